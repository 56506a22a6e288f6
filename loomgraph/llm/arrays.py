"""Vectorised byte work on whole Arrow batches of texts (NumPy, no loop over characters).

Batches are cut into slices of a few MB so that 8-byte temporaries stay small; a slice holds whole
texts, so memory is bounded by the slice size or by the longest single text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_U = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the word (murmur3's published constants)."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x ^= x >> _U(33)
    x *= _U(0xC4CEB9FE1A85EC53)
    x ^= x >> _U(33)
    return x


@lru_cache(maxsize=4)
def byte_table(seed: int) -> np.ndarray:
    """256 pseudo-random 64-bit words, one for each byte value."""
    return mix64(np.arange(1, 257, dtype=np.uint64) * _U(0xD6E8FEB86659FD93) + _U(seed))


def eights(buf: np.ndarray) -> np.ndarray:
    """Every eight bytes of the buffer as one number, so exactly."""
    out = np.empty(max(0, len(buf) - 7), np.uint64)
    for s in range(8):
        n = (len(buf) - s) // 8
        if n > 0:
            out[s::8] = buf[s : s + 8 * n].view("<u8")
    return out


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The identifier of two neighbours, from theirs."""
    return mix64(a * _U(_BASE) + b)


def doubled(ids: np.ndarray, have: int, width: int) -> np.ndarray:
    """Identifiers of every `width` bytes (at most 2 * have) from those of every `have` bytes."""
    step = width - have
    return pair(ids[: max(0, len(ids) - step)], ids[step:])


def windows(buf: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
    """Identifiers of every `width` bytes (8 at least), by doubling from eight bytes on."""
    ids, have = mix64(eights(buf) ^ mix64(np.array([seed + 1], np.uint64))), 8
    while have < width:
        wide = min(2 * have, width)
        ids, have = doubled(ids, have, wide), wide
    return ids


_MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
LONG_RANGE = 128


def fingerprints(buf: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 1) -> np.ndarray:
    """Fingerprints of ranges of a buffer: eight bytes a step through a mixer, BLAKE2b beyond LONG_RANGE bytes.

    Ranges of one length up to eight bytes never collide. Longer ones that do can be made on purpose, so equal
    fingerprints make candidates; what depends on equality asks `exact_shingles`.
    """
    size = end - start
    h = mix64(size.astype(np.uint64) * _U(_BASE) + _U(seed))
    eight = eights(np.concatenate((buf, np.zeros(8, np.uint8))))
    todo, at = np.flatnonzero((size > 0) & (size <= LONG_RANGE)), 0
    while len(todo):
        left = size[todo] - at
        block = eight[start[todo] + at] & _MASK[np.minimum(left, 8)]
        h[todo] = mix64((h[todo] ^ block) * _U(_BASE))
        at, todo = at + 8, todo[left > 8]
    for i in np.flatnonzero(size > LONG_RANGE).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(buf[start[i] : end[i]].tobytes(), digest_size=8, key=seed.to_bytes(4, "big")).digest(), "little")
    return h


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string or binary column and the n + 1 offsets; a null is empty."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    off = np.frombuffer(offsets, kind, len(column) + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64) if offsets else np.zeros(len(column) + 1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), off


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets from 0) with at most `most` bytes of text, or a single longer text."""
    if not batch.num_rows:
        return
    buf, off = text_buffers(batch.column(column))
    start = 0
    while start < batch.num_rows:
        end = max(start + 1, int(np.searchsorted(off, off[start] + most, "right")) - 1)
        end = min(end, batch.num_rows)
        yield batch.slice(start, end - start), buf[off[start] : off[end]], off[start : end + 1] - off[start]
        start = end


def owners(off: np.ndarray) -> np.ndarray:
    """For each byte the number of its text."""
    return np.repeat(np.arange(len(off) - 1), np.diff(off))


_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), 95, *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(fingerprint, text number, start) of each word.

    A word is a longest run of ASCII letters, digits, underscores and bytes of non-ASCII characters,
    with ASCII letters in lower case; runs end where a text ends.
    """
    if not len(buf):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = _WORD[buf]
    before = np.concatenate(([False], inside[:-1]))
    first = off[:-1][np.diff(off) > 0]
    before[first] = False
    start = np.flatnonzero(inside & ~before)
    after = np.concatenate((inside[1:], [False]))
    after[first[1:] - 1] = False
    end = np.flatnonzero(inside & ~after) + 1
    text = np.searchsorted(off, start, "right") - 1
    return fingerprints(_LOWER[buf], start, end, 7), text, start


def shingles(buf: np.ndarray, off: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct k-word shingles of each text: (text number, fingerprint, count), sorted by both.

    A text of fewer than k words, but at least one, has one shingle of all its words.
    """
    w, text, _ = words(buf, off)
    if not len(w):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    n = np.bincount(text, minlength=len(off) - 1)
    head = np.concatenate(([0], np.cumsum(n)))[:-1]
    take = np.minimum(n, k)
    h = np.zeros(len(w), np.uint64)
    left = (head + n)[text] - np.arange(len(w))
    for j in range(k):
        ok = left > j
        step = np.zeros(len(w), np.uint64)
        step[ok] = w[np.flatnonzero(ok) + j]
        h = np.where(ok, mix64(h * _U(_BASE) + step + _U(j + 1)), h)
    keep = left >= take[text]
    keep &= (n[text] >= k) | (np.arange(len(w)) == head[text])
    text, h = text[keep], h[keep]
    order = np.lexsort((h, text))
    text, h = text[order], h[order]
    new = np.concatenate(([True], (h[1:] != h[:-1]) | (text[1:] != text[:-1])))
    at = np.flatnonzero(new)
    return text[at], h[at], np.diff(np.concatenate((at, [len(h)])))


def exact_shingles(text: bytes, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingles of one text as sorted BLAKE2b digests of 128 bits, and their counts."""
    buf = np.frombuffer(text, np.uint8)
    inside = _WORD[buf]
    before = np.concatenate(([False], inside[:-1]))
    kept = inside | before  # words and the one byte after each
    own = inside[kept]
    plain = np.where(own, _LOWER[buf[kept]], 32)
    first = np.flatnonzero(own & ~np.concatenate(([False], own[:-1])))
    last = np.flatnonzero(own & ~np.concatenate((own[1:], [False]))) + 1
    if not len(first):
        return np.zeros(0, "S16"), np.zeros(0, np.int64)
    k = min(k, len(first))
    view = memoryview(np.ascontiguousarray(plain.astype(np.uint8)))
    ends = zip(first[: len(first) - k + 1].tolist(), last[k - 1 :].tolist(), strict=True)
    digests = b"".join(hashlib.blake2b(view[a:b], digest_size=16, key=b"shingle").digest() for a, b in ends)
    return np.unique(np.frombuffer(digests, "S16"), return_counts=True)
