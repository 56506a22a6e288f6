"""Media columns: signature sniffing, type correction, carving and decoding.

An Aho-Corasick automaton finds all magic bytes of a blob in one pass. At each hit the format's validator
follows the structure (chunks, sizes, checksums) and either gives the length of a whole, well-formed
file or rejects the hit. A valid file at offset 0 gives the blob's true type, whatever was declared;
valid files further in are carved: their type, offset and length are listed.

Defined results: a null blob is empty and has no type; a blob without a valid signature keeps its
declared type and is marked invalid; bytes after a valid file are reported as trailing; equal blobs give
equal results; of two valid files at one place the longer comes first; a blob of any length is taken whole (one
must fit in a task); repeated rows and null ids each keep their row; an empty table gives an empty result;
`store_texts` reads no further columns, `sniff_media` passes them on (its own names must not be among them).
The query stores the media column as a Parquet table in the shared folder and sniffs what it reads back.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.arrays import slices
from loomgraph.session import materialise, table

UNIT = 576


def _png(b: bytes, at: int) -> int | None:
    pos, first = at + 8, True
    while pos + 12 <= len(b):
        (n,), kind = struct.unpack_from(">I", b, pos), b[pos + 4 : pos + 8]
        if pos + 12 + n > len(b) or first != (kind == b"IHDR") or (first and n != 13):
            return None
        if zlib.crc32(memoryview(b)[pos + 4 : pos + 8 + n]) != struct.unpack_from(">I", b, pos + 8 + n)[0]:
            return None
        pos, first = pos + 12 + n, False
        if kind == b"IEND":
            return pos - at
    return None


def _wav(b: bytes, at: int) -> int | None:
    if b[at + 8 : at + 12] != b"WAVE" or len(b) < at + 44:
        return None
    end, pos, seen = at + 8 + struct.unpack_from("<I", b, at + 4)[0], at + 12, set()
    while pos + 8 <= min(end, len(b)):
        kind, n = b[pos : pos + 4], struct.unpack_from("<I", b, pos + 4)[0]
        seen.add(kind)
        pos += 8 + n + n % 2
    return end - at if pos == end <= len(b) and {b"fmt ", b"data"} <= seen else None


def _bmp(b: bytes, at: int) -> int | None:
    if len(b) < at + 54:
        return None
    size, zero, start, head, w, h, planes, depth = struct.unpack_from("<IIIIiiHH", b, at + 2)
    if zero or head != 40 or planes != 1 or depth not in (1, 4, 8, 24, 32) or w <= 0 or not h or start < 54:
        return None
    want = start + (w * depth + 31) // 32 * 4 * abs(h)
    return size if size == want and at + size <= len(b) else None


def _pgm(b: bytes, at: int) -> int | None:
    head = re.compile(rb"P5\s+(\d{1,9})\s+(\d{1,9})\s+(\d{1,5})\s").match(b, at)
    if not head:
        return None
    w, h, top = map(int, head.groups())
    n = head.end() - at + w * h * (1 if top < 256 else 2)
    return n if w and h and 0 < top < 65536 and at + n <= len(b) else None


def _au(b: bytes, at: int) -> int | None:
    if len(b) < at + 24:
        return None
    start, size, coding, rate, channels = struct.unpack_from(">IIIII", b, at + 4)
    if start < 24 or not 1 <= coding <= 27 or not 1000 <= rate <= 768000 or not 1 <= channels <= 64 or size == 0xFFFFFFFF:
        return None
    return start + size if at + start + size <= len(b) else None


def _gif(b: bytes, at: int) -> int | None:
    if len(b) < at + 13 or b[at + 3 : at + 6] not in (b"87a", b"89a"):
        return None
    flags = b[at + 10]
    pos = at + 13 + (3 * 2 ** ((flags & 7) + 1) if flags & 128 else 0)
    images = 0
    while pos < len(b):
        kind = b[pos]
        if kind == 0x3B:
            return pos + 1 - at if images else None
        if kind == 0x21:
            pos += 2
        elif kind == 0x2C and pos + 10 <= len(b):
            local = b[pos + 9]
            pos += 11 + (3 * 2 ** ((local & 7) + 1) if local & 128 else 0)
            images += 1
        else:
            return None
        while pos < len(b) and b[pos]:
            pos += 1 + b[pos]
        pos += 1
    return None


def _jpeg(b: bytes, at: int) -> int | None:
    pos, scan = at + 2, False
    while pos + 4 <= len(b) or (scan and pos + 2 <= len(b)):
        if b[pos] != 0xFF:
            return None
        kind = b[pos + 1]
        if kind == 0xD9:
            return pos + 2 - at if scan else None
        if kind in (0x00, 0x01) or 0xD0 <= kind <= 0xD8 or pos + 4 > len(b):
            return None
        pos += 2 + struct.unpack_from(">H", b, pos + 2)[0]
        if kind == 0xDA:
            scan = True
            while (pos := b.find(b"\xff", pos)) >= 0 and pos + 1 < len(b) and (b[pos + 1] == 0 or 0xD0 <= b[pos + 1] <= 0xD7):
                pos += 2
            if pos < 0 or pos + 1 >= len(b):
                return None
    return None


#: Magic bytes and media type of each format, from its public specification.
FORMATS: dict[str, tuple[bytes, str, Callable[[bytes, int], int | None]]] = {
    "png": (b"\x89PNG\r\n\x1a\n", "image/png", _png),
    "wav": (b"RIFF", "audio/wav", _wav),
    "bmp": (b"BM", "image/bmp", _bmp),
    "pgm": (b"P5", "image/x-portable-graymap", _pgm),
    "au": (b".snd", "audio/basic", _au),
    "gif": (b"GIF8", "image/gif", _gif),
    "jpeg": (b"\xff\xd8\xff", "image/jpeg", _jpeg),
}


@lru_cache(maxsize=1)
def _automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for name, (magic, _, _) in FORMATS.items():
        found.add_word(magic.decode("latin-1"), (name, len(magic)))
    found.make_automaton()
    return found


def sniff(blob: bytes) -> list[tuple[str, int, int]]:
    """(format, offset, length) of each well-formed file that the blob holds, in order."""
    out = []
    for end, (name, size) in _automaton().iter(blob.decode("latin-1")):
        at = end + 1 - size
        if (n := FORMATS[name][2](blob, at)) is not None:
            out.append((name, at, n))
    return sorted(out, key=lambda x: (x[1], -x[2]))


def encode(payload: bytes, name: str) -> bytes:
    """8-bit samples in a file of this format; rows of UNIT samples for images."""
    n, rows = len(payload), len(payload) // UNIT
    if name == "wav":
        return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + n + n % 2, b"WAVE", b"fmt ", 16, 1, 1, 8000, 8000, 1, 8, b"data", n) + payload + b"\0" * (n % 2)
    if name == "au":
        return struct.pack(">4sIIIII", b".snd", 24, n, 2, 8000, 1) + payload
    if name == "pgm":
        return b"P5\n%d %d\n255\n" % (UNIT, rows) + payload
    if name == "bmp":
        palette = bytes(x for i in range(256) for x in (i, i, i, 0))
        return struct.pack("<2sIIIIiiHHIIiiII", b"BM", 1078 + n, 0, 1078, 40, UNIT, -rows, 1, 8, 0, n, 2835, 2835, 256, 0) + palette + payload
    if name == "png":
        part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
        lines = np.zeros((rows, UNIT + 1), np.uint8)
        lines[:, 1:] = np.frombuffer(payload, np.uint8).reshape(rows, UNIT)
        return FORMATS["png"][0] + part(b"IHDR", struct.pack(">IIBBBBB", UNIT, rows, 8, 0, 0, 0, 0)) + part(b"IDAT", zlib.compress(lines.tobytes(), 1)) + part(b"IEND", b"")
    raise ValueError(f"no writer for {name}")


def decode(blob: bytes, name: str) -> bytes:
    """The samples of a file that `encode` can write."""
    if name == "wav":
        pos = 12
        while blob[pos : pos + 4] != b"data":
            pos += 8 + struct.unpack_from("<I", blob, pos + 4)[0]
        return blob[pos + 8 : pos + 8 + struct.unpack_from("<I", blob, pos + 4)[0]]
    if name == "au":
        start, n = struct.unpack_from(">II", blob, 4)
        return blob[start : start + n]
    if name == "pgm":
        return blob[re.compile(rb"P5\s+\d+\s+\d+\s+\d+\s").match(blob).end() :]
    if name == "bmp":
        return blob[struct.unpack_from("<I", blob, 10)[0] :]
    if name == "png":
        pos, data, width = 8, [], struct.unpack_from(">I", blob, 16)[0]
        while pos < len(blob):
            n = struct.unpack_from(">I", blob, pos)[0]
            if blob[pos + 4 : pos + 8] == b"IDAT":
                data.append(blob[pos + 8 : pos + 8 + n])
            pos += 12 + n
        lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(-1, width + 1)
        if lines[:, 0].any():
            raise ValueError("only unfiltered lines are decoded")
        return lines[:, 1:].tobytes()
    raise ValueError(f"no reader for {name}")


_WRITERS = ("wav", "png", "bmp", "pgm", "au")


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, buf, off in slices(batch, "text"):
            sizes, declared, blobs = [], [], []
            for i in range(len(off) - 1):
                text = buf[off[i] : off[i + 1]].tobytes()
                payload = text + b"\xff" * (-len(text) % UNIT if text else UNIT)
                pick = hashlib.sha256(payload).digest()
                sizes.append(len(text))
                declared.append(FORMATS[_WRITERS[pick[1] % 5]][1])
                blobs.append(encode(payload, _WRITERS[pick[0] % 5]))
            yield pa.RecordBatch.from_arrays([rows.column("id"), pa.array(sizes, pa.int64()), pa.array(declared), pa.array(blobs, pa.binary())], ["id", "n_bytes", "declared", "media"])


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Texts as a media column: id, n_bytes, declared (type, often wrong) and media.

    The payload is the text in UTF-8 filled up with 255 to a positive multiple of UNIT; its digest
    picks the format and the declared type.
    """
    src = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return src.mapInArrow(_store, f"id {src.schema['id'].dataType.simpleString()}, n_bytes long, declared string, media binary")


_SNIFFED = (
    "media_type string, valid boolean, corrected boolean, media_bytes long, media_sha256 string, payload_bytes long, payload_sha256 string, tail_crc32 long,"
    " trailing long, mean double, carved array<struct<type:string,at:long,length:long>>"
)


def _sniffer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    carve = pa.list_(pa.struct([("type", pa.string()), ("at", pa.int64()), ("length", pa.int64())]))
    types = [pa.string(), pa.bool_(), pa.bool_(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64(), carve]
    names = [x.split()[0] for x in re.sub(r"<.*>", "", _SNIFFED).split(",")]
    for batch in batches:
        for rows, buf, off in slices(batch, "media"):
            out = []
            for i, declared in enumerate(rows.column("declared").to_pylist()):
                blob = buf[off[i] : off[i + 1]].tobytes()
                found = sniff(blob)
                whole = next((x for x in found if x[1] == 0), None)
                kind = FORMATS[whole[0]][1] if whole else declared
                inner = [{"type": FORMATS[n][1], "at": at, "length": size} for n, at, size in found if at]
                length = whole[2] if whole else len(blob)
                payload = decode(blob[:length], whole[0]) if whole and whole[0] in _WRITERS else None
                read = (None, None, None, None) if payload is None else (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), float(np.frombuffer(payload, np.uint8).mean()) if payload else None)
                out.append((kind, whole is not None, kind != declared, length, hashlib.sha256(blob[:length]).hexdigest(), *read[:3], len(blob) - length, read[3], inner))
            yield pa.RecordBatch.from_arrays([*rows.drop_columns(["media"]).columns, *(pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), types, strict=True))], [*rows.drop_columns(["media"]).schema.names, *names])


def sniff_media(media: DataFrame) -> DataFrame:
    """Sniff media(…, declared, media): its other columns with what was found in each blob.

    media_type is the corrected type, carved lists files inside; payload_* are the decoded samples of
    formats that can be decoded, else null.
    """
    rest = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in media.schema if f.name != "media")
    return media.mapInArrow(_sniffer, f"{rest}, {_SNIFFED}")


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = materialise(store_texts(table(spark, sf_dir, "documents")), "media")
    got = sniff_media(stored)
    feature = F.concat_ws(";", "media_type", F.when(F.col("corrected"), F.concat(F.lit("was "), "declared")).otherwise("as declared"), F.format_string("mean=%.6f", "mean"), F.concat(F.lit("carved="), F.size("carved")))
    return got.select(F.col("id").alias("doc_id"), "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))


QUERIES = {"op9_media": op9_media}
ORACLE: dict[str, str] = {}
