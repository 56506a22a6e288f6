"""Removal of repeated substrings by bucket-pointer refinement of suffixes.

Every start of a `length`-byte window is a suffix to be sorted to that depth. The initial bucket of a
suffix is named by a q-gram: the q-gram of least identifier in its window, so suffixes of equal windows
are in equal buckets, and a run of neighbouring suffixes shares a bucket.

1. Runs are counted by bucket; suffixes alone in a bucket are unique and leave. Buckets with company are
   joined to their runs, at any number of buckets.
2. Runs whose whole string occurs again (by bucket and a 128-bit BLAKE2b name) repeat as a whole; one
   occurrence goes on to stand for them.
3. What is left of a bucket is refined in one place, from the bytes of its runs: identifiers of 8 bytes,
   which are the bytes themselves, are doubled with those of later offsets to 16, 32, 64, ... up to `length`
   bytes, each level reusing the last. Suffixes are sorted on the identifiers of 64 bytes on, and
   those alone in theirs leave before the next level. Equal neighbours of the last level are compared
   byte for byte, so a collision of identifiers never removes a byte.

A bucket of more than HOT_RUNS runs is dealt to several tasks by the window's identifier; there
the identifiers themselves travel, in 128 bits, and are not compared with bytes again. Equal ones of one
slice are decided there, and one of them goes on.

Only rows about runs are shuffled at levels 1 and 2, each distinct text once, to meet its runs, and the bytes
of the runs that level 3 needs.

Defined results: a null text is empty; texts shorter than `length` keep all bytes; repeats within a
text and overlapping ones count; copies of a text are repeats of each other; a text of any length is
taken whole (one text must fit in a task); with ties (equal windows) all go; null ids and repeated rows
each keep their row; an empty table gives an empty result; further columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.arrays import doubled, eights, mix64, owners, slices, windows
from loomgraph.llm.skew import join_counted
from loomgraph.session import materialise, table

LENGTH, GRAM = 200, 32
#: A bucket of more runs than this is dealt to several tasks.
HOT_RUNS = 2_000
_FLUSH = 1 << 20
_U = np.uint64


def _slide(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each `width` neighbours, by doubling."""
    out, size = values, 1
    while size * 2 <= width:
        out = np.minimum(out[: len(out) - size], out[size:])
        size *= 2
    if size < width:
        out = np.minimum(out[: len(out) - (width - size)], out[width - size :])
    return out


def runs(buf: np.ndarray, off: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one bucket: (identifiers of q-grams, text, first, last, bucket), places in buf."""
    h = windows(buf, gram)
    none = np.zeros(0, np.int64)
    if len(buf) < length:
        return h, none, none, none, np.zeros(0, np.uint64)
    low = _slide(h, length - gram + 1)
    text = owners(off)[: len(low)]
    valid = np.arange(len(low)) + length <= off[1:][text]
    edge = np.concatenate(([True], (low[1:] != low[:-1]) | (text[1:] != text[:-1])))
    first = np.flatnonzero(valid & (edge | ~np.concatenate(([False], valid[:-1]))))
    last = np.flatnonzero(valid & np.concatenate((edge[1:] | ~valid[1:], [True])))
    return h, text[first], first, last, low[first]


def _twice(h: np.ndarray, first: np.ndarray, last: np.ndarray, bucket: np.ndarray, width: int) -> np.ndarray:
    """Runs that hold their bucket's q-gram more than once, so that suffixes of one run may be equal."""
    out = np.empty(len(first), bool)
    view = np.lib.stride_tricks.sliding_window_view(h, width)
    for k in range(0, len(first), 4096):
        at = slice(k, k + 4096)
        a, b = view[first[at]] == bucket[at, None], view[last[at]] == bucket[at, None]
        left, right = first[at] + a.argmax(axis=1), last[at] + width - 1 - b[:, ::-1].argmax(axis=1)
        out[at] = (left != right) | (a.sum(axis=1) > 1)
    return out


def _buckets(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, buf, off in slices(batch, "text"):
                h, _, first, last, bucket = runs(buf, off, length, gram)
                if len(first):
                    again = _twice(h, first, last, bucket, length - gram + 1)
                    yield pa.RecordBatch.from_arrays([pa.array(bucket.view(np.int64)), pa.array(1 + again.astype(np.int32))], ["v", "n"])

    return run


def _run_names(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, buf, off in slices(batch, "text"):
                _, text, first, last, bucket = runs(buf, off, length, gram)
                if len(first):
                    view = memoryview(np.ascontiguousarray(buf))
                    names = [hashlib.blake2b(view[a:b], digest_size=16).digest() for a, b in zip(first.tolist(), (last + length).tolist(), strict=True)]
                    place = (first - off[text] << 32) | (last - off[text])
                    yield pa.RecordBatch.from_arrays([pa.array(bucket.view(np.int64)), pa.array(names, pa.binary()), rows.column("th").take(pa.array(text)), pa.array(place)], ["v", "name", "th", "place"])

    return run


_SUFFIXES = "v long, part int, th binary, stands boolean, first int, n int, data binary, at binary"
_NAMES = [x.split()[0] for x in _SUFFIXES.split(", ")]
_TYPES = [pa.int64(), pa.int32(), pa.binary(), pa.bool_(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]


def _suffixes(length: int):
    """The runs that go on, as bytes; for hot buckets the identifiers of windows, by part.

    Of equal identifiers in a slice one goes on to stand for the others, so a window that is in every text
    is not one row for each. The spans that this decides are rows without data.
    """

    def hot_rows(buf: np.ndarray, found: list[tuple]) -> Iterator[tuple]:
        n = np.array([x[4] for x in found])
        region = np.concatenate([buf[x[5] : x[5] + x[4] + length - 1] for x in found])
        base = np.cumsum(n + length - 1) - (n + length - 1)
        run = np.repeat(np.arange(len(n)), n)
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        ids = np.stack([windows(region, length, seed)[base[run] + inside] for seed in (1, 2)], axis=1)
        v, parts = (np.array([x[k] for x in found], np.int64)[run] for k in (0, 1))
        part = (ids[:, 0] % parts.astype(np.uint64)).astype(np.int64)
        order = np.lexsort((ids[:, 1], ids[:, 0]))
        same = np.concatenate(([False], (ids[order][1:] == ids[order][:-1]).all(axis=1)))
        dup, lead = _both(order, same, len(ids)), np.zeros(len(ids), bool)
        lead[order[:-1][same[1:] & ~same[:-1]]] = True

        def groups(at: np.ndarray, a: np.ndarray) -> Iterator[np.ndarray]:
            at = at[np.lexsort((part[at], a[at]))]
            cut = np.flatnonzero((a[at][1:] != a[at][:-1]) | (part[at][1:] != part[at][:-1])) + 1
            return iter(np.split(at, cut)) if len(at) else iter(())

        for at in groups(np.flatnonzero(lead), v):
            yield int(v[at[0]]), int(part[at[0]]), b"", True, 0, len(at), ids[at].tobytes(), b""
        for at in groups(np.flatnonzero(~dup), run):
            _, _, th, stands, *_, first = found[run[at[0]]]
            yield int(v[at[0]]), int(part[at[0]]), th, stands, first, len(at), ids[at].tobytes(), inside[at].astype(np.int32).tobytes()
        for k in np.unique(run[dup]).tolist():
            _, _, th, *_, first = found[k]
            yield int.from_bytes(th[:8], "big", signed=True), -1, th, False, 0, 0, None, _spans(first + inside[dup & (run == k)]).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, buf, off in slices(batch, "text"):
                out: list[tuple] = []
                hot: list[tuple] = []
                for i, (th, found) in enumerate(zip(rows.column("th").to_pylist(), rows.column("runs").to_pylist(), strict=True)):
                    for x in found or ():
                        if x["state"] == 1:
                            continue
                        first, n = x["place"] >> 32, (x["place"] & 0xFFFFFFFF) - (x["place"] >> 32) + 1
                        at = int(off[i]) + first
                        if x["parts"] == 1:
                            out.append((x["v"], 0, th, x["state"] == 2, first, n, buf[at : at + n + length - 1].tobytes(), None))
                        else:
                            hot.append((x["v"], x["parts"], th, x["state"] == 2, n, at, first))
                if hot:
                    out.extend(hot_rows(buf, hot))
                for k in range(0, len(out), 4096):
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out[k : k + 4096], strict=True), _TYPES, strict=True)], _NAMES)

    return run


def _company(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order that sorts ids, and for each place of it whether it equals the one before."""
    order = np.argsort(ids, kind="stable")
    return order, np.concatenate(([False], ids[order][1:] == ids[order][:-1]))


def _both(order: np.ndarray, same: np.ndarray, n: int) -> np.ndarray:
    """Which of n suffixes equal the one before or after them in the order."""
    out = np.zeros(n, bool)
    out[order[same]] = True
    out[order[:-1][same[1:]]] = True
    return out


def refine(buf: np.ndarray, start: np.ndarray, length: int) -> np.ndarray:
    """Which of the suffixes that start there have an equal window of `length` bytes among them."""
    exact = eights(buf)
    ids, have, alive = mix64(exact), 8, np.arange(len(start))
    while have < length and len(alive):
        wide = min(2 * have, length)
        ids, have = doubled(ids, have, wide), wide
        if 64 <= have < length:
            alive = alive[_both(*_company(ids[start[alive]]), len(alive))]
    out = np.zeros(len(start), bool)
    if len(alive) < 2:
        return out
    at = start[alive]
    order, same = _company(ids[at])
    while True:
        follow = np.flatnonzero(same)
        a, b = at[order[follow - 1]], at[order[follow]]
        equal = np.ones(len(follow), bool)
        for k in (*range(0, length - 8, 8), length - 8):
            equal &= exact[a + k] == exact[b + k]
        if equal.all():
            out[alive[_both(order, same, len(at))]] = True
            return out
        # different windows under one identifier: sort these by their bytes
        group = np.cumsum(~same)
        for g in np.unique(group[follow[~equal]]).tolist():
            span = np.flatnonzero(group == g)
            keys = [buf[p : p + length].tobytes() for p in at[order[span]].tolist()]
            by = sorted(range(len(span)), key=keys.__getitem__)
            order[span] = order[span][by]
            same[span] = [j > 0 and keys[by[j]] == keys[by[j - 1]] for j in range(len(span))]


def _spans(places: np.ndarray) -> np.ndarray:
    """(first, last) of each stretch of consecutive numbers."""
    cut = np.flatnonzero(np.diff(places) != 1)
    return np.stack((places[np.concatenate(([0], cut + 1))], places[np.concatenate((cut, [len(places) - 1]))]), axis=1).astype(np.int32)


def _sort_suffixes(length: int):
    """Rows come sorted by (v, part); whole buckets are gathered until there is enough to sort."""

    def repeats(held: list[tuple]) -> Iterator[tuple]:
        n = np.array([x[3] for x in held])
        if held[0][5] is None:
            size = np.array([len(x[4]) for x in held])
            base = np.cumsum(size) - size
            inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            dup = refine(np.frombuffer(b"".join(x[4] for x in held), np.uint8), np.repeat(base, n) + inside, length)
        else:
            ids = np.frombuffer(b"".join(x[4] for x in held), np.uint64).reshape(-1, 2)
            order = np.lexsort((ids[:, 1], ids[:, 0]))
            dup = _both(order, np.concatenate(([False], (ids[order][1:] == ids[order][:-1]).all(axis=1))), len(ids))
        for (th, stands, first, _, _, at), mine in zip(held, np.split(dup, np.cumsum(n)[:-1]), strict=True):
            if not stands and mine.any():
                places = np.flatnonzero(mine)
                yield th, _spans(first + (places if at is None else np.frombuffer(at, np.int32)[places])).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bool, list[tuple]] = {False: [], True: []}
        size, last, decided = {False: 0, True: 0}, None, []

        def flush(kind: bool) -> Iterator[pa.RecordBatch]:
            out = list(repeats(held[kind])) if held[kind] else []
            held[kind], size[kind] = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.binary()) for c in zip(*out, strict=True)], ["th", "spans"])

        for batch in batches:
            for v, part, *row in zip(*(batch.column(c).to_pylist() for c in _NAMES), strict=True):
                if (v, part) != last:
                    for kind in held:
                        if size[kind] > _FLUSH:
                            yield from flush(kind)
                last = (v, part)
                if row[4] is None:
                    decided.append((row[0], row[5]))
                    if len(decided) >= 4096:
                        yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.binary()) for c in zip(*decided, strict=True)], ["th", "spans"])
                        decided = []
                    continue
                kind = row[5] is not None
                held[kind].append(tuple(row))
                size[kind] += len(row[4]) // (16 if kind else 1)
        for kind in held:
            yield from flush(kind)
        if decided:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.binary()) for c in zip(*decided, strict=True)], ["th", "spans"])

    return run


def _cut(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, buf, off in slices(batch, "text"):
                out = []
                for i, (whole, single) in enumerate(zip(rows.column("runs").to_pylist(), rows.column("spans").to_pylist(), strict=True)):
                    text = buf[off[i] : off[i + 1]]
                    step = np.zeros(len(text) + 1, np.int32)
                    both = np.array([(x["place"] >> 32, x["place"] & 0xFFFFFFFF) for x in whole or () if x["state"]], np.int64).reshape(-1, 2)
                    both = np.concatenate((both, np.frombuffer(b"".join(single or ()), np.int32).reshape(-1, 2)))
                    np.add.at(step, both[:, 0], 1)
                    np.add.at(step, both[:, 1] + length, -1)
                    gone = np.cumsum(step)[:-1] > 0
                    spans = int((gone & ~np.concatenate(([False], gone[:-1]))).sum()) if len(text) else 0
                    out.append((len(text), int(gone.sum()), spans, hashlib.sha256(text[~gone].tobytes()).hexdigest(), text[~gone].tobytes()))
                n, removed, spans, sha, kept = (list(c) for c in zip(*out, strict=True))
                columns = [rows.column("th"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha), pa.array(kept, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["th", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_bytes, n_removed, n_spans, kept_sha256 and kept (remaining bytes).

    Removed is each byte of a `length`-byte string that also starts anywhere else.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    src = docs.select(F.col(id_col).alias("id"), F.unhex(F.substr(F.sha2(text, 256), F.lit(1), F.lit(32))).alias("th"), text.alias("text"))
    counted = src.select("text").mapInArrow(_buckets(length, gram), "v long, n int").groupBy("v").agg(F.sum("n").alias("n"))
    shared = materialise(counted.filter("n > 1"), "buckets")
    named = src.select("th", "text").mapInArrow(_run_names(length, gram), "v long, name binary, th binary, place long")
    named = materialise(join_counted(named, shared, ["v"], ["th", "place"], "n"), "runs")
    place = F.struct("th", "place")
    again = materialise(named.groupBy("v", "name").agg(F.count(F.lit(1)).alias("m"), F.min(place).alias("stands")).filter("m > 1"), "repeated-runs")
    # 0: undecided, 1: repeats as a whole, 2: so does this one, and it stands for the others
    state = F.when(F.col("stands").isNull(), 0).when(F.col("stands") == place, 2).otherwise(1)
    parts = F.floor((F.col("n") - 1) / HOT_RUNS).cast("int") + 1
    known = join_counted(named, again, ["v", "name"], ["th", "place"], "m", "left").select("th", F.struct("v", "place", parts.alias("parts"), state.alias("state")).alias("run"))
    per_text = materialise(known.groupBy("th").agg(F.collect_set("run").alias("runs")), "text-runs")
    met = src.groupBy("th").agg(F.first("text").alias("text")).join(per_text, "th", "left")
    suffixes = met.select("th", "text", "runs").mapInArrow(_suffixes(length), _SUFFIXES)
    single = suffixes.repartition("v", "part").sortWithinPartitions("v", "part").mapInArrow(_sort_suffixes(length), "th binary, spans binary")
    single = single.groupBy("th").agg(F.collect_list("spans").alias("spans"))
    cut = met.join(single, "th", "left").select("th", "text", "runs", "spans").mapInArrow(_cut(length), "th binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    copies = materialise(src.groupBy("th").agg(F.count(F.lit(1)).alias("m")), "copies")
    rows = src.select("id", "th", F.monotonically_increasing_id().alias("uid"))
    wide = join_counted(rows, cut, ["th"], ["uid"], "m", counted=copies)
    return wide.select(F.col("id").alias(id_col), "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


QUERIES = {"op6_substring_dedup": op6_substring_dedup}
ORACLE: dict[str, str] = {}
