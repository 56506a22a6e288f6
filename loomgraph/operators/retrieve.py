"""Retrieval: seeds, fuzzy names, hits, fusion under a token budget, and review decisions."""

from __future__ import annotations

import difflib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.config import Settings
from loomgraph.functions.text import confidence, confidence_rank, confidence_weight, length_band, normalize_entity, render_hit
from loomgraph.functions.tokens import quarter_count
from loomgraph.operators import graph
from loomgraph.operators.community import overlap
from loomgraph.session import materialise, numbered

HEADER = "已知知识点："


def normalized_nodes(nodes: DataFrame) -> DataFrame:
    """(norm, name) of each node with a non-empty normal form."""
    return nodes.select(normalize_entity(F.col("name")).alias("norm"), "name").filter("norm != ''")


def exact_seeds(entities: DataFrame, names: DataFrame) -> DataFrame:
    """(entity, name): all nodes whose normal form is the entity's."""
    asked = entities.select(F.col("name").alias("entity"), normalize_entity(F.col("name")).alias("norm")).filter("norm != ''").distinct()
    return asked.join(names, "norm").select("entity", "name")


def fuzzy_candidates(entities: DataFrame, names: DataFrame, cutoff: float) -> DataFrame:
    """(entity_norm, norm) within the length band: an equi-join on length, not a nested loop."""
    asked = entities.select(normalize_entity(F.col("name")).alias("entity_norm")).filter("entity_norm != ''").distinct()
    low, high = length_band(F.length("entity_norm"), cutoff)
    band = asked.select("entity_norm", F.explode(F.sequence(low, F.greatest(low, high))).alias("len"))
    known = names.select("norm").distinct().withColumn("len", F.length("norm"))
    return band.join(known, "len").select("entity_norm", "norm")


#: Characters of a block of names and of a block of entities: what one task holds of either at a time.
NAME_CHARS, ENTITY_CHARS, SCORES = 1 << 19, 1 << 17, 1 << 23


def _blocked(rows: DataFrame, chars: int, prefix: str) -> tuple[DataFrame, DataFrame]:
    """rows (norm) with length and block, and the number of blocks of each length; a block holds about `chars` characters."""
    rows = materialise(rows.select("norm", F.length("norm").alias(f"{prefix}_len")), prefix)
    size = rows.groupBy(f"{prefix}_len").agg(F.ceil(F.count(F.lit(1)) * F.col(f"{prefix}_len") / chars).alias("n"))
    block = F.pmod(F.xxhash64("norm"), F.col("n")).alias(f"{prefix}_block")
    return rows.join(F.broadcast(size), f"{prefix}_len").select("norm", f"{prefix}_len", block), size


def _marks(names: pa.ChunkedArray, size: int) -> np.ndarray:
    """A row for each name of this many characters: these as sorted marks, the second `a` of a name being another mark than its first.

    The multiset of characters becomes a set, so common characters are the common marks.
    """
    code = np.sort(np.frombuffer("".join(names.to_pylist()).encode("utf-32-le"), np.uint32).reshape(-1, size), axis=1)
    place = np.broadcast_to(np.arange(size), code.shape)
    starts = np.concatenate((np.ones((len(code), 1), bool), code[:, 1:] != code[:, :-1]), axis=1)
    nth = place - np.maximum.accumulate(np.where(starts, place, 0), axis=1)
    return (code.astype(np.int64) << 32) | nth


def _incidence(marks: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of the known marks each row has, as 0 and 1."""
    at = np.minimum(np.searchsorted(known, marks), len(known) - 1)
    row, column = np.nonzero(known[at] == marks)
    out = np.zeros((len(marks), len(known)), np.float32)
    out[row, at[row, column]] = 1
    return out


def _common_enough(cutoff: float):
    """Pairs of a block of entities and a block of names with enough common marks, counted by products of 0-1 matrices."""

    def run(asked: pa.Table, known: pa.Table) -> pa.Table:
        schema, out = pa.schema([("entity_norm", pa.string()), ("norm", pa.string())]), []
        if asked.num_rows and known.num_rows:
            a, b = asked["asked_len"][0].as_py(), known["known_len"][0].as_py()
            # two names of lengths a and b reach the cutoff by 2 * M / (a + b) with M common characters
            least = np.ceil((a + b) * cutoff / 2 - 1e-9)
            entity, name = asked["norm"].combine_chunks(), known["norm"].combine_chunks()
            mine, theirs = _marks(asked["norm"], a), _marks(known["norm"], b)
            every = np.unique(mine)
            mine, step = _incidence(mine, every), max(1, SCORES // len(every))
            for i in range(0, len(theirs), step):
                part = np.ascontiguousarray(_incidence(theirs[i : i + step], every).T)
                rows = max(1, SCORES // part.shape[1])
                for j in range(0, len(mine), rows):
                    hit = np.flatnonzero(mine[j : j + rows] @ part >= least)
                    if len(hit):
                        x, y = np.divmod(hit, part.shape[1])
                        out.append(pa.RecordBatch.from_arrays([entity.take(pa.array(x + j)), name.take(pa.array(y + i))], schema=schema))
        return pa.Table.from_batches(out, schema)

    return run


def fuzzy_survivors(entities: DataFrame, names: DataFrame, cutoff: float) -> DataFrame:
    """(entity_norm, norm) that share enough characters and are of fitting lengths: all pairs that can reach the cutoff.

    Similarity counts matched characters, which are common marks. Entities and names are dealt to blocks of one length;
    blocks of fitting lengths meet, each pair of blocks in one group, and a pair of names meets once. The pairs can be as
    many as entities times names, but a task holds two blocks only.
    """
    asked = entities.select(normalize_entity(F.col("name")).alias("norm")).filter("norm != ''").distinct()
    asked, asked_sizes = _blocked(asked, ENTITY_CHARS, "asked")
    known, known_sizes = _blocked(names.select("norm").distinct(), NAME_CHARS, "known")
    low, high = length_band(F.col("asked_len"), cutoff)
    meet = asked_sizes.withColumnRenamed("n", "asked_n").join(F.broadcast(known_sizes), F.col("known_len").between(low, high))
    meet = meet.select("asked_len", F.explode(F.sequence(F.lit(0).cast("long"), F.col("asked_n") - 1)).alias("asked_block"), "known_len", "n")
    meet = materialise(meet.select("asked_len", "asked_block", "known_len", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("known_block")), "meetings")
    left, right = asked.join(meet, ["asked_len", "asked_block"]), known.join(meet, ["known_len", "known_block"])
    return left.groupBy(*meet.columns).cogroup(right.groupBy(*meet.columns)).applyInArrow(_common_enough(cutoff), "entity_norm string, norm string")


def _similar(cutoff: float):
    """Ratcliff-Obershelp similarity as difflib has it (name second)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matcher, held = difflib.SequenceMatcher(), None
        for frame in frames:
            ratio = []
            for a, b in zip(frame["entity_norm"], frame["norm"], strict=True):
                if held != a:
                    matcher.set_seq2(a)
                    held = a
                matcher.set_seq1(b)
                ratio.append(matcher.ratio())
            out = frame.assign(ratio=ratio)
            yield out[out["ratio"] >= cutoff]

    return run


def fuzzy_matches(entities: DataFrame, names: DataFrame, cutoff: float = 0.8, n: int = 3) -> DataFrame:
    """(entity_norm, norm, ratio, rank): the n most similar normal forms of each entity."""
    near = fuzzy_survivors(entities, names, cutoff).mapInPandas(_similar(cutoff), "entity_norm string, norm string, ratio double")
    best = Window.partitionBy("entity_norm").orderBy(F.desc("ratio"), F.desc("norm"))
    return near.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= n)


def seeds(entities: DataFrame, nodes: DataFrame, cutoff: float = 0.8) -> DataFrame:
    """Names of nodes that match an entity, exactly or, only where that fails, by similarity."""
    names = normalized_nodes(nodes)
    exact = materialise(exact_seeds(entities, names), "exact")
    out = exact.select("name")
    rest = entities.join(exact.select(F.col("entity").alias("name")), "name", "left_anti")
    if cutoff > 0 and not rest.isEmpty():
        out = out.unionByName(fuzzy_matches(rest, names, cutoff).select("norm").join(names, "norm").select("name"))
    return out.distinct()


def _triple() -> Column:
    return F.struct("head", "relation", "tail", "confidence", "source_file", "track", "chunk_index")


def _concept() -> Column:
    return F.struct("name", "description", "source_file", "confidence", "node_type", "extra")


def _hits(rows: DataFrame, source: str, order: list, score: Column, triple: Column | None = None, concept: Column | None = None, summary: Column | None = None) -> DataFrame:
    t = "struct<head:string,relation:string,tail:string,confidence:string,source_file:string,track:string,chunk_index:int>"
    c = "struct<name:string,description:string,source_file:string,confidence:string,node_type:string,extra:map<string,string>>"
    null = F.lit(None)
    return numbered(rows, order).select(
        "pos",
        F.lit(source).alias("source"),
        score.cast("double").alias("score"),
        (null if triple is None else triple).cast(t).alias("triple"),
        (null if concept is None else concept).cast(c).alias("concept"),
        (null if summary is None else summary).cast("string").alias("community_summary"),
    )


def graph_hits(nodes: DataFrame, edges: DataFrame, entities: DataFrame, s: Settings) -> DataFrame:
    """Hits of the graph route: edges around the seeds, or the seed nodes if there is no edge."""
    found = materialise(seeds(entities, nodes, s.fuzzy_match_cutoff), "seeds")
    near = materialise(graph.expand(edges, found, s.retrieval_hops, s.max_subgraph_edges)[1], "near")
    if not near.isEmpty():
        return _hits(near.withColumn("confidence", confidence(F.col("confidence"))), "graph", ["source_file", "head", "relation", "tail"], F.lit(1.0), triple=_triple())
    return _hits(nodes.join(found, "name", "left_semi"), "graph", ["name"], F.lit(1.0), concept=_concept())


def vector_hits(near: DataFrame) -> DataFrame:
    """Hits of the vector route from the rows of vectors.search, nearest first."""
    rows = near.select("distance", "id", "score", F.col("node").alias("name"), F.col("document").alias("description"), "source_file", F.lit("EXTRACTED").alias("confidence"), F.lit("concept").alias("node_type"), F.create_map().cast("map<string,string>").alias("extra"))
    return _hits(rows, "vector", ["distance", "id"], F.col("score"), concept=_concept())


def community_hits(found: DataFrame, entities: DataFrame) -> DataFrame:
    rows = found.join(overlap(found, entities), "id")
    return _hits(rows, "community", ["id"], F.col("score"), summary=F.col("summary"))


def union_routes(routes: list[DataFrame]) -> DataFrame:
    """All hits, in order of the routes and of each route's hits."""
    out = None
    for i, hits in enumerate(routes):
        part = hits.withColumn("route", F.lit(i))
        out = part if out is None else out.unionByName(part)
    return numbered(out.withColumnRenamed("pos", "__own"), ["route", "__own"]).select("pos", *[c for c in out.columns if c not in ("pos", "route")])


def hit_confidence() -> Column:
    return F.coalesce(F.col("triple.confidence"), F.col("concept.confidence"), F.lit("EXTRACTED"))


def _hit_key() -> list[Column]:
    """What makes two hits the same; the first column is null for empty hits."""
    t, c, s = F.col("triple"), F.col("concept"), F.col("community_summary")
    kind = F.when(t.isNotNull(), "t").when(s.isNotNull(), "s").when(c.isNotNull(), "c")
    one = F.when(kind == "t", t["head"]).when(kind == "s", s).otherwise(c["name"])
    return [kind, one, *[F.when(kind == "t", t[x]) for x in ("relation", "tail", "source_file")], F.when(kind != "s", F.col("source"))]


def dedup_hits(hits: DataFrame) -> DataFrame:
    """The first hit of each key; the route is part of triple and concept keys, empty hits vanish."""
    key = _hit_key()
    first = Window.partitionBy(*key).orderBy("pos")
    return hits.filter(key[0].isNotNull()).withColumn("__n", F.row_number().over(first)).filter("__n = 1").drop("__n")


def budget(ranked: DataFrame, tokens: Column, most: int, order: list, spent: int = 0) -> DataFrame:
    """The first rows in this order whose tokens fit; at least one.

    A line has at least one token, so no more than `most` rows can fit: they are picked by a
    distributed top-k, and only they come together for the running sum.
    """
    ranked = ranked.orderBy(*order).limit(max(1, most))
    rank = Window.orderBy(*order)
    upto = rank.rowsBetween(Window.unboundedPreceding, 0)
    out = ranked.withColumn("__t", tokens).withColumns({"__n": F.row_number().over(rank), "__s": F.sum("__t").over(upto)})
    return out.filter((F.col("__n") == 1) | (F.col("__s") + spent <= most)).drop("__t", "__n", "__s")


BINS = 1_024


def _bound(rows: DataFrame, column: str, most: int, smallest: bool) -> tuple[float | None, int, bool]:
    """The value up to which the first `most` rows by column reach, how many rows are before it, and whether the rows at it are too many.

    A histogram of BINS bins is looked at and then the bin of the cut anew, so only counts come to the driver. It ends when
    no more than twice the wanted rows are left, or when the bin holds one value.
    """
    x = F.col(column).cast("double")
    low, high = rows.agg(F.min(x), F.max(x)).first()
    before = 0
    while low is not None and low < high:
        place = F.least(F.floor((x - low) / ((high - low) / BINS)), F.lit(BINS - 1))
        bins = rows.filter(x.between(low, high)).groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min(x).alias("low"), F.max(x).alias("high")).collect()
        for r in sorted(bins, key=lambda r: r["bin"] if smallest else -r["bin"]):
            if before + r["n"] >= most or (r["high"] if smallest else r["low"]) == (high if smallest else low):
                low, high = r["low"], r["high"]
                break
            before += r["n"]
        if before + r["n"] <= 2 * most:
            return (high if smallest else low), before, False
    return low, before, True


def first_hits(ranked: DataFrame, most: int) -> DataFrame:
    """At least the first `most` rows by weighted (largest first) and pos, and not many more; no total order of all rows."""
    return _cut(ranked, materialise(ranked.select("weighted", "pos"), "weights"), most)


def _cut(ranked: DataFrame, keys: DataFrame, most: int) -> DataFrame:
    """first_hits of rows whose weighted and pos are stored as keys."""
    weight, before, many = _bound(keys, "weighted", most, smallest=False)
    if weight is None:
        return ranked
    if not many:
        return ranked.filter(F.col("weighted") >= weight)
    pos, _, _ = _bound(keys.filter(F.col("weighted") == weight), "pos", most - before, smallest=True)
    return ranked.filter((F.col("weighted") > weight) | ((F.col("weighted") == weight) & (F.col("pos") <= int(pos))))


#: How many times more hits than are wanted fusion looks at before it deduplicates all.
LOOKS = (2, 16)


def _first_fused(hits: DataFrame, most: int) -> DataFrame:
    """At least the first `most` of the deduplicated hits (weighted, line) by weighted and pos, and not many more.

    The best hits of all are taken, and all hits with their keys tell which of them come first. Where repeats
    leave too few, more are taken, and at last all hits are deduplicated.
    """
    key = _hit_key()
    line = render_hit(F.col("triple"), F.col("concept"), F.col("community_summary"))
    rows = hits.filter(key[0].isNotNull()).withColumns({"weighted": confidence_weight(hit_confidence()) * F.col("score"), "line": line, "__key": F.xxhash64(*key)})
    keys = materialise(rows.select("weighted", "pos"), "weights")
    n = keys.count()
    for times in LOOKS:
        if n <= times * most:
            break
        best = _cut(rows, keys, times * most).select("__key").distinct()
        near = rows.join(F.broadcast(materialise(best, "best-keys")), "__key", "left_semi")  # whole keys, so what is first stays first
        found = materialise(_cut(dedup_hits(near), keys, times * most).filter("line != ''").drop("__key"), "first-hits")
        if found.count() >= most:
            return found
    ranked = dedup_hits(rows.drop("__key")).filter("line != ''")
    return materialise(first_hits(ranked, most), "first-hits")


def fuse(hits: DataFrame, most_tokens: int = 4000, count: Callable[[Column], Column] = quarter_count) -> DataFrame:
    """Without repeats, by confidence weight times score, cut to the budget; rank from 1."""
    # a line has a token at least, so no more than the first most_tokens rows can fit; these are some thousands
    some = _first_fused(hits, max(1, most_tokens))
    order = Window.orderBy(F.desc("weighted"), "pos")
    return budget(some.withColumn("rank", F.row_number().over(order)), count(F.col("line")), most_tokens, [F.col("rank")])


def context(fused: DataFrame, most_tokens: int = 4000, count: Callable[[Column], Column] = quarter_count, header_tokens: int = 1) -> DataFrame:
    """One row: the header and the lines that fit with it; empty without hits."""
    kept = budget(fused, count(F.col("line")), most_tokens, [F.col("rank")], header_tokens)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda x: x["line"])
    return kept.agg(lines.alias("l")).select(F.when(F.size("l") > 0, F.concat(F.lit(HEADER + "\n"), F.array_join("l", "\n"))).otherwise("").alias("context"))


def review(hits: DataFrame, s: Settings) -> DataFrame:
    """One row: whether an answer on these hits needs review, why, the entities, and its confidence."""
    label = F.col("triple.confidence")
    few, low = F.col("n") < s.min_hit_count, F.coalesce("best", F.lit(0.0)) < s.min_confidence_score
    ends = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.when(F.col("triple").isNotNull(), F.array("triple.head", "triple.tail")).otherwise(F.array().cast("array<string>")).alias("e")))), lambda x: x["e"]))
    one = hits.agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("best"), F.coalesce(F.bool_or(label == "AMBIGUOUS"), F.lit(False)).alias("unclear"), F.coalesce(F.bool_or(label.isin("INFERRED", "AMBIGUOUS")), F.lit(False)).alias("used_inferred"), F.min(F.when(label.isNotNull(), confidence_rank(label))).alias("rank"), F.array_join(F.array_distinct(ends), ", ").alias("entities"))
    return one.select(
        (few | low | F.col("unclear")).alias("flagged"),
        F.when(few, "low_hit_count").when(low, "low_confidence_score").otherwise("ambiguous_conflict").alias("reason"),
        "entities",
        "used_inferred",
        F.element_at(F.array(*map(F.lit, ("EXTRACTED", "INFERRED", "AMBIGUOUS"))), F.coalesce("rank", F.lit(2)) + 1).alias("confidence"),
    )


def route_counts(hits: DataFrame) -> DataFrame:
    return hits.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
