"""Triples and concepts of prose, chunk by chunk, from a model."""

from __future__ import annotations

from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.extract.clients import LLMClient, ask_in_turns
from loomgraph.functions.text import parse_json_loose, sentences, stem

SYSTEM = (
    "Turn the text into a knowledge graph. Answer with one JSON object alone: "
    '{"triples": [{"head", "relation", "tail", "confidence"}], "concepts": [{"name", "description", "node_type"}]}. '
    "confidence is EXTRACTED (stated), INFERRED (follows) or AMBIGUOUS (unclear). Names are short; every concept has a description."
)
_LABELS = ("EXTRACTED", "INFERRED", "AMBIGUOUS")


def ask(client: LLMClient, text: str) -> dict | None:
    """The parsed answer; once more at a higher temperature if it is no valid answer."""
    for temperature in (0.0, 0.2):
        try:
            found = parse_json_loose(client.complete(SYSTEM, text, "json", temperature))
        except Exception:
            found = None
        if found and isinstance(found.get("triples"), list) and isinstance(found.get("concepts"), list):
            return found
    return None


def _text(x) -> str:
    return x.strip() if isinstance(x, str) else ""


def clean(found: dict) -> tuple[list[tuple], list[tuple]]:
    """(head, relation, tail, confidence) and (name, description, node_type); incomplete ones are dropped."""
    triples = []
    for x in found["triples"]:
        if isinstance(x, dict) and all(parts := tuple(_text(x.get(k)) for k in ("head", "relation", "tail"))):
            label = _text(x.get("confidence")).upper()
            triples.append((*parts, label if label in _LABELS else "EXTRACTED"))
    concepts = [(n, _text(x.get("description")) or n, _text(x.get("node_type")) or "concept") for x in found["concepts"] if isinstance(x, dict) and (n := _text(x.get("name")))]
    return triples, concepts


_ANSWER = "source_file string, chunk_index int, failed boolean, triples array<struct<head:string,relation:string,tail:string,confidence:string>>, concepts array<struct<name:string,description:string,node_type:string>>"


def semantic_track(chunks: DataFrame, client: LLMClient, strategy: str = "last_write_wins", concurrency: int = 1) -> DataFrame:
    """chunks (source_file, index, text) to one row per file: source_file, triples, concepts, failed.

    A task asks for `concurrency` chunks at a time, so model calls in flight are that times the running tasks.

    A chunk without a valid answer gives one AMBIGUOUS triple. Chunks are merged in their order,
    whatever the order in which they were answered.
    """

    def work(own: LLMClient):
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            with ThreadPoolExecutor(max(1, concurrency)) as pool:
                yield from (answered(own, frame, pool) for frame in frames)

        return run

    def answered(own: LLMClient, frame: pd.DataFrame, pool: ThreadPoolExecutor) -> pd.DataFrame:
        rows = []
        for where, index, found in zip(frame["source_file"], frame["index"], pool.map(lambda text: ask(own, text), frame["text"]), strict=True):
            t, c = clean(found) if found else ([], [])
            rows.append((where, index, found is None, [dict(zip(("head", "relation", "tail", "confidence"), x, strict=True)) for x in t], [dict(zip(("name", "description", "node_type"), x, strict=True)) for x in c]))
        return pd.DataFrame(rows, columns=["source_file", "chunk_index", "failed", "triples", "concepts"])

    answers = ask_in_turns(chunks.select("source_file", "index", "text"), client, work, _ANSWER)
    lost = F.array(F.struct(stem(F.col("source_file")).alias("head"), F.lit("extraction_failed").alias("relation"), F.concat(F.lit("chunk_"), "chunk_index").alias("tail"), F.lit("AMBIGUOUS").alias("confidence")))
    said = F.when(F.col("failed"), lost).otherwise(F.col("triples"))
    full = F.transform(said, lambda x: F.struct(x["head"].alias("head"), x["relation"].alias("relation"), x["tail"].alias("tail"), x["confidence"].alias("confidence"), F.col("source_file"), F.lit("semantic").alias("track"), F.col("chunk_index")))
    answers = answers.select("source_file", "chunk_index", "failed", full.alias("triples"), "concepts")
    parts = F.array_sort(F.collect_list(F.struct("chunk_index", "triples", "concepts")))
    file = answers.groupBy("source_file").agg(parts.alias("p"), F.bool_or("failed").alias("failed"))
    file = file.select("source_file", "failed", F.flatten(F.transform("p", lambda x: x["triples"])).alias("triples"))
    each = answers.select("source_file", "chunk_index", F.posexplode("concepts").alias("pos", "c")).select("source_file", "chunk_index", "pos", "c.name", "c.description", "c.node_type")
    return file.join(merge_concepts(each, strategy), "source_file", "left").select("source_file", "triples", F.coalesce("concepts", F.array().cast(merged_type())).alias("concepts"), "failed")


def merged_type() -> str:
    from loomgraph.schemas import _C

    return f"array<struct<{_C}>>"


def concat_dedup(each: DataFrame) -> DataFrame:
    """(source_file, name, description): the sentences of all descriptions in order, each once whatever its case."""
    said = each.select("source_file", "name", "chunk_index", "pos", F.posexplode(sentences(F.col("description"))).alias("i", "s"))
    first = said.groupBy("source_file", "name", F.lower("s").alias("low")).agg(F.min(F.struct("chunk_index", "pos", "i", "s")).alias("x"))
    return first.groupBy("source_file", "name").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["s"]), " ").alias("description"))


def merge_concepts(each: DataFrame, strategy: str) -> DataFrame:
    """(source_file, concepts): one concept per name; the last description, or all their sentences once."""
    order = F.struct("chunk_index", "pos")
    group = each.groupBy("source_file", "name")
    if strategy == "concat_dedup":
        one = group.agg(F.min_by("node_type", order).alias("node_type"), F.count(F.lit(1)).alias("n"), F.max("chunk_index").alias("last"), F.min(order).alias("at"))
        one = one.join(concat_dedup(each), ["source_file", "name"], "left").withColumn("description", F.coalesce("description", F.lit("")))
    elif strategy == "last_write_wins":
        one = group.agg(F.max_by("description", order).alias("description"), F.max_by("node_type", order).alias("node_type"), F.count(F.lit(1)).alias("n"), F.max("chunk_index").alias("last"), F.min(order).alias("at"))
    else:
        raise ValueError(f"unknown strategy {strategy}")
    extra = F.when(F.col("n") > 1, F.create_map(F.lit("last_chunk_index"), F.col("last").cast("string"))).otherwise(F.create_map().cast("map<string,string>"))
    concept = F.struct("name", "description", "source_file", F.lit("EXTRACTED").alias("confidence"), "node_type", extra.alias("extra"))
    rows = one.select("source_file", "at", concept.alias("c"))
    # maps can't be ordered, so places are sorted with the index of their concept
    listed = rows.groupBy("source_file").agg(F.collect_list(F.struct("at", "c")).alias("cs"))
    places = F.array_sort(F.transform("cs", lambda x, i: F.struct(x["at"].alias("at"), i.alias("i"))))
    listed = listed.select("source_file", "cs", places.alias("places"))
    return listed.select("source_file", F.transform("places", lambda p: F.col("cs")[p["i"]]["c"]).cast(merged_type()).alias("concepts"))
