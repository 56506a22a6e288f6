"""Builds the knowledge base: incremental compile and replay from the log."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.config import CODE_FORMATS, Settings, embedding_signature, extraction_signature, index_signature
from loomgraph.extract.clients import EmbeddingClient, LLMClient, make_embedder, make_llm, probe_dim
from loomgraph.extract.code import code_track
from loomgraph.extract.semantic import semantic_track
from loomgraph.functions.tokens import RankTokenizer, chunk_segments, chunk_tokens
from loomgraph.operators import changes, community, graph, keywords, vectors
from loomgraph.progress import Progress, now
from loomgraph.schemas import _C, _T, LOG
from loomgraph.session import materialise, ship
from loomgraph.snapshot import Store
from loomgraph.sources.files import Loaders, load, scan

VERSION = "1"
CACHE = f"key string, triples array<struct<{_T}>>, concepts array<struct<{_C}>>"


def _log(rows: DataFrame, ts: str) -> DataFrame:
    """Log records of source_file, op, triples and concepts; the store adds the version that they become part of."""
    t, c = f"array<struct<{_T}>>", f"array<struct<{_C}>>"
    return rows.select(F.lit(VERSION).alias("schema_version"), "op", "source_file", F.lit(ts).alias("ts"), F.col("triples").cast(t).alias("triples"), F.col("concepts").cast(c).alias("concepts"))


@dataclass(frozen=True)
class BuildResult:
    added: int = 0
    modified: int = 0
    deleted: int = 0
    extracted: int = 0
    cached: int = 0
    skipped: int = 0
    fallbacks: int = 0
    version: int = 0


def extract(documents: DataFrame, settings: Settings, client: LLMClient, tokenizer=None) -> DataFrame:
    """source_file, triples, concepts, failed of each document: code by structure, prose by the model."""
    prose = documents.filter(~F.col("suffix").isin(*CODE_FORMATS)).withColumn("source_file", F.col("path"))
    if tokenizer is None and settings.token_ranks:
        tokenizer = RankTokenizer(settings.token_ranks)
    cut = chunk_segments if tokenizer is None else lambda d, m, o: chunk_tokens(d, m, o, tokenizer)
    chunks = cut(prose, settings.chunk_max_tokens, settings.chunk_overlap_tokens)
    said = semantic_track(chunks, client, settings.concept_description_strategy, settings.extract_concurrency)
    return code_track(documents, settings.code_languages).unionByName(said)


def _edges(extracted: DataFrame) -> DataFrame:
    rows = extracted.select(F.posexplode("triples").alias("seq", "t"))
    return rows.select("t.*", F.col("seq").cast("long").alias("seq"))


def _concepts(extracted: DataFrame) -> DataFrame:
    rows = extracted.select(F.posexplode("concepts").alias("seq", "c"))
    return rows.select("c.*", F.col("seq").cast("long").alias("seq"))


def _tables(edges: DataFrame, concepts: DataFrame, settings: Settings) -> dict[str, DataFrame]:
    """All tables that follow from edges and concepts."""
    edges = materialise(graph.upsert_edges(edges), "edges")
    bare = graph.merge_nodes(concepts, edges, ("source_file", "seq"))  # a later source writes last
    nodes = materialise(graph.with_fallbacks(materialise(bare, "nodes"), edges, settings.fallback_description_max_edges), "nodes")
    member = materialise(community.membership(nodes, edges, settings.leiden_symmetrize, settings.leiden_seed), "members")
    return {"edges": edges, "concepts": concepts, "nodes": nodes, "communities": community.communities(nodes, edges, member), "keywords": keywords.keyword_index(nodes)}


def compile_base(
    spark: SparkSession, settings: Settings, client: LLMClient | None = None, embedder: EmbeddingClient | None = None, force: bool = False, loaders: Loaders | None = None, tokenizer=None, backend: vectors.VectorStoreBackend | None = None
) -> BuildResult:
    """One incremental build. Files that fail are skipped and tried again next time. A backend gets the changes of the vectors too."""
    ship(spark)
    store = Store(spark, settings.out_dir)
    store.pin()
    client, embedder = client or make_llm(settings), embedder or make_embedder(settings)
    state = {"extraction_config": extraction_signature(settings), "llm_model": settings.llm_model, "index_config": index_signature(settings), "embedding_config": embedding_signature(settings)}
    manifest = store.read("manifest")
    if force:
        manifest = manifest.limit(0)
    files = scan(spark, settings.raw_dir)
    here = files.select("path", "sha256", *[F.lit(v).alias(k) for k, v in state.items()])
    changed = materialise(changes.detect_changes(here, manifest).filter("change != 'unchanged'"), "changes")
    if force:  # sources of the old base that are gone are deleted too
        old = store.read("manifest").select("path").join(here.select("path"), "path", "left_anti").withColumn("change", F.lit("deleted"))
        changed = materialise(changed.unionByName(old), "changes")
    count = {r["change"]: r["count"] for r in changed.groupBy("change").count().collect()}
    if not count and not force:
        return BuildResult(version=store.version)
    progress = Progress(store, force)
    try:
        wanted = changes.to_process(changed)
        documents, rejects = load(materialise(files.join(wanted, "path", "left_semi"), "files"), loaders)  # contents are read once
        # of the path only the file name decides (modules are named by it), so a moved file is still known
        documents = documents.withColumn("key", F.sha2(F.concat_ws("|", "sha256", F.lit(state["extraction_config"]), F.lit(settings.llm_model), F.substring_index("path", "/", -1)), 256))
        documents = materialise(documents, "documents")
        progress.stage("extract", extract={"total": documents.count(), "skipped": rejects.count()})
        cache = materialise(store.read_cache("extraction_cache", CACHE).dropDuplicates(["key"]), "cache")
        here_now = [F.transform(c, lambda x: x.withField("source_file", F.col("path"))).alias(c) for c in ("triples", "concepts")]
        known = documents.join(cache, "key").select(F.col("path").alias("source_file"), *here_now)
        todo = documents.join(cache, "key", "left_anti")
        made = materialise(extract(todo, settings, client, tokenizer), "extracted")  # model calls run once
        sound = made.filter("not failed").join(documents.select(F.col("path").alias("source_file"), "key"), "source_file")
        sound.select("key", "triples", "concepts").write.mode("append").parquet(f"{store.out}/extraction_cache")
        extracted = materialise(made.drop("failed").unionByName(known), "extracted")
        n_known, n_made = known.count(), made.count()
        progress.stage("graph", extract={"completed": n_known + n_made, "cached": n_known})
        empty = documents.select(F.col("path").alias("source_file")).join(extracted, "source_file", "left_anti")
        good = extracted.select("source_file").unionByName(empty)
        # what a failed file has given stays in the graph, but the manifest doesn't list it: it is asked for again next time
        done = good.join(made.filter("failed").select("source_file"), "source_file", "left_anti")
        out = changed.filter("change = 'deleted'").select(F.col("path").alias("source_file"))
        replaced = materialise(out.unionByName(good).distinct(), "replaced")
        old_edges, old_concepts = (store.read(t).limit(0) if force else store.read(t).join(replaced, "source_file", "left_anti") for t in ("edges", "concepts"))
        tables = _tables(old_edges.unionByName(_edges(extracted)), old_concepts.unionByName(_concepts(extracted)), settings)
        progress.stage("vector")
        progress.update_vector(total=tables["nodes"].count())
        dim = probe_dim(embedder)
        # vectors leave only with their source, or for those of a dimension that the embedder has just given
        stored = store.read("vectors")
        other_dim = not stored.filter(F.size("embedding") != dim).isEmpty()
        kept = stored.join(replaced, "source_file", "left_anti").filter(F.size("embedding") == dim)
        kept = kept.limit(0) if force else kept
        # sources that lose their vectors, also those of the other dimension, are embedded again
        lost = materialise(replaced.unionByName(stored.filter(F.size("embedding") != dim).select("source_file")).distinct(), "lost")
        ends = graph.source_nodes(tables["edges"].join(lost, "source_file", "left_semi"))
        said = ends.join(tables["nodes"].select(F.col("name").alias("node"), "description"), "node").select("source_file", "node", "description")
        held = store.read_cache("embedding_cache", vectors.CACHE) if settings.enable_embed_cache else None
        texts = said.select(F.col("description").alias("text")).filter(F.trim("text") != "")
        embedded, fresh = vectors.embed_texts(texts, embedder.embed, settings.embedding_model, dim, held, settings.embedding_batch, settings.embed_concurrency)
        embedded = materialise(embedded, "embedded")
        if settings.enable_embed_cache:
            keys = embedded.select(vectors.cache_key(F.col("text"), settings.embedding_model, dim).alias("key"), F.lit(settings.embedding_model).alias("model"), F.lit(dim).alias("dim"), "embedding")
            keys = keys if held is None else keys.join(held, "key", "left_anti")
            materialise(keys, "fresh").write.mode("append").parquet(f"{store.out}/embedding_cache")
        tables["vectors"] = materialise(vectors.upsert(kept, vectors.index_nodes(said, embedded)), "vectors")
        if backend is not None:
            backend.delete_by_source(lost)
            backend.index_nodes(materialise(said, "said"), embedded)
        progress.update_vector(indexed=tables["vectors"].select("node").distinct().count(), flush=True)
        progress.stage("index")
        ts = now()
        rows = here.join(done.withColumnRenamed("source_file", "path"), "path", "left_semi").select(
            "path", "sha256", F.lit(ts).alias("processed_at"), F.lit(settings.extractor_version).alias("extractor_version"), "llm_model", F.lit(settings.embedding_model).alias("embedding_model"), F.lit(dim).alias("embedding_dim"), "extraction_config", "index_config", "embedding_config"
        )
        gone = replaced.withColumnRenamed("source_file", "path")
        tables["manifest"] = manifest.join(gone, "path", "left_anti").unionByName(rows)
        progress.stage("finalize")
        upserts = extracted.select("source_file", "triples", "concepts", F.lit("upsert").alias("op"))
        deletes = out.select("source_file", F.array().alias("triples"), F.array().alias("concepts"), F.lit("delete").alias("op"))
        version = store.write(tables, None if force or other_dim else replaced, _log(upserts, ts).unionByName(_log(deletes, ts)))
        if settings.graph_serialization:
            store.export_graph(settings.graph_serialization)
        fallbacks = tables["nodes"].filter("node_type = 'entity'").count()
        result = BuildResult(count.get("added", 0), count.get("modified", 0), count.get("deleted", 0), n_made, n_known, rejects.count(), fallbacks, version)
        progress.done()
        return result
    except BaseException:
        progress.interrupted()
        raise


def replay(spark: SparkSession, settings: Settings) -> BuildResult:
    """Rebuild the graph from the log without model calls; vectors and manifest stay."""
    ship(spark)
    store = Store(spark, settings.out_dir)
    store.pin()
    log = store.read_log()
    changes.check_versions(log, VERSION)
    last = materialise(changes.converge(log).filter("op = 'upsert'").select(*[x.split()[0] for x in LOG.split(", ")][2:3], "triples", "concepts"), "log")
    tables = _tables(_edges(last), _concepts(last), settings)
    tables["vectors"] = materialise(store.read("vectors"), "vectors")
    tables["manifest"] = materialise(store.read("manifest"), "manifest")
    return BuildResult(extracted=last.count(), fallbacks=tables["nodes"].filter("node_type = 'entity'").count(), version=store.write(tables))
