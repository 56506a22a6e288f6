"""Queries of the text functions, extraction, routes and stored state, each with its oracle SQL."""

from __future__ import annotations

import json
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.answer import Session
from loomgraph.config import Settings, embedding_signature, extraction_signature, index_signature
from loomgraph.extract import semantic
from loomgraph.extract.clients import OfflineClient
from loomgraph.extract.code import code_track
from loomgraph.functions import text as tx
from loomgraph.functions import tokens as tk
from loomgraph.operators import changes, community, graph, keywords, retrieve, vectors
from loomgraph.plans.fixture import ORACLE_TRIPLES, node_table, triples
from loomgraph.plans.registry import query
from loomgraph.schemas import _C, _T
from loomgraph.session import materialise, table, work_dir
from loomgraph.snapshot import TABLES, Store, graphml, review_lines
from loomgraph.sources.files import load, scan, write_texts
from loomgraph.streaming.watch import debounced, moves_as_two, session_paths

# text functions


@query("paths", "SELECT doc_id, source || '/' || doc_id || '.MD' AS path, '.md' AS suffix, CAST(doc_id AS VARCHAR) AS stem FROM documents")
def paths(spark: SparkSession, d: str) -> DataFrame:
    whole = F.concat(F.lit("/data/raw/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".MD"))
    rows = table(spark, d, "documents").select("doc_id", tx.relative_path(whole, "/data/raw").alias("path"))
    return rows.select("doc_id", "path", tx.suffix(F.col("path")).alias("suffix"), tx.stem(F.col("path")).alias("stem"))


@query("labels_coerced", """SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'INFERRED' WHEN 1 THEN 'AMBIGUOUS' ELSE 'EXTRACTED' END AS confidence,
  CASE p_size % 4 WHEN 0 THEN 0.6 WHEN 1 THEN 0.3 ELSE 1.0 END::DOUBLE AS weight, CASE WHEN p_size % 3 = 2 THEN p_type ELSE p_name END AS description FROM part""")
def labels_coerced(spark: SparkSession, d: str) -> DataFrame:
    size = F.col("p_size")
    raw = F.when(size % 4 == 0, " inferred ").when(size % 4 == 1, "AMBIGUOUS").when(size % 4 == 2, "sure")
    about = F.when(size % 3 == 0, "  ").when(size % 3 == 2, F.concat(F.lit(" "), "p_type", F.lit(" ")))
    rows = table(spark, d, "part").select("p_partkey", tx.confidence(raw).alias("confidence"), tx.description(about, F.col("p_name")).alias("description"))
    return rows.withColumn("weight", tx.confidence_weight(F.col("confidence")).cast("double"))


@query("collapse_spaces", r"SELECT p_partkey, p_name || ' ' || p_type AS text FROM part")
def collapse_spaces(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", tx.collapse_spaces(F.concat(F.lit(" \n"), "p_name", F.lit("\u3000 \t\u00a0"), "p_type", F.lit("  "))).alias("text"))


@query("token_counts", r"""WITH f AS (SELECT doc_id, text, trim(regexp_replace(text, '\s+', ' ', 'g')) AS flat FROM documents)
  SELECT doc_id, CAST(CASE WHEN flat = '' THEN 0 ELSE len(string_split(flat, ' ')) END AS INTEGER) AS words, CAST(greatest(1, length(text) // 4) AS INTEGER) AS quarter FROM f""")
def token_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", tk.word_count(F.col("text")).alias("words"), tk.quarter_count(F.col("text")).alias("quarter"))


_CJK = "CASE WHEN doc_id % 3 = 0 THEN translate(text, 'aeiou', '的一是在不') ELSE text END"


@query("chunk_segments", f"""WITH d AS (SELECT source || '/' || doc_id || '.md' AS source_file, {_CJK} AS x FROM documents),
  w AS (SELECT *, regexp_extract_all(x, '{tk.SEGMENT}') AS w, length(regexp_extract(x, '{tk.LEADING}')) AS lead FROM d),
  k AS (SELECT *, unnest(range(0, 1 + CAST(greatest(0, ceil((len(w) - 100) / 80)) AS BIGINT))) AS k FROM w WHERE len(w) > 0)
  SELECT source_file, CAST(k AS INTEGER) AS index, CASE WHEN len(w) <= 100 THEN x ELSE regexp_replace(array_to_string(w[k * 80 + 1 : k * 80 + 100], ''), '{tk.TRAILING}', '') END AS text,
    CAST(len(w[k * 80 + 1 : k * 80 + 100]) AS INTEGER) AS token_count, CAST(CASE WHEN len(w) <= 100 THEN 0 ELSE lead + length(array_to_string(w[1 : k * 80], '')) END AS INTEGER) AS start FROM k""")
def chunk_segments(spark: SparkSession, d: str) -> DataFrame:
    """Windows over documents of which every third is written without blanks for its vowels."""
    text = F.when(F.col("doc_id") % 3 == 0, F.translate("text", "aeiou", "的一是在不")).otherwise(F.col("text"))
    files = table(spark, d, "documents").select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("source_file"), text.alias("text"))
    return tk.chunk_segments(files, 100, 20)


@query("json_lenient", "SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events")
def json_lenient(spark: SparkSession, d: str) -> DataFrame:
    def read(raw: pd.Series) -> pd.Series:
        return raw.map(lambda x: (tx.parse_json_loose(x) or {}).get("k")).astype("Int32")

    said = F.when(F.col("event_id") % 2 == 0, F.col("props")).otherwise(F.concat(F.lit("Here it is: "), "props", F.lit(" and {more}")))
    return table(spark, d, "events").select("event_id", F.pandas_udf(read, "int")(said).alias("k"))


@query("elapsed_text", """SELECT event_id, CASE WHEN event_id < 60 THEN event_id || 's' WHEN event_id < 3600 THEN event_id // 60 || 'm ' || event_id % 60 || 's'
  ELSE event_id // 3600 || 'h ' || event_id % 3600 // 60 || 'm' END AS elapsed FROM events""")
def elapsed_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", tx.elapsed_label(F.col("event_id")).alias("elapsed"))


@query("config_signatures", """SELECT sha256('{"chunk_max_tokens": 3000, "chunk_overlap_tokens": 200, "code_languages": ["java", "javascript", "python"], "concept_description_strategy": "last_write_wins", "extractor_version": "1"}') AS extraction,
  sha256('{"fallback_description_max_edges": 5, "leiden_symmetrize": "sum"}') AS index, sha256('{"embedding_model": "offline", "embedding_provider": "offline"}') AS embedding""")
def config_signatures(spark: SparkSession, d: str) -> DataFrame:
    s = Settings()
    return spark.range(1).select(F.lit(extraction_signature(s)).alias("extraction"), F.lit(index_signature(s)).alias("index"), F.lit(embedding_signature(s)).alias("embedding"))


@query("files_scanned", "SELECT source || '/' || doc_id || '.md' AS path, '.md' AS suffix, 'md' AS format, sha256(coalesce(text, '')) AS sha256, sha256(coalesce(text, '')) AS text_sha256 FROM documents")
def files_scanned(spark: SparkSession, d: str) -> DataFrame:
    """Every document as a file, then scanned, hashed and decoded.

    A path may be that of several documents, missing, hidden, or lead out of the folder. So a file is named by its row and the
    encoded path (none if it is missing), in a folder for each task, and paths are read back from the names.
    """
    folder = f"{work_dir(spark)}/raw-{uuid.uuid4().hex}"
    path, row = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")), F.monotonically_increasing_id()
    docs = table(spark, d, "documents").select(path.alias("path"), "text", row.alias("row"))
    # names have at most 255 bytes, and those that begin with a dot or a line are hidden
    encoded = F.regexp_replace(F.url_encode("path"), "(.{100})", "$1/x")
    task, number = F.shiftright("row", 33).cast("string"), F.col("row").bitwiseAND(F.lit((1 << 33) - 1)).cast("string")
    name = F.concat(task, F.lit("/"), number, F.coalesce(F.concat(F.lit("-"), encoded), F.lit("")), F.lit(".md"))
    write_texts(docs.select(name.alias("path"), "text"), folder)
    documents, _ = load(scan(spark, folder))
    named = F.regexp_extract("path", "^[0-9]+/[0-9]+-(.*)[.]md$", 1)
    back = F.when(named != "", F.url_decode(F.replace(named, F.lit("/x"), F.lit(""))))
    return documents.select(back.alias("path"), "suffix", "format", "sha256", F.sha2("text", 256).alias("text_sha256"))


# extraction


class RuleClient(OfflineClient):
    """Answers a line `brand|type|size|key` by rule, with flaws that the track must mend."""

    def complete(self, system: str, user: str, response_format: str = "json", temperature: float = 0.0) -> str:
        brand, kind, size, key = user.split("|")
        n = int(size)
        if n % 7 == 0:
            return "no answer"
        label = {0: "inferred", 1: " AMBIGUOUS"}.get(n % 3, "sure")
        triples = [{"head": f" {brand} ", "relation": "made_as", "tail": kind, "confidence": label}, {"head": brand, "relation": " ", "tail": kind}, "noise"]
        concepts = [{"name": kind, "description": f"{key} of {brand}" if n % 2 else " ", "node_type": ""}, {"name": ""}, 5]
        answer = json.dumps({"triples": triples, "concepts": concepts})
        return f"Answer: {answer} done" if n % 5 == 0 else answer


def _answers(spark: SparkSession, d: str) -> DataFrame:
    line = F.concat_ws("|", "p_brand", "p_type", F.col("p_size").cast("string"), F.col("p_partkey").cast("string"))
    chunks = table(spark, d, "part").select(F.col("p_brand").alias("source_file"), F.col("p_partkey").cast("int").alias("index"), line.alias("text"))
    return semantic.semantic_track(chunks, RuleClient(), "last_write_wins", 4)


@query("model_triples", """SELECT p_brand AS source_file, CAST(p_partkey AS INTEGER) AS chunk_index, p_brand AS head, CASE WHEN p_size % 7 = 0 THEN 'extraction_failed' ELSE 'made_as' END AS relation,
  CASE WHEN p_size % 7 = 0 THEN 'chunk_' || p_partkey ELSE p_type END AS tail, CASE WHEN p_size % 7 = 0 OR p_size % 3 = 1 THEN 'AMBIGUOUS' WHEN p_size % 3 = 0 THEN 'INFERRED' ELSE 'EXTRACTED' END AS confidence, 'semantic' AS track FROM part""")
def model_triples(spark: SparkSession, d: str) -> DataFrame:
    return _answers(spark, d).select(F.explode("triples").alias("t")).select("t.source_file", "t.chunk_index", "t.head", "t.relation", "t.tail", "t.confidence", "t.track")


@query("model_concepts", """SELECT p_brand AS source_file, p_type AS name, arg_max(CASE WHEN p_size % 2 = 1 THEN p_partkey || ' of ' || p_brand ELSE p_type END, p_partkey) AS description,
  CASE WHEN count(*) > 1 THEN CAST(max(p_partkey) AS VARCHAR) END AS last_chunk_index, 'concept' AS node_type FROM part WHERE p_size % 7 <> 0 GROUP BY ALL""")
def model_concepts(spark: SparkSession, d: str) -> DataFrame:
    return _answers(spark, d).select("source_file", F.explode("concepts").alias("c")).select("source_file", "c.name", "c.description", F.col("c.extra")["last_chunk_index"].alias("last_chunk_index"), "c.node_type")


@query("concept_concat_dedup", r"""WITH s AS (SELECT 'd' || doc_id // 8 AS source_file, lang AS name, doc_id, unnest(parts) AS x, generate_subscripts(parts, 1) AS i FROM (
    SELECT *, list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '([.!?;\n])', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, ' ' || chr(10) || chr(9) || chr(13))), lambda x: x <> '') AS parts FROM documents)),
  f AS (SELECT source_file, name, x, doc_id, i, row_number() OVER (PARTITION BY source_file, name, lower(x) ORDER BY doc_id, i) AS rn FROM s),
  t AS (SELECT source_file, name, string_agg(x, ' ' ORDER BY doc_id, i) AS said FROM f WHERE rn = 1 GROUP BY ALL)
  SELECT source_file, name, sha256(coalesce(said, '')) AS sha256 FROM (SELECT DISTINCT 'd' || doc_id // 8 AS source_file, lang AS name FROM documents) LEFT JOIN t USING (source_file, name)""")
def concept_concat_dedup(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    source = F.concat(F.lit("d"), F.floor(F.col("doc_id") / 8).cast("string")).alias("source_file")
    each = docs.select(source, F.col("doc_id").alias("chunk_index"), F.lit(0).alias("pos"), F.col("lang").alias("name"), F.col("text").alias("description"), F.lit("concept").alias("node_type"))
    return semantic.merge_concepts(each, "concat_dedup").select("source_file", F.explode("concepts").alias("c")).select("source_file", "c.name", F.sha2("c.description", 256).alias("sha256"))


@query("code_structure", """WITH f AS (SELECT p_partkey AS k, p_size AS s, 'src/f' || p_partkey || CASE p_partkey % 3 WHEN 0 THEN '.py' WHEN 1 THEN '.js' ELSE '.java' END AS source_file FROM part)
  SELECT source_file, 'f' || k AS head, 'defines' AS relation, 'C' || k AS tail FROM f UNION ALL SELECT source_file, 'C' || k, 'contains', 'm' || k FROM f UNION ALL SELECT source_file, 'm' || k, 'calls', 'h' || s FROM f""")
def code_structure(spark: SparkSession, d: str) -> DataFrame:
    k, s = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    suffix = F.element_at(F.array(*map(F.lit, (".py", ".js", ".java"))), (F.col("p_partkey") % 3 + 1).cast("int"))
    shape = F.element_at(F.array(F.lit('"""doc"""\nclass C%s:\n    def m%s(self, a):\n        return h%s()\n'), F.lit("// f()\nclass C%s { m%s(a) { return h%s('g()'); } }"), F.lit('class C%s { @Get("x") int m%s(int a) throws E { return h%s(); } }')), (F.col("p_partkey") % 3 + 1).cast("int"))
    text = F.format_string("%s", shape)
    for part in (k, k, s):
        at = F.instr(text, "%s")
        text = F.concat(F.substr(text, F.lit(1), at - 1), part, F.substr(text, at + 2))
    files = table(spark, d, "part").select(F.concat(F.lit("src/f"), k, suffix).alias("path"), suffix.alias("suffix"), text.alias("text"))
    return code_track(files, ("python", "javascript", "java")).select(F.explode("triples").alias("t")).select("t.source_file", "t.head", "t.relation", "t.tail")


# vectors and keywords


@query("index_nodes", """SELECT p_brand || '::' || p_name || ' ' || p_partkey AS id, p_brand AS source_file, p_name || ' ' || p_partkey AS node, p_type AS document, CAST(length(p_type) AS DOUBLE) AS first
  FROM part WHERE p_size % 4 <> 0""")
def index_nodes(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    nodes = part.select(F.col("p_brand").alias("source_file"), F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string")).alias("node"), F.when(F.col("p_size") % 4 == 0, " ").otherwise(F.col("p_type")).alias("description"))
    embedded = part.select(F.col("p_type").alias("text"), F.array(F.length("p_type").cast("float")).alias("embedding")).distinct()
    new = vectors.index_nodes(nodes, embedded)
    return vectors.upsert(vectors.empty(spark), new).select("id", "source_file", "node", "document", F.col("embedding")[0].cast("double").alias("first"))


@query("embedding_misses", """SELECT DISTINCT sha256(sha256(p_type || ' ' || p_size) || '|m|64') AS key, 'm' AS model, 64 AS dim FROM part WHERE p_size >= 25""")
def embedding_misses(spark: SparkSession, d: str) -> DataFrame:
    """What is new in the cache when texts of half the sizes are there already; each text is embedded once."""
    texts = table(spark, d, "part").select(F.concat_ws(" ", "p_type", F.col("p_size").cast("string")).alias("text"), "p_size")
    client = OfflineClient(64)
    _, cached = vectors.embed_texts(texts.filter("p_size < 25"), client.embed, "m", 64)
    _, fresh = vectors.embed_texts(texts, client.embed, "m", 64, materialise(cached, "embedding-cache"), 16, 4)
    return fresh.select("key", "model", "dim")


@query("keyword_lookup", "WITH w AS (SELECT lower(p_name || ' ' || p_partkey) AS k, p_name || ' ' || p_partkey AS node, p_brand AS source_file FROM part) SELECT k AS keyword, node, source_file FROM w WHERE k = (SELECT min(k) FROM w)")
def keyword_lookup(spark: SparkSession, d: str) -> DataFrame:
    name = F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string"))
    part = table(spark, d, "part").select(name.alias("name"), F.lit(None).cast("string").alias("description"), F.col("p_brand").alias("source_file"), F.lit("concept").alias("node_type"))
    word = part.agg(F.min(F.lower("name"))).first()[0] or ""
    return keywords.lookup(keywords.keyword_index(part), f"  {word.upper()} ").select("keyword", "node", "source_file")


# routes


def _graph_route(spark: SparkSession, d: str) -> DataFrame:
    edges = materialise(triples(spark, d), "edges")
    return retrieve.graph_hits(node_table(edges), edges, spark.range(1).select(F.lit(" asia").alias("name")), Settings())


def _vector_route(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings")
    name = F.col("vec_id").cast("string")
    rows = v.select(name.alias("id"), F.concat(F.lit("n"), name).alias("node"), F.concat(F.lit("d"), name).alias("document"), F.col("label").cast("string").alias("source_file"), "embedding")
    return retrieve.vector_hits(vectors.search(rows, list(v.filter("vec_id = 0").first()["embedding"]), 10))


def _community_route(spark: SparkSession, d: str) -> DataFrame:
    nation, region = table(spark, d, "nation"), table(spark, d, "region")
    of = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    found = of.groupBy(F.col("r_name").alias("id"), F.concat(F.lit("about "), "r_name").alias("summary")).agg(F.collect_list("n_name").alias("members"))
    return retrieve.community_hits(found, nation.filter("n_nationkey % 2 = 0").select(F.col("n_name").alias("name")))


_GRAPH_ROUTE = f"""{ORACLE_TRIPLES}, f AS (SELECT head AS n FROM triples WHERE tail = 'ASIA' UNION SELECT tail FROM triples WHERE head = 'ASIA' UNION SELECT 'ASIA'),
  g AS (SELECT *, row_number() OVER (ORDER BY source_file, head, relation, tail) AS pos FROM triples WHERE head IN (SELECT n FROM f) OR tail IN (SELECT n FROM f))"""
_VECTOR_ROUTE = """far AS (SELECT v.vec_id, list_sum(list_transform(list_zip(v.embedding, q.embedding), lambda x: (CAST(x[1] AS DOUBLE) - x[2]) * (CAST(x[1] AS DOUBLE) - x[2]))) AS distance
    FROM embeddings v, (SELECT embedding FROM embeddings WHERE vec_id = 0) q),
  v AS (SELECT *, row_number() OVER (ORDER BY distance, CAST(vec_id AS VARCHAR)) AS pos FROM far QUALIFY pos <= 10)"""
_COMMUNITY_ROUTE = """m AS (SELECT DISTINCT r_name AS cid, lower(n_name) AS norm FROM nation JOIN region ON n_regionkey = r_regionkey),
  e AS (SELECT DISTINCT lower(n_name) AS norm FROM nation WHERE n_nationkey % 2 = 0),
  c AS (SELECT cid, row_number() OVER (ORDER BY cid) AS pos, round(count(*) / (SELECT count(*) FROM e), 6) AS score FROM m JOIN e USING (norm) GROUP BY cid)"""


@query("graph_route", f"WITH {_GRAPH_ROUTE} SELECT pos, 'graph' AS source, CAST(1 AS DOUBLE) AS score, head, relation, tail, confidence, source_file FROM g")
def graph_route(spark: SparkSession, d: str) -> DataFrame:
    return _graph_route(spark, d).select("pos", "source", "score", "triple.head", "triple.relation", "triple.tail", "triple.confidence", "triple.source_file")


@query("vector_route", f"WITH {_VECTOR_ROUTE} SELECT pos, 'vector' AS source, round(greatest(0.0, 1 - distance), 6) AS score, 'n' || vec_id AS name, 'd' || vec_id AS description FROM v")
def vector_route(spark: SparkSession, d: str) -> DataFrame:
    return _vector_route(spark, d).select("pos", "source", F.round("score", 6).alias("score"), "concept.name", "concept.description")


@query("community_route", f"WITH {_COMMUNITY_ROUTE} SELECT pos, 'community' AS source, score, 'about ' || cid AS summary FROM c")
def community_route(spark: SparkSession, d: str) -> DataFrame:
    return _community_route(spark, d).select("pos", "source", F.round("score", 6).alias("score"), F.col("community_summary").alias("summary"))


@query("route_union", f"""WITH {_GRAPH_ROUTE}, {_VECTOR_ROUTE}, {_COMMUNITY_ROUTE},
  u AS (SELECT 0 AS route, pos, 'graph' AS source, head AS label FROM g UNION ALL SELECT 1, pos, 'vector', 'n' || vec_id FROM v UNION ALL SELECT 2, pos, 'community', 'about ' || cid FROM c)
  SELECT row_number() OVER (ORDER BY route, pos) AS pos, source, label FROM u""")
def route_union(spark: SparkSession, d: str) -> DataFrame:
    every = retrieve.union_routes([_graph_route(spark, d), _vector_route(spark, d), _community_route(spark, d)])
    return every.select("pos", "source", F.coalesce("triple.head", "concept.name", "community_summary").alias("label"))


# communities

_MEMBER = """m AS (SELECT r_name AS node, CAST(r_regionkey AS INTEGER) AS id FROM region UNION ALL SELECT n_name, CAST(n_regionkey AS INTEGER) FROM nation
    UNION ALL SELECT 'supplier:' || s_suppkey, CAST(n_regionkey AS INTEGER) FROM supplier JOIN nation ON s_nationkey = n_nationkey UNION ALL SELECT 'part:' || p_partkey, 5 FROM part)"""


def _by_region(spark: SparkSession, d: str) -> DataFrame:
    """A given membership: places and suppliers by region, parts apart."""
    nation = table(spark, d, "nation").select("n_nationkey", "n_name", F.col("n_regionkey").cast("int").alias("id"))
    out = table(spark, d, "region").select(F.col("r_name").alias("node"), F.col("r_regionkey").cast("int").alias("id")).unionByName(nation.select(F.col("n_name").alias("node"), "id"))
    supplier = table(spark, d, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("supplier:"), F.col("s_suppkey").cast("string")).alias("node"), "id")
    return out.unionByName(supplier).unionByName(table(spark, d, "part").select(F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("node"), F.lit(5).alias("id")))


@query("community_table", f"""WITH {ORACLE_TRIPLES}, {_MEMBER}, r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY node) AS rn FROM m),
  g AS (SELECT id, CAST(count(*) AS INTEGER) AS size, sha256(string_agg(node, ',' ORDER BY node)) AS members, string_agg(node, ', ' ORDER BY node) FILTER (WHERE rn <= 10) AS ten FROM r GROUP BY id),
  e AS (SELECT head AS node, source_file FROM triples UNION SELECT tail, source_file FROM triples),
  f AS (SELECT id, source_file FROM m JOIN e USING (node) UNION SELECT id, 'nation' FROM m JOIN e USING (node))
  SELECT id, size, members, 'Community of: ' || ten || CASE WHEN size > 10 THEN ' 等 ' || size || ' 个节点' ELSE '' END AS summary, files FROM g
  LEFT JOIN (SELECT id, string_agg(source_file, ',' ORDER BY source_file) AS files FROM f GROUP BY id) USING (id)""")
def community_table(spark: SparkSession, d: str) -> DataFrame:
    edges = triples(spark, d)
    out = community.communities(node_table(edges), edges, _by_region(spark, d))
    return out.select("id", "size", F.sha2(F.array_join("members", ","), 256).alias("members"), "summary", F.array_join("source_files", ",").alias("files"))


@query("community_modularity", f"""WITH {ORACLE_TRIPLES}, {_MEMBER}, s AS (SELECT least(head, tail) AS a, greatest(head, tail) AS b, count(*) AS w FROM triples GROUP BY 1, 2),
  p AS (SELECT x.id AS x, y.id AS y, w FROM s JOIN m x ON a = x.node JOIN m y ON b = y.node), t AS (SELECT 2.0 * sum(w) AS total FROM p),
  mass AS (SELECT id, sum(w) AS mass FROM (SELECT x AS id, w FROM p UNION ALL SELECT y, w FROM p) GROUP BY id)
  SELECT round((SELECT sum(CASE WHEN x = y THEN 2.0 * w ELSE 0 END) FROM p) / total - (SELECT sum(CAST(mass AS DOUBLE) * mass) FROM mass) / (total * total), 9) AS modularity FROM t""")
def community_modularity(spark: SparkSession, d: str) -> DataFrame:
    pairs = graph.symmetrize(graph.weighted_pairs(triples(spark, d)))
    return community.frame_modularity(pairs, _by_region(spark, d)).select(F.round("modularity", 9).alias("modularity"))


@query("community_quality", f"WITH {ORACLE_TRIPLES}, n AS (SELECT head AS node FROM triples UNION SELECT tail FROM triples) SELECT count(*) AS nodes, true AS better FROM n")
def community_quality(spark: SparkSession, d: str) -> DataFrame:
    """Nodes with a community, and whether these communities have more modularity than those by region."""
    edges = materialise(triples(spark, d), "edges")
    member = materialise(community.membership(node_table(edges), edges), "members")
    pairs = materialise(graph.symmetrize(graph.weighted_pairs(edges)), "pairs")
    own, given = (community.frame_modularity(pairs, x) for x in (member, _by_region(spark, d)))
    both = own.join(F.broadcast(given.withColumnRenamed("modularity", "given")))
    return member.agg(F.count(F.lit(1)).alias("nodes")).join(F.broadcast(both)).select("nodes", (F.col("modularity") > F.col("given")).alias("better"))


@query("community_parts", """WITH g AS (SELECT event_id, user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 10 HOUR THEN 0 ELSE 1 END AS new FROM events),
  s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM g)
  SELECT event_id AS node, user_id AS id, min(event_id) OVER (PARTITION BY user_id, k) AS part FROM s""")
def community_parts(spark: SparkSession, d: str) -> DataFrame:
    """Events linked to their user's next one within ten hours, users as communities; events of different users are linked too."""
    seen = table(spark, d, "events").select("event_id", "user_id", "ts")
    before = Window.partitionBy("user_id").orderBy("ts", "event_id")
    far = F.unix_micros(F.col("ts").cast("timestamp"))
    chain = seen.select("event_id", F.lag("event_id").over(before).alias("b"), (far - F.lag(far).over(before)).alias("gap")).filter("gap <= 36000000000")
    other = seen.select((F.col("event_id") + 1).alias("event_id"), F.col("event_id").alias("b"), F.col("user_id").alias("u")).join(seen, "event_id").filter("user_id != u")
    pairs = chain.select(F.col("event_id").alias("a"), "b").unionByName(other.select(F.col("event_id").alias("a"), "b"))
    return community.connected_parts(seen.select(F.col("event_id").alias("node"), F.col("user_id").alias("id")), pairs)


# changes and streams

_EMPTY = {"triples": f"array<struct<{_T}>>", "concepts": f"array<struct<{_C}>>"}


@query("to_process", "SELECT DISTINCT source || '/' || doc_id || '.md' AS path FROM documents WHERE doc_id % 10 <> 0 AND (doc_id % 5 = 1 OR doc_id % 7 = 0)")
def to_process(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    path = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path")
    now = docs.filter("doc_id % 10 <> 0").select(path, F.sha2("text", 256).alias("sha256"))
    old = docs.filter("doc_id % 5 <> 1").select(path, F.when(F.col("doc_id") % 7 == 0, "stale").otherwise(F.sha2("text", 256)).alias("sha256"))
    return changes.to_process(changes.detect_changes(now, old, ("sha256",)))


def _changes_seen(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("path"))


@query("debounce_paths", """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (ORDER BY ts) < INTERVAL 700 SECOND THEN 0 ELSE 1 END AS new FROM events),
  s AS (SELECT *, sum(new) OVER (ORDER BY ts RANGE UNBOUNDED PRECEDING) AS k FROM g)
  SELECT strftime(min(min(ts)) OVER (PARTITION BY k), '%Y-%m-%d %H:%M:%S') AS start, 'u' || user_id AS path, count(*) AS n FROM s GROUP BY k, user_id""")
def debounce_paths(spark: SparkSession, d: str) -> DataFrame:
    return session_paths(_changes_seen(spark, d), "700 seconds").select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "path", "n")


@query("debounce", """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (ORDER BY ts) < INTERVAL 600500 MILLISECOND THEN 0 ELSE 1 END AS new FROM events),
  s AS (SELECT *, sum(new) OVER (ORDER BY ts RANGE UNBOUNDED PRECEDING) AS k FROM g)
  SELECT strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n, sha256((SELECT string_agg(x, ',' ORDER BY x) FROM (SELECT DISTINCT unnest(list('u' || user_id)) AS x))) AS paths FROM s GROUP BY k""")
def debounce(spark: SparkSession, d: str) -> DataFrame:
    return debounced(_changes_seen(spark, d), "600500 milliseconds").select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n", F.sha2(F.array_join("paths", ","), 256).alias("paths"))


@query("watch_moves", "SELECT event_id, 'a' || user_id AS path FROM events UNION ALL SELECT event_id, 'b' || user_id FROM events WHERE event_id % 3 = 0")
def watch_moves(spark: SparkSession, d: str) -> DataFrame:
    user = F.col("user_id").cast("string")
    events = table(spark, d, "events").select(F.col("event_id").alias("ts"), F.concat(F.lit("a"), user).alias("path"), F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("b"), user)).alias("moved_to"))
    return moves_as_two(events).withColumnRenamed("ts", "event_id")


# stored state


def _store(spark: SparkSession) -> Store:
    return Store(spark, f"{work_dir(spark)}/store-{uuid.uuid4().hex}")


def _stored(spark: SparkSession, d: str) -> Store:
    """One version of all tables, from the star schema."""
    store, edges = _store(spark), materialise(triples(spark, d), "edges")  # both go into several tables
    nation = table(spark, d, "nation")
    nodes = materialise(node_table(edges), "nodes")
    given = community.communities(nodes, edges, _by_region(spark, d))
    words = nation.select(F.lower("n_name").alias("keyword"), F.col("n_name").alias("node"), F.lit("nation").alias("source_file"), F.lit("concept").alias("node_type"))
    vector = nation.select(F.concat(F.lit("nation::"), "n_name").alias("id"), F.lit("nation").alias("source_file"), F.col("n_name").alias("node"), F.col("n_name").alias("document"), F.array(F.lit(1.0).cast("float")).alias("embedding"))
    x = F.lit("x")
    manifest = table(spark, d, "documents").select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.sha2("text", 256).alias("sha256"), x.alias("processed_at"), x.alias("extractor_version"), x.alias("llm_model"), x.alias("embedding_model"), F.lit(1).alias("embedding_dim"), x.alias("extraction_config"), x.alias("index_config"), x.alias("embedding_config"))
    store.write({"nodes": nodes, "edges": edges, "concepts": nodes.withColumn("seq", F.lit(0).cast("long")).limit(0), "communities": given, "keywords": words, "vectors": vector, "manifest": manifest})
    return store


@query("store_round_trip", f"""WITH {ORACLE_TRIPLES}, {_MEMBER} SELECT 'edges' AS name, source_file || '|' || head || '|' || relation || '|' || tail || '|' || confidence AS row FROM triples
  UNION ALL SELECT 'nodes', node FROM (SELECT head AS node FROM triples UNION SELECT tail FROM triples) UNION ALL SELECT 'communities', id || '|' || count(*) FROM m GROUP BY id
  UNION ALL SELECT 'keywords', lower(n_name) || '|' || n_name FROM nation UNION ALL SELECT 'vectors', 'nation::' || n_name || '|1.0' FROM nation
  UNION ALL SELECT 'manifest', source || '/' || doc_id || '.md|' || sha256(text) FROM documents""")
def store_round_trip(spark: SparkSession, d: str) -> DataFrame:
    store = _stored(spark, d)
    keys = {"edges": ("source_file", "head", "relation", "tail", "confidence"), "nodes": ("name",), "communities": ("id", "size"), "keywords": ("keyword", "node"), "vectors": ("id", "first"), "manifest": ("path", "sha256")}
    out = None
    for name, columns in keys.items():
        rows = store.read(name)
        rows = rows.withColumn("first", F.col("embedding")[0]) if name == "vectors" else rows
        part = rows.select(F.lit(name).alias("name"), F.concat_ws("|", *[F.col(c).cast("string") for c in columns]).alias("row"))
        out = part if out is None else out.unionByName(part)
    return out


@query("index_stats", f"""WITH {ORACLE_TRIPLES}, n AS (SELECT head AS node FROM triples UNION SELECT tail FROM triples)
  SELECT 'nodes' AS name, count(*) AS n FROM n UNION ALL SELECT 'edges', count(*) FROM triples UNION ALL SELECT 'vectors', count(*) FROM nation UNION ALL SELECT 'communities', 6
  UNION ALL SELECT 'keywords', count(DISTINCT lower(n_name)) FROM nation UNION ALL SELECT 'sources', count(DISTINCT source_file) FROM triples""")
def index_stats(spark: SparkSession, d: str) -> DataFrame:
    session = Session(spark, Settings(out_dir=_stored(spark, d).out))
    try:
        counts = session.counts()
    finally:
        session.close()
    return spark.createDataFrame(list(counts.items()), "name string, n long")


@query("log_round_trip", """SELECT CAST(user_id AS VARCHAR) AS source_file, event_id AS pos, CASE event_type WHEN 'error' THEN 'delete' ELSE 'upsert' END AS op FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY strftime(ts, '%Y-%m-%dT%H:%M:%S') DESC, event_id % 3 DESC, event_id) AS rn FROM events) WHERE rn = 1""")
def log_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Every event appended to a log of JSON lines, read back and converged."""
    store, empty = _store(spark), [F.array().cast(t).alias(c) for c, t in _EMPTY.items()]
    op = F.when(F.col("event_type") == "error", "delete").otherwise("upsert").alias("op")
    events = table(spark, d, "events")
    # each event's number stands in its first concept, since the store's own number is that of the version
    concept = F.array(F.struct(*[F.col("event_id").cast("string").alias("name"), *[F.lit(None).cast("string").alias(x) for x in ("description", "source_file", "confidence", "node_type")], F.create_map().cast("map<string,string>").alias("extra")]))
    log = events.select((F.col("event_id") % 3).cast("string").alias("schema_version"), op, F.col("user_id").cast("string").alias("source_file"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("ts"), empty[0], concept.alias("concepts"))
    tables = {name: spark.createDataFrame([], schema) for name, schema in TABLES.items()}
    # two versions, so the log is read from two places
    for odd in (0, 1):
        store.write(tables, None, log.filter(F.col("concepts")[0]["name"].cast("long") % 2 == odd))
    read = store.read_log().withColumn("pos", F.col("concepts")[0]["name"].cast("long"))
    return changes.converge(read).select("source_file", "pos", "op")


@query("review_round_trip", """SELECT 'what | of ' || n_name || '?' AS question, CASE WHEN n_regionkey % 2 = 0 THEN 'low_hit_count' ELSE 'ambiguous_conflict' END AS reason, n_name || ', x' AS entities,
  'T' || n_nationkey AS ts FROM nation WHERE n_nationkey % 2 = 1""")
def review_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Flagged questions appended to the queue; the pending ones as check-list lines, and these read again."""
    store = _store(spark)
    reason = F.when(F.col("n_regionkey") % 2 == 0, "low_hit_count").otherwise("ambiguous_conflict")
    rows = table(spark, d, "nation").select(F.concat(F.lit("what | of "), "n_name", F.lit("?")).alias("question"), reason.alias("reason"), F.concat("n_name", F.lit(", x")).alias("entities"), F.concat(F.lit("T"), F.col("n_nationkey").cast("string")).alias("ts"), (F.col("n_nationkey") % 2 == 0).alias("done"))
    store.append("review", rows)
    return review_lines(store.pending()).select(tx.review_fields(F.col("value")).alias("f")).select("f.question", "f.reason", "f.entities", "f.ts")


@query("graph_export", f"""WITH {ORACLE_TRIPLES}, n AS (SELECT head AS name FROM triples UNION SELECT tail FROM triples)
  SELECT '<node id="' || name || '">' || CASE WHEN contains(name, ':') THEN '' ELSE '<data key="description">place ' || lower(name) || '</data>' END ||
    '<data key="source_file">nation</data><data key="confidence">EXTRACTED</data><data key="node_type">concept</data><data key="extra">{{}}</data></node>' AS value FROM n
  UNION ALL SELECT '<edge source="' || head || '" target="' || tail || '"><data key="relation">' || relation || '</data><data key="confidence">' || confidence || '</data><data key="source_file">' || source_file || '</data><data key="track">semantic</data></edge>' FROM triples""")
def graph_export(spark: SparkSession, d: str) -> DataFrame:
    """The lines of nodes and edges of the GraphML file."""
    edges = triples(spark, d)
    return graphml(node_table(edges), edges).filter("part in (1, 2)").select("value")
