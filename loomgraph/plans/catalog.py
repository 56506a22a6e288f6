"""Queries over the given tables, each with its oracle SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.config import Settings
from loomgraph.extract import semantic
from loomgraph.functions import text as tx
from loomgraph.functions import tokens as tk
from loomgraph.operators import ann, changes, community, graph, keywords, retrieve, vectors
from loomgraph.plans.fixture import ORACLE_TRIPLES, node_table, triples
from loomgraph.plans.registry import ORACLE, QUERIES, query
from loomgraph.session import materialise, table

_STOP = ", ".join(f"'{w}'" for w in tx.STOP_WORDS)
_WORDS = f"list_filter(list_transform(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9_]+'), lambda x: lower(x)), lambda x: NOT list_contains([{_STOP}], x))"
_TOKENS = f"list_distinct(list_concat({_WORDS}, regexp_extract_all(text, '[0-9]{{3,}}')))"
_PAIRS = "pairs AS (SELECT head, tail, count(*) AS weight FROM triples GROUP BY ALL)"
_LINE = "'[' || head || ']--' || relation || '-->[' || tail || '] (来源:' || source_file || ')'"


@query("graph_hubs", f"""WITH {ORACLE_TRIPLES}, {_PAIRS}, s AS (SELECT least(head, tail) AS a, greatest(head, tail) AS b, sum(weight) AS w FROM pairs GROUP BY ALL),
  e AS (SELECT a AS node, w FROM s UNION ALL SELECT b, w FROM s WHERE a <> b)
  SELECT node, CAST(sum(w) AS BIGINT) AS degree, count(*) AS neighbours FROM e GROUP BY node ORDER BY degree DESC, node LIMIT 20""")
def graph_hubs(spark: SparkSession, d: str) -> DataFrame:
    return graph.hubs(triples(spark, d), 20)


@query("graph_upsert", f"WITH {ORACLE_TRIPLES} SELECT head, relation, tail, confidence, source_file FROM triples")
def graph_upsert(spark: SparkSession, d: str) -> DataFrame:
    return triples(spark, d).select("head", "relation", "tail", "confidence", "source_file")


@query("graph_merge_nodes", """WITH w AS (SELECT p_brand AS name, p_type AS description, 'part/' || p_size AS source_file, p_partkey AS seq FROM part),
  e AS (SELECT p_brand AS head, 'made_as' AS relation, p_type AS tail FROM part), n AS (SELECT head AS name FROM e UNION SELECT tail FROM e),
  l AS (SELECT name, arg_max(description, seq) AS description, arg_max(source_file, seq) AS source_file FROM w GROUP BY name)
  SELECT name, description, source_file FROM n FULL JOIN l USING (name)""")
def graph_merge_nodes(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    said = part.select(F.col("p_brand").alias("name"), F.col("p_type").alias("description"), F.concat(F.lit("part/"), "p_size").alias("source_file"), F.lit("EXTRACTED").alias("confidence"), F.lit("concept").alias("node_type"), F.create_map().cast("map<string,string>").alias("extra"), F.col("p_partkey").alias("seq"))
    return graph.merge_nodes(said, part.select(F.col("p_brand").alias("head"), F.col("p_type").alias("tail"))).select("name", "description", "source_file")


@query("graph_remove_edges", f"""WITH {ORACLE_TRIPLES} SELECT source_file, head, relation, tail FROM triples WHERE NOT (confidence = 'AMBIGUOUS')""")
def graph_remove_edges(spark: SparkSession, d: str) -> DataFrame:
    edges = triples(spark, d)
    return graph.remove_edges(edges, edges.filter("confidence = 'AMBIGUOUS'")).select("source_file", "head", "relation", "tail")


for _how in ("sum", "max"):

    @query(f"graph_symmetrize_{_how}", f"WITH {ORACLE_TRIPLES}, {_PAIRS} SELECT least(head, tail) AS a, greatest(head, tail) AS b, CAST({_how}(weight) AS BIGINT) AS weight FROM pairs GROUP BY 1, 2")
    def _symmetrize(spark: SparkSession, d: str, how: str = _how) -> DataFrame:
        return graph.symmetrize(graph.weighted_pairs(triples(spark, d)), how)


@query("graph_fallback_description", f"""WITH {ORACLE_TRIPLES}, i AS (
    SELECT head AS node, 0 AS dir, relation, tail AS nb, seq FROM triples UNION ALL SELECT tail, 1, relation, head, seq FROM triples),
  r AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY dir, seq, relation, nb) AS rn FROM i WHERE contains(node, ':'))
  SELECT node AS name, node || ': ' || string_agg(relation || ' ' || nb, '; ' ORDER BY rn) AS description FROM r WHERE rn <= 5 GROUP BY node""")
def graph_fallback_description(spark: SparkSession, d: str) -> DataFrame:
    edges = triples(spark, d)
    return graph.fallback_descriptions(node_table(edges), edges, 5)


@query("graph_delete_orphans", f"""WITH {ORACLE_TRIPLES}, k AS (SELECT * FROM triples WHERE source_file <> 'lineitem/O'),
  ends AS (SELECT head AS name FROM k UNION SELECT tail FROM k), gone AS (SELECT head AS name FROM triples WHERE source_file = 'lineitem/O' UNION SELECT tail FROM triples WHERE source_file = 'lineitem/O'),
  every AS (SELECT head AS name FROM triples UNION SELECT tail FROM triples)
  SELECT name FROM every WHERE name NOT IN (SELECT name FROM gone WHERE name NOT IN (SELECT name FROM ends))""")
def graph_delete_orphans(spark: SparkSession, d: str) -> DataFrame:
    edges = triples(spark, d)
    gone = edges.filter("source_file = 'lineitem/O'").select("source_file").distinct()
    return graph.delete_source(node_table(edges), edges, gone)[0].select("name")


@query("graph_bfs_2hop", f"""WITH {ORACLE_TRIPLES}, f AS (SELECT head AS n FROM triples WHERE tail = 'ASIA' UNION SELECT tail FROM triples WHERE head = 'ASIA' UNION SELECT 'ASIA')
  SELECT source_file, head, relation, tail FROM triples WHERE head IN (SELECT n FROM f) OR tail IN (SELECT n FROM f)""")
def graph_bfs_2hop(spark: SparkSession, d: str) -> DataFrame:
    seed = spark.range(1).select(F.lit("ASIA").alias("name"))
    return graph.expand(triples(spark, d), seed, 2)[1].select("source_file", "head", "relation", "tail")


@query("graph_source_nodes", f"WITH {ORACLE_TRIPLES} SELECT source_file, head AS node FROM triples UNION SELECT source_file, tail FROM triples")
def graph_source_nodes(spark: SparkSession, d: str) -> DataFrame:
    return graph.source_nodes(triples(spark, d))


@query("normalize_entity", r"SELECT part.p_partkey AS id, lower(trim(regexp_replace('  ' || p_name || chr(160) || ' ' || p_type || chr(9), '[\s\x{a0}]+', ' ', 'g'))) AS norm FROM part")
def normalize_entity(spark: SparkSession, d: str) -> DataFrame:
    name = F.concat(F.lit("  "), "p_name", F.lit("  "), "p_type", F.lit("\t"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), tx.normalize_entity(name).alias("norm"))


@query("chunk_overlap", r"""WITH w AS (SELECT source || '/' || doc_id || '.md' AS source_file, text, string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ') AS w FROM documents WHERE trim(text) <> ''),
  k AS (SELECT *, unnest(range(0, 1 + CAST(greatest(0, ceil((len(w) - 100) / 80)) AS BIGINT))) AS k FROM w)
  SELECT source_file, CAST(k AS INTEGER) AS index, CASE WHEN len(w) <= 100 THEN text ELSE array_to_string(w[k * 80 + 1 : k * 80 + 100], ' ') END AS text,
         CAST(len(w[k * 80 + 1 : k * 80 + 100]) AS INTEGER) AS token_count FROM k""")
def chunk_overlap(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "documents").select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("source_file"), "text")
    return tk.chunk_words(files, 100, 20)


@query("keyword_document_frequency", f"SELECT keyword, count(*) AS df FROM (SELECT unnest({_TOKENS}) AS keyword FROM documents) GROUP BY keyword")
def keyword_document_frequency(spark: SparkSession, d: str) -> DataFrame:
    return keywords.document_frequency(table(spark, d, "documents"))


_POSTINGS = f"""p AS (SELECT DISTINCT k AS keyword, p_name || ' ' || p_partkey AS node, p_brand AS source_file FROM
  (SELECT *, unnest(list_concat([lower(p_name || ' ' || p_partkey)], {_TOKENS})) AS k FROM (SELECT *, p_name || ' ' || p_partkey || ' ' || p_type AS text FROM part)) WHERE k <> '')"""


def _part_nodes(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    return part.select(F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string")).alias("name"), F.col("p_type").alias("description"), F.col("p_brand").alias("source_file"), F.lit("concept").alias("node_type"))


@query("keyword_postings", f"WITH {_POSTINGS} SELECT keyword, node, source_file FROM (SELECT *, row_number() OVER (PARTITION BY keyword ORDER BY node) AS rn FROM p) WHERE rn <= 200")
def keyword_postings(spark: SparkSession, d: str) -> DataFrame:
    return keywords.keyword_index(_part_nodes(spark, d)).select("keyword", "node", "source_file")


@query("keyword_lookup_any", f"""WITH {_POSTINGS}, w AS (SELECT unnest([upper(x), x || ' ']) AS q, unnest([1, 2]) AS o FROM (SELECT min(keyword) AS x FROM p))
  SELECT DISTINCT node FROM (SELECT *, row_number() OVER (PARTITION BY keyword ORDER BY node) AS rn FROM p) JOIN w ON keyword = lower(trim(q)) WHERE rn <= 200""")
def keyword_lookup_any(spark: SparkSession, d: str) -> DataFrame:
    nodes = _part_nodes(spark, d)
    word = keywords.postings(nodes).agg(F.min("keyword")).first()[0] or ""  # the index's limit leaves each keyword a node
    return keywords.lookup_any(keywords.keyword_index(nodes), [word.upper(), word + " "]).select("node")


@query("vector_topk_l2", """SELECT CAST(v.vec_id AS VARCHAR) AS id, round(list_sum(list_transform(list_zip(v.embedding, q.embedding), lambda x: (CAST(x[1] AS DOUBLE) - x[2]) * (CAST(x[1] AS DOUBLE) - x[2]))), 6) AS distance
  FROM embeddings v, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY distance, id LIMIT 10""")
def vector_topk_l2(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings")
    asked = v.filter("vec_id = 0").first()["embedding"]
    rows = v.select(F.col("vec_id").cast("string").alias("id"), "embedding")
    return vectors.search(rows, list(asked), 10).select("id", F.round("distance", 6).alias("distance"))


@query("vector_topk_l2_whole", """WITH f AS (SELECT CAST(q.vec_id AS VARCHAR) AS query, CAST(v.vec_id AS VARCHAR) AS id, list_sum(list_transform(list_zip(v.embedding, q.embedding), lambda x: (CAST(x[1] AS DOUBLE) - x[2]) * (CAST(x[1] AS DOUBLE) - x[2]))) AS far
    FROM embeddings v, embeddings q WHERE q.vec_id % 100 = 0)
  SELECT query, id, round(far, 6) AS distance, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY far, id) AS rank FROM f) WHERE rank <= 10""")
def vector_topk_l2_whole(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings")
    asked = v.filter("vec_id % 100 = 0").select(F.col("vec_id").cast("string").alias("query"), "embedding")
    near = vectors.search_many(v.select(F.col("vec_id").cast("string").alias("id"), "embedding"), asked, 10)
    return near.select("query", "id", F.round("distance", 6).alias("distance"), "rank")


@query("vector_ann")
def vector_ann(spark: SparkSession, d: str) -> DataFrame:
    """The search of vector_topk_l2_whole by the inverted-file index."""
    v = table(spark, d, "embeddings")
    rows = v.select(F.col("vec_id").cast("string").alias("id"), "embedding")
    asked = v.filter("vec_id % 100 = 0").select(F.col("vec_id").cast("string").alias("query"), "embedding")
    index = ann.fit(rows, 10)
    found = ann.search(ann.assign(rows, index), asked, index, 10)
    return found.select("query", "id", F.round("distance", 6).alias("distance"), "rank")


@query("vector_delete_source", "SELECT CAST(vec_id AS VARCHAR) AS id FROM embeddings WHERE label <> 1")
def vector_delete_source(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("id"), F.col("label").cast("string").alias("source_file"))
    return vectors.list_ids(vectors.delete_sources(v, spark.range(1).select(F.lit("1").alias("source_file"))))


_STATE = ["extraction_config", "llm_model", "index_config", "embedding_config"]


@query("detect_changes", """WITH f AS (SELECT source || '/' || doc_id || '.md' AS path, sha256(text) AS h FROM documents WHERE doc_id % 10 <> 0),
  m AS (SELECT source || '/' || doc_id || '.md' AS path, CASE WHEN doc_id % 7 = 0 THEN 'stale' ELSE sha256(text) END AS h FROM documents WHERE doc_id % 5 <> 1)
  SELECT path, CASE WHEN m.path IS NULL THEN 'added' WHEN f.path IS NULL THEN 'deleted' WHEN f.h = m.h THEN 'unchanged' ELSE 'modified' END AS change FROM f FULL JOIN m USING (path)""")
def detect_changes(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    path = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path")
    rest = [F.lit("x").alias(c) for c in _STATE]
    now = docs.filter("doc_id % 10 <> 0").select(path, F.sha2("text", 256).alias("sha256"), *rest)
    old = docs.filter("doc_id % 5 <> 1").select(path, F.when(F.col("doc_id") % 7 == 0, "stale").otherwise(F.sha2("text", 256)).alias("sha256"), *rest)
    return changes.detect_changes(now, old)


@query("log_converge", """SELECT CAST(user_id AS VARCHAR) AS source_file, event_id AS pos, CASE event_type WHEN 'error' THEN 'delete' ELSE 'upsert' END AS op FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY strftime(ts, '%Y-%m-%dT%H:%M:%S') DESC, event_id % 3 DESC, event_id) AS rn FROM events) WHERE rn = 1""")
def log_converge(spark: SparkSession, d: str) -> DataFrame:
    log = table(spark, d, "events").select(F.col("user_id").cast("string").alias("source_file"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("ts"), (F.col("event_id") % 3).cast("string").alias("schema_version"), F.col("event_id").alias("pos"), F.when(F.col("event_type") == "error", "delete").otherwise("upsert").alias("op"))
    return changes.converge(log).select("source_file", "pos", "op")


@query("community_overlap", f"""WITH {ORACLE_TRIPLES}, m AS (SELECT DISTINCT r_name AS cid, lower(n_name) AS norm FROM nation JOIN region ON n_regionkey = r_regionkey),
  e AS (SELECT DISTINCT lower(n_name) AS norm FROM nation WHERE n_nationkey % 2 = 0)
  SELECT cid AS id, round(count(*) / (SELECT count(*) FROM e), 6) AS score FROM m JOIN e USING (norm) GROUP BY cid""")
def community_overlap(spark: SparkSession, d: str) -> DataFrame:
    nation, region = table(spark, d, "nation"), table(spark, d, "region")
    groups = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).groupBy(F.col("r_name").alias("id")).agg(F.collect_list("n_name").alias("members"))
    return community.overlap(groups, nation.filter("n_nationkey % 2 = 0").select(F.upper("n_name").alias("name"))).select("id", F.round("score", 6).alias("score"))


def _asked(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").select(F.concat(F.lit(" "), F.lower("n_name"), F.lit("  ")).alias("name"))


@query("seed_exact", "SELECT n_name AS name FROM nation")
def seed_exact(spark: SparkSession, d: str) -> DataFrame:
    return retrieve.exact_seeds(_asked(spark, d), retrieve.normalized_nodes(node_table(triples(spark, d)))).select("name")


@query("fuzzy_length_band", """WITH n AS (SELECT DISTINCT lower(p_name) AS norm FROM part), e AS (SELECT lower(n_name) AS a FROM nation)
  SELECT a AS entity_norm, norm FROM e JOIN n ON length(norm) BETWEEN greatest(1, ceil(length(a) * 0.8 / 1.2 - 1e-9)) AND floor(length(a) * 1.2 / 0.8 + 1e-9)""")
def fuzzy_length_band(spark: SparkSession, d: str) -> DataFrame:
    names = retrieve.normalized_nodes(table(spark, d, "part").select(F.col("p_name").alias("name")))
    return retrieve.fuzzy_candidates(_asked(spark, d), names, 0.8)


@query("fuzzy_survivors", """WITH n AS (SELECT DISTINCT lower(p_name) || ' ' || p_partkey AS norm FROM part), e AS (SELECT lower(replace(p_name, 'r', 'rr')) || ' ' || p_partkey || 'x' AS a FROM part WHERE p_partkey % 100 = 0),
  m AS (SELECT norm, c, count(*) AS k FROM (SELECT norm, unnest(string_split(norm, '')) AS c FROM n) GROUP BY ALL), q AS (SELECT a, c, count(*) AS k FROM (SELECT a, unnest(string_split(a, '')) AS c FROM e) GROUP BY ALL),
  j AS (SELECT a, norm, sum(least(m.k, q.k)) AS common FROM q JOIN m USING (c) GROUP BY ALL)
  SELECT a AS entity_norm, norm FROM j WHERE common >= ceil((length(a) + length(norm)) * 0.8 / 2 - 1e-9)
    AND length(norm) BETWEEN greatest(1, ceil(length(a) * 0.8 / 1.2 - 1e-9)) AND floor(length(a) * 1.2 / 0.8 + 1e-9)""")
def fuzzy_survivors(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of misspelt and right part names that share enough characters, counted by blocks of one length."""
    part = table(spark, d, "part")
    key = F.col("p_partkey").cast("string")
    typed = part.filter("p_partkey % 100 = 0").select(F.concat(F.replace("p_name", F.lit("r"), F.lit("rr")), F.lit(" "), key, F.lit("x")).alias("name"))
    return retrieve.fuzzy_survivors(typed, retrieve.normalized_nodes(part.select(F.concat("p_name", F.lit(" "), key).alias("name"))), 0.8)


@query("fuzzy_match")
def fuzzy_match(spark: SparkSession, d: str) -> DataFrame:
    nodes = retrieve.normalized_nodes(node_table(triples(spark, d)))
    typed = table(spark, d, "nation").select(F.regexp_replace("n_name", "NATION", "NATIN").alias("name"))
    return retrieve.fuzzy_matches(typed, nodes).select("entity_norm", "norm", F.round("ratio", 6).alias("ratio"), "rank")


def _hits(spark: SparkSession, d: str) -> DataFrame:
    """Every triple as a hit, twice; the repeats come after all first ones at any size."""
    score = F.when(F.col("relation") == "part_of", 0.9).when(F.col("relation") == "located_in", 0.7).otherwise(0.8)
    hits = retrieve._hits(triples(spark, d), "graph", ["source_file", "head", "relation", "tail"], score, triple=retrieve._triple())
    return hits.unionByName(hits.withColumn("pos", F.col("pos") + (1 << 40)))


_HITS = f"""{ORACLE_TRIPLES}, h AS (SELECT *, CASE relation WHEN 'part_of' THEN 0.9 WHEN 'located_in' THEN 0.7 ELSE 0.8 END AS score,
    CASE confidence WHEN 'INFERRED' THEN 0.6 WHEN 'AMBIGUOUS' THEN 0.3 ELSE 1.0 END AS cw, row_number() OVER (ORDER BY source_file, head, relation, tail) AS pos,
    {_LINE} AS line FROM triples)"""
_RANKS = f"""{_HITS}, r AS (SELECT *, row_number() OVER (ORDER BY CAST(cw AS DOUBLE) * CAST(score AS DOUBLE) DESC, pos) AS rank FROM h),
  s AS (SELECT *, sum(greatest(1, length(line) // 4)) OVER (ORDER BY rank ROWS UNBOUNDED PRECEDING) AS t FROM r)"""


@query("fuse_truncate", f"WITH {_RANKS} SELECT CAST(rank AS INTEGER) AS rank, line FROM s WHERE rank = 1 OR t <= 4000")
def fuse_truncate(spark: SparkSession, d: str) -> DataFrame:
    return retrieve.fuse(_hits(spark, d), Settings().max_context_tokens).select("rank", "line")


@query("compile_context", f"""WITH {_RANKS}
  SELECT '已知知识点：' || chr(10) || string_agg(line, chr(10) ORDER BY rank) AS context FROM s WHERE t <= 4000 AND (rank = 1 OR t + 1 <= 4000)""")
def compile_context(spark: SparkSession, d: str) -> DataFrame:
    most = Settings().max_context_tokens
    return retrieve.context(retrieve.fuse(_hits(spark, d), most), most)


@query("dedup_hits", f"WITH {_HITS} SELECT pos, head, tail FROM h")
def dedup_hits(spark: SparkSession, d: str) -> DataFrame:
    return retrieve.dedup_hits(_hits(spark, d)).select("pos", "triple.head", "triple.tail")


@query("route_counts", f"WITH {_HITS} SELECT 'graph' AS source, 2 * count(*) AS n FROM h")
def route_counts(spark: SparkSession, d: str) -> DataFrame:
    return retrieve.route_counts(_hits(spark, d))


@query("review_flag", f"""WITH {_HITS} SELECT count(*) < 3 OR max(score) < 0.3 OR bool_or(confidence = 'AMBIGUOUS') AS flagged,
  CASE WHEN count(*) < 3 THEN 'low_hit_count' WHEN max(score) < 0.3 THEN 'low_confidence_score' ELSE 'ambiguous_conflict' END AS reason,
  bool_or(confidence IN ('INFERRED', 'AMBIGUOUS')) AS used_inferred, 'EXTRACTED' AS confidence FROM h""")
def review_flag(spark: SparkSession, d: str) -> DataFrame:
    return retrieve.review(_hits(spark, d), Settings()).drop("entities")


@query("review_entities", f"""WITH {_RANKS}, k AS (SELECT rank, head, tail FROM s WHERE rank = 1 OR t <= 4000),
  e AS (SELECT head AS x, min(pos) * 2 AS o FROM k JOIN (SELECT rank, pos FROM s) USING (rank) GROUP BY 1 UNION ALL SELECT tail, min(pos) * 2 + 1 FROM k JOIN (SELECT rank, pos FROM s) USING (rank) GROUP BY 1)
  SELECT string_agg(x, ', ' ORDER BY o) AS entities FROM (SELECT x, min(o) AS o FROM e GROUP BY x)""")
def review_entities(spark: SparkSession, d: str) -> DataFrame:
    """The entities of the hits that fit the budget, as the review queue gets them."""
    return retrieve.review(retrieve.fuse(_hits(spark, d), Settings().max_context_tokens), Settings()).select("entities")


@query("citations", r"""SELECT doc_id, array_to_string(regexp_extract_all('see ^[' || source || '/' || doc_id || '.md] and ^[' || lang || '].', '\^\[([^\]]+)\]', 1), ',') AS cited FROM documents""")
def citations(spark: SparkSession, d: str) -> DataFrame:
    line = F.concat(F.lit("see ^["), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md] and ^["), "lang", F.lit("]."))
    return table(spark, d, "documents").select("doc_id", F.array_join(tx.citations(line), ",").alias("cited"))


def _merged(spark: SparkSession, d: str) -> DataFrame:
    """The concepts (lang) of each source with whole texts as descriptions, in the order of documents; place counts from 1."""
    docs = table(spark, d, "documents")
    each = docs.select(F.col("source").alias("source_file"), F.col("doc_id").alias("chunk_index"), F.lit(0).alias("pos"), F.col("lang").alias("name"), F.col("text").alias("description"), F.lit("concept").alias("node_type"))
    return semantic.merge_concepts(each, "last_write_wins").select("source_file", F.posexplode("concepts").alias("place", "c")).withColumn("place", F.col("place") + 1)


@query("concept_merge", """SELECT source AS source_file, lang AS name, sha256(arg_max(text, doc_id)) AS sha256, CASE WHEN count(*) > 1 THEN CAST(max(doc_id) AS VARCHAR) END AS last_chunk_index,
  CAST(row_number() OVER (PARTITION BY source ORDER BY min(doc_id)) AS INTEGER) AS place FROM documents GROUP BY source, lang""")
def concept_merge(spark: SparkSession, d: str) -> DataFrame:
    return _merged(spark, d).select("source_file", "c.name", F.sha2("c.description", 256).alias("sha256"), F.col("c.extra")["last_chunk_index"].alias("last_chunk_index"), "place")


@query("concept_sentences", r"""SELECT doc_id, CAST(len(list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '([.!?;\n])', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, ' ' || chr(10) || chr(9) || chr(13))), lambda x: x <> '')) AS INTEGER) AS n FROM documents""")
def concept_sentences(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.size(tx.sentences(F.col("text"))).alias("n"))


@query("community_sizes")
def community_sizes(spark: SparkSession, d: str) -> DataFrame:
    edges = materialise(triples(spark, d), "edges")
    nodes = node_table(edges)
    return community.communities(nodes, edges, community.membership(nodes, edges)).select("id", "size", "summary")


from loomgraph.plans import pieces  # noqa: E402, F401  registers its queries
