import difflib
import json
import math
import os
import random
import time
import uuid
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.config import Settings, embedding_signature, extraction_signature, index_signature
from loomgraph.extract.clients import OfflineClient, RateLimiter, backoff, question_entities
from loomgraph.extract.code import extract_code
from loomgraph.extract.semantic import semantic_track
from loomgraph.functions import text as tx
from loomgraph.functions import tokens as tk
from loomgraph.operators import changes, community, graph, keywords, retrieve, vectors
from loomgraph.streaming.watch import changed_paths, debounced, fingerprint, moves_as_two

EDGE = "source_file string, head string, relation string, tail string, confidence string, seq long, track string, chunk_index int"


def edges(spark, rows):
    return spark.createDataFrame([(s, h, r, t, c, i, "semantic", None) for i, (s, h, r, t, c) in enumerate(rows)], EDGE)


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first()["x"]


def test_text_functions(spark):
    t = F.col("t")
    assert one(spark, tx.normalize_entity(t), t=" A  b　C\t") == "a b c"
    assert one(spark, tx.keyword_tokens(t), t="The Graph_1 has 12 and 345 的图 graph_1") == ["graph_1", "345", "图"]
    assert one(spark, tx.node_keywords(t, F.lit(None).cast("string")), t="Is") == []
    assert one(spark, tx.sentences(t), t="One. Two!三。\n four") == ["One.", "Two!", "三。", "four"]
    assert one(spark, tx.citations(t), t="x ^[a.md] y ^[b/c.md]") == ["a.md", "b/c.md"]
    assert one(spark, tx.confidence(t), t=" inferred ") == "INFERRED" and one(spark, tx.confidence(t), t="maybe") == "EXTRACTED"
    assert one(spark, tx.description(t, F.lit("n")), t="  ") == "n"
    assert one(spark, tx.suffix(t), t="a/b.PY") == ".py" and one(spark, tx.stem(t), t="a/b.c.md") == "b.c"
    assert one(spark, tx.relative_path(t, "file:///r"), t="file:///r/x/y.md") == "x/y.md"
    assert one(spark, tx.schema_number(t), t="x") == 0
    assert one(spark, tx.review_fields(t), t="- [ ] why | not | low | A, B | 2024").asDict() == {"question": "why | not", "reason": "low", "entities": "A, B", "ts": "2024"}
    assert [tx.elapsed(x) for x in (45, 135, 3780, None)] == ["45s", "2m 15s", "1h 3m", "未知"]


def test_loose_json():
    assert tx.parse_json_loose('x {"a": "}", "b": {"c": 1}} y {"d": 2}') == {"a": "}", "b": {"c": 1}}
    for bad in (None, "", "[1]", "no", "{a}", '{"a": 1'):
        assert tx.parse_json_loose(bad) is None
    assert tx.parse_json_loose('t {"a": "\\"}"}') == {"a": '"}'}


def test_chunks(spark):
    docs = spark.createDataFrame([("a", " ".join(map(str, range(250)))), ("b", "  two  words "), ("c", ""), ("d", " ".join("x" * 100))], "source_file string, text string")
    for rows in (tk.chunk_words(docs, 100, 20), tk.chunk_tokens(docs, 100, 20)):
        got = {(r["source_file"], r["index"]): (r["text"], r["token_count"]) for r in rows.collect()}
        assert sorted(got) == [("a", 0), ("a", 1), ("a", 2), ("b", 0), ("d", 0)]
        assert got["a", 1] == (" ".join(map(str, range(80, 180))), 100) and got["a", 2][1] == 90 and got["b", 0] == ("  two  words ", 2)
    for most, overlap in ((0, 0), (5, 5), (5, -1)):
        with pytest.raises(ValueError):
            tk.chunk_words(docs, most, overlap)


def test_code_structure():
    js = "function pack(item) { return wrap(item); }\nclass Crate { load() { this.pack('x'); } }"
    triples, concepts = extract_code("a.js", js)
    assert {(t["head"], t["relation"], t["tail"]) for t in triples} == {("a", "defines", "pack"), ("pack", "calls", "wrap"), ("a", "defines", "Crate"), ("Crate", "contains", "load"), ("load", "calls", "pack")}
    about = {c["name"]: c["description"] for c in concepts}
    assert (about["pack"], about["Crate"], about["load"]) == ("function pack(item)", "class Crate", "method Crate.load()")
    java = "class A extends B { int f(int x) throws E { if (x > 0) { g(x); } return new C(x).h(); } abstract void k(); }"
    assert {(t["head"], t["relation"], t["tail"]) for t in extract_code("p/A.java", java)[0]} == {("A", "contains", "f"), ("f", "calls", "g"), ("f", "calls", "h"), ("A", "contains", "k")}
    assert extract_code("x.py", "def broken(:")[0] == [] and extract_code("x.py", "def f(): f()", ("java",)) == ([], [])
    assert not [t for t in extract_code("x.py", "def f(): f()")[0] if t["relation"] == "calls"]


def test_upsert_delete_fallback(spark):
    e = graph.upsert_edges(edges(spark, [("f", "A", "r", "B", "INFERRED"), ("f", "A", "r", "B", "EXTRACTED"), ("g", "A", "r", "B", "AMBIGUOUS"), ("g", "C", "s", "A", "EXTRACTED"), ("g", "D", "q", "D", "EXTRACTED")]))
    assert sorted((r["source_file"], r["confidence"]) for r in e.filter("relation = 'r'").collect()) == [("f", "EXTRACTED"), ("g", "AMBIGUOUS")]
    nodes = graph.merge_nodes(spark.createDataFrame([("A", "first", "f", "EXTRACTED", "concept", {"k": "v"}, 0), ("A", "last", "g", "EXTRACTED", "concept", {}, 1)], "name string, description string, source_file string, confidence string, node_type string, extra map<string,string>, seq long"), e)
    got = {r["name"]: r for r in graph.with_fallbacks(nodes, e).collect()}
    assert got["A"]["description"] == "last" and got["A"]["extra"] == {"k": "v"}
    assert got["B"]["description"] == "B: r A; r A" and got["B"]["confidence"] == "INFERRED" and got["B"]["node_type"] == "entity"
    assert got["D"]["description"] == "D: q D; q D"
    left_nodes, left = graph.delete_source(nodes, e, spark.createDataFrame([("g",)], "source_file string"))
    assert {r["name"] for r in left_nodes.collect()} == {"A", "B"} and left.count() == 1
    assert graph.remove_edges(e, e.filter("head = 'D'")).count() == 3


def test_expand_and_weights(spark):
    e = edges(spark, [("f", a, "r", b, "EXTRACTED") for a, b in ("AB", "BC", "CD", "DE", "BC", "CB")]).withColumn("source_file", F.col("seq").cast("string"))
    seed = spark.createDataFrame([("A",)], "name string")
    for hops, expected in ((0, 0), (1, 1), (2, 4), (3, 5)):
        nodes, found = graph.expand(e, seed, hops)
        assert found.count() == expected
    assert {r["name"] for r in graph.expand(e, seed, 2)[0].collect()} == {"A", "B", "C"}
    assert graph.expand(e, seed, 3, cap=2)[1].count() == 2
    pairs = graph.weighted_pairs(e)
    weight = lambda how: {(r["a"], r["b"]): r["weight"] for r in graph.symmetrize(pairs, how).collect()}
    assert weight("sum")["B", "C"] == 3 and weight("max")["B", "C"] == 2


def test_communities(spark):
    rows = [("d1", a, "r", b, "EXTRACTED") for a, b in ("AB", "BC", "CA")] + [("d2", a, "r", b, "EXTRACTED") for a, b in ("DE", "EF", "FD")] + [("d1", "A", "r", "D", "EXTRACTED")]
    e = edges(spark, rows)
    nodes = spark.createDataFrame([(x, None, "d1", None, None, None) for x in "ABCDEF"], "name string, description string, source_file string, confidence string, node_type string, extra map<string,string>")
    one, many = (sorted(map(tuple, community.membership(nodes, e, one_task=limit).collect())) for limit in (1000, 0))
    assert one == many == [(x, int(x > "C")) for x in "ABCDEF"]
    member = community.membership(nodes, e)
    found = community.communities(nodes, e, member).orderBy("id").collect()
    assert [r["members"] for r in found] == [["A", "B", "C"], ["D", "E", "F"]] and found[0]["summary"] == "Community of: A, B, C"
    asked = spark.createDataFrame([("a",), ("B ",), ("x",)], "name string")
    assert [(r["id"], round(r["score"], 3)) for r in community.overlap(community.communities(nodes, e, member), asked).collect()] == [(0, 0.667)]
    rng = random.Random(7)
    links = [(f"n{a:02}", f"n{b:02}", 1.0) for a in range(40) for b in range(a) if rng.random() < (0.6 if a // 10 == b // 10 else 0.03)]
    names, number = community.leiden(*zip(*links, strict=True))
    of = dict(zip(names, number, strict=True))
    assert len(set(of.values())) == 4 and all(of[f"n{i:02}"] == of[f"n{i // 10 * 10:02}"] for i in range(40))
    assert community.leiden(["b"], ["a"], [0])[1].tolist() == [0, 0]


def test_fuzzy_equals_difflib(spark):
    rng = random.Random(3)
    names = sorted({"".join(rng.choice("abcde") for _ in range(rng.randint(1, 9))) for _ in range(150)})
    asked = ["abcde", "aabb", "c", "edcbaedcb", "bbb"]
    nodes = retrieve.normalized_nodes(spark.createDataFrame([(x,) for x in names], "name string"))
    got = retrieve.fuzzy_matches(spark.createDataFrame([(x,) for x in asked], "name string"), nodes, 0.7).orderBy("entity_norm", "rank").collect()
    for x in asked:
        assert [r["norm"] for r in got if r["entity_norm"] == x] == difflib.get_close_matches(x, names, 3, 0.7)


def test_seeds_hits_fusion(spark):
    e = edges(spark, [("doc.md", "Compressor", "uses", "Turbine", "EXTRACTED"), ("doc.md", "Compressor", "is_a", "Machine", "AMBIGUOUS")])
    nodes = spark.createDataFrame([(x, f"about {x}", "doc.md", "EXTRACTED", "concept", {}) for x in ("Compressor", "Turbine", "Machine", "Lonely")], "name string, description string, source_file string, confidence string, node_type string, extra map<string,string>")
    ask = lambda *x: spark.createDataFrame([(v,) for v in x], "name string")
    assert {r["name"] for r in retrieve.seeds(ask("compresor", "TURBINE "), nodes).collect()} == {"Compressor", "Turbine"}
    hits = retrieve.graph_hits(nodes, e, ask("Compressor"), Settings())
    assert hits.count() == 2
    alone = retrieve.graph_hits(nodes, e, ask("lonely"), Settings()).collect()
    assert [h["concept"]["name"] for h in alone] == ["Lonely"]
    both = retrieve.union_routes([hits, hits, retrieve.graph_hits(nodes, e, ask("lonely"), Settings())])
    fused = retrieve.fuse(both, 4000)
    assert [r["line"] for r in fused.orderBy("rank").collect()] == ["[Compressor]--uses-->[Turbine] (来源:doc.md)", "[Lonely] about Lonely (来源:doc.md)", "[Compressor]--is_a-->[Machine] (来源:doc.md)"]
    assert retrieve.fuse(both, 1).count() == 1
    assert retrieve.context(fused, 15).first()["context"] == "已知知识点：\n[Compressor]--uses-->[Turbine] (来源:doc.md)"
    assert retrieve.context(fused.limit(0)).first()["context"] == ""
    verdict = retrieve.review(hits, Settings()).first()
    assert verdict["flagged"] and verdict["reason"] == "low_hit_count" and verdict["entities"] == "Compressor, Machine, Turbine" and verdict["confidence"] == "EXTRACTED" and verdict["used_inferred"]
    assert retrieve.review(hits.limit(0), Settings()).first()["confidence"] == "AMBIGUOUS"


def test_vectors_and_cache(spark):
    client, calls = OfflineClient(8), []
    texts = spark.createDataFrame([("alpha",), ("beta",), ("alpha",)], "text string")
    got, new = vectors.embed_texts(texts, client.embed, "m", 8)
    assert got.count() == 2
    held = spark.createDataFrame(new.collect(), vectors.CACHE)
    again, fresh = vectors.embed_texts(texts, lambda t: calls.append(t) or 1 / 0, "m", 8, held)
    assert again.count() == 2 and fresh.count() == 0
    other, fresh = vectors.embed_texts(texts, client.embed, "other", 8, held)
    assert fresh.count() == 2
    nodes = spark.createDataFrame([("f", "A", "alpha"), ("g", "B", "beta"), ("g", "C", " ")], "source_file string, node string, description string")
    rows = vectors.index_nodes(nodes, got)
    assert sorted(r["id"] for r in vectors.list_ids(rows).collect()) == ["f::A", "g::B"]
    assert vectors.upsert(rows, rows).count() == 2 and vectors.delete_sources(rows, spark.createDataFrame([("g",)], "source_file string")).count() == 1
    near = vectors.search(rows, client.embed(["alpha"])[0], 1).first()
    assert near["id"] == "f::A" and near["score"] == pytest.approx(1.0)
    for metric in ("cosine", "ip"):
        assert vectors.search(rows, client.embed(["beta"])[0], 1, metric).first()["id"] == "g::B"


def test_keyword_index(spark):
    nodes = spark.createDataFrame([(f"Node {i}", "shared graph", "f", "concept") for i in range(5)], "name string, description string, source_file string, node_type string")
    index = keywords.keyword_index(nodes, 3)
    assert keywords.lookup(index, " SHARED ").count() == 3 and keywords.lookup(index, "node 4").count() == 1
    assert keywords.lookup_any(index, ["graph", "shared", "node 4"]).count() == 4


def test_changes_and_log(spark):
    s = "path string, sha256 string, extraction_config string, llm_model string, index_config string, embedding_config string"
    now = spark.createDataFrame([("a", "1", "x", "m", "i", "e"), ("b", "2", "x", "m", "i", "e"), ("c", "3", "x", "m", "i", "e")], s)
    old = spark.createDataFrame([("b", "2", "x", "m", "i", "e"), ("c", "3", "x", "m", None, "e"), ("d", "4", "x", "m", "i", "e")], s)
    assert dict(map(tuple, changes.detect_changes(now, old).collect())) == {"a": "added", "b": "unchanged", "c": "modified", "d": "deleted"}
    log = spark.createDataFrame([("s", "2024", "1", 0), ("s", "2025", "9", 1), ("s", "2025", "10", 2), ("s", "2025", "10", 3)], "source_file string, ts string, schema_version string, pos long")
    assert changes.converge(log).first()["pos"] == 2
    with pytest.raises(ValueError):
        changes.check_versions(log, "10")


def test_semantic_track(spark):
    class Fake:
        def complete(self, system, user, response_format="json", temperature=0.0):
            if "fail" in user:
                return "no json"
            return '{"triples": [{"head": " A ", "relation": "r", "tail": "B", "confidence": "odd"}, {"head": "", "relation": "r", "tail": "B"}], "concepts": [{"name": "A", "description": "%s."}, {"name": ""}]}' % user

    chunks = spark.createDataFrame([("d/x.md", 1, "two"), ("d/x.md", 0, "one"), ("d/x.md", 2, "fail")], "source_file string, index int, text string")
    for strategy, said in (("last_write_wins", "two."), ("concat_dedup", "one. two.")):
        r = semantic_track(chunks, Fake(), strategy).first()
        assert r["failed"] and [(t["head"], t["relation"], t["tail"], t["confidence"], t["chunk_index"]) for t in r["triples"]] == [("A", "r", "B", "EXTRACTED", 0), ("A", "r", "B", "EXTRACTED", 1), ("x", "extraction_failed", "chunk_2", "AMBIGUOUS", 2)]
        assert [(c["name"], c["description"], c["extra"]) for c in r["concepts"]] == [("A", said, {"last_chunk_index": "1"})]


def test_clients_and_signatures():
    assert question_entities(OfflineClient(), "What is Turbine?") == ["What", "Turbine"]
    assert [backoff(i) for i in (0, 1, 9)] == [10, 20, 120]
    RateLimiter(0).acquire()
    a, b = Settings(), Settings(chunk_max_tokens=7)
    assert extraction_signature(a) != extraction_signature(b) and index_signature(a) == index_signature(b) and embedding_signature(a) == embedding_signature(b)
    assert Settings.from_env({"LOOMGRAPH_RETRIEVAL_HOPS": "5", "LOOMGRAPH_CODE_LANGUAGES": '["java"]'}, None).code_languages == ("java",)


def test_debounce(spark):
    rows = spark.createDataFrame([(0.0, "a.md", None), (0.3, "b.md", "c.md"), (5.0, "a.md", None)], "t double, path string, moved_to string")
    got = debounced(moves_as_two(rows.withColumn("ts", F.timestamp_seconds("t")))).orderBy("start").collect()
    assert [r["paths"] for r in got] == [["a.md", "b.md", "c.md"], ["a.md"]]
    listed = lambda *rows: spark.createDataFrame(list(rows), "path string, mark string")
    old, new = listed(("a", "1"), ("b", "1"), ("d", "4")), listed(("b", "2"), ("c", "1"), ("d", "4"))
    assert sorted(r["path"] for r in changed_paths(old, new).collect()) == ["a", "b", "c"]
    assert fingerprint(old) == fingerprint(old.orderBy("mark", F.desc("path"))) != fingerprint(new) and fingerprint(old.limit(0))[0] == 0


def test_sessions_of_a_table_need_no_common_key(spark):
    from pyspark.sql import Window

    from loomgraph.session import carried
    from loomgraph.streaming.watch import session_paths

    rng, at, rows = random.Random(3), 0, []
    for i in range(400):
        at += rng.choice((0, 1, 499_999, 500_000, 500_001, 3_000_000))  # ties, and gaps at the limit on either side
        rows.append((at, f"p{rng.randrange(9)}"))
    rows += [(at + 10_000_000, "hot")] * 300 + [(None, "x"), (at, None)]
    rng.shuffle(rows)
    events = spark.createDataFrame(rows, "t long, path string").select(F.timestamp_micros("t").alias("ts"), "path", F.lit(1).alias("start"), F.lit(2).alias("slice"))
    want, last = [], None
    for t, p in sorted((t, p) for t, p in rows if t is not None and p is not None):
        if last is None or t - last >= 500_000:
            want.append([t, {}])
        want[-1][1][p] = want[-1][1].get(p, 0) + 1
        last, want[-1][2:] = t, [t + 500_000]
    us = lambda c: F.unix_micros(c).alias(c)
    got = debounced(events).select(us("start"), us("end"), "paths", "n").orderBy("start").collect()
    assert [tuple(r) for r in got] == [(s, end, sorted(n), sum(n.values())) for s, n, end in want]
    each = session_paths(events).select(us("start"), "path", "n").collect()
    assert sorted(map(tuple, each)) == sorted((s, p, k) for s, n, _ in want for p, k in n.items())
    plan = debounced(events)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan
    assert debounced(events.limit(0)).count() == 0 and session_paths(events.filter("path IS NULL")).count() == 0
    known = spark.createDataFrame([(i, i if i % 7 == 3 else None) for i in range(50)], "o int, v int")
    assert [r["v"] for r in carried(known, "o", "v").orderBy("o").collect()] == [None if i < 3 else i - (i - 3) % 7 for i in range(50)]


class Noting:
    """A client that notes when it is called."""

    def __init__(self, folder, interval):
        self.folder, self.limit = folder, RateLimiter(interval)

    def complete(self, system, user, response_format="json", temperature=0.0):
        self.limit.acquire()
        at = time.time()
        with open(f"{self.folder}/{uuid.uuid4().hex}", "w") as f:
            f.write(f"{at} {os.getpid()}")
        return json.dumps({"triples": [], "concepts": []})


def test_tasks_keep_one_rate_limit_together(spark, tmp_path):
    chunks = spark.createDataFrame([(f"f{i}", 0, "t") for i in range(24)], "source_file string, index int, text string")
    assert semantic_track(chunks, Noting(str(tmp_path), 0.1), concurrency=3).count() == 24
    calls = [(tmp_path / f).read_text().split() for f in os.listdir(tmp_path)]
    times = sorted(float(t) for t, _ in calls)
    assert len(calls) == 24 and len({p for _, p in calls}) > 1  # each chunk once, by several processes
    assert min(b - a for a, b in zip(times, times[1:], strict=False)) > 0.06  # a late wake-up shortens the next gap
    assert times[-1] - times[0] < 24 * 0.1 * 3
    turns = [RateLimiter(0.05, part, 3) for part in range(3)]
    for limiter in turns * 2:
        limiter.acquire()
        assert int(time.time() / 0.05 + 0.1) % 3 == limiter.part


def test_connected_parts(spark):
    rng = random.Random(5)
    chain = [(f"c{i:03}", f"c{i + 1:03}") for i in range(60)]
    loose = [(f"r{rng.randrange(40):02}", f"r{rng.randrange(40):02}") for _ in range(35)]
    nodes = {x for p in chain + loose for x in p} | {"alone"}
    of = {x: 0 if x[0] == "c" else rng.randrange(2) for x in nodes} | {"c030": 1}
    member = spark.createDataFrame(sorted(of.items()), "node string, id int")
    pairs = spark.createDataFrame(chain + loose + loose[:5], "a string, b string")
    low = {x: x for x in nodes}
    for _ in range(len(nodes)):
        for a, b in chain + loose:
            if of[a] == of[b]:
                low[a] = low[b] = min(low[a], low[b])
    assert {r["node"]: r["part"] for r in community.connected_parts(member, pairs).collect()} == low
    assert low["c060"] == "c031" and low["c030"] == "c030"
    names = sorted(nodes)
    x, y = (np.array([names.index(p[k]) for p in chain + loose]) for k in (0, 1))
    got = community._parts_arrays(x, y, np.array([of[n] for n in names]))
    assert {n: names[k] for n, k in zip(names, got, strict=True)} == low
    assert community.connected_parts(member.limit(0), pairs).count() == 0 and community.connected_parts(member, pairs.limit(0)).filter("part = node").count() == len(nodes)


def test_debounce_stream(spark, tmp_path):
    rows = spark.createDataFrame([(float(t), p) for t, p in ((0, "a.md"), (0.2, "b.py"), (9, "x.exe"), (4000, "z.md"))], "t double, path string").withColumn("ts", F.timestamp_seconds("t"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    query = debounced(stream, formats=(".md", ".py")).writeStream.format("memory").queryName("debounced").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).start()
    query.processAllAvailable()
    query.stop()
    assert [r["paths"] for r in spark.table("debounced").collect()] == [["a.md", "b.py"]]


def test_fuzzy_index_equals_difflib_over_all_pairs(spark):

    rng = random.Random(4)
    names = {"".join(rng.choice("abcdefgh 1é日") for _ in range(rng.randint(1, 24))).strip() for _ in range(250)} | {"a", "aa", "ab", "supplier:12", "supplier:21"}
    names = sorted({" ".join(n.split()) for n in names} - {""})
    asked = sorted({n[:i] + rng.choice("abz") + n[i + 1 :] for n in names for i in [rng.randrange(len(n))]} | {"a", "ab", "suplier:12"})
    asked = [a for a in (" ".join(x.split()) for x in asked) if a]
    index = retrieve.normalized_nodes(spark.createDataFrame([(n,) for n in names], "name string"))
    for cutoff in (0.8, 0.5):
        want = set()
        for a in set(asked):
            near = [(difflib.SequenceMatcher(None, b, a).ratio(), b) for b in names]
            want |= {(a, b, round(r, 9)) for r, b in sorted((x for x in near if x[0] >= cutoff), reverse=True)[:3]}
        got = retrieve.fuzzy_matches(spark.createDataFrame([(a,) for a in asked], "name string"), index, cutoff).collect()
        assert {(r["entity_norm"], r["norm"], round(r["ratio"], 9)) for r in got} == want and want


def test_first_hits_of_ties_and_of_many_weights(spark, monkeypatch):
    monkeypatch.setattr(retrieve, "BINS", 4)
    rows = spark.range(3000).select((F.col("id") * 7 % 3000).alias("pos"), F.when(F.col("id") % 3 == 0, 0.9).when(F.col("id") % 3 == 1, F.rand(2)).otherwise(1.0).alias("weighted"))
    rows = spark.createDataFrame(rows.collect(), rows.schema)
    order = sorted(((-r["weighted"], r["pos"]) for r in rows.collect()))
    for most in (1, 10, 900, 1100, 2500, 5000):
        got = sorted(((-r["weighted"], r["pos"]) for r in retrieve.first_hits(rows, most).collect()))
        assert got == order[: len(got)] and min(most, 3000) <= len(got) <= 3 * most
    assert retrieve.first_hits(rows.limit(0), 5).count() == 0


def test_vector_index_recall_and_hot_cells(spark, monkeypatch):
    import numpy as np

    from loomgraph.operators import ann

    rng = np.random.default_rng(9)
    x = np.concatenate((rng.standard_normal((600, 16)), rng.standard_normal((1, 16)) + 0.01 * rng.standard_normal((300, 16))))
    rows = spark.createDataFrame([(str(i), v.tolist()) for i, v in enumerate(x)], "id string, embedding array<float>")
    asked = rows.filter("cast(id as int) % 20 = 0").withColumnRenamed("id", "query")
    monkeypatch.setattr(ann, "MEMBERS", 50)
    monkeypatch.setattr(ann, "ASKED", 7)
    index = ann.fit(rows, 10)
    got = ann.search(ann.assign(rows, index), asked, index, 10).collect()
    want = {(r["query"], r["id"]): r["distance"] for r in vectors.search_many(rows, asked, 10).collect()}
    hit = [r for r in got if (r["query"], r["id"]) in want]
    assert len(got) == 450 and len(hit) >= 0.9 * len(want) and all(r["distance"] == pytest.approx(want[r["query"], r["id"]]) for r in hit)
    assert ann.fit(rows.limit(0)) is None


def test_fuzzy_pairs_of_many_blocks_meet_once(spark, monkeypatch):
    """Blocks of a few names, products of a few scores: every pair with enough common characters, and none twice."""
    for name, size in (("NAME_CHARS", 40), ("ENTITY_CHARS", 30), ("SCORES", 50)):
        monkeypatch.setattr(retrieve, name, size)
    rng = random.Random(3)
    names = ["".join(rng.choices("ab12é的😀 ", k=rng.choice((1, 2, 5, 9, 10)))) for _ in range(300)] + ["x" * 700]
    asked = names[::9] + ["x" * 690 + "y" * 10, "", "a"]
    frame = lambda some: spark.createDataFrame([(x,) for x in some], "name string")
    for cutoff in (0.5, 0.8, 1.0):
        got = sorted(map(tuple, retrieve.fuzzy_survivors(frame(asked), retrieve.normalized_nodes(frame(names)), cutoff).collect()))
        clean = lambda some: {" ".join(x.split()) for x in some} - {""}
        count = lambda a, b: sum((Counter(a) & Counter(b)).values())
        band = lambda a, b: max(1, math.ceil(len(a) * cutoff / (2 - cutoff) - 1e-9)) <= len(b) <= math.floor(len(a) * (2 - cutoff) / cutoff + 1e-9)
        assert got == sorted((a, b) for a in clean(asked) for b in clean(names) if band(a, b) and count(a, b) >= math.ceil((len(a) + len(b)) * cutoff / 2 - 1e-9))


def test_small_levels_of_a_large_graph_are_finished_with_arrays(spark, monkeypatch):
    rng, seen, make = np.random.default_rng(5), [], community._levels_task
    ends = rng.integers(0, 12, (150, 2)) + 12 * rng.integers(0, 5, (150, 1))
    e = spark.createDataFrame([(f"n{a}", f"n{b}") for a, b in ends.tolist()] + [("n0", "n12"), ("n12", "n24")], "head string, tail string")
    nodes = e.select(F.explode(F.array("head", "tail")).alias("name"))
    monkeypatch.setattr(community, "_levels_task", lambda *state: seen.append(state) or make(*state))
    one, many = (sorted(map(tuple, community.membership(nodes, e, one_task=limit).collect())) for limit in (1000, 80))
    assert one == many and len(seen) == 1


def test_fusion_deduplicates_only_keys_of_the_best_hits(spark, monkeypatch):
    """A key's first hit counts though a later one weighs more; with many repeats on top more hits are looked at, at last all."""
    t = "struct<head:string,relation:string,tail:string,confidence:string,source_file:string,track:string,chunk_index:int>"
    c = "struct<name:string,description:string,source_file:string,confidence:string,node_type:string,extra:map<string,string>>"
    seen, real = [], retrieve.dedup_hits
    monkeypatch.setattr(retrieve, "dedup_hits", lambda x: seen.append(x.count()) or real(x))
    for repeats, looks in ((1, 1), (60, 2), (600, 3)):
        rows = [(1, 0.2, "a"), (2, 0.9, "a")] + [(10 + i, 0.8, "c") for i in range(repeats)] + [(1000 + i, 0.1 + (i % 3) / 100, f"n{i}") for i in range(900)]
        hits = spark.createDataFrame([(pos, "graph", score, (head, "r", "b", "EXTRACTED", "f", "x", 0)) for pos, score, head in rows], f"pos long, source string, score double, triple {t}")
        hits = hits.withColumns({"concept": F.lit(None).cast(c), "community_summary": F.lit(None).cast("string")})
        first = {}
        for pos, score, head in rows:
            first.setdefault(head, (-score, pos, head))
        seen.clear()
        got = [(r["pos"], r["triple"]["head"]) for r in retrieve.fuse(hits, 30).orderBy("rank").collect()]
        assert got and got == [(pos, head) for _, pos, head in sorted(first.values())][: len(got)] and got[:2] == [(10, "c"), (1, "a")]
        assert len(seen) == looks and (looks == 3 or max(seen) < len(rows))


def test_costly_work_on_a_small_file_is_dealt_to_tasks(spark):
    """Names of one partition are read by as many tasks as shuffles have, whatever the file's bytes."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    nodes = spark.range(100).coalesce(1).select(F.concat(F.lit("n"), F.col("id").cast("string")).alias("name"), F.lit("x y").alias("description"), F.lit("f").alias("source_file"), F.lit("concept").alias("node_type"))
    assert keywords.postings(nodes).select(F.spark_partition_id()).distinct().count() == parts


def test_names_found_exactly_are_not_looked_for_by_similarity(spark, monkeypatch):
    nodes = spark.createDataFrame([("Compressor",), ("Turbine",)], "name string")
    monkeypatch.setattr(retrieve, "fuzzy_matches", lambda *a: pytest.fail("all names are known"))
    asked = spark.createDataFrame([(" TURBINE",)], "name string")
    assert [r["name"] for r in retrieve.seeds(asked, nodes).collect()] == ["Turbine"]


def _counted(df, seen):
    def run(frames):
        for frame in frames:
            seen.add(len(frame))
            yield frame

    return df.mapInPandas(run, df.schema)


def test_each_hop_reads_the_edges_twice(spark):
    """Once for heads and once for tails, and not again for later hops."""
    seen = spark.sparkContext.accumulator(0)
    edges = spark.range(100).select(F.lit("f").alias("source_file"), F.concat(F.lit("n"), "id").alias("head"), F.lit("r").alias("relation"), F.concat(F.lit("n"), F.col("id") + 1).alias("tail"), F.col("id").alias("seq"))
    for hops in (1, 2, 3):
        seen.value = 0
        found = graph.expand(_counted(edges, seen), spark.createDataFrame([("n50",)], "name string"), hops)[1]
        assert found.count() == 2 * hops and seen.value == hops * 200


def test_a_version_of_the_star_schema_derives_its_edges_once(spark, monkeypatch):
    from loomgraph.plans import pieces

    seen, d = spark.sparkContext.accumulator(0), "/root/testdata/sf0.001"
    n = pieces.triples(spark, d).count()
    monkeypatch.setattr(pieces, "triples", lambda spark, d, make=pieces.triples: _counted(make(spark, d), seen))
    store = pieces._stored(spark, d)
    assert store.read("edges").count() == n == seen.value


def test_counts_keep_no_tables(spark):
    from loomgraph.answer import Session
    from loomgraph.config import Settings
    from loomgraph.plans import pieces

    session = Session(spark, Settings(out_dir=pieces._stored(spark, "/root/testdata/sf0.001").out))
    first = session.counts()
    assert not session.held and first["keywords"] == first["vectors"] == 25 and first["sources"] == 4
    session.table("edges").count()
    assert session.counts() == first and list(session.held) == ["edges"]
    session.close()


def test_long_texts_are_cut_into_windows(spark):
    """Windows of all sizes equal slices of the segments; a text of many windows is not looked at anew for each."""
    odd = "".join(chr(c) + " " * (c % 3) for c in (*range(9, 0x250), *range(0xE00, 0x1100), *range(0x1FF8, 0x2070), *range(0x2E78, 0x3130), *range(0x3FF0, 0x4E10), *range(0xFDF0, 0x10000), *range(0x1FFF0, 0x20010)))
    texts = spark.createDataFrame([("odd", odd), ("long", "x" * 999 + " y"), ("lead", "\u3000 a b c"), ("blank", " \t")], "source_file string, text string")
    segs = {r[0]: r[1] for r in texts.select("source_file", tk.segments(F.col("text"))).collect()}
    whole = {r[0]: r[1] for r in texts.collect()}
    for most, overlap in ((100, 20), (3000, 200), (7, 3), (400, 0), (3, 2)):
        want, step = [], most - overlap
        for name, w in segs.items():
            lead = len(whole[name]) - len("".join(w))
            for k in range(max(0, -((most - len(w)) // step)) + 1 if w else 0):
                text = whole[name] if len(w) <= most else "".join(w[k * step : k * step + most])
                at = 0 if len(w) <= most else lead + len("".join(w[: k * step]))
                want.append((name, k, text.rstrip() if len(w) > most else text, len(w[k * step : k * step + most]), at))
        got = tk.chunk_segments(texts, most, overlap).collect()
        assert sorted((r[0], r[1], r[2].rstrip() if len(segs[r[0]]) > most else r[2], r[3], r[4]) for r in got) == sorted(want)
    n = 400_000
    big = spark.range(1).select(F.lit("big").alias("source_file"), F.repeat(F.lit("字"), n).alias("text"))
    last = -((100 - n) // 80)
    assert tk.chunk_segments(big, 100, 20).agg(F.sum("start")).first()[0] == 40 * last * (last + 1)
