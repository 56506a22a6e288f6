"""Queries and operators over whole inputs."""

import random

import numpy as np
from pyspark.sql import functions as F

from loomgraph.build import compile_base
from loomgraph.config import Settings
from loomgraph.extract.clients import OfflineClient
from loomgraph.extract.code import extract_code
from loomgraph.operators import community, graph, vectors
from loomgraph.plans import catalog
from loomgraph.plans.fixture import node_table, triples
from loomgraph.session import materialise, numbered
from loomgraph.snapshot import Store

SF = "/root/testdata/sf0.001"


def test_numbers_without_gaps_in_order(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x"), F.col("id").cast("string").alias("y"))
    got = numbered(rows, [F.desc("x")])
    assert sorted((r["pos"], r["x"]) for r in got.collect()) == [(i + 1, 999 - i) for i in range(1000)]
    assert numbered(rows.limit(0), ["x"]).count() == 0


def test_hits_are_all_triples(spark):
    edges = triples(spark, SF)
    n = edges.count()
    assert catalog.QUERIES["route_counts"](spark, SF).first()["n"] == 2 * n
    hits = catalog.QUERIES["dedup_hits"](spark, SF)
    assert hits.count() == n and hits.agg(F.max("pos")).first()[0] == n


def test_communities_hold_every_node(spark):
    sizes = catalog.QUERIES["community_sizes"](spark, SF)
    assert sizes.agg(F.sum("size")).first()[0] == node_table(triples(spark, SF)).count()


def test_communities_are_connected_and_keep_their_modularity(spark):
    edges = triples(spark, SF.replace("0.001", "0.01"))
    pairs = graph.symmetrize(graph.weighted_pairs(edges))
    member = materialise(community.membership(node_table(edges), edges))
    parts = community.connected_parts(member, pairs)
    assert parts.select("id").distinct().count() == parts.select("id", "part").distinct().count()
    assert community.frame_modularity(pairs, member).first()[0] > 0.07


def test_both_community_routes_find_long_chains_and_large_groups(spark):
    rows = [(f"c{i:02}", f"c{i + 1:02}", 1) for i in range(39)]
    rows += [(f"{g}{i:02}", f"{g}{j:02}", 1) for g in "xy" for i in range(25) for j in range(i)] + [("x00", "y00", 1), ("z", "z", 3)]
    pairs = spark.createDataFrame(rows, "a string, b string, weight long")
    nodes = spark.createDataFrame([(x,) for x in sorted({v for r in rows for v in r[:2]} | {"alone"})], "name string")
    links = {}
    for a, b, w in rows:
        links.setdefault(a, {})[b] = links.setdefault(b, {})[a] = w
    links["alone"] = {}
    of = {r["node"]: r["id"] for r in community.leiden_frames(nodes, pairs).collect()}
    assert set(of) == set(links)
    for g in "xy":
        assert len({of[f"{g}{i:02}"] for i in range(25)}) == 1
    names, number = community.leiden(*zip(*rows, ("alone", "alone", 0), strict=True))
    assert dict(zip(names, number, strict=True)) == of
    member = spark.createDataFrame(list(of.items()), "node string, id int")
    assert abs(community.frame_modularity(pairs, member).first()[0] - community.modularity(links, of)) < 1e-12
    assert community.modularity(links, of) > 0.55
    assert {r["id"] for r in community.leiden_frames(nodes, pairs.limit(0)).collect()} == {0}


def test_community_routes_take_the_same_decisions(spark):
    """Random graphs of several kinds, weighted and with self-loops, in one task and by DataFrames."""
    rng = random.Random(11)
    seen = {}
    for size, dense in ((30, 0.1), (24, 0.5)):
        for a in range(size):
            for b in range(a + 1):
                if rng.random() < dense * (3 if a % 4 == b % 4 else 0.3):
                    seen[f"g{size}n{a:02}", f"g{size}n{b:02}"] = rng.randint(1, 5)
    rows = [(a, b, w) for (a, b), w in seen.items()]
    pairs = spark.createDataFrame(rows, "a string, b string, weight long")
    nodes = spark.createDataFrame([(x,) for x in sorted({v for r in rows for v in r[:2]})], "name string")
    names, number = community.leiden(*zip(*rows, strict=True))
    got = {r["node"]: r["id"] for r in community.leiden_frames(nodes, pairs).collect()}
    assert dict(zip(names, number, strict=True)) == got
    hashed = {r["x"]: r["h"] for r in spark.range(-50, 50).select(F.col("id").alias("x"), F.xxhash64("id", F.lit(3).cast("long")).alias("h")).collect()}
    x = np.arange(-50, 50)
    assert community.hash_long(np.full(100, 3), community.hash_long(x)).tolist() == [hashed[i] for i in x.tolist()]


def test_rounds_of_communities_write_no_tables(spark, monkeypatch):
    """Blocks of a few links, with a hub that fills several, give what joins of all labels give."""
    rng, tables, write = random.Random(3), [], materialise
    ends = {(min(a, b), max(a, b)): rng.randint(1, 4) for a, b in ((rng.randrange(60), rng.randrange(60)) for _ in range(250))}
    ends |= {(0, b): 1 for b in range(1, 60)}
    pairs = spark.createDataFrame([(f"n{a:02}", f"n{b:02}", w) for (a, b), w in ends.items()], "a string, b string, weight long")
    nodes = spark.createDataFrame([(f"n{i:02}",) for i in range(61)], "name string")
    monkeypatch.setattr(community, "BLOCK", 20)
    monkeypatch.setattr(community, "materialise", lambda df, name="table": tables.append(name) or write(df, name))
    sent = sorted(map(tuple, community.leiden_frames(nodes, pairs).collect()))
    assert "choice" not in tables
    monkeypatch.setattr(community, "SENT_NODES", 0)
    assert sorted(map(tuple, community.leiden_frames(nodes, pairs).collect())) == sent
    assert tables.count("choice") > 10 and len({i for _, i in sent}) > 2


def test_python_with_broken_lines_keeps_the_rest():
    text = "import os\ndef good(a):\n    return helper(a)\nx = = 3\nclass Box:\n    def put(self, y:\n        pass\n    def take(self):\n        return good(1)\n"
    triples, _ = extract_code("m.py", text)
    found = {(t["head"], t["relation"], t["tail"]) for t in triples}
    assert {("m", "defines", "good"), ("good", "calls", "helper"), ("Box", "contains", "take"), ("take", "calls", "good")} <= found
    assert extract_code("m.py", "(((\n")[0] == [] and extract_code("m.py", "")[0] == []


def test_java_annotations_are_no_calls():
    java = 'class B { @Get("x") @a.b.Put(value = f(1)) void k() { run(); } }'
    triples, _ = extract_code("p/B.java", java)
    found = {(t["head"], t["relation"], t["tail"]) for t in triples}
    assert ("k", "calls", "run") in found and not any(t in ("Get", "Put") for _, _, t in found)


def test_java_method_with_a_long_throws_clause():
    java = "class A { void f() throws java.io.IOException, java.sql.SQLException, a.b.C, d.e.F { g(); } abstract void k() throws a.b.C, d.e.F, g.h.I, j.k.L, m.n.O; void l() { } }"
    triples, concepts = extract_code("p/A.java", java)
    assert {(t["head"], t["relation"], t["tail"]) for t in triples} == {("A", "contains", "f"), ("f", "calls", "g"), ("A", "contains", "k"), ("A", "contains", "l")}
    assert "method A.f()" in {c["description"] for c in concepts}


class Summarizer(OfflineClient):
    def complete(self, system, user, response_format="json", temperature=0.0):
        if system != community.SYSTEM:
            return super().complete(system, user, response_format, temperature)
        if "Python" in user:
            raise RuntimeError("no answer")
        return " All about " + ", ".join(user.split("\n")[1:]) + " "


def test_summaries_are_the_models_or_the_heuristic(spark, tmp_path):
    raw = tmp_path / "raw"
    raw.mkdir()
    (raw / "a.md").write_text("Transformer uses Attention.")
    (raw / "b.md").write_text("Python is a Language.")
    s = Settings(raw_dir=str(raw), out_dir=str(tmp_path / "out"))
    compile_base(spark, s, Summarizer())  # as in the reference, a build does not ask for summaries
    store = Store(spark, s.out_dir)
    plain = {"Attention": "Community of: Attention, Transformer", "Language": "Community of: Language, Python"}
    said = lambda found: {r["members"][0]: r["summary"] for r in found.collect()}
    assert said(store.read("communities")) == plain
    nodes, edges = store.read("nodes"), store.read("edges")
    member = community.membership(nodes, edges)
    assert said(community.communities(nodes, edges, member, OfflineClient())) == plain  # an empty answer
    assert said(community.communities(nodes, edges, member, Summarizer())) == plain | {"Attention": "All about Attention, Transformer"}


def test_concepts_merge_whole_texts_by_the_operator(spark, monkeypatch):
    seen = []
    merge = catalog.semantic.merge_concepts
    monkeypatch.setattr(catalog.semantic, "merge_concepts", lambda each, strategy: seen.append(each.agg(F.max(F.length("description"))).first()[0]) or merge(each, strategy))
    for name in ("concept_merge", "concept_concat_dedup"):
        assert catalog.QUERIES[name](spark, SF).count()
    assert len(seen) == 2 and min(seen) > 40


def test_search_of_many_queries_with_ties(spark):
    rows = spark.createDataFrame([(str(i), [float(i % 7), 1.0]) for i in range(300)], "id string, embedding array<float>")
    asked = spark.createDataFrame([(f"q{i}", [float(i), 1.0]) for i in range(5)], "query string, embedding array<float>")
    got = vectors.search_many(rows, asked, 10, block=2).collect()
    for i in range(5):
        want = sorted(((i - j % 7) ** 2, str(j)) for j in range(300))[:10]
        assert [(r["distance"], r["id"]) for r in sorted(got, key=lambda r: r["rank"]) if r["query"] == f"q{i}"] == want
