import pytest

from loomgraph.answer import ColdStartError, Session
from loomgraph.build import compile_base, replay
from loomgraph.cli import main
from loomgraph.config import Settings
from loomgraph.extract.clients import OfflineClient
from loomgraph.operators import vectors
from loomgraph.snapshot import Store, graphml, node_link_json
from loomgraph.streaming.watch import Watch


@pytest.fixture
def base(tmp_path):
    raw = tmp_path / "raw"
    (raw / "sub").mkdir(parents=True)
    (raw / "a.md").write_text("Transformer uses Attention. Transformer is a Model. Attention has Heads.")
    (raw / "b.txt").write_text("Python is a Language. Java is a Language.")
    (raw / "sub" / "code.py").write_text("def helper(x):\n    return x\n\nclass Calculator:\n    def add(self, a, b=(1, 2)):\n        return helper(a)\n\nhelper(3)\n")
    (raw / "bad.md").write_bytes(b"\xff\xfe broken")
    (raw / "ignored.xyz").write_text("no")
    return Settings(raw_dir=str(raw), out_dir=str(tmp_path / "out"))


def graph_of(spark, s):
    store = Store(spark, s.out_dir)
    edges = sorted(map(tuple, store.read("edges").select("source_file", "head", "relation", "tail").collect()))
    return edges, {r["name"]: r["description"] for r in store.read("nodes").collect()}


def test_build_query_change_delete_replay(spark, base, tmp_path):
    with pytest.raises(ColdStartError):
        Session(spark, base).answer("What is Attention?")
    first = compile_base(spark, base)
    assert (first.added, first.skipped, first.extracted) == (4, 1, 3)
    edges, nodes = graph_of(spark, base)
    assert ("a.md", "Transformer", "uses", "Attention") in edges
    assert ("sub/code.py", "code", "defines", "helper") in edges and ("sub/code.py", "add", "calls", "helper") in edges
    assert nodes["add"] == "method Calculator.add(self, a, b=(1, 2))" and nodes["helper"] == "function helper(x)"
    # a file that failed is tried again; all else is unchanged
    again = compile_base(spark, base)
    assert (again.added, again.modified, again.extracted) == (1, 0, 0)
    answer = Session(spark, base).answer("What does Transformer use?")
    assert "a.md" in answer.citations and answer.confidence in ("EXTRACTED", "INFERRED")
    assert main(["query", "Transformer?"], spark, base) == 0 and main(["ask", "Attention"], spark, base) == 0
    assert main(["search", "Transformer"], spark, base) == 0 and main(["status"], spark, base) == 0 and main(["review"], spark, base) == 0
    # modification leaves nothing behind, deletion takes orphans with it
    (tmp_path / "raw" / "b.txt").write_text("Rust is a Language.")
    (tmp_path / "raw" / "a.md").unlink()
    changed = compile_base(spark, base)
    assert (changed.modified, changed.deleted) == (1, 1)
    edges, nodes = graph_of(spark, base)
    assert not [e for e in edges if e[0] == "a.md"] and "Attention" not in nodes and "Python" not in nodes and "Rust" in nodes
    ids = {r["id"] for r in Store(spark, base.out_dir).read("vectors").collect()}
    assert ids and not [i for i in ids if i.startswith("a.md::")]
    before = graph_of(spark, base)
    replay(spark, base)
    assert graph_of(spark, base) == before
    store = Store(spark, base.out_dir)
    assert '"links"' in node_link_json(store.read("nodes"), store.read("edges"))
    assert graphml(store.read("nodes"), store.read("edges")).count() == store.read("nodes").count() + store.read("edges").count() + 2


def test_cache_is_used_when_only_the_index_changes(spark, base):
    compile_base(spark, base)
    got = compile_base(spark, Settings(**{**base.__dict__, "leiden_symmetrize": "max"}))
    assert got.modified == 3 and got.cached == 3 and got.extracted == 0


def test_moved_file_is_known_and_keeps_its_new_path(spark, base, tmp_path):
    compile_base(spark, base)
    (tmp_path / "raw" / "a.md").rename(tmp_path / "raw" / "sub" / "a.md")
    got = compile_base(spark, base)
    assert (got.added, got.deleted, got.cached, got.extracted) == (2, 1, 1, 0)  # bad.md is tried again
    edges, _ = graph_of(spark, base)
    assert ("sub/a.md", "Transformer", "uses", "Attention") in edges and not [e for e in edges if e[0] == "a.md"]


def test_backend_follows_builds_and_answers(spark, base, tmp_path):
    own = vectors.TableStore(vectors.empty(spark))
    rows = lambda df: sorted((r["id"], r["document"], r["embedding"]) for r in df.collect())
    compile_base(spark, base, backend=own)
    assert rows(own.vectors) == rows(Store(spark, base.out_dir).read("vectors")) != []
    (tmp_path / "raw" / "a.md").unlink()
    (tmp_path / "raw" / "b.txt").write_text("Python uses Indentation.")
    compile_base(spark, base, backend=own)
    assert rows(own.vectors) == rows(Store(spark, base.out_dir).read("vectors"))
    compile_base(spark, base, embedder=OfflineClient(32), backend=own)  # nothing changed, so nothing is embedded again
    compile_base(spark, base, embedder=OfflineClient(32), force=True, backend=own)
    assert {len(e) for _, _, e in rows(own.vectors)} == {32} and rows(own.vectors) == rows(Store(spark, base.out_dir).read("vectors"))
    got = Session(spark, base, embedder=OfflineClient(32), backend=own)._vector("Python").collect()
    assert got and [tuple(r) for r in got] == [tuple(r) for r in Session(spark, base, embedder=OfflineClient(32))._vector("Python").collect()]
    asked = []
    own.search = lambda query, k=10: asked.append(len(query)) or vectors.search(own.vectors, query, k)
    assert Session(spark, base, embedder=OfflineClient(32), backend=own).recall("What is Python?", "ask") and asked == [32]


def test_broken_route_stops_no_other(spark, base):
    compile_base(spark, base)
    session = Session(spark, base)
    session.register("late", lambda question, entities: spark.sql("SELECT raise_error('broken') AS pos"))
    session.register("early", lambda question, entities: 1 / 0)
    assert session.answer("What does Transformer use?").citations


def test_watch_sees_add_change_delete_when_settled(spark, tmp_path):
    raw, seen = tmp_path / "raw", []
    raw.mkdir()
    watch = Watch(spark, str(raw), seen.append)
    (raw / "x.md").write_text("one")
    assert watch.tick() == [] and watch.tick() == ["x.md"]
    (raw / "x.md").write_text("three")
    (raw / "y.exe").write_text("no")
    assert watch.tick() == [] and watch.tick() == ["x.md"]
    (raw / "x.md").unlink()
    assert watch.flush() == ["x.md"] and seen == [["x.md"]] * 3
    query = watch.start()
    query.stop()
