"""State on disk, progress, logging, clients and settings."""

import io
import json
import logging
import os
import threading
import time
import urllib.error
import zipfile

import pytest
from pyspark.sql import functions as F

from loomgraph import progress as pg
from loomgraph import session
from loomgraph.build import compile_base, replay
from loomgraph.config import Settings, find_env_file
from loomgraph.extract import clients
from loomgraph.extract.clients import EmbedderError, HttpClient, OfflineClient, probe_dim
from loomgraph.extract.semantic import semantic_track
from loomgraph.functions.text import parse_json_loose
from loomgraph.functions.tokens import RankTokenizer, chunk_segments, chunk_tokens
from loomgraph.logs import setup_logging
from loomgraph.operators import vectors
from loomgraph.snapshot import TABLES, ConcurrentBuildError, Store, bucket, replace_with_retry
from loomgraph.sources.files import docx_text


class Down:
    def embed(self, texts):
        raise OSError("down")


class Slow(OfflineClient):
    """Counts the calls that run at a time."""

    lock, running, most = threading.Lock(), 0, 0

    def complete(self, *args, **how):
        with Slow.lock:
            Slow.running += 1
            Slow.most = max(Slow.most, Slow.running)
        time.sleep(0.05)
        with Slow.lock:
            Slow.running -= 1
        return super().complete(*args, **how)


def test_a_silent_embedder_leaves_the_base_as_it_is(spark, tmp_path):
    raw = tmp_path / "raw"
    raw.mkdir()
    (raw / "a.md").write_text("Mortar uses Lime. Brick is a Stone.")
    (raw / "b.md").write_text("Roof has Tiles. Beam supports Roof.")
    s = Settings(raw_dir=str(raw), out_dir=str(tmp_path / "out"))
    first = compile_base(spark, s)
    n = Store(spark, s.out_dir).read("vectors").count()
    assert first.version == 1 and n > 0
    (raw / "b.md").unlink()
    with pytest.raises(EmbedderError):
        compile_base(spark, s, embedder=Down())
    store = Store(spark, s.out_dir)
    assert store.version == 1 and store.read("vectors").count() == n and pg.read_progress(store)["stage"] == "interrupted"
    again = compile_base(spark, s)
    assert again.version == 2 and again.deleted == 1 and 0 < store.read("vectors").count() < n
    with pytest.raises(EmbedderError):
        probe_dim(Down())


def test_only_two_versions_stay_and_the_graph_is_exported(spark, tmp_path):
    raw = tmp_path / "raw"
    raw.mkdir()
    for i, kind in enumerate(("json", "graphml", "")):
        (raw / f"{i}.md").write_text(f"Item{i} uses Tool{i}.")
        compile_base(spark, Settings(raw_dir=str(raw), out_dir=str(tmp_path / "out"), graph_serialization=kind))
    out, store = tmp_path / "out", Store(spark, str(tmp_path / "out"))
    folder = lambda v: next(out.glob(f"v={v}-*"))
    number = lambda at: int(at[2:].split("-")[0])
    assert not (folder(1) / "nodes").exists() and (folder(2) / "nodes").exists()
    edges = {r["source_file"] for r in store.read("edges").collect()}
    assert edges == {"0.md", "1.md", "2.md"} and store.read("manifest").count() == 3
    mine = spark.range(1).select(bucket(F.lit("2.md"))).first()[0]
    assert [p.name for p in (folder(3) / "edges").iterdir() if p.name.startswith("bucket=")] == [f"bucket={mine}"]
    parts = store.layout(3)["edges"]
    assert set(map(number, parts.values())) <= {1, 2, 3} and number(parts[str(mine)]) == 3
    (raw / "0.md").unlink()
    compile_base(spark, Settings(raw_dir=str(raw), out_dir=str(out)))
    assert {r["source_file"] for r in store.read("edges").collect()} == {"1.md", "2.md"} == {r["source_file"] for r in store.read("vectors").collect()}
    compile_base(spark, Settings(raw_dir=str(raw), out_dir=str(out)), force=True)
    assert {number(v) for parts in store.layout(5).values() for v in parts.values()} == {5} and store.read("manifest").count() == 2
    compile_base(spark, Settings(raw_dir=str(raw), out_dir=str(out)), force=True)
    assert sorted(p.name.split("-")[0] for p in out.iterdir() if p.name.startswith("v=")) == ["v=5", "v=6"]
    assert sorted(p.name for p in (out / "versions").iterdir() if not p.name.startswith(".")) == ["5.json", "6.json"]
    lines = [json.loads(r["value"]) for r in spark.read.text(str(tmp_path / "out" / "graph.json")).collect()]
    assert {x["kind"] for x in lines} == {"node", "link"} and any(x.get("link", {}).get("head") == "Item0" for x in lines)
    assert spark.read.text(str(tmp_path / "out" / "graph.graphml")).filter("value like '<graphml%'").count() == 1
    with pytest.raises(ValueError):
        Store(spark, str(tmp_path / "out")).export_graph("xml")
    log = Store(spark, str(tmp_path / "out")).read_log()
    assert {r["pos"] for r in log.collect()} == {1, 2, 3, 4, 5, 6}


def test_shared_folder_and_clean(spark):
    class Conf:
        def get(self, *_):
            return None

    class Remote:
        conf = Conf()

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(Remote())
    Remote.sparkContext.master = "local[2]"
    assert session.shared_dir(Remote()) == session.shared_dir(Remote()) != session.shared_dir(spark)
    made = session.materialise(spark.range(3), "gone")
    assert made.count() == 3
    path = spark._jvm.org.apache.hadoop.fs.Path(session.work_dir(spark))
    assert path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def test_progress_counts_beats_and_liveliness(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path))
    p = pg.Progress(store)
    p.stage("extract", extract={"total": 4})
    p.update_extract(completed=1, cached=1)
    assert not p.flush_if_pending() and pg.read_progress(store)["extract"]["completed"] == 0
    p.update_extract(completed=pg.FLUSH_EVERY)
    assert pg.read_progress(store)["extract"]["completed"] == 1 + pg.FLUSH_EVERY
    p.update_vector(indexed=5, total=10, flush=True)
    state = pg.read_progress(store)
    assert state["vector"] == {"total_nodes": 10, "indexed_nodes": 5} and pg.is_alive(state) and pg.check_alive(store)
    p.stage("vector")
    state = pg.read_progress(store)
    assert [pg.stage_state(state, x) for x in ("detect", "vector", "index")] == [("ok", None), ("run", 50), ("pending", None)]
    old = state | {"heartbeat_ts": "2000-01-01T00:00:00+00:00"}
    assert not pg.is_fresh(old) and not pg.is_alive(old) and not pg.is_fresh({}) and pg.is_fresh(state | {"heartbeat_ts": pg.now().replace("+00:00", "")})
    store.write_text(".build_progress.json", json.dumps(old))
    out = io.StringIO()
    assert not pg.check_alive_shown(store, pg.TerminalProgressReporter(out), 0.01) and "running build" in out.getvalue()
    store.write_text(".build_progress.json", "{broken")
    assert pg.read_progress(store) is None
    with pytest.raises(ValueError):
        p.stage("unheard of")
    p.interrupted()
    assert not pg.check_alive(store)
    again = pg.Progress(store)
    again.done()
    assert pg.read_progress(store) is None


def test_reporters():
    out = io.StringIO()
    with pg.TerminalProgressReporter(out).stage("fuse"):
        pass
    with pytest.raises(KeyError), pg.TerminalProgressReporter(out).stage("answer"):
        raise KeyError
    assert out.getvalue().startswith("✓ fuse") and "✗ answer" in out.getvalue()
    with pg.NullProgressReporter().stage("x"):
        pass


def test_logging_goes_to_console_and_file(tmp_path, capsys):
    for _ in range(2):
        log = setup_logging(str(tmp_path), verbose=False)
    assert len(log.handlers) == 2
    log.info("quiet", extra={"stage": "extract", "source_file": "a.md"})
    log.warning("loud")
    text = (tmp_path / "build.log").read_text()
    assert "INFO [extract] [a.md] quiet" in text and "WARNING [-] [-] loud" in text
    assert "quiet" not in capsys.readouterr().err
    assert len(setup_logging(None, True).handlers) == 1
    logging.getLogger("loomgraph").propagate = True


def test_replace_is_tried_again():
    tries = []

    def replace():
        tries.append(1)
        if len(tries) < 3:
            raise PermissionError

    replace_with_retry(replace, delay=0)
    assert len(tries) == 3
    with pytest.raises(PermissionError):
        replace_with_retry(lambda: (_ for _ in ()).throw(PermissionError()), 2, 0)
    with pytest.raises(OSError):
        replace_with_retry(lambda: (_ for _ in ()).throw(OSError("other")), 5, 0)


def test_env_file_is_found_upwards(tmp_path):
    deep = tmp_path / "a" / "b"
    deep.mkdir(parents=True)
    (tmp_path / ".env.probe").write_text("LOOMGRAPH_RETRIEVAL_HOPS=5\n# x\nLOOMGRAPH_CODE_LANGUAGES=[\"java\"]\n")
    assert find_env_file(".env.probe", str(deep)) == str(tmp_path / ".env.probe") and find_env_file(".env.nowhere", str(deep)) is None
    got = Settings.from_env({}, str(tmp_path / ".env.probe"))
    assert got.retrieval_hops == 5 and got.code_languages == ("java",)


class Answer(io.BytesIO):
    def __enter__(self):
        return self


@pytest.mark.parametrize("provider", ["openai", "anthropic", "ollama"])
def test_http_clients(monkeypatch, provider):
    sent, replies = [], []

    def urlopen(request, timeout):
        sent.append((request.full_url, json.loads(request.data), dict(request.header_items())))
        got = replies.pop(0)
        if isinstance(got, Exception):
            raise got
        return Answer(json.dumps(got).encode())

    monkeypatch.setattr(clients.urllib.request, "urlopen", urlopen)
    monkeypatch.setattr(clients.time, "sleep", lambda s: sent.append(s))
    c = HttpClient(provider, "m", "key", None, retries=1, batch=2, faults=1)
    limited, broken = (urllib.error.HTTPError("u", code, "x", {}, None) for code in (429, 503))
    said = {"openai": {"choices": [{"message": {"content": "hi"}}]}, "anthropic": {"content": [{"type": "text", "text": "hi"}]}, "ollama": {"message": {"content": "hi"}}}[provider]
    replies += [limited, broken, said]
    assert c.complete("s", "u", "text") == "hi" and [x for x in sent if isinstance(x, float)] == [10.0, 1.0]
    if provider == "anthropic":
        replies.append({"content": [{"type": "tool_use", "input": {"a": 1}}]})
        assert json.loads(c.complete("s", "u")) == {"a": 1} and sent[-1][2]["X-api-key"] == "key"
    for wrong in (urllib.error.HTTPError("u", 401, "x", {}, None), urllib.error.URLError("gone")):
        replies += [wrong, wrong]
        with pytest.raises(urllib.error.URLError):
            c.complete("s", "u")
        replies.clear()
    if provider == "ollama":
        replies += [{"embedding": [1.0]}, {"embedding": [2.0]}, {"embedding": [3.0]}]
    else:
        replies += [{"data": [{"index": 1, "embedding": [2.0]}, {"index": 0, "embedding": [1.0]}]}, {"data": [{"index": 0, "embedding": [3.0]}]}]
    assert c.embed(["a", "b", "c"]) == [[1.0], [2.0], [3.0]]
    assert c.count_tokens("some words here") > 0


def test_counts_of_tokens_by_a_file_of_ranks(tmp_path):
    import base64

    path = tmp_path / "ranks"
    path.write_bytes(b"\n".join(base64.b64encode(bytes([i])) + b" %d" % i for i in range(256)) + b"\n" + base64.b64encode(b"ab") + b" 256\n")
    assert clients.count_tokens("abab c", path=str(path)) == 4 and RankTokenizer(str(path)).decode(RankTokenizer(str(path)).encode("abab c")) == "abab c"


def test_chunks_of_a_task_are_asked_at_the_same_time(spark):
    client = Slow()
    text = "Pump uses Valve."
    for most, concurrency in ((1, 1), (4, 4)):
        Slow.most = 0
        chunks = spark.createDataFrame([(f"f{i % 2}", i, text) for i in range(8)], "source_file string, index int, text string").coalesce(1)
        got = {r["source_file"]: [t["chunk_index"] for t in r["triples"]] for r in semantic_track(chunks, client, concurrency=concurrency).collect()}
        assert got == {"f0": [0, 2, 4, 6], "f1": [1, 3, 5, 7]}
    began = time.time()
    rows = spark.createDataFrame([(f"t{i}",) for i in range(16)], "text string").coalesce(1)
    made, _ = vectors.embed_texts(rows, lambda x: time.sleep(0.05) or OfflineClient().embed(x), "m", 64, None, 1, 8)
    assert made.count() == 16 and time.time() - began < 60


def test_table_store_and_repeated_ids(spark):
    new = spark.createDataFrame([("f::a", "f", "a", "x", [1.0]), ("f::a", "f", "a", "y", [2.0]), ("g::b", "g", "b", "z", [3.0])], "id string, source_file string, node string, document string, embedding array<float>")
    store = vectors.TableStore(vectors.upsert(vectors.empty(spark), new))
    assert sorted((r["id"], r["document"]) for r in store.vectors.collect()) == [("f::a", "y"), ("g::b", "z")]
    store.delete_by_source(spark.createDataFrame([("f",)], "source_file string"))
    nodes = spark.createDataFrame([("g", "b", "new"), ("g", "c", " ")], "source_file string, node string, description string")
    store.index_nodes(nodes, spark.createDataFrame([("new", [4.0])], "text string, embedding array<float>"))
    assert [(r["id"], r["document"]) for r in store.vectors.collect()] == [("g::b", "new")]


def test_lenient_json():
    assert parse_json_loose('so: {"a": {"b": "}"}} and {"c": 1}') == {"a": {"b": "}"}} and parse_json_loose("[1]") is None
    assert parse_json_loose('x {"a": 1') is None and parse_json_loose("") is None and parse_json_loose("no") is None and parse_json_loose("{} {") == {}


def test_docx_paragraphs():
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        z.writestr("word/document.xml", "<w:body><w:p><w:r><w:t>One &amp; </w:t><w:t xml:space='preserve'>two</w:t></w:r></w:p><w:p></w:p><w:p a='b'><w:t>&lt;3&gt;</w:t></w:p></w:body>")
    assert docx_text(held.getvalue()) == "One & two\n\n<3>"


def test_work_folder_is_removed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "shared_dir", lambda spark: f"file://{tmp_path}")
    session.materialise(spark.range(3).withColumn("x", F.lit(1)), "t")
    assert any(tmp_path.iterdir())
    session.clean(spark)
    assert not any(tmp_path.iterdir())


class Outage(OfflineClient):
    """A model that is not there, until it is."""

    def __init__(self, flag) -> None:
        super().__init__(64)
        self.flag = str(flag)

    def complete(self, *args, **how) -> str:
        if not os.path.exists(self.flag):
            raise ConnectionError("no model")
        return super().complete(*args, **how)


def test_a_build_during_an_outage_is_tried_again(spark, tmp_path):
    raw, flag = tmp_path / "raw", tmp_path / "up"
    raw.mkdir()
    (raw / "a.md").write_text("Mortar uses Lime.")
    s = Settings(raw_dir=str(raw), out_dir=str(tmp_path / "out"))
    compile_base(spark, s, client=Outage(flag))
    store = Store(spark, s.out_dir)
    assert [r["relation"] for r in store.read("edges").collect()] == ["extraction_failed"] and store.read("manifest").isEmpty()
    flag.touch()
    again = compile_base(spark, s, client=Outage(flag))
    assert again.extracted == 1 and [r["relation"] for r in store.read("edges").collect()] == ["uses"] and store.read("manifest").count() == 1
    replay(spark, s)
    assert [r["relation"] for r in store.read("edges").collect()] == ["uses"]


def test_the_log_is_part_of_the_version(spark, tmp_path, monkeypatch):
    """A crash at the commit leaves neither graph nor log of that build; the next one has both."""
    raw = tmp_path / "raw"
    raw.mkdir()
    (raw / "a.md").write_text("Mortar uses Lime.")
    s = Settings(raw_dir=str(raw), out_dir=str(tmp_path / "out"))
    compile_base(spark, s)
    (raw / "b.md").write_text("Roof has Tiles.")

    def crash(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m, pytest.raises(KeyboardInterrupt):
        m.setattr(Store, "_publish", crash)
        compile_base(spark, s)
    store = Store(spark, s.out_dir)
    heads = lambda: sorted(r["head"] for r in store.read("edges").collect())
    assert store.version == 1 and heads() == ["Mortar"] and {r["source_file"] for r in store.read_log().collect()} == {"a.md"}
    assert compile_base(spark, s).version == 2 and heads() == ["Mortar", "Roof"]
    replay(spark, s)
    assert heads() == ["Mortar", "Roof"] and store.version == 3


def test_of_two_builds_on_one_version_one_commits(spark, tmp_path):
    raw = tmp_path / "raw"
    raw.mkdir()
    (raw / "a.md").write_text("Mortar uses Lime.")
    s = Settings(raw_dir=str(raw), out_dir=str(tmp_path / "out"))
    compile_base(spark, s)
    slow = Store(spark, s.out_dir)
    slow.pin()
    old = {name: slow.read(name) for name in TABLES}
    (raw / "b.md").write_text("Roof has Tiles.")
    compile_base(spark, s)
    assert slow.read("edges").count() == 1  # it still reads what it has begun with
    with pytest.raises(ConcurrentBuildError):
        slow.write(old)
    store = Store(spark, s.out_dir)
    assert store.version == 2 and store.read("edges").count() == 2 and len([p for p in (tmp_path / "out").iterdir() if p.name.startswith("v=2-")]) == 1


def test_another_dimension_embeds_all_sources(spark, tmp_path):
    raw = tmp_path / "raw"
    raw.mkdir()
    (raw / "a.md").write_text("Mortar uses Lime.")
    s = Settings(raw_dir=str(raw), out_dir=str(tmp_path / "out"))
    compile_base(spark, s, embedder=OfflineClient(8))
    (raw / "b.md").write_text("Roof has Tiles.")
    compile_base(spark, s, embedder=OfflineClient(16))
    rows = Store(spark, s.out_dir).read("vectors").collect()
    assert {len(r["embedding"]) for r in rows} == {16} and {r["source_file"] for r in rows} == {"a.md", "b.md"}


def test_windows_of_any_script(spark):
    chinese = "".join(chr(0x4E00 + i * 7919 % 20000) for i in range(100_000))
    rows = [("c", chinese), ("w", "x" * 100_000), ("m", "  ab 日本\u3000語 cd"), ("e", " \u3000 "), ("n", None), ("t", "tail  \n")]
    files = spark.createDataFrame(rows, "source_file string, text string")
    got = [r for r in chunk_segments(files, 3000, 200).collect()]
    own = sorted((r for r in got if r["source_file"] == "c"), key=lambda r: r["index"])
    assert len(own) == 36 and all(r["text"] == chinese[r["start"] : r["start"] + r["token_count"]] for r in own)
    assert {r["start"] for r in own} == set(range(0, 2800 * 36, 2800)) and max(r["token_count"] for r in got) <= 3000
    assert sum(r["source_file"] == "w" for r in got) == 2  # a word of 100,000 letters is 3125 segments
    assert [r["text"] for r in got if r["source_file"] in "ment"] == ["  ab 日本\u3000語 cd", "tail  \n"]
    small = sorted(((r["index"], r["text"], r["start"]) for r in chunk_segments(files.filter("length(text) < 100"), 2, 1).collect() if r["source_file"] == "m"))
    assert small == [(0, "ab 日", 2), (1, "日本", 5), (2, "本\u3000語", 6), (3, "語 cd", 8)]


def test_builds_cut_by_the_ranks_that_settings_name(spark, tmp_path):
    ranks = "/opt/tokenizers/byte_bpe_50k.tiktoken"
    text = "日本語の文章 " * 400
    files = spark.createDataFrame([("a", text)], "source_file string, text string")
    parts = [r["text"] for r in chunk_tokens(files, 50, 0, RankTokenizer(ranks)).collect()]
    assert len(parts) > 20 and "\ufffd" not in "".join(parts) and "".join(parts).replace(" ", "") == text.replace(" ", "")
    raw = tmp_path / "raw"
    raw.mkdir()
    (raw / "a.md").write_text("Mortar uses Lime. " * 60)
    s = Settings(raw_dir=str(raw), out_dir=str(tmp_path / "out"), token_ranks=ranks, chunk_max_tokens=40, chunk_overlap_tokens=0)
    compile_base(spark, s)
    assert Store(spark, s.out_dir).read("edges").agg({"chunk_index": "max"}).first()[0] > 3
