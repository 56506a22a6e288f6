"""The operators on texts, all oracles and the pipeline: brute force, exact round trips, oracles and odd inputs."""

import collections
import gzip
import hashlib
import math
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import arrays, bpe, cdc, chat_format, components, exact_dedup, media, mixing, near_dedup, quality, sharding, skew, substring_dedup, warc
from loomgraph.llm.catalog import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, uid long, th binary, key string, v int, n double, shard int"
LONG = " ".join(f"word{i % 977} and{i % 31}" for i in range(30_000))


def docs(spark, rows):
    full = [(i, t, lang, src, None, "x", 1, b"y", None, 3, 0.5, 9) for i, t, lang, src in rows]
    return spark.createDataFrame(full, SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows, clashing columns."""
    base = "The quick brown fox jumps over the lazy dog near the river bank while seven wise owls watch from above. " * 4
    rows = [
        (1, base, "en", "src0"), (2, base, "en", "src0"), (2, base, "en", "src0"), (3, None, None, None), (4, "", "en", "src1"), (None, base + "tail", "de", "src2"),
        (None, None, "fr", None), (5, LONG, "en", "src0"), (6, LONG + " end", "en", "src0"), (7, " \n\t ", "es", "src3"), (8, "one", "en", "src1"), (8, "two", "en", "src1"),
        (9, "é" * 500 + "日本 <|endoftext|> \u0085 x", "fr", "src2"), (10, "BM RIFF P5 GIF8 \x00 data", "en", "src1"),
    ]
    return docs(spark, rows)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def texts_of(frame):
    return [(r["doc_id"], r["text"]) for r in frame.collect()]


def values(frame, columns):
    frame = frame[columns].astype(object)
    return sorted(map(repr, frame.where(frame.notna(), None).values.tolist()))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_oracle(spark, name):
    c = duckdb.connect()
    for t in ("documents", "conversations", "labels", "embeddings"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want, got = c.sql(ORACLE[name]).df(), QUERIES[name](spark, SF).toPandas()
    assert sorted(want.columns) == sorted(got.columns) and values(got, sorted(got.columns)) == values(want, sorted(got.columns))


# 1 chat formatting


def test_chat_round_trip_and_mask(spark):
    rng, parts = random.Random(1), ["\\", "<turn>", "</turn>", "<turn", "\n", "l", "\\l", "<", "x", "\\\\", "### Assistant: ", "日"]
    text = lambda: "".join(rng.choice(parts) for _ in range(rng.randint(0, 9)))
    rows = [(c, t, rng.choice(["user", "assistant", text()]), text()) for c in range(60) for t in range(rng.randint(1, 5))]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat_format.format_chats(chat_format.linear_trees(turns))
    got = out.select("tree", chat_format.parse(F.col("text")).alias("t"), chat_format.masked(F.col("text"), F.col("loss_spans")).alias("m"), "text").collect()
    want = collections.defaultdict(list)
    for c, t, role, x in sorted(rows):
        want[f"k{c}"].append((role, x))
    for r in got:
        assert [tuple(x) for x in r["t"]] == want[r["tree"]]
        assert r["m"] == "".join(x for role, x in want[r["tree"]] if role == "assistant")
    assert len(got) == 60


def test_chat_branches_cycles_and_odd_rows(spark):
    m = "tree string, msg long, parent long, role string, text string, score double"
    tree = [("t", 1, None, "user", "q", 0.0), ("t", 2, 1, "assistant", "bad", 0.1), ("t", 3, 1, "assistant", "good", 0.9), ("t", 4, 3, "user", "more", 0.5), ("t", 4, 3, "user", "zz", 0.5), ("t", 5, 99, None, None, None), ("c", 1, 2, "user", "a", 1.0), ("c", 2, 1, "user", "b", 1.0)]
    out = chat_format.format_chats(spark.createDataFrame(tree, m), branches=2).orderBy("rank").collect()
    assert [(r["tree"], r["rank"], r["branch"], round(r["score"], 4)) for r in out] == [("t", 1, 4, 0.4667), ("t", 2, 2, 0.05)]
    assert out[0]["text"] == "<turn>user\nq</turn>\n<turn>assistant\ngood</turn>\n<turn>user\nmore</turn>\n"
    assert chat_format.format_chats(spark.createDataFrame([], m)).count() == 0
    deep = spark.createDataFrame([(None, t, None if t % 7 == 0 else "assistant", "x" * (t % 3)) for t in range(300)] + [(1, None, "user", None)], "conv_id long, turn long, role string, text string")
    got = {r["tree"]: r for r in chat_format.format_chats(chat_format.linear_trees(deep)).select("tree", F.size(chat_format.parse(F.col("text"))).alias("n")).collect()}
    assert got["null"]["n"] == 300 and got["k1"]["n"] == 1


def test_chat_ties_order_null_as_empty(spark):
    rows = [(1, 1, None, "b"), (1, 1, "", "a"), (1, 1, "", None), (2, 1, "user", LONG), (2, 2, "assistant", LONG)]
    turns = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "conv_id long, turn long, role string, text string, tree string, msg int, __n int")
    out = chat_format.format_chats(chat_format.linear_trees(turns)).select("tree", chat_format.parse(F.col("text")).alias("t"), chat_format.masked(F.col("text"), F.col("loss_spans")).alias("m")).collect()
    got = {r["tree"]: r for r in out}
    assert [tuple(x) for x in got["k1"]["t"]] == [("", ""), ("", "a"), ("", "b")]
    assert [tuple(x) for x in got["k2"]["t"]] == [("user", LONG), ("assistant", LONG)] and got["k2"]["m"] == LONG
    tree = spark.createDataFrame([("t", 1, None, "user", "q", None, 7, "x"), ("t", 2, 1, None, "a", 1.0, 7, "x")], "tree string, msg long, parent long, role string, text string, score double, n int, __n string")
    assert chat_format.format_chats(tree).first()["text"] == "<turn>user\nq</turn>\n<turn>\na</turn>\n"


# 2 byte-pair encoding


def test_bpe_equals_library(spark, odd, empty):
    path = bpe.vocabulary_path()
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(path)
    got = [tuple(r)[1:] for r in bpe.encode_documents(odd, path).collect()]
    want = []
    for _, t in texts_of(odd):
        ids = exact.encode(t or "", add_special_tokens=False).ids
        want.append((len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(exact.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(got) == sorted(want)
    assert bpe.encode_documents(empty, path).count() == 0
    back = bpe.decode_documents(bpe.encode_documents(odd, path, with_ids=True), path)
    assert sorted(r["decoded"] for r in back.collect()) == sorted(t or "" for _, t in texts_of(odd))
    engine, rng = bpe.Engine.of(path), random.Random(2)
    parts = ["a", " b", "  ", "\n", "'s", "é", "1", ",", "<|endoftext|>", " ", "日", " the", "😀", "\x1c", "zzzzzz"]
    for _ in range(3000):
        s = "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))
        ids = exact.encode(s, add_special_tokens=False).ids
        assert engine.encode(s) == ids and engine.decode(ids) == exact.decode(ids, skip_special_tokens=False)
        cut, joined = sorted(rng.randint(0, len(s)) for _ in range(2)), []
        for a, b in zip([0, *cut], [*cut, len(s)], strict=True):
            joined = engine.join(joined, engine.encode(s[a:b]))
        assert joined == ids


def test_bpe_hot_chunk_is_dealt_to_parts(spark, monkeypatch):
    monkeypatch.setattr(bpe, "USES_A_PART", 5)
    monkeypatch.setattr(skew, "ROWS", 4)
    rows = [(i, LONG[:20_000] + f" and {i}", "en", "s") for i in range(40)] + [(99, "alone", "en", "s")]
    path = bpe.vocabulary_path()
    got = {r["doc_id"]: r["decoded"] for r in bpe.decode_documents(bpe.encode_documents(docs(spark, rows), path, with_ids=True), path).collect()}
    assert got == {i: t for i, t, *_ in rows}
    engine = bpe.Engine.of(path)
    ids = {r["doc_id"]: r["ids_sha256"] for r in bpe.encode_documents(docs(spark, rows), path).collect()}
    assert ids == {i: hashlib.sha256(",".join(map(str, engine.exact.encode(t, add_special_tokens=False).ids)).encode()).hexdigest() for i, t, *_ in rows}


def long_texts():
    rng = random.Random(11)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randint(2, 9)))
    yield " ".join(word("абвгдежзийклмнопрст") for _ in range(90_000))
    yield "".join(chr(rng.randint(0x4E00, 0x9FA5)) for _ in range(340_000))
    yield "".join(rng.choice("abcdeéñ") for _ in range(900_000))


def test_bpe_joins_of_long_texts_encode_little_again(monkeypatch):
    """1 MB each of Cyrillic words, Chinese and one word: all joins together encode less than the text's length again."""
    engine = bpe.Engine.of(bpe.vocabulary_path())
    for text in long_texts():
        raw = text.encode()
        buf, parts, at = np.frombuffer(raw, np.uint8), [], 0
        for end in bpe._chunks(buf, np.array([0, len(buf)]))[0]:
            parts.append(engine.encode(raw[at:end].decode()))
            at = end
        want, again, encode = engine.encode(text), [], engine.encode
        monkeypatch.setattr(engine, "encode", lambda x, encode=encode, again=again: again.append(len(x.encode())) or encode(x))
        ids = []
        for part in parts:
            ids = engine.join(ids, part)
        monkeypatch.undo()
        assert ids == want and len(parts) > 500 and sum(again) < len(raw)


def test_bpe_shared_chunks_of_other_scripts(spark):
    rows = [(10 * k + i, text[:60_000] + f" {i}", "ru", "s") for k, text in enumerate(long_texts()) for i in range(3)]
    path = bpe.vocabulary_path()
    exact = bpe.Engine.of(path).exact
    got = {r["doc_id"]: r["ids_sha256"] for r in bpe.encode_documents(docs(spark, rows), path).collect()}
    assert got == {i: hashlib.sha256(",".join(map(str, exact.encode(t, add_special_tokens=False).ids)).encode()).hexdigest() for i, t, *_ in rows}


def test_bpe_of_a_whole_table_and_of_another_kind_of_vocabulary(spark, odd):
    from tokenizers import Tokenizer

    for name, table in (("byte_bpe_50k.json", spark.read.parquet("/root/testdata/sf0.01/documents.parquet")), ("word_bpe_49k.json", odd)):
        path = bpe.vocabulary_path(name)
        exact = Tokenizer.from_file(path)
        assert bpe.Engine.of(path).local == (name == "byte_bpe_50k.json")
        want = []
        for i, t in texts_of(table):
            ids = exact.encode(t or "", add_special_tokens=False).ids
            want.append((str(i), len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(exact.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
        assert sorted((str(r["doc_id"]), *tuple(r)[1:]) for r in bpe.encode_documents(table, path).collect()) == sorted(want)


# 3 quality


def test_quality_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = QUERIES["op3_quality"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").toPandas()
    good, bad = got[got.quality == 1].score.to_numpy(), got[got.quality == 0].score.to_numpy()
    assert (good[:, None] > bad[None, :]).mean() > 0.97 and (got.predicted == got.quality).mean() > 0.97


def dense_model(texts, y):
    """NB-SVM with dense matrices: ratios, unit rows, hinge loss by dual coordinate descent, logistic fit."""
    rows = []
    for t in texts:
        b = np.frombuffer(t.encode(), np.uint8)
        rows.append(set(quality.features(b, np.array([0, len(b)]))[1].tolist()))
    names = sorted(set().union(*rows))
    x = np.array([[n in r for n in names] for r in rows], float)
    held = np.arange(len(y)) % 5 == 4
    use = ~held
    d = 1 << quality.BITS
    counts = [1 + x[use & (y == c)].sum(axis=0) for c in (0, 1)]
    sums = [d + x[use & (y == c)].sum() for c in (0, 1)]
    ratio = np.log(counts[1] / sums[1]) - np.log(counts[0] / sums[0])
    ratio[names.index(0)] = 1.0
    z = x * ratio
    z /= np.sqrt((z**2).sum(axis=1, keepdims=True))
    sign, zu = np.where(y[use] > 0, 1.0, -1.0), z[use]
    alpha, rng = np.zeros(use.sum()), np.random.default_rng(5)
    for _ in range(12):
        before = alpha.copy()
        for i in rng.permutation(len(alpha)):
            alpha[i] = np.clip(alpha[i] - (sign[i] * (zu[i] @ (zu.T @ (alpha * sign))) - 1), 0, 1)
        if abs(alpha - before).max() < 1e-3:
            break
    w = zu.T @ (alpha * sign)
    return dict(zip(names, zip(ratio, w * ratio, strict=True), strict=True)), quality.logistic_fit(z[held] @ w, y[held])


def test_quality_scores_against_dense_brute_force(spark):
    text = lambda i: f"word{i % 7} and more {i % 3} words, plainly." if i % 3 else f"JUNK {i % 5} !!! $$$ {'#' * (i % 4)}"
    rows = [(i, text(i), "en", "s") for i in range(80)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0 and i % 11 > 0)) for i in range(80)], "doc_id long, quality int")
    frame = docs(spark, rows + [(100, None, "en", "s"), (101, "words of JUNK, more!", "de", "t")])
    rank = labels.select("doc_id", "quality", F.xxhash64(F.lit(29), F.col("doc_id").cast("string")).alias("rank")).collect()
    train = sorted((r["rank"], r["quality"], text(r["doc_id"])) for r in rank if zlib.crc32(str(r["doc_id"]).encode()) % 5)
    weight, (a, b) = dense_model([t for *_, t in train], np.array([q for _, q, _ in train]))
    for r in quality.score(frame, quality.train(frame, labels)).join(frame, "doc_id").collect():
        raw = np.frombuffer((r["text"] or "").encode(), np.uint8)
        own = [weight.get(f) for f in quality.features(raw, np.array([0, len(raw)]))[1].tolist()]
        if None not in own:
            margin = sum(w for _, w in own) / math.sqrt(sum(q * q for q, _ in own))
            assert r["score"] == pytest.approx(1 / (1 + math.exp(-(a * margin + b))), abs=1e-4)


def test_quality_repeated_rows_train_once(spark):
    text = lambda i: f"word{i} and more {i % 3} words" if i % 2 else f"JUNK {i} !!! $$$"
    rows = [(i, text(i), "en", "s") for i in range(60)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    once, often = quality.train(docs(spark, rows), labels), quality.train(docs(spark, rows + rows[:1] * 50), labels)
    assert np.array_equal(once.weight, often.weight) and (once.a, once.b) == (often.a, often.b)


def test_keep_rows_leaves_one_of_repeated_rows(spark):
    rows = [(1, "a", "en", "s")] * 40 + [(None, None, None, None)] * 40 + [(2, "b", "en", "s"), (3, "b", "en", "s")]
    got = exact_dedup.exact_dedup(docs(spark, rows)).select("doc_id", "text").collect()
    assert sorted(map(repr, map(tuple, got))) == ["(1, 'a')", "(3, 'b')", "(None, None)"]


def test_quality_odd_inputs(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (5, 0), (None, 1), (8, None)], "doc_id long, quality int")
    model = quality.train(odd, labels)
    scored = quality.score(odd, model)
    assert scored.count() == odd.count() and scored.filter("score is null or score < 0 or score > 1").count() == 0
    assert scored.filter("doc_id in (1, 2)").select(F.round("score", 12)).distinct().count() == 1
    assert quality.good_documents(odd, model, 0.0).columns == odd.columns and quality.score(empty, model).count() == 0
    none = quality.train(odd, labels.limit(0))
    assert {r["score"] for r in quality.score(odd, none).collect()} == {0.5}
    one = quality.train(odd, labels.filter("doc_id = 1"))
    assert min(r["score"] for r in quality.score(odd, one).collect()) > 0.99
    text, feature = quality.features(np.zeros(0, np.uint8), np.array([0, 0, 0]))
    assert text.tolist() == [0, 1] and feature.tolist() == [0, 0]


# 4 WARC


def test_warc_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/ b", "<p>x</p>", 1), (2, None, "<p>x</p>", 2), (3, "u", None, 3), (4, "u", "", 4), (5, "é", LONG + "\r\n\r\nWARC/1.1", 5), (None, "u", "<p>x</p>", 6), (5, "u", "lone", 7)], "page_id long, url string, html string, payload int")
    whole = warc.write_archives(pages, f"file://{tmp_path}/w")
    members = warc.normalise(whole)
    rows = warc.read_archives(members).collect()
    kinds = collections.Counter((r["record_id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in rows)
    html = len(LONG) + 12
    assert kinds == {("<urn:page:1>", "revisit", "<urn:page:2>", 8): 1, ("<urn:page:2>", "response", None, 8): 1, ("<urn:page:3>", "revisit", "<urn:page:4>", 0): 1, ("<urn:page:4>", "response", None, 0): 1, ("<urn:page:5>", "response", None, html): 1, ("<urn:page:>", "revisit", "<urn:page:2>", 8): 1, ("<urn:page:5>", "response", None, 4): 1}
    for a, b in zip(sorted(r["path"] for r in whole.collect()), sorted(r["path"] for r in members.collect()), strict=True):
        assert gzip.open(a.removeprefix("file://")).read() == gzip.open(b.removeprefix("file://")).read()
    assert warc.read_archives(warc.normalise(warc.write_archives(pages.limit(0), f"file://{tmp_path}/e"))).count() == 0
    broken = tmp_path / "broken.warc.gz"
    broken.write_bytes(gzip.compress(warc.record(1, "u", b"abc", None, False, "d"))[:-20])
    with pytest.raises((ValueError, zlib.error)):
        warc.normalise_file(f"file://{broken}", f"file://{tmp_path}/o.gz")


def test_warc_query_against_brute_force(spark):
    pages = [(r["page_id"], (r["html"] or "").encode()) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    last = {}
    for i, p in pages:
        last[p] = max(last.get(p, i), i)
    want = sorted((i, len(p), warc.digest(p), "response" if last[p] == i else "revisit", None if last[p] == i else last[p]) for i, p in pages)
    assert sorted(map(tuple, QUERIES["op4_warc"](spark, SF).collect())) == want


# 5 sharding


def test_sharding(spark, odd, empty):
    got = sharding.shard_documents(odd, [1.0] * 8).collect()
    want = sorted((str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in texts_of(odd))
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in got) == want
    for shard in range(8):
        slots = sorted(r["slot"] for r in got if r["shard"] == shard)
        assert slots == list(range(len(slots)))
    assert all(r["grown_shard"] in (r["shard"], 8) for r in got) and {r["law"] for r in got} == {"key"}
    assert sharding.shard_documents(empty, [1.0] * 8).count() == 0
    many = spark.range(20_000).select(sharding.rendezvous(F.col("id"), [1.0, 2.0, 0.0, 1.0]).alias("a"), sharding.rendezvous(F.col("id"), [1.0, 2.0, 0.0, 1.0, 4.0]).alias("b"))
    share = {r["a"]: r["count"] / 20_000 for r in many.groupBy("a").count().collect()}
    assert set(share) == {0, 1, 3} and abs(share[1] - 0.5) < 0.02 and many.filter("a != b and b != 4").count() == 0
    with pytest.raises(ValueError):
        sharding.rendezvous(F.col("id"), [0.0])


def spark_hash(seed, key, shard):
    """Spark's xxhash64 of (int, string, int): each value is hashed with the last hash as the seed, an int as four bytes."""
    import xxhash

    h = 42
    for part in (seed.to_bytes(4, "little"), key.encode(), shard.to_bytes(4, "little")):
        h = xxhash.xxh64_intdigest(part, h)
    return h


def test_sharding_query_against_brute_force(spark):
    def winner(key, weights):
        draws = [(w / -math.log(((spark_hash(17, f"k{key}", s) >> 11) + 0.5) * 2.0**-53), -s) for s, w in enumerate(weights)]
        return -max(draws)[1]

    got = QUERIES["op5_rendezvous_sharding"](spark, SF).collect()
    seen = {r["doc_id"]: r for r in got}
    assert len(seen) == len(got)
    for i, t in texts_of(spark.read.parquet(f"{SF}/documents.parquet")):
        b = (t or "").encode()
        r = seen.pop(i)
        assert (r["size"], r["text_crc32"], r["law"], r["shard"], r["grown_shard"]) == (len(b) + 1, zlib.crc32(b), "key", winner(i, [1.0] * 8), winner(i, [1.0] * 9))
    assert not seen
    for shard in range(8):
        slots = sorted(r["slot"] for r in got if r["shard"] == shard)
        assert slots == list(range(len(slots)))


# 6 repeated substrings


def brute_removed(texts, length):
    """Every window, once for each different text; hashes of windows are Python's own strings."""
    seen, copies = collections.Counter(), collections.Counter(texts)
    for t, n in copies.items():
        for i in range(len(t) - length + 1):
            seen[t[i : i + length]] += n
    known = {}
    for t in copies:
        gone, reach = np.zeros(len(t), bool), 0
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[max(i, reach) : i + length] = True
                reach = i + length
        kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
        known[t] = len(t), int(gone.sum()), int((gone & ~np.concatenate(([False], gone[:-1]))).sum()) if len(t) else 0, hashlib.sha256(kept).hexdigest()
    return [known[t] for t in texts]


def check_removed(frame, **how):
    got = sorted((r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in substring_dedup.remove_repeats(frame, **how).collect())
    assert got == sorted(brute_removed([(t or "").encode() for _, t in texts_of(frame)], how.get("length", 200)))


def test_substrings_random(spark, monkeypatch):
    rng = random.Random(4)
    pool = ["".join(rng.choice("ab c") for _ in range(rng.randint(5, 60))) for _ in range(12)]
    rows = [(i, "".join(rng.choice(pool) for _ in range(rng.randint(0, 6))) + "ab" * rng.randint(0, 30), "en", "s") for i in range(80)]
    check_removed(docs(spark, rows), length=40, gram=8)
    monkeypatch.setattr(substring_dedup, "HOT_RUNS", 2)  # split nearly every bucket
    monkeypatch.setattr(substring_dedup, "_FLUSH", 50)
    monkeypatch.setattr(skew, "ROWS", 3)  # and spread nearly every key
    check_removed(docs(spark, rows), length=40, gram=8)


def thue_morse(n, a="a", b="b"):
    s = a
    other = str.maketrans(a + b, b + a)
    while len(s) < n:
        s += s.translate(other)
    return s


def mirror_pairs():
    """u + t + v and u + t' + v, with t a Thue-Morse string and t' its complement, which collide under sums of powers modulo 2**64."""
    rng = random.Random(9)
    word = lambda n: "".join(rng.choice("cdefgh ") for _ in range(n))
    rows = []
    for i in range(30):
        u, v, t = word(rng.randint(0, 60)), word(rng.randint(0, 60)), thue_morse(1024 << i % 2)
        rows += [(2 * i, u + t + v, "en", "s"), (2 * i + 1, u + t.translate(str.maketrans("ab", "ba")) + v, "en", "s")]
    return rows


def test_substrings_of_strings_that_collide_under_power_sums(spark):
    check_removed(docs(spark, mirror_pairs()))


def test_refine_with_colliding_identifiers(monkeypatch):
    """Whatever the identifiers are worth, bytes decide."""
    monkeypatch.setattr(substring_dedup, "mix64", lambda x: x & np.uint64(0))
    rng = random.Random(3)
    text = ("".join(rng.choice("ab") for _ in range(300)) * 2 + "".join(rng.choice("ab") for _ in range(300))).encode()
    buf = np.frombuffer(text, np.uint8)
    start = np.arange(len(text) - 16 + 1)
    seen = collections.Counter(text[i : i + 16] for i in start)
    with monkeypatch.context() as m:
        m.setattr(substring_dedup, "doubled", lambda ids, have, width: np.zeros(max(0, len(ids) - (width - have)), np.uint64))
        assert substring_dedup.refine(buf, start, 16).tolist() == [seen[text[i : i + 16]] > 1 for i in start]


def test_substrings_query_and_odd(spark, odd, empty):
    check_removed(odd)
    assert substring_dedup.remove_repeats(empty).count() == 0
    check_removed(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("doc_id is not null"))


# 7 exact dedup


def test_exact_dedup(spark, odd, empty):
    got = exact_dedup.exact_groups(odd).collect()
    groups = collections.defaultdict(list)
    for i, t in texts_of(odd):
        groups[hashlib.sha256((t or "").encode()).hexdigest()].append(i)
    assert len(got) == odd.count()
    for sha, ids in groups.items():
        mine = [r for r in got if r["text_sha256"] == sha]
        best = max((i for i in ids if i is not None), default=None)
        assert {(r["keep_id"], r["group_size"]) for r in mine} == {(best, len(ids))}
        assert [r["doc_id"] for r in mine if r["kept"]] == [best]
    kept = exact_dedup.exact_dedup(odd)
    assert kept.columns == odd.columns and kept.count() == len(groups)
    assert exact_dedup.exact_groups(empty).count() == 0 and exact_dedup.exact_dedup(empty).count() == 0


def test_clashing_helper_names_are_kept(spark):
    rows = [(1, "a b c d e f", "en", "s", "k1", 1, 2, 3, 4, 5, 6), (2, "a b c d e f", "en", "s", "k2", 1, 2, 3, 4, 5, 6), (2, "a b c d e f", "en", "s", "k2", 1, 2, 3, 4, 5, 6), (3, None, None, None, None, 9, 9, 9, 9, 9, 9)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, __k string, __n int, __c int, __e int, __s int, __m int, `a.b` int")
    kept = exact_dedup.exact_dedup(frame)
    assert kept.columns == frame.columns and sorted(map(repr, map(tuple, kept.collect()))) == sorted(map(repr, (rows[2], rows[3])))
    near = near_dedup.near_dedup(frame)
    assert near.columns == frame.columns and {r["__k"] for r in near.collect()} == {"k2", None}
    mixed = mixing.mixed_documents(frame, budget=(2, 1))
    assert mixed.columns == frame.columns
    assert collections.Counter((r["doc_id"], r["__k"], r["__m"], r["a.b"]) for r in mixed.collect()) == {(1, "k1", 5, 6): 2, (2, "k2", 5, 6): 4}


def test_chunk_identifiers_split_on_disagreement(spark):
    rows = [("r1", [(b"d", b"1"), (b"e", b"1")]), ("r2", [(b"d", b"2"), (b"e", b"1")])]
    frame = spark.createDataFrame(rows, "rk string, recipe array<struct<d:binary,c:binary>>")
    ids = {(bytes(r["d"]), bytes(r["c"])): bytes(r["chunk_id"]) for r in exact_dedup.chunk_identifiers(frame).collect()}
    assert ids == {(b"d", b"1"): b"d1", (b"d", b"2"): b"d2", (b"e", b"1"): b"e"}


def test_chunk_cuts():
    rng = np.random.default_rng(5)
    text = rng.integers(97, 123, 60_000).astype(np.uint8)
    both = np.concatenate((text, text[100:]))
    a, b = cdc.cuts(both, np.array([0, len(text), len(both)]))
    assert a[-1] == len(text) and np.diff(np.concatenate(([0], a))).max() <= 8192
    assert len(set(a.tolist()) & set((b + 100).tolist())) > 0.8 * len(a)
    assert [x.tolist() for x in cdc.cuts(np.zeros(0, np.uint8), np.array([0, 0]))] == [[]]


# 8 mixing


def test_share_out_redistributes(spark):
    rows = [("p", "a", 1, 10, 100), ("p", "b", 1, 1000, 100), ("p", "c", 2, 1000, 100), ("q", "a", 1, 5, 3), ("z", "a", 1, 0, 0)]
    nodes = spark.createDataFrame(rows, "p string, c string, w long, cap long, budget long")
    got = {(r["p"], r["c"]): r["alloc"] for r in mixing.share_out(nodes, ["p"], "c").collect()}
    assert got == {("p", "a"): 10, ("p", "b"): 30, ("p", "c"): 60, ("q", "a"): 3, ("z", "a"): 0}


def test_mixing_odd_inputs(spark, odd, empty):
    got = mixing.mix(odd, budget=(1, 2)).collect()
    total = sum((len((t or "").encode()) + 3) // 4 for _, t in texts_of(odd))
    assert len(got) == odd.count() and sum(r["copies"] * r["n_tokens"] for r in got) <= total // 2
    assert {r["copies"] for r in mixing.mix(odd, budget=(2, 1)).collect() if r["n_tokens"]} == {2}
    assert mixing.mix(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0
    rows = mixing.mixed_documents(odd, budget=(2, 1))
    assert rows.columns == odd.columns and rows.filter("doc_id = 2").count() == 4
    zero = mixing.mix(odd, weights={"lang": {"en": 0}}).filter("lang = 'en'").agg(F.max("copies")).first()[0]
    assert zero == 0


# 9 media


def test_media_round_trip(spark, odd, empty):
    got = media.sniff_media(media.store_texts(odd)).collect()
    want = []
    for _, t in texts_of(odd):
        b = (t or "").encode()
        p = b + b"\xff" * (-len(b) % 576 if b else 576)
        want.append((len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:])))
    assert sorted((r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in got) == sorted(want)
    assert all(r["valid"] and r["trailing"] == 0 and not r["carved"] for r in got)
    assert media.sniff_media(media.store_texts(empty)).count() == 0


def test_media_query_against_brute_force(spark):
    """Bytes stored and the whole feature column, from the formats' public descriptions."""
    kinds = {"wav": "audio/wav", "png": "image/png", "bmp": "image/bmp", "pgm": "image/x-portable-graymap", "au": "audio/basic"}
    order, want = ["wav", "png", "bmp", "pgm", "au"], []
    for i, t in texts_of(spark.read.parquet(f"{SF}/documents.parquet")):
        b = (t or "").encode()
        p = b + b"\xff" * (-len(b) % 576 if b else 576)
        pick = hashlib.sha256(p).digest()
        blob, kind, told = media.encode(p, order[pick[0] % 5]), kinds[order[pick[0] % 5]], kinds[order[pick[1] % 5]]
        carved = sum(media.FORMATS[n][2](blob, at) is not None for n, (magic, _, _) in media.FORMATS.items() for at in range(1, len(blob)) if blob.startswith(magic, at))
        feature = [kind, "as declared" if kind == told else f"was {told}", pytest.approx(sum(p) / len(p), abs=1e-6), f"carved={carved}"]
        want.append((i, len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), len(blob), hashlib.sha256(blob).hexdigest(), feature))
    got = sorted(map(tuple, QUERIES["op9_media"](spark, SF).collect()))
    for row, expected in zip(got, sorted(want, key=lambda x: x[0]), strict=True):
        kind, told, mean, carved = row[-1].split(";")
        assert (*row[:-1], [kind, told, float(mean.removeprefix("mean=")), carved]) == expected


def test_media_sniffs_corrects_and_carves(spark):
    payload = bytes(range(256)) * 9
    files = {n: media.encode(payload, n) for n in ("wav", "png", "bmp", "pgm", "au")}
    gif = b"GIF89a\x01\0\x01\0\x80\0\0\0\0\0\xff\xff\xff,\0\0\0\0\x01\0\x01\0\0\x02\x02D\x01\0;"
    jpeg = b"\xff\xd8\xff\xe0\0\x04ab\xff\xda\0\x04cd12\xff\x00\xff\xd9"
    for name, blob in (*files.items(), ("gif", gif), ("jpeg", jpeg)):
        assert media.sniff(b"junk BM " + blob + b"more") == [(name, 8, len(blob))]
        assert media.sniff(blob[:-3]) == []
    for name, blob in files.items():
        assert media.decode(blob, name) == payload
    bad = bytearray(files["png"])
    bad[60] ^= 1
    assert media.sniff(bytes(bad)) == []
    rows = [(1, "image/png", files["wav"] + b"zz"), (2, "audio/wav", b"text BM no media"), (3, None, None), (4, "image/bmp", files["bmp"][:1078] + gif + files["bmp"][1078 + len(gif) :])]
    got = {r["id"]: r for r in media.sniff_media(spark.createDataFrame(rows, "id long, declared string, media binary")).collect()}
    assert (got[1]["media_type"], got[1]["corrected"], got[1]["trailing"]) == ("audio/wav", True, 2)
    assert (got[2]["media_type"], got[2]["valid"]) == ("audio/wav", False) and not got[3]["valid"]
    assert [tuple(x) for x in got[4]["carved"]] == [("image/gif", 1078, len(gif))]


# 10 near-duplicates


def profile(text):
    b = np.frombuffer((text or "").encode(), np.uint8)
    _, e, c = arrays.shingles(b, np.array([0, len(b)]))
    return e, near_dedup.weights(c)


def test_probability_jaccard():
    rng = np.random.default_rng(6)
    for _ in range(200):
        a, b = (dict(zip(rng.choice(12, 8, replace=False).tolist(), rng.integers(1, 4, 8).astype(float).tolist(), strict=True)) for _ in range(2))
        want = sum(1 / sum(max(a.get(j, 0) / a[i], b.get(j, 0) / b[i]) for j in a.keys() | b.keys()) for i in a.keys() & b.keys())
        pair = [(np.array(sorted(x), np.uint64), np.array([x[k] for k in sorted(x)])) for x in (a, b)]
        assert near_dedup.probability_jaccard(*pair) == pytest.approx(want)
    assert near_dedup.probability_jaccard((np.zeros(0, np.uint64), np.zeros(0)), pair[0]) == 0


def test_signature_estimates_similarity():
    rng = np.random.default_rng(7)
    common, own = rng.integers(1, 1 << 62, 300).astype(np.uint64), rng.integers(1, 1 << 62, (2, 100)).astype(np.uint64)
    sets = [np.sort(np.concatenate((common, x))) for x in own]
    weight = [np.ones(400), np.ones(400)]
    sig = near_dedup.prob_minhash(np.repeat([0, 1], 400), np.concatenate(sets), np.concatenate(weight), 2, 2000)
    want = near_dedup.probability_jaccard(*zip(sets, weight, strict=True))
    assert (sig > 0).all() and abs((sig[0] == sig[1]).mean() - want) < 0.04
    assert (near_dedup.prob_minhash(np.zeros(1, int), np.array([5], np.uint64), np.ones(1), 2, 50)[0] == 5).all()


def brute_groups(rows):
    prof = [profile(t) for _, t in rows]
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] or "") == (rows[j][1] or "") or near_dedup.probability_jaccard(prof[i], prof[j]) >= 0.8:
                up[top(i)] = top(j)
    groups = collections.defaultdict(list)
    for i, (k, _) in enumerate(rows):
        groups[top(i)].append(k)
    return collections.Counter(tuple(sorted(g, key=str)) for g in groups.values())


def check_groups(frame):
    got = near_dedup.near_groups(frame).collect()
    rows = texts_of(frame)
    assert len(got) == len(rows) and sum(r["kept"] for r in got) == sum(brute_groups(rows).values())
    if len({i for i, _ in rows}) == len(rows):
        found = collections.defaultdict(list)
        for r in got:
            found[r["group_id"]].append(r["doc_id"])
        assert collections.Counter(tuple(sorted(g, key=str)) for g in found.values()) == brute_groups(rows)


def test_near_groups(spark, odd, empty):
    check_groups(odd)
    check_groups(spark.read.parquet(f"{SF}/documents.parquet"))
    assert near_dedup.near_groups(empty).count() == 0
    kept = near_dedup.near_dedup(odd)
    assert kept.columns == odd.columns and kept.count() == sum(brute_groups(texts_of(odd)).values())


def test_near_groups_of_spread_copies(spark, monkeypatch):
    """A group whose members are as often below as above the threshold, in few rounds and in many."""
    rng = random.Random(8)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(90):
        words = list(base)
        for k in rng.sample(range(150), rng.randint(0, 6)):
            words[k] = rng.choice(["be", "of", "x1", "x2"])
        rows.append((i, " ".join(words), "en", "s"))
    check_groups(docs(spark, rows))
    monkeypatch.setattr(near_dedup, "LEADERS", 5)
    monkeypatch.setattr(near_dedup, "PAIRS_A_PART", 4)
    monkeypatch.setattr(near_dedup, "MEMBERS_A_PART", 7)
    monkeypatch.setattr(skew, "ROWS", 3)
    check_groups(docs(spark, rows))


def test_near_groups_tell_long_words_apart(spark):
    """Seven common words and one long word each, Thue-Morse strings and their complements: similarity 3 / 5."""
    rows = []
    for n in (512, 1024, 2048, 4096):
        t = thue_morse(n)
        rows += [(2 * n, f"{t} a b c d e f g", "en", "s"), (2 * n + 1, f"{t.translate(str.maketrans('ab', 'ba'))} a b c d e f g", "en", "s")]
    got = near_dedup.near_groups(docs(spark, rows)).collect()
    assert len(got) == 8 and {r["group_size"] for r in got} == {1}


def test_near_groups_compare_bytes_where_fingerprints_agree(spark):
    """Two words made to have one 64-bit fingerprint; the texts share no shingle."""
    pair = ["mfxuqjwwaaaaeaaa p q r s", "jashffmnhdblzkdb p q r s"]
    buf = np.frombuffer("".join(w.split()[0] for w in pair).encode(), np.uint8)
    assert len(set(arrays.fingerprints(buf, np.array([0, 16]), np.array([16, 32]), 7).tolist())) == 1
    got = near_dedup.near_groups(docs(spark, [(i, t, "en", "s") for i, t in enumerate(pair)])).collect()
    assert sorted((r["doc_id"], r["group_size"], r["kept"]) for r in got) == [(0, 1, True), (1, 1, True)]
    digests, count = arrays.exact_shingles(b"A b, c D e a B c d E a", 5)
    assert sorted(count.tolist()) == [1, 1, 1, 2, 2] and len(arrays.exact_shingles(b" .,! ")[0]) == 0 and len(arrays.exact_shingles(b"one Two")[0]) == 1
    assert near_dedup.exact_similarity(arrays.exact_shingles(b"a b c d e f"), arrays.exact_shingles(b"A B c d-e F")) == pytest.approx(1)


def test_near_groups_of_hot_texts(spark, monkeypatch):
    """A text that two thirds of all rows hold, and its near copies."""
    monkeypatch.setattr(skew, "ROWS", 5)
    base = " ".join(f"w{i}" for i in range(80))
    check_groups(docs(spark, [(i, base if i % 3 else f"{base} {i}", "en", "s") for i in range(120)]))


def test_join_counted_spreads_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(skew, "ROWS", 5)
    rows = spark.createDataFrame([(k, i) for i, k in enumerate(["hot"] * 60 + ["b", "c", None, "d"])], "k string, i long")
    right = spark.createDataFrame([("hot", 60, 1), ("b", 1, 2), ("x", 3, 3)], "k string, n long, w int")
    inner = skew.join_counted(rows, right, ["k"], ["i"], "n")
    assert sorted((r["k"], r["i"], r["w"]) for r in inner.collect()) == sorted([("hot", i, 1) for i in range(60)] + [("b", 60, 2)])
    left = skew.join_counted(rows, right, ["k"], ["i"], "n", "left")
    assert left.count() == 64 and left.filter("w is null").count() == 3
    assert skew.join_counted(rows.limit(0), right.limit(0), ["k"], ["i"], "n").count() == 0


def test_components(spark):
    links = [(f"n{i}", f"n{i + 1}") for i in range(40)] + [("a", "b"), ("c", "b"), ("z", "z")]
    got = {r["node"]: r["comp"] for r in components.components(spark.createDataFrame(links, "a string, b string")).collect()}
    assert len({v for k, v in got.items() if k[0] == "n"}) == 1 and got["c"] == got["b"] == "a" and got["z"] == "z"


# pipeline


def test_pipeline_of_odd_and_empty_tables(spark, odd, empty, tmp_path):
    import corpus_pipeline as p
    from loomgraph.session import materialise

    spark.createDataFrame([(1, 1, None), (2, 1, 0), (5, None, 1), (None, 0, 0), (7, 0, 0), (10, 0, 0), (6, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for frame in (odd, empty):
        at = frame
        for name, stage in p.STAGES:
            last, at = at, materialise(stage(spark, at, str(tmp_path)), name)
            if name == "encode":
                assert at.count() == last.count()
            else:
                assert at.columns == frame.columns and (name == "mix" or at.count() <= last.count())
        back = bpe.decode_documents(at, bpe.vocabulary_path()).select("doc_id", "decoded")
        want = collections.Counter((r["doc_id"], r["text"] or "") for r in last.collect())
        assert collections.Counter(map(tuple, back.collect())) == want
    model = quality.fit([], np.zeros(0, np.int64))
    assert quality.good_documents(odd, model, 0.5).count() == odd.count() and quality.good_documents(empty, model).count() == 0
    assert components.components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_pipeline_against_brute_force(spark):
    import corpus_pipeline as p
    from loomgraph.session import materialise

    frame = spark.read.parquet(f"{SF}/documents.parquet")
    seen = [frame]
    for name, stage in p.STAGES:
        seen.append(materialise(stage(spark, seen[-1], SF), name))
        if name != "encode":
            assert seen[-1].columns == frame.columns
    good, exact, near, mixed, encoded = seen[1:]
    model = quality.train(frame, spark.read.parquet(f"{SF}/labels.parquet"))
    fine = {r["doc_id"] for r in quality.score(frame, model).filter("score >= 0.3").collect()}
    assert {i for i, _ in texts_of(good)} == fine
    last = {}
    for i, t in texts_of(good):
        last[t] = max(last.get(t, i), i)
    assert {i for i, _ in texts_of(exact)} == set(last.values())
    assert {i for i, _ in texts_of(near)} == {max(g) for g in brute_groups(texts_of(exact))}
    want = collections.Counter({r["doc_id"]: r["copies"] for r in mixing.mix(near).collect() if r["copies"]})
    assert collections.Counter(i for i, _ in texts_of(mixed)) == want
    assert collections.Counter(r["doc_id"] for r in encoded.collect()) == want
    text = dict(texts_of(mixed))
    assert all(r["decoded_sha256"] == hashlib.sha256(text[r["doc_id"]].encode()).hexdigest() for r in encoded.collect())
