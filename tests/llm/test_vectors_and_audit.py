"""Operators 11 to 13: brute force on small tables, odd inputs, hot cells in parts and lanes."""

import collections
import hashlib
import itertools
import math
import re

import numpy as np
import pytest

from loomgraph.llm import centroids, filter_audit, vector_dedup

VECTORS = "vec_id long, embedding array<float>, label int, id string, uid long, q binary, node binary, n double, cluster int, cell string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", 2, b"q", b"n", 0.5, 9, "c") for i, v in rows], VECTORS)


def some_vectors(n=400, dims=64, seed=5):
    """Random ones, groups of near copies around the threshold, a third of all rows equal, and useless ones."""
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dims))
    for g in range(0, n // 2, 20):  # members at many distances from one another
        x[g : g + 20] = x[g] + rng.standard_normal((20, dims)) * np.linspace(0.02, 0.35, 20)[:, None]
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    rows = [(i, [float(v) for v in x[i]]) for i in range(n)]
    rows += [(n + i, rows[7][1]) for i in range(n // 2)]  # hot
    one = rows[0][1]
    rows += [(2000, None), (2001, []), (2002, [0.0] * dims), (2003, [*one[:-1], None]), (2004, [*one[:-1], math.nan]), (2005, [*one[:-1], math.inf]), (2006, one[:10]), (2007, one[:10]), (2008, one + one)]
    rows += [(2009, [v * 1e30 for v in one]), (2010, [v * 1e-30 for v in one]), (None, rows[n - 20][1]), (3, rows[3][1]), (3, rows[n - 30][1]), (None, [0.5] * dims)]
    return rows


def brute_links(rows):
    """Rows that can link, the cosine matrix and the components by repeated minimum."""
    fine = [(k, np.array(v, np.float32).astype(float)) for k, (_, v) in enumerate(rows) if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    linked = collections.defaultdict(set)
    for (a, x), (b, y) in itertools.combinations(fine, 2):
        if len(x) == len(y):
            x, y = x / abs(x).max(), y / abs(y).max()
            if float(x @ y) / math.sqrt(float(x @ x) * float(y @ y)) >= 0.95:
                linked[a].add(b)
                linked[b].add(a)
    comp = list(range(len(rows)))
    while True:
        after = [min([comp[k], *(comp[o] for o in linked[k])]) for k in range(len(rows))]
        if after == comp:
            break
        comp = after
    low = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            low[comp[k]] = min(low.get(comp[k], i), i)
    return sorted((repr(i), len(linked[k]), repr(low.get(comp[k])), i == low.get(comp[k])) for k, (i, _) in enumerate(rows))


@pytest.mark.parametrize(("members", "visitors", "cell", "recall"), [(2048, 16384, 256, 0.999), (16, 64, 8, 1.0), (5, 16, 40, 0.999)])
def test_embedding_links_against_brute_force(spark, monkeypatch, members, visitors, cell, recall):
    """One part a cell, and hot cells in many parts and lanes; the counts of links are exact either way."""
    for name, value in (("MEMBERS", members), ("VISITORS", visitors), ("CELL", cell), ("BLOCK", min(512, members))):
        monkeypatch.setattr(vector_dedup, name, value)
    rows = some_vectors()
    got = vector_dedup.embedding_groups(vectors(spark, rows), target_recall=recall).collect()
    assert sorted((repr(r["vec_id"]), r["n_links"], repr(r["component_id"]), r["kept"]) for r in got) == brute_links(rows)


def test_embedding_links_of_empty_and_useless_tables(spark):
    assert vector_dedup.embedding_groups(vectors(spark, [])).collect() == []
    got = vector_dedup.embedding_groups(vectors(spark, [(1, None), (1, [0.0, 0.0]), (None, [])])).collect()
    assert sorted((repr(r["vec_id"]), r["n_links"], repr(r["component_id"]), r["kept"]) for r in got) == [("1", 0, "1", True), ("1", 0, "1", True), ("None", 0, "None", True)]
    short = [(i, [float(i % 3 + 1), 1.0]) for i in range(9)] + [(9, [1.0])]  # of one component: an empty first half
    got = vector_dedup.embedding_groups(vectors(spark, short)).collect()
    assert sorted((repr(r["vec_id"]), r["n_links"], repr(r["component_id"]), r["kept"]) for r in got) == brute_links(short)


def test_multi_sequence_is_ascending_and_complete():
    rng = np.random.default_rng(3)
    a, b = sorted(rng.random(17).tolist()), sorted(rng.random(23).tolist())
    got = list(vector_dedup.multi_sequence(a, b, 0.9))
    sums = [a[i] + b[j] for i, j in got]
    assert sums == sorted(sums) and set(got) == {(i, j) for i in range(17) for j in range(23) if a[i] + b[j] <= 0.9}


def test_bounds_of_cells_hold():
    """No vector is nearer than the bound of its cell: the traversal of full recall loses nothing."""
    x = vector_dedup.unit(np.random.default_rng(4).standard_normal((600, 16)))
    index = vector_dedup.Index(x, 9, 0.95, 1.0)
    (i, a), (j, b) = index.bounds(x)
    far = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    assert (a[:, i] + b[:, j] <= far + 1e-9).all()


def brute_lloyd(rows, k=40, rounds=5):
    kept = [(i, [max(-(1 << 27), min(1 << 27, math.floor(256 * float(np.float32(x))))) for x in v]) for i, v in rows if v and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    packed = lambda q: b"".join(x.to_bytes(2 if all(-32768 <= y < 32768 for y in q) else 4, "little", signed=True) for x in q)
    first = sorted((hashlib.sha256(f"2:{'' if i is None else i}".encode()).hexdigest(), packed(q), q) for i, q in kept)
    own = [q for _, _, q in first[:k]]
    far = lambda q, c: sum((x - y) ** 2 for x, y in zip(q, c, strict=True))
    best = lambda q: min((far(q, c), n) for n, c in enumerate(own))
    for _ in range(rounds):
        to = [best(q)[1] for _, q in kept]
        own = [[sum(col) // len(mine) for col in zip(*mine, strict=True)] if (mine := [q for (_, q), t in zip(kept, to, strict=True) if t == n]) else c for n, c in enumerate(own)]
    end = [best(q) for _, q in kept]
    inertia = collections.Counter()
    for d, n in end:
        inertia[n] += d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in own]
    return sorted((repr(i), n, d, inertia[n], sum(inertia.values()), sha[n]) for (i, _), (d, n) in zip(kept, end, strict=True))


@pytest.mark.parametrize("big", [False, True])
def test_lloyd_against_brute_force(spark, big):
    """A hot vector, useless ones, ids that repeat; with and without components beyond what doubles multiply exactly."""
    rows = [(i, v) for i, v in some_vectors(150) if big or i not in (2009,)]
    rows += [(5000, [1e9] * 64), (5001, [-3e5] * 64)] if big else []
    got = centroids.cluster_vectors(vectors(spark, rows)).collect()
    assert sorted((repr(r["vec_id"]), r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], r["centroid_sha256"]) for r in got) == brute_lloyd(rows)


def test_lloyd_few_and_no_vectors(spark):
    assert centroids.cluster_vectors(vectors(spark, [])).collect() == []
    assert centroids.cluster_vectors(vectors(spark, [(1, None), (2, [1.0])])).collect() == []
    got = centroids.cluster_vectors(vectors(spark, [(1, [0.5] * 64), (1, [0.5] * 64), (2, [-0.5] * 64)])).collect()
    assert [r["distance"] for r in got] == [0, 0, 0] and len({tuple(r["centroid"]) for r in got}) == 2


def brute_audit(rows, labels):
    said = collections.defaultdict(lambda: (False, False))
    for i, quality, toxic in labels:
        if i is not None:
            said[i] = said[i][0] or quality == 1, said[i][1] or toxic == 1
    first = {}
    for i, text, _ in rows:
        if i is not None:
            first[text or ""] = min(first.get(text or "", i), i)
    out = collections.defaultdict(lambda: [0] * 6)
    seen = []
    for i, text, part in rows:
        x = text or ""
        words = re.findall("[^\x20\x09-\x0d]+", x)
        fails = {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", x)) > 10 * len(x), "D": bool(re.search("[#$%&*|]", x)), "E": i is not None and i > first[x]}
        seen.append((part or "", fails, *said[i]))
    shapley = collections.Counter()
    for order in map("".join, itertools.permutations("ABCDE")):
        for part, fails, good, toxic in seen:
            gone = False
            for step, f in enumerate(order, 1):
                row = out[part, order, step]
                here = fails[f] and not gone
                for k, on in enumerate((not fails[f] and not gone, here, fails[f] and gone, fails[f] and sum(fails.values()) == 1, here and good, here and toxic)):
                    row[k] += on
                shapley[part, f] += here
                gone = gone or fails[f]
    return sorted((part, order, step, *row, shapley[part, order[step - 1]]) for (part, order, step), row in out.items())


def test_audit_against_brute_force(spark):
    plain = " ".join(f"w{i}" for i in range(120))
    rows = [
        (1, plain, "en"), (2, plain, "en"), (2, plain, "en"), (None, plain, None), (3, None, None), (4, "", ""), (5, "A B C #", "de"), (6, "x " * 300, "de"),
        (7, "é è " * 200 + "　", "fr"), (8, plain.upper(), "en"), (8, plain + " 100%", "en"), (9, plain, "xx"), (None, None, "en"), (10, "long" + " tail" * 50_000, "en"),
    ]
    labels = [(1, 1, 0), (2, 1, 1), (2, 0, None), (8, None, 1), (None, 1, 1), (77, 1, 1), (6, 1, 0), (6, 1, 0)]
    docs = spark.createDataFrame([(*r, 5, "m", 1.5) for r in rows], "doc_id long, text string, lang string, mask int, part string, n double")
    said = spark.createDataFrame([(*r, "x", 3) for r in labels], "doc_id long, quality int, toxic int, id string, n int")
    got = filter_audit.audit(filter_audit.cells(filter_audit.failures(docs), said)).drop("filter").collect()
    names = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    assert sorted(tuple(r[n] for n in names) for r in got) == brute_audit(rows, labels)
    assert filter_audit.audit(filter_audit.cells(filter_audit.failures(docs.limit(0)), said)).collect() == []
    no_labels = filter_audit.audit(filter_audit.cells(filter_audit.failures(docs), said.limit(0))).agg({"good_lost": "max", "toxic_lost": "max"}).first()
    assert tuple(no_labels) == (0, 0)
