"""Communities by Leiden's steps: local moves of modularity, refinement inside communities, aggregation.

One rule at every size. In a round each node looks for the label among its neighbours' that gains most (ties by
a hash of the label); about half of the nodes may move, others each time, since moves made at once can undo each
other. A graph of up to ONE_TASK pairs is worked on in one task with arrays, a larger one by DataFrames; both
take the same decisions, so results don't depend on the size. Nodes move one by one, so a community can lose what held
it together: at the end each is split into its connected parts, which can only raise modularity. Numbers go by
size, largest first, then by the first member.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.extract.clients import LLMClient, ask_in_turns
from loomgraph.functions.text import community_summary, normalize_entity
from loomgraph.operators.graph import symmetrize, weighted_pairs
from loomgraph.session import materialise, numbered

SYSTEM = "You are given names of things that belong together. Say what unites them."

#: Pairs that one task holds as arrays, some 100 bytes each; it decides where the work is done, not the result.
ONE_TASK = 2_000_000
#: Nodes whose labels are sent to all tasks in each round, 16 bytes each; those of more nodes are joined by shuffles.
SENT_NODES = 2_000_000
#: Links that a task works on at a time, 24 bytes each; a node with more has them in one block.
BLOCK = 250_000
IDLE_ROUNDS, LEAST_GAIN = 4, 1e-9
_U = np.uint64


def modularity(links: dict[int, dict[int, float]], of: dict[int, int]) -> float:
    """Of an undirected weighted graph (a self-loop is listed once, with its weight)."""
    degree = {v: sum(w * (2 if u == v else 1) for u, w in near.items()) for v, near in links.items()}
    total = sum(degree.values())
    if not total:
        return 0.0
    inside, whole = dict.fromkeys(of.values(), 0.0), dict.fromkeys(of.values(), 0.0)
    for v, near in links.items():
        whole[of[v]] += degree[v]
        for u, w in near.items():
            if of[u] == of[v]:
                inside[of[v]] += w * (2 if u == v else 1)
    return sum(inside[c] / total - (whole[c] / total) ** 2 for c in whole)


def hash_long(x: np.ndarray, seed: np.ndarray | int = 42) -> np.ndarray:
    """XXH64 of 8-byte numbers, signed: what Spark's xxhash64 gives (fixed values: its five primes and its rotations)."""
    p1, p2, p3, p4, p5 = map(_U, (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))

    def rotate(v: np.ndarray, by: int) -> np.ndarray:
        return (v << _U(by)) | (v >> _U(64 - by))

    x = np.asarray(x, np.int64).view(_U)
    h = np.asarray(seed, np.int64).view(_U) + p5 + _U(8)
    h = h ^ (rotate(x * p2, 31) * p1)
    h = rotate(h, 27) * p1 + p4
    h = (h ^ (h >> _U(33))) * p2
    h = (h ^ (h >> _U(29))) * p3
    return (h ^ (h >> _U(32))).view(np.int64)


# one task


def _sums(key: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, sorted, and the sum of the weights of each."""
    bits = int(w.max()).bit_length() if len(w) else 0
    if (w == np.floor(w)).all() and int(key.max()).bit_length() + bits < 63:
        both = np.sort((key << bits) | w.astype(np.int64))  # sorting values is many times faster than an order
        key, w = both >> bits, (both & ((1 << bits) - 1)).astype(float)
    else:
        order = np.argsort(key)
        key, w = key[order], w[order]
    first = np.concatenate(([0], np.flatnonzero(key[1:] != key[:-1]) + 1))
    return key[first], np.add.reduceat(w, first)


def _largest(x: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Where x is the largest of its group; groups lie together."""
    first = np.concatenate(([0], np.flatnonzero(group[1:] != group[:-1]) + 1))
    return np.flatnonzero(x == np.repeat(np.maximum.reduceat(x, first), np.diff(np.concatenate((first, [len(x)])))))


def _moves(at: np.ndarray, b: np.ndarray, w: np.ndarray, own: np.ndarray, degree: np.ndarray, total: float, label: np.ndarray, mass: np.ndarray, mark: int) -> tuple[float, bool, np.ndarray, np.ndarray]:
    """What a round does with nodes own of these degrees: the weight inside labels, whether any node wants to move, those that do and where to.

    Links (own[at], b, w) are all links of these nodes; each has one of weight 0 to itself.
    """
    n = len(label)
    key, weight = _sums(at * n + label[b], w)
    node, to = key // n, key % n
    stays = to == label[own][node]
    gain = weight - degree[node] * (mass[to] - np.where(stays, degree[node], 0.0)) / total
    best = _largest(gain, node)  # keys are sorted, and each node has one
    last = best[_largest(hash_long(to[best]), node[best])]  # no two labels have one hash
    wants = gain[last] > gain[stays] + LEAST_GAIN
    turn = (hash_long(np.full(len(own), mark), hash_long(own)) & 1) == 0
    return float(weight[stays].sum()), bool(wants.any()), own[turn & wants], to[last][turn & wants]


def _rounds(step: Callable[[np.ndarray, np.ndarray, int], tuple], label: np.ndarray, degree: np.ndarray, total: float, loops: float, seed: int) -> tuple[np.ndarray, float]:
    """The best labels that rounds of moves reach, and their modularity; step is _moves of all nodes."""
    best, most, idle, k = label, -np.inf, 0, 0
    while True:
        mass = np.bincount(label, degree, len(label))
        inside, wants, node, to = step(label, mass, k + seed)
        q = (inside + loops) / total - float((mass / total) @ (mass / total))
        if q > most + LEAST_GAIN:
            best, most, idle = label, q, 0
        else:
            idle += 1
        if not wants or idle == IDLE_ROUNDS:
            return best, most
        label = label.copy()
        label[node] = to
        k += 1


def _settle_arrays(a: np.ndarray, b: np.ndarray, w: np.ndarray, label: np.ndarray, degree: np.ndarray, total: float, loops: float, seed: int) -> tuple[np.ndarray, float]:
    """The best labels that rounds of moves over links (a, b, w) reach, and their modularity."""
    own = np.arange(len(label))
    links = np.concatenate((a, own)), np.concatenate((b, own)), np.concatenate((w, np.zeros(len(own))))
    return _rounds(lambda *state: _moves(*links, own, degree, total, *state), label, degree, total, loops, seed)


def _parts_arrays(x: np.ndarray, y: np.ndarray, label: np.ndarray) -> np.ndarray:
    """The smallest node that each node reaches by links (x, y) inside its own label."""
    same = label[x] == label[y]
    x, y, low = x[same], y[same], np.arange(len(label))
    while True:
        to = low.copy()
        np.minimum.at(to, low[x], low[y])
        np.minimum.at(to, low[y], low[x])
        while (to[to] != to).any():
            to = to[to]
        if (to == low).all():
            return low
        low = to[low]


def leiden_arrays(a: np.ndarray, b: np.ndarray, w: np.ndarray, n: int, seed: int = 42) -> np.ndarray:
    """The label of each of n nodes; pairs (a, b, w) are undirected, each once."""
    other = a != b
    a, b, w = np.concatenate((a, b[other])), np.concatenate((b, a[other])), np.concatenate((np.where(other, w, 2 * w), w[other])).astype(float)
    total = w.sum()
    if not total:
        return np.zeros(n, np.int64)
    return _parts_arrays(a, b, _levels_arrays(a, b, w, np.arange(n), total, -np.inf, seed))


def _levels_arrays(a: np.ndarray, b: np.ndarray, w: np.ndarray, label: np.ndarray, total: float, reached: float, seed: int) -> np.ndarray:
    """The labels that all levels reach from these, which have modularity `reached`; links (a, b, w) go both ways, self-loops once, doubled."""
    top = np.arange(len(label))
    while True:
        size = len(label)
        degree, loop = np.bincount(a, w, size), a == b
        x, y, v = a[~loop], b[~loop], w[~loop]
        found, q = _settle_arrays(x, y, v, label, degree, total, w[loop].sum(), seed)
        if q <= reached + LEAST_GAIN:
            return label[top]
        reached, label = q, found
        same = label[x] == label[y]
        fine, _ = _settle_arrays(x[same], y[same], v[same], np.arange(size), degree, total, w[loop].sum(), seed)
        if len(np.unique(fine)) == size:
            fine = label
        names, place = np.unique(fine, return_inverse=True)
        # a part is named by its label, and its community by the part of the same name or else by a number beyond
        own, community = np.unique(label, return_inverse=True)
        of = np.zeros(len(names), np.int64)
        of[place] = community
        first = np.full(len(own), len(names))
        np.minimum.at(first, of, np.arange(len(names)))
        key, w = _sums(place[a] * len(names) + place[b], w)
        a, b, top, label = key // len(names), key % len(names), place[top], first[of]


def leiden(a: np.ndarray, b: np.ndarray, weight: np.ndarray, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """(names, numbers) of all ends of named pairs; a pair of weight 0 only names its ends. Names are in byte order."""
    ends = sorted(set(a) | set(b), key=lambda x: x.encode())
    place = {x: i for i, x in enumerate(ends)}
    x, y = (np.array([place[v] for v in side], np.int64) for side in (a, b))
    w = np.asarray(weight, float)
    return np.array(ends, object), rank_labels(leiden_arrays(x[w > 0], y[w > 0], w[w > 0], len(ends), seed))


def _leiden_task(seed: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        whole = pd.concat(list(frames) or [pd.DataFrame({"a": [], "b": [], "weight": []})])
        names, number = leiden(whole["a"].to_numpy(object), whole["b"].to_numpy(object), whole["weight"].to_numpy(), seed)
        yield pd.DataFrame({"node": names, "id": number}).astype({"id": "int32"})

    return run


def rank_labels(label: np.ndarray) -> np.ndarray:
    """Numbers by size, largest first, then by the first member."""
    _, first, at, size = np.unique(label, return_index=True, return_inverse=True, return_counts=True)
    rank = np.empty(len(first), np.int64)
    rank[np.lexsort((first, -size))] = np.arange(len(first))
    return rank[at]


# DataFrames


def _blocks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Arrays of whole nodes with all their links, some BLOCK links a row, of links (a, b, w) that are sorted by a.

    A link of a node to itself brings the node's degree as its weight.
    """

    def packed(block: pd.DataFrame) -> pd.DataFrame:
        own, at = np.unique(block["a"].to_numpy(np.int64), return_inverse=True)
        b, w = block["b"].to_numpy(np.int64), block["w"].to_numpy(float)
        itself = own[at] == b
        columns = {"own": own, "degree": w[itself], "at": at.astype(np.int64), "b": b, "w": np.where(itself, 0.0, w)}
        return pd.DataFrame({name: [x.tobytes()] for name, x in columns.items()})

    rest, size, most = [], 0, BLOCK
    for frame in frames:
        rest.append(frame)
        size += len(frame)
        if size >= most:
            whole = pd.concat(rest)
            last = (whole["a"] == whole["a"].iloc[-1]).to_numpy()
            if not last.all():
                yield packed(whole[~last])
            rest, size = [whole[last]], int(last.sum())
            most = max(BLOCK, 2 * size)
    if size:
        yield packed(pd.concat(rest))


def _unpacked(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, ...]]:
    for frame in frames:
        for row in frame.itertuples(index=False):
            yield tuple(np.frombuffer(x, float if name in ("degree", "w") else np.int64) for name, x in zip(frame.columns, row, strict=True))


def _settle(links: DataFrame, label: DataFrame, total: float, loops: float, seed: int) -> tuple[DataFrame, float]:
    """As _settle_arrays: links (a, b, w) without self-loops, label (node, label, degree) of nodes 0, 1, ...

    Links are dealt by their first end once and kept as arrays. So a round is one job: labels and masses of nodes are sent
    to all tasks, and those that change come back.
    """
    spark = links.sparkSession
    if label.count() > SENT_NODES:
        return _settle_joined(links, label, total, loops, seed)
    parts = min(int(spark.conf.get("spark.sql.shuffle.partitions")), links.count() // BLOCK + 1)
    own = label.select(F.col("node").alias("a"), F.col("node").alias("b"), F.col("degree").alias("w"))
    held = links.select("a", "b", "w").unionByName(own).repartition(parts, "a").sortWithinPartitions("a")
    held = held.mapInPandas(_blocks, "own binary, degree binary, at binary, b binary, w binary").persist()

    def step(now: np.ndarray, mass: np.ndarray, mark: int) -> tuple[float, bool, np.ndarray, np.ndarray]:
        sent = spark.sparkContext.broadcast((now, mass))

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for nodes, degree, at, b, w in _unpacked(frames):
                inside, wants, node, to = _moves(at, b, w, nodes, degree, total, *sent.value, mark)
                yield pd.DataFrame({"inside": [inside], "wants": [wants], "node": [node.tobytes()], "to": [to.tobytes()]})

        rows = held.mapInPandas(run, "inside double, wants boolean, node binary, to binary").collect()
        sent.destroy()
        node, to = (np.frombuffer(b"".join(r[c] for r in rows), np.int64) for c in ("node", "to"))
        return sum(r["inside"] for r in rows), any(r["wants"] for r in rows), node, to

    start = label.select("node", "label", "degree").toArrow()
    order = np.argsort(start["node"].to_numpy())
    best, most = _rounds(step, start["label"].to_numpy()[order], start["degree"].to_numpy()[order], total, loops, seed)
    sent = spark.sparkContext.broadcast(best)

    def named(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for nodes, degree, *_ in _unpacked(frames):
            yield pd.DataFrame({"node": nodes, "label": sent.value[nodes], "degree": degree})

    found = materialise(held.mapInPandas(named, "node long, label long, degree double"), "labels")
    held.unpersist()
    sent.destroy()
    return found, most


def _settle_joined(links: DataFrame, label: DataFrame, total: float, loops: float, seed: int) -> tuple[DataFrame, float]:
    """As _settle, for more nodes than are sent: each node with a link of weight 0 to itself for its own label, and labels and
    masses are joined by shuffles."""
    parts = int(links.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = label.select(F.col("node").alias("a"), F.col("node").alias("b"), F.lit(0.0).alias("w"))
    held = links.select("a", "b", "w").unionByName(own).join(label.select(F.col("node").alias("a"), "degree"), "a").repartition(parts, "a").persist()
    best, most, idle, k = label, float("-inf"), 0, 0
    while True:
        mass = label.groupBy("label").agg(F.sum("degree").alias("mass"))
        to = held.join(label.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node"), "label")
        to = to.agg(F.sum("w").alias("w"), F.max(F.col("a") == F.col("b")).alias("stays"), F.max("degree").alias("degree")).join(mass, "label")
        stays = F.col("stays")
        to = to.withColumn("gain", F.col("w") - F.col("degree") * (F.col("mass") - F.when(stays, F.col("degree")).otherwise(0.0)) / total)
        mine = lambda c: F.max(F.when(stays, F.col(c)))
        choice = to.groupBy("node").agg(F.max_by("label", F.struct("gain", F.xxhash64("label"))).alias("to"), F.max("gain").alias("gain"), mine("gain").alias("now"), mine("w").alias("inside"), mine("label").alias("own"), F.max("degree").alias("degree"))
        choice = materialise(choice, "choice")
        wants = F.col("gain") > F.col("now") + LEAST_GAIN
        one = choice.agg(F.sum("inside").alias("inside"), F.count_if(wants).alias("wants")).first()
        spread = mass.agg(F.sum(F.pow(F.col("mass") / total, F.lit(2.0)))).first()[0]
        q = ((one["inside"] or 0.0) + loops) / total - spread
        if q > most + LEAST_GAIN:
            best, most, idle = label, q, 0
        else:
            idle += 1
        if not one["wants"] or idle == IDLE_ROUNDS:
            held.unpersist()
            return best, most
        turn = F.xxhash64("node", F.lit(k + seed).cast("long")).bitwiseAND(F.lit(1)) == 0
        label = choice.select("node", F.when(turn & wants, F.col("to")).otherwise(F.col("own")).alias("label"), "degree")
        k += 1


def _levels_task(total: float, reached: float, seed: int):
    """The levels that are left, for links (a, b, w) and labels (a, null, label) of nodes 0, 1, ..."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        whole = pd.concat(list(frames))
        of, links = whole[whole["b"].isna()].sort_values("a"), whole[whole["b"].notna()]
        arrays = (links["a"].to_numpy(np.int64), links["b"].to_numpy(np.int64), links["w"].to_numpy(float))
        label = _levels_arrays(*arrays, of["w"].to_numpy(np.int64), total, reached, seed)
        yield pd.DataFrame({"node": np.arange(len(label)), "label": label})

    return run


def _renamed(links: DataFrame, of: DataFrame) -> DataFrame:
    """links between the parts that of (node, part) gives."""
    ends = links.join(of.select(F.col("node").alias("a"), F.col("part").alias("x")), "a").join(of.select(F.col("node").alias("b"), F.col("part").alias("y")), "b")
    return ends.groupBy(F.col("x").alias("a"), F.col("y").alias("b")).agg(F.sum("w").alias("w"))


def connected_parts(member: DataFrame, pairs: DataFrame) -> DataFrame:
    """member (node, id) with part: the smallest node reached by pairs (a, b) inside the same id. Nodes may be of any type.

    Each round hangs the ends of what links are left below their smallest neighbour, follows these to their roots and
    keeps the links between different roots, so the links shrink and paths of any length take few rounds.
    """
    of = lambda end, name: member.select(F.col("node").alias(end), F.col("id").alias(name))
    links = pairs.select("a", "b").filter("a != b").join(of("a", "x"), "a").join(of("b", "y"), "b").filter("x = y").select("a", "b").distinct()
    links, low = materialise(links, "inside"), member.withColumn("part", F.col("node"))
    while not links.isEmpty():
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = materialise(both.groupBy("a").agg(F.min("b").alias("to")).filter("`to` < a"), "up")
        while True:
            above = up.select(F.col("a").alias("to"), F.col("to").alias("over"))
            up = materialise(up.join(above, "to", "left").select("a", F.coalesce("over", "to").alias("to"), F.col("over").isNotNull().alias("moved")), "up")
            if up.filter("moved").isEmpty():
                break
        up = up.select("a", "to")
        low = materialise(low.join(up.withColumnRenamed("a", "part"), "part", "left").select(*member.columns, F.coalesce("to", "part").alias("part")), "parts")
        for _ in range(2):  # one end, then the other
            links = links.join(up, "a", "left").select(F.col("b").alias("a"), F.coalesce("to", "a").alias("b"))
        links = materialise(links.filter("a != b").distinct(), "inside")
    return low


def leiden_frames(nodes: DataFrame, pairs: DataFrame, seed: int = 42, one_task: int = 0) -> DataFrame:
    """(node, id) for nodes (name) and pairs (a, b, weight), by the same steps as leiden_arrays.

    Parts have far fewer links than nodes: levels of at most one_task links and parts are worked on with arrays.
    """
    name = materialise(numbered(nodes.select(F.col("name").alias("node")), ["node"], "i").select("node", (F.col("i") - 1).alias("i")), "numbers")
    w = F.col("weight").cast("double")
    ends = pairs.filter("weight > 0").join(name.select(F.col("node").alias("a"), F.col("i").alias("x")), "a").join(name.select(F.col("node").alias("b"), F.col("i").alias("y")), "b")
    ends = ends.select(F.col("x").alias("a"), F.col("y").alias("b"), w.alias("w"))
    back = ends.filter("a != b").select(F.col("b").alias("a"), F.col("a").alias("b"), "w")
    links = materialise(ends.withColumn("w", F.when(F.col("a") == F.col("b"), 2 * F.col("w")).otherwise(F.col("w"))).unionByName(back), "links")
    total = links.agg(F.sum("w")).first()[0]
    if not total:
        return name.select("node", F.lit(0).alias("id"))
    label = name.select(F.col("i").alias("node"), F.col("i").alias("label"))
    member, reached = name.select(F.col("i").alias("node"), F.col("i").alias("top")), float("-inf")
    while True:
        if max(label.count(), links.count()) <= one_task:
            state = links.select("a", "b", "w").unionByName(label.select(F.col("node").alias("a"), F.lit(None).cast("long").alias("b"), F.col("label").cast("double").alias("w")))
            label = materialise(state.coalesce(1).mapInPandas(_levels_task(total, reached, seed), "node long, label long"), "labels")
            break
        degree = links.groupBy(F.col("a").alias("node")).agg(F.sum("w").alias("degree"))
        label = materialise(label.join(degree, "node", "left").select("node", "label", F.coalesce("degree", F.lit(0.0)).alias("degree")), "labels")
        loops = links.filter("a = b").agg(F.sum("w")).first()[0] or 0.0
        other = links.filter("a != b")
        found, q = _settle(other, label, total, loops, seed)
        if q <= reached + LEAST_GAIN:
            break
        reached, label = q, found
        of = label.select("node", "label")
        same = other.join(of.select(F.col("node").alias("a"), F.col("label").alias("x")), "a").join(of.select(F.col("node").alias("b"), F.col("label").alias("y")), "b").filter("x = y")
        fine, _ = _settle(materialise(same.select("a", "b", "w"), "inner"), label.withColumn("label", F.col("node")), total, loops, seed)
        if fine.select("label").distinct().count() == fine.count():
            fine = label
        # parts and then communities get numbers from 0, in the order of their labels
        parts = materialise(numbered(fine.select("label").distinct(), ["label"], "part").select("label", (F.col("part") - 1).alias("part")), "parts")
        place = materialise(fine.select("node", "label").join(parts, "label").select("node", "part"), "places")
        part_of = place.join(of, "node").groupBy("part").agg(F.first("label").alias("community"))
        first = part_of.groupBy("community").agg(F.min("part").alias("label"))
        links = materialise(_renamed(links, place), "links")
        member = materialise(member.join(place.withColumnRenamed("node", "top"), "top").select("node", F.col("part").alias("top")), "members")
        label = part_of.join(first, "community").select(F.col("part").alias("node"), "label")
    own = member.join(label.select(F.col("node").alias("top"), F.col("label").alias("id")), "top").select("node", "id")
    own = materialise(connected_parts(materialise(own, "members"), ends), "parts").select("node", F.col("part").alias("label"))
    size = own.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("first"))
    number = numbered(size, [F.desc("n"), "first"], "id").select("label", (F.col("id") - 1).cast("int").alias("id"))
    return own.join(number, "label").select(F.col("node").alias("i"), "id").join(name, "i").select("node", "id")


def membership(nodes: DataFrame, edges: DataFrame, strategy: str = "sum", seed: int = 42, one_task: int = ONE_TASK) -> DataFrame:
    """(node, id) for each node; fewer than two nodes give nothing, and without edges all are in community 0."""
    nodes = materialise(nodes.select("name").distinct(), "nodes")
    pairs = materialise(symmetrize(weighted_pairs(edges), strategy), "pairs")
    n = nodes.count()
    if n < 2:
        return nodes.select(F.col("name").alias("node"), F.lit(0).alias("id")).limit(0)
    if max(n, pairs.count()) > one_task:
        return leiden_frames(nodes, pairs, seed, one_task)
    alone = nodes.select(F.col("name").alias("a"), F.col("name").alias("b"), F.lit(0).cast("long").alias("weight"))
    return pairs.select("a", "b", "weight").unionByName(alone).coalesce(1).mapInPandas(_leiden_task(seed), "node string, id int")


def frame_modularity(pairs: DataFrame, member: DataFrame) -> DataFrame:
    """One row, modularity: of undirected pairs (a, b, weight) and member (node, id)."""
    of = lambda end, name: member.select(F.col("node").alias(end), F.col("id").alias(name))
    w = F.col("weight").cast("double")
    ends = pairs.join(of("a", "x"), "a").join(of("b", "y"), "b").select("x", "y", w.alias("w"))
    mass = ends.select(F.explode(F.array("x", "y")).alias("id"), "w").groupBy("id").agg(F.sum("w").alias("mass"))
    inside = ends.agg(F.sum(F.when(F.col("x") == F.col("y"), 2 * F.col("w")).otherwise(0.0)).alias("inside"), (2 * F.sum("w")).alias("total"))
    squares: Callable[[], Column] = lambda: F.sum(F.col("mass") * F.col("mass"))
    return mass.agg(squares().alias("s")).join(F.broadcast(inside)).select((F.col("inside") / F.col("total") - F.col("s") / (F.col("total") * F.col("total"))).alias("modularity"))


def _summaries(client: LLMClient):
    """The model's sentence on a community's first members; what is there stays if it fails or says nothing."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for some, plain in zip(frame["some"], frame["summary"], strict=True):
                try:
                    said = client.complete(SYSTEM, "One sentence, in the language of these names:\n" + "\n".join(some), "text", 0.0).strip()
                except Exception:
                    said = ""
                out.append(said or plain)
            yield frame[["id"]].assign(summary=out)

    return run


def communities(nodes: DataFrame, edges: DataFrame, member: DataFrame, client: LLMClient | None = None) -> DataFrame:
    """id, members (sorted), size, summary and source_files of each community; with a client it writes the summaries."""
    own = member.join(nodes.select(F.col("name").alias("node"), "source_file"), "node").select("id", "source_file")
    end = edges.select(F.explode(F.array("head", "tail")).alias("node"), "source_file").distinct()
    sources = own.unionByName(member.join(end, "node").select("id", "source_file")).filter("source_file != ''")
    files = sources.groupBy("id").agg(F.sort_array(F.collect_set("source_file")).alias("source_files"))
    group = member.groupBy("id").agg(F.sort_array(F.collect_list("node")).alias("members"), F.count(F.lit(1)).cast("int").alias("size"))
    out = group.join(files, "id", "left").withColumn("summary", community_summary(F.col("members"), F.col("size")))
    if client is not None:
        asked = ask_in_turns(out.select("id", F.slice("members", 1, 20).alias("some"), "summary"), client, _summaries, "id int, summary string")
        out = out.drop("summary").join(materialise(asked, "summaries"), "id")  # model calls run once
    return out.select("id", "members", "size", "summary", F.coalesce("source_files", F.array().cast("array<string>")).alias("source_files"))


def overlap(found: DataFrame, entities: DataFrame) -> DataFrame:
    """(id, score) of communities: matched entities over all distinct entities, both normalised."""
    asked = entities.select(normalize_entity(F.col("name")).alias("norm")).filter("norm != ''").distinct()
    n = asked.count()
    member = found.select("id", F.explode("members").alias("m")).select("id", normalize_entity(F.col("m")).alias("norm")).distinct()
    return member.join(asked, "norm").groupBy("id").agg((F.count(F.lit(1)) / F.lit(max(n, 1))).alias("score"))
