"""The k most similar vectors of every vector, by a forest of random-projection trees.

A tree halves the vectors at every node, at the median of their projections on the
difference of two random means of the node's vectors.  Each vector lies in one leaf
of every tree, its homes.  A query walks all trees with one shared priority queue:
a step to the far side of a split adds the squared margin, so the homes come first
and then the leaves beyond the nearest splits.  The queue is walked level by level
and keeps only as many nodes as leaves are wanted; a node costs no less than its
parent, so these are the first leaves of the whole queue.

Two rounds: first every vector is searched in its homes, which gives it a bound, the
k-th best cosine so far; then it visits the next leaves of its queue, where only what
reaches its bound is reranked by exact cosine.  As cosine is symmetric, a visitor is a
candidate for the vectors at home, too.

The splits are fitted on a bounded sample (``SAMPLE`` vectors of a kind); every vector
is indexed and every vector is a query.  How many leaves are visited isn't a constant:
``CHECKED`` vectors of a kind are searched by brute force in all rows, and the queue
is followed as far as their true neighbours need to be found to ``RECALL``.  So recall
doesn't fall as a table grows; the work per vector rises instead.

Vectors travel packed, many of one leaf in a row.  A task holds the home vectors of
one leaf and lets the visitors stream by.  Vectors of one kind with equal values are
one point of the index with its smallest members.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.components import salted_join
from ..session import cut, merge_join, ordered_chunks

K, DECIMALS = 5, 6
TREES, LEAF = 3, 1200
SAMPLE, PER_LEAF, CHECKED, RECALL, SEED = 20_000, 8, 256, 0.965, 7
_NEAR = 3e-6  # what rounding and single precision may hide
_CELLS = 4_000_000  # similarities that a task holds at once
_BUCKET = 11  # bits of a vector's number within the rows it is merged with


class Forest:
    """Complete binary trees of one depth: normals and thresholds of their nodes by level, tree after tree."""

    def __init__(self, normals: list[np.ndarray], thresholds: list[np.ndarray], trees: int, probes: int) -> None:
        self.normals, self.thresholds, self.trees, self.probes = normals, thresholds, trees, probes
        self.leaves = trees << len(normals)

    @classmethod
    def fit(cls, unit: np.ndarray, n: int, seed: int = SEED, trees: int = TREES, leaf: int = LEAF) -> Forest:
        """Leaves of about ``leaf`` of the ``n`` vectors, but of at least ``PER_LEAF`` vectors of the sample ``unit``."""
        depth = max(0, min(int(np.ceil(np.log2(max(n, 1) / leaf))), int(np.log2(max(len(unit), 1) / PER_LEAF))))
        trees = trees if depth else 1
        rnd = np.random.default_rng(seed)
        normals = [np.zeros((trees << level, unit.shape[1]), dtype=np.float32) for level in range(depth)]
        thresholds = [np.zeros(trees << level, dtype=np.float32) for level in range(depth)]
        held = [np.arange(len(unit)) for _ in range(trees)]
        for level in range(depth):
            below = []
            for node, rows in enumerate(held):
                normals[level][node] = normal = _normal(unit, rows, rnd)
                side = unit[rows] @ normal
                thresholds[level][node] = at = np.float32(np.median(side)) if len(rows) else np.float32(0)
                below += [rows[side <= at], rows[side > at]]
            held = below
        return cls(normals, thresholds, trees, trees)

    def _margins(self, unit: np.ndarray, level: int, at: np.ndarray) -> np.ndarray:
        normals, thresholds = self.normals[level], self.thresholds[level]
        if len(normals) <= 16 * at.shape[1]:
            return np.take_along_axis(unit @ normals.T - thresholds, at, 1)
        return np.einsum("nd,nmd->nm", unit, normals[at]) - thresholds[at]

    def queue(self, unit: np.ndarray, most: int) -> np.ndarray:
        """For each vector the first ``most`` leaves of the shared queue, in its order (the homes first, tree by tree)."""
        n = len(unit)
        at, cost = np.tile(np.arange(self.trees), (n, 1)), np.zeros((n, self.trees), dtype=np.float32)
        for level in range(len(self.normals)):
            m = self._margins(unit, level, at)
            far = np.maximum(m * m, 1e-12)
            at = np.concatenate([2 * at, 2 * at + 1], axis=1)
            cost = np.concatenate([cost + np.where(m > 0, far, 0), cost + np.where(m > 0, 0, far)], axis=1)
            if cost.shape[1] > most:
                keep = np.argpartition(cost, most - 1, axis=1)[:, :most]
                at, cost = np.take_along_axis(at, keep, 1), np.take_along_axis(cost, keep, 1)
        return np.take_along_axis(at, np.lexsort((at, cost), axis=1), 1)


def _normal(unit: np.ndarray, rows: np.ndarray, rnd: np.random.Generator, few: int = 200, rounds: int = 5) -> np.ndarray:
    """The direction between two means of random vectors of a node; a random one where they don't differ."""
    some = unit[rnd.choice(rows, min(len(rows), few), replace=False)] if len(rows) > 1 else np.zeros((0, unit.shape[1]), np.float32)
    if len(some) > 1:
        a, b = some[0], some[1]
        for _ in range(rounds):
            to_a = some @ a >= some @ b
            if to_a.all() or not to_a.any():
                break
            a, b = some[to_a].mean(0), some[~to_a].mean(0)
            a, b = a / max(np.linalg.norm(a), 1e-9), b / max(np.linalg.norm(b), 1e-9)
        if np.linalg.norm(a - b) > 1e-6:
            return ((a - b) / np.linalg.norm(a - b)).astype(np.float32)
    w = rnd.standard_normal(unit.shape[1])
    return (w / np.linalg.norm(w)).astype(np.float32)


def _unit(raw: np.ndarray) -> np.ndarray:
    d = raw.astype(np.float64)
    return (d / np.linalg.norm(d, axis=1, keepdims=True)).astype(np.float32)


def _exact(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Rounded cosine of each row of ``q`` with the same row of ``c``."""
    q, c = q.astype(np.float64), c.astype(np.float64)
    return np.round(np.einsum("nd,nd->n", q, c) / np.sqrt(np.einsum("nd,nd->n", q, q) * np.einsum("nd,nd->n", c, c)), DECIMALS)


def best(of: np.ndarray, near: np.ndarray, sims: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each number in ``of``, by ``sims`` and then the smaller ``near``; repeated pairs count once."""
    order = np.lexsort((near, -sims, of))
    of, near, sims = of[order], near[order], sims[order]
    if len(of):  # a pair that was met twice has the same cosine, so it stands beside itself
        fresh = np.concatenate([[True], (of[1:] != of[:-1]) | (near[1:] != near[:-1])])
        of, near, sims = of[fresh], near[fresh], sims[fresh]
        starts = np.concatenate([[True], of[1:] != of[:-1]])
        place = np.arange(len(of)) - np.maximum.accumulate(np.where(starts, np.arange(len(of)), 0))
        keep = place < k
        of, near, sims = of[keep], near[keep], sims[keep]
    return of, near, sims


def nearest(ids: np.ndarray, raw: np.ndarray, unit: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``of, near, cosine``: the exact k nearest others of every vector of a set, ties to the smaller id."""
    n, m = len(ids), min(k + 4, len(ids))
    step, got = max(1, _CELLS // max(n, 1)), []
    for s in range(0, n, step):
        e = min(s + step, n)
        rough = unit[s:e] @ unit.T
        rough[np.arange(e - s), np.arange(s, e)] = -3.0
        top = np.argpartition(-rough, m - 1, axis=1)[:, :m]
        kth = np.sort(np.take_along_axis(rough, top, 1), axis=1)[:, -min(k, m)]
        # More than m may tie with the k-th: then all of them are looked at.
        tied = np.nonzero((rough >= kth[:, None] - _NEAR).sum(axis=1) > m)[0]
        pairs = [(np.repeat(np.arange(e - s), m), top.ravel())] + [(np.full(len(x), r), x) for r in tied for x in [np.nonzero(rough[r] >= kth[r] - _NEAR)[0]]]
        i, j = np.concatenate([p[0] for p in pairs]) + s, np.concatenate([p[1] for p in pairs])
        i, j = i[i != j], j[i != j]
        got.append(best(ids[i], ids[j], _exact(raw[i], raw[j]), k))
    return tuple(np.concatenate(x) for x in zip(*got))


def visit(h_id, h, hu, h_least, q_id, q, qu, q_least, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``of, near, cosine`` of visitors ``q`` and home vectors ``h``: what reaches the bound (``least``) of either side."""
    step, got = max(1, _CELLS // max(len(h_id), 1)), []
    for s in range(0, len(q_id), step):
        rough = qu[s : s + step] @ hu.T
        i, j = np.nonzero(rough >= np.minimum(q_least[s : s + step, None], h_least[None, :]) - _NEAR)
        exact = _exact(q[s + i], h[j])
        for_q, for_h = exact >= q_least[s + i], exact >= h_least[j]
        got.append(best(q_id[s + i][for_q], h_id[j][for_q], exact[for_q], k))
        got.append(best(h_id[j][for_h], q_id[s + i][for_h], exact[for_h], k))
    return tuple(np.concatenate(x) for x in zip(*got)) if got else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def _packed(m: np.ndarray) -> bytes:
    """Vectors as bytes, without loss: one byte a value where all are small whole numbers, else four."""
    small = m.astype(np.int8) if m.size and np.abs(m).max() <= 127 else None
    return b"\x01" + small.tobytes() if small is not None and (small == m).all() else b"\x04" + m.astype(np.float32).tobytes()


def _unpacked(b: bytes, n: int) -> np.ndarray:
    flat = np.frombuffer(b, dtype=np.int8, offset=1).astype(np.float32) if b[0] == 1 else np.frombuffer(b, dtype=np.float32, offset=1)
    return flat.reshape(n, -1)


def index_points(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Points of the index and the assets on them, from ``kind, asset_id, vec`` (one valid vector each).

    Points are numbered in the order of their smallest asset, so that ties by
    number are ties by asset id.
    """
    # Two 64-bit hashes of the values tell vectors apart.
    copy = F.concat_ws("-", F.xxhash64("vec").cast("string"), F.xxhash64(F.lit(1), "vec").cast("string"))
    assets = cut(vectors.withColumn("copy", copy))
    groups = assets.groupBy("kind", "copy").agg(F.min(F.struct("asset_id", "vec")).alias("m")).select("kind", "copy", F.col("m.asset_id").alias("least"), F.col("m.vec").alias("vec"))
    points = cut(ordered_chunks(groups, "kind", "least").withColumn("vid", F.monotonically_increasing_id()).drop("chunk"))
    return points, assets.drop("vec")


def _matrices(batch: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray]]:
    """``kind, vid, raw, bound`` of a batch's rows, kind by kind."""
    kinds = np.array(batch.column("kind").to_pylist(), dtype=object)
    vid = batch.column("vid").to_numpy(zero_copy_only=False)
    bound = batch.column("bound").to_numpy(zero_copy_only=False) if "bound" in batch.schema.names else np.full(len(vid), -2.0)
    vec = batch.column("vec")
    ends = np.cumsum(vec.value_lengths().to_numpy(zero_copy_only=False))
    flat = vec.flatten().to_numpy(zero_copy_only=False).astype(np.float32)
    for kind in dict.fromkeys(kinds):
        at = np.nonzero(kinds == kind)[0]
        d = int(ends[at[0]] - (ends[at[0] - 1] if at[0] else 0))
        yield kind, vid[at], flat[(ends[at] - d)[:, None] + np.arange(d)], bound[at]


def forests(points: DataFrame, sample: int = SAMPLE, seed: int = SEED, k: int = K, leaf: int = LEAF) -> dict[str, Forest]:
    """A forest for each kind, fitted on the ``sample`` points with the smallest hash of their number, and how far its queue is followed."""
    models, asked = {}, {}
    for r in points.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect():  # kinds are few: one for each model
        rows = points.where(F.col("kind") == r["kind"]).withColumn("h", F.xxhash64("vid")).orderBy("h").limit(sample).select("kind", "vid", "vec").toArrow()
        _, vid, raw, _ = next(_matrices(rows.combine_chunks().to_batches()[0]))
        models[r["kind"]] = Forest.fit(_unit(raw), r["n"], seed, leaf=leaf)
        asked[r["kind"]] = vid[:CHECKED], _unit(raw[:CHECKED])
    for kind, of, raw in _true_neighbours(points, {x: a for x, a in asked.items() if len(models[x].normals)}, k):
        f, q = models[kind], asked[kind][1][of]
        there, back = f.queue(_unit(raw), f.leaves), f.queue(q, f.leaves)
        rank = lambda queue, homes: (queue[:, :, None] == homes[:, None, : f.trees]).any(axis=2).argmax(axis=1)
        needed = np.sort(np.minimum(rank(back, there), rank(there, back)))
        f.probes = max(f.trees, int(needed[int(np.ceil(RECALL * len(needed))) - 1]) + 1)
    return models


def _true_neighbours(points: DataFrame, asked: dict[str, tuple[np.ndarray, np.ndarray]], k: int) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """Per kind the k true neighbours of its asked vectors (a bounded number): their places in ``asked``, the neighbours' vectors."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for kind, vid, raw, _ in _matrices(batch):
                if kind not in asked:
                    continue
                sims = asked[kind][1] @ _unit(raw).T
                sims[asked[kind][0][:, None] == vid[None, :]] = -3.0
                m = min(k, len(vid))
                top = np.argpartition(-sims, m - 1, axis=1)[:, :m]
                of = np.repeat(np.arange(len(top)), m)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([kind] * len(of)), pa.array(of), pa.array(np.take_along_axis(sims, top, 1).ravel().astype(float)), pa.array([raw[j].tobytes() for j in top.ravel()], pa.binary())], ["kind", "of", "sim", "vec"]
                )

    if asked:
        met = points.select("kind", "vid", "vec").mapInArrow(scan, "kind string, of bigint, sim double, vec binary")
        place = F.row_number().over(W.partitionBy("kind", "of").orderBy(F.desc("sim"), "vec"))
        got = met.withColumn("place", place).where(F.col("place") <= k).where("sim > -2").select("kind", "of", "vec").toPandas()  # k rows for each vector asked
        for kind, part in got.groupby("kind"):
            yield kind, part["of"].to_numpy(), np.stack([np.frombuffer(b, dtype=np.float32) for b in part["vec"]])


_ROUTED = "kind string, leaf int, guest boolean, vids binary, vecs binary, bounds binary"
_MET = "bucket bigint, ids binary, near binary, sims binary"


def _route(models: dict[str, Forest], guests: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for kind, vid, raw, bound in _matrices(batch):
                f, rows = models[kind], []
                for s in range(0, len(vid), 2048):
                    u = _unit(raw[s : s + 2048])
                    rows.append(f.queue(u, f.probes if guests else f.trees))
                to = np.concatenate(rows)
                of = np.repeat(np.arange(len(vid)), to.shape[1])
                guest = np.tile(np.arange(to.shape[1]) >= f.trees, len(vid))
                flat = to.ravel()
                order = np.lexsort((guest, flat))
                flat, of, guest = flat[order], of[order], guest[order]
                at = np.concatenate([[0], np.nonzero((flat[1:] != flat[:-1]) | (guest[1:] != guest[:-1]))[0] + 1, [len(flat)]])
                parts = [of[a:b] for a, b in zip(at[:-1], at[1:])]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([kind] * len(parts)), pa.array(flat[at[:-1]].astype(np.int32)), pa.array(guest[at[:-1]]), pa.array([vid[p].tobytes() for p in parts], pa.binary()),
                        pa.array([_packed(raw[p]) for p in parts], pa.binary()), pa.array([bound[p].tobytes() for p in parts], pa.binary()),
                    ], ["kind", "leaf", "guest", "vids", "vecs", "bounds"],
                )

    return run


def _met(of: np.ndarray, near: np.ndarray, sims: np.ndarray) -> pa.RecordBatch:
    """Results packed by the bucket of ``of``."""
    order = np.argsort(of >> _BUCKET, kind="stable")
    of, near, sims = of[order], near[order], sims[order]
    bucket = of >> _BUCKET
    at = [0, *(np.nonzero(bucket[1:] != bucket[:-1])[0] + 1), len(of)] if len(of) else [0]
    cut_up = lambda x: pa.array([x[a:b].tobytes() for a, b in zip(at[:-1], at[1:])], pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(bucket[at[:-1]] if len(of) else bucket), cut_up(of), cut_up(near), cut_up(sims)], ["bucket", "ids", "near", "sims"])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):  # packed rows: each holds many vectors
            yield {n: batch.column(c)[i].as_py() for c, n in enumerate(batch.schema.names)}


def _search(k: int, guests: bool) -> Callable:
    """Over rows sorted by kind, leaf and guest: the homes of a leaf are held, its visitors stream by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leaf, parts, home = None, [], None

        def opened(parts):
            return [np.concatenate(x) for x in zip(*parts)]

        for r in _rows(batches):
            if (r["kind"], r["leaf"]) != leaf:
                if parts and not guests:
                    i, v, u, _ = opened(parts)
                    yield _met(*nearest(i, v, u, k))
                leaf, parts, home = (r["kind"], r["leaf"]), [], None
            vid = np.frombuffer(r["vids"], dtype=np.int64)
            raw = _unpacked(r["vecs"], len(vid))
            part = vid, raw, _unit(raw), np.frombuffer(r["bounds"], dtype=np.float64)
            if not r["guest"]:
                parts.append(part)
            elif parts:
                home = opened(parts) if home is None else home
                yield _met(*visit(*home, *part, k))
        if parts and not guests:
            i, v, u, _ = opened(parts)
            yield _met(*nearest(i, v, u, k))

    return run


def _merge(k: int, packed: bool) -> Callable:
    """Over rows sorted by bucket: the k best of every vector, packed again or one row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, parts = None, []

        def done():
            of, near, sims = best(*[np.concatenate(x) for x in zip(*parts)], k)
            if packed:
                return _met(of, near, sims)
            at = np.concatenate([[0], np.nonzero(of[1:] != of[:-1])[0] + 1, [len(of)]]).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(at), pa.array(x)) for x in (near, sims)]
            return pa.RecordBatch.from_arrays([pa.array(of[at[:-1]]), *lists], ["vid", "near", "sims"])

        for r in _rows(batches):
            if r["bucket"] != bucket and parts:
                yield done()
                parts = []
            bucket = r["bucket"]
            parts.append([np.frombuffer(r["ids"], np.int64), np.frombuffer(r["near"], np.int64), np.frombuffer(r["sims"], np.float64)])
        if parts:
            yield done()

    return run


def _merged(met: DataFrame, k: int, packed: bool) -> DataFrame:
    rows = met.repartition("bucket").sortWithinPartitions("bucket")
    return rows.mapInArrow(_merge(k, packed), _MET if packed else "vid bigint, near array<bigint>, sims array<double>")


def knn(points: DataFrame, k: int = K, sample: int = SAMPLE, leaf: int = LEAF) -> DataFrame:
    """``vid, near: array<struct<neg: double, vid: bigint>>``: up to k neighbours, nearest first (``neg`` is minus the cosine)."""
    models = forests(points, sample, k=k, leaf=leaf)

    def round_of(rows: DataFrame, guests: bool) -> DataFrame:
        routed = rows.mapInArrow(_route(models, guests), _ROUTED).repartition("kind", "leaf").sortWithinPartitions("kind", "leaf", "guest")
        return routed.mapInArrow(_search(k, guests), _MET)

    at_home = cut(_merged(round_of(points.select("kind", "vid", "vec"), False), k, True))
    every = at_home
    if any(f.probes > f.trees for f in models.values()):
        lists = _merged(at_home, k, False).select("vid", F.when(F.size("sims") >= k, F.array_min("sims")).otherwise(-2.0).alias("bound"))
        bounded = merge_join(points.select("kind", "vid", "vec"), lists, "vid", "left").select("kind", "vid", "vec", F.coalesce("bound", F.lit(-2.0)).alias("bound"))
        every = at_home.unionByName(round_of(bounded, True))
    return _merged(every, k, False).select("vid", F.zip_with("sims", "near", lambda s, v: F.struct((-s).alias("neg"), v.alias("vid"))).alias("near"))


def asset_neighbours(vectors: DataFrame, k: int = K) -> DataFrame:
    """``kind, asset_id, other, cosine, place``: the k nearest other assets of every asset.

    ``vectors``: ``kind, asset_id, vec``.  Vectors must be valid (see
    :func:`valid_vectors`); an asset counts once per kind.
    """
    points, assets = index_points(vectors)
    near = cut(knn(points, k))
    place = F.row_number().over(W.partitionBy("kind", "copy").orderBy("asset_id"))
    # The k + 1 smallest assets of each point: more can't be among anyone's k nearest.  One more tells whether there are others.
    few = assets.withColumn("p", place).where(F.col("p") <= k + 2).groupBy("kind", "copy").agg(F.sort_array(F.collect_list("asset_id")).alias("members"))
    at = cut(merge_join(points.select("kind", "copy", "vid"), few, ["kind", "copy"]))
    of_point = at.select("vid", F.slice("members", 1, k + 1).alias("members"))
    lists = near.select(F.col("vid").alias("of"), F.explode("near").alias("x")).select("of", F.col("x.vid").alias("vid"), F.col("x.neg").alias("neg"))
    other = merge_join(lists, of_point, "vid").select(F.col("of").alias("vid"), F.transform("members", lambda a: F.struct(F.col("neg").alias("neg"), a.alias("id"))).alias("l"))
    own = of_point.where(F.size("members") > 1).select("vid", F.transform("members", lambda a: F.struct(F.lit(-1.0).alias("neg"), a.alias("id"))).alias("l"))
    # At most k + 1 lists of k + 1 for each point.
    pool = other.unionByName(own).groupBy("vid").agg(F.slice(F.sort_array(F.flatten(F.collect_list("l"))), 1, 2 * k + 2).alias("pool"))
    by_point = cut(merge_join(at, pool, "vid").select("kind", "copy", "members", "pool"))
    # Points whose assets are all listed need no join with the assets, the others a salted one.
    listed = by_point.where(F.size("members") <= k + 1).select("kind", F.explode("members").alias("asset_id"), "pool")
    crowd = salted_join(assets, by_point.where(F.size("members") > k + 1).select("kind", "copy", "pool"), ["kind", "copy"], "asset_id").select("kind", "asset_id", "pool")
    got = listed.unionByName(crowd).select("kind", "asset_id", F.posexplode(F.slice(F.filter("pool", lambda x: x["id"] != F.col("asset_id")), 1, k)).alias("place", "x"))
    return got.select("kind", "asset_id", F.col("x.id").alias("other"), (-F.col("x.neg")).alias("cosine"), (F.col("place") + 1).alias("place"))


def valid_vectors(df: DataFrame, kind: str, asset: str, vec: str, version: str | None = None, length: int | None = None) -> DataFrame:
    """``kind, asset_id, vec``: the vectors that take part, one per kind and asset.

    Null, empty, non-finite and all-zero vectors and such with null elements take
    no part, nor do those of another length than their kind's: ``length``, else
    the commonest length of the kind's vectors (the shorter of equally common
    ones).  Of several vectors of an asset the greatest version counts, then the
    greatest values.
    """
    v = df.where(F.col(kind).isNotNull() & F.col(asset).isNotNull()).select(
        F.col(kind).alias("kind"), F.col(asset).alias("asset_id"), F.col(vec).cast("array<float>").alias("vec"), (F.col(version) if version else F.lit(0)).alias("version")
    )
    sound = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("vec", lambda x: x != 0)
    ok = v.where((F.size("vec") > 0) & sound)
    if length is None:
        sizes = ok.groupBy("kind", F.size("vec").alias("d")).agg(F.count(F.lit(1)).alias("n")).groupBy("kind").agg(F.max(F.struct("n", (-F.col("d")).alias("d"))).alias("m"))
        # One row for each kind.
        ok = ok.join(F.broadcast(sizes.select("kind", (-F.col("m.d")).alias("d"))), "kind").where(F.size("vec") == F.col("d"))
    else:
        ok = ok.where(F.size("vec") == length)
    return ok.groupBy("kind", "asset_id").agg(F.max(F.struct("version", "vec")).alias("m")).select("kind", "asset_id", F.col("m.vec").alias("vec"))


def pairs_found(neighbours: DataFrame) -> DataFrame:
    """``kind, a, b`` with a < b where one is among the nearest of the other, each once."""
    return neighbours.select("kind", F.least("asset_id", "other").alias("a"), F.greatest("asset_id", "other").alias("b")).distinct()
