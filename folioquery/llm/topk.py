"""Exact top-k by inner product: a ball tree in each shard, searched by branch and bound.

Components become integers, floor(256 * x). Shards are local: the upper levels of a ball tree, fitted
on a bounded sample (``SAMPLE_ROWS``, at most ``SAMPLE_BYTES``), deal every vector to one of at most
``MOST_LEAVES`` leaves, and a leaf's vectors are split by a hash into shards of about ``SHARD_BYTES``.
Every row is dealt, and a leaf's radius covers all of its rows, so the sample decides about speed
alone. A task reads a shard, builds its own ball tree and answers the queries that are streamed past
it, at most ``QUERY_BLOCK`` or so of them, so nothing in it grows with the table.

Nodes, and leaves before them, are taken in the order of their bounds: inner products are at most
q.c + |q| r for a centre c and radius r. The k-th score is shared between shards: a query first meets
one shard of the leaf whose centre suits it best, then the shards of the next few leaves whose bound
reaches the k-th score found so far, then all others whose bound reaches the k-th score of those. A
shard whose leaf's bound is below it is never sent the query. Equal scores go to the smaller id, so
only bounds strictly below cut.

Sums are exact: float64 while every product sum is below 2**52, Python integers beyond; bounds are
widened for rounding.

Defined cases: vectors that are null or hold null or non-finite components take no part; only
vectors of the same number of components are compared; a row with a null id takes no part; the
candidates of a query are all rows with another id; rows of one id other than the query's own
are candidates each (an id may then repeat in a result); equal query rows are answered once;
fewer than k candidates give fewer rows; a score beyond a long counts as the nearest long, and 256
times a component beyond a double as the nearest double; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioquery.llm.common import Workspace, join_checked, map_batches, materialize, table

QUERY = "op4_topk_search"

TOP = 5
SHARD_BYTES = 4 << 20
LEAF_ROWS = 128
SAMPLE_ROWS = 20_000
SAMPLE_BYTES = 32 << 20
MOST_LEAVES = 1024
#: Sampled rows that a leaf of the upper levels has at least.
LEAF_SAMPLE = 8
#: Leaves that a query meets before the rest, and queries that a shard meets in one task.
NEXT_LEAVES = 8
QUERY_BLOCK = 65_536
SCALE = 256
_EXACT = float(1 << 52)
_LONG = (-(1 << 63), (1 << 63) - 1)
#: Norms beyond this have no bounds in doubles; such rows are compared with every query.
_WIDE = 1e150


def _norms(x: np.ndarray) -> np.ndarray:
    most = np.abs(x).max(axis=1, initial=0.0)
    unit = x / np.where(most > 0, most, 1)[:, None]
    return most * np.sqrt((unit**2).sum(axis=1))


def _halves(x: np.ndarray, centre: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Sides of rows towards either of two far points, with the direction and the place of the cut."""
    a = x[int(far.argmax())]
    b = x[int(((x - a) ** 2).sum(axis=1).argmax())]
    along = x @ (b - a)
    cut = float(np.median(along))
    return along > cut, b - a, cut


class BallTree:
    """Nodes over the rows of an integer matrix; ids break ties."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, leaf: int = LEAF_ROWS):
        order = np.argsort(ids, kind="stable")
        self.ids, self.exact = ids[order], rows[order]
        self.rows = self.exact.astype(np.float64)
        norms = _norms(self.rows)
        self.wide = np.flatnonzero(norms > _WIDE)
        own = np.flatnonzero(norms <= _WIDE)
        self.norm = float(norms[own].max()) if len(own) else 0.0
        self.centres, self.radii, self.children, self.members = [], [], [], []
        if len(own):
            self._build(own, leaf)
        self.centres = np.array(self.centres).reshape(len(self.radii), rows.shape[1])
        self.radii = np.array(self.radii)

    def _build(self, all_rows: np.ndarray, leaf: int) -> None:
        todo = [(all_rows, None)]
        while todo:
            own, parent = todo.pop()
            node = len(self.radii)
            if parent is not None:
                self.children[parent].append(node)
            x = self.rows[own]
            centre = x.mean(axis=0)
            far = np.sqrt(((x - centre) ** 2).sum(axis=1))
            self.centres.append(centre)
            self.radii.append(float(far.max()) * (1 + 1e-9) + 1e-6)
            self.children.append([])
            if len(own) <= leaf or far.max() == 0:
                self.members.append(np.sort(own))
                continue
            self.members.append(None)
            side, way, cut = _halves(x, centre, far)
            if side.all() or not side.any():  # halves where that leaves a side empty
                side = x @ way >= cut
                if side.all():
                    side = np.arange(len(own)) % 2 == 0
            todo += [(own[side], node), (own[~side], node)]

    def scores(self, rows: np.ndarray, q: np.ndarray, q_float: np.ndarray, safe: bool) -> np.ndarray:
        if safe:
            return self.rows[rows] @ q_float
        sums = [sum(int(a) * int(b) for a, b in zip(self.exact[r], q)) for r in rows]
        return np.array([min(max(x, _LONG[0]), _LONG[1]) for x in sums], object)

    def search(self, queries: np.ndarray, own: np.ndarray, floor: list, k: int) -> list[list[tuple]]:
        """For each query up to k of (score, id) of at least its floor, best first; rows whose id is
        own are passed over."""
        qf = queries.astype(np.float64)
        length = _norms(qf)
        bounds = _bounds(qf, length, self.centres, self.radii, self.norm)
        return [
            self._one(queries[i], qf[i], bounds[i], own[i], floor[i], k, length[i] * self.norm < _EXACT)
            for i in range(len(queries))
        ]

    def _one(self, q, qf, bound, own, floor, k, safe) -> list[tuple]:
        kth = -np.inf if floor is None else floor
        best: list[tuple] = []
        heap = [(-bound[0], 0)] if len(bound) else []
        pending = [(self.wide, False)] if len(self.wide) else []
        while heap or pending:
            if pending:
                rows, exact = pending.pop()
                s = self.scores(rows, q, qf, exact)
            else:
                b, node = heapq.heappop(heap)
                if -b < kth:
                    break
                rows = self.members[node]
                if rows is None:
                    for c in self.children[node]:
                        if bound[c] >= kth:
                            heapq.heappush(heap, (-bound[c], c))
                    continue
                s = self.scores(rows, q, qf, safe)
            good = np.flatnonzero((s >= kth) & (self.ids[rows] != own))
            if not len(good):
                continue
            s, ids = s[good], self.ids[rows[good]]
            if len(good) > k:  # rows lie by id, so a stable sort leaves the smaller id first
                top = np.argsort(-s, kind="stable")[:k]
                s, ids = s[top], ids[top]
            best = sorted(best + [(int(x), int(i)) for x, i in zip(s, ids)], key=lambda p: (-p[0], p[1]))[:k]
            if len(best) == k:
                kth = max(kth, best[-1][0])
        return best


def _bounds(qf: np.ndarray, length: np.ndarray, centres: np.ndarray, radii: np.ndarray, norm: float) -> np.ndarray:
    """Largest inner products of queries with what lies in balls, widened for rounding; infinite
    where doubles cannot tell."""
    with np.errstate(over="ignore", invalid="ignore"):
        bounds = qf @ centres.T + length[:, None] * radii[None]
        bounds += 1e-9 * np.abs(bounds) + 1e-9 * length[:, None] * norm + 1e-3
    return np.where(np.isnan(bounds), np.inf, bounds)


@dataclass
class Upper:
    """Upper levels for vectors of one length: cuts, and of each leaf its centre, radius and shards."""

    cuts: list = field(default_factory=list)  # (direction, place, node below, node above); None: a leaf
    leaf_of: dict = field(default_factory=dict)  # node -> leaf
    centres: np.ndarray | None = None
    radii: np.ndarray | None = None
    shards: np.ndarray | None = None

    @staticmethod
    def fit(sample: np.ndarray, leaves: int) -> "Upper":
        tree, waiting = Upper([None]), [(len(sample), 0, np.arange(len(sample)))]
        members = {0: np.arange(len(sample))}
        while waiting and len(members) < min(leaves, len(sample) // LEAF_SAMPLE):
            _, node, own = heapq.heappop(waiting)
            x = sample[own]
            far = _norms(x - x.mean(axis=0))
            side, way, cut = _halves(x, x.mean(axis=0), far)
            if far.max() == 0 or side.all() or not side.any():
                continue
            tree.cuts[node] = (way, cut, len(tree.cuts), len(tree.cuts) + 1)
            del members[node]
            for part in (own[~side], own[side]):
                members[len(tree.cuts)] = part
                heapq.heappush(waiting, (-len(part), len(tree.cuts), part))
                tree.cuts.append(None)
        tree.leaf_of = {node: k for k, node in enumerate(members)}
        tree.centres = np.array([sample[own].mean(axis=0) if len(own) else np.zeros(sample.shape[1]) for own in members.values()])
        return tree

    def leaves(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        for node, cut in enumerate(self.cuts):  # parents come before their children
            if cut is not None:
                here = np.flatnonzero(at == node)
                with np.errstate(over="ignore", invalid="ignore"):
                    at[here] = np.where(x[here] @ cut[0] > cut[1], cut[3], cut[2])
        return np.array([self.leaf_of[n] for n in at.tolist()], np.int64)


def as_integers(vectors: DataFrame, id_col: str = "vec_id", col: str = "embedding") -> DataFrame:
    """id and v (array<double> of whole numbers) of the rows that take part."""
    v = F.col(f"`{col}`")
    usable = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != F.lit(float("inf"))))
    scaled = F.transform(v, lambda x: F.floor(x.cast("double") * SCALE).cast("double"))
    # floor() of a double saturates at a long; larger components are whole numbers already
    most = F.lit(float(np.finfo(np.float64).max))
    whole = lambda x: F.least(F.greatest(x.cast("double") * SCALE, -most), most)
    large = F.transform(v, lambda x: F.when(F.abs(x.cast("double")) < 1e15, F.floor(x.cast("double") * SCALE).cast("double")).otherwise(whole(x)))
    small = F.forall(v, lambda x: F.abs(x.cast("double")) < 1e15)
    rows = vectors.filter(v.isNotNull() & F.col(f"`{id_col}`").isNotNull()).filter(usable)
    return rows.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.when(small, scaled).otherwise(large).alias("v"))


def _floats(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dim)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of whole numbers, as int64 where they fit and else as Python integers."""
    flat = _floats(column, dim)
    if not flat.size or np.abs(flat).max() < 2.0**62:
        return flat.astype(np.int64)
    return np.vectorize(int, otypes=[object])(flat)


def _by(batch: pa.RecordBatch, *names: str):
    """(values, rows of batch) of each run of equal values in the columns named."""
    keys = np.array([batch.column(n).to_numpy(zero_copy_only=False) for n in names]).T
    cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
    for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
        if b > a:
            yield tuple(int(x) for x in keys[a]), batch.slice(a, b - a)


_SHARD = ["dim", "leaf", "part", "block"]


def _search(mixed: DataFrame, k: int) -> DataFrame:
    """mixed: (dim, leaf, part, block, is_query, id, v, floor); a shard's vectors come before its
    queries."""

    def run(batches):
        at, ids, rows, tree = None, [], [], None
        for batch in batches:
            for key, part in _by(batch, *_SHARD, "is_query"):
                if key[:4] != at:
                    at, ids, rows, tree = key[:4], [], [], None
                dim = key[0]
                if not key[4]:
                    ids.append(part.column("id").to_numpy())
                    rows.append(_matrix(part.column("v"), dim))
                    continue
                if tree is None:
                    both = np.concatenate(rows) if rows else np.zeros((0, dim), np.int64)
                    tree = BallTree(np.concatenate(ids) if ids else np.zeros(0, np.int64), both)
                    rows = []
                asked = part.column("id").to_numpy()
                found = tree.search(_matrix(part.column("v"), dim), asked, part.column("floor").to_pylist(), k)
                out = [(int(q), i, s) for q, best in zip(asked, found) for s, i in best]
                if out:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([o[j] for o in out], pa.int64()) for j in range(3)], ["query_id", "vec_id", "score"]
                    )

    ordered = mixed.repartition(*_SHARD).sortWithinPartitions(*_SHARD, "is_query")
    return map_batches(ordered, run, "query_id long, vec_id long, score long")


def _best(found: DataFrame, k: int) -> DataFrame:
    """found with rank, of each query the k best; maps keep k of each before anything is shuffled."""
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).filter(F.col("rank") <= k)


def _fit(vectors: DataFrame, shard_rows: int | None, work: Workspace) -> tuple[dict[int, Upper], DataFrame]:
    """The upper levels for each length, and the vectors (dim, leaf, id, v, row), all of them dealt."""
    counts = {r["dim"]: r["n"] for r in vectors.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    some = min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * max([1, *counts])))
    sample: dict[int, list] = {d: [] for d in counts}
    for r in vectors.orderBy(F.xxhash64("id", "v"), "id").limit(some).collect():
        sample[r["dim"]].append(r["v"])
    rows_of = {d: shard_rows or max(1, SHARD_BYTES // (8 * max(1, d))) for d in counts}
    upper = {}
    for d, rows in sample.items():
        x = np.array(rows, np.float64).reshape(len(rows), d)
        x = x[_norms(x) <= _WIDE] if len(x) else x
        upper[d] = Upper.fit(x, min(MOST_LEAVES, -(-counts[d] // rows_of[d])))

    def deal(batches):
        for b in batches:
            for (dim,), part in _by(b, "dim"):
                x = _floats(part.column("v"), dim)
                leaf = upper[dim].leaves(x)
                with np.errstate(over="ignore", invalid="ignore"):
                    far = _norms(x - upper[dim].centres[leaf])
                far = np.where(np.isnan(far), np.inf, far)
                yield pa.RecordBatch.from_arrays(
                    [part.column("dim"), pa.array(leaf, pa.int32()), part.column("id"), part.column("v"), pa.array(far)], ["dim", "leaf", "id", "v", "far"]
                )

    dealt = map_batches(vectors.select("dim", "id", "v"), deal, "dim int, leaf int, id long, v array<double>, far double")
    dealt = work.table(dealt.withColumn("row", F.monotonically_increasing_id()), "vectors")
    for d, tree in upper.items():
        tree.radii, tree.shards = np.zeros(len(tree.centres)), np.zeros(len(tree.centres), np.int64)
    for r in dealt.groupBy("dim", "leaf").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect():  # at most MOST_LEAVES of a length
        upper[r["dim"]].radii[r["leaf"]] = r["far"] * (1 + 1e-9) + 1e-6
        upper[r["dim"]].shards[r["leaf"]] = -(-r["n"] // rows_of[r["dim"]])
    return upper, dealt


def _routes(asked: DataFrame, upper: dict[int, Upper], blocks: int, wave: int) -> DataFrame:
    """The shards (dim, leaf, part, block) that each of asked (dim, id, v, floor) meets in a wave: the
    first one, those of the next leaves, those of all others."""

    def run(batches):
        for b in batches:
            for (dim,), part in _by(b, "dim"):
                tree, ids, floors = upper[dim], part.column("id").to_numpy(), part.column("floor").to_pylist()
                qf = _floats(part.column("v"), dim)
                with np.errstate(over="ignore", invalid="ignore"):
                    near = np.nan_to_num(qf @ tree.centres.T)
                near[:, tree.shards == 0] = -np.inf
                length = _norms(qf)
                bounds = _bounds(qf, length, tree.centres, tree.radii, float(_norms(tree.centres).max() + tree.radii.max()))
                order = np.argsort(-near, axis=1, kind="stable")
                at, leaf, shard = [], [], []
                for i, q in enumerate(ids.tolist()):
                    home = order[i, 0]
                    own = q % tree.shards[home]
                    if wave == 0:
                        wanted = [(home, own)]
                    else:
                        floor = -np.inf if floors[i] is None else floors[i]
                        leaves = order[i, :NEXT_LEAVES] if wave == 1 else order[i, NEXT_LEAVES:]
                        wanted = [(x, s) for x in leaves.tolist() if bounds[i, x] >= floor for s in range(tree.shards[x]) if (x, s) != (home, own)]
                    at += [i] * len(wanted)
                    leaf += [x for x, _ in wanted]
                    shard += [s for _, s in wanted]
                for k in range(0, len(at), 4096):
                    rows = part.take(pa.array(at[k : k + 4096], pa.int64()))
                    yield pa.RecordBatch.from_arrays(
                        [rows.column("dim"), pa.array(leaf[k : k + 4096], pa.int32()), pa.array(shard[k : k + 4096], pa.int32()), rows.column("id"), rows.column("v"), rows.column("floor")],
                        ["dim", "leaf", "part", "id", "v", "floor"],
                    )

    found = map_batches(asked.select("dim", "id", "v", "floor"), run, "dim int, leaf int, part int, id long, v array<double>, floor long")
    return found.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))


def search(vectors: DataFrame, queries: DataFrame, k: int = TOP, shard_rows: int | None = None, visits: list[int] | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of vectors (id, v) with the largest inner product
    with each of queries (id, v), both as as_integers() gives them. visits, if given, gets the number
    of shards that queries met in each wave there was and the number of all pairs of a query and a shard."""
    spark = vectors.sparkSession
    with Workspace(spark, "topk") as work:
        vectors = work.table(vectors.withColumn("dim", F.size("v")), "given")
        upper, dealt = _fit(vectors, shard_rows, work)
        asked = queries.withColumn("dim", F.size("v")).dropDuplicates(["id", "v"])
        asked = work.table(asked.filter(F.col("dim").isin(*upper)) if upper else asked.limit(0), "queries")
        blocks = max(1, -(-asked.count() // QUERY_BLOCK))
        leaves = [(d, leaf, int(n)) for d, tree in upper.items() for leaf, n in enumerate(tree.shards)]
        shards = spark.createDataFrame(leaves, "dim int, leaf int, shards int")  # at most MOST_LEAVES of a length
        in_shards = dealt.join(F.broadcast(shards), ["dim", "leaf"]).withColumn("part", F.pmod(F.xxhash64("id", "row"), "shards").cast("int"))
        found = spark.createDataFrame([], "query_id long, vec_id long, score long")
        # one shard answers all there is to ask; few leaves leave none for the last wave
        alone = all(tree.shards.sum() <= 1 for tree in upper.values())
        waves = 1 if alone else 2 if all(len(tree.shards) <= NEXT_LEAVES for tree in upper.values()) else 3
        for wave in range(waves):
            kth = _best(found, k).groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("floor")).filter(F.col("n") >= k)
            state = asked.join(kth.select(F.col("query_id").alias("id"), "floor"), "id", "left")
            routes = _routes(state, upper, blocks, wave)
            met = work.table(routes.select(*_SHARD).distinct(), "met")
            if visits is not None:
                visits.append(routes.count())
            rows = join_checked(in_shards, met, ["dim", "leaf", "part"]).select(*_SHARD, F.lit(False).alias("is_query"), "id", "v", F.lit(None).cast("long").alias("floor"))
            mixed = rows.unionByName(routes.select(*_SHARD, F.lit(True).alias("is_query"), "id", "v", "floor"))
            found = work.table(found.unionByName(_search(mixed, k)), "found")
        if visits is not None:
            visits.append(sum(r["n"] * int(upper[r["dim"]].shards.sum()) for r in asked.groupBy("dim").agg(F.count("*").alias("n")).collect()))
        return materialize(_best(found, k).select("query_id", "rank", "vec_id", "score"), "topk")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best of all other rows for each row whose id is divisible by 50."""
    rows = as_integers(table(spark, sf_dir, "embeddings"))
    return search(rows, rows.filter(F.col("id") % 50 == 0))


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= 5
"""
