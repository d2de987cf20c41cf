"""Nearest neighbours with a vantage-point tree in every shard.

Vectors are scaled to length 1 (distances order as cosines do). A vantage-point tree over a bounded sample (SAMPLE
vectors) parts the space into leaves of about equal numbers; a leaf's vectors are a shard, or several by a hash of their
ids where they are more than `shard_rows`. Every vector is in a shard, and each shard builds a vantage-point tree of its
own: a node splits its vectors at the median distance from one of them. All queries of a shard go down its tree together,
near side first. A query first searches the shards of its own leaf, which gives it k neighbours and a radius; it then
goes down the tree of the sample with that radius, and visits the shards of all leaves that are left.

Pruning uses the triangle inequality: a side is at least gap = |d(q, vantage) - split| away. It is left out if
factor * gap exceeds the radius. Factor 1 is exact; a larger one prunes more and may miss neighbours. Production takes the
rows with an id divisible by 20 as queries, against all rows.

Of equal vectors more than k + 1 of which there are, only the k + 1 least ids are put in shards: no other can be among
anyone's k nearest. So copies that are a large part of the table don't multiply the work; all of them may be queries.

Defined results: null, empty, zero and non-finite vectors, those with null elements, those of another length than most
have, and rows with a null id are neither queries nor neighbours; ties go to the smaller id; rows with the same id are
one vector (the least in order of its elements); with k or fewer other vectors all are returned; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._text import mix
from ._work import Scratch, SEND_LIMIT

LEAF, SAMPLE = 256, 1 << 14
#: Distances are rounded to 1e-7, so a bound that follows from two of them may be off by a little more.
SLACK = 4e-7
FOUND = "vec_id bigint, rank int, neighbour_id bigint, distance double"
BEST = "vec_id bigint, ids binary, dists binary"
MEMBERS = "shard int, vec_id bigint, vector binary"


class Tree:
    """A vantage-point tree over unit vectors; ids are in ascending order."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, leaf: int = LEAF):
        self.x, self.ids, self.leaf = x, ids, leaf
        self.root = self._build(np.arange(len(x)))

    def _build(self, at: np.ndarray):
        if len(at) <= self.leaf:
            return at
        far = at[np.argmax(distances(self.x[at[:1]], self.x[at])[0])]  # a vector at the rim parts best
        d = distances(self.x[[far]], self.x[at])[0]
        split = float(np.median(d))
        inner = d <= split
        if inner.all():
            return at  # as good as equal
        return int(far), split, self._build(at[inner]), self._build(at[~inner])

    def search(self, q: np.ndarray, own: np.ndarray, best_d: np.ndarray, best_i: np.ndarray, factor: float) -> None:
        """Improves the k best (distance, id) of each query in place; own: the queries' ids, which don't count."""
        stack = [(self.root, np.arange(len(q)), None)]
        while stack:
            node, rows, gap = stack.pop()
            if gap is not None:
                some = factor * gap <= best_d[rows, -1] + factor * SLACK
                rows = rows[some]
            if not len(rows):
                continue
            if isinstance(node, np.ndarray):
                self._scan(node, rows, q, own, best_d, best_i)
                continue
            vantage, split, inner, outer = node
            d = distances(q[rows], self.x[[vantage]])[:, 0]
            near = d <= split
            gap = np.abs(d - split)
            # last in, first out: the near sides come before what may be left of the far ones
            stack.append((inner, rows[~near], gap[~near]))
            stack.append((outer, rows[near], gap[near]))
            stack.append((outer, rows[~near], None))
            stack.append((inner, rows[near], None))

    def _scan(self, at: np.ndarray, rows: np.ndarray, q: np.ndarray, own: np.ndarray, best_d: np.ndarray, best_i: np.ndarray) -> None:
        k = best_d.shape[1]
        for a in range(0, len(at), 1024):
            part = at[a : a + 1024]
            for b in range(0, len(rows), 4096):
                r = rows[b : b + 4096]
                d = distances(q[r], self.x[part])
                d[own[r][:, None] == self.ids[part][None, :]] = np.inf
                some = d.min(1) <= best_d[r, -1]
                r, d = r[some], d[some]
                if not len(r):
                    continue
                if d.shape[1] > k:
                    kth = np.partition(d, k - 1, axis=1)[:, k - 1 : k]
                    # of ties at the k-th distance the first, which have the least ids, come first in a stable sort
                    first = np.argsort(np.where(d <= kth, d, np.inf), axis=1, kind="stable")[:, :k]
                    d, i = np.take_along_axis(d, first, 1), self.ids[part][first]
                else:
                    i = np.broadcast_to(self.ids[part], d.shape)
                all_d, all_i = np.concatenate((best_d[r], d), 1), np.concatenate((best_i[r], i), 1)
                all_i = np.where(np.isinf(all_d), np.iinfo(np.int64).max, all_i)
                order = np.lexsort((all_i, all_d), axis=1)[:, :k]
                best_d[r], best_i[r] = np.take_along_axis(all_d, order, 1), np.take_along_axis(all_i, order, 1)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Between unit vectors, rounded so that equal pairs have equal ones however they are multiplied out."""
    return np.round(np.sqrt(np.maximum(2 - 2 * (a @ b.T), 0)), 7)


class Leaves:
    """The tree over the sample, which only tells leaves apart."""

    def __init__(self, x: np.ndarray, leaf: int):
        self.n = 0
        self.root = self._numbered(Tree(x, np.arange(len(x)), leaf), None)

    def _numbered(self, tree: Tree, node):
        node = tree.root if node is None else node
        if isinstance(node, np.ndarray):
            self.n += 1
            return self.n - 1
        vantage, split, inner, outer = node
        return tree.x[[vantage]], split, self._numbered(tree, inner), self._numbered(tree, outer)

    def visits(self, q: np.ndarray, radius: np.ndarray, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """All (row, leaf) that the radius leaves to a query; with a radius below 0 its own leaf alone."""
        rows, leaves, stack = [], [], [(self.root, np.arange(len(q)))]
        while stack:
            node, at = stack.pop()
            if not len(at):
                continue
            if isinstance(node, int):
                rows.append(at)
                leaves.append(np.full(len(at), node))
                continue
            vantage, split, inner, outer = node
            d = distances(q[at], vantage)[:, 0]
            far = factor * np.abs(d - split) <= radius[at] + factor * SLACK
            far &= radius[at] >= 0
            stack += [(inner, at[(d <= split) | far]), (outer, at[(d > split) | far])]
        return np.concatenate([np.empty(0, np.int64), *rows]), np.concatenate([np.empty(0, np.int64), *leaves])


def _vectors(table) -> np.ndarray:
    raw = [x.as_py() for x in table.column("vector")]
    return np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1) if raw else np.empty((0, 1))


def _usable(batch: pa.RecordBatch, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors at length 1 of those that have one."""
    x = batch.column("vector").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)
    with np.errstate(invalid="ignore", over="ignore"):
        norm = np.sqrt((x * x).sum(1))
    good = np.isfinite(norm) & (norm > 0)
    return batch.column("vec_id").to_numpy(zero_copy_only=False)[good], x[good] / norm[good, None]


def _leaf_counts(sent, size: int):
    def run(batches):
        for batch in batches:
            _, x = _usable(batch, size)
            leaf = sent.value.visits(x, np.full(len(x), -1.0), 1.0)[1]
            n = np.bincount(leaf, minlength=sent.value.n)
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some])], ["leaf", "n"])

    return run


def _placed(sent, size: int):
    """Every vector in its shard."""

    def run(batches):
        leaves, first, parts = sent.value
        for batch in batches:
            ids, x = _usable(batch, size)
            row, leaf = leaves.visits(x, np.full(len(x), -1.0), 1.0)
            shard = first[leaf] + (mix(ids[row].view(np.uint64)) % parts[leaf].astype(np.uint64)).astype(np.int64)
            yield _sent(shard, ids[row], x[row])

    return run


def _sent(shard: np.ndarray, ids: np.ndarray, x: np.ndarray, **more) -> pa.RecordBatch:
    columns = {"shard": pa.array(shard.astype(np.int32)), "vec_id": pa.array(ids.astype(np.int64)), "vector": pa.array([v.tobytes() for v in x], pa.binary())}
    return pa.RecordBatch.from_pydict(columns | more)


def _visits(sent, size: int, factor: float):
    """A query once for each shard that it visits; at first those of its own leaf, then, with its radius, the others."""

    def run(batches):
        leaves, first, parts = sent.value
        for batch in batches:
            if "dists" in batch.schema.names:
                ids, x = batch.column("vec_id").to_numpy(), _vectors(batch)
                far = np.array([np.frombuffer(v.as_py(), np.float64)[-1] for v in batch.column("dists")])
                row, leaf = leaves.visits(x, far, factor)
                own = np.empty(len(x), np.int64)
                at, home = leaves.visits(x, np.full(len(x), -1.0), 1.0)
                own[at] = home
                row, leaf = row[leaf != own[row]], leaf[leaf != own[row]]
            else:
                ids, x = _usable(batch, size)
                far = np.full(len(x), np.inf)
                row, leaf = leaves.visits(x, np.full(len(x), -1.0), 1.0)
            n = parts[leaf]
            shard = np.repeat(first[leaf] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
            row = np.repeat(row, n)
            for a in range(0, len(row), 1 << 14):
                r = row[a : a + (1 << 14)]
                yield _sent(shard[a : a + (1 << 14)], ids[r], x[r], far=pa.array(far[r]))

    return run


def _blank(n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    return np.full((n, k), np.inf), np.full((n, k), np.iinfo(np.int64).max)


def _found(ids: np.ndarray, d: np.ndarray, i: np.ndarray, x: np.ndarray) -> pa.Table:
    blob = lambda rows: pa.array([v.tobytes() for v in rows], pa.binary())
    return pa.table({"vec_id": pa.array(ids, pa.int64()), "ids": blob(i), "dists": blob(d), "vector": blob(x)})


def _searched(k: int, factor: float):
    """The k best of a shard for each query that visits it."""

    def run(members: pa.Table, visitors: pa.Table) -> pa.Table:
        if not members.num_rows or not visitors.num_rows:
            return _found(np.empty(0, np.int64), *[np.empty((0, 1))] * 3)
        ids = members.column("vec_id").to_numpy()
        order = np.argsort(ids, kind="stable")
        tree, q, own = Tree(_vectors(members)[order], ids[order]), _vectors(visitors), visitors.column("vec_id").to_numpy()
        d, i = _blank(len(q), k)
        # the radius so far bounds the search; those neighbours come from elsewhere, so their ids aren't needed
        d[:] = np.nextafter(visitors.column("far").to_numpy(), np.inf)[:, None]
        tree.search(q, own, d, i, factor)
        return _found(own, d, i, q)

    return run


def _best(k: int):
    def run(table: pa.Table) -> pa.Table:
        who = table.column("vec_id").to_numpy()
        d = np.frombuffer(b"".join(x.as_py() for x in table.column("dists")), np.float64)
        i = np.frombuffer(b"".join(x.as_py() for x in table.column("ids")), np.int64)
        who = np.repeat(who, k)
        real = i != np.iinfo(np.int64).max
        who, d, i = who[real], d[real], i[real]
        order = np.lexsort((i, d, who))
        who, d, i = who[order], d[order], i[order]
        first = np.flatnonzero(np.concatenate(([True], who[1:] != who[:-1]))) if len(who) else np.empty(0, np.int64)
        rank = np.arange(len(who)) - np.repeat(first, np.diff(np.append(first, len(who))))
        top = rank < k
        return pa.table({"vec_id": who[top], "rank": (rank[top] + 1).astype(np.int32), "neighbour_id": i[top], "distance": d[top]})

    return run


def _merged(k: int):
    """Of what several shards found for a query the k best, in order."""

    def run(table: pa.Table) -> pa.Table:
        best = _best(k)(table)
        who, n = np.unique(best.column("vec_id").to_numpy(), return_counts=True)
        every, first = np.unique(table.column("vec_id").to_numpy(), return_index=True)
        d, i = _blank(len(every), k)
        row = np.repeat(np.searchsorted(every, who), n)
        at = best.column("rank").to_numpy() - 1
        d[row, at], i[row, at] = best.column("distance").to_numpy(), best.column("neighbour_id").to_numpy()
        return _found(every, d, i, _vectors(table.take(pa.array(first))))

    return run


def nearest(vectors: DataFrame, k: int = 10, factor: float = 1.0, shard_rows: int = 8192, vec_id: str = "vec_id", vector: str = "embedding", every: int = 1, send_limit: int = SEND_LIMIT) -> DataFrame:
    """The k nearest other vectors of every vector whose id is divisible by `every`: vec_id, rank from 1, neighbour_id and distance."""
    if k < 1 or factor < 1 or every < 1:
        raise ValueError("k, factor and every are at least 1")
    spark = vectors.sparkSession
    scratch = Scratch(spark, "neighbours")
    source = vectors.select(F.col(vec_id).alias("vec_id"), F.col(vector).cast("array<double>").alias("vector")).where("vec_id IS NOT NULL AND vector IS NOT NULL")
    size = source.groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), "size").first()
    if size is None or not size.size:
        return spark.createDataFrame([], FOUND)
    size = size.size
    source = source.where((F.size("vector") == size) & F.forall("vector", lambda x: x.isNotNull()))
    if not source.groupBy("vec_id").count().where("count > 1").isEmpty():
        source = source.groupBy("vec_id").agg(F.min("vector").alias("vector"))
    queries = source.where(F.pmod("vec_id", F.lit(every)) == 0)
    # of many equal vectors the k + 1 with the least ids; rows are limited before they are shuffled
    many = source.groupBy(F.xxhash64("vector").alias("hash")).count().where(F.col("count") > k + 1).select("hash")
    if (heavy := many.count()) > 0:
        many, hashed = (F.broadcast(many) if heavy * 16 <= send_limit else many), source.withColumn("hash", F.xxhash64("vector"))
        first = F.row_number().over(Window.partitionBy("hash", "vector").orderBy("vec_id"))
        few = hashed.join(many, "hash", "left_semi").withColumn("place", first).where(F.col("place") <= k + 1)
        source = scratch.keep(hashed.join(many, "hash", "left_anti").select("vec_id", "vector").unionByName(few.select("vec_id", "vector")), "indexed")
    count = source.count()
    sample = source.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toArrow()
    sample = np.concatenate([np.empty((0, size)), *(_usable(b, size)[1] for b in sample.to_batches())])
    leaves = Leaves(sample, max(8, len(sample) // max(1, -(-count // shard_rows))))
    counts = source.mapInArrow(_leaf_counts(spark.sparkContext.broadcast(leaves), size), "leaf bigint, n bigint").groupBy("leaf").agg(F.sum("n").alias("n"))
    parts = np.ones(leaves.n, np.int64)
    for r in counts.collect():  # a number for each leaf, of which there are at most SAMPLE / 8
        parts[r.leaf] = -(-r.n // shard_rows)
    sent = spark.sparkContext.broadcast((leaves, np.cumsum(parts) - parts, parts))
    shards = int(parts.sum())
    member = scratch.keep(source.mapInArrow(_placed(sent, size), MEMBERS), "members")

    def searched(visitors: DataFrame) -> DataFrame:
        a, b = (x.repartition(shards, "shard").groupBy("shard") for x in (member, visitors))
        return a.cogroup(b).applyInArrow(_searched(k, factor), f"{BEST}, vector binary")

    def by_query(rows: DataFrame):
        return rows.withColumn("group", F.pmod(F.xxhash64("vec_id"), F.lit(max(4, shards)))).groupBy("group")

    visits = "shard int, vec_id bigint, vector binary, far double"
    home = searched(queries.mapInArrow(_visits(sent, size, factor), visits))
    if (parts > 1).any():
        home = by_query(home).applyInArrow(_merged(k), f"{BEST}, vector binary")
    home = scratch.keep(home, "home")
    out = home.select("vec_id", "ids", "dists")
    if leaves.n > 1:
        out = out.unionByName(searched(home.mapInArrow(_visits(sent, size, factor), visits)).select("vec_id", "ids", "dists"))
    return by_query(out).applyInArrow(lambda t: _best(k)(t), FOUND)


#: Production's pruning factor; recall against brute force is in the README.
FACTOR = 3.0
#: Production's queries are the rows whose id this divides.
EVERY = 20


def op1_vptree_neighbours(spark, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), factor=FACTOR, every=EVERY)


def op1_vptree_neighbours_exact(spark, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), every=EVERY)


ORACLE_EXACT = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
u AS (SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS e FROM v),
d AS (SELECT a.vec_id, b.vec_id AS neighbour_id, round(sqrt(greatest(2 - 2 * list_dot_product(a.e, b.e), 0)), 7) AS distance FROM u a JOIN u b ON a.vec_id <> b.vec_id AND a.vec_id % 20 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY distance, neighbour_id) AS INTEGER) AS rank FROM d)
SELECT vec_id, rank, neighbour_id, distance FROM r WHERE rank <= 10"""
