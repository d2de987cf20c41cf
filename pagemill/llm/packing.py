"""Packing by optimal length buckets.

A document's length is its number of words between white space. The histogram of all lengths goes to the driver, where
dynamic programming chooses the bucket bounds with the least padding in all; as the cost of a bucket satisfies the
quadrangle inequality, each layer is solved by divide and conquer, all subproblems of a level at once. Within a bucket,
batches of budget // bound documents are formed in order of length and doc_id. Buckets of many documents are cut into
shards by doc_id, each sorted on its own, so no task sorts more than about per_shard documents.

Defined results: null, empty and blank texts have length 0 and ride in the first bucket; a document longer than the
budget is a batch of its own and stays whole; of bounds with equal padding those with the smaller last-but-one bounds
are taken; rows that repeat are packed each, rows equal in length and doc_id in any order among themselves; null doc_ids
belong to shard 0 and come first; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._work import Scratch

BUCKETS, BUDGET, PER_SHARD = 8, 16384, 1 << 16
WORD = r"[^ \t\n\r\f]+"


def _layer(before: np.ndarray, length: np.ndarray, upto: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best cost and split of the first j lengths, for all j, with one bucket more than in `before`."""
    n = len(length)
    best, split = np.full(n + 1, np.iinfo(np.int64).max // 4), np.zeros(n + 1, np.int64)
    best[0] = 0
    lo, hi, first, last = (np.array([x]) for x in (1, n, 0, n - 1))
    while len(lo):
        mid = (lo + hi) // 2
        end = np.minimum(last, mid - 1)
        count = end - first + 1
        j = np.repeat(mid, count)
        starts = np.cumsum(count) - count
        i = np.arange(len(j)) - np.repeat(starts - first, count)
        cost = before[i] + length[j - 1] * (upto[j] - upto[i])
        least = np.minimum.reduceat(cost, starts)
        at = np.flatnonzero(cost == np.repeat(least, count))
        group = np.searchsorted(starts, at, "right") - 1
        chosen = i[at[np.searchsorted(group, np.arange(len(mid)))]]
        best[mid], split[mid] = least, chosen
        parts = [(lo, mid - 1, first, chosen), (mid + 1, hi, chosen, last)]
        lo, hi, first, last = (np.concatenate(x) for x in zip(*parts))
        some = lo <= hi
        lo, hi, first, last = lo[some], hi[some], first[some], last[some]
    return best, split


def bounds(length: np.ndarray, count: np.ndarray, buckets: int = BUCKETS) -> list[int]:
    """Upper bounds of at most so many buckets that need the least padding, for different lengths in ascending order."""
    n = len(length)
    if n <= buckets:
        return length.tolist()
    length = length.astype(np.int64)
    upto = np.concatenate(([0], np.cumsum(count.astype(np.int64))))
    cost = np.concatenate(([0], length * upto[1:]))
    splits = []
    for _ in range(buckets - 1):
        cost, split = _layer(cost, length, upto)
        splits.append(split)
    out, j = [], n
    for split in reversed(splits):
        if not j:
            break
        out.append(int(length[j - 1]))
        j = int(split[j])
    if j:
        out.append(int(length[j - 1]))
    return out[::-1]


def _by_bucket(cases: list, key: Column, values: list) -> Column:
    out = F.lit(values[-1])
    for b, v in reversed(list(zip(cases, values))[:-1]):
        out = F.when(key <= b, v).otherwise(out)
    return out


def pack(docs: DataFrame, buckets: int = BUCKETS, budget: int = BUDGET, per_shard: int = PER_SHARD) -> DataFrame:
    """Every document's bucket, shard, batch and place in the batch. Only ids and lengths are shuffled."""
    scratch = Scratch(docs.sparkSession, "packing")
    n = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint")
    sized = scratch.keep(docs.select("doc_id", n.alias("n_tokens")), "sizes")
    hist = sized.groupBy("n_tokens").agg(F.count("*").alias("docs")).orderBy("n_tokens").toArrow()
    length, count = (hist.column(k).to_numpy() for k in ("n_tokens", "docs"))
    if not len(length):
        return sized.selectExpr("doc_id", "n_tokens", "0L AS bound", "0L AS shard", "0L AS batch", "0L AS place")
    ends = bounds(length, count, buckets)
    per = np.bincount(np.searchsorted(ends, length), count, len(ends)).astype(int)
    room = [max(1, budget // max(1, b)) for b in ends]
    shards = [max(1, -(-int(k) // per_shard)) for k in per]
    size = F.col("n_tokens")
    placed = sized.withColumn("bound", _by_bucket(ends, size, ends).cast("bigint"))
    placed = placed.withColumn("shard", F.coalesce(F.pmod("doc_id", _by_bucket(ends, size, shards)), F.lit(0)).cast("bigint"))
    row = F.row_number().over(Window.partitionBy("bound", "shard").orderBy("n_tokens", "doc_id")).cast("bigint") - 1
    fit = _by_bucket(ends, size, room).cast("bigint")
    return placed.withColumn("row", row).select("doc_id", "n_tokens", "bound", "shard", F.floor(F.col("row") / fit).cast("bigint").alias("batch"), (F.col("row") % fit).alias("place"))


def op7_bucket_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def oracle(source: str = "documents", buckets: int = BUCKETS, budget: int = BUDGET, per_shard: int = PER_SHARD) -> str:
    """The same in SQL: one step of the dynamic program for each bucket, then back along the splits."""
    parts = [
        rf"""WITH s AS MATERIALIZED (SELECT doc_id, CAST(coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS BIGINT) AS n_tokens FROM {source}),
h AS MATERIALIZED (SELECT n_tokens AS l, row_number() OVER (ORDER BY n_tokens) AS j, CAST(sum(count(*)) OVER (ORDER BY n_tokens) AS BIGINT) AS upto FROM s GROUP BY n_tokens),
z AS (SELECT 0 AS j, CAST(0 AS BIGINT) AS upto UNION ALL SELECT j, upto FROM h),
d1 AS MATERIALIZED (SELECT j, l * upto AS cost, 0 AS i FROM h UNION ALL SELECT 0, 0, 0)"""
    ]
    for k in range(2, buckets + 1):
        parts.append(f"""d{k} AS MATERIALIZED (SELECT h.j, min(p.cost + h.l * (h.upto - z.upto)) AS cost, arg_min(p.j, (p.cost + h.l * (h.upto - z.upto), p.j)) AS i
FROM h JOIN d{k - 1} p ON p.j < h.j JOIN z ON z.j = p.j GROUP BY h.j UNION ALL SELECT 0, 0, 0)""")
    parts.append(f"b{buckets} AS (SELECT max(j) AS j FROM h)")
    for k in range(buckets, 1, -1):
        parts.append(f"b{k - 1} AS (SELECT d.i AS j FROM b{k} b JOIN d{k} d ON d.j = b.j)")
    every = " UNION ".join(f"SELECT j FROM b{k}" for k in range(1, buckets + 1))
    return (
        ",\n".join(parts)
        + f""",
e AS MATERIALIZED (SELECT l AS bound FROM h WHERE (SELECT count(*) FROM h) <= {buckets} OR j IN ({every})),
a AS (SELECT doc_id, n_tokens, (SELECT min(bound) FROM e WHERE bound >= n_tokens) AS bound FROM s),
c AS (SELECT *, count(*) OVER (PARTITION BY bound) AS docs FROM a),
g AS (SELECT *, CAST(coalesce((doc_id % k + k) % k, 0) AS BIGINT) AS shard FROM (SELECT *, (docs + {per_shard - 1}) // {per_shard} AS k FROM c)),
r AS (SELECT *, row_number() OVER (PARTITION BY bound, shard ORDER BY n_tokens, doc_id NULLS FIRST) - 1 AS row, greatest(1, {budget} // greatest(1, bound)) AS fit FROM g)
SELECT doc_id, n_tokens, bound, shard, CAST(row // fit AS BIGINT) AS batch, CAST(row % fit AS BIGINT) AS place FROM r"""
    )
