"""Exact top-k inner products by columnar branch and bound.

Candidates lie in vertical layout: one contiguous row for each dimension. For a query, partial products accumulate
block of dimensions by block; what the rest can still add is at most the product of the two remaining norms (Cauchy-
Schwarz). The k-th best lower bound is the threshold, candidates whose upper bound is below it go, and the survivors'
partial products are compacted before the next block. What survives all blocks has its exact integer score.

Rows are dealt by hash of their id and vector into blocks of bounded size, and each block of queries meets each block of
candidates in one task. Tasks report k rows for each query; a ranked window with a limit before its shuffle merges
them. The number of queries and of candidates a task holds never grows with the table.

Edge cases: vectors null or holding null or non-finite components and rows with a null id take no part; a missing
dimension counts as zero; every row is a candidate for every query of another id, also rows that share an id, and all
rows of a query's id rank together; equal scores rank by the smaller id; a query with fewer candidates returns them all;
an empty table gives no rows. Scores are exact: blocks whose scores could pass 2^53, where float64 is no longer, are
computed in Python's integers, and what a long can't hold becomes the nearest long.
"""

from __future__ import annotations

import heapq
import operator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CANDIDATES, QUERIES = 8192, 4096
DIMENSIONS = 8
#: Whole numbers below it are exact in float64, and so are their sums.
EXACT = float(1 << 53)


def top_k(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int):
    """(query id, id, score) of the k best candidates of each query; all values are whole numbers in float64."""
    width = vectors.shape[1]
    if width and len(ids) and len(query_ids) and np.sqrt(np.square(queries).sum(axis=1).max()) * np.sqrt(np.square(vectors).sum(axis=1).max()) >= EXACT:
        return _top_k_of_large(queries, query_ids, vectors, ids, k)
    order = np.argsort(-np.square(vectors).sum(axis=0), kind="stable")  # heavy dimensions first, so bounds tighten early
    columns = np.ascontiguousarray(vectors.T[order])
    queries = queries[:, order]
    cuts = list(range(0, width, DIMENSIONS)) + [width]
    rest = np.zeros((len(cuts), len(ids)))
    for b in range(len(cuts) - 2, -1, -1):
        rest[b] = rest[b + 1] + np.square(columns[cuts[b] : cuts[b + 1]]).sum(axis=0)
    rest = np.sqrt(rest)
    out = ([], [], [])
    for query_id, q in zip(query_ids.tolist(), queries):
        alive = np.flatnonzero(ids != query_id)
        partial = np.zeros(len(alive))
        norms = np.sqrt(np.append(np.cumsum(np.square(q)[::-1])[::-1], 0.0)) if width else np.zeros(1)
        threshold = -np.inf
        for b in range(len(cuts) - 1):
            block = columns[cuts[b] : cuts[b + 1]]
            partial = partial + q[cuts[b] : cuts[b + 1]] @ (block if len(alive) == block.shape[1] else block[:, alive])
            slack = norms[cuts[b + 1]] * rest[b + 1][alive]
            slack += 1e-9 * (slack + np.abs(partial)) + (1e-6 if cuts[b + 1] < width else 0)  # rounding of the roots
            if len(alive) > k:
                threshold = max(threshold, np.partition(partial - slack, len(alive) - k)[len(alive) - k])
                kept = partial + slack >= threshold
                alive, partial = alive[kept], partial[kept]
        best = np.lexsort((ids[alive], -partial))[:k]
        out[0].append(np.full(len(best), query_id, np.int64))
        out[1].append(ids[alive[best]])
        out[2].append(partial[best].astype(np.int64))
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in out)


def _top_k_of_large(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int):
    rows = []
    whole = [[int(x) for x in v] for v in vectors]
    for query_id, q in zip(query_ids.tolist(), queries):
        q = [int(x) for x in q]
        best = heapq.nsmallest(k, ((-sum(map(operator.mul, q, v)), i) for i, v in zip(ids.tolist(), whole) if i != query_id))
        rows += [(query_id, i, max(-(1 << 63), min((1 << 63) - 1, -s))) for s, i in best]
    return tuple(np.array(x, np.int64) for x in zip(*rows)) if rows else (np.zeros(0, np.int64),) * 3


def _matrix(lists: pa.ChunkedArray, width: int) -> np.ndarray:
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    out = np.zeros((len(lists), width))
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    sizes = np.diff(lists.offsets.to_numpy())
    if len(flat) == out.size and (sizes == width).all():
        return flat.reshape(out.shape).astype(np.float64)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def exact_top_k(vectors: DataFrame, is_query, k: int = 5, key: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score. ``is_query``: a function from the key column to the condition that a row is a query."""
    spark = vectors.sparkSession
    whole = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v")).where("id IS NOT NULL AND v IS NOT NULL AND forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity'))")
    whole = whole.select("id", F.transform("v", lambda x: F.when(F.abs(F.lit(scale) * x.cast("double")) < EXACT, F.floor(F.lit(scale) * x.cast("double")).cast("double")).otherwise(F.lit(scale) * x.cast("double"))).alias("v"))
    counts = whole.agg(F.count("*").alias("n"), F.count_if(is_query(F.col("id"))).alias("q")).head()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    groups = max(1, -(-counts["n"] // CANDIDATES), min(parts, counts["n"] // 1024))
    sides = max(1, -(-counts["q"] // QUERIES))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    candidates = whole.withColumn("g", F.pmod(F.xxhash64("id", "v"), F.lit(groups)).cast("int")).withColumn("h", every(sides))
    queries = whole.where(is_query(F.col("id"))).withColumn("h", F.pmod(F.xxhash64("id", "v", F.lit(1)), F.lit(sides)).cast("int")).withColumn("g", every(groups))

    def search(asked: pa.Table, among: pa.Table) -> pa.Table:
        names = ["query_id", "vec_id", "score"]
        if not asked.num_rows or not among.num_rows:
            return pa.table([pa.array([], pa.int64())] * 3, names)
        width = max(int(pc.max(pc.list_value_length(t["v"])).as_py()) for t in (asked, among))
        sides = []
        for t in (asked, among):
            sides += [_matrix(t["v"], width), t["id"].to_numpy()]
        return pa.table([pa.array(x) for x in top_k(*sides, k)], names)

    found = queries.groupBy("g", "h").cogroup(candidates.groupBy("g", "h")).applyInArrow(search, "query_id long, vec_id long, score long")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
