"""Exact top-k search by distributed histogram selection.

For each block of queries (bounded, so it can be sent to all tasks) everything is scored
in passes over the vectors. The first pass brackets each query's kth score: the largest
kth score of any task bounds it from below, the largest score from above. Global
histograms of the scores in the bracket then narrow it until it holds one value. The last
pass keeps what reaches that value; each task keeps its k first by score and vec_id, so
that any number of ties stays small, and the global order breaks the ties.

Defined results: vectors that are null or hold null or non-finite components, and rows
with a null vec_id, take no part. Vectors of different lengths don't meet. A vec_id that
occurs in several query rows is one query (of the smallest vector, by components);
as candidates repeated rows count each. With fewer than k candidates all are returned;
an empty table returns no rows. Very long vectors are scored whole. Extra columns are
ignored. Scores beyond a long raise an error instead of wrapping around.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, map_arrow, materialize, new_path

K, SCALE = 10, 1024
#: Queries in one block, and bins of one histogram.
BLOCK, BINS = 2048, 512
LOW = -(1 << 63)


def quantised(vectors: DataFrame) -> DataFrame:
    """vec_id and floor(1024 * x) of each component, without the vectors that take no part."""
    whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    used = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & whole)
    return used.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: F.floor(SCALE * x.cast("double"))).alias("v"))


class Queries:
    """A block of queries, by length of their vectors."""

    def __init__(self, rows: list[tuple[int, list[int]]]):
        self.ids = np.array([r[0] for r in rows], np.int64)
        self.of_length: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n in {len(r[1]) for r in rows}:
            at = np.array([i for i, r in enumerate(rows) if len(r[1]) == n])
            self.of_length[n] = at, np.array([rows[i][1] for i in at], np.int64).reshape(len(at), n)

    def scores(self, batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Indexes of queries, ids of vectors, their products, and which of these count (not the query's own)."""
        column = batch.column(1)
        size = np.diff(column.offsets.to_numpy())
        flat, ids = column.flatten().to_numpy(), batch.column(0).to_numpy()
        first = np.cumsum(size) - size
        for n, (at, q) in self.of_length.items():
            for rows in np.array_split(np.flatnonzero(size == n), max(1, (size == n).sum() * len(at) // 2_000_000)):
                if len(rows):
                    v = flat[first[rows][:, None] + np.arange(n)]
                    most = float(np.abs(q).max(initial=0)) * float(np.abs(v).max(initial=0)) * n
                    # object integers are exact; a product beyond a long raises an OverflowError
                    product = (q.astype(float) @ v.T.astype(float)).astype(np.int64) if most < 2**53 else (q.astype(object) @ v.T.astype(object)).astype(np.int64)
                    yield at, ids[rows], product, self.ids[at][:, None] != ids[rows][None, :]


def _bracket(queries: Queries, k: int):
    def bracket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(queries.ids)
        best = np.full((n, k), LOW)
        least = np.full(n, (1 << 63) - 1)
        for batch in batches:
            for at, _, s, other in queries.scores(batch):
                least[at] = np.minimum(least[at], np.where(other, s, (1 << 63) - 1).min(1))
                s = np.concatenate([best[at], np.where(other, s, LOW)], 1)
                best[at] = np.partition(s, s.shape[1] - k, axis=1)[:, -k:]
        some = best.max(1) > LOW
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(some)), pa.array(best.min(1)[some]), pa.array(best.max(1)[some]), pa.array(least[some])], ["q", "low", "high", "least"])

    return bracket


def _histogram(queries: Queries, low: np.ndarray, width: np.ndarray, high: np.ndarray, k: int):
    """Counts of the scores from low to high, in bins of the width; of each task only its k highest scores matter."""

    def histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(queries.ids)
        tally = np.zeros((n, BINS + 1), np.int64)  # the last bin: above the bracket
        for batch in batches:
            for at, _, s, other in queries.scores(batch):
                use = other & (s >= low[at][:, None])
                q, c = np.nonzero(use)
                x = s[q, c]
                bins = np.where(x > high[at][q], BINS, (x - low[at][q]) // width[at][q])
                tally += np.bincount(at[q] * (BINS + 1) + bins, minlength=n * (BINS + 1)).reshape(n, -1)
        above = np.cumsum(tally[:, ::-1], 1)[:, ::-1] - tally
        q, b = np.nonzero((tally > 0) & (above < k))
        yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(b), pa.array(tally[q, b])], ["q", "bin", "n"])

    return histogram


def _winners(queries: Queries, bound: np.ndarray, k: int):
    def winners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [np.zeros((0, 2), np.int64)] * len(queries.ids)
        for batch in batches:
            for at, ids, s, other in queries.scores(batch):
                use = other & (s >= bound[at][:, None])
                for i in np.flatnonzero(use.any(1)):
                    x = np.concatenate([found[at[i]], np.stack([s[i, use[i]], ids[use[i]]], 1)])
                    found[at[i]] = x[np.lexsort((x[:, 1], -x[:, 0]))[:k]]
        x = np.concatenate([np.zeros((0, 2), np.int64), *found])
        q = np.repeat(queries.ids, [len(f) for f in found])
        yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(np.ascontiguousarray(x[:, 1])), pa.array(np.ascontiguousarray(x[:, 0]))], ["query_id", "vec_id", "score"])

    return winners


def _search(vectors: DataFrame, queries: Queries, k: int) -> DataFrame:
    n = len(queries.ids)
    low, high = np.zeros(n, np.int64), np.full(n, -1, np.int64)
    ends = map_arrow(vectors, _bracket(queries, k), "q long, low long, high long, least long").groupBy("q").agg(F.max("low").alias("low"), F.max("high").alias("high"), F.min("least").alias("least"))
    for r in ends.collect():  # a row for each query of the block
        low[r.q], high[r.q] = (r.low if r.low > LOW else r.least), r.high
    while True:
        width = np.maximum(1, -(-(high - low + 1) // BINS))
        if not (high > low).any():
            break
        counted = map_arrow(vectors, _histogram(queries, low, width, high, k), "q long, bin long, n long").groupBy("q", "bin").agg(F.sum("n").alias("n"))
        down = Window.partitionBy("q").orderBy(F.desc("bin"))
        reached = counted.withColumn("total", F.sum("n").over(down)).where(f"total >= {k}").groupBy("q").agg(F.max("bin").alias("bin"))
        was_low, was_high = low.copy(), high.copy()
        for r in reached.collect():
            if r.bin < BINS:
                low[r.q] = was_low[r.q] + r.bin * width[r.q]
                high[r.q] = min(was_high[r.q], low[r.q] + width[r.q] - 1)
        high = np.where((low == was_low) & (high == was_high), low, high)  # fewer than k candidates: all count
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")).cast("int")
    kept = map_arrow(vectors, _winners(queries, low, k), "query_id long, vec_id long, score long")
    return kept.withColumn("rank", rank).where(f"rank <= {k}").select("query_id", "rank", "vec_id", "score")


def top_k(vectors: DataFrame, k: int = K, every: int = 100, block: int = BLOCK) -> DataFrame:
    """vectors (vec_id, embedding, ...): the k best others of each row whose vec_id is divisible by every."""
    spark = vectors.sparkSession
    rows = materialize(quantised(vectors), "quantised")  # every block reads it several times
    asked = materialize(rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v")), "queries")
    blocks = -(-asked.count() // block)
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if not blocks:
        return empty
    path = new_path(spark, "top")
    for b in range(blocks):  # about `block` queries each: a bounded number reaches the driver
        part = [(r.vec_id, list(r.v)) for r in asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).orderBy("vec_id").collect()]
        if part:
            _search(rows, Queries(part), k).write.mode("append").parquet(path)
    discard(rows, asked)
    return spark.read.schema(empty.schema).parquet(path)
