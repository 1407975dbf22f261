"""Quality classification by nearest-neighbour voting in a latent semantic space.

Texts are bags of hashed words, of hashed shape n-grams (case, digits, white space and
signs; letters are folded), and of word repetitions. TF-IDF and a truncated SVD, fitted on
a bounded sample of labelled rows, give latent vectors: words that keep company with the
same words and shapes come to lie together. The vectors of the sample are broadcast (their
number is bounded by ROWS_PER_CLASS), the cosine of every document with all of them is
computed exactly in blocks, and the nearest ones vote with their similarity.

Defined results: null and empty texts have no features; their score is the share of
label 1 among the labelled training rows (0.5 without labels). Very long texts are counted
whole. Ties for the last neighbour's place go to either. Labels with null quality or
without a document teach nothing; repeated rows return (and teach as) repeated rows;
an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow
from .grams import SHAPES, counts, repeats, unit, word_counts
from .textops import chunks, strings

#: Bound of the training sample, and the method's parameters: dimensions of shapes and of words, rank, neighbours, power of the similarity.
ROWS_PER_CLASS, SHAPE_DIM, WORD_DIM, SIZES, RANK, NEIGHBOURS, POWER = 1500, 1024, 1024, (1, 2, 3), 60, 21, 6
#: Columns of shapes with the two of repetitions, then of words.
SPLIT = SHAPE_DIM + 2
PREDICT_AT = 0.3


def features(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
    """Row ranges with term counts: shape n-grams, repeated words, words."""
    offsets, data = strings(column)
    for i, j in chunks(offsets):
        x = counts(data, offsets[i : j + 1], SHAPES, SIZES, SHAPE_DIM)
        r = repeats(data, offsets[i : j + 1])
        # as many as there are bytes, so that repetition weighs against n-grams
        per_word = x.sum(1) / np.maximum(r[:, 0], 1) / 2
        extra = np.stack([r[:, 1] * per_word, r[:, 2] * per_word], 1)
        yield i, j, np.hstack([x, extra, word_counts(data, offsets[i : j + 1], WORD_DIM)])


def leading_axes(w: np.ndarray, rank: int) -> np.ndarray:
    """The first right singular vectors, by subspace iteration with a fixed start."""
    q = np.random.RandomState(7).standard_normal((w.shape[1], min(rank + 20, *w.shape)))
    for _ in range(8):
        q, _ = np.linalg.qr(w.T @ (w @ q))
    _, _, v = np.linalg.svd(w @ q, full_matrices=False)
    return (q @ v.T)[:, :rank]


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, x in features(batch.column(2)):
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array([r.tobytes() for r in x.astype(np.float32)], pa.binary())], ["h", "quality", "x"])


class Model:
    def __init__(self, idf: np.ndarray, axes: np.ndarray, vectors: np.ndarray, quality: np.ndarray, prior: float):
        self.idf, self.axes, self.vectors, self.quality, self.prior = idf, axes, vectors, quality, prior

    @staticmethod
    def weigh(x: np.ndarray, idf: np.ndarray) -> np.ndarray:
        """Shapes and words weigh alike."""
        parts = []
        for part, f in ((x[:, :SPLIT], idf[:SPLIT]), (x[:, SPLIT:], idf[SPLIT:])):
            total = part.sum(1, keepdims=True)
            parts.append(unit(np.sqrt(part / np.where(total > 0, total, 1)) * f))
        return unit(np.hstack(parts))

    @classmethod
    def fit(cls, x: np.ndarray, quality: np.ndarray, prior: float) -> Model:
        idf = np.log((1 + len(x)) / (1 + (x > 0).sum(0))) + 0.3
        w = cls.weigh(x, idf)
        axes = leading_axes(w, RANK)
        return cls(idf, axes, unit(w @ axes).astype(np.float32), quality.astype(float), prior)

    def score(self, x: np.ndarray) -> np.ndarray:
        v = unit(self.weigh(x, self.idf) @ self.axes).astype(np.float32)
        out = np.empty(len(v))
        k = min(NEIGHBOURS, len(self.vectors))
        share = self.quality.mean()
        balance = np.where(self.quality > 0, self.prior / max(share, 1e-9), (1 - self.prior) / max(1 - share, 1e-9))
        for s in range(0, len(v), 512):  # blocks bound the matrix of products
            p = v[s : s + 512] @ self.vectors.T
            near = np.argpartition(-p, k - 1, axis=1)[:, :k]
            w = np.maximum(np.take_along_axis(p, near, 1), 0) ** POWER * balance[near]
            total = w.sum(1)
            out[s : s + 512] = np.where(total > 0, (w * self.quality[near]).sum(1) / np.where(total > 0, total, 1), self.prior)
        out[x.sum(1) == 0] = self.prior
        return np.clip(out, 0, 1)


def train(docs: DataFrame, labels: DataFrame, rows_per_class: int = ROWS_PER_CLASS) -> Model | None:
    """Fits on at most rows_per_class rows of each label."""
    key = F.col("doc_id").cast("long").alias("doc_id")
    known = labels.select(key, F.col("quality").cast("int").alias("quality")).where("quality in (0, 1) and doc_id is not null and pmod(crc32(cast(doc_id as string)), 5) <> 0")
    n = {r.quality: r.n for r in known.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    if not n:
        return None
    h = F.xxhash64("doc_id", F.lit("quality"))
    chosen = [known.where(F.col("quality") == q).withColumn("h", h).orderBy("h", "doc_id").limit(rows_per_class) for q in sorted(n)]
    few = chosen[0] if len(chosen) == 1 else chosen[0].unionByName(chosen[1])
    texts = docs.select(key, "text").join(F.broadcast(few), "doc_id")  # at most 2 * rows_per_class rows
    got = map_arrow(texts.select("h", "quality", "text"), _examples, "h long, quality int, x binary").orderBy("h").limit(4 * rows_per_class).collect()
    if not got:
        return None
    return Model.fit(np.stack([np.frombuffer(r.x, np.float32) for r in got]).astype(float), np.array([r.quality for r in got]), n.get(1, 0) / sum(n.values()))


def _score(model: Model | None):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.full(batch.num_rows, 0.5)
            if model is not None:
                for i, j, x in features(batch.column(1)):
                    out[i:j] = model.score(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out)], ["doc_id", "score"])

    return score


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    out = map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), _score(train(docs, labels)), "doc_id long, score double")
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= PREDICT_AT).cast("int").alias("predicted"))
