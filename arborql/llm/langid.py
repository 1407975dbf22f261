"""Language identification by error-correcting output codes.

Each language gets a codeword; one binary classifier over hashed letter n-grams predicts
each bit. Decoding takes the language whose codeword has the least loss, each bit's loss
weighted by how well its classifier does on the training rows; if the runner-up is nearly
as close, the row is flagged as ambiguous.

Defined results: null text, or text without a letter: `und`, score 0. Rows with a null
lang teach nothing but are predicted like all others. Without any training rows every
prediction is `und`, and an empty table gives no rows. Very long texts are counted whole.
Ties go to the language whose name sorts first, and count as ambiguous. Repeated rows
return (and teach as) repeated rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, materialize
from .grams import LETTERS, counts, unit
from .textops import chunks, strings

#: Bounds of the training sample: rows for each language (every language is learned), and tasks that sum them up.
ROWS_PER_LANGUAGE, TASKS = 400, 32
DIM, SIZES, BITS, RIDGE, BLOCK = 2048, (1, 2, 3), 24, 1e-3, 64
#: A prediction is ambiguous if the runner-up's share of the two best is above this.
AMBIGUOUS = 0.48


def features(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
    offsets, data = strings(column)
    for i, j in chunks(offsets):
        x = np.sqrt(counts(data, offsets[i : j + 1], LETTERS, SIZES, DIM))
        yield i, j, unit(x)


def has_letter(column: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.match_substring_regex(column, r"\p{L}"), False).to_numpy(zero_copy_only=False)


def code_bits(n: int) -> int:
    """Bits of the codewords of n languages: BITS for up to 16, and 6 more for each doubling, to keep them apart."""
    return max(BITS, 6 * math.ceil(math.log2(max(n, 2))))


def codewords(n: int, bits: int = BITS) -> np.ndarray:
    """n x bits of -1 and 1: distinct rows, columns neither constant nor equal or opposite to another while such exist."""
    random, best, far = np.random.RandomState(n), None, -1
    for _ in range(300):
        code = np.where(random.rand(n, bits) < 0.5, -1, 1)
        for c in range(bits):
            if abs(code[:, c].sum()) == n and n > 1:
                code[random.randint(n), c] *= -1
        apart = min([bits, *((code[a] != code[b]).sum() for a in range(min(n, 40)) for b in range(a))])
        if apart > far:
            best, far = code, apart
    return best


def _sums(rows: dict):
    """lang, text -> blocks of the rows of X'WX and X'WY beside each other, X with a column of ones; rows: codeword and weight by lang."""
    bits = len(next(iter(rows.values()))[0])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = np.zeros((DIM + 1, DIM + 1 + bits))
        some = False
        for batch in batches:
            mine = [rows[k] for k in batch.column(0).to_pylist()]
            for i, j, x in features(batch.column(1)):
                some = True
                x = np.hstack([x, np.ones((len(x), 1))])
                xw = x * np.array([w for _, w in mine[i:j]])[:, None]
                both += xw.T @ np.hstack([x, np.array([c for c, _ in mine[i:j]])])
        for k in range(0, len(both) if some else 0, BLOCK):
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([both[k : k + BLOCK].tobytes()], pa.binary())], ["k", "part"])

    return sums


def _add(group: pa.Table) -> pa.Table:
    total = 0
    for part in group.column("part"):
        total = total + np.frombuffer(part.as_py())
    return pa.table({"k": group.column("k").slice(0, 1).combine_chunks(), "part": pa.array([total.tobytes()], pa.binary())})


def _right(rows: dict, w: np.ndarray):
    """lang, text -> for each bit, how many rows its classifier gets right."""

    def right(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits = np.zeros(w.shape[1])
        for batch in batches:
            code = [rows[k][0] for k in batch.column(0).to_pylist()]
            for i, j, x in features(batch.column(1)):
                hits += ((x @ w[:-1] + w[-1]) * np.array(code[i:j]) > 0).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array([hits.tolist()], pa.list_(pa.float64()))], ["right"])

    return right


class Model:
    def __init__(self, languages: list[str], code: np.ndarray, weights: np.ndarray, trust: np.ndarray):
        self.languages, self.code, self.weights, self.trust = languages, code, weights, trust

    @classmethod
    def fit(cls, sample: DataFrame) -> Model | None:
        """sample: lang, text. Ridge regression on sums that the executors make: no row comes to the driver."""
        tally = {r.lang: r["count"] for r in sample.groupBy("lang").count().collect()}
        if not tally:
            return None
        names = sorted(tally)
        code = codewords(len(names), code_bits(len(names)))
        rows = {k: (code[i], 1 / tally[k]) for i, k in enumerate(names)}  # languages count alike
        dealt = sample.repartition(min(TASKS, -(-sum(tally.values()) // 1000)))
        sums = map_arrow(dealt, _sums(rows), "k int, part binary").groupBy("k").applyInArrow(_add, "k int, part binary")
        both = np.vstack([np.frombuffer(r.part).reshape(-1, DIM + 1 + code.shape[1]) for r in sorted(sums.collect(), key=lambda r: r.k)])
        gram = both[:, : DIM + 1]
        w = np.linalg.solve(gram + RIDGE * np.trace(gram) / len(gram) * np.eye(len(gram)), both[:, DIM + 1 :])
        hits = np.array([r.right for r in map_arrow(dealt, _right(rows, w), "right array<double>").collect()]).sum(0)
        right = hits / sum(tally.values())
        trust = np.log((right + 1e-3) / (1 - right + 1e-3))
        return cls(names, code, w, np.maximum(trust, 0) / max(np.maximum(trust, 0).sum(), 1e-9))

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best language, its score, and the runner-up's share of the two best."""
        out = x @ self.weights[:-1] + self.weights[-1]
        loss = (np.exp(-out) * self.trust) @ (self.code.T > 0) + (np.exp(out) * self.trust) @ (self.code.T < 0)
        p = np.exp(-6 * (loss - loss.min(1, keepdims=True)))
        p /= p.sum(1, keepdims=True)
        two = np.sort(p, 1)[:, -2:] if p.shape[1] > 1 else np.hstack([np.zeros((len(p), 1)), p])
        return p.argmax(1), p.max(1), two[:, 0] / two.sum(1)


def train(docs: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE) -> Model | None:
    """Fits on a sample of about rows_per_language rows of every language (all rows of one that has fewer)."""
    known = docs.where("lang is not null and coalesce(pmod(crc32(cast(doc_id as string)), 4), 0) <> 2 and text rlike '[\\\\p{L}]'")
    h = F.pmod(F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id", F.lit("langid"))).otherwise(F.xxhash64("text", F.lit("langid"))), F.lit(1 << 30))
    cuts = known.groupBy("lang").agg((F.least(F.lit(1.0), rows_per_language / F.count("*")) * (1 << 30)).alias("cut"))
    sample = known.select("lang", "text", h.alias("h")).join(F.broadcast(materialize(cuts, "langid-cuts")), "lang").where("h < cut")
    return Model.fit(materialize(sample.select("lang", "text"), "langid-sample"))


def _predict(model: Model | None):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            lang, score, close = np.full(n, "und", object), np.zeros(n), np.ones(n)
            letter = has_letter(batch.column("text"))
            if model is not None:
                for i, j, x in features(batch.column("text")):
                    k, s, c = model.decode(x)
                    some = letter[i:j]
                    lang[i:j][some] = np.array(model.languages, object)[k[some]]
                    score[i:j][some], close[i:j][some] = s[some], c[some]
            kept = [batch.column(i) for i in range(batch.num_columns)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(lang, pa.string()), pa.array(score), pa.array(close > AMBIGUOUS)], [*batch.schema.names, "lang_pred", "score", "ambiguous"])

    return predict


def identify(docs: DataFrame, model: Model | None, keep: list[str]) -> DataFrame:
    """The columns keep of docs (text among them) with lang_pred, score and ambiguous."""
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return map_arrow(docs.select(*keep), _predict(model), f"{schema}, lang_pred string, score double, ambiguous boolean")


def _accept(model: Model | None, schema_names: list[str]):
    def accept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = schema_names.index("text")
        for batch in batches:
            only = pa.RecordBatch.from_arrays([batch.column(k)], ["text"])
            for judged in _predict(model)(iter([only])):
                good = pc.and_(pc.not_equal(judged.column("lang_pred"), "und"), pc.invert(judged.column("ambiguous")))
                yield batch.filter(good)

    return accept


def accepted(docs: DataFrame) -> DataFrame:
    """The rows of docs that have a language, unambiguously, with all their columns."""
    return map_arrow(docs, _accept(train(docs), docs.columns), docs.schema)


def predict_languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous for every row."""
    out = identify(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), train(docs), ["doc_id", "text"])
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score", "ambiguous")
