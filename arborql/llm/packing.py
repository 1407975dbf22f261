"""Best-fit decreasing packing of token sequences.

Documents are cut into full windows and a remainder. Best-fit decreasing depends on the
pieces only through the histogram of their lengths, which has at most WINDOW entries
whatever the corpus: the driver packs that histogram (a segment tree over the remaining
capacity finds the tightest open sequence; sequences with equal contents are one group),
and each piece then looks up its place from its rank among the pieces of its length.
The plan has a few entries for each length, so its size is bounded by WINDOW.

Defined results: null text counts as empty, and an empty document is one piece of the
end token alone. Very long texts are cut into full windows and a rest. Ties: pieces of one
length, and sequences of one remaining capacity, go in the order of their numbers.
Repeated rows are packed as often as they occur. A null doc_id is kept. An empty table
gives no pieces. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_arrow, materialize
from .tokens import Encoder, default_path

WINDOW, END = 2048, 1
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part int, nth long"


class Capacities:
    """Segment tree over remaining capacities: which of them have open sequences."""

    def __init__(self, window: int):
        self.size = 1 << (window + 1).bit_length()
        self.open = [0] * (2 * self.size)

    def add(self, r: int, n: int) -> None:
        r += self.size
        while r:
            self.open[r] += n
            r >>= 1

    def tightest(self, least: int) -> int | None:
        """The smallest open capacity of at least so much."""
        i = least + self.size
        if self.open[i]:
            return least
        while i > 1:
            if not i & 1 and self.open[i + 1]:
                i += 1
                break
            i >>= 1
        else:
            return None
        while i < self.size:
            i = 2 * i if self.open[2 * i] else 2 * i + 1
        return i - self.size


def plan(histogram: dict[int, int], window: int = WINDOW) -> list[tuple[int, int, int, int, int]]:
    """Entries (length, first rank, first sequence, pieces a sequence, offset): piece with rank t of that length, from the first rank on, goes to sequence first + t // pieces."""
    tree, groups, out, following = Capacities(window), {}, [], 0
    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            r = tree.tightest(length)
            if r is None:
                r = window
                each = r // length
                first, n = following, -(-left // each)
                following += n
            else:
                first, n = groups[r].pop()
                tree.add(r, -1)
                each = r // length
            out.append((length, rank, first, each, window - r))
            full = min(n, left // each)
            over = left - full * each if full < n else 0
            for one, count, used in ((first, full, each), (first + full, 1 if over else 0, over), (first + full + bool(over), n - full - bool(over), 0)):
                if count and r - used * length:
                    groups.setdefault(r - used * length, []).append((one, count))
                    tree.add(r - used * length, 1)
            rank += full * each + over
            left -= full * each + over
    return out


def _cut(path: str, window: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, seen, part = Encoder(path), np.zeros(window + 1, np.int64), TaskContext.get().partitionId()
        tail = np.array([END], "<u4").tobytes()
        for batch in batches:
            doc, start, length, crc, total = [], [], [], [], []
            ids_of = batch.column(0).cast(pa.int64()).to_pylist()
            for doc_id, ids in zip(ids_of, encoder.column(batch.column(1))):
                n = len(ids) + 1
                for s in range(0, n, window):
                    e = min(s + window, n)
                    x = zlib.crc32(ids[s:e])
                    doc.append(doc_id)
                    start.append(s)
                    length.append(e - s)
                    crc.append(zlib.crc32(tail, x) if e == n else x)
                    total.append(n)
            nth = []
            for x in length:
                nth.append(int(seen[x]))
                seen[x] += 1
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), *(pa.array(x, pa.int64()) for x in (start, length, crc, total)), pa.array([part] * len(doc), pa.int32()), pa.array(nth, pa.int64())], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "nth"])

    return cut


def _place(entries: list[tuple[int, int, int, int, int]]):
    entries = np.array(sorted(entries), np.int64).reshape(-1, 5)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = entries[:, 0] * (1 << 48) + entries[:, 1]
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            e = entries[np.searchsorted(key, length * (1 << 48) + rank, side="right") - 1]
            t = rank - e[:, 1]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")), pa.array(e[:, 2] + t // e[:, 3]), pa.array(e[:, 4] + t % e[:, 3] * length)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return place


def pack(docs: DataFrame, tokenizer_path: str | None = None, window: int = WINDOW) -> DataFrame:
    """docs (doc_id, text, ...) -> one row for each piece, with its sequence and its offset there."""
    pieces = materialize(map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), _cut(tokenizer_path or default_path(), window), PIECE), "pieces")
    counts = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    # At most one entry for each length up to the window: bounded, whatever the corpus.
    histogram = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    ranked = pieces.join(base, ["length", "part"]).withColumn("rank", F.col("base") + F.col("nth"))
    return map_arrow(ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "rank"), _place(plan(histogram, window)), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
