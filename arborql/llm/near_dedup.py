"""MinHash near-dedup with tensored banding.

Two small collections of half keys (each of PER_HALF minhashes) are computed for each
distinct shingle set; a table key joins half key i of the first with half key j of the
second, so HALVES ** 2 tables cost 2 * HALVES * PER_HALF minhashes. Candidates of one
table are compared with the table's smallest member (its pivot) on full shingle sets; as
Jaccard distance is a metric, the distances to the pivot then rule out every other pair
of the bucket but those that might still be linked, and these are compared as well.

Sets whose sizes alone rule a link out are never compared.

Defined results: null text, or text without words: no shingles, linked with nothing.
Fewer than five words: the whole sequence is the one shingle. Very long texts take part
with all their shingles. Equal sets (exact copies, whatever their ids) are folded before
any table is built, so a group of copies costs one row. Ties: the smallest doc_id names a
group and is kept. A null doc_id takes no part in linking: its component_id is null and it
is kept. Repeated rows return repeated rows; rows of one doc_id with different texts are
linked by each of their texts. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, materialize, small
from .components import connected_components
from .textops import U64, as_long, chunks, mix, shingles, strings

HALVES, PER_HALF, SHINGLE = 8, 2, 5
#: Per cent: a pair is linked when 100 * intersection >= threshold * union, unless the caller gives another one.
THRESHOLD = 85
_RND = np.random.RandomState(20240229)
_XOR = _RND.randint(0, 1 << 62, 2 * HALVES * PER_HALF).astype(U64)
_MUL = (_RND.randint(0, 1 << 62, 2 * HALVES * PER_HALF).astype(U64) << U64(1)) | U64(1)
SKETCH = "doc_id long, n_shingles long, f1 long, f2 long, a array<long>, b array<long>"


def _distinct(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size of each row's set of hashes, and two order-free fingerprints of the set."""
    n = len(first) - 1
    size, f1, f2 = np.zeros(n, np.int64), np.zeros(n, U64), np.zeros(n, U64)
    odd = U64(0xC2B2AE3D27D4EB4F)
    for r in range(n):
        s = np.sort(h[first[r] : first[r + 1]])
        if len(s):
            keep = np.empty(len(s), bool)
            keep[0] = True
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            s = s[keep]
            size[r], f1[r], f2[r] = len(s), s.sum(), ((s ^ (s >> U64(31))) * odd).sum()
    return size, mix(f1), mix(f2)


def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, text -> size of the shingle set, its fingerprint and the two collections of half keys."""
    for batch in batches:
        offsets, data = strings(batch.column(1))
        for i, j in chunks(offsets):
            h, first = shingles(offsets[i : j + 1], data, SHINGLE)
            size, f1, f2 = _distinct(h, first)
            some = np.flatnonzero(size)
            halves = np.zeros((j - i, 2 * HALVES), U64)
            if len(some):
                mins = [np.minimum.reduceat((h ^ x) * m, first[some]) for x, m in zip(_XOR, _MUL)]
                for k in range(2 * HALVES):
                    acc = np.full(len(some), k + 1, U64)
                    for p in range(PER_HALF):
                        acc = mix(acc * U64(0x9FB21C651E98DF25) + mins[k * PER_HALF + p])
                    halves[some, k] = acc
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(j - i + 1, dtype=np.int32) * HALVES), pa.array(as_long(np.ascontiguousarray(halves[:, x : x + HALVES]).ravel()))) for x in (0, HALVES)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i).cast(pa.int64()), pa.array(size), pa.array(as_long(f1)), pa.array(as_long(f2)), *lists], ["doc_id", "n_shingles", "f1", "f2", "a", "b"])


def _sets(column: pa.Array) -> Iterator[np.ndarray]:
    offsets, data = strings(column)
    for i, j in chunks(offsets):
        h, first = shingles(offsets[i : j + 1], data, SHINGLE)
        for r in range(j - i):
            yield np.unique(h[first[r] : first[r + 1]])


def _overlap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """x, y, text of x, text of y -> sizes of intersection and union of the full shingle sets."""
    for batch in batches:
        inter, union = [], []
        for s, t in zip(_sets(batch.column(2)), _sets(batch.column(3))):
            n = len(np.intersect1d(s, t, assume_unique=True))
            inter.append(n)
            union.append(len(s) + len(t) - n)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(inter, pa.int64()), pa.array(union, pa.int64())], ["x", "y", "common", "total"])


def confirm(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Counts on full sets for candidate pairs (x, y), a written table: x, y, common, total.

    The joins are plain equi-joins on a unique key, so that a pivot with very many
    partners is split at run time.
    """
    asked = materialize(pairs.select("x").union(pairs.select("y")).distinct().select(F.col("x").alias("doc_id")), "asked")
    texts = texts.join(small(asked), "doc_id", "left_semi")  # only these are shuffled
    s = texts.select(F.col("doc_id").alias("x"), F.col("text").alias("text_x"))
    t = texts.select(F.col("doc_id").alias("y"), F.col("text").alias("text_y"))
    joined = pairs.join(s, "x").join(t, "y").select("x", "y", "text_x", "text_y")
    return map_arrow(joined, _overlap, "x long, y long, common long, total long")


def _buckets(reps: DataFrame) -> DataFrame:
    """(key, rep, n: size of its set) for the table keys that can be shared: both halves must be shared by somebody."""
    half = reps.select("rep", "n_shingles", F.posexplode(F.concat("a", "b")).alias("pos", "val"))
    shared = half.groupBy("pos", "val").agg(F.count("*").alias("n")).where("n > 1").select("pos", "val")
    mine = half.join(shared, ["pos", "val"]).groupBy("rep", "n_shingles").agg(F.collect_list(F.struct("pos", "val")).alias("halves"))
    left = mine.select("rep", "n_shingles", "halves", F.explode(F.filter("halves", lambda x: x.pos < HALVES)).alias("l"))
    both = left.select("rep", "n_shingles", "l", F.explode(F.filter("halves", lambda x: x.pos >= HALVES)).alias("r"))
    return both.select(F.xxhash64("l.pos", "l.val", "r.pos", "r.val").alias("key"), "rep", F.col("n_shingles").alias("n"))


def near_duplicates(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs (doc_id, text, ...)."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = materialize(map_arrow(texts, sketch, SKETCH), "sketch")
    fp = ["f1", "f2", "n_shingles"]
    reps = rows.where("n_shingles > 0 and doc_id is not null").groupBy(*fp).agg(F.min(F.struct("doc_id", "a", "b")).alias("m"))
    reps = materialize(reps.select(*fp, F.col("m.doc_id").alias("rep"), "m.a", "m.b"), "sets")
    buckets = materialize(_buckets(reps), "buckets")
    pivots = buckets.groupBy("key").agg(F.min("rep").alias("pivot"), F.max("rep").alias("last")).where("last <> pivot").select("key", "pivot")
    members = materialize(buckets.join(pivots, "key"), "members")
    first = materialize(members.where("rep <> pivot").select(F.col("rep").alias("x"), F.col("pivot").alias("y")).distinct(), "pivot-pairs")
    known = materialize(confirm(first, texts), "pivot-links")
    linked = F.expr(f"100 * common >= {threshold} * total")
    links = known.where(linked).select("x", "y")
    comp = materialize(connected_components(links), "first-components")

    far = known.select(F.col("x").alias("rep"), F.col("y").alias("pivot"), (1 - F.col("common") / F.col("total")).alias("d"), (~linked).alias("open"))
    placed = members.join(far, ["rep", "pivot"], "left").join(comp.withColumnRenamed("node", "rep"), "rep", "left")
    placed = placed.select("key", "rep", "n", F.coalesce("d", F.lit(0.0)).alias("d"), F.coalesce("open", F.lit(False)).alias("open"), F.col("rep").__ne__(F.col("pivot")).alias("other"), F.coalesce("component", "rep").alias("c"))
    rest = placed.where("other")
    u = rest.where("open").select("key", F.col("rep").alias("x"), F.col("d").alias("dx"), F.col("c").alias("cx"), F.col("n").alias("nx"))
    v = rest.select("key", F.col("rep").alias("y"), F.col("d").alias("dy"), F.col("c").alias("cy"), F.col("open").alias("oy"), F.col("n").alias("ny"))
    slack = 1 - threshold / 100 + 1e-9
    alike = 100 * F.least("nx", "ny") >= threshold * F.greatest("nx", "ny")
    second = u.join(v, "key").where(alike & (F.abs(F.col("dx") - F.col("dy")) <= slack) & (F.col("cx") != F.col("cy")) & (~F.col("oy") | (F.col("x") < F.col("y"))))
    second = materialize(second.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct(), "other-pairs")
    more = materialize(confirm(second, texts).where(linked).select("x", "y"), "other-links")
    every = connected_components(comp.select(F.col("node").alias("x"), F.col("component").alias("y")).where("x <> y").unionByName(more))
    names = reps.select(*fp, "rep").join(every.withColumnRenamed("node", "rep"), "rep", "left")
    names = names.select(*(F.col(c).alias(f"s_{c}") for c in fp), F.coalesce("component", "rep").alias("component"))
    on = [rows[c] == names[f"s_{c}"] for c in fp]
    out = rows.join(names, on, "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def deduplicated(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """The rows of docs that are kept, with all their columns; of rows that repeat a kept doc_id and its text one stays."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    gone = materialize(near_duplicates(docs, threshold).where("not kept").select(F.col("doc_id").alias("gone")).distinct(), "gone")
    rest = docs.join(small(gone), docs["doc_id"].cast("long") == gone["gone"], "left_anti")
    twice = materialize(ids.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("twice")), "repeated")
    if twice.isEmpty():
        return rest
    repeats = rest["doc_id"].cast("long") == twice["twice"]
    once = rest.join(small(twice), repeats, "left_anti")
    return once.unionByName(rest.join(small(twice), repeats, "left_semi").dropDuplicates(["doc_id", "text"]))
