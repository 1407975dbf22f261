"""Benchmark decontamination by a positional inverted index, in DataFrame operations only.

The index stores the postings (term, document, position) of every term that occurs in the
benchmark, in one pass over the documents and without a shuffle; an end mark's posting
holds each document's length. Every window of WINDOW consecutive item words (the whole
item, if it is shorter) is a phrase. Its terms are ordered by their number of postings.
The rarest term's list gives the places to look at; the second rarest term's list is
intersected with it within REACH words; where both meet, the lists of all terms are
intersected at their offsets: a phrase stands where every list has the position that the
offset asks for, and is near where all lists have one within REACH words of the rarest
term. Positions meet in equi-joins on blocks of 2 * REACH + 1 words, so that neither a
long document nor a frequent term multiplies rows, and no row holds a text.

Defined results: null or empty text has no words. An item without words has no windows.
Very long texts are indexed whole. Ties in rarity go to the earlier word, then the smaller
term number. Repeated rows return repeated rows, each with its own hits; rows are told
apart by their text, so rows of one doc_id with different texts are judged apart. A null
doc_id is kept. Items with a null id count under no name. An empty benchmark leaves all
documents clean, an empty documents table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, small

WINDOW = 10
#: Words around a window's rarest word within which its other words are near.
REACH = WINDOW
BLOCK = 2 * REACH + 1
END = -1
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What parts words. Upper-case letters count as letters here, so that it also splits a text that isn't lower-cased.
_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: The key of the null doc_id in joins; rows are also told apart by their text.
NO_ID = -(1 << 63)


def split_words(text: Column) -> Column:
    """Splitting is several times as fast as extracting matches; only the ends can give empty words."""
    return F.array_remove(F.split(text, _GAP), "")


def words(text: Column) -> Column:
    """Words of the ASCII-lower-cased text. lower() is right where all is ASCII, and much cheaper."""
    low = F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return split_words(low)


def phrases(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """item_id, phrase: the distinct windows of each item."""
    w = benchmark.select(F.col("item_id"), words(F.col("text")).alias("w")).where("size(w) > 0")
    at = w.select("item_id", "w", F.explode(F.sequence(F.lit(1), F.greatest(F.size("w") - window + 1, F.lit(1)))).alias("i"))
    return at.select("item_id", F.slice("w", F.col("i"), window).alias("phrase")).distinct()


def vocabulary(listed: DataFrame) -> DataFrame:
    """term, tid: the terms of the phrases with a number each; the end mark is the empty term."""
    terms = materialize(listed.select(F.explode("phrase").alias("term")).distinct(), "terms")
    numbered = terms.select("term", F.monotonically_increasing_id().alias("tid"))
    mark = terms.sparkSession.range(1).select(F.lit("").alias("term"), F.lit(END).cast("long").alias("tid"))
    return materialize(numbered.unionByName(mark), "vocabulary")


def build_index(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """The stored index: tid, doc_id, of (hash of the text), pos (from 0). An end mark stands behind each document's last word."""
    marked = F.array_append(words(F.coalesce("text", F.lit(""))), F.lit(""))
    each = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("of"), marked.alias("w"))
    each = each.select("doc_id", "of", F.posexplode("w").alias("pos", "term"))
    return materialize(each.join(small(terms), "term").select("tid", "doc_id", "of", "pos"), "index")


def _block(pos: Column) -> Column:
    return F.floor(pos / BLOCK)


def _near_blocks(pos: Column) -> Column:
    """The blocks within reach of a position: one or two."""
    return F.explode(F.array_distinct(F.array(_block(pos - REACH), _block(pos + REACH))))


def _keyed(index: DataFrame) -> DataFrame:
    """The index with a document key that is never null."""
    return index.select("tid", F.coalesce("doc_id", F.lit(NO_ID)).alias("doc"), "of", "pos")


def plans(listed: DataFrame, terms: DataFrame, index: DataFrame) -> DataFrame:
    """pid, phrase (term numbers), order (its distinct terms: n, offset, tid; rarest first), for phrases all of whose terms occur."""
    counts = index.groupBy("tid").agg(F.count("*").alias("n"))
    distinct = listed.select(F.xxhash64("phrase").alias("pid"), "phrase").distinct()
    at = distinct.select("pid", F.posexplode("phrase").alias("offset", "term")).join(small(terms), "term")
    at = at.join(materialize(counts, "term-counts"), "tid", "left")
    whole = at.groupBy("pid").agg(F.sort_array(F.collect_list(F.struct("offset", "tid"))).alias("phrase"))
    order = at.groupBy("pid", "tid").agg(F.min("offset").alias("offset"), F.first("n").alias("n"))
    order = order.groupBy("pid").agg(F.sort_array(F.collect_list(F.struct("n", "offset", "tid"))).alias("order"), F.count("n").alias("known"))
    return whole.join(order, "pid").where(F.col("known") == F.size("order")).select("pid", F.col("phrase.tid").alias("phrase"), "order")


def candidates(index: DataFrame, plan: DataFrame) -> DataFrame:
    """doc, of, pid, pos: where a phrase's rarest term stands and, if it has two terms, the second rarest within reach."""
    first, second = F.col("order")[0], F.get("order", 1)
    told = materialize(plan.select("pid", first["tid"].alias("t1"), second["tid"].alias("t2")), "rarest")
    pairs = materialize(told.select("t1", "t2").distinct(), "pairs")
    at = index.join(small(pairs), index.tid == pairs.t1).select("doc", "of", "pos", "t1", "t2")
    alone = at.where("t2 is null")
    wanted = materialize(pairs.select("t2").distinct(), "second-terms")
    others = index.join(small(wanted), index.tid == wanted.t2, "left_semi").select(F.col("doc").alias("doc2"), F.col("of").alias("of2"), F.col("tid").alias("tid2"), F.col("pos").alias("pos2"), _block(F.col("pos")).alias("block2"))
    both = at.where("t2 is not null").select("*", _near_blocks(F.col("pos")).alias("block"))
    meet = (F.col("doc") == F.col("doc2")) & (F.col("of") == F.col("of2")) & (F.col("t2") == F.col("tid2")) & (F.col("block") == F.col("block2")) & (F.abs(F.col("pos") - F.col("pos2")) <= REACH)
    met = both.join(others, meet, "left_semi").drop("block")
    found = materialize(met.unionByName(alone).distinct(), "met")
    named = told.withColumnsRenamed({"t1": "p1", "t2": "p2"})
    return materialize(found.join(small(named), (F.col("t1") == F.col("p1")) & F.col("t2").eqNullSafe(F.col("p2"))).select("doc", "of", "pid", "pos"), "candidates")


def matches(index: DataFrame, plan: DataFrame) -> DataFrame:
    """doc, of, pid, start, n (words), exact: the places where a phrase is near; start is the exact match's first word."""
    found = candidates(index, plan)
    alive = materialize(found.select("pid").distinct(), "alive")
    plan = materialize(plan.join(small(alive), "pid", "left_semi"), "plans")
    some = materialize(plan.select(F.explode("phrase").alias("tid")).distinct(), "alive-terms")
    docs = materialize(found.select("doc", "of").distinct(), "alive-documents")
    lists = index.join(small(some), "tid", "left_semi").join(small(docs), ["doc", "of"], "left_semi")
    lists = lists.select("doc", "of", "tid", F.col("pos").alias("p"), _block(F.col("pos")).alias("block"))
    asked = found.join(small(plan), "pid").select("doc", "of", "pid", "pos", F.col("phrase"), F.col("order")[0]["offset"].alias("offset"), F.size("order").alias("terms"), F.explode("order.tid").alias("tid"))
    asked = materialize(asked.select("*", _near_blocks(F.col("pos")).alias("block")), "asked")
    hit = lists.join(small(asked), ["doc", "of", "tid", "block"]).where(F.abs(F.col("p") - F.col("pos")) <= REACH)
    start = F.col("pos") - F.col("offset")
    fits = F.when(F.get("phrase", F.col("p") - start) == F.col("tid"), F.col("p"))
    place = hit.select("doc", "of", "pid", start.alias("start"), F.size("phrase").alias("n"), "terms", "tid", fits.alias("fits"))
    # At most BLOCK positions and WINDOW terms in a group.
    both = place.groupBy("doc", "of", "pid", "start", "n", "terms").agg(F.size(F.collect_set("tid")).alias("near"), F.size(F.collect_set("fits")).alias("fit"))
    return both.where(F.col("near") == F.col("terms")).select("doc", "of", "pid", "start", "n", (F.col("fit") == F.col("n")).alias("exact"))


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The item windows (item_id, pid), the index, and the matches."""
    if window > REACH + 1:
        raise ValueError(f"windows have at most {REACH + 1} words")
    listed = materialize(phrases(benchmark, window), "phrases")
    terms = vocabulary(listed)
    index = build_index(docs, terms)
    plan = materialize(plans(listed, terms, index), "plans")
    found = materialize(matches(_keyed(index.where(F.col("tid") != END)), plan), "matches")
    return listed.select("item_id", F.xxhash64("phrase").alias("pid")), index, found


def _same_row(docs: DataFrame, doc: Column, of: Column) -> Column:
    return (F.coalesce(docs["doc_id"].cast("long"), F.lit(NO_ID)) == doc) & (F.xxhash64(docs["text"]) == of)


def without_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of docs without any item window, with all their columns."""
    bad = materialize(hits(docs, benchmark, window)[2].where("exact").select(F.col("doc").alias("bad_doc"), F.col("of").alias("bad_of")).distinct(), "contaminated")
    return docs.join(small(bad), _same_row(docs, bad["bad_doc"], bad["bad_of"]), "left_anti")


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near (items near, exact ones included), for every row of docs (doc_id, text, ...)."""
    listed, index, found = hits(docs, benchmark, window)
    exact = found.where("exact")
    covered = exact.select("doc", "of", F.explode(F.sequence("start", F.col("start") + F.col("n") - 1)).alias("word")).distinct()
    covered = covered.groupBy("doc", "of").agg(F.count("*").alias("n_hit"))
    names = found.groupBy("doc", "of", "pid").agg(F.max("exact").alias("exact")).join(small(materialize(listed, "windows")), "pid")
    names = names.groupBy("doc", "of", F.col("item_id").cast("string").alias("item")).agg(F.max("exact").alias("exact"))
    own = F.when(F.col("exact"), F.col("item"))
    items = names.groupBy("doc", "of").agg(F.count(own).alias("n_items"), F.sha2(F.array_join(F.sort_array(F.collect_list(own)), ","), 256).alias("items_sha256"), F.count("item").alias("n_near"))
    told = materialize(items.join(covered, ["doc", "of"], "left").withColumnsRenamed({"doc": "hit_doc", "of": "hit_of"}), "hits")
    ends = index.where(F.col("tid") == END).select("doc_id", "of", F.col("pos").cast("long").alias("n_words"))
    same = (F.coalesce("doc_id", F.lit(NO_ID)) == F.col("hit_doc")) & (F.col("of") == F.col("hit_of"))
    none = F.lit(0).cast("long")
    n_hit = F.coalesce("n_hit", none)
    return ends.join(small(told), same, "left").select("doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", none).alias("n_items"), F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), (n_hit > 0).alias("contaminated"), F.coalesce("n_near", none).alias("n_near"))
