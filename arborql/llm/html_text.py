"""Main text of web pages: page differencing between nearest URLs, with the page's own structure as a second vote.

Pages of a host are ordered by URL path, and each is paired with the neighbour that has
the longer path prefix in common (ties: the one before). Neighbours whose text lines are
all equal count as one page, so a partner always differs, and equal pages get equal
results. The lines of a page are aligned with its partner's by longest common
subsequence. Shared lines are deleted, with two exceptions:

* Inside an article or main element, and where the partner is a near copy, a shared line
  goes only if it is usual in the host: four fifths of its distinct pages, at least five,
  have it. Else a copied passage or article would be lost at both of its URLs.
* Where four fifths of a host's pages are near copies of each other, what they share
  can't be told from a template and goes.

Menus, headers, footers, sidebars, notices, adverts, forms, comments and markup that
differencing leaves (most menus differ from page to page) go by element, role or class.
Where a page has an article or main element with text (as parsed: one in a script, a
comment or an attribute is none), only lines inside are left.

The order is a range-partitioned sort of short line hashes, so a host with a third of all
pages is spread over many tasks; neighbours across tasks meet by the global rank of their
runs of equal pages.

Defined results: null or empty html, and an empty table, give an empty text, and no rows.
A null url counts as an empty host and path. Very long pages: the alignment halves the
partner until its tables fit into memory. Ties of the alignment are broken alike in all
runs. Repeated rows return repeated rows with equal results. Extra columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_arrow, materialize, small
from .url_filter import host_of, path_of

_TOKEN = re.compile(r"<!--(?:.*?-->|.*)|<(script|style|noscript|template|iframe|textarea|svg|title)\b(?:.*?</\1\s*>|.*)|<![^>]*>?|<\?[^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[a-zA-Z/][^>]*\Z|[^<]++|<", re.S | re.I)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_BLOCK = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_NEVER = frozenset("nav aside footer form button select menu dialog object canvas audio video map".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
_NAMES = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notices?|notification|alert|popup|modal|overlay|sidebar|side|menu|nav|navbar|navigation|breadcrumbs?|comments?|replies|reply|disqus|respond|footer|masthead|share|sharing|social|related|recommend\w*|newsletter|subscribe|signup|login|search|skip|pagination|pager|copyright|disclaimer|toolbar|widget)(?:$|[\s_-])", re.I)
#: Lines that stand in so large a part of a host's distinct pages, if these are ENOUGH, are its template whatever the partner is.
USUAL, ENOUGH = 0.8, 5
#: A partner with so large a part of a page's other lines is a near copy, not a page of the same template.
NEAR = 2 / 3
#: Bits of an alignment's tables; longer pages are aligned in halves.
TABLE_BITS = 1 << 27
PLACE = "key long, host string, path string, page_id long"


def _unwanted(tag: str, attributes: str, inside: bool) -> bool:
    if tag in _NEVER or tag == "header" and not inside:
        return True
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or "").strip("\"'")
        if name in ("class", "id"):
            if tag not in ("html", "body", "article", "main") and _NAMES.search(value):
                return True
        elif name == "role" and value.lower() in _ROLES or name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return True
    return False


def lines(page: str) -> list[tuple[str, bool, bool]]:
    """The text blocks in page order: text, whether it is inside an article, and whether structure lets it pass."""
    out: list[tuple[str, bool, bool]] = []
    parts: list[str] = []
    skip, depth = "", 0  # the unwanted element we are in, and how many of its name are open
    articles: list[str] = []

    def end_block() -> None:
        text = " ".join("".join(parts).split())
        parts.clear()
        if text and not (articles and skip):
            out.append((text, bool(articles), not skip))

    for m in _TOKEN.finditer(page):
        tag = m[3] or m[6]
        if tag is None:
            x = m[0]
            if x[0] != "<" or len(x) == 1:
                parts.append(entities.unescape(x) if "&" in x else x)
            elif m[1]:
                parts.append(" ")
            continue
        tag, close, attributes = tag.lower(), m[2] or m[5], m[4] or m[7] or ""
        if tag in _BLOCK:
            end_block()
        if skip:
            if tag == skip and not attributes.endswith("/"):
                depth += -1 if close else 1
                if not depth:
                    end_block()
                    skip = ""
            continue
        if close:
            if articles and tag == articles[-1]:
                end_block()
                articles.pop()
        elif tag in _VOID:
            continue
        elif _unwanted(tag, attributes, bool(articles)):
            end_block()
            skip, depth = tag, 1
        elif tag in ("article", "main") or "role" in attributes and re.search(r"\brole\s*=\s*[\"']?main\b", attributes, re.I):
            end_block()
            articles.append(tag)
        elif articles and tag == articles[-1]:
            articles.append(tag)
    end_block()
    return out


def _rows(a: list, b: list) -> Iterator[int]:
    """For each line of b the bit vector of the alignment of a with b up to it: a zero where the length grows."""
    mask = (1 << len(a)) - 1
    place: dict = {}
    for i, x in enumerate(a):
        place[x] = place.get(x, 0) | 1 << i
    v = mask
    for y in b:
        u = v & place.get(y, 0)
        v = ((v + u) | (v - u)) & mask
        yield v


def _lengths(a: list, b: list) -> np.ndarray:
    """Length of the longest common subsequence of b and each beginning of a."""
    last = (1 << len(a)) - 1
    for last in _rows(a, b):
        pass
    bits = np.unpackbits(np.frombuffer(last.to_bytes(len(a) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(a)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def shared(a: list, b: list, most_bits: int = TABLE_BITS) -> list[int]:
    """Indexes of a that are in a longest common subsequence of a and b, by bit-parallel dynamic programming."""
    start, end = 0, 0
    while start < min(len(a), len(b)) and a[start] == b[start]:
        start += 1
    while end < min(len(a), len(b)) - start and a[-1 - end] == b[-1 - end]:
        end += 1
    x, y = a[start : len(a) - end], b[start : len(b) - end]
    if len(y) > 1 and len(x) * len(y) > most_bits:  # where the halves of b part a best
        half = len(y) // 2
        cut = int(np.argmax(_lengths(x, y[:half]) + _lengths(x[::-1], y[half:][::-1])[::-1]))
        inner = shared(x[:cut], y[:half], most_bits) + [cut + i for i in shared(x[cut:], y[half:], most_bits)]
    else:
        inner, rows, i, j = [], list(_rows(x, y)), len(x), len(y)
        while i and j:
            if rows[j - 1] >> (i - 1) & 1:
                i -= 1
            else:
                j -= 1
                if not (j and not rows[j - 1] >> (i - 1) & 1):
                    i -= 1
                    inner.append(i)
        inner.reverse()
    return [*range(start), *(start + i for i in inner), *range(len(a) - end, len(a))]


def _hash(text: str) -> int:
    import hashlib

    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _outlines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the lines (null for those that structure drops), the hashes of all lines, and whether they are inside an article."""
    for batch in batches:
        own, hashes, article = [], [], []
        for page in batch.column("html"):
            found = lines(page.as_py() or "")
            some = any(inside for _, inside, _ in found)
            own.append([text if (inside if some else passed) else None for text, inside, passed in found])
            hashes.append([_hash(text) for text, _, _ in found])
            article.append(some)
        kept = ["key", "host", "path", "page_id", "url"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(own, pa.list_(pa.string())), pa.array(hashes, pa.list_(pa.int64())), pa.array(article, pa.bool_())], [*kept, "own", "hashes", "article"])


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the number of the task and, within it, of the run of rows with equal outlines."""
    part, run, last = TaskContext.get().partitionId(), -1, None
    for batch in batches:
        if batch.num_rows:
            outline = batch.column(batch.schema.names.index("outline")).to_numpy(zero_copy_only=False)
            new = np.append(last is None or outline[0] != last, outline[1:] != outline[:-1])
            runs = run + np.cumsum(new)
            run, last = int(runs[-1]), outline[-1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * batch.num_rows, pa.int32()), pa.array(runs.astype(np.int64))], [*batch.schema.names, "part", "nth"])


def _common_prefix(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def template(own: list[int], partner: list[int], usual: set[int], article: bool) -> list[int]:
    """Indexes of the lines of a page that go: those it shares with its partner, with the exceptions above."""
    gone = shared(own, partner)
    if not gone:
        return gone
    doubtful = sum(own[i] not in usual for i in gone)
    if article or doubtful and doubtful >= NEAR * sum(x not in usual for x in own):
        gone = [i for i in gone if own[i] in usual]
    return gone


def _differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = batch.to_pydict()
        keys, out = [], []
        for run, low, high, own, article, before, p, after, n, common in zip(*(rows[c] for c in ("run", "low", "high", "hashes", "article", "before_path", "before", "after_path", "after", "common"))):
            use = p
            if p is None or n is not None and _common_prefix(high, after) > _common_prefix(low, before):
                use = n
            gone = template(own, use, set(common or ()), article) if use else []
            if gone:
                keys.append(run)
                out.append(gone)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(out, pa.list_(pa.int32()))], ["run", "gone"])


def common_lines(runs: DataFrame) -> DataFrame:
    """host, common: the lines of a host's usual template. At most a mean page's lines / USUAL for each host."""
    pages = runs.groupBy("host", "outline").agg(F.first("hashes").alias("hashes")).where("size(hashes) > 0")
    hosts = pages.groupBy("host").agg(F.count("*").alias("n")).where(F.col("n") >= ENOUGH)
    each = pages.select("host", F.explode(F.array_distinct("hashes")).alias("line")).groupBy("host", "line").agg(F.count("*").alias("m")).where(F.col("m") >= USUAL * ENOUGH)
    return each.join(hosts, "host").where(F.col("m") >= USUAL * F.col("n")).groupBy("host").agg(F.collect_list("line").alias("common"))


def template_lines(pages: DataFrame) -> DataFrame:
    """key, gone: which lines of a page go, for the pages that lose some. pages: key, host, path, page_id, article, hashes."""
    short = pages.dropDuplicates(["key"]).withColumn("outline", F.xxhash64("host", "hashes", "article"))
    ordered = short.orderBy("host", "path", "page_id", "key")
    ordered = materialize(map_arrow(ordered, _number, f"{PLACE}, article boolean, hashes array<long>, outline long, part int, nth long"), "ordered")
    # A row for each task of the sort; its first run may go on from the task before.
    by_task = Window.orderBy("part")
    sizes = ordered.groupBy("part").agg((F.max("nth") + 1).alias("n"), F.min_by("outline", "nth").alias("first"), F.max_by("outline", "nth").alias("last"))
    sizes = sizes.select("part", "n", F.coalesce((F.lag("last").over(by_task) == F.col("first")).cast("long"), F.lit(0)).alias("same"))
    base = F.coalesce(F.sum(F.col("n") - F.col("same")).over(by_task.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) - F.col("same")
    ranked = ordered.join(F.broadcast(sizes.select("part", base.alias("base"))), "part").withColumn("run", F.col("base") + F.col("nth"))
    first = lambda c: F.first(c).alias(c)
    runs = ranked.groupBy("run").agg(first("host"), first("outline"), first("hashes"), first("article"), F.min("path").alias("low"), F.max("path").alias("high"))
    runs = materialize(runs, "runs")
    other = lambda name, path, step: runs.select(F.col("host").alias(f"{name}_host"), F.col(path).alias(f"{name}_path"), F.col("hashes").alias(name), (F.col("run") + step).alias("run"))
    near = lambda name, c: F.when(F.col(f"{name}_host") == F.col("host"), F.col(c)).alias(c)
    pairs = runs.join(other("before", "high", 1), "run", "left").join(other("after", "low", -1), "run", "left")
    pairs = pairs.select("run", "low", "high", "hashes", "article", "host", near("before", "before_path"), near("before", "before"), near("after", "after_path"), near("after", "after"))
    common = materialize(common_lines(runs), "common-lines")
    # Without a usual line nothing goes from an article: such pages need no alignment.
    pairs = pairs.join(small(common), "host", "left").where(~F.col("article") | F.col("common").isNotNull()).drop("host")
    gone = materialize(map_arrow(pairs, _differences, "run long, gone array<int>"), "gone")
    return ranked.select("key", "run").join(small(gone), "run").select("key", "gone")


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages (page_id, url, html, ...)."""
    key = F.xxhash64("page_id", "url", "html").alias("key")
    rows = pages.select(key, host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.col("page_id").cast("long").alias("page_id"), "url", "html")
    parsed = materialize(map_arrow(rows, _outlines, f"{PLACE}, url string, own array<string>, hashes array<long>, article boolean"), "outlines")
    gone = materialize(template_lines(parsed.select("key", "host", "path", "page_id", "article", "hashes")), "gone-lines")
    # Only pages that lose lines are looked up; where these are few, no text is shuffled.
    left = parsed.select("key", "page_id", "url", "own").join(small(gone), "key", "left")
    kept = F.when(F.col("gone").isNull(), F.col("own")).otherwise(F.filter("own", lambda x, i: ~F.array_contains("gone", i)))
    return left.select("page_id", "url", F.array_join(kept, " ").alias("text")).withColumn("n_chars", F.length("text").cast("long"))
