"""URL verdicts: rules for hosts and paths, and trust and distrust over the host link graph.

A rule (host, path, verdict) fits its host and all subdomains if the url's path starts
with the rule's; the longest rule wins. Urls that no rule fits get the verdict of their
host: personalised PageRank carries trust along the links from trusted hosts; distrust
goes against the links, from blocked hosts to those that link to them, each of which
takes it by the share of its own links that goes there. So what a host gets depends on
where it links, not on how many others link there too. A host whose distrust reaches the
threshold and exceeds its trust is blocked.
Seeds are the hosts of which more than half of the pages are allowed, or blocked, by
rules. Links are counted by pair of hosts before any shuffle, so the page count of a host
doesn't matter to the iterations.

Defined results: a null url, or one without ://, has an empty host and path, fits no rule
and is allowed. Null, empty or very long html gives the links it holds, none if null; an
empty table gives no rows. Ties: equal trust and distrust allow; of rules of equal length
the first listed counts. Repeated rows return repeated rows (and count as pages and links
each); extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, small

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: What may be missing of a score, and rounds after which flows are added up.
DAMPING, ENOUGH, COMPACT_EVERY = 0.85, 1e-7, 20
#: Distrust that blocks a host; a seed has 0.15 of its own, a host that links only to seeds without links 0.1275.
THRESHOLD = 0.02
_LINK = r"""(?i)\bhref\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s>]+)"""


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def ruled(host: Column, path: Column, rules: tuple) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null without one."""
    rule = verdict = None
    for does, name, prefix in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(prefix)
        rule = (F.when if rule is None else rule.when)(fits, name + prefix)
        verdict = (F.when if verdict is None else verdict.when)(fits, does)
    return rule, verdict


def host_links(pages: DataFrame) -> DataFrame:
    """Counted links between different hosts: src, dst, n."""
    links = pages.select(host_of(F.col("url")).alias("src"), F.explode(F.regexp_extract_all("html", F.lit(_LINK), 1)).alias("to"))
    dst = F.translate("to", UPPER, LOWER)
    return links.select("src", dst.alias("dst")).where("src <> '' and dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def propagate(links: DataFrame, seeds: DataFrame, against: bool = False) -> DataFrame:
    """Personalised PageRank of (src, dst, n) from seeds (host): host, score. Seeds count 1 each; what leaves the graph is lost.

    Against the links, a host gets from each host it links to by the share of its own links.
    The score is the sum of the flows that have gone over 0, 1, 2, ... links, each of them
    what the one before passes on. The loop ends when what may still come is below ENOUGH:
    a flow's sum (its largest value, against the links, where shares of one host add up to
    at most one) shrinks by DAMPING or more with each link. A host with very many links is
    one side of an equi-join with a unique key, which is split at run time.
    """
    giver, taker = ("dst", "src") if against else ("src", "dst")
    out = links.groupBy("src").agg(F.sum("n").alias("total"))
    share = materialize(links.join(out, "src").select(F.col(giver).alias("host"), F.col(taker).alias("to"), (DAMPING * F.col("n") / F.col("total")).alias("w")), "shares")
    flow = total = materialize(seeds.select("host", F.lit(1 - DAMPING).alias("score")), "flow")
    parts = [flow]
    left = F.max("score") if against else F.sum("score")
    while True:
        flow = materialize(share.join(flow, "host").groupBy(F.col("to").alias("host")).agg(F.sum(F.col("w") * F.col("score")).alias("score")), "flow")
        parts.append(flow)
        total = total.unionByName(flow)
        if (flow.agg(left).first()[0] or 0) * DAMPING / (1 - DAMPING) < ENOUGH:
            break
        if len(parts) > COMPACT_EVERY:
            total = materialize(total.groupBy("host").agg(F.sum("score").alias("score")), "rank")
            discard(*parts[:-1])
            parts = [total, flow]
    out = materialize(total.groupBy("host").agg(F.sum("score").alias("score")), "rank")
    discard(share, *parts)
    return out


def host_verdicts(judged: DataFrame, links: DataFrame) -> DataFrame:
    """host, blocked (boolean) for all hosts that the propagation reaches. judged: host, verdict (by rules, or null)."""
    tally = judged.where("host <> ''").groupBy("host").agg(F.count("*").alias("n"), F.count_if(F.col("verdict") == "allow").alias("good"), F.count_if(F.col("verdict") == "block").alias("bad"))
    tally = materialize(tally, "hosts")
    links = materialize(links, "links")
    trust = propagate(links, tally.where("2 * good > n").select("host")).withColumnRenamed("score", "trust")
    distrust = propagate(links, tally.where("2 * bad > n").select("host"), against=True).withColumnRenamed("score", "distrust")
    both = distrust.join(trust, "host", "left")
    return both.select("host", ((F.col("distrust") >= THRESHOLD) & (F.col("distrust") > F.coalesce("trust", F.lit(0.0)))).alias("blocked"))


def filter_urls(pages: DataFrame, rules: tuple = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict for every row of pages (page_id, url, html, ...)."""
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    judged = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    rule, verdict = ruled(F.col("host"), F.col("path"), rules)
    judged = judged.select("*", rule.alias("rule"), verdict.alias("verdict"))
    hosts = materialize(host_verdicts(judged, host_links(pages)).where("blocked"), "blocked")
    # Only rows without a rule need their host's verdict.
    open_ = judged.where("verdict is null").join(small(hosts), "host", "left").withColumn("verdict", F.when(F.col("blocked"), "block").otherwise("allow"))
    return judged.where("verdict is not null").unionByName(open_.select(judged.columns))
