"""URL filters: rules first, trust and distrust over the link graph for the rest.

A rule is a host and the beginning of a path; it fits the host and its subdomains, and the
longest rule that fits decides.  Urls without a rule are judged by their host: links
between hosts form a graph, trust flows along the links from hosts whose pages rules
allow, distrust flows against them from hosts whose pages rules block (who links to blocked
hosts is distrusted), both as personalised PageRank with the same weights, the shares of a
host's links.  So distrust tells how much of its links a host gives to blocked hosts, and
a blocked host with a thousand linkers reaches each of them as it would reach one.  A host is a seed by the share of its
pages that rules allow or block, so a host blocked in one directory alone is no full seed.
Of a host that is linked but has no pages here, as is common for blocked ones, the linked
urls are judged in place of pages.
A host is blocked if its distrust exceeds its trust by three quarters of what a wholly
blocked host has of its own: one that links to such hosts alone has 0.85 of it, one that
links to those linkers alone 0.72.

The graph is one of hosts: links are counted per pair of hosts before any shuffle, and a
turn moves one row per pair.  Every turn is written to the checkpoint folder.  A host with
a third of all pages, or of all links, is a skewed join key, which Spark splits at run time;
its sums are partly aggregated first.

Defined cases: a null url, or one without ``://``, has an empty host and path and no rule;
pages of the empty host are judged like those of any host, which without links and rules is
to allow; null html has no links; links of a host to itself do not count; repeated rows are
repeated in the result and count as pages; an empty table has no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, stored

DAMPING, TURNS, MARGIN = 0.85, 10, 0.75


@dataclass(frozen=True)
class Rule:
    """``text`` is a host and the beginning of a path, as in ``example.com/de/``."""

    verdict: str
    text: str

    @property
    def host(self) -> str:
        return self.text.split("/", 1)[0]

    @property
    def path(self) -> str:
        return "/" + self.text.split("/", 1)[1]


# fixed values: the rules that are asked for
RULES = (Rule("block", "net/"), Rule("allow", "example.net/en/"), Rule("block", "example.com/de/"), Rule("allow", "org/fr/"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def fitting(rules: tuple[Rule, ...], host: Column, path: Column) -> Column:
    """``rule, verdict`` of the longest rule that fits, else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: len(r.text)):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        out = F.when(fits, F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def host_links(pages: DataFrame, url: str = "url", html: str = "html", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``src, dst, n``: links from pages of one host to another host; ``allow, block``: those of them to urls that rules allow or block."""
    targets = F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit(r"""(?i)<a\s[^<>]*?href\s*=\s*["']?\s*((?:https?:)?//[^"'\s>]+)"""), F.lit(1))
    cut = pages.select(host_and_path(F.col(url))[0].alias("src"), F.explode(targets).alias("target"))
    dst, path = host_and_path(F.when(F.startswith("target", F.lit("//")), F.concat(F.lit("http:"), F.col("target"))).otherwise(F.col("target")))
    found = cut.select("src", dst.alias("dst"), path.alias("path")).where("src <> dst AND src <> '' AND dst <> ''")
    found = found.select("src", "dst", fitting(rules, F.col("dst"), F.col("path"))["verdict"].alias("verdict"))
    return found.groupBy("src", "dst").agg(F.count("*").alias("n"), *(F.count(F.when(F.col("verdict") == v, 1)).alias(v) for v in ("allow", "block")))


def flow(seeds: DataFrame, shares: DataFrame, damping: float = DAMPING, turns: int = TURNS) -> DataFrame:
    """``host, rank``: personalised PageRank of the seeds (``host, seed``) along ``src, dst, share``; what a host without links holds is not handed on."""
    own = stored(seeds.select("host", (F.col("seed") * (1 - damping)).alias("own")))
    ranks = own.select("host", F.col("own").alias("rank"))
    if shares.isEmpty():
        return ranks
    for _ in range(turns):
        given = ranks.join(shares, F.col("host") == F.col("src")).select(F.col("dst").alias("host"), (F.col("rank") * F.col("share") * damping).alias("rank"))
        ranks = stored(own.select("host", F.col("own").alias("rank")).unionByName(given).groupBy("host").agg(F.sum("rank").alias("rank")))
    return ranks


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, damping: float = DAMPING, turns: int = TURNS, margin: float = MARGIN) -> DataFrame:
    """``page_id, host, path, rule, verdict`` of every page, and its host's ``trust`` and ``distrust``."""
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path")).select("*", fitting(rules, F.col("host"), F.col("path")).alias("fit"))
    share = lambda v: (F.sum(F.when(F.col("fit.verdict") == v, 1).otherwise(0)) / F.count("*"))
    hosts = stored(rows.groupBy("host").agg(share("allow").alias("allowed"), share("block").alias("blocked")))
    links = stored(host_links(pages, rules=rules))
    linked = links.groupBy(F.col("dst").alias("host")).agg(*((F.sum(v) / F.sum("n")).alias(k) for v, k in (("allow", "allowed"), ("block", "blocked"))))
    seeds = stored(hosts.unionByName(linked.where("allowed > 0 OR blocked > 0").join(hosts, "host", "left_anti")))
    out = links.groupBy("src").agg(F.sum("n").alias("all"))
    shares = stored(links.join(out, "src").select("src", "dst", (F.col("n") / F.col("all")).alias("share")))
    trust = flow(seeds.select("host", F.col("allowed").alias("seed")), shares, damping, turns)
    distrust = flow(seeds.select("host", F.col("blocked").alias("seed")), shares.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "share"), damping, turns)
    scores = hosts.select("host").join(trust.withColumnRenamed("rank", "trust"), "host", "left").join(distrust.withColumnRenamed("rank", "distrust"), "host", "left")
    scores = stored(scores.select("host", F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust")))
    bad = F.col("distrust") - F.col("trust") >= margin * (1 - damping)
    return rows.join(scores, "host").select(
        "page_id", "host", "path", F.col("fit.rule").alias("rule"),
        F.coalesce(F.col("fit.verdict"), F.when(bad, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"), "trust", "distrust")
