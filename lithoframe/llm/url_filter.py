"""URL filters: explicit rules, and link-graph propagation for the urls that no rule fits.

Hosts are nodes; a link from a page to an address on another host is an edge, once
per pair of hosts, weighted by its number of links. Hosts with urls that a rule
allows are trusted seeds, hosts with urls that a rule blocks are blocked seeds, in
proportion to such urls. Trust is personalised PageRank from the trusted seeds
along links; distrust is the same from the blocked seeds along reversed links, so
that it reaches hosts which link to blocked ones. A host is blocked if its distrust
is positive and at least ``threshold`` times its trust.

Links are counted per pair of hosts before anything is joined, so a host with very
many pages is one row; ranks are summed with a combine before the shuffle. Rounds
end when the ranks move by less than ``tolerance`` in total; round k moves them by
2 * damping ** k at most, so that ends every run. Rank that reaches hosts without links goes back to the seeds, so trust
and distrust each sum to one. What later rounds would move is left
out: less than tolerance * damping / (1 - damping) in total.

A null url, or one without ``://``, has an empty host and path, fits no rule and
belongs to the empty host, which has no links. Null html has no links. Repeated
rows each get their verdict, and count as often as seeds and links. Columns of the
input that clash with the output's are replaced.
"""

from __future__ import annotations

import math
import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialize, release

#: Hosts whose verdicts may be broadcast; more are joined by a shuffle.
BROADCAST_HOSTS = 50_000
_LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']?((?:[a-z][a-z0-9+.-]*:)?//[^"'>\s]+)"""


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    @staticmethod
    def of(verdict: str, text: str) -> Rule:
        host, _, path = text.partition("/")
        return Rule(verdict, host, "/" + path)


#: The rules of the query.
RULES = (Rule.of("block", "com/en/"), Rule.of("allow", "example.com/en/7"), Rule.of("allow", "net/de/"), Rule.of("block", "example.net/de/8"), Rule.of("block", "org/es/"))


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for a null and without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _by_rule(rules: tuple[Rule, ...], pick) -> Column:
    """``pick(rule)`` of the longest rule that fits ``host`` and ``path``, else null."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith(r.path)
        out = F.when(fits, F.lit(pick(r))).otherwise(out)
    return out


def host_links(pages: DataFrame) -> DataFrame:
    """source, target, n of links between different hosts, from columns host and html."""
    links = pages.select("host", F.explode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(_LINK), F.lit(1))).alias("__url"))
    links = links.withColumn("__url", F.when(F.col("__url").startswith("//"), F.concat(F.lit("http:"), F.col("__url"))).otherwise(F.col("__url")))
    return links.select(F.col("host").alias("source"), url_parts(F.col("__url"))[0].alias("target")).filter("source <> target and source <> '' and target <> ''").groupBy("source", "target").agg(F.count(F.lit(1)).alias("n"))


def page_rank(links: DataFrame, seeds: DataFrame, damping: float = 0.85, rounds: int | None = None, tolerance: float = 1e-6) -> DataFrame:
    """host, rank: personalised PageRank of ``seeds`` (host, weight) over ``links`` (source, target, n). Materialised. ``rounds``: as many as ``tolerance`` needs if None."""
    if rounds is None:
        rounds = math.ceil(math.log(tolerance / 2) / math.log(damping)) + 1
    total = seeds.agg(F.sum("weight")).first()[0] or 0
    base = seeds.filter("weight > 0").select("host", (F.col("weight") / F.lit(float(total or 1))).alias("base"))
    out_links = links.groupBy("source").agg(F.sum("n").alias("all"))
    shares = materialize(links.join(out_links, "source").select("source", "target", (F.col("n") / F.col("all")).alias("share")), "shares")
    ranks = materialize(base.select("host", F.col("base").alias("rank")), "ranks")
    for _ in range(rounds if shares.take(1) else 0):
        moved = ranks.join(shares, ranks.host == shares.source).select(F.col("target").alias("host"), (damping * F.col("rank") * F.col("share")).alias("part"))
        step = moved.unionByName(base.select("host", ((1 - damping) * F.col("base")).alias("part"))).groupBy("host").agg(F.sum("part").alias("rank"))
        step = materialize(step, "ranks")
        change = step.join(ranks.withColumnRenamed("rank", "was"), "host", "full").agg(F.sum(F.abs(F.coalesce("rank", F.lit(0.0)) - F.coalesce("was", F.lit(0.0))))).first()[0] or 0.0
        release([ranks])
        ranks = step
        if change < tolerance:
            break
    release([shares])
    return ranks


def _whole(ranks: DataFrame) -> DataFrame:
    """Ranks that sum to one. The same as giving what reaches hosts without links back to the seeds, which multiplies all ranks by one number."""
    total = ranks.agg(F.sum("rank")).first()[0] or 1.0
    return ranks.withColumn("rank", F.col("rank") / F.lit(float(total)))


def host_verdicts(ruled: DataFrame, links: DataFrame, threshold: float = 1.0) -> DataFrame:
    """host, trust, distrust, verdict of all hosts that seeds or links reach; ``ruled`` has host and verdict (of a rule, else null)."""
    seeds = materialize(ruled.groupBy("host").agg(F.count_if(F.col("verdict") == "allow").alias("good"), F.count_if(F.col("verdict") == "block").alias("bad")), "seeds")
    links = materialize(links, "links")
    trust = _whole(page_rank(links, seeds.select("host", F.col("good").alias("weight"))))
    distrust = _whole(page_rank(links.select(F.col("target").alias("source"), F.col("source").alias("target"), "n"), seeds.select("host", F.col("bad").alias("weight"))))
    both = trust.withColumnRenamed("rank", "trust").join(distrust.withColumnRenamed("rank", "distrust"), "host", "full").na.fill(0.0)
    return both.withColumn("verdict", F.when((F.col("distrust") > 0) & (F.col("distrust") >= threshold * F.col("trust")), "block").otherwise("allow"))


def judge_urls(pages: DataFrame, rules: tuple[Rule, ...] = RULES, *, url_col: str = "url", html_col: str = "html", carry: list[str] | None = None, threshold: float = 1.0) -> DataFrame:
    """``carry`` (all columns if None) plus host, path, rule, verdict."""
    made = ("host", "path", "rule", "verdict")
    carry = [c for c in (pages.columns if carry is None else carry) if c not in made]
    own = pages.select(*[F.col(f"`{c}`") for c in carry], F.col(url_col).cast("string").alias("__url"), F.col(html_col).cast("string").alias("__html"))
    host, path = url_parts(F.col("__url"))
    own = own.select(*carry, "__html", host.alias("host"), path.alias("path"))
    own = own.withColumn("rule", _by_rule(rules, lambda r: r.name)).withColumn("ruled", _by_rule(rules, lambda r: r.verdict))
    links = host_links(own.select("host", F.col("__html").alias("html")))
    hosts = materialize(host_verdicts(own.select("host", F.col("ruled").alias("verdict")), links, threshold).filter("verdict = 'block'").select("host", F.lit("block").alias("by_host")), "hosts")
    few = hosts.count() <= BROADCAST_HOSTS
    judged = own.drop("__html").join(F.broadcast(hosts) if few else hosts, "host", "left")
    return judged.select(*carry, "host", "path", "rule", F.coalesce("ruled", "by_host", F.lit("allow")).alias("verdict"))
