"""Page filters by URL rules and by trust that spreads over the links between hosts.

A page's verdict is that of the longest rule that fits its URL. Where none fits, its host decides.
A host of which more than half of the pages are allowed by rules is a trusted seed; one of which more
than half are blocked is a blocked seed. Trust spreads along links (personalised PageRank from the
trusted seeds), distrust against them (the same from the blocked seeds over reversed links, so that
a host which links to blocked ones is distrusted). A host with at least `least` of one seed's mass in distrust, and
more of it than trust, is blocked; every other host is allowed.

All steps are joins and aggregations of hosts: a host's rows meet as partial counts, links as distinct
pairs of hosts with their number of pages. Masses are whole numbers, so sums do not depend on their order.
The series of the PageRank is summed term by term until no mass is left to pass on, `rounds` terms at
most (after 20 terms at a damping of 0.85, 4 % of the mass is still under way). Mass at hosts without links is not
dealt back to the seeds: that scales all masses of a kind alike.

Odd rows. A null URL, or one without "://", has empty host and path; the empty host takes no part in
links or seeds and is allowed. A null or empty `html` has no links. Repeated rows count as
often as they occur. A null `page_id` is kept. Extra columns are not looked at. An empty table gives an empty result.
Very long URLs and texts are read whole.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barscreen.llm.common import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Absolute and scheme-relative targets of anchors; the group is the host.
LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']?(?:https?:)?//([^/?#"'\s>]+)"""
#: Mass of one seed.
SEED = 1_000_000_000


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str


def parse_rule(text: str) -> Rule:
    """`block net/` as verdict, host and path."""
    verdict, place = text.split()
    host, slash, path = place.partition("/")
    if verdict not in ("allow", "block") or not host or not slash:
        raise ValueError(f"not a rule: {text!r}")
    return Rule(verdict, host, slash + path)


def plain_lower(text: Column) -> Column:
    """A to Z lower-cased, all other letters as they are."""
    return F.translate(text, UPPER, LOWER)


def url_parts(pages: DataFrame) -> DataFrame:
    """`pages` as (page_id, host, path, html)."""
    url = F.coalesce(F.col("url"), F.lit(""))
    begin = F.locate("://", url)
    after = F.when(begin > 0, F.substring(url, begin + 3, F.length(url))).otherwise("")
    raw = F.regexp_extract("after", r"^[^/?#]*", 0)
    rest = F.substring(F.col("after"), F.length(raw) + 1, F.length("after"))
    return pages.select("page_id", "html", after.alias("after")).select(
        "page_id",
        plain_lower(raw).alias("host"),
        F.regexp_extract(rest, r"^[^?#]*", 0).alias("path"),
        "html",
    )


def rules_of_hosts(hosts: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """(host, fitting) of the distinct `hosts` that rules fit: their rules, longest first.

    A host meets the rules by its last labels, no more of them than the longest rule host has.
    """
    spark = hosts.sparkSession
    listed = spark.createDataFrame(
        [(r.host, r.path, r.host + r.path, r.verdict) for r in rules],
        "rule_host string, rule_path string, rule string, rule_verdict string",
    )
    most = max((r.host.count(".") + 1 for r in rules), default=1)
    labels = F.split("host", r"\.")
    ends = F.expr(
        f"transform(sequence(greatest(1, size(labels) - {most - 1}), size(labels)),"
        " i -> array_join(slice(labels, i, size(labels)), '.'))"
    )
    ended = hosts.withColumn("labels", labels).select("host", F.explode(ends).alias("rule_host"))
    fitting = F.struct(
        (-F.length("rule")).alias("shorter"), (-F.length("rule_host")).alias("wider"), "rule", "rule_path", "rule_verdict"
    )
    found = ended.join(listed, "rule_host").select("host", fitting.alias("fitting"))
    return found.groupBy("host").agg(F.sort_array(F.collect_set("fitting")).alias("fitting"))


def ruled(parts: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """(page_id, host, path, rule, rule_verdict); the last two are null where no rule fits."""
    fitting = rules_of_hosts(parts.select("host").distinct(), rules)
    best = F.expr("get(filter(fitting, r -> startswith(path, r.rule_path)), 0)")
    return (
        parts.select("page_id", "host", "path")
        .join(fitting, "host", "left")
        .withColumn("best", best)
        .select("page_id", "host", "path", "best.rule", "best.rule_verdict")
    )


def host_links(parts: DataFrame) -> DataFrame:
    """(src, dst, pages): hosts that link to other hosts, and the number of pages that do."""
    pages = parts.where("host <> '' and contains(html, '//')")
    targets = F.transform(F.regexp_extract_all("html", F.lit(LINK), F.lit(1)), plain_lower)
    links = pages.select(F.col("host").alias("src"), F.explode(F.array_distinct(targets)).alias("dst"))
    links = links.where("src <> dst")
    return links.groupBy("src", "dst").agg(F.count("*").alias("pages"))


def flows_of(links: DataFrame) -> DataFrame:
    """(kind, start, end, share): how a host's trust and distrust divide among its neighbours."""
    both = F.array(
        F.struct(F.lit("trust").alias("kind"), F.col("src").alias("start"), F.col("dst").alias("end")),
        F.struct(F.lit("distrust").alias("kind"), F.col("dst").alias("start"), F.col("src").alias("end")),
    )
    ways = links.select(F.explode(both).alias("way"), "pages").select("way.*", "pages")
    total = ways.groupBy("kind", "start").agg(F.sum("pages").alias("total"))
    share = F.col("pages").cast("double") / F.col("total").cast("double")
    return ways.join(total, ["kind", "start"]).select("kind", "start", "end", share.alias("share"))


def seeds_of(judged: DataFrame) -> DataFrame:
    """(kind, host, mass) of the hosts that rules allow, or block, in more than half of their pages."""
    counts = judged.where("host <> ''").groupBy("host").agg(
        F.count("*").alias("pages"),
        F.count_if(F.col("rule_verdict") == "allow").alias("allowed"),
        F.count_if(F.col("rule_verdict") == "block").alias("blocked"),
    )
    kind = F.when(2 * F.col("allowed") > F.col("pages"), "trust").when(
        2 * F.col("blocked") > F.col("pages"), "distrust"
    )
    seeds = counts.select(kind.alias("kind"), "host", F.lit(SEED).cast("bigint").alias("mass"))
    return seeds.where("kind is not null")


def propagated(seeds: DataFrame, flows: DataFrame, damping: float, rounds: int) -> DataFrame:
    """(host, trust, distrust) of every host that mass reaches: the PageRank series up to `rounds` terms."""
    terms = [stored(seeds, "mass")]
    moved = F.floor(F.col("mass").cast("double") * F.lit(damping) * F.col("share")).cast("bigint")
    for _ in range(rounds):
        sent = flows.join(terms[-1].withColumnRenamed("host", "start"), ["kind", "start"])
        sent = sent.select("kind", F.col("end").alias("host"), moved.alias("mass"))
        sent = sent.groupBy("kind", "host").agg(F.sum("mass").alias("mass")).where("mass > 0")
        terms.append(stored(sent, "mass"))
        if terms[-1].isEmpty():
            break
    every = terms[0]
    for term in terms[1:]:
        every = every.union(term)
    of_kind = {k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("mass"))), F.lit(0)) for k in ("trust", "distrust")}
    return every.groupBy("host").agg(*[column.alias(k) for k, column in of_kind.items()])


def filtered(
    pages: DataFrame,
    rules: Sequence[Rule],
    damping: float = 0.85,
    rounds: int = 20,
    least: float = 0.01,
) -> DataFrame:
    """Every page's (page_id, host, path, rule, verdict, trust, distrust); the masses are its host's."""
    parts = url_parts(pages)
    judged = stored(ruled(parts, rules), "judged-pages")
    flows = stored(flows_of(stored(host_links(parts), "host-links")), "host-flows")
    masses = propagated(seeds_of(judged), flows, damping, rounds)
    distrusted = (F.col("distrust") >= int(least * SEED)) & (F.col("distrust") > F.col("trust"))
    return judged.join(masses, "host", "left").select(
        "page_id",
        "host",
        "path",
        "rule",
        F.coalesce("rule_verdict", F.when(distrusted, "block"), F.lit("allow")).alias("verdict"),
        F.coalesce("trust", F.lit(0)).alias("trust"),
        F.coalesce("distrust", F.lit(0)).alias("distrust"),
    )
