"""URL filters (7): rules first, then the reputation of the host by empirical Bayes.

Labelled outcomes of pages are counted for each host. A host with few labels says little, so its rate is shrunk
towards that of its registered domain, which is shrunk towards its suffix, which is shrunk towards all pages. The
weight of each prior is that of a beta-binomial whose spread matches the counts, by moments. A host is blocked if
the lower bound of its posterior rate of bad pages is above a limit: without evidence nothing is blocked.

All of it is DataFrame code. Pages are reduced to hosts inside the scan tasks; only the blocked hosts, few and
narrow, meet the pages again.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martloom.llm.common import join_small, lower_ascii, prepared

#: Bad pages that the lower bound of a blocked host's rate exceeds, and its distance in standard deviations.
LIMIT, DEVIATIONS = 0.5, 1.645
#: Spread of rates between the children of one parent: a weight of 1/0.5 - 1 = 1 page to 1/0.001 - 1 = 999 pages.
LEAST_SPREAD, GREATEST_SPREAD = 0.001, 0.5
# Second-level labels under which domains are registered, where the last label is a country's.
SECOND_LEVEL = ("ac", "co", "com", "edu", "gov", "net", "org")

_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


class Rule(NamedTuple):
    """Fits the host and its subdomains where the path starts with `path`."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    return F.coalesce(lower_ascii(F.regexp_extract(url, _URL, 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def machine_of(host: Column) -> Column:
    """The host without a user before it, a port behind it and the dot of the root."""
    return F.regexp_replace(host, r"^.*@|\.?(?::\d*)?$", "")


def _is_address(machine: Column) -> Column:
    return machine.rlike(r"^(?:\d{1,3}(?:\.\d{1,3}){3}|\[.*\])$")


def suffix_of(host: Column) -> Column:
    """The last label, or the last two where the one before a country's is a common second level; of an address `ip`,
    which no name ends in."""
    machine = machine_of(host)
    label = F.regexp_extract(machine, rf"((?:(?:^|\.)(?:{'|'.join(SECOND_LEVEL)})\.[a-z]{{2}}|(?:^|\.)[^.]*))$", 1)
    return F.when(_is_address(machine), "ip").otherwise(label)


def domain_of(host: Column) -> Column:
    """The suffix and the label before it; an address is a domain of its own."""
    machine = machine_of(host)
    domain = F.regexp_extract(machine, rf"([^.]*(?:\.(?:{'|'.join(SECOND_LEVEL)})\.[a-z]{{2}}|\.[^.]*)|[^.]*)$", 1)
    return F.when(_is_address(machine), machine).otherwise(domain)


def fitting_rule(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, else null."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        text, verdict = F.when(fits, rule.text).otherwise(text), F.when(fits, rule.verdict).otherwise(verdict)
    return text, verdict


def _shrunk(children: DataFrame, parent: str, mean: Column, ws, name: str) -> DataFrame:
    """Adds the posterior of each child's rate: prior of the parent's mean, weight by the spread of siblings.

    `children` has n, bad and, as `mean`, the parent's posterior mean.
    """
    counted = ws.save(children.withColumn("prior", mean), name).df
    chance = F.col("prior") * (1 - F.col("prior"))
    sums = counted.where("n > 0").agg(
        F.sum(F.col("n") * F.pow(F.col("bad") / F.col("n") - F.col("prior"), 2) - chance).alias("over"),
        F.sum((F.col("n") - 1) * chance).alias("scale"),
    )
    over, scale = sums.first()
    # rounded, as sums of doubles differ in their last digits from one run to the next
    spread = min(GREATEST_SPREAD, max(LEAST_SPREAD, round((over or 0.0) / scale, 9))) if scale else GREATEST_SPREAD
    weight = F.lit(1 / spread - 1)
    return (
        counted.withColumn("a", F.col("bad") + weight * F.col("prior"))
        .withColumn("b", F.col("n") - F.col("bad") + weight * (1 - F.col("prior")))
        .withColumn("rate", F.col("a") / (F.col("a") + F.col("b")))
        .drop("prior")
    )


def reputations(outcomes: DataFrame) -> DataFrame:
    """host, domain, suffix, n, bad, rate, lower: of every host of `outcomes` (host, n, bad).

    A host without labels has its domain's rate as prior. An empty table gives an empty result.
    """
    ws = prepared(outcomes.sparkSession)
    hosts = outcomes.groupBy("host").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    hosts = ws.save(hosts.withColumn("domain", domain_of(F.col("host"))).withColumn("suffix", suffix_of(F.col("host"))), "hosts").df
    sums = [F.sum("n").alias("n"), F.sum("bad").alias("bad")]
    everything = hosts.agg(*sums).first()
    overall = (everything.bad or 0) / everything.n if everything.n else 0.0
    suffixes = _shrunk(hosts.groupBy("suffix").agg(*sums), "", F.lit(float(overall)), ws, "suffixes")
    domains = hosts.groupBy("domain", "suffix").agg(*sums).join(suffixes.select("suffix", F.col("rate").alias("above")), "suffix")
    domains = _shrunk(domains, "suffix", F.col("above"), ws, "domains").drop("above")
    hosts = hosts.join(domains.select("domain", "suffix", F.col("rate").alias("above")), ["domain", "suffix"])
    hosts = _shrunk(hosts, "domain", F.col("above"), ws, "shrunk").drop("above")
    total = F.col("a") + F.col("b")
    deviation = F.sqrt(F.col("a") * F.col("b") / (total * total * (total + 1)))
    lower = F.coalesce(F.col("rate") - DEVIATIONS * deviation, F.lit(0.0))
    return hosts.select("host", "domain", "suffix", "n", "bad", F.coalesce("rate", F.lit(0.0)).alias("rate"), lower.alias("lower"))


def url_filter(
    pages: DataFrame, outcomes: DataFrame, rules: Sequence[Rule], limit: float = LIMIT, id_col: str = "page_id", url_col: str = "url"
) -> DataFrame:
    """page_id, host, path, rule, verdict of every page; verdict is "allow" or "block".

    `outcomes` (page_id, bad 0/1) labels some pages; of several labels of a page the worst counts, null labels do
    not. A null url, or one without "://", has an empty host and path, fits no rule and is allowed. Repeated pages
    are judged, and counted, one by one. Empty tables are fine. Other columns are not looked at.
    """
    ws = prepared(pages.sparkSession)
    url = pages[url_col].cast("string")
    rows = pages.select(pages[id_col].cast("long").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    rows = ws.save(rows, "urls").df
    labels = outcomes.select(F.col("page_id").cast("long"), F.col("bad").cast("int")).where("bad IS NOT NULL")
    labels = labels.groupBy("page_id").agg(F.max("bad").alias("bad"))
    labelled = rows.select("page_id", "host").join(labels, "page_id", "left")
    counted = labelled.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    blocked = reputations(counted).where((F.col("lower") > limit) & (F.col("host") != "")).select("host", F.lit(True).alias("blocked"))
    blocked = ws.save(blocked, "blocked")
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("blocked"), "block").otherwise("allow")
    judged = join_small(rows, blocked.df, blocked.rows, "host", "left")
    return judged.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"))
