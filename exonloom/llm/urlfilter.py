"""Allow or block URLs by rules and by the reputation of their hosts.

The bad share of a host is estimated by empirical Bayes: a host with few labelled pages is drawn to
its registered domain, that to its suffix, that to all.  On each level the strength of the draw comes
from the data, by the moments of a beta-binomial: what varies more between groups than chance allows
weakens the draw.  A host is blocked when the lower bound of its posterior lies above a share.

DataFrame functions only.  Labels are summed by host before anything is shuffled, so a hot host is one
row per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from exonloom.llm.linededup import fold

#: Suffixes of two labels under which names are registered (fixed values; a parameter).
TWO_LABEL_SUFFIXES = ("ac.uk", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.au", "com.br", "com.cn", "gov.uk", "org.uk")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host after the first ``://`` up to ``/ ? #`` with A-Z lower-cased, and the path after it up to ``? #``.

    Null, or no ``://``: both empty.
    """
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(F.regexp_extract(rest, r"(?s)^[^?#]*", 0), F.lit(""))
    slash = F.locate("/", rest)
    host = F.when(slash > 0, F.substr(rest, F.lit(1), slash - 1)).otherwise(rest)
    path = F.when(slash > 0, F.substr(rest, slash)).otherwise(F.lit(""))
    return fold(host), path


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """The longest fitting rule ``(host, path, verdict)`` as ``struct(rule, verdict)``, or null.

    A rule fits its host and all hosts under it when the path starts with its own.  Among equally long
    ones the longer host wins.  The list is a parameter, meant for hand-written rules.
    """
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), len(r[0]))):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def domain_and_suffix(host: Column, two_label: Sequence[str] = TWO_LABEL_SUFFIXES) -> tuple[Column, Column]:
    """Registered domain and suffix of a host; its port is left out."""
    bare = F.regexp_replace(host, r":\d*$", "")
    last = F.substring_index(bare, ".", -1)
    two = F.substring_index(bare, ".", -2)
    long = two.isin(*two_label)
    return F.when(long, F.substring_index(bare, ".", -3)).otherwise(two), F.when(long, two).otherwise(last)


def _strength(groups: DataFrame) -> float:
    """Prior strength from ``n``, ``bad`` and the prior mean ``m`` of all groups with a label."""
    spread = F.col("n") * F.pow(F.col("bad") / F.col("n") - F.col("m"), 2) / (F.col("m") * (1 - F.col("m")))
    row = groups.filter("n > 0 and m > 0 and m < 1").agg(
        F.sum(spread).alias("x"), F.count("*").alias("k"), F.sum(F.col("n") - 1).alias("d")
    ).first()
    rho = (row["x"] - row["k"]) / row["d"] if row["d"] else 0.5
    rho = min(max(rho, 0.001), 0.5)
    return 1 / rho - 1


def reputations(hosts: DataFrame, two_label: Sequence[str] = TWO_LABEL_SUFFIXES) -> DataFrame:
    """``host, n, bad, mean, sd``: the posterior of every host of ``hosts(host, n, bad)``.

    Runs one small aggregate per level (strengths are scalars).  Hosts without labels get their prior.
    """
    domain, suffix = domain_and_suffix(F.col("host"), two_label)
    hosts = hosts.withColumn("domain", domain).withColumn("suffix", suffix)
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    total = suffixes.agg(F.sum("bad").alias("bad"), F.sum("n").alias("n")).first()
    overall = ((total["bad"] or 0) + 1) / ((total["n"] or 0) + 2)

    def posterior(groups: DataFrame) -> tuple[DataFrame, float]:
        s = _strength(groups)
        return groups.withColumn("p", (F.lit(s) * F.col("m") + F.col("bad")) / (F.lit(s) + F.col("n"))), s

    suffixes, _ = posterior(suffixes.withColumn("m", F.lit(overall)))
    domains, _ = posterior(domains.join(suffixes.select("suffix", F.col("p").alias("m")), "suffix"))
    hosts, s = posterior(hosts.join(domains.select("domain", "suffix", F.col("p").alias("m")), ["domain", "suffix"]))
    sd = F.sqrt(F.col("p") * (1 - F.col("p")) / (F.lit(s) + F.col("n") + 1))
    return hosts.select("host", "n", "bad", F.col("p").alias("mean"), sd.alias("sd"))


def judge(
    pages: DataFrame, outcomes: DataFrame, rules: Sequence[tuple[str, str, str]] = (), key: str = "page_id",
    url: str = "url", z: float = 1.645, most_bad: float = 0.25,
) -> DataFrame:
    """``key, host, path, rule, verdict, bad_share, bound`` for every page.

    ``outcomes(key, bad)`` labels some pages with 0 or 1; repeated labels of a key count once, as bad if
    any is, and null ones not at all.  The verdict is the rule's, else ``block`` where the mean less ``z``
    deviations is at least ``most_bad``.  Null urls have an empty host and are judged as that host.
    Repeated pages each give a row; a null key has no label; other columns are ignored; an empty
    table gives an empty result.
    """
    host, path = host_and_path(F.col(url))
    parts = pages.select(F.col(key).alias("k"), host.alias("host"), path.alias("path"))
    label = outcomes.filter("bad is not null").groupBy(F.col(key).alias("k")).agg(F.max("bad").cast("long").alias("bad"))
    hosts = parts.join(label, "k", "left").groupBy("host").agg(
        F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")
    )
    known = reputations(hosts).withColumn("bound", F.col("mean") - F.lit(z) * F.col("sd"))
    out = parts.join(known.select("host", "mean", "bound"), "host").withColumn(
        "r", rule_of(F.col("host"), F.col("path"), rules)
    )
    own = F.when(F.col("bound") >= most_bad, "block").otherwise("allow")
    return out.select(
        F.col("k").alias(key), "host", "path", F.col("r.rule").alias("rule"),
        F.coalesce("r.verdict", own).alias("verdict"), F.col("mean").alias("bad_share"), "bound",
    )
