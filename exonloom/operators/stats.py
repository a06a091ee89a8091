"""Group statistics.

Ranks and quantiles are exact and never sort a whole group in one task: values are first
collapsed to (group, value, count), dealt by ranges of (group, value) and numbered range by range.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from exonloom.operators.scan import sum_below, with_key
from exonloom.session import cut_lineage


# ---------------------------------------------------------------- ranks and quantiles

def value_counts_before(df: DataFrame, keys: Sequence[str], value: str, blocks: int | None = None) -> DataFrame:
    """``(keys, value, n, before)``: copies of each value and rows of its group below it."""
    df, keys, whole = with_key(df, keys)
    n = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    return sum_below(n, keys, value, "n", "before", blocks).drop(*(["_all"] if whole else []))


def average_ranks(df: DataFrame, keys: Sequence[str], value: str, name: str = "avg_rank", blocks: int | None = None) -> DataFrame:
    """Every row with the average rank of its value in its group (ties share the mean)."""
    ranks = value_counts_before(df, keys, value, blocks).select(
        *keys, value, (F.col("before") + (F.col("n") + 1) / 2).alias(name)
    )
    return df.join(ranks, [*keys, value])


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probabilities: Sequence[float], blocks: int | None = None
) -> DataFrame:
    """Linearly interpolated quantiles ``(keys, p, quantile)``, exact at any size."""
    df, keys, whole = with_key(df, keys)
    counted = value_counts_before(df, keys, value, blocks)
    totals = counted.groupBy(*keys).agg(F.sum("n").alias("_total"))
    holds = lambda i: (F.col("before") <= i) & (i < F.col("before") + F.col("n"))
    wanted = lambda p: holds(F.floor((F.col("_total") - 1) * p)) | holds(F.ceil((F.col("_total") - 1) * p))
    # a value is kept only for the probabilities whose ranks it holds, so few rows are made
    asked = counted.join(totals, keys).withColumn(
        "p", F.explode(F.filter(F.array(*[F.lit(float(p)) for p in probabilities]), wanted))
    )
    h = (F.col("_total") - 1) * F.col("p")
    ends = asked.filter(holds(F.floor(h)) | holds(F.ceil(h))).groupBy(*keys, "p").agg(
        F.max(F.when(holds(F.floor(h)), F.col(value))).alias("_lo"),
        F.max(F.when(holds(F.ceil(h)), F.col(value))).alias("_hi"),
        F.first(h - F.floor(h)).alias("_w"),
    )
    return ends.select(*([] if whole else keys), "p", (F.col("_lo") + F.col("_w") * (F.col("_hi") - F.col("_lo"))).alias("quantile"))


def quantile_bins(df: DataFrame, keys: Sequence[str], value: str, bins: int, name: str = "quantile_bin") -> DataFrame:
    """Right-closed quantile bins 0.. with repeated edges dropped (the lowest value is in bin 0)."""
    df, keys, whole = with_key(df, keys)
    edges = exact_quantiles(df, keys, value, [i / bins for i in range(bins + 1)]).groupBy(*keys).agg(
        F.array_sort(F.collect_set("quantile")).alias("_edges")
    )
    edges = cut_lineage(edges)  # stored, so that Spark knows its size and does not shuffle the rows by few keys
    below = lambda v: F.size(F.filter(F.slice("_edges", 2, bins + 1), lambda e: v > e))
    return df.join(edges, keys).withColumn(name, below(F.col(value)).cast("bigint")).drop(
        "_edges", *(["_all"] if whole else [])
    )


def fixed_bin(distance: Column | str, width: int) -> Column:
    """Left edge of the fixed-width bin of a non-negative integer distance."""
    d = F.col(distance) if isinstance(distance, str) else distance
    return F.floor(d / F.lit(width)) * F.lit(width)


# ---------------------------------------------------------------- moments

# Half-width factor of the reported 95 % interval (fixed value).
CI_FACTOR = 1.95


def mean_interval(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    stats = df.groupBy(*keys).agg(
        F.avg(value).alias("mean"), F.count(value).alias("n"), F.stddev_samp(value).alias("sd")
    )
    half = F.lit(CI_FACTOR) * F.col("sd") / F.sqrt("n")
    return stats.withColumns({"ci_low": F.col("mean") - half, "ci_high": F.col("mean") + half})


def profile(df: DataFrame, keys: Sequence[str], position: str, value: str, bins: int) -> DataFrame:
    """Mean and interval of ``value`` per quantile bin of ``position`` within the keys."""
    binned = quantile_bins(df, keys, position, bins)
    return mean_interval(binned, [*keys, "quantile_bin"], value)


def percentages(df: DataFrame, whole: Sequence[str], part: Sequence[str]) -> DataFrame:
    """Counts per (whole, part) with their percentage of the whole."""
    n = df.groupBy(*whole, *part).agg(F.count(F.lit(1)).alias("n"))
    total = n.groupBy(*whole).agg(F.sum("n").alias("total"))
    return n.join(total, list(whole)).withColumn("percentage", 100.0 * F.col("n") / F.col("total"))


def deviations(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Rows per key whose absolute value exceeds the key's own sample deviation."""
    sd = df.groupBy(*keys).agg(F.stddev_samp(value).alias("_sd"))
    return df.join(sd, list(keys)).groupBy(*keys).agg(
        F.count_if(F.abs(F.col(value)) > F.col("_sd")).alias("n_deviating"), F.count(F.lit(1)).alias("n")
    )


def z_scores(df: DataFrame, row: Sequence[str], value: str, name: str = "z") -> DataFrame:
    """Value minus row mean over row sample deviation, for heat maps in long form."""
    m = df.groupBy(*row).agg(F.avg(value).alias("_m"), F.stddev_samp(value).alias("_sd"))
    return df.join(m, list(row)).withColumn(
        name, F.when(F.col("_sd") != 0, (F.col(value) - F.col("_m")) / F.col("_sd"))
    ).drop("_m", "_sd")


# ---------------------------------------------------------------- distribution tails (small helpers)

def _incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta by the usual continued fraction."""
    from math import exp, lgamma, log

    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - _incomplete_beta(b, a, 1 - x)
    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log(1 - x)) / a
    tiny = 1e-300
    c, d = 1.0, 0.0
    f = 1.0
    for i in range(400):
        m = i // 2
        if i == 0:
            step = 1.0
        elif i % 2 == 0:
            step = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            step = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 + step * d
        d = 1 / (d if abs(d) > tiny else tiny)
        c = 1 + step / (c if abs(c) > tiny else tiny)
        f *= c * d
        if i and abs(1 - c * d) < 1e-14:
            break
    return front * (f - 1)


def t_two_sided(t: float, df: float) -> float:
    return _incomplete_beta(df / 2, 0.5, df / (df + t * t))


def t_critical(df: float, alpha: float = 0.05) -> float:
    lo, hi = 0.0, 1e6
    while hi - lo > 1e-12 * max(lo, 1.0):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if t_two_sided(mid, df) > alpha else (lo, mid)
        if mid in (lo, hi) and (lo + hi) / 2 in (lo, hi):
            break
    return (lo + hi) / 2


def binomial_two_sided(k: int, n: int, p: float = 0.5) -> float:
    """Exact two-sided binomial probability: all outcomes no likelier than the observed one.

    The outcomes on the far side are found by bisection, as probabilities fall away from the mode, and each
    tail is an incomplete beta, so the cost grows with the logarithm of ``n``.
    """
    from math import lgamma, log

    logpmf = lambda i: lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * log(p) + (n - i) * log(1 - p)
    below = lambda i: 1.0 if i >= n else 0.0 if i < 0 else _incomplete_beta(n - i, i + 1, 1 - p)  # P(X <= i)
    above = lambda i: 1.0 if i <= 0 else 0.0 if i > n else _incomplete_beta(i, n - i + 1, p)  # P(X >= i)
    seen = logpmf(k) + 1e-7
    mode = int((n + 1) * p)
    if logpmf(min(mode, n)) <= seen:
        return 1.0
    if k < mode:
        lo, hi = mode, n + 1  # the least outcome above the mode that is as unlikely
        while hi - lo > 1:
            mid = (lo + hi) // 2
            lo, hi = (lo, mid) if logpmf(mid) <= seen else (mid, hi)
        return min(1.0, below(k) + above(hi))
    lo, hi = -1, mode
    while hi - lo > 1:
        mid = (lo + hi) // 2
        lo, hi = (mid, hi) if logpmf(mid) <= seen else (lo, mid)
    return min(1.0, below(lo) + above(k))


def _series(fn, *columns: pd.Series) -> pd.Series:
    return pd.Series(
        [None if any(pd.isna(v) for v in row) else fn(*row) for row in zip(*columns)], dtype="float64"
    )


@F.pandas_udf(DoubleType())
def t_p_value(t: pd.Series, df: pd.Series) -> pd.Series:
    return _series(t_two_sided, t, df)


@F.pandas_udf(DoubleType())
def t_critical_value(df: pd.Series) -> pd.Series:
    return df.map({d: t_critical(d) for d in df.dropna().unique()}).astype("float64")


@F.pandas_udf(DoubleType())
def binomial_p_value(k: pd.Series, n: pd.Series) -> pd.Series:
    return _series(lambda a, b: binomial_two_sided(int(a), int(b)), k, n)


@F.pandas_udf(DoubleType())
def normal_two_sided(z: pd.Series) -> pd.Series:
    from math import erfc, sqrt

    return _series(lambda v: erfc(abs(v) / sqrt(2)), z)


# ---------------------------------------------------------------- tests

def one_sample_t(df: DataFrame, keys: Sequence[str], value: str, mean: float = 0.0, p_values: bool = True) -> DataFrame:
    stats = df.groupBy(*keys).agg(
        F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.count(value).alias("n")
    )
    t = F.when((F.col("n") > 1) & (F.col("sd") > 0), (F.col("mean") - mean) / (F.col("sd") / F.sqrt("n")))
    out = stats.withColumn("t", t)
    if not p_values:
        return out
    dof = (F.col("n") - 1).cast("double")
    return out.withColumns(
        {
            "t_critical": F.when(F.col("n") > 1, t_critical_value(dof)),
            "p_value": t_p_value(F.col("t"), dof),
        }
    ).withColumn("significant", F.abs("t") >= F.col("t_critical"))


def paired_t(df: DataFrame, keys: Sequence[str], first: str, second: str, p_values: bool = True) -> DataFrame:
    return one_sample_t(df.withColumn("_diff", F.col(first) - F.col(second)), keys, "_diff", 0.0, p_values)


def holm(tests: DataFrame, p: str, name: str = "p_holm", family: Sequence[str] = (), tie: Sequence[str] = ()) -> DataFrame:
    """Step-down adjusted p-values; one row per test, so a family is as small as the tests run."""
    with_family = tests if family else tests.withColumn("_family", F.lit(0))
    keys = list(family) or ["_family"]
    order = Window.partitionBy(*keys).orderBy(p, *tie)
    m = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    stepped = with_family.withColumn("_s", (m - F.row_number().over(order) + 1) * F.col(p))
    top = F.max("_s").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return stepped.withColumn(name, F.least(top, F.lit(1.0))).drop("_s", "_family")


def bonferroni(tests: DataFrame, p: str, name: str = "p_bonferroni") -> DataFrame:
    m = tests.count()
    return tests.withColumn(name, F.least(F.col(p) * m, F.lit(1.0)))


def binomial_test(counts: DataFrame, successes: str, total: str) -> DataFrame:
    return counts.withColumn("p_value", binomial_p_value(F.col(successes), F.col(total)))


def mann_whitney(df: DataFrame, keys: Sequence[str], group: str, first: str, value: str, p_values: bool = True) -> DataFrame:
    """U of one group against the rest, from average ranks, with tie-corrected normal p-values."""
    df, keys, whole = with_key(df, keys)
    rows = df.filter(F.col(value).isNotNull())
    ranked = _pooled_ranks(rows, keys, group, first, value)
    sums = ranked.groupBy(*keys).agg(
        F.sum(F.col("_a") * F.col("_rank")).alias("rank_sum"),
        F.sum("_a").alias("n1"), F.sum("_b").alias("n2"),
        F.sum(F.pow("_n", F.lit(3)) - F.col("_n")).alias("_ties"),
    )
    n1, n2 = F.col("n1"), F.col("n2")
    out = sums.filter((n1 > 0) & (n2 > 0)).withColumn("u", F.col("rank_sum") - n1 * (n1 + 1) / 2)
    out = out.drop("_all") if whole else out
    if not p_values:
        return out.drop("_ties")
    n = n1 + n2
    sd = F.sqrt(n1 * n2 / 12.0 * (n + 1 - F.col("_ties") / (n * (n - 1))))
    gap = F.greatest(F.abs(F.col("u") - n1 * n2 / 2.0) - 0.5, F.lit(0.0))
    return out.withColumn("p_value", normal_two_sided(gap / sd)).drop("_ties")


def _pooled_ranks(rows: DataFrame, keys: list[str], group: str, first: str, value: str) -> DataFrame:
    """Copies of each value in both groups with its pooled average rank."""
    n = rows.groupBy(*keys, value).agg(
        F.count_if(F.col(group) == first).alias("_a"), F.count_if(F.col(group) != first).alias("_b")
    ).withColumn("_n", F.col("_a") + F.col("_b"))
    scanned = sum_below(n, keys, value, "_n", "_before")
    return scanned.withColumn("_rank", F.col("_before") + (F.col("_n") + 1) / 2)


def spearman(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Rank correlation per key with average ranks for ties."""
    df, keys, whole = with_key(df, keys)
    rows = df.select(*keys, F.col(x).alias("_x"), F.col(y).alias("_y")).filter(
        F.col("_x").isNotNull() & F.col("_y").isNotNull()
    )
    # Ranks depend on (key, value) only, so pairs are collapsed before the two rank joins.
    pairs = cut_lineage(rows.groupBy(*keys, "_x", "_y").agg(F.count(F.lit(1)).alias("_w")))
    rx = _weighted_ranks(pairs, keys, "_x", "_rx")
    ry = _weighted_ranks(pairs, keys, "_y", "_ry")
    joined = pairs.join(rx, [*keys, "_x"]).join(ry, [*keys, "_y"])
    w, a, b = F.col("_w"), F.col("_rx"), F.col("_ry")
    n = F.sum("_w")
    sums = joined.groupBy(*keys).agg(
        n.alias("n"), F.sum(w * a).alias("sa"), F.sum(w * b).alias("sb"),
        F.sum(w * a * a).alias("saa"), F.sum(w * b * b).alias("sbb"), F.sum(w * a * b).alias("sab"),
    )
    cov = F.col("n") * F.col("sab") - F.col("sa") * F.col("sb")
    va = F.col("n") * F.col("saa") - F.col("sa") * F.col("sa")
    vb = F.col("n") * F.col("sbb") - F.col("sb") * F.col("sb")
    return sums.select(*([] if whole else keys), "n", F.when((va > 0) & (vb > 0), cov / F.sqrt(va * vb)).alias("rho"))


def _weighted_ranks(pairs: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    n = pairs.groupBy(*keys, value).agg(F.sum("_w").alias("_n"))
    scanned = sum_below(n, keys, value, "_n", "_before")
    return scanned.select(*keys, value, (F.col("_before") + (F.col("_n") + 1) / 2).alias(name))


# Labels whose pairs are all formed (checked): the vocabulary of a report, not of a corpus.
LABEL_LIMIT = 5_000


def cooccurrence_correlation(df: DataFrame, item: str, label: str, minimum: float = 0.1) -> DataFrame:
    """Correlation of label presence over items, pairs with \\|r\\| above ``minimum``.

    On 0/1 data rank and product-moment correlation agree, so counts suffice.  All pairs of labels are compared,
    also those that never meet, so the vocabulary must be at most ``LABEL_LIMIT`` labels (more fail the job).
    """
    present = df.select(item, label).distinct()
    sets = present.groupBy(item).agg(F.array_sort(F.collect_set(label)).alias("_set"))
    single = present.groupBy(label).agg(F.count(F.lit(1)).alias("c"))
    counts = {r[label]: r["c"] for r in single.limit(LABEL_LIMIT + 1).collect()}
    if len(counts) > LABEL_LIMIT:
        raise ValueError(f"more than {LABEL_LIMIT} labels")
    n = float(sets.count())
    pair = sets.select(F.explode("_set").alias("label_a"), "_set").select(
        "label_a", F.explode("_set").alias("label_b")
    ).filter(F.col("label_a") < F.col("label_b"))
    both = pair.groupBy("label_a", "label_b").agg(F.count(F.lit(1)).alias("both"))
    names = sorted(k for k in counts if k is not None)
    every = single.filter(F.col(label).isNotNull()).select(F.col(label).alias("label_a"), F.col("c").alias("ca")).withColumn(
        "label_b", F.explode(F.filter(F.array(*[F.lit(k) for k in names]), lambda b: b > F.col("label_a")))
    ) if names else single.select(F.col(label).alias("label_a"), F.col("c").alias("ca"), F.col(label).alias("label_b"))
    joined = (
        every.join(single.select(F.col(label).alias("label_b"), F.col("c").alias("cb")), "label_b")
        .join(both, ["label_a", "label_b"], "left").na.fill(0, ["both"])
        .select("label_a", "label_b", "both", "ca", "cb", F.lit(int(n)).cast("long").alias("n"))
    )
    a, b = F.col("ca"), F.col("cb")
    r = (n * F.col("both") - a * b) / F.sqrt(a * (n - a) * b * (n - b))
    return joined.withColumn("r", F.when((a < n) & (b < n), r)).filter(F.abs("r") > minimum)


def linear_fit(df: DataFrame, keys: Sequence[str], y: str, x: str) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.regr_slope(F.col(y), F.col(x)).alias("slope"),
        F.regr_intercept(F.col(y), F.col(x)).alias("intercept"),
        F.regr_r2(F.col(y), F.col(x)).alias("r2"),
    )


def sign_accuracy(df: DataFrame, keys: Sequence[str], score: str, label: str) -> DataFrame:
    """Share of rows whose score has the sign of the label."""
    hit = F.signum(F.col(score)) == F.signum(F.col(label))
    return df.groupBy(*keys).agg(F.avg(hit.cast("double")).alias("accuracy"))


def r_squared(df: DataFrame, keys: Sequence[str], predicted: str, actual: str) -> DataFrame:
    """``1 - residual / total`` sums of squares."""
    e = F.col(actual) - F.col(predicted)
    return df.groupBy(*keys).agg(
        F.when(
            F.var_pop(actual) > 0,
            1 - F.sum(e * e) / (F.var_pop(actual) * F.count(actual)),
        ).alias("r2")
    )


def best_model(df: DataFrame, keys: Sequence[str], score: str, model: str) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.min_by(F.struct(F.col(model).alias("model"), F.col(score).alias("score")),
                 F.struct(-F.col(score), F.col(model))).alias("_b")
    ).select(*keys, F.col("_b.model").alias("best_model"), F.col("_b.score").alias("best_score"))
