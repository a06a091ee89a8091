"""Bins, quantiles, tests and correlations on events, orders and line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from exonloom.catalog.base import query, table
from exonloom.operators import stats as st
from exonloom.operators import tabular as tb


def _events(spark, folder):
    return table(spark, folder, "events").select("event_id", "user_id", "event_type", "value")


@query(
    "distance_bins",
    "select event_type, cast(floor(value) as bigint) // 50 * 50 as bin, count(*) as n from events group by all",
)
def distance_bins(spark, folder):
    binned = _events(spark, folder).withColumn("bin", st.fixed_bin(F.floor("value"), 50))
    return binned.groupBy("event_type", "bin").agg(F.count(F.lit(1)).alias("n"))


@query(
    "exact_quantiles",
    "select event_type, unnest([0.1, 0.25, 0.5, 0.9])::double as p, round(unnest(quantile_cont(value, [0.1, 0.25, 0.5, 0.9])), 6) as quantile from events group by event_type",
)
def exact_quantiles(spark, folder):
    out = st.exact_quantiles(_events(spark, folder), ["event_type"], "value", [0.1, 0.25, 0.5, 0.9])
    return out.withColumn("quantile", F.round("quantile", 6))


_BINNED = """
e as (select {k} as k, list_sort(list_distinct(quantile_cont(l_quantity, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) as edges from lineitem group by 1),
b as (select l.*, len(list_filter(edges[2:], lambda x: l_quantity > x)) as quantile_bin from lineitem l join e on {k} = e.k)
"""


@query(
    "quantile_bins",
    "with " + _BINNED.format(k="l_returnflag") + " select l_returnflag as flag, quantile_bin, count(*) as n, min(l_quantity) as low, max(l_quantity) as high from b group by all",
)
def quantile_bins(spark, folder):
    df = table(spark, folder, "lineitem").select(F.col("l_returnflag").alias("flag"), "l_quantity")
    return st.quantile_bins(df, ["flag"], "l_quantity", 10).groupBy("flag", "quantile_bin").agg(
        F.count(F.lit(1)).alias("n"), F.min("l_quantity").alias("low"), F.max("l_quantity").alias("high")
    )


@query(
    "quantile_bins_whole",
    "with " + _BINNED.format(k="1") + " select quantile_bin, count(*) as n, max(l_quantity) as high from b group by all",
)
def quantile_bins_whole(spark, folder):
    df = table(spark, folder, "lineitem").select("l_quantity")
    return st.quantile_bins(df, [], "l_quantity", 10).groupBy("quantile_bin").agg(
        F.count(F.lit(1)).alias("n"), F.max("l_quantity").alias("high")
    )


_CI = """select {k}, round(m, 6) as mean, n, round(sd, 6) as sd, round(m - 1.95 * sd / sqrt(n), 6) as ci_low, round(m + 1.95 * sd / sqrt(n), 6) as ci_high
         from (select {k}, avg({v}) as m, count({v}) as n, stddev_samp({v}) as sd from {t} group by {k})"""


def _rounded(df, *columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query("mean_interval", _CI.format(k="event_type", v="value", t="events"))
def mean_interval(spark, folder):
    return _rounded(st.mean_interval(_events(spark, folder), ["event_type"], "value"), "mean", "sd", "ci_low", "ci_high")


@query(
    "meta_profile",
    "with " + _BINNED.format(k="l_returnflag") + " " + _CI.format(k="l_returnflag, quantile_bin", v="l_discount", t="b"),
)
def meta_profile(spark, folder):
    df = table(spark, folder, "lineitem").select("l_returnflag", "l_quantity", "l_discount")
    return _rounded(
        st.profile(df, ["l_returnflag"], "l_quantity", "l_discount", 10), "mean", "sd", "ci_low", "ci_high"
    )


@query(
    "group_percentages",
    """select event_type, user_id, n, total, 100.0 * n / total as percentage from (
         select *, cast(sum(n) over (partition by event_type) as bigint) as total from (
           select event_type, user_id, count(*) as n from events group by event_type, user_id))""",
)
def group_percentages(spark, folder):
    return st.percentages(_events(spark, folder), ["event_type"], ["user_id"])


@query(
    "group_size_filter",
    "select event_id, user_id from events where user_id in (select user_id from events group by user_id having count(*) >= 40)",
)
def group_size_filter(spark, folder):
    df = _events(spark, folder).select("event_id", "user_id")
    large = df.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).filter("n >= 40")
    return df.join(large, "user_id", "left_semi").select("event_id", "user_id")


@query(
    "deviation_counts",
    """select event_type, count(*) filter (abs(value) > sd) as n_deviating, count(*) as n
       from events join (select event_type, stddev_samp(value) as sd from events group by 1) using (event_type) group by 1""",
)
def deviation_counts(spark, folder):
    return st.deviations(_events(spark, folder), ["event_type"], "value")


@query(
    "row_z_scores",
    """with c as (select user_id, event_type, count(*) as n from events group by all)
       select user_id, event_type, n, case when sd <> 0 then round((n - m) / sd, 6) end as z
       from c join (select user_id, avg(n) as m, stddev_samp(n) as sd from c group by 1) using (user_id)""",
)
def row_z_scores(spark, folder):
    counts = _events(spark, folder).groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    return _rounded(st.z_scores(counts, ["user_id"], "n"), "z")


_T = """select {k}, round(m, 6) as mean, round(sd, 6) as sd, n, case when n > 1 and sd > 0 then round((m - {mu}) / (sd / sqrt(n)), 5) end as t
        from (select {k}, avg({v}) as m, stddev_samp({v}) as sd, count({v}) as n from {t} group by {k})"""


@query("one_sample_t", _T.format(k="user_id", v="value", mu=50, t="events"))
def one_sample_t(spark, folder):
    out = st.one_sample_t(_events(spark, folder), ["user_id"], "value", 50, p_values=False)
    return _rounded(_rounded(out, "mean", "sd"), "t", digits=5)


@query("paired_t", _T.format(k="l_linestatus", v="(l_tax - l_discount)", mu=0, t="lineitem"))
def paired_t(spark, folder):
    df = table(spark, folder, "lineitem").select("l_linestatus", "l_tax", "l_discount")
    out = st.paired_t(df, ["l_linestatus"], "l_tax", "l_discount", p_values=False)
    return _rounded(_rounded(out, "mean", "sd"), "t", digits=5)


# Areas of the densities by Simpson's rule over fixed panels, in SQL lists (k runs over the panel ends).
_PANELS = 1000
_SIMPSON = f"(case when k = 0 or k = {_PANELS} then 1 when k % 2 = 1 then 4 else 2 end)"


def _t_tails(v: str, t: str) -> str:
    area = f"abs({t}) / {_PANELS} / 3 * list_sum(list_transform(range({_PANELS + 1}), lambda k: {_SIMPSON} * pow(1 + pow({t} * k / {_PANELS}, 2) / {v}, -({v} + 1) / 2)))"
    return f"(1 - 2 * exp(lgamma(({v} + 1) / 2) - lgamma({v} / 2)) / sqrt({v} * pi()) * {area})"


_NORMAL_TAILS = "(1 - 2 / sqrt(2 * pi()) * {z} / 1000 / 3 * list_sum(list_transform(range(1001), lambda k: " + _SIMPSON + " * exp(-pow({z} * k / 1000, 2) / 2))))"


@query(
    "one_sample_t_p_values",
    "with recursive " + f"""s as (select user_id, avg(value) as m, stddev_samp(value) as sd, count(value) as n from events group by 1),
        halved(v, lo, hi, i) as (
          select distinct (n - 1)::double, 0::double, 1000::double, 0 from s where n > 1
          union all
          select v, case when p > 0.05 then mid else lo end, case when p > 0.05 then hi else mid end, i + 1
          from (select *, {_t_tails('v', 'mid')} as p from (select *, (lo + hi) / 2 as mid from halved where i < 40))),
        q as (select *, case when n > 1 and sd > 0 then (m - 50) / (sd / sqrt(n)) end as t from s)
        select user_id, round(m, 6) as mean, round(sd, 6) as sd, n, round(t, 5) as t, round(lo, 4) as t_critical,
               round(case when t is not null then {_t_tails('v', 't')} end, 6) as p_value, abs(t) >= lo as significant
        from q left join (select * from halved where i = 40) on v = n - 1""",
)
def one_sample_t_p_values(spark, folder):
    out = st.one_sample_t(_events(spark, folder), ["user_id"], "value", 50)
    return _rounded(_rounded(_rounded(out, "mean", "sd", "p_value"), "t", digits=5), "t_critical", digits=4)


_P = "p as (select user_id, avg(case when event_type = 'click' then 0.04 else 0.002 end) as p_value from events group by 1)"


@query(
    "holm_adjusted",
    f"""with {_P}, s as (select *, (count(*) over () - row_number() over (order by p_value, user_id) + 1) * p_value as s,
             row_number() over (order by p_value, user_id) as rn from p)
        select user_id, round(p_value, 9) as p_value, round(least(1.0, max(s) over (order by rn rows unbounded preceding)), 9) as p_holm from s""",
)
def holm_adjusted(spark, folder):
    p = _events(spark, folder).groupBy("user_id").agg(
        F.avg(F.when(F.col("event_type") == "click", 0.04).otherwise(0.002)).alias("p_value")
    )
    return _rounded(st.holm(p, "p_value", tie=["user_id"]), "p_value", "p_holm", digits=9)


@query(
    "bonferroni_adjusted",
    f"with {_P} select user_id, round(p_value, 9) as p_value, round(least(1.0, p_value * count(*) over ()), 9) as p_bonferroni from p",
)
def bonferroni_adjusted(spark, folder):
    p = _events(spark, folder).groupBy("user_id").agg(
        F.avg(F.when(F.col("event_type") == "click", 0.04).otherwise(0.002)).alias("p_value")
    )
    return _rounded(st.bonferroni(p, "p_value"), "p_value", "p_bonferroni", digits=9)


@query(
    "binomial_test",
    """with c as (select user_id, count(*) filter (event_type in ('click', 'view')) as k, count(*) as n from events group by 1),
       l as (select *, list_transform(range(n + 1), lambda i: lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2)) as logs from c),
       p as (select user_id, k, n, least(1.0, list_sum(list_transform(list_filter(logs, lambda x: x <= logs[k + 1] + 1e-7), lambda x: exp(x)))) as p from l)
       select user_id, k, n, round(p, 7) as p_value, round(least(1.0, p * count(*) over ()), 7) as p_bonferroni from p""",
)
def binomial_test(spark, folder):
    counts = _events(spark, folder).groupBy("user_id").agg(
        F.count_if(F.col("event_type").isin("click", "view")).alias("k"), F.count(F.lit(1)).alias("n")
    )
    return _rounded(st.bonferroni(st.binomial_test(counts, "k", "n"), "p_value"), "p_value", "p_bonferroni", digits=7)


@query(
    "average_ranks",
    """select o_orderkey as orderkey, o_orderpriority as priority, rank() over (partition by o_orderpriority order by round(o_totalprice / 1000))
         + (count(*) over (partition by o_orderpriority, round(o_totalprice / 1000)) - 1) / 2.0 as avg_rank from orders""",
)
def average_ranks(spark, folder):
    df = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("orderkey"), F.col("o_orderpriority").alias("priority"), F.round(F.col("o_totalprice") / 1000).alias("v")
    )
    return st.average_ranks(df, ["priority"], "v").drop("v")


@query(
    "mann_whitney_u",
    """with r as (select l_linestatus, l_returnflag = 'A' as g, rank() over (partition by l_linestatus order by l_extendedprice)
                  + (count(*) over (partition by l_linestatus, l_extendedprice) - 1) / 2.0 as rk from lineitem)
       select l_linestatus, sum(rk) filter (g) as rank_sum, count(*) filter (g) as n1, count(*) filter (not g) as n2,
              sum(rk) filter (g) - count(*) filter (g) * (count(*) filter (g) + 1) / 2 as u from r group by 1""",
)
def mann_whitney_u(spark, folder):
    df = table(spark, folder, "lineitem").select("l_linestatus", "l_returnflag", "l_extendedprice")
    return st.mann_whitney(df, ["l_linestatus"], "l_returnflag", "A", "l_extendedprice", p_values=False)


@query(
    "mann_whitney_p_values",
    """with r as (select l_linestatus, l_extendedprice, l_returnflag = 'A' as g, rank() over (partition by l_linestatus order by l_extendedprice)
                  + (count(*) over (partition by l_linestatus, l_extendedprice) - 1) / 2.0 as rk from lineitem),
       tied as (select l_linestatus, sum(pow(c, 3) - c) as ties from (select l_linestatus, count(*) as c from lineitem group by l_linestatus, l_extendedprice) group by 1),
       u as (select l_linestatus, sum(rk) filter (g) as rank_sum, (count(*) filter (g))::double as n1, (count(*) filter (not g))::double as n2 from r group by 1),
       z as (select *, rank_sum - n1 * (n1 + 1) / 2 as u from u join tied using (l_linestatus) where n1 > 0 and n2 > 0),
       s as (select *, greatest(abs(u - n1 * n2 / 2) - 0.5, 0) / sqrt(n1 * n2 / 12 * (n1 + n2 + 1 - ties / ((n1 + n2) * (n1 + n2 - 1)))) as z from z)
       select l_linestatus, rank_sum, n1::bigint as n1, n2::bigint as n2, u, round(""" + _NORMAL_TAILS.format(z="z") + """, 6) as p_value from s""",
)
def mann_whitney_p_values(spark, folder):
    df = table(spark, folder, "lineitem").select("l_linestatus", "l_returnflag", "l_extendedprice")
    return _rounded(st.mann_whitney(df, ["l_linestatus"], "l_returnflag", "A", "l_extendedprice"), "p_value")


@query(
    "spearman_per_group",
    """with r as (select l_returnflag, rank() over (partition by l_returnflag order by l_quantity) + (count(*) over (partition by l_returnflag, l_quantity) - 1) / 2.0 as a,
                  rank() over (partition by l_returnflag order by l_extendedprice) + (count(*) over (partition by l_returnflag, l_extendedprice) - 1) / 2.0 as b from lineitem)
       select l_returnflag, count(*) as n, round(corr(a, b), 6) as rho from r group by 1""",
)
def spearman_per_group(spark, folder):
    df = table(spark, folder, "lineitem").select("l_returnflag", "l_quantity", "l_extendedprice")
    return _rounded(st.spearman(df, ["l_returnflag"], "l_quantity", "l_extendedprice"), "rho")


# labels are the priorities and, from the keys, two that never meet
@query(
    "cooccurrence_correlation",
    """with pr as (select distinct o_custkey as item, o_orderpriority as label from orders
                   union select o_custkey, case when o_custkey % 2 = 0 then 'even' else 'odd' end from orders),
            n as (select count(distinct item)::double as n from pr), s as (select label, count(*) as c from pr group by 1),
            met as (select a.label as label_a, b.label as label_b, count(*) as k from pr a join pr b on a.item = b.item and a.label < b.label group by all)
       select label_a, label_b, n::bigint as n, "both", ca, cb, round(r, 6) as r from (
         select *, case when ca < n and cb < n then (n * "both" - ca * cb) / sqrt(ca * (n - ca) * cb * (n - cb)) end as r from (
           select a.label as label_a, b.label as label_b, a.c as ca, b.c as cb, coalesce(k, 0) as "both", n
           from s a join s b on a.label < b.label cross join n left join met on label_a = a.label and label_b = b.label))
       where abs(r) > 0.01""",
)
def cooccurrence_correlation(spark, folder):
    o = table(spark, folder, "orders")
    parity = F.when(F.col("o_custkey") % 2 == 0, "even").otherwise("odd")
    df = o.select(F.col("o_custkey").alias("item"), F.explode(F.array("o_orderpriority", parity)).alias("label"))
    return _rounded(st.cooccurrence_correlation(df, "item", "label", 0.01), "r")


@query(
    "linear_fit",
    """select l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) as slope, round(regr_intercept(l_extendedprice, l_quantity), 4) as intercept,
              round(regr_r2(l_extendedprice, l_quantity), 6) as r2 from lineitem group by 1""",
)
def linear_fit(spark, folder):
    df = table(spark, folder, "lineitem").select("l_returnflag", "l_quantity", "l_extendedprice")
    fit = st.linear_fit(df, ["l_returnflag"], "l_extendedprice", "l_quantity")
    return _rounded(_rounded(fit, "slope", "intercept", digits=4), "r2")


@query(
    "model_accuracy",
    """select p_type, avg((sign(p_size - 25) = sign(p_retailprice - 1200))::int::double) as accuracy from part group by 1""",
)
def model_accuracy(spark, folder):
    df = table(spark, folder, "part").select(
        "p_type", (F.col("p_size") - 25).alias("score"), (F.col("p_retailprice") - 1200).alias("label")
    )
    return st.sign_accuracy(df, ["p_type"], "score", "label")


@query(
    "model_r_squared",
    """select p_type, round(1 - sum((p_retailprice - (900 + p_size)) * (p_retailprice - (900 + p_size))) / (var_pop(p_retailprice) * count(*)), 5) as r2 from part group by 1""",
)
def model_r_squared(spark, folder):
    df = table(spark, folder, "part").select("p_type", "p_retailprice", (900 + F.col("p_size")).alias("guess"))
    return _rounded(st.r_squared(df, ["p_type"], "guess", "p_retailprice"), "r2", digits=5)


@query(
    "best_model",
    """select c_nationkey, c_mktsegment as best_model, m as best_score from (
         select c_nationkey, c_mktsegment, max(c_acctbal) as m from customer group by all)
       qualify row_number() over (partition by c_nationkey order by m desc, c_mktsegment) = 1""",
)
def best_model(spark, folder):
    scores = table(spark, folder, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.max("c_acctbal").alias("m"))
    return st.best_model(scores, ["c_nationkey"], "m", "c_mktsegment")


@query(
    "occurrence_histogram",
    """select event_type, case when n >= 10 then '>=10' else cast(n as varchar) end as occurrences, count(*) as n_keys
       from (select event_type, user_id, count(*) as n from events group by all) group by all""",
)
def occurrence_histogram(spark, folder):
    return tb.occurrence_histogram(_events(spark, folder), "user_id", "event_type")


@query(
    "chosen_sets",
    """select configurations, count(*) as n_keys from (
         select o_custkey, string_agg(distinct o_orderpriority, '&' order by o_orderpriority) as configurations from orders group by 1) group by 1""",
)
def chosen_sets(spark, folder):
    return tb.chosen_sets(table(spark, folder, "orders").select("o_custkey", "o_orderpriority"), "o_custkey", "o_orderpriority")


_STATUS = ["F", "O", "P"]


@query(
    "changed_events",
    """with w as (select o_custkey, """ + ", ".join(
        f"avg((o_orderkey % 200) / 1000.0) filter (o_orderstatus = '{s}') as p_{s}, avg(o_totalprice / 1000000 - 0.25) filter (o_orderstatus = '{s}') as d_{s}" for s in _STATUS
    ) + """ from orders group by 1)
       select o_custkey, rbp_name, round(dpsi, 6) as dpsi, round(p_value, 6) as p_value, status from (
         select *, case when p_value <= 0.05 and abs(dpsi) >= 0.1 then 'changed' when p_value <= 0.1 and abs(dpsi) < 0.02 then 'unchanged' end as status from (
         """ + " union all ".join(f"select o_custkey, '{s}' as rbp_name, d_{s} as dpsi, p_{s} as p_value from w" for s in _STATUS) + """))
       where status is not null""",
)
def changed_events(spark, folder):
    o = table(spark, folder, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_totalprice")
    aggs = []
    for s in _STATUS:
        own = F.col("o_orderstatus") == s
        aggs.append(F.avg(F.when(own, (F.col("o_orderkey") % 200) / 1000.0)).alias(f"{s}_wilcoxon"))
        aggs.append(F.avg(F.when(own, F.col("o_totalprice") / 1000000 - 0.25)).alias(f"{s}_dpsi"))
    wide = o.groupBy("o_custkey").agg(*aggs)
    return _rounded(tb.classify_changes(wide, ["o_custkey"], _STATUS), "dpsi", "p_value")


@query(
    "paired_self_join",
    """select a.c_custkey as kd, b.c_custkey as ctrl, a.c_acctbal as acctbal_kd, b.c_acctbal as acctbal_ctrl
       from customer a join customer b on a.c_custkey + 1 = b.c_custkey where a.c_custkey % 2 = 0""",
)
def paired_self_join(spark, folder):
    from exonloom.operators.matching import pairs_to_wide

    c = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("target"), F.col("c_acctbal").alias("acctbal"),
        F.when(F.col("c_custkey") % 2 == 0, "KD").otherwise("CTRL").alias("exon_group"),
        F.when(F.col("c_custkey") % 2 == 0, F.col("c_custkey") + 1).alias("paired_with"),
    )
    return pairs_to_wide(c, "target", [], ["acctbal"]).select(
        F.col("target_KD").alias("kd"), F.col("target_CTRL").alias("ctrl"),
        F.col("acctbal_KD").alias("acctbal_kd"), F.col("acctbal_CTRL").alias("acctbal_ctrl"),
    )


@query(
    "unpivot_features",
    "select p_partkey, feature, value from (select p_partkey, p_size::double as size, p_retailprice as price from part) unpivot (value for feature in (size, price))",
)
def unpivot_features(spark, folder):
    df = table(spark, folder, "part").select("p_partkey", F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"))
    return df.unpivot(["p_partkey"], ["size", "price"], "feature", "value")


@query(
    "nonzero_features",
    "select l_orderkey, l_linenumber, l_tax, l_discount from lineitem where l_tax <> 0 and l_discount <> 0",
)
def nonzero_features(spark, folder):
    df = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_tax", "l_discount")
    return tb.all_nonzero(df, ["l_tax", "l_discount"])


@query(
    "empty_features_dropped",
    "select o_orderkey, o_totalprice from orders",
)
def empty_features_dropped(spark, folder):
    df = table(spark, folder, "orders").select("o_orderkey", "o_totalprice").withColumns(
        {"zero": F.col("o_orderkey") * 0, "none": F.lit(None).cast("double")}
    )
    return tb.drop_empty_features(df, ["o_totalprice", "zero", "none"])
