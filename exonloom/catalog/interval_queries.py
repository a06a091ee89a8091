"""Cluster, merge, overlap, subtract and nearest on event intervals."""

from __future__ import annotations

from pyspark.sql import functions as F

from exonloom.catalog.base import event_intervals, ivals, query, table, with_ctes
from exonloom.operators import intervals as iv

KEYS = ["c"]


def _labelled(slack: int) -> str:
    return f"""
lab as (
  select *, max(case when head then "start" end) over (partition by c order by "start", id
            rows between unbounded preceding and current row) as cluster_start
  from (select *, coalesce("start" - ({slack}) > max("end") over (partition by c order by "start", id
                  rows between unbounded preceding and 1 preceding), true) as head from iv))
"""


def _register_clusters():
    for tag, slack in (("minus4", -4), ("minus1", -1), ("zero", 0), ("plus5", 5)):
        @query(
            f"interval_cluster_{tag}",
            with_ctes(ivals(), _labelled(slack), body="select id, c, cluster_start from lab"),
        )
        def run(spark, folder, slack=slack):
            return iv.cluster(event_intervals(spark, folder), KEYS, slack).select(
                "id", "c", "cluster_start"
            )


_register_clusters()


@query(
    "interval_merge",
    with_ctes(
        ivals(), _labelled(0),
        body='select c, cluster_start as "start", max("end") as "end", count(*) as n_merged from lab group by c, cluster_start',
    ),
)
def interval_merge(spark, folder):
    return iv.merge(event_intervals(spark, folder), KEYS)


_RESOLVE = {
    "longest": '"start" - "end", "start", id',
    "first": '"start", id',
    "ranked": 'case when kind <> \'click\' then 0 else 1 end, -(id % 17), "start", id',
}


def _register_removals():
    for keep, order in _RESOLVE.items():
        @query(
            f"remove_overlaps_{keep}",
            with_ctes(
                ivals(), _labelled(-1),
                body=f'select c, id, kind, "start", "end" from (select *, row_number() over (partition by c, cluster_start order by {order}) as rn from lab) where rn = 1',
            ),
        )
        def run(spark, folder, keep=keep):
            df = event_intervals(spark, folder).withColumn("rank_score", F.col("id") % 17)
            return iv.remove_overlaps(
                df, KEYS, ["id"], keep, known=F.col("kind") != "click", rank="rank_score"
            ).drop("rank_score")

    for name, test, invert in (("none", "n = 1", False), ("inverted", "n > 1", True)):
        @query(
            f"remove_overlaps_{name}",
            with_ctes(
                ivals(), _labelled(-1),
                body=f'select c, id, kind, "start", "end" from (select *, count(*) over (partition by c, cluster_start) as n from lab) where {test}',
            ),
        )
        def run_none(spark, folder, invert=invert):
            return iv.remove_overlaps(
                event_intervals(spark, folder), KEYS, ["id"], None, invert=invert
            )


_register_removals()

_SIDES = """
a as (select * from iv where kind in ('view', 'signup', 'purchase')), b as (select * from iv where kind not in ('view', 'signup', 'purchase'))
"""


def _sides(spark, folder):
    df = event_intervals(spark, folder)
    one = F.col("kind").isin("view", "signup", "purchase")
    return df.filter(one), df.filter(~one)


@query(
    "interval_overlap_join",
    with_ctes(
        ivals(), _SIDES,
        body="""select a.c, a.id, b.id as id_b, least(a."end", b."end") - greatest(a."start", b."start") as overlap
                from a join b on a.c = b.c and a."start" < b."end" and b."start" < a."end" """,
    ),
)
def interval_overlap_join(spark, folder):
    a, b = _sides(spark, folder)
    return iv.overlap_join(a, b, KEYS, 256).select("c", "id", "id_b", "overlap")


# lengths from ten bases to ten million on one axis per user
_LENGTH = "case when event_id % 97 = 0 then 10000000 when event_id % 31 = 0 then 100000 when event_id % 7 = 0 then 3000 else 10 + event_id % 50 end"


@query(
    "interval_overlap_mixed_lengths",
    f"""with iv as (select user_id % 8 as c, event_id as id, event_id % 3 as part, event_id * 1000 as "start", event_id * 1000 + {_LENGTH} as "end" from events),
        a as (select * from iv where part = 0), b as (select * from iv where part <> 0)
        select a.id, count(*) as n_overlaps, sum(least(a."end", b."end") - greatest(a."start", b."start"))::bigint as shared_bases, max(b.id) as last_id
        from a join b on a.c = b.c and a."start" < b."end" and b."start" < a."end" group by a.id""",
)
def interval_overlap_mixed_lengths(spark, folder):
    start = F.col("event_id") * 1000
    df = table(spark, folder, "events").select(
        (F.col("user_id") % 8).alias("c"), F.col("event_id").alias("id"), (F.col("event_id") % 3).alias("part"),
        start.alias("start"), (start + F.expr(_LENGTH)).alias("end"),
    )
    met = iv.overlap_join(df.filter("part = 0").drop("part"), df.filter("part <> 0").drop("part"), KEYS, 64)
    return met.groupBy("id").agg(F.count("*").alias("n_overlaps"), F.sum("overlap").alias("shared_bases"), F.max("id_b").alias("last_id"))


_EXISTS = """select id, c from a where {neg} exists (select 1 from b where a.c = b.c and a."start" < b."end" and b."start" < a."end")"""


@query("interval_exists", with_ctes(ivals(), _SIDES, body=_EXISTS.format(neg="")))
def interval_exists(spark, folder):
    a, b = _sides(spark, folder)
    return iv.overlap_exists(a, b, KEYS).select("id", "c")


@query("interval_not_exists", with_ctes(ivals(), _SIDES, body=_EXISTS.format(neg="not")))
def interval_not_exists(spark, folder):
    a, b = _sides(spark, folder)
    return iv.overlap_exists(a, b, KEYS, anti=True).select("id", "c")


def islands_sql(source: str, keys: str, order: str) -> str:
    return f"""
isl as (
  select {keys}, min("start") as s, max("end") as e from (
    select *, sum(head) over (partition by {keys} order by {order} rows unbounded preceding) as grp from (
      select *, case when "start" <= max("end") over (partition by {keys} order by {order}
                    rows between unbounded preceding and 1 preceding) then 0 else 1 end as head from {source}))
  group by {keys}, grp)
"""


SUBTRACT = """
ov as (select a.*, isl.s as bs, isl.e as be from a join isl on a.{k} = isl.{k} and a."start" < isl.e and isl.s < a."end"),
pieces as (
  select {cols}, coalesce(lag(be) over (partition by {id} order by bs), "start") as s, bs as e from ov
  union all
  select {cols}, max(be) as s, max("end") as e from ov group by all
  union all
  select {cols}, "start", "end" from a where not exists (
    select 1 from isl where a.{k} = isl.{k} and a."start" < isl.e and isl.s < a."end"))
"""


@query(
    "interval_subtract",
    with_ctes(
        ivals(), _SIDES, islands_sql("b", "c", '"start", id'),
        SUBTRACT.format(k="c", id="id", cols="id, c"),
        body='select id, c, s as "start", e as "end" from pieces where s < e',
    ),
)
def interval_subtract(spark, folder):
    a, b = _sides(spark, folder)
    return iv.subtract(a, b, KEYS, 1024).select("id", "c", "start", "end")


@query(
    "interval_gaps",
    with_ctes(
        ivals(),
        body="""select c, e as "start", s2 as "end" from (
          select c, max("end") over (partition by c order by "start", "end" rows unbounded preceding) as e,
                 lead("start") over (partition by c order by "start", "end") as s2 from iv) where s2 > e""",
    ),
)
def interval_gaps(spark, folder):
    df = event_intervals(spark, folder)
    span = df.groupBy("c").agg(F.min("start").alias("lo"), F.max("end").alias("hi"))
    return iv.complement(df, KEYS, span)


_NEAR = {
    "before": ('b."end" <= a."start"', 'b."end" desc, b."start" desc, b.id', 'a."start" - b."end" + 1'),
    "after": ('b."start" >= a."end"', 'b."start", b."end", b.id', 'b."start" - a."end" + 1'),
}


def _near_sql(how: str, k: int) -> str:
    test, order, dist = _NEAR[how]
    return f"""
near_{how} as (
  select a.id, b.id as id_b, {dist} as distance, row_number() over (partition by a.id order by {order}) as idx
  from a join b on a.c = b.c and {test} qualify idx <= {k})
"""


@query(
    "nearest_up_down",
    with_ctes(
        ivals(), _SIDES, _near_sql("before", 1), _near_sql("after", 1),
        body="""select id, 'before' as side, id_b, distance from near_before
                union all select id, 'after', id_b, distance from near_after""",
    ),
)
def nearest_up_down(spark, folder):
    a, b = _sides(spark, folder)
    parts = [
        iv.nearest(a, b, KEYS, how, "id").select("id", F.lit(how).alias("side"), "id_b", "distance")
        for how in ("before", "after")
    ]
    return parts[0].unionByName(parts[1])


@query(
    "k_nearest_wide",
    with_ctes(
        ivals(), _SIDES, _near_sql("before", 3),
        body="select id, " + ", ".join(
            f"max(case when idx = {i} then {c} end) as {c}_{i}" for i in (1, 2, 3) for c in ("id_b", "distance")
        ) + " from near_before group by id",
    ),
)
def k_nearest_wide(spark, folder):
    a, b = _sides(spark, folder)
    near = iv.k_nearest(a, b, KEYS, 3, "before", "id")
    return iv.to_wide(near, ["id"], ["id_b", "distance"], 3)
