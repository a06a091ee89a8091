"""Streams with state replayed in several batches, and functions called from SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from exonloom.catalog.base import query, table
from exonloom.functions import registry
from exonloom.session import ensure_checkpoint_dir
from exonloom.streaming import stateful

_FILES, _STEPS = 4, 4


def _replayed(spark, folder):
    """``events`` as a stream that arrives in four steps of time."""
    place = f"{ensure_checkpoint_dir(spark)}/{uuid.uuid4().hex}"
    events = table(spark, folder, "events").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"))
    at = F.unix_millis("ts")
    cuts = events.select(F.percentile_approx(at, [i / _STEPS for i in range(1, _STEPS)])).first()[0] or []
    bounds = [None, *cuts, None]
    for low, high in zip(bounds, bounds[1:]):
        part = events.filter((F.lit(True) if low is None else at > low) & (F.lit(True) if high is None else at <= high))
        part.repartition(_FILES).write.mode("append").parquet(f"{place}/in")
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", _FILES).parquet(f"{place}/in"), place


_CLOSED = """
e as (select user_id, event_id, epoch_us(ts) // 1000 as t from events),
lab as (select *, sum(new) over (partition by user_id order by t, event_id) as burst from (
          select *, case when t - lag(t) over (partition by user_id order by t, event_id) {gap} then 0 else 1 end as new from e)),
bursts as (select user_id, min(t) as first_ms, max(t) as last_ms, count(*) as n from lab group by user_id, burst)
"""


# bursts of a user: events at most six hours apart, given out when the stream has passed them
@query(
    "stream_bursts",
    f"""with {_CLOSED.format(gap="<= 21600000")} select user_id, first_ms, last_ms, n from bursts
        where last_ms + 21600000 <= (select max(t) - 172800000 from e)""",
)
def stream_bursts(spark, folder):
    stream, place = _replayed(spark, folder)
    stateful.drain(stateful.bursts(stream, "user_id", "ts", "6 hours", "2 days"), f"{place}/out", f"{place}/state")
    return spark.read.parquet(f"{place}/out").withColumnRenamed("key", "user_id")


@query(
    "stream_sessions",
    f"""with {_CLOSED.format(gap="< 21600000")} select user_id, first_ms, last_ms + 21600000 as until_ms, n from bursts
        where last_ms + 21600000 <= (select max(t) - 172800000 from e)""",
)
def stream_sessions(spark, folder):
    stream, place = _replayed(spark, folder)
    stateful.drain(stateful.sessions(stream, "user_id", "ts", "6 hours", "2 days"), f"{place}/out", f"{place}/state")
    out = spark.read.parquet(f"{place}/out")
    return out.select(F.col("key").alias("user_id"), F.unix_millis("first").alias("first_ms"), F.unix_millis("until").alias("until_ms"), "n")


# the last line of a part ordered before each returned one, by a table function
@query(
    "sql_nearest_before",
    """with l as (select 'p' || (l_partkey % 500) as gene, case when l_returnflag = 'R' then 1 else 0 end as kind, l_orderkey * 10 + l_linenumber as pos,
                       'o' || l_orderkey || '-' || l_linenumber || '-' || l_suppkey as name from lineitem),
       near as (select *, max(case when kind = 0 then place end) over (partition by gene order by place rows between unbounded preceding and current row) as f
                from (select *, row_number() over (partition by gene order by pos, kind, name) as place from l))
       select n.gene, n.name as target, g.name as nearest, n.pos - g.pos + 1 as distance from near n left join near g on g.gene = n.gene and g.place = n.f where n.kind = 1""",
)
def sql_nearest_before(spark, folder):
    registry.register(spark)
    lines = table(spark, folder, "lineitem")
    lines.createOrReplaceTempView("exonloom_lines")
    return spark.sql(
        """with rows as (select concat('p', l_partkey % 500) as gene, if(l_returnflag = 'R', 1, 0) as kind, l_orderkey * 10 + l_linenumber as pos,
                                concat('o', l_orderkey, '-', l_linenumber, '-', l_suppkey) as name from exonloom_lines)
           select split(target, '@')[0] as gene, split(target, '@')[1] as target, split(nearest, '@')[1] as nearest, distance from
           nearest_before(table(select gene, kind, pos, concat(gene, '@', name) as name from rows) partition by gene order by (pos, kind, name))"""
    )


@query(
    "sql_ranked_rows",
    """select c_mktsegment || '@' || c_custkey as name, c_acctbal::double as value, rank() over (partition by c_mktsegment order by c_acctbal) as place,
              row_number() over (partition by c_mktsegment, c_acctbal order by c_custkey) - 1 as ties from customer""",
)
def sql_ranked_rows(spark, folder):
    registry.register(spark)
    table(spark, folder, "customer").createOrReplaceTempView("exonloom_customers")
    return spark.sql(
        """select * from ranked_rows(table(select c_mktsegment, concat(c_mktsegment, '@', c_custkey) as name, cast(c_acctbal as double) as value, c_custkey
           from exonloom_customers) partition by c_mktsegment order by (value, c_custkey))"""
    )


@query(
    "sql_extents",
    """select 'u' || user_id as key, count(*) as rows, min(event_id * 10) as first, max(event_id * 10 + floor(value)::bigint + 1) as last,
              sum(floor(value)::bigint + 1)::bigint as bases from events group by user_id""",
)
def sql_extents(spark, folder):
    registry.register(spark)
    table(spark, folder, "events").createOrReplaceTempView("exonloom_events")
    return spark.sql(
        """select * from extent_of(table(select concat('u', user_id) as key, event_id * 10 as start, event_id * 10 + floor(value) + 1 as end
           from exonloom_events) partition by key)"""
    )


@query(
    "sql_scalars",
    """with s as (select p_partkey, translate(upper(p_brand || p_name), 'BDEFHIJKLMNOPQRSUVWXYZ# 0123456789', 'ACGTACGTACGTACGTACGTAC') as seq from part)
       select p_partkey, case when length(seq) > 0 then round(100.0 * (length(seq) - length(translate(seq, 'GC', ''))) / length(seq), 2) end as gc,
              reverse(translate(seq, 'ACGTacgt', 'TGCAtgca')) as back, greatest(least(p_partkey + 10, p_size * 40) - greatest(p_partkey, p_size), 0)::bigint as shared from s join part using (p_partkey)""",
)
def sql_scalars(spark, folder):
    registry.register(spark)
    table(spark, folder, "part").createOrReplaceTempView("exonloom_parts")
    return spark.sql(
        """with s as (select *, translate(upper(concat(p_brand, p_name)), 'BDEFHIJKLMNOPQRSUVWXYZ# 0123456789', 'ACGTACGTACGTACGTACGTAC') as seq from exonloom_parts)
           select p_partkey, gc_content(seq) as gc, reverse_complement(seq) as back, overlap_bases(p_partkey, p_partkey + 10, p_size, p_size * 40) as shared from s"""
    )
