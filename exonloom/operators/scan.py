"""Ordered running aggregates that never hold a whole key in one task.

A plain window ``PARTITION BY chrom ORDER BY start`` sends a chromosome to one task.  Here
every key is cut into blocks of positions; running values are computed per (key, block), and
only one summary row per block is carried across blocks.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from exonloom.session import cut_lineage

DEFAULT_BLOCK = 1 << 16

_FOLD = {"max": F.max, "min": F.min, "sum": F.sum}


@dataclass(frozen=True)
class Running:
    """One running aggregate: ``how`` over ``value``, written to ``name``."""

    name: str
    how: str
    value: Column
    inclusive: bool = False


def _combine(how: str, carried: Column, local: Column) -> Column:
    if how == "max":
        return F.greatest(carried, local)
    if how == "min":
        return F.least(carried, local)
    return F.coalesce(carried, F.lit(0)) + F.coalesce(local, F.lit(0))


def prefix_scan(
    df: DataFrame,
    keys: Sequence[str],
    block: Column,
    order: Sequence[Column | str],
    running: Sequence[Running],
    stored: bool = False,
) -> DataFrame:
    """Add running aggregates over each key in ``order``; ``block`` must not decrease along it.

    The input should already be aggregated to distinct positions, so that the rows of one
    block are bounded by the block width whatever the number of copies.  It is read by two
    branches (rows and block totals), so it is first written to the shared checkpoint folder
    unless it is ``stored`` already; the work behind it runs once.
    """
    keys = list(keys)
    blocked = df.withColumn("_block", block)
    if not stored:
        blocked = cut_lineage(blocked)
    local_window = Window.partitionBy(*keys, "_block").orderBy(*order)
    local = blocked.select(
        "*",
        *[
            _FOLD[r.how](r.value)
            .over(local_window.rowsBetween(Window.unboundedPreceding, 0 if r.inclusive else -1))
            .alias(f"_local_{r.name}")
            for r in running
        ],
    )
    totals = blocked.groupBy(*keys, "_block").agg(
        *[_FOLD[r.how](r.value).alias(f"_total_{r.name}") for r in running]
    )
    across = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        *keys,
        "_block",
        *[_FOLD[r.how](f"_total_{r.name}").over(across).alias(f"_carry_{r.name}") for r in running],
    )
    joined = local.join(carried, [*keys, "_block"])
    return joined.select(
        *df.columns,
        *[
            _combine(r.how, F.col(f"_carry_{r.name}"), F.col(f"_local_{r.name}")).alias(r.name)
            for r in running
        ],
    )


def position_block(position: Column | str, width: int = DEFAULT_BLOCK) -> Column:
    col = F.col(position) if isinstance(position, str) else position
    return F.floor(col / F.lit(width)).cast("bigint")


def range_blocks(df: DataFrame, keys: Sequence[str], value: str, blocks: int | None = None) -> DataFrame:
    """``df`` stored with ``_vblock``, its range of (key, value), which ascends along both.

    Spark deals the rows by sampled bounds, so that ranges are about even whatever the distribution: a far value or a
    hot key changes nothing.  There are ``blocks`` ranges, or as many as Spark makes for a shuffle; results do not
    depend on their number.
    """
    dealt = df.repartitionByRange(*([blocks] if blocks else []), *keys, value)
    return cut_lineage(dealt.withColumn("_vblock", F.spark_partition_id().cast("bigint")))


def sum_below(df: DataFrame, keys: Sequence[str], value: str, weight: str, name: str, blocks: int | None = None) -> DataFrame:
    """Add the sum of ``weight`` over the smaller values of the key; the values of a key are distinct.

    Sums run within ranges of (key, value), and a range hands on one row for each of its keys.
    """
    blocked = range_blocks(df, list(keys), value, blocks)
    running = [Running(name, "sum", F.col(weight))]
    return prefix_scan(blocked, keys, F.col("_vblock"), [value], running, stored=True).drop("_vblock")


def with_key(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, list[str], bool]:
    """``df`` with a constant key when none is given, so that whole tables use the same plans."""
    if keys:
        return df, list(keys), False
    return df.withColumn("_all", F.lit(0)), ["_all"], True
