"""Interval algebra on half-open intervals, generic over key and coordinate column names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from exonloom.operators.scan import DEFAULT_BLOCK, Running, position_block, prefix_scan
from exonloom.session import cut_lineage


def cluster(
    df: DataFrame,
    keys: Sequence[str],
    slack: int = 0,
    start: str = "start",
    end: str = "end",
    block: int = DEFAULT_BLOCK,
    name: str = "cluster_start",
) -> DataFrame:
    """Label every interval with the first start of its cluster.

    Two neighbours share a cluster while ``start - slack <= largest end so far``: 0 joins
    bookended intervals, -1 asks for one shared base.  With a negative slack, intervals must
    be at least ``-slack`` long.
    """
    keys = list(keys)
    heads = df.groupBy(*keys, start).agg(F.max(end).alias("_end"))
    labelled = _label(heads, keys, slack, start, block, name, False).select(*keys, start, name)
    return df.join(labelled, [*keys, start])


def cluster_sizes(
    df: DataFrame,
    keys: Sequence[str],
    slack: int = 0,
    start: str = "start",
    end: str = "end",
    block: int = DEFAULT_BLOCK,
    name: str = "cluster_start",
    size: str = "cluster_size",
) -> DataFrame:
    """``cluster`` with the number of rows in each cluster, added up over distinct starts."""
    keys = list(keys)
    heads = cut_lineage(df.groupBy(*keys, start).agg(F.max(end).alias("_end"), F.count(F.lit(1)).alias("_copies")))
    labelled = cut_lineage(_label(heads, keys, slack, start, block, name, True).select(*keys, start, name, "_copies"))
    sizes = labelled.groupBy(*keys, name).agg(F.sum("_copies").alias(size))
    return df.join(labelled.drop("_copies").join(sizes, [*keys, name]), [*keys, start])


def _opened(heads: DataFrame, keys: list[str], slack: int, start: str, block: int, stored: bool) -> DataFrame:
    """Distinct starts with their largest end ``_end``, and ``_reach`` (largest end before), ``_head``, ``_open``.

    A start is a head when it lies beyond the reach of its block so far and of all blocks before; ``_open`` is the
    last head of the blocks before.  Starts ascend, so a block has a head exactly when its last candidate lies
    beyond the blocks before, and one summary row per block carries both on.  The input is stored and read twice.
    """
    blocked = heads.withColumn("_block", position_block(start, block))
    if not stored:
        blocked = cut_lineage(blocked)
    within = Window.partitionBy(*keys, "_block").orderBy(start)
    near = F.max("_end").over(within.rowsBetween(Window.unboundedPreceding, -1))
    beyond = lambda at, reach: reach.isNull() | (at - F.lit(slack) > reach)
    local = blocked.withColumn("_near", near).withColumn("_last", F.when(beyond(F.col(start), F.col("_near")), F.col(start)))
    across = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    totals = local.groupBy(*keys, "_block").agg(F.max("_end").alias("_far"), F.max("_last").alias("_last"))
    reached = totals.withColumn("_before", F.max("_far").over(across))
    last = F.when(beyond(F.col("_last"), F.col("_before")), F.col("_last"))
    carried = reached.withColumn("_opens", last).select(*keys, "_block", "_before", F.max("_opens").over(across).alias("_open"))
    joined = local.join(carried, [*keys, "_block"])
    head = F.col("_last").isNotNull() & beyond(F.col(start), F.col("_before"))
    return joined.withColumns({"_reach": F.greatest("_near", "_before"), "_head": head}).drop("_near", "_last", "_before")


def _label(
    heads: DataFrame, keys: list[str], slack: int, start: str, block: int, name: str, stored: bool
) -> DataFrame:
    """Cluster label of distinct starts with their largest end ``_end``."""
    opened = _opened(heads, keys, slack, start, block, stored)
    so_far = Window.partitionBy(*keys, "_block").orderBy(start).rowsBetween(Window.unboundedPreceding, 0)
    label = F.coalesce(F.max(F.when(F.col("_head"), F.col(start))).over(so_far), F.col("_open"))
    return opened.withColumn(name, label).drop("_block", "_reach", "_head", "_open")


def merge_within(
    df: DataFrame, keys: Sequence[str], slack: int = 0, start: str = "start", end: str = "end"
) -> DataFrame:
    """``merge`` for keys of bounded extent (a gene): copies are combined map side, then one window."""
    keys = list(keys)
    heads = df.groupBy(*keys, start).agg(
        F.max(end).alias(end), F.count(F.lit(1)).alias("_copies")
    )
    labelled = cluster_within(heads, keys, slack, start, end, name="_island")
    return labelled.groupBy(*keys, F.col("_island").alias(start)).agg(
        F.max(end).alias(end), F.sum("_copies").alias("n_merged")
    )


def cluster_within(
    df: DataFrame,
    keys: Sequence[str],
    slack: int = 0,
    start: str = "start",
    end: str = "end",
    tie: Sequence[str] = (),
    name: str = "cluster_start",
) -> DataFrame:
    """``cluster`` for keys of bounded size (one transcript, one sequence): a single shuffle."""
    order = Window.partitionBy(*keys).orderBy(start, F.desc(end), *tie)
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = df.withColumn("_reach", reach).withColumn(
        "_head",
        F.when(
            F.col("_reach").isNull() | (F.col(start) - F.lit(slack) > F.col("_reach")), F.col(start)
        ),
    )
    label = F.max("_head").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return opened.withColumn(name, label).drop("_reach", "_head")


def merge(
    df: DataFrame,
    keys: Sequence[str],
    slack: int = 0,
    start: str = "start",
    end: str = "end",
    block: int = DEFAULT_BLOCK,
) -> DataFrame:
    """Non-redundant intervals per key with the number of rows merged into each."""
    keys = list(keys)
    heads = cut_lineage(
        df.groupBy(*keys, start).agg(F.max(end).alias(end), F.count(F.lit(1)).alias("_copies"))
    )
    labelled = _label(heads.withColumnRenamed(end, "_end"), keys, slack, start, block, "_island", True)
    return labelled.withColumnRenamed("_end", end).groupBy(*keys, F.col("_island").alias(start)).agg(
        F.max(end).alias(end), F.sum("_copies").alias("n_merged")
    )


def remove_overlaps(
    df: DataFrame,
    keys: Sequence[str],
    tie: Sequence[str],
    keep: str | None = "longest",
    slack: int = -1,
    start: str = "start",
    end: str = "end",
    invert: bool = False,
    known: Column | None = None,
    rank: str | None = None,
    block: int = DEFAULT_BLOCK,
) -> DataFrame:
    """Resolve clusters of overlapping rows.

    ``keep``: ``longest``, ``first``, ``ranked`` (known transcripts before novel ones, then by
    ``rank``) or None, which drops every row of a cluster with more than one.  ``invert``
    returns the overlapping rows instead.  Leave the strand out of ``keys`` to ignore it.
    """
    columns = df.columns
    labelled = cluster(df, keys, slack, start, end, block, "_island")
    group = [*keys, "_island"]
    if invert:
        crowded = labelled.groupBy(*group).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
        return labelled.join(crowded, group, "left_semi").select(*columns)
    smaller_first = [F.struct(*[F.col(c) for c in (start, *tie)])]
    row = F.struct(*[F.col(c).alias(c) for c in columns])
    if keep is None:
        picked = labelled.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"), F.min(row).alias("_row"))
        return picked.filter("_n = 1").select("_row.*")
    if keep == "longest":
        sort_key = F.struct(F.col(start) - F.col(end), *smaller_first)
    elif keep == "first":
        sort_key = F.struct(*smaller_first)
    elif keep == "ranked":
        if known is None or rank is None:
            raise ValueError("keep='ranked' needs the known flag and the rank column")
        sort_key = F.struct(F.when(known, 0).otherwise(1), -F.col(rank), *smaller_first)
    else:
        raise ValueError("keep must be longest, first, ranked or None")
    return labelled.groupBy(*group).agg(F.min_by(row, sort_key).alias("_row")).select("_row.*")


# A rung of the ladder is so many times as wide as the one below, and so many rungs lie under the open top.
LADDER_STEP, LADDER_RUNGS = 8, 7


def _rungs(width: int) -> list[int]:
    """Bin widths from ``width`` up; one bin, wide enough for any position, ends the ladder."""
    return [width * LADDER_STEP**i for i in range(LADDER_RUNGS)] + [1 << 62]


def _rung_of(start: str, end: str, widths: Sequence[int]) -> Column:
    """The lowest rung whose bins are as wide as the interval."""
    length = F.col(end) - F.col(start)
    rung = F.lit(len(widths) - 1)
    for i in reversed(range(len(widths) - 1)):
        rung = F.when(length <= widths[i], i).otherwise(rung)
    return rung


def _occupied(df: DataFrame, start: str, end: str, widths: Sequence[int]) -> set[int]:
    """The rungs on which an interval of ``df`` lives; one small number for each."""
    return {r["rung"] for r in df.select(_rung_of(start, end, widths).alias("rung")).distinct().collect()}


def occupied_rungs(df: DataFrame, bin_width: int, start: str = "start", end: str = "end") -> set[int]:
    """The rungs of the ladder from ``bin_width`` on which a stored frame's intervals live."""
    return _occupied(df, start, end, _rungs(bin_width))


def _seats(start: str, end: str, widths: Sequence[int], guest: int, home: int, hosts: set[int] | None = None) -> Column:
    """``(rung, bin, side)`` of an interval: the bins it touches at home, and as a guest on every wider rung.

    Bins are as wide as the interval at least, so it touches one or two of each rung.  Pairs meet where one is at
    home: ``side`` 0 joins guests and homes of the left with homes of the right, ``side`` 1 homes of the left
    with guests of the right, so no two guests meet.  Where ``hosts``, the rungs of the other side, are known,
    there are no seats that meet nobody.
    """
    hosts = set(range(len(widths))) if hosts is None else hosts
    def touched(i: int, side: int) -> Column:
        first = F.floor(F.col(start) / F.lit(widths[i])).cast("bigint")
        last = F.floor(F.greatest(F.col(end) - 1, F.col(start)) / F.lit(widths[i])).cast("bigint")
        seat = lambda at: F.struct(F.lit(i).alias("rung"), at.alias("bin"), F.lit(side).alias("side"))
        return F.when(first == last, F.array(seat(first))).otherwise(F.array(seat(first), seat(last)))

    mine = _rung_of(start, end, widths)
    none = F.array().cast("array<struct<rung:int,bin:bigint,side:int>>")
    as_guest = [F.when(mine < i, touched(i, guest)).otherwise(none) for i in range(1, len(widths)) if i in hosts]
    met_by = [i for i in range(len(widths)) if any(h < i or (guest and h == i) for h in hosts)]
    at_home = [F.when(mine == i, touched(i, home)).otherwise(none) for i in met_by]
    if guest == 0:  # the left's homes meet homes, too
        at_home += [F.when(mine == i, touched(i, guest)).otherwise(none) for i in range(len(widths)) if i in hosts]
    return F.flatten(F.array(none, *at_home, *as_guest))


def overlap_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    bin_width: int,
    start: str = "start",
    end: str = "end",
    suffix: str = "_b",
    how: str = "inner",
    stored: bool = False,
) -> DataFrame:
    """Pairs that share at least one base, with ``overlap`` in bases.

    Every interval lives on the rung of a ladder of bins that fits its own length, in the one or two bins there that
    it touches, and asks the wider rungs for longer ones; the sides meet by an equi join on (rung, bin).  So a row
    costs at most two rows a rung, whatever its length, and short intervals do not search bins sized for long
    ones.  A pair is kept only in the bin that holds its first shared base, so no distinct is needed.
    ``bin_width`` is the width of the lowest rung; it should be near the shorter usual lengths.  Where both sides are
    ``stored``, each is read once more for the rungs it lives on, and the other asks those rungs only.
    """
    keys, widths = list(keys), _rungs(bin_width)
    rs, re = f"{start}{suffix}", f"{end}{suffix}"
    renamed = right.select(
        *keys, *[F.col(c).alias(f"{c}{suffix}") for c in right.columns if c not in keys]
    )
    of_left, of_right = (_occupied(x, start, end, widths) if stored else None for x in (left, right))
    a = left.withColumn("_seat", F.explode(_seats(start, end, widths, 0, 1, of_right)))
    b = renamed.withColumn("_seat", F.explode(_seats(rs, re, widths, 1, 0, of_left)))
    seat = ["rung", "bin", "side"]
    a, b = (x.select(*[c for c in x.columns if c != "_seat"], *[F.col(f"_seat.{c}").alias(f"_{c}") for c in seat]) for x in (a, b))
    shared = F.greatest(F.col(start), F.col(rs))
    width = F.element_at(F.array(*[F.lit(w) for w in widths]), F.col("_rung") + 1)
    pairs = a.join(b, [*keys, *[f"_{c}" for c in seat]], how).filter(
        (F.col(start) < F.col(re)) & (F.col(rs) < F.col(end)) & (F.floor(shared / width) == F.col("_bin"))
    )
    return pairs.drop(*[f"_{c}" for c in seat]).withColumn("overlap", F.least(F.col(end), F.col(re)) - shared)


def point_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], bin_width: int, at: str, start: str = "start", end: str = "end", suffix: str = "_b",
    rungs: set[int] | None = None,
) -> DataFrame:
    """Pairs where the place ``at`` of the left lies in the right interval; the ladder of ``overlap_join``.

    A place has one bin on every rung, so the right stays on its own rung: one or two rows each.  Where ``rungs``, those
    that the right lives on (see ``occupied_rungs``), are known, a place takes one row for each of them only.
    """
    keys, widths = list(keys), _rungs(bin_width)
    asked = range(len(widths)) if rungs is None else sorted(rungs)
    rs, re = f"{start}{suffix}", f"{end}{suffix}"
    seat = lambda i, place: F.struct(F.lit(i).alias("_rung"), F.floor(place / F.lit(widths[i])).cast("bigint").alias("_bin"))
    renamed = right.select(*keys, *[F.col(c).alias(f"{c}{suffix}") for c in right.columns if c not in keys])
    rung = _rung_of(rs, re, widths)
    last = F.greatest(F.col(re) - 1, F.col(rs))
    homes = [F.when(rung == i, F.array_distinct(F.array(seat(i, F.col(rs)), seat(i, last)))) for i in range(len(widths))]
    a = left.select("*", F.inline(F.array(*[seat(i, F.col(at)) for i in asked]).cast("array<struct<_rung:int,_bin:bigint>>")))
    b = renamed.select("*", F.inline(F.coalesce(*homes)))
    met = a.join(b, [*keys, "_rung", "_bin"]).filter((F.col(rs) <= F.col(at)) & (F.col(at) < F.col(re)))
    return met.drop("_rung", "_bin")


def overlap_exists(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    start: str = "start",
    end: str = "end",
    block: int = DEFAULT_BLOCK,
    anti: bool = False,
) -> DataFrame:
    """Rows of ``left`` that some ``right`` interval overlaps (or, with ``anti``, none does).

    No pairs are formed: an interval is hit exactly when the largest right end among right
    starts before its own end lies beyond its own start.
    """
    keys = list(keys)
    starts = right.groupBy(*keys, F.col(start).alias("_pos")).agg(F.max(end).alias("_reach"))
    probes = left.select(*keys, start, end).distinct()
    events = starts.select(
        *keys, "_pos", F.lit(0).alias("_probe"), "_reach",
        F.lit(None).cast("bigint").alias(start), F.lit(None).cast("bigint").alias(end),
    ).unionByName(
        probes.select(
            *keys, (F.col(end) - 1).alias("_pos"), F.lit(1).alias("_probe"),
            F.lit(None).cast("bigint").alias("_reach"), start, end,
        )
    )
    scanned = prefix_scan(
        events, keys, position_block("_pos", block), ["_pos", "_probe"],
        [Running("_best", "max", F.col("_reach"), inclusive=True)],
    )
    hit = scanned.filter((F.col("_probe") == 1) & (F.col("_best") > F.col(start))).select(
        *keys, start, end
    )
    return left.join(hit, [*keys, start, end], "left_anti" if anti else "left_semi")


def complement(
    df: DataFrame,
    keys: Sequence[str],
    bounds: DataFrame,
    start: str = "start",
    end: str = "end",
    block: int = DEFAULT_BLOCK,
) -> DataFrame:
    """Stretches of each key's ``[lo, hi)`` in ``bounds`` that no interval of ``df`` covers."""
    keys = list(keys)
    edges = bounds.select(*keys, F.col("hi").alias(start), F.col("hi").alias(end))
    heads = df.select(*keys, start, end).unionByName(edges).groupBy(*keys, start).agg(F.max(end).alias("_end"))
    # what lies between a head and the reach before it is free
    walked = _opened(heads, keys, 0, start, block, False).filter("_head")
    return (
        walked.join(bounds, keys)
        .select(
            *keys,
            F.greatest(F.coalesce(F.col("_reach"), F.col("lo")), F.col("lo")).alias(start),
            F.least(F.col(start), F.col("hi")).alias(end),
        )
        .filter(F.col(start) < F.col(end))
    )


def subtract(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    bin_width: int,
    start: str = "start",
    end: str = "end",
    block: int = DEFAULT_BLOCK,
) -> DataFrame:
    """The parts of every ``left`` interval that no ``right`` interval covers."""
    keys = list(keys)
    left = cut_lineage(left)  # read three times below
    # one row per key, used three times
    bounds = cut_lineage(left.groupBy(*keys).agg(F.min(start).alias("lo"), F.max(end).alias("hi")))
    covered = right.join(bounds.select(*keys), keys, "left_semi")
    free = cut_lineage(complement(covered, keys, bounds, start, end, block))
    pieces = overlap_join(left, free, keys, bin_width, start, end, stored=True)
    rest = [c for c in left.columns if c not in (*keys, start, end)]
    return pieces.select(
        *keys,
        F.greatest(F.col(start), F.col(f"{start}_b")).alias(start),
        F.least(F.col(end), F.col(f"{end}_b")).alias(end),
        *rest,
    )


def gaps_within(
    df: DataFrame, keys: Sequence[str], start: str = "start", end: str = "end"
) -> DataFrame:
    """Gaps between consecutive intervals of a bounded key (introns of a transcript)."""
    order = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, 0))
    following = F.lead(start).over(order)
    return (
        df.select(*keys, reach.alias("_from"), following.alias("_to"))
        .filter(F.col("_to") > F.col("_from"))
        .select(*keys, F.col("_from").alias(start), F.col("_to").alias(end))
    )


def k_nearest(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    k: int,
    how: str,
    right_id: str,
    start: str = "start",
    end: str = "end",
    suffix: str = "_b",
    block: int = DEFAULT_BLOCK,
) -> DataFrame:
    """The ``k`` closest non-overlapping ``right`` intervals before or after each ``left`` one.

    ``how`` is ``before`` or ``after`` in coordinate order.  Right intervals are numbered along
    the key by a blocked scan, and each left interval asks for the last ``k`` numbers at its
    edge by an equi join, so neither side is windowed as a whole and no pairs are tried.
    Distance counts bookended intervals as 1.  Ties at one edge go by ``right_id``.
    """
    keys = list(keys)
    sign = 1 if how == "before" else -1
    if how not in ("before", "after"):
        raise ValueError("how must be before or after")
    edge = (F.col(end) if how == "before" else -F.col(start)).alias("_pos")
    probe = (F.col(start) if how == "before" else -F.col(end)).alias("_pos")
    near = Window.partitionBy(*keys, "_pos").orderBy(
        F.desc(start) if how == "before" else F.asc(end), right_id
    )
    # Only k rows can matter at one edge; row_number limits them before the shuffle.
    kept = (
        right.select("*", edge)
        .withColumn("_nth", F.row_number().over(near))
        .filter(F.col("_nth") <= k)
    )
    edges = kept.groupBy(*keys, "_pos").agg(F.count(F.lit(1)).alias("_n"))
    probes = left.select(*keys, probe).distinct()
    events = edges.withColumn("_probe", F.lit(0)).unionByName(
        probes.withColumn("_n", F.lit(0).cast("bigint")).withColumn("_probe", F.lit(1))
    )
    numbered = prefix_scan(
        events, keys, position_block("_pos", block), ["_pos", "_probe"],
        [Running("_upto", "sum", F.col("_n"), inclusive=True)],
    )
    place = numbered.filter("_probe = 0").select(*keys, "_pos", "_upto")
    ask = numbered.filter("_probe = 1").select(*keys, "_pos", "_upto")
    ranked = kept.join(place, [*keys, "_pos"]).select(
        *keys,
        # the first row at an edge is the nearest of it and takes the highest number
        (F.col("_upto") - F.col("_nth") + 1).alias("_seat"),
        *[F.col(c).alias(f"{c}{suffix}") for c in right.columns if c not in keys],
    )
    wanted = (
        left.withColumn("_pos", F.col(start) if how == "before" else -F.col(end))
        .join(ask, [*keys, "_pos"])
        .withColumn("idx", F.explode(F.sequence(F.lit(1), F.lit(k))))
        .withColumn("_seat", F.col("_upto") - F.col("idx") + 1)
    )
    found = wanted.join(ranked, [*keys, "_seat"])
    distance = (
        F.col(start) - F.col(f"{end}{suffix}") + 1
        if sign == 1
        else F.col(f"{start}{suffix}") - F.col(end) + 1
    )
    return found.drop("_pos", "_upto", "_seat").withColumn("distance", distance)


def nearest(left, right, keys, how, right_id, **options) -> DataFrame:
    return k_nearest(left, right, keys, 1, how, right_id, **options).drop("idx")


def to_wide(
    df: DataFrame, keys: Sequence[str], values: Sequence[str], k: int, suffix: str = ""
) -> DataFrame:
    """Ranked neighbours as columns ``value_1 .. value_k`` (conditional aggregation)."""
    return df.groupBy(*keys).agg(
        *[
            F.max(F.when(F.col("idx") == i, F.col(v))).alias(f"{v}{suffix}_{i}")
            for i in range(1, k + 1)
            for v in values
        ]
    )
