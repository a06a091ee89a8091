"""Nearest-control matching without replacement, and the paired tables built from it.

Responsive (KD) rows choose in a fixed order; each takes the nearest control still free.  Controls of equal features
are one kind; at equal distance the kind whose first row comes first is taken, and of a kind the first free row.  That
is the one rule, whatever the plan: groups below a checked size are matched by one pass in a task, larger ones by
rounds of proposals over tiles of growing width, in which every open row proposes to its nearest kind that is free or held
by a later row, and a kind keeps the earliest proposers.  As all kinds prefer earlier rows, the rounds end in the same
matching whatever the order of proposals, and every round is an ordinary distributed job.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from exonloom.operators.ranking import top_row
from exonloom.operators.scan import Running, position_block, prefix_scan
from exonloom.session import cut_lineage

METRICS = ("euclidean", "cityblock", "max", "sum", "avg")

# Features along which the tiles of a large group are cut.
_GRID_DIMENSIONS = 3


def scale_features(
    df: DataFrame, group: str, features: Sequence[str], log_features: Sequence[str] = ()
) -> DataFrame:
    """``scaled_<feature>``: z-scores with the population deviation of the group, after log10."""
    log = {c: F.log10(F.col(c)) for c in log_features}
    value = lambda c: log.get(c, F.col(c).cast("double"))
    moments = df.groupBy(group).agg(
        *[F.avg(value(c)).alias(f"_m_{c}") for c in features],
        *[F.stddev_pop(value(c)).alias(f"_s_{c}") for c in features],
    )
    joined = df.join(moments, group)
    scaled = {
        f"scaled_{c}": (value(c) - F.col(f"_m_{c}"))
        / F.when(F.col(f"_s_{c}") > 0, F.col(f"_s_{c}")).otherwise(F.lit(1.0))
        for c in features
    }
    return joined.select(*df.columns, *[v.alias(k) for k, v in scaled.items()])


def greedy_match(
    df: DataFrame,
    group: str,
    role: str,
    order: str,
    target: str,
    features: Sequence[str],
    metric: str = "euclidean",
    kd: str = "KD",
    ctrl: str = "CTRL",
    task_limit: int = 20_000,
) -> DataFrame:
    """``(group, kd_order, ctrl_order, distance)`` for every KD row that finds a control.

    ``order`` is a unique non-negative integer that gives the order of choice and breaks
    distance ties: first that of the first control with the same features, then its own.  Controls that share a
    ``target`` count once (their first row).  Groups of at most ``task_limit`` rows are matched inside one task, larger
    ones by rounds, with the same result.  Rows with a null or undefined feature take no part.
    """
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    named = {f"_f{i}": F.col(c).cast("double") for i, c in enumerate(features)}
    f = list(named)
    rows = df.select(
        F.col(group).alias("grp"), F.col(role).alias("role"), F.col(order).cast("bigint").alias("ord"),
        F.col(target).alias("target"), *[v.alias(k) for k, v in named.items()],
    )
    for c in f:
        rows = rows.filter(F.col(c).isNotNull() & ~F.isnan(c))
    sizes = rows.groupBy("grp").agg(F.count(F.lit(1)).alias("_n"))
    controls = top_row(rows.filter(F.col("role") == ctrl), ["grp", "target"], F.col("ord"))
    choosers = rows.filter(F.col("role") == kd)
    small = sizes.filter(F.col("_n") <= task_limit).select("grp")
    large = sizes.filter(F.col("_n") > task_limit).select("grp")
    parts = [_match_in_task(choosers.join(small, "grp", "left_semi"), controls.join(small, "grp", "left_semi"), f, metric)]
    if not large.isEmpty():
        parts.append(
            match_by_rounds(choosers.join(large, "grp", "left_semi"), controls.join(large, "grp", "left_semi"), f, metric)
        )
    return reduce(DataFrame.unionByName, parts).withColumnRenamed("grp", group)


def _match_in_task(choosers: DataFrame, controls: DataFrame, f: list[str], metric: str) -> DataFrame:
    kind = dict(choosers.dtypes)["grp"]

    def match(kd: pd.DataFrame, ctrl: pd.DataFrame) -> pd.DataFrame:
        kd = kd.sort_values("ord")
        kinds = ctrl.groupby(f)["ord"].transform("min") if len(ctrl) else ctrl["ord"]
        ctrl = ctrl.assign(_kind=kinds).sort_values(["_kind", "ord"])
        points, free = ctrl[f].to_numpy(), np.ones(len(ctrl), bool)
        found = []
        for row, at in zip(kd["ord"], kd[f].to_numpy()):
            if not free.any():
                break
            gap = np.abs(points - at)
            dist = {
                "euclidean": lambda: np.sqrt((gap * gap).sum(axis=1)), "max": lambda: gap.max(axis=1),
                "avg": lambda: gap.mean(axis=1),
            }.get(metric, lambda: gap.sum(axis=1))()
            best = int(np.argmin(np.where(free, dist, np.inf)))
            free[best] = False
            found.append((kd["grp"].iloc[0], row, ctrl["ord"].iloc[best], float(dist[best])))
        return pd.DataFrame(found, columns=["grp", "kd_order", "ctrl_order", "distance"])

    return choosers.groupBy("grp").cogroup(controls.groupBy("grp")).applyInPandas(
        match, f"grp {kind}, kd_order bigint, ctrl_order bigint, distance double"
    )


def _number(df: DataFrame, keys: list[str], order: str, name: str) -> DataFrame:
    """1-based position along ``order`` within the keys, by a blocked scan."""
    return prefix_scan(df, keys, position_block(order), [order], [Running(name, "sum", F.lit(1), True)])


def match_by_rounds(
    choosers: DataFrame, controls: DataFrame, f: list[str], metric: str, tile_rows: int = 20_000
) -> DataFrame:
    """The distributed matching for groups of any size, in a number of rounds that is known beforehand.

    Controls with equal features form one item with a capacity.  The items of a group are cut into tiles by quantiles of
    up to three features, about ``tile_rows`` of them in a tile.  A task settles the rows of a tile (see ``settle_tile``);
    a row whose nearest control there may not be the nearest of all waits for the next round, whose tiles are twice as
    wide along each feature.  The tiles of the last round are whole groups, so there are 1 + log2(tiles along a feature) rounds.
    """
    d = f[:_GRID_DIMENSIONS]
    items = cut_lineage(
        controls.groupBy("grp", *f).agg(F.min("ord").alias("item"), F.count(F.lit(1)).alias("capacity"))
    )
    most = items.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    levels = max(1, int(np.ceil(np.log2(max(most / tile_rows, 1)) / len(d))))
    shares = [i / (1 << levels) for i in range(1, 1 << levels)]
    # a row for each of the large groups: where its tiles are cut, and the least and greatest value of every feature
    frame = cut_lineage(
        items.groupBy("grp").agg(
            *[F.percentile_approx(c, shares).alias(f"e{c}") for c in d],
            F.array(*[F.min(c) for c in f]).alias("lo"), F.array(*[F.max(c) for c in f]).alias("hi"),
        )
    )
    frames = {
        r["grp"]: ([np.array(r[f"e{c}"]) for c in d], np.array(r["lo"]), np.array(r["hi"])) for r in frame.toLocalIterator()
    }
    cells = [f"_c{c}" for c in d]
    cell = lambda c: F.size(F.filter(f"e{c}", lambda e: F.col(c) >= e)).alias(f"_c{c}")
    place = lambda df: df.join(frame.drop("lo", "hi"), "grp").select(*df.columns, *[cell(c) for c in d])
    items = cut_lineage(place(items))
    state = cut_lineage(
        place(choosers.select("grp", "ord", *f)).withColumns({"item": F.lit(-1).cast("bigint"), "distance": F.lit(None).cast("double")})
    )
    for level in range(levels + 1):
        tiles = {f"_t{i}": F.shiftright(c, level) for i, c in enumerate(cells)}
        of_tile = lambda df: df.withColumns(tiles).groupBy("grp", *tiles)
        settle = _settler(state.columns, f, level, levels, frames, metric)
        state = cut_lineage(of_tile(state).cogroup(of_tile(items)).applyInPandas(settle, state.schema))
    # The n-th chooser of an item, in order, takes its n-th control.
    takers = _number(state.filter("item >= 0").select("grp", "item", "ord", "distance"), ["grp", "item"], "ord", "_nth")
    member = items.select("grp", "item", *f).join(controls.select("grp", "ord", *f), ["grp", *f]).select("grp", "item", "ord")
    seats = _number(member, ["grp", "item"], "ord", "_nth").select("grp", "item", "_nth", F.col("ord").alias("ctrl_order"))
    return takers.join(seats, ["grp", "item", "_nth"]).select(
        "grp", F.col("ord").alias("kd_order"), "ctrl_order", "distance"
    )


def _settler(columns: list[str], f: list[str], level: int, levels: int, frames: dict, metric: str):
    def settle(key: tuple, kd: pd.DataFrame, ctrl: pd.DataFrame) -> pd.DataFrame:
        if not len(kd) or not len(ctrl) or (kd["item"] >= 0).all():
            return kd[columns]
        at = kd[f].to_numpy()
        bound = reach_of_tile(at, [int(c) for c in key[1:]], level, levels, frames[key[0]], metric)
        found, distance = settle_tile(
            kd["ord"].to_numpy(), at, kd["item"].to_numpy(), kd["distance"].to_numpy("float64"), bound,
            ctrl["item"].to_numpy(), ctrl["capacity"].to_numpy(), ctrl[f].to_numpy(), metric,
        )
        return kd.assign(item=found, distance=distance)[columns]

    return settle


def _length_of(gap, metric: str):
    """Distances of rows of absolute differences."""
    if metric == "euclidean":
        return np.sqrt((gap * gap).sum(axis=-1))
    if metric == "max":
        return gap.max(axis=-1)
    return gap.mean(axis=-1) if metric == "avg" else gap.sum(axis=-1)


def reach_of_tile(at, cells: list[int], level: int, levels: int, frame: tuple, metric: str):
    """For each row of ``at`` a distance that no item outside its tile falls short of.

    An item outside lies beyond a face of the tile along one feature, and within the values of its group along the others.
    """
    cuts, lo, hi = frame
    box = np.maximum(np.maximum(lo - at, at - hi), 0)
    reach = np.full(len(at), np.inf)
    for j, c in enumerate(cells):
        faces = [(c << level) - 1] if c else []
        faces += [((c + 1) << level) - 1] if c + 1 < 1 << (levels - level) else []
        for face in faces:
            gap = box.copy()
            gap[:, j] = np.maximum(gap[:, j], np.abs(at[:, j] - cuts[j][face]))
            reach = np.minimum(reach, _length_of(gap, metric))
    return reach * (1 - 1e-12)


def _buckets(points, most: int = 256) -> list:
    """Rows of ``points`` in buckets of near ones, by halving along the widest feature."""
    out, todo = [], [np.arange(len(points))]
    while todo:
        rows = todo.pop()
        wide = int(np.ptp(points[rows], axis=0).argmax())
        if len(rows) <= most:
            out.append(rows)
            continue
        order, half = np.argpartition(points[rows, wide], len(rows) // 2), len(rows) // 2
        todo += [rows[order[:half]], rows[order[half:]]]
    return out


def settle_tile(order, at, held, distance, bound, items, capacity, points, metric: str) -> tuple:
    """``(item, distance)`` of the rows of a tile after all proposals that are certain; -1 where a row waits or finds none.

    Rows without an item (``held`` -1) propose in their order to the nearest item that is free or held by a later row; a
    row that loses its place proposes again.  A proposal is made only if it is nearer than ``bound``, what lies outside the
    tile.  Items are searched in buckets, nearest bucket first, and full buckets are passed over.
    """
    never = np.iinfo(np.int64).max
    held, distance = held.astype(np.int64).copy(), distance.copy()
    number = {int(i): k for k, i in enumerate(items.tolist())}
    holders: list[list] = [[] for _ in range(len(items))]
    for row in np.flatnonzero(held >= 0).tolist():
        heapq.heappush(holders[number[int(held[row])]], (-int(order[row]), row))
    cutoff = np.full(len(items), never)  # an item takes rows before its cutoff
    for k, own in enumerate(holders):
        if len(own) >= capacity[k]:
            cutoff[k] = -own[0][0]
    rows_of = _buckets(points)
    of_bucket = np.empty(len(items), np.int64)
    for k, rows in enumerate(rows_of):
        of_bucket[rows] = k
    inside = [points[rows] for rows in rows_of]
    low, high = np.array([x.min(axis=0) for x in inside]), np.array([x.max(axis=0) for x in inside])
    last = np.array([cutoff[rows].max() for rows in rows_of])
    waiting = [(int(order[row]), row) for row in np.flatnonzero(held < 0).tolist()]
    heapq.heapify(waiting)
    while waiting:
        turn, row = heapq.heappop(waiting)
        x, limit = at[row], bound[row]
        near = _length_of(np.maximum(np.maximum(low - x, x - high), 0), metric)
        near[last <= turn] = np.inf
        best, found = np.inf, -1
        while True:
            k = int(near.argmin())
            if near[k] > best or near[k] >= limit:
                break
            rows = rows_of[k]
            gap = _length_of(np.abs(inside[k] - x), metric)
            gap[cutoff[rows] <= turn] = np.inf
            least = gap.min()
            if least < np.inf and least <= best:
                same = rows[gap == least]
                first = int(same[items[same].argmin()])
                if least < best or items[first] < items[found]:
                    best, found = least, first
            near[k] = np.inf
        if found < 0 or not best < limit:
            continue
        held[row], distance[row] = items[found], best
        own = holders[found]
        heapq.heappush(own, (-turn, row))
        if len(own) > capacity[found]:
            other = heapq.heappop(own)[1]
            held[other], distance[other] = -1, np.nan
            heapq.heappush(waiting, (int(order[other]), other))
        if len(own) >= capacity[found]:
            cutoff[found] = -own[0][0]
            k = of_bucket[found]
            last[k] = cutoff[rows_of[k]].max()
    return held, distance


def pairs_to_wide(
    df: DataFrame, target: str, keys: Sequence[str], values: Sequence[str], kd: str = "KD", ctrl: str = "CTRL"
) -> DataFrame:
    """Matched rows side by side: a KD row meets the control it is paired with."""
    keys = list(keys)
    left = df.filter(F.col("exon_group") == kd).select(
        *keys, "paired_with", *[F.col(c).alias(f"{c}_{kd}") for c in (target, *values)]
    )
    right = df.filter(F.col("exon_group") == ctrl).select(
        *keys, F.col(target).alias("paired_with"), *[F.col(c).alias(f"{c}_{ctrl}") for c in (target, *values)]
    )
    return left.join(right, [*keys, "paired_with"]).drop("paired_with")


def pair_differences(pairs: DataFrame, rows: DataFrame, order: str, values: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Value differences (KD minus control) of matched pairs; each side is looked up by order."""
    keys = list(keys)
    side = lambda prefix: rows.select(
        *keys, F.col(order).alias(f"{prefix}_order"), *[F.col(v).alias(f"_{prefix}_{v}") for v in values]
    )
    joined = pairs.join(side("kd"), [*keys, "kd_order"]).join(side("ctrl"), [*keys, "ctrl_order"])
    return joined.select(
        *pairs.columns, *[(F.col(f"_kd_{v}") - F.col(f"_ctrl_{v}")).alias(f"{v}_diff") for v in values]
    )
