"""Functions and table functions of the library under names that SQL can call.

    registry.register(spark)
    spark.sql("select gc_content(seq), reverse_complement(seq) from t")
    spark.sql("select * from nearest_before(table(select gene, kind, pos, name from t) partition by gene order by (pos, kind))")

Scalar functions are SQL functions, which Spark inlines into the plan.  Table functions get one partition of their
table at a time, row by row or batch by batch, and hold a bounded state: none collects its partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

SCALARS = {
    "gc_content": ("seq string", "double", "case when length(seq) > 0 then round(100 * (length(seq) - length(translate(seq, 'GC', ''))) / length(seq), 2) end"),
    "reverse_complement": ("seq string", "string", "reverse(translate(seq, 'ACGTacgt', 'TGCAtgca'))"),
    "overlap_bases": ("s1 bigint, e1 bigint, s2 bigint, e2 bigint", "bigint", "greatest(least(e1, e2) - greatest(s1, s2), 0)"),
}


@F.arrow_udtf(returnType="target string, nearest string, distance bigint")
class NearestBefore:
    """For each row with ``kind`` 1 the last row with ``kind`` 0 before it, in the order that the query gives.

    The table has the columns ``(kind int, pos bigint, name string)`` beside its partition key; of rows at one place the
    features come first if the query orders by ``pos, kind``.  A target without one before it gets nulls.  Batches are
    worked on as columns; a batch hands on its last feature.
    """

    def __init__(self) -> None:
        self.last = None

    def eval(self, batch: pa.RecordBatch) -> Iterator[pa.Table]:
        names, pos = batch.column("name").cast(pa.string()), batch.column("pos").cast(pa.int64())
        feature = pc.fill_null(pc.equal(batch.column("kind"), 0), False).to_numpy(zero_copy_only=False)
        if self.last is not None:
            names, pos = pa.concat_arrays([self.last[0], names]), pa.concat_arrays([self.last[1], pos])
            feature = np.concatenate([[True], feature])
        last = np.maximum.accumulate(np.where(feature, np.arange(len(feature)), -1))
        target = np.flatnonzero(~feature)
        if len(target):
            of = pa.array(last[target], mask=last[target] < 0)
            distance = pc.add(pc.subtract(pos.take(pa.array(target)), pos.take(of)), 1)
            yield pa.table({"target": names.take(pa.array(target)), "nearest": names.take(of), "distance": distance})
        if len(last) and last[-1] >= 0:
            at = pa.array([last[-1]])
            self.last = names.take(at), pos.take(at)


@F.udtf(returnType="name string, value double, place bigint, ties bigint")
class RankedRows:
    """Competition ranks of the rows of a partition that comes ordered by ``value``; ``ties`` counts equal rows before it."""

    def __init__(self) -> None:
        self.seen = self.place = self.ties = 0
        self.value = None

    def eval(self, row) -> Iterator[tuple]:
        self.seen += 1
        if self.seen == 1 or row["value"] != self.value:
            self.place, self.ties, self.value = self.seen, 0, row["value"]
        else:
            self.ties += 1
        yield row["name"], row["value"], self.place, self.ties


@F.arrow_udtf(returnType="key string, rows bigint, first bigint, last bigint, bases bigint")
class Extent:
    """Rows, first start, last end and summed length of a partition with ``(key, start, end)``, batch by batch."""

    def __init__(self) -> None:
        self.key, self.rows, self.first, self.last, self.bases = None, 0, None, None, 0

    def eval(self, batch: pa.RecordBatch) -> Iterator[pa.Table]:
        low, high = pc.min(batch.column("start")).as_py(), pc.max(batch.column("end")).as_py()
        self.key = batch.column("key")[0].as_py()
        self.rows += batch.num_rows
        self.first = low if self.first is None else min(self.first, low)
        self.last = high if self.last is None else max(self.last, high)
        self.bases += pc.sum(pc.subtract(batch.column("end"), batch.column("start"))).as_py()
        return iter(())

    def terminate(self) -> Iterator[pa.Table]:
        if self.rows:
            yield pa.table({
                "key": pa.array([self.key], pa.string()), "rows": pa.array([self.rows], pa.int64()), "first": pa.array([self.first], pa.int64()),
                "last": pa.array([self.last], pa.int64()), "bases": pa.array([self.bases], pa.int64()),
            })


TABLES = {"nearest_before": NearestBefore, "ranked_rows": RankedRows, "extent_of": Extent}


def register(spark: SparkSession) -> list[str]:
    """Make all functions callable from SQL of this session; their names."""
    for name, (arguments, returns, body) in SCALARS.items():
        spark.sql(f"create or replace temporary function {name}({arguments}) returns {returns} return {body}")
    for name, function in TABLES.items():
        spark.udtf.register(name, function)
    return [*SCALARS, *TABLES]
