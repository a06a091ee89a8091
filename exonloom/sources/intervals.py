"""Interval tables: coordinate strings, BED files and sequence headers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from exonloom.functions.sequence import interval_parts


def intervals_from_strings(
    df: DataFrame, column: str, zero_based: bool = True, check_strand: bool = True
) -> DataFrame:
    """Split ``chrom:start-end``; the coordinate column is renamed to ``name``.

    A strand other than + or - fails the job when the row is read.
    """
    if "strand" not in df.columns and "Strand" in df.columns:
        df = df.withColumnRenamed("Strand", "strand")
    parts = df.withColumn("_p", interval_parts(column)).withColumnRenamed(column, "name")
    out = parts.select(
        F.col("_p.chrom").alias("chrom"),
        (F.col("_p.start") - F.lit(0 if zero_based else 1)).alias("start"),
        F.col("_p.end").alias("end"),
        *[c for c in parts.columns if c not in ("_p", "chrom", "start", "end")],
    )
    if check_strand and "strand" in out.columns:
        out = out.withColumn(
            "strand",
            F.when(F.col("strand").isin("+", "-"), F.col("strand")).otherwise(
                F.raise_error(F.lit("strand must be + or -")).cast("string")
            ),
        )
    return out


def read_interval_strings(
    spark: SparkSession,
    path: str,
    column: int = 0,
    header: bool = False,
    zero_based: bool = True,
    names: dict[int, str] | None = None,
) -> DataFrame:
    """Tab-separated table whose ``column``-th field holds ``chrom:start-end``.

    Without a header the remaining fields are named by ``names`` (default: 1 score, 2 strand)
    or ``col_<index>``.
    """
    raw = spark.read.option("sep", "\t").option("header", header).csv(path)
    if not header:
        names = names or {1: "score", 2: "strand"}
        raw = raw.toDF(
            *[
                "name" if i == column else names.get(i, f"col_{i}")
                for i in range(len(raw.columns))
            ]
        )
    return intervals_from_strings(raw, raw.columns[column], zero_based)


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """BED3 to BED6, tab separated, no header."""
    raw = spark.read.option("sep", "\t").option("comment", "#").csv(path)
    labels = ["chrom", "start", "end", "name", "score", "strand"]
    raw = raw.toDF(*[labels[i] if i < 6 else f"col_{i}" for i in range(len(raw.columns))])
    return raw.withColumns(
        {"start": F.col("start").try_cast("bigint"), "end": F.col("end").try_cast("bigint")}
    )


def bed_is_valid(spark: SparkSession, path: str, raise_error: bool = False) -> bool:
    """Does the first line carry at least three fields with integers in the second and third?"""
    first = spark.read.text(path).limit(1).select(F.split("value", "\t").alias("f"))
    ok = first.select(
        (
            (F.size("f") >= 3)
            & F.get("f", F.lit(1)).try_cast("bigint").isNotNull()
            & F.get("f", F.lit(2)).try_cast("bigint").isNotNull()
        ).alias("ok")
    ).first()
    valid = bool(ok and ok["ok"])
    if raise_error and not valid:
        raise ValueError(f"{path} is not a BED file")
    return valid


def header_intervals(df: DataFrame, header: str = "seq_id") -> DataFrame:
    """Parse ``chrom:start-end(strand)`` headers; unparsable ones keep null coordinates."""
    pattern = r"^([^:]+):(-?\d+)-(\d+)\(([+-])"
    part = lambda i: F.nullif(F.regexp_extract(F.col(header), pattern, i), F.lit(""))
    return df.withColumns(
        {
            "chrom": part(1),
            "start": part(2).cast("bigint"),
            "end": part(3).cast("bigint"),
            "strand": part(4),
        }
    )
