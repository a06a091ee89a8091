"""Annotation (GTF) and identifier-list readers."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from exonloom.schemas import GTF_ATTRIBUTES, GTF_COLUMNS, require


def read_gtf(spark: SparkSession, path: str) -> DataFrame:
    """Nine-column GTF with 0-based starts and the attribute text still packed."""
    return parse_gtf(spark.read.text(path))


def parse_gtf(lines: DataFrame) -> DataFrame:
    """``read_gtf`` on rows ``value``: ``#`` lines and empty lines go, ``.`` and what is no number become null."""
    names = [c.strip().split() for c in GTF_COLUMNS.split(",")]
    kept = lines.filter(~F.col("value").startswith("#") & (F.trim("value") != ""))
    cut = kept.select(F.split("value", "\t").alias("_fields"))  # a step of its own, so that a line is cut once
    raw = cut.select(*[F.nullif(F.get("_fields", F.lit(i)), F.lit(".")).try_cast(kind).alias(n) for i, (n, kind) in enumerate(names)])
    return raw.withColumn("start", F.col("start") - 1)


def attribute_pairs(attribute: Column) -> Column:
    """The ``key value`` pairs of an attribute text, each as an array of its tokens."""
    cleaned = F.regexp_replace(attribute, '"', "")
    return F.transform(F.split(cleaned, r"\s*;\s*"), lambda pair: F.split(F.trim(pair), r"\s+"))


def value_of(pairs: Column, key: str) -> Column:
    """Values of ``key`` joined with ``;``; only the first token of a value counts."""
    values = F.transform(
        F.filter(pairs, lambda p: (F.size(p) > 1) & (F.get(p, F.lit(0)) == key)),
        lambda p: F.get(p, F.lit(1)),
    )
    return F.when(F.size(values) > 0, F.array_join(values, ";"))


def attribute_value(attribute: Column, key: str) -> Column:
    """``value_of`` straight from the text, for one key."""
    return value_of(attribute_pairs(attribute), key)


def expand_attributes(
    gtf: DataFrame, attribute: str = "attribute", keys: Iterable[str] = GTF_ATTRIBUTES
) -> DataFrame:
    """One nullable string column per attribute key; the text is taken apart once for all keys."""
    require(gtf, attribute)
    kept = [c for c in gtf.columns if c != attribute]
    paired = gtf.select(*kept, attribute_pairs(F.col(attribute)).alias("_pairs"))
    return paired.select(*kept, *[value_of(F.col("_pairs"), k).alias(k) for k in keys])


def read_processed(spark: SparkSession, path: str) -> DataFrame:
    """An expanded annotation written earlier as parquet."""
    df = spark.read.parquet(path)
    require(df, "chrom", "start", "end", "feature", "strand", "gene_id", "transcript_id")
    return df


def read_cache(spark: SparkSession, path: str, feature: str, level: int) -> DataFrame:
    """One partition of the neighbour cache (see ``plans.annotation_cache``)."""
    if level not in (0, 1, 2):
        raise ValueError("level must be 0, 1 or 2")
    table = spark.read.parquet(path).filter(F.col("cache_feature") == feature)
    sides = [c for c in table.columns if c.endswith(("_upstream_1", "_upstream_2", "_downstream_1", "_downstream_2"))]
    dropped = [c for c in sides if int(c[-1]) > level]
    return table.drop(*dropped)


def read_ids(spark: SparkSession, source: str | Iterable[str], name: str = "id") -> DataFrame:
    """Identifiers from a one-per-line file, or from values given directly."""
    if isinstance(source, str):
        lines = spark.read.text(source).select(F.trim("value").alias(name))
        return lines.filter(F.col(name) != "")
    return spark.createDataFrame([(str(v),) for v in source], f"{name} string")
