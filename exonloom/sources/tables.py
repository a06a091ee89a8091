"""Reading several result files at once, and the splice-site index table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from exonloom.schemas import SITE_COLUMNS


def read_tsv_union(spark: SparkSession, patterns: list[str]) -> DataFrame:
    """Union by name of tab-separated files; columns absent from one become null."""
    frames = [
        spark.read.option("sep", "\t").option("header", True).csv(p) for p in patterns
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def site_columns(df: DataFrame, acceptors: str = "acceptor_idx", donors: str = "donor_idx") -> DataFrame:
    """``a;b;c`` acceptor and donor lists to six nullable integer columns (``<NA>`` is null)."""
    at = lambda c, i: F.get(F.split(F.col(c), ";"), F.lit(i)).try_cast("bigint")
    interleaved = [at(acceptors if j == 0 else donors, i) for i in range(3) for j in range(2)]
    rest = [c for c in df.columns if c not in (acceptors, donors)]
    return df.select(*rest, *[v.alias(n) for v, n in zip(interleaved, SITE_COLUMNS)])


def read_site_index(spark: SparkSession, path: str) -> DataFrame:
    return site_columns(spark.read.option("sep", "\t").option("header", True).csv(path))


def match_site_index(seqs: DataFrame, index: DataFrame) -> DataFrame:
    """Site columns per sequence, found by ``header`` + ``_`` + ``tx_id``.

    A sequence with several index rows, or with none, fails the job.
    """
    keyed = index.withColumn("seq_id", F.concat_ws("_", "header", "tx_id"))
    one = keyed.groupBy("seq_id").agg(
        F.count(F.lit(1)).alias("_n"), *[F.first(c).alias(c) for c in SITE_COLUMNS]
    )
    base = F.regexp_replace("seq_id", "_REF_seq$", "")
    joined = seqs.select(base.alias("seq_id")).distinct().join(one, "seq_id", "left")
    return joined.withColumn(
        "seq_id",
        F.when(F.col("_n") == 1, F.col("seq_id")).otherwise(
            F.raise_error(F.concat(F.when(F.col("_n") > 1, "several index rows for ").otherwise("no index row for "), "seq_id")).cast("string")
        ),
    ).drop("_n")


def read_raw_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Long per-position predictions saved by an earlier run."""
    return spark.read.parquet(path).select("seq_id", "pos", "acceptor", "donor")
