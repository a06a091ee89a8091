"""FASTA readers and the chunked genome table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULT_CHUNK = 4096


def read_fasta(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Sequences keyed by the first token of their header; a ``>`` inside a header is part of it."""
    return parse_fasta(spark.read.option("lineSep", "\n>").text(path))


def parse_fasta(records: DataFrame) -> DataFrame:
    """``(seq_id, seq)`` from records ``value``: a header line, then sequence lines, with or without ``\\r``."""
    records = records.select(F.regexp_replace("value", "^>", "").alias("value")).filter(F.trim(F.translate("value", "\r\n", "")) != "")
    head = F.substring_index("value", "\n", 1)
    body = F.substr("value", F.length(head) + 2)
    return records.select(
        F.get(F.split(F.trim(F.translate(head, "\r", "")), r"\s+"), F.lit(0)).alias("seq_id"),
        F.regexp_replace(body, r"[\r\n]", "").alias("seq"),
    )


def chunk_sequences(df: DataFrame, chunk: int = DEFAULT_CHUNK) -> DataFrame:
    """``(chrom, chunk_no, bases, chrom_len)``: random access to long sequences by an equi join.

    The split walks the string once; slicing by position would walk it once per chunk.
    """
    cut = F.split("seq", f"(?<=\\G[\\s\\S]{{{chunk}}})")
    return (
        df.select(
            F.col("seq_id").alias("chrom"),
            F.length("seq").cast("bigint").alias("chrom_len"),
            F.posexplode(cut).alias("chunk_no", "bases"),
        )
        .filter(F.col("bases") != "")
        .withColumn("chunk_no", F.col("chunk_no").cast("bigint"))
    )


def read_genome(spark: SparkSession, path: str, chunk: int = DEFAULT_CHUNK) -> DataFrame:
    return chunk_sequences(read_fasta(spark, path), chunk)
