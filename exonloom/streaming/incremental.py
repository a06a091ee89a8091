"""Sequences that arrive over time: scan each batch and append hits and metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from exonloom.operators.motifs import scan_dictionary
from exonloom.operators.perturb import deletion_metadata
from exonloom.schemas import SEQUENCES


def read_sequences(spark: SparkSession, folder: str, files_per_batch: int | None = None) -> DataFrame:
    """A stream over a folder of parquet files with ``seq_id`` and ``seq``."""
    reader = spark.readStream.schema(SEQUENCES)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def append_metadata(
    stream: DataFrame, owners: dict[str, list[str]], out: str, checkpoint: str
) -> StreamingQuery:
    """Scan is stateless per sequence, so hits and deletion rows are appended exactly once.

    Runs over what is available and stops; a restart goes on from ``checkpoint``.
    """
    rows = deletion_metadata(scan_dictionary(stream, owners))
    return (
        rows.writeStream.format("parquet").outputMode("append")
        .option("path", out).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
