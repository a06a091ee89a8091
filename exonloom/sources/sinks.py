"""Writers. Every writer leaves the data distributed; text formats are edges only."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from exonloom.schemas import require


def _tab(df: DataFrame, path: str, header: bool, compression: str | None = None) -> None:
    writer = df.write.mode("overwrite").option("sep", "\t").option("header", header)
    if compression:
        writer = writer.option("compression", compression)
    writer.option("emptyValue", "").csv(path)


def bed_frame(
    df: DataFrame,
    bed6: bool = True,
    one_based: bool = False,
    names: dict[str, str] | None = None,
    extra: Sequence[str] = (),
) -> DataFrame:
    """Columns of a BED file; absent name, score and strand become ``.``."""
    require(df, "chrom", "start", "end")
    for old, new in (names or {}).items():
        df = df.withColumnRenamed(old, new)
    start = F.col("start") - F.lit(1 if one_based else 0)
    cols = [F.col("chrom"), start.alias("start"), F.col("end")]
    if bed6:
        for c in ("name", "score", "strand"):
            value = F.coalesce(F.col(c).cast("string"), F.lit(".")) if c in df.columns else F.lit(".")
            cols.append(value.alias(c))
    return df.select(*cols, *extra)


def write_bed(df: DataFrame, path: str, **options) -> None:
    _tab(bed_frame(df, **options), path, header=False)


def write_bedgraph(df: DataFrame, path: str, value: str) -> None:
    if not path.endswith(".bedgraph"):
        raise ValueError("a bedGraph path must end in .bedgraph")
    _tab(df.select("chrom", "start", "end", value), path, header=False)


def position_track(df: DataFrame, scores: str, decimals: int = 5) -> DataFrame:
    """One row per base of ``[start, end)``; scores run backwards on the minus strand."""
    exploded = df.select(
        "chrom", "start", "end", "strand", F.posexplode(scores).alias("_i", "_v")
    )
    left = F.when(F.col("strand") == "-", F.col("end") - 1 - F.col("_i")).otherwise(
        F.col("start") + F.col("_i")
    ).cast("bigint")
    return exploded.select(
        "chrom", left.alias("start"), (left + 1).alias("end"),
        F.round("_v", decimals).alias("score"),
    )


def fasta_lines(df: DataFrame, header: str = "seq_id", seq: str = "seq") -> DataFrame:
    """FASTA records as text rows; null sequences are left out."""
    return df.filter(F.col(seq).isNotNull()).select(
        F.concat(F.lit(">"), F.col(header), F.lit("\n"), F.col(seq)).alias("value")
    )


def write_fasta(df: DataFrame, path: str, header: str = "seq_id", seq: str = "seq", files: int | None = None) -> None:
    """``files`` spreads the records over that many part files for outside tools."""
    lines = fasta_lines(df, header, seq)
    if files:
        lines = lines.repartition(files)
    lines.write.mode("overwrite").text(path)


def write_ids(df: DataFrame, path: str, column: str) -> None:
    df.select(F.col(column).cast("string").alias("value")).write.mode("overwrite").text(path)


def write_tsv(df: DataFrame, path: str, gzip: bool = True) -> None:
    """Tab-separated with a header; array columns are joined with ``;``."""
    _tab(flat_columns(df), path, header=True, compression="gzip" if gzip else None)


def flat_columns(df: DataFrame) -> DataFrame:
    """Array columns as text joined with ``;``, nulls inside as ``<NA>``."""
    return df.select(
        *[
            F.array_join(F.transform(F.col(f.name), lambda x: x.cast("string")), ";", "<NA>").alias(f.name)
            if f.dataType.typeName() == "array"
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def run_statistics(
    requested: DataFrame, known: DataFrame, written: DataFrame, edge: DataFrame, discarded: DataFrame,
    key: str = "name",
) -> DataFrame:
    """Counters of one annotation run in long form, each side aggregated once."""
    count = F.count(F.lit(1)).cast("bigint")

    def long(df: DataFrame, **counters) -> DataFrame:
        one = df.agg(*[expr.alias(name) for name, expr in counters.items()])
        return one.unpivot([], list(counters), "statistic", "value")

    distinct = F.countDistinct(key)
    parts = [
        long(requested, n_events=count, n_unique_events=distinct),
        long(known, n_known=count, n_unique_known=distinct),
        long(
            requested.join(known, key, "left_anti"),
            n_unknown=count, n_unique_unknown=distinct,
        ),
        long(written, n_written=count),
        long(edge, n_first_or_last=count),
        long(discarded, n_discarded=count),
    ]
    return reduce(DataFrame.unionByName, parts)
