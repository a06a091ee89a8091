"""Ranked selection.

Every top-1 is a map-side combined aggregate over a sort key, so a key that holds a third of
the rows is reduced before the shuffle instead of being sorted in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Weights of annotation tags (fixed values).
TAG_WEIGHTS = {
    "MANE_Select": 12,
    "CCDS": 11,
    "appris_principal_1": 10,
    "appris_principal_2": 9,
    "appris_principal_3": 8,
    "appris_principal_4": 7,
    "appris_principal_5": 6,
    "basic": 5,
    "appris_alternative_1": 4,
    "appris_candidate": 3,
    "TAGENE": 2,
    "RNA_Seq_supported_only": 1,
    "CAGE_supported_TSS": 1,
}


def tag_score(
    tags: Column | str, weights: dict[str, int] = TAG_WEIGHTS, missing: int = -1
) -> Column:
    """Sum of the weights of ``;``-joined tags; unknown tags weigh 0, no tag scores ``missing``."""
    col = F.col(tags) if isinstance(tags, str) else tags
    lookup = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
    weighed = F.transform(
        F.split(col, ";"), lambda t: F.coalesce(F.try_element_at(lookup, t), F.lit(0))
    )
    total = F.aggregate(weighed, F.lit(0), lambda a, x: a + x)
    return F.coalesce(total, F.lit(missing)).cast("bigint")


def top_row(df: DataFrame, keys: Sequence[str], sort_key: Column, last: bool = False) -> DataFrame:
    """The row of each key with the smallest (or, with ``last``, largest) sort key."""
    row = F.struct(*[F.col(c).alias(c) for c in df.columns])
    pick = F.max_by if last else F.min_by
    return df.groupBy(*keys).agg(pick(row, sort_key).alias("_row")).select("_row.*")


def top_ties(df: DataFrame, keys: Sequence[str], score: str) -> DataFrame:
    """All rows of each key that hold its largest score; the maximum is combined map side."""
    best = df.groupBy(*keys).agg(F.max(score).alias("_best"))
    return df.join(best, list(keys)).filter(F.col(score) == F.col("_best")).drop("_best")


def rank_transcripts(
    transcripts: DataFrame, top_only: bool = False, gene: str = "gene_id"
) -> DataFrame:
    """Score transcripts by tags; the best of a gene has top score, then length, then first id."""
    scored = transcripts.withColumn("rank_score", tag_score("tag"))
    if not top_only:
        return scored
    key = F.struct(
        -F.col("rank_score"), F.col("start") - F.col("end"), F.col("transcript_id")
    )
    return top_row(scored, [gene], key)


def argmax_abs(
    df: DataFrame, keys: Sequence[str], value: str, tie: Sequence[str], smallest: bool = False
) -> DataFrame:
    """The row of each key with the largest (smallest) absolute value, ties by ``tie``."""
    magnitude = F.abs(F.col(value))
    return top_row(
        df, keys, F.struct(magnitude if smallest else -magnitude, *[F.col(c) for c in tie])
    )


def best_row(df: DataFrame, keys: Sequence[str], score: str, tie: Sequence[str]) -> DataFrame:
    """Sort by score, keep the first row of each key."""
    return top_row(df, keys, F.struct(-F.col(score), *[F.col(c) for c in tie]))
