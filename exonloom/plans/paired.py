"""Responsive and control exons to matched pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from exonloom.operators import annotation as an
from exonloom.operators import matching as ma
from exonloom.operators.ranking import argmax_abs, best_row
from exonloom.operators.tabular import joined_groups

# |dPSI| limits of responsive and control events (fixed values).
RESPONSIVE = 0.1
CONTROL = 0.025

FEATURES = ["GC_target", "GC_upstream_1", "GC_downstream_1"]
LENGTHS = ["Length_target", "Length_upstream_1", "Length_downstream_1"]

# Distance configurations: metric and whether lengths take part (fixed values).
CONFIGURATIONS = {
    "euclidean": ("euclidean", False),
    "euclidean_l": ("euclidean", True),
    "cityblock_l": ("cityblock", True),
    "max_l": ("max", True),
    "sum_l": ("sum", True),
    "avg_l": ("avg", True),
}


def select_events(events: DataFrame, controls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One event per (exon, gene, group): the strongest responsive, the weakest control.

    Control exons that respond in any experiment are left out.
    """
    keys = ["target_coordinates", "gene_name", "gene_id", "group"]
    kd = events.filter(F.abs("dPSI") >= RESPONSIVE)
    quiet = controls.filter(F.abs("dPSI") <= CONTROL).join(
        events.select("target_coordinates"), "target_coordinates", "left_anti"
    )
    tie = [c for c in events.columns if c not in (*keys, "dPSI")]
    return argmax_abs(kd, keys, "dPSI", ["dPSI", *tie]), argmax_abs(quiet, keys, "dPSI", ["dPSI", *tie], smallest=True)


def attach_cache(selected: DataFrame, cache: DataFrame) -> DataFrame:
    """Groups joined per exon, the best ranked cached transcript, inner exons only."""
    keys = ["target_coordinates", "gene_name", "gene_id"]
    wide = joined_groups(selected, keys, ["group", "dPSI"], ["group"])
    found = best_row(wide.join(cache, keys), keys, "rank_score", ["transcript_id"])
    return an.split_edge_exons(found)[0]


def pair(exons: DataFrame, order: str, configuration: str = "euclidean_l", group: str = "rbp_name") -> DataFrame:
    """Matched pairs of one configuration with feature differences."""
    metric, with_length = CONFIGURATIONS[configuration]
    names = [*FEATURES, *(LENGTHS if with_length else [])]
    if with_length:
        exons = ma.scale_features(exons, group, names, LENGTHS)
        names = [f"scaled_{n}" for n in names]
    pairs = ma.greedy_match(exons, group, "exon_group", order, "target_coordinates", names, metric)
    return ma.pair_differences(pairs, exons, order, names, [group])
