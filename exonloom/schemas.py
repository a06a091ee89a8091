"""Declared schemas of the frames that flow between operators.

Coordinates are 0-based and half open everywhere inside the library.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

INTERVALS = "chrom string, start bigint, end bigint, strand string, name string"

GTF_COLUMNS = (
    "chrom string, source string, feature string, start bigint, end bigint, "
    "score double, strand string, frame string, attribute string"
)

# Attribute keys that an annotation row is expanded to (fixed values).
GTF_ATTRIBUTES = [
    "gene_id",
    "gene_name",
    "gene_type",
    "level",
    "ont",
    "tag",
    "transcript_id",
    "transcript_name",
    "transcript_support_level",
    "transcript_type",
    "exon_id",
    "exon_number",
]

SEQUENCES = "seq_id string, seq string"

MOTIFS = "rbp_name string, motif string"

HITS = "seq_id string, rbp_name string, motif string, start bigint, end bigint"

PREDICTIONS = "seq_id string, pos bigint, acceptor double, donor double"

# The six splice-site columns of a sequence, in transcript order.
SITE_COLUMNS = [
    "start_exon_upstream",
    "end_exon_upstream",
    "start_exon_cassette",
    "end_exon_cassette",
    "start_exon_downstream",
    "end_exon_downstream",
]

# Locations a motif hit can take (fixed values).
LOCATIONS = [
    "Intron_upstream_2",
    "Intron_upstream",
    "Intron_downstream",
    "Intron_downstream_2",
    "Exon_upstream_fully_contained",
    "Exon_upstream_acceptor_region",
    "Exon_upstream_donor_region",
    "Exon_cassette_fully_contained",
    "Exon_cassette_acceptor_region",
    "Exon_cassette_donor_region",
    "Exon_downstream_fully_contained",
    "Exon_downstream_acceptor_region",
    "Exon_downstream_donor_region",
]


def require(df: DataFrame, *columns: str) -> None:
    """Raise when ``df`` lacks one of ``columns``."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; have {df.columns}")
