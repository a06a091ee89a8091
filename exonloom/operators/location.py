"""Where hits lie relative to the exons and introns of their sequence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from exonloom.schemas import SITE_COLUMNS


def distances_to_cassette() -> dict[str, Column]:
    """Distances of a hit to the cassette acceptor and donor, never negative.

    Before the exon the nearest-edge distance (bookended is 1) goes to the acceptor, after it
    to the donor.
    """
    s, e = F.col("start"), F.col("end")
    acc, don = F.col("start_exon_cassette"), F.col("end_exon_cassette")
    before, after = e <= acc, s >= don
    acceptor = F.when(before, acc - e + 1).otherwise(s - acc)
    donor = F.when(before, don - e).when(after, s - don + 1).otherwise(don - e)
    return {
        "distance_to_cassette_acceptor": F.greatest(acceptor, F.lit(0)),
        "distance_to_cassette_donor": F.greatest(donor, F.lit(0)),
    }


def segments(seq_length: Column) -> list[tuple[str, bool, Column, Column]]:
    """(name, is exon, start, end) of the exon and intron segments of a sequence.

    Unknown outer sites fall back to the sequence ends, which leaves empty segments there.
    """
    zero = F.lit(0).cast("bigint")
    up_s, up_e = (F.coalesce(F.col(c), zero) for c in SITE_COLUMNS[:2])
    ca_s, ca_e = F.col(SITE_COLUMNS[2]), F.col(SITE_COLUMNS[3])
    do_s, do_e = (F.coalesce(F.col(c), seq_length) for c in SITE_COLUMNS[4:])
    return [
        ("Exon_upstream", True, up_s, up_e),
        ("Exon_cassette", True, ca_s, ca_e),
        ("Exon_downstream", True, do_s, do_e),
        ("Intron_upstream_2", False, zero, up_s),
        ("Intron_upstream", False, up_e, ca_s),
        ("Intron_downstream", False, ca_e, do_s),
        ("Intron_downstream_2", False, do_e, seq_length),
    ]


def header_length(seq_id: str = "seq_id") -> Column:
    """``end - start`` of a ``chrom:start-end(strand)`` identifier."""
    at = lambda i: F.regexp_extract(F.col(seq_id), r"^[^:]+:(-?\d+)-(\d+)", i).cast("bigint")
    return at(2) - at(1)


def locate(hits: DataFrame, sites: DataFrame, length: str | None = None) -> DataFrame:
    """One row per hit and location label it earns.

    The segments of a sequence are six numbers beside its hits, so no interval join is needed:
    every possible label is a guarded row of one explode.  Exonic hits two or more bases inside
    an exon, and hits that span a whole exon, are fully contained; others touch the acceptor
    region, the donor region, or both.  Intronic hits must lie fully inside an intron.
    """
    size = F.col(length) if length else header_length()
    table = sites.select("seq_id", *SITE_COLUMNS, size.alias("_len"))
    placed = hits.join(table, "seq_id").withColumns(distances_to_cassette())
    s, e = F.col("start"), F.col("end")
    floor = lambda c: F.greatest(c, F.lit(0).cast("bigint"))
    unknown = F.lit(None).cast("bigint")

    def row(test, name, exon, acceptor, donor):
        return F.when(
            test,
            F.struct(
                F.lit(name).alias("location"), F.lit(exon).alias("is_in_exon"),
                acceptor.alias("acceptor"), donor.alias("donor"),
            ),
        )

    rows = []
    for name, exon, a, b in segments(F.col("_len")):
        met = (s < b) & (a < e)
        contained = (s >= a) & (e <= b)
        if exon:
            whole = (contained & (s - a > 1) & (b - e > 1)) | ((s <= a) & (e >= b))
            at = (exon, floor(s - a), floor(b - e))
            rows += [
                row(met & whole, f"{name}_fully_contained", *at),
                row(met & ~whole & (s - a < 2), f"{name}_acceptor_region", *at),
                row(met & ~whole & (b - e < 2), f"{name}_donor_region", *at),
            ]
        else:
            rows.append(
                row(
                    met & contained, name, exon,
                    unknown if name == "Intron_downstream_2" else floor(b - e),
                    unknown if name == "Intron_upstream_2" else floor(s - a),
                )
            )
    exploded = placed.withColumn("_l", F.explode(F.array(*rows))).filter(F.col("_l").isNotNull())
    return exploded.select(
        *hits.columns, "distance_to_cassette_acceptor", "distance_to_cassette_donor",
        F.col("_l.is_in_exon").alias("is_in_exon"), F.col("_l.location").alias("location"),
        F.col("_l.acceptor").alias("distance_to_acceptor"), F.col("_l.donor").alias("distance_to_donor"),
    )


# Exon-edge and intron reach of the RBP map, in bases (fixed values).
EXON_EDGE = 50
INTRON_REACH = 500


def rbp_map_location() -> dict[str, Column]:
    """``new_location`` and ``new_distance`` of a located hit on a 15-label RBP map.

    Hits deeper than the intron reach from every exon get null.
    """
    acc, don = F.col("distance_to_acceptor"), F.col("distance_to_donor")
    cacc, cdon = F.col("distance_to_cassette_acceptor"), F.col("distance_to_cassette_donor")
    loc = F.col("location")

    def exon(prefix, a, d):
        closer_donor = ((a < EXON_EDGE) & (d < EXON_EDGE) & (d < a)) | (a >= EXON_EDGE)
        middle = (a >= EXON_EDGE) & (d >= EXON_EDGE)
        label = (
            F.when(middle, f"{prefix}_exon_middle")
            .when(closer_donor, f"{prefix}_exon_donor_side")
            .otherwise(f"{prefix}_exon_acceptor_side")
        )
        return label, F.when(middle, F.least(a, d)).when(closer_donor, d).otherwise(a)

    near_cassette = (cacc < INTRON_REACH) | (cdon < INTRON_REACH)
    cases = [
        (loc == "Intron_upstream_2", F.lit("Upstream_exon_intron_upstream"), acc),
        (loc == "Intron_downstream_2", F.lit("Downstream_exon_intron_downstream"), don),
        (loc.startswith("Exon_cassette"), *exon("Cassette", cacc, cdon)),
        (loc.startswith("Exon_upstream"), *exon("Upstream", acc, don)),
        (loc.startswith("Exon_downstream"), *exon("Downstream", acc, don)),
        ((loc == "Intron_upstream") & near_cassette, F.lit("Cassette_exon_intron_upstream"), F.least(cacc, cdon)),
        ((loc == "Intron_upstream") & (don < INTRON_REACH), F.lit("Upstream_exon_intron_downstream"), don),
        ((loc == "Intron_downstream") & near_cassette, F.lit("Cassette_exon_intron_downstream"), F.least(cacc, cdon)),
        ((loc == "Intron_downstream") & (acc < INTRON_REACH), F.lit("Downstream_exon_intron_upstream"), acc),
    ]
    label, distance = F.when(cases[0][0], cases[0][1]), F.when(cases[0][0], cases[0][2])
    for test, name, d in cases[1:]:
        label, distance = label.when(test, name), distance.when(test, d)
    return {"new_location": label, "new_distance": distance.cast("bigint")}


def within_triplet(margin: int = 100) -> Column:
    """False for hits in the outer introns farther than ``margin`` from their exon."""
    far_up = (F.col("location") == "Intron_upstream_2") & (
        F.col("start") < F.col("start_exon_upstream") - margin
    )
    far_down = (F.col("location") == "Intron_downstream_2") & (
        F.col("end") > F.col("end_exon_downstream") + margin
    )
    return ~(F.coalesce(far_up, F.lit(False)) | F.coalesce(far_down, F.lit(False)))
