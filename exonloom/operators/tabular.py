"""Count matrices, length normalisation and the tabular datasets built from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from exonloom.operators.motifs import count_matrix
from exonloom.schemas import LOCATIONS, SITE_COLUMNS
from exonloom.session import cut_lineage

# Which length each location is divided by.
LOCATION_LENGTH = {
    name: (
        "len_intron_upstream2" if name == "Intron_upstream_2"
        else "len_intron_downstream2" if name == "Intron_downstream_2"
        else f"len_{name.lower()}" if name.startswith("Intron")
        else "len_" + "_".join(name.lower().split("_")[:2])
    )
    for name in LOCATIONS
}


def segment_lengths(df: DataFrame, length: str = "len_seq") -> DataFrame:
    """Exon and intron lengths from first and last exonic positions."""
    us, ue, cs, ce, ds, de = (F.col(c) for c in SITE_COLUMNS)
    return df.withColumns(
        {
            "len_intron_upstream2": us,
            "len_intron_upstream": cs - ue - 1,
            "len_intron_downstream": ds - ce - 1,
            "len_intron_downstream2": F.col(length) - de - 1,
            "len_exon_upstream": ue - us + 1,
            "len_exon_cassette": ce - cs + 1,
            "len_exon_downstream": de - ds + 1,
        }
    )


def normalise_by_length(df: DataFrame, features: Sequence[str], length: str = "len_seq") -> DataFrame:
    return df.withColumns({f: F.col(f) / F.col(length) for f in features})


def location_counts(hits: DataFrame, rbps: Sequence[str]) -> DataFrame:
    """``RBP_location`` counts per sequence; every pair is a column even when absent."""
    features = sorted(f"{r}_{loc}" for r in rbps for loc in LOCATIONS)
    return count_matrix(hits, features, ("rbp_name", "location"))


def location_length(location: Column | str) -> Column:
    """The length column that belongs to a location, for use before pivoting."""
    loc = F.col(location) if isinstance(location, str) else location
    out = None
    for name, column in LOCATION_LENGTH.items():
        test = loc == name
        out = F.when(test, F.col(column)) if out is None else out.when(test, F.col(column))
    return out


def location_densities(hits: DataFrame, lengths: DataFrame, rbps: Sequence[str]) -> DataFrame:
    """``RBP_location`` counts divided by the length of their segment.

    Counting and dividing happen in long form, one row per (sequence, RBP, location), before the
    pivot; a missing or empty outer intron gives 0.
    """
    n = hits.groupBy("seq_id", "rbp_name", "location").agg(F.count(F.lit(1)).alias("n"))
    size = location_length("location")
    outer = F.col("location").isin("Intron_upstream_2", "Intron_downstream_2")
    value = F.when(size != 0, F.col("n") / size)
    dense = n.join(lengths, "seq_id").select(
        "seq_id", F.concat_ws("_", "rbp_name", "location").alias("_feature"),
        F.when(outer, F.coalesce(value, F.lit(0.0))).otherwise(value).alias("_v"),
    )
    features = sorted(f"{r}_{loc}" for r in rbps for loc in LOCATIONS)
    return dense.groupBy("seq_id").pivot("_feature", features).agg(F.first("_v")).na.fill(0.0)


def tabular_dataset(
    summary: DataFrame, counts: DataFrame, drop_prefixes: Sequence[str] = ("other_",)
) -> DataFrame:
    """Sequence summary without its position columns, plus counts and mean cassette strength."""
    dropped = [c for c in summary.columns if c.startswith(tuple(drop_prefixes)) or c in SITE_COLUMNS]
    slim = summary.drop(*dropped).withColumn(
        "average_cassette_strength",
        (F.col("ref_acceptor_cassette") + F.col("ref_donor_cassette")) / 2,
    )
    features = [c for c in counts.columns if c != "seq_id"]
    return slim.join(counts, "seq_id", "left").na.fill(0, features)


def reindex_mutated(df: DataFrame, length: str = "len_seq") -> DataFrame:
    """Site columns without gaps: unknown upstream is 0, unknown downstream the last base."""
    up, down = SITE_COLUMNS[:2], SITE_COLUMNS[4:]
    filled = {c: F.coalesce(F.col(c), F.lit(0)) for c in up}
    filled |= {c: F.coalesce(F.col(c), F.col(length) - 1) for c in down}
    return df.withColumns(filled)


def drop_empty_features(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Drop features that are zero or null in every row, found in one pass."""
    flags = df.agg(
        *[F.max((F.coalesce(F.col(f), F.lit(0)) != 0).cast("int")).alias(f) for f in features]
    ).first()
    return df.drop(*[f for f in features if not flags[f]])


def impute_median(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Null and undefined features as the exact median of the others; a feature without any value stays null.

    Medians of all features are found together, by ranges of values, so no feature is sorted in one task.
    """
    from exonloom.operators.stats import exact_quantiles

    value = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in features}
    long = df.select(*[v.alias(c) for c, v in value.items()]).unpivot([], list(features), "feature", "value")
    found = {r["feature"]: r["quantile"] for r in exact_quantiles(long, ["feature"], "value", [0.5]).collect()}  # one row a feature
    return df.withColumns({c: F.coalesce(v, F.lit(found.get(c)).cast("double")) for c, v in value.items()})


def all_nonzero(df: DataFrame, features: Sequence[str]) -> DataFrame:
    keep = F.lit(True)
    for f in features:
        keep = keep & (F.col(f) != 0)
    return df.filter(keep)


def classify_changes(
    wide: DataFrame, ids: Sequence[str], names: Sequence[str], p: str = "_wilcoxon", dpsi: str = "_dpsi",
    extra: Sequence[str] = (),
) -> DataFrame:
    """Per-RBP columns to rows with ``status`` changed / unchanged; other rows are dropped."""
    parts = F.array(
        *[
            F.struct(
                F.lit(n).alias("rbp_name"), F.col(f"{n}{dpsi}").alias("dpsi"), F.col(f"{n}{p}").alias("p_value"),
                *[F.col(f"{n}{x}").alias(x.strip("_")) for x in extra],
            )
            for n in names
        ]
    )
    status = F.when((F.col("p_value") <= 0.05) & (F.abs("dpsi") >= 0.1), "changed").when(
        (F.col("p_value") <= 0.1) & (F.abs("dpsi") < 0.02), "unchanged"
    )
    rows = wide.select(*ids, F.inline(parts))
    return rows.withColumn("status", status).filter(F.col("status").isNotNull())


def difference_matrix(
    df: DataFrame, key: str, feature: str, group: str, features: Sequence[str],
    positive: str = "KD", negative: str = "CTRL",
) -> DataFrame:
    """Count in one group minus count in the other, per key and feature, in a fixed column order.

    A group without hits in a cell counts as zero there, and so does a cell without any.
    """
    n = df.groupBy(key, feature).agg(
        F.count_if(F.col(group) == positive).alias("_p"), F.count_if(F.col(group) == negative).alias("_n")
    )
    wide = n.withColumn("_d", F.col("_p") - F.col("_n")).groupBy(key).pivot(feature, list(features)).agg(F.first("_d"))
    return wide.na.fill(0, list(features))


def occurrence_histogram(df: DataFrame, key: str, group: str, lump: int = 10) -> DataFrame:
    """How many keys occur n times in each group; ``lump`` and more share one row."""
    n = df.groupBy(group, key).agg(F.count(F.lit(1)).alias("_n"))
    label = F.when(F.col("_n") >= lump, F.lit(f">={lump}")).otherwise(F.col("_n").cast("string"))
    return n.groupBy(group, label.alias("occurrences")).agg(F.count(F.lit(1)).alias("n_keys"))


def chosen_sets(df: DataFrame, key: str, configuration: str) -> DataFrame:
    """How many keys were chosen by exactly each set of configurations."""
    per_key = df.groupBy(key).agg(
        F.array_join(F.array_sort(F.collect_set(configuration)), "&").alias("configurations")
    )
    return per_key.groupBy("configurations").agg(F.count(F.lit(1)).alias("n_keys"))


def _as_text(field: str):
    return lambda x: x[field].cast("string")


def joined_groups(df: DataFrame, keys: Sequence[str], columns: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Comma-joined values per key in a stated order."""
    row = F.struct(*[F.col(c) for c in dict.fromkeys([*order, *columns])])
    grouped = df.groupBy(*keys).agg(F.array_sort(F.collect_list(row)).alias("_r"))
    return grouped.select(
        *keys,
        *[
            F.array_join(F.transform("_r", _as_text(c)), ",").alias(c)
            for c in columns
        ],
    )


def split_by_group(df: DataFrame, group: str, positive: str, header: str = "seq_id"):
    """(positive records, negative records, target vector) for an outside trainer."""
    pos = df.filter(F.col(group) == positive)
    neg = df.filter(F.col(group) != positive)
    return pos, neg, df.select(header, F.when(F.col(group) == positive, 1).otherwise(-1).alias("target"))


# Locations inside the cassette exon, and the distance that splits near from far (fixed values).
CASSETTE_LOCATIONS = [
    "Exon_cassette_acceptor_region",
    "Exon_cassette_fully_contained",
    "Exon_cassette_donor_region",
]
NEAR = 500


def distance_histogram(located: DataFrame, keys: Sequence[str] = (), bins: int = 40) -> DataFrame:
    """Hits per equal-width bin of their distance to the nearer cassette site.

    Near and far hits are binned apart, each over its own range; bin edges come from one row
    of extremes per side.
    """
    d = F.least("distance_to_cassette_acceptor", "distance_to_cassette_donor")
    marked = located.withColumns(
        {
            "distance": d, "near": d < NEAR, "within_exon": F.col("location").isin(CASSETTE_LOCATIONS),
        }
    )
    counted = cut_lineage(
        marked.groupBy(*keys, "near", "within_exon", "distance").agg(F.count(F.lit(1)).alias("_n"))
    )
    span = counted.groupBy("near").agg(F.min("distance").alias("_lo"), F.max("distance").alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / F.lit(bins)
    place = F.when(width > 0, F.least(F.floor((F.col("distance") - F.col("_lo")) / width), F.lit(bins - 1))).otherwise(F.lit(0))
    return counted.join(span, "near").groupBy(*keys, "near", "within_exon", place.cast("bigint").alias("bin")).agg(
        F.sum("_n").alias("n")
    )


def site_effects(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per cassette site: its distance to the hit and the effect on it."""
    sides = F.array(
        *[
            F.struct(
                F.lit(side.capitalize()).alias("splice_site"),
                F.col(f"distance_to_cassette_{side}").alias("distance"),
                F.col(f"{side}_cassette_effect").alias("effect"),
            )
            for side in ("donor", "acceptor")
        ]
    )
    return df.select(*keys, F.inline(sides))


def score_matrix(df: DataFrame, row: str, column: str, score: str, columns: Sequence[str]) -> DataFrame:
    """Best score per row and column, columns in the stated order."""
    return df.groupBy(row).pivot(column, list(columns)).agg(F.max(score))


def names_with_counts(df: DataFrame, name: str) -> DataFrame:
    """``name (N=count)`` labels for reports."""
    n = df.groupBy(name).agg(F.count(F.lit(1)).alias("n"))
    label = F.concat(F.col(name), F.lit(" (N="), F.col("n").cast("string"), F.lit(")"))
    return n.withColumn("label", label)


# |dPSI| above which a pair counts as more or less included (fixed value).
SIGN_LIMIT = 0.09


def mark_direction(df: DataFrame, pairs: DataFrame, keys: Sequence[str], dpsi: str = "dPSI") -> DataFrame:
    """``more_inclusion`` by the sign of the paired responsive exon; null below the limit."""
    direction = F.when(F.col(dpsi) > SIGN_LIMIT, True).when(F.col(dpsi) < -SIGN_LIMIT, False)
    flags = pairs.select(*keys, direction.alias("more_inclusion")).filter(F.col("more_inclusion").isNotNull())
    return df.join(flags.dropDuplicates(list(keys)), list(keys), "left")
