"""Annotation filters, transcript structure, neighbours and novel-exon insertion.

Windows here are per transcript, whose exon count is bounded by biology; anything keyed by
gene or chromosome is aggregated instead.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from exonloom.functions.sequence import gc_percent, strip_version
from exonloom.operators.intervals import merge, merge_within, occupied_rungs, point_join, subtract
from exonloom.session import cut_lineage

ID_COLUMNS = ("gene_id", "transcript_id", "exon_id")


# ---------------------------------------------------------------- filters

def filter_biotypes(df: DataFrame, column: str, wanted: Sequence[str]) -> DataFrame:
    """Rows of the given biotypes; a biotype the data does not know is an error."""
    known = df.filter(F.col(column).isin(list(wanted))).select(column).distinct()
    found = {r[0] for r in known.limit(len(wanted)).collect()}
    unknown = sorted(set(wanted) - found)
    if unknown:
        raise ValueError(f"biotypes not in the annotation: {unknown}")
    return df.filter(F.col(column).isin(list(wanted)))


def filter_ids(
    df: DataFrame,
    genes: DataFrame | None = None,
    transcripts: DataFrame | None = None,
    exons: DataFrame | None = None,
    gene_names: DataFrame | None = None,
) -> DataFrame:
    """Semi joins with one-column id tables; given together they all must hold."""
    if genes is not None and gene_names is not None:
        raise ValueError("give gene ids or gene names, not both")
    for ids, column in (
        (genes, "gene_id"), (gene_names, "gene_name"),
        (transcripts, "transcript_id"), (exons, "exon_id"),
    ):
        if ids is not None:
            df = df.join(ids.toDF(column), column, "left_semi")
    return df


def strip_versions(df: DataFrame, columns: Sequence[str] = ID_COLUMNS) -> DataFrame:
    return df.withColumns({c: strip_version(c) for c in columns if c in df.columns})


def drop_sex_duplicates(
    df: DataFrame, remove: Sequence[str] = ("chrY", "Y"), gene: str = "gene_id"
) -> DataFrame:
    """Drop the rows on ``remove`` of genes that own more than one ``gene`` row.

    These genes are few in an annotation; they are found first and stored, so that Spark knows their size and broadcasts
    them instead of shuffling all rows.
    """
    allowed = {"chrX", "chrY", "X", "Y"}
    if not set(remove) <= allowed:
        raise ValueError(f"only {sorted(allowed)} can be removed")
    doubled = cut_lineage(
        df.filter(F.col("feature") == "gene").groupBy(gene)
        .agg(F.count(F.lit(1)).alias("_n"))
        .filter("_n > 1")
        .select(gene, F.lit(True).alias("_doubled"))
    )
    marked = df.join(doubled, gene, "left")
    drop = F.coalesce("_doubled", F.lit(False)) & F.col("chrom").isin(list(remove))
    return marked.filter(~drop).select(*df.columns)


def add_length(df: DataFrame, one_based: bool = False) -> DataFrame:
    return df.withColumn("length", F.col("end") - F.col("start") + F.lit(1 if one_based else 0))


def split_edge_exons(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(inner, edge): edge rows lack a neighbour start on some side."""
    starts = [c for c in df.columns if c.startswith("start_") and "stream" in c]
    missing = F.lit(False)
    for c in starts:
        missing = missing | F.col(c).isNull()
    return df.filter(~missing), df.filter(missing)


# ---------------------------------------------------------------- structure

def _gap_behind() -> tuple[Column, Column]:
    """How far a transcript's exons reach up to this one, and where its next one starts."""
    order = Window.partitionBy("transcript_id").orderBy("start", "end")
    return F.max("end").over(order.rowsBetween(Window.unboundedPreceding, 0)), F.lead("start").over(order)


def introns(exons: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """Gaps between a transcript's own exons, with ``intron_id`` = ``chrom_start_end``."""
    keys = ["transcript_id", "chrom", "strand", *carry]
    reach, after = _gap_behind()
    gaps = exons.select(*keys, reach.alias("_s"), after.alias("_e"))
    return gaps.filter(F.col("_e") > F.col("_s")).select(
        *keys, F.col("_s").alias("start"), F.col("_e").alias("end"),
        F.concat_ws("_", "chrom", F.col("_s").cast("string"), F.col("_e").cast("string")).alias("intron_id"),
    )


def _strand_order(strand: str = "strand") -> list[Column]:
    sign = F.when(F.col(strand) == "-", -1).otherwise(1)
    return [F.col("start") * sign, F.col("end") * sign]


def subfeatures(exons: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """Exons and introns, numbered 1.. in transcript order within each feature.

    An exon brings the gap behind it along (see ``introns``), so the exons are shuffled once, to their transcripts.
    """
    keys = ["transcript_id", "chrom", "strand", *carry]
    reach, after = _gap_behind()
    span = lambda s, e, feature: F.struct(F.col(s).alias("start"), F.col(e).alias("end"), F.lit(feature).alias("feature"))
    own, gap = span("start", "end", "exon"), span("_s", "_e", "intron")
    walked = exons.select(*keys, "start", "end", reach.alias("_s"), after.alias("_e"))
    rows = walked.select(*keys, F.inline(F.when(F.col("_e") > F.col("_s"), F.array(own, gap)).otherwise(F.array(own))))
    order = Window.partitionBy("transcript_id", "feature").orderBy(*_strand_order())
    return rows.withColumn("number", F.row_number().over(order).cast("bigint"))


def neighbours(
    features: DataFrame, level: int = 2, target: str | None = "exon", attributes: Sequence[str] = ()
) -> DataFrame:
    """Target features (all where ``target`` is None) with their ``level`` nearest features on both sides, strand aware.

    Features of a transcript tile it, so the k-th nearest is the k-th row before or after; one
    window per transcript answers every level.  A bookended neighbour is at distance 1.
    """
    if level < 0:
        raise ValueError("level cannot be negative")
    order = Window.partitionBy("transcript_id").orderBy(*_strand_order(), F.desc("feature"))
    out = features
    added = {}
    for k in range(1, level + 1):
        for side, shift in (("upstream", F.lag), ("downstream", F.lead)):
            for c in ("start", "end", "feature", "number", *attributes):
                added[f"{c}_{side}_{k}"] = shift(c, k).over(order)
    out = out.withColumns(added) if added else out
    for k in range(1, level + 1):
        for side in ("upstream", "downstream"):
            s, e = F.col(f"start_{side}_{k}"), F.col(f"end_{side}_{k}")
            out = out.withColumn(
                f"distance_{side}_{k}",
                F.when(e <= F.col("start"), F.col("start") - e + 1).otherwise(s - F.col("end") + 1),
            )
    return out if target is None else out.filter(F.col("feature") == target)


def splice_sites(exons: DataFrame) -> DataFrame:
    """Two-base windows at exon edges that are splice sites (outer transcript ends are not)."""
    asc = Window.partitionBy("transcript_id").orderBy("start", "end")
    desc = Window.partitionBy("transcript_id").orderBy(F.desc("start"), F.desc("end"))
    numbered = exons.withColumns(
        {"_first": F.row_number().over(asc), "_last": F.row_number().over(desc)}
    )
    sides = F.filter(
        F.array(
            F.when(F.col("_first") > 1, F.struct((F.col("start") - 2).alias("s"), F.col("start").alias("e"))),
            F.when(F.col("_last") > 1, F.struct(F.col("end").alias("s"), (F.col("end") + 2).alias("e"))),
        ),
        lambda x: x.isNotNull(),
    )
    rest = [c for c in exons.columns if c not in ("start", "end")]
    return numbered.select(*rest, F.explode(sides).alias("_w")).select(
        *rest, F.col("_w.s").alias("start"), F.col("_w.e").alias("end")
    )


def splice_site_regions(introns_df: DataFrame, five: int = 2, three: int = 2) -> DataFrame:
    """Donor and acceptor windows inside each intron, swapped on the minus strand."""
    minus = F.col("strand") == "-"
    donor = F.when(minus, F.struct((F.col("end") - five).alias("s"), F.col("end").alias("e"))).otherwise(
        F.struct(F.col("start").alias("s"), (F.col("start") + five).alias("e"))
    )
    acceptor = F.when(minus, F.struct(F.col("start").alias("s"), (F.col("start") + three).alias("e"))).otherwise(
        F.struct((F.col("end") - three).alias("s"), F.col("end").alias("e"))
    )
    rest = [c for c in introns_df.columns if c not in ("start", "end")]
    both = F.array(
        F.struct(F.lit("donor").alias("region"), donor.alias("w")),
        F.struct(F.lit("acceptor").alias("region"), acceptor.alias("w")),
    )
    return introns_df.select(*rest, F.explode(both).alias("_x")).select(
        *rest, F.col("_x.region").alias("region"),
        F.col("_x.w.s").alias("start"), F.col("_x.w.e").alias("end"),
    )


def merged_exons(exons: DataFrame, by_gene: bool = True) -> DataFrame:
    """Merged exon intervals with the number of exons in each; a gene's extent is bounded."""
    if by_gene:
        return merge_within(exons, ["chrom", "strand", "gene_id"])
    return merge(exons, ["chrom", "strand"])


def inverse_coordinates(
    transcripts: DataFrame,
    exons: DataFrame,
    shrink_five: int = 0,
    shrink_three: int = 0,
    bin_width: int = 1 << 14,
) -> DataFrame:
    """Transcript stretches without any exon, strand-aware shrunk; emptied ones are dropped.

    Exons of every gene and strand count, so the subtraction is keyed by chromosome alone.
    """
    if shrink_five < 0 or shrink_three < 0:
        raise ValueError("only positive shrinking is allowed")
    free = subtract(transcripts, exons.select("chrom", "start", "end"), ["chrom"], bin_width)
    plus = F.col("strand") == "+"
    moved = free.select(
        *[c for c in free.columns if c not in ("start", "end")],
        (F.col("start") + F.when(plus, shrink_five).otherwise(shrink_three)).alias("start"),
        (F.col("end") - F.when(plus, shrink_three).otherwise(shrink_five)).alias("end"),
    )
    return moved.filter(F.col("start") < F.col("end"))


def coordinates_with_ids(df: DataFrame, keys: Sequence[str], id_column: str) -> DataFrame:
    """Distinct coordinates with the sorted, comma-joined ids that share them."""
    return df.groupBy(*keys).agg(
        F.array_join(F.array_sort(F.collect_set(id_column)), ",").alias(f"{id_column}s")
    )


def region_arrays(features: DataFrame) -> DataFrame:
    """One row per transcript: 5' and 3' UTR, exon, CDS and intron intervals in transcript order.

    UTRs run from the transcript edge to its first start (stop) codon and are null without one;
    introns that overlap a UTR are left out.  ``features`` holds transcript, exon, CDS,
    start_codon and stop_codon rows.
    """
    minus = F.col("strand") == "-"
    span = F.struct("start", "end")
    of = lambda name: F.col("feature") == name
    first_codon = lambda name: F.min(F.when(of(name), span))
    per_tx = features.groupBy("transcript_id", "chrom", "strand").agg(
        F.min(F.when(of("transcript"), F.col("start"))).alias("tx_start"),
        F.max(F.when(of("transcript"), F.col("end"))).alias("tx_end"),
        first_codon("start_codon").alias("_c5"),
        first_codon("stop_codon").alias("_c3"),
        F.array_sort(F.collect_list(F.when(of("exon"), span))).alias("_exons"),
        F.array_sort(F.collect_list(F.when(of("CDS"), span))).alias("_cds"),
    )
    interval = lambda s, e: F.struct(s.cast("bigint").alias("start"), e.cast("bigint").alias("end"))
    utr5 = F.when(
        F.col("_c5").isNotNull(),
        F.when(minus, interval(F.col("_c5.end"), F.col("tx_end"))).otherwise(
            interval(F.col("tx_start"), F.col("_c5.start"))
        ),
    )
    utr3 = F.when(
        F.col("_c3").isNotNull(),
        F.when(minus, interval(F.col("tx_start"), F.col("_c3.start"))).otherwise(
            interval(F.col("_c3.end"), F.col("tx_end"))
        ),
    )
    gaps = F.filter(
        F.transform(
            F.sequence(F.lit(0), F.size("_exons") - 2),
            lambda i: interval(
                F.get("_exons", i)["end"], F.get("_exons", i + 1)["start"]
            ),
        ),
        lambda x: x["start"] < x["end"],
    )
    outside = lambda x, utr: F.col(utr).isNull() | ~(
        (F.col(f"{utr}.start") < x["end"]) & (x["start"] < F.col(f"{utr}.end"))
    )
    in_order = lambda c: F.when(minus, F.reverse(c)).otherwise(c)
    with_utr = per_tx.withColumns({"utr5": utr5, "utr3": utr3}).withColumn(
        "_introns", F.when(F.size("_exons") > 1, gaps)
    )
    return with_utr.select(
        "transcript_id", "chrom", "strand", "tx_start", "tx_end", "utr5", "utr3",
        in_order(F.col("_exons")).alias("exons"),
        in_order(F.col("_cds")).alias("cds"),
        in_order(
            F.filter("_introns", lambda x: outside(x, "utr5") & outside(x, "utr3"))
        ).alias("introns"),
    )


def tag_introns_in_utr(introns_df: DataFrame, regions: DataFrame, utr: str) -> DataFrame:
    """``True`` / ``False`` / ``no_<utr>`` for each intron of a transcript."""
    table = regions.select("transcript_id", F.col(utr).alias("_u"))
    joined = introns_df.join(table, "transcript_id", "left")
    hit = (F.col("_u.start") < F.col("end")) & (F.col("start") < F.col("_u.end"))
    label = F.when(F.col("_u").isNull(), f"no_{utr}").when(hit, "True").otherwise("False")
    return joined.withColumn(f"in_{utr}", label).drop("_u")


def _region_row(region: str):
    return lambda x, i: F.struct(
        F.lit(region).alias("region"), (i + 1).cast("bigint").alias("score"),
        x["start"].alias("start"), x["end"].alias("end"),
    )


def labelled_regions(regions: DataFrame, gene: str = "gene_name") -> DataFrame:
    """BED rows named ``region_transcript_gene`` with the ordinal of the region as score."""
    exploded = []
    for region, column in (("utr5", F.array_compact(F.array("utr5"))), ("utr3", F.array_compact(F.array("utr3"))),
                           ("exon", F.col("exons")), ("CDS", F.col("cds")), ("intron", F.col("introns"))):
        exploded.append(
            F.transform(
                F.coalesce(column, F.array()),
                _region_row(region),
            )
        )
    keep = ["chrom", "strand", "transcript_id", *([gene] if gene in regions.columns else [])]
    rows = regions.select(*keep, F.explode(F.concat(*exploded)).alias("_r"))
    name = F.concat_ws("_", F.col("_r.region"), *[F.col(c) for c in keep[2:]])
    return rows.select(
        "chrom", F.col("_r.start").alias("start"), F.col("_r.end").alias("end"),
        name.alias("name"), F.col("_r.score").alias("score"), "strand",
    )


def attribute_arrays(features: DataFrame, values: Sequence[str] = ("gc", "length")) -> DataFrame:
    """Per transcript, arrays of feature attributes in transcript order."""
    aggs = [
        F.transform(
            F.array_sort(
                F.collect_list(F.when(F.col("feature") == f, F.struct("number", F.col(v).alias("v"))))
            ),
            lambda x: x["v"],
        ).alias(f"{v}_{f}")
        for f in ("exon", "intron")
        for v in values
    ]
    return features.groupBy("transcript_id").agg(*aggs)


def explode_arrays(df: DataFrame, keys: Sequence[str], arrays: dict[str, str]) -> DataFrame:
    """Aligned explode of several arrays with a 1-based ordinal ``number``."""
    zipped = F.arrays_zip(*[F.col(a).alias(n) for n, a in arrays.items()])
    return df.select(*keys, F.posexplode(zipped).alias("_i", "_z")).select(
        *keys, (F.col("_i") + 1).cast("bigint").alias("number"),
        *[F.col(f"_z.{n}").alias(n) for n in arrays],
    )


def sequence_attributes(df: DataFrame, seq: str = "seq") -> DataFrame:
    """GC percentage and length from an extracted sequence."""
    return df.withColumns({"gc": gc_percent(seq), "length": F.length(seq).cast("bigint")})


def biotype_matrix(transcripts: DataFrame, types: Sequence[str] | None = None) -> DataFrame:
    """Transcript type by gene type counts, zero filled."""
    grouped = transcripts.groupBy("transcript_type").pivot("gene_type", list(types) if types else None)
    return grouped.count().na.fill(0)


# ---------------------------------------------------------------- cache lookups

def key_columns(left: DataFrame, right: DataFrame) -> list[str]:
    """Coordinates plus whichever of strand, gene and transcript both sides have."""
    optional = [c for c in ("strand", "gene_name", "gene_id", "transcript_id")
                if c in left.columns and c in right.columns]
    return ["chrom", "start", "end", *optional]


def annotate_by_key(targets: DataFrame, features: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(known, absent): targets matched to cached features, and targets without any."""
    keys = key_columns(targets, features)
    extra = [c for c in targets.columns if c not in keys]
    shadow = [c for c in features.columns if c in extra]
    known = targets.drop(*shadow).join(features, keys)
    absent = targets.join(features.select(*keys), keys, "left_anti")
    return known, absent


def top_known(known: DataFrame, keys: Sequence[str], tie: Sequence[str]) -> DataFrame:
    """The match with the highest rank score of each key, ties by ``tie``.

    Spark keeps one row of a key in each task before the shuffle, and only columns that are used later travel, which a
    ``min_by`` of whole rows would not know.  Like that, it takes the last of a task's rows that are equal in all this.
    """
    order = Window.partitionBy(*keys).orderBy(-F.col("rank_score"), *tie, F.desc("_turn"))
    turned = known.withColumn("_turn", F.monotonically_increasing_id())
    return turned.withColumn("_place", F.row_number().over(order)).filter(F.col("_place") == 1).drop("_place", "_turn")


# ---------------------------------------------------------------- novel exons

def insert_exons(
    new: DataFrame,
    exons: DataFrame,
    gene: str = "gene_id",
    top_only: bool = True,
    bin_width: int = 1 << 14,
    stored: bool = False,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Put novel exons into every transcript of their gene that can hold them.

    A transcript qualifies when it spans the exon and has exons strictly before and after it
    that neither overlap nor touch it.  Features between those two are replaced by
    intron, new exon, intron; exons are renumbered in transcript order.  The new transcript id
    is the old one plus a hash of the exon, so a rerun gives the same id.

    ``new`` needs ``exon_id, chrom, start, end, strand`` and the gene column; ``exons`` needs
    ``transcript_id, chrom, start, end, strand, rank_score`` and the gene column.  Returns
    (inserted exons, structures of the new transcripts, discarded exons).  Where several of them are used, ``stored``
    keeps the exons in their places in the shared checkpoint folder, so that these are found once.
    """
    body = exons.select(
        gene, "transcript_id", "chrom", "strand", "rank_score",
        F.col("start").alias("_s"), F.col("end").alias("_e"),
    )
    spans = body.groupBy(gene, "chrom", "strand", "transcript_id", "rank_score").agg(
        F.min("_s").alias("start"), F.max("_e").alias("end"),
        F.collect_list(F.struct(F.col("_s").alias("s"), F.col("_e").alias("e"))).alias("parts"),
    )
    if stored:
        spans = cut_lineage(spans)
    # Only transcripts that hold the exon's first base are met; the search is inside each one's exon array.
    rungs = occupied_rungs(spans, bin_width) if stored else None
    met = point_join(new, spans, [gene, "chrom", "strand"], bin_width, "start", rungs=rungs)
    before = F.array_max(
        F.transform(F.filter("parts_b", lambda x: x["e"] <= F.col("start")), lambda x: x["e"])
    )
    after = F.array_min(
        F.transform(F.filter("parts_b", lambda x: x["s"] >= F.col("end")), lambda x: x["s"])
    )
    placed = met.select(
        *new.columns, F.col("transcript_id_b").alias("base_transcript_id"),
        F.col("rank_score_b").alias("rank_score"), "parts_b",
        before.alias("before_end"), after.alias("after_start"),
    ).filter((F.col("before_end") < F.col("start")) & (F.col("after_start") > F.col("end")))
    stays = F.filter(
        "parts_b", lambda x: (x["e"] <= F.col("before_end")) | (x["s"] >= F.col("after_start"))
    )
    earlier = F.filter(
        "parts_b",
        lambda x: F.when(F.col("strand") == "-", x["s"] >= F.col("after_start")).otherwise(
            x["e"] <= F.col("before_end")
        ),
    )
    fits = placed.select(
        *new.columns, "base_transcript_id", "rank_score",
        F.concat_ws("_", "base_transcript_id", F.substr(F.md5("exon_id"), F.lit(1), F.lit(8))).alias("transcript_id"),
        (F.size(earlier) + 1).cast("bigint").alias("number"), stays.alias("_stays"),
    )
    chosen = fits
    if top_only:
        chosen = top_known(fits, ["exon_id", gene], ["base_transcript_id"])
    if stored:
        chosen = cut_lineage(chosen)
    own = F.array(F.struct(F.col("start").alias("s"), F.col("end").alias("e")))
    rebuilt = chosen.select(
        "transcript_id", "chrom", "strand", gene, "rank_score", F.inline(F.concat("_stays", own))
    ).withColumnsRenamed({"s": "start", "e": "end"})
    structures = subfeatures(rebuilt, [gene, "rank_score"])
    inserted = chosen.drop("_stays").withColumn("feature", F.lit("exon"))
    # the best of an exon is chosen among its places, so the exons that have one are the same
    discarded = new.join((chosen if stored else fits).select("exon_id").distinct(), "exon_id", "left_anti")
    return inserted, structures, discarded


def is_novel(transcript: str = "transcript_id") -> Column:
    return F.contains(F.col(transcript), F.lit("_"))


# ---------------------------------------------------------------- training labels

def base_class_marks(exons: DataFrame) -> DataFrame:
    """Non-zero base classes ``(transcript_id, pos, class)``: 1 at donors, 2 at acceptors.

    Positions are transcript-wise and 0-based; a site marks the two intronic bases beside the
    exon edge.  All other bases are class 0 and take no row.
    """
    asc = Window.partitionBy("transcript_id").orderBy("start", "end")
    whole = Window.partitionBy("transcript_id")
    placed = exons.select("transcript_id", "strand", "start", "end").withColumns(
        {
            "_n": F.row_number().over(asc), "_count": F.count(F.lit(1)).over(whole),
            "_lo": F.min("start").over(whole), "_hi": F.max("end").over(whole),
        }
    )
    minus = F.col("strand") == "-"
    # transcript-wise positions of the first and last exonic base
    first = F.when(minus, F.col("_hi") - F.col("end")).otherwise(F.col("start") - F.col("_lo"))
    last = F.when(minus, F.col("_hi") - F.col("start")).otherwise(F.col("end") - F.col("_lo")) - 1
    ordinal = F.when(minus, F.col("_count") - F.col("_n") + 1).otherwise(F.col("_n"))
    marks = F.array_compact(
        F.array(
            F.when(ordinal > 1, F.struct((first - 2).alias("pos"), F.lit(2).alias("class"))),
            F.when(ordinal > 1, F.struct((first - 1).alias("pos"), F.lit(2).alias("class"))),
            F.when(ordinal < F.col("_count"), F.struct((last + 1).alias("pos"), F.lit(1).alias("class"))),
            F.when(ordinal < F.col("_count"), F.struct((last + 2).alias("pos"), F.lit(1).alias("class"))),
        )
    )
    return placed.select("transcript_id", F.inline(marks))


def dense_classes(marks: DataFrame, transcripts: DataFrame) -> DataFrame:
    """One class array per transcript, for trainers that want every base."""
    table = marks.groupBy("transcript_id").agg(
        F.map_from_entries(F.collect_set(F.struct(F.col("pos").cast("int"), "class"))).alias("_m")
    )
    positions = F.sequence(F.lit(0), (F.col("end") - F.col("start") - 1).cast("int"))
    label = lambda i: F.coalesce(F.try_element_at("_m", i), F.lit(0))
    return transcripts.join(table, "transcript_id").select(
        "transcript_id", F.transform(positions, label).alias("classes")
    )
