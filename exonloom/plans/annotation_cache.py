"""Annotation to a parquet cache of numbered features and their neighbours.

One table holds every level: a reader takes the columns of the level it needs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from exonloom.operators import annotation as an
from exonloom.operators import sequences as sq
from exonloom.operators.ranking import rank_transcripts
from exonloom.session import cut_lineage, scratch
from exonloom.sources.annotation import expand_attributes, read_gtf

LABELS = ["gene_id", "gene_name", "transcript_type", "rank_score"]
# What ``features_of`` uses of an annotation.
USED = ["feature", "transcript_id", "chrom", "strand", "start", "end", "gene_id", "gene_name", "transcript_type", "tag"]

CODEC = "zstd"  # of the cache's files


def prepare(gtf: DataFrame) -> DataFrame:
    """Expanded annotation without id versions and without sex-chromosome duplicates."""
    return an.drop_sex_duplicates(an.strip_versions(expand_attributes(gtf)))


def _taken_apart(annotation: DataFrame) -> DataFrame:
    """The rows and columns that ``features_of`` uses, stored: its branches and filters take no line apart again."""
    return cut_lineage(annotation.filter(F.col("feature").isin("transcript", "exon")).select(*USED))


def features_of(annotation: DataFrame, genome: DataFrame | None = None, chunk: int = 4096) -> DataFrame:
    """Numbered exons and introns with labels; with a genome also GC and length."""
    ranked = rank_transcripts(annotation.filter("feature = 'transcript'")).select(
        "transcript_id", "gene_id", "gene_name", "transcript_type", "rank_score"
    )
    exons = annotation.filter("feature = 'exon'").select("transcript_id", "chrom", "strand", "start", "end")
    table = an.add_length(an.subfeatures(exons)).join(ranked, "transcript_id")
    if genome is None:
        return table
    with_seq = sq.extract(table, genome, chunk)
    return an.sequence_attributes(with_seq).drop("seq")


def build_cache(
    spark: SparkSession, gtf_path: str, out: str, genome: DataFrame | None = None, chunk: int = 4096, level: int = 2
) -> None:
    """Write ``features`` and ``neighbours`` under ``out``; the features are computed once.

    One window, where the numbering has put the transcripts, gives the neighbours of exons and introns.  Their table holds
    every feature, so the features are read off it and not shuffled again.  What is stored on the way is deleted.
    """
    with scratch(spark):
        features = features_of(_taken_apart(prepare(read_gtf(spark, gtf_path))), genome, chunk)
        extra = [c for c in ("gc", "length") if c in features.columns]
        near = an.neighbours(features, level, None, extra).withColumn("cache_feature", F.col("feature"))
        near.write.mode("overwrite").option("compression", CODEC).partitionBy("cache_feature").parquet(f"{out}/neighbours")
    whole = spark.read.schema(near.schema).parquet(f"{out}/neighbours").select(*features.columns)
    whole.write.mode("overwrite").option("compression", CODEC).parquet(f"{out}/features")


def annotate(
    targets: DataFrame, neighbours: DataFrame, features: DataFrame, name: str = "name", level: int = 2
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(known and inserted targets with neighbours, absent targets, discarded targets).

    Exons missing from the cache are put into transcripts of their gene when the targets carry
    a strand and a gene.
    """
    known, absent = an.annotate_by_key(targets, neighbours)
    best = an.top_known(known, [name], ["transcript_id"])
    gene = next((g for g in ("gene_name", "gene_id") if g in targets.columns), None)
    if gene is None or "strand" not in targets.columns:
        return best, absent, absent.limit(0)
    named = absent.withColumn("exon_id", F.concat(
        "chrom", F.lit(":"), F.col("start").cast("string"), F.lit("-"), F.col("end").cast("string")
    )).select("exon_id", "chrom", "start", "end", "strand", gene, name).dropDuplicates(["exon_id", gene])
    inserted, structures, discarded = an.insert_exons(cut_lineage(named), features.filter("feature = 'exon'"), gene, stored=True)
    around = an.neighbours(an.add_length(structures), level, "exon", ["length"])
    # equal places, said so that the transcript alone is the key: the neighbours stay where their window has put them
    own = inserted.select("transcript_id", F.col("start").alias("_s"), F.col("end").alias("_e"), F.col(name))
    at = (F.col("start") >= F.col("_s")) & (F.col("start") <= F.col("_s")) & (F.col("end") >= F.col("_e")) & (F.col("end") <= F.col("_e"))
    novel = around.join(own, "transcript_id").filter(at).drop("_s", "_e")
    return best.unionByName(novel, allowMissingColumns=True), absent, discarded


def annotate_direct(
    targets: DataFrame, annotation: DataFrame, genome: DataFrame | None = None, chunk: int = 4096, name: str = "name", level: int = 2
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``annotate`` from a prepared annotation (see ``prepare``), without a cache.

    Only genes that a target can touch are worked on: those that the targets name, or, where they name none, those with
    an exon at the coordinates of a target.  The semi join reaches the annotation before anything is ranked, numbered
    or extracted, and Spark may turn it into a runtime filter of the scan.
    """
    gene = next((g for g in ("gene_name", "gene_id") if g in targets.columns), None)
    if gene is not None:
        # null-safe, as a test for null would be carried down to the lines and take each apart once more
        wanted = targets.filter(F.col(gene).isNotNull()).select(F.col(gene).alias("_wanted")).distinct()
        hit = annotation.join(wanted, F.col(gene).eqNullSafe(F.col("_wanted")), "left_semi")
    else:
        keys = ["chrom", "start", "end"]
        genes = annotation.filter("feature = 'exon'").join(targets.select(*keys).distinct(), keys, "left_semi").select("gene_id").distinct()
        hit = annotation.join(genes, "gene_id", "left_semi")
    features = features_of(_taken_apart(hit), genome, chunk)
    extra = [c for c in ("gc", "length") if c in features.columns]
    near = an.neighbours(features, level, "exon", extra)
    return annotate(targets, near, features, name, level)


def drop_overlapping(surrounding: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, removed) when overlapping targets are resolved: known transcripts, then rank."""
    from exonloom.operators.intervals import remove_overlaps

    kept = remove_overlaps(
        surrounding, ["chrom"], ["transcript_id"], "ranked", slack=0, known=~an.is_novel(), rank="rank_score"
    )
    keys = ["chrom", "start", "end", "transcript_id"]
    return kept, surrounding.join(kept.select(*keys), keys, "left_anti")
