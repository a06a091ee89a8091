"""Targets to effects: windows, motif hits, deletions, scores, summary.

Stages are lazy DataFrames.  Three of them are written, because later stages read them more
than once or because recomputing them is expensive: windows, scores and summary.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from exonloom.operators import annotation as an
from exonloom.operators import location as lo
from exonloom.operators import motifs as mo
from exonloom.operators import perturb as pe
from exonloom.operators import predict as pr
from exonloom.operators import sequences as sq
from exonloom.schemas import SITE_COLUMNS


@dataclass(frozen=True)
class Options:
    """Defaults of a run (fixed values of the original procedure)."""

    full_windows: bool = False
    border: int = 100
    reach: int = 5000
    scope: int = 5000
    skip_splice_regions: bool = False
    batch_size: int = 64
    variable_threshold: float = 0.05
    chunk: int = 4096


def windows(surrounding: DataFrame, genome: DataFrame, options: Options) -> tuple[DataFrame, DataFrame]:
    """(sequences with sites, first or last exons left out)."""
    inner, edge = an.split_edge_exons(surrounding)
    placed = (
        sq.full_windows(inner, options.border) if options.full_windows else sq.fixed_windows(inner, options.reach)
    )
    cols = ["seq_id", "header", "transcript_id", "chrom", "strand", "win_start", "win_end", *SITE_COLUMNS]
    extra = [c for c in ("name", "gene_name", "dpsi") if c in placed.columns]
    distinct = placed.select(*cols, *extra).dropDuplicates(["seq_id"])
    seqs = sq.extract(distinct, genome, options.chunk, start="win_start", end="win_end")
    return seqs.filter(F.col("seq").isNotNull()), edge


def located_hits(seqs: DataFrame, motifs: DataFrame, options: Options) -> DataFrame:
    """Scanned, reduced, density tagged, located and scoped hits."""
    raw = mo.scan_exact(seqs, motifs)
    tagged = mo.tag_density(mo.remove_self_contained(raw))
    located = lo.locate(tagged, seqs)
    scoped = mo.within_scope(located, seqs, options.scope) if options.scope > 0 else located
    return mo.outside_splice_regions(scoped, seqs) if options.skip_splice_regions else scoped


def scores(seqs: DataFrame, hits: DataFrame, scorer, options: Options) -> DataFrame:
    """Scores of references and of every distinct deletion, keyed by ``id``."""
    mutated = pe.deletions(hits.select("seq_id", "start", "end"), seqs)
    everything = pe.with_reference(mutated, seqs)
    return pr.predict(everything, scorer, options.batch_size, "id").withColumnRenamed("seq_id", "id")


def summarise(seqs: DataFrame, hits: DataFrame, scored: DataFrame, options: Options) -> DataFrame:
    """Effects per hit: each distinct deletion is compared once, then joined to its hits."""
    spans = pe.deletion_metadata(hits.select("seq_id", "rbp_name", "motif", "start", "end")).dropDuplicates(["id", "rbp_name"])
    unique = spans.select("id", "seq_id", "type", "start", "end").dropDuplicates(["id"])
    mutants = pr.realign(unique.join(scored, "id"))
    refs = scored.filter(F.col("id").endswith("_REF_seq")).select(
        F.regexp_replace("id", "_REF_seq$", "").alias("seq_id"), "acceptor", "donor"
    )
    effects = pr.effect_summary(mutants, refs, seqs, options.variable_threshold)
    per_hit = spans.select("id", "rbp_name", "mutation", "motif_start", "motif_end").join(effects, "id")
    return pr.attach_hits(per_hit, hits)


def run(
    spark: SparkSession, surrounding: DataFrame, genome: DataFrame, motifs: DataFrame, out: str,
    scorer: pr.Scorer, options: Options = Options(),
) -> DataFrame:
    """The whole run; finished stages under ``out`` are read back instead of recomputed in memory."""
    seqs, edge = windows(surrounding, genome, options)
    seqs.write.mode("overwrite").parquet(f"{out}/sequences")
    edge.write.mode("overwrite").parquet(f"{out}/first_or_last")
    seqs = spark.read.parquet(f"{out}/sequences")
    located_hits(seqs, motifs, options).write.mode("overwrite").parquet(f"{out}/hits")
    hits = spark.read.parquet(f"{out}/hits")
    scores(seqs, hits, scorer, options).write.mode("overwrite").parquet(f"{out}/scores")
    scored = spark.read.parquet(f"{out}/scores")
    summarise(seqs, hits, scored, options).write.mode("overwrite").parquet(f"{out}/summary")
    return spark.read.parquet(f"{out}/summary")


def infer(seqs: DataFrame, sites: DataFrame | None, scorer: pr.Scorer, batch_size: int = 64) -> DataFrame:
    """Stand-alone sequences: scores, and the summary at annotated sites when these are known."""
    scored = pr.predict(seqs, scorer, batch_size)
    return pr.reference_sites(scored) if sites is None else pr.independent_summary(scored, sites)
