"""Frames derived from the given tables, once as DataFrames and once as SQL for the oracle.

A query is registered with ``@query(name, sql)``; the SQL is an independent statement of the
same result over the same tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from exonloom.session import spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def with_ctes(*parts: str, body: str) -> str:
    """``with recursive-free`` CTE list; a part is ``name as (...)``."""
    return "with " + ",\n".join(p.strip() for p in parts) + "\n" + body


# ---------------------------------------------------------------- nucleotide sequences

# Letters to bases; every other character is dropped (fixed mapping of the test sequences).
ALPHABET = "abcdefghijklmnopqrstuvwxyz"
BASES = "ACGTACGTACGTACGTACGTACGTAC"


def dna(text: str):
    return F.regexp_replace(F.translate(F.lower(text), ALPHABET, BASES), "[^ACGT]", "")


def dna_sql(text: str) -> str:
    return f"regexp_replace(translate(lower({text}), '{ALPHABET}', '{BASES}'), '[^ACGT]', '', 'g')"


def sequences(spark, folder) -> DataFrame:
    rows = table(spark, folder, "documents").select("doc_id", "text")
    return spread(rows, spark.sparkContext.defaultParallelism).select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("seq_id"), dna("text").alias("seq")
    )


SEQS = f"seqs as (select 'd' || doc_id as seq_id, {dna_sql('text')} as seq from documents)"


# Motifs of the test dictionary: partly overlapping, one inside another (fixed values).
MOTIFS = {
    "RBA": ["ACGTA", "GTACG"],
    "RBB": ["AAAAA", "AAAAAAA"],
    "RBC": ["CATAT", "ACATATA"],
    "RBD": ["TTTTT", "AACAC"],
    "RBE": ["GCGCGCGC"],
}
RBPS = list(MOTIFS)
MOTIF_FEATURES = [f"{r}_{m}" for r, ms in MOTIFS.items() for m in ms]


def motif_table(spark) -> DataFrame:
    return spark.createDataFrame(
        [(r, m) for r, ms in MOTIFS.items() for m in ms], "rbp_name string, motif string"
    )


MOTIFS_CTE = "motifs(rbp_name, motif) as (values " + ", ".join(
    f"('{r}', '{m}')" for r, ms in MOTIFS.items() for m in ms
) + ")"

HITS = """
pieces as (
  select seq_id, rbp_name, motif, unnest(string_split(seq, motif)) as piece,
         generate_subscripts(string_split(seq, motif), 1) as i
  from seqs, motifs),
ends as (
  select seq_id, rbp_name, motif, i,
         count(*) over (partition by seq_id, rbp_name, motif) as n,
         sum(length(piece) + length(motif)) over (partition by seq_id, rbp_name, motif order by i) as upto
  from pieces),
hits as (
  select seq_id, rbp_name, motif, cast(upto - length(motif) as bigint) as "start", cast(upto as bigint) as "end"
  from ends where i < n)
"""

# Splice sites of a test sequence: fractions of its length, absent for some (fixed rule).
_SITE_RULE = {
    "start_exon_upstream": ("len * 1 // 10", "mod(num, 7) <> 0"),
    "end_exon_upstream": ("len * 2 // 10", "mod(num, 7) <> 0"),
    "start_exon_cassette": ("len * 4 // 10", None),
    "end_exon_cassette": ("len * 6 // 10", None),
    "start_exon_downstream": ("len * 8 // 10", "mod(num, 5) <> 0"),
    "end_exon_downstream": ("len * 9 // 10", "mod(num, 5) <> 0"),
}

SITES = "sites as (select seq_id, cast(length(seq) as bigint) as len_seq, " + ", ".join(
    (f"cast({e} as bigint)" if test is None else f"case when {test} then cast({e} as bigint) end") + f" as {c}"
    for c, (e, test) in _SITE_RULE.items()
) + " from (select *, length(seq) as len, cast(substr(seq_id, 2) as bigint) as num from seqs))"


def sites(seqs: DataFrame) -> DataFrame:
    """The same rule on any frame with ``seq_id`` (one letter and a number) and ``seq``."""
    base = seqs.select("seq_id", F.length("seq").cast("bigint").alias("len"),
                       F.substr("seq_id", F.lit(2)).cast("bigint").alias("num"))
    cols = []
    for c, (e, test) in _SITE_RULE.items():
        value = f"cast({e.replace('//', 'div')} as bigint)"
        cols.append(F.expr(value if test is None else f"case when {test} then {value} end").alias(c))
    return base.select("seq_id", F.col("len").alias("len_seq"), *cols)


def hits(spark, folder) -> DataFrame:
    from exonloom.operators.motifs import scan_exact

    return scan_exact(sequences(spark, folder), motif_table(spark))


# ---------------------------------------------------------------- gene models

def exons(spark, folder) -> DataFrame:
    """Exons from order lines: five orders make a gene, an order is a transcript."""
    line = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    one = line.groupBy("l_orderkey", "l_linenumber").agg(
        F.min("l_partkey").alias("p"), F.max("l_quantity").alias("q")
    )
    gene = F.floor(F.col("l_orderkey") / F.lit(5)).cast("bigint")
    start = gene * 10000 + F.col("l_linenumber") * 1000 + F.col("p") % 300
    return one.select(
        F.concat(F.lit("t"), F.col("l_orderkey").cast("string")).alias("transcript_id"),
        F.concat(F.lit("g"), gene.cast("string")).alias("gene_id"),
        F.concat(F.lit("chr"), (gene % 22 + 1).cast("string")).alias("chrom"),
        F.when(gene % 2 == 0, "+").otherwise("-").alias("strand"),
        start.alias("start"),
        (start + 50 + (F.col("q") * 5).cast("bigint")).alias("end"),
    )


EXONS = """
exons as (
  select 't' || l_orderkey as transcript_id, 'g' || (l_orderkey // 5) as gene_id,
         'chr' || ((l_orderkey // 5) % 22 + 1) as chrom,
         case when (l_orderkey // 5) % 2 = 0 then '+' else '-' end as strand,
         (l_orderkey // 5) * 10000 + l_linenumber * 1000 + min(l_partkey) % 300 as "start",
         (l_orderkey // 5) * 10000 + l_linenumber * 1000 + min(l_partkey) % 300 + 50
           + cast(max(l_quantity) * 5 as bigint) as "end"
  from lineitem group by l_orderkey, l_linenumber)
"""

# Tag text per order priority (fixed rule of the test annotation).
TAGS = {
    "1-URGENT": "MANE_Select;CCDS",
    "2-HIGH": "CCDS;basic",
    "3-MEDIUM": "appris_principal_1;not_a_weighted_tag",
    "5-LOW": "basic",
}


def transcripts(spark, folder) -> DataFrame:
    spans = exons(spark, folder).groupBy("transcript_id", "gene_id", "chrom", "strand").agg(
        F.min("start").alias("start"), F.max("end").alias("end")
    )
    tag = None
    for priority, text in TAGS.items():
        test = F.col("o_orderpriority") == priority
        tag = F.when(test, text) if tag is None else tag.when(test, text)
    attrs = table(spark, folder, "orders").select(
        F.concat(F.lit("t"), F.col("o_orderkey").cast("string")).alias("transcript_id"),
        tag.alias("tag"), F.col("o_orderstatus").alias("transcript_type"),
        F.concat(F.lit("c"), (F.col("o_custkey") % 4).cast("string")).alias("gene_type"),
    )
    return spans.join(attrs, "transcript_id")


TRANSCRIPTS = """
transcripts as (
  select s.*, o.tag, o.transcript_type, o.gene_type from (
    select transcript_id, gene_id, chrom, strand, min("start") as "start", max("end") as "end"
    from exons group by all) s
  join (select 't' || o_orderkey as transcript_id,
               case o_orderpriority """ + " ".join(f"when '{k}' then '{v}'" for k, v in TAGS.items()) + """ end as tag,
               o_orderstatus as transcript_type, 'c' || (o_custkey % 4) as gene_type from orders) o
  on s.transcript_id = o.transcript_id)
"""

INTRONS = """
introns as (
  select transcript_id, gene_id, chrom, strand, e as "start", s2 as "end" from (
    select *, max("end") over (partition by transcript_id order by "start", "end"
                               rows between unbounded preceding and current row) as e,
           lead("start") over (partition by transcript_id order by "start", "end") as s2
    from exons) where s2 > e)
"""

FEATURES = """
features as (
  select *, row_number() over (partition by transcript_id, feature order by
           case when strand = '-' then -"start" else "start" end,
           case when strand = '-' then -"end" else "end" end) as number
  from (select transcript_id, gene_id, chrom, strand, "start", "end", 'exon' as feature from exons
        union all
        select transcript_id, gene_id, chrom, strand, "start", "end", 'intron' from introns))
"""


# ---------------------------------------------------------------- plain intervals

def event_intervals(spark, folder, modulo: int | None = None) -> DataFrame:
    """Events as intervals of length ``floor(value) + 1`` every ten bases, per user."""
    e = table(spark, folder, "events")
    user = F.col("user_id") if modulo is None else F.col("user_id") % modulo
    return e.select(
        user.alias("c"), F.col("event_id").alias("id"), F.col("event_type").alias("kind"),
        (F.col("event_id") * 10).alias("start"),
        (F.col("event_id") * 10 + F.floor("value") + 1).alias("end"),
    )


def ivals(modulo: int | None = None) -> str:
    user = "user_id" if modulo is None else f"user_id % {modulo}"
    return f"""
iv as (select {user} as c, event_id as id, event_type as kind, event_id * 10 as "start",
       event_id * 10 + cast(floor(value) as bigint) + 1 as "end" from events)
"""
