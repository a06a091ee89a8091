"""VCF records as DataFrames, their intervals, chromosome naming and annotation."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CONSEQUENCE_FIELDS = ("ANN", "CSQ")
DETAIL_FIELDS = ("STRAND", "Gene", "SYMBOL", "Feature", "HGVSc", "EXON", "INTRON", "VARIANT_CLASS")

# Primary chromosome names with and without the prefix: 1 to 22, X, Y, M and MT.
PRIMARY = [
    p + c for p in ("", "chr") for c in [*(str(i) for i in range(1, 23)), "X", "Y", "M", "MT"]
]

_COLUMNS = ["chrom", "pos", "id", "ref", "alt", "qual", "filter", "info"]


def read_vcf(spark: SparkSession, path: str) -> DataFrame:
    """Eight fixed VCF columns, plus ``rest`` for genotype columns."""
    return parse_vcf(spark.read.text(path))


def parse_vcf(lines: DataFrame) -> DataFrame:
    """``read_vcf`` on rows ``value``; header lines go."""
    fields = F.split("value", "\t")
    out = lines.filter(~F.col("value").startswith("#")).select(
        *[F.get(fields, F.lit(i)).alias(c) for i, c in enumerate(_COLUMNS)],
        F.array_join(F.slice(fields, 9, 1 << 20), "\t").alias("rest"),
    )
    return out.withColumn("pos", F.col("pos").cast("bigint"))


def read_header(spark: SparkSession, path: str) -> list[str]:
    """Header lines; bounded by the file's own header, not by its records."""
    rows = spark.read.text(path).filter(F.col("value").startswith("#")).collect()
    return [r["value"] for r in rows]


def consequence_format(header: Iterable[str]) -> tuple[str, list[str]] | None:
    """The consequence INFO key and its sub-field names, if the header declares one."""
    for line in header:
        for key in CONSEQUENCE_FIELDS:
            if line.startswith(f"##INFO=<ID={key},") and "Format:" in line:
                text = line.split("Format:", 1)[1].rstrip().rstrip(">").rstrip('"')
                return key, [t.strip() for t in text.strip().split("|")]
    return None


def info_value(info: str, key: str):
    return F.nullif(F.regexp_extract(F.col(info), f"(?:^|;){key}=([^;]*)", 1), F.lit(""))


def variant_intervals(
    vcf: DataFrame,
    fields: list[str] | None = None,
    key: str = "CSQ",
    transcript_field: str = "Feature",
) -> DataFrame:
    """Half-open intervals: a deletion spans the reference allele, all else the alternate one.

    ``fields`` are the sub-fields of the consequence annotation; its first entry gives strand
    and, when every detail field exists, gene, transcript and class columns.
    """
    if fields is not None and "STRAND" not in fields:
        raise ValueError("the consequence annotation needs a STRAND field")
    if fields is not None and transcript_field not in fields:
        raise ValueError(f"{transcript_field} is not a consequence field")
    single = F.when(~F.contains(F.col("alt"), F.lit(",")), F.col("alt")).otherwise(
        F.raise_error(
            F.concat(
                F.lit("multi-allelic variant "), "chrom", F.lit(":"), F.col("pos").cast("string"),
                F.lit("; split such records first"),
            )
        ).cast("string")
    )
    base = vcf.withColumn("alt", single)
    deletion = F.length("ref") > F.length("alt")
    span = F.when(deletion, F.length("ref")).otherwise(F.length("alt"))
    out = base.select(
        "chrom",
        (F.col("pos") - 1).alias("start"),
        (F.col("pos") + span - 1).cast("bigint").alias("end"),
        "pos", "id", "ref", "alt",
        *([F.split(F.substring_index(info_value("info", key), ",", 1), r"\|").alias("_a")] if fields else []),
    )
    if not fields:
        return out.withColumns({"score": F.lit("0"), "strand": F.lit("+")})
    pick = lambda name: F.get("_a", F.lit(fields.index(name)))
    strand = F.when(pick("STRAND") == "-1", "-").otherwise("+")
    columns = {"strand": strand, "transcript_id": pick(transcript_field)}
    if all(f in fields for f in DETAIL_FIELDS):
        columns |= {
            "gene_id": pick("Gene"),
            "gene_name": pick("SYMBOL"),
            "hgvsc": pick("HGVSc"),
            "exon_number": pick("EXON"),
            "intron_number": pick("INTRON"),
            "variant_class": pick("VARIANT_CLASS"),
        }
    return out.withColumns(columns).drop("_a")


def gene_intervals(variants: DataFrame, genes: DataFrame) -> DataFrame:
    """Whole-gene intervals of the genes hit; ``genes`` comes from the local annotation."""
    wanted = variants.filter(F.col("gene_id").isNotNull()).select("gene_id").distinct()
    named = genes.withColumn(
        "chrom",
        F.when(F.col("chrom").startswith("chr"), F.col("chrom")).otherwise(
            F.concat(F.lit("chr"), "chrom")
        ),
    )
    return named.filter(F.col("chrom").isin(PRIMARY)).join(wanted, "gene_id", "left_semi")


def fix_chromosome_names(vcf: DataFrame, add: bool = True) -> DataFrame:
    """Add or strip the prefix on primary chromosomes and shorten MT to M."""
    bare = F.regexp_replace(F.regexp_replace("chrom", "^chr", ""), "^MT$", "M")
    fixed = F.concat(F.lit("chr"), bare) if add else bare
    return vcf.withColumn(
        "chrom", F.when(F.col("chrom").isin(PRIMARY), fixed).otherwise(F.col("chrom"))
    )


def fix_contig_lines(header: list[str], add: bool = True) -> list[str]:
    """Contig lines renamed like the records; other header lines are kept."""
    out = []
    for line in header:
        if line.startswith("##contig=<ID="):
            name, rest = line[len("##contig=<ID="):], ""
            for stop in (",", ">"):
                if stop in name:
                    cut = name.index(stop)
                    name, rest = name[:cut], name[cut:] + rest
                    break
            if name in PRIMARY:
                bare = name.removeprefix("chr")
                bare = "M" if bare == "MT" else bare
                name = f"chr{bare}" if add else bare
            line = f"##contig=<ID={name}{rest}"
        out.append(line)
    return out


def needs_prefix(vcf: DataFrame, genome_names: list[str] | None = None) -> bool | None:
    """True to add the prefix, False to strip it, None when the names already agree."""
    primary = vcf.select("chrom").distinct().filter(F.col("chrom").isin(PRIMARY))
    names = {r["chrom"] for r in primary.limit(len(PRIMARY)).collect()}
    if genome_names is None:
        return None if any(n.startswith("chr") for n in names) else True
    genome = {n for n in genome_names if n in PRIMARY}
    if names <= genome:
        return None
    return all(n.startswith("chr") for n in genome)


def annotate_variants(
    vcf: DataFrame,
    values: DataFrame,
    column: str,
    name: str | None = None,
    existing: Iterable[str] = (),
) -> DataFrame:
    """Append ``name=value`` to INFO by exact (chrom, pos, ref, alt); ``.`` where absent.

    Two values for one variant of the VCF fail the job; a name already declared is rejected.
    """
    label = name or column
    if label in set(existing):
        raise ValueError(f"annotation {label} already exists")
    keys = ["chrom", "pos", "ref", "alt"]
    # One row per variant: map-side combined, so repeated variants never reach the join.
    lookup = values.groupBy(*keys).agg(
        F.first(F.col(column)).cast("string").alias("_v"), F.count(F.lit(1)).alias("_n")
    )
    joined = vcf.join(lookup, keys, "left")
    value = F.when(F.col("_n") > 1, F.raise_error(
        F.concat(F.lit("more than one value for "), "chrom", F.lit(":"), F.col("pos").cast("string"))
    ).cast("string")).otherwise(F.coalesce("_v", F.lit(".")))
    entry = F.concat(F.lit(f"{label}="), value)
    info = F.when(F.col("info") == ".", entry).otherwise(F.concat("info", F.lit(";"), entry))
    return joined.withColumn("info", info).select(*vcf.columns)


def info_header_line(name: str, kind: str = "String", number: str = "1", description: str = ".") -> str:
    if kind not in ("Integer", "Float", "Flag", "Character", "String"):
        raise ValueError("unknown INFO type")
    return f'##INFO=<ID={name},Number={number},Type={kind},Description="{description}">'


def vcf_lines(vcf: DataFrame) -> DataFrame:
    body = F.concat_ws("\t", *[F.col(c).cast("string") for c in _COLUMNS])
    tail = F.when(F.coalesce("rest", F.lit("")) != "", F.concat(F.lit("\t"), "rest")).otherwise("")
    return vcf.select(F.concat(body, tail).alias("value"))
