"""Motif dictionaries: plain lists, position weight matrices and the databases they come from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from exonloom.schemas import require


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their file and order; motif files are small, so one task reads each file."""
    whole = spark.read.option("wholetext", True).text(path)
    return whole.select(
        F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", r"\r?\n")).alias("no", "line")
    )


def read_motif_list(
    spark: SparkSession, path: str, min_length: int = 5, rna_to_dna: bool = True
) -> DataFrame:
    """``>RBP|n|`` headers followed by ``*M1|M2`` lines; reading a file stops at a ``MOUSE`` line.

    Several files may be read at once; an RBP may have one list in all of them together.
    """
    return parse_motif_list(_lines(spark, path), min_length, rna_to_dna)


def parse_motif_list(lines: DataFrame, min_length: int = 5, rna_to_dna: bool = True) -> DataFrame:
    """``read_motif_list`` on rows ``(file, no, line)``; running values are per file."""
    order = Window.partitionBy("file").orderBy("no")
    stopped = F.max(F.col("line").startswith("MOUSE").cast("int")).over(
        order.rowsBetween(Window.unboundedPreceding, 0)
    )
    header = F.when(
        F.col("line").startswith(">"), F.substring_index(F.substr("line", F.lit(2)), "|", 1)
    )
    named = lines.select(
        "no", "line", stopped.alias("stopped"),
        F.last(header, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("rbp_name"),
    ).filter((F.col("stopped") == 0) & F.col("line").startswith("*"))
    repeats = F.count(F.lit(1)).over(Window.partitionBy("rbp_name"))
    checked = named.withColumn("_n", repeats).withColumn(
        "rbp_name",
        F.when(F.col("_n") == 1, F.col("rbp_name")).otherwise(
            F.raise_error(F.concat(F.lit("repeated RBP name in file: "), "rbp_name")).cast("string")
        ),
    )
    motif = F.explode(F.split(F.substr("line", F.lit(2)), r"\|")).alias("motif")
    out = checked.select("rbp_name", motif)
    if rna_to_dna:
        out = out.withColumn("motif", F.translate("motif", "Uu", "Tt"))
    return out.filter(F.length("motif") >= min_length).distinct()


def read_meme(spark: SparkSession, path: str) -> DataFrame:
    """MEME matrices in long form ``(motif_id, rbp_name, pos, base, p)``; the last one counts too."""
    return parse_meme(_lines(spark, path))


def parse_meme(lines: DataFrame) -> DataFrame:
    """``read_meme`` on rows ``(file, no, line)``; running values are per file."""
    lines = lines.withColumn("line", F.trim("line"))
    order = Window.partitionBy("file").orderBy("no")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    is_motif = F.col("line").startswith("MOTIF")
    token = lambda i: F.when(is_motif, F.get(F.split("line", r"\s+"), F.lit(i)))
    matrix_row = F.col("line").rlike(r"^[0-9]")
    tagged = lines.select(
        "file", "no", "line",
        F.last(token(1), True).over(so_far).alias("motif_id"),
        F.last(token(2), True).over(so_far).alias("rbp_name"),
        F.sum(is_motif.cast("int")).over(so_far).alias("_block"),
    ).filter(matrix_row & (F.col("_block") > 0))
    rows = tagged.withColumn(
        "pos", F.row_number().over(Window.partitionBy("file", "_block").orderBy("no")) - 1
    )
    return pwm_rows(rows, F.split("line", r"\s+"))


def pwm_rows(rows: DataFrame, values) -> DataFrame:
    """Long form from one row per matrix position and an array of four probabilities."""
    return rows.select(
        "motif_id", "rbp_name", F.col("pos").cast("int").alias("pos"),
        F.posexplode(values).alias("_i", "_p"),
    ).select(
        "motif_id", "rbp_name", "pos",
        F.element_at(F.array(*[F.lit(b) for b in "ACGT"]), F.col("_i") + 1).alias("base"),
        F.col("_p").cast("double").alias("p"),
    )


def read_fimo(spark: SparkSession, path: str) -> DataFrame:
    """Hits of an external scanner; the 1-based start becomes 0-based, duplicates are dropped."""
    raw = (
        spark.read.option("sep", "\t").option("header", True).option("comment", "#").csv(path)
    )
    return fimo_hits(raw)


def fimo_hits(raw: DataFrame) -> DataFrame:
    """``read_fimo`` on the scanner's columns."""
    return (
        raw.select(
            F.col("sequence_name").alias("seq_id"),
            F.col("motif_alt_id").alias("rbp_name"),
            F.col("matched_sequence").alias("motif"),
            (F.col("start").cast("bigint") - 1).alias("start"),
            F.col("stop").cast("bigint").alias("end"),
        )
        .dropDuplicates()
    )


def read_hits(spark: SparkSession, path: str) -> DataFrame:
    """Motif hits written by this library (tab separated with a header)."""
    df = spark.read.option("sep", "\t").option("header", True).csv(path)
    require(df, "seq_id", "rbp_name", "start", "end")
    return df.withColumns(
        {"start": F.col("start").cast("bigint"), "end": F.col("end").cast("bigint")}
    )


def motif_ids_from_table(
    table: DataFrame,
    organism_column: str,
    name_column: str,
    id_column: str,
    organism: str = "Homo_sapiens",
) -> DataFrame:
    """Distinct matrix identifiers per RBP of one organism; a lone ``.`` is no identifier."""
    return (
        table.filter((F.col(organism_column) == organism) & (F.col(id_column) != "."))
        .select(F.col(name_column).alias("rbp_name"), F.col(id_column).alias("motif_id"))
        .distinct()
    )


def motif_ids_from_labels(labels: DataFrame, id_column: str, label_column: str) -> DataFrame:
    """Labels such as ``"NAME (1), OTHER (2)"`` to (rbp_name, zero-padded id) rows."""
    names = F.explode(F.split(F.col(label_column), r"\s*,\s*"))
    return labels.select(
        F.lpad(F.trim(F.col(id_column)), 3, "0").alias("motif_id"), names.alias("_label")
    ).select(
        F.trim(F.regexp_replace(F.col("_label"), r"\s*\(\d+\)\s*$|\"", "")).alias("rbp_name"),
        "motif_id",
    ).distinct()


def kmers_from_scored_cells(table: DataFrame, name_column: str, cells_column: str) -> DataFrame:
    """``KMER_logo_score;KMER_logo_score`` cells to distinct (rbp_name, motif) rows."""
    cell = F.explode(F.split(F.col(cells_column), ";"))
    parts = F.split(F.col("_cell"), "_")
    return (
        table.select(F.col(name_column).alias("rbp_name"), cell.alias("_cell"))
        .filter(F.size(parts) == 3)
        .select("rbp_name", F.get(parts, F.lit(0)).alias("motif"))
        .distinct()
    )


def read_matrix_files(spark: SparkSession, path: str) -> DataFrame:
    """One matrix per file (``PO A C G U`` table); the file name gives the identifier."""
    whole = spark.read.option("wholetext", True).text(path).select(
        F.regexp_extract(F.input_file_name(), r"([^/]+)\.[^./]+$", 1).alias("motif_id"),
        F.split("value", r"\r?\n").alias("_lines"),
    )
    rows = (
        whole.select("motif_id", F.explode("_lines").alias("line"))
        .filter(F.trim("line").rlike(r"^\d"))
        .withColumn("f", F.split(F.trim("line"), r"\s+"))
    )
    ordered = rows.withColumn("rbp_name", F.lit(None).cast("string")).withColumn(
        "pos",
        F.row_number().over(
            Window.partitionBy("motif_id").orderBy(F.get("f", F.lit(0)).cast("int"))
        )
        - 1,
    )
    return pwm_rows(ordered, F.slice("f", 2, 4))


def matrix_database(matrices: DataFrame, ids: DataFrame) -> DataFrame:
    """Matrices joined to the RBPs they belong to."""
    return matrices.drop("rbp_name").join(ids, "motif_id").select(
        "motif_id", "rbp_name", "pos", "base", "p"
    )


# Length of a MEME header and the alphabet line (fixed format).
MEME_HEADER = (
    "MEME version 4\n\nALPHABET= ACGT\n\nstrands: + -\n\n"
    "Background letter frequencies\nA 0.25 C 0.25 G 0.25 T 0.25\n"
)


def meme_records(matrices: DataFrame) -> DataFrame:
    """One MEME text block per matrix, ready for ``write.text`` after the header."""
    row = matrices.groupBy("motif_id", "rbp_name", "pos").agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("base", "p"))),
                lambda x: x["p"].cast("string"),
            ),
            "\t",
        ).alias("line")
    )
    return row.groupBy("motif_id", "rbp_name").agg(
        F.concat(
            F.lit("MOTIF "), F.col("motif_id"), F.lit(" "), F.col("rbp_name"),
            F.lit("\n\nletter-probability matrix: alength= 4 w= "),
            F.count(F.lit(1)).cast("string"), F.lit("\n"),
            F.array_join(
                F.transform(
                    F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]
                ),
                "\n",
            ),
            F.lit("\n"),
        ).alias("value")
    )


def resolve_subset(
    motifs: DataFrame, subset: list[str] | str | None, named_sets: dict[str, list[str]] | None = None
) -> DataFrame:
    """Keep the RBPs of ``subset``: a list, the name of a set, or a file of names.

    Names without motifs are simply absent from the result (see ``missing_names``); an unknown
    set name and an empty result are errors.
    """
    if subset is None:
        return motifs
    spark = motifs.sparkSession
    if isinstance(subset, str):
        if named_sets and subset in named_sets:
            wanted = spark.createDataFrame([(n,) for n in named_sets[subset]], "rbp_name string")
        elif "/" in subset or "." in subset:
            wanted = spark.read.text(subset).select(F.trim("value").alias("rbp_name"))
        else:
            raise KeyError(f"unknown RBP set {subset!r}; known: {sorted(named_sets or {})}")
    else:
        wanted = spark.createDataFrame([(n,) for n in subset], "rbp_name string")
    kept = motifs.join(wanted, "rbp_name", "left_semi")
    if kept.isEmpty():
        raise ValueError("none of the requested RBPs has motifs")
    return kept


def missing_names(motifs: DataFrame, wanted: list[str]) -> DataFrame:
    names = motifs.sparkSession.createDataFrame([(n,) for n in wanted], "rbp_name string")
    return names.join(motifs, "rbp_name", "left_anti")
