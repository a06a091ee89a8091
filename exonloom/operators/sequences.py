"""Extraction from a chunked genome, splice-site indexes and input windows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from exonloom.functions.sequence import literal_count, reverse_complement
from exonloom.schemas import SITE_COLUMNS


def extract(
    intervals: DataFrame,
    genome: DataFrame,
    chunk: int,
    slack: int = 0,
    one_based: bool = False,
    start: str = "start",
    end: str = "end",
    check_chrom: bool = True,
    out: str = "seq",
) -> DataFrame:
    """Add the strand-oriented sequence of every interval.

    Identical coordinates are fetched once.  An interval meets its chunks by an equi join on
    (chrom, chunk_no), so a busy chromosome is spread over its chunks.  Windows outside the
    chromosome and windows of N only are null; an unknown chromosome fails the job.
    """
    left = (F.col(start) - F.lit(slack + (1 if one_based else 0))).cast("bigint")
    right = (F.col(end) + F.lit(slack)).cast("bigint")
    placed = intervals.withColumns({"_from": left, "_to": right})
    wanted = placed.select("chrom", "_from", "_to").distinct()
    if check_chrom:
        names = genome.select("chrom", F.lit(True).alias("_known")).filter("chunk_no = 0")
        wanted = (
            wanted.join(names, "chrom", "left")
            .withColumn(
                "chrom",
                F.when(F.col("_known"), F.col("chrom")).otherwise(
                    F.raise_error(F.concat(F.lit("chromosome not in the genome: "), "chrom")).cast("string")
                ),
            )
            .drop("_known")
        )
    inside = wanted.filter((F.col("_from") >= 0) & (F.col("_to") > F.col("_from")))
    spread = inside.withColumn(
        "chunk_no",
        F.explode(
            F.sequence(
                F.floor(F.col("_from") / F.lit(chunk)).cast("bigint"),
                F.floor((F.col("_to") - 1) / F.lit(chunk)).cast("bigint"),
            )
        ),
    )
    origin = F.col("chunk_no") * F.lit(chunk)
    a = F.greatest(F.col("_from") - origin, F.lit(0)).cast("int")
    b = F.least(F.col("_to") - origin, F.lit(chunk)).cast("int")
    pieces = spread.join(genome.select("chrom", "chunk_no", "bases"), ["chrom", "chunk_no"]).select(
        "chrom", "_from", "_to", "chunk_no", F.substr("bases", a + 1, b - a).alias("_piece")
    )
    joined = pieces.groupBy("chrom", "_from", "_to").agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("chunk_no", "_piece"))), lambda x: x["_piece"]
            ),
            "",
        ).alias("_bases")
    )
    whole = (F.length("_bases") == F.col("_to") - F.col("_from")) & (
        F.translate("_bases", "N", "") != ""
    )
    oriented = F.when(F.col("strand") == "-", reverse_complement("_bases")).otherwise(F.col("_bases"))
    return (
        placed.join(joined, ["chrom", "_from", "_to"], "left")
        .withColumn(out, F.when(whole, oriented))
        .drop("_from", "_to", "_bases")
    )


def extend_existing(
    df: DataFrame, genome: DataFrame, chunk: int, slack: int, seq: str = "seq"
) -> DataFrame:
    """Flank an existing (possibly mutated) sequence with ``slack`` genomic bases on each side."""
    lefts = extract(
        df.withColumns({"_ls": F.col("start") - slack, "_le": F.col("start")}),
        genome, chunk, start="_ls", end="_le", out="_left",
    )
    both = extract(
        lefts.withColumns({"_rs": F.col("end"), "_re": F.col("end") + slack}),
        genome, chunk, start="_rs", end="_re", out="_right",
    )
    minus = F.col("strand") == "-"
    flanked = F.when(minus, F.concat("_right", seq, "_left")).otherwise(
        F.concat("_left", seq, "_right")
    )
    return both.withColumn(seq, flanked).drop("_ls", "_le", "_rs", "_re", "_left", "_right")


def site_index(
    df: DataFrame, origin: str, limit: str, level: int = 2, fixed_window: bool = False
) -> DataFrame:
    """The six splice-site positions of a target exon in its strand-oriented window.

    Acceptors are first exonic bases, donors last exonic bases.  With ``fixed_window``,
    coordinates outside ``[origin, limit]`` are unknown.  Below level 2 only the target is
    known.  Targets must be exons.
    """
    o, e = F.col(origin), F.col(limit)

    def seen(c):
        col = F.col(c)
        return F.when((col >= o) & (col <= e), col) if fixed_window else col

    plus = F.col("strand") == "+"

    def acceptor(s, t):
        return F.when(plus, seen(s) - o).otherwise(e - seen(t)).cast("bigint")

    def donor(s, t):
        return (F.when(plus, seen(t) - o).otherwise(e - seen(s)) - 1).cast("bigint")

    if "feature" in df.columns:
        df = df.withColumn(
            "feature",
            F.when(F.col("feature") == "exon", F.col("feature")).otherwise(
                F.raise_error(F.lit("splice-site indexes need exon targets")).cast("string")
            ),
        )
    sides = [("start_upstream_2", "end_upstream_2"), ("start", "end"), ("start_downstream_2", "end_downstream_2")]
    values = []
    for i, (s, t) in enumerate(sides):
        known = level == 2 or i == 1
        values += [acceptor(s, t) if known else F.lit(None).cast("bigint"),
                   donor(s, t) if known else F.lit(None).cast("bigint")]
    return df.withColumns(dict(zip(SITE_COLUMNS, values)))


def window_header(start: str, end: str):
    return F.concat(
        F.col("chrom"), F.lit(":"), (F.col(start) + 1).cast("string"), F.lit("-"),
        F.col(end).cast("string"), F.lit("("), F.col("strand"), F.lit(")"),
    )


def full_windows(neighbours: DataFrame, border: int = 0, level: int = 2) -> DataFrame:
    """From the outermost upstream to the outermost downstream neighbour, plus a border."""
    minus = F.col("strand") == "-"
    if level == 0:
        s, e = F.col("start"), F.col("end")
    else:
        up, down = f"upstream_{level}", f"downstream_{level}"
        s = F.when(minus, F.col(f"start_{down}")).otherwise(F.col(f"start_{up}"))
        e = F.when(minus, F.col(f"end_{up}")).otherwise(F.col(f"end_{down}"))
    placed = neighbours.withColumns({"win_start": s - border, "win_end": e + border})
    return _windows(site_index(placed, "win_start", "win_end", level))


def fixed_windows(neighbours: DataFrame, reach: int = 5000, level: int = 2) -> DataFrame:
    """A window of ``reach`` bases on each side of the target exon."""
    placed = neighbours.withColumns(
        {"win_start": F.col("start") - reach, "win_end": F.col("end") + reach}
    )
    return _windows(site_index(placed, "win_start", "win_end", level, fixed_window=True))


def _windows(df: DataFrame) -> DataFrame:
    header = window_header("win_start", "win_end")
    return df.withColumns(
        {"header": header, "seq_id": F.concat_ws("_", header, "transcript_id")}
    )


def trim_to_triplet(df: DataFrame, seq: str = "seq", out: str = "triplet") -> DataFrame:
    """From the first acceptor to the last donor; unknown ends fall back to the sequence ends."""
    s = F.coalesce(F.col("start_exon_upstream"), F.lit(0))
    e = F.coalesce(F.col("end_exon_downstream") + 1, F.length(seq))
    return df.withColumn(out, F.substr(seq, (s + 1).cast("int"), F.greatest(e - s, F.lit(0)).cast("int")))


def kmer_frequencies(df: DataFrame, kmers: Sequence[str], seq: str = "seq") -> DataFrame:
    """Non-overlapping count of each k-mer over the sequence length, five decimals, as columns."""
    n = F.length(seq)
    return df.select(
        *[c for c in df.columns if c != seq],
        *[
            F.when(n > 0, F.round(literal_count(seq, F.lit(k)) / n, 5)).alias(k)
            for k in kmers
        ],
    )


#: Bases whose k-mers are counted at once.
KMER_BASES = 1 << 18


def kmer_counts(texts: Sequence[str], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(text, kmer, n)``: the k-mers over A, C, G and T of each text, without overlap from left to right."""
    code = np.full(256, -1, np.int8)
    code[[65, 67, 71, 84]] = [0, 1, 2, 3]
    # texts are parted by a letter that is in no k-mer
    bases = code[np.frombuffer("-".join([*texts, ""]).encode("ascii", "replace"), np.uint8)]
    size = max(len(bases) - k + 1, 0)
    words = np.zeros(size, np.int64)
    bad = np.concatenate([[0], np.cumsum(bases < 0)])
    for i in range(k):
        words = words * 4 + bases[i : i + size]
    at = np.flatnonzero(bad[k : k + size] == bad[:size])
    ends = np.cumsum([len(t) + 1 for t in texts])
    keys = (np.searchsorted(ends, at, "right") << (2 * k)) + words[at]
    found, n = np.unique(keys, return_counts=True)
    # k-mers that overlap themselves are counted again, one by one
    full = np.full(size, -1, np.int64)
    full[at] = keys
    near = np.zeros(size, bool)
    for i in range(1, min(k, size)):
        near[i:] |= (full[i:] == full[:-i]) & (full[i:] >= 0)
    again = np.unique(full[near])
    if len(again):
        place = np.minimum(np.searchsorted(again, keys), len(again) - 1)
        own = again[place] == keys
        free, left = np.zeros(len(again), np.int64), np.zeros(len(again), np.int64)
        for which, where in zip(place[own].tolist(), at[own].tolist()):
            if where >= free[which]:
                free[which] = where + k
                left[which] += 1
        n[np.searchsorted(found, again)] = left
    return found >> (2 * k), found & ((1 << (2 * k)) - 1), n


def kmer_names(kinds: np.ndarray, k: int) -> pa.Array:
    """The k-mers of these numbers as texts."""
    letters = np.frombuffer(b"ACGT", np.uint8)[(kinds[:, None] >> (2 * np.arange(k - 1, -1, -1))) & 3]
    return pa.StringArray.from_buffers(len(kinds), pa.py_buffer((np.arange(len(kinds) + 1) * k).astype(np.int32)), pa.py_buffer(letters.astype(np.uint8).tobytes()))


def kmer_table(df: DataFrame, k: int = 6, seq: str = "seq") -> DataFrame:
    """``n`` and ``frequency`` of every k-mer over A, C, G and T that a sequence holds, in long form.

    Occurrences of a k-mer are counted left to right without overlap; the frequency is over the sequence length,
    five decimals.  One pass over each sequence counts all k-mers; ``kmer_matrix`` gives columns.
    """
    keep = [c for c in df.columns if c != seq]
    schema = T.StructType(
        [*[df.schema[c] for c in keep], T.StructField("kmer", T.StringType()), T.StructField("n", T.LongType()), T.StructField("_length", T.LongType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(seq).to_pylist()]
            at = 0
            while at < len(texts):  # about ``KMER_BASES`` at once; a longer text by itself
                stop, size = at + 1, len(texts[at])
                while stop < len(texts) and size + len(texts[stop]) <= KMER_BASES:
                    size, stop = size + len(texts[stop]), stop + 1
                where, kinds, n = kmer_counts(texts[at:stop], k)
                own = [batch.column(c).take(pa.array(where + at)) for c in keep]
                lengths = np.array([len(t) for t in texts[at:stop]], np.int64)[where]
                yield pa.RecordBatch.from_arrays([*own, kmer_names(kinds, k), pa.array(n), pa.array(lengths)], names=[*keep, "kmer", "n", "_length"])
                at = stop

    counted = df.select(*keep, seq).mapInArrow(run, schema)
    return counted.select(*keep, "kmer", "n", F.round(F.col("n") / F.col("_length"), 5).alias("frequency"))


def kmer_matrix(table: DataFrame, row: str, k: int = 6) -> DataFrame:
    """All ``4 ** k`` frequencies of each row as columns; ``k`` is at most 6, as columns are few."""
    if k > 6:
        raise ValueError("more than 4,096 columns; stay in long form")
    names = ["".join(x) for x in product("ACGT", repeat=k)]
    return table.groupBy(row).pivot("kmer", names).agg(F.first("frequency")).na.fill(0.0, names)
