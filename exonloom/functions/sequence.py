"""Column expressions over nucleotide strings; everything stays JVM side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def reverse_complement(seq: Column | str) -> Column:
    return F.reverse(F.translate(_c(seq), "ACGTacgt", "TGCAtgca"))


def gc_percent(seq: Column | str) -> Column:
    """Upper-case G and C as a percentage of the whole length (N counts); empty gives null."""
    s = _c(seq)
    n = F.length(s)
    gc = n - F.length(F.translate(s, "GC", ""))
    return F.when(n > 0, F.round(100.0 * gc / n, 2))


def literal_count(seq: Column | str, motif: Column | str) -> Column:
    """Left-to-right non-overlapping occurrences of a literal string."""
    s, m = _c(seq), _c(motif)
    removed = F.length(s) - F.length(F.replace(s, m, F.lit("")))
    return F.floor(removed / F.length(m)).cast("bigint")


def strip_version(col: Column | str) -> Column:
    return F.substring_index(_c(col), ".", 1)


def interval_parts(col: Column | str) -> Column:
    """``chrom:start-end`` to a struct; unparsable text gives null coordinates."""
    parts = F.split(_c(col), "[:-]")
    return F.struct(
        F.get(parts, F.lit(0)).alias("chrom"),
        F.get(parts, F.lit(1)).try_cast("bigint").alias("start"),
        F.get(parts, F.lit(2)).try_cast("bigint").alias("end"),
    )


def delete_span(seq: Column | str, start: Column | str, end: Column | str) -> Column:
    s, a, b = _c(seq), _c(start).cast("int"), _c(end).cast("int")
    return F.concat(F.substr(s, F.lit(1), a), F.substr(s, b + 1))


def replace_base(seq: Column | str, pos: Column | str, base: Column | str) -> Column:
    s, p = _c(seq), _c(pos).cast("int")
    return F.concat(F.substr(s, F.lit(1), p), _c(base), F.substr(s, p + 2))
