"""Lines that many documents share, dropped by means of levelled sorted runs of line hashes.

The runs hold every shared line once, with the document that keeps it.  Documents are taken in
batches from the largest key down; a batch anti-joins its shared lines with the runs, so what is
left is met for the first time and stays in its largest document, and becomes a new run.  Runs of a
level are merged into one of the next when there are ``fanout`` of them, as in a log-structured
merge tree, so a line hash is rewritten a logarithmic number of times.

DataFrame functions only.  A line is known by 96 hash bits.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from exonloom.llm.tokens import unused
from exonloom.session import cut_lineage

SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def fold(text: Column) -> Column:
    """A-Z as a-z and no other letter changed; texts of single bytes take the short way."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def line_key(line: Column) -> Column:
    return fold(F.btrim(line, F.lit(SPACE)))


def lines_of(text: str) -> Column:
    return F.split(F.coalesce(F.col(text), F.lit("")), "\n")


def keyed_lines(rows: DataFrame, row: str, key: str, text: str, min_chars: int) -> DataFrame:
    """``(h1, h2, row, pos, k)``: every line whose key has ``min_chars`` code points; ``row`` names the row number."""
    lines = rows.select(F.col(row).alias("row"), F.col(key).alias("k"), F.posexplode(lines_of(text)).alias("pos", "line"))
    keyed = lines.select("row", "pos", "k", line_key(F.col("line")).alias("key")).filter(F.char_length("key") >= min_chars)
    return keyed.select(F.xxhash64("key").alias("h1"), F.hash("key").alias("h2"), "row", "pos", "k")


class Runs:
    """Sorted runs in levels: ``levels[i]`` holds fewer than ``fanout`` runs."""

    def __init__(self, fanout: int):
        self.fanout, self.levels = fanout, []

    def __iter__(self):
        return (run for level in self.levels for run in level)

    def all(self) -> DataFrame | None:
        runs = list(self)
        return reduce(DataFrame.unionByName, runs) if runs else None

    def unseen(self, batch: DataFrame) -> DataFrame:
        """The rows of ``batch`` whose hashes no run holds, one merge per run."""
        for run in self:
            batch = batch.join(run, ["h1", "h2"], "left_anti")
        return batch

    def add(self, run: DataFrame, level: int = 0) -> None:
        """Store one more run; a full level is merged into one run of the next."""
        stored = cut_lineage(run.sortWithinPartitions("h1", "h2"))
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(stored)
        if len(self.levels[level]) == self.fanout:
            full, self.levels[level] = self.levels[level], []
            self.add(reduce(DataFrame.unionByName, full).repartition("h1", "h2"), level + 1)


def keepers(shared: DataFrame, batches: int, fanout: int) -> DataFrame:
    """``(h1, h2, keeper)``: the largest key that holds each shared line; null keys lose to all others."""
    cuts = shared.agg(F.percentile_approx("k", [i / batches for i in range(1, batches)], 1000)).first()[0] or []
    bounds = sorted(set(cuts), reverse=True)
    runs = Runs(fanout)
    for i in range(len(bounds) + 1):
        part = F.lit(True) if not bounds else (
            F.col("k") > bounds[0] if i == 0
            else (F.col("k") <= bounds[i - 1]) & (F.col("k") > bounds[i]) if i < len(bounds)
            else (F.col("k") <= bounds[-1]) | F.col("k").isNull()
        )
        runs.add(runs.unseen(shared.filter(part).groupBy("h1", "h2").agg(F.max("k").alias("keeper"))))
    return runs.all()


def dedup_lines(
    docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = 20, min_docs: int = 3,
    batches: int = 4, fanout: int = 2,
) -> DataFrame:
    """``docs`` with ``text`` less its shared lines, and ``n_lines`` (before) and ``n_dropped`` after its columns.

    Lines whose key (stripped of white space, A-Z lower-cased) has at least ``min_chars`` code points and
    is found in at least ``min_docs`` rows go from all rows but those with the largest ``key`` holding it.
    Null or empty texts are one empty line and come out empty.  Rows with a null key lose to rows with
    one; where all keys are null, all keep the line.  ``docs`` must be stored (read from files), as rows
    are numbered by their place in two scans.  Other columns stay as they are; columns that have the
    name of a count are replaced by it.
    """
    row, lost, parts = (unused(docs.columns, c) for c in ("row_number", "lost_lines", "all_lines"))
    rows = docs.withColumn(row, F.monotonically_increasing_id())
    found = cut_lineage(keyed_lines(rows, row, key, text, min_chars))
    often = found.groupBy("h1", "h2").agg(
        F.count("*").alias("n"), F.min("row").alias("a"), F.max("row").alias("b")
    ).filter((F.col("n") >= min_docs) & ((F.col("b") > F.col("a")) | F.lit(min_docs < 2))).select("h1", "h2")
    often = cut_lineage(found.join(cut_lineage(often), ["h1", "h2"]))  # stored keys: a hot one can be split in the join
    in_rows = often.groupBy("h1", "h2", "row").agg(F.max("k").alias("k"))
    enough = in_rows.groupBy("h1", "h2").agg(F.count("*").alias("n")).filter(F.col("n") >= min_docs).select("h1", "h2")
    shared = cut_lineage(often.join(cut_lineage(enough), ["h1", "h2"]))
    kept = keepers(shared, batches, fanout)
    lose = F.col("keeper").isNotNull() & (F.col("k").isNull() | (F.col("k") < F.col("keeper")))
    gone = shared.join(kept, ["h1", "h2"]).filter(lose).groupBy("row").agg(F.collect_list("pos").alias(lost))
    joined = rows.join(gone.withColumnRenamed("row", row), row, "left").withColumn(parts, lines_of(text))
    size = F.size(parts)
    stay = F.array_except(F.sequence(F.lit(0), size - 1), F.col(lost))
    picked = F.array_join(F.transform(stay, lambda i: F.col(parts)[i]), "\n")
    return joined.select(
        *[
            F.when(F.col(lost).isNull(), F.coalesce(F.col(text), F.lit(""))).otherwise(picked).alias(text) if c == text else F.col(c)
            for c in docs.columns if c not in ("n_lines", "n_dropped")
        ],
        size.cast("long").alias("n_lines"),
        F.coalesce(F.size(lost), F.lit(0)).cast("long").alias("n_dropped"),
    )
