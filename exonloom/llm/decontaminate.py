"""Documents that hold benchmark passages, found by spaced seeds that forgive substituted words.

Rule: a document is contaminated when ``SPAN + 1`` words in a row equal as many words in a row of a
benchmark item but for at most two substitutions.  Items of 8 to 12 words must appear whole, with one
substitution at most; shorter ones are not looked for.

A seed is a hash of some of twelve neighbouring words.  The twelve fall into four blocks of three and a
mask keeps two blocks, so of the six masks one meets no substitution as long as two at most happened:
seeds lose nothing, and the exact check follows around each hit.  Short items have a mask per half.

Documents are read once; a bitmap of fixed size says which of their seeds may be in the benchmark, and
only those go on to the join on the seed, whatever the size of the benchmark.  Equal windows of words
are checked once, so a passage in very many documents costs one check.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from exonloom.llm import tokens
from exonloom.session import cut_lineage

SPAN, BLOCK, LEAST, FORGIVE = 12, 3, 8, 2
WINDOW = SPAN + 2  # a word on each side of the seed
BITS = 27  # of the bitmap: 16 MiB


def masks(n: int) -> list[tuple[int, ...]]:
    """Word positions that the seeds of an item of ``n`` words keep (``n`` at most ``SPAN``)."""
    if n >= SPAN:
        blocks = [tuple(range(i, i + BLOCK)) for i in range(0, SPAN, BLOCK)]
        return [a + b for a, b in combinations(blocks, 2)]
    return [tuple(range(n // 2)), tuple(range(n // 2, n))]


def seeds(words: np.ndarray, length: int) -> np.ndarray:
    """Seed hashes by mask and start, for all starts that have ``length`` words."""
    n = max(len(words) - length + 1, 0)
    out = np.zeros((len(masks(length)), n), np.uint64)
    for row, mask in zip(out, masks(length), strict=True):
        for o in mask:
            row += words[o : o + n] * tokens.odd(o + 64 * length)
        row ^= row >> np.uint64(29)
        row *= tokens.odd(sum(mask) + 4096 * length)
        row ^= row >> np.uint64(32)
    return out


def around(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The ``WINDOW`` words from one before each start; 0 where there is none."""
    padded = np.concatenate((np.zeros(1, np.uint64), words, np.zeros(WINDOW, np.uint64)))
    return padded[at[:, None] + np.arange(WINDOW)]


def _lists(values: np.ndarray, width: int | np.ndarray) -> pa.Array:
    n = len(values) if isinstance(width, int) else len(width)
    ends = np.arange(n + 1) * width if isinstance(width, int) else np.concatenate(([0], np.cumsum(width)))
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.ascontiguousarray(values).reshape(-1).view(np.int64)))


def benchmark_seeds(items: DataFrame, key: str, text: str) -> DataFrame:
    """``(seed, item, n, at, words)`` for every seed of every item; null texts and short items have none."""
    def run(batches):
        for batch in batches:
            data, offsets = tokens.texts(batch.column("t"))
            for i in range(len(batch)):
                w, _ = tokens.words(data, offsets[i : i + 2])
                n = len(w)
                if n < LEAST:
                    continue
                found = seeds(w, min(n, SPAN))
                at = np.tile(np.arange(found.shape[1]), len(found))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(found.reshape(-1).view(np.int64)), pa.array([batch.column("k")[i].as_py()] * len(at), pa.int64()),
                        pa.array(np.full(len(at), n, np.int32)), pa.array(at.astype(np.int32)), _lists(around(w, at), WINDOW),
                    ],
                    names=["seed", "item", "n", "at", "words"],
                )

    rows = items.select(F.col(key).cast("long").alias("k"), F.col(text).cast("binary").alias("t"))
    return rows.mapInArrow(run, "seed long, item long, n int, at int, words array<long>")


def _bitmap(found: DataFrame) -> np.ndarray:
    """Which low bits some seed has; as many bytes for any benchmark."""
    low = F.col("seed").bitwiseAND((1 << BITS) - 1)
    cells = found.select((F.shiftright(low, 6)).alias("cell"), F.expr(f"shiftleft(1L, cast((seed & {(1 << BITS) - 1}) & 63 as int))").alias("bit"))
    rows = cells.groupBy("cell").agg(F.bit_or("bit").alias("bits")).toPandas()
    out = np.zeros(1 << (BITS - 6), np.int64)
    out[rows["cell"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64)
    return out.view(np.uint8)


def _hits(docs: DataFrame, bitmap, lengths: list[int]) -> DataFrame:
    """``(k, window, words, seeds)`` for every start of a document where some seed may be in the benchmark."""
    def run(batches):
        bits = bitmap.value
        for batch in batches:
            data, offsets = tokens.texts(batch.column("t"))
            keys = batch.column("k")
            for i, j in tokens.slices(offsets):
                w, n = tokens.words(data, offsets[i : j + 1])
                ends = np.cumsum(n)
                room = np.repeat(ends, n) - np.arange(len(w))  # words from here to the end of the document
                may, which = [], []
                for length in lengths:
                    for row in seeds(w, length):
                        low = row & np.uint64((1 << BITS) - 1)
                        hit = np.flatnonzero(bits[(low >> np.uint64(3)).astype(np.int64)] >> (low & np.uint64(7)).astype(np.uint8) & 1)
                        hit = hit[room[hit] >= length]
                        may.append(hit)
                        which.append(row[hit])
                at, seed = np.concatenate(may), np.concatenate(which)
                if not len(at):
                    continue
                order = np.argsort(at, kind="stable")
                at, seed = at[order], seed[order]
                at, size = np.unique(at, return_counts=True)
                doc = np.searchsorted(ends, at, "right")
                view = around(w, at)
                place = at[:, None] - 1 + np.arange(WINDOW)
                view[(place < (ends - n)[doc][:, None]) | (place >= ends[doc][:, None])] = 0
                name = tokens.mix(np.arange(WINDOW) + 7777) | np.uint64(1)
                yield pa.RecordBatch.from_arrays(
                    [
                        keys.take(pa.array(doc + i)), pa.array((view * name).sum(axis=1, dtype=np.uint64).view(np.int64)),
                        _lists(view, WINDOW), _lists(seed, size),
                    ],
                    names=["k", "window", "words", "seeds"],
                )

    return docs.mapInArrow(run, "k long, window long, words array<long>, seeds array<long>")


def _fits() -> F.Column:
    """Whether the words around a hit pass the rule; ``w`` is the document's window, ``b`` the item's."""
    same = F.zip_with("w", "b", lambda x, y: F.when((x == y) & (x != 0), 1).otherwise(0))
    equal = lambda a, n: F.aggregate(F.slice(same, a, n), F.lit(0), lambda s, x: s + x)
    full = SPAN + 1
    before = (F.col("w")[0] != 0) & (F.col("b")[0] != 0) & (equal(1, full) >= full - FORGIVE)
    after = (F.col("w")[full] != 0) & (F.col("b")[full] != 0) & (equal(2, full) >= full - FORGIVE)
    return F.when(F.col("n") > SPAN, before | after).otherwise(equal(F.lit(2), F.col("n")) >= F.col("n") - 1)


def leaks(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """``(key, item_id)``, once for every document and benchmark item whose passage it holds.

    Words are runs outside ``\\x20\\x09-\\x0D``, A-Z as a-z.  Keys are integers.  Null or empty texts hold
    nothing; rows with the same key count as one document; null keys keep a row of their own.  Other
    columns are ignored; an empty table on either side gives an empty result.
    """
    spark = docs.sparkSession
    found = cut_lineage(benchmark_seeds(items, item, item_text))
    short = [r["n"] for r in found.filter(F.col("n") < SPAN).select("n").distinct().collect()]  # at most SPAN - LEAST
    bitmap = spark.sparkContext.broadcast(_bitmap(found))
    hits = cut_lineage(
        _hits(docs.select(F.col(key).cast("long").alias("k"), F.col(text).cast("binary").alias("t")), bitmap, [SPAN, *sorted(short)])
    )
    windows = hits.groupBy("window").agg(F.first("words").alias("w"), F.first("seeds").alias("s"))
    met = windows.select("window", "w", F.explode("s").alias("seed")).join(
        found.select("seed", "item", "n", F.col("words").alias("b")), "seed"
    )
    bad = met.filter(_fits()).select("window", "item").distinct()
    return hits.select("k", "window").join(bad, "window").select(F.col("k").alias(key), F.col("item").alias("item_id")).distinct()


def contaminated(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, contaminated, n_items, items`` for every row of ``docs``; see ``leaks``."""
    found = leaks(docs, items, key, text).groupBy(key).agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    rows = docs.select(F.col(key).alias("k"))
    found = found.withColumnRenamed(key, "j")
    out = rows.join(found, F.col("k").eqNullSafe(F.col("j")), "left")
    empty = F.array().cast("array<bigint>")
    return out.select(
        F.col("k").alias(key), F.col("items").isNotNull().alias("contaminated"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"), F.coalesce("items", empty).alias("items"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` less the rows that hold a benchmark passage.

    ``docs`` must be stored (read from files), as rows are numbered by their place in two scans.
    """
    number = tokens.unused(docs.columns, "row_number")
    rows = docs.withColumn(number, F.monotonically_increasing_id())
    gone = leaks(rows.select(number, text), items, number, text).select(number).distinct()
    return rows.join(gone, number, "left_anti").select(*docs.columns)
