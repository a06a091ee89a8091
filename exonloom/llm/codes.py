"""Product codes of vectors by Lloyd's rounds in whole numbers, comparing moved entries only.

A vector is cut into equal parts; each part position has a codebook of at most 256 entries.  A round assigns every
part to the nearest entry of its codebook and then moves each entry to the mean of its parts.  A part keeps its entry
and the exact distance to it.  When that entry stood still in the last move, all other entries that stood still are no
nearer than before, so only the moved ones are compared with the stored distance; a part whose entry moved compares
all.  Distances are whole numbers, so both ways give one result, ties going to the lower index.

The rows are stored with their entries and distances after every round; sums per entry are made in the tasks and added
by Spark.  The driver holds the codebooks only, which the parameters and the dimension bound.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from exonloom.session import cut_lineage

SCALE = 1024
#: Rows of a batch worked on at once, so that their distances to a codebook fit the cache.
ROWS = 4096
SUMS = "part int, entry int, pos int, n bigint, total bigint"


def whole(vectors: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """``(k, label, v)`` with ``v`` the components times 1,024, rounded down; unusable vectors left out.

    A vector is left out when it is null or holds null or non-finite components.
    """
    x = F.col(vector).cast("array<double>")
    sound = F.col(vector).isNotNull() & F.forall(x, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.lit(False)))
    return vectors.filter(sound).select(
        F.col(key).alias("k"), F.col(label).alias("label"), F.transform(x, lambda c: F.floor(c * F.lit(float(SCALE)))).alias("v")
    )


def distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows ``x`` to ``entries``, both of whole numbers."""
    largest = max(int(np.abs(x).max(initial=0)), int(np.abs(entries).max(initial=0)))
    if x.shape[1] * (2 * largest) ** 2 < 1 << 53:  # then every sum below is a whole number that a float holds
        a, b = x.astype(np.float64), entries.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    if x.shape[1] * (2 * largest) ** 2 >= 1 << 63:
        raise OverflowError("squared distances of these vectors do not fit a long")
    out = np.zeros((len(x), len(entries)), np.int64)
    for i in range(x.shape[1]):
        out += (x[:, i, None] - entries[None, :, i]) ** 2
    return out


def assign(
    x: np.ndarray, entries: np.ndarray, moved: np.ndarray | None = None, code: np.ndarray | None = None, far: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry of each row and its squared distance; of equal ones the lowest.

    ``moved`` marks the entries that changed since ``code`` and ``far`` were found; without them all are compared.
    """
    if code is None:
        d = distances(x, entries)
        best = d.argmin(1)
        return best.astype(np.int32), d[np.arange(len(x)), best]
    code, far = code.copy(), far.copy()
    again = moved[code]
    if again.any():
        code[again], far[again] = assign(x[again], entries)
    still = np.flatnonzero(~again)
    which = np.flatnonzero(moved)
    if len(still) and len(which):
        d = distances(x[still], entries[which])
        at = d.argmin(1)
        d, at = d[np.arange(len(still)), at], which[at]
        nearer = (d < far[still]) | ((d == far[still]) & (at < code[still]))
        code[still[nearer]], far[still[nearer]] = at[nearer], d[nearer]
    return code, far


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def lists(values: np.ndarray) -> pa.Array:
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(np.ascontiguousarray(values).reshape(-1)))


def step(rows: DataFrame, books: np.ndarray, moved: np.ndarray | None) -> DataFrame:
    """``rows`` with every part assigned to ``books`` (part, entry, position)."""
    parts, _, width = books.shape
    sent = rows.sparkSession.sparkContext.broadcast((books, moved))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries, changed = sent.value
        for whole_batch in batches:
            for i in range(0, len(whole_batch), ROWS):
                batch = whole_batch.slice(i, ROWS)
                x = matrix(batch.column("v"), parts * width)
                known = changed is not None
                old = (matrix(batch.column("code"), parts), matrix(batch.column("far"), parts)) if known else None
                made = [
                    assign(x[:, p * width : (p + 1) * width], entries[p], *((changed[p], old[0][:, p], old[1][:, p]) if known else ()))
                    for p in range(parts)
                ]
                code, far = np.stack([c for c, _ in made], 1).astype(np.int32), np.stack([d for _, d in made], 1)
                yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("label"), batch.column("v"), lists(code), lists(far)],
                                                 names=["k", "label", "v", "code", "far"])

    schema = T.StructType([rows.schema["k"], rows.schema["label"], rows.schema["v"],
                           T.StructField("code", T.ArrayType(T.IntegerType())), T.StructField("far", T.ArrayType(T.LongType()))])
    return rows.mapInArrow(run, schema)


def sums(rows: DataFrame, shape: tuple[int, int, int]) -> DataFrame:
    """``(part, entry, pos, n, total)``: of each entry's parts their number and the sums of their components."""
    parts, size, width = shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((parts, size, width), np.int64), np.zeros((parts, size), np.int64)
        for batch in batches:
            x, code = matrix(batch.column("v"), parts * width), matrix(batch.column("code"), parts)
            for p in range(parts):
                np.add.at(total[p], code[:, p], x[:, p * width : (p + 1) * width])
                n[p] += np.bincount(code[:, p], minlength=size)
        p, e = np.nonzero(n)
        at = np.tile(np.arange(width, dtype=np.int32), len(p))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(p, width).astype(np.int32)), pa.array(np.repeat(e, width).astype(np.int32)), pa.array(at),
             pa.array(np.repeat(n[p, e], width)), pa.array(total[p, e].reshape(-1))],
            names=["part", "entry", "pos", "n", "total"],
        )

    made = rows.select("v", "code").mapInArrow(run, SUMS)
    return made.groupBy("part", "entry", "pos").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def moved_books(rows: DataFrame, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every entry as the mean of its parts, rounded down, and which entries changed; unused entries stay."""
    new = books.copy()
    for r in sums(rows, books.shape).collect():  # at most one row per component of the codebooks
        new[r["part"], r["entry"], r["pos"]] = r["total"] // r["n"]
    return new, (new != books).any(2)


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components in order, as decimal numbers joined by commas."""
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def compress(
    vectors: DataFrame, key: str, vector: str, label: str, parts: int = 4, entries: int = 256, rounds: int = 4
) -> tuple[DataFrame, np.ndarray]:
    """``(key, label, codes, errors)`` of every usable vector, and the codebooks (part, entry, position).

    The codebooks start as the parts of the vectors with the ``entries`` smallest keys (equal keys: smaller vector
    first; null keys first), or of all, if fewer; ``errors`` are squared distances by part, in units of 1/1024.
    Left out are vectors that are null, empty, hold null or non-finite components, or have another length than the
    first of the start; a length that ``parts`` does not divide is an error.  Repeated rows are coded each by
    itself.  Without usable vectors both results are empty.  Other columns are ignored.
    """
    usable = cut_lineage(whole(vectors, key, vector, label).filter(F.size("v") > 0))
    first = usable.select("k", "v").orderBy("k", "v").limit(entries).collect()  # bounded by the parameter
    width = len(first[0]["v"]) if first else parts
    if width % parts:
        raise ValueError(f"vectors of {width} components have no {parts} equal parts")
    start = [r["v"] for r in first if len(r["v"]) == width]
    if len(start) < len(first):
        usable = usable.filter(F.size("v") == width)
        start = [r["v"] for r in usable.select("k", "v").orderBy("k", "v").limit(entries).collect()]
    else:
        usable = usable.filter(F.size("v") == width)
    books = np.array(start, np.int64).reshape(len(start), parts, width // parts).transpose(1, 0, 2).copy()
    rows, moved = usable, None
    if len(start):
        for _ in range(rounds):
            rows = cut_lineage(step(rows, books, moved))
            books, moved = moved_books(rows, books)
        rows = step(rows, books, moved)
    else:
        rows = rows.withColumns({"code": F.array().cast("array<int>"), "far": F.array().cast("array<bigint>")})
    return rows.select(F.col("k").alias(key), F.col("label").alias(label), F.col("code").alias("codes"), F.col("far").alias("errors")), books


def summed_by(rows: DataFrame, group: str, value: str, name: str) -> DataFrame:
    """``rows`` with ``name``, the sum of ``value`` over the rows of equal ``group``, nulls together.

    Sums are stored first, so that Spark knows their size, and can split a group that very many rows share.
    """
    total = cut_lineage(rows.groupBy(F.col(group).alias("g")).agg(F.sum(value).alias(name)))
    return rows.join(total, rows[group].eqNullSafe(total["g"])).drop("g")
