"""Near-duplicate texts by SimHash fingerprints that meet inside balls of half the radius.

Two fingerprints at most ``2 r`` bits apart have a fingerprint within ``r`` bits of both between
them.  So every distinct fingerprint emits its ball of radius ``r`` (1 + width rows for r = 1), rows
are shuffled on these variants, and what meets on one variant is linked to the least fingerprint
there.  All fingerprints that meet are within the radius of each other, so linking to the least one
gives the same components as all pairs, and a variant never holds more rows than the ball.

Copies collapse to one fingerprint before the ball is emitted, so a group of copies costs one row.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from exonloom.llm import graph, tokens
from exonloom.session import cut_lineage

PART = 1 << 15


def shingle_hashes(text: bytes, size: int) -> Iterator[np.ndarray]:
    """Unsigned XXH64 (seed 42) of the word shingles of a text, repeats included, in parts.

    Fewer words than ``size`` give one shingle of all of them; no words give none.
    """
    words = text.lower().split()  # bytes: A-Z only, and \x20\x09-\x0D only
    if not words:
        return
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(size, len(words))
    starts, ends = starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    for i in range(0, len(starts), PART):
        yield np.array(
            [digest(line[a:b], 42) for a, b in zip(starts[i : i + PART], ends[i : i + PART], strict=True)], np.uint64
        )


def fingerprint(text: bytes | None, size: int, words: int = 1) -> np.ndarray:
    """``words`` unsigned 64-bit words whose bits are 1 where over half the shingle hashes have a 1.

    The first word uses the hashes themselves, further ones fixed mixes of them.  No words: zero.
    """
    return majority(shingle_hashes(text or b"", size), words)


def majority(parts: Iterable[np.ndarray], words: int = 1) -> np.ndarray:
    """The fingerprint of hashes that come in parts."""
    ones, n = np.zeros(64 * words, np.int64), 0
    for h in parts:
        rows = [h if k == 0 else tokens.mix(h + np.uint64(k)) for k in range(words)]
        big = np.stack(rows, axis=1).astype(">u8").view(np.uint8).reshape(len(h), 8 * words)
        for i in range(0, len(h), 128):  # so few that the counts fit in bytes
            ones += np.unpackbits(big[i : i + 128], axis=1).sum(0, dtype=np.uint8)
        n += len(h)
    return np.packbits(2 * ones > n).view(">u8").astype(np.uint64)


def fingerprints(rows: DataFrame, text: str, size: int = 3, words: int = 1) -> DataFrame:
    """``rows`` with ``text`` replaced by ``fp``, an array of signed 64-bit words. Null text: as empty."""
    keep = [c for c in rows.columns if c != text]
    schema = T.StructType([*[rows.schema[c] for c in keep], T.StructField("fp", T.ArrayType(T.LongType(), False))])

    def run(batches):
        for batch in batches:
            made = [fingerprint(t.as_py(), size, words).view(np.int64) for t in batch.column(text)]
            flat = np.concatenate(made) if made else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(made) + 1, dtype=np.int32) * words), pa.array(flat))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], lists], names=[*keep, "fp"])

    return rows.withColumn(text, F.col(text).cast("binary")).mapInArrow(run, schema)


def ball(fp: str, width: int = 64) -> F.Column:
    """The fingerprint and all that differ from it in one of its ``width`` low bits."""
    return F.expr(f"concat(array({fp}), transform(sequence(0, {width - 1}), i -> {fp} ^ shiftleft(1L, i)))")


def links(distinct: DataFrame) -> DataFrame:
    """Edges ``(u, v)`` that join all fingerprints ``fp`` at two or fewer differing bits into components."""
    variants = distinct.select("fp", F.explode(ball("fp")).alias("near"))
    least = F.min("fp").over(Window.partitionBy("near"))
    met = variants.withColumn("v", least).filter("fp > v").select(F.col("fp").alias("u"), "v").distinct()
    return met.filter(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= 2)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 3) -> DataFrame:
    """``key``, ``fingerprint`` (16 hex digits) and ``component_id``, the least key reachable.

    One row per input row, repeated rows included.  Null or empty texts have fingerprint zero and are
    linked like any other.  A null key is never a component's name unless all its keys are null.  Other
    columns are ignored; an empty table gives an empty result.
    """
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    fps = cut_lineage(fingerprints(rows, "t", size).select("k", F.col("fp")[0].alias("fp")))
    distinct = cut_lineage(fps.groupBy("fp").agg(F.min("k").alias("first")))
    found = graph.components(links(distinct))
    named = distinct.join(found, distinct["fp"] == found["node"]).groupBy("component").agg(F.min("first").alias("name"))
    of = found.join(named, "component").select(F.col("node").alias("fp"), "name")
    # stored, so that the last join can split a fingerprint that very many rows share
    all_of = cut_lineage(distinct.join(of, "fp", "left").select("fp", F.coalesce("name", "first").alias("component_id")))
    return fps.join(all_of, "fp").select(
        F.col("k").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


# ------------------------------------------------------------------ similar texts, several fingerprints

BANDS, LEAST = 16, 4


def shingle_set(text: bytes | None, size: int) -> np.ndarray:
    """The distinct shingle hashes of a text, sorted."""
    return np.unique(np.concatenate([*shingle_hashes(text or b"", size), np.zeros(0, np.uint64)]))


def shingle_sets(rows: DataFrame, size: int) -> DataFrame:
    """``(k, set)``: the distinct shingle hashes of ``rows(k, t)``."""
    def run(batches):
        for batch in batches:
            made = [shingle_set(t.as_py(), size) for t in batch.column("t")]
            ends = np.concatenate(([0], np.cumsum([len(x) for x in made]))).astype(np.int32)
            flat = np.concatenate([*made, np.zeros(0, np.uint64)]).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("k"), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["k", "set"])

    schema = T.StructType([rows.schema["k"], T.StructField("set", T.ArrayType(T.LongType(), False))])
    return rows.select("k", F.col("t").cast("binary").alias("t")).mapInArrow(run, schema)


def least_of(shingles: np.ndarray, bands: int) -> np.ndarray:
    """A hash for each band of the least values of its ``LEAST`` random orders of the shingles; none of no shingles.

    Two sets have equal least values in one order with a chance of their Jaccard similarity.
    """
    if not len(shingles):
        return np.zeros(0, np.int64)
    factors = tokens.mix(np.arange(2 * bands * LEAST)).reshape(2, -1, 1) | np.uint64(1)
    least = np.full(bands * LEAST, np.uint64(2**64 - 1))
    for i in range(0, len(shingles), 1 << 9):  # so few that they stay in the cache
        x = shingles[i : i + (1 << 9)] * factors[0]
        x ^= x >> np.uint64(32)
        x *= factors[1]
        np.minimum(least, x.min(axis=1), out=least)
    out = np.arange(bands, dtype=np.uint64)
    for column in least.reshape(bands, LEAST).T:
        out = tokens.mix(out ^ column)
    return out.view(np.int64)


def sketches(rows: DataFrame, size: int, bands: int) -> DataFrame:
    """``(k, id, n, fp, least)``: of the set of shingles of ``rows(k, t)`` a 128-bit hash, its size, fingerprint and ``least_of`` it."""
    def run(batches):
        for batch in batches:
            made = [shingle_set(t.as_py(), size) for t in batch.column("t")]
            least = [least_of(x, bands) for x in made]
            ends = np.concatenate(([0], np.cumsum([len(x) for x in least]))).astype(np.int32)
            flat = np.concatenate([*least, np.zeros(0, np.int64)])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("k"), pa.array([xxhash.xxh3_128_digest(x.tobytes()) for x in made], pa.binary()),
                    pa.array([len(x) for x in made], pa.int64()), pa.array([int(majority([x]).view(np.int64)[0]) for x in made], pa.int64()),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)),
                ],
                names=["k", "id", "n", "fp", "least"],
            )

    schema = T.StructType(
        [rows.schema["k"], T.StructField("id", T.BinaryType()), T.StructField("n", T.LongType()), T.StructField("fp", T.LongType()), T.StructField("least", T.ArrayType(T.LongType(), False))]
    )
    return rows.select("k", F.col("t").cast("binary").alias("t")).mapInArrow(run, schema)


def alike(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The ``pairs(u, v)`` whose ``sets(k, set)`` have at least this Jaccard similarity."""
    both = pairs.join(sets.select(F.col("k").alias("u"), F.col("set").alias("su")), "u").join(
        sets.select(F.col("k").alias("v"), F.col("set").alias("sv")), "v"
    )
    common = F.size(F.array_intersect("su", "sv"))
    return both.filter(common >= similarity * (F.size("su") + F.size("sv") - common)).select("u", "v")


def named_by(groups: DataFrame, rows: DataFrame) -> DataFrame:
    """``rows`` with ``c``, the component in ``groups(node, component)`` of their column ``k``; itself where it is in none."""
    of = groups.select(F.col("node").alias("k"), F.col("component").alias("c"))
    return rows.join(of, "k", "left").withColumn("c", F.coalesce("c", "k"))


def prefixes(sets: DataFrame, similarity: float) -> DataFrame:
    """``(k, n, shingle, pos)``: the places in each set's order, rarest first, where a similar set can first meet it.

    Sets with a Jaccard similarity of at least ``similarity`` share a shingle at such places in both, and the first
    one they share leaves as many shingles behind it in both as they must have in common.  Shingles are counted
    within ``sets``; those of one set only are counted as places but give no row.
    """
    each = sets.select("k", F.size("set").alias("n"), F.explode("set").alias("shingle"))
    often = cut_lineage(each.groupBy("shingle").agg(F.count("*").alias("often")).filter("often > 1"))
    ordered = each.join(often, "shingle").groupBy("k", "n").agg(F.array_sort(F.collect_list(F.struct("often", "shingle"))).alias("o"))
    placed = ordered.select("k", "n", F.posexplode("o").alias("i", "x"), (F.col("n") - F.size("o")).alias("rare"))
    placed = placed.select("k", "n", F.col("x.shingle").alias("shingle"), (F.col("rare") + F.col("i")).alias("pos"))
    return placed.filter(F.col("n") - F.col("pos") >= similarity * F.col("n") - 1e-6)


def prefix_links(rows: DataFrame, sets: DataFrame, known: DataFrame, similarity: float) -> DataFrame:
    """Edges that join all ``rows(k)`` alike by their ``sets(k, set)``, next to those of ``known``; see ``prefix_groups``."""
    groups = prefix_groups(rows, sets, cut_lineage(graph.components(known)), similarity)
    return groups.select(F.col("node").alias("u"), F.col("component").alias("v"))


def prefix_groups(rows: DataFrame, sets: DataFrame, groups: DataFrame, similarity: float) -> DataFrame:
    """``groups(node, component)`` extended by the links of all ``rows(k)`` alike by their ``sets(k, set)``; exact.

    Sets meet on the shingles of their prefixes.  First each is compared with the set of its shingle that has the
    fewest rarer ones, which joins families of near copies; then all that meet and are not joined yet are compared.
    """
    def may(a: str, b: str):
        n, m = F.col(f"n{a}"), F.col(f"n{b}")
        return (F.least(n, m) >= similarity * F.greatest(n, m)) & (
            F.least(n - F.col(f"pos{a}"), m - F.col(f"pos{b}")) >= similarity / (1 + similarity) * (n + m) - 1e-6
        )

    def sides(df: DataFrame, tag: str) -> DataFrame:
        return df.select("shingle", *[F.col(c).alias(c + tag) for c in ("k", "c", "n", "pos")])

    def pairs(met: DataFrame) -> DataFrame:
        return met.filter("cx <> cy").filter(may("x", "y")).select(F.greatest("kx", "ky").alias("u"), F.least("kx", "ky").alias("v")).distinct()

    few = cut_lineage(prefixes(sets.join(rows, "k", "left_semi"), similarity))
    entries = cut_lineage(named_by(groups, few))
    head = entries.groupBy("shingle").agg(F.min(F.struct("pos", "k", "c", "n")).alias("h")).select("shingle", "h.*")
    tried = cut_lineage(pairs(sides(entries, "x").join(sides(head, "y"), "shingle")))
    groups = cut_lineage(graph.extended(groups, cut_lineage(alike(tried, sets, similarity))))
    entries = cut_lineage(named_by(groups, few))
    met = sides(entries, "x").join(sides(entries, "y"), "shingle").filter("kx > ky")
    rest = cut_lineage(pairs(met).join(tried, ["u", "v"], "left_anti"))
    return graph.extended(groups, cut_lineage(alike(rest, sets, similarity)))


def join_met(near: DataFrame, rows: DataFrame, size: int, similarity: float) -> DataFrame:
    """Components of ``near(first, n, near)`` (``n``: shingles of the set) under links between all alike texts that meet.

    Texts meet in a bucket of equal ``near``.  Every row is first compared with the least one of its bucket.  The rows
    of all buckets that this leaves in several components are then joined by ``prefix_groups``, which misses no pair
    among them.  Work is linear in families of copies; texts that share a template, but have more words of their own
    than similar texts can have, do not meet in the second step.
    """
    bucket = Window.partitionBy("near")
    met = near.withColumns({"least": F.min("first").over(bucket), "nl": F.min_by("n", "first").over(bucket), "rows": F.count("*").over(bucket)})
    met = cut_lineage(met.filter("rows > 1").drop("rows"))
    sets = cut_lineage(shingle_sets(rows.join(met.select(F.col("first").alias("k")).distinct(), "k", "left_semi"), size))
    small, large = F.least("n", "nl"), F.greatest("n", "nl")
    pairs = met.filter("first > least").filter(small >= similarity * large).select(F.col("first").alias("u"), F.col("least").alias("v")).distinct()
    groups = cut_lineage(graph.components(alike(cut_lineage(pairs), sets, similarity)))
    named = cut_lineage(named_by(groups, met.select(F.col("first").alias("k"), "near")))
    apart = named.groupBy("near").agg(F.min("c").alias("a"), F.max("c").alias("b")).filter("a <> b").select("near")
    open_rows = named.join(apart, "near", "left_semi").select("k").distinct()
    return prefix_groups(open_rows, sets, groups, similarity)


def similar_groups(docs: DataFrame, key: str, text: str, size: int = 5, similarity: float = 0.8, bands: int = BANDS) -> DataFrame:
    """``(key, group)`` of every row; rows at least ``similarity`` alike share a group, named by its least key.

    The rule is the Jaccard similarity of the sets of word shingles.  Texts meet in the balls of their fingerprints, as
    in ``near_duplicates``: whatever is at two or fewer differing bits meets.  At 0.8 a seventh of all bits differ, and balls alone
    would need 37 fingerprints of 32 bits for a chance of 0.99, 1,221 rows a text; so texts also meet that have the same least
    values in ``LEAST`` random orders of their shingles, in one of ``bands`` such draws: texts 0.8 alike with a chance of
    1 - (1 - 0.8^4)^16 = 0.9998, 0.85 alike with more than 0.9999.  What meets either way is compared by its
    sets, see ``join_met``.  Keys must be unique.  Equal sets (and all empty ones) are one group.
    """
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    made = cut_lineage(sketches(rows, size, bands))
    same = cut_lineage(made.groupBy("id").agg(F.min("k").alias("first"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("least").alias("least")))
    # a draw and a fingerprint that happen to be one number cost a comparison, no more
    near = same.filter("n > 0").select("first", "n", F.explode(F.concat(ball("fp"), "least")).alias("near"))
    joined = join_met(near, rows, size, similarity)
    # stored, so that the last join can split a set that very many rows share
    of = same.join(joined, same["first"] == joined["node"], "left").select("id", F.coalesce("component", "first").alias("group"))
    return made.select("k", "id").join(cut_lineage(of), "id").select(F.col("k").alias(key), "group")


def drop_similar(docs: DataFrame, text: str = "text", size: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` with one row of every group of similar texts: the first in the order of the stored rows.

    ``docs`` must be stored (read from files), as rows are numbered by their place in two scans.
    """
    number = tokens.unused(docs.columns, "row_number")
    rows = docs.withColumn(number, F.monotonically_increasing_id())
    groups = similar_groups(rows.select(number, text), number, text, size, similarity)
    gone = groups.filter(F.col(number) != F.col("group")).select(number)
    return rows.join(gone, number, "left_anti").select(*docs.columns)
