"""How far the word use of a source lies from its peers and from its language.

Sources are compared by smoothed shares of the terms that enough documents of their language hold.  The difference of
two sources, summed over all kept terms, is found by row accumulation: terms are dealt into blocks, a block keeps its
cells by term, and every group scatters its terms through that index into one dense row of numbers, a number for each
peer.  No pair of postings is ever a row.  A term that a source lacks has the source's base share, not zero, so

    sum |p - q|  =  V |a - b|  +  sum over s's terms (|p - b| - |a - b|)  +  sum over o's terms (|q - a| - |a - b|)
                    +  sum over common terms (|p - q| - |p - b| - |q - a| + |a - b|)

with a and b the base shares of s and o.  Blocks and tiles of groups bound what a task holds.
"""

from __future__ import annotations

from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from exonloom.session import cut_lineage

TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Cells of one block of terms, and groups of one tile, about.
BLOCK_CELLS, TILE = 1 << 15, 256
PAIRS = "lang string, source string, item string, value bigint"


def cells(docs: DataFrame, lang: str, source: str, text: str) -> DataFrame:
    """``(lang, source, term, n, docs)``: occurrences of a term in a group and the rows that hold it.

    A text without terms gives one row with a null term, so that every group is there.  Nulls count as empty.
    """
    words = F.regexp_extract_all(F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER), F.lit(TERM), F.lit(0))
    rows = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"))], F.sort_array(words).alias("w"))
    # equal terms stand together: the first of a row also counts its document
    new = F.transform("w", lambda t, i: F.struct(t.alias("term"), F.when((i > 0) & F.try_element_at("w", i).eqNullSafe(t), 0).otherwise(1).alias("first")))
    each = rows.select("lang", "source", F.explode_outer(new).alias("t"))
    return each.groupBy("lang", "source", "t.term").agg(F.count("t.term").alias("n"), F.coalesce(F.sum("t.first"), F.lit(0)).alias("docs"))


def share(count: str, total: str, kept: str):
    """``1 + floor(10**9 (count + 5) / (total + 5 kept))``, exact."""
    return F.expr(f"1 + (cast({count} + 5 as decimal(20, 0)) * cast(1000000000 as decimal(10, 0))) div cast({total} + 5 * {kept} as decimal(20, 0))")


def prepared(docs: DataFrame, lang: str, source: str, text: str, least_docs: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Stored tables: cells of kept terms with share ``p`` and the language's ``q``, groups, and languages."""
    counted = cut_lineage(cells(docs, lang, source, text))
    terms = counted.filter("term is not null").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("of_lang"))
    kept = cut_lineage(terms.filter(F.col("docs") >= least_docs).select("lang", "term", "of_lang"))
    here = cut_lineage(counted.join(kept, ["lang", "term"]))
    sizes = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("of_lang").alias("all_n"))
    totals = here.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("cells"))
    groups = (
        counted.select("lang", "source").distinct()
        .join(totals, ["lang", "source"], "left").join(sizes, "lang", "left")
        .na.fill(0, ["v", "all_n", "total", "cells"])
    )
    base = F.when(F.col("v") > 0, share("0L", "total", "greatest(v, 1)")).otherwise(0).cast("long")
    groups = cut_lineage(groups.withColumn("base", base))
    langs = groups.groupBy("lang").agg(F.count("*").alias("n_groups"), F.sum("cells").alias("n_cells"))
    langs = langs.select("lang", F.ceil(F.col("n_groups") / TILE).alias("tiles"), F.greatest(F.ceil(F.col("n_cells") / BLOCK_CELLS), F.lit(1)).alias("blocks"))
    shares = here.join(groups.select("lang", "source", "total", "v", "all_n"), ["lang", "source"]).select(
        "lang", "source", "term", share("n", "total", "v").cast("long").alias("p"), share("of_lang", "all_n", "v").cast("long").alias("q"),
    )
    return cut_lineage(shares), groups, cut_lineage(langs)


def _tiled(rows: DataFrame, langs: DataFrame) -> DataFrame:
    """A row for each tile of rows and of columns that needs it; ``side`` 1: as row, 2: as column, 3: both."""
    mine = F.pmod(F.xxhash64("source"), F.col("tiles"))
    place = F.explode(F.flatten(F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1),
        lambda t: F.when(t == F.col("mine"), F.array(F.struct(t.alias("r"), t.alias("c"), F.lit(3).alias("side")))).otherwise(
            F.array(F.struct(F.col("mine").alias("r"), t.alias("c"), F.lit(1).alias("side")), F.struct(t.alias("r"), F.col("mine").alias("c"), F.lit(2).alias("side")))
        ),
    )))
    return rows.withColumn("mine", mine).select("*", place.alias("at")).select("*", "at.*").drop("mine", "at", "tiles")


def accumulate(base_r: np.ndarray, base_c: np.ndarray, rows: tuple, columns: tuple, same: bool) -> np.ndarray:
    """Sums over the terms of a block for every (row group, column group), but for the part that only the bases make.

    ``rows`` and ``columns`` are (group, term, share) arrays, terms being small integers.
    """
    out = np.zeros((len(base_r), len(base_c)), np.int64)

    def by_own_terms(group, share, mine, theirs):
        """Of each group: sums of |p - b| - |a - b| over its terms, for the base b of every other."""
        made = np.zeros((len(mine), len(theirs)), np.int64)
        order = np.lexsort((share, group))
        group, share = group[order], share[order]
        cut = np.searchsorted(group, np.arange(len(mine) + 1))
        for g in np.flatnonzero(np.diff(cut)):
            x = share[cut[g] : cut[g + 1]]
            upto = np.concatenate(([0], np.cumsum(x)))
            k = np.searchsorted(x, theirs)
            made[g] = theirs * (2 * k - len(x)) + upto[-1] - 2 * upto[k] - len(x) * np.abs(mine[g] - theirs)
        return made

    rg, rt, rp = rows
    cg, ct, cp = columns
    own = by_own_terms(rg, rp, base_r, base_c)
    out += own
    out += own.T if same else by_own_terms(cg, cp, base_c, base_r).T
    order = np.argsort(ct, kind="stable")  # the term-major index
    peers, q = cg[order], cp[order]
    n_terms = int(max(rt.max(initial=-1), ct.max(initial=-1))) + 1
    first = np.searchsorted(ct[order], np.arange(n_terms + 1))
    order = np.argsort(rg, kind="stable")
    rg, rt, rp = rg[order], rt[order], rp[order]
    cut = np.searchsorted(rg, np.arange(len(base_r) + 1))
    for g in np.flatnonzero(np.diff(cut)):
        a, row = base_r[g], out[g]
        for i in range(cut[g], cut[g + 1], 1 << 14):  # so that what is scattered at once is bounded by terms x peers of the tile
            term, p = rt[i : min(i + (1 << 14), cut[g + 1])], rp[i : min(i + (1 << 14), cut[g + 1])]
            n = first[term + 1] - first[term]
            at = np.repeat(first[term] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            peer, other, mine = peers[at], q[at], np.repeat(p, n)
            b = base_c[peer]
            np.add.at(row, peer, np.abs(mine - other) - np.abs(mine - b) - np.abs(other - a) + np.abs(a - b))
    return out


def peer_differences(shares: DataFrame, groups: DataFrame, langs: DataFrame) -> DataFrame:
    """``(lang, source, item, value)``: summed differences of every source to every other of its language."""
    block = F.pmod(F.xxhash64("term", F.lit(1)), F.col("blocks"))
    some = F.lit(None).cast("string")
    entries = shares.join(langs, "lang").select("lang", "source", "tiles", block.alias("block"), "term", "p", F.lit(0).cast("long").alias("v"))
    heads = groups.join(langs, "lang").select(
        "lang", "source", "tiles", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"),
        some.alias("term"), F.col("base").alias("p"), "v",
    )
    placed = _tiled(entries.unionByName(heads), langs)

    def run(key: tuple[Any, ...], frame: pd.DataFrame) -> pd.DataFrame:
        block_no = key[1]
        head = frame["term"].isna()
        by_side = {}
        for side in (1, 2):
            mine = frame[(frame["side"] & side) > 0]
            top = mine[head[mine.index]].sort_values("source")
            body = mine[~head[mine.index]]
            place = pd.Index(top["source"])
            by_side[side] = (top, place, body)
        terms = pd.Index(frame.loc[~head, "term"].unique())
        arrays = []
        for side in (1, 2):
            top, place, body = by_side[side]
            arrays.append((top["p"].to_numpy(np.int64), (place.get_indexer(body["source"]), terms.get_indexer(body["term"]), body["p"].to_numpy(np.int64))))
        made = accumulate(arrays[0][0], arrays[1][0], arrays[0][1], arrays[1][1], key[2] == key[3])
        if not block_no:  # once for all blocks
            v = int(frame["v"].max())
            made += v * np.abs(arrays[0][0][:, None] - arrays[1][0][None, :])
        r, c = np.nonzero(by_side[1][1].to_numpy()[:, None] != by_side[2][1].to_numpy()[None, :])
        return pd.DataFrame({"lang": key[0], "source": by_side[1][1].to_numpy()[r], "item": by_side[2][1].to_numpy()[c], "value": made[r, c]})

    partial = placed.groupBy("lang", "block", "r", "c").applyInPandas(run, PAIRS)
    return partial.groupBy("lang", "source", "item").agg(F.sum("value").cast("long").alias("value"))


def audit(
    docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", least_docs: int = 30, top: int = 50
) -> DataFrame:
    """``(lang, source, part, item, value, rank)``: of every source the differences to its peers, and its own terms.

    Part ``pair``: every other source of the language with the summed difference of the shares of all kept terms.
    Part ``term``: the ``top`` kept terms whose share in the source is most above that in the language.  Shares are
    smoothed by 5 and in units of 10^-9.  Terms are runs of ASCII letters and non-ASCII characters, A-Z lower-cased,
    that at least ``least_docs`` rows of the language hold.  Null text, language and source count as empty, repeated
    rows each by itself; a language without kept terms has differences of 0 and no terms; a source alone in its
    language has no pairs.  Equal values are ranked by the bytes of the item.  An empty table gives an empty result.
    """
    shares, groups, langs = prepared(docs, lang, source, text, least_docs)
    pairs = peer_differences(shares, groups, langs).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    own = shares.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = own.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return pairs.withColumn("rank", F.row_number().over(order)).unionByName(ranked)
