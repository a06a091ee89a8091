"""Per-position scores of sequences, their alignment after deletions, and effects of mutations.

Scores travel as one row per sequence with two arrays.  A mutant then meets its reference in
one join per sequence instead of one per position; positions are exploded only where an
operator really groups by position.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from exonloom.schemas import SITE_COLUMNS

# texts -> (acceptor arrays, donor arrays), one value per base
Scorer = Callable[[list[str]], tuple[list, list]]

SCORES = "seq_id string, acceptor array<double>, donor array<double>"


def one_hot(texts: Sequence[str], context: int = 5000):
    """Batch of padded one-hot matrices (A, C, G, T); other letters and padding are zero."""
    import numpy as np

    table = np.zeros((256, 4), dtype="float32")
    for i, base in enumerate("ACGT"):
        table[ord(base)] = np.eye(4, dtype="float32")[i]
    width = max(len(t) for t in texts) + 2 * context
    batch = np.zeros((len(texts), width, 4), dtype="float32")
    for row, text in enumerate(texts):
        raw = np.frombuffer(text.encode("ascii", "replace"), dtype=np.uint8)
        batch[row, context : context + len(raw)] = table[raw]
    return batch


#: Models that this worker has loaded, by name.
_LOADED: dict[str, list] = {}


def ensemble_scorer(models: Callable[[], list], context: int = 5000, name: str | None = None) -> Scorer:
    """Mean of several models with channels (none, acceptor, donor).

    ``models`` returns callables from a one-hot batch to ``[batch, positions, 3]`` scores without the context.  They are
    loaded once per task or, under a ``name``, once per Python worker, which goes from task to task.  Texts of a batch
    are padded to the longest; a text's scores must not depend on what stands beyond its context.
    """
    own: list = []

    def score(texts: list[str]):
        loaded = own if name is None else _LOADED.setdefault(name, [])
        if not loaded:
            loaded.extend(models())
        batch = one_hot(texts, context)
        mean = np.asarray(loaded[0](batch))
        for model in loaded[1:]:  # no more than one model's scores beside their sum
            mean = mean + np.asarray(model(batch))
        mean = mean / len(loaded)
        return (
            [mean[i, : len(t), 1] for i, t in enumerate(texts)],
            [mean[i, : len(t), 2] for i, t in enumerate(texts)],
        )

    return score


def share_models(width: int = 10) -> list:
    """Two models with known answers: shares of G and C, and of A and G, among ``width`` places up to and from each.

    They read one-hot batches with a context of ``width``; places outside a text count as neither.
    """
    def model(columns: tuple[int, int]):
        def run(batch):
            marked = batch[:, :, list(columns)].sum(axis=2)
            total = np.concatenate([np.zeros((len(marked), 1)), np.cumsum(marked, axis=1)], axis=1)
            at = np.arange(width, marked.shape[1] - width)
            upto, onward = total[:, at + 1] - total[:, at + 1 - width], total[:, at + width] - total[:, at]
            return np.stack([np.zeros_like(upto), upto / width, onward / width], axis=2)

        return run

    return [model((1, 2)), model((0, 2))]


def consensus_scorer(texts: list[str]) -> tuple[list, list]:
    """A deterministic stand-in for a trained model.

    Scores splice-site dinucleotides by the pyrimidine share of the 20 bases before (acceptor)
    and the purine share of the 6 bases after (donor).  It makes runs repeatable; it predicts
    nothing.
    """
    import numpy as np

    acceptors, donors = [], []
    for text in texts:
        raw = np.frombuffer(text.encode("ascii", "replace"), dtype=np.uint8)
        n = len(raw)
        is_py = np.isin(raw, [67, 84]).astype(float)
        total = np.concatenate([[0.0], np.cumsum(is_py)])
        at = np.arange(n)
        lo = np.maximum(at - 20, 0)
        left = (total[at] - total[lo]) / np.maximum(at - lo, 1)
        hi = np.minimum(at + 7, n)
        nxt = np.minimum(at + 1, n)
        right = 1 - (total[hi] - total[nxt]) / np.maximum(hi - nxt, 1)
        before_ag = np.zeros(n, bool)
        before_ag[2:] = (raw[:-2] == 65) & (raw[1:-1] == 71)
        gt_next = np.zeros(n, bool)
        gt_next[:-2] = (raw[1:-1] == 71) & (raw[2:] == 84)
        acceptors.append(np.where(before_ag, left, 0.01 * left))
        donors.append(np.where(gt_next, right, 0.01 * right))
    return acceptors, donors


def gc_scorer(width: int = 10) -> Scorer:
    """Share of G and C among up to ``width`` bases that end (acceptor) and begin (donor) at each position."""

    def score(texts: list[str]) -> tuple[list, list]:
        before, after = [], []
        for text in texts:
            raw = np.frombuffer(text.encode("ascii", "replace"), dtype=np.uint8)
            total = np.concatenate(([0.0], np.cumsum(np.isin(raw, [67, 71]))))
            at = np.arange(len(raw))
            low, high = np.maximum(at - width + 1, 0), np.minimum(at + width, len(raw))
            before.append((total[at + 1] - total[low]) / (at + 1 - low))
            after.append((total[high] - total[at]) / (high - at))
        return before, after

    return score


def predict(
    seqs: DataFrame, scorer: Scorer, batch_size: int = 64, id_column: str = "seq_id", batch_bases: int = 1 << 17
) -> DataFrame:
    """Acceptor and donor arrays per sequence.

    Sequences are sorted by length inside each partition so that a batch pads little; the scorer sees at most
    ``batch_size`` texts at once, and no more than ``batch_bases`` bases with their padding unless one text has more.
    """
    named = seqs.select(F.col(id_column).alias("seq_id"), "seq")
    ordered = named.sortWithinPartitions(F.length("seq"))

    def lists(parts) -> pa.Array:
        ends = np.concatenate(([0], np.cumsum([len(x) for x in parts]))).astype(np.int32)
        flat = np.concatenate([np.asarray(x, np.float64) for x in parts]) if len(parts) else np.zeros(0)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, at = batch.column("seq"), 0
            size = pc.fill_null(pc.utf8_length(column), 0).to_pylist()
            while at < len(size):
                stop, longest = at, 0
                while stop < len(size) and stop - at < batch_size:
                    longest = max(longest, size[stop])
                    if stop > at and longest * (stop + 1 - at) > batch_bases:
                        break
                    stop += 1
                acceptor, donor = scorer([t or "" for t in column.slice(at, stop - at).to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("seq_id").slice(at, stop - at), lists(acceptor), lists(donor)], names=["seq_id", "acceptor", "donor"]
                )
                at = stop

    return ordered.mapInArrow(run, SCORES)


def explode_scores(df: DataFrame, keys: Sequence[str] = ("seq_id",)) -> DataFrame:
    zipped = F.arrays_zip(F.col("acceptor").alias("a"), F.col("donor").alias("d"))
    return df.select(*keys, F.posexplode(zipped).alias("_i", "_z")).select(
        *keys, F.col("_i").cast("bigint").alias("pos"),
        F.col("_z.a").alias("acceptor"), F.col("_z.d").alias("donor"),
    )


def realign_array(scores: str, start: str, end: str) -> Column:
    """Scores of a deleted sequence in reference coordinates, 0 at the deleted bases."""
    a, s, n = F.col(scores), F.col(start).cast("int"), (F.col(end) - F.col(start)).cast("int")
    return F.concat(
        F.slice(a, F.lit(1), s),
        F.array_repeat(F.lit(0.0), n),
        F.slice(a, s + 1, F.greatest(F.size(a) - s, F.lit(0))),
    )


def realign(df: DataFrame) -> DataFrame:
    """Arrays of DEL rows shifted to reference coordinates; other rows are left alone."""
    shifted = F.col("type") == "DEL"
    return df.withColumns(
        {
            c: F.when(shifted, realign_array(c, "start", "end")).otherwise(F.col(c))
            for c in ("acceptor", "donor")
        }
    )


def realign_long(preds: DataFrame, deletions: DataFrame) -> DataFrame:
    """The same on long rows: positions right of a deletion shift, deleted ones become 0."""
    n = F.col("end") - F.col("start")
    moved = preds.join(deletions.select("id", "start", "end"), preds["seq_id"] == F.col("id")).select(
        "seq_id",
        F.when(F.col("pos") >= F.col("start"), F.col("pos") + n).otherwise(F.col("pos")).alias("pos"),
        "acceptor", "donor",
    )
    filled = deletions.select(
        F.col("id").alias("seq_id"),
        F.explode(F.sequence(F.col("start"), F.col("end") - 1)).alias("pos"),
        F.lit(0.0).alias("acceptor"), F.lit(0.0).alias("donor"),
    )
    return moved.unionByName(filled)


# ---------------------------------------------------------------- site arithmetic

def shifted_site(site: Column, start: Column, end: Column) -> Column:
    """An annotated site after a deletion: inside goes to the deletion start, later ones shift."""
    moved = site - (end - start)
    return (
        F.when((site >= start) & (site <= end), start)
        .when(site > end, F.when(moved >= 0, moved))
        .otherwise(site)
    )


def shifted_position(pos: Column, start: Column, end: Column, kind: Column) -> Column:
    """Any other position after a mutation: null inside a deletion."""
    moved = pos - (end - start)
    after = F.when((pos >= start) & (pos <= end), F.lit(None).cast("bigint")).when(
        pos > end, F.when(moved >= 0, moved)
    ).otherwise(pos)
    return F.when(kind == "DEL", after).otherwise(pos)


def shift_sites(df: DataFrame) -> DataFrame:
    """The six site columns of mutated rows (``type``, ``start``, ``end``)."""
    s, e = F.col("start"), F.col("end")
    return df.withColumns(
        {
            c: F.when(F.col("type") == "DEL", shifted_site(F.col(c), s, e)).otherwise(F.col(c))
            for c in SITE_COLUMNS
        }
    )


# ---------------------------------------------------------------- reference and variable positions

def above(scores: str, threshold: float, decimals: int | None = None) -> Column:
    """``array<struct<pos, score>>`` of the positions above a threshold, in order."""
    value = lambda x: F.round(x, decimals) if decimals is not None else x
    pairs = F.transform(
        F.col(scores),
        lambda x, i: F.struct(i.cast("bigint").alias("pos"), value(x).alias("score"), x.alias("raw")),
    )
    return F.transform(
        F.filter(pairs, lambda p: p["raw"] > threshold),
        lambda p: F.struct(p["pos"].alias("pos"), p["score"].alias("score")),
    )


def reference_sites(preds: DataFrame, threshold: float = 0.1) -> DataFrame:
    """Predicted splice sites of reference sequences with scores to three decimals."""
    a, d = above("acceptor", threshold, 3), above("donor", threshold, 3)
    field = lambda arr, name: F.transform(arr, lambda x: x[name])
    return preds.select(
        "seq_id",
        field(a, "pos").alias("acceptor_idx"), field(d, "pos").alias("donor_idx"),
        field(a, "score").alias("acceptor_preds"), field(d, "score").alias("donor_preds"),
    )


def variable_positions(
    preds: DataFrame, group: str = "seq_id", threshold: float = 0.05
) -> DataFrame:
    """Positions whose score range over all sequences of a group exceeds ``threshold``.

    ``(group, pos, site)``; a position that varies in both classes keeps the class with the
    larger median, acceptor on a tie.  Ranges are combined map side; medians are computed only
    for the positions that need them.
    """
    long = explode_scores(preds, [group])
    spans = long.groupBy(group, "pos").agg(
        (F.max("acceptor") - F.min("acceptor")).alias("_a"),
        (F.max("donor") - F.min("donor")).alias("_d"),
    ).filter((F.col("_a") > threshold) | (F.col("_d") > threshold))
    both = spans.filter((F.col("_a") > threshold) & (F.col("_d") > threshold)).select(group, "pos")
    medians = long.join(both, [group, "pos"], "left_semi").groupBy(group, "pos").agg(
        F.median("acceptor").alias("_ma"), F.median("donor").alias("_md")
    )
    joined = spans.join(medians, [group, "pos"], "left")
    site = F.when(F.col("_ma").isNotNull(), F.when(F.col("_ma") >= F.col("_md"), "acceptor").otherwise("donor")).when(
        F.col("_a") > threshold, "acceptor"
    ).otherwise("donor")
    return joined.select(group, "pos", site.alias("site"))


def variable_tracks(preds: DataFrame, positions: DataFrame, group: str = "seq_id", member: str = "id") -> DataFrame:
    """Long scores at the variable positions with the class of each (plot data)."""
    long = explode_scores(preds, [group, member])
    return long.join(positions, [group, "pos"]).select(
        group, member, "pos", "site",
        F.when(F.col("site") == "acceptor", F.col("acceptor")).otherwise(F.col("donor")).alias("score"),
    )


# ---------------------------------------------------------------- effects

def _at(array: str, pos: Column) -> Column:
    return F.get(F.col(array), pos.cast("int"))


def _change(mutant: str, reference: str):
    return lambda p: F.struct(
        p.alias("pos"), F.round(_at(mutant, p) - _at(reference, p), 3).alias("effect")
    )


def _not_among(known: Column):
    return lambda x: ~F.array_contains(known, x["pos"])


_SIDES = ("upstream", "cassette", "downstream")


def effect_summary(
    mutants: DataFrame,
    references: DataFrame,
    sites: DataFrame,
    threshold: float = 0.05,
    cryptic: float = 0.2,
) -> DataFrame:
    """One row per mutant: scores and effects at the six sites, cryptic sites, other changes.

    ``mutants``: id, seq_id, type, start, end, acceptor, donor (already realigned), plus any
    metadata.  ``references``: seq_id, acceptor, donor.  An effect is reported for positions
    that vary over the group; acceptor sites are read from acceptor scores only.
    """
    everything = mutants.select("seq_id", "acceptor", "donor").unionByName(
        references.select("seq_id", "acceptor", "donor")
    )
    variable = variable_positions(everything, "seq_id", threshold).groupBy("seq_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("site") == "acceptor", F.col("pos")))).alias("_va"),
        F.array_sort(F.collect_list(F.when(F.col("site") == "donor", F.col("pos")))).alias("_vd"),
    )
    base = references.select(
        "seq_id", F.col("acceptor").alias("_ra"), F.col("donor").alias("_rd")
    ).join(sites.select("seq_id", *SITE_COLUMNS), "seq_id").join(variable, "seq_id", "left")
    rows = mutants.join(base, "seq_id")
    none = F.array().cast("array<bigint>")
    rows = rows.withColumns(
        {
            "_va": F.coalesce("_va", none), "_vd": F.coalesce("_vd", none),
            "_sites": F.array_compact(F.array(*[F.col(c) for c in SITE_COLUMNS])),
        }
    )
    out = {}
    for i, side in enumerate(_SIDES):
        for kind, mut, ref, var, c in (
            ("acceptor", "acceptor", "_ra", "_va", SITE_COLUMNS[2 * i]),
            ("donor", "donor", "_rd", "_vd", SITE_COLUMNS[2 * i + 1]),
        ):
            pos = F.col(c)
            out[f"ref_{kind}_{side}"] = _at(mut, pos)
            out[f"{kind}_{side}_effect"] = F.when(
                F.array_contains(var, pos), F.round(_at(mut, pos) - _at(ref, pos), 3)
            ).otherwise(F.lit(0.0))
    start, end = F.col("start"), F.col("end")
    for kind, mut, ref, var in (("acceptor", "acceptor", "_ra", "_va"), ("donor", "donor", "_rd", "_vd")):
        high = F.filter(above(mut, cryptic, 3), lambda x: ~F.array_contains("_sites", x["pos"]))
        out[f"other_{kind}_preds"] = F.transform(high, lambda x: x["score"])
        out[f"other_{kind}_position"] = F.transform(
            high, lambda x: shifted_position(x["pos"], start, end, F.col("type"))
        )
        changed = F.filter(
            F.transform(
                F.filter(var, lambda p: ~F.array_contains("_sites", p)),
                _change(mut, ref),
            ),
            lambda x: F.abs(x["effect"]) > cryptic,
        )
        inside = lambda p: (start < p) & (p < end)
        out[f"other_{kind}_effect"] = F.transform(changed, lambda x: x["effect"])
        out[f"other_{kind}_distance_to_mutation"] = F.transform(
            changed,
            lambda x: F.when(inside(x["pos"]), F.lit(0).cast("bigint")).otherwise(
                F.least(F.abs(x["pos"] - start), F.abs(x["pos"] - end))
            ),
        )
        out[f"other_{kind}_affected_position"] = F.transform(
            changed, lambda x: shifted_position(x["pos"], start, end, F.col("type"))
        )
    keep = [c for c in mutants.columns if c not in ("acceptor", "donor")]
    done = rows.select(*keep, *SITE_COLUMNS, *[v.alias(k) for k, v in out.items()])
    return shift_sites(done)


def attach_hits(summary: DataFrame, located_hits: DataFrame) -> DataFrame:
    """Hit attributes (flags, density, location) by sequence, motif span and RBP."""
    keys = ["seq_id", "rbp_name", "motif_start", "motif_end"]
    named = located_hits.withColumnsRenamed({"start": "motif_start", "end": "motif_end"})
    extra = [c for c in named.columns if c not in summary.columns or c in keys]
    one = named.select(*extra).groupBy(*keys).agg(
        F.min(F.struct(*[F.col(c) for c in extra if c not in keys])).alias("_h")
    )
    return summary.join(one, keys, "left").select(*summary.columns, "_h.*")


def independent_summary(preds: DataFrame, sites: DataFrame, cryptic: float = 0.2) -> DataFrame:
    """Scores at the annotated sites of stand-alone sequences, and other positions above 0.2."""
    rows = preds.join(sites.select("seq_id", *SITE_COLUMNS), "seq_id")
    out = {}
    for kind, offset in (("acceptor", 0), ("donor", 1)):
        own = [SITE_COLUMNS[2 * i + offset] for i in range(3)]
        for side, c in zip(_SIDES, own):
            out[f"ref_{kind}_{side}"] = _at(kind, F.col(c))
        known = F.array_compact(F.array(*[F.col(c) for c in own]))
        other = F.filter(above(kind, cryptic, 2), _not_among(known))
        out[f"other_{kind}_position"] = F.transform(other, lambda x: x["pos"])
        out[f"other_{kind}_preds"] = F.transform(other, lambda x: x["score"])
    return rows.select("seq_id", *SITE_COLUMNS, *[v.alias(k) for k, v in out.items()])


def max_abs_effect(acceptor: Column | str, donor: Column | str) -> Column:
    """The effect with the larger magnitude, sign kept; the acceptor on a tie."""
    a = F.col(acceptor) if isinstance(acceptor, str) else acceptor
    d = F.col(donor) if isinstance(donor, str) else donor
    return F.when(F.abs(d) > F.abs(a), d).otherwise(a)


# Effect bins: right-closed edges and their labels (fixed values).
EFFECT_EDGES = [-1.0, -0.6, -0.2, 0.0, 0.2, 0.6, 1.0]
EFFECT_LABELS = [
    "Very_Strong_Neg",
    "Strong_Neg",
    "Moderate_Neg",
    "Moderate_Pos",
    "Strong_Pos",
    "Very_Strong_Pos",
]


def effect_bin(effect: Column | str) -> Column:
    """Right-closed bins; the lowest edge itself and values outside are null."""
    v = F.col(effect) if isinstance(effect, str) else effect
    out = None
    for lo, hi, label in zip(EFFECT_EDGES, EFFECT_EDGES[1:], EFFECT_LABELS):
        test = (v > lo) & (v <= hi)
        out = F.when(test, label) if out is None else out.when(test, label)
    return out


def significant(
    summary: DataFrame, threshold: float = 0.05, same_sign: bool = False, use_max: bool = True,
    top: int | None = 50, tie: Sequence[str] = ("id",),
) -> DataFrame:
    """Mutants with a cassette effect of at least ``threshold``; the ``top`` largest signed effects."""
    a, d = F.col("acceptor_cassette_effect"), F.col("donor_cassette_effect")
    kept = summary.filter((F.abs(a) >= threshold) | (F.abs(d) >= threshold))
    if same_sign:
        kept = kept.filter(((a > 0) & (d > 0)) | ((a < 0) & (d < 0)))
    effect = max_abs_effect(a, d) if use_max else (a + d) / 2
    out = kept.withColumn("effect", effect).withColumn("effect_bin", effect_bin("effect"))
    return out.orderBy(F.desc("effect"), *tie).limit(top) if top else out
