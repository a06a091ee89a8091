"""Motif scanning, containment and density of hits, scope and counts."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from exonloom.operators.automaton import Automaton, code_points, slices
from exonloom.operators.intervals import cluster, cluster_sizes, cluster_within
from exonloom.operators.scan import DEFAULT_BLOCK, position_block
from exonloom.schemas import HITS
from exonloom.session import cut_lineage

# Motifs that are shipped to the tasks at once; further ones make further passes.
DICTIONARY_LIMIT = 20_000
# From this many motifs on they are looked for together by an automaton instead of one by one.
AUTOMATON_FROM = 200
# Hits of one output batch, and bytes of text walked at once by the automaton.
HITS_AT_ONCE, BYTES_AT_ONCE = 20_000, 1 << 20


def dictionary_of(motifs: DataFrame) -> DataFrame:
    """Distinct ``(rbp_name, motif)``; null and empty motifs are no motifs."""
    return motifs.select("rbp_name", "motif").filter(F.length("motif") > 0).distinct()


def scan_exact(seqs: DataFrame, motifs: DataFrame, limit: int = DICTIONARY_LIMIT) -> DataFrame:
    """Literal hits ``(seq_id, rbp_name, motif, start, end)``, in code points.

    Case sensitive; occurrences of one motif are taken left to right and do not overlap each
    other.  Null and empty motifs are left out, null sequences have no hits, and every row of ``seqs`` is
    scanned by itself, also where ids repeat.  Motifs go to the tasks ``limit`` at a time: a larger
    dictionary is cut by a hash of the motif and takes one pass per part, with the same result.
    """
    return reduce(DataFrame.unionByName, [scan_dictionary(seqs, owners) for owners in loaded_dictionaries(motifs, limit)])


def loaded_dictionaries(motifs: DataFrame, limit: int = DICTIONARY_LIMIT) -> Iterator[dict[str, list[str]]]:
    """The dictionary, motif to its RBP names, in parts of about ``limit`` motifs; one part at least."""
    words = dictionary_of(motifs)
    head = words.limit(limit + 1).collect()
    parts = 1 if len(head) <= limit else -(-words.count() // limit)
    for part in range(parts):
        owners: dict[str, list[str]] = defaultdict(list)
        place = F.pmod(F.xxhash64("motif"), F.lit(parts))
        for row in head if parts == 1 else words.filter(place == part).toLocalIterator():
            owners[row["motif"]].append(row["rbp_name"])
        yield dict(owners)


def scan_dictionary(seqs: DataFrame, owners: dict[str, list[str]]) -> DataFrame:
    """``scan_exact`` for a dictionary held by the tasks (motif to its RBP names)."""
    return seqs.select(F.col("seq_id").cast("string"), "seq").mapInArrow(batch_scanner(seqs.sparkSession, owners), HITS)


def batch_scanner(spark: SparkSession, owners: dict[str, list[str]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What ``scan_dictionary`` does to batches of ``(seq_id, seq)``."""
    names = {m: sorted(set(o)) for m, o in owners.items() if m}

    if len(names) >= AUTOMATON_FROM:
        return _automaton_scanner(spark, names)
    words = list(names)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _owner_table(words, names)
        for batch in batches:
            found: list[tuple[int, int, int]] = []
            for i, text in enumerate(batch.column("seq")):
                text = text.as_py() or ""
                for k, motif in enumerate(words):
                    at = text.find(motif)
                    while at >= 0:
                        found.append((i, k, at))
                        at = text.find(motif, at + len(motif))
                        if len(found) >= HITS_AT_ONCE:
                            yield from _hit_rows(batch.column("seq_id"), *np.array(found, np.int64).T, table)
                            found = []
            if found:
                yield from _hit_rows(batch.column("seq_id"), *np.array(found, np.int64).T, table)

    return scan


def _owner_table(motifs: Sequence[str], names: dict[str, list[str]]) -> tuple[pa.Array, pa.Array, np.ndarray, np.ndarray]:
    """Motifs, all owners one motif after another, the first owner of each, and lengths in code points."""
    owners = [names[m] for m in motifs]
    return (
        pa.array(motifs, pa.string()), pa.array([o for own in owners for o in own], pa.string()),
        np.cumsum([0, *map(len, owners)]), np.array([len(m) for m in motifs], np.int64),
    )


def _hit_rows(ids: pa.Array, where: np.ndarray, motif: np.ndarray, start: np.ndarray, table: tuple) -> Iterator[pa.RecordBatch]:
    """A row for each owner of each hit, about ``HITS_AT_ONCE`` of them at once."""
    words, rbps, first, points = table
    n = first[motif + 1] - first[motif]
    upto = np.concatenate([[0], np.cumsum(n)])
    i = 0
    while i < len(n):
        j = max(i + 1, int(np.searchsorted(upto, upto[i] + HITS_AT_ONCE, "right")) - 1)
        nth = np.repeat(np.arange(i, j), n[i:j])
        owner = first[motif[nth]] + np.arange(len(nth)) - (upto[nth] - upto[i])
        m, s = motif[nth], start[nth]
        yield pa.RecordBatch.from_arrays(
            [ids.take(pa.array(where[nth])), rbps.take(pa.array(owner)), words.take(pa.array(m)), pa.array(s), pa.array(s + points[m])],
            names=["seq_id", "rbp_name", "motif", "start", "end"],
        )
        i = j


def _automaton_scanner(spark: SparkSession, names: dict[str, list[str]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same with one walk over each text for all motifs; the automaton is broadcast once."""
    motifs = sorted(names)
    sent = spark.sparkContext.broadcast((Automaton([m.encode() for m in motifs]), _owner_table(motifs, names)))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, table = sent.value
        for batch in batches:
            texts = pc.fill_null(batch.column("seq").cast(pa.large_binary()), b"")
            offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
            body = texts.buffers()[2]
            data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
            for i, j in slices(offsets, BYTES_AT_ONCE):
                part, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                where, motif, start = automaton.hits(part, at)
                start = code_points(part, at, where, start)
                yield from _hit_rows(batch.column("seq_id"), where + i, motif, start, table)

    return scan


def scan_by_join(seqs: DataFrame, motifs: DataFrame, limit: int = DICTIONARY_LIMIT) -> DataFrame:
    """``scan_exact`` by a join: windows of each motif length meet the dictionary by key.

    At most ``limit`` distinct motifs are broadcast at a time, so that windows are not shuffled; a larger dictionary is
    cut by a hash of the motif and takes one join per part, with the same result.
    """
    words = cut_lineage(dictionary_of(motifs))
    parts = -(-words.select("motif").distinct().count() // limit)
    if parts > 1:
        place = F.pmod(F.xxhash64("motif"), F.lit(parts))
        return reduce(DataFrame.unionByName, [_join_loaded(seqs, words.filter(place == part)) for part in range(parts)])
    return _join_loaded(seqs, words)


def _join_loaded(seqs: DataFrame, words: DataFrame) -> DataFrame:
    lengths = sorted(r["k"] for r in words.select(F.length("motif").alias("k")).distinct().collect())
    if not lengths:
        return seqs.sparkSession.createDataFrame([], HITS)

    def windows(k: int) -> Column:
        # one code point is consumed per match, so the place of a match counts code points
        grams = F.regexp_extract_all("seq", F.lit(f"(?s)(?=(.{{{k}}}))."), F.lit(1))
        return F.transform(grams, lambda g, i: F.struct(i.alias("at"), g.alias("motif")))

    rows = seqs.select("seq_id", "seq", F.monotonically_increasing_id().alias("_row"))
    found = rows.select("_row", "seq_id", F.inline(F.flatten(F.array(*[windows(k) for k in lengths])))).join(
        F.broadcast(words.select("motif").distinct()), "motif", "left_semi"
    )
    # Occurrences of one motif in one sequence are bounded by the sequence itself.
    ordered = found.groupBy("_row", "seq_id", "motif").agg(F.array_sort(F.collect_list("at")).alias("_all"))
    empty = F.struct(F.lit(0).alias("free"), F.array().cast("array<int>").alias("out"))
    step = lambda acc, at: F.when(
        at >= acc["free"],
        F.struct((at + F.length("motif")).alias("free"), F.array_append(acc["out"], at).alias("out")),
    ).otherwise(acc)
    kept = ordered.select(
        "seq_id", "motif", F.explode(F.aggregate("_all", empty, step, lambda a: a["out"])).alias("at")
    )
    return kept.join(F.broadcast(words), "motif").select(
        "seq_id", "rbp_name", "motif", F.col("at").cast("bigint").alias("start"),
        (F.col("at") + F.length("motif")).cast("bigint").alias("end"),
    )


def unambiguous_kmers(
    matrices: DataFrame, threshold: float = 0.15, min_length: int = 5
) -> DataFrame:
    """Every sequence a matrix allows with all bases at or above ``threshold``, per RBP."""
    allowed = (
        matrices.filter(F.col("p") >= threshold)
        .groupBy("motif_id", "rbp_name", "pos")
        .agg(F.array_sort(F.collect_set("base")).alias("bases"))
    )
    width = matrices.groupBy("motif_id", "rbp_name").agg(F.countDistinct("pos").alias("_w"))
    columns = allowed.groupBy("motif_id", "rbp_name").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("pos", "bases"))), lambda x: x["bases"]
        ).alias("_cols")
    ).join(width, ["motif_id", "rbp_name"]).filter(F.size("_cols") == F.col("_w"))
    product = F.aggregate(
        "_cols",
        F.array(F.lit("")),
        lambda acc, bases: F.flatten(
            F.transform(acc, lambda head: F.transform(bases, lambda b: F.concat(head, b)))
        ),
    )
    return (
        columns.filter(F.col("_w") >= min_length)
        .select("rbp_name", F.explode(product).alias("motif"))
        .distinct()
    )


# ---------------------------------------------------------------- matrix search

def score_matrices(matrices: DataFrame, background: float = 0.25, pseudo: float = 1e-4) -> DataFrame:
    """Log-odds rows ``(motif_id, rbp_name, weights array<array<double>>)`` in A, C, G, T order."""
    odds = F.log2((F.col("p") + pseudo) / (1 + 4 * pseudo) / F.lit(background))
    rows = matrices.groupBy("motif_id", "rbp_name", "pos").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("base", odds.alias("w")))), lambda x: x["w"]
        ).alias("w")
    )
    return rows.groupBy("motif_id", "rbp_name").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("pos", "w"))), lambda x: x["w"]
        ).alias("weights")
    )


def _score_tail(weights, scale: int = 100):
    """Smallest scaled score for each tail probability, from the exact score distribution."""
    import numpy as np

    steps = np.rint(np.asarray(weights) * scale).astype(int)
    low = int(steps.min(axis=1).sum())
    size = int(steps.max(axis=1).sum()) - low + 1
    dist = np.zeros(size)
    dist[0] = 1.0
    for column in steps:
        moved = np.zeros(size)
        for step in column - column.min():
            moved[step:] += 0.25 * dist[: size - step]
        dist = moved
    return steps, low, np.cumsum(dist[::-1])[::-1]


def scan_matrices(
    seqs: DataFrame, matrices: DataFrame, p_value: float = 5e-5, limit: int = 5_000,
    allowed: DataFrame | None = None,
) -> DataFrame:
    """Forward-strand matrix hits whose score tail probability is at most ``p_value``.

    Probabilities come from the distribution of the rounded log-odds score under a uniform
    background.  ``allowed`` (rbp_name, motif) keeps hits whose bases are one of the
    unambiguous sequences.  Matrices go to the tasks ``limit`` at a time, one pass per part.
    """
    table = score_matrices(matrices)
    parts = -(-table.count() // limit) or 1
    place = F.pmod(F.xxhash64("motif_id", "rbp_name"), F.lit(parts))
    scans = [_scan_loaded(seqs, table.filter(place == part), p_value) for part in range(parts)]
    hits = reduce(DataFrame.unionByName, scans).distinct()
    if allowed is not None:
        hits = hits.join(allowed, ["rbp_name", "motif"], "left_semi")
    return hits


# Columns of a matrix that are looked up together.
COLUMNS_AT_ONCE = 4


def _loaded_matrix(weights: list[list[float]], p_value: float) -> tuple[int, list[np.ndarray], int]:
    """Width, scores of ``COLUMNS_AT_ONCE`` letters at a time (A, C, G, T, other) and the least score of a hit."""
    steps, low, tail = _score_tail(weights)
    good = np.flatnonzero(tail <= p_value)
    other = -(1 << 24)  # a word with another letter is no hit, however high its other letters score
    padded = np.hstack([steps, np.full((len(steps), 1), other)]).astype(np.int64)
    tables = []
    for i in range(0, len(padded), COLUMNS_AT_ONCE):
        part = padded[i : i + COLUMNS_AT_ONCE]
        whole = np.vstack([part, np.zeros((COLUMNS_AT_ONCE - len(part), 5), np.int64)])
        total = reduce(lambda x, y: np.add.outer(x, y), whole).ravel()
        tables.append(np.maximum(total, other).astype(np.int32))
    return len(steps), tables, int(low + good[0]) if len(good) else 1 << 30


def _scan_loaded(seqs: DataFrame, table: DataFrame, p_value: float) -> DataFrame:
    loaded = [(r["rbp_name"], [list(w) for w in r["weights"]]) for r in table.toLocalIterator()]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = [(rbp, *_loaded_matrix(w, p_value)) for rbp, w in loaded]
        widest = max((k for _, k, _, _ in ready), default=0) + COLUMNS_AT_ONCE
        code = np.full(256, 4, np.int32)
        code[[65, 67, 71, 84]] = [0, 1, 2, 3]
        for batch in batches:
            # code points, one byte each; texts are parted by a letter that is in no hit
            bodies = [(t or "").encode("ascii", "replace") + b"-" for t in batch.column("seq").to_pylist()]
            offsets = np.cumsum([0, *map(len, bodies)])
            for i, j in slices(offsets, BYTES_AT_ONCE):
                data = np.frombuffer(b"".join(bodies[i:j]) + b"-" * widest, np.uint8)
                begin, size = offsets[i:j] - offsets[i], int(offsets[j] - offsets[i])
                bases = code[data]
                words = np.zeros(size + widest - COLUMNS_AT_ONCE, np.int32)
                for c in range(COLUMNS_AT_ONCE):
                    words = words * 5 + bases[c : c + len(words)]
                for rbp, k, tables, least in ready:
                    score = tables[0][words[:size]]
                    for n, part in enumerate(tables[1:], 1):
                        score += part[words[n * COLUMNS_AT_ONCE : n * COLUMNS_AT_ONCE + size]]
                    at = np.flatnonzero(score >= least)
                    for s in range(0, len(at), HITS_AT_ONCE):
                        yield _matrix_hits(batch.column("seq_id"), i, begin, data, at[s : s + HITS_AT_ONCE], rbp, k)

    return seqs.select(F.col("seq_id").cast("string"), "seq").mapInArrow(scan, HITS)


def _matrix_hits(ids: pa.Array, first: int, begin: np.ndarray, data: np.ndarray, at: np.ndarray, rbp: str, k: int) -> pa.RecordBatch:
    where = np.searchsorted(begin, at, "right") - 1
    ends, letters = (np.arange(len(at) + 1) * k).astype(np.int32), np.ascontiguousarray(data[at[:, None] + np.arange(k)])
    motif = pa.StringArray.from_buffers(len(at), pa.py_buffer(ends), pa.py_buffer(letters))
    start = at - begin[where]
    return pa.RecordBatch.from_arrays(
        [ids.take(pa.array(where + first)), pa.array([rbp] * len(at), pa.string()), motif, pa.array(start), pa.array(start + k)],
        names=["seq_id", "rbp_name", "motif", "start", "end"],
    )


# ---------------------------------------------------------------- redundancy and density

def _loser(best: Column, name: str, end: Column) -> Column:
    """The struct ``(end, name)`` that loses when ``(end, name)`` meets the best so far; null if they share a name."""
    return F.when(best.isNotNull() & (best["name"] != F.col(name)), F.greatest(F.struct(end.alias("end"), F.col(name).alias("name")), best))


def _two_least(df: DataFrame, keys: list[str], order: list, end: Column, mine: Column) -> DataFrame:
    """``_best`` and ``_second`` before each row; a new best of another name makes the old one the second."""
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("_best", F.min(mine).over(before))
    lost = F.when(mine.isNotNull(), _loser(F.col("_best"), "_name", end))
    return df.withColumn("_lost", lost).withColumn("_second", F.min("_lost").over(before))


def _holds(*least: str) -> Column:
    """Whether one of these structs ``(end, name)`` has another name than ``_name`` and ends at ``end`` or before."""
    return reduce(Column.__or__, [F.coalesce((F.col(f"{c}.name") != F.col("_name")) & (F.col(f"{c}.end") <= F.col("end")), F.lit(False)) for c in least])


def held_by_others(probes: DataFrame, hits: DataFrame, name: str = "rbp_name", block: int = DEFAULT_BLOCK) -> DataFrame:
    """The distinct ``probes(seq_id, name, start, end)`` that hold a strictly shorter hit of another name.

    A sweep from the right: of all hits that begin further right, or at the same base and are shorter, the least end
    counts, and next to it the least end of any other name, since a probe's own hits do not count.  Both are
    running minima within blocks of positions; a block hands on two rows, so a long sequence is spread over tasks.
    """
    order = [-F.col("start"), F.col("end"), F.col("_hit"), F.col("_name")]
    rows = lambda df, is_hit: df.select("seq_id", F.col(name).alias("_name"), "start", "end", F.lit(is_hit).alias("_hit")).distinct()
    events = rows(probes, 0).unionByName(rows(hits, 1)).withColumn("_block", position_block(-F.col("start"), block))
    events = cut_lineage(events)
    mine = F.when(F.col("_hit") == 1, F.struct("end", F.col("_name").alias("name")))

    local = _two_least(events, ["seq_id", "_block"], order, F.col("end"), mine)
    # what a block hands on: its two best names
    tops = local.filter("_hit = 1").groupBy("seq_id", "_block").agg(F.min(mine).alias("a"), F.min("_lost").alias("b"))
    handed = tops.select("seq_id", "_block", F.explode(F.filter(F.array("a", "b"), lambda x: x.isNotNull())).alias("t"))
    handed = handed.select("seq_id", "_block", F.col("t.end").alias("end"), F.col("t.name").alias("_name"))
    steps = local.select("seq_id", "_block").distinct().withColumns({"end": F.lit(None).cast("bigint"), "_name": F.lit(None).cast("string")})
    given = F.when(F.col("_name").isNotNull(), F.struct("end", F.col("_name").alias("name")))
    carried = _two_least(handed.unionByName(steps), ["seq_id"], ["_block", F.col("end").asc_nulls_first(), "_name"], F.col("end"), given)
    carried = carried.filter("_name is null").select("seq_id", "_block", F.col("_best").alias("_c"), F.col("_second").alias("_d"))
    return local.filter("_hit = 0").join(carried, ["seq_id", "_block"]).filter(_holds("_best", "_second", "_c", "_d")).select("seq_id", F.col("_name").alias(name), "start", "end")


def remove_self_contained(hits: DataFrame, block: int = DEFAULT_BLOCK) -> DataFrame:
    """Drop hits strictly inside the longest hit of their own RBP's cluster, and flag containers.

    Clusters are per sequence and RBP with at least four shared bases; the representative is
    the longest hit, then the first.  A representative that holds hits of its own RBP gets
    ``has_self_submotif``, one that holds hits of another RBP ``has_other_submotif``.  Sequences whose hits lie within
    one width of a block take one shuffle; in all others clusters and containers are found in blocks of positions
    (hits must be four bases long at least).
    """
    hits = cut_lineage(hits)  # read more than once below, so the scan behind it runs once
    near, far = _near_and_far(hits, block)
    kept = _without_contained_near(near)
    return kept if far is None else kept.unionByName(_without_contained_far(far, block))


def _near_and_far(hits: DataFrame, block: int) -> tuple[DataFrame, DataFrame | None]:
    """Stored ``hits`` of sequences whose hits begin within one width of a block, dealt by sequence, and all others.

    The rows of the first are bounded by the width, so one shuffle serves every window over a sequence.
    """
    hits = hits.filter("seq_id is not null and start is not null")
    spans = hits.groupBy("seq_id").agg((F.max("start") - F.min("start")).alias("_span"))
    wide = cut_lineage(spans.filter(F.col("_span") >= block).select("seq_id"))
    if wide.isEmpty():
        return hits.repartition("seq_id"), None
    far = cut_lineage(hits.join(wide, "seq_id", "left_semi").select(*hits.columns))
    return hits.join(wide, "seq_id", "left_anti").select(*hits.columns).repartition("seq_id"), far


def _marked(labelled: DataFrame) -> DataFrame:
    """Hits with their cluster ``_island``, marked as ``_is_rep`` or ``_inside`` it, and ``has_self_submotif``."""
    group = Window.partitionBy("seq_id", "rbp_name", "_island")
    first = F.min(
        F.struct(
            (F.col("start") - F.col("end")).alias("len"),
            F.col("start").alias("start"), F.col("end").alias("end"), F.col("motif").alias("motif"),
        )
    ).over(group)
    with_rep = labelled.withColumn("_rep", first)
    inside = (
        (F.col("start") >= F.col("_rep.start")) & (F.col("end") <= F.col("_rep.end"))
        & (F.col("end") - F.col("start") < F.col("_rep.end") - F.col("_rep.start"))
    )
    is_rep = (
        (F.col("start") == F.col("_rep.start")) & (F.col("end") == F.col("_rep.end"))
        & (F.col("motif") == F.col("_rep.motif"))
    )
    marked = with_rep.withColumns({"_inside": inside, "_is_rep": is_rep})
    return marked.withColumn("has_self_submotif", F.col("_is_rep") & F.max("_inside").over(group))


def _without_contained_near(hits: DataFrame) -> DataFrame:
    """``remove_self_contained`` by windows over sequences; a representative goes in once more to ask what it holds."""
    named = hits.filter("rbp_name is not null")
    marked = _marked(cluster_within(named, ["seq_id", "rbp_name"], slack=-4, tie=["motif"], name="_island"))
    as_hit = F.explode(F.when(F.col("_is_rep"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(1))))
    events = marked.withColumn("_name", F.col("rbp_name")).withColumn("_hit", as_hit)
    mine = F.when(F.col("_hit") == 1, F.struct("end", F.col("_name").alias("name")))
    swept = _two_least(events, ["seq_id"], [-F.col("start"), F.col("end"), F.col("_hit"), F.col("_name")], F.col("end"), mine)
    kept = swept.filter(~F.col("_inside") & ((F.col("_hit") == 0) | ~F.coalesce("_is_rep", F.lit(False))))
    return kept.select(*hits.columns, "has_self_submotif", (F.col("_is_rep") & _holds("_best", "_second")).alias("has_other_submotif"))


def _without_contained_far(hits: DataFrame, block: int) -> DataFrame:
    """``remove_self_contained`` of stored hits in blocks of positions."""
    marked = cut_lineage(_marked(cluster(hits, ["seq_id", "rbp_name"], slack=-4, block=block, name="_island")))
    others = held_by_others(marked.filter("_is_rep"), hits, block=block).withColumn("_other", F.lit(True))
    kept = marked.filter(~F.col("_inside")).join(others, ["seq_id", "rbp_name", "start", "end"], "left")
    return kept.select(
        *hits.columns, "has_self_submotif",
        (F.col("_is_rep") & F.coalesce("_other", F.lit(False))).alias("has_other_submotif"),
    )


def tag_density(hits: DataFrame, slack: int = 5, block: int = DEFAULT_BLOCK) -> DataFrame:
    """Blocks of hits of any RBP at most ``slack`` bases apart; blocks of one are not dense.

    Sequences whose hits lie within one width of a block take one shuffle; in all others clusters are found on
    distinct starts, in blocks of positions, and counted there.
    """
    near, far = _near_and_far(cut_lineage(hits), block)
    size = "n_at_density_block"
    labelled = cluster_within(near, ["seq_id"], slack, name="_island").withColumn(
        size, F.count(F.lit(1)).over(Window.partitionBy("seq_id", "_island"))
    )
    if far is not None:
        labelled = labelled.unionByName(cluster_sizes(far, ["seq_id"], slack, block=block, name="_island", size=size))
    rest = [c for c in hits.columns if c not in ("seq_id", "start")]
    return labelled.select("seq_id", "start", *rest, size, (F.col(size) > 1).alias("is_high_density_region"))


def _as_text(field: str):
    return lambda x: x[field].cast("string")


def merge_duplicate_hits(hits: DataFrame, attributes: Sequence[str]) -> DataFrame:
    """One row per identical span; attributes of the hits joined with ``;`` in RBP, motif order."""
    row = F.struct("rbp_name", "motif", *[c for c in attributes if c not in ("rbp_name", "motif")])
    grouped = hits.groupBy("seq_id", "start", "end").agg(
        F.array_sort(F.collect_list(row)).alias("_r")
    )
    return grouped.select(
        "seq_id", "start", "end",
        *[
            F.array_join(F.transform("_r", _as_text(a)), ";").alias(a)
            for a in attributes
        ],
    )


# ---------------------------------------------------------------- scope and counts

def within_scope(hits: DataFrame, sites: DataFrame, reach: int = 5000) -> DataFrame:
    """Hits inside ``reach`` bases around the cassette exon."""
    lo = F.greatest(F.col("start_exon_cassette") - reach, F.lit(0))
    hi = F.col("end_exon_cassette") + reach
    joined = hits.join(
        sites.select("seq_id", "start_exon_cassette", "end_exon_cassette"), "seq_id"
    )
    return joined.filter((F.col("start") >= lo) & (F.col("end") <= hi)).select(*hits.columns)


def outside_splice_regions(hits: DataFrame, sites: DataFrame, margin: int = 5) -> DataFrame:
    """Drop hits lying within ``margin`` bases before the acceptor or after the donor."""
    joined = hits.join(
        sites.select("seq_id", "start_exon_cassette", "end_exon_cassette"), "seq_id"
    )
    acceptor, donor = F.col("start_exon_cassette"), F.col("end_exon_cassette")
    near = (
        (F.col("start") >= F.greatest(acceptor - margin, F.lit(0))) & (F.col("end") <= acceptor)
    ) | ((F.col("start") >= donor) & (F.col("end") <= donor + margin))
    return joined.filter(~near).select(*hits.columns)


def feature_name(*parts: str) -> Column:
    return F.concat_ws("_", *[F.col(p) for p in parts])


def count_matrix(
    hits: DataFrame, features: Sequence[str], by: Sequence[str] = ("rbp_name",)
) -> DataFrame:
    """Zero-filled counts per sequence for every listed feature, present or not."""
    keyed = hits.select("seq_id", feature_name(*by).alias("_feature"))
    return keyed.groupBy("seq_id").pivot("_feature", list(features)).count().na.fill(0)


def rbp_fractions(hits: DataFrame, keys: Sequence[str], part: str) -> DataFrame:
    """Share of each ``part`` within its keys."""
    sizes = hits.groupBy(*keys, part).agg(F.count(F.lit(1)).alias("n"))
    totals = sizes.groupBy(*keys).agg(F.sum("n").alias("total"))
    return sizes.join(totals, list(keys)).withColumn("fraction", F.col("n") / F.col("total"))
