"""Scores of whole texts under a gated recurrent language model trained in numpy.

Words are counted over all training texts.  The most frequent ones form the model's own vocabulary; all
others share one place in it and are told apart there by their counts, so every text has a probability.

The network has one gated recurrent layer and an output softmax in two steps, class then word within the
class, so a word costs two short softmaxes.  Many texts run side by side in lanes, each lane text after
text; the state goes on over the windows of a text and starts anew with the next, so a long text is
scored as a whole.  Training cuts gradients at the ends of windows, which all hold about equally many words.

Training is spread: in a round each task starts from the same parameters, learns from its part of the
texts, and parameters are averaged by the number of words.  Texts are cut into words once, and the rounds read
the places of the words in the vocabulary.

Counts of frequent words (at most ``HEAVY`` of them, as each makes up more than 1/``HEAVY`` of all words) go
to the tasks; other words meet their counts in a join on the word's hash.
"""

from __future__ import annotations

import heapq
import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from exonloom.llm.tokens import END, mix, slices, texts, words
from exonloom.session import cut_lineage

HEAVY = 1 << 18
LN10 = float(np.log(10))


# ------------------------------------------------------------------ the network

@dataclass
class Shape:
    classes: int  # the vocabulary has classes * classes places
    size: int

    @property
    def vocabulary(self) -> int:
        return self.classes * self.classes

    def parts(self) -> list[tuple[str, tuple[int, ...]]]:
        v, c, h = self.vocabulary, self.classes, self.size
        return [("e", (v, 3 * h)), ("u", (h, 3 * h)), ("b", (3 * h,)), ("wc", (h, c)), ("bc", (c,)), ("ww", (c, h, c)), ("bw", (c, c))]

    def views(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        out, at = {}, 0
        for name, shape in self.parts():
            n = int(np.prod(shape))
            out[name] = flat[at : at + n].reshape(shape)
            at += n
        return out

    @property
    def kind(self) -> np.dtype:
        """Of a place in the vocabulary, as stored."""
        return np.dtype(np.uint16 if self.vocabulary <= 1 << 16 else np.int32)

    @property
    def total(self) -> int:
        return sum(int(np.prod(s)) for _, s in self.parts())


def start(shape: Shape, counts: np.ndarray, seed: int = 3) -> np.ndarray:
    """First parameters: the output already gives each place its share of ``counts``."""
    rng = np.random.default_rng(seed)
    flat = np.zeros(shape.total, np.float32)
    p = shape.views(flat)
    for name, scale in (("e", 0.3), ("u", shape.size**-0.5), ("wc", 0.1), ("ww", 0.1)):
        p[name][:] = rng.normal(0, scale, p[name].shape)
    share = np.log(np.maximum(counts, 0.5)).reshape(shape.classes, shape.classes)
    top = np.log(np.exp(share - share.max()).sum(1))
    p["bc"][:], p["bw"][:] = top - top.max(), share - share.max(1)[:, None]
    return flat


def forward(p: dict, ids: np.ndarray, fresh: np.ndarray, h: np.ndarray, keep: bool = False):
    """States before each word of a window (steps x lanes), the state after it, and what backward needs.

    ``fresh`` marks the first word of a text: the state before it is zero.  Inside, lanes come last, so that each
    gate of a step is one run of memory.
    """
    steps, lanes = ids.shape
    n, kind = h.shape[1], p["u"].dtype
    sign = np.repeat(np.array([-1, 1], kind), [2 * n, n])  # gates are 1 / (1 + exp(-x))
    u = np.ascontiguousarray((p["u"] * sign).T)
    if ids.size > len(p["e"]):
        x = ((p["e"] + p["b"]) * sign).take(ids.reshape(-1), axis=0)
    else:
        x = (p["e"].take(ids.reshape(-1), axis=0) + p["b"]) * sign
    x = np.ascontiguousarray(x.reshape(steps, lanes, 3 * n).transpose(0, 2, 1))
    before = np.empty((steps + 1, n, lanes), kind)
    before[0] = h.T
    rec = np.empty((steps if keep else 1, 3 * n, lanes), kind)
    new = fresh.any(1).tolist()
    by_step = zip(before, before[1:], rec if keep else itertools.repeat(rec[0]), x[:, : 2 * n], x[:, :n], x[:, n : 2 * n], x[:, 2 * n :])
    with np.errstate(over="ignore"):  # a gate shut for good
        for t, (a, after, now, gates, z, r, cand) in enumerate(by_step):
            if new[t]:
                a[:, fresh[t]] = 0
            np.matmul(u, a, out=now)
            gates += now[: 2 * n]
            np.exp(gates, out=gates)
            gates += 1
            np.reciprocal(gates, out=gates)
            np.multiply(r, now[2 * n :], out=after)
            cand += after
            np.tanh(cand, out=cand)
            np.subtract(a, cand, out=after)
            after *= z
            after += cand
    return np.ascontiguousarray(before[:-1].transpose(0, 2, 1)), before[-1].T, (x, rec, before) if keep else None


def _softmax(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if x.max(initial=0) > 60 or x.min(initial=0) < -60:
        np.clip(x, -60, 60, out=x)
    np.exp(x, out=x)
    return x, x @ np.ones(x.shape[1], x.dtype)


def output(p: dict, h: np.ndarray, ids: np.ndarray, grad: dict | None = None):
    """Natural log probability of each word given the state before it; with ``grad`` also the gradient of the states."""
    c = p["bc"].shape[0]
    cls = ids // c
    order = np.argsort(cls.astype(np.int16), kind="stable")
    h, cls, word = h.take(order, axis=0), cls[order], (ids - cls * c)[order]
    rows = np.arange(0, len(h) * c, c)
    at_cls, at_word = rows + cls, rows + word
    cuts = np.searchsorted(cls, np.arange(c + 1)).tolist()
    parts = [(k, a, b) for k, (a, b) in enumerate(zip(cuts, cuts[1:])) if a < b]
    x, s = _softmax(h @ p["wc"] + p["bc"])
    y = p["bw"].take(cls, axis=0)
    for k, a, b in parts:
        y[a:b] += h[a:b] @ p["ww"][k]
    y, t = _softmax(y)
    got = np.log(x.reshape(-1)[at_cls] / s * (y.reshape(-1)[at_word] / t))
    out = np.empty_like(got)
    out[order] = got
    if grad is None:
        return out, None
    x /= s[:, None]
    x.reshape(-1)[at_cls] -= 1
    y /= t[:, None]
    y.reshape(-1)[at_word] -= 1
    grad["wc"] += h.T @ x
    grad["bc"] += x.sum(0)
    back = x @ p["wc"].T
    ones = np.ones(len(h), h.dtype)
    for k, a, b in parts:
        part = y[a:b]
        grad["ww"][k] += h[a:b].T @ part
        grad["bw"][k] += ones[a:b] @ part
        back[a:b] += part @ p["ww"][k].T
    d = np.empty_like(back)
    d[order] = back
    return out, d


def backward(p: dict, grad: dict, ids, fresh, before, kept, d_before: np.ndarray) -> None:
    """Gradients through one window; ``d_before`` is that of the states before each word."""
    steps, lanes, n = before.shape
    x, rec, h = kept
    h, z, r, cand = h[:-1], x[:, :n], x[:, n : 2 * n], x[:, 2 * n :]
    d_before = np.ascontiguousarray(d_before.transpose(0, 2, 1))
    of_cand = (1 - z) * (1 - cand * cand)
    by = np.empty((steps, 3, n, lanes), x.dtype)  # what one of the state after a step makes of each gate
    np.multiply((h - cand) * z, 1 - z, out=by[:, 0])
    np.multiply(of_cand, r, out=by[:, 2])
    np.multiply(by[:, 2] * rec[:, 2 * n :], 1 - r, out=by[:, 1])
    dh = np.zeros((steps + 1, n, lanes), x.dtype)
    u, new = np.ascontiguousarray(p["u"]), fresh.any(1).tolist()
    for t in range(steps - 1, -1, -1):
        by[t] *= dh[t + 1]
        now = dh[t]
        np.matmul(u, by[t].reshape(3 * n, lanes), out=now)
        now += dh[t + 1] * z[t]
        now += d_before[t]
        if new[t]:
            now[:, fresh[t]] = 0
    by = by.reshape(steps, 3 * n, lanes)
    grad["u"] += np.matmul(h, by.transpose(0, 2, 1)).sum(0)
    np.multiply(dh[1:], of_cand, out=by[:, 2 * n :])
    g = np.ascontiguousarray(by.transpose(0, 2, 1)).reshape(-1, 3 * n)
    grad["b"] += g.sum(0)
    flat = ids.reshape(-1)
    order = np.argsort(flat.astype(np.int32), kind="stable")
    at = np.flatnonzero(np.diff(flat[order], prepend=-1))
    grad["e"][flat[order[at]]] += np.add.reduceat(g[order], at, axis=0)


# ------------------------------------------------------------------ texts in lanes

#: Lanes at least, where there are texts for them: a step costs little more for them than for one.
FEWEST_LANES = 32


def lanes_of(n: np.ndarray, lanes: int) -> list[np.ndarray]:
    """Texts dealt to lanes, longest first, so that lanes end at about the same step."""
    heap = [(0, k) for k in range(lanes)]
    out = [[] for _ in range(lanes)]
    for i in np.argsort(-n, kind="stable"):
        if n[i]:
            load, k = heap[0]
            out[k].append(i)
            heapq.heapreplace(heap, (load + int(n[i]), k))
    return [np.array(x, np.int64) for x in out if x]


def windows(ids: np.ndarray, n: np.ndarray, lanes: int, steps: int) -> Iterator[tuple]:
    """Windows over texts side by side: places in ``ids`` (-1: none) and marks of first words, steps x lanes.

    A window holds about ``lanes * steps`` words.  There are no more lanes than end about when the longest text does, but
    ``FEWEST_LANES``.  Those still at work come first and their number falls, so ended lanes cost nothing; the fewer they
    are, the more steps a window has.
    """
    most, lanes = lanes * steps, min(lanes, max(FEWEST_LANES, len(ids) // max(int(n.max(initial=0)), 1)))
    starts = np.cumsum(n) - n
    dealt = sorted(lanes_of(n, lanes), key=lambda lane: -n[lane].sum())
    if not dealt:
        return
    listed = np.concatenate(dealt)
    size = np.array([n[lane].sum() for lane in dealt])
    base, first = np.cumsum(size) - size, np.cumsum(n[listed]) - n[listed]
    place = np.arange(int(size.sum())) + np.repeat(starts[listed] - first, n[listed])  # lane after lane
    begins = np.zeros(len(place), bool)
    begins[first] = True
    t, last = 0, int(size[0])
    while t < last:
        live = int((size > t).sum())
        step = np.arange(t, min(t + max(most // live, 1), last))[:, None]
        real = step < size[:live]
        track = np.where(real, base[:live] + step, 0)
        yield np.where(real, place[track], -1), begins[track] & real
        t += len(step)


def log_probability(p: dict, ids: np.ndarray, n: np.ndarray, lanes: int = 512, steps: int = 32) -> np.ndarray:
    """Natural log probability of each text (``n`` words each, end to end in ``ids``)."""
    out = np.zeros(len(ids), np.float32)
    h = np.zeros((0, p["u"].shape[0]), np.float32)
    for at, fresh in windows(ids, n, lanes, steps):
        live = at.shape[1]
        h = np.zeros((live, p["u"].shape[0]), np.float32) if not len(h) else h[:live]
        seen = np.where(at < 0, 0, ids[at])
        before, h, _ = forward(p, seen, fresh, h)
        real = at >= 0
        out[at[real]], _ = output(p, before[real], seen[real])
    ends = np.cumsum(n)
    total = np.concatenate(([0.0], np.cumsum(out, dtype=np.float64)))
    return total[ends] - total[ends - n]


class Trainer:
    """Adam over windows; the state goes on from window to window, gradients do not."""

    def __init__(self, shape: Shape, flat: np.ndarray, rate: float):
        self.shape, self.flat, self.rate = shape, flat.copy(), rate
        self.m, self.v, self.k, self.seen = np.zeros_like(flat), np.zeros_like(flat), 0, 0

    def learn(self, ids: np.ndarray, n: np.ndarray, lanes: int, steps: int) -> None:
        p = self.shape.views(self.flat)
        g = np.empty_like(self.flat)
        grad = self.shape.views(g)
        h = np.zeros((0, self.shape.size), np.float32)
        for at, fresh in windows(ids, n, lanes, steps):
            live = at.shape[1]
            h = np.zeros((live, self.shape.size), np.float32) if not len(h) else h[:live]
            seen, real = np.where(at < 0, 0, ids[at]), at >= 0
            g.fill(0)
            before, h, kept = forward(p, seen, fresh, h, keep=True)
            _, d = output(p, before[real], seen[real], grad)
            full = np.zeros_like(before)
            full[real] = d
            backward(p, grad, seen, fresh, before, kept, full)
            count = max(len(d), 1)
            norm = float(np.sqrt(g @ g)) / count
            g /= count * max(norm, 1)
            self.k += 1
            self.seen += len(d)
            self.m *= 0.9  # sums of gradients, not yet times 0.1, and of squares, not yet times 0.01
            self.m += g
            g *= g
            self.v *= 0.99
            self.v += g
            scale = (1 - 0.99**self.k) ** 0.5 / 0.1
            np.sqrt(self.v, out=g)
            g += 1e-6 * scale
            np.divide(self.m, g, out=g)
            g *= self.rate * 0.1 * scale / (1 - 0.9**self.k)
            self.flat -= g


# ------------------------------------------------------------------ over Spark

#: Tokens that one learner sees between two averages, about, and tasks of a round at most.
LEARNER_TOKENS, MOST_TASKS = 1 << 18, 4096


@dataclass
class Counts:
    """Counts of words: the stored table ``(h, c)``, totals, and the frequent words at hand, sorted by hash."""

    table: DataFrame
    tokens: int
    distinct: int
    heavy: np.ndarray
    heavy_counts: np.ndarray


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of each text and one end after each, and how many."""
    h, n = words(data, offsets)
    return np.insert(h, np.cumsum(n), END), n + 1


def count_words(bodies: DataFrame, heavy: int = HEAVY) -> Counts:
    """Counts over all texts of ``bodies(body binary)``; equal words meet in each slice before the shuffle."""
    def run(batches):
        for batch in batches:
            data, offsets = texts(batch.column("body"))
            for i, j in slices(offsets, 1 << 23):
                h, _ = _tokens(data, offsets[i : j + 1])
                u, c = np.unique(h, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(c)], names=["h", "c"])

    table = cut_lineage(bodies.select("body").mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")))
    row = table.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    top = table.filter(F.col("c") > row["n"] / heavy).toPandas()  # fewer than ``heavy`` rows
    h, c = top["h"].to_numpy(np.int64).view(np.uint64), top["c"].to_numpy(np.int64)
    order = np.argsort(h)
    return Counts(table, row["n"], row["v"], h[order], c[order])


def shortlist(counts: Counts, shape: Shape) -> np.ndarray:
    """For each frequent word its place in the model's vocabulary; 0 stands for all others.

    Places go by count from class to class, so that classes hold about equally likely words.
    """
    order = np.lexsort((counts.heavy, -counts.heavy_counts))[: shape.vocabulary - 1]
    place = np.zeros(len(counts.heavy), np.int32)
    c = shape.classes
    rank = np.arange(1, len(order) + 1)
    place[order] = (rank % c) * c + rank // c
    return place


class _Finder:
    """Places of hashes in a sorted array by a table over their first bits."""

    def __init__(self, sorted_: np.ndarray, bits: int = 20):
        self.sorted, self.shift = sorted_, np.uint64(64 - bits)
        self.first = np.searchsorted(sorted_ >> self.shift, np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.int32)

    def __call__(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.sorted):
            return np.zeros(len(h), np.int32), np.zeros(len(h), bool)
        cell = (h >> self.shift).astype(np.int64)
        at, end = self.first[cell], self.first[cell + 1]
        last = len(self.sorted) - 1
        found = self.sorted[np.minimum(at, last)] == h
        left = np.flatnonzero(~found & (end - at > 1))
        while len(left):
            at[left] += 1
            found[left] = self.sorted[np.minimum(at[left], last)] == h[left]
            left = left[~found[left] & (end[left] - at[left] > 1)]
        return np.minimum(at, last), found


def _placed(dealt: DataFrame, heavy: np.ndarray, place: np.ndarray, shape: Shape) -> DataFrame:
    """Places of the words of each text beside ``round, at``: the rounds then read no texts."""
    sent = dealt.sparkSession.sparkContext.broadcast((heavy, place))

    def run(batches):
        listed, of = sent.value
        find = _Finder(listed)
        for batch in batches:
            data, offsets = texts(batch.column("body"))
            for i, j in slices(offsets, 1 << 23):
                h, n = _tokens(data, offsets[i : j + 1])
                at, known = find(h)
                ids = (np.where(known, of[at], 0) if len(of) else np.zeros(len(h))).astype(shape.kind)
                ends = np.concatenate(([0], np.cumsum(n))) * shape.kind.itemsize
                stored = pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([batch.column("round").slice(i, j - i), batch.column("at").slice(i, j - i), stored], names=["round", "at", "ids"])

    return dealt.select("round", "at", "body").mapInArrow(run, "round long, at long, ids binary")


def train(
    bodies: DataFrame, counts: Counts, shape: Shape, rounds: int = 8, lanes: int = 256, steps: int = 16, rate: float = 0.01,
    learner_tokens: int = LEARNER_TOKENS,
) -> np.ndarray:
    """Parameters after ``rounds`` averages; ``bodies(k, body)`` are all learned from once.

    A text belongs to one round and one learner by a hash of its key and text, and a learner takes its texts in the
    order of another, so the outcome does not depend on how rows are stored or dealt.  There are as many learners as
    the tokens ask for, each with about ``learner_tokens`` a round; a task may hold several and adds them up.  Sums of
    tasks are added in two steps, and only few rows come to the driver.
    """
    spark = bodies.sparkSession
    place = shortlist(counts, shape)
    tally = np.zeros(shape.vocabulary)
    np.add.at(tally, place, counts.heavy_counts)
    tally[0] = max(counts.tokens - tally[1:].sum(), 1)
    flat = start(shape, tally)
    learners = max(1, round(counts.tokens / (rounds * learner_tokens)))
    groups = max(1, round(min(learners, MOST_TASKS) ** 0.5))
    dealt = bodies.withColumns({"round": F.pmod(F.xxhash64("k", "body", F.lit(11)), F.lit(rounds)), "at": F.xxhash64("k", "body", F.lit(12))})
    stored = cut_lineage(_placed(dealt, counts.heavy, place, shape))
    for turn in range(rounds):
        sent = spark.sparkContext.broadcast(flat)

        def run(batches):
            now = sent.value
            total, seen, trainer, last, waiting = np.zeros(len(now)), 0, None, None, []

            def learn():
                n = np.array([len(x) for x in waiting]) // shape.kind.itemsize
                trainer.learn(np.frombuffer(b"".join(waiting), shape.kind).astype(np.int64), n, lanes, steps)
                waiting.clear()

            def finish():
                nonlocal seen
                if waiting:
                    learn()
                total[:] += trainer.flat.astype(np.float64) * trainer.seen
                seen += trainer.seen

            for batch in batches:
                for learner, ids in zip(batch.column("learner").to_pylist(), batch.column("ids")):
                    if learner != last:
                        if trainer is not None:
                            finish()
                        trainer, last, size = Trainer(shape, now, rate), learner, 0
                    waiting.append(ids.as_py())
                    size += len(waiting[-1])
                    if size >= 4 * LEARNER_TOKENS * shape.kind.itemsize:
                        learn()
                        size = 0
            if trainer is not None:
                finish()
                yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary()), pa.array([seen])], names=["value", "seen"])

        def add(frame):
            total = np.zeros(len(flat))
            for x in frame["value"]:
                total += np.frombuffer(x, np.float64)
            return pd.DataFrame({"value": [total.tobytes()], "seen": [frame["seen"].sum()]})

        part = stored.filter(F.col("round") == turn).withColumn("learner", F.pmod(F.xxhash64("at"), F.lit(learners)))
        placed = part.repartition(min(learners, MOST_TASKS), "learner").sortWithinPartitions("learner", "at", "ids")
        made = placed.select("learner", "ids").mapInArrow(run, "value binary, seen long").withColumn("g", F.spark_partition_id() % groups)
        sums = made.groupBy("g").applyInPandas(add, "value binary, seen long").collect()  # one row a group
        seen = sum(r["seen"] for r in sums)
        if seen:
            flat = (sum(np.frombuffer(r["value"], np.float64) for r in sums) / seen).astype(np.float32)
    return flat


def score(docs: DataFrame, counts: Counts, shape: Shape, flat: np.ndarray, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_tokens, n_known, train_tokens, base_score, score`` for every row.

    ``base_score`` is the log10 probability under word counts with one added to each, ``score`` that of the
    model: a word outside its vocabulary has the probability of their common place times its share of their
    counts (one added to each, and one for all unseen words).  Null and empty texts are one end.  Repeated
    rows each give a row; other columns are ignored; an empty table gives an empty result.
    """
    place = shortlist(counts, shape)
    listed = int(counts.heavy_counts[place > 0].sum())
    rest = (counts.tokens - listed) + (counts.distinct - int((place > 0).sum()) + 1)
    sent = docs.sparkSession.sparkContext.broadcast((flat, counts.heavy, counts.heavy_counts, place))
    schema = T.StructType(
        [
            T.StructField("k", docs.schema[key].dataType), T.StructField("row", T.LongType()), T.StructField("n_tokens", T.LongType()),
            T.StructField("known", T.LongType()), T.StructField("base", T.DoubleType()), T.StructField("model", T.DoubleType()),
            T.StructField("others", T.LongType()), T.StructField("h", T.ArrayType(T.LongType(), False)), T.StructField("n", T.ArrayType(T.IntegerType(), False)),
        ]
    )

    def run(batches):
        now, heavy, heavy_counts, of = sent.value
        p, find = shape.views(now), _Finder(heavy)
        logs = np.log10(heavy_counts + 1.0)
        for batch in batches:
            data, offsets = texts(batch.column("body"))
            for i, j in slices(offsets, 1 << 23):
                h, n = _tokens(data, offsets[i : j + 1])
                at, known = find(h)
                if not len(of):
                    at, known = np.zeros(len(h), np.int64), np.zeros(len(h), bool)
                    ids = at
                else:
                    ids = np.where(known, of[at], 0)
                model = log_probability(p, ids, n) / LN10
                ends = np.cumsum(n)

                def per(x, ends=ends, n=n):
                    total = np.concatenate(([0], np.cumsum(x)))
                    return total[ends] - total[ends - n]

                base = np.where(known, logs[at], 0.0) if len(of) else np.zeros(len(h))
                outside = known & (ids == 0)  # frequent, but not in the model's vocabulary
                model += per(np.where(outside, base, 0.0))
                doc = np.repeat(np.arange(len(n), dtype=np.uint64), n)[~known]
                rare = h[~known]
                order = np.lexsort((rare, doc))
                rare, doc = rare[order], doc[order]
                new = np.ones(len(rare), bool)
                new[1:] = (rare[1:] != rare[:-1]) | (doc[1:] != doc[:-1])
                first = np.flatnonzero(new)
                times = np.diff(first, append=len(rare)).astype(np.int32)
                cuts = np.searchsorted(doc[first], np.arange(len(n) + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("k").slice(i, j - i), batch.column("row").slice(i, j - i), pa.array(n), pa.array(per(known)),
                        pa.array(per(base)), pa.array(model), pa.array(per(ids == 0)),
                        pa.ListArray.from_arrays(pa.array(cuts), pa.array(rare[first].view(np.int64))),
                        pa.ListArray.from_arrays(pa.array(cuts), pa.array(times)),
                    ],
                    schema=pa.schema(
                        [("k", batch.schema.field("k").type), ("row", pa.int64()), ("n_tokens", pa.int64()), ("known", pa.int64()), ("base", pa.float64()),
                         ("model", pa.float64()), ("others", pa.int64()), ("h", pa.list_(pa.int64())), ("n", pa.list_(pa.int32()))]
                    ),
                )

    rows = docs.select(F.col(key).alias("k"), F.monotonically_increasing_id().alias("row"), F.col(text).cast("binary").alias("body"))
    scored = cut_lineage(rows.mapInArrow(run, schema))
    rare = scored.select("row", F.explode(F.arrays_zip("h", "n")).alias("x")).select("row", "x.h", "x.n")
    met = rare.join(counts.table.filter(F.col("c") <= counts.tokens / HEAVY), "h")
    sums = met.groupBy("row").agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.log10(F.col("c") + 1.0)).alias("s"))
    more = scored.drop("h", "n").join(sums, "row", "left").na.fill(0, ["m", "s"])
    total = float(np.log10(counts.tokens + counts.distinct + 1))
    return more.select(
        F.col("k").alias(key), "n_tokens", (F.col("known") + F.col("m")).alias("n_known"), F.lit(counts.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.col("s") - F.col("n_tokens") * total).alias("base_score"),
        (F.col("model") + F.col("s") - F.col("others") * float(np.log10(max(rest, 1)))).alias("score"),
    )


def fit_and_score(
    docs: DataFrame, learn: Column, key: str = "doc_id", text: str = "text", classes: int = 32, size: int = 16,
    rounds: int = 8,
) -> DataFrame:
    """Count and train on the rows where ``learn`` holds, then score every row; see ``score`` and ``train``."""
    bodies = docs.filter(F.coalesce(learn, F.lit(False))).select(
        F.col(key).cast("string").alias("k"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("body")
    )
    counts, shape = count_words(bodies), Shape(classes, size)
    return score(docs, counts, shape, train(bodies, counts, shape, rounds), key, text)
