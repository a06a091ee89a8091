"""Toxicity of whole texts by a convolutional classifier trained in numpy.

Words are hashed, together with their beginnings of four, five and six bytes, into one table of
embeddings.  Filters one, two and three words wide run over the text, each keeps its largest answer,
and a logistic unit weighs them.  As only the place of the largest answer gets a gradient, training
costs little more than reading the sample.

The network begins on a few thousand rows; learners in many tasks then go on over all labelled rows, and their moves
are averaged.  Scores are scaled on all rows held back from training so that they can be read as probabilities, and a
threshold is chosen on them for each language.  The language is no input of a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from exonloom.llm.tokens import hashes, slices, spans, texts, unused
from exonloom.session import cut_lineage

BEGINNINGS = (4, 5, 6)
WIDTHS = (1, 2, 3)
SCORE_BYTES = 1 << 19
CHUNK = 1 << 15
#: Texts of one step.
BATCH = 32


@dataclass
class Model:
    table: np.ndarray  # 2**bits x size
    filters: list[np.ndarray]  # for each width: (width * size) x count
    bias: np.ndarray
    out: np.ndarray
    offset: float
    scale: tuple[float, float] = (1.0, 0.0)
    thresholds: dict = field(default_factory=dict)


def features(data: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the table for each word (the word and its beginnings), and the number of words of each text."""
    a, b, n = spans(data, offsets)
    shift = np.uint64(64 - bits)
    ids = [hashes(data, a, b)] + [hashes(data, a, b, most) * np.uint64(0x9E3779B97F4A7C15) for most in BEGINNINGS]
    return np.stack([(h >> shift).astype(np.int32) for h in ids], axis=1), n


def embed(model: Model, ids: np.ndarray) -> np.ndarray:
    out = model.table[ids[:, 0]]
    for k in range(1, ids.shape[1]):
        out += model.table[ids[:, k]]
    return out


def answers(model: Model, x: np.ndarray, room: np.ndarray) -> np.ndarray:
    """What every filter says at every word; ``room`` is the number of words left in its text."""
    wide = [x]
    for w in range(1, max(WIDTHS)):
        moved = np.zeros_like(x)
        moved[:-w] = x[w:]
        moved *= (room > w)[:, None]
        wide.append(moved)
    return np.concatenate(
        [np.concatenate(wide[:w], axis=1) @ f for w, f in zip(WIDTHS, model.filters, strict=True)], axis=1
    )


def pooled(model: Model, ids: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The largest answer of every filter in each text, at least zero (texts without words: zero)."""
    out = np.zeros((len(n), len(model.bias)), np.float32)
    ends = np.cumsum(n)
    owner = np.repeat(np.arange(len(n)), n)
    for s in range(0, len(ids), CHUNK):
        e = min(s + CHUNK, len(ids))
        far = min(e + max(WIDTHS) - 1, len(ids))
        own = owner[s:far]
        z = answers(model, embed(model, ids[s:far]), ends[own] - np.arange(s, far))[: e - s]
        first = np.flatnonzero(np.diff(own[: e - s], prepend=-1))
        docs = own[first]
        out[docs] = np.maximum(out[docs], np.maximum.reduceat(z, first, axis=0) + model.bias)
    return out


def logits(model: Model, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    bits = int(model.table.shape[0]).bit_length() - 1
    out = []
    for i, j in slices(offsets, SCORE_BYTES):
        ids, n = features(data, offsets[i : j + 1], bits)
        out.append(pooled(model, ids, n) @ model.out + model.offset)
    return np.concatenate(out) if out else np.zeros(0, np.float32)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


class Descent:
    """Steps of a model down its gradient, each rate divided by the root of the squares it has seen."""

    def __init__(self, model: Model, rate: float = 0.05, seen: tuple | None = None):
        self.model, self.rate = model, rate
        if seen is None:
            seen = (
                [np.full_like(p, 1e-3) for p in (*model.filters, model.bias, model.out)],
                np.full(model.table.shape[0], 1e-3, np.float32), 1e-3,
            )
        self.seen, self.seen_table, self.seen_offset = seen

    def _move(self, p: np.ndarray, g: np.ndarray, h: np.ndarray) -> None:
        h += g * g
        p -= self.rate * g / np.sqrt(h)

    def _tops(self, ids: np.ndarray, begin: np.ndarray, sizes: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The largest answer of every filter in each text and its place; a long batch is gone over in chunks."""
        model = self.model
        at = np.zeros((len(sizes), len(model.bias)), int)
        top = np.zeros(at.shape, np.float32)
        fresh = np.ones(len(sizes), bool)
        for s in range(0, len(ids), CHUNK):
            e = min(s + CHUNK, len(ids))
            far = min(e + max(WIDTHS) - 1, len(ids))
            z = answers(model, embed(model, ids[s:far]), room[s:far])[: e - s]
            for d in np.flatnonzero((begin < e) & (begin + sizes > s) & (sizes > 0)).tolist():
                lo, hi = max(int(begin[d]), s), min(int(begin[d] + sizes[d]), e)
                part = z[lo - s : hi - s]
                place = part.argmax(0)
                value = part[place, np.arange(part.shape[1])]
                better = fresh[d] | (value > top[d])
                at[d], top[d] = np.where(better, place + lo, at[d]), np.where(better, value, top[d])
                fresh[d] = False
        return at, top

    def step(self, ids: np.ndarray, sizes: np.ndarray, y: np.ndarray, weight: np.ndarray) -> None:
        """One step for texts whose ``ids`` stand one after another, ``sizes`` words each."""
        model, count, size = self.model, len(self.model.bias) // len(WIDTHS), self.model.table.shape[1]
        begin = np.cumsum(sizes) - sizes
        room = np.repeat(begin + sizes, sizes) - np.arange(len(ids))
        at, top = self._tops(ids, begin, sizes, room)
        has = (sizes > 0)[:, None]
        hidden = np.maximum(top + model.bias, 0) * has
        error = ((sigmoid(hidden @ model.out + model.offset) - y) * weight / len(sizes)).astype(np.float32)
        back = error[:, None] * model.out * (hidden > 0)
        grads = [np.zeros_like(f) for f in model.filters]
        dx_rows, dx = [], []
        for i, w in enumerate(WIDTHS):
            part = slice(i * count, (i + 1) * count)
            where, g = at[:, part], back[:, part]
            for o in range(w):
                cell = np.minimum(where + o, max(len(ids) - 1, 0))
                live = g * (room[where] > o) if len(ids) else g * 0
                block = slice(o * size, (o + 1) * size)
                if len(ids):
                    grads[i][block] = np.einsum("df,dfe->ef", live, embed(model, ids[cell.ravel()]).reshape(*cell.shape, size))
                    dx_rows.append(cell.ravel())
                    dx.append((live[:, :, None] * model.filters[i][block].T[None]).reshape(-1, size))
        self._move(model.out, hidden.T @ error, self.seen[-1])
        self._move(model.bias, back.sum(0), self.seen[-2])
        self.seen_offset += float(error.sum()) ** 2
        model.offset -= self.rate * float(error.sum()) / self.seen_offset**0.5
        for f, g, h in zip(model.filters, grads, self.seen, strict=False):
            self._move(f, g, h)
        if dx:
            g = np.concatenate(dx)
            live = np.flatnonzero(np.abs(g).sum(1))
            g, cells = g[live], ids[np.concatenate(dx_rows)[live]]
            cells, g = cells.ravel(), np.repeat(g, cells.shape[1], axis=0)
            u, back_to = np.unique(cells, return_inverse=True)
            total = np.zeros((len(u), size), np.float32)
            np.add.at(total, back_to, g)
            self.seen_table[u] += (total**2).mean(1)
            model.table[u] -= self.rate * total / np.sqrt(self.seen_table[u])[:, None]


def train(
    bodies: list[bytes], y: np.ndarray, bits: int = 16, size: int = 8, count: int = 16, epochs: int = 4, batch: int = BATCH,
    rate: float = 0.05, seed: int = 7, least_steps: int = 400, seen: list | None = None,
) -> Model:
    """Fit the network to texts and labels; both classes weigh the same.  Few texts are gone over more often.

    The squares of the gradients are put into ``seen``, for steps that go on from here.
    """
    rng = np.random.default_rng(seed)
    model = Model(
        (rng.normal(0, 0.03, (1 << bits, size))).astype(np.float32),
        [(rng.normal(0, (w * size) ** -0.5, (w * size, count))).astype(np.float32) for w in WIDTHS],
        np.zeros(count * len(WIDTHS), np.float32), rng.normal(0, 0.3, count * len(WIDTHS)).astype(np.float32), 0.0,
    )
    if not len(bodies) or y.min() == y.max():
        model.out[:] = 0
        model.offset = 0.0 if not len(bodies) else float(6 * y[0] - 3)
        return model
    data, offsets = texts(pa.array(bodies, pa.binary()))
    parts = [features(data, offsets[i : j + 1], bits) for i, j in slices(offsets, SCORE_BYTES)]
    ids, n = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    del parts
    starts = np.cumsum(n) - n
    weight = even_weights(y, y.mean())
    descent = Descent(model, rate)
    for _ in range(max(epochs, -(-least_steps * batch // len(bodies)))):
        order = rng.permutation(len(bodies))
        for k in range(0, len(order), batch):
            docs = order[k : k + batch]
            rows = np.concatenate([np.arange(starts[d], starts[d] + n[d]) for d in docs])
            descent.step(ids[rows], n[docs], y[docs], weight[docs])
    if seen is not None:
        seen[:] = [descent.seen, descent.seen_table, descent.seen_offset]
    return model


def even_weights(y: np.ndarray, share: float) -> np.ndarray:
    """Weights by which both classes weigh the same where ``share`` of all rows are positive."""
    return np.where(y == 1, 0.5 / max(share, 1e-6), 0.5 / max(1 - share, 1e-6))


# ------------------------------------------------------------------ learning from all rows

#: Rows of a learner, the most learners, and the fixed point of their sums.
LEARNER_ROWS, LEARNERS, POINT = 4096, 256, float(1 << 32)
#: Rows of the table in one part of a model that is added up.
PART = 1 << 12


def learn_all(model: Model, seen: list, rows: DataFrame, total: int, share: float, seed: int) -> Model:
    """``model`` after learners that together go once over all ``rows(o, body, y)``, each from ``model`` on.

    A learner has the rows of one hash, in the order of ``o``.  The moves of the learners are averaged, those of a row of
    the table over the learners that moved it.  They are added up in whole numbers, so the result
    depends neither on partitions nor on their order.
    """
    learners = int(np.clip(-(-total // LEARNER_ROWS), 1, LEARNERS))
    dealt = rows.withColumn("learner", F.pmod(F.xxhash64("o", F.lit(seed + 2)), F.lit(learners)))
    dealt = dealt.repartition("learner").sortWithinPartitions("learner", "o", "body")
    sent = rows.sparkSession.sparkContext.broadcast((vars(model), seen))
    bits, size = int(model.table.shape[0]).bit_length() - 1, model.table.shape[1]

    def fresh() -> tuple[Model, Descent]:
        known, (steps, table, offset) = sent.value
        own = Model(**{**known, "table": known["table"].copy(), "filters": [f.copy() for f in known["filters"]], "bias": known["bias"].copy(), "out": known["out"].copy()})
        return own, Descent(own, seen=([x.copy() for x in steps], table.copy(), offset))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start = Model(**sent.value[0])
        moved, times = np.zeros(start.table.shape, np.int64), np.zeros(len(start.table), np.int64)
        dense, done = np.zeros(len(_dense(start)), np.int64), 0
        now, held, own, descent = None, [], None, None

        def flush() -> None:
            if held:
                y = np.array([h[1] for h in held], np.float64)
                descent.step(np.concatenate([h[0] for h in held]), np.array([len(h[0]) for h in held]), y, even_weights(y, share))
                held.clear()

        def leave() -> None:
            nonlocal done, dense
            flush()
            change = np.rint((own.table.astype(np.float64) - start.table) * POINT).astype(np.int64)
            np.add(moved, change, out=moved)
            np.add(times, change.any(axis=1), out=times)
            dense += np.rint((_dense(own) - _dense(start)) * POINT).astype(np.int64)
            done += 1

        for batch in batches:
            data, offsets = texts(batch.column("body"))
            learner, y = batch.column("learner").to_numpy(), batch.column("y").to_numpy()
            for i, j in slices(offsets, SCORE_BYTES):
                ids, n = features(data, offsets[i : j + 1], bits)
                ends = np.cumsum(n)
                for k in range(i, j):
                    if learner[k] != now:
                        if own is not None:
                            leave()
                        now, (own, descent) = learner[k], fresh()
                    held.append((ids[ends[k - i] - n[k - i] : ends[k - i]], y[k]))
                    if len(held) == BATCH:
                        flush()
        if own is None:
            return
        leave()
        parts = [np.concatenate([moved[a : a + PART].ravel(), times[a : a + PART]]) for a in range(0, len(times), PART)]
        for k, part in enumerate([*parts, np.append(dense, done)]):
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([part.tobytes()], pa.binary())], names=["part", "sums"])

    def add(frame):
        sums = np.sum([np.frombuffer(x, np.int64) for x in frame["sums"]], axis=0)
        return frame[:1].assign(sums=[sums.tobytes()])

    made = dealt.select("learner", "body", F.col("y").cast("double")).mapInArrow(run, "part int, sums binary")
    found = {r["part"]: np.frombuffer(r["sums"], np.int64) for r in made.groupBy("part").applyInPandas(add, "part int, sums binary").collect()}
    dense = found.pop(max(found))
    out = Model(**vars(model))
    parts = [found[k] for k in sorted(found)]
    change = np.concatenate([p[: -(len(p) // (size + 1))].reshape(-1, size) for p in parts])
    times = np.concatenate([p[-(len(p) // (size + 1)) :] for p in parts])
    out.table = (model.table + change / POINT / np.maximum(times, 1)[:, None]).astype(np.float32)
    flat, at = _dense(model) + dense[:-1] / POINT / dense[-1], 0
    filters = []
    for f in model.filters:
        filters.append(flat[at : at + f.size].reshape(f.shape).astype(np.float32))
        at += f.size
    n = len(model.bias)
    out.filters, out.bias, out.out = filters, flat[at : at + n].astype(np.float32), flat[at + n : at + 2 * n].astype(np.float32)
    out.offset = float(flat[-1])
    return out


def _dense(model: Model) -> np.ndarray:
    """All parameters but the table, one after another."""
    return np.concatenate([*(f.ravel() for f in model.filters), model.bias, model.out, [model.offset]]).astype(np.float64)


#: Logits are counted in steps of one part of so many, up to this size.
STEPS, FARTHEST = 1024, 60


def logit_counts(rows: DataFrame, model: Model) -> DataFrame:
    """``(lang, z, y, n)``: the positive and all ``rows(body, lang, y)`` of a language at a (rounded) logit."""
    sent = rows.sparkSession.sparkContext.broadcast(vars(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Model(**sent.value)
        for batch in batches:
            z = logits(known, *texts(batch.column("body"))).astype(np.float64)
            step = np.rint(np.clip(z, -FARTHEST, FARTHEST) * STEPS).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("y"), pa.array(step)], names=["lang", "y", "step"])

    made = rows.select("body", "lang", F.col("y").cast("bigint")).mapInArrow(run, T.StructType([rows.schema["lang"], T.StructField("y", T.LongType()), T.StructField("step", T.LongType())]))
    return made.groupBy("lang", "step").agg(F.sum("y").alias("y"), F.count(F.lit(1)).alias("n")).select("lang", (F.col("step") / STEPS).alias("z"), "y", "n")


def rescale(x: np.ndarray, y: np.ndarray, n: np.ndarray | None = None) -> tuple[float, float]:
    """Slope and offset that turn logits into probabilities, by Newton steps with a weak prior.

    ``y`` of ``n`` rows at a logit are positive, of one row if ``n`` is left out.
    """
    n = np.ones(len(x)) if n is None else n
    a, b = 1.0, 0.0
    for _ in range(25):
        p = sigmoid(a * x + b)
        g = np.array([((n * p - y) * x).sum() + 0.1 * (a - 1), (n * p - y).sum() + 0.01 * b])
        r = n * p * (1 - p)
        h = np.array([[(r * x * x).sum() + 0.1, (r * x).sum()], [(r * x).sum(), r.sum() + 0.01]])
        move = np.clip(np.linalg.solve(h, g), -1, 1)
        a, b = max(a - move[0], 0.05), b - move[1]
    return float(a), float(b)


def best_threshold(score: np.ndarray, y: np.ndarray, least: float = 0.5, most: float = 0.9, n: np.ndarray | None = None) -> float:
    """The middle of the scores between which the F1 value is largest, kept inside two bounds; ``y`` and ``n`` as above."""
    order = np.argsort(-score, kind="stable")
    s, t = score[order], y[order]
    rows = np.ones(len(s)) if n is None else n[order]
    if not t.sum():
        return most
    f1 = 2 * np.cumsum(t) / (np.cumsum(rows) + t.sum())
    i = int(f1.argmax())
    after = s[i + 1] if i + 1 < len(s) else 0.0
    return float(np.clip((s[i] + after) / 2, least, most))


def fit(
    docs: DataFrame, labels: DataFrame, learn: Column, key: str = "doc_id", text: str = "text", lang: str = "lang",
    label: str = "toxic", rows: int = 2000, most_bytes: int = 1 << 16, seed: int = 7,
) -> Model:
    """A model from all labelled rows.

    Three quarters of the keys, by a hash, are learned from, the others set the scale of the scores and the thresholds.
    The network begins with steps over at most ``rows`` rows of each class, none of more than ``most_bytes``; learners
    then go on from there over all rows, see ``learn_all``.  Keys are taken in the order of a hash, so nothing depends on how
    rows are stored; of repeated keys the row with the least text counts.  Only labels where ``learn`` (an expression
    on ``key``) holds and that are 0 or 1 are used.  Without labels all scores are one half.
    """
    order = F.xxhash64(F.col(key), F.lit(seed))
    known = labels.filter(learn & F.col(label).isin(0, 1) & F.col(key).isNotNull()).groupBy(F.col(key)).agg(F.max(label).alias("y"))
    known = known.withColumn("check", F.pmod(F.xxhash64(F.col(key), F.lit(seed + 1)), F.lit(4)) == 0).withColumn("o", order)
    body = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("body"), F.col(lang).alias("lang"))
    every = body.join(known, key).groupBy(key, "o", "y", "check").agg(F.min(F.struct("body", "lang")).alias("b"))  # one row of each
    every = cut_lineage(every.select(F.col(key).alias("k"), "o", "y", "check", "b.*"))
    learned, checks = every.filter(~F.col("check")), every.filter("check")
    few = learned.filter(F.octet_length("body") <= most_bytes)
    first = reduce(DataFrame.unionByName, [few.filter(F.col("y") == v).select("k", "o").orderBy("o", "k").limit(rows) for v in (0, 1)])
    got = learned.join(F.broadcast(first.select("k")), "k").select("o", "body", "y").toPandas()  # 2 rows keys at most
    got = got.sort_values(["o", "body"], ignore_index=True)
    seen: list = []
    model = train(list(got["body"]), got["y"].to_numpy(np.float64), seed=seed, seen=seen)
    total, positive = learned.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0))).first()
    if seen and total > len(got):
        model = learn_all(model, seen, learned, total, positive / total, seed)
    counts = logit_counts(checks, model).toPandas().sort_values(["z"], ignore_index=True)
    if len(counts):
        z, y, n = (counts[c].to_numpy(np.float64) for c in ("z", "y", "n"))
        model.scale = rescale(z, y, n)
        score = sigmoid(model.scale[0] * z + model.scale[1])
        model.thresholds[None] = best_threshold(score, y, n=n)
        of = counts["lang"].to_numpy()
        for name in set(of[of != None]):  # noqa: E711
            own = of == name
            if y[own].sum() >= 10:
                model.thresholds[name] = best_threshold(score[own], y[own], n=n[own])
    return model


def score(docs: DataFrame, model: Model, text: str = "text", lang: str | None = "lang") -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and, if ``lang`` is given, ``toxic`` (score against its language's threshold).

    Whole texts are scored.  Null and empty texts have the score of no words.  A null or unknown language has the
    threshold of all.  Columns with the names of results are replaced; repeated rows stay; an empty table
    gives an empty result.
    """
    keep = [c for c in docs.columns if c not in ("score", "toxic")]
    body = unused(docs.columns, "body")
    sent = docs.sparkSession.sparkContext.broadcast(vars(model))  # a fixed number of parameters
    schema = T.StructType([*[docs.schema[c] for c in keep], T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Model(**sent.value)
        for batch in batches:
            data, offsets = texts(batch.column(body))
            z = logits(known, data, offsets).astype(np.float64)
            p = sigmoid(known.scale[0] * z + known.scale[1])
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(p)], names=[*keep, "score"])

    out = docs.select(*keep, F.col(text).cast("binary").alias(body)).mapInArrow(run, schema)
    if lang is None:
        return out
    least = F.lit(model.thresholds.get(None, 0.7))
    for name, value in model.thresholds.items():
        if name is not None:
            least = F.when(F.col(lang) == name, F.lit(value)).otherwise(least)
    return out.withColumn("toxic", F.col("score") >= least)
