"""Counts against brute force, gradients against differences, and held-out likelihood."""

import math
import random
from collections import Counter
from zlib import crc32

import numpy as np
from pyspark.sql import functions as F

from exonloom.llm import lm


def tokens(text):
    return (text or "").encode().lower().split() + [None]


def scored(spark, rows, **options):
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string").repartition(3)
    return lm.fit_and_score(docs, F.crc32(F.col("doc_id").cast("string")) % 7 != 2, **options).collect()


def test_counts_and_base_against_brute_force(spark, monkeypatch):
    rng = random.Random(8)
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(5000)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 60))).upper(), "x") for i in range(200)]
    rows += [(300, None, ""), (301, "", ""), (302, " \t\r\n", ""), (303, "w1 " * 20000 + "é É", ""), (4, "w1 unseen-word", "")]
    c = Counter(t for k, x, _ in rows if crc32(str(k).encode()) % 7 != 2 for t in tokens(x))
    n, v = sum(c.values()), len(c)
    for heavy in (1 << 18, 50):  # all words at hand, or most of them by the join
        monkeypatch.setattr(lm, "HEAVY", heavy)
        got = scored(spark, rows, rounds=2, classes=4, size=4) if heavy == 50 else scored(spark, rows, rounds=2, classes=8, size=8)
        want = sorted(
            (k, len(tokens(x)), sum(c[t] > 0 for t in tokens(x)), n, round(sum(math.log10((c[t] + 1) / (n + v + 1)) for t in tokens(x)), 6)) for k, x, _ in rows
        )
        assert sorted((r[0], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
        assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)


def test_the_model_is_a_distribution_over_next_words():
    shape = lm.Shape(4, 5)
    p = shape.views(lm.start(shape, np.arange(1.0, 17.0)))
    prefix = [3, 7, 7, 12]
    logs = [lm.log_probability(p, np.array([*prefix, w]), np.array([5]))[0] for w in range(16)]
    before = lm.log_probability(p, np.array(prefix), np.array([4]))[0]
    assert abs(sum(math.exp(x - before) for x in logs) - 1) < 1e-4


def test_lanes_and_windows_do_not_matter():
    rng = np.random.default_rng(2)
    shape = lm.Shape(4, 6)
    p = shape.views(lm.start(shape, np.ones(16)))
    n = np.array([5, 0, 120, 1, 33, 64, 65])
    ids = rng.integers(0, 16, n.sum())
    want = lm.log_probability(p, ids, n, lanes=1, steps=1000)
    for lanes, steps in ((3, 7), (512, 32), (2, 1)):
        assert np.allclose(lm.log_probability(p, ids, n, lanes, steps), want, rtol=1e-4)
    ends = np.cumsum(n)
    alone = [lm.log_probability(p, ids[e - m : e], np.array([m]))[0] for e, m in zip(ends, n)]
    assert np.allclose(alone, want, rtol=1e-4)


def test_windows_hold_every_word_once_and_are_full():
    """One long text beside many short ones: the windows follow the words, not the longest text."""
    n = np.array([3, 0, 8000, *[500] * 400, 1])
    starts, total = np.cumsum(n) - n, int(n.sum())
    made = list(lm.windows(np.zeros(total, np.int64), n, 256, 16))
    assert len(made) <= 1.5 * total / (256 * 16) + 3  # were 500
    assert max(at.size for at, _ in made) <= 256 * 16
    assert sorted(np.concatenate([at[at >= 0] for at, _ in made])) == list(range(total))
    assert sorted(np.concatenate([at[fresh] for at, fresh in made])) == sorted(starts[n > 0])
    after = {}
    for at, fresh in made:  # a lane goes on where it was, or starts a text
        for lane in range(at.shape[1]):
            for i, new in zip(at[:, lane], fresh[:, lane]):
                assert i < 0 or new or after[lane] == i
                after[lane] = i + 1
    assert list(lm.windows(np.zeros(0, np.int64), np.zeros(3, np.int64), 4, 4)) == []


def test_gradients_against_differences():
    rng = np.random.default_rng(0)
    shape = lm.Shape(3, 4)
    flat = lm.start(shape, np.ones(9)).astype(np.float64)
    ids, fresh = rng.integers(0, 9, (5, 3)), rng.random((5, 3)) < 0.3
    fresh[0] = True

    def loss(f):
        p = shape.views(f)
        before, _, _ = lm.forward(p, ids, fresh, np.zeros((3, 4)))
        return -lm.output(p, before.reshape(-1, 4), ids.reshape(-1))[0].astype(float).sum()

    p, g = shape.views(flat), np.zeros_like(flat)
    grad = shape.views(g)
    before, _, kept = lm.forward(p, ids, fresh, np.zeros((3, 4)), keep=True)
    _, d = lm.output(p, before.reshape(-1, 4), ids.reshape(-1), grad)
    lm.backward(p, grad, ids, fresh, before, kept, d.reshape(before.shape))
    for i in rng.choice(len(flat), 60, False):
        f = flat.copy()
        f[i] += 1e-2
        up = loss(f)
        f[i] -= 2e-2
        assert abs((up - loss(f)) / 2e-2 - g[i]) < 2e-3


def test_held_out_texts_gain_from_order(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(f"a{j % 5} b{j % 5}" for j in range(rng.randint(0, 9), rng.randint(20, 60))), "") for i in range(6000)]
    got = scored(spark, rows, classes=4, size=8)
    held = [r for r in got if crc32(str(r["doc_id"]).encode()) % 7 == 2]
    assert sum(r["score"] for r in held) > 0.7 * sum(r["base_score"] for r in held)


def test_nothing_to_learn_from(spark):
    assert scored(spark, [(2, None, "x")][:0]) == []
    docs = spark.createDataFrame([(1, "a b"), (None, "c")], "doc_id long, text string")
    got = lm.fit_and_score(docs, F.lit(False)).collect()
    assert sorted((r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in got) == [(2, 0, 0, 0.0), (3, 0, 0, 0.0)]


def test_rounds_part_all_rows(spark):
    """Every text is in one of the rounds; without a rate nothing moves."""
    rows = spark.createDataFrame([(str(i), f"some words {i % 50}") for i in range(300)], "k string, body string").withColumn("body", F.col("body").cast("binary"))
    counts, shape = lm.count_words(rows), lm.Shape(4, 4)
    dealt = rows.select(F.pmod(F.xxhash64("k", "body", F.lit(11)), F.lit(3)).alias("round"))
    assert counts.tokens == 1200 and dealt.groupBy("round").count().count() == 3
    still = lm.train(rows, counts, shape, rounds=3, learner_tokens=100, rate=0.0)
    moved = lm.train(rows, counts, shape, rounds=3, learner_tokens=100)
    assert np.allclose(still, lm.train(rows.limit(0), counts, shape, rounds=1), atol=1e-5) and not np.allclose(still, moved, atol=1e-3)


def test_the_outcome_does_not_depend_on_the_layout(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(f"a{j % 5} b{j % 5}" for j in range(rng.randint(0, 9), rng.randint(20, 60)))) for i in range(400)]
    docs = spark.createDataFrame([*rows, *rows[:20], (None, "a1 b1")], "k string, body string").withColumn("body", F.col("body").cast("binary"))
    counts = lm.count_words(docs)
    made = [lm.train(docs.repartition(n), counts, lm.Shape(4, 4), rounds=2, learner_tokens=2000) for n in (1, 8, 64)]
    assert all(np.allclose(m, made[0], rtol=0, atol=1e-5) for m in made[1:])
