"""The classifier on a made-up language with toxic words and toxic beginnings of words."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from exonloom.llm import toxicity


def corpus(n, seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(3000)]
    rows = []
    for i in range(n):
        w = [rng.choice(words) for _ in range(rng.randint(3, 200))]
        y = int(rng.random() < 0.25)
        for _ in range(y * rng.randint(1, 3)):
            w[rng.randrange(len(w))] = rng.choice(["zzbad", "zzfoul"]) if i % 2 else "qqstem" + rng.choice(words)
        rows.append((i, " ".join(w), "xx" if i % 2 else "yy", y))
    return rows


def test_held_out_documents(spark):
    rows = corpus(2400, 1)
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string").repartition(4)
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows] + [(None, 1), (5, None), (99999, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
    assert set(model.thresholds) == {None, "xx", "yy"}
    truth = {r[0]: r[3] for r in rows}
    got = toxicity.score(docs.withColumn("score", F.lit("clash")), model).withColumn("held", F.crc32(F.col("doc_id").cast("string")) % 3 == 1)
    held = [r for r in got.collect() if r["held"]]
    assert np.mean([(r["score"] >= 0.7) == bool(truth[r["doc_id"]]) for r in held]) > 0.97
    assert np.mean([r["toxic"] == bool(truth[r["doc_id"]]) for r in held]) > 0.97


def test_odd_texts_and_no_labels(spark):
    model = toxicity.train([b"good words here", b"bad zzz words"] * 30, np.array([0.0, 1.0] * 30))
    rows = [(1, None, None), (2, "", "xx"), (3, " \n", "xx"), (None, "zzz " * 50000, "new"), (4, "zzz", "xx"), (4, "zzz", "xx")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = toxicity.score(docs, model).collect()
    assert len(got) == 6 and all(0 <= r["score"] <= 1 for r in got)
    assert len({r["score"] for r in got if r["doc_id"] in (1, 2, 3)}) == 1
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r["score"] for r in toxicity.score(docs, toxicity.fit(docs, none, F.lit(True))).collect()} == {0.5}
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_chunks_give_what_the_whole_gives(monkeypatch):
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["ab", "cd", "ef", "gh"]) for _ in range(rng.randint(0, 40))).encode() for _ in range(60)]
    model = toxicity.train(texts, np.array([float(b"ab cd" in t) for t in texts]), least_steps=20)
    data, offsets = toxicity.texts(pa.array(texts, pa.binary()))
    whole = toxicity.logits(model, data, offsets)
    monkeypatch.setattr(toxicity, "CHUNK", 7)
    monkeypatch.setattr(toxicity, "SCORE_BYTES", 50)
    assert np.allclose(whole, toxicity.logits(model, data, offsets), atol=1e-5)
    one = np.concatenate([toxicity.logits(model, *toxicity.texts(pa.array([t], pa.binary()))) for t in texts])
    assert np.allclose(whole, one, atol=1e-5)


def test_thresholds_and_scale():
    assert toxicity.best_threshold(np.array([0.9, 0.8, 0.2, 0.1]), np.array([1, 1, 0, 0])) == 0.5
    assert toxicity.best_threshold(np.array([0.1, 0.2]), np.array([0, 0])) == 0.9
    x = np.linspace(-3, 3, 200)
    a, b = toxicity.rescale(x, (x > 1).astype(float))
    assert a > 1 and abs(-b / a - 1) < 0.1


def test_learners_go_over_all_rows_whatever_the_partitions(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "LEARNER_ROWS", 200)
    rows = corpus(1600, 3)
    seen = []
    plain = toxicity.learn_all
    monkeypatch.setattr(toxicity, "learn_all", lambda model, kept, of, *x: seen.append(of.count()) or plain(model, kept, of, *x))
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows], "doc_id long, toxic int")
    one, two = (toxicity.fit(docs.repartition(n), labels, F.lit(True), rows=100, most_bytes=600) for n in (1, 7))
    assert seen[0] == seen[1] > 1100  # three quarters of all, long texts too
    assert np.array_equal(one.table, two.table) and one.offset == two.offset and one.thresholds == two.thresholds
    truth = {r[0]: r[3] for r in rows}
    fresh = [(10**6 + i, r[1], r[2], r[3]) for i, r in enumerate(corpus(600, 4))]
    got = toxicity.score(spark.createDataFrame([r[:3] for r in fresh], "doc_id long, text string, lang string"), one).collect()
    truth = {r[0]: r[3] for r in fresh}
    assert np.mean([(r["score"] >= 0.5) == bool(truth[r["doc_id"]]) for r in got]) > 0.9


def test_texts_without_words_are_learned_from(monkeypatch):
    texts = [b"good words here", b"", b"bad zzz words", b" \n"] * 10
    y = np.array([0.0, 0.0, 1.0, 0.0] * 10)
    model = toxicity.train(texts, y, least_steps=20)
    data, offsets = toxicity.texts(pa.array(texts[:4], pa.binary()))
    assert toxicity.logits(model, data, offsets).argmax() == 2
    monkeypatch.setattr(toxicity, "CHUNK", 5)
    parts = toxicity.train(texts, y, least_steps=20)
    assert np.allclose(toxicity.logits(model, data, offsets), toxicity.logits(parts, data, offsets), atol=1e-3)
