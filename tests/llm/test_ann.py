"""Neighbours against brute force."""

import numpy as np
import pytest

from exonloom.llm import ann


def asked(spark, rows, k=20):
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string").repartition(4)
    got = {}
    for r in ann.nearest(table, table.filter("vec_id % 20 = 0"), k=k).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return got


def brute(rows, k=20):
    good = [(i, np.asarray(v, np.float64)) for i, v, _ in rows if i is not None and v and None not in v and np.isfinite(np.float32(v)).all() and np.any(v)]
    out = {}
    for i, q in good:
        if i % 20 == 0:
            s = sorted(((-float(np.float32(v).astype(float) @ np.float32(q).astype(float)), j) for j, v in good if j != i and len(v) == len(q)))[:k]
            out[i] = [(n + 1, j, -x) for n, (x, j) in enumerate(s)]
    return out


@pytest.mark.parametrize("normal", [True, False])
def test_recall(spark, monkeypatch, normal):
    monkeypatch.setattr(ann.index, "__defaults__", ("vec_id", "embedding", 21, 300))
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(8, 24))
    x = centres[rng.integers(0, 8, 1500)] + 0.7 * rng.normal(size=(1500, 24))
    if normal:
        x /= np.linalg.norm(x, axis=1)[:, None]
    rows = [(i, v.astype(np.float32).tolist(), "") for i, v in enumerate(x)]
    got, want = asked(spark, rows), brute(rows)
    assert set(got) == set(want)
    recall = np.mean([len({g[1] for g in got[q]} & {w[1] for w in want[q]}) / 20 for q in want])
    assert recall > 0.95
    for q in want:
        assert [r[0] for r in got[q]] == list(range(1, 21))
        scores = dict(zip((i for i, *_ in rows), x))
        assert all(abs(s - np.float32(scores[v]).astype(float) @ np.float32(scores[q]).astype(float)) < 1e-9 for _, v, s in got[q])


def test_copies_ties_bad_vectors_and_few_candidates(spark):
    hot = [0.5, 0.5, 0.0]
    rows = [(i, hot, "") for i in range(100)] + [(200 + i, [0.1 * i, -1.0, 0.5], "") for i in range(5)]
    rows += [(300, None, ""), (320, [0.0, 0.0, 0.0], ""), (340, [float("nan"), 1.0, 0.0], ""), (360, [1.0, None, 0.0], ""), (380, [float("inf"), 0.0, 0.0], ""), (None, hot, "")]
    rows += [(400, [1.0, 2.0], ""), (401, [1.0, 1.0], ""), (420, [1.0], ""), (440, [], "")]
    got, want = asked(spark, rows), brute(rows)
    assert set(got) == {q for q in want if want[q]}
    for q in got:
        assert [r[:2] for r in got[q]] == [r[:2] for r in want[q]]
        assert np.allclose([r[2] for r in got[q]], [r[2] for r in want[q]])
    assert asked(spark, rows[:0]) == {}


def test_pruning_keeps_different_directions():
    x = np.array([[0, 0], [1, 0], [1.1, 0], [0, 1], [-5, 0]], np.float32)
    kept = ann.robust_prune(x, np.array([0]), np.array([[1, 2, 3, 4, 0, -1, 2]]), 4, 1.2)
    assert kept[0].tolist() == [1, 3, 4, -1]
    graph, entry = ann.build(np.zeros((1, 3), np.float32))
    assert entry == 0 and (graph < 0).all()
