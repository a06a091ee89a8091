"""Codes against rounds that compare everything, written with plain Python integers."""

import hashlib
import math
import random

import numpy as np
import pytest

from exonloom.llm import codes, queries


def brute(rows, parts=4, entries=256, rounds=4):
    """``rows`` of (key, vector); the codebooks and (codes, errors) in the order of ``rows``."""
    ints = [[math.floor(1024 * x) for x in v] for _, v in rows]
    width = len(ints[0]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    start = sorted(range(len(rows)), key=lambda i: (rows[i][0], ints[i]))[:entries]
    books = [[list(cut(ints[i], p)) for i in start] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), j) for j, e in enumerate(book))

    for step in range(rounds + 1):
        found = [[nearest(cut(v, p), books[p]) for p in range(parts)] for v in ints]
        if step == rounds:
            return books, [([j for _, j in f], [d for d, _ in f]) for f in found]
        for p in range(parts):
            for j in range(len(books[p])):
                mine = [cut(v, p) for v, f in zip(ints, found) if f[p][1] == j]
                if mine:
                    books[p][j] = [sum(c) // len(mine) for c in zip(*mine)]


def table(spark, rows):
    return spark.createDataFrame([(k, v, la) for k, v, la in rows], "vec_id bigint, embedding array<float>, label int")


def compared(spark, rows, **options):
    got, books = codes.compress(table(spark, rows).repartition(3), "vec_id", "embedding", "label", **options)
    kept = [(k, np.float32(v).tolist()) for k, v, _ in rows]
    want_books, want = brute(kept, **options)
    assert books.tolist() == want_books
    mine = sorted((r["vec_id"], r["codes"], r["errors"]) for r in got.collect())
    assert mine == sorted((k, c, e) for (k, _), (c, e) in zip(kept, want))


def test_random_vectors(spark):
    draw = random.Random(1)
    compared(spark, [(i, [draw.gauss(0, 0.2) for _ in range(8)], i % 3) for i in range(400)], entries=16)


def test_ties_repeated_rows_and_few_rows(spark):
    draw = random.Random(2)
    rows = [(draw.randint(-5, 40), [draw.choice([-0.01, 0.0, 0.01, 0.02]) for _ in range(8)], None) for _ in range(200)]
    compared(spark, rows + rows[:50], entries=12)
    compared(spark, rows[:7], entries=256)


def test_active_comparison_equals_a_whole_one():
    draw = np.random.default_rng(3)
    x = draw.integers(-4, 5, (500, 3))
    old = draw.integers(-4, 5, (20, 3))
    code, far = codes.assign(x, old)
    for share in (0.0, 0.1, 0.5, 1.0):
        new = np.where((draw.random(20) < share)[:, None], draw.integers(-4, 5, (20, 3)), old)
        got = codes.assign(x, new, (new != old).any(1), code, far)
        want = codes.assign(x, new)
        assert np.array_equal(got[0], want[0]) and np.array_equal(got[1], want[1])


def test_only_moved_entries_are_compared(monkeypatch):
    seen, plain = [], codes.distances
    monkeypatch.setattr(codes, "distances", lambda x, e: seen.append((len(x), len(e))) or plain(x, e))
    x, old = np.arange(40).reshape(-1, 1), np.array([[0], [10], [20], [30]])
    code, far = codes.assign(x, old)
    seen.clear()
    codes.assign(x, np.array([[0], [11], [20], [30]]), np.array([False, True, False, False]), code, far)
    at = int((code == 1).sum())
    assert seen == [(at, 4), (40 - at, 1)]


def test_long_vectors_stay_exact(spark):
    draw = random.Random(5)
    compared(spark, [(i, [draw.choice([1.0, 3e4, -3e4]) * draw.random() for _ in range(8)], 1) for i in range(60)], entries=8, rounds=2)


def test_distances_that_fit_no_long_fail_aloud():
    with pytest.raises(OverflowError):
        codes.distances(np.array([[1 << 32]]), np.array([[-(1 << 32)]]))


def test_unusable_vectors_and_clashing_columns(spark):
    rows = [
        (1, [0.1, 0.2, 0.3, 0.4], 1, 5, 5), (2, None, 1, 5, 5), (3, [0.1, None, 0.3, 0.4], 1, 5, 5), (4, [float("nan"), 0.0, 0.0, 0.0], 1, 5, 5),
        (5, [float("-inf"), 0.0, 0.0, 0.0], 1, 5, 5), (6, [], 1, 5, 5), (7, [0.5] * 8, 1, 5, 5), (None, [-0.1, 0.0, 0.0, 0.0], None, 5, 5),
    ]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int, v int, code int")
    got, books = codes.compress(df, "vec_id", "embedding", "label")
    assert sorted((r["vec_id"] or 0, r["codes"], r["errors"]) for r in got.collect()) == [(0, [0] * 4, [0] * 4), (1, [1] * 4, [0] * 4)]
    assert books.shape == (4, 2, 1) and books[:, 0, 0].tolist() == [-103, 0, 0, 0]
    with pytest.raises(ValueError, match="no 3 equal parts"):
        codes.compress(df, "vec_id", "embedding", "label", parts=3)


def test_query_on_small_and_empty_tables(spark, tmp_path):
    draw = random.Random(6)
    rows = [(i, [draw.gauss(0, 0.2) for _ in range(8)], draw.choice([None, 1, 2])) for i in range(300)]
    table(spark, rows).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {r["vec_id"]: r for r in queries.op12_vector_codes(spark, str(tmp_path)).collect()}
    books, want = brute([(k, np.float32(v).tolist()) for k, v, _ in rows])
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    per = {}
    for (_, _, la), (_, e) in zip(rows, want):
        per[la] = per.get(la, 0) + sum(e)
    for (k, _, la), (c, e) in zip(rows, want):
        assert got[k]["code"] == "".join(f"{x:02x}" for x in c) and got[k]["error"] == sum(e)
        assert got[k]["label_error"] == per[la] and got[k]["codebooks_sha256"] == digest
    table(spark, []).write.parquet(str(tmp_path / "none" / "embeddings.parquet"))
    assert queries.op12_vector_codes(spark, str(tmp_path / "none")).collect() == []
