import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from exonloom.operators import matching as ma
from exonloom.operators import predict as pr
from exonloom.operators import stats as st
from exonloom.operators import tabular as tb


def test_site_shift(spark):
    rows = [(5, 10, 14), (10, 10, 14), (12, 10, 14), (14, 10, 14), (20, 10, 14)]
    df = spark.createDataFrame(rows, "p long, s long, e long")
    got = df.select(
        pr.shifted_site(F.col("p"), F.col("s"), F.col("e")).alias("a"), pr.shifted_position(F.col("p"), F.col("s"), F.col("e"), F.lit("DEL")).alias("b")
    ).collect()
    assert [r["a"] for r in got] == [5, 10, 10, 10, 16]
    assert [r["b"] for r in got] == [5, None, None, None, 16]


def test_effect_bins_are_right_closed(spark):
    df = spark.createDataFrame([(v,) for v in (-1.0, -0.6, -0.2, 0.0, 0.2, 0.6, 1.0)], "v double")
    assert [r[0] for r in df.select(pr.effect_bin("v")).collect()] == [None, *pr.EFFECT_LABELS]


def test_realign_restores_length(spark):
    df = spark.createDataFrame([("x", "DEL", 2, 4, [1.0, 2.0, 5.0], [0.0, 0.0, 9.0])], "id string, type string, start long, end long, acceptor array<double>, donor array<double>")
    r = pr.realign(df).first()
    assert r["acceptor"] == [1, 2, 0, 0, 5] and r["donor"] == [0, 0, 0, 0, 9]


def test_effect_summary_by_hand(spark):
    ref = [0.0] * 30
    acc, don = ref[:], ref[:]
    acc[10], don[15], acc[25] = 0.9, 0.8, 0.5
    mut_a, mut_d = acc[:], don[:]
    mut_a[10], mut_a[25], mut_d[5] = 0.4, 0.9, 0.6
    refs = spark.createDataFrame([("s", acc, don)], "seq_id string, acceptor array<double>, donor array<double>")
    muts = spark.createDataFrame([("m", "s", "DEL", 18, 20, mut_a, mut_d)], "id string, seq_id string, type string, start long, end long, acceptor array<double>, donor array<double>")
    sites = spark.createDataFrame(
        [("s", None, None, 10, 15, None, None)],
        "seq_id string, start_exon_upstream long, end_exon_upstream long, start_exon_cassette long, end_exon_cassette long, start_exon_downstream long, end_exon_downstream long",
    )
    r = pr.effect_summary(muts, refs, sites).first()
    assert r["acceptor_cassette_effect"] == -0.5 and r["donor_cassette_effect"] == 0.0
    assert r["ref_acceptor_cassette"] == 0.4 and r["acceptor_upstream_effect"] == 0.0
    assert r["other_acceptor_effect"] == [0.4] and r["other_acceptor_affected_position"] == [23]
    assert r["other_acceptor_distance_to_mutation"] == [5]
    assert r["other_donor_effect"] == [0.6] and r["other_donor_affected_position"] == [5] and r["other_donor_distance_to_mutation"] == [13]
    assert r["other_donor_position"] == [5] and r["start_exon_cassette"] == 10


def test_predict_is_batched_and_padded(spark):
    batch = pr.one_hot(["AC", "G"], 3)
    assert batch.shape == (2, 8, 4) and batch[0, 3, 0] == 1 and batch[0, 4, 1] == 1 and batch[1].sum() == 1
    model = lambda b: np.stack([b[:, 3:-3, 0], b[:, 3:-3, 1], b[:, 3:-3, 2]], axis=2)
    scorer = pr.ensemble_scorer(lambda: [model, lambda b: 3 * model(b)], 3)
    df = spark.createDataFrame([("a", "ACG"), ("b", "G"), ("c", "CCCCC")], "seq_id string, seq string")
    got = {r["seq_id"]: (r["acceptor"], r["donor"]) for r in pr.predict(df, scorer, 2).collect()}
    assert got["a"] == ([0, 2, 0], [0, 0, 2]) and got["c"] == ([2] * 5, [0] * 5)


def test_distribution_tails():
    assert st.t_two_sided(2.228, 10) == pytest.approx(0.05, abs=2e-4)
    assert st.t_critical(10) == pytest.approx(2.228139, abs=1e-5)
    assert st.t_critical(1) == pytest.approx(12.7062, abs=1e-3)
    assert st.t_two_sided(1.0, 2) == pytest.approx(1 - 1 / math.sqrt(3), abs=1e-12)
    assert st.binomial_two_sided(3, 10) == pytest.approx(0.34375)
    assert st.binomial_two_sided(5, 10) == pytest.approx(1.0)
    assert st.binomial_two_sided(0, 10) == pytest.approx(2 / 1024)


@pytest.mark.parametrize("blocks", [3, 1024])
def test_ranks_and_quantiles(spark, blocks):
    rng = random.Random(3)
    rows = [(rng.choice("xyy"), float(rng.choice([0, 1, 1, 2, 3.5, 100, 1e6]))) for _ in range(200)]
    df = spark.createDataFrame(rows, "g string, v double")
    p = pd.DataFrame(rows, columns=["g", "v"])
    got = {(r["g"], r["v"]): r["avg_rank"] for r in st.average_ranks(df, ["g"], "v", blocks=blocks).collect()}
    p["r"] = p.groupby("g")["v"].rank()
    assert got == {(g, v): r for g, v, r in p.itertuples(index=False)}
    q = {(r["g"], r["p"]): r["quantile"] for r in st.exact_quantiles(df, ["g"], "v", [0, 0.3, 1], blocks).collect()}
    for (g, prob), value in q.items():
        assert value == pytest.approx(np.quantile(p[p.g == g]["v"], prob))


def test_quantile_bins_follow_duplicate_edges(spark):
    values = [0, 0, 0, 0, 1, 2, 3, 4, 5, 6]
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    want = pd.qcut(pd.Series(values), 5, labels=False, duplicates="drop").tolist()
    got = st.quantile_bins(df, [], "v", 5).orderBy("v").collect()
    assert [r["quantile_bin"] for r in got] == want


def test_mann_whitney_small(spark):
    a, b = [1, 2, 2, 5, 9], [2, 3, 6, 7]
    df = spark.createDataFrame([("a", float(v)) for v in a] + [("b", float(v)) for v in b], "g string, v double")
    r = st.mann_whitney(df, [], "g", "a", "v").first()
    assert r["u"] == sum((x > y) + 0.5 * (x == y) for x in a for y in b)
    assert 0 < r["p_value"] <= 1


def test_holm(spark):
    df = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", 0.005)], "k string, p double")
    got = {r["k"]: round(r["p_holm"], 10) for r in st.holm(df, "p").collect()}
    assert got == {"d": 0.02, "a": 0.03, "c": 0.06, "b": 0.06}


def brute_match(rows, metric):
    p = pd.DataFrame(rows, columns=["g", "role", "o", "t", "a", "b"])
    out = set()
    for g, x in p.groupby("g"):
        c = x[x.role == "CTRL"].sort_values("o").drop_duplicates("t")
        c = c.assign(kind=c.groupby(["a", "b"])["o"].transform("min")).sort_values(["kind", "o"])
        for r in x[x.role == "KD"].sort_values("o").itertuples():
            if c.empty:
                break
            gap = np.abs(c[["a", "b"]].to_numpy(float) - [r.a, r.b])
            d = {"euclidean": np.sqrt((gap**2).sum(1)), "max": gap.max(1), "avg": gap.mean(1), "cityblock": gap.sum(1)}[metric]
            best = int(np.argmin(d))
            out.add((g, r.o, c.o.iloc[best]))
            c = c.drop(c.index[best])
    return out


def match_rows(n, seed):
    rng = random.Random(seed)
    return [
        (rng.choice("pq"), "KD" if rng.random() < 0.4 else "CTRL", i, f"t{i - i % 2 if i > 20 else i}", float(rng.randrange(8)), float(rng.randrange(8)))
        for i in range(n)
    ]


@pytest.mark.parametrize("metric", ["euclidean", "max", "avg", "cityblock"])
def test_greedy_match(spark, metric):
    rows = match_rows(80, 1)
    df = spark.createDataFrame(rows, "g string, role string, o long, t string, a double, b double")
    got = ma.greedy_match(df, "g", "role", "o", "t", ["a", "b"], metric).collect()
    assert {(r["g"], r["kd_order"], r["ctrl_order"]) for r in got} == brute_match(rows, metric)
    assert len({(r["g"], r["ctrl_order"]) for r in got}) == len(got)


def test_greedy_match_by_rounds(spark):
    rows = match_rows(16, 2)
    df = spark.createDataFrame(rows, "g string, role string, o long, t string, a double, b double")
    got = ma.greedy_match(df, "g", "role", "o", "t", ["a", "b"], task_limit=0).collect()
    assert {(r["g"], r["kd_order"], r["ctrl_order"]) for r in got} == brute_match(rows, "euclidean")


def test_difference_matrix_counts_a_missing_group_as_zero(spark):
    rows = [("r", "x", "KD"), ("r", "x", "KD"), ("r", "x", "CTRL"), ("r", "y", "KD"), ("s", "y", "CTRL"), ("t", "other", "KD")]
    got = tb.difference_matrix(spark.createDataFrame(rows, "k string, f string, g string"), "k", "f", "g", ["x", "y"])
    assert sorted(map(tuple, got.collect())) == [("r", 1, 1), ("s", 0, -1), ("t", 0, 0)]


@pytest.mark.parametrize("metric", ["avg", "euclidean", "max"])
def test_contested_controls_in_few_rounds(spark, monkeypatch, metric):
    """All choosers lie beyond all controls along one feature, so that they want the same ones."""
    rng = random.Random(3)
    rows = []
    for i in range(900):
        kd = rng.random() < 0.4
        size = rng.randrange(36, 51) if kd else rng.randrange(0, 36)
        rows.append(("g" if i % 3 else "h", "KD" if kd else "CTRL", i, i, rng.random() * 4, (i * 37) % 101 / 30, size / 15))
    df = spark.createDataFrame(rows, "g string, role string, o long, t long, a double, b double, c double")
    stored = []
    monkeypatch.setattr(ma, "cut_lineage", lambda x, plain=ma.cut_lineage: stored.append(1) or plain(x))
    small = sorted(map(repr, ma.greedy_match(df, "g", "role", "o", "t", ["a", "b", "c"], metric).collect()))
    plain = ma.match_by_rounds
    monkeypatch.setattr(ma, "match_by_rounds", lambda *x: plain(*x, tile_rows=8))
    large = sorted(map(repr, ma.greedy_match(df, "g", "role", "o", "t", ["a", "b", "c"], metric, task_limit=50).collect()))
    assert small == large and len(small) > 300
    assert len(stored) <= 10


def test_rows_are_not_shuffled_to_their_quantile_edges(spark):
    df = spark.range(1000).selectExpr("id % 3 as k", "cast(id % 50 as double) as x")
    plan = st.quantile_bins(df, ["k"], "x", 10)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan


def test_scorers_see_few_bases_and_one_model_at_a_time(spark):
    texts = spark.createDataFrame([(str(i), "ACGT" * 5000) for i in range(24)], "seq_id string, seq string").coalesce(1)

    def model(batch):
        if batch.shape[0] * batch.shape[1] > 1 << 18:
            raise ValueError("a batch of many bases")
        return np.repeat(batch.sum(axis=2)[:, 3:-3, None], 3, axis=2)

    scorer = pr.ensemble_scorer(lambda: [model, lambda b: 2 * model(b)], 3)
    rows = pr.predict(texts, scorer).selectExpr("seq_id", "size(acceptor) n", "aggregate(donor, 0D, (a, x) -> a + x) d").collect()
    assert len(rows) == 24 and {(r["n"], r["d"]) for r in rows} == {(20000, 30000.0)}
