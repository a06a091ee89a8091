"""One definition whatever the size: both plans of an operator on odd rows, and readers on several files."""

import os
import random
from math import comb

import numpy as np
import pytest
from pyspark.errors import PySparkException

from exonloom import session
from exonloom.operators import learn, matching, motifs, scan, sequences, stats
from exonloom.sources import motifs as sm
from exonloom.sources import sequences as ss
from exonloom.sources import tables


def rows_of(df):
    return sorted(map(repr, map(tuple, df.collect())))


def brute_hits(seqs, words):
    out = []
    for seq_id, text in seqs:
        for rbp, m in {(r, m) for r, m in words if m}:
            at = (text or "").find(m)
            while at >= 0:
                out.append((seq_id, rbp, m, at, at + len(m)))
                at = text.find(m, at + len(m))
    return sorted(map(repr, out))


@pytest.mark.parametrize("plan", ["shipped", "in parts", "automaton", "join"])
def test_motif_plans_agree(spark, monkeypatch, plan):
    seqs = [("a", "\U0001f600ACGTACGTA"), ("a", "ACGTACGTA"), ("b", None), ("c", ""), ("d", "AAAAAA"), ("d", "AAAAAA\nAAAAA"), (None, "GTAGTA")]
    words = [("R1", "ACGTA"), ("R2", "ACGTA"), ("R1", "AAAAA"), ("R1", ""), ("R1", None), ("R3", "GTA"), ("R3", "GTA"), ("R4", "\U0001f600A")]
    s, m = spark.createDataFrame(seqs, "seq_id string, seq string"), spark.createDataFrame(words, "rbp_name string, motif string")
    if plan == "automaton":
        monkeypatch.setattr(motifs, "AUTOMATON_FROM", 1)
    got = motifs.scan_by_join(s, m) if plan == "join" else motifs.scan_exact(s, m, 2 if plan == "in parts" else 20_000)
    assert rows_of(got) == brute_hits(seqs, words)
    assert motifs.scan_exact(s, m.limit(0)).count() == 0 and motifs.scan_by_join(s, m.limit(0)).count() == 0


def test_matrices_in_parts(spark):
    rng = random.Random(1)
    rows = [(f"M{k}", f"R{k}", i, b, 0.91 if b == rng.choice("ACGT") else 0.03) for k in range(5) for i in range(5) for b in "ACGT"]
    matrices = spark.createDataFrame(rows, "motif_id string, rbp_name string, pos int, base string, p double")
    seqs = spark.createDataFrame([("s", "".join(rng.choice("ACGT") for _ in range(2000)))], "seq_id string, seq string")
    assert rows_of(motifs.scan_matrices(seqs, matrices, 0.01)) == rows_of(motifs.scan_matrices(seqs, matrices, 0.01, limit=2))


def test_matching_plans_agree_with_null_and_equal_features(spark):
    rng = random.Random(3)
    kinds = [rng.random() for _ in range(20)]
    rows = [("g", "KD" if i % 3 == 0 else "CTRL", i, i, rng.choice([*kinds, None, float("nan")]), 1.0) for i in range(90)]
    rows += [("h", "KD", 1, 1, 0.0, 0.0), ("h", "CTRL", 2, 2, None, 0.0), ("h", "CTRL", 3, 3, 0.1, 0.0)]
    df = spark.createDataFrame(rows, "grp string, role string, ord long, target long, a double, b double")
    plans = [matching.greedy_match(df, "grp", "role", "ord", "target", ["a", "b"], task_limit=n) for n in (20_000, 10, 0)]
    want = rows_of(plans[0])
    assert want == rows_of(plans[1]) == rows_of(plans[2])
    assert "('h', 1, 3, 0.1)" in want


def test_matching_plans_agree_on_ties(spark):
    """Whole numbers as features: equal controls, and kinds at equal distances, at every group size."""
    rng = random.Random(11)
    rows = [(g, "KD" if rng.random() < 0.4 else "CTRL", i, i, float(rng.randrange(3)), float(rng.randrange(3))) for i, g in enumerate("gghgi" * 9)]
    df = spark.createDataFrame(rows, "grp string, role string, ord long, target long, a double, b double")
    plans = [rows_of(matching.greedy_match(df, "grp", "role", "ord", "target", ["a", "b"], "cityblock", task_limit=n)) for n in (20_000, 12)]
    assert plans[0] == plans[1]


def test_six_rows_at_one_distance(spark):
    rows = [(0, "KD", 0.0), (1, "KD", 0.0), (5, "KD", 0.0), (2, "CTRL", 1.0), (3, "CTRL", -1.0), (4, "CTRL", 1.0)]
    df = spark.createDataFrame([("g", r, o, o, x, 0.0) for o, r, x in rows], "grp string, role string, ord long, target long, a double, b double")
    for limit in (20_000, 0):
        got = matching.greedy_match(df, "grp", "role", "ord", "target", ["a", "b"], task_limit=limit).collect()
        assert sorted((r["kd_order"], r["ctrl_order"]) for r in got) == [(0, 2), (1, 4), (5, 3)]


def test_readers_on_several_files(spark, tmp_path):
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "1.txt").write_text(">RA|1|\n*ACGUA|GGGGG\n>RB|1|\n*UUUUU\n>RC|1|\n*CCCCC\n")
    (tmp_path / "m" / "2.txt").write_text(">RD|1|\n*AAAAA\nMOUSE\n>RE|1|\n*CCCCC\n")
    got = sm.read_motif_list(spark, str(tmp_path / "m"))
    assert rows_of(got) == sorted(map(repr, [("RA", "ACGTA"), ("RA", "GGGGG"), ("RB", "TTTTT"), ("RC", "CCCCC"), ("RD", "AAAAA")]))
    (tmp_path / "e").mkdir()
    for k in (1, 2):
        (tmp_path / "e" / f"{k}.meme").write_text(f"MEME\n\nMOTIF M{k} R{k}\nmatrix\n 0.1 0.2 0.3 0.4\n 1 0 0 0\nMOTIF N{k} S{k}\n 0 0 0 1\n")
    rows = sm.read_meme(spark, str(tmp_path / "e")).collect()
    assert len(rows) == 24 and {(r["motif_id"], r["rbp_name"], r["pos"]) for r in rows} == {(f"{a}{k}", f"{b}{k}", p) for k in (1, 2) for a, b, p in (("M", "R", 0), ("M", "R", 1), ("N", "S", 0))}


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_fasta_headers_may_hold_the_mark(spark, tmp_path, end):
    (tmp_path / "a.fa").write_bytes(end.join([">NM_1 c.76A>T note", "ACG", "TAC", "", ">x", "", ">y", "GG"]).encode())
    (tmp_path / "b.fa").write_bytes((">z d" + end + "TT" + end).encode())
    assert rows_of(ss.read_fasta(spark, str(tmp_path))) == sorted(map(repr, [("NM_1", "ACGTAC"), ("x", ""), ("y", "GG"), ("z", "TT")]))


def test_a_sequence_without_index_row_fails(spark):
    index = spark.createDataFrame([("h", "t", 1, 2, 3, 4, 5, 6)], "header string, tx_id string, " + ", ".join(f"{c} long" for c in tables.SITE_COLUMNS))
    good = spark.createDataFrame([("h_t",), ("h_t_REF_seq",)], "seq_id string")
    assert tables.match_site_index(good, index).count() == 1
    with pytest.raises(PySparkException, match="no index row for other"):
        tables.match_site_index(good.union(spark.createDataFrame([("other",)], "seq_id string")), index).collect()


def test_correlation_of_labels_that_never_meet(spark):
    rows = [(i, "even" if i % 2 == 0 else "odd") for i in range(20)] + [(i, "all") for i in range(20)] + [(i, "some") for i in (0, 1, 2)]
    got = {(r["label_a"], r["label_b"]): r for r in stats.cooccurrence_correlation(spark.createDataFrame(rows, "item int, label string"), "item", "label").collect()}
    assert abs(got["even", "odd"]["r"] + 1) < 1e-12 and got["even", "odd"]["both"] == 0
    assert not any("all" in k for k in got)
    x = np.array([[i % 2 == 0, i < 3] for i in range(20)], float)
    assert abs(got["even", "some"]["r"] - np.corrcoef(x.T)[0, 1]) < 1e-12


def test_binomial_and_t_values():
    for n in (1, 2, 7, 40):
        for k in range(n + 1):
            pmf = [comb(n, i) * 0.3**i * 0.7 ** (n - i) for i in range(n + 1)]
            assert abs(stats.binomial_two_sided(k, n, 0.3) - min(1, sum(x for x in pmf if x <= pmf[k] * (1 + 1e-7)))) < 1e-10
    assert abs(stats.binomial_two_sided(50_010_000, 10**8) - 0.0455) < 1e-4
    assert abs(stats.t_critical(10.0) - 2.228139) < 1e-5


def test_kmer_table_against_brute_force(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("ACGTN" if i % 2 else "AC") for _ in range(rng.randint(0, 300))) for i in range(30)] + ["AAAAAAAAAAAAA", None, "ACACACACACACAC"]
    df = spark.createDataFrame(list(enumerate(texts)), "seq_id int, seq string")
    want = {
        (i, t[j : j + 6]): (t.count(t[j : j + 6])) for i, t in enumerate(texts) if t for j in range(len(t) - 5) if set(t[j : j + 6]) <= set("ACGT")
    }
    long = sequences.kmer_table(df, 6)
    assert {(r["seq_id"], r["kmer"]): r["n"] for r in long.collect()} == want
    wide = sequences.kmer_matrix(sequences.kmer_table(df, 3), "seq_id", 3)
    assert len(wide.columns) == 65


def test_ranges_are_even_with_an_outlier_and_a_hot_key(spark):
    df = spark.range(20000).selectExpr("'g' as k", "double(id) as v").union(spark.sql("select 'g', 1e12")).union(spark.sql("select 'h', 5.0"))
    blocked = scan.range_blocks(df, ["k"], "v", 16).groupBy("k", "_vblock").agg({"v": "max", "*": "count"}).collect()
    assert max(r["count(1)"] for r in blocked) < 4000 and len(blocked) > 8
    top = sorted((r["_vblock"], r["max(v)"]) for r in blocked if r["k"] == "g")
    assert [v for _, v in top] == sorted(v for _, v in top)


def test_ranks_do_not_depend_on_the_number_of_ranges(spark):
    rng = random.Random(6)
    rows = [(rng.choice("gggh"), rng.choice([1.0, 1.0, rng.random(), 1e12, None])) for _ in range(400)]
    df = spark.createDataFrame(rows, "k string, v double")
    plans = [stats.average_ranks(df, ["k"], "v", blocks=n) for n in (None, 1, 3, 40)]
    want = rows_of(plans[0])
    assert all(rows_of(p) == want for p in plans[1:])


def test_dummy_predictions(spark):
    rows = [(i, float(i % 7), 1.0 if i % 3 else 0.0) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, x double, y double")
    score = sum(learn.cross_validate(df, "dummy", ["x"], "y", "id", 3)) / 3
    assert abs(score - 2 / 3) < 0.05
    assert abs(sum(learn.cross_validate(df, "dummy", ["x"], "y", "id", 3, classify=False))) < 0.1


def test_scratch_tables_are_deleted(spark):
    df = spark.createDataFrame([("g", float(i % 5)) for i in range(30)], "k string, v double")
    with session.scratch(spark) as made:
        rows = rows_of(stats.average_ranks(df, ["k"], "v"))
        inner = list(made)
        assert rows and inner and all(os.path.isdir(p.removeprefix("file:")) for p in inner)
    assert not any(os.path.exists(p.removeprefix("file:")) for p in inner)
    kept = session.cut_lineage(df)  # outside, tables stay
    assert kept.count() == 30
