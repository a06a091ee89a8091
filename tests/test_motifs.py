import hashlib
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from exonloom.functions import sequence as fs
from exonloom.operators import location as lo
from exonloom.operators import motifs as mo
from exonloom.operators import perturb as pe
from exonloom.operators import sequences as sq
from exonloom.sources.motifs import pwm_rows
from exonloom.sources.sequences import chunk_sequences


def seqs(spark, texts):
    return spark.createDataFrame([(f"s{i}", t) for i, t in enumerate(texts)], "seq_id string, seq string")


def rand_dna(seed, n=400):
    rng = random.Random(seed)
    return "".join(rng.choice("ACGT") for _ in range(n))


def motifs(spark, rows):
    return spark.createDataFrame(rows, "rbp_name string, motif string")


def test_scan_is_left_to_right_without_overlap(spark):
    table = motifs(spark, [("R", "AAA"), ("S", "AAA"), ("R", "AGA")])
    texts = ["AAAAAA", "xAGAGAGA", "", rand_dna(1), rand_dna(2)]
    want = {
        (f"s{i}", r, m, x.start(), x.end())
        for i, t in enumerate(texts) for r, m in [("R", "AAA"), ("S", "AAA"), ("R", "AGA")] for x in re.finditer(re.escape(m), t)
    }
    for got in (
        mo.scan_exact(seqs(spark, texts), table),
        mo.scan_exact(seqs(spark, texts), table, limit=1),  # too large to ship: joined
        mo.scan_by_join(seqs(spark, texts), table),
    ):
        rows = [tuple(r) for r in got.select("seq_id", "rbp_name", "motif", "start", "end").collect()]
        assert len(rows) == len(want) and set(rows) == want


def test_automaton_agrees_with_search(spark):
    words = ["".join(p) for p in itertools.product("ACGT", repeat=4)]
    owners = {w: ["R"] for w in words}
    text = rand_dna(5, 300) + "A" * 30
    got = {(r["motif"], r["start"]) for r in mo.scan_dictionary(seqs(spark, [text]), owners).collect()}
    assert got == {(w, m.start()) for w in words for m in re.finditer(w, text)}


def hits(spark, rows):
    return spark.createDataFrame(rows, "seq_id string, rbp_name string, motif string, start long, end long")


def test_self_contained_hits(spark):
    df = hits(spark, [
        ("s", "A", "AAAAAAA", 10, 17), ("s", "A", "AAAAA", 11, 16), ("s", "B", "CCCCC", 12, 17), ("s", "B", "GGGGG", 40, 45), ("s", "C", "GGGGG", 40, 45),
    ])
    got = {(r["rbp_name"], r["start"]): (r["has_self_submotif"], r["has_other_submotif"]) for r in mo.remove_self_contained(df).collect()}
    assert got == {
        ("A", 10): (True, True), ("B", 12): (False, False), ("B", 40): (False, False), ("C", 40): (False, False),
    }


def random_hits(seed, n=300, span=400):
    rng = random.Random(seed)
    rows = set()
    for _ in range(n):
        start = rng.randrange(span)
        rows.add((rng.choice("sst"), rng.choice("ABCD"), "m", start, start + rng.choice([5, 5, 6, 8, 13, 40])))
    return sorted(rows)


@pytest.mark.parametrize("block", [8, 64, 1 << 16])
def test_containers_of_other_names_against_brute_force(spark, block):
    rows = random_hits(block)
    probes, held = rows[::2], rows
    want = {
        (p[0], p[1], p[3], p[4]) for p in probes for h in held
        if p[0] == h[0] and p[1] != h[1] and p[3] <= h[3] and h[4] <= p[4] and h[4] - h[3] < p[4] - p[3]
    }
    got = mo.held_by_others(hits(spark, probes), hits(spark, held), block=block).select("seq_id", "rbp_name", "start", "end").collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_one_long_sequence_is_spread_and_gives_the_same(spark):
    df = hits(spark, [("s", *r[1:]) for r in random_hits(3, 500, 3000)]).dropDuplicates()
    rows = lambda d: sorted(tuple(r) for r in d.collect())
    assert rows(mo.remove_self_contained(df, 64)) == rows(mo.remove_self_contained(df))
    assert rows(mo.tag_density(df, block=64)) == rows(mo.tag_density(df))
    # blocks are keys of the shuffle, so one sequence goes to many tasks
    assert mo.held_by_others(df, df, block=64)._jdf.queryExecution().executedPlan().toString().count("_block") > 2


def test_short_sequences_take_no_joins_and_long_ones_beside_them_agree(spark, monkeypatch):
    long = [("w", *r[1:]) for r in random_hits(5, 200, 900)]
    short = [(f"{r[0]}{r[3] % 3}", *r[1:3], r[3] % 60, r[3] % 60 + r[4] - r[3]) for r in random_hits(6, 200)]
    rows = lambda d: sorted(tuple(r) for r in d.collect())
    mixed = hits(spark, long + short).dropDuplicates()
    want = rows(mo._without_contained_far(mixed, 64))  # every sequence in blocks of positions
    assert rows(mo.remove_self_contained(mixed, 64)) == want
    dense = rows(mo.tag_density(mixed, block=64))
    monkeypatch.setattr(mo, "held_by_others", None)
    monkeypatch.setattr(mo, "cluster", None)
    monkeypatch.setattr(mo, "cluster_sizes", None)
    assert rows(mo.remove_self_contained(mixed)) == want and rows(mo.tag_density(mixed)) == dense
    plan = mo.remove_self_contained(mixed)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan


def test_density_blocks(spark):
    df = hits(spark, [("s", "A", "m", 0, 5), ("s", "B", "m", 10, 15), ("s", "A", "m", 21, 26), ("t", "A", "m", 0, 5)])
    got = {(r["seq_id"], r["start"]): (r["n_at_density_block"], r["is_high_density_region"]) for r in mo.tag_density(df).collect()}
    assert got == {("s", 0): (2, True), ("s", 10): (2, True), ("s", 21): (1, False), ("t", 0): (1, False)}


def test_locations_of_an_exon(spark):
    """Exon [10, 20): one row per label."""
    spans = [(12, 15), (10, 13), (11, 14), (17, 20), (8, 12), (18, 22), (8, 22), (2, 6)]
    df = hits(spark, [("s", "R", "m", a, b) for a, b in spans])
    sites = spark.createDataFrame(
        [("s", None, None, 10, 20, None, None, 100)],
        "seq_id string, start_exon_upstream long, end_exon_upstream long, start_exon_cassette long, end_exon_cassette long, start_exon_downstream long, end_exon_downstream long, n long",
    )
    got = sorted((r["start"], r["end"], r["location"], r["distance_to_cassette_acceptor"]) for r in lo.locate(df, sites, "n").collect())
    assert got == sorted([
        (12, 15, "Exon_cassette_fully_contained", 2), (10, 13, "Exon_cassette_acceptor_region", 0), (11, 14, "Exon_cassette_acceptor_region", 1),
        (17, 20, "Exon_cassette_donor_region", 7), (8, 12, "Exon_cassette_acceptor_region", 0), (18, 22, "Exon_cassette_donor_region", 8),
        (8, 22, "Exon_cassette_fully_contained", 0), (2, 6, "Intron_upstream", 5),
    ])


def test_short_exon_gets_both_regions(spark):
    df = hits(spark, [("s", "R", "m", 10, 14)])
    sites = spark.createDataFrame(
        [("s", 1, 3, 10, 15, 30, 40, 60)],
        "seq_id string, start_exon_upstream long, end_exon_upstream long, start_exon_cassette long, end_exon_cassette long, start_exon_downstream long, end_exon_downstream long, n long",
    )
    assert sorted(r["location"] for r in lo.locate(df, sites, "n").collect()) == ["Exon_cassette_acceptor_region", "Exon_cassette_donor_region"]


def test_perturbations_rebuild_the_sequence(spark):
    text = rand_dna(3, 60)
    s = seqs(spark, [text])
    df = hits(spark, [("s0", "A", text[0:5], 0, 5), ("s0", "B", text[0:5], 0, 5), ("s0", "A", text[20:27], 20, 27)])
    dels = {r["id"]: r["seq"] for r in pe.deletions(df, s).collect()}
    assert dels == {"s0_DEL_0_5": text[5:], "s0_DEL_20_27": text[:20] + text[27:]}
    assert pe.deletion_metadata(df).count() == 3
    snv = pe.motif_substitutions(df.filter("rbp_name = 'A'"), s).collect()
    assert len(snv) == 3 * (5 + 7)
    for r in snv:
        assert sum(a != b for a, b in zip(r["seq"], text)) == 1 and r["seq"][r["start"]] == r["mutation"]
    assert {r["motif_start"] for r in snv} == {0, 20}
    whole = pe.sequence_substitutions(seqs(spark, ["ACNGT"])).collect()
    assert len(whole) == 12 and all(r["start"] != 2 for r in whole)
    # the same positions on every run; rows come back in no stated order
    sampled = [sorted(pe.sequence_substitutions(s, exclude=(10, 20), sample=6, with_sequence=False).collect()) for _ in range(2)]
    assert sampled[0] == sampled[1] and len(sampled[0]) == 18
    with pytest.raises(ValueError):
        pe.sequence_substitutions(s, exclude=(0, 3))


def test_extraction(spark):
    bases = rand_dna(4, 1000)
    genome = chunk_sequences(spark.createDataFrame([("c1", bases), ("c2", "N" * 50)], "seq_id string, seq string"), 64)
    assert genome.filter("chrom = 'c1'").count() == 16
    rows = [(0, "c1", 10, 500, "+"), (1, "c1", 10, 500, "-"), (2, "c1", 990, 1010, "+"), (3, "c2", 0, 20, "+"), (4, "c1", -5, 20, "+"), (5, "c1", 64, 128, "+")]
    df = spark.createDataFrame(rows, "id int, chrom string, start long, end long, strand string")
    got = {r["id"]: r["seq"] for r in sq.extract(df, genome, 64).collect()}
    rc = bases[10:500][::-1].translate(str.maketrans("ACGT", "TGCA"))
    assert got == {0: bases[10:500], 1: rc, 2: None, 3: None, 4: None, 5: bases[64:128]}
    ext = sq.extend_existing(
        spark.createDataFrame([("c1", 100, 110, "-", "TTT")], "chrom string, start long, end long, strand string, seq string"), genome, 64, 5
    ).first()["seq"]
    flip = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    assert ext == flip(bases[110:115]) + "TTT" + flip(bases[95:100])
    with pytest.raises(Exception, match="chromosome not in the genome"):
        sq.extract(spark.createDataFrame([(0, "c9", 0, 5, "+")], df.schema), genome, 64).collect()


def test_scalars(spark):
    df = spark.createDataFrame([("acgtN",), ("",), (None,), ("GGCC",)], "s string")
    got = df.select(fs.reverse_complement("s"), fs.gc_percent("s"), fs.literal_count("s", F.lit("C"))).collect()
    assert [r[0] for r in got] == ["Nacgt", "", None, "GGCC"]
    assert [r[1] for r in got] == [0.0, None, None, 100.0]
    assert [r[2] for r in got] == [0, 0, None, 2]


def matrix(spark, columns, motif_id="M1"):
    rows = [(motif_id, "R", i, [float(x) for x in c]) for i, c in enumerate(columns)]
    return pwm_rows(spark.createDataFrame(rows, "motif_id string, rbp_name string, pos int, v array<double>"), F.col("v"))


COLUMNS = [[0.8, 0.2, 0, 0], [0, 1, 0, 0], [0.1, 0.1, 0.4, 0.4], [1, 0, 0, 0], [0, 0, 0, 1]]


def test_unambiguous_kmers(spark):
    got = {r["motif"] for r in mo.unambiguous_kmers(matrix(spark, COLUMNS)).collect()}
    assert got == {a + "C" + b + "AT" for a in "AC" for b in "GT"}
    assert mo.unambiguous_kmers(matrix(spark, COLUMNS[:4])).count() == 0


def test_matrix_scan_tail_probability(spark):
    """Hits are exactly the windows whose score is among the p-value share of all words."""
    import math

    text = rand_dna(11, 3000)
    pseudo = 1e-4
    weight = [[round(100 * math.log2((p + pseudo) / (1 + 4 * pseudo) / 0.25)) for p in c] for c in COLUMNS]
    score = lambda w: sum(weight[i]["ACGT".index(b)] for i, b in enumerate(w))
    every = [score("".join(w)) for w in itertools.product("ACGT", repeat=5)]
    p = lambda s: sum(e >= s for e in every) / len(every)
    limit = 0.01
    want = {i for i in range(len(text) - 4) if p(score(text[i : i + 5])) <= limit}
    got = {r["start"] for r in mo.scan_matrices(seqs(spark, [text]), matrix(spark, COLUMNS), limit).collect()}
    assert got == want and want


def test_scope_and_counts(spark):
    df = hits(spark, [("s", "A", "m", 5, 10), ("s", "A", "m", 50, 55), ("t", "B", "n", 1, 5)])
    sites = spark.createDataFrame([("s", 52, 60), ("t", 0, 9)], "seq_id string, start_exon_cassette long, end_exon_cassette long")
    assert {(r["seq_id"], r["start"]) for r in mo.within_scope(df, sites, 10).collect()} == {("s", 50), ("t", 1)}
    got = {r["seq_id"]: (r["A"], r["B"], r["Z"]) for r in mo.count_matrix(df, ["A", "B", "Z"]).collect()}
    assert got == {"s": (2, 0, 0), "t": (0, 1, 0)}


def test_sampled_positions_are_the_least_hashes_and_few_are_shuffled(spark, monkeypatch):
    monkeypatch.setattr(pe, "POSITIONS_AT_ONCE", 7)
    texts = [("s1", "ACGTNACGTACGTTTACG"), ("s1", "CCCCCCCCCCCC"), ("s2", "AC"), ("s3", ""), ("s4", None), (None, "ACGTACGT")]
    s = spark.createDataFrame(texts, "seq_id string, seq string")
    got = sorted(tuple(r) for r in pe.sample_positions(s.filter("seq_id <> 's1' or seq like 'A%'"), 4, (3, 5)).collect() if r[0])
    want = []
    for name, text in texts[:1] + texts[2:3]:
        for side in (range(min(3, len(text))), range(5, len(text))):
            best = sorted((hashlib.md5(f"{name}|{i}|0".encode()).hexdigest(), i) for i in side)[:2]
            want += [(name, i, text[i]) for _, i in best]
    assert got == sorted(want)
    plan = pe.sample_positions(s, 4, (3, 5))._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan  # the positions of a text are no rows of a shuffle
    assert len(pe.sample_positions(s.filter("seq_id = 's1'"), 4, (3, 5)).collect()) == 4  # of both rows together


def test_substitution_summary_is_that_of_all_rows(spark):
    texts = [("s1", "ACGTNACGTACGTTTACG" * 7), ("s1", "CCCCCCCCCCCC"), ("s2", "AC"), ("s3", ""), ("s4", None), (None, "ACGTACGT"), ("a_b", "T" * 1201)]
    s = spark.createDataFrame(texts, "seq_id string, seq string")
    key = lambda r: (r["seq_id"] or "", r["mutation"])
    for exclude in (None, (3, 101)):
        rows = pe.sequence_substitutions(s, exclude=exclude, with_sequence=False)
        want = rows.groupBy("seq_id", "mutation").agg(
            F.count("*").alias("n"), F.sum("start").alias("positions"), F.min("id").alias("first_id"), F.max("id").alias("last_id")
        ).collect()
        made = pe.substitution_summary(s, exclude)
        assert sorted(made.collect(), key=key) == sorted(want, key=key)
    plan = made._jdf.queryExecution().sparkPlan().toString()
    lowest = [line for line in plan.splitlines() if "Aggregate" in line][-1]
    assert "HashAggregate" in lowest  # no row of a position is sorted


def test_scans_keep_to_small_outputs_and_shuffle_no_windows(spark, monkeypatch):
    monkeypatch.setattr(mo, "HITS_AT_ONCE", 3)
    texts = seqs(spark, ["ACGTACGTAACC", None, "", "TTTTTTTTTT"])
    words = motifs(spark, [("A", "ACGT"), ("B", "ACGT"), ("C", "TTT"), ("D", "CC"), (None, "AA")])
    want = sorted(map(str, mo.scan_by_join(texts, words).collect()))
    assert len(want) == 2 * 2 + 3 + 1 + 1 and want == sorted(map(str, mo.scan_by_join(texts, words, 2).collect()))
    assert sorted(map(str, mo.scan_exact(texts, words).filter("rbp_name is not null").collect())) == [w for w in want if "None" not in w]
    sizes = [b.num_rows for b in mo._hit_rows(mo.pa.array(["a", "b"]), *mo.np.array([[0, 1], [0, 0], [5, 6]]), mo._owner_table(["AC"], {"AC": ["X", "Y"]}))]
    assert sizes == [2, 2]  # owners are joined to a few hits at a time
    plan = mo.scan_by_join(texts, words)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_digests_of_substitutions_without_the_texts(spark):
    texts = [("s", "ACGTAéACGTATTAAAAAAA"), ("s", "GGACGTAC"), ("t", "ACGTA"), ("u", None), (None, "ACGTA")]
    s = spark.createDataFrame(texts, "seq_id string, seq string")
    words = spark.createDataFrame([("A", "ACGTA"), ("B", "AAAAA"), ("B", "AAAAAAA"), ("C", "éACGT")], "rbp_name string, motif string")
    hits = mo.scan_exact(s, words).unionByName(spark.createDataFrame([("u", "A", "ACGTA", 2, 7), ("t", "A", "ACGTA", 3, 8)], "seq_id string, rbp_name string, motif string, start bigint, end bigint"))
    want = pe.motif_substitutions(hits, s).withColumn("seq_md5", F.md5("seq")).drop("seq")
    got = pe.motif_substitution_digests(hits, s, block=4)
    assert got.columns == want.columns
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect())) and got.count() > 100


def test_kmers_of_many_texts_at_once(monkeypatch):
    rng = random.Random(9)
    texts = ["".join(rng.choice(s) for _ in range(rng.randint(0, 60))) for s in ("A", "AC", "ACGT", "ACGTNé") for _ in range(20)]
    for k in (1, 3, 6):
        where, kinds, n = sq.kmer_counts(texts, k)
        names = sq.kmer_names(kinds, k).to_pylist()
        want = {(i, t[j : j + k]): t.count(t[j : j + k]) for i, t in enumerate(texts) for j in range(len(t) - k + 1) if set(t[j : j + k]) <= set("ACGT")}
        assert dict(zip(zip(where.tolist(), names), n.tolist())) == want


def test_matrix_scores_are_looked_up_columns_at_a_time():
    rng = random.Random(4)
    for k in (1, 4, 6, 9):
        weights = [[rng.uniform(-3, 2) for _ in range(4)] for _ in range(k)]
        width, tables, least = mo._loaded_matrix(weights, 0.2)
        steps, low, tail = mo._score_tail(weights)
        assert width == k and len(tables) == -(-k // mo.COLUMNS_AT_ONCE)
        for _ in range(200):
            word = [rng.randrange(5) for _ in range(k)] + [rng.randrange(5) for _ in range(3)]
            score = sum(int(t[sum(x * 5 ** (3 - j) for j, x in enumerate(word[4 * i : 4 * i + 4]))]) for i, t in enumerate(tables))
            plain = 4 not in word[:k] and tail[sum(steps[j][x] for j, x in enumerate(word[:k])) - low] <= 0.2
            assert (score >= least) == plain


def test_substitutions_are_found_where_the_texts_lie(spark, monkeypatch):
    texts = [("s", "ACGTAéACGTATTAAAAAAA"), ("s", "GGACGTAC"), ("t", "ACGTA"), ("u", None), (None, "ACGTA"), ("v", "TTACGTAAAAAACGTA"), ("w", "")]
    s = spark.createDataFrame(texts, "seq_id string, seq string")
    words = spark.createDataFrame([("A", "ACGTA"), ("B", "AAAAA"), ("B", "ACGTA"), ("C", "éACGT"), ("D", None)], "rbp_name string, motif string")
    rows = lambda d: sorted(map(repr, d.collect()))
    for some in (s, s.filter("seq like 'T%' or seq_id = 't'"), s.filter("seq_id is null")):
        hits = mo.scan_exact(some, words)
        want = pe.motif_substitutions(hits, some).withColumn("seq_md5", F.md5("seq")).drop("seq")
        got = pe.motif_substitution_digests(hits, some, block=4, motifs=words)
        assert got.columns == want.columns and rows(got) == rows(want)
    alone = s.filter("seq_id in ('t', 'v')")
    plan = pe.motif_substitution_digests(mo.scan_exact(alone, words), alone, motifs=words)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    monkeypatch.setattr(pe, "REPEATED_AT_MOST", 0)
    hits = mo.scan_exact(s, words)
    assert rows(pe.motif_substitution_digests(hits, s, motifs=words)) == rows(pe.motif_substitution_digests(hits, s))
