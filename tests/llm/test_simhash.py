"""Fingerprints, links and groups against brute force."""

import random

import xxhash

from exonloom.llm import graph, simhash


def brute_fingerprint(text, size=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    h = [xxhash.xxh64_intdigest(x, 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(nodes, edges):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components_of_a_long_path_a_star_and_noise(spark):
    path = [(i, i + 1) for i in range(60)]
    star = [(100, 100 + i) for i in range(1, 50)]
    edges = path + star + [(7, 7), (60, 59), (200, 201), (None, 3)]
    found = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    want = roots({n for e in edges for n in e if n is not None}, [e for e in edges if None not in e])
    assert found == want
    assert graph.components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    base = " ".join(rng.choice(words) for _ in range(800))
    texts = {i: " ".join(rng.choice(words) for _ in range(rng.randint(1, 40))) for i in range(10, 40)}
    for i in range(40, 60):
        w = base.split()
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = rng.choice(words)
        texts[i] = " ".join(w)
    texts |= {1: None, 2: "", 3: " \t\n\x0b\x0c\r ", 4: "One", 5: "ONE ", 6: "É é", 7: "one two", 8: "x " * 30000, 9: base.upper()}
    rows = [(k, t, "x") for k, t in texts.items()] + [(4, "One", "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string")
    got = simhash.near_duplicates(docs).collect()
    fp = {k: brute_fingerprint(t) for k, t in texts.items()}
    want = roots(fp, [(a, b) for a in fp for b in fp if a < b and (fp[a] ^ fp[b]).bit_count() <= 2])
    assert sorted((r[0], r[1], r[2]) for r in got) == sorted((k, f"{fp[k]:016x}", want[k]) for k, *_ in rows)
    assert {want[k] for k in (1, 2, 3)} == {1}
    assert any(want[k] != k for k in range(41, 60))


def test_near_duplicates_of_null_keys_and_nothing(spark):
    docs = spark.createDataFrame([(None, "a b c"), (5, "a b c"), (None, "only here")], "doc_id long, text string")
    assert sorted(map(str, simhash.near_duplicates(docs).select("doc_id", "component_id").collect())) == sorted(
        ["Row(doc_id=None, component_id=5)", "Row(doc_id=5, component_id=5)", "Row(doc_id=None, component_id=None)"]
    )
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_similar_texts_lose_all_but_one(spark, tmp_path):
    rng = random.Random(9)
    words = [f"v{i}" for i in range(2000)]
    rows, group = [], 0
    for group in range(30):
        w = [rng.choice(words) for _ in range(200)]
        rows.append((len(rows), group, " ".join(w)))
        for _ in range(2):
            x = list(w)
            x[rng.randrange(200)] = "changed"
            rows.append((len(rows), group, " ".join(x)))
    rows += [(1000 + i, 100 + i, " ".join(rng.choice(words) for _ in range(60))) for i in range(40)]
    rows += [(2000, 900, ""), (2001, 900, None), (2002, 901, "two words"), (2002, 901, "two words")]
    spark.createDataFrame(rows, "doc_id long, g long, text string").repartition(3).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    kept = simhash.drop_similar(docs).collect()
    assert sorted(r["g"] for r in kept) == sorted({r[1] for r in rows})
    assert set(map(tuple, kept)) <= set(rows)


def jaccard(a, b, size=5):
    x, y = ({h for part in simhash.shingle_hashes(t.encode(), size) for h in part.tolist()} for t in (a, b))
    return len(x & y) / len(x | y)


def grouped(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "k long, text string")
    return {r["k"]: r["group"] for r in simhash.similar_groups(rows, "k", "text").collect()}


def test_pairs_inside_a_family_of_half_alike_texts(spark):
    rng = random.Random(4)
    make = lambda n: [f"v{rng.randrange(10**6)}" for _ in range(n)]
    frame = make(100)
    texts = [" ".join(frame + make(14)) for _ in range(700)]  # the least rows: about 0.77 alike to all others
    for _ in range(40):
        own = make(14)
        texts += [" ".join(frame + own), " ".join(frame + own[:-5] + make(5))]
    assert jaccard(texts[0], texts[1]) < 0.79 and jaccard(texts[-2], texts[-1]) > 0.9
    of = grouped(spark, texts)
    assert [of[i] for i in range(700)] == list(range(700))
    assert all(of[i] == of[i + 1] for i in range(700, 780, 2))


def test_a_filler_neither_joins_texts_nor_parts_copies(spark):
    rng = random.Random(6)
    make = lambda n: " ".join(f"v{rng.randrange(10**6)}" for _ in range(n))
    own = make(100)
    texts = ["| " * 300 + make(100) for _ in range(30)]  # one shingle makes up most of each
    texts += [own + " |" * n for n in (10, 100, 1000)]
    of = grouped(spark, texts)
    assert [of[i] for i in range(30)] == list(range(30))
    assert {of[i] for i in range(30, 33)} == {30}


def test_pairs_just_above_the_rule_against_brute_force(spark):
    rng = random.Random(8)
    make = lambda n: [f"v{rng.randrange(10**6)}" for _ in range(n)]
    texts = []
    while len(texts) < 1200:
        n = rng.choice([9, 20, 60, 200, 600])
        a = make(n)
        b = a[: n - n // 8] + make(rng.randrange(n // 8 + 1))
        if 0.8 <= jaccard(" ".join(a), " ".join(b)) <= 0.85:
            texts += [" ".join(a), " ".join(b)]
    of = grouped(spark, texts)
    assert sum(of[i] == of[i + 1] for i in range(0, len(texts), 2)) >= 0.99 * len(texts) / 2
    assert len(set(of.values())) >= len(texts) / 2


def test_prefix_links_against_all_pairs(spark):
    """A family of copies with changed words: some pairs just above the rule, most below it."""
    draw = random.Random(8)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for i in range(120):
        words = list(base)
        for _ in range(draw.choice([0, 1, 1, 2, 3, 5])):
            words[draw.randrange(60)] = f"x{draw.randrange(400)}"
        texts.append(" ".join(words[draw.choice([0, 0, 3]) :]))
    rows = spark.createDataFrame(list(enumerate(texts)), "k bigint, t string")
    sets = simhash.shingle_sets(rows, 5)
    none = spark.createDataFrame([], "u bigint, v bigint")
    found = simhash.graph.components(simhash.prefix_links(rows.select("k"), sets, none, 0.8)).collect()
    edges = [(a, b) for a in range(120) for b in range(a) if jaccard(texts[a], texts[b]) >= 0.8]
    want = roots(range(120), edges)
    linked = {n for e in edges for n in e}
    assert len(edges) > 100 and {r["node"]: r["component"] for r in found} == {n: want[n] for n in linked}


def test_groups_meet_in_balls_of_fingerprints(spark):
    """Texts at two or fewer differing bits meet without any draw of least values."""
    rng = random.Random(2)
    make = lambda n: [f"v{rng.randrange(10**6)}" for _ in range(n)]
    texts, near = [], 0
    for i in range(0, 60, 2):
        words = make(900)
        texts += [" ".join(words), " ".join(words[:-1])]
    rows = spark.createDataFrame(list(enumerate(texts)), "k long, t string")
    made = {r["k"]: r for r in simhash.sketches(rows, 5, 0).collect()}
    of = {r["k"]: r["group"] for r in simhash.similar_groups(rows, "k", "t", bands=0).collect()}
    for i in range(0, 60, 2):
        if ((made[i]["fp"] ^ made[i + 1]["fp"]) & (2**64 - 1)).bit_count() <= 2:
            near += 1
            assert of[i] == of[i + 1]
    assert near > 10 and len(set(of.values())) >= 30


def test_components_grow_by_edges(spark):
    rng = random.Random(3)
    first = [(rng.randrange(60), rng.randrange(60)) for _ in range(30)]
    more = [(rng.randrange(80), rng.randrange(80)) for _ in range(20)]
    frame = lambda e: spark.createDataFrame(e, "u long, v long")
    groups = simhash.graph.components(frame(first))
    of = {r["node"]: r["component"] for r in simhash.graph.extended(groups, frame(more)).collect()}
    linked = {n for u, v in first + more if u != v for n in (u, v)}
    want = roots(range(80), first + more)
    assert of == {n: want[n] for n in linked}
    assert simhash.graph.extended(groups, frame([])).count() == groups.count()
    stored, mark = simhash.graph._stored(frame([(1, 0), (2, 1)]))
    assert mark[0] == stored.count() == 2
