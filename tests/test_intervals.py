import random

import pytest
from pyspark.sql import functions as F

from exonloom.operators import intervals as iv


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, c string, start long, end long")


# bookended, one shared base, gap 5, gap 6, nested, other chromosome
EDGES = [
    (0, "a", 0, 10), (1, "a", 10, 20), (2, "a", 19, 30), (3, "a", 35, 45), (4, "a", 51, 70), (5, "a", 55, 60), (6, "b", 0, 5), (7, "a", 80, 90),
]


@pytest.mark.parametrize(
    "slack, want",
    [
        (-4, [0, 10, 19, 35, 51, 51, 0, 80]),
        (-1, [0, 10, 10, 35, 51, 51, 0, 80]),
        (0, [0, 0, 0, 35, 51, 51, 0, 80]),
        (5, [0, 0, 0, 0, 51, 51, 0, 80]),
    ],
)
@pytest.mark.parametrize("block", [7, 1 << 16])
def test_cluster_edges(spark, slack, want, block):
    got = iv.cluster(frame(spark, EDGES), ["c"], slack, block=block).orderBy("id").collect()
    assert [r["cluster_start"] for r in got] == want
    near = iv.cluster_within(frame(spark, EDGES), ["c"], slack).orderBy("id").collect()
    assert [r["cluster_start"] for r in near] == want


def random_rows(seed, n=60, span=300):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        s = rng.randrange(span)
        rows.append((i, rng.choice("aab"), s, s + rng.randrange(1, 40)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_joins_against_brute_force(spark, seed):
    left, right = random_rows(seed), random_rows(seed + 50)
    a, b = frame(spark, left), frame(spark, right)
    pairs = {(x[0], y[0], min(x[3], y[3]) - max(x[2], y[2])) for x in left for y in right if x[1] == y[1] and x[2] < y[3] and y[2] < x[3]}
    got = iv.overlap_join(a, b, ["c"], 16).select("id", "id_b", "overlap").collect()
    assert len(got) == len(pairs) and {tuple(r) for r in got} == pairs
    hit = {p[0] for p in pairs}
    assert {r["id"] for r in iv.overlap_exists(a, b, ["c"], block=32).collect()} == hit
    assert {r["id"] for r in iv.overlap_exists(a, b, ["c"], block=32, anti=True).collect()} == {x[0] for x in left} - hit


@pytest.mark.parametrize("seed", [3, 4])
def test_subtract_against_bases(spark, seed):
    left, right = random_rows(seed), random_rows(seed + 50, 12)
    got = iv.subtract(frame(spark, left), frame(spark, right), ["c"], 16, block=32).collect()
    covered = {(y[1], p) for y in right for p in range(y[2], y[3])}
    for x in left:
        want = {p for p in range(x[2], x[3]) if (x[1], p) not in covered}
        mine = [r for r in got if r["id"] == x[0]]
        bases = [p for r in mine for p in range(r["start"], r["end"])]
        assert len(bases) == len(set(bases)) and set(bases) == want
        runs = sum(1 for p in want if p - 1 not in want)
        assert len(mine) == runs


@pytest.mark.parametrize("how", ["before", "after"])
def test_k_nearest_against_brute_force(spark, how):
    left, right = random_rows(7), random_rows(8)
    right += [(100 + i, "a", 120, 130) for i in range(5)]  # copies at one edge
    got = iv.k_nearest(frame(spark, left), frame(spark, right), ["c"], 3, how, "id", block=32).collect()
    want = set()
    for x in left:
        if how == "before":
            near = sorted((y for y in right if y[1] == x[1] and y[3] <= x[2]), key=lambda y: (-y[3], -y[2], y[0]))
        else:
            near = sorted((y for y in right if y[1] == x[1] and y[2] >= x[3]), key=lambda y: (y[2], y[3], y[0]))
        for i, y in enumerate(near[:3], 1):
            want.add((x[0], i, y[0], x[2] - y[3] + 1 if how == "before" else y[2] - x[3] + 1))
    assert {(r["id"], r["idx"], r["id_b"], r["distance"]) for r in got} == want and len(got) == len(want)


def test_merge_keeps_every_row(spark):
    rows = random_rows(9)
    got = iv.merge(frame(spark, rows), ["c"], block=32)
    assert got.agg(F.sum("n_merged")).first()[0] == len(rows)
    for c in "ab":
        islands = sorted((r["start"], r["end"]) for r in got.filter(F.col("c") == c).collect())
        assert all(p[1] < q[0] for p, q in zip(islands, islands[1:]))


def test_remove_overlaps_choices(spark):
    df = frame(spark, EDGES)
    ids = lambda x: sorted(r["id"] for r in x.collect())
    assert ids(iv.remove_overlaps(df, ["c"], ["id"], "longest")) == [0, 2, 3, 4, 6, 7]
    assert ids(iv.remove_overlaps(df, ["c"], ["id"], "first")) == [0, 1, 3, 4, 6, 7]
    assert ids(iv.remove_overlaps(df, ["c"], ["id"], None)) == [0, 3, 6, 7]
    assert ids(iv.remove_overlaps(df, ["c"], ["id"], None, invert=True)) == [1, 2, 4, 5]
    ranked = df.withColumn("rank", F.col("id"))
    assert ids(iv.remove_overlaps(ranked, ["c"], ["id"], "ranked", known=F.col("id") != 2, rank="rank")) == [0, 1, 3, 5, 6, 7]
    with pytest.raises(ValueError):
        iv.remove_overlaps(df, ["c"], ["id"], "shortest")


def test_hot_key_is_split_into_blocks(spark):
    """A third of all rows on one key and one position: still one row per position per block."""
    rows = [(i, "hot", 500, 510) for i in range(3000)] + [(10_000 + i, f"k{i}", i, i + 5) for i in range(6000)]
    got = iv.merge(frame(spark, rows), ["c"])
    assert got.filter("c = 'hot'").collect()[0]["n_merged"] == 3000
    assert got.count() == 6001


def mixed_rows(seed, n=150):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        start = rng.randrange(-5_000, 12_000_000)
        out.append((i, rng.choice("aab"), start, start + rng.choice([0, 1, 10, 63, 64, 65, 512, 4096, 4097, 100_000, 10**6, 10**7, 3 * 10**8])))
    return out


@pytest.mark.parametrize("seed", [5, 6])
def test_overlaps_of_mixed_lengths_against_brute_force(spark, seed):
    left, right = mixed_rows(seed), mixed_rows(seed + 50)
    want = {(x[0], y[0], min(x[3], y[3]) - max(x[2], y[2])) for x in left for y in right if x[1] == y[1] and x[2] < y[3] and y[2] < x[3]}
    got = [tuple(r) for r in iv.overlap_join(frame(spark, left), frame(spark, right), ["c"], 64).select("id", "id_b", "overlap").collect()]
    assert len(got) == len(want) and set(got) == want


def test_a_row_takes_few_seats_whatever_its_length(spark):
    widths = iv._rungs(64)
    df = frame(spark, mixed_rows(7, 3000))
    for guest, home in ((0, 1), (1, 0)):
        made = df.select(F.size(iv._seats("start", "end", widths, guest, home)).alias("n")).agg(F.avg("n"), F.max("n")).first()
        assert made[0] < 10 and made[1] <= 2 * (len(widths) + 1)


def test_cluster_sizes(spark):
    df = frame(spark, random_rows(9, 200)).unionByName(frame(spark, random_rows(9, 5)))
    for block in (16, 1 << 16):
        got = iv.cluster_sizes(df, ["c"], 3, block=block).collect()
        sizes = {}
        for r in got:
            sizes.setdefault((r["c"], r["cluster_start"]), []).append(r["cluster_size"])
        assert len(got) == 205 and all(v == [len(v)] * len(v) for v in sizes.values())
        near = {(r["id"], r["start"], r["cluster_start"]) for r in iv.cluster_within(df, ["c"], 3).collect()}
        assert {(r["id"], r["start"], r["cluster_start"]) for r in got} == near


def _spread_lengths(seed, n=150):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        start = rng.randrange(4000)
        rows.append((rng.choice("ab"), start, start + rng.choice([1, 3, 9, 60, 500, 3000]), i))
    return rows


@pytest.mark.parametrize("longest", [3, 60, 3000])
def test_stored_sides_ask_only_rungs_where_the_other_lives(spark, longest):
    make = lambda rows: spark.createDataFrame(rows, "k string, start long, end long, id long")
    left = [r for r in _spread_lengths(1) if r[2] - r[1] <= longest]
    right = [r for r in _spread_lengths(2) if r[2] - r[1] >= 9]
    want = sorted((a[3], b[3]) for a in left for b in right if a[0] == b[0] and a[1] < b[2] and b[1] < a[2])
    for a, b, turn in ((left, right, 1), (right, left, -1)):
        got = iv.overlap_join(make(a), make(b), ["k"], 4, stored=True).select("id", "id_b").collect()
        assert sorted(tuple(r)[::turn] for r in got) == want
    short = make([("a", 5, 6, 1)])
    seats = lambda hosts: short.select(F.size(iv._seats("start", "end", iv._rungs(4), 0, 1, hosts)).alias("n")).first()["n"]
    assert seats(None) == 8 and seats({0}) == 1 and seats(set()) == 0


def test_points_in_intervals_against_brute_force(spark):
    make = lambda rows: spark.createDataFrame(rows, "k string, start long, end long, id long")
    left, right = _spread_lengths(3), _spread_lengths(4)
    got = iv.point_join(make(left), make(right), ["k"], 4, "start").select("id", "id_b").collect()
    want = sorted((a[3], b[3]) for a in left for b in right if a[0] == b[0] and b[1] <= a[1] < b[2])
    assert sorted(map(tuple, got)) == want


def test_a_place_asks_only_rungs_that_are_lived_on(spark):
    rng = random.Random(8)
    make = lambda rows: spark.createDataFrame(rows, "k string, id bigint, start bigint, end bigint")
    left = make([("a", i, s, s + 1) for i in range(60) for s in [rng.randrange(400)]])
    right = make([("a", i, s, s + rng.choice([0, 3, 30, 300])) for i in range(60) for s in [rng.randrange(400)]] + [("a", 99, None, None)])
    rungs = iv.occupied_rungs(right, 4)
    assert rungs < set(range(8))
    want = iv.point_join(left, right, ["k"], 4, "start").select("id", "id_b")
    got = iv.point_join(left, right, ["k"], 4, "start", rungs=rungs).select("id", "id_b")
    assert sorted(got.collect()) == sorted(want.collect()) and got.count() > 100
    assert iv.point_join(left, right, ["k"], 4, "start", rungs=set()).count() == 0
