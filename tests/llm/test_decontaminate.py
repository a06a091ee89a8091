"""Leaked passages against brute force."""

import random

from exonloom.llm import decontaminate


def brute(text, item):
    d, b = (x.encode().lower().split() for x in (text or "", item or ""))
    n = min(len(b), 13)
    if n < 8:
        return False
    forgiven = 2 if n == 13 else 1
    return any(
        sum(x != y for x, y in zip(d[i : i + n], b[j : j + n])) <= forgiven
        for i in range(len(d) - n + 1)
        for j in range(len(b) - n + 1)
    )


def test_leaks_against_brute_force(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(400)]
    say = lambda n: [rng.choice(words) for _ in range(n)]
    items = {i: say(rng.randint(6, 40)) for i in range(30)}
    docs = {}
    for k in range(300):
        x = say(rng.randint(0, 60))
        if k % 2:
            b = items[rng.randrange(30)]
            part = b[rng.randrange(max(1, len(b) - 13)) :][: rng.randint(8, 20)]
            for _ in range(rng.randint(0, 4)):
                part[rng.randrange(len(part))] = "other"
            at = rng.randrange(len(x) + 1)
            x = x[:at] + part + x[at:]
        docs[k] = " \t".join(x).upper() if k % 3 else "\n".join(x)
    docs |= {500: None, 501: "", 502: " ".join(say(30000) + items[3][:20]), 503: " ".join(items[5])}
    texts = {i: " ".join(x) for i, x in items.items()} | {90: None, 91: "", 92: " ".join(items[5])}
    d = spark.createDataFrame([(k, t, "x") for k, t in docs.items()] + [(503, docs[503], "again")], "doc_id long, text string, items string").repartition(5)
    b = spark.createDataFrame(list(texts.items()), "item_id long, text string")
    got = decontaminate.contaminated(d, b).collect()
    assert len(got) == len(docs) + 1
    for r in got:
        want = sorted(i for i, t in texts.items() if brute(docs[r["doc_id"]], t))
        assert (r["items"], r["contaminated"], r["n_items"]) == (want, bool(want), len(want)), r["doc_id"]
    assert sum(r["contaminated"] for r in got) > 40


def test_null_keys_and_empty_tables(spark, tmp_path):
    item = " ".join(f"word{i}" for i in range(20))
    d = spark.createDataFrame([(None, item), (1, "clean"), (None, "clean too")], "doc_id long, text string")
    b = spark.createDataFrame([(7, item)], "item_id long, text string")
    got = decontaminate.contaminated(d, b).collect()
    assert len(got) == 3 and all(r["items"] == ([7] if r["doc_id"] is None else []) for r in got)
    assert not any(r["contaminated"] for r in decontaminate.contaminated(d, b.limit(0)).collect())
    assert decontaminate.contaminated(d.limit(0), b).count() == 0
    d.write.parquet(str(tmp_path / "d"))
    kept = decontaminate.drop_contaminated(spark.read.parquet(str(tmp_path / "d")), b).collect()
    assert sorted(r["text"] for r in kept) == ["clean", "clean too"]
