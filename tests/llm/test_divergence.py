"""Differences of sources against sums over all terms, in plain Python integers."""

import random
import re
from collections import Counter, defaultdict

import pytest

from exonloom.llm import divergence


def fold(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute(rows, least_docs=30, top=50):
    """``rows`` of (lang, source, text)."""
    held, counts, langs = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        words = re.findall(divergence.TERM, fold(text))
        langs[lang].add(source)
        counts[lang, source].update(words)
        held[lang].update(set(words))
    out = []
    for lang, sources in langs.items():
        kept = [t for t, n in held[lang].items() if n >= least_docs]
        share = {}
        for s in (*sources, None):
            c = counts[lang, s] if s is not None else sum((counts[lang, x] for x in sources), Counter())
            total = sum(c[t] for t in kept)
            share[s] = {t: 1 + 10**9 * (c[t] + 5) // (total + 5 * len(kept)) for t in kept}
        for s in sources:
            pairs = [(-sum(abs(share[s][t] - share[o][t]) for t in kept), o) for o in sources if o != s]
            own = [(share[None][t] - share[s][t], t) for t in kept if counts[lang, s][t] and share[s][t] > share[None][t]]
            for part, items in (("pair", pairs), ("term", own)):
                for i, (v, item) in enumerate(sorted(items, key=lambda x: (x[0], x[1].encode()))):
                    if part == "pair" or i < top:
                        out.append((lang, s, part, item, -v, i + 1))
    return sorted(out)


def audited(spark, rows, **options):
    df = spark.createDataFrame(rows, "lang string, source string, text string").repartition(3)
    return sorted(tuple(r) for r in divergence.audit(df, **options).select("lang", "source", "part", "item", "value", "rank").collect())


def made(seed, n=300, sources=6, words=80):
    draw = random.Random(seed)
    vocabulary = ["w%s" % "".join(draw.choice("abcdé日") for _ in range(draw.randint(1, 3))) for _ in range(words)]
    rows = []
    for _ in range(n):
        s = min(draw.randrange(sources), draw.randrange(sources))
        text = " ".join(draw.choice(vocabulary[(7 * s) % 40 :][: 30 + 5 * s]).upper() if draw.random() < 0.3 else draw.choice(vocabulary) for _ in range(draw.randint(0, 25)))
        rows.append((draw.choice(["en", "de", None]), draw.choice([f"s{s}", f"s{s}", None]), draw.choice([text, text, text, None])))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_against_sums_over_all_terms(spark, seed):
    rows = made(seed)
    for options in ({"least_docs": 12}, {"least_docs": 3, "top": 4}):
        assert audited(spark, rows, **options) == brute(rows, **options)


def test_many_blocks_and_tiles_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(divergence, "BLOCK_CELLS", 40)
    monkeypatch.setattr(divergence, "TILE", 3)
    rows = made(3, sources=12)
    assert audited(spark, rows, least_docs=4) == brute(rows, least_docs=4)


def test_no_kept_terms_single_sources_and_ties(spark):
    rows = [("en", "a", "x y"), ("en", "b", "1 2 3"), ("en", "c", None), ("de", "only", "x " * 40), ("fr", "", "")]
    assert audited(spark, rows) == brute(rows)
    rows = [("en", s, "q r Q") for s in ("b", "a", "ä", "Z") for _ in range(20)]  # repeated rows, equal values
    assert audited(spark, rows) == brute(rows)


def test_large_counts_are_exact(spark):
    got = spark.range(1).selectExpr("4000000000000 as c", "9000000000000L as n", "7L as v").select(divergence.share("c", "n", "v").alias("p")).first()["p"]
    assert got == 1 + 10**9 * (4000000000000 + 5) // (9000000000000 + 35)


def test_long_text_empty_table_and_other_columns(spark):
    rows = [("en", "a", "lorem ipsum " * 200_000)] + [("en", "b", "lorem dolor")] * 40
    assert audited(spark, rows) == brute(rows)
    assert audited(spark, []) == []
    df = spark.createDataFrame([("en", "a", "x", 1, 2)], "lang string, source string, text string, term int, n int")
    assert divergence.audit(df).collect() == []
