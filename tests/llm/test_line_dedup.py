"""Shared lines against brute force."""

import random
from collections import defaultdict

from exonloom.llm import linededup

SPACE = " \t\n\x0b\x0c\r"
FOLD = str.maketrans(linededup.UPPER, linededup.LOWER)


def brute(rows, least=20, docs=3):
    key = lambda line: line.strip(SPACE).translate(FOLD)
    holders = defaultdict(set)
    for n, (_, text) in enumerate(rows):
        for line in (text or "").split("\n"):
            if len(key(line)) >= least:
                holders[key(line)].add(n)
    out = []
    for k, text in rows:
        lines = (text or "").split("\n")
        kept = []
        for line in lines:
            held = holders.get(key(line), ())
            best = max((rows[n][0] for n in held if rows[n][0] is not None), default=None)
            gone = len(held) >= docs and best is not None and (k is None or k < best)
            if not gone:
                kept.append(line)
        out.append((k, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def stored(spark, rows, path, schema="doc_id long, text string"):
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(str(path))
    return spark.read.parquet(str(path))


def plain(rows):
    return sorted(map(repr, rows))


def test_lines_against_brute_force(spark, tmp_path):
    rng = random.Random(3)
    common = [f"{'Ä' if i % 3 else 'A'}bc shared LINE number {i} of all" for i in range(12)]
    rows = []
    for k in range(80):
        lines = []
        for _ in range(rng.randint(0, 12)):
            line = rng.choice(common) if rng.random() < 0.6 else f"line of its own {rng.random()}"
            lines.append(rng.choice(["", " ", "\t\x0b"]) + (line.lower() if rng.random() < 0.3 else line) + rng.choice(["", "\r", " "]))
        rows.append((k, "\n".join(lines)))
    hot = "this very line stands in every document"
    rows = [(k, f"{t}\n{hot}\n{hot}") for k, t in rows]
    rows += [(100, None), (101, ""), (102, "\n\n"), (103, "short\nshort"), (None, hot), (104, "x" * 300000), (79, hot), (104, "exactly twenty chars")]
    rows += [(105, "exactly twenty chars"), (106, "exactly twenty chars"), (107, "nineteen chars long"), (108, "nineteen chars long"), (109, "nineteen chars long")]
    got = linededup.dedup_lines(stored(spark, rows, tmp_path / "d")).collect()
    assert plain(map(tuple, got)) == plain(brute(rows))


def test_null_keys_alone_keep_their_lines_and_columns_stay(spark, tmp_path):
    line = "a line that three documents share"
    rows = [(None, line, 1, "a"), (None, line, 2, "b"), (None, line, 3, "c")]
    docs = stored(spark, rows, tmp_path / "d", "doc_id long, text string, n_lines int, keeper string")
    got = linededup.dedup_lines(docs)
    assert got.columns == ["doc_id", "text", "keeper", "n_lines", "n_dropped"]
    assert {(r["text"], r["n_dropped"]) for r in got.collect()} == {(line, 0)}
    assert linededup.dedup_lines(stored(spark, [], tmp_path / "e")).count() == 0


def test_runs_hold_each_line_once_and_are_few(spark):
    runs = linededup.Runs(2)
    for i in range(5):
        batch = spark.createDataFrame([(j, 0, i) for j in range(i, i + 4)], "h1 long, h2 int, keeper long")
        runs.add(runs.unseen(batch))
    assert sum(map(len, runs.levels)) == 2
    assert sorted((r["h1"], r["keeper"]) for r in runs.all().collect()) == [(j, max(0, j - 3)) for j in range(8)]
