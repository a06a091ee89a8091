"""The stages over small tables, and each decision against brute force."""

import random

import pytest

import corpus_pipeline

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture
def folder(spark, tmp_path):
    rng = random.Random(12)
    words = [f"word{i}" for i in range(3000)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    bench = [(i, say(30)) for i in range(5)]
    rows, labels = [], []
    for i in range(400):
        text = say(rng.randint(30, 80))
        toxic = i % 5 == 0
        if toxic:
            text += " zzvile zzfoul"
        rows.append((i, text))
        labels.append((i, 1, int(toxic)))
    line = "this whole line stands in many documents here"
    rows += [(1000 + i, f"{say(40)}\n{line}") for i in range(6)]
    rows += [(1100, rows[1][1]), (1101, rows[2][1] + " end"), (1200, say(20) + " " + bench[2][1] + " " + say(20)), (1300, None), (1301, "")]
    docs = [(k, t, "en", "s", len(t or "")) for k, t in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path), dict(rows), line


def test_stages_drop_what_they_should_and_nothing_else(spark, folder):
    path, texts, line = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    seen = [set(texts)]
    frames = []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = corpus_pipeline.cut_lineage(stage(spark, docs, path))
        if i < 4:
            assert docs.columns == COLUMNS
        frames.append({r["doc_id"]: r for r in docs.collect()})
        seen.append(set(frames[-1]))
    toxic, lines, near, leaks, pieces = frames
    assert seen[0] - seen[1] == {k for k, t in texts.items() if t and "zzvile" in t}
    assert seen[2] == seen[1]
    assert [k for k in lines if line in lines[k]["text"]] == [1005]
    assert all(r["n_chars"] == len(r["text"]) for r in lines.values())
    gone = seen[2] - seen[3]
    assert len(gone & {1, 1100}) == 1 and len(gone & {2, 1101}) == 1 and len(gone & {1300, 1301}) == 1 and len(gone) == 3
    assert seen[3] - seen[4] == {1200}
    assert set(pieces) == seen[4] and all((r["n_pieces"] > 0) == bool(leaks[k]["text"]) for k, r in pieces.items())
    again = {r["doc_id"]: r["pieces"] for r in corpus_pipeline.run(spark, path).collect()}
    assert len(again) == len(pieces) and all(again[k] == r["pieces"] for k, r in pieces.items() if k in again)


def test_empty_documents(spark, folder):
    path, *_ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet").filter("doc_id < 0")
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.cut_lineage(stage(spark, docs, path))
    assert docs.count() == 0
