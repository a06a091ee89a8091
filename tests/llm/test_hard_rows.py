"""Rows that once broke an operator: clashing names, null and repeated keys, one very long vector, markup that never closes."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from exonloom.llm import ann, decontaminate, extract, linededup, pieces, queries, simhash, toxicity

CLASHING = ["_body", "body", "Body_", "_gone", "lost_lines", "all_lines", "row_number", "_row_number_of_docs", "seed_of_row", "_seed", "h1", "row", "k"]


@pytest.fixture(scope="module")
def clashing(spark, tmp_path_factory):
    """Six documents with columns that bear names of the operators' own."""
    body = " ".join(f"word{i}" for i in range(60))
    texts = [body, body, "a shared line of some length\n1", "a shared line of some length\n2", "a shared line of some length\n3", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("lang", F.lit("en"))
    path = str(tmp_path_factory.mktemp("clashing") / "docs")
    rows.withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in CLASHING}).write.parquet(path)
    return spark.read.parquet(path)


def untouched(got, of=range(6)):
    assert {r["doc_id"] for r in got} == set(of)
    for r in got:
        assert [r[c] for c in CLASHING] == [f"{c}{r['doc_id']}" for c in CLASHING]


def test_columns_with_names_of_the_operators_own(spark, clashing):
    untouched(linededup.dedup_lines(clashing).collect())
    untouched(simhash.drop_similar(clashing).collect(), [0, 2, 3, 4, 5])
    items = spark.createDataFrame([(1, " ".join(f"word{i}" for i in range(20, 40)))], "item_id int, text string")
    untouched(decontaminate.drop_contaminated(clashing, items).collect(), [2, 3, 4, 5])
    untouched(pieces.encode(clashing, pieces.load(queries.PIECES), check=True).collect())
    labels = clashing.select("doc_id", F.lit(1).alias("toxic"))
    untouched(toxicity.score(clashing, toxicity.fit(clashing, labels, F.lit(True))).collect())


def test_warc_query_with_null_keys_and_texts(spark, tmp_path):
    rows = [(1, "http://a/", "x" * 1200), (None, "http://b/", "y"), (3, None, None), (4, "http://c/", "x" * 1200)]
    spark.createDataFrame(rows, "page_id bigint, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {(r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in queries.op9_warc(spark, str(tmp_path)).collect()}
    assert got == {(1, 1200, "revisit", 4), (None, 1, "response", None), (3, 0, "response", None), (4, 1200, "response", None)}


@pytest.mark.parametrize("norm", [1e2, 1e4, 1e30])
def test_recall_beside_a_very_long_vector(spark, norm):
    draw = np.random.default_rng(1)
    x = draw.normal(size=(2048, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[7] *= norm
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    got = ann.nearest(rows, rows.filter("vec_id % 20 = 0")).collect()
    found = {}
    for r in got:
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    score = x[::20] @ x.T
    hits = 0
    for q, row in zip(range(0, 2048, 20), score):
        row[q] = -np.inf
        hits += len(found[q] & set(np.argsort(-row, kind="stable")[:20].tolist()))
    assert hits / (20 * len(score)) >= 0.95


def test_a_labelled_key_in_many_rows_is_learned_from_once(spark, monkeypatch):
    seen = []
    plain = toxicity.train
    monkeypatch.setattr(toxicity, "train", lambda bodies, y, **k: seen.append(len(bodies)) or plain(bodies, y, **k))
    docs = spark.range(4000).selectExpr("id % 4 as doc_id", "concat('words of row ', id) as text", "'en' as lang")
    labels = spark.createDataFrame([(i, i % 2) for i in range(4)], "doc_id bigint, toxic int")
    toxicity.fit(docs, labels, F.lit(True))
    assert seen[0] <= 4


PARAGRAPH = "<div>Text, of some length, that counts as a paragraph by itself"


@pytest.mark.parametrize("page", [
    "<select a>" * 200_000, PARAGRAPH * 30_000, "<ul>" + "<div>" * 5000 + "<li>x" * 50_000, "<div>" * 5000 + "</p>x" * 50_000,
    "<script>" * 200_000, '<a "' * 200_000, "<!-- " * 200_000, "<b " * 300_000, "<svg><p>" * 150_000,
])
def test_open_markup_is_read_in_linear_time(page):
    began = time.monotonic()
    extract.main_text(page)
    assert time.monotonic() - began < 10


def test_dropped_elements():
    long = "A paragraph, long enough, that stays because it reads like text."
    for markup in ("<svg-icon>", "<svg/>", "<button>", "<select a>", "<BUTTON x>gone</Button >", "<svg><p>gone</p></svg>", "<script>gone</script>"):
        assert extract.main_text(f"<p>{long}</p>{markup}<p>{long}</p>") == f"{long} {long}"
    assert extract.main_text(f"<p>{long}</p><script>gone<p>{long}</p>") == long
