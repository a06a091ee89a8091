"""The corpus pipeline: toxicity, line dedup, near-dedup, benchmark decontamination, piece encoding.

Every stage takes ``(spark, docs, sf_dir)`` with ``docs`` read from Parquet and returns a DataFrame; ``run``
writes each stage to the shared checkpoint folder and reads it back for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from exonloom.llm import decontaminate, linededup, pieces, simhash, toxicity
from exonloom.session import cut_lineage

#: Model file of the public piece vocabulary.
PIECES = "/opt/tokenizers/piece_bpe_32k.model"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxicity threshold of their language; learned from the labelled ones among them."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), F.lit(True))
    return toxicity.score(docs, model).filter(~F.col("toxic")).select(*docs.columns)


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less the lines that three or more share; ``n_chars`` is counted anew."""
    out = linededup.dedup_lines(docs).drop("n_lines", "n_dropped")
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of similar texts."""
    return simhash.drop_similar(docs)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as sampled pieces, checked to decode to its text."""
    known = pieces.load(PIECES)
    made = pieces.encode(docs.select("doc_id", "lang", "source", "text"), known, check=True)
    wrong = F.raise_error("a text did not decode to itself").cast("array<int>")
    checked = F.when(F.col("lossless"), F.col("pieces")).otherwise(wrong)
    return made.select("doc_id", "lang", "source", F.size("pieces").cast("long").alias("n_pieces"), checked.alias("pieces"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_shared_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_benchmark_passages),
    ("sentencepiece", encode_pieces),
]

#: Fingerprints, seeds and a trained model are not for SQL; the tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after another, over the whole of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return docs
