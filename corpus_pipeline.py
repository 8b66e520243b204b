"""A training-data pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; :func:`run` writes each result
as Parquet in the shared folder and rereads it as the next stage's documents. Null and empty texts,
repeated rows, empty tables and columns of any names are met as each stage's operator says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import exact_dedup, mixing, ngram_join, pieces, quality
from larkspur.llm.storage import without_keys, written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on the labelled ones, does not reject."""
    model = quality.train_on(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.scored(docs, model).where("predicted = 1").select(*docs.columns)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of byte-equal texts: the one with the largest id."""
    return exact_dedup.drop_exact_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies (five-word shingles, Jaccard at least 0.8): the smallest id."""
    classes = ngram_join.ngram_components(docs, words=5, percent=80)
    return without_keys(docs, F.col("doc_id"), classes.where("component_id <> doc_id").select("doc_id"), "near-gone")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled by probabilities raked to tempered source, language and topic weights."""
    mixed = mixing.mix(docs, mixing.MixTargets(temper={"source": 0.5, "lang": 0.7, "topic": 0.8}, keep_share=0.8), prefix="mix_")
    return mixed.where("mix_kept").select(*docs.columns)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every whole text, with a check that they decode to it."""
    both = pieces.encode(docs, check_col="round_trip")
    return both.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_pieces"), "ids", "round_trip")


STAGES = [
    ("quality", quality_stage),
    ("exact_dedup", exact_stage),
    ("ngram_join", near_stage),
    ("mixing", mixing_stage),
    ("pieces", encoding_stage),
]

#: Classifier, sampling and encoding stages are not SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
