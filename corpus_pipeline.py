"""From raw documents to token ids: language ID, toxicity, near duplicates, mixing, BPE.

Each stage takes the documents its predecessor kept and returns documents again, the last one token ids. ``run`` writes each
result as Parquet and reads it back for the next stage. Rows with a null id pass the near-duplicate stage, as nothing can name
them; rows that share an id are one document there only where their texts are copies or near copies.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagework.llm import bpe, jaccard, langid, mixing, toxicity
from pagework.llm.common import read_table, ship_package, written
from pagework.llm.queries import VOCABULARY, language_model, toxicity_model

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
TOXIC = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; a missing ``lang`` becomes the predicted one. Null texts, texts without letters, and
    those that share too few n-grams with any learned language go; so does all text where no row names a language."""
    ship_package(spark)
    model = language_model(docs)
    columns = ("__lang", "__score", "__known")
    found = langid.predict(docs.select(*COLUMNS, F.col("text").alias("__said")), model, COLUMNS, "__said", columns)
    kept = found.filter((F.col("__lang") != langid.UNKNOWN) & (F.col("__known") >= model.least_known))
    return kept.withColumn("lang", F.coalesce("lang", "__lang")).select(*COLUMNS)


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below one half."""
    ship_package(spark)
    model = toxicity_model(docs, read_table(spark, sf_dir, "labels"))
    found = toxicity.score(docs.select(*COLUMNS), model, COLUMNS, "text", "__score")
    return found.filter(F.col("__score") < TOXIC).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of copies and near copies, the document with the least id; rows that share an id stay if their texts differ."""
    ship_package(spark)
    kept = jaccard.classes(docs).filter("first and id = copy_id").select(F.col("id").alias("__kept"), F.col("copies").alias("__set")).distinct()
    kept = written(kept, "kept")
    held = jaccard.with_digest(docs.select(*COLUMNS).filter("doc_id is not null"), "text", "__copies")
    # one join by the window's own keys: whatever the size of ``kept``, the texts are shuffled once
    held = held.join(kept, (F.col("doc_id") == F.col("__kept")) & (F.col("__copies") == F.col("__set")), "left_semi")
    first = Window.partitionBy("doc_id", "__copies").orderBy("text", "source", "lang", "n_chars")
    one = held.withColumn("__n", F.row_number().over(first)).filter("__n = 1").select(*COLUMNS)
    return one.union(docs.select(*COLUMNS).filter("doc_id is null"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order, as often as the mix reads them: a source above its target gives less, one below repeats."""
    ship_package(spark)
    mixed = mixing.mix(docs, COLUMNS, "doc_id", into="__mix")
    return mixing.in_training_order(mixed, "doc_id", "__mix", "__position").select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and whether they decode to its text exactly."""
    ship_package(spark)
    path = public_tokenizers.path(VOCABULARY)
    ids = bpe.encode(docs, path, ["doc_id", "lang", "source"], round_trip="round_trip")
    return ids.select("doc_id", "lang", "source", F.size("ids").cast("bigint").alias("n_tokens"), "ids", "round_trip")


STAGES = [
    ("language ID", language_id),
    ("toxicity", toxicity_filter),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing sources to target weights", mix_sources),
    ("BPE encoding and decoding", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)


ORACLE_SQL = None  # language and toxicity models and token merges have no SQL form
QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
