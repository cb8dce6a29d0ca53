"""A corpus pipeline over documents in five stages.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before has left;
all but the last return the columns of documents. A row is judged by its own content: the
stages that drop rows give each a key of its own, so that rows without a doc_id, and rows
that share one, stay or go each by itself. A text that is null, empty or without a letter has
no language and goes in the first stage; texts of any length are read whole.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import decontaminate, language_id, secret_scan, sentencepiece_codec, simhash
from corpusloom.sources.storage import materialize


def _keyed(docs: DataFrame, name: str) -> DataFrame:
    """key, digest (of all columns) and row, stored, so that a row's key stays its own."""
    return materialize(docs.select(F.monotonically_increasing_id().alias("key"), F.xxhash64(*docs.columns).alias("digest"), F.struct(*docs.columns).alias("row")), name)


def _without(rows: DataFrame, keys: DataFrame, name: str) -> DataFrame:
    """The documents of the rows without these keys. The keys are stored first, so that the
    join strategy follows their measured size."""
    gone = materialize(keys.distinct(), name)
    return rows.join(gone, "key", "left_anti").select("row.*")


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; those that language identification cannot place go."""
    found = language_id.classify(docs, language_id.learn(docs), keep_row=True)
    return found.where(F.col("lang_pred") != language_id.UNKNOWN).select(*[F.col("row")[c].alias(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of texts at a 5-word similarity of 0.8 or more: that of the
    smallest id."""
    rows = _keyed(docs, "pipeline-rows")
    found = simhash.similar(rows.select("key", "row.text"), "key", "text").select(F.col("doc_id").alias("key"), F.col("component_id").alias("component"))
    found = materialize(found, "pipeline-components")
    several = materialize(found.groupBy("component").count().where(F.col("count") > 1).select("component"), "pipeline-several")
    members = materialize(found.join(several, "component").join(rows.select("key", "digest", "row.doc_id"), "key"), "pipeline-members")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "digest", "key")
    kept = materialize(members.groupBy("component").agg(F.min_by("key", order).alias("kept")), "pipeline-kept")
    return _without(rows, members.join(kept, "component").where("key <> kept").select("key"), "pipeline-copies")


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    rows = _keyed(docs, "pipeline-rows")
    leaks = decontaminate.find_leaks(rows.select("key", "row.text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), "key", "text")
    return _without(rows, leaks.select(F.col("doc_id").alias("key")), "pipeline-leaks")


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced by their kind, n_chars counted anew."""
    return secret_scan.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, decoded, n_tokens and the digests of ids and decoded text."""
    tokens = sentencepiece_codec.encode(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return sentencepiece_codec.digests(tokens, keep=("ids", "decoded"))


STAGES = [
    ("language", keep_languages),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("secrets", redact_secrets),
    ("sentencepiece", encode),
]
ORACLE_SQL = None  # no stage but the fourth can be stated in SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is stored before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
