"""Helpers that the operators share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.batches import BATCH_ROWS, bounded_batches, portions  # noqa: F401

#: Groups of tasks whose sums are added first.
SUM_PARTS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_row: bool = False) -> DataFrame:
    """Only the two columns an operator reads, under fixed names; a null text is empty.
    keep_row: also row, a struct of all columns, so that clashing names stay apart."""
    bounded_batches(docs.sparkSession)
    return docs.select(
        docs[id_col].cast("long").alias("doc_id"),
        F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"),
        *[F.struct(*[docs[c] for c in docs.columns]).alias("row")] * keep_row,
    )


def cached(kind: str, key, make):
    """What make() gave for the key, for as long as the Python worker lives and no other key of
    the kind is asked for: of models and memo tables, a worker holds one of each kind."""
    import sys
    import types

    name = "_corpusloom_worker_cache"
    if name not in sys.modules:
        sys.modules[name] = types.ModuleType(name)
    entries = sys.modules[name].__dict__.setdefault("entries", {})
    if kind not in entries or entries[kind][0] != key:
        entries.pop(kind, None)
        entries[kind] = key, make()
    return entries[kind][1]


def add_binary(parts: DataFrame, keys: list[str]) -> DataFrame:
    """parts: the keys, and counts binary (int64 values, of one length for the keys' values). The
    sums by keys, in two steps, so that no task holds a row of each of very many tasks."""
    schema = parts.select(*keys, "counts").schema

    def add(key, rows):
        total = None
        for x in rows.column("counts").to_pylist():
            own = np.frombuffer(x, np.int64)
            total = own.copy() if total is None else np.add(total, own, out=total)
        return pa.table([*(pa.array([k.as_py()], t.type) for k, t in zip(key, (rows.column(c) for c in keys))), pa.array([total.tobytes()], pa.binary())], [*keys, "counts"])

    some = parts.withColumn("_part", F.spark_partition_id() % SUM_PARTS).groupBy(*keys, "_part").applyInArrow(add, schema)
    return some.groupBy(*keys).applyInArrow(add, schema)


def sum_vectors(parts: DataFrame) -> dict[int, np.ndarray]:
    """parts: key int, counts binary. The sums by key, for statistics whose keys and lengths are
    fixed, so that they may reach the driver."""
    return {r.key: np.frombuffer(bytes(r.counts), np.int64) for r in add_binary(parts, ["key"]).collect()}
