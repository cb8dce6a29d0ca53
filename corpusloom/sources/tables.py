"""Readers and writers of the corpus formats."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as S

from corpusloom.functions.text import collapse, strip
from corpusloom.operators.corpus import numbered
from corpusloom.sources.storage import materialize, path_exists

RUN_LOG = "step int, elapsed_sec double, tokens long, lr double, train_loss double, val_loss double, tok_per_sec double"
HEADER = "step,elapsed_sec,tokens,lr,train_loss,val_loss,tok_per_sec"
EVAL = "tag string, ckpt string, holdout string, holdout_lines int, bits_per_char double, repetition_rate double, topic_rate double, broken_rate double, avg_reply_len double, sampling map<string,string>, results array<struct<id:string,category:string,turns:array<string>,reply:string,repetition:boolean,broken:boolean,keyword_hit:boolean>>"


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """text of Parquet shards; the other columns are not read, empty texts are dropped."""
    return spark.read.parquet(path).select("text").where("text <> ''")


def read_jsonl(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """text of (gzipped) JSON lines. gzip cannot be split, so a large file wants partitions."""
    rows = spark.read.schema("text string").json(path).where("text <> ''")
    return rows.repartition(partitions) if partitions else rows


def _ordered_lines(spark: SparkSession, paths: str | list[str], glob: str | None = None) -> DataFrame:
    """path, name, place, value: the lines of text files. (name, place) orders them as they stand:
    place is where the line's split begins and the line's number in it, and is stored."""
    reader = spark.read.option("pathGlobFilter", glob) if glob else spark.read
    at = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    return materialize(reader.text(paths).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("name"), at.alias("place"), "value"), "lines")


def read_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """path, seq, text: one document a line, stripped, blank lines dropped. seq numbers all lines
    in the order of the files (of a list, its order; of a folder, by name) and of their lines."""
    listed = [paths] if isinstance(paths, str) else list(paths)
    out = None
    for n, path in enumerate(listed):
        one = _ordered_lines(spark, path).select(F.lit(n).alias("n"), "path", "name", "place", strip(F.col("value")).alias("text")).where("text <> ''")
        out = one if out is None else out.unionByName(one)
    return numbered(out, "seq", ("n", "name", "path", "place")).select("path", "seq", "text")


def read_messages(spark: SparkSession, path: str, field: str = "conversations") -> DataFrame:
    """conv_id, turn, role, text of rows that hold an array of role and content. conv_id numbers
    the rows by file and place in it, whatever the splits."""
    rows = spark.read.parquet(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.row_index").alias("row"), F.col(field).alias("m"))
    turns = numbered(rows, "conv_id", ("path", "row")).select("conv_id", F.posexplode("m").alias("turn", "m"))
    return turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.col("m.role").alias("role"), F.col("m.content").alias("text"))


def read_local_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """path, seq, q, a of *.jsonl (user, assistant) and *.tsv (cut at the first tab), by file name
    and line; the sides are collapsed, and rows without either are dropped."""
    lines = _ordered_lines(spark, folder, "*.{jsonl,tsv}")
    json, cut = F.from_json("value", "user string, assistant string"), F.split("value", "\t", 2)
    is_json = F.endswith("path", F.lit(".jsonl"))
    q, a = (collapse(F.coalesce(F.when(is_json, json[k]).otherwise(F.get(cut, F.lit(n))), F.lit(""))) for n, k in enumerate(("user", "assistant")))
    return numbered(lines.select("path", "name", "place", q.alias("q"), a.alias("a")).where("q <> '' and a <> ''"), "seq", ("name", "path", "place")).select("path", "seq", "q", "a")


def read_run_log(spark: SparkSession, path: str) -> DataFrame:
    """A run log's rows; lines that begin with # are comments, header lines are no rows."""
    lines = spark.read.text(path).where(~F.startswith("value", F.lit("#")) & (F.col("value") != HEADER) & (F.trim("value") != ""))
    return lines.select(F.from_csv("value", F.lit(RUN_LOG)).alias("r")).select("r.*")


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of a JSON artifact; none if there is no such file."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], S.StructType.fromDDL(schema))
    return spark.read.schema(schema).option("multiLine", True).json(path)


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """path, bytes, sha256 of whole files (each below 2 GB)."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def resolve_sources(known: dict[str, Callable[[SparkSession], DataFrame]], spec: str) -> dict[str, Callable[[SparkSession], DataFrame]]:
    """`all`, or a comma list of names; an unknown name is an error."""
    names = list(known) if spec == "all" else [x.strip() for x in spec.split(",") if x.strip()]
    if unknown := [x for x in names if x not in known]:
        raise ValueError(f"unknown sources: {', '.join(unknown)}")
    return {x: known[x] for x in names}


def write_lines(rows: DataFrame, path: str, column: str = "text") -> None:
    """One document a line; line ends inside a text would break that, so they are an error."""
    checked = F.when(F.contains(column, F.lit("\n")), F.raise_error(F.lit("a text holds a line end"))).otherwise(F.col(column))
    rows.select(checked.alias("value")).write.text(path)


def write_tokens(rows: DataFrame, path: str, limit: int = 65_536) -> None:
    """doc_id, tokens; an id at or over the limit is an error."""
    checked = F.when(F.exists("tokens", lambda x: x >= limit), F.raise_error(F.lit("a token id is over the limit"))).otherwise(F.col("tokens"))
    rows.select("doc_id", checked.alias("tokens")).write.parquet(path)


def write_manifest(row: DataFrame, path: str) -> None:
    row.coalesce(1).write.mode("overwrite").json(path)


def append_log(rows: DataFrame, path: str) -> None:
    """Append run-log rows to a folder, whose first file is its header."""
    spark = rows.sparkSession
    if not path_exists(spark, path):
        spark.createDataFrame([(HEADER,)], "value string").coalesce(1).write.text(path)
    names = HEADER.split(",")
    rows.select(F.to_csv(F.struct(*names)).alias("value")).write.mode("append").text(path)
