"""Binary files in any store that Spark writes to.

A block is a run of bytes made by one row; a partition's blocks stand one after the other in
one file, each followed by MARK. MARK has four bytes, so what begins at a multiple of four in
a block of such a length does so in its file. A block states its own length: MARK is no
delimiter, and may occur inside blocks. Files go through Spark's commit protocol, so the
attempts of lost executors leave nothing behind.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MARK = b"EOB\n"


def write_blocks(rows: DataFrame, path: str, block: str = "block", mode: str = "errorifexists", most: int = 0) -> None:
    """The blocks of the rows, a file for each partition that has rows; most: a file for each so
    many blocks of it."""
    rows.select(F.col(block).cast("string").alias("value")).write.mode(mode).option("maxRecordsPerFile", most).option("lineSep", MARK.decode()).option("compression", "none").text(path)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """content, one row a file."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
