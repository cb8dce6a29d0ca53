"""Files as byte ranges, whatever their line ends.

A file is cut into ranges of equal length, one partition each, so that a file of one endless line
is read by as many tasks as it has ranges. A range comes with the bytes after it that a pattern
which begins in it may reach into; what begins there belongs to the next range.
"""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from corpusloom.functions import grams

RANGE_BYTES = 32 << 20
SEED = 20


def _system(path: str):
    """Arrow's file system and the path in it; None and the path for a local one."""
    if ":" not in path.split("/")[0]:
        return None, path
    if path.startswith("file:/"):
        return None, "/" + path[len("file:") :].lstrip("/")
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def _listed(path: str) -> list[tuple[str, int]]:
    """The files of a folder and below, or the one file, with their sizes, by name."""
    system, at = _system(path)
    if system is None:
        if not os.path.exists(at):
            raise FileNotFoundError(path)
        found = [at] if os.path.isfile(at) else [f"{d}/{x}" for d, _, names in os.walk(at) for x in names]
        sized = [(f, os.path.getsize(f)) for f in found]
    else:
        from pyarrow import fs

        info = system.get_file_info(at)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(path)
        sized = [(f.path, f.size) for f in ([info] if info.is_file else system.get_file_info(fs.FileSelector(at, recursive=True))) if f.is_file]
    return sorted(x for x in sized if not x[0].rpartition("/")[2].startswith(("_", ".")))


@dataclass
class ByteRange(InputPartition):
    path: str
    start: int
    length: int

    def __post_init__(self):
        super().__init__(None)


class ByteRanges(DataSource):
    """Options: path (a file or a folder of files), range (bytes), overlap (bytes after a range).
    Rows: path, start, length (of the range), data (the range and the overlap)."""

    @classmethod
    def name(cls) -> str:
        return "byte_ranges"

    def schema(self) -> str:
        return "path string, start long, length long, data binary"

    def reader(self, schema) -> DataSourceReader:
        return _RangeReader(self.options["path"], int(self.options.get("range", RANGE_BYTES)), int(self.options.get("overlap", 0)))


class _RangeReader(DataSourceReader):
    def __init__(self, path: str, size: int, overlap: int):
        self.path, self.size, self.overlap = path, size, overlap

    def partitions(self) -> list[ByteRange]:
        return [ByteRange(p, start, min(self.size, n - start)) for p, n in _listed(self.path) for start in range(0, n, self.size)]

    def read(self, part: ByteRange):
        system, _ = _system(self.path)
        with open(part.path, "rb") if system is None else system.open_input_file(part.path) as f:
            f.seek(part.start)
            yield part.path, part.start, part.length, f.read(part.length + self.overlap)


def read_ranges(spark: SparkSession, path: str, overlap: int = 0, size: int = RANGE_BYTES) -> DataFrame:
    spark.dataSource.register(ByteRanges)
    return spark.read.format("byte_ranges").option("path", path).option("range", size).option("overlap", overlap).load()


def scan_files(spark: SparkSession, path: str, patterns: list[str], size: int = RANGE_BYTES) -> DataFrame:
    """path, start (in bytes), pattern: every place of a pattern's UTF-8 bytes in the files, each
    once. The patterns are those that leak.shippable() allows, of SEED bytes at least."""
    coded = sorted({p.encode().decode("latin-1") for p in patterns})
    if short := [p for p in coded if len(p) < SEED]:
        raise ValueError(f"a pattern has fewer than {SEED} bytes: {short[0]}")
    ranges = read_ranges(spark, path, max(map(len, coded), default=1) - 1, size)
    shipped, stride = spark.sparkContext.broadcast(coded), min(map(len, coded), default=SEED) - SEED + 1

    def run(batches):
        import pyarrow as pa

        seeds = grams.Seeds(shipped.value, SEED, stride)
        for batch in batches:
            for row in range(batch.num_rows):
                start, length = batch.column(1)[row].as_py(), batch.column(2)[row].as_py()
                text = batch.column(3)[row].as_buffer().to_pybytes().decode("latin-1")
                found = []
                for _, place, p, offset in seeds.meetings([text], stride):
                    at = place - offset
                    if 0 <= at < length and text.startswith(seeds.patterns[p], at):
                        found.append((start + at, seeds.patterns[p].encode("latin-1").decode()))
                yield pa.RecordBatch.from_arrays([pa.array([batch.column(0)[row].as_py()] * len(found), pa.string()), pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.string())], ["path", "start", "pattern"])

    return ranges.mapInArrow(run, "path string, start long, pattern string")
