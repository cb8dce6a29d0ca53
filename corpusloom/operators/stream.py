"""A flat stream of token ids over all documents, with a positional index.

The ids of the documents stand one after the other by seq. The index has where each document
starts, from sums over ranges; the ids are kept in blocks of equal length, which reach across
documents, so that any span of the stream is found by an equi-join on block numbers: nothing is
sorted or numbered again to read a window, and a block is the most that a row holds.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.batches import bounded_batches, portions
from corpusloom.functions.ordered import sums_before
from corpusloom.operators.tokens import batch_offsets
from corpusloom.sources.binary import MARK, read_files, write_blocks
from corpusloom.sources.storage import materialize

BLOCK = 4096
#: Ids from here on do not fit the files' two bytes.
ID_LIMIT = 1 << 16
#: Ids of a file, which is read whole.
IDS_A_FILE = 1 << 22


@dataclass
class TokenStream:
    index: DataFrame  # seq, start, n_tokens
    blocks: DataFrame  # block, tokens: `size` ids each, the last one fewer
    size: int
    length: int


def fitting(tokens: Column, limit: int = ID_LIMIT) -> Column:
    """The ids; an error if one is not below the limit."""
    wrong = F.concat(F.lit(f"a token id is not from 0 to {limit - 1}: "), F.array_max(tokens).cast("string"), F.lit(", "), F.array_min(tokens).cast("string"))
    return F.when((F.array_max(tokens) >= limit) | (F.array_min(tokens) < 0), F.raise_error(wrong)).otherwise(tokens)


def flatten(arrays: DataFrame, size: int = BLOCK, limit: int = ID_LIMIT) -> TokenStream:
    """The stream of arrays (seq, tokens array<int>), seq unique; no ids for a null array."""
    none = F.array().cast("array<int>")
    rows = materialize(arrays.select("seq", fitting(F.coalesce("tokens", none), limit).alias("tokens")), "stream-documents")
    sized = rows.select("seq", F.size("tokens").cast("long").alias("n_tokens"))
    index = materialize(sums_before(sized, ["seq"], "n_tokens", "start"), "stream-index")
    length = index.agg(F.max(F.col("start") + F.col("n_tokens"))).first()[0] or 0
    at, end = F.col("start"), F.col("start") + F.col("n_tokens")
    numbers = F.sequence(F.floor(at / size), F.floor((end - 1) / size))
    parts = rows.join(index.where("n_tokens > 0"), "seq").select("start", "n_tokens", "tokens", F.explode(numbers).alias("block"))
    first = F.greatest(at, F.col("block") * size)
    cut = F.slice("tokens", (first - at + 1).cast("int"), (F.least(end, (F.col("block") + 1) * size) - first).cast("int"))
    pieces = parts.select("block", F.struct(first.alias("at"), cut.alias("ids")).alias("p"))
    joined = F.flatten(F.transform(F.sort_array(F.collect_list("p")), lambda p: p["ids"]))
    return TokenStream(index, materialize(pieces.groupBy("block").agg(joined.alias("tokens")), "stream-blocks"), size, length)


def fetch(stream: TokenStream, spans: DataFrame, *keys: str) -> DataFrame:
    """keys, offset and tokens of the spans (keys, which are unique, offset, n): the ids from offset
    on, n of them or as many as are left."""
    n = stream.size
    end = F.least(F.col("offset") + F.col("n"), F.lit(stream.length))
    wanted = spans.where((F.col("n") > 0) & (F.col("offset") < stream.length)).select(*keys, "offset", end.alias("_end"), F.explode(F.sequence(F.floor(F.col("offset") / n), F.floor((end - 1) / n))).alias("block"))
    first = F.greatest(F.col("offset"), F.col("block") * n)
    cut = F.slice("tokens", (first - F.col("block") * n + 1).cast("int"), (F.least("_end", (F.col("block") + 1) * n) - first).cast("int"))
    parts = wanted.join(stream.blocks, "block").select(*keys, "offset", F.struct("block", cut.alias("ids")).alias("p"))
    return parts.groupBy(*keys, "offset").agg(F.flatten(F.transform(F.sort_array(F.collect_list("p")), lambda p: p["ids"])).alias("tokens"))


def windows(stream: TokenStream, size: int = 256) -> DataFrame:
    """window, tokens: size + 1 ids every size, across documents; a shorter tail is dropped. All but
    one id of a window lie in one block; that one comes from the next block by a join of one id
    a block."""
    if stream.size % size:
        raise ValueError("a block must hold whole windows")
    heads = stream.blocks.select((F.col("block") - 1).alias("block"), F.slice("tokens", 1, 1).alias("head"))
    grown = stream.blocks.join(heads, "block", "left").select("block", F.concat("tokens", F.coalesce("head", F.array().cast("array<int>"))).alias("tokens"))
    n = F.floor((F.size("tokens") - 1) / size).cast("int")
    each = grown.where(n > 0).select("block", "tokens", F.explode(F.sequence(F.lit(0), n - 1)).alias("k"))
    return each.select((F.col("block") * (stream.size // size) + F.col("k")).alias("window"), F.slice("tokens", F.col("k") * size + 1, F.lit(size + 1)).alias("tokens"))


def batches(stream: TokenStream, block: int, batch: int, seed: int, steps: int) -> DataFrame:
    """step, i, offset, x and y: `batch` spans of `block` ids for each step, at places that depend on
    seed, step and i alone; y is x one place on."""
    offsets = batch_offsets(stream.blocks.sparkSession, stream.length, block, batch, seed, steps)
    found = fetch(stream, offsets.withColumn("n", F.lit(block + 1)), "step", "i")
    return found.select("step", "i", "offset", F.slice("tokens", 1, block).alias("x"), F.slice("tokens", 2, block).alias("y"))


def weighted(arrays: DataFrame, size: int = BLOCK, limit: int = ID_LIMIT) -> TokenStream:
    """The stream of arrays (seq, tokens, weights of 0 and 1, of one length): each of its values is
    2 id + weight, so that ids and weights are read by one join."""
    odd = F.when(F.size("tokens") != F.size("weights"), F.raise_error(F.lit("tokens and weights differ in length"))).otherwise(fitting(F.col("tokens"), limit))
    both = F.zip_with(odd, F.col("weights"), lambda t, w: 2 * t + F.when(w > 0, 1).otherwise(0))
    return flatten(arrays.select("seq", both.cast("array<int>").alias("tokens")), size, 2 * limit)


def weighted_batches(stream: TokenStream, block: int, batch: int, seed: int, steps: int) -> DataFrame:
    """step, i, offset, x, y and w, the weights of y, of a weighted() stream."""
    ids = lambda c: F.transform(c, lambda v: F.shiftright(v, 1))
    found = batches(stream, block, batch, seed, steps)
    return found.select("step", "i", "offset", ids(F.col("x")).alias("x"), ids(F.col("y")).alias("y"), F.transform("y", lambda v: v.bitwiseAND(F.lit(1))).alias("w"))


def unigram_nats(stream: TokenStream, spans: DataFrame) -> DataFrame:
    """window, nats of windows (window, tokens): what a model of the stream's id counts takes for
    all ids but the first. The counts are of a vocabulary's length."""
    counts = stream.blocks.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("c"))
    ids = spans.select("window", F.explode(F.slice("tokens", 2, 1 << 30)).alias("token")).groupBy("window", "token").agg(F.count("*").alias("k"))
    return ids.join(counts, "token").groupBy("window").agg(F.sum(-F.col("k") * F.ln(F.col("c") / stream.length)).alias("nats"))


# --- files -----------------------------------------------------------------------------

_HEADER = "<8sQII"  # magic, block, ids in a full block, ids in this one
_MAGIC = b"FLATIDS2"


def write_stream(stream: TokenStream, path: str, ranges: int | None = None) -> None:
    """Binary files of two bytes an id, the blocks in order within and across the files."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for part in portions(batch, "tokens"):
                ids = part.column(1)
                flat, ends = ids.flatten().to_numpy().astype("<u2"), np.cumsum([0, *ids.value_lengths().to_pylist()])
                data = [struct.pack(_HEADER, _MAGIC, b, size, z - a) + flat[a:z].tobytes() + b"\0" * (-2 * (z - a) % 4) for b, a, z in zip(part.column(0).to_pylist(), ends.tolist(), ends[1:].tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(data, pa.binary())], ["block"])

    size = stream.size
    n = ranges or int(stream.blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = stream.blocks.repartitionByRange(n, "block").sortWithinPartitions("block")
    bounded_batches(dealt.sparkSession)
    write_blocks(dealt.select("block", "tokens").mapInArrow(run, "block binary"), path, most=max(1, IDS_A_FILE // size))


def read_stream(spark: SparkSession, path: str) -> TokenStream:
    """The blocks of files that write_stream() made; without an index of documents."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for content in (batch.column(0)[k].as_py() for k in range(batch.num_rows)):  # a file at a time
                at, numbers, sizes, ids = 0, [], [], []
                while at < len(content):
                    magic, block, size, n = struct.unpack_from(_HEADER, content, at)
                    at += struct.calcsize(_HEADER)
                    stop = at + 2 * n + -2 * n % 4
                    if magic != _MAGIC or content[stop : stop + len(MARK)] != MARK:
                        raise ValueError(f"no block of token ids before byte {at}")
                    numbers.append(block)
                    sizes.append(size)
                    ids.append(np.frombuffer(content, "<u2", n, at).astype(np.int32))
                    at = stop + len(MARK)
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, ids)]), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *ids])))
                yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array(sizes, pa.int32()), lists], ["block", "size", "tokens"])

    bounded_batches(spark)
    rows = materialize(read_files(spark, path).mapInArrow(run, "block long, size int, tokens array<int>"), "stream-read")
    found = rows.agg(F.max("size").alias("size"), F.sum(F.size("tokens")).alias("n"), F.max("block").alias("last"), F.count("*").alias("blocks")).first()
    if found.blocks and found.last + 1 != found.blocks:
        raise ValueError(f"{found.last + 1 - found.blocks} blocks of the stream are not there")
    return TokenStream(None, rows.drop("size"), found.size or BLOCK, found.n or 0)
