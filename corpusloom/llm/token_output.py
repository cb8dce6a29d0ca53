"""Token ids as binary files with Elias-Fano document boundaries.

Documents are encoded, an end id is appended to each, and the ids of all documents stand one
after the other in files, ascending by document id. A range of ids is a shard, written by one
task as one file of blocks (sources.binary). A block holds some documents:

    header     magic, shard, documents, tokens, tokens of the shard before the block, bytes an id,
               documents without an id, and the first document id
    ids        2 bytes each where the vocabulary has at most 65,536 entries, else 4
    ends       where each document ends, a monotone sequence, by Elias-Fano
    documents  document ids less the first, by Elias-Fano too

Elias-Fano keeps the low bits of each value packed, and the high bits in unary: n values up to
u take about n * (2 + log2(u / n)) bits, where a table of offsets has 64 n. select(i), over the
places of every SAMPLE-th one bit, gives value i without decoding those before it.

Defined cases: a null or empty text has the end id alone; rows without an id stand first; rows
of one id stand by the hash of their text, equal rows in any order; a text of any length is
one document of one block; an empty table writes no block and reads back empty; extra columns
are not read. A shard is bounded in bytes of text by the number of ranges, a block by
BLOCK_TOKENS and one document.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.ordered import sums_before
from corpusloom.llm.common import cached, id_text, portions
from corpusloom.llm.spaced import LONGEST_KEPT, SpacedIds
from corpusloom.llm.token_counts import _SAFE, _UNSAFE, _chunkable
from corpusloom.sources.binary import MARK, read_files, write_blocks
from corpusloom.sources.storage import materialize, scratch_path

#: Bytes of text a shard, about.
SHARD_BYTES = 64 << 20
BLOCK_TOKENS = 1 << 20
#: Bytes of texts encoded at a time.
PORTION = 1 << 20
#: One bits between two sampled places.
SAMPLE = 64
MEMO_ENTRIES = 1_000_000
MAGIC = b"EFTOKEN1"
HEADER = "<8sIIQQIIq"  # magic, shard, documents, tokens, tokens before, bytes an id, without an id, first id


class EliasFano:
    """A monotone sequence of n values below 2^64, in about n * (2 + log2(last / n)) bits."""

    def __init__(self, n: int, shift: int, low: np.ndarray, high: np.ndarray, places: np.ndarray):
        self.n, self.shift, self.low, self.high, self.places = n, shift, low, high, places

    @classmethod
    def of(cls, values: np.ndarray) -> "EliasFano":
        values, n = values.astype(np.uint64), len(values)
        last = int(values[-1]) if n else 0
        shift = max(0, (last // n).bit_length() - 1) if n else 0
        bits = (values[:, None] >> np.arange(shift, dtype=np.uint64)[None, :]) & np.uint64(1)
        low = _words(np.packbits(bits.astype(np.uint8).ravel(), bitorder="little"))
        ones = (values >> np.uint64(shift)).astype(np.int64) + np.arange(n)
        marks = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        marks[ones] = 1
        return cls(n, shift, low, _words(np.packbits(marks, bitorder="little")), ones[::SAMPLE].astype("<u4"))

    def select(self, i: np.ndarray) -> np.ndarray:
        """The values at the places i: from the sampled place of each, words are passed over by
        their counts of ones, then ones of the last word by clearing them."""
        i = np.asarray(i, np.int64)
        start = self.places[i // SAMPLE].astype(np.int64)
        word, left = start // 64, i % SAMPLE
        here = self.high[word] & (np.uint64(0xFFFFFFFFFFFFFFFF) << (start % 64).astype(np.uint64))
        while (passed := left >= (ones := np.bitwise_count(here).astype(np.int64))).any():
            left = np.where(passed, left - ones, left)
            word = word + passed
            here = np.where(passed, self.high[np.minimum(word, len(self.high) - 1)], here)
        for _ in range(int(left.max(initial=0))):
            here = np.where(left > 0, here & (here - np.uint64(1)), here)
            left = left - (left > 0)
        inside = np.bitwise_count((here & (~here + np.uint64(1))) - np.uint64(1)).astype(np.int64)
        return ((word * 64 + inside - i).astype(np.uint64) << np.uint64(self.shift)) | self._low(i)

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.shift:
            return np.zeros(len(i), np.uint64)
        at = i.astype(np.uint64) * np.uint64(self.shift)
        word, off = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        over = np.where(off == 0, np.uint64(0), self.low[np.minimum(word + 1, len(self.low) - 1)] << ((np.uint64(64) - off) & np.uint64(63)))
        return ((self.low[word] >> off) | over) & np.uint64((1 << self.shift) - 1)

    def to_bytes(self) -> bytes:
        head = struct.pack("<IIII", self.n, self.shift, len(self.low), len(self.high))
        places = self.places.tobytes()
        return head + self.low.tobytes() + self.high.tobytes() + places + b"\0" * (-len(places) % 8)

    @classmethod
    def read(cls, data, at: int) -> tuple["EliasFano", int]:
        """The sequence that begins at a place of the data, and where it ends."""
        n, shift, n_low, n_high = struct.unpack_from("<IIII", data, at)
        at += 16
        low = np.frombuffer(data, "<u8", n_low, at)
        high = np.frombuffer(data, "<u8", n_high, at + 8 * n_low)
        at += 8 * (n_low + n_high)
        n_places = -(-n // SAMPLE)
        return cls(n, shift, low, high, np.frombuffer(data, "<u4", n_places, at)), at + 8 * -(-n_places // 2)


def _words(data: np.ndarray) -> np.ndarray:
    return np.frombuffer(data.tobytes() + b"\0" * (-len(data) % 8), "<u8")


class Coder:
    """The ids of texts as bytes, as the tokenizers library gives them."""

    def __init__(self, data: bytes):
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tok, spec = Tokenizer.from_str(data.decode()), json.loads(data)
        tok.no_truncation()
        tok.no_padding()
        self.cut = _chunkable(spec)
        self.added = [x["content"] for x in spec.get("added_tokens", [])]
        self.width = 2 if tok.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        self.table = SpacedIds(tok, "H" if self.width == 2 else "I")
        self.heads: dict[str, bytes] = {}  # of texts' first chunks, which follow no space

    def encode(self, text: str) -> bytes:
        """A text is cut before each single space between two characters that are none, where no
        token reaches across; a text with an added token's string is not."""
        if not text:
            return b""
        if not self.cut or any(x in text for x in self.added):
            return self.table.ids(text)
        if text[0].isspace() or _UNSAFE.search(text):
            head, *rest = _SAFE.split(" " + text)
            head = head[1:]
        else:
            head, *rest = text.split(" ")
        first = self.heads.get(head)
        if first is None:
            first = self.table.head(head)
            if len(head) <= LONGEST_KEPT:
                if len(self.heads) > MEMO_ENTRIES // 4:
                    self.heads.clear()
                self.heads[head] = first
        self.table.bound(MEMO_ENTRIES)
        return first + b"".join(map(self.table.__getitem__, rest))


def coder(data: bytes) -> Coder:
    return cached("ids", hashlib.sha256(data).digest(), lambda: Coder(data))


def pack(shard: int, before: int, docs: list[tuple[int | None, bytes]], width: int) -> bytes:
    """One block of documents (id, ids as bytes), those without an id first, ids ascending."""
    ids = b"".join(x for _, x in docs)
    named = np.array([i for i, _ in docs if i is not None], np.int64)
    first = int(named[0]) if len(named) else 0
    ends = np.cumsum(np.array([len(x) // width for _, x in docs], np.uint64))
    gaps = named.astype(np.uint64) - np.array([first], np.int64).astype(np.uint64)  # wraps as ids do
    head = struct.pack(HEADER, MAGIC, shard, len(docs), len(ids) // width, before, width, len(docs) - len(named), first)
    return head + ids + b"\0" * (-len(ids) % 8) + EliasFano.of(ends).to_bytes() + EliasFano.of(gaps).to_bytes()


def unpack(data: bytes):
    """shard, tokens before, document ids (None: without), starts and ends in the block, and the
    ids, of each block of a file's content."""
    at, data = 0, memoryview(data)
    while at < len(data):
        magic, shard, n, n_tokens, before, width, n_null, first = struct.unpack_from(HEADER, data, at)
        if magic != MAGIC:
            raise ValueError(f"no block of token ids at byte {at}")
        at += struct.calcsize(HEADER)
        ids = np.frombuffer(data, f"<u{width}", n_tokens, at)
        at += n_tokens * width + -(n_tokens * width) % 8
        ends, at = EliasFano.read(data, at)
        gaps, at = EliasFano.read(data, at)
        if bytes(data[at : at + len(MARK)]) != MARK:
            raise ValueError(f"no end of a block at byte {at}")
        at += len(MARK)
        stops = ends.select(np.arange(n)).astype(np.int64)
        named = gaps.select(np.arange(n - n_null)) + np.array([first], np.int64).astype(np.uint64)
        yield shard, before, [None] * n_null + named.astype(np.int64).tolist(), np.concatenate(([0], stops[:-1])).astype(np.int64), stops, ids


def write(docs: DataFrame, tokenizer_path: str, path: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> None:
    """The files of the documents' ids under path, which must not be there."""
    spark = docs.sparkSession
    with open(tokenizer_path, "rb") as f:
        shipped = spark.sparkContext.broadcast(f.read())  # one vocabulary file
    rows = id_text(docs, id_col, text_col)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_BYTES))
    order = ["doc_id", "tie"]
    dealt = rows.withColumn("tie", F.xxhash64("text")).repartitionByRange(n, *order).sortWithinPartitions(*order)

    def run(batches):
        from pyspark import TaskContext

        code, shard = coder(shipped.value), TaskContext.get().partitionId()
        width = code.width
        end, held, tokens, before = end_id.to_bytes(width, "little"), [], 0, 0
        for batch in batches:
            for part in portions(batch, "text", PORTION):
                for i, ids in zip(part.column(0).to_pylist(), map(code.encode, part.column(1).to_pylist())):
                    held.append((i, ids + end))
                    tokens += len(ids) // width + 1
                    if tokens >= BLOCK_TOKENS:
                        yield pa.RecordBatch.from_arrays([pa.array([pack(shard, before, held, width)], pa.binary())], ["block"])
                        held, tokens, before = [], 0, before + tokens
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([pack(shard, before, held, width)], pa.binary())], ["block"])

    write_blocks(dealt.select("doc_id", "text").mapInArrow(run, "block binary"), path)


def read(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 (of all its ids, 4
    bytes each, low byte first), and its ids if asked for, read from the files under path. The
    shards' totals, one row each, are added up by ranges and joined."""
    schema = "shard long, doc_id long, at long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids

    def run(batches):
        import zlib

        for batch in batches:
            for n in range(batch.num_rows):
                for shard, before, named, starts, stops, ids in unpack(batch.column(0)[n].as_buffer()):
                    wide = ids.astype("<u4")
                    sums = [zlib.crc32(wide[a:b]) for a, b in zip(starts.tolist(), stops.tolist())]
                    columns = [pa.array(np.full(len(named), shard)), pa.array(named, pa.int64()), pa.array(starts + before), pa.array(stops - starts), pa.array(sums, pa.int64())]
                    if with_ids:
                        columns.append(pa.ListArray.from_arrays(pa.array(np.append(starts, len(ids)), pa.int32()), pa.array(wide.astype(np.int32))))
                    yield pa.RecordBatch.from_arrays(columns, ["shard", "doc_id", "at", "n_tokens", "ids_crc32", *["ids"] * with_ids])

    found = materialize(read_files(spark, path).mapInArrow(run, schema), "token-documents")
    totals = found.groupBy("shard").agg(F.max(F.col("at") + F.col("n_tokens")).alias("tokens"))
    placed = materialize(sums_before(totals, ["shard"], "tokens", "before").select("shard", "before"), "token-shards")
    return found.join(placed, "shard").select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


def write_and_read(docs: DataFrame, tokenizer_path: str, path: str | None = None) -> DataFrame:
    path = path or f"{scratch_path(docs.sparkSession, 'token-ids')}/blocks"
    write(docs, tokenizer_path, path)
    return read(docs.sparkSession, path)
