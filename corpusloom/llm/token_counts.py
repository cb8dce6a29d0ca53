"""Token counts through a digest cache.

Contents are keyed by the SHA-256 of their UTF-8 text (a null is normalised to the empty
text; nothing else may be normalised, or counts would change) and of the tokenizer's file.
Texts are joined to the stored counts, the distinct misses alone are encoded, and their
counts are appended to the cache, a Parquet table in a folder that all executors share (made
empty where there is none).

A miss is counted chunk by chunk with a bounded memo: the byte-level pre-tokenizer never
joins a non-space character to a space after it, so a text can be cut before any single
space between two non-space characters, and each distinct chunk is given to the library
once. A text that holds an added token's string, or whose tokenizer is of another kind, is
given to the library whole.

Defined cases: a null or empty text has 0 bytes and the count of the empty text; repeated
rows give repeated results from one encoding, and there are no ties to break; a null id stays null; texts of any length are
counted whole, a worker holding a few megabytes of them at a time; an empty table gives an
empty table; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import cached, id_text, portions
from corpusloom.sources.storage import materialize, path_exists, scratch_path

MEMO_ENTRIES = 300_000
LONGEST_KEPT = 64

_SAFE = re.compile(r"(?<=\S) (?=\S)")
#: A space with white space before it and white space or nothing after it.
_UNSAFE = re.compile(r"\s (?=\s|\Z)")


def _chunkable(spec: dict) -> bool:
    """True for byte-level pre-tokenizing with the usual pattern, no prefix space and no normalizer."""
    pre = spec.get("pre_tokenizer") or {}
    return spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and (spec.get("post_processor") or {}).get("type") in (None, "ByteLevel")


class ChunkCounts(dict):
    """chunk -> number of tokens, as the library counts it."""

    def __init__(self, data: bytes, kind: str):
        super().__init__()
        self.whole = self._library(data, kind)

    def _library(self, data: bytes, kind: str):
        if kind == "model":
            import sentencepiece

            sp = sentencepiece.SentencePieceProcessor(model_proto=data)
            self.cut = False
            return lambda text: len(sp.encode(text))
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tok, spec = Tokenizer.from_str(data.decode()), json.loads(data)
        tok.no_truncation()
        tok.no_padding()
        self.cut = _chunkable(spec)
        self.added = [x["content"] for x in spec.get("added_tokens", [])]
        self.pre, self.model = tok.pre_tokenizer, tok.model
        return lambda text: len(tok.encode(text, add_special_tokens=False).ids)

    def __missing__(self, chunk: str) -> int:
        # a chunk holds no added token: the library's own two steps, without its bookkeeping
        n = sum(len(self.model.tokenize(x)) for x, _ in self.pre.pre_tokenize_str(chunk))
        if len(chunk) <= LONGEST_KEPT:
            self[chunk] = n
        return n

    def count(self, text: str) -> int:
        if not self.cut or not text or any(x in text for x in self.added):
            return self.whole(text)
        first, *rest = _SAFE.split(text) if _UNSAFE.search(text) else text.split(" ")
        n = (self[first] if first else 0) + sum(map(self.__getitem__, [" " + x for x in rest]))
        if len(self) > MEMO_ENTRIES:
            self.clear()
        return n


def chunk_counts(data: bytes, kind: str) -> ChunkCounts:
    return cached("counts", hashlib.sha256(data).digest(), lambda: ChunkCounts(data, kind))


def count_tokens(docs: DataFrame, tokenizer_path: str, cache_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, content_digest, n_bytes, n_tokens. cache_path: the cache's folder, shared by
    runs; without one, a fresh cache is kept for this call."""
    spark = docs.sparkSession
    with open(tokenizer_path, "rb") as f:
        data = f.read()
    version, kind = hashlib.sha256(data).hexdigest(), tokenizer_path.rpartition(".")[2]
    shipped = spark.sparkContext.broadcast(data)  # one vocabulary file
    cache_path = cache_path or scratch_path(spark, "token-count-cache")
    schema = "content_digest string, tokenizer_digest string, n_tokens long"

    keyed = id_text(docs, id_col, text_col).withColumn("content_digest", F.sha2("text", 256))
    if not path_exists(spark, cache_path):
        spark.createDataFrame([], schema).write.mode("ignore").parquet(cache_path)
    stored = spark.read.schema(schema).parquet(cache_path).where(F.col("tokenizer_digest") == version)
    todo = keyed.select("content_digest", "text").join(stored.select("content_digest"), "content_digest", "left_anti")

    def run(batches):
        counts = chunk_counts(shipped.value, kind)
        for batch in batches:
            for part in portions(batch, "text"):
                found = pa.array([counts.count(t) for t in part.column(1).to_pylist()], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([version] * part.num_rows, pa.string()), found], ["content_digest", "tokenizer_digest", "n_tokens"])

    todo.dropDuplicates(["content_digest"]).mapInArrow(run, schema).write.mode("append").parquet(cache_path)
    # a lost race between two writers may store a digest twice, with the same count
    stored = spark.read.schema(schema).parquet(cache_path).where(F.col("tokenizer_digest") == version).groupBy("content_digest").agg(F.max("n_tokens").alias("n_tokens"))
    stored = materialize(stored, "token-counts")  # so that the join's sides are plain exchanges, and a digest of many copies can be split
    return keyed.select("doc_id", "content_digest", F.octet_length("text").cast("long").alias("n_bytes")).join(stored, "content_digest").select("doc_id", "content_digest", "n_bytes", "n_tokens")
