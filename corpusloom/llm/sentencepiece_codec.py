"""SentencePiece encoding and decoding by a distinct-chunk table.

No piece of the model holds a whitespace marker after another character (checked when the
model is loaded), so a merge never crosses the start of a run of markers. A text is
therefore cut before each run, each distinct marked chunk is segmented once, and the ids
are joined back by position. The table lives in the Python worker, with a bounded number
of entries: the ids of all positions never pass through a shuffle.

Defined cases: a null or empty text gives no ids but the end id; repeated rows give
repeated results, and there are no ties to break; a null id stays null; an empty table gives an empty table; any length of
text is encoded whole; columns other than the two named are not read.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import cached, id_text, portions

#: Entries of a worker's chunk table; a full table starts anew, which changes no result.
TABLE_ENTRIES = 200_000
#: Longer chunks are not kept beyond the texts at hand.
LONGEST_KEPT = 64
#: Bytes of texts handled at a time.
PORTION = 1 << 20

MARK = "▁"
_RUNS = re.compile(" +[^ ]*")


class ChunkTable(dict):
    """chunk without its first marker -> its ids, as the bytes of int32 values."""

    def __init__(self, model: bytes):
        super().__init__()
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        crossing = [p for p in map(self.sp.id_to_piece, range(self.sp.get_piece_size())) if re.search(f"[^{MARK}]{MARK}", p)]
        if crossing:
            raise ValueError(f"pieces cross whitespace markers: {crossing[:3]}")
        self.odd: dict[str, str] = {}  # chunks that do not decode to themselves
        self.size = 0

    def learn(self, chunks: set[str]) -> None:
        """Segment chunks that the table lacks, each once."""
        import array

        if len(self) > TABLE_ENTRIES or len(self.odd) > TABLE_ENTRIES:
            self.clear()
            self.odd.clear()
        new = [x for x in chunks if x not in self]
        full = [x for x in new if x]
        ids = self.sp.encode(full, num_threads=1) if full else []
        for chunk, found, back in zip(full, ids, self.sp.decode(ids, num_threads=1) if ids else []):
            self[chunk] = array.array("i", found).tobytes()
            if back != chunk:
                self.odd[chunk] = back
        if len(full) < len(new):
            self[""] = array.array("i", [self.sp.piece_to_id(MARK)]).tobytes()  # a marker alone

    def chunks(self, text: str) -> list[str]:
        """The marked chunks of a text, each without its first marker."""
        if not text:
            return []
        if MARK in text:
            text = text.replace(MARK, " ")
        if "  " in text or text[0] == " " or text[-1] == " ":
            return [x[1:] for x in _RUNS.findall(" " + text)]
        return text.split(" ")

    def encode_decode(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """The ids, as the bytes of int32 values, and the decoded text of each text."""
        parts = [self.chunks(t) for t in texts]
        self.learn({x for p in parts for x in p if x not in self} if len(self) <= TABLE_ENTRIES else {x for p in parts for x in p})
        ids = [b"".join(map(self.__getitem__, p)) for p in parts]
        if self.odd:
            odd = self.odd
            parts = [p if odd.keys().isdisjoint(p) else [odd.get(x, x) for x in p] for p in parts]
        for x in [x for p in parts for x in p if len(x) > LONGEST_KEPT]:
            self.pop(x, None)
            self.odd.pop(x, None)
        return list(zip(ids, map(" ".join, parts)))


def chunk_table(model: bytes) -> ChunkTable:
    import hashlib

    return cached("sp", hashlib.sha256(model).digest(), lambda: ChunkTable(model))


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", add_end: bool = True) -> DataFrame:
    """doc_id, ids array<int> and decoded, the text that the library's decode(ids) gives."""
    with open(model_path, "rb") as f:
        shipped = docs.sparkSession.sparkContext.broadcast(f.read())  # one vocabulary file

    def run(batches):
        import numpy as np

        table = chunk_table(shipped.value)
        end = np.array([table.sp.eos_id()] if add_end else [], "<i4").tobytes()
        for batch in batches:
            for part in portions(batch, "text", PORTION):
                pairs = table.encode_decode(part.column(1).to_pylist())
                data = [p[0] + end for p in pairs]
                offsets = np.zeros(len(data) + 1, "<i4")
                np.cumsum([len(x) // 4 for x in data], out=offsets[1:])
                values = pa.array(np.frombuffer(b"".join(data), "<i4"))
                ids = pa.ListArray.from_arrays(pa.array(offsets), values)
                yield pa.RecordBatch.from_arrays([part.column(0), ids, pa.array([p[1] for p in pairs], pa.string())], ["doc_id", "ids", "decoded"])

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def decode(tokens: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and the text of each array of ids, by the library's own decoder; null ids give an empty text."""
    with open(model_path, "rb") as f:
        shipped = tokens.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        sp = chunk_table(shipped.value).sp
        for batch in batches:
            texts = [sp.decode(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return tokens.select(tokens[id_col].alias("doc_id"), tokens[ids_col].alias("ids")).mapInArrow(run, "doc_id long, text string")


def digests(tokens: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Counts and digests of what encode() gives, and the columns to keep of it."""
    return tokens.select(
        "doc_id",
        *keep,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
