"""Alignment of two tokenizers' tokens by the bytes they cover.

A text's B tokens are a static index of byte intervals, sorted by their ends. Each A token is
a stabbing query: two bisections, made at one time for the tokens of many chunks, give the first
and the last B token that it overlaps. Byte places that no interval of either side spans, where
both sides end a token, close a group.

The A tokenizer (byte-level, from the tokenizers library) reads a space and the text; the B
tokenizer (SentencePiece) puts that space there itself. Neither lets a token reach across a
single space between two characters that are none, so a text is cut there, each distinct
chunk is aligned once and kept in the worker's bounded table, and a text's groups and links are
those of its chunks, one after the other.

How often an id pair is linked in all documents is a table that grows with them, so it is not
broadcast: texts are kept in blocks of about BLOCK_BYTES, a block's distinct pairs are added up
over all blocks, joined back, and meet the block's documents, which hold the numbers of their
pairs in it, in one group a block.

Defined cases: a null or empty text, and one whose tokens do not give back its bytes on either
side, has no tokens: zeros, and no digest; equal rows get equal results, each counted; a null id
stays null; a text of any length is aligned whole, as a block of its own if it is long; links of
a B id that tie for the highest count are all best; an empty table gives an empty table; extra
columns are not read.
"""

from __future__ import annotations

import array
import hashlib
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import cached, id_text, portions
from corpusloom.llm.spaced import LONGEST_KEPT, SpacedIds, char_of_byte
from corpusloom.llm.token_counts import _chunkable
from corpusloom.sources.storage import materialize

#: Bytes of text whose documents share one list of pairs.
BLOCK_BYTES = 16 << 20
PORTION = 1 << 20
#: Chunks of a worker's table and the one before it; one that is half of that starts anew and takes
#: from the one before what is met again, which changes no result.
TABLE_ENTRIES = 600_000

MARK = "▁"
_SAFE = re.compile(r"(?<=\S) (?=\S)")
_UNSAFE = re.compile(r"\s (?=\s|\Z)")
#: A pair is b + 2^31 a; the bit says that it is its A token's first link.
_FIRST = 1 << 62

_STORED = "kind int, block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, gaps binary, counts binary, wide boolean, pairs array<long>, times array<long>"
_RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _joined(table: list[bytes], numbers: np.ndarray) -> bytes:
    """The entries of the table one after the other; of many, some at a time, as a number in a list takes much."""
    return b"".join([b"".join(map(table.__getitem__, numbers[at : at + (1 << 16)].tolist())) for at in range(0, len(numbers), 1 << 16)])


def _gives_back(whole: list[bytes], table: list[bytes], sizes: np.ndarray, ids: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether each text is what its n ids stand for."""
    joined, ends = _joined(table, ids), np.concatenate(([0], np.cumsum(sizes[ids])))[np.cumsum(n)]
    if np.array_equal(ends, np.cumsum(np.fromiter(map(len, whole), np.int64, len(whole)))) and joined == b"".join(whole):
        return np.ones(len(whole), bool)
    ends = ends.tolist()
    return np.array([joined[s:e] == x for s, e, x in zip([0, *ends], ends, whole)], bool)


class Aligner(dict):
    """chunk, without the space before it -> its groups as text, and its links as the bytes of
    int64 pairs."""

    def __init__(self, a_file: bytes, b_file: bytes):
        import json
        import os

        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(a_file.decode())
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        if not _chunkable(json.loads(a_file)):
            raise ValueError("the first tokenizer is not byte-level")
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_file)
        self.spaced = SpacedIds(self.a, "I")
        table = {c: b for b, c in char_of_byte().items()}
        vocab = self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(vocab.values()) + 1)
        for t, i in vocab.items():
            self.a_bytes[i] = bytes(table[c] for c in t) if all(c in table for c in t) else t.encode()
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(map(self.b.id_to_piece, range(self.b.get_piece_size())))]
        self.a_sizes, self.b_sizes = (np.array(list(map(len, x)), np.int64) for x in (self.a_bytes, self.b_bytes))
        # an id's name before an id of its side, the other side's first id and the next group
        self.names = [b"%d%c" % (i, c) for i in range(max(len(self.a_bytes), len(self.b_bytes))) for c in b",|;"]
        self.name_sizes = np.array(list(map(len, self.names)), np.int64)
        self.before: dict[str, tuple[bytes, bytes]] = {}  # the table before it last started anew
        self.odd: set[str] = set()  # chunks whose tokens do not give back their bytes

    def encode(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The A ids of all chunks, how many each has, and the same of B."""
        a, b = list(map(self.spaced.of, chunks)), self.b.encode(chunks, num_threads=1)
        n_a, n_b = (np.fromiter(map(len, x), np.int64, len(chunks)) for x in (a, b))
        n_a //= array.array("I").itemsize
        return np.frombuffer(b"".join(a), np.uintc).astype(np.int64), n_a, np.fromiter(chain.from_iterable(b), np.int64, int(n_b.sum())), n_b

    def align(self, chunks: list[str]) -> list[tuple[bytes, bytes] | None]:
        """The groups and links of a space and each chunk; None if a side does not give back its bytes.
        Each A token asks the index of B's ends for the first interval that ends after its start,
        and the first that ends at its end or after: those and what is between overlap it. The
        chunks follow one another, and as both sides end a token where a chunk ends, none overlaps
        another's."""
        a, n_a, b, n_b = self.encode(chunks)
        whole = [b" " + x.encode() for x in chunks]
        good = _gives_back(whole, self.a_bytes, self.a_sizes, a, n_a) & _gives_back(whole, self.b_bytes, self.b_sizes, b, n_b)
        if not good.all():
            a, b, n_a, n_b = a[np.repeat(good, n_a)], b[np.repeat(good, n_b)], n_a[good], n_b[good]
        if not len(n_a):
            return [None] * len(chunks)
        a_sizes, b_ends = self.a_sizes[a], np.cumsum(self.b_sizes[b])
        a_ends = np.cumsum(a_sizes)
        lo, hi = np.searchsorted(b_ends, a_ends - a_sizes, "right"), np.searchsorted(b_ends, a_ends)
        links = np.cumsum(hi - lo + 1)  # so far
        first = np.concatenate(([0], links[:-1]))
        pairs = np.repeat(a, hi - lo + 1) << 31 | b[np.arange(links[-1]) - np.repeat(first - lo, hi - lo + 1)]
        pairs[first] |= _FIRST
        a_closes, b_closes = b_ends[hi] == a_ends, np.zeros(len(b), bool)  # no interval spans these places
        b_closes[hi[a_closes]] = True
        # a group's A ids stand after the B ids of the groups before it, its B ids after its A ids
        a_until, b_until = (np.concatenate(([0], np.flatnonzero(x) + 1)) for x in (a_closes, b_closes))
        names = np.empty(len(a) + len(b), np.int64)
        names[np.arange(len(a)) + b_until[np.cumsum(a_closes) - a_closes]] = a * 3 + a_closes
        names[np.arange(len(b)) + a_until[np.cumsum(b_closes) - b_closes + 1]] = b * 3 + b_closes * 2
        text, text_ends = _joined(self.names, names), np.cumsum(self.name_sizes[names])[np.cumsum(n_a + n_b) - 1].tolist()
        packed, ends = pairs.tobytes(), (links[np.cumsum(n_a) - 1] * pairs.itemsize).tolist()
        found = [(text[s : e - 1], packed[p:q]) for s, e, p, q in zip([0, *text_ends], text_ends, [0, *ends], ends)]
        if len(found) == len(chunks):
            return found
        own = iter(found)
        return [next(own) if x else None for x in good.tolist()]

    def learn(self, chunks: set[str]) -> list[str]:
        """Align the chunks that the table lacks, and give them."""
        if len(self) > TABLE_ENTRIES // 2:
            self.before = dict(self)
            self.clear()
            self.odd.intersection_update(self.before)
        self.spaced.bound(TABLE_ENTRIES)
        new = chunks.difference(self)
        old = new & self.before.keys()
        for x in old:
            self[x] = self.before[x]
        new = list(new - old)
        for x, found in zip(new, self.align(new)) if new else []:
            if found is None:
                self.odd.add(x)
            self[x] = found or (b"", b"")
        return new

    def texts(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """The groups and links of each text, empty for one without tokens."""
        parts: list[list[str]] = []
        for t in texts:
            if not t or MARK in t:  # B gives a space for a marker
                parts.append([])
            elif t[0].isspace() or _UNSAFE.search(t):
                first, *rest = _SAFE.split(" " + t)
                parts.append([first[1:], *rest])
            else:
                parts.append(t.split(" "))
        new = self.learn(set().union(*parts))
        out = []
        for t, p in zip(texts, parts):
            if self.odd and not self.odd.isdisjoint(p):
                out.append(self.align([t])[0] or (b"", b""))
                continue
            found = list(map(self.__getitem__, p))
            out.append((b";".join([x[0] for x in found]), b"".join([x[1] for x in found])))
        for x in new:
            if len(x) > LONGEST_KEPT:
                self.pop(x, None)
                self.odd.discard(x)
        return out


def aligner(a_file: bytes, b_file: bytes) -> Aligner:
    key = hashlib.sha256(a_file).digest() + hashlib.sha256(b_file).digest()
    return cached("align", key, lambda: Aligner(a_file, b_file))


class _Block:
    """Documents of about BLOCK_BYTES, their pairs numbered by the block's sorted distinct pairs."""

    def __init__(self, number: int):
        self.number, self.size, self.rows, self.pairs, self.times = number, 0, [], [], []

    def add(self, doc_id, size: int, groups: bytes, links: bytes) -> None:
        pairs = np.frombuffer(links, "<i8")
        n_a, n_links, n_groups = int(np.count_nonzero(pairs & _FIRST)), len(pairs), groups.count(b";") + bool(groups)
        # a group of a and b tokens has a + b - 1 links: each place where one side alone ends adds one
        self.rows.append((doc_id, n_a, n_links + n_groups - n_a, n_groups, n_links, hashlib.sha256(groups).hexdigest() if groups else ""))
        found, times = np.unique(pairs & (_FIRST - 1), return_counts=True)
        self.pairs.append(found)
        self.times.append(times)
        self.size += size + 64

    def batches(self):
        """The documents, and then one row of all distinct pairs and how often each is linked."""
        joined = np.concatenate(self.pairs)
        pairs, numbers = np.unique(joined, return_inverse=True)
        times = np.zeros(len(pairs), np.int64)
        np.add.at(times, numbers, np.concatenate(self.times))
        gaps, counts, wide, at = [], [], [], 0
        for own in self.times:
            mine = numbers[at : at + len(own)]
            at += len(own)
            steps = np.diff(mine, prepend=0)
            wide.append(bool(len(own)) and (int(steps.max()) > 0xFFFF or int(own.max()) > 0xFF))
            gaps.append(steps.astype("<u4" if wide[-1] else "<u2").tobytes())
            counts.append(own.astype("<u4" if wide[-1] else "u1").tobytes())
        n = len(self.rows)
        longs = [pa.array(x, pa.int64()) for x in list(zip(*self.rows))[:5]]
        none = pa.nulls(n, pa.list_(pa.int64()))
        yield self._batch([pa.array([0] * n, pa.int32()), pa.array([self.number] * n, pa.int64()), *longs, pa.array([r[5] for r in self.rows]), pa.array(gaps, pa.binary()), pa.array(counts, pa.binary()), pa.array(wide), none, none])
        if len(pairs):
            zero, lists = pa.nulls(1, pa.int64()), [pa.ListArray.from_arrays(pa.array([0, len(pairs)], pa.int32()), pa.array(x)) for x in (pairs, times)]
            yield self._batch([pa.array([1], pa.int32()), pa.array([self.number], pa.int64()), *[zero] * 5, pa.nulls(1, pa.string()), *[pa.nulls(1, pa.binary())] * 2, pa.nulls(1, pa.bool_()), *lists])

    def _batch(self, columns: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in _STORED.split(", ")])


def _encoded(docs: DataFrame, a_path: str, b_path: str, id_col: str, text_col: str) -> DataFrame:
    """_STORED rows: documents (kind 0) and blocks (kind 1)."""
    files = []
    for path in (a_path, b_path):
        with open(path, "rb") as f:
            files.append(f.read())
    shipped = docs.sparkSession.sparkContext.broadcast(files)  # two vocabulary files

    def run(batches):
        from pyspark import TaskContext

        table, number = aligner(*shipped.value), TaskContext.get().partitionId() << 32
        block = _Block(number)
        for batch in batches:
            for part in portions(batch, "text", PORTION):
                texts = part.column(1).to_pylist()
                for i, t, (groups, links) in zip(part.column(0).to_pylist(), texts, table.texts(texts)):
                    block.add(i, len(t), groups, links)
                if block.size >= BLOCK_BYTES:
                    yield from block.batches()
                    block = _Block(number := number + 1)
        if block.rows:
            yield from block.batches()

    return id_text(docs, id_col, text_col).mapInArrow(run, _STORED)


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best (links whose pair is linked as often as any of
    its B id), count_sum (how often their pairs are linked, over links) and groups_sha256."""
    stored = materialize(_encoded(docs, a_path, b_path, id_col, text_col), "aligned")
    pairs = stored.where("kind = 1").select("block", F.posexplode(F.arrays_zip("pairs", "times")).alias("number", "p")).select("block", "number", "p.pairs", "p.times")
    totals = materialize(pairs.groupBy("pairs").agg(F.sum("times").alias("total")), "pair-totals")
    b_id = F.col("pairs").bitwiseAND(F.lit((1 << 31) - 1))
    highest = totals.groupBy(b_id.alias("b")).agg(F.max("total").alias("highest"))
    judged = materialize(totals.join(highest, b_id == F.col("b")).select("pairs", "total", (F.col("total") == F.col("highest")).alias("best")), "pair-counts")
    met = materialize(pairs.select("block", "number", "pairs").join(judged, "pairs").select("block", "number", "total", "best"), "block-counts")

    def finish(key, rows, counts):
        names = [x.split()[0] for x in _RESULT.split(", ")]
        total, best = np.zeros(counts.num_rows, np.int64), np.zeros(counts.num_rows, bool)
        at = counts.column("number").to_numpy()
        total[at], best[at] = counts.column("total").to_numpy(), counts.column("best").to_numpy(zero_copy_only=False)
        n_best, sums = [], []
        for gaps, times, wide in zip(rows.column("gaps").to_pylist(), rows.column("counts").to_pylist(), rows.column("wide").to_pylist()):
            mine = np.cumsum(np.frombuffer(gaps, "<u4" if wide else "<u2").astype(np.int64))
            own = np.frombuffer(times, "<u4" if wide else "u1").astype(np.int64)
            n_best.append(int(own[best[mine]].sum()))
            sums.append(int((own * total[mine]).sum()))
        columns = {"n_best": pa.array(n_best, pa.int64()), "count_sum": pa.array(sums, pa.int64())}
        return pa.table({x: columns[x] if x in columns else rows.column(x) for x in names})

    mine = stored.where("kind = 0").select("block", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "gaps", "counts", "wide")
    return mine.groupBy("block").cogroup(met.groupBy("block")).applyInArrow(finish, _RESULT)
