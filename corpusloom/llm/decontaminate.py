"""Benchmark decontamination by embedded edit distance.

Texts and items are sequences of words (lower case, letters and digits; characters of scripts
without spaces one by one), and edits are of words: put in, left out or replaced. An item leaks
if its least edit distance to any part of a text is at most MOST_EDITS of the item's length.

A CGK random walk reads a sequence with a pointer that a random function of step and word
moves on or holds: sequences at a small edit distance fall back into step after an edit, so
their walks differ in few places. Items are of length classes; a window is read from each word
of a text as far as the items of a class are long. Each table of a class has a walk of its own
and samples a few of its places, the early ones more densely, as fewer edits lie before them.
A window that has the same words there as one of an item, read from one of its STARTS rarest
words and at as many different places as are sampled, makes a candidate. A class has so many tables that simulated items with MOST_EDITS edits
at random places are found with a probability of RECALL; exact ones always are. Candidates are verified by the exact
edit distance of the whole item to the text around the window.

Windows are read lazily: only from words that an item is read from, and past the first sampled
place only if an item has the same two words. The items are given to the workers in blocks of
ITEMS; each block scans the texts once.

Defined cases: null or empty texts and items, and those without a word, match nothing; an item
of fewer words than 1 / MOST_EDITS is found only word for word, of any length down to one;
texts of any length are read whole, in bounded portions; of equal best alignments one row is
given, as only their number of edits counts; repeated rows and items each match; a null id
stays null; empty tables give an empty table; extra columns are not read.
"""

from __future__ import annotations

import functools
import random
import re
import uuid
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import cached, id_text, portions

SEED = 20240229
MOST_EDITS = 0.2
RECALL, TRIALS, MOST_TABLES = 0.99, 400, 64
CLASSES = (1, 2, 4, 8, 16, 32, 64)  # an item is of the largest class that is not above its words
STARTS = 8
ITEMS = 20_000
#: Bytes of texts handled at a time, which bound the memory of a task.
BYTES = 2 << 20
PAD = 2 * max(CLASSES)

_SPLIT = re.compile(r"[฀-໿က-႟ក-៿⺀-⿟々-〇぀-㆏ㆠ-ㇿ㐀-鿿가-힯豈-﫿\U00020000-\U0003ffff]")
_OTHER = re.compile(r"[^\w\x00-\x7f]")
_PLAIN = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256))


def words(text: str) -> list[bytes]:
    text = text.lower()
    if not text.isascii():
        text = _OTHER.sub(" ", text)
        if _SPLIT.search(text):
            text = _SPLIT.sub(r" \g<0> ", text)
    return text.encode(errors="replace").translate(_PLAIN).split()


# --- walks and tables ----------------------------------------------------------------


def _moves(ids: np.ndarray, step: int, walk: int) -> np.ndarray:
    """The random function of a walk: 0 or 1 for each word."""
    salt = np.uint64((step * 0xC2B2AE3D27D4EB4F + walk * 0x165667B19E3779F9 + SEED) % 2**64)
    h = (ids + salt) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    return (h * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(63)).astype(np.int64)


def _mix(key: np.ndarray, ids: np.ndarray) -> np.ndarray:
    key = (key ^ ids) * np.uint64(0xBF58476D1CE4E5B9)
    return key ^ key >> np.uint64(29)


def advance(ids: np.ndarray, at: np.ndarray, first: int, last: int, walk: int) -> np.ndarray:
    """Where windows read next, from step first to step last."""
    for step in range(first, last):
        at = at + _moves(ids[at], step, walk)
    return at


def sampled_steps(size: int, n: int) -> tuple[int, ...]:
    """The sampled steps of a class's n-th table besides step 0, log-uniform over a walk of its windows."""
    if size < 4:
        return (1,) * (size - 1)
    rng, most, more = random.Random(SEED * 1000 + size * 100 + n), 2 * size - 1, 1 if size < 8 else 2
    out: set[int] = set()
    while len(out) < more:
        out.add(min(most, int(most ** rng.random())))
    return tuple(sorted(out))


def _edited(rng: random.Random, item: list[int], edits: int, fresh) -> list[int]:
    out = list(item)
    for _ in range(edits):
        kind, at = rng.randrange(3), rng.randrange(len(out))
        out[at : at + (kind != 0)] = [] if kind == 1 else [next(fresh)]
    return out


@functools.lru_cache
def n_tables(size: int, most_edits: float = MOST_EDITS, recall: float = RECALL) -> int:
    """How many tables find simulated items of the class with the most edits often enough: MOST_TABLES
    for the class of 4 to 7 words, whose simulated recall stays below RECALL at that number."""
    n = size if size < 4 else -(-size // 5) * 5
    edits = int(most_edits * n)
    if not edits:
        return 1
    rng, fresh = random.Random(SEED), iter(range(1, 1 << 40))
    ids, where, begins = [0] * PAD, [], []
    for k in range(TRIALS):
        item = [next(fresh) for _ in range(n)]
        starts = sorted(rng.sample(range(n), min(n, STARTS)))
        for part in (item, _edited(rng, item, edits, fresh)):
            begins.append((len(ids), len(part)))
            ids += part + [0] * PAD
        where += [(k, begins[-2][0] + s) for s in starts]
    array, found = np.array(ids, np.uint64), np.zeros(TRIALS, bool)
    own = {int(array[p]): k for k, p in where}
    theirs = np.array([p for b, m in begins[1::2] for p in range(b, b + m) if ids[p] in own])
    for t in range(MOST_TABLES):
        sets = []
        for places, is_item in ((np.array([p for _, p in where]), True), (theirs, False)):
            at, before, key, ok = places, 0, array[places], np.ones(len(places), bool)
            for step in sampled_steps(size, t):
                last, at, before = at, advance(array, at, before, step, size * 1000 + t), step
                key, ok = _mix(key, array[at]), ok & (array[at] > 0) & (at > last)
            sets.append(dict(zip(key[ok].tolist(), array[places][ok].tolist())) if is_item else set(key[ok].tolist()))
        found[[own[w] for key, w in sets[0].items() if key in sets[1]]] = True
        if found.mean() >= recall:
            return t + 1
    return MOST_TABLES


class Table:
    """The keys of a class's windows of items under one walk."""

    def __init__(self, size: int, n: int, ids: np.ndarray, starts: np.ndarray, ends: np.ndarray, vocabulary: int):
        self.steps, self.walk = sampled_steps(size, n), size * 1000 + n
        at, before, key, self.partial = starts, 0, ids[starts], None
        ok = np.ones(len(starts), bool)
        for k, step in enumerate(self.steps):
            last, at, before = at, advance(ids, at, before, step, self.walk), step
            ok &= (at > last) & (at < ends)  # a walk that has held its place since has read nothing new
            key = _mix(key, ids[at])
            if k == 0:
                early = key
        self.first = np.zeros(vocabulary + 1, bool)
        self.first[ids[starts[ok]].astype(np.int64)] = True
        order = np.argsort(key[ok], kind="stable")
        self.keys, self.which = key[ok][order], np.flatnonzero(ok)[order]
        if len(self.steps) > 1:
            self.bits = np.uint64((1 << max(16, (16 * len(self.keys)).bit_length())) - 1)
            self.partial = np.zeros(int(self.bits) + 1, bool)
            self.partial[(early[ok] & self.bits).astype(np.int64)] = True

    def hits(self, ids: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, window of an item) wherever the keys are equal."""
        at = here = places[self.first[ids[places].astype(np.int64)]]
        before, key = 0, ids[here]
        for k, step in enumerate(self.steps):
            at, before = advance(ids, at, before, step, self.walk), step
            key = _mix(key, ids[at])
            if k == 0 and self.partial is not None:
                keep = self.partial[(key & self.bits).astype(np.int64)]
                at, here, key = at[keep], here[keep], key[keep]
        low, high = (np.searchsorted(self.keys, key, side) for side in ("left", "right"))
        n = high - low
        if not n.any():
            return here[:0], self.which[:0]
        offsets = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(here, n), self.which[np.repeat(low, n) + offsets]


class Items:
    """The tables of a block of items."""

    def __init__(self, items: list[tuple[int, str]], most_edits: float = MOST_EDITS):
        self.most_edits, self.items, self.vocabulary = most_edits, [], {}
        texts = [(i, words(t or "")) for i, t in items]
        often: dict[bytes, int] = {}
        for _, t in texts:
            for w in set(t):
                often[w] = often.get(w, 0) + 1
        self.vocabulary = {w: n for n, w in enumerate(often, 1)}
        ids, windows = [0] * PAD, {}
        for i, t in ((i, t) for i, t in texts if t):
            own, begin = [self.vocabulary[w] for w in t], len(ids)
            ids += own + [0] * PAD
            size = max(c for c in CLASSES if c <= len(t))
            places = sorted(range(len(t)), key=lambda k: (often[t[k]], k)) if len(t) >= 8 else range(len(t))
            windows.setdefault(size, []).extend((len(self.items), begin, begin + len(t), k) for k in list(places)[: STARTS if len(t) >= 8 else None])
            self.items.append((i, np.array(own, np.uint64)))
        array, self.tables = np.array(ids, np.uint64), []
        often_at = np.array([0, *often.values()])[array.astype(np.int64)]
        for size, rows in sorted(windows.items()):
            item, begin, end, offset = np.array(rows, np.int64).T
            for n in range(n_tables(size, most_edits)):
                self.tables.append((Table(size, n, array, begin + offset, end, len(self.vocabulary)), item, offset))
        # an item without a window in any table is read from each place of its rarest word
        held = {int(k) for t, item, _ in self.tables for k in item[t.which]}
        rest = [r for rows in windows.values() for r in rows if r[0] not in held]
        if rest:
            rest = list({r[0]: r for r in sorted(rest, key=lambda r: -often_at[r[1] + r[3]])}.values())
            item, begin, end, offset = np.array(rest, np.int64).T
            self.tables.append((Table(1, 0, array, begin + offset, end, len(self.vocabulary)), item, offset))
        self.start = np.zeros(len(self.vocabulary) + 1, bool)
        for t, _, _ in self.tables:
            self.start |= t.first

    def matches(self, texts: list[str]) -> list[tuple[int, int, int, int]]:
        """(text, item, edits, words of the item) of the texts' leaks, in order."""
        lists = [words(t) for t in texts]
        starts = np.cumsum([PAD] + [len(x) + PAD for x in lists])
        ids, get = np.zeros(int(starts[-1]), np.uint64), self.vocabulary.get
        for s, x in zip(starts.tolist(), lists):
            ids[s : s + len(x)] = np.fromiter(map(get, x, repeat(0)), np.uint64, len(x))
        places, pairs = np.flatnonzero(self.start[ids.astype(np.int64)]), []
        for table, item, offset in self.tables:
            at, window = table.hits(ids, places)
            if len(at):
                pairs.append(np.stack([np.searchsorted(starts, at, "right") - 1, item[window], at - offset[window]]))
        if not pairs:
            return []
        out: dict[tuple[int, int], int] = {}
        seen = None
        for d, n, place in np.unique(np.concatenate(pairs, axis=1), axis=1).T.tolist():
            own = self.items[n][1]
            most = int(self.most_edits * len(own))
            if out.get((d, n)) == 0 or seen and seen[:2] == (d, n) and place - seen[2] <= most:
                continue  # the region seen reaches as far
            seen = (d, n, place)
            begin, end = int(starts[d]), int(starts[d]) + len(lists[d])
            region = ids[max(begin, place - most) : min(end, place + len(own) + 2 * most)]
            if place >= begin and np.array_equal(ids[place : place + len(own)], own):
                edits = 0
            else:
                own, region = own.tolist(), region.tolist()
                if sum(map(set(region).__contains__, own)) < len(own) - most:
                    continue
                edits = least_edits(own, region)
            if edits <= most:
                out[d, n] = min(edits, out.get((d, n), edits))
        return [(d, n, edits, len(self.items[n][1])) for (d, n), edits in sorted(out.items())]


def least_edits(item, text) -> int:
    """The least edit distance of the item to any part of the text, with the columns of the
    distance table as bit vectors."""
    size = len(item)
    at: dict = {}
    for i, c in enumerate(item):
        at[c] = at.get(c, 0) | 1 << i
    full, top = (1 << size) - 1, 1 << (size - 1)
    up, down, score, best = full, 0, size, size
    for c in text:
        same = at.get(c, 0)
        diagonal = (((same & up) + up) ^ up) | same | down
        more, less = down | (full & ~(diagonal | up)), up & diagonal
        if more & top:
            score += 1
        elif less & top:
            score -= 1
            best = min(best, score)
        more, less = more << 1 & full, less << 1 & full
        up, down = less | (full & ~(diagonal | more)), more & diagonal
    return best


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", most_edits: float = MOST_EDITS) -> DataFrame:
    """doc_id, item_id, edits and item_words: a row for each item that a text holds."""
    spark = docs.sparkSession
    texts = id_text(docs, id_col, text_col)
    schema = "doc_id long, item_id long, edits long, item_words long"

    def scan(block: list[tuple[int, str]]) -> DataFrame:
        shipped, key = spark.sparkContext.broadcast(block), uuid.uuid4().hex  # of ITEMS items at most

        def run(batches):
            items = cached("items", key, lambda: Items(shipped.value, most_edits))
            for batch in batches:
                for part in portions(batch, "text", BYTES):
                    ids = part.column(0)
                    found = items.matches(part.column(1).to_pylist())
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array([r[0] for r in found], pa.int64())), pa.array([items.items[r[1]][0] for r in found], pa.int64()), *(pa.array([r[k] for r in found], pa.int64()) for k in (2, 3))], ["doc_id", "item_id", "edits", "item_words"])

        return texts.mapInArrow(run, schema)

    out, block = None, []
    rows = benchmark.select(benchmark[item_col].cast("long"), benchmark[item_text_col].cast("string")).where(F.length(item_text_col) > 0)
    for row in rows.toLocalIterator():
        block.append(tuple(row))
        if len(block) == ITEMS:
            out, block = scan(block) if out is None else out.union(scan(block)), []
    if block or out is None:
        out = scan(block) if out is None else out.union(scan(block))
    return out
