"""Language-model scoring by logistic context mixing, and the unigram base beside it.

The model codes a text's bytes and an end symbol, each as nine binary decisions. For each
decision, counters found by hashing the last 1 to 5 bytes and the decisions so far predict
it; their logits are mixed by weights that a gate selects (how often the two longest
contexts were seen), and the mix is refined by an adaptive map from the last byte and the
quantised logit. A text's score is the sum of the log probabilities of its decisions.

Learning covers every learning document:

1. Their distinct 6-grams are counted, a table that grows with the corpus.
2. The counters are sums over these counts. An order's table has room for the measured number
   of its distinct contexts, up to MOST_BITS; counts over 16 bits are scaled down in pairs.
3. The weights are learned online over all grams, each weighted by its count: the grams are dealt
   by hash to parts of about PART_GRAMS, each part is learned gram after gram in a fixed order,
   and the parts' weights are averaged by what each gate has seen in a part. Each decision is
   predicted without its own occurrence.
4. The map counts, over all grams, how often a logit came with a one, again without the own
   occurrence.

What is then shipped to the workers is bounded: the counters, the weights and the map. Sums
are of integers and orders are fixed, so that partitioning, retries and the order of rows
change no score. The frozen model lets each distinct 6-gram of a piece of texts be evaluated
once, and each of its prefixes of decisions too; a worker keeps what it found in a table of
bounded size, which changes no score.

The unigram base needs a count for each word, a table that grows with the corpus, and is
joined, not broadcast: a block of texts gives its distinct words, these meet the counts by
word, and come back to their block, where the texts' words wait as numbers.

Defined cases: a null or empty text is the end token alone; a null id neither learns nor is
held out; repeated rows learn and score each, and there are no ties to break; without learning documents N and V are 0 and
the model predicts evenly; texts of any length are read whole, in portions, a longer one by
itself; the score is of the raw bytes (case and white space too), the base of the lower-cased
words; an empty table gives an empty table; extra columns are not read.
"""

from __future__ import annotations

import uuid
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import cached, id_text, portions, sum_vectors
from corpusloom.sources.storage import discard, materialize

END = 256
DECISIONS = 9
#: Bytes of each context; the bits of its table are at least LEAST_BITS and at most MOST_BITS.
CONTEXTS, LEAST_BITS, MOST_BITS = (1, 2, 3, 4, 5), 12, 22
ORDERS, LONGEST = len(CONTEXTS), max(CONTEXTS)
#: Slots for each distinct context, several times the counters it needs on average.
NODES = 32
COUNT_STEPS = (1, 2, 3, 5, 9, 20, 60)  # a gate's buckets
GATES = (len(COUNT_STEPS) + 1) ** 2
#: The logits of the map: so many steps from -MAP_RANGE to MAP_RANGE.
MAP_STEPS, MAP_RANGE = 385, 12.0
PRIOR, MAP_PRIOR = 0.1, 8.0
RATE, MINI_BATCH, PART_GRAMS = 0.05, 1024, 1 << 18
#: Bytes of texts taken together, and words of a block of the base's tables.
PIECE, BLOCK_WORDS = 2 << 20, 1 << 22
#: A worker keeps what it found for so many grams (bits), each in the one slot that its hash names.
KEPT_BITS = 22
_FIXED = 1024  # counter logits are stored in steps of 1 / _FIXED


# --- symbols and counters ------------------------------------------------------------


def symbol_keys(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A key (LONGEST bytes before, symbol) for each byte and end of the texts, and where each
    text's keys start."""
    pad = b"\0" * LONGEST
    raw = b"".join(pad + t + b"\0" for t in texts)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    b = np.frombuffer(raw, np.uint8)
    ends = np.cumsum(lengths + LONGEST) - 1
    # each place's byte and the seven before it as a number, of which all but LONGEST + 1 bytes go
    keys = np.ndarray(len(b), ">u8", b"\0" * 7 + raw, 0, (1,)).astype(np.uint64)
    keys &= np.uint64((1 << 8 * (LONGEST + 1)) - 1)
    keys <<= np.uint64(DECISIONS - 8)
    keys -= b  # the shift has doubled the last byte
    keys[ends] += np.uint64(END)  # the byte there is zero
    valid = np.ones(len(b), bool)
    for k in range(LONGEST):
        valid[ends - lengths - k] = False
    return keys[valid], np.concatenate(([0], np.cumsum(lengths[:-1])))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ x >> np.uint64(29)


@dataclass(frozen=True)
class Tables:
    """The bits of each order's table."""

    bits: tuple[int, ...]

    @property
    def slots(self) -> int:
        return sum(1 << b for b in self.bits)

    def contexts(self, keys: np.ndarray) -> list[np.ndarray]:
        """The hashed contexts of the keys, for each order."""
        return [mixed((keys >> np.uint64(DECISIONS) & np.uint64((1 << 8 * k) - 1)) * np.uint64(0x9E3779B97F4A7C15)) for k in CONTEXTS]

    def find(self, contexts: list[np.ndarray], prefix: np.ndarray, j: int):
        """For each order, the counters of the j-th decision after a prefix of decisions."""
        node = (np.uint64(1 << j) | prefix & np.uint64((1 << j) - 1)) * np.uint64(0xC2B2AE3D27D4EB4F)
        base = 0
        for own, b in zip(contexts, self.bits):
            h = own + node
            yield base + ((h ^ h >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - b)).astype(np.int64)
            base += 1 << b


def groups(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """keys ascending. Where runs of keys that are alike but for their last bits begin, and their prefixes."""
    prefix = keys >> np.uint64(bits)
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(keys)), bool), prefix[1:] != prefix[:-1])))
    return first, prefix[first]


def added(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, ascending, and the sums of their n."""
    order = np.argsort(keys)
    keys = keys[order]
    first = groups(keys, 0)[0]
    return keys[first], np.add.reduceat(n[order], first) if len(first) else n


def outcomes(keys: np.ndarray, n: np.ndarray, j: int):
    """The distinct j-th decisions with their outcomes: where each begins, its prefix, bit and count."""
    first, prefix = groups(keys, DECISIONS - 1 - j)
    return first, prefix >> np.uint64(1), (prefix & np.uint64(1)).astype(np.int64), np.add.reduceat(n, first) if len(first) else n


def _buckets(n: np.ndarray) -> np.ndarray:
    return np.searchsorted(COUNT_STEPS, n, "right")


def _step(z: np.ndarray) -> np.ndarray:
    """The map's step of a logit."""
    return np.clip((z + MAP_RANGE) * ((MAP_STEPS - 1) / (2 * MAP_RANGE)) + 0.5, 0, MAP_STEPS - 0.5).astype(np.int64)


class Learner:
    """counts: [2, slots]; weights: [GATES, ORDERS + 1]."""

    def __init__(self, tables: Tables, counts: np.ndarray, weights: np.ndarray | None = None):
        self.tables, self.counts, self.weights = tables, counts, weights
        self.mass = np.zeros(GATES)  # the counts that each gate was trained with
        if weights is None:
            self.weights = np.zeros((GATES, ORDERS + 1))
            self.weights[:, :ORDERS] = 1 / ORDERS

    def inputs(self, contexts: list[np.ndarray], prefix: np.ndarray, j: int, bit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Logits [order + bias, decision] and gates, one occurrence of the outcome taken out."""
        x, seen = np.empty((ORDERS + 1, len(prefix))), []
        for k, slots in enumerate(self.tables.find(contexts, prefix, j)):
            n1 = np.maximum(self.counts[1][slots].astype(np.float64) - bit, 0)
            n0 = np.maximum(self.counts[0][slots].astype(np.float64) - (1 - bit), 0)
            x[k] = np.log((n1 + PRIOR) / (n0 + PRIOR))
            seen.append(n0 + n1)
        x[ORDERS] = 0.3
        return x, _buckets(seen[-1]) * (len(COUNT_STEPS) + 1) + _buckets(seen[-2])

    def mix(self, x: np.ndarray, gates: np.ndarray) -> np.ndarray:
        return np.einsum("kn,nk->n", x, self.weights[gates])

    def train(self, keys: np.ndarray, n: np.ndarray) -> None:
        """Online steps over the keys in the order given."""
        squares = np.full_like(self.weights, 1e-3)
        for at in range(0, len(keys), MINI_BATCH):
            own, times = keys[at : at + MINI_BATCH], n[at : at + MINI_BATCH]
            weight = times / times.mean()
            contexts = self.tables.contexts(own)
            for j in range(DECISIONS):
                prefix, bit = own >> np.uint64(DECISIONS - j), (own >> np.uint64(DECISIONS - 1 - j) & np.uint64(1)).astype(np.int64)
                x, gates = self.inputs(contexts, prefix, j, bit)
                self.mass += np.bincount(gates, times, GATES)
                miss = weight * (bit - 1 / (1 + np.exp(-np.clip(self.mix(x, gates), -30, 30))))
                seen = np.maximum(np.bincount(gates, weight, GATES), 1)[:, None]
                step = np.stack([np.bincount(gates, miss * row, GATES) for row in x], axis=1) / seen
                squares += step**2
                self.weights += RATE * step / np.sqrt(squares)

    def refine(self, keys: np.ndarray, n: np.ndarray, sums: np.ndarray) -> None:
        """Add the counts of the map's cells [2, 256 * MAP_STEPS]. keys ascending."""
        every = self.tables.contexts(keys)
        for j in range(DECISIONS):
            first, prefix, bit, times = outcomes(keys, n, j)
            x, gates = self.inputs([c[first] for c in every], prefix, j, bit)
            at = (keys[first] >> np.uint64(DECISIONS) & np.uint64(255)).astype(np.int64) * MAP_STEPS + _step(self.mix(x, gates))
            np.add.at(sums, (bit, at), times)


def kept_slots(keys: np.ndarray) -> np.ndarray:
    return (mixed(keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - KEPT_BITS)).astype(np.int64)


class Model:
    """The frozen model. logits: of the counters, in steps of 1 / _FIXED; seen: the buckets of the
    two longest orders' counters; cells: log10 probability [outcome, last byte and step]."""

    def __init__(self, tables: Tables, logits: np.ndarray, seen: np.ndarray, weights: np.ndarray, cells: np.ndarray):
        self.tables, self.logits, self.seen, self.cells = tables, logits, seen, cells
        self.weights, self.bias = np.ascontiguousarray(weights[:, :ORDERS].T / _FIXED, np.float32), (weights[:, ORDERS] * 0.3).astype(np.float32)
        self.seen_from = tables.slots - len(seen)

    def packed(self) -> tuple:
        return self.tables, zlib.compress(self.logits, 1), zlib.compress(self.seen, 1), self.weights, self.bias, self.cells

    @classmethod
    def unpacked(cls, parts: tuple) -> Model:
        tables, logits, seen, weights, bias, cells = parts
        model = cls.__new__(cls)
        model.tables, model.weights, model.bias, model.cells = tables, weights, bias, cells
        model.logits, model.seen = np.frombuffer(zlib.decompress(logits), np.int16), np.frombuffer(zlib.decompress(seen), np.uint8)
        model.seen_from = tables.slots - len(model.seen)
        return model

    def log10(self, keys: np.ndarray) -> np.ndarray:
        """log10 probability of each key's symbol after its context. keys ascending and distinct."""
        out, every = np.zeros(len(keys)), self.tables.contexts(keys)
        for j in range(DECISIONS):
            first, prefix = groups(keys, DECISIONS - j)
            found = list(self.tables.find([np.take(c, first) for c in every], prefix, j))
            gates = np.take(self.seen, found[-1] - self.seen_from) * np.uint8(len(COUNT_STEPS) + 1) + np.take(self.seen, found[-2] - self.seen_from)
            z = np.take(self.bias, gates)
            for w, slots in zip(self.weights, found):
                z += np.take(w, gates) * np.take(self.logits, slots)
            at = (prefix >> np.uint64(j) & np.uint64(255)).astype(np.int64) * MAP_STEPS + _step(z)
            at = np.repeat(at, np.diff(np.append(first, len(keys))))
            at += (keys >> np.uint64(DECISIONS - 1 - j) & np.uint64(1)).astype(np.int64) * self.cells.shape[1]
            out += np.take(self.cells, at)  # of both rows, one after the other
        return out

    def score(self, texts: list[bytes]) -> np.ndarray:
        """log10 probability of each text. Of grams met before, what is kept is taken."""
        keys, starts = symbol_keys(texts)
        if not hasattr(self, "kept"):  # keys + 1, and what was found for them
            self.kept = np.zeros(1 << KEPT_BITS, np.uint64), np.zeros(1 << KEPT_BITS)
        kept, values = self.kept
        found, missed = np.empty(len(keys)), []
        for at in range(0, len(keys), 1 << 16):
            own = keys[at : at + (1 << 16)]
            slots = kept_slots(own)
            np.take(values, slots, out=found[at : at + len(own)])
            missed.append(np.flatnonzero(np.take(kept, slots) != own + np.uint64(1)) + at)
        where = np.concatenate(missed)
        if len(where):
            own = keys[where]
            distinct = np.unique(own)
            fresh = self.log10(distinct)
            found[where] = fresh[np.searchsorted(distinct, own)]
            slots, last = np.unique(kept_slots(distinct), return_index=True)
            kept[slots], values[slots] = distinct[last] + np.uint64(1), fresh[last]
        return np.add.reduceat(found, starts)


def freeze(learner: Learner, sums: np.ndarray) -> Model:
    """The model of the learned weights and the map's counts."""
    slots = learner.tables.slots
    logits, seen = np.empty(slots, np.int16), np.empty(slots, np.uint8)
    for at in range(0, slots, 1 << 20):
        own = slice(at, at + (1 << 20))
        n0, n1 = (c[own].astype(np.float32) for c in learner.counts)
        logits[own] = np.rint(np.log((n1 + np.float32(PRIOR)) / (n0 + np.float32(PRIOR))) * _FIXED)
        seen[own] = _buckets(n0 + n1)
    seen = seen[-sum(1 << b for b in learner.tables.bits[-2:]) :]
    z = np.tile(np.linspace(-MAP_RANGE, MAP_RANGE, MAP_STEPS), 256)
    p = 1 / (1 + np.exp(-z))
    z = (z + np.log((sums[1] + MAP_PRIOR * p) / (sums[0] + MAP_PRIOR * (1 - p)))) / 2
    return Model(learner.tables, logits, seen, learner.weights, -np.stack((np.logaddexp(0, z), np.logaddexp(0, -z))) / np.log(10))


# --- learning ------------------------------------------------------------------------


def held_out(id_col):
    return F.coalesce(F.crc32(id_col.cast("string")) % 5 == 1, F.lit(False))


def count_keys(learning: DataFrame) -> DataFrame:
    """last, key, n: the distinct grams of the learning texts, each task's counts pre-aggregated.
    Grams with the same three last bytes come together, so that tasks share few counters."""

    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def together():
            return added(*map(np.concatenate, zip(*held)))

        for batch in batches:
            for part in portions(batch, "text", PIECE):
                keys = np.sort(symbol_keys(part.column(0).cast(pa.binary()).to_pylist())[0])
                first = groups(keys, 0)[0]
                held.append((keys[first], np.diff(first, append=len(keys))))
                if len(held) >= 16:
                    held = [together()]
                    if len(held[0][0]) > 2_000_000:
                        yield out(held.pop())
        if held:
            yield out(together())

    def out(found):
        return pa.RecordBatch.from_arrays([pa.array((found[0] >> np.uint64(DECISIONS) & np.uint64(0xFFFFFF)).astype(np.int32)), pa.array(found[0].view(np.int64)), pa.array(found[1])], ["last", "key", "n"])

    return learning.mapInArrow(run, "last int, key long, n long").repartition("last").groupBy("last", "key").agg(F.sum("n").alias("n"))


def _sorted_rows(batches):
    """Keys, ascending, and counts, of bounded parts."""
    for batch in batches:
        for at in range(0, batch.num_rows, 1 << 16):
            part = batch.slice(at, 1 << 16)
            keys, n = part.column("key").to_numpy().view(np.uint64), part.column("n").to_numpy()
            order = np.argsort(keys)
            yield keys[order], n[order]


def averaged(parts: list[tuple[bytes, bytes]]) -> np.ndarray:
    """The parts' weights, averaged for each gate by what it has seen there (weights, mass)."""
    mass = np.stack([np.frombuffer(bytes(m)) for _, m in parts])
    share = mass + (mass.sum(axis=0) == 0)  # a gate that no part has seen is alike in all
    weights = np.stack([np.frombuffer(bytes(w)).reshape(GATES, ORDERS + 1) for w, _ in parts])
    return (weights * share[:, :, None]).sum(axis=0) / share.sum(axis=0)[:, None]


def learn(learning: DataFrame) -> Model:
    """A model of the texts of the one column of learning."""
    context = learning.sparkSession.sparkContext
    grams = materialize(count_keys(learning), "lm-grams")
    own = lambda k: F.shiftright("key", DECISIONS).bitwiseAND(F.lit((1 << 8 * k) - 1))
    facts = grams.agg(F.count("*").alias("rows"), *[F.approx_count_distinct(own(k), 0.02).alias(f"c{k}") for k in CONTEXTS]).first()
    tables = Tables(tuple(min(MOST_BITS, max(LEAST_BITS, (NODES * facts[f"c{k}"]).bit_length())) for k in CONTEXTS))

    def counters(batches):
        import pandas as pd

        for keys, n in _sorted_rows(batches):
            every, rows = tables.contexts(keys), ([], [], [])
            for j in range(DECISIONS):
                first, prefix, bit, times = outcomes(keys, n, j)
                for slots in tables.find([c[first] for c in every], prefix, j):
                    for column, part in zip(rows, (slots, times * (1 - bit), times * bit)):
                        column.append(part)
            slots, n0, n1 = map(np.concatenate, rows)
            where, at = pd.factorize(slots)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), *(pa.array(np.bincount(where, c, len(at)).astype(np.int64)) for c in (n0, n1))], ["slot", "n0", "n1"])

    found = grams.select("key", "n").mapInArrow(counters, "slot int, n0 long, n1 long").groupBy("slot").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    scale = F.ceil(F.greatest("n0", "n1") / 65535)
    packed = found.select("slot", ((F.col("n0") / scale).cast("long") + (F.col("n1") / scale).cast("long") * 65536 - (1 << 31)).cast("int").alias("both")).toArrow()  # the tables' slots at most
    counts, both = np.zeros((2, tables.slots), np.uint16), packed.column("both").to_numpy().astype(np.int64) + (1 << 31)
    slot = packed.column("slot").to_numpy()
    counts[0][slot], counts[1][slot] = both & 65535, both >> 16
    del packed, both, slot
    shipped, tag = context.broadcast(zlib.compress(counts, 1)), uuid.uuid4().hex  # most of a table is small or empty

    def table():
        return cached("lm", tag, lambda: np.frombuffer(zlib.decompress(shipped.value), np.uint16).reshape(2, -1))

    parts = max(1, -(-facts.rows // PART_GRAMS))  # of the grams alone, not of the partitions

    def train(rows):
        keys, n = rows.column("key").to_numpy().view(np.uint64), rows.column("n").to_numpy().astype(np.float64)
        order = np.lexsort((keys, mixed(keys)))
        learner = Learner(tables, table())
        learner.train(keys[order], n[order])
        return pa.table({"part": rows.column("part")[:1], "weights": pa.array([learner.weights.tobytes()], pa.binary()), "mass": pa.array([learner.mass.tobytes()], pa.binary())})

    dealt = grams.select(F.pmod(F.xxhash64(F.lit(1), "key"), F.lit(parts)).cast("int").alias("part"), "key", "n")
    rows = dealt.repartition(parts, "part").groupBy("part").applyInArrow(train, "part int, weights binary, mass binary").collect()  # some kilobytes a part
    weights = averaged([(r.weights, r.mass) for r in sorted(rows, key=lambda r: r.part)]) if rows else None

    def refine(batches):
        learner, sums = Learner(tables, table(), weights), np.zeros((2, 256 * MAP_STEPS), np.int64)
        for keys, n in _sorted_rows(batches):
            learner.refine(keys, n, sums)
        if sums.any():
            cells = sums.reshape(2 * 256, MAP_STEPS)
            some = np.flatnonzero(cells.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([cells[k].tobytes() for k in some], pa.binary())], ["key", "counts"])

    sums = np.zeros((2 * 256, MAP_STEPS), np.int64)
    for key, own in sum_vectors(grams.select("key", "n").mapInArrow(refine, "key int, counts binary")).items():
        sums[key] = own
    shipped.destroy()  # nothing reads the raw counters any more
    discard(grams)
    return freeze(Learner(tables, counts, weights), sums.reshape(2, -1))


# --- scoring -------------------------------------------------------------------------


class Numbers(dict):
    """Numbers the keys in the order in which they are first asked for."""

    def __missing__(self, key) -> int:
        return self.setdefault(key, len(self))


_BLOCKS = "block long, ids array<long>, held array<boolean>, learns array<boolean>, bytes array<long>, tokens array<long>, scores array<double>, starts array<long>, terms array<int>, times array<int>, local int, word binary, n long"


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_bytes, n_tokens, n_known, train_tokens, base_score, score (both
    log10) and bits_per_byte (the model's, the end symbol counted as a byte)."""
    spark = docs.sparkSession
    rows = id_text(docs, id_col, text_col).select("doc_id", "text", held_out(F.col("doc_id")).alias("held"), (F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).alias("learns"))
    learned_model = learn(rows.where("learns").select("text"))
    shipped = spark.sparkContext.broadcast(learned_model.packed())  # the tables' slots at most
    tag = uuid.uuid4().hex
    out_schema = pa.schema([("block", pa.int64()), ("ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("learns", pa.list_(pa.bool_())), ("bytes", pa.list_(pa.int64())), ("tokens", pa.list_(pa.int64())), ("scores", pa.list_(pa.float64())), ("starts", pa.list_(pa.int64())), ("terms", pa.list_(pa.int32())), ("times", pa.list_(pa.int32())), ("local", pa.int32()), ("word", pa.binary()), ("n", pa.int64())])

    def run(batches):
        from collections import Counter

        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        model = cached("lm", tag, lambda: Model.unpacked(shipped.value))
        table = Numbers()
        doc_rows: list[tuple] = []
        words = 0

        def flush():
            nonlocal block, words
            if not doc_rows:
                return
            terms, times = [r[6] for r in doc_rows], [r[7] for r in doc_rows]
            starts = np.concatenate(([0], np.cumsum([len(t) for t in terms])))[:-1]
            row = {k: [r[n] for r in doc_rows] for n, k in enumerate(("ids", "held", "learns", "bytes", "tokens", "scores"))} | {"block": block, "starts": starts, "terms": np.concatenate(terms), "times": np.concatenate(times)}
            yield pa.RecordBatch.from_arrays([pa.array([row.get(f.name)], f.type) for f in out_schema], schema=out_schema)
            doc_rows.clear()
            names, n = list(table), len(table)
            table.clear()
            own = [k for k, x in enumerate(row["learns"]) if x]
            learned = np.bincount(np.concatenate([np.zeros(0, np.int32), *(terms[k] for k in own)]), np.concatenate([np.zeros(0), *(times[k] for k in own)]), n).astype(np.int64)
            for at in range(0, n, 50_000):
                size = min(50_000, n - at)
                cols = {"block": pa.array(np.full(size, block)), "local": pa.array(np.arange(at, at + size, dtype=np.int32)), "word": pa.array(names[at : at + size], pa.binary()), "n": pa.array(learned[at : at + size], pa.int64())}
                yield pa.RecordBatch.from_arrays([cols[f.name] if f.name in cols else pa.nulls(size, f.type) for f in out_schema], schema=out_schema)
            block += 1
            words = 0

        for batch in batches:
            for part in portions(batch, "text", PIECE):
                texts = part.column(1).cast(pa.binary()).to_pylist()
                for i, t, held, learns, s in zip(part.column(0).to_pylist(), texts, part.column(2).to_pylist(), part.column(3).to_pylist(), model.score(texts).tolist()):
                    found = Counter(t.lower().split())
                    # a last term of no times, so that no text is without one
                    local, times = np.zeros(len(found) + 1, np.int32), np.zeros(len(found) + 1, np.int32)
                    local[:-1] = list(map(table.__getitem__, found))
                    times[:-1] = list(found.values())
                    size = sum(found.values())
                    doc_rows.append((i, held, learns, len(t), size + 1, s, local, times))
                    words += size
                    if words >= BLOCK_WORDS:
                        yield from flush()
        yield from flush()

    both = materialize(rows.mapInArrow(run, _BLOCKS), "lm-blocks")
    blocks = both.where("local is null").drop("local", "word", "n")
    words = both.where("local is not null").select("block", "local", "word", "n").repartition("word")
    counts = words.groupBy("word").agg(F.sum("n").alias("c"), F.min("block").alias("first"))
    joined = materialize(words.join(counts, "word").select("block", "local", "c", "n", (F.col("block") == F.col("first")).alias("once")), "lm-words")
    ends = blocks.select(F.coalesce(F.sum(F.size(F.filter("learns", lambda x: x))), F.lit(0)).alias("e")).first().e
    sums = joined.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum((F.col("once") & (F.col("c") > 0)).cast("long")), F.lit(0)).alias("v")).first()
    total, distinct = sums.n + ends, sums.v + (1 if ends else 0)

    back = joined.select("block", F.col("local").cast("int").alias("local"), "c")

    def base(key, left, right):
        at, c = right.column("local").to_numpy(), right.column("c").to_numpy()
        by_local = np.zeros(int(at.max()) + 1 if len(at) else 1, np.int64)
        by_local[at] = c
        row = {k: left.column(k)[0].values for k in ("ids", "held", "bytes", "tokens", "scores", "starts", "terms", "times")}
        terms, times, starts = (row[k].to_numpy() for k in ("terms", "times", "starts"))
        seen = by_local[terms]
        logs, known = (np.add.reduceat(x, starts) for x in (times * np.log10(seen + 0.5), (times * (seen > 0)).astype(np.int64)))
        tokens = row["tokens"].to_numpy()
        score = logs + np.log10(ends + 0.5) - tokens * np.log10(total + 0.5 * (distinct + 1))
        n = len(tokens)
        bits = row["scores"].to_numpy() * -np.log2(10) / (row["bytes"].to_numpy() + 1)
        return pa.table({"doc_id": row["ids"], "held_out": row["held"], "n_bytes": row["bytes"], "n_tokens": row["tokens"], "n_known": pa.array(known + (1 if ends else 0)), "train_tokens": pa.array(np.full(n, total, np.int64)), "base_score": pa.array(score), "score": row["scores"], "bits_per_byte": pa.array(bits)})

    return blocks.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(base, "doc_id long, held_out boolean, n_bytes long, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double")
