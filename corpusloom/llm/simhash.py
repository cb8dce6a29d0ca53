"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints: a 64-bit majority of the XXH64 values of word shingles. Equal fingerprints
are one node. Two fingerprints link at TAU or fewer differing bits:

1. The 64 bits are dealt into m partitions so that correlated bits share a partition; m is
   the number for which the estimated work is least.
2. For each fingerprint, dynamic programming allots a threshold to each partition (-1: not
   probed), with the sum TAU - m + 1, so that the estimated number of candidates and probes
   is least. By the principle, a fingerprint within TAU differs by no more than the threshold
   in some partition. The estimates come from histograms of 8-bit blocks of the partitions,
   a few thousand counts over all fingerprints.
3. Each fingerprint probes its partitions' values within the thresholds, and the candidates
   are verified with all bits.

A value that more than BUCKET fingerprints share in a partition would give all pairs of a
group. The fingerprints that hold such a value, and those that probe it, take an exact way
that is linear in their number: each gives the 65 values within one bit of itself, and those
that meet in a value link with the smallest there. Two fingerprints differ in at most two
bits exactly if they meet so. The others still find them, as they are in the index of the
values that few share.

similar() finds texts by a similarity of their shingles, of which the bits are only a sample:
it takes COPIES fingerprints of a text's set of shingles, by independent mixes of the hashes.
Each is searched as above for SIMILAR_TAU bits; what meets in it and differs in MOST_BITS of
it or fewer, and in at most MOST_SHARE of all copies' bits, is a candidate, whose Jaccard
similarity is verified on the whole sets. Crowded values are handled by components: their
holders are compared with one of them, in REPRESENTATIVES rounds; those outside the largest
component of a value are then compared with all its holders of other components. What meets
in other values is compared across components. Pairs left out lie in one already. Texts of a
similarity of 0.8 differ in 15 % of the bits on average, with chance, so a pair is found with
a probability: 0.9 at 0.8 and over 0.99 from 0.9 on; the README has the measured recall.

Defined cases: a null or empty text, or one without a word, has the fingerprint zero, which
links like any other; in similar() such texts are copies of one another, and a text of fewer
words than a shingle is one shingle. A null id gets a component but cannot name one unless a
component has no other id, whose component_id is null (ids of similar() are keys: none is
null or there twice). Repeated rows get equal results. Texts of any length are read whole.
Empty tables give empty tables. Extra columns are not read.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import id_text, portions, sum_vectors
from corpusloom.llm.components import connected_components
from corpusloom.sources.storage import materialize

SHINGLE, SEED, BITS = 3, 42, 64
TAU = 2
BUCKET = 64
BLOCK = 8
#: similar(): words of a shingle, the similarity as a fraction, fingerprints, and their bits.
SIMILAR_SHINGLE, NUM, DEN = 5, 4, 5
COPIES, SIMILAR_TAU = 8, 3
#: Bits in which 99 % of the pairs at that similarity differ, of a copy in which they have met, and the share of all.
MOST_BITS, MOST_SHARE = 13, 0.19
REPRESENTATIVES = 3
#: Cost of one probe in candidates verified.
PROBE_COST = 1.0
#: Shingles hashed at a time, so that a very long text needs no more memory than a long one.
PIECE = 1 << 16


def fingerprint(text: bytes) -> int:
    """Unsigned; a bit is 1 if over half of the shingles' hashes have it."""
    import xxhash

    words = text.lower().split()  # bytes: lower-cases A-Z, splits at \x20 and \x09-\x0d
    if not words:
        return 0
    digest, joined = xxhash.xxh64_intdigest, b" ".join(words)
    n = max(1, len(words) - SHINGLE + 1)
    if n == 1:
        return digest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[: n - 1])).tolist()
    ends = (ends[SHINGLE - 1 :] - 1).tolist()
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, PIECE):
        hashes = np.array([digest(joined[s:e], SEED) for s, e in zip(starts[at : at + PIECE], ends[at : at + PIECE])], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long."""

    def run(batches):
        for batch in batches:
            for part in portions(batch, "text"):
                fps = np.array([fingerprint(t) for t in part.column(1).cast(pa.binary()).to_pylist()], "<u8")
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fps.view("<i8"))], ["doc_id", "fp"])

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, fp long")


def _bits(fps: np.ndarray) -> np.ndarray:
    return np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def correlations(nodes: DataFrame, copies: int = 1) -> list[tuple[int, np.ndarray]]:
    """nodes: fps, an array of fingerprints. For each of its places, the number of fingerprints
    and, for each pair of bits, how many have both; one pass for all."""

    def run(batches):
        total, n = np.zeros((copies, BITS, BITS)), 0
        for batch in batches:
            fps = batch.column(0).flatten().to_numpy().reshape(-1, copies)
            for k in range(copies):
                x = _bits(np.ascontiguousarray(fps[:, k])).astype(np.float32)
                total[k] += x.T @ x
            n += len(fps)
        rows = [r for t in total for r in (*t.astype(np.int64), np.full(BITS, n))]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(rows)), pa.int32()), pa.array([r.astype(np.int64).tobytes() for r in rows], pa.binary())], ["key", "counts"])

    sums = sum_vectors(nodes.select("fps").mapInArrow(run, "key int, counts binary"))
    at = lambda k, row: sums.get(k * (BITS + 1) + row, np.zeros(BITS, np.int64))
    return [(int(at(k, BITS)[0]), np.array([at(k, row) for row in range(BITS)], np.float64)) for k in range(copies)]


def deal(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """m partitions of the bits of nearly equal size; the most correlated bits go together."""
    if not n:
        return [list(range(k, BITS, m)) for k in range(m)]
    p = np.diag(both) / n
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    rho = np.abs((both / n - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(rho, 0)
    free, parts = set(range(BITS)), []
    for k in range(m):
        size, part = (BITS - sum(map(len, parts))) // (m - k), []
        while len(part) < size:
            pull = {b: (rho[b, part].mean() if part else rho[b, sorted(free)].sum()) for b in free}
            best = max(sorted(pull), key=pull.get)
            part.append(best)
            free.remove(best)
        parts.append(sorted(part))
    return parts


def _blocks(parts: list[list[int]]) -> list[tuple[int, list[int]]]:
    return [(k, part[at : at + BLOCK]) for k, part in enumerate(parts) for at in range(0, len(part), BLOCK)]


def _values(bits: np.ndarray, block: list[int]) -> np.ndarray:
    return bits[:, block].astype(np.int64) @ (1 << np.arange(len(block)))


def histograms(nodes: DataFrame, parts: list[list[list[int]]]) -> list[dict[int, np.ndarray]]:
    """How many fingerprints have each value of each block, for each place of nodes' fps."""
    blocks = [_blocks(p) for p in parts]
    own = [(k, n, block) for k, b in enumerate(blocks) for n, (_, block) in enumerate(b)]

    def run(batches):
        sums = np.zeros((len(own), 1 << BLOCK), np.int64)
        for batch in batches:
            fps = batch.column(0).flatten().to_numpy().reshape(-1, len(parts))
            bits = [_bits(np.ascontiguousarray(fps[:, k])) for k in range(len(parts))]
            for row, (k, _, block) in enumerate(own):
                sums[row] += np.bincount(_values(bits[k], block), minlength=1 << BLOCK)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(own)), pa.int32()), pa.array([r.tobytes() for r in sums], pa.binary())], ["key", "counts"])

    sums = sum_vectors(nodes.select("fps").mapInArrow(run, "key int, counts binary"))
    return [{n: sums[row] for row, (j, n, _) in enumerate(own) if j == k and row in sums} for k in range(len(parts))]


@functools.lru_cache
def _distances(size: int) -> np.ndarray:
    """The differing bits of all pairs of block values."""
    return np.array([[bin(a ^ b).count("1") for b in range(size)] for a in range(size)])


class Allotment:
    """The thresholds of each fingerprint and the estimated work they cost."""

    def __init__(self, parts: list[list[int]], n: int, hists: dict[int, np.ndarray], tau: int = TAU):
        self.parts, self.n, self.tau, self.blocks = parts, n, tau, _blocks(parts)
        # share of the fingerprints at each distance from each block value
        self.near = []
        for k, (_, block) in enumerate(self.blocks):
            size = 1 << len(block)
            away = _distances(size)
            hist = hists.get(k, np.zeros(1 << BLOCK))[:size] / max(n, 1)
            self.near.append(np.stack([(away == d) @ hist for d in range(tau + 1)], axis=1))

    def candidates(self, bits: np.ndarray) -> np.ndarray:
        """[fingerprint, partition, threshold 0..tau]: estimated number within the threshold."""
        out = np.zeros((len(bits), len(self.parts), self.tau + 1))
        for k in range(len(self.parts)):
            at = np.zeros((len(bits), self.tau + 1))
            at[:, 0] = 1
            for (part, block), near in zip(self.blocks, self.near):
                if part == k:
                    here = near[_values(bits, block)]
                    at = np.stack([sum(at[:, i] * here[:, d - i] for i in range(d + 1)) for d in range(self.tau + 1)], axis=1)
            out[:, k] = self.n * np.cumsum(at, axis=1)
        return out

    def thresholds(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """[fingerprint, partition] thresholds, and each fingerprint's least cost."""
        from math import comb

        m, tau, bits = len(self.parts), self.tau, _bits(fps)
        cost = np.zeros((len(fps), m, tau + 2))  # index 0 is the threshold -1
        cost[:, :, 1:] = self.candidates(bits)
        for k, part in enumerate(self.parts):
            cost[:, k, 1:] += PROBE_COST * np.cumsum([comb(len(part), d) for d in range(tau + 1)])
        goal = tau + 1  # the sum of (threshold + 1) over the partitions
        best = np.full((len(fps), goal + 1), np.inf)
        best[:, 0] = 0
        choice = np.zeros((len(fps), m, goal + 1), np.int8)
        for k in range(m):
            new = np.full_like(best, np.inf)
            for s in range(goal + 1):
                for t in range(min(s, tau + 1) + 1):
                    total = best[:, s - t] + cost[:, k, t]
                    less = total < new[:, s]
                    new[less, s], choice[less, k, s] = total[less], t
            best = new
        left, out = np.full(len(fps), goal), np.zeros((len(fps), m), np.int8)
        for k in reversed(range(m)):
            took = choice[np.arange(len(fps)), k, left]
            out[:, k], left = took - 1, left - took
        return out, best[:, goal]

    def probes(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """part, value (the fingerprint's bits of the partition, some flipped) and fingerprint."""
        from itertools import combinations

        thresholds, _ = self.thresholds(fps)
        out: tuple[list, list, list] = ([], [], [])
        for k, part in enumerate(self.parts):
            mask = np.uint64(sum(1 << b for b in part))
            for d in range(self.tau + 1):
                own = fps[thresholds[:, k] >= d]
                for flipped in combinations(part, d) if len(own) else ():
                    out[0].append(np.full(len(own), k, np.int32))
                    out[1].append((own ^ np.uint64(sum(1 << b for b in flipped))) & mask)
                    out[2].append(own)
        return tuple(np.concatenate(x) if x else np.zeros(0, t) for x, t in zip(out, (np.int32, np.uint64, np.uint64)))


def _mask(part: list[int]) -> int:
    mask = sum(1 << b for b in part)
    return mask - (1 << 64) if mask >> 63 else mask


def allot(nodes: DataFrame, sizes: tuple[int, ...] = (2, 3, 4), tau: int = TAU, copies: int = 1) -> list[Allotment]:
    """nodes: fps, an array of fingerprints. For each of its places: the number of partitions for
    which an even corpus of this size costs least, the bits dealt by their correlations, and the
    histograms of all fingerprints."""
    found, parts = correlations(nodes, copies), []
    even: dict[int, float] = {}
    for n, both in found:
        even = even or {m: Allotment(deal(0, both, m), n, {k: np.full(1 << BLOCK, n / (1 << BLOCK)) for k in range(BITS)}, tau).thresholds(np.zeros(1, np.uint64))[1][0] for m in sizes}
        parts.append(deal(n, both, min(even, key=even.get)))
    return [Allotment(p, n, h, tau) for p, (n, _), h in zip(parts, found, histograms(nodes, parts))]


def links(nodes: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """nodes: distinct fp. Returns a, b: links that join every pair within TAU bits into one
    component; every link returned is such a pair."""
    assert TAU == 2, "the way of crowded values meets pairs of two bits"
    (plan,) = allot(nodes.select(F.array("fp").alias("fps")))  # partitions and a few thousand shares
    index = nodes.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(_mask(p))) for p in plan.parts])).alias("part", "value"))
    heavy = materialize(index.groupBy("part", "value").count().where(F.col("count") > bucket).select("part", "value"), "simhash-heavy")
    crowded = heavy.limit(1).count() > 0
    light = index
    if crowded:
        grouped = materialize(index.join(heavy, ["part", "value"], "left_semi").select("fp").distinct(), "simhash-grouped")
        light = index.join(heavy, ["part", "value"], "left_anti")
        nodes = nodes.join(grouped, "fp", "left_anti")

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part, value, fp = plan.probes(batch.column(0).slice(at, 2048).to_numpy().view("<u8"))
                yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(value.view("<i8")), pa.array(fp.view("<i8"))], ["part", "value", "probe"])

    probes = nodes.select("fp").mapInArrow(run, "part int, value long, probe long")
    if crowded:
        probes = materialize(probes, "simhash-probes")
    found = (probes.join(heavy, ["part", "value"], "left_anti") if crowded else probes).join(light, ["part", "value"])
    pairs = found.where((F.col("probe") != F.col("fp")) & (F.bit_count(F.col("probe").bitwiseXOR(F.col("fp"))) <= TAU)).select(F.col("probe").alias("a"), F.col("fp").alias("b"))
    if not crowded:
        return pairs
    near = grouped.union(probes.join(heavy, ["part", "value"], "left_semi").select("probe")).distinct()
    flips = F.array(F.lit(0).cast("long"), *[F.lit(_mask([b])).cast("long") for b in range(BITS)])
    met = near.select("fp", F.explode(flips).alias("flip")).groupBy(F.col("fp").bitwiseXOR(F.col("flip")).alias("at")).agg(F.collect_set("fp").alias("fps"))  # 65 at most
    stars = met.where(F.size("fps") > 1).select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a <> b")
    return pairs.union(stars)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (signed long), fingerprint (16 lower-case hex digits) and component_id, the
    smallest doc_id that links reach."""
    rows = materialize(fingerprints(docs, id_col, text_col), "simhash-fingerprints")
    nodes = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-nodes")
    members = connected_components(links(nodes.select("fp")))
    # the smallest id of each component, then of each of its fingerprints
    both = members.select("node", "root").union(members.select("root", "root").distinct())
    firsts = materialize(both.join(nodes, both.node == nodes.fp).groupBy("root").agg(F.min("first_id").alias("component_id")), "simhash-roots")
    owned = materialize(members.join(firsts, "root").select(F.col("node").alias("fp"), "component_id").union(firsts.select("root", "component_id")), "simhash-members")
    labels = materialize(nodes.join(owned, "fp", "left").select("fp", F.coalesce("component_id", "first_id").alias("component_id")), "simhash-labels")
    return rows.join(labels, "fp").select("doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# --- by similarity of shingles -------------------------------------------------------


def shingle_set(text: bytes, known: dict[bytes, int], size: int = SIMILAR_SHINGLE) -> np.ndarray:
    """The distinct hashes of the text's shingles, ascending. known: words' hashes, a memo."""
    import xxhash

    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(known) > 1 << 16:
        known.clear()
    for w in words:
        if w not in known:
            known[w] = xxhash.xxh64_intdigest(w, SEED)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    n = max(1, len(words) - size + 1)
    out = np.full(n, min(len(words), size), np.uint64)
    for k in range(min(len(words), size)):
        out = (out ^ h[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.unique(out)


def set_fingerprints(hashes: np.ndarray, copies: int = COPIES) -> np.ndarray:
    """The majority bits of the set's hashes, mixed anew for each copy."""
    salts = np.array([(k + 1) * 0xD6E8FEB86659FD93 % 2**64 for k in range(copies)], np.uint64)[:, None]
    ones, step = np.zeros((copies, BITS), np.int64), PIECE // copies
    for at in range(0, len(hashes), step):
        h = hashes[at : at + step] ^ salts
        h = (h ^ h >> np.uint64(32)) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        ones += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(copies, -1, 8), axis=2, bitorder="little").sum(axis=1, dtype=np.int64)
    return np.packbits(2 * ones > len(hashes), axis=1, bitorder="little").view("<u8")[:, 0]


def _sets(texts: DataFrame) -> DataFrame:
    """node, shingles: the whole sets of the texts (node, text)."""

    def run(batches):
        known: dict[bytes, int] = {}
        for batch in batches:
            for part in portions(batch, "text"):
                own = [shingle_set(t, known) for t in part.column("text").cast(pa.binary()).to_pylist()]
                starts = pa.array(np.concatenate(([0], np.cumsum([len(x) for x in own]))), pa.int32())
                values = pa.array(np.concatenate([np.zeros(0, np.uint64), *own]).view(np.int64))
                yield pa.RecordBatch.from_arrays([part.column("node"), pa.ListArray.from_arrays(starts, values)], ["node", "shingles"])

    return texts.select("node", "text").mapInArrow(run, "node long, shingles array<long>")


def _met(nodes: DataFrame, plans: list[Allotment]) -> tuple[DataFrame, DataFrame]:
    """nodes: node, fps, root. The index and the probes: copy, value (of some partition, told from
    those of others by its bits) and r, a struct of node, fp and root."""
    entry = lambda k, p: F.struct(F.lit(k).alias("copy"), F.col("fps")[k].bitwiseAND(F.lit(_mask(p))).alias("value"), F.col("fps")[k].alias("fp"))
    entries = F.explode(F.array(*[entry(k, p) for k, plan in enumerate(plans) for p in plan.parts])).alias("e")
    index = nodes.select("node", "root", entries).select("e.copy", "e.value", F.struct("node", "e.fp", "root").alias("r"))

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                fps = part.column("fps").flatten().to_numpy().view("<u8").reshape(part.num_rows, len(plans))
                for k, plan in enumerate(plans):
                    own, inverse = np.unique(fps[:, k], return_inverse=True)
                    _, value, fp = plan.probes(own)
                    order = np.argsort(inverse, kind="stable")
                    first, n = np.searchsorted(inverse[order], np.arange(len(own) + 1))[:-1], np.bincount(inverse)
                    which = np.searchsorted(own, fp)  # each probe, for each node of its fingerprint
                    times = n[which]
                    rows = order[np.repeat(first[which] - (np.cumsum(times) - times), times) + np.arange(times.sum())]
                    taken = part.take(pa.array(rows))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), k, np.int32)), pa.array(np.repeat(value, times).view(np.int64)), taken.column("node"), pa.array(fps[rows, k].view(np.int64)), taken.column("root")], ["copy", "value", "node", "fp", "root"])

    probes = nodes.select("node", "fps", "root").mapInArrow(run, "copy int, value long, node long, fp long, root long")
    return index, probes.select("copy", "value", F.struct("node", "fp", "root").alias("r"))


def _near(a: str, b: str):
    """Whether two nodes of different components are within the bits."""
    return (F.col(a)["root"] != F.col(b)["root"]) & (F.bit_count(F.col(a)["fp"].bitwiseXOR(F.col(b)["fp"])) <= MOST_BITS)


def similar_links(texts: DataFrame, nodes: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """texts: node, text; nodes: node (least id of a set), fps array<long>. Returns a, b: verified
    pairs that join what the candidates join."""
    plans = allot(nodes, tau=SIMILAR_TAU, copies=COPIES)
    fps = nodes.select("node", "fps")

    def alike(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) whose fingerprints are alike in all copies together."""
        both = materialize(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "similar-met").join(fps.toDF("a", "x"), "a").join(fps.toDF("b", "y"), "b")
        bits = F.aggregate(F.zip_with("x", "y", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, n: t + n)
        return materialize(both.where(bits <= MOST_SHARE * BITS * COPIES).select("a", "b"), "similar-pairs")

    def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
        both = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b")
        common = F.size(F.array_intersect("x", "y"))
        return materialize(both.where(common * (NUM + DEN) >= (F.size("x") + F.size("y")) * NUM).select("a", "b"), "similar-links")

    def sets_of(ids: DataFrame) -> DataFrame:
        ids = materialize(ids.distinct(), "similar-ids")
        return materialize(_sets(texts.join(ids, "node", "left_semi")), "similar-sets")

    index, probes = _met(nodes.withColumn("root", F.col("node")), plans)
    crowded = materialize(index.groupBy("copy", "value").count().where(F.col("count") > bucket).select("copy", "value"), "similar-crowded")
    out = nodes.select(F.col("node").alias("a"), F.col("node").alias("b")).where("false")
    if crowded.limit(1).count():
        held = materialize(index.union(probes).select("copy", "value", "r.node", "r.fp").join(crowded, ["copy", "value"], "left_semi").distinct(), "similar-held")
        sets = sets_of(held.select("node"))
        for turn in range(REPRESENTATIVES):
            comp = materialize(connected_components(out), "similar-components")
            rooted = materialize(held.join(comp, "node", "left").select("copy", "value", F.struct("node", "fp", F.coalesce("root", "node").alias("root")).alias("r")), "similar-rooted")
            one = materialize(rooted.groupBy("copy", "value").agg(F.min_by("r", F.xxhash64("r.node", F.lit(turn))).alias("one")), "similar-one")
            pairs = rooted.join(one, ["copy", "value"]).where(_near("r", "one")).select(F.col("r.node").alias("a"), F.col("one.node").alias("b"))
            out = out.union(verified(alike(pairs), sets))
        # what is outside a value's largest component is compared with all of its other components;
        # the sets go along, so that only links come out
        comp = materialize(connected_components(out), "similar-components")
        rooted = materialize(held.join(comp, "node", "left").withColumn("root", F.coalesce("root", "node")), "similar-rooted")
        most = materialize(rooted.groupBy("copy", "value", "root").count().groupBy("copy", "value").agg(F.max_by("root", F.struct("count", "root")).alias("most"), F.count("*").alias("roots")).where("roots > 1"), "similar-most")
        whole = materialize(rooted.join(most, ["copy", "value"]).join(sets, "node").select("copy", "value", (F.col("root") != F.col("most")).alias("minor"), F.struct("node", "fp", "root", "shingles").alias("r")), "similar-whole")
        minor = whole.where("minor").select("copy", "value", F.col("r").alias("p"))
        common = F.size(F.array_intersect("p.shingles", "r.shingles")) * (NUM + DEN) >= (F.size("p.shingles") + F.size("r.shingles")) * NUM
        across = minor.join(whole.drop("minor"), ["copy", "value"]).where(_near("p", "r") & common)
        out = out.union(materialize(across.select(F.least("p.node", "r.node").alias("a"), F.greatest("p.node", "r.node").alias("b")).distinct(), "similar-links"))
    comp = materialize(connected_components(out), "similar-components")
    rooted = materialize(nodes.join(comp, "node", "left").select("node", "fps", F.coalesce("root", "node").alias("root")), "similar-nodes")
    index, probes = (x.join(crowded, ["copy", "value"], "left_anti") for x in _met(rooted, plans))
    near = probes.withColumnRenamed("r", "p").join(index, ["copy", "value"]).where(_near("p", "r"))
    pairs = alike(near.select(F.col("p.node").alias("a"), F.col("r.node").alias("b")))
    return out.union(verified(pairs, sets_of(pairs.select("a").union(pairs.select("b")).toDF("node"))))


def similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket: int = BUCKET) -> DataFrame:
    """doc_id and component_id, the smallest doc_id that pairs of texts at a Jaccard similarity of
    NUM / DEN or more reach."""
    texts = id_text(docs, id_col, text_col)

    def run(batches):
        import xxhash

        known: dict[bytes, int] = {}
        for batch in batches:
            for part in portions(batch, "text"):
                own = [shingle_set(t, known) for t in part.column("text").cast(pa.binary()).to_pylist()]
                digests = pa.array([xxhash.xxh3_128_digest(x.tobytes()) for x in own], pa.binary())
                fps = np.array([set_fingerprints(x) for x in own], "<u8").reshape(len(own), COPIES).view("<i8")
                starts = pa.array(np.arange(len(own) + 1, dtype=np.int32) * COPIES)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), digests, pa.array([len(x) for x in own], pa.int64()), pa.ListArray.from_arrays(starts, pa.array(fps.ravel()))], ["doc_id", "digest", "size", "fps"])

    rows = materialize(texts.mapInArrow(run, "doc_id long, digest binary, size long, fps array<long>"), "similar-rows")
    nodes = materialize(rows.groupBy("digest").agg(F.min("doc_id").alias("node"), F.first("size").alias("size"), F.first("fps").alias("fps")), "similar-sets-once")
    # a set of fewer than NUM shingles reaches the similarity with equal sets only
    members = connected_components(similar_links(texts.withColumnRenamed("doc_id", "node"), nodes.where(F.col("size") >= NUM).select("node", "fps"), bucket))  # of least ids, so a root is the least of all
    labels = materialize(nodes.select("digest", "node").join(members, "node", "left").select("digest", F.coalesce("root", "node").alias("component_id")), "similar-labels")
    return rows.join(labels, "digest").select("doc_id", "component_id")
