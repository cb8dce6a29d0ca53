"""Near-duplicate vectors by NN-descent.

Equal vectors of a label are one node. Each node keeps a list of its nearest neighbours so
far. The first lists come from runs of nodes that lie together in the order of a few random
sign codes; then, in each round, the neighbours of a node, forward and reverse, are compared
with one another. A list all of whose members are links is saturated, and gets twice the
room. Rounds end when few lists change.

The codes' length grows with their group, so that few nodes share one, and their number with
their length, so that two nodes at the threshold share one in two searches with the chance MEET
at any size, also where they have no other neighbour to be found through.

A dense cluster can fill its lists with its own members. So the search is repeated, with new
codes, for neighbours of other components than a node's own, until one finds no link between
components: a search is independent of those before, so it sees what they have missed. The
recall against all nodes is audited too, for a bounded sample that holds nodes with known links.
If that is too low after WIDENINGS searches more, the nodes of different components are compared
exactly, in blocks.

The search works on half-precision unit vectors; links are decided in double precision.
Links join nodes into components. Inside a component every vector's links are counted
exactly: a small one as one matrix; a large one in pairs of blocks of which only counts
leave, save that the nodes within half the threshold's angle of the root, which all link
with one another, are not compared among themselves.

Defined cases: a vector that is null, empty, zero or holds a null, NaN or infinity, or has a
null label, links with nothing; vectors of different lengths do not link; repeated rows link
with one another, and links of equal similarity are all kept; a null id takes part, and names a component only if no other id is there;
an empty table gives an empty table; extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.components import connected_components
from corpusloom.sources.storage import discard, materialize

THRESHOLD = 0.93
LIST = 8
RUN = 32
#: Nodes that share a code, about: codes get longer with their group. Codes are so many that two nodes at the threshold share
#: one in two searches with this chance.
CODE_LOAD, MEET, MOST_BITS = 8, 0.99, 60
ROUNDS, ROUNDS_ACROSS, FEW = 5, 2, 0.01
#: The audited nodes, the recall asked for, and how often the search may be widened for it.
AUDIT, ENOUGH, WIDENINGS = 256, 0.98, 3
BLOCK = 1024
_SLACK = 4e-3  # of half precision


def _nodes(vectors: DataFrame, id_col: str, vec_col: str, label_col: str, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """All rows (vec_id, node; node null where the vector cannot link), and the nodes: node,
    grp, first_id, size, exact (unit vector, doubles), vec (halves), and the length and number of
    codes that their group's size asks for."""
    v = vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[label_col].cast("string").alias("label"), vectors[vec_col].cast("array<double>").alias("e"))
    sound = F.col("label").isNotNull() & F.col("e").isNotNull() & F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("e", lambda x: x != 0)
    good = v.where(sound)

    def unit(batches):
        for batch in batches:
            exact, half = [], []
            for e in batch.column("e").to_pylist():
                x = np.array(e)
                x = x / np.abs(x).max()  # no square overflows or vanishes
                x = x / np.sqrt(x @ x)
                exact.append(x.tobytes())
                half.append(x.astype(np.float16).tobytes())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("node", "grp", "first_id", "size")), pa.array(exact, pa.binary()), pa.array(half, pa.binary())], ["node", "grp", "first_id", "size", "exact", "vec"])

    # a node is a value, not its hash: equal vectors of a label, numbered
    once = good.groupBy("label", "e").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("size"))
    once = materialize(once.withColumn("node", F.monotonically_increasing_id()), "vectors-once")
    rows = v.withColumn("k", F.when(sound, F.struct("label", "e"))).join(once.select(F.struct("label", "e").alias("k"), "node"), "k", "left").select("vec_id", "node")
    grouped = once.select("node", F.concat_ws(":", F.size("e").cast("string"), "label").alias("grp"), "e", "first_id", "size")
    nodes = materialize(grouped.mapInArrow(unit, "node long, grp string, first_id long, size long, exact binary, vec binary"), "vectors-nodes")
    sizes = materialize(nodes.groupBy("grp").agg(F.count("*").alias("n")), "vectors-sizes")
    bits = F.least(F.lit(MOST_BITS), F.greatest(F.lit(1), F.ceil(F.log2(F.col("n") / CODE_LOAD)))).cast("int")
    share = F.pow(F.lit(1 - np.arccos(threshold) / np.pi), bits)
    codes = F.ceil(F.log(F.lit(1 - MEET)) / F.log(1 - share) / 2).cast("int")
    plan = sizes.select("grp", bits.alias("bits"), F.when(F.col("n") <= RUN, 3).otherwise(codes).alias("codes"))
    return materialize(rows, "vectors-rows"), materialize(nodes.join(plan, "grp"), "vectors-nodes")


def _best(ids: list[int], vecs: list[bytes], floors: list[float], roots: list[int], out: list[list]) -> None:
    """Append, for each member, its best others of other roots above its floor."""
    x = np.frombuffer(b"".join(vecs), np.float16).reshape(len(ids), -1).astype(np.float32)
    s, r = x @ x.T, np.array(roots)
    s[r[:, None] == r[None, :]] = -2
    keep = min(LIST, len(ids) - 1)
    if keep < 1:
        return
    top = np.argpartition(-s, keep - 1, axis=1)[:, :keep]
    for i, row in enumerate(top.tolist()):
        for j in row:
            if s[i, j] > max(floors[i], -1.5):
                out[0].append(ids[i])
                out[1].append(ids[j])
                out[2].append(float(s[i, j]))


_EDGES = "src long, dst long, sim double"


def _batch(out: list[list]):
    return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], ["src", "dst", "sim"])


def _first_lists(nodes: DataFrame, seed: int) -> DataFrame:
    """Links between nodes that lie in one run of the order of their random sign codes."""

    def code(batches):
        for batch in batches:
            vecs, bits, codes = batch.column("vec").to_pylist(), batch.column("bits").to_pylist(), batch.column("codes").to_pylist()
            shapes = [(len(v) // 2, b) for v, b in zip(vecs, bits)]
            for r in range(max(codes, default=0)):
                rows = [i for i, c in enumerate(codes) if c > r]
                keys = {}
                for d, b in {shapes[i] for i in rows}:
                    own = [i for i in rows if shapes[i] == (d, b)]
                    x = np.frombuffer(b"".join(vecs[i] for i in own), np.float16).reshape(len(own), d).astype(np.float32)
                    plane = np.random.default_rng((seed, r, d)).standard_normal((MOST_BITS, d)).astype(np.float32)[:b].T
                    packed = np.packbits(x @ plane > 0, axis=1)
                    keys |= {i: k.tobytes() for i, k in zip(own, packed)}
                taken = batch.take(pa.array(rows, pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array([r] * len(rows), pa.int32()), pa.array([keys[i] for i in rows], pa.binary()), *(taken.column(c) for c in ("grp", "node", "root", "vec"))], ["r", "code", "grp", "node", "root", "vec"])

    def runs(batches):
        held: list[tuple] = []
        for batch in batches:
            out: list[list] = [[], [], []]
            for row in zip(*(batch.column(c).to_pylist() for c in ("r", "grp", "node", "vec", "root"))):
                if held and held[-1][:2] != row[:2]:
                    _best([h[2] for h in held], [h[3] for h in held], [-1.0] * len(held), [h[4] for h in held], out)
                    held = []
                held.append(row)
                if len(held) == RUN:
                    _best([h[2] for h in held], [h[3] for h in held], [-1.0] * len(held), [h[4] for h in held], out)
                    held = held[RUN // 2 :]
            yield _batch(out)
        out = [[], [], []]
        if held:
            _best([h[2] for h in held], [h[3] for h in held], [-1.0] * len(held), [h[4] for h in held], out)
        yield _batch(out)

    coded = nodes.select("grp", "node", "root", "vec", "bits", "codes").mapInArrow(code, "r int, code binary, grp string, node long, root long, vec binary")
    order = ["r", "grp", "code", "node"]
    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return coded.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(runs, _EDGES)


def _lists(edges: DataFrame, room: DataFrame | None = None) -> DataFrame:
    """The best members of each list: LIST, or its own room. Members are ranked as rows, so that a
    node that very many propose to needs no more memory than others."""
    best = edges.groupBy("src", "dst").agg(F.max("sim").alias("sim"))
    best = best.withColumn("room", F.lit(LIST)) if room is None else best.join(room, "src", "left").withColumn("room", F.coalesce("room", F.lit(LIST)))
    ranked = best.withColumn("at", F.row_number().over(Window.partitionBy("src").orderBy(F.desc("sim"), "dst")) - 1).where("at < room")
    return ranked.withColumn("held", F.count("*").over(Window.partitionBy("src"))).select("src", "dst", "sim", "room", "held", "at")


def _round(nodes: DataFrame, lists: DataFrame, turn: int) -> DataFrame:
    """Proposals from comparing the neighbours of each node with one another."""
    floors = lists.groupBy("src").agg(F.min(F.when(F.col("held") >= F.col("room"), F.col("sim")).otherwise(-1.0)).alias("floor"))
    state = nodes.select("node", "root", "vec").join(floors.withColumnRenamed("src", "node"), "node", "left").select("node", F.struct("node", "root", F.coalesce("floor", F.lit(-1.0)).alias("floor"), "vec").alias("m"))
    mixed = Window.partitionBy("dst").orderBy(F.xxhash64("src", F.lit(turn)))
    forward = lists.withColumn("k", F.row_number().over(Window.partitionBy("src").orderBy(F.xxhash64("dst", F.lit(turn))))).where(F.col("k") <= LIST)
    reverse = lists.withColumn("k", F.row_number().over(mixed)).where(F.col("k") <= LIST)
    pairs = forward.select(F.col("src").alias("center"), F.col("dst").alias("node")).union(reverse.select("dst", "src")).union(nodes.select("node", "node")).distinct()
    met = pairs.join(state, "node").groupBy("center").agg(F.collect_list("m").alias("ms"))  # 2 LIST + 1 at most

    def compare(batches):
        for batch in batches:
            out: list[list] = [[], [], []]
            for ms in batch.column(0).to_pylist():
                _best([m["node"] for m in ms], [m["vec"] for m in ms], [m["floor"] for m in ms], [m["root"] for m in ms], out)
            yield _batch(out)

    return met.select("ms").mapInArrow(compare, _EDGES)


def _rooms(lists: DataFrame, threshold: float) -> DataFrame:
    """src, room: twice as much where a full list holds nothing but links."""
    full = (F.col("held") >= F.col("room")) & (F.col("low") >= threshold)
    return lists.groupBy("src").agg(F.max("room").alias("room"), F.max("held").alias("held"), F.min("sim").alias("low")).select("src", F.when(full, 2 * F.col("room")).otherwise(F.col("room")).alias("room"))


def neighbour_lists(nodes: DataFrame, seed: int = 1, threshold: float = THRESHOLD, rounds: int = ROUNDS) -> DataFrame:
    """src, dst, sim, room, held, at after rounds of refinement; members are of other roots than
    their node (node, grp, root, vec)."""
    lists = materialize(_lists(_first_lists(nodes, seed)), "vectors-lists")
    for turn in range(rounds):
        new = materialize(_lists(lists.select("src", "dst", "sim").union(_round(nodes, lists, turn + 100 * seed)), _rooms(lists, threshold)), "vectors-lists")
        changed = new.select("src", "dst").join(lists.select("src", "dst"), ["src", "dst"], "left_anti").count()
        discard(lists)
        lists = new
        if changed <= FEW * max(1, new.count()):
            break
    return lists


def _verified(nodes: DataFrame, lists: DataFrame, threshold: float) -> DataFrame:
    """a, b: the pairs of the lists whose exact cosine reaches the threshold."""
    near = lists.where(F.col("sim") >= threshold - _SLACK).select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    exact = nodes.select("node", "exact")
    both = near.join(exact.toDF("a", "x"), "a").join(exact.toDF("b", "y"), "b")

    def check(batches):
        for batch in batches:
            a, b, x, y = (batch.column(k).to_pylist() for k in range(4))
            held = [bool(np.frombuffer(p) @ np.frombuffer(q) >= threshold) for p, q in zip(x, y)]
            yield pa.RecordBatch.from_arrays([pa.array([v for v, h in zip(c, held) if h], pa.int64()) for c in (a, b)], ["a", "b"])

    return both.select("a", "b", "x", "y").mapInArrow(check, "a long, b long")


def audit(nodes: DataFrame, comp: DataFrame, threshold: float = THRESHOLD, size: int = AUDIT) -> float | None:
    """The share of the true links of a bounded sample of nodes whose ends are in one component;
    half of the nodes are among those with a known link, if so many have one. None without a
    link. What no search has found of lone pairs is seen by the next search, not here."""
    labelled = nodes.join(comp, "node", "left").select("node", "grp", "exact", F.coalesce("root", "node").alias("root"), F.col("root").isNotNull().alias("linked"))
    picked = lambda rows, n: rows.orderBy(F.xxhash64("node")).limit(n).select("node", "grp", "exact", "root").collect()
    known = picked(labelled.where("linked"), size // 2)
    sample = list({r.node: tuple(r) for r in known + picked(labelled, size - len(known))}.values())

    def run(batches):
        by: dict[str, list] = {}
        for node, grp, exact, root in sample:
            by.setdefault(grp, []).append((node, np.frombuffer(bytes(exact)), root))
        true = found = 0
        for batch in batches:
            for node, grp, exact, root in zip(*(batch.column(k).to_pylist() for k in range(4))):
                for other, y, r in by.get(grp, ()):
                    if other != node and np.frombuffer(exact) @ y >= threshold:
                        true, found = true + 1, found + (r == root)
        yield pa.RecordBatch.from_arrays([pa.array([true]), pa.array([found])], ["true", "found"])

    total = labelled.mapInArrow(run, "true long, found long").agg(F.sum("true"), F.sum("found")).first()
    return total[1] / total[0] if total[0] else None


def _counts(nodes: DataFrame, comp: DataFrame, threshold: float) -> DataFrame:
    """node, links: the other vectors that each node of a component links with, copies counted."""
    roots = comp.select("root").distinct()
    all_of = materialize(comp.select("node", "root").union(roots.select("root", "root")).join(nodes.select("node", "exact", "size"), "node"), "vectors-members")
    large = materialize(all_of.groupBy("root").count().where(F.col("count") > BLOCK), "vectors-large")

    def within(batches):
        for batch in batches:
            out: list[list] = [[], []]
            for ms in batch.column(0).to_pylist():
                x = np.frombuffer(b"".join(m["exact"] for m in ms)).reshape(len(ms), -1)
                size = np.array([m["size"] for m in ms])
                near = x @ x.T >= threshold
                np.fill_diagonal(near, True)
                out[0] += [m["node"] for m in ms]
                out[1] += (near @ size - 1).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["node", "links"])

    member = F.struct("node", "exact", "size")
    small = all_of.join(large, "root", "left_anti").groupBy("root").agg(F.collect_list(member).alias("ms")).select("ms").mapInArrow(within, "node long, links long")
    if not large.limit(1).count():
        return small
    # inner: within half the angle of the root, so all of them link with one another
    half = float(np.cos(np.arccos(threshold) / 2))
    centre = nodes.join(large.select(F.col("root").alias("node")), "node").select(F.col("node").alias("root"), F.col("exact").alias("c"))

    def inner(batches):
        for batch in batches:
            c, e = batch.column("c").to_pylist(), batch.column("exact").to_pylist()
            flag = pa.array([bool(np.frombuffer(p) @ np.frombuffer(q) >= half + 1e-9) for p, q in zip(c, e)])
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in ("root", "node", "exact", "size")), flag], ["root", "node", "exact", "size", "inner"])

    wide = materialize(all_of.join(centre, "root").mapInArrow(inner, "root long, node long, exact binary, size long, inner boolean"), "vectors-wide")
    ball = wide.where("inner").groupBy("root").agg(F.sum("size").alias("ball"))
    own = wide.where("inner").join(ball, "root").select("node", (F.col("ball") - 1).alias("links"))
    blocks = F.greatest(F.lit(1), F.ceil(F.col("count") / (BLOCK // 2))).cast("int")
    parts = wide.join(large, "root").withColumn("block", F.pmod(F.xxhash64("node"), blocks)).groupBy("root", "inner", "block").agg(F.collect_list(member).alias("ms"))
    parts = materialize(parts, "vectors-blocks")
    left, right = parts.toDF("root", "inner", "block", "xs"), parts.toDF("root", "inner2", "block2", "ys")
    pairs = left.join(right, "root").where(~(F.col("inner") & F.col("inner2")))

    def between(batches):
        for batch in batches:
            out: list[list] = [[], []]
            for xs, ys in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x, y = (np.frombuffer(b"".join(m["exact"] for m in ms)).reshape(len(ms), -1) for ms in (xs, ys))
                near = x @ y.T >= threshold
                same = {m["node"]: j for j, m in enumerate(ys)}
                for i, m in enumerate(xs):
                    if m["node"] in same:
                        near[i, same[m["node"]]] = True
                n = near @ np.array([m["size"] for m in ys])
                out[0] += [m["node"] for m in xs]
                out[1] += [int(k) - (m["node"] in same) for k, m in zip(n, xs)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["node", "links"])

    across = pairs.select("xs", "ys").mapInArrow(between, "node long, links long")
    return small.union(own.union(across).groupBy("node").agg(F.sum("links").alias("links")))


def _across(nodes: DataFrame, comp: DataFrame, threshold: float) -> DataFrame:
    """a, b: links that join all components that have a link between them; every pair of nodes
    of a group that lie in different components is compared, in blocks."""
    rooted = nodes.join(comp, "node", "left").select("grp", F.coalesce("root", "node").alias("root"), "node", "exact")
    n = materialize(rooted.groupBy("grp").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "vectors-groups")
    parts = rooted.join(n, "grp").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks"))).groupBy("grp", "block").agg(F.collect_list(F.struct("node", "root", "exact")).alias("ms"))
    parts = materialize(parts, "vectors-parts")
    pairs = parts.toDF("grp", "block", "xs").join(parts.toDF("grp", "block2", "ys"), "grp").where("block <= block2")

    def run(batches):
        for batch in batches:
            out: list[list] = [[], []]
            for xs, ys in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x, y = (np.frombuffer(b"".join(m["exact"] for m in ms)).reshape(len(ms), -1) for ms in (xs, ys))
                r, q = (np.array([m["root"] for m in ms]) for ms in (xs, ys))
                i, j = np.nonzero((x @ y.T >= threshold) & (r[:, None] != q[None, :]))
                seen: set[tuple] = set()
                for a, b in zip(i.tolist(), j.tolist()):  # one link for two components is enough
                    key = (min(r[a], q[b]), max(r[a], q[b]))
                    if key not in seen:
                        seen.add(key)
                        out[0].append(xs[a]["node"])
                        out[1].append(ys[b]["node"])
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["a", "b"])

    return pairs.select("xs", "ys").mapInArrow(run, "a long, b long")


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept."""
    rows, nodes = _nodes(vectors, id_col, vec_col, label_col, threshold)
    search, links = nodes.withColumn("root", F.col("node")), None
    for turn in range(WIDENINGS + 2):
        lists = neighbour_lists(search, turn + 1, threshold, ROUNDS_ACROSS if turn else ROUNDS)
        new = materialize(_verified(nodes, lists, threshold), "vectors-links")
        discard(lists)
        links = new if links is None else links.union(new)
        comp = materialize(connected_components(links), "vectors-components")
        if turn and not new.limit(1).count() and ((recall := audit(nodes, comp, threshold)) is None or recall >= ENOUGH):
            break
        search = materialize(nodes.join(comp, "node", "left").withColumn("root", F.coalesce("root", "node")), "vectors-search")
    else:
        if (audit(nodes, comp, threshold) or 0) < ENOUGH:
            comp = materialize(connected_components(links.union(_across(nodes, comp, threshold))), "vectors-components")
    counts = materialize(_counts(nodes, comp, threshold), "vectors-counts")
    rooted = materialize(nodes.select("node", "first_id", "size").join(comp, "node", "left").join(counts, "node", "left").select("node", "first_id", F.coalesce("root", "node").alias("root"), F.coalesce("links", F.col("size") - 1).alias("links")), "vectors-rooted")
    firsts = materialize(rooted.groupBy("root").agg(F.min("first_id").alias("component_id")), "vectors-firsts")
    labels = materialize(rooted.join(firsts, "root").select("node", "links", "component_id"), "vectors-labels")
    found = rows.join(labels, "node", "left")
    component = F.coalesce("component_id", "vec_id")
    return found.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
