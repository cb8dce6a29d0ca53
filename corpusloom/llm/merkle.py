"""Merkle manifest of documents: a tree of 16 a source, and one over the sources' roots.

H is the lower-case hex SHA-256 of its inputs one after the other, digests as their hex text. A
leaf is H of the row's five columns, each `-` if null, else its UTF-8 byte count, `:` and its
value. While a tree has several nodes, each run of 16 in order (the last of fewer, even of one)
becomes their H.

Leaves get their place in their source by a scan over ranges. Blocks of 16^3 leaves are then
reduced, each by one task, to one digest; while more than TOP_NODES digests are left, blocks of
those are reduced too. The driver builds the top tree over the rest, at most TOP_NODES digests,
and broadcasts what stands above each: the path of a node to the root, a level as the node's
place in its run and the digests of the others. Tasks then finish the proofs block by block and
fold each row's leaf along its path. Where several rounds were needed, paths come down by joins
instead, a row for each block.

Defined cases: null columns are `-`; a null source is the first source, and an empty one
another; rows of one source and id stand by their leaves, so equal rows in any order; a null
id is before all others, and its row is never tampered with; a text of any length is hashed
whole; an empty table gives an empty table; extra columns are not read.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.ordered import sums_before
from corpusloom.sources.storage import materialize

FAN = 16
#: Levels of a block: 16^3 leaves at most, each of a few hundred bytes.
HEIGHT = 3
#: Digests of the top tree, which the driver builds.
TOP_NODES = 4096
TAMPERED = 5

_PATHS = "source string, place long, path array<string>, subroot string, root string"


def leaf(doc_id: Column, source: Column, lang: Column, n_chars: Column, text: Column) -> Column:
    def part(c: Column) -> Column:
        s = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))

    return F.sha2(F.concat(*map(part, (doc_id, source, lang, n_chars, text))), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """doc_id, source, leaf, and tampered: the leaf of the row with its text's A-Z in lower case,
    where 5 divides the CRC-32 of the decimal id, else null."""
    c = {x: docs[x] for x in ("doc_id", "source", "lang", "n_chars", "text")}
    chosen = F.crc32(c["doc_id"].cast("string").cast("binary")) % TAMPERED == 0
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return docs.select(c["doc_id"].cast("long").alias("doc_id"), c["source"].alias("source"), leaf(**c).alias("leaf"), F.when(chosen, leaf(**c | {"text": F.translate(c["text"], upper, upper.lower())})).alias("tampered"))


def _h(x: str) -> str:
    return hashlib.sha256(x.encode()).hexdigest()


def _depth(n: int) -> int:
    """Levels over n nodes."""
    d = 0
    while n > 1:
        n, d = -(-n // FAN), d + 1
    return d


def _reduced(digests: list[str], levels: int) -> list[list[str]]:
    """The nodes of each level, the given ones first."""
    out = [digests]
    for _ in range(levels):
        at = out[-1]
        out.append([_h("".join(at[i : i + FAN])) for i in range(0, len(at), FAN)])
    return out


def _paths(levels: list[list[str]]) -> list[list[str]]:
    """For each node of the first level its path to the last: `place:digests of the others`."""
    above: list[list[str]] = [[]] * len(levels[-1])
    for nodes in reversed(levels[:-1]):
        here = []
        for i in range(len(nodes)):
            run = i - i % FAN
            others = "".join(nodes[run:i]) + "".join(nodes[i + 1 : run + FAN])
            here.append([f"{i - run}:{others}", *above[i // FAN]])
        above = here
    return above


def _fold(digest: str, path: list[str]) -> str:
    for step in path:
        place, _, others = step.partition(":")
        cut = 64 * int(place)
        digest = _h(others[:cut] + digest + others[cut:])
    return digest


def _batch(columns: dict, schema: str) -> pa.Table:
    kinds = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
    fields = [x.split() for x in schema.split(", ")]
    return pa.table({name: pa.array(columns[name], kinds[kind]) for name, kind in fields})


def _blocks(nodes: DataFrame) -> DataFrame:
    """nodes (source, place, n: nodes of the source's tree, digest), and the block of each."""
    return nodes.withColumn("block", F.floor(F.col("place") / FAN**HEIGHT))


def reduce_blocks(nodes: DataFrame) -> DataFrame:
    """The next round's nodes: one a block."""
    schema = "source string, place long, n long, digest string"

    def run(key, group):
        group = group.sort_by("place")
        n = group.column("n")[0].as_py()
        top = _reduced(group.column("digest").to_pylist(), min(HEIGHT, _depth(n)))[-1]
        return _batch({"source": [key[0].as_py()], "place": [key[1].as_py()], "n": [-(-n // FAN**HEIGHT)], "digest": top}, schema)

    return _blocks(nodes).groupBy("source", "block").applyInArrow(run, schema)


def build_top(nodes: list) -> dict:
    """(source, place) -> its path to the root, its source's subroot, and the root."""
    trees: dict = {}
    for x in sorted(nodes, key=lambda x: x.place):
        trees.setdefault(x.source, []).append(x.digest)
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    grown = {s: _reduced(trees[s], _depth(len(trees[s]))) for s in order}
    forest = _reduced([grown[s][-1][0] for s in order], _depth(len(order)))
    out = {}
    for s, up in zip(order, _paths(forest)):
        for place, path in enumerate(_paths(grown[s])):
            out[s, place] = (path + up, grown[s][-1][0], forest[-1][0])
    return out


def _up(nodes: DataFrame) -> DataFrame | dict:
    """The path, subroot and root of each node: a dict of at most TOP_NODES, or a table."""
    if nodes.limit(TOP_NODES + 1).count() <= TOP_NODES:
        return build_top(nodes.collect())
    if nodes.where("n > 1").limit(1).count():
        return _below(nodes, _up(materialize(reduce_blocks(nodes), "merkle-nodes")))
    # each source has one node: they are the nodes of the tree over the sources
    ranked = sums_before(nodes.withColumn("one", F.lit(1)), ["source"], "one", "rank")
    forest = materialize(ranked.select(F.lit(None).cast("string").alias("source"), F.col("rank").alias("place"), F.lit(nodes.count()).cast("long").alias("n"), "digest", F.struct("source").alias("of")), "merkle-forest")
    found = _below(forest, _up(materialize(reduce_blocks(forest), "merkle-nodes")))
    named = found.join(forest.select("place", "of", "digest"), "place")
    return materialize(named.select("of.source", F.lit(0).cast("long").alias("place"), "path", F.col("digest").alias("subroot"), "root"), "merkle-paths")


def _with_paths(nodes: DataFrame, above: DataFrame | dict, finish, schema: str) -> DataFrame:
    """finish(group of a block in order, its nodes' paths in the block, the block's path, subroot
    and root) for each block; above has the blocks' paths."""
    here = _blocks(nodes)

    def paths(group):
        group = group.sort_by("place")
        return group, _paths(_reduced(group.column("digest").to_pylist(), min(HEIGHT, _depth(group.column("n")[0].as_py()))))

    if isinstance(above, dict):
        shipped = nodes.sparkSession.sparkContext.broadcast(above)

        def run(key, group):
            group, own = paths(group)
            return finish(group, own, *shipped.value[key[0].as_py(), key[1].as_py()])

        return here.groupBy("source", "block").applyInArrow(run, schema)

    def both(key, group, up):
        group, own = paths(group)
        return finish(group, own, *(up.column(c)[0].as_py() for c in ("path", "subroot", "root")))

    return here.groupBy("source", "block").cogroup(above.groupBy("source", "place")).applyInArrow(both, schema)


def _below(nodes: DataFrame, above: DataFrame | dict) -> DataFrame:
    """The paths of nodes whose blocks' paths are above."""

    def finish(group, own, path, subroot, root):
        k = group.num_rows
        return _batch({"source": group.column("source").to_pylist(), "place": group.column("place").to_pylist(), "path": [x + path for x in own], "subroot": [subroot] * k, "root": [root] * k}, _PATHS)

    return materialize(_with_paths(nodes, above, finish, _PATHS), "merkle-paths")


def placed_leaves(docs: DataFrame) -> DataFrame:
    """leaves() with place, their place in their source, and n, the leaves of the source."""
    found = materialize(sums_before(leaves(docs).withColumn("one", F.lit(1)), ["doc_id", "leaf"], "one", "place", by=("source",)), "merkle-leaves")
    sizes = materialize(found.groupBy("source").agg(F.count("*").alias("n")), "merkle-sizes").select(F.col("source").alias("s"), "n")
    return found.join(sizes, found["source"].eqNullSafe(F.col("s"))).select("doc_id", "source", F.col("leaf").alias("digest"), "tampered", "place", "n")


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified and the path of each row."""
    rows = materialize(placed_leaves(docs), "merkle-rows")
    nodes = materialize(reduce_blocks(rows), "merkle-nodes")
    schema = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, path array<string>"

    def finish(group, own, path, subroot, root):
        digests, k = group.column("digest").to_pylist(), group.num_rows
        whole = [x + path for x in own]
        proofs = [_h("".join(step.partition(":")[2] for step in x)) for x in whole]
        folded = [_fold(t or d, x) for d, t, x in zip(digests, group.column("tampered").to_pylist(), whole)]
        return _batch({"doc_id": group.column("doc_id").to_pylist(), "leaf": digests, "subroot": [subroot] * k, "root": [root] * k, "proof_sha256": proofs, "folded_root": folded, "verified": [x == root for x in folded], "path": whole}, schema)

    return _with_paths(rows, _up(nodes), finish, schema)
