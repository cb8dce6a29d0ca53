"""Chat formatting through a prefix tree.

A turn is written as `### role:`, a line end, the text, `</turn>` and a line end. Inside
texts and roles a backslash goes before each backslash, `#` and `<` (in roles before `:`
too), so no control string can occur there, and taking the backslashes away gives the text
back.

1. Rows stream through by conversation and turn; each turn's node is the digest of all that
   is written up to it. The digests of a conversation, joined, are its path.
2. Distinct paths are sorted, in ranges. A path shares with the one before it the nodes that
   an earlier path has emitted already; what follows them is its segment of the stream. So
   every node is emitted once, depth-first. A range is laid out from zero; the driver then
   gets the first and last path of each range, and from them where the range begins and
   which nodes its first path finds in earlier ranges.
3. A node carries its position id (the offset that its text has in every conversation that
   holds it), and the stream intervals of its ancestors: it attends to these and to itself.

read_back() gets the conversations from the stream: node by node, the intervals and the
position say which of the nodes before it a node follows.

Defined cases: rows are ordered by turn, equal turns by role, then text; a null text or role
is empty; null turns come first; rows without an id are one conversation with a null id;
repeated rows are repeated turns; an empty table gives empty tables; extra columns are not
read. Lengths are code points. No table holds a conversation's texts in one row, and no
task more than one path: a conversation of very many turns, a first turn of very many
conversations, or very many equal conversations need no more memory than others.
"""

from __future__ import annotations

import bisect
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import portions
from corpusloom.sources.storage import materialize

OPEN, AFTER_ROLE, CLOSE = "### ", ":\n", "</turn>\n"
LOSS_ROLE = "assistant"
DIGEST = 16  # bytes of a node's digest
#: Formatted characters of a range of paths.
RANGE_CHARS = 64 << 20
_TURN = re.compile(r"### ([^\\:]*+(?:\\.[^\\:]*+)*+):\n([^\\<]*+(?:\\.[^\\<]*+)*+)</turn>\n", re.DOTALL)


def escape(text: str, extra: str = "") -> str:
    return re.sub(rf"[\\#<{extra}]", r"\\\g<0>", text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The turn as written, and where its escaped text starts and ends in it."""
    head, body = OPEN + escape(role, ":") + AFTER_ROLE, escape(text)
    return head + body + CLOSE, len(head), len(head) + len(body)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted conversation; an error if anything else is there."""
    turns, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        turns.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return turns


@dataclass(frozen=True)
class Layout:
    """nodes: range, stream_start, stream_end, position, depth, ancestors (stream intervals),
    role, formatted, loss_start, loss_end (both in the stream, null outside the loss), node
    (digest) and ends (true where a conversation ends); in the order of stream_start they are
    the stream. members: conv_id and leaf, the node where the conversation ends."""

    nodes: DataFrame
    members: DataFrame


_STEP = pa.schema([("conv_id", pa.int64()), ("node", pa.binary()), ("depth", pa.int64()), ("position", pa.int64()), ("role", pa.string()), ("formatted", pa.string()), ("loss_from", pa.int64()), ("loss_to", pa.int64()), ("path", pa.binary()), ("ends", pa.binary())])
_STEPS = "conv_id long, node binary, depth long, position long, role string, formatted string, loss_from long, loss_to long, path binary, ends binary"


def _chain(batches):
    """Each turn with its node; the last of a conversation also has the path, and where each of
    its nodes ends. Rows come by conversation, in order."""
    import hashlib

    nobody = object()
    conv, digest, position, depth, path, ends = nobody, b"", 0, 0, bytearray(), []
    held: list[tuple] = []

    def last():
        return (*held.pop()[:-2], bytes(path), np.array(ends, "<i8").tobytes())

    def out(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_STEP)], schema=_STEP)

    for batch in batches:
        for part in portions(batch, "text"):
            for c, role, text in zip(*(part.column(k).to_pylist() for k in ("conv_id", "role", "text"))):
                if c != conv:
                    if held:
                        held.append(last())
                    conv, digest, position, depth, path, ends = c, b"", 0, 0, bytearray(), []
                formatted, start, end = format_turn(role, text)
                digest = hashlib.sha256(digest + formatted.encode()).digest()  # a format that can be read back tells turns apart
                path += digest[:DIGEST]
                ends.append(position + len(formatted))
                loss = (start, end) if role == LOSS_ROLE else (None, None)
                held.append((c, digest[:DIGEST], depth, position, role, formatted, *loss, None, None))
                position, depth = position + len(formatted), depth + 1
            if len(held) > 1:
                yield out(held[:-1])
                held = held[-1:]
    if held:
        held.append(last())
        yield out(held)


def merged(starts: np.ndarray, stops: np.ndarray) -> list[tuple[int, int]]:
    """The intervals, in order, those that meet made one."""
    if not len(starts):
        return []
    new = np.flatnonzero(np.concatenate(([True], starts[1:] != stops[:-1])))
    return list(zip(starts[new].tolist(), stops[np.append(new[1:], len(starts)) - 1].tolist()))


def first_part(intervals: list[tuple[int, int]], size: int) -> list[tuple[int, int]]:
    """The first so many places of the intervals."""
    out = []
    for start, end in intervals:
        if size <= 0:
            break
        out.append((start, min(end, start + size)))
        size -= end - start
    return out


def shared(a: bytes, b: bytes) -> int:
    """How many nodes two paths begin with alike."""
    n = min(len(a), len(b)) // DIGEST
    x, y = (np.frombuffer(p, f"V{DIGEST}", n) for p in (a, b))
    other = np.flatnonzero(x != y)
    return int(other[0]) if len(other) else n


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_SEGMENT = pa.schema([("range", pa.int32()), ("conv_id", pa.int64()), ("depth", pa.int64()), ("start", pa.int64()), ("chars", pa.int64()), ("ancestors", _SPANS), ("edge", pa.int32()), ("path", pa.binary()), ("ends", pa.binary()), ("whole", _SPANS)])
_SEGMENTS = "range int, conv_id long, depth long, start long, chars long, ancestors array<struct<start:bigint,end:bigint>>, edge int, path binary, ends binary, whole array<struct<start:bigint,end:bigint>>"


def _spans(intervals):
    return [{"start": a, "end": b} for a, b in intervals]


def _segments(batches):
    """The segment of each path of a range: the depth it starts at, its place in the range's own
    stream, the characters of the path before it, and the intervals of the nodes above it. The
    range's first row (edge 1) has its path, the last (edge 2) also its whole intervals."""
    from pyspark import TaskContext

    at = TaskContext.get().partitionId()
    before, starts, stops, stream = b"", np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    row, first = None, True

    def out(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_SEGMENT)], schema=_SEGMENT)

    for batch in batches:
        rows = []
        for conv, path, own in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "path", "ends"))):
            if row:
                rows.append(row)
            ends = np.frombuffer(own, "<i8")
            d = shared(before, path)
            above = int(ends[d - 1]) if d else 0
            ancestors = merged(starts[:d], stops[:d])
            stops = np.concatenate((stops[:d], ends[d:] - above + stream))
            begins = np.concatenate(([0], ends[:-1]))
            starts = np.concatenate((starts[:d], begins[d:] - above + stream))
            row = (at, conv, d, stream, above, _spans(ancestors), 1 if first else 0, path if first else None, own if first else None, None)
            before, stream, first = path, stream + int(ends[-1]) - above, False
        if rows:
            yield out(rows)
    if row:
        yield out([row, (at, None, None, stream, None, None, 2, before, None, _spans(merged(starts, stops)))])


@dataclass(frozen=True)
class _Range:
    """What earlier ranges hold of a range's first path, and where the range's stream begins."""

    depth: int
    chars: int
    above: list[tuple[int, int]]
    start: int

    def place(self, intervals) -> list[tuple[int, int]]:
        """Stream intervals of intervals in the range's own numbering."""
        out, shift = [], self.start - self.chars
        for a, b in intervals:
            if a < self.chars:  # a is 0: what a path shares with the first one, it shares from the root
                out += first_part(self.above, min(b, self.chars))
            if b > self.chars:
                out.append((max(a, self.chars) + shift, b + shift))
        return out


def _ranges(edges) -> dict[int, _Range]:
    """edges: the first and last rows of the ranges, in order. The driver's share: a path each."""
    out: dict[int, _Range] = {}
    path, intervals, start, own = b"", [], 0, None
    for r in edges:
        if r.edge == 1:
            d = shared(path, bytes(r.path))
            chars = int(np.frombuffer(bytes(r.ends), "<i8")[d - 1]) if d else 0
            own = out[r.range] = _Range(d, chars, first_part(intervals, chars), start)
        else:
            path, intervals = bytes(r.path), own.place([(x.start, x.end) for x in r.whole])
            start += r.start - own.chars
    return out


def layout(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", range_chars: int = RANGE_CHARS) -> Layout:
    c, spark = conversations, conversations.sparkSession
    rows = c.select(c[conv_col].cast("long").alias("conv_id"), c[turn_col].cast("long").alias("turn"), F.coalesce(c[role_col].cast("string"), F.lit("")).alias("role"), F.coalesce(c[text_col].cast("string"), F.lit("")).alias("text"))
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    steps = materialize(dealt.select("conv_id", "role", "text").mapInArrow(_chain, _STEPS), "chat-steps")
    whole = steps.where("path is not null")
    members = whole.select("conv_id", F.col("node").alias("leaf"))
    paths = materialize(whole.groupBy("node").agg(F.min("conv_id").alias("conv_id"), F.first("path").alias("path"), F.first("ends").alias("ends")), "chat-paths")
    chars = steps.agg(F.coalesce(F.sum(F.length("formatted").cast("long")), F.lit(0))).first()[0]
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-chars // range_chars))
    found = paths.repartitionByRange(n, "path").sortWithinPartitions("path").select("conv_id", "path", "ends").mapInArrow(_segments, _SEGMENTS)
    segments = materialize(found, "chat-segments")
    ranges = _ranges(segments.where("edge > 0").orderBy("range", "edge").collect())  # two paths a range
    shipped = spark.sparkContext.broadcast(ranges)

    def place(batches):
        for batch in batches:
            known, cols = shipped.value, {k: batch.column(k).to_pylist() for k in ("range", "depth", "start", "chars", "ancestors", "edge")}
            for k, (at, edge) in enumerate(zip(cols["range"], cols["edge"])):
                own = known[at]
                if edge == 1:
                    cols["depth"][k], cols["start"][k], cols["chars"][k], cols["ancestors"][k] = own.depth, own.start, own.chars, _spans(own.above)
                else:
                    cols["start"][k] += own.start - own.chars
                    cols["ancestors"][k] = _spans(own.place([(x["start"], x["end"]) for x in cols["ancestors"][k]]))
            yield pa.RecordBatch.from_arrays([batch.column("range"), batch.column("conv_id"), *(pa.array(cols[k], pa.int64()) for k in ("depth", "start", "chars")), pa.array(cols["ancestors"], _SPANS)], ["range", "conv_id", "from_depth", "start", "chars", "above"])

    inner = segments.where("edge < 2").select("range", "conv_id", "depth", "start", "chars", "ancestors", "edge")
    placed = materialize(inner.mapInArrow(place, "range int, conv_id long, from_depth long, start long, chars long, above array<struct<start:bigint,end:bigint>>"), "chat-placed")
    owned = steps.select("conv_id", "node", "depth", "position", "role", "formatted", "loss_from", "loss_to", F.col("path").isNotNull().alias("ends"))
    both = owned.withColumnRenamed("conv_id", "conv").join(placed, F.col("conv").eqNullSafe(F.col("conv_id"))).where("depth >= from_depth")
    both = both.withColumn("stream_start", F.col("start") + F.col("position") - F.col("chars"))
    start, above = F.col("stream_start"), F.col("above")
    own = lambda a: F.array(F.struct(a.alias("start"), start.alias("end")))
    tail = F.try_element_at(above, F.lit(-1))
    ancestors = F.when(start == F.col("start"), above).when(tail["end"] == F.col("start"), F.concat(F.slice(above, 1, F.greatest(F.size(above) - 1, F.lit(0))), own(tail["start"]))).otherwise(F.concat(above, own(F.col("start"))))
    nodes = both.select("range", "stream_start", (start + F.length("formatted")).alias("stream_end"), "position", "depth", ancestors.alias("ancestors"), "role", "formatted", (start + F.col("loss_from")).alias("loss_start"), (start + F.col("loss_to")).alias("loss_end"), "node", "ends")
    return Layout(materialize(nodes, "chat-nodes"), members)


_READ = pa.schema([("leaf", pa.binary()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def _read(batches):
    """The counts and digests of the conversations that end in a range, whose nodes come in the
    order of the stream, after those of earlier ranges that the first of them follow."""
    import hashlib

    at, stack = None, []  # of the ancestors: where each ends, the characters so far, the digests and counts so far
    for batch in batches:
        for part in portions(batch, "formatted"):
            rows = []
            for r in part.to_pylist():
                if r["at"] != at:
                    at, stack = r["at"], []
                follows = r["ancestors"][-1]["end"] if r["ancestors"] else None
                while stack and stack[-1][0] != follows:
                    stack.pop()
                if (stack[-1][1] if stack else 0) != r["position"] or sum(x["end"] - x["start"] for x in r["ancestors"]) != r["position"]:
                    raise ValueError(f"the intervals of the node at {r['stream_start']} do not lead to its position")
                _, chars, turns, loss, n, lost = stack[-1] if stack else (None, 0, hashlib.sha256(), hashlib.sha256(), 0, 0)
                turns, loss, formatted = turns.copy(), loss.copy(), r["formatted"]
                ((role, text),) = parse(formatted)
                turns.update(f"{role}\n{text}\n".encode())
                if r["loss_start"] is not None:
                    masked = unescape(formatted[r["loss_start"] - r["stream_start"] : r["loss_end"] - r["stream_start"]])
                    loss.update(masked.encode())
                    lost += len(masked)
                stack.append((r["stream_end"], chars + len(formatted), turns, loss, n + 1, lost))
                if r["ends"] and r["own"]:
                    rows.append((r["node"], n + 1, turns.hexdigest(), lost, loss.hexdigest(), chars + len(formatted)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_READ)], schema=_READ)


def read_back(out: Layout) -> DataFrame:
    """Each conversation's counts and digests, from the stream alone."""
    spark, nodes = out.nodes.sparkSession, out.nodes
    first = nodes.groupBy("range").agg(F.min("stream_start").alias("low"), F.min_by("ancestors", "stream_start").alias("above")).orderBy("low").collect()  # a row a range
    lows, wanted = [r.low for r in first], []
    for r in first:
        for x in r.above:
            k = bisect.bisect_right(lows, x.start) - 1
            while k < len(lows) and lows[k] < x.end:
                wanted.append((first[k].range, r.range, x.start, x.end))
                k += 1
    columns = ["stream_start", "stream_end", "position", "ancestors", "formatted", "loss_start", "loss_end", "node", "ends"]
    earlier = spark.createDataFrame(wanted, "held int, at int, a long, b long")
    known = nodes.join(earlier, F.col("range") == F.col("held")).where("stream_start >= a and stream_start < b").select("at", F.lit(False).alias("own"), *columns)
    rows = nodes.select(F.col("range").alias("at"), F.lit(True).alias("own"), *columns).union(known)
    dealt = rows.repartitionByRange(max(1, len(first)), "at").sortWithinPartitions("at", "stream_start")
    read = materialize(dealt.mapInArrow(_read, "leaf binary, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"), "chat-read")
    return out.members.join(read, "leaf").drop("leaf")
