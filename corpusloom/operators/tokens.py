"""Character and subword tokens, loss masks, windows and deterministic batches."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import chars
from corpusloom.functions import text as T
from corpusloom.functions.batches import bounded_batches, portions
from corpusloom.functions.ordered import Carry, scan, sums_before
from corpusloom.operators.corpus import numbered
from corpusloom.sources.storage import copy_file, materialize, spread

# The special tokens in the order of their ids.
SPECIAL = (T.UNK, T.USER, T.ASSISTANT, T.END)
_MARKERS = r"<\|user\|>|<\|assistant\|>|<\|end\|>"
_PIECES = f"(?s){_MARKERS}|."


def pieces(text):
    """array<string>: markers and single characters."""
    return F.regexp_extract_all(text, F.lit(_PIECES), F.lit(0))


def char_counts(lines: DataFrame) -> DataFrame:
    """char, n of all characters outside the markers."""
    return chars.char_counts(lines.select(F.regexp_replace("text", _MARKERS, "").alias("text")), "text")


def vocabulary(lines: DataFrame, least: int = 1) -> DataFrame:
    """token, id: the special tokens, then the characters seen `least` times in code-point order."""
    special = lines.sparkSession.range(1).select(F.posexplode(F.array(*map(F.lit, SPECIAL))).alias("id", "token")).select("token", F.col("id").cast("long").alias("id"))
    seen = numbered(char_counts(lines).where(F.col("n") >= least).select(F.col("char").alias("token")), "id", ("token",))
    return special.unionByName(seen.select("token", (F.col("id") + len(SPECIAL)).alias("id")))


def char_tokens(lines: DataFrame, vocab: DataFrame) -> DataFrame:
    """doc_id, pos, piece, token: unknown characters have the id of the unknown token."""
    rows = lines.select("doc_id", F.posexplode(pieces(F.col("text"))).alias("pos", "piece"))
    return rows.join(vocab.select(F.col("token").alias("piece"), F.col("id").alias("t")), "piece", "left").select("doc_id", "pos", "piece", F.coalesce("t", F.lit(0)).alias("token"))


def char_encode(docs: DataFrame, vocab: DataFrame) -> DataFrame:
    """doc_id, tokens array<int>. The vocabulary goes to the workers as a table by code point,
    which bounds its size; a text is looked up in it at once."""
    import numpy as np

    rows = vocab.where(F.length("token") == 1).select(F.ascii("token").alias("c"), "id").toArrow()  # a row a code point at most
    table = np.zeros(0x110000, np.int32)
    table[rows.column("c").to_numpy()] = rows.column("id").to_numpy()
    shipped = docs.sparkSession.sparkContext.broadcast(table)

    bounded_batches(docs.sparkSession)
    return spread(docs.select("doc_id", "text")).mapInArrow(lambda batches: _encoded(batches, shipped.value), "doc_id long, tokens array<int>")


def _encoded(batches, ids):
    """doc_id and tokens, a few megabytes of texts at a time; ids by code point."""
    import re

    import numpy as np

    marker = re.compile("(" + "|".join(map(re.escape, SPECIAL[1:])) + ")")
    at = {m: np.array([n], np.int32) for n, m in enumerate(SPECIAL)}
    code = lambda t: at.get(t) if t in at else ids[np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)]
    for batch in batches:
        for rows in portions(batch, "text"):
            parts = [np.concatenate([code(p) for p in marker.split(t)]) for t in ("" if t is None else t for t in rows.column(1).to_pylist())]
            starts = pa.array(np.concatenate(([0], np.cumsum([len(p) for p in parts]))), pa.int32())
            values = pa.array(np.concatenate([np.zeros(0, np.int32), *parts]).astype(np.int32, copy=False))
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.ListArray.from_arrays(starts, values)], ["doc_id", "tokens"])


def char_decode(tokens: DataFrame, vocab: DataFrame, skip_special: bool = False) -> DataFrame:
    """doc_id, text of tokens (doc_id, pos, token)."""
    rows = tokens.select("doc_id", "pos", F.col("token").alias("id")).join(vocab.select("id", F.col("token").alias("piece")), "id")
    if skip_special:
        rows = rows.where(F.col("id") >= len(SPECIAL))
    return rows.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "piece"))), lambda x: x["piece"]), "").alias("text"))


def loss_mask(tokens: DataFrame, long_lines: bool = False) -> DataFrame:
    """tokens (doc_id, pos, piece) with weight 1 after an assistant marker up to and with the
    next end marker, 0 elsewhere; each line starts anew. A line is one window; long_lines: lines of
    any length are scanned by ranges of their places."""
    marked = tokens.withColumn("_marker", F.when(F.col("piece").isin(T.USER, T.ASSISTANT, T.END), F.col("piece")))
    if long_lines:
        marked = scan(marked, ["pos"], {"_last": Carry("near", "_marker")}, ("doc_id",))
    else:
        before = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
        marked = marked.withColumn("_last", F.last("_marker", ignorenulls=True).over(before))
    inside = F.coalesce(F.col("_last") == T.ASSISTANT, F.lit(False))
    return marked.withColumn("weight", (inside & ~F.col("piece").isin(T.USER, T.ASSISTANT)).cast("int")).drop("_marker", "_last")


def masked_arrays(masked: DataFrame, vocab: DataFrame) -> DataFrame:
    """doc_id, tokens and weights, in order, of masked pieces (doc_id, pos, piece, weight)."""
    coded = masked.join(vocab.select(F.col("token").alias("piece"), "id"), "piece", "left")
    rows = F.sort_array(F.collect_list(F.struct("pos", F.coalesce("id", F.lit(0)).cast("int").alias("id"), "weight")))
    return coded.groupBy("doc_id").agg(rows.alias("r")).select("doc_id", F.col("r.id").alias("tokens"), F.col("r.weight").alias("weights"))


def mask_ratio(masked: DataFrame) -> DataFrame:
    return masked.agg(F.count("*").alias("tokens"), F.coalesce(F.sum("weight"), F.lit(0)).alias("targets"), (F.sum("weight") / F.count("*")).alias("ratio"))


def check_mask_ratio(ratio: float) -> None:
    if not 0.1 < ratio < 0.95:
        raise ValueError(f"the loss mask covers {ratio:.3f} of the tokens")


def shifted(masked: DataFrame) -> DataFrame:
    """Each token with its target: the token and weight after it (null at a line's end)."""
    w = Window.partitionBy("doc_id").orderBy("pos")
    return masked.withColumn("target", F.lead("token").over(w)).withColumn("target_weight", F.lead("weight").over(w))


def token_windows(arrays: DataFrame, size: int = 256) -> DataFrame:
    """doc_id, window, tokens: size + 1 tokens every size; a shorter tail is dropped."""
    n = F.floor((F.size("tokens") - 1) / size).cast("int")
    return arrays.where(n > 0).select("doc_id", "tokens", F.explode(F.sequence(F.lit(0), n - 1)).alias("window")).select("doc_id", "window", F.slice("tokens", F.col("window") * size + 1, F.lit(size + 1)).alias("tokens"))


def bits_per_char(windows: DataFrame, n_chars: int, n_tokens: int, size: int = 256) -> DataFrame:
    """One row from the windows' summed nats: bits by character of the share that was scored."""
    scored = F.count("*") * size / F.lit(max(n_tokens - 1, 1))
    return windows.agg((F.sum("nats") / F.log(F.lit(2.0)) / (F.lit(n_chars) * scored)).alias("bits_per_char"))


def batch_offsets(spark, length: int, block: int, batch: int, seed: int, steps: int) -> DataFrame:
    """step, i, offset: a function of seed and step alone."""
    high = length - block - 1
    if high <= 0:
        raise ValueError("the stream is shorter than a block")
    ids = spark.range(steps * batch).select((F.col("id") / batch).cast("long").alias("step"), (F.col("id") % batch).alias("i"))
    return ids.withColumn("offset", T.mixed(seed, F.col("step"), F.col("i")) % high)


def encode_split(docs: DataFrame, val_every: int, most_tokens: int) -> DataFrame:
    """docs (seq, n_tokens) with part: val for every val_every-th document while the tokens of
    val are below the limit, by document; else train."""
    n = numbered(docs)
    val = sums_before(n.where(F.col("n") % val_every == 0), ["seq"], "n_tokens", "written").where(F.col("written") < most_tokens)
    return n.join(val.select(F.col("seq").alias("_v")), n["seq"] == F.col("_v"), "left").withColumn("part", F.when(F.col("_v").isNull(), "train").otherwise("val")).drop("_v", "n")


#: Candidates that are left for the last part of an admission, which the driver does.
FEW_LEFT = 100_000


def admit(docs: DataFrame, val_every: int, most_tokens: int, chunk: int = 4000) -> DataFrame:
    """docs (seq, n_tokens) with part by greedy admission: of every val_every-th document, those go
    to val whose tokens, with those written before its chunk of `chunk` documents, are below the
    limit; one that is too large is skipped, and later ones may still enter. What is written
    counts from the next chunk on.

    The limit can only leave less room, so a candidate that does not fit once never does. Runs of
    chunks all of whose candidates fit are therefore admitted whole, by sums over ranges, up to
    the first chunk that has one that does not; that chunk is judged, the candidates that are too
    large for the rest are dropped, and so on. Once few are left, the driver folds them."""
    n = numbered(docs)
    room, at, gains, few = most_tokens, -1, [], []
    candidates = materialize(n.where(F.col("n") % val_every == 0).select("seq", F.floor(F.col("n") / chunk).alias("chunk"), F.col("n_tokens").cast("long").alias("n_tokens")), "admission")
    left = candidates
    while True:
        left = left.where((F.col("n_tokens") < room) & (F.col("chunk") > at))
        if left.limit(FEW_LEFT + 1).count() <= FEW_LEFT:
            few = _folded([tuple(r) for r in left.select("chunk", "seq", "n_tokens").collect()], room)
            break
        chunks = left.groupBy("chunk").agg(F.sum("n_tokens").alias("sum"), F.max("n_tokens").alias("largest"))
        placed = materialize(sums_before(chunks, ["chunk"], "sum", "before"), "admission-chunks")
        over = placed.where(F.col("before") + F.col("largest") >= room).agg(F.min_by(F.struct("chunk", "before"), "chunk").alias("x")).first().x
        if over is None:
            gains.append((at, None, room))
            break
        # all before the chunk, and of the chunk those that fit
        rest = room - over.before
        gains += [(at, over.chunk, room), (over.chunk - 1, over.chunk + 1, rest)]
        room = rest - (left.where((F.col("chunk") == over.chunk) & (F.col("n_tokens") < rest)).agg(F.sum("n_tokens")).first()[0] or 0)
        at = over.chunk
    fits = F.lit(False)  # (after a chunk, before a chunk, below so many tokens), a condition for each turn
    for after, before, below in gains:
        fits = fits | ((F.col("chunk") > after) & (F.lit(True) if before is None else F.col("chunk") < before) & (F.col("n_tokens") < below))
    val = candidates.where(fits).select(F.col("seq").alias("_v")).unionByName(docs.sparkSession.createDataFrame([(x,) for x in few], "_v long"))
    return n.join(val, n["seq"] == F.col("_v"), "left").withColumn("part", F.when(F.col("_v").isNull(), "train").otherwise("val")).drop("_v", "n")


def _folded(rows: list[tuple], room: int) -> list[int]:
    """seq of the candidates (chunk, seq, tokens) that are admitted."""
    from itertools import groupby

    out = []
    for _, group in groupby(sorted(rows), key=lambda r: r[0]):
        fit = [r for r in group if r[2] < room]
        out += [r[1] for r in fit]
        room -= sum(r[2] for r in fit)
    return out


def encode_summary(encoded: DataFrame) -> DataFrame:
    """part, docs, tokens, chars_per_token of documents (part, n_tokens, n_chars)."""
    return encoded.groupBy("part").agg(F.count("*").alias("docs"), F.sum("n_tokens").alias("tokens"), F.bround(F.sum("n_chars") / F.greatest(F.sum("n_tokens"), F.lit(1)), 4).alias("chars_per_token"))


def train_subwords(sample: DataFrame, path: str, vocab_size: int = 8000, lines: int = 100_000, seed: int = 1) -> None:
    """Fit a unigram model with byte fallback on a bounded, seeded sample of sentences (text),
    and write it to path. lines bounds what reaches the driver."""
    import sentencepiece

    rows = sample.where("text <> ''").orderBy(T.mixed(seed, F.col("text")), "text").limit(lines)
    sentencepiece.SentencePieceTrainer.train(sentence_iterator=(r.text for r in rows.toLocalIterator()), model_prefix=path.removesuffix(".model"), vocab_size=vocab_size, model_type="unigram", byte_fallback=True, normalization_rule_name="identity", split_by_whitespace=False, character_coverage=0.9995, max_sentence_length=8192, hard_vocab_limit=False, minloglevel=2, user_defined_symbols=list(SPECIAL[1:]))


def model_bytes(spark, path: str) -> bytes:
    """A model file, from any store that Spark reads."""
    return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])


_processors: dict[bytes, object] = {}  # of a Python worker


def _processor(model: bytes):
    import hashlib

    import sentencepiece

    key = hashlib.sha256(model).digest()
    if key not in _processors:
        _processors[key] = sentencepiece.SentencePieceProcessor(model_proto=model)
    return _processors[key]


def subword_encode(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, tokens array<int> by a SentencePiece model file, which goes to the workers once."""
    shipped = docs.sparkSession.sparkContext.broadcast(model_bytes(docs.sparkSession, model_path))

    bounded_batches(docs.sparkSession)

    def run(batches):
        sp = _processor(shipped.value)
        for batch in batches:
            for part in portions(batch, "text"):
                ids = sp.encode([t or "" for t in part.column(1).to_pylist()], num_threads=1)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, tokens array<int>")


def subword_decode(tokens: DataFrame, model_path: str) -> DataFrame:
    shipped = tokens.sparkSession.sparkContext.broadcast(model_bytes(tokens.sparkSession, model_path))
    bounded_batches(tokens.sparkSession)
    return tokens.select("doc_id", "tokens").mapInArrow(lambda batches: _decoded(batches, _processor(shipped.value)), "doc_id long, text string")


def _decoded(batches, sp):
    """doc_id and text, a few megabytes of ids at a time."""
    for batch in batches:
        for part in portions(batch, "tokens"):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([sp.decode(x or []) for x in part.column(1).to_pylist()], pa.string())], ["doc_id", "text"])


# --- saved tokenizers ----------------------------------------------------------------


class CharTokenizer:
    """Characters by a vocabulary (token, id)."""

    def __init__(self, vocab: DataFrame):
        self.vocab = vocab

    def encode(self, docs: DataFrame) -> DataFrame:
        return char_encode(docs, self.vocab)

    def decode(self, tokens: DataFrame, skip_special: bool = False) -> DataFrame:
        return char_decode(tokens.select("doc_id", F.posexplode("tokens").alias("pos", "token")), self.vocab, skip_special)

    def save(self, folder: str) -> None:
        """One JSON row: type and itos, the tokens by id."""
        tokens = F.transform(F.sort_array(F.collect_list(F.struct("id", "token"))), lambda x: x["token"])
        self.vocab.agg(F.lit("char").alias("type"), tokens.alias("itos")).write.mode("overwrite").json(f"{folder}/tokenizer")


class SubwordTokenizer:
    """Pieces by a SentencePiece model file."""

    def __init__(self, model_path: str):
        self.model_path = model_path

    def encode(self, docs: DataFrame) -> DataFrame:
        return subword_encode(docs, self.model_path)

    def decode(self, tokens: DataFrame, skip_special: bool = True) -> DataFrame:
        """Special tokens are the model's user-defined ones and markers, by their pieces."""
        if skip_special:
            sp = _processor(model_bytes(tokens.sparkSession, self.model_path))
            special = [i for i in map(sp.piece_to_id, SPECIAL) if sp.id_to_piece(i) in SPECIAL]
            if special:
                tokens = tokens.withColumn("tokens", F.filter("tokens", lambda x: ~x.isin(*special)))
        return subword_decode(tokens, self.model_path)

    def save(self, folder: str, spark) -> None:
        sp = _processor(model_bytes(spark, self.model_path))
        spark.createDataFrame([("subword", sp.get_piece_size())], "type string, vocab_size int").write.mode("overwrite").json(f"{folder}/tokenizer")
        copy_file(spark, self.model_path, f"{folder}/spm.model")


def load_tokenizer(spark, folder: str) -> CharTokenizer | SubwordTokenizer:
    """The tokenizer that save() wrote; one that names no type is of characters."""
    row = spark.read.schema("type string, itos array<string>").json(f"{folder}/tokenizer")
    if row.first().type == "subword":
        return SubwordTokenizer(f"{folder}/spm.model")
    return CharTokenizer(row.select(F.posexplode("itos").alias("id", "token")).select("token", F.col("id").cast("long").alias("id")))
