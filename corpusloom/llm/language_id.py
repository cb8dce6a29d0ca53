"""Language identification by mixture inference.

Each language has a distribution over hashed byte trigrams of lower-cased text, counted
over all learning documents. A document's grams are explained by a mixture of languages
whose shares expectation-maximisation estimates; the set of languages grows, from the best
single one, while the best further language raises the log-likelihood by more than a
penalty. The prediction is the language of the largest share, the score that share.

Defined cases: a text that is null or has no letter is `und` with score 0 and no languages;
so is every text if nothing could be learned. A null language is not learned from. A null
id is held out of learning but not counted as held out. Equal shares go to the language
that sorts first. Repeated rows count each time in learning and get equal results. Texts of
any length are read whole, their grams counted in a table of fixed size. Empty
tables give empty tables. Extra columns are not read, and only pass through with keep_row.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import add_binary, bounded_batches, cached, id_text, portions

GRAM_BITS = 16
CHUNK = 4096  # gram counts in a row of the partial sums
SMOOTHING = 0.5
#: Added languages must raise the log-likelihood by PENALTY * ln(number of grams).
PENALTY = 4.0
ITERATIONS, TOLERANCE = 30, 1e-4
UNKNOWN = "und"


def gram_codes(text: str):
    """The hashed trigram at each position of the text's UTF-8 bytes, with a space at either end."""
    import numpy as np

    b = np.frombuffer(f" {text.lower()} ".encode(), np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.zeros(0, np.uint16)
    key = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    return ((key * np.uint32(2654435761)) >> np.uint32(32 - GRAM_BITS)).astype(np.uint16)


def gram_counts(text: str):
    """Distinct grams and how often each occurs."""
    import numpy as np

    codes = gram_codes(text)
    if len(codes) > 1 << GRAM_BITS:
        full = np.bincount(codes, minlength=1 << GRAM_BITS)
        grams = np.flatnonzero(full)
        return grams, full[grams]
    if not len(codes):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    codes = np.sort(codes, kind="stable")
    first = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
    return codes[first].astype(np.int64), np.diff(np.append(first, len(codes)))


def held_out(id_col):
    """True for documents that are not learned from; false for a null id."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], bytes]:
    """The languages, sorted, and their gram counts as int64[languages, 2**GRAM_BITS]: what
    reaches the driver is bounded by the number of languages, whatever the corpus."""
    bounded_batches(docs.sparkSession)
    chosen = docs.select(docs[lang_col].cast("string").alias("lang"), docs[text_col].cast("string").alias("text")).where(
        docs[id_col].isNotNull() & docs[lang_col].isNotNull() & docs[text_col].isNotNull() & ~held_out(docs[id_col])
    )

    def count(batches):
        import numpy as np

        sums: dict[str, object] = {}
        for batch in batches:
            for part in portions(batch, "text"):
                for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    if lang not in sums:
                        sums[lang] = np.zeros(1 << GRAM_BITS, np.int64)
                    grams, n = gram_counts(text)
                    sums[lang][grams] += n
        rows = [(lang, k, row.tobytes()) for lang, total in sums.items() for k, row in enumerate(total.reshape(-1, CHUNK))]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], ["lang", "chunk", "counts"])

    schema = "lang string, chunk int, counts binary"
    rows = add_binary(chosen.mapInArrow(count, schema), ["lang", "chunk"]).collect()
    langs = sorted({r.lang for r in rows})
    parts = {(r.lang, r.chunk): bytes(r.counts) for r in rows}
    return langs, b"".join(parts[lang, k] for lang in langs for k in range((1 << GRAM_BITS) // CHUNK))


class Mixture:
    """The gram distributions of the languages, and the inference for one text."""

    def __init__(self, langs: list[str], counts: bytes):
        import numpy as np

        self.langs = langs
        c = np.frombuffer(counts, np.int64).reshape(len(langs), 1 << GRAM_BITS).astype(np.float64)
        c = (c + SMOOTHING) / (c.sum(1, keepdims=True) + SMOOTHING * (1 << GRAM_BITS))
        self.p = np.ascontiguousarray(c.T)

    def fit(self, p, n):
        """Shares and log-likelihood of a set of languages."""
        import numpy as np

        share, total = np.full(p.shape[1], 1 / p.shape[1]), n.sum()
        for _ in range(ITERATIONS):
            new = share * (p.T @ (n / (p @ share))) / total
            done = abs(new - share).max() < TOLERANCE
            share = new
            if done:
                break
        return share, float(n @ np.log(p @ share))

    def shares(self, text: str) -> list[tuple[str, float]]:
        """The chosen languages by falling share."""
        import numpy as np

        if not self.langs or not any(map(str.isalpha, text)):
            return []
        grams, n = gram_counts(text)
        p, n = self.p[grams], n.astype(np.float64)
        single = n @ np.log(p)
        chosen = [int(single.argmax())]
        share, best, penalty = np.ones(1), single[chosen[0]], PENALTY * np.log(max(n.sum(), 2))
        while len(chosen) < len(self.langs):
            # the log-likelihood is concave: the slope towards a language bounds what it can add
            slope = (n / (p[:, chosen] @ share)) @ p - n.sum()
            tries = [(x, *self.fit(p[:, [*chosen, x]], n)) for x in range(len(self.langs)) if x not in chosen and slope[x] > penalty]
            x, new, found = max(tries, key=lambda t: t[2], default=(0, share, best))
            if found <= best + penalty:
                break
            chosen, share, best = [*chosen, x], new, found
        return sorted(((self.langs[x], float(min(1.0, s))) for x, s in zip(chosen, share)), key=lambda t: (-t[1], t[0]))


def classify(docs: DataFrame, model: tuple[list[str], bytes], id_col: str = "doc_id", text_col: str = "text", keep_row: bool = False) -> DataFrame:
    """doc_id, held_out, lang_pred, score and languages, the chosen set with its shares."""
    import hashlib

    langs, counts = model
    shipped, key = docs.sparkSession.sparkContext.broadcast(model), hashlib.sha256(repr(langs).encode() + counts).hexdigest()
    out = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))

    def run(batches):
        model = cached("lang", key, lambda: Mixture(*shipped.value))
        for batch in batches:
            for part in portions(batch, "text"):
                found = pa.array([[{"lang": x, "share": s} for x, s in model.shares(t)] for t in part.column("text").to_pylist()], out)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), found], [*kept, "languages"])

    rows = id_text(docs, id_col, text_col, keep_row)
    kept = ["doc_id", *["row"] * keep_row]
    schema = rows.select(*kept).withColumn("languages", F.lit(None).cast("array<struct<lang:string,share:double>>")).schema
    return rows.mapInArrow(run, schema).select(
        "doc_id",
        *["row"] * keep_row,
        held_out(F.col("doc_id")).alias("held_out"),
        F.coalesce(F.get("languages", F.lit(0))["lang"], F.lit(UNKNOWN)).alias("lang_pred"),
        F.coalesce(F.get("languages", F.lit(0))["share"], F.lit(0.0)).alias("score"),
        "languages",
    )
