"""Secret scans over a trigram inverted index, with DataFrame functions only.

Each rule's regex gives a Boolean trigram query. The index holds, for each trigram that a
rule set asks for, the rows whose lower-cased text holds it; a clause's postings are
intersected per row, and only the rows left for a rule are verified with its regex. A rule
without a mandatory trigram is verified on every row.

A row is known by its id and its text's hash, so repeated ids, null ids and repeated rows
are told apart by what they hold, and equal rows get equal results. Matches of a kind do not
overlap, the leftmost counts; matches of different kinds may, and tie at a start by the order
of the rules. A null or empty text has no spans; texts of any length are read whole; an empty
table gives an empty table; extra columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import id_text
from corpusloom.llm.trigrams import ANY, trigram_query
from corpusloom.sources.storage import materialize


@dataclass(frozen=True)
class Rule:
    """A match counts if the given group has min_length code points."""

    kind: str
    regex: str
    group: int = 0
    min_length: int = 1


BASE_RULES = (
    Rule("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}"),  # the runs of [0-9a-f]+ that have 16 characters or more
)
ADDED_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
    Rule("forge_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("cloud_key", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("payment_key", r"sk_live_[0-9A-Za-z]{16,}"),
    Rule("signed_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("bearer", r"[Bb]earer\x20+[A-Za-z0-9._~+/-]{16,}"),
)
RULES = BASE_RULES + ADDED_RULES
_SEPARATOR = "\u0001"




def build_index(keyed: DataFrame, trigrams: list[str]) -> DataFrame:
    """Postings: doc_id, text_hash, trigram; one row for each trigram that a row's text holds."""
    # generated, so that the optimizer cannot write the expression into each of its uses
    lower = keyed.select("doc_id", "text_hash", F.explode(F.array(F.lower("text"))).alias("lower"))
    held = F.concat_ws(_SEPARATOR, *[F.when(F.contains("lower", F.lit(t)), F.lit(t)) for t in trigrams])
    return lower.select("doc_id", "text_hash", F.explode(F.split(held, _SEPARATOR)).alias("trigram")).where("trigram <> ''")


def candidates(index: DataFrame, queries: dict[str, frozenset]) -> DataFrame:
    """doc_id, text_hash and the kinds of the rules of which a clause's trigrams all are there."""
    rows = [(kind, n, t, 1 << k, (1 << len(c)) - 1) for kind, q in queries.items() for n, c in enumerate(sorted(map(sorted, q))) for k, t in enumerate(c)]
    terms = index.sparkSession.range(1).select(F.inline(F.array(*[F.struct(F.lit(r[0]).alias("kind"), F.lit(r[1]).alias("clause"), F.lit(r[2]).alias("trigram"), F.lit(r[3]).cast("long").alias("bit"), F.lit(r[4]).cast("long").alias("full")) for r in rows])))
    held = index.join(F.broadcast(terms), "trigram")  # as many rows as the rules have terms
    met = held.groupBy("doc_id", "text_hash", "kind", "clause").agg(F.bit_or("bit").alias("met"), F.max("full").alias("full")).where("met = full")
    return met.groupBy("doc_id", "text_hash").agg(F.collect_set("kind").alias("kinds"))


def _spans(rule: Rule, rank: int) -> Column:
    """array<struct<start, rank, end, kind>> of a rule's matches in the column text, in code
    points, from the lengths of the matches and of the pieces between them."""
    text, regex = F.col("text"), F.lit(rule.regex)
    lengths = F.arrays_zip(
        F.transform(F.split(text, rule.regex, -1), F.length).alias("gap"),
        F.transform(F.regexp_extract_all(text, regex, F.lit(0)), F.length).alias("size"),
        F.transform(F.regexp_extract_all(text, regex, F.lit(rule.group)), F.length).alias("part"),
    )
    none = F.array().cast("array<struct<start:long,rank:int,end:long,kind:string>>")

    def step(acc, x):
        start = acc["at"] + x["gap"]
        end = start + F.coalesce(x["size"], F.lit(0))
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(rule.kind).alias("kind"))
        return F.struct(end.alias("at"), F.when(x["part"] >= rule.min_length, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    start = F.struct(F.lit(0).cast("long").alias("at"), none.alias("out"))
    return F.when(text.rlike(rule.regex), F.aggregate(lengths, start, step, lambda acc: acc["out"])).otherwise(none)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text", keep_row: bool = False) -> DataFrame:
    """doc_id, text and spans, array<struct<start, rank, end, kind>> sorted by start, then by
    the rules' order. Start and end are code points, the end exclusive.
    keep_row: also row, a struct of all columns of docs."""
    queries = {r.kind: trigram_query(r.regex) for r in rules}
    indexed = {k: q for k, q in queries.items() if q != ANY}
    keyed = id_text(docs, id_col, text_col, keep_row).withColumn("text_hash", F.xxhash64("text"))
    if indexed:
        index = build_index(keyed, sorted({t for q in indexed.values() for c in q for t in c}))
        found = materialize(candidates(index, indexed), "secret-candidates").withColumnsRenamed({"doc_id": "c_id", "text_hash": "c_hash"})
        # broadcast only if the measured table is below the session's threshold
        keyed = keyed.join(found, keyed.doc_id.eqNullSafe(found.c_id) & (keyed.text_hash == found.c_hash), "left")
    else:
        keyed = keyed.withColumn("kinds", F.array().cast("array<string>"))
    each = []
    for rank, rule in enumerate(rules):
        spans = _spans(rule, rank)
        each.append(spans if queries[rule.kind] == ANY else F.when(F.array_contains("kinds", rule.kind), spans).otherwise(F.array().cast("array<struct<start:long,rank:int,end:long,kind:string>>")))
    return keyed.select("doc_id", "text", F.array_sort(F.concat(*each)).alias("spans"), *["row"] * keep_row)


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def digests(scanned: DataFrame) -> DataFrame:
    """Counts of the base kinds, the digest of their spans, and all spans."""
    spans, base = F.col("spans"), [r.kind for r in BASE_RULES]
    count = lambda kind: F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return scanned.select(
        "doc_id",
        *map(count, base),
        F.sha2(_listed(F.filter(spans, lambda x: x["kind"].isin(base))), 256).alias("base_sha256"),
        _listed(spans).alias("spans"),
    )


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The same rows and columns; what the spans cover is replaced by [kind], overlapping
    spans by that of the first."""
    scanned, text = scan(docs, rules, id_col, text_col, keep_row=True), F.col("text")

    def step(acc, x):
        inside = x["start"] < acc["at"]
        before = F.substring(text, (acc["at"] + 1).cast("int"), (x["start"] - acc["at"]).cast("int"))
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.when(inside, acc["out"]).otherwise(F.concat(acc["out"], before, F.lit("["), x["kind"], F.lit("]"))).alias("out"))

    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    left = F.aggregate("spans", start, step, lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.length(text))))
    row = F.col("row")
    return scanned.select(*[F.when(F.size("spans") > 0, left).otherwise(row[c]).alias(c) if c == text_col else row[c].alias(c) for c in docs.columns])
