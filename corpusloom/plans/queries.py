"""Named queries over the reference's own operators, and their DuckDB counterparts.

Each callable takes (spark, sf_dir). The tables hold no Japanese text, so the script class of
the queries is Latin; the Japanese rules are covered by the unit tests.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.functions.ordered import parts_by_size
from corpusloom.operators import chat, corpus, leak, pii, runs, stream, tokens
from corpusloom.sources import ranges, tables
from corpusloom.sources.storage import scratch_path
from corpusloom.streaming import state

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("seq"), "text", "source")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("line_no"), "text")


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/conversations.parquet")


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs of the conversations, seq = 1000000 conv_id + turn."""
    return chat.adjacent_pairs(_turns(spark, sf_dir)).withColumn("seq", F.col("conv_id") * 1_000_000 + F.col("turn"))


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log that begins anew every 400 lines: line, step, value."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.select(F.col("event_id").alias("line"), (F.col("event_id") % 400).alias("step"), "value")


def _sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("seq", "source", F.length("text").cast("long").alias("n_chars"))


# --- SQL parts -----------------------------------------------------------------------


def _sql_string(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_SPACES = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
_CONTROLS = r"[\x{0}-\x{8}\x{b}-\x{1f}\x{7f}-\x{9f}\p{Cf}\p{Co}]"
_LINE_ENDS = r"\r\n|[\n\x0b\x0c\r\x1c-\x1e\x{85}\x{2028}\x{2029}]"


def _collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '{_SPACES}', ' ', 'g'))"


def _norm(x: str) -> str:
    return _collapse(f"regexp_replace({x}, '{_CONTROLS}', '', 'g')")


def _clean(x: str) -> str:
    kept = f"list_filter(list_transform(string_split_regex({x}, '{_LINE_ENDS}'), lambda l: regexp_replace(l, '^{_SPACES}|{_SPACES}$', '', 'g')), lambda l: l <> '' AND NOT regexp_matches(l, {_sql_string(T.BOILERPLATE)}))"
    return _norm(f"array_to_string({kept}, ' ')")


def _ratio(x: str) -> str:
    return f"CASE WHEN length({x}) > 0 THEN length(regexp_replace({x}, '[^A-Za-zÀ-ÿ]', '', 'g')) / length({x})::DOUBLE ELSE 0.0 END"


def _repeated(rows: str, key: str, text: str, gram: int, times: int, least: int, last: int, step: str) -> str:
    """Keys of rows whose text repeats a gram; last: how many of the final places count not."""
    return f"SELECT DISTINCT {key} FROM (SELECT {key}, substr(t, i::INT + 1, {gram}) AS g, count(*) AS c FROM (SELECT {key}, t, unnest(range(0, length(t) - {gram} + 1 - {last}, {step})) AS i FROM (SELECT {key}, {text} AS t FROM {rows}) WHERE length(t) >= {least}) GROUP BY ALL) WHERE c >= {times}"


_STEP = "greatest(1, length(t) // 2000)"
_SCREEN = f"""
raw AS (SELECT doc_id, source, coalesce(text, '') AS raw, {_clean("coalesce(text, '')")} AS clean FROM documents),
cut AS (SELECT doc_id, source, raw, length(clean) AS full_length, left(clean, 20000) AS text FROM raw),
rep AS ({_repeated("cut", "doc_id", "text", 20, 4, 80, 1, _STEP)}),
scr AS (SELECT doc_id, source, text, CASE WHEN regexp_matches(raw, {_sql_string(T.REJECTED)}) THEN 'unsuitable' WHEN full_length < 200 THEN 'short'
        WHEN {_ratio("text")} < 0.7 THEN 'low_ratio' WHEN doc_id IN (SELECT doc_id FROM rep) THEN 'repetitive' END AS early FROM cut),
judged AS (SELECT *, coalesce(early, CASE WHEN row_number() OVER (PARTITION BY early, left(text, 200) ORDER BY doc_id) > 1 THEN 'duplicate' END) AS reason FROM scr)"""
_PAIRS = f"""
turns AS (SELECT conv_id, turn, role, {_collapse("coalesce(text, '')")} AS text FROM conversations),
heard AS (SELECT *, lag(role) OVER w AS r, lag(text) OVER w AS q FROM turns WHERE role IN ('user', 'assistant') OR text = '' WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
pairs AS (SELECT conv_id, turn, conv_id * 1000000 + turn AS seq, q, text AS a FROM heard WHERE role = 'assistant' AND text <> '' AND r = 'user' AND q <> '')"""
_POINTS = "points AS (SELECT event_id AS line, event_id % 400 AS step, value FROM events)"


def _mix(seed: int, *keys: str) -> str:
    return f"('0x' || substr(md5('{seed}' || {' || '.join(f'chr(58) || {k}' for k in keys)}), 1, 15))::BIGINT"


def _shuffled(rows: str, seed: int) -> str:
    return f"(row_number() OVER (ORDER BY {_mix(seed, 'doc_id')}, doc_id) - 1)"


def _sentences(rows: str, least: int, most: int) -> str:
    """doc_id, parts: sentences packed to the least bytes, then cut at the most."""
    step = max(1, most // 3)
    cut = f"CASE WHEN strlen(c) <= {most} THEN [c] ELSE list_filter(list_transform(range(0, length(c), {step}), lambda i: substr(c, i::INT + 1, {step})), lambda p: {_collapse('p')} <> '') END"
    return f"""
(SELECT doc_id, flatten(list_transform(CASE WHEN {_collapse('r.open')} <> '' THEN r.done || [r.open] ELSE r.done END, lambda c: {cut})) AS parts FROM
 (SELECT doc_id, list_reduce([{{'done': []::VARCHAR[], 'open': ''}}] || list_transform(regexp_extract_all(text, '[^。！？\n]*[。！？\n]|[^。！？\n]+'), lambda x: {{'done': []::VARCHAR[], 'open': x}}),
    lambda a, x: CASE WHEN strlen(a.open || x.open) >= {least} THEN {{'done': a.done || [a.open || x.open], 'open': ''}} ELSE {{'done': a.done, 'open': a.open || x.open}} END) AS r FROM {rows}))"""


# --- cleaning and filters --------------------------------------------------------------


@query(f"WITH {_SCREEN} SELECT doc_id, length(text)::BIGINT AS n_chars, md5(text) AS digest FROM judged WHERE reason IS NULL")
def corpus_clean(spark, sf_dir):
    screened = corpus.reject_duplicates(corpus.screen(_docs(spark, sf_dir), script=T.LATIN))
    return screened.where("reason is null").select(F.col("seq").alias("doc_id"), F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("digest"))


@query(f"WITH d AS (SELECT doc_id, {_norm('text')} AS t FROM documents) SELECT doc_id, length(t)::BIGINT AS n_chars, strlen(t)::BIGINT AS n_bytes, md5(t) AS digest FROM d")
def normalize_text(spark, sf_dir):
    t = F.col("t")
    return _docs(spark, sf_dir).select(F.col("seq").alias("doc_id"), T.normalize(F.col("text")).alias("t")).select("doc_id", F.length(t).cast("long").alias("n_chars"), F.octet_length(t).cast("long").alias("n_bytes"), F.md5(t).alias("digest"))


@query(f"WITH d AS (SELECT doc_id, {_clean('text')} AS t FROM documents) SELECT doc_id, length(t)::BIGINT AS n_chars, md5(t) AS digest FROM d")
def line_filter(spark, sf_dir):
    return _docs(spark, sf_dir).select(F.col("seq").alias("doc_id"), T.clean_document(F.col("text")).alias("t")).select("doc_id", F.length("t").cast("long").alias("n_chars"), F.md5("t").alias("digest"))


@query(f"SELECT doc_id, round({_ratio('text')}, 6) AS ratio FROM documents")
def script_ratio(spark, sf_dir):
    return _docs(spark, sf_dir).select(F.col("seq").alias("doc_id"), F.round(T.script_ratio(F.col("text"), T.LATIN), 6).alias("ratio"))


@query("SELECT doc_id, length(left(text, 20000))::BIGINT AS n_chars, md5(left(text, 200)) AS prefix_digest, length(text) >= 200 AS long_enough FROM documents")
def length_rules(spark, sf_dir):
    t = F.col("text")
    return _docs(spark, sf_dir).select(F.col("seq").alias("doc_id"), F.length(F.substring(t, 1, 20_000)).cast("long").alias("n_chars"), F.md5(T.prefix_key(t)).alias("prefix_digest"), (F.length(t) >= 200).alias("long_enough"))


@query(f"WITH rep AS ({_repeated('documents', 'doc_id', 'text', 20, 4, 80, 1, _STEP)}) SELECT doc_id, doc_id IN (SELECT doc_id FROM rep) AS repetitive FROM documents")
def repetition_flag(spark, sf_dir):
    return _docs(spark, sf_dir).select(F.col("seq").alias("doc_id"), T.is_repetitive(F.col("text")).alias("repetitive"))


@query(f"WITH {_SCREEN} SELECT coalesce(reason, 'kept') AS reason, count(*)::BIGINT AS n FROM judged GROUP BY 1")
def reject_reasons(spark, sf_dir):
    screened = corpus.reject_duplicates(corpus.screen(_docs(spark, sf_dir), script=T.LATIN))
    return screened.groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


@query("SELECT doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY left(text, 200) ORDER BY doc_id) = 1")
def prefix_dedup(spark, sf_dir):
    return corpus.first_of(_docs(spark, sf_dir), [T.prefix_key(F.col("text"))]).select(F.col("seq").alias("doc_id"))


@query("SELECT doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1")
def exact_dedup(spark, sf_dir):
    return corpus.first_of(_docs(spark, sf_dir), [F.sha2("text", 256)]).select(F.col("seq").alias("doc_id"))


# --- budgets, samples, splits, mixes -----------------------------------------------------


@query("SELECT doc_id FROM documents QUALIFY coalesce(sum(length(text)) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 1000000")
def char_budget(spark, sf_dir):
    return corpus.within_budget(_sized(spark, sf_dir), 1_000_000).select(F.col("seq").alias("doc_id"))


@query("SELECT doc_id FROM documents QUALIFY (row_number() OVER (ORDER BY doc_id) - 1) % 7 = 0")
def every_nth(spark, sf_dir):
    return corpus.every(_sized(spark, sf_dir), 7).select(F.col("seq").alias("doc_id"))


@query(r"SELECT doc_id FROM documents QUALIFY coalesce(sum(length(regexp_replace(text, '<[|](user|assistant|end|unk)[|]>', '', 'g'))) OVER (ORDER BY doc_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 40000")
def tail_holdout(spark, sf_dir):
    sized = _docs(spark, sf_dir).select("seq", F.length(T.without_markers(F.col("text"), T.REPLY_MARKERS)).cast("long").alias("n_chars"))
    return corpus.tail(sized, 40_000).select(F.col("seq").alias("doc_id"))


@query("SELECT doc_id, length(t)::BIGINT AS n_chars, md5(t) AS digest FROM (SELECT doc_id, substr(text, 1, (100000 - before)::INT) AS t FROM (SELECT doc_id, text, coalesce(sum(length(text) + 1) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM documents) WHERE before < 100000)")
def text_head(spark, sf_dir):
    head = corpus.text_head(_docs(spark, sf_dir).select("seq", "text"), 100_000)
    return head.select(F.col("seq").alias("doc_id"), F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("digest"))


@query("""WITH e AS (SELECT doc_id, length(text) AS n FROM documents QUALIFY (row_number() OVER (ORDER BY doc_id) - 1) % 3 = 0)
SELECT doc_id FROM e QUALIFY coalesce(sum(n) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 200000""")
def line_stream(spark, sf_dir):
    return corpus.line_stream(_docs(spark, sf_dir).select("seq", "text"), 3, 200_000).select(F.col("seq").alias("doc_id"))


@query("SELECT round(sum(strlen(text)) / greatest(sum(length(text)), 1), 6) AS bytes_per_char, greatest(1, round_even(sum(length(text)) / 100000.0, 0))::INT AS stride FROM documents")
def sample_stride(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    ratio = corpus.bytes_per_char(docs)
    n_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0]
    stride = corpus.stride_for(round(corpus.estimate_chars(n_bytes, ratio)), 100_000)
    return spark.createDataFrame([(round(ratio, 6), stride)], "bytes_per_char double, stride int")


@query("""WITH n AS (SELECT doc_id, length(text) AS c, row_number() OVER (ORDER BY doc_id) - 1 AS k FROM documents),
v AS (SELECT doc_id FROM n WHERE k % 20 = 0 QUALIFY coalesce(sum(c) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 100000)
SELECT doc_id, doc_id IN (SELECT doc_id FROM v) AS validation FROM n""")
def val_split(spark, sf_dir):
    return corpus.split_validation(_sized(spark, sf_dir), 20, 100_000).select(F.col("seq").alias("doc_id"), "validation")


@query("""WITH n AS (SELECT doc_id, length(text) // 2 AS c, row_number() OVER (ORDER BY doc_id) - 1 AS k FROM documents),
v AS (SELECT doc_id FROM n WHERE k % 10 = 0 QUALIFY coalesce(sum(c) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 20000),
e AS (SELECT *, CASE WHEN doc_id IN (SELECT doc_id FROM v) THEN 'val' ELSE 'train' END AS part FROM n JOIN (SELECT doc_id, length(text) AS chars FROM documents) USING (doc_id))
SELECT part, count(*)::BIGINT AS docs, sum(c)::BIGINT AS tokens, round_even(sum(chars) / greatest(sum(c), 1), 4) AS chars_per_token FROM e GROUP BY part""")
def encode_split(spark, sf_dir):
    sized = _sized(spark, sf_dir).withColumn("n_tokens", F.floor(F.col("n_chars") / 2))
    return tokens.encode_summary(tokens.encode_split(sized, 10, 20_000))


@query("""WITH RECURSIVE n AS (SELECT doc_id, (length(text) // 2)::BIGINT AS c, row_number() OVER (ORDER BY doc_id) - 1 AS k FROM documents),
cand AS MATERIALIZED (SELECT doc_id, c, k // 100 AS chunk FROM n WHERE k % 10 = 0),
f(chunk, w) AS (SELECT 0::BIGINT, 0::BIGINT UNION ALL SELECT f.chunk + 1, (f.w + coalesce((SELECT sum(c) FROM cand WHERE cand.chunk = f.chunk AND f.w + c < 20000), 0))::BIGINT FROM f WHERE f.chunk <= (SELECT max(chunk) FROM cand))
SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM cand JOIN f USING (chunk) WHERE w + c < 20000) THEN 'val' ELSE 'train' END AS part FROM n""")
def encode_admission(spark, sf_dir):
    """Validation documents by greedy admission, a chunk of 100 at a time."""
    sized = _sized(spark, sf_dir).withColumn("n_tokens", F.floor(F.col("n_chars") / 2))
    return tokens.admit(sized, 10, 20_000, 100).select(F.col("seq").alias("doc_id"), "part")


@query("SELECT source, count(*)::BIGINT AS docs, sum(length(text))::BIGINT AS chars, round_even(sum(length(text)) / greatest(sum(sum(length(text))) OVER (), 1), 4) AS share FROM documents GROUP BY source")
def source_share(spark, sf_dir):
    return corpus.source_share(_sized(spark, sf_dir))


@query(f"""WITH a AS (SELECT doc_id, {_shuffled('documents', 7)} AS position, count(*) OVER () AS n FROM documents),
b AS (SELECT doc_id, {_shuffled('documents', 8)} AS position, count(*) OVER () AS n FROM documents WHERE source = 'src0'),
u AS (SELECT 0 AS part, 1 AS copy, doc_id FROM a UNION ALL SELECT 0, 2, doc_id FROM a WHERE position < round_even(n * 0.5, 0)
 UNION ALL SELECT 1, c, doc_id FROM b, range(1, 3) x(c) UNION ALL SELECT 1, 3, doc_id FROM b WHERE position < round_even(n * 0.25, 0))
SELECT part::INT AS part, copy::INT AS copy, count(*)::BIGINT AS n, sum(doc_id)::BIGINT AS ids FROM u GROUP BY ALL""")
def mix_corpus(spark, sf_dir):
    rows = _sized(spark, sf_dir)
    return corpus.mix([(rows, 1.5), (rows.where("source = 'src0'"), 2.25)], 7).groupBy("part", "copy").agg(F.count("*").alias("n"), F.sum("seq").alias("ids"))


@query(f"SELECT doc_id AS seq, {_shuffled('documents', 11)}::BIGINT AS position FROM documents")
def seeded_shuffle(spark, sf_dir):
    return corpus.shuffled(_sized(spark, sf_dir), 11).select("seq", "position")


@query(f"SELECT doc_id, {_shuffled('documents', 3)} < (SELECT greatest(1, floor(count(*) * 0.01)) FROM documents) AS validation FROM documents")
def fraction_split(spark, sf_dir):
    return corpus.fraction_split(_sized(spark, sf_dir), 0.01, 3).select(F.col("seq").alias("doc_id"), "validation")


@query(f"""WITH {_SCREEN}, kept AS (SELECT *, length(text) AS n FROM judged WHERE reason IS NULL QUALIFY coalesce(sum(length(text)) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 500000)
SELECT count(*)::BIGINT AS total_documents, sum(n)::BIGINT AS total_chars, (SELECT count(*)::BIGINT FROM judged WHERE reason = 'duplicate' AND doc_id <= (SELECT max(doc_id) FROM kept)) AS duplicates FROM kept""")
def corpus_manifest(spark, sf_dir):
    built = corpus.build([("documents", _docs(spark, sf_dir), 500_000)], script=T.LATIN)
    row = corpus.manifest(*built)
    return row.select("total_documents", "total_chars", F.coalesce(F.try_element_at("rejected", F.lit("duplicate")), F.lit(0)).alias("duplicates"))


@query(f"""WITH {_SCREEN}, kept AS (SELECT *, length(text) AS n FROM judged WHERE reason IS NULL QUALIFY coalesce(sum(length(text)) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 500000),
lost AS (SELECT reason, count(*) AS n FROM judged WHERE reason IS NOT NULL AND doc_id <= (SELECT max(doc_id) FROM kept) GROUP BY reason),
src AS (SELECT 'documents' AS source, count(*) AS docs, sum(n) AS chars FROM kept)
SELECT (SELECT string_agg(source || ':' || docs || ':' || chars || ':1.0', ',') FROM src) AS sources, (SELECT string_agg(reason || ':' || n, ',' ORDER BY reason) FROM lost) AS rejected""")
def manifest_maps(spark, sf_dir):
    """The manifest's maps: its sources, and its rejections."""
    row = corpus.manifest(*corpus.build([("documents", _docs(spark, sf_dir), 500_000)], script=T.LATIN))
    text = lambda entries, *fields: F.array_join(F.transform(F.array_sort(F.map_entries(entries)), lambda e: F.concat_ws(":", *[f(e).cast("string") for f in fields])), ",")
    sources = text("sources", lambda e: e["key"], lambda e: e["value"]["docs"], lambda e: e["value"]["chars"], lambda e: e["value"]["share"])
    return row.select(sources.alias("sources"), text("rejected", lambda e: e["key"], lambda e: e["value"]).alias("rejected"))


# --- readers of files that the tables are written to -----------------------------------------


def _files(spark: SparkSession, name: str) -> str:
    return f"{scratch_path(spark, name)}/files"


@query("SELECT md5(text) AS digest, count(*)::BIGINT AS n FROM documents WHERE text <> '' GROUP BY 1")
def jsonl_texts(spark, sf_dir):
    """Texts from gzipped JSON lines."""
    path = _files(spark, "jsonl")
    texts = _docs(spark, sf_dir).select("text")
    texts.write.option("compression", "gzip").json(path)
    return tables.read_jsonl(spark, path, parts_by_size(texts, "text", least=8)).groupBy(F.md5("text").alias("digest")).agg(F.count("*").alias("n"))


@query("SELECT t::BIGINT AS turn, role, md5(text) AS digest, count(*)::BIGINT AS n FROM (SELECT row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS t, role, text FROM conversations) GROUP BY ALL")
def message_turns(spark, sf_dir):
    """Turns from rows that hold arrays of messages."""
    path = _files(spark, "messages")
    said = F.transform(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))), lambda m: F.struct(m["role"].alias("role"), m["text"].alias("content")))
    _turns(spark, sf_dir).groupBy("conv_id").agg(said.alias("conversations")).select("conversations").write.parquet(path)
    return tables.read_messages(spark, path).groupBy("turn", "role", F.md5("text").alias("digest")).agg(F.count("*").alias("n"))


@query(f"WITH {_PAIRS} SELECT (row_number() OVER (ORDER BY seq) - 1)::BIGINT AS seq, md5(q) AS q, md5(a) AS a FROM pairs WHERE a NOT LIKE '%\"%' AND q NOT LIKE '%\"%'")
def local_pairs(spark, sf_dir):
    """Pairs from a folder of TSV files, in the order of their names and lines."""
    path = _files(spark, "pairs")
    plain = _pairs(spark, sf_dir).where(~F.contains("q", F.lit('"')) & ~F.contains("a", F.lit('"')))  # the writer would quote them
    plain.repartitionByRange(parts_by_size(plain, "q", "a", least=4), "seq").sortWithinPartitions("seq").select("q", "a").write.option("sep", "\t").option("extension", "tsv").option("escapeQuotes", False).csv(path)
    return tables.read_local_pairs(spark, path).select("seq", F.md5("q").alias("q"), F.md5("a").alias("a"))


@query(r"SELECT (row_number() OVER (ORDER BY doc_id) - 1)::BIGINT AS seq, md5(t) AS digest FROM (SELECT doc_id, regexp_replace(replace(text, chr(10), ' '), '^" + _SPACES + "|" + _SPACES + r"$', '', 'g') AS t FROM documents) WHERE t <> ''")
def file_lines(spark, sf_dir):
    """One document a line, numbered over all files."""
    path = _files(spark, "lines")
    lines = _docs(spark, sf_dir).select("seq", F.replace(F.col("text"), F.lit("\n"), F.lit(" ")).alias("text"))
    tables.write_lines(lines.repartitionByRange(parts_by_size(lines, "text", least=5), "seq").sortWithinPartitions("seq"), path)
    return tables.read_lines(spark, path).select("seq", F.md5("text").alias("digest"))


@query("SELECT (event_id % 1000000)::INT AS step, CASE WHEN event_type <> 'click' THEN round(value, 4) END AS train_loss, CASE WHEN event_type = 'click' THEN round(value, 4) END AS val_loss FROM events")
def run_log(spark, sf_dir):
    """A run log with comments, train and validation points on rows of their own."""
    path, none = _files(spark, "log"), F.lit(None).cast("double")
    click, value = F.col("event_type") == "click", F.round("value", 4)
    points = spark.read.parquet(f"{sf_dir}/events.parquet").select((F.col("event_id") % 1_000_000).cast("int").alias("step"), none.alias("elapsed_sec"), F.col("event_id").alias("tokens"), none.alias("lr"), F.when(~click, value).alias("train_loss"), F.when(click, value).alias("val_loss"), none.alias("tok_per_sec"))
    tables.append_log(points, path)
    spark.range(3).select(F.concat(F.lit("# begun anew "), F.col("id")).alias("value")).write.mode("append").text(path)
    return tables.read_run_log(spark, path).select("step", "train_loss", "val_loss")


# --- conversations -----------------------------------------------------------------------


@query(f"WITH {_PAIRS} SELECT conv_id, turn, md5(q) AS q, md5(a) AS a FROM pairs")
def chat_pairs(spark, sf_dir):
    return _pairs(spark, sf_dir).select("conv_id", "turn", F.md5("q").alias("q"), F.md5("a").alias("a"))


@query("SELECT c.conv_id, c.turn, md5(p.text) AS q, md5(c.text) AS a FROM conversations c JOIN conversations p ON p.conv_id = c.conv_id AND p.turn = c.turn - 1 AND p.role = 'user' WHERE c.role = 'assistant'")
def parent_child_join(spark, sf_dir):
    name = lambda t: F.concat_ws(":", F.col("conv_id").cast("string"), t.cast("string"))
    m = _turns(spark, sf_dir).select(name(F.col("turn")).alias("message_id"), name(F.col("turn") - 1).alias("parent_id"), "role", "text", F.lit(False).alias("flagged"), F.col("turn").alias("seq"))
    part = lambda n: F.split("message_id", ":")[n].cast("long")
    return chat.pairs_of_tree(m).select(part(0).alias("conv_id"), part(1).alias("turn"), F.md5("q").alias("q"), F.md5("a").alias("a"))


@query("SELECT c.conv_id, c.turn FROM conversations c JOIN conversations p ON p.conv_id = c.conv_id AND p.turn = c.turn - 1 AND p.role = 'user' WHERE c.role = 'assistant' AND (c.conv_id + c.turn) % 7 <> 0 AND (p.conv_id + p.turn) % 7 <> 0")
def flagged_pairs(spark, sf_dir):
    """Pairs neither side of which is flagged: those whose conversation and turn sum to a multiple of 7."""
    name = lambda t: F.concat_ws(":", F.col("conv_id").cast("string"), t.cast("string"))
    m = _turns(spark, sf_dir).select(name(F.col("turn")).alias("message_id"), name(F.col("turn") - 1).alias("parent_id"), "role", "text", ((F.col("conv_id") + F.col("turn")) % 7 == 0).alias("flagged"), F.col("turn").alias("seq"))
    part = lambda n: F.split("message_id", ":")[n].cast("long")
    return chat.pairs_of_tree(m).select(part(0).alias("conv_id"), part(1).alias("turn"))


@query("SELECT conv_id, len(l)::INT AS n, md5(array_to_string(l, '|')) AS digest FROM (SELECT conv_id, list(coalesce(text, '') ORDER BY turn)[-3:] AS l FROM conversations GROUP BY conv_id)")
def last_turns(spark, sf_dir):
    turns = _turns(spark, sf_dir).groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("text")))), lambda x: x["text"]).alias("t"))
    last = turns.select("conv_id", T.last_turns(F.col("t"), 3).alias("l"))
    return last.select("conv_id", F.size("l").alias("n"), F.md5(F.array_join("l", "|")).alias("digest"))


@query(f"WITH {_PAIRS} SELECT seq FROM pairs WHERE length(q) <= 300 AND length(a) BETWEEN 4 AND 600")
def pair_length(spark, sf_dir):
    return chat.fitting(_pairs(spark, sf_dir), 300, 4, 600).select("seq")


@query(f"WITH {_PAIRS}, rep AS ({_repeated('pairs', 'seq', 'a', 6, 4, 12, 0, '1')}) SELECT seq, q = a OR seq IN (SELECT seq FROM rep) AS broken FROM pairs")
def broken_pairs(spark, sf_dir):
    return _pairs(spark, sf_dir).select("seq", T.looks_broken(F.col("q"), F.col("a")).alias("broken"))


@query(f"WITH {_PAIRS} SELECT seq FROM pairs QUALIFY row_number() OVER (PARTITION BY q, a ORDER BY seq) = 1")
def pair_dedup(spark, sf_dir):
    return chat.distinct_pairs(_pairs(spark, sf_dir)).select("seq")


@query(f"WITH {_PAIRS} SELECT seq, md5('<|user|>' || q || '<|assistant|>' || a || '<|end|>') AS line, md5(q) AS q, md5(a) AS a FROM pairs")
def chat_lines(spark, sf_dir):
    lines = _pairs(spark, sf_dir).select("seq", T.chat_line(F.col("q"), F.col("a")).alias("line"))
    back = lines.select("seq", "line", F.inline(T.chat_pairs_of_line(F.col("line"))))
    return back.select("seq", F.md5("line").alias("line"), F.md5("q").alias("q"), F.md5("a").alias("a"))


@query(f"WITH {_PAIRS} SELECT count(*)::BIGINT AS pairs, sum(length(q) + length(a))::BIGINT AS chars, (SELECT count(DISTINCT c)::BIGINT FROM (SELECT unnest(string_split(q || a, '')) AS c FROM pairs)) AS distinct_chars, round_even(avg(length(q)), 1) AS avg_q, round_even(avg(length(a)), 1) AS avg_a FROM pairs")
def sft_summary(spark, sf_dir):
    return chat.summary(_pairs(spark, sf_dir))


@query(f"WITH {_PAIRS}, rare AS (SELECT c FROM (SELECT unnest(string_split(q || a, '')) AS c FROM pairs) GROUP BY c HAVING count(*) < 300) SELECT seq FROM pairs WHERE NOT EXISTS (SELECT 1 FROM rare WHERE contains(q || a, c))")
def rare_chars(spark, sf_dir):
    return chat.without_rare(_pairs(spark, sf_dir), 300).select("seq")


@query(f"WITH {_PAIRS} SELECT seq FROM pairs WHERE (q, a) NOT IN (SELECT (q, a) FROM pairs WHERE turn = 1)")
def holdout_exact(spark, sf_dir):
    p = _pairs(spark, sf_dir)
    return chat.without_exact(p, p.where("turn = 1")).select("seq")


@query(f"""WITH {_PAIRS}, sides AS (SELECT seq, conv_id % 20 = 0 AS held, unnest([q, a]) AS t FROM pairs), w AS (SELECT seq, held, substr(t, i::INT + 1, 40) AS g FROM (SELECT *, unnest(range(0, length(t) - 39)) AS i FROM sides WHERE length(t) >= 40)),
bad AS (SELECT DISTINCT seq FROM w WHERE g IN (SELECT g FROM w WHERE held)) SELECT seq FROM pairs WHERE seq NOT IN (SELECT seq FROM bad)""")
def pairs_without_fragments(spark, sf_dir):
    p = _pairs(spark, sf_dir)
    return chat.without_fragments(p, p.where("conv_id % 20 = 0"), 40).select("seq")


@query("""WITH h AS (SELECT DISTINCT substr(text, i::INT + 1, 40) AS g FROM (SELECT text, unnest(range(0, length(text) - 39)) AS i FROM benchmark WHERE length(text) >= 40)),
w AS (SELECT doc_id, substr(text, i::INT + 1, 40) AS g FROM (SELECT doc_id, text, unnest(range(0, length(text) - 39)) AS i FROM documents WHERE length(text) >= 40))
SELECT DISTINCT doc_id FROM w SEMI JOIN h USING (g)""")
def holdout_fragment(spark, sf_dir):
    docs = _docs(spark, sf_dir).select("seq", "text")
    return chat.seeds_shared(docs, _lines(spark, sf_dir), 40).select(F.col("seq").alias("doc_id"))


# --- leaks and contacts ------------------------------------------------------------------

_PROBES = f"""
t AS (SELECT item_id, {_collapse("regexp_replace(text, '<[|](user|assistant|end|endoftext)[|]>', '', 'g')")} AS t FROM benchmark),
s AS (SELECT item_id, substr(t, round_even((length(t) - 48) * i / 2.0, 0)::INT + 1, 96) AS r FROM t, range(0, 3) x(i) WHERE length(t) >= 48),
g AS (SELECT item_id, (SELECT min(n) FROM range(48, greatest(48, length(r)) + 1) y(n) WHERE strlen(left(r, n::INT)) >= 96) AS n, r FROM s),
probes AS (SELECT left(r, n::INT) AS probe, min(item_id) AS line_no FROM g WHERE n IS NOT NULL GROUP BY 1)"""


@query(f"WITH {_PROBES} SELECT * FROM probes")
def leak_probes(spark, sf_dir):
    return leak.probes(_lines(spark, sf_dir))


@query(f"WITH {_PROBES} SELECT doc_id, line_no, md5(probe) AS probe, ((length(text) - length(replace(text, probe, ''))) / length(probe))::BIGINT AS n FROM documents, probes WHERE contains(text, probe)")
def leak_hits(spark, sf_dir):
    wanted = leak.probes(_lines(spark, sf_dir))
    docs = _docs(spark, sf_dir).select(F.col("seq").alias("doc_id"), "text")
    hits = leak.occurrences(docs, wanted).groupBy("doc_id", "probe").agg(F.count("*").alias("n"))
    return hits.join(wanted, "probe").select("doc_id", "line_no", F.md5("probe").alias("probe"), "n")


@query(f"WITH {_PROBES} SELECT line_no, md5(probe) AS probe, sum((length(text) - length(replace(text, probe, ''))) / length(probe))::BIGINT AS n FROM documents, probes WHERE contains(text, probe) GROUP BY ALL")
def byte_scan(spark, sf_dir):
    """The documents as files that are read by byte ranges: their probes' occurrences."""
    path = f"{scratch_path(spark, 'byte-scan')}/files"
    _docs(spark, sf_dir).select(F.coalesce("text", F.lit("")).alias("value")).write.text(path)
    wanted = leak.probes(_lines(spark, sf_dir))
    patterns = leak.shippable(wanted, "probe", leak.PROBE_CHARS, leak.MOST_SEEDS)
    hits = ranges.scan_files(spark, path, patterns, 1 << 20).groupBy("pattern").agg(F.count("*").alias("n"))
    return hits.join(wanted, hits["pattern"] == wanted["probe"]).select("line_no", F.md5("probe").alias("probe"), "n")


@query(f"WITH {_PROBES}, hit AS (SELECT DISTINCT line_no FROM probes SEMI JOIN documents ON contains(text, probe)) SELECT item_id AS line_no FROM benchmark WHERE item_id NOT IN (SELECT line_no FROM hit)")
def clean_holdout(spark, sf_dir):
    docs = _docs(spark, sf_dir).select(F.col("seq").alias("doc_id"), "text")
    return leak.clean_lines(_lines(spark, sf_dir), leak.report(docs, _lines(spark, sf_dir))).select("line_no")


@query(f"""WITH {_PROBES}, h AS (SELECT line_no, probe, sum((length(text) - length(replace(text, probe, ''))) / length(probe))::BIGINT AS n FROM documents, probes WHERE contains(text, probe) GROUP BY ALL)
SELECT (SELECT count(*) FROM probes)::BIGINT AS probes, count(*)::BIGINT AS hit_probes, coalesce(sum(n), 0)::BIGINT AS occurrences, count(*) > 0 AS leaked, array_to_string(list_sort(list(DISTINCT line_no)), ',') AS affected_lines,
 (SELECT string_agg(md5(probe) || ':' || n, ',' ORDER BY n DESC, probe) FROM (SELECT * FROM h ORDER BY n DESC, probe LIMIT 5)) AS examples FROM h""")
def leak_report(spark, sf_dir):
    docs = _docs(spark, sf_dir).select(F.col("seq").alias("doc_id"), "text")
    found = leak.report(docs, _lines(spark, sf_dir))
    examples = F.transform("examples", lambda x: F.concat(F.md5(x["probe"]), F.lit(":"), x["n"].cast("string")))
    return found.select("probes", "hit_probes", "occurrences", "leaked", F.array_join(F.col("affected_lines").cast("array<string>"), ",").alias("affected_lines"), F.array_join(examples, ",").alias("examples"))


def _contacts(column: str = "text") -> str:
    one = "SELECT doc_id, '{0}' AS kind, m[pos + 1] AS secret, pos, text, (list_sum(list_transform(g[1:pos + 1], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:pos], lambda x: length(x))), 0))::INT AS start FROM (SELECT *, unnest(range(0, len(m))) AS pos FROM (SELECT doc_id, {2} AS text, regexp_extract_all({2}, {1}) AS m, string_split_regex({2}, {1}) AS g FROM documents))"
    return " UNION ALL ".join(one.format(kind, _sql_string(regex), column) for kind, regex in pii.KINDS)


#: The tables hold no number of the phone rule's form, so two spellings of theirs are rewritten.
_PHONES = (r"\+1 \((\d{3})\) (\d{3})-(\d{4})", r"0\1-\2-\3")


def _contact_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select(F.col("seq").alias("doc_id"), F.regexp_replace("text", _PHONES[0], "0$1-$2-$3").alias("text"))


_CONTACTS = f"m AS (SELECT doc_id, kind, secret, pos, substr(text, greatest(start - 120, 0) + 1, least(start, 120)) AS context, regexp_matches(lower(secret), {_sql_string(pii.PLACEHOLDER)}) AS placeholder FROM ({_contacts(f'''regexp_replace(text, '{_PHONES[0]}', '{_PHONES[1]}', 'g')''')}))"


@query(f"WITH {_CONTACTS} SELECT doc_id, kind, pos::INT AS position, secret, placeholder FROM m")
def pii_matches(spark, sf_dir):
    return pii.matches(_contact_docs(spark, sf_dir)).select("doc_id", "kind", "position", "secret", "placeholder")


@query(f"WITH {_CONTACTS} SELECT doc_id, kind, pos::INT AS position, md5(context) AS context, length(regexp_replace(context, '^{_SPACES}|{_SPACES}$', '', 'g')) >= 20 AS usable FROM m")
def pii_context(spark, sf_dir):
    return pii.matches(_contact_docs(spark, sf_dir)).select("doc_id", "kind", "position", F.md5("context").alias("context"), pii.has_context(F.col("context")).alias("usable"))


@query(f"WITH {_CONTACTS}, t AS (SELECT * FROM m WHERE NOT placeholder AND length(regexp_replace(context, '^{_SPACES}|{_SPACES}$', '', 'g')) >= 20 QUALIFY row_number() OVER (PARTITION BY secret ORDER BY doc_id, pos, kind) = 1) SELECT doc_id, kind, secret FROM t ORDER BY doc_id, pos, kind LIMIT 60")
def pii_targets(spark, sf_dir):
    return pii.targets(pii.matches(_contact_docs(spark, sf_dir)), 60).select("doc_id", "kind", "secret")


@query(f"""WITH {_CONTACTS}, o AS (SELECT kind, secret, CASE doc_id % 3 WHEN 0 THEN 'it is ' || secret WHEN 1 THEN 'it is ' || left(secret, 8) ELSE 'nothing' END AS output, CASE WHEN contains(secret, '@') THEN split_part(secret, '@', 1) ELSE left(secret, 6) END AS part FROM m)
SELECT kind, CASE WHEN contains(output, secret) THEN 'exact' WHEN contains(output, part) AND length(part) >= 6 THEN 'partial' ELSE 'none' END AS leak, count(*)::BIGINT AS n FROM o GROUP BY ALL""")
def pii_leak_class(spark, sf_dir):
    said = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("it is "), F.col("secret"))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("it is "), F.substring("secret", 1, 8))).otherwise("nothing")
    return pii.leak_class(pii.matches(_contact_docs(spark, sf_dir)).withColumn("output", said)).groupBy("kind", "leak").agg(F.count("*").alias("n"))


@query(f"WITH {_CONTACTS}, u AS (SELECT DISTINCT secret, strpos(secret, '@') AS p FROM m) SELECT secret, CASE WHEN p > 0 THEN left(left(secret, p - 1), 2) || repeat('*', greatest(0, p - 3)) || substr(secret, p) ELSE left(secret, 3) || repeat('*', greatest(0, length(secret) - 3)) END AS masked FROM u")
def pii_mask(spark, sf_dir):
    return pii.matches(_contact_docs(spark, sf_dir)).select("secret").distinct().withColumn("masked", T.mask_contact(F.col("secret")))


@query(f"WITH {_CONTACTS} SELECT kind, count(*)::BIGINT AS n, count(DISTINCT secret)::BIGINT AS distinct_n, count(*) FILTER (placeholder)::BIGINT AS placeholders, count(*) FILTER (NOT placeholder)::BIGINT AS others, count(DISTINCT secret) FILTER (NOT placeholder)::BIGINT AS distinct_others FROM m GROUP BY kind")
def pii_summary(spark, sf_dir):
    return pii.summary(pii.matches(_contact_docs(spark, sf_dir)))


# --- tokens --------------------------------------------------------------------------------


def _chat_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select(F.col("seq").alias("doc_id"), T.chat_line(F.col("q"), F.col("a")).alias("text"))


_PIECES = f"""{_PAIRS}, pieces AS (SELECT doc_id, generate_subscripts(p, 1) - 1 AS pos, unnest(p) AS piece FROM
 (SELECT seq AS doc_id, ['<|user|>'] || string_split(q, '') || ['<|assistant|>'] || string_split(a, '') || ['<|end|>'] AS p FROM pairs))"""
_VOCAB = """vocab AS (SELECT c AS token, row_number() OVER (ORDER BY c) + 3 AS id FROM (SELECT DISTINCT piece AS c FROM pieces WHERE piece NOT IN ('<|user|>', '<|assistant|>', '<|end|>'))
 UNION ALL VALUES ('<|unk|>', 0), ('<|user|>', 1), ('<|assistant|>', 2), ('<|end|>', 3))"""


@query(f"WITH {_PIECES}, {_VOCAB} SELECT token, id::BIGINT AS id FROM vocab")
def char_vocab(spark, sf_dir):
    return tokens.vocabulary(_chat_docs(spark, sf_dir))


@query(f"WITH {_PIECES}, {_VOCAB} SELECT doc_id, count(*)::BIGINT AS n, md5(string_agg(id::VARCHAR, ' ' ORDER BY pos)) AS digest FROM pieces JOIN vocab ON piece = token GROUP BY doc_id")
def char_encode(spark, sf_dir):
    docs = _chat_docs(spark, sf_dir)
    rows = tokens.char_encode(docs, tokens.vocabulary(docs))
    return rows.select("doc_id", F.size("tokens").cast("long").alias("n"), F.md5(F.array_join(F.col("tokens").cast("array<string>"), " ")).alias("digest"))


@query(f"WITH {_PAIRS} SELECT seq AS doc_id, md5('<|user|>' || q || '<|assistant|>' || a || '<|end|>') AS digest FROM pairs")
def char_decode(spark, sf_dir):
    docs = _chat_docs(spark, sf_dir)
    tokenizer = tokens.CharTokenizer(tokens.vocabulary(docs))
    return tokenizer.decode(tokenizer.encode(docs)).select("doc_id", F.md5("text").alias("digest"))


@query("SELECT doc_id, md5(CASE WHEN ends_with(text, '<|end|>') THEN text ELSE text || '<|end|>' END) AS digest FROM documents")
def end_append(spark, sf_dir):
    return _docs(spark, sf_dir).select(F.col("seq").alias("doc_id"), F.md5(T.with_end(F.col("text"))).alias("digest"))


_MASK = f"{_PIECES}, marked AS (SELECT doc_id, pos, piece, last_value(CASE WHEN piece IN ('<|user|>', '<|assistant|>', '<|end|>') THEN piece END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM pieces), masked AS (SELECT *, (coalesce(m = '<|assistant|>', false) AND piece NOT IN ('<|user|>', '<|assistant|>'))::INT AS weight FROM marked)"


def _masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _chat_docs(spark, sf_dir).select("doc_id", F.posexplode(tokens.pieces(F.col("text"))).alias("pos", "piece"))
    return tokens.loss_mask(rows)


@query(f"WITH {_MASK} SELECT doc_id, sum(weight)::BIGINT AS targets, min(pos) FILTER (weight = 1)::INT AS first_target, max(pos) FILTER (weight = 1)::INT AS last_target FROM masked GROUP BY doc_id")
def loss_mask(spark, sf_dir):
    on = F.when(F.col("weight") == 1, F.col("pos"))
    return _masked(spark, sf_dir).groupBy("doc_id").agg(F.sum("weight").alias("targets"), F.min(on).alias("first_target"), F.max(on).alias("last_target"))


@query(f"WITH {_MASK}, shifted AS (SELECT doc_id, pos, lead(piece) OVER w AS target, lead(weight) OVER w AS tw FROM masked WINDOW w AS (PARTITION BY doc_id ORDER BY pos)) SELECT doc_id, md5(string_agg(target, '' ORDER BY pos)) AS digest, sum(tw)::BIGINT AS targets, count(*) FILTER (target IS NULL)::BIGINT AS open FROM shifted GROUP BY doc_id")
def shifted_targets(spark, sf_dir):
    rows = tokens.shifted(_masked(spark, sf_dir).withColumnRenamed("piece", "token"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "target"))), lambda x: x["target"]), "")
    return rows.groupBy("doc_id").agg(F.md5(joined).alias("digest"), F.sum("target_weight").alias("targets"), F.count_if(F.col("target").isNull()).alias("open"))


@query("""WITH w AS (SELECT doc_id, unnest(range(0, (length(text) - 1) // 256)) AS w, length(text) AS n FROM documents), t AS (SELECT sum(length(text)) AS n FROM documents)
SELECT round(sum(doc_id % 13 + w * 0.5 + 300) / ln(2.0) / ((SELECT n FROM t) * (count(*) * 256.0 / greatest((SELECT n FROM t) - 1, 1))), 9) AS bits_per_char FROM w""")
def bits_per_char(spark, sf_dir):
    """The nats of a window are an input of the operator; here they are made up."""
    arrays = _docs(spark, sf_dir).select(F.col("seq").alias("doc_id"), F.regexp_extract_all("text", F.lit("(?s)."), F.lit(0)).alias("tokens"))
    n = _sized(spark, sf_dir).agg(F.sum("n_chars")).first()[0]
    windows = tokens.token_windows(arrays).select((F.col("doc_id") % 13 + F.col("window") * 0.5 + 300).alias("nats"))
    return tokens.bits_per_char(windows, n, n).select(F.round("bits_per_char", 9).alias("bits_per_char"))


@query(f"WITH {_MASK} SELECT count(*)::BIGINT AS tokens, sum(weight)::BIGINT AS targets, sum(weight) / count(*) AS ratio FROM masked")
def mask_ratio(spark, sf_dir):
    return tokens.mask_ratio(_masked(spark, sf_dir))


@query("""WITH d AS (SELECT doc_id, string_split(text, '') AS c, length(text) AS n FROM documents)
SELECT doc_id, w::INT AS "window", md5(array_to_string(c[w * 256 + 1 : w * 256 + 257], '')) AS digest FROM (SELECT *, unnest(range(0, (n - 1) // 256)) AS w FROM d)""")
def token_windows(spark, sf_dir):
    arrays = _docs(spark, sf_dir).select(F.col("seq").alias("doc_id"), F.regexp_extract_all("text", F.lit("(?s)."), F.lit(0)).alias("tokens"))
    return tokens.token_windows(arrays).select("doc_id", "window", F.md5(F.array_join("tokens", "")).alias("digest"))


@query(f"SELECT step, i, {_mix(1234, 'step', 'i')} % (SELECT sum(length(text)) - 257 FROM documents)::BIGINT AS \"offset\" FROM range(0, 20) a(step), range(0, 32) b(i)")
def batch_sample(spark, sf_dir):
    """Places of spans in the stream of the documents' characters."""
    return tokens.batch_offsets(spark, _sized(spark, sf_dir).agg(F.sum("n_chars")).first()[0], 256, 32, 1234, 20)


# The stream of all documents, each with an end token: its ids are those of the documents' own characters.
_STREAM = """pieces AS (SELECT doc_id, generate_subscripts(p, 1) AS pos, unnest(p) AS piece FROM (SELECT doc_id, string_split(text, '') || ['<|end|>'] AS p FROM documents)),
vocab AS (SELECT c AS token, row_number() OVER (ORDER BY c) + 3 AS id FROM (SELECT DISTINCT piece AS c FROM pieces WHERE piece <> '<|end|>') UNION ALL VALUES ('<|end|>', 3)),
s AS MATERIALIZED (SELECT row_number() OVER (ORDER BY doc_id, pos) - 1 AS p, id FROM pieces JOIN vocab ON piece = token)"""
_WINDOWS = """w AS (SELECT p // 256 AS w, p, id FROM s UNION ALL SELECT p // 256 - 1, p, id FROM s WHERE p % 256 = 0 AND p > 0)"""


def _stream(spark: SparkSession, sf_dir: str) -> stream.TokenStream:
    docs = _docs(spark, sf_dir).select(F.col("seq").alias("doc_id"), T.with_end(F.col("text")).alias("text"))
    return stream.flatten(tokens.char_encode(docs, tokens.vocabulary(docs)).withColumnRenamed("doc_id", "seq"))


def _digest(column: str):
    return F.md5(F.array_join(F.col(column).cast("array<string>"), " "))


@query("SELECT doc_id, coalesce(sum(length(text) + 1) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start, (length(text) + 1)::BIGINT AS n_tokens FROM documents")
def stream_index(spark, sf_dir):
    return _stream(spark, sf_dir).index.select(F.col("seq").alias("doc_id"), "start", "n_tokens")


@query(f"WITH {_STREAM}, {_WINDOWS} SELECT w AS \"window\", md5(string_agg(id::VARCHAR, ' ' ORDER BY p)) AS digest FROM w GROUP BY w HAVING count(*) = 257")
def stream_windows(spark, sf_dir):
    """Windows for scoring, across the ends of documents."""
    return stream.windows(_stream(spark, sf_dir), 256).select("window", _digest("tokens").alias("digest"))


@query(f"""WITH {_STREAM}, o AS (SELECT step, i, {_mix(1234, 'step', 'i')} % ((SELECT count(*) FROM s) - 257) AS o FROM range(0, 20) a(step), range(0, 32) b(i)),
x AS (SELECT step, i, o, k, id FROM (SELECT *, unnest(range(0, 257)) AS k FROM o) JOIN s ON p = o + k)
SELECT step, i, o AS "offset", md5(string_agg(id::VARCHAR, ' ' ORDER BY k) FILTER (k < 256)) AS x, md5(string_agg(id::VARCHAR, ' ' ORDER BY k) FILTER (k > 0)) AS y FROM x GROUP BY ALL""")
def stream_batches(spark, sf_dir):
    """Training batches with their targets, out of the documents."""
    return stream.batches(_stream(spark, sf_dir), 256, 32, 1234, 20).select("step", "i", "offset", _digest("x").alias("x"), _digest("y").alias("y"))


@query(f"""WITH {_STREAM}, {_WINDOWS}, full_w AS (SELECT w FROM w GROUP BY w HAVING count(*) = 257), c AS (SELECT id, -ln(count(*) / (SELECT count(*) FROM s)) AS nats FROM s GROUP BY id)
SELECT round(sum(nats) / ln(2.0) / ((SELECT sum(length(text)) FROM documents) * ((SELECT count(*) FROM full_w) * 256.0 / greatest((SELECT count(*) FROM s) - 1, 1))), 6) AS bits_per_char
FROM w SEMI JOIN full_w USING (w) JOIN c USING (id) WHERE p > 256 * w""")
def stream_bits_per_char(spark, sf_dir):
    """Bits a character of a model of the stream's own id counts, over its windows."""
    s = _stream(spark, sf_dir)
    n = _sized(spark, sf_dir).agg(F.sum("n_chars")).first()[0]
    scored = tokens.bits_per_char(stream.unigram_nats(s, stream.windows(s, 256)), n, s.length)
    return scored.select(F.round("bits_per_char", 6).alias("bits_per_char"))


@query(f"""WITH {_MASK}, {_VOCAB}, s AS MATERIALIZED (SELECT row_number() OVER (ORDER BY doc_id, pos) - 1 AS p, id, weight FROM masked JOIN vocab ON piece = token),
o AS (SELECT step, i, {_mix(77, 'step', 'i')} % ((SELECT count(*) FROM s) - 129) AS o FROM range(0, 10) a(step), range(0, 16) b(i)),
x AS (SELECT step, i, o, k, id, weight FROM (SELECT *, unnest(range(0, 129)) AS k FROM o) JOIN s ON p = o + k)
SELECT step, i, o AS "offset", md5(string_agg(id::VARCHAR, ' ' ORDER BY k) FILTER (k < 128)) AS x, md5(string_agg(id::VARCHAR, ' ' ORDER BY k) FILTER (k > 0)) AS y, md5(string_agg(weight::VARCHAR, ' ' ORDER BY k) FILTER (k > 0)) AS w FROM x GROUP BY ALL""")
def sft_batches(spark, sf_dir):
    """Batches of conversations with their targets and loss weights."""
    arrays = tokens.masked_arrays(_masked(spark, sf_dir), tokens.vocabulary(_chat_docs(spark, sf_dir))).withColumnRenamed("doc_id", "seq")
    found = stream.weighted_batches(stream.weighted(arrays), 128, 16, 77, 10)
    return found.select("step", "i", "offset", *[_digest(c).alias(c) for c in ("x", "y", "w")])


@query(f"WITH {_STREAM} SELECT p // 4096 AS block, count(*)::BIGINT AS n, md5(string_agg(id::VARCHAR, ' ' ORDER BY p)) AS digest FROM s GROUP BY 1")
def token_file(spark, sf_dir):
    """The stream written to binary files of two bytes an id, and read back."""
    path = f"{scratch_path(spark, 'token-file')}/blocks"
    stream.write_stream(_stream(spark, sf_dir), path)
    return stream.read_stream(spark, path).blocks.select("block", F.size("tokens").cast("long").alias("n"), _digest("tokens").alias("digest"))


@query(f"SELECT doc_id, (generate_subscripts(parts, 1) - 1)::INT AS n, length(unnest(parts))::INT AS n_chars, md5(unnest(parts)) AS digest FROM {_sentences('documents', 60, 600)}")
def sentence_split(spark, sf_dir):
    parts = _docs(spark, sf_dir).select(F.col("seq").alias("doc_id"), F.posexplode(T.split_sentences(F.col("text"), 60, 600)).alias("n", "sentence"))
    return parts.select("doc_id", "n", F.length("sentence").alias("n_chars"), F.md5("sentence").alias("digest"))


@query(f"""WITH e AS (SELECT doc_id, text FROM documents QUALIFY (row_number() OVER (ORDER BY doc_id) - 1) % 5 = 0),
s AS (SELECT doc_id, parts, coalesce(list_sum(list_transform(parts, lambda x: length(x))), 0) AS c FROM {_sentences('e', 200, 6000)}),
k AS (SELECT doc_id, parts FROM s QUALIFY coalesce(sum(c) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 300000)
SELECT doc_id, n, md5(regexp_replace(replace(line, chr(10), ' '), '^{_SPACES}|{_SPACES}$', '', 'g')) AS digest FROM (SELECT doc_id, (generate_subscripts(parts, 1) - 1)::INT AS n, unnest(parts) AS line FROM k)""")
def subword_sample(spark, sf_dir):
    lines = corpus.subword_sample(_docs(spark, sf_dir).select("seq", "text"), 300_000, 5)
    return lines.select(F.col("seq").alias("doc_id"), "n", F.md5("line").alias("digest"))


@query("""WITH d AS (SELECT doc_id, text, CASE WHEN strlen(text) <= 600 THEN [text] ELSE list_transform(range(0, length(text), 200), lambda i: substr(text, i::INT + 1, 200)) END AS parts FROM documents)
SELECT doc_id, len(k)::BIGINT AS n, md5(array_to_string(k, '|')) AS digest FROM (SELECT doc_id, CASE WHEN strlen(text) <= 600 THEN parts ELSE list_filter(parts, lambda p: trim(regexp_replace(p, '\\s', ' ', 'g')) <> '') END AS k FROM d)""")
def hard_split(spark, sf_dir):
    parts = T.hard_split(F.col("text"), 600)
    return _docs(spark, sf_dir).select(F.col("seq").alias("doc_id"), F.size(parts).cast("long").alias("n"), F.md5(F.array_join(parts, "|")).alias("digest"))


@query()
def subword_encode(spark, sf_dir):
    import public_tokenizers

    rows = tokens.subword_encode(_docs(spark, sf_dir).select(F.col("seq").alias("doc_id"), "text"), public_tokenizers.path("piece_bpe_32k.model"))
    return rows.select("doc_id", F.size("tokens").alias("n_tokens"))


@query("SELECT doc_id, length(text)::BIGINT AS n_chars, md5(text) AS digest FROM documents")
def subword_decode(spark, sf_dir):
    """Subword ids decoded to the texts they are of."""
    import public_tokenizers

    model = public_tokenizers.path("piece_bpe_32k.model")
    ids = tokens.subword_encode(_docs(spark, sf_dir).select(F.col("seq").alias("doc_id"), "text"), model)
    return tokens.subword_decode(ids, model).select("doc_id", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("digest"))


# --- run logs and evaluation -----------------------------------------------------------------


@query("SELECT user_id, event_id AS line, event_id % 400 AS step FROM events QUALIFY coalesce(step < min(step) OVER (PARTITION BY user_id ORDER BY line ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), true)")
def keep_last_run(spark, sf_dir):
    logs = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", F.col("event_id").alias("line"), (F.col("event_id") % 400).alias("step"))
    return runs.keep_last_run(logs, "user_id")


@query("SELECT event_id AS line, event_id % 7000 AS step FROM events QUALIFY coalesce(step < min(step) OVER (ORDER BY line ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), true)")
def keep_last_run_one_log(spark, sf_dir):
    """All events as one log."""
    return runs.keep_last_run(spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("line"), (F.col("event_id") % 7_000).alias("step")))


@query(f"WITH {_POINTS} SELECT line, step, value FROM points QUALIFY row_number() OVER (PARTITION BY step ORDER BY line DESC) = 1")
def last_by_step(spark, sf_dir):
    return runs.last_by_step(_points(spark, sf_dir))


def _growing(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream of its files; the pattern takes a table of one file too."""
    return spark.readStream.schema(spark.read.parquet(f"{sf_dir}/{name}.parquet").schema).parquet(f"{sf_dir}/{name}.parque[t]")


def _drained(rows: DataFrame, mode: str, name: str) -> str:
    path = scratch_path(rows.sparkSession, name)
    state.drain(rows, mode, f"{path}/checkpoint", state.keep_batches(f"{path}/rows")).awaitTermination()
    return f"{path}/rows"


@query("SELECT doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY left(text, 200) ORDER BY doc_id) = 1")
def stream_prefix_dedup(spark, sf_dir):
    """The first document of each prefix, by state kept for each prefix in a stream."""
    docs = _growing(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq"), "text")
    kept = state.first_wins(docs.select("seq", F.sha2(T.prefix_key(F.col("text")), 256).alias("prefix")), F.col("prefix"))
    return spark.read.parquet(_drained(kept, "append", "first-wins")).select(F.col("seq").alias("doc_id"))


@query("""WITH e AS (SELECT user_id, event_id AS line, event_id % 400 AS step, value FROM events),
k AS (SELECT * FROM e QUALIFY coalesce(step < min(step) OVER (PARTITION BY user_id ORDER BY line ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), true))
SELECT user_id::VARCHAR AS run, count(*)::BIGINT AS points, arg_min(step, (value, step)) AS best_step, min(value) AS best_value, min(step) AS first_step, max(step) AS last_step, (SELECT count(*) FROM e WHERE e.user_id = k.user_id)::BIGINT AS lines FROM k GROUP BY user_id""")
def stream_last_runs(spark, sf_dir):
    """What each log's last run keeps, by a stack kept for each log in a stream."""
    points = _growing(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("run"), F.col("event_id").alias("line"), (F.col("event_id") % 400).alias("step"), "value")
    return state.latest(spark, _drained(state.last_runs(points), "update", "last-runs"), "run")


def _gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as a run: the clicks are the validation curve."""
    points = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", F.col("event_id").alias("step"), "value", "event_type")
    return runs.gaps(points.where("event_type <> 'click'"), points.where("event_type = 'click'"), "user_id")


_GAP = """e AS (SELECT user_id, event_id AS step, value, event_type FROM events), tr AS (SELECT * FROM e WHERE event_type <> 'click'), va AS (SELECT * FROM e WHERE event_type = 'click'),
lo AS (SELECT va.user_id, va.step, va.value AS v, tr.step AS ls, tr.value AS lv FROM va ASOF LEFT JOIN tr ON va.user_id = tr.user_id AND va.step >= tr.step),
b AS (SELECT lo.*, tr.step AS hs, tr.value AS hv FROM lo ASOF LEFT JOIN tr ON lo.user_id = tr.user_id AND lo.step <= tr.step),
gap AS (SELECT user_id, step, v AS val, CASE WHEN ls IS NULL THEN hv WHEN hs IS NULL OR hs = ls THEN lv ELSE lv + (hv - lv) * ((step - ls) / (hs - ls)) END AS train FROM b)"""


@query(f"WITH {_GAP} SELECT user_id, step, round(val, 6) AS val, round(train, 6) AS train, round(val - train, 6) AS gap FROM gap")
def asof_gap(spark, sf_dir):
    return _gap(spark, sf_dir).select("user_id", "step", *[F.round(c, 6).alias(c) for c in ("val", "train", "gap")])


@query(f"WITH {_GAP.replace('SELECT user_id, event_id', 'SELECT 0 AS user_id, event_id')} SELECT step, round(val, 6) AS val, round(train, 6) AS train, round(val - train, 6) AS gap FROM gap")
def asof_gap_one_run(spark, sf_dir):
    """All events as one run."""
    points = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("step"), "value", "event_type")
    gap = runs.gaps(points.where("event_type <> 'click'"), points.where("event_type = 'click'"))
    return gap.select("step", *[F.round(c, 6).alias(c) for c in ("val", "train", "gap")])


@query(f"WITH {_GAP} SELECT user_id, coalesce(min(step) FILTER (val > train), 0)::BIGINT AS divergence_step FROM gap GROUP BY user_id")
def divergence_step(spark, sf_dir):
    return runs.divergence_step(_gap(spark, sf_dir), "user_id")


@query(f"WITH {_POINTS} SELECT line // 400 AS run, arg_min(step, (value, step)) AS best_step, min(value) AS best_value FROM points GROUP BY 1")
def best_point(spark, sf_dir):
    return runs.best_point(_points(spark, sf_dir).withColumn("run", F.floor(F.col("line") / 400)), "run")


_RUN_GAP = _GAP.replace("SELECT user_id, event_id AS step, value, event_type FROM events", "SELECT event_id // 400 AS user_id, event_id % 400 AS step, value, event_type FROM events")


@query(f"""WITH {_RUN_GAP}, d AS (SELECT user_id AS run, coalesce(min(step) FILTER (val > train), 0)::BIGINT AS divergence_step FROM gap GROUP BY 1),
f AS (SELECT user_id AS run, arg_max(value, step) AS final_train FROM tr GROUP BY 1), best AS (SELECT user_id AS run, arg_min(step, (value, step)) AS best_step, min(value) AS best_value FROM va GROUP BY 1)
SELECT run, final_train, best_step, best_value, divergence_step FROM f JOIN best USING (run) JOIN d USING (run)""")
def run_comparison(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.floor(F.col("event_id") / 400).alias("run"), (F.col("event_id") % 400).alias("step"), "value", "event_type")
    return runs.run_table(p.where("event_type <> 'click'"), p.where("event_type = 'click'"))


@query(f"""WITH {_GAP}, d AS (SELECT user_id AS place, coalesce(min(step) FILTER (val > train), 0) AS d FROM gap GROUP BY 1),
l AS (SELECT 'all' AS list, place, d FROM d UNION ALL SELECT 'first', place, d FROM d WHERE place = (SELECT min(place) FROM d) OR d = 0 UNION ALL SELECT 'rising', place, place + 1 FROM d),
w AS (SELECT *, lag(d) OVER (PARTITION BY list ORDER BY place) AS p, first_value(d) OVER (PARTITION BY list ORDER BY place) AS f FROM l)
SELECT list, CASE WHEN coalesce(bool_and(d = 0) FILTER (p IS NOT NULL), true) THEN 'none' WHEN max(f) > 0 AND bool_and(d = 0 OR d > p) FILTER (p IS NOT NULL) THEN 'later' ELSE 'unordered' END AS verdict FROM w GROUP BY list""")
def scaling_verdict(spark, sf_dir):
    d = runs.divergence_step(_gap(spark, sf_dir), "user_id").withColumnRenamed("user_id", "place")
    least = d.agg(F.min("place")).first()[0]
    lists = {"all": d, "first": d.where((F.col("place") == least) | (F.col("divergence_step") == 0)), "rising": d.withColumn("divergence_step", F.col("place") + 1)}
    out = None
    for name, rows in lists.items():
        one = runs.scaling_verdict(rows).select(F.lit(name).alias("list"), "verdict")
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT event_id::VARCHAR AS key, round(abs(value - value * (1 + (event_id % 7) / 100.0)), 9) AS diff FROM events ORDER BY abs(value - value * (1 + (event_id % 7) / 100.0)) DESC, key DESC LIMIT 1")
def largest_difference(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").cast("string").alias("key"), "value", "event_id")
    other = e.select("key", (F.col("value") * (1 + (F.col("event_id") % 7) / 100.0)).alias("value"))
    return runs.max_abs_diff(e.select("key", "value"), other).select("key", F.round("diff", 9).alias("diff"))


@query("SELECT event_id::VARCHAR AS label, value AS d_over_n FROM events ORDER BY abs(value - 20), label LIMIT 1")
def closest_ratio(spark, sf_dir):
    return runs.closest(spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").cast("string").alias("label"), F.col("value").alias("d_over_n")))


@query("SELECT event_id, user_id FROM events WHERE event_type = 'click' ORDER BY event_id LIMIT 1")
def first_lookup(spark, sf_dir):
    return runs.lookup(spark.read.parquet(f"{sf_dir}/events.parquet"), {"event_type": "click"}, "event_id").select("event_id", "user_id")


@query("SELECT * FROM (SELECT DISTINCT user_id AS model FROM events), (SELECT DISTINCT event_type AS prompt FROM events)")
def model_prompts(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return runs.model_prompts(e.select(F.col("user_id").alias("model")).distinct(), e.select(F.col("event_type").alias("prompt")).distinct())


@query("WITH a AS (SELECT DISTINCT user_id AS key FROM events WHERE event_type = 'click'), b AS (SELECT DISTINCT user_id AS key FROM events WHERE event_type = 'view') SELECT coalesce(a.key, b.key) AS key, CASE WHEN b.key IS NULL THEN 'left' WHEN a.key IS NULL THEN 'right' ELSE 'both' END AS side FROM a FULL JOIN b USING (key)")
def key_sets(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("key"), "event_type")
    return runs.key_sets(e.where("event_type = 'click'"), e.where("event_type = 'view'"))


@query("SELECT event_id, epoch_us(ts + to_microseconds((round(value * 3600, 6) * 1000000)::BIGINT)) AS done_us FROM events")
def run_eta(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select("event_id", F.unix_micros(T.done_at(F.col("ts"), F.col("value")).cast("timestamp")).alias("done_us"))


@query("SELECT doc_id, md5(CASE WHEN length(text) > 60 THEN rtrim(left(text, 60), ' ') || '…' ELSE text END) AS clipped, len(w)::INT AS n_lines, md5(array_to_string(w, '|')) AS wrapped FROM (SELECT doc_id, text, regexp_extract_all(text, '(?s).{1,40}[。、」）ｗw！？]*') AS w FROM documents)")
def display_text(spark, sf_dir):
    w = T.wrap(F.col("text"), 40)
    return _docs(spark, sf_dir).select(F.col("seq").alias("doc_id"), F.md5(T.clip(F.col("text"), 60)).alias("clipped"), F.size(w).alias("n_lines"), F.md5(F.array_join(w, "|")).alias("wrapped"))


@query(f"WITH {_POINTS} SELECT (step - 1) // 50 AS \"interval\", round(avg(value), 6) AS loss, round(sum(value) / count(*), 6) AS tok_per_sec FROM points WHERE step > 0 GROUP BY 1")
def interval_means(spark, sf_dir):
    log = _points(spark, sf_dir).where("step > 0").select("step", F.col("value").alias("loss"), F.col("value").alias("tokens"), F.lit(1).alias("seconds"))
    return runs.interval_means(log, 50).select("interval", F.round("loss", 6).alias("loss"), F.round("tok_per_sec", 6).alias("tok_per_sec"))


@query("SELECT 'user ' || (user_id % 5) AS model, round(avg(value) FILTER (event_type = 'click'), 6) AS click, round(avg(value) FILTER (event_type = 'view'), 6) AS \"view\" FROM events GROUP BY 1")
def pivot_scores(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    scores = events.groupBy(F.concat(F.lit("user "), (F.col("user_id") % 5).cast("string")).alias("model"), F.col("event_type").alias("domain")).agg(F.round(F.avg("value"), 6).alias("bits_per_char"))
    return runs.pivot_scores(scores, ["click", "view"])


@query("WITH s AS (SELECT user_id, event_id AS step FROM events WHERE event_type <> 'click'), m AS (SELECT user_id, event_id AS mark FROM events WHERE event_type = 'click') SELECT user_id, step FROM s WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.user_id = s.user_id AND mark > step - 200 AND mark < step)")
def usable_steps(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    steps = e.where("event_type <> 'click'").select("user_id", F.col("event_id").alias("step"))
    return runs.usable_steps(steps, e.where("event_type = 'click'").select("user_id", F.col("event_id").alias("mark")), 200, "user_id")


@query("WITH x AS (SELECT event_id AS step, value FROM events WHERE event_type <> 'click'), y AS (SELECT event_id + 4 AS step, value FROM events) SELECT step, round(abs(x.value - y.value), 6) AS diff FROM x JOIN y USING (step)")
def curve_difference(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    a, b = e.where("event_type <> 'click'").select(F.col("event_id").alias("step"), "value"), e.select((F.col("event_id") + 4).alias("step"), "value")
    return runs.curve_difference(a, b).select("step", F.round("diff", 6).alias("diff"))


@query(f"""WITH r AS (SELECT conv_id, turn, coalesce(text, '') AS text FROM conversations WHERE role = 'assistant'), k AS (SELECT conv_id * 1000000 + turn AS id, text FROM r), rep AS ({_repeated('k', 'id', 'text', 3, 3, 9, 0, '1')})
SELECT avg((id IN (SELECT id FROM rep))::INT) AS repetition_rate, avg((length(trim(text)) < 4)::INT) AS broken_rate, avg((contains(text, 'the') OR contains(text, 'die'))::INT) AS topic_rate, avg(length(text)) AS avg_reply_len FROM k""")
def reply_metrics(spark, sf_dir):
    replies = _turns(spark, sf_dir).where("role = 'assistant'").select(F.coalesce("text", F.lit("")).alias("text"), F.lit(False).alias("truncated"), F.array(F.lit("the"), F.lit("die")).alias("keywords"))
    return runs.reply_rates(runs.reply_flags(replies))


@query("""WITH m(metric, lower_is_better) AS (VALUES ('bits_per_char', true), ('repetition_rate', true), ('topic_rate', false), ('broken_rate', true)),
v AS (SELECT m.*, (SELECT round(avg(value), 4) FROM events WHERE event_id % 4 = i) AS now, (SELECT round(avg(value), 4) FROM events WHERE (event_id + 1) % 4 = i) AS before FROM (SELECT *, row_number() OVER () - 1 AS i FROM m) m)
SELECT metric, now, before, round(now - before, 6) AS delta, CASE WHEN abs(now - before) < 1e-9 THEN 'unchanged' WHEN (now < before) = lower_is_better THEN 'improved' ELSE 'worsened' END AS verdict, round(CASE WHEN lower_is_better THEN now - before ELSE before - now END, 6) AS cost FROM v""")
def metric_comparison(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    names = F.array(*map(F.lit, runs.METRICS))
    side = lambda k: events.groupBy(F.get(names, ((F.col("event_id") + k) % 4).cast("int")).alias("metric")).agg(F.round(F.avg("value"), 4).alias("value"))
    return runs.comparison(side(0), side(1)).select("metric", "now", "before", F.round("delta", 6).alias("delta"), "verdict", F.round("cost", 6).alias("cost"))


@query("SELECT event_id AS step, round(CASE WHEN event_id < 100 THEN 0.00002 + event_id * 0.00098 / 100 ELSE 0.0001 + 0.00045 * (1 + cos(pi() * least((event_id - 100) / 900.0, 1.0))) END, 9) AS rate FROM events")
def learning_rate(spark, sf_dir):
    steps = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("step"))
    return steps.withColumn("rate", F.round(T.learning_rate(F.col("step"), 0.001, 1000, 100, 0.1), 9))


@query("SELECT event_type, min(event_id)::BIGINT AS first_seq FROM events GROUP BY 1")
def distinct_in_order(spark, sf_dir):
    return runs.distinct_in_order(spark.read.parquet(f"{sf_dir}/events.parquet").withColumnRenamed("event_id", "seq"), "event_type")


@query("SELECT user_id, (value * 3240)::DOUBLE AS tokens, floor(value * 3240)::BIGINT AS tokens_in_budget, floor(floor(value * 3240) / 512)::BIGINT AS steps_in_budget, floor(value * 3240) / 1000.0 AS d_over_n FROM events")
def time_budget(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select("user_id", (F.col("value") * 3240).alias("tokens"), *[c.alias(n) for n, c in runs.budget(F.col("value"), 3240, F.lit(512), F.lit(1000.0)).items()])
