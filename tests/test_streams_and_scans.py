"""Scans with a carry, the flat token stream, gram hashes, pattern scans, budgets and samples."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import grams
from corpusloom.functions import text as T
from corpusloom.functions.ordered import Carry, scan, sums_before
from corpusloom.operators import chat, corpus, leak, runs, stream, tokens

# --- scans ---------------------------------------------------------------------------

CARRIES = {"s": Carry("sum", "v"), "m": Carry("min", "v", back=True), "x": Carry("max", "v", own=True), "l": Carry("near", "v"), "f": Carry("near", "v", back=True, own=True)}


def scanned_slowly(rows):
    out = []
    for key in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == key), key=lambda r: r[1])
        for n, r in enumerate(mine):
            seen = lambda part: [x[2] for x in part if x[2] is not None]
            before, after, upto, on = seen(mine[:n]), seen(mine[n + 1 :]), seen(mine[: n + 1]), seen(mine[n:])
            out.append((*r, sum(before), min(after, default=None), max(upto, default=None), before[-1] if before else None, on[0] if on else None))
    return Counter(out)


@pytest.mark.parametrize("ranges", [1, 2, 211])
def test_scan_is_the_same_for_any_ranges(spark, ranges):
    rng = random.Random(3)
    rows = [(rng.choice([None, "a", "a", "a", "b"]), i, rng.choice([None, 1, 2, 5, -3])) for i in range(300)] + [("c", 1, 4), ("d", 1, None)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, o int, v int")
    assert Counter(map(tuple, scan(df, ["o"], CARRIES, ("k",), ranges).collect())) == scanned_slowly(rows)
    one = [("", *r[1:]) for r in rows if r[0] == "a"]
    got = scan(spark.createDataFrame(one, "k string, o int, v int"), ["o"], CARRIES, partitions=ranges)
    assert Counter(map(tuple, got.collect())) == scanned_slowly(one)


def test_scan_of_nothing(spark):
    assert sums_before(spark.createDataFrame([], "o int, v int"), ["o"], "v", "s").count() == 0


@pytest.mark.parametrize("ranges", [1, 2, 97])
def test_runs_by_ranges(spark, monkeypatch, ranges):
    """One long run, whatever the ranges."""
    import corpusloom.functions.ordered as ordered

    monkeypatch.setattr(ordered, "n_ranges", lambda rows, spark: ranges)
    rng = random.Random(ranges)
    steps = [(line, rng.randrange(60)) for line in range(200)]
    kept = runs.keep_last_run(spark.createDataFrame(steps, "line int, step int")).collect()
    expect = [(n, s) for n, s in steps if all(s < later for m, later in steps if m > n)]
    assert sorted((r.line, r.step) for r in kept) == expect
    train = [(s, float(rng.randrange(9))) for s in sorted(rng.sample(range(100), 30))] + [(55, None)]
    val = [(s, 1.0) for s in (-3, 0, 7, 50, 55, 98, 140)] + [(train[4][0], 2.0)]
    got = runs.gaps(spark.createDataFrame(train, "step int, value double"), spark.createDataFrame(val, "step int, value double")).collect()
    curve = [(s, v) for s, v in train if v is not None]
    expect = [(s, float(np.interp(s, *zip(*sorted(curve))))) for s, _ in val]
    assert sorted((r.step, round(r.train, 9)) for r in got) == sorted((s, round(v, 9)) for s, v in expect)
    none = runs.gaps(spark.createDataFrame([], "step int, value double"), spark.createDataFrame(val, "step int, value double"))
    assert {r.gap for r in none.collect()} == {None}


def test_loss_mask_of_long_lines(spark):
    rng = random.Random(1)
    rows = [(d, n, rng.choice(["a", "b", T.USER, T.ASSISTANT, T.END])) for d in range(3) for n in range(150)]
    df = spark.createDataFrame(rows, "doc_id int, pos int, piece string")
    masks = [sorted(map(tuple, tokens.loss_mask(df, long_lines).collect())) for long_lines in (False, True)]
    expect, inside = [], None
    for d, n, piece in rows:
        inside = None if n == 0 else inside
        expect.append((d, n, piece, int(inside == T.ASSISTANT and piece not in (T.USER, T.ASSISTANT))))
        inside = piece if piece in (T.USER, T.ASSISTANT, T.END) else inside
    assert masks[0] == masks[1] == expect


# --- the token stream ----------------------------------------------------------------


def made(spark, sizes, block):
    flat, rows = [], []
    for seq, n in enumerate(sizes):
        ids = [(seq * 31 + k * 7) % 65536 for k in range(n)]
        rows.append((seq, ids if n or seq % 2 else None))
        flat += ids
    return flat, stream.flatten(spark.createDataFrame(rows, "seq int, tokens array<int>").repartition(3), block)


SIZES = [5, 0, 0, 130, 1, 16, 15, 17, 0, 64, 3]


@pytest.mark.parametrize("block", [16, 64, 4096])
def test_stream_windows_and_spans(spark, block, tmp_path):
    flat, s = made(spark, SIZES, block)
    assert s.length == len(flat)
    assert [(r.seq, r.start, r.n_tokens) for r in s.index.orderBy("seq").collect()] == [(n, sum(SIZES[:n]), x) for n, x in enumerate(SIZES)]
    assert sum([r.tokens for r in s.blocks.orderBy("block").collect()], []) == flat
    got = {r.window: r.tokens for r in stream.windows(s, 16).collect()}
    assert got == {w: flat[16 * w : 16 * w + 17] for w in range((len(flat) - 1) // 16)}
    spans = [(k, at, n) for k, (at, n) in enumerate([(0, 1), (15, 2), (3, 200), (len(flat) - 1, 9), (len(flat), 5), (40, 0), (16, 16)])]
    found = stream.fetch(s, spark.createDataFrame(spans, "k int, offset long, n int"), "k")
    assert {r.k: r.tokens for r in found.collect()} == {k: flat[at : at + n] for k, at, n in spans if flat[at : at + n]}
    stream.write_stream(s, f"{tmp_path}/x", 3)
    back = stream.read_stream(spark, f"{tmp_path}/x")
    assert (back.size, back.length) == (block, len(flat))
    assert sum([r.tokens for r in back.blocks.orderBy("block").collect()], []) == flat


def test_batches_are_spans_and_targets(spark):
    flat, s = made(spark, SIZES, 32)
    got = stream.batches(s, 10, 4, 5, 6).collect()
    assert len(got) == 24
    for r in got:
        assert r.x == flat[r.offset : r.offset + 10] and r.y == flat[r.offset + 1 : r.offset + 11]
    again = stream.batches(made(spark, SIZES, 4096)[1], 10, 4, 5, 6).collect()
    assert {(r.step, r.i, r.offset) for r in got} == {(r.step, r.i, r.offset) for r in again}
    with pytest.raises(ValueError, match="shorter"):
        stream.batches(s, len(flat), 4, 5, 6)


def test_weighted_batches(spark):
    rng = random.Random(4)
    rows = [(n, [rng.randrange(65536) for _ in range(k)], [rng.randrange(2) for _ in range(k)]) for n, k in enumerate(SIZES)]
    s = stream.weighted(spark.createDataFrame(rows, "seq int, tokens array<int>, weights array<int>"), 32)
    ids, weights = sum([r[1] for r in rows], []), sum([r[2] for r in rows], [])
    for r in stream.weighted_batches(s, 10, 4, 5, 6).collect():
        o = r.offset
        assert (r.x, r.y, r.w) == (ids[o : o + 10], ids[o + 1 : o + 11], weights[o + 1 : o + 11])
    with pytest.raises(Exception, match="differ in length"):
        stream.weighted(spark.createDataFrame([(1, [1, 2], [1])], "seq int, tokens array<int>, weights array<int>"))


def test_ids_that_do_not_fit(spark):
    for wrong in (65536, -1):
        with pytest.raises(Exception, match="token id"):
            stream.flatten(spark.createDataFrame([(1, [1, wrong])], "seq int, tokens array<int>"))
    s = stream.flatten(spark.createDataFrame([], "seq int, tokens array<int>"))
    assert s.length == 0 and stream.windows(s).count() == 0


def test_a_missing_file_is_an_error(spark, tmp_path):
    _, s = made(spark, SIZES, 16)
    stream.write_stream(stream.TokenStream(None, s.blocks.where("block <> 2"), 16, 0), f"{tmp_path}/x", 2)
    with pytest.raises(ValueError, match="blocks of the stream"):
        stream.read_stream(spark, f"{tmp_path}/x")


# --- grams ---------------------------------------------------------------------------


def repeats_slowly(t, gram, times, least, sampled):
    if not t or len(t) < least:
        return False
    step = max(1, len(t) // 2000) if sampled else 1
    found = Counter(t[i : i + gram] for i in range(0, len(t) - gram + (0 if sampled else 1), step))
    return max(found.values(), default=0) >= times


@pytest.mark.parametrize("rule", [(20, 4, 80, True), (6, 4, 12, False), (3, 3, 9, False)])
@pytest.mark.parametrize("portion", [1 << 20, 50])
def test_repetition_by_brute_force(monkeypatch, rule, portion):
    monkeypatch.setattr(grams, "PORTION", portion)
    rng = random.Random(rule[0])
    texts = [None, ""] + ["".join(rng.choice("ab") for _ in range(rng.randrange(60))) for _ in range(200)]
    texts += ["".join(rng.choice("abc漢😀") for _ in range(rng.randrange(9000))) for _ in range(20)] + ["abcdefghijklmnopqrst" * 4, "abcdefghijklmnopqrst" * 4 + "x", "0123456789" * 600]
    expect = [repeats_slowly(t, *rule) for t in texts]
    assert grams.repeating(texts, *rule).tolist() == expect and any(expect) and not all(expect)


def test_equal_hashes_are_verified(monkeypatch):
    """With a hash that is always equal, only true repetitions count."""
    monkeypatch.setattr(grams, "window_hashes", lambda codes, size: np.zeros(max(0, len(codes) - size + 1), np.uint64))
    assert grams.repeating(["abcabcabc", "abcdefghi"], 3, 3, 9, False).tolist() == [True, False]


@pytest.mark.parametrize("size", [1, 2, 3, 6, 7, 20, 40])
def test_window_hashes(size):
    codes = np.random.default_rng(size).integers(0, 3, 90).astype(np.uint32)
    power = [pow(grams._BASE, size - 1 - k, 1 << 64) for k in range(size)]
    expect = [sum((int(c) + 1) * p for c, p in zip(codes[i : i + size], power)) % (1 << 64) for i in range(91 - size)]
    assert grams.window_hashes(codes, size).tolist() == expect


# --- pattern scans -------------------------------------------------------------------


def leaky(seed):
    rng = random.Random(seed)
    word = lambda n: "".join(rng.choice("ab漢😀 ") for _ in range(n))
    probes = [word(rng.randrange(48, 120)) for _ in range(12)] + ["ab" * 40, "a" * 60, "short"]
    texts = [word(rng.randrange(200)) + rng.choice(probes) * rng.randrange(3) + word(rng.randrange(200)) for _ in range(60)] + ["a" * 200, None, ""]
    return probes, texts


def test_scanned_and_joined_patterns_agree(spark):
    probes, texts = leaky(4)
    docs, wanted = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame([(p,) for p in probes + probes[:2]], "probe string")
    expect = {(p, n, at) for p in probes if len(p) >= 48 for n, t in enumerate(texts) if t for at in range(len(t)) if t.startswith(p, at)}
    for most in (leak.MOST_SEEDS, 3):
        got = [tuple(r) for r in leak.occurrences(docs, wanted, most_seeds=most).select("probe", "doc_id", "start").collect()]
        assert len(got) == len(set(got)) and set(got) == expect
    plan = leak.occurrences(docs, wanted)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_scanned_and_joined_fragments_agree(spark):
    probes, texts = leaky(8)
    held = probes[:9] + ["x" * 39]
    expect = {n for n, t in enumerate(texts) if t and any(t[i : i + 40] in h for h in held for i in range(len(t) - 39))}
    docs, holdout = spark.createDataFrame(list(enumerate(texts)), "seq long, text string"), spark.createDataFrame([(h,) for h in held], "text string")
    for most in (leak.MOST_SEEDS, 3):
        assert {r.seq for r in chat.seeds_shared(docs, holdout, 40, most).collect()} == expect
        pairs = spark.createDataFrame([(n, "q", t or "") for n, t in enumerate(texts)] + [(100 + n, t or "", "a") for n, t in enumerate(texts)], "seq long, q string, a string")
        left = {r.seq for r in chat.without_fragments(pairs, spark.createDataFrame([(h, "") for h in held], "q string, a string"), 40, most).collect()}
        assert left == {n for n in range(len(texts)) if n not in expect} | {100 + n for n in range(len(texts)) if n not in expect}


# --- budgets and samples -------------------------------------------------------------


@pytest.mark.parametrize("target", [0, 1, 50, 700, 701, 2499, 2500, 10**6])
@pytest.mark.parametrize("spread", [1, 1000])
def test_budgets(spark, target, spread):
    sizes = [(n * 7) % 11 for n in range(400)] + [0, 500, 0]
    rows = spark.createDataFrame([(n * spread - 30, x) for n, x in enumerate(sizes)], "seq long, n_chars long")
    head, last = [], []
    for n, x in enumerate(sizes):
        if sum(sizes[:n]) < target:
            head.append(n * spread - 30)
        if sum(sizes[n + 1 :]) < target:
            last.append(n * spread - 30)
    assert [r.seq for r in corpus.within_budget(rows, target).orderBy("seq").collect()] == head
    assert [r.seq for r in corpus.tail(rows, target).orderBy("seq").collect()] == last


def test_a_budget_reads_ranges(spark, tmp_path):
    """A filter on seq that reaches the scan is all that a small budget leaves of a large table."""
    spark.range(100_000).selectExpr("id AS seq", "10L AS n_chars").write.parquet(f"{tmp_path}/t")
    kept = corpus.within_budget(spark.read.parquet(f"{tmp_path}/t"), 1_000)
    assert kept.count() == 100
    assert "LessThanOrEqual(seq,99)" in kept._jdf.queryExecution().executedPlan().toString()
    assert corpus.within_budget(spark.createDataFrame([], "seq long, n_chars long"), 5).count() == 0
    with pytest.raises(TypeError):
        corpus.within_budget(spark.createDataFrame([("a", 1)], "seq string, n_chars long"), 5)


@pytest.mark.parametrize("every, most", [(3, 1), (3, 40), (7, 300), (2, 10**6), (5, 0), (1, 60), (1, 0)])
def test_line_streams(spark, every, most):
    """Sizes that make the first guess too short: the long lines are not among the chosen."""
    sizes = [1 if n % every == 0 else 40 for n in range(150)] + [9] * 150
    lines = spark.createDataFrame([(5 * n, "x" * k) for n, k in enumerate(sizes)], "seq long, text string")
    chosen = [n for n in range(len(sizes)) if n % every == 0]
    expect = [n for i, n in enumerate(chosen) if not most or sum(sizes[m] for m in chosen[:i]) < most]
    got = corpus.line_stream(lines, every, most)
    assert got.columns == ["seq", "text"] and [r.seq // 5 for r in got.orderBy("seq").collect()] == expect


@pytest.mark.parametrize("few, bits", [(10_000, 16), (3, 16), (3, 2)])
def test_selection_is_the_shuffle(spark, monkeypatch, few, bits):
    monkeypatch.setattr(corpus, "FEW", few)
    monkeypatch.setattr(corpus, "STEP_BITS", bits)
    rows = spark.range(300).withColumnRenamed("id", "seq")
    order = [r.seq for r in corpus.shuffled(rows, 5).orderBy("position").collect()]
    for n in (0, 1, 17, 299, 300, 400):
        assert {r.seq for r in rows.where(corpus.among_first(rows, n, 5)).collect()} == set(order[:n])


def test_equal_mixed_keys(spark, monkeypatch):
    monkeypatch.setattr(corpus, "FEW", 3)
    monkeypatch.setattr(T, "mixed", lambda seed, *keys: F.lit(5).cast("long"))
    rows = spark.range(20).withColumnRenamed("id", "seq")
    assert {r.seq for r in rows.where(corpus.among_first(rows, 7, 5)).collect()} == set(range(7))


def admitted_slowly(sizes, every, most, chunk):
    written, val = 0, set()
    for at in range(0, len(sizes), chunk):
        fit = [n for n in range(at, min(at + chunk, len(sizes))) if n % every == 0 and written + sizes[n] < most]
        val |= set(fit)
        written += sum(sizes[n] for n in fit)
    return val


@pytest.mark.parametrize("few", [100_000, 2])
@pytest.mark.parametrize("every, most, chunk", [(3, 200, 1), (3, 200, 7), (2, 900, 10), (1, 30, 4), (5, 10**6, 50), (2, 0, 3)])
def test_admission(spark, monkeypatch, few, every, most, chunk):
    monkeypatch.setattr(tokens, "FEW_LEFT", few)
    rng = random.Random(most)
    sizes = [rng.choice([0, 1, 3, 8, 20, 60, 150]) for _ in range(160)]
    docs = spark.createDataFrame([(10 * n, x) for n, x in enumerate(sizes)], "seq long, n_tokens long")
    got = tokens.admit(docs, every, most, chunk).collect()
    assert {r.seq // 10 for r in got if r.part == "val"} == admitted_slowly(sizes, every, most, chunk)
    assert len(got) == len(sizes)


def test_build_reads_up_to_its_targets(spark, monkeypatch):
    """Two sources with duplicates within and across them, in ranges of a few rows."""
    monkeypatch.setattr(corpus, "FIRST_PART", 40)
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(300))
    shared = [word() for _ in range(5)]
    made = [[rng.choice(shared) if rng.random() < 0.3 else word() if rng.random() < 0.8 else "short" for _ in range(80)] for _ in range(2)]
    seen, kept, lost = [], [], Counter()
    for k, texts in enumerate(made):
        own, total = set(), 0
        for n, t in enumerate(texts):
            if total >= 6_000:
                break
            reason = "short" if len(t) < 200 else "duplicate" if t[:200] in own or t[:200] in seen else None
            if reason:
                lost[f"s{k}", reason] += 1
            else:
                own.add(t[:200])
                kept.append((f"s{k}", n))
                total += len(t)
        seen += own
    docs = [(f"s{k}", spark.createDataFrame(list(enumerate(texts)), "seq long, text string"), 6_000) for k, texts in enumerate(made)]
    got, rejected = corpus.build(docs, script=T.LATIN)
    assert sorted((r.source, r.seq) for r in got.collect()) == kept
    assert {(r.source, r.reason): r.n for r in rejected.collect()} == lost


# --- byte ranges ---------------------------------------------------------------------


@pytest.mark.parametrize("size", [7, 64, 1 << 20])
def test_byte_ranges_count_each_hit_once(spark, tmp_path, size):
    """One endless line, hits across the ends of ranges, a needle that is absent."""
    from corpusloom.sources import ranges

    needles = ["needle-needle-needle-é漢", "x" * 21, "never there, never ever"]
    rng = random.Random(size)
    text = "".join(rng.choice(["ab", "é", "漢", needles[0], needles[1], "x"]) for _ in range(60 if size < 64 else 3000))
    (tmp_path / "in").mkdir()
    for name, t in (("a", text), ("b", "\n" + text[::-1]), ("c", ""), ("_SUCCESS", needles[0])):
        (tmp_path / "in" / name).write_bytes(t.encode())
    data = {name: t.encode() for name, t in (("a", text), ("b", "\n" + text[::-1]))}
    expect = Counter((n, i, p) for n, d in data.items() for p in needles for i in range(len(d)) if d.startswith(p.encode(), i))
    got = ranges.scan_files(spark, str(tmp_path / "in"), needles, size)
    assert Counter((r.path.rpartition("/")[2], r.start, r.pattern) for r in got.collect()) == expect
    parts = ranges.read_ranges(spark, f"file:{tmp_path}/in/a", 3, size)
    assert parts.rdd.getNumPartitions() == -(-len(data["a"]) // size)
    with pytest.raises(ValueError, match="fewer than"):
        ranges.scan_files(spark, str(tmp_path / "in"), ["short"])


# --- keyed state ---------------------------------------------------------------------


def test_stopped_streams_equal_the_batch(spark, tmp_path):
    """Rows that come in three parts, with a query that is stopped and started anew for each."""
    from corpusloom.streaming import state

    rng = random.Random(2)
    docs = [(n, rng.choice("abcdef") * 3, f"t{n}") for n in range(60)]
    points = [(rng.choice(["x", "y"]), n, rng.randrange(40), rng.choice([None, rng.random()])) for n in range(90)]
    for part in range(3):
        spark.createDataFrame(docs[part * 20 : part * 20 + 20], "seq long, k string, text string").write.mode("append").parquet(f"{tmp_path}/docs")
        spark.createDataFrame(points[part * 30 : part * 30 + 30], "run string, line long, step long, value double").write.mode("append").parquet(f"{tmp_path}/points")
        stream_of = lambda name, schema: spark.readStream.schema(schema).parquet(f"{tmp_path}/{name}")
        first = state.first_wins(stream_of("docs", "seq long, k string, text string"), F.col("k"))
        state.drain(first, "append", f"{tmp_path}/ck1", state.keep_batches(f"{tmp_path}/first")).awaitTermination()
        last = state.last_runs(stream_of("points", "run string, line long, step long, value double"))
        state.drain(last, "update", f"{tmp_path}/ck2", state.keep_batches(f"{tmp_path}/last")).awaitTermination()
    batch = corpus.first_of(spark.createDataFrame(docs, "seq long, k string, text string"), [F.col("k")])
    assert {(r.seq, r.k, r.text) for r in spark.read.parquet(f"{tmp_path}/first").collect()} == {tuple(r) for r in batch.collect()}
    df = spark.createDataFrame(points, "run string, line long, step long, value double")
    kept = runs.keep_last_run(df, "run").collect()
    for r in state.latest(spark, f"{tmp_path}/last", "run").collect():
        mine = sorted((k.step, k.value) for k in kept if k.run == r.run)
        best = min((v, s) for s, v in mine if v is not None)
        assert (r.points, r.first_step, r.last_step, r.lines) == (len(mine), mine[0][0], mine[-1][0], sum(p[0] == r.run for p in points))
        assert (r.best_value, r.best_step) == best


def test_joined_windows_are_not_broadcast(spark, tmp_path):
    # of a file, whose size the planner knows
    spark.createDataFrame([(k, f"{k:060d}", "a") for k in range(20)], "seq int, q string, a string").write.parquet(f"{tmp_path}/texts")
    texts = spark.read.parquet(f"{tmp_path}/texts")
    held = texts.where("seq % 5 = 0").select("q", "a")
    left = chat.without_fragments(texts, held, 40, 0)
    met = leak.occurrences(texts.selectExpr("seq AS doc_id", "q AS text"), held.selectExpr("q AS probe"), 48, 0)
    for rows, keys in ((left, ["w#", "w#", "seq#"]), (met, ["gram#"])):
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert [plan.count(f"SortMergeJoin [{k}") for k in keys] == [keys.count(k) for k in keys]


# --- portions of batches -------------------------------------------------------------


def test_tokens_are_made_and_read_in_portions(spark, tmp_path):
    import numpy as np
    import pyarrow as pa

    class Words:
        def decode(self, ids):
            return "x" * len(ids)

    texts = ["ab" * 5000, None, ""] * 1000
    rows = pa.record_batch({"doc_id": pa.array(range(3000)), "text": pa.array(texts)})
    coded = list(tokens._encoded([rows], np.arange(0x110000, dtype=np.int32)))
    assert max(b.nbytes for b in coded) < 10 << 20  # 4 bytes for each of the text's
    assert [x for b in coded for x in b.column(1).value_lengths().to_pylist()] == [len(t or "") for t in texts]
    ids = pa.record_batch({"doc_id": pa.array(range(1000)), "tokens": pa.array([[7] * 5000] * 1000, pa.list_(pa.int32()))})
    back = list(tokens._decoded([ids], Words()))
    assert max(b.num_rows for b in back) <= 30 and sum(b.num_rows for b in back) == 1000
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts[:9])], "doc_id long, text string")
    s = stream.flatten(tokens.char_encode(docs, tokens.vocabulary(docs)).withColumnRenamed("doc_id", "seq"), 512)
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "1000"
    stream.write_stream(s, f"{tmp_path}/x", 1)
    assert stream.read_stream(spark, f"{tmp_path}/x").length == s.length == 30_000


def test_a_stream_is_written_to_bounded_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stream, "IDS_A_FILE", 64, raising=False)
    flat, s = made(spark, [100, 0, 300], 16)
    stream.write_stream(s, f"{tmp_path}/x", 1)
    assert len(list((tmp_path / "x").glob("part-*"))) == 7  # 25 blocks, 4 a file
    found = stream.read_stream(spark, f"{tmp_path}/x").blocks.orderBy("block").collect()
    assert [i for r in found for i in r.tokens] == flat
