import random

import pytest
from pyspark.sql import functions as F

from corpusloom.functions.ordered import sums_before
from corpusloom.operators import chat, corpus, leak, pii, runs, tokens


def test_running_sums_do_not_depend_on_partitions(spark):
    rng = random.Random(1)
    rows = [(i, rng.randint(0, 9)) for i in range(200)]
    for n in (1, 3, 7):
        got = sums_before(spark.createDataFrame(rows, "seq long, v long"), ["seq"], "v", "before", n).orderBy("seq").collect()
        total = 0
        for r, (_, v) in zip(got, rows):
            assert r.before == total
            total += v
    assert sums_before(spark.createDataFrame([], "seq long, v long"), ["seq"], "v", "before").count() == 0


def test_budgets_and_splits(spark):
    rows = spark.createDataFrame([(i, 10) for i in range(20)], "seq long, n_chars long")
    ids = lambda df: sorted(r.seq for r in df.collect())
    assert ids(corpus.within_budget(rows, 25)) == [0, 1, 2]
    assert ids(corpus.tail(rows, 25)) == [17, 18, 19]
    assert ids(corpus.every(rows, 8)) == [0, 8, 16]
    split = corpus.split_validation(rows, 5, 15)
    assert ids(split.where("validation")) == [0, 5] and split.count() == 20
    assert corpus.stride_for(25, 10) == 2 and corpus.stride_for(35, 10) == 4 and corpus.stride_for(5, 0) == 1
    assert ids(corpus.fraction_split(rows, 0.1, 1).where("validation")) == ids(corpus.fraction_split(rows.repartition(5), 0.1, 1).where("validation"))
    assert corpus.repeat(rows, 2.25, 3).count() == 45
    with pytest.raises(ValueError):
        corpus.repeat(rows, 0, 1)
    assert ids(corpus.shuffled(rows, 4)) == list(range(20))


def test_build_takes_sources_in_order_and_counts_to_the_cut(spark):
    good = lambda c, i: c + "".join(random.Random(i).choices("あいうえおかきくけこ漢字", k=230))
    a = spark.createDataFrame([(0, good("あ", 1)), (1, "短い"), (2, good("い", 2)), (3, "short again")], "seq long, text string")
    b = spark.createDataFrame([(0, good("い", 2)), (1, good("う", 5)), (2, good("う", 5)), (3, None)], "seq long, text string")
    kept, lost = corpus.build([("a", a, 400), ("b", b, 10_000)])
    assert sorted((r.source, r.seq) for r in kept.collect()) == [("a", 0), ("a", 2), ("b", 1)]
    assert {(r.source, r.reason): r.n for r in lost.collect()} == {("a", "short"): 1, ("b", "duplicate"): 2, ("b", "short"): 1}
    row = corpus.manifest(kept, lost).first()
    assert row.total_documents == 3 and row.rejected == {"short": 2, "duplicate": 2}


def test_first_of_and_last_of(spark):
    rows = spark.createDataFrame([(0, "x"), (1, "x"), (2, None), (3, None), (4, "y")], "seq long, k string")
    assert sorted(r.seq for r in corpus.first_of(rows, [F.col("k")]).collect()) == [0, 2, 4]
    assert sorted(r.seq for r in corpus.last_of(rows, [F.col("k")]).collect()) == [1, 3, 4]


def test_adjacent_pairs(spark):
    turns = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 2, "user", "c"), (1, 3, "user", " "), (1, 4, "assistant", "d"), (2, 0, "user", "e"), (2, 1, "system", "s"), (2, 2, "assistant", "f"), (3, 0, "assistant", "g"), (4, 0, "user", "h"), (4, 1, "system", ""), (4, 2, "assistant", "i"), (5, 0, "user", None)]
    got = chat.adjacent_pairs(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    assert sorted((r.q, r.a) for r in got.collect()) == [("a", "b"), ("e", "f")]


def test_tree_last_row_of_an_id_counts(spark):
    m = [("1", "nan", "user", "old", False, 0), ("1", "nan", "user", "new", False, 1), ("2", "1", "assistant", "a", False, 2), ("3", "1", "assistant", "b", True, 3), ("4", "2", "assistant", "c", False, 4)]
    got = chat.pairs_of_tree(spark.createDataFrame(m, "message_id string, parent_id string, role string, text string, flagged boolean, seq long"))
    assert [(r.q, r.a) for r in got.collect()] == [("new", "a")]


def test_pair_filters(spark):
    rng = random.Random(5)
    noise = lambda n: "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))
    held = noise(120)
    pairs = [(0, "q", noise(100)), (1, "q", noise(30) + held[13:53] + noise(20)), (2, held[60:99], noise(60)), (3, held[:40] + "x", "short"), (4, "q", "Ω rare")]
    df = spark.createDataFrame(pairs, "seq long, q string, a string")
    kept = chat.without_fragments(df, spark.createDataFrame([("z", held)], "q string, a string"))
    assert sorted(r.seq for r in kept.collect()) == [0, 2, 4]
    assert 4 not in [r.seq for r in chat.without_rare(df, 2).collect()]
    assert chat.without_rare(df, 1).count() == 5
    one = chat.summary(df).first()
    assert one.pairs == 5 and one.chars == sum(len(q) + len(a) for _, q, a in pairs)
    assert chat.summary(df.where("false")).first().avg_q is None


def test_planted_needles(spark):
    rng = random.Random(6)
    noise = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    needle, absent = noise(150), noise(150)
    lines = spark.createDataFrame([(1, needle), (2, absent), (3, "too short"), (4, None)], "line_no int, text string")
    wanted = leak.probes(lines)
    assert {r.line_no for r in wanted.collect()} == {1, 2}
    n = " ".join(needle.split())
    docs = spark.createDataFrame([(7, noise(50) + n + noise(31) + n + noise(9)), (8, noise(500)), (9, n[20:]), (10, None)], "doc_id long, text string")
    got = {(r.probe, r.doc_id): 0 for r in leak.occurrences(docs, wanted).collect()}
    for p in [r.probe for r in wanted.where("line_no = 1").collect()]:
        assert (p, 7) in got
    report = leak.report(docs, lines).first()
    assert report.leaked and report.affected_lines == [1] and report.occurrences == 5  # two probes twice, one once more in the cut copy
    assert sorted(r.line_no for r in leak.clean_lines(lines, leak.report(docs, lines)).collect()) == [2, 3, 4]
    half_even = spark.createDataFrame([(1, "a" * 48 + "bcdef")], "line_no int, text string")
    assert {r.probe for r in leak.probes(half_even, 48, 3, 48).collect()} == {("a" * 48 + "bcdef")[s : s + 48] for s in (0, 2, 5)}


def test_contacts(spark):
    t = "x" * 130 + " write to bob.smith@corp.example.com or bob.smith@corp.jp, call 03-1234-5678, bob.smith@corp.jp"
    found = pii.matches(spark.createDataFrame([(1, t), (2, None), (3, "")], "doc_id long, text string"))
    rows = {(r.kind, r.position): r for r in found.collect()}
    assert rows["email", 0].placeholder and not rows["email", 1].placeholder
    assert rows["phone", 0].secret == "03-1234-5678" and rows["email", 2].context.endswith("5678, ") and len(rows["email", 2].context) == 120
    assert [r.secret for r in pii.targets(found, 5).collect()] == ["03-1234-5678", "bob.smith@corp.jp"]
    c = spark.createDataFrame([("bob.smith@corp.jp", "is bob.smith there"), ("a@b.cc", "a"), ("03-1234-5678", "03-1234-5678")], "secret string, output string")
    assert [r.leak for r in pii.leak_class(c).collect()] == ["partial", "none", "exact"]
    assert {r.kind: (r.n, r.distinct_n, r.others) for r in pii.summary(found).collect()} == {"email": (3, 2, 2), "phone": (1, 1, 1)}


def test_tokens_round_trip_and_mask(spark):
    lines = ["<|user|>あa<|assistant|>bb<|end|>", "<|user|>x<|end|>y", ""]
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    vocab = tokens.vocabulary(docs)
    assert [r.token for r in vocab.orderBy("id").collect()] == ["<|unk|>", "<|user|>", "<|assistant|>", "<|end|>", "a", "b", "x", "y", "あ"]
    coded = tokens.char_tokens(docs, vocab)
    assert {r.doc_id: r.text for r in tokens.char_decode(coded, vocab).collect()} == {0: lines[0], 1: lines[1]}
    masked = tokens.loss_mask(coded)
    assert [r.weight for r in masked.where("doc_id = 0").orderBy("pos").collect()] == [0, 0, 0, 0, 1, 1, 1]
    assert [r.weight for r in masked.where("doc_id = 1").orderBy("pos").collect()] == [0, 0, 0, 0]
    assert tokens.shifted(masked).where("doc_id = 0 and pos = 6").first().target is None
    assert tokens.mask_ratio(masked).first().ratio == 3 / 11
    with pytest.raises(ValueError):
        tokens.check_mask_ratio(0.99)
    w = tokens.token_windows(spark.createDataFrame([(1, list(range(10))), (2, [1, 2]), (3, [])], "doc_id long, tokens array<int>"), 4)
    assert [(r.window, r.tokens) for r in w.orderBy("window").collect()] == [(0, [0, 1, 2, 3, 4]), (1, [4, 5, 6, 7, 8])]


def test_batches_are_a_function_of_seed_and_step(spark):
    a = tokens.batch_offsets(spark, 1000, 16, 4, 5, 6).collect()
    b = tokens.batch_offsets(spark, 1000, 16, 4, 5, 6).repartition(3).orderBy("step", "i").collect()
    assert a == b and all(0 <= r.offset < 983 for r in a)
    assert a != tokens.batch_offsets(spark, 1000, 16, 4, 6, 6).collect()


def test_subwords(spark, tmp_path):
    rng = random.Random(7)
    words = ["alpha", "beta", "gamma", "delta", "漢字", "かな"]
    docs = spark.createDataFrame([(i, " ".join(rng.choice(words) for _ in range(12))) for i in range(200)], "doc_id long, text string")
    path = str(tmp_path / "m.model")
    tokens.train_subwords(docs, path, vocab_size=320, lines=150)
    coded = tokens.subword_encode(docs, path)
    back = {r.doc_id: r.text for r in tokens.subword_decode(coded, path).collect()}
    assert back == {r.doc_id: r.text for r in docs.collect()}


def test_curves(spark):
    log = spark.createDataFrame([(0, 1), (1, 2), (2, 3), (3, 2), (4, 3), (5, 4)], "line long, step long")
    assert [r.line for r in runs.keep_last_run(log).orderBy("line").collect()] == [0, 3, 4, 5]
    train = spark.createDataFrame([(10, 1.0), (20, 2.0)], "step long, value double")
    val = spark.createDataFrame([(5, 0.0), (10, 5.0), (15, 1.0), (30, 3.0)], "step long, value double")
    gap = runs.gaps(train, val)
    assert [(r.step, r.train) for r in gap.orderBy("step").collect()] == [(5, 1.0), (10, 1.0), (15, 1.5), (30, 2.0)]
    assert runs.divergence_step(gap).first()[0] == 10
    assert runs.best_point(spark.createDataFrame([(2, 1.0), (1, 1.0)], "step long, value double")).first().best_step == 1
    steps = spark.createDataFrame([(k,) for k in range(10, 130, 10)], "step long")
    marks = spark.createDataFrame([(7,), (14,)], "mark long")
    assert sorted(r.step for r in runs.usable_steps(steps, marks, 10).collect()) == list(range(30, 130, 10))
    kv = lambda *rows: spark.createDataFrame(rows, "key string, value double")
    assert tuple(runs.max_abs_diff(kv(("a", 1.0), ("b", 2.0)), kv(("a", 1.5), ("b", 2.0))).first()) == ("a", 0.5)
    with pytest.raises(Exception, match="keys differ"):
        runs.max_abs_diff(kv(("a", 1.0)), kv(("b", 1.0))).collect()
    verdict = lambda *d: runs.scaling_verdict(spark.createDataFrame(list(enumerate(d)), "place int, divergence_step int")).first()[0]
    assert (verdict(900, 0, 0), verdict(900, 1200, 0), verdict(900, 500)) == ("none", "later", "unordered")


def test_evaluation(spark):
    replies = spark.createDataFrame([("abcabcabc", False, ["x"]), ("fine reply", True, None), ("has x", False, ["x", "y"])], "text string, truncated boolean, keywords array<string>")
    rates = runs.reply_rates(runs.reply_flags(replies)).first()
    assert (rates.repetition_rate, rates.broken_rate, rates.topic_rate) == (1 / 3, 1 / 3, 0.5)
    m = lambda *rows: spark.createDataFrame(rows, "metric string, value double")
    got = {r.metric: (r.verdict, r.cost) for r in runs.comparison(m(("bits_per_char", 2.0), ("topic_rate", 0.5), ("broken_rate", 0.0)), m(("bits_per_char", 1.0), ("topic_rate", 0.25), ("broken_rate", 0.0))).collect()}
    assert got == {"bits_per_char": ("worsened", 1.0), "topic_rate": ("improved", -0.25), "broken_rate": ("unchanged", 0.0)}


def test_saved_tokenizers(spark, tmp_path):
    docs = spark.createDataFrame([(0, "<|user|>あa<|assistant|>b\nb<|end|>"), (1, "unseen ω"), (2, ""), (3, None), (4, "<|end|><|end|>")], "doc_id long, text string")
    vocab = tokens.vocabulary(docs.where("doc_id = 0"))
    tokens.CharTokenizer(vocab).save(str(tmp_path / "char"))
    again = tokens.load_tokenizer(spark, str(tmp_path / "char"))
    assert sorted(map(tuple, again.vocab.collect())) == sorted(map(tuple, vocab.collect()))
    by_join = {}
    for r in tokens.char_tokens(docs.where("text <> ''"), vocab).collect():
        by_join.setdefault(r.doc_id, {})[r.pos] = r.token
    coded = {r.doc_id: r.tokens for r in again.encode(docs).collect()}
    assert coded == {i: [by_join[i][k] for k in sorted(by_join[i])] if i in by_join else [] for i in range(5)}
    back = {r.doc_id: r.text for r in again.decode(again.encode(docs), skip_special=True).collect()}
    assert back[0] == "あab\nb"
    rng = random.Random(8)
    words = spark.createDataFrame([(i, " ".join(rng.choice(["alpha", "beta", "gamma", "かな"]) for _ in range(9))) for i in range(150)], "doc_id long, text string")
    tokens.train_subwords(words, str(tmp_path / "m.model"), vocab_size=320, lines=100)
    tokens.SubwordTokenizer(str(tmp_path / "m.model")).save(str(tmp_path / "sub"), spark)
    sub = tokens.load_tokenizer(spark, str(tmp_path / "sub"))
    assert isinstance(sub, tokens.SubwordTokenizer)
    assert {r.doc_id: r.text for r in sub.decode(sub.encode(words)).collect()} == {r.doc_id: r.text for r in words.collect()}
    marked = spark.createDataFrame([(1, "<|user|>alpha<|end|>")], "doc_id long, text string")
    assert sub.decode(sub.encode(marked)).first().text == "alpha"
    (tmp_path / "old").mkdir()
    (tmp_path / "old" / "tokenizer").mkdir()
    (tmp_path / "old" / "tokenizer" / "part.json").write_text('{"itos": ["<|unk|>", "<|user|>", "<|assistant|>", "<|end|>", "a"]}')
    assert isinstance(tokens.load_tokenizer(spark, str(tmp_path / "old")), tokens.CharTokenizer)


def test_samples_and_heads(spark):
    lines = spark.createDataFrame([(k, "あ" * 10 + "。" + "b" * k) for k in range(12)], "seq long, text string")
    joined = "\n".join("あ" * 10 + "。" + "b" * k for k in range(12))
    for size in (0, 1, 11, 12, 13, 40, 10_000):
        assert "\n".join(r.text for r in corpus.text_head(lines, size).orderBy("seq").collect()).rstrip("\n") == joined[:size].rstrip("\n")
    assert abs(corpus.bytes_per_char(lines) - len(joined.replace("\n", "").encode()) / len(joined.replace("\n", ""))) < 1e-12
    assert corpus.bytes_per_char(lines.where("false")) == 0 and corpus.estimate_chars(100, 0.0) == 0 and corpus.estimate_chars(100, 2.0) == 50
    sample = corpus.subword_sample(lines, 30, 3, 20, 60)
    assert {r.seq for r in sample.collect()} == {0, 3, 6}  # 11, 14 and 17 characters: the third reaches 30
    assert all(r.line == r.line.strip() and "\n" not in r.line for r in sample.collect())


def test_key_sets_and_prompts(spark):
    k = lambda *xs: spark.createDataFrame([(x,) for x in xs], "key string")
    assert {(r.key, r.side) for r in runs.key_sets(k("a", "b", "b", None), k("b", "c")).collect()} == {("a", "left"), ("b", "both"), ("c", "right")}
    models, prompts = spark.range(2).toDF("m"), spark.range(3).toDF("p")
    assert runs.model_prompts(models, prompts).count() == 6
    with pytest.raises(ValueError):
        runs.model_prompts(models, spark.range(runs.MOST_PROMPTS + 1).toDF("p"))


def test_run_table_and_lookup(spark):
    train = spark.createDataFrame([("a", 10, 3.0), ("a", 20, 1.0), ("b", 10, 5.0)], "run string, step long, value double")
    val = spark.createDataFrame([("a", 10, 2.0), ("a", 20, 2.5), ("b", 10, 4.0)], "run string, step long, value double")
    assert {r.run: (r.final_train, r.best_step, r.best_value, r.divergence_step) for r in runs.run_table(train, val).collect()} == {"a": (1.0, 10, 2.0, 20), "b": (5.0, 10, 4.0, 0)}
    assert runs.lookup(val, {"run": "a"}, "step").first().step == 10
    with pytest.raises(KeyError):
        runs.lookup(val, {"run": "z"}, "step")
