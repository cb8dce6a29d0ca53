import math
import random
import re
import unicodedata
from collections import Counter

from pyspark.sql import functions as F

from corpusloom.functions import text as T


def column(spark, values, f, *more):
    rows = [(i, v, *(m[i] for m in more)) for i, v in enumerate(values)]
    names = ["i", "t", *[f"c{k}" for k in range(len(more))]]
    df = spark.createDataFrame(rows, "i int, t string" + "".join(f", c{k} string" for k in range(len(more))))
    return [r[0] for r in df.orderBy("i").select(f(*[F.col(n) for n in names[1:]])).collect()]


ALPHABET = ["あ", "漢", "ー", "。", "a", "B", "é", " ", "　", " ", "​", "­", "\n", "\t", "\r", "\x85", "\x1c", "？", "👩‍👩", "\x07", "ホーム", "検索"]


def texts(n, size, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, size))) for _ in range(n)]


def py_normalize(t):
    kept = "".join(c for c in t if c in "\n\t" or unicodedata.category(c) not in ("Cc", "Cf", "Co", "Cs"))
    return re.sub(r"\s+", " ", kept).strip()


def py_clean(t):
    lines = [x.strip() for x in t.splitlines()]
    return py_normalize(" ".join(x for x in lines if x and not re.search(T.BOILERPLATE, x)))


def test_normalize_and_clean(spark):
    values = texts(300, 14, 1)
    assert column(spark, values, T.normalize) == [py_normalize(v) for v in values]
    assert column(spark, values, T.clean_document) == [py_clean(v) for v in values]


def test_boilerplate_is_anchored_only_for_navigation(spark):
    assert column(spark, ["ホーム\n本文です", "ホームの話\nCookieを使用します"], T.clean_document) == ["本文です", "ホームの話"]


def test_script_ratio(spark):
    assert column(spark, ["", "あいab", "漢字。"], T.script_ratio) == [0.0, 0.5, 1.0]


def py_repetitive(t, gram=20, limit=4):
    if len(t) < gram * limit:
        return False
    step = max(1, len(t) // 2000)
    seen = Counter(t[i : i + gram] for i in range(0, len(t) - gram, step))
    return max(seen.values(), default=0) >= limit


def test_repetition(spark):
    rng = random.Random(2)
    unit = "".join(rng.choice("abcdefghij") for _ in range(30))
    noise = lambda n: "".join(chr(rng.randint(97, 122)) for _ in range(n))
    values = ["a" * 79, "a" * 80, unit * 3 + noise(50), unit * 4 + noise(50), noise(5000), (unit + noise(7)) * 300, noise(9000) + unit * 40, "", (unit[:20] + noise(3)) * 3 + unit[:20]]
    assert column(spark, values, T.is_repetitive) == [py_repetitive(v) for v in values]


def test_broken_pairs_and_replies(spark):
    q, a = ["x", "x", "x", "x"], ["x", "abcdefgh", "abcdef" * 4, "abcdefg" + "abcdef" * 3]
    expect = [True, False, True, max(Counter(a[3][i : i + 6] for i in range(len(a[3]) - 5)).values()) >= 4]
    assert column(spark, q, T.looks_broken, a) == expect
    assert column(spark, ["abcabcab", "abcabcabc", "あああああああああ", ""], T.has_repetition) == [False, True, True, False]
    assert column(spark, ["abc ", "abcd", "ab <|unk|>"], lambda t: T.is_broken_reply(t, F.lit(False))) == [True, False, True]


def py_sentences(t, least, most):
    def cut(x):
        if len(x.encode()) <= most:
            return [x]
        k = max(1, most // 3)
        return [y for y in (x[i : i + k] for i in range(0, len(x), k)) if y.strip()]

    out, held = [], ""
    for piece in re.split("(?<=[。！？\n])", t):
        held += piece
        if len(held.encode()) >= least:
            out, held = out + cut(held), ""
    return out + (cut(held) if held.strip() else [])


def test_sentences(spark):
    rng = random.Random(3)
    values = ["".join(rng.choice("あい。！a \n") for _ in range(rng.randint(0, 60))) for _ in range(120)]
    found = column(spark, values, lambda t: T.split_sentences(t, 12, 30))
    for v, f in zip(values, found):
        mine = [x for x in py_sentences(v, 12, 30)]
        assert f == mine, v


def test_small_functions(spark):
    assert column(spark, ["ab@x.org", "abcde@x.org", "0901234"], T.mask_contact) == ["ab@x.org", "ab***@x.org", "090****"]
    assert column(spark, ["q<|end|>", "q", ""], T.with_end) == ["q<|end|>", "q<|end|>", "<|end|>"]
    assert column(spark, ["abc  def", "ab"], lambda t: T.clip(t, 4)) == ["abc…", "ab"]
    assert column(spark, ["/a/b/c.npz", "c.npz"], T.last_parts) == ["b/c.npz", "c.npz"]
    line = "<|user|>q1<|assistant|>a1<|end|><|user|>q2<|assistant|>a2<|end|>"
    assert column(spark, [line], T.chat_pairs_of_line) == [[("q1", "a1"), ("q2", "a2")]]
    rates = spark.range(0, 11).select(T.learning_rate(F.col("id"), 1.0, 10, 2, 0.1)).collect()
    assert abs(rates[0][0] - 0.02) < 1e-12 and abs(rates[2][0] - 1) < 1e-12 and abs(rates[10][0] - 0.1) < 1e-12
    assert spark.range(1).select(T.finite(F.lit(float("inf")))).first()[0] is None and math.isclose(spark.range(1).select(T.finite(F.lit(1.23456))).first()[0], 1.2346)


def test_wrapping_turns_and_markers(spark):
    def wrap(t, width):
        lines, line = [], ""
        for c in t:
            if len(line) >= width and c not in T.NO_LINE_START:
                lines.append(line)
                line = c
            else:
                line += c
        return lines + [line] * bool(line)

    rng = random.Random(4)
    values = ["".join(rng.choice("あいa。、w\n 」") for _ in range(rng.randint(0, 30))) for _ in range(200)]
    assert column(spark, values, lambda t: T.wrap(t, 4)) == [wrap(v, 4) for v in values]
    marked = ["<|user|>a<|unk|>b<|endoftext|>", ""]
    assert column(spark, marked, T.without_markers) == ["a<|unk|>b", ""]
    assert column(spark, marked, lambda t: T.without_markers(t, T.REPLY_MARKERS)) == ["ab<|endoftext|>", ""]
    turns = spark.createDataFrame([([1, 2, 3],), ([],)], "t array<int>")
    assert [[r[k] for r in turns.select(*[T.last_turns(F.col("t"), n) for n in (0, 2, 5)]).collect()] for k in range(3)] == [[[], []], [[2, 3], []], [[1, 2, 3], []]]
    at = spark.sql("SELECT timestamp'2024-01-01 00:00:00' AS now, 1.5D AS h, CAST(NULL AS DOUBLE) AS none").select(T.done_at(F.col("now"), F.col("h")).cast("string"), T.done_at(F.col("now"), F.col("none")).cast("string")).first()
    assert tuple(at) == ("2024-01-01 01:30:00", "2024-01-01 00:00:00")


def test_strided_windows(spark):
    rng = random.Random(5)
    values = ["".join(rng.choice("ab\n") for _ in range(rng.randint(0, 60))) for _ in range(60)]
    for size, stride in ((5, 1), (5, 3), (5, 5), (4, 9)):
        assert column(spark, values, lambda t: T.strided_windows(t, size, stride)) == [[v[i : i + size] for i in range(0, len(v) - size + 1, stride)] for v in values]


def test_rejected_over_all_white_space(spark):
    """Error pages whose parts are apart by any white space, ideographic and narrow ones too."""
    texts = ["404 Not Found", "403\u3000Forbidden", "404\u00a0\u2009\u001fNot Found", "404Not Found", "404 was Not Found", "404\u200bNot Found"]
    got = [r.x for r in spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "n int, t string").orderBy("n").select(F.col("t").rlike(T.REJECTED).alias("x")).collect()]
    assert got == [True, True, True, True, False, False]
