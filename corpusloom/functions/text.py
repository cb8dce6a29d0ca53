"""Column functions over text. All lengths and positions are code points unless named bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.grams import repeats

# White space and line ends as the corpus rules count them, and the markers.
SPACE = r"(?U)[\s\x{1c}-\x{1f}]"
LINE_END = r"\r\n|[\n\x0b\x0c\r\x1c-\x1e\x85\x{2028}\x{2029}]"
CONTROL = r"[\p{Cc}\p{Cf}\p{Co}\p{Cs}&&[^\n\t]]"
USER, ASSISTANT, END, UNK = "<|user|>", "<|assistant|>", "<|end|>", "<|unk|>"
CORPUS_MARKERS = r"<\|(?:user|assistant|end|endoftext)\|>"
REPLY_MARKERS = r"<\|(?:user|assistant|end|unk)\|>"
JAPANESE = "[぀-ゟ゠-ヿ一-鿿々〆ー、。「」]"
LATIN = "[A-Za-zÀ-ÿ]"
NO_LINE_START = "。、」）ｗw！？"
SENTENCE_END = "(?<=[。！？\\n])"

# Lines that are dropped.
BOILERPLATE = (
    "(Cookie|クッキー).{0,20}(使用|利用|同意)"
    "|JavaScript.{0,30}(有効|オフ|無効)"
    "|^(ホーム|トップ|メニュー|サイトマップ|お問い合わせ|プライバシーポリシー|利用規約|会社概要|採用情報|関連記事|人気記事|新着記事|カテゴリー?"
    "|前の記事|次の記事|コメントを残す|コメントする|返信をキャンセル|ページの先頭へ|検索|ログイン|新規登録|カートに入れる|続きを読む)$"
    "|無断(転載|複写|複製)を?禁(じ|ず)"
    "|All Rights Reserved"
)
# Documents that are rejected. White space is all that Unicode counts as such, written out so that
# Java and RE2 agree.
REJECTED = r"(18歳未満|アダルトサイト|出会い系)|(404|403)[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]*(Not Found|Forbidden)|お探しのページは(見つかりません|移動)"


def without_markers(text: Column, markers: str = CORPUS_MARKERS) -> Column:
    """The text without its markers: CORPUS_MARKERS where corpora are compared, REPLY_MARKERS
    where replies are judged."""
    return F.regexp_replace(text, markers, "")


def collapse(text: Column) -> Column:
    """White space runs to one space, none at the ends."""
    return F.trim(F.regexp_replace(text, SPACE + "+", " "))


def normalize(text: Column) -> Column:
    """Control, format, private and surrogate characters go, but for line ends and tabs; then
    collapse(). Unassigned code points stay: which they are depends on the Java version."""
    return collapse(F.regexp_replace(text, CONTROL, ""))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def clean_document(raw: Column, boilerplate: str = BOILERPLATE) -> Column:
    """Blank and boilerplate lines go, the others are joined by spaces and normalized."""
    lines = F.transform(F.split(raw, LINE_END, -1), strip)
    return normalize(F.array_join(F.filter(lines, lambda x: (x != "") & ~x.rlike(boilerplate)), " "))


def script_ratio(text: Column, script: str = JAPANESE) -> Column:
    """The share of characters of a class; 0 for an empty text."""
    return F.when(F.length(text) > 0, F.regexp_count(text, F.lit(script)) / F.length(text)).otherwise(F.lit(0.0))


def prefix_key(text: Column, size: int = 200) -> Column:
    return F.substring(text, 1, size)


def windows(text: Column, size: int) -> Column:
    """All windows of the size, in order, in one pass over the text. A match takes one character, so
    that none begins inside a surrogate pair."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{size}}}))."), F.lit(1))


def strided_windows(text: Column, size: int, stride: Column | int) -> Column:
    """The windows that begin at 0, stride, 2 stride ..., which may overlap, in one pass."""
    step = F.lit(stride) if isinstance(stride, int) else stride
    return F.regexp_extract_all(text, F.concat(F.lit(f"(?s)(?=(.{{{size}}})).{{1,"), step.cast("string"), F.lit("}")), F.lit(1))


def mixed(seed: int, *keys: Column) -> Column:
    """A long from 0 that depends on the seed and the keys alone: the first 60 bits of the MD5 of
    seed and keys, joined by colons."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in keys])), 1, 15), 16, 10).cast("long")


def let(value: Column, f) -> Column:
    """f(value) with the value computed once, also where f uses it inside a lambda."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def is_repetitive(text: Column, gram: int = 20, times: int = 4) -> Column:
    """Some gram occurs `times` times among those at every step-th place, the last place left
    out; step is length // 2000, at least 1. Texts under gram * times characters are not."""
    return repeats(text, gram, times, gram * times, sampled=True)


def looks_broken(question: Column, answer: Column, gram: int = 6, times: int = 4, least: int = 12) -> Column:
    """A pair whose sides are equal, or whose answer repeats a gram."""
    return (question == answer) | repeats(answer, gram, times, least)


def has_repetition(text: Column, gram: int = 3, times: int = 3) -> Column:
    return repeats(text, gram, times, gram * times)


def is_broken_reply(text: Column, truncated: Column) -> Column:
    return (F.length(strip(text)) < 4) | truncated | F.contains(text, F.lit(UNK))


def chat_line(question: Column, answer: Column) -> Column:
    return F.concat(F.lit(USER), question, F.lit(ASSISTANT), answer, F.lit(END))


def chat_pairs_of_line(line: Column) -> Column:
    """array<struct<q, a>> of every serialised pair on a line."""
    regex = r"<\|user\|>(.*?)<\|assistant\|>(.*?)<\|end\|>"
    q, a = (F.regexp_extract_all(line, F.lit(regex), F.lit(k)) for k in (1, 2))
    return F.arrays_zip(q.alias("q"), a.alias("a"))


def with_end(line: Column) -> Column:
    return F.when(F.endswith(line, F.lit(END)), line).otherwise(F.concat(line, F.lit(END)))


def hard_split(text: Column, most_bytes: int) -> Column:
    """A text over the limit as slices of most_bytes // 3 characters, blank ones dropped."""
    step = max(1, most_bytes // 3)
    slices = F.filter(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{step}}}"), F.lit(0)), lambda x: strip(x) != "")
    return F.when(F.octet_length(text) <= most_bytes, F.array(text)).otherwise(slices)


def split_sentences(text: Column, least_bytes: int, most_bytes: int) -> Column:
    """Sentences, the short ones packed with those after them until they reach least_bytes,
    each then cut by hard_split(); a blank remainder is dropped."""
    none = F.array().cast("array<string>")
    start = F.struct(none.alias("out"), F.lit("").alias("open"))

    def step(acc, piece):
        grown = F.concat(acc["open"], piece)
        full = F.octet_length(grown) >= least_bytes
        return F.struct(F.when(full, F.concat(acc["out"], hard_split(grown, most_bytes))).otherwise(acc["out"]).alias("out"), F.when(full, F.lit("")).otherwise(grown).alias("open"))

    return F.aggregate(F.split(text, SENTENCE_END, -1), start, step, lambda acc: F.when(strip(acc["open"]) != "", F.concat(acc["out"], hard_split(acc["open"], most_bytes))).otherwise(acc["out"]))


def mask_contact(text: Column) -> Column:
    """An e-mail keeps two characters and its domain, another string three characters."""
    at = F.instr(text, "@")
    head = F.substring(text, F.lit(1), at - 1)
    stars = lambda x, n: F.repeat(F.lit("*"), F.greatest(F.lit(0), F.length(x) - n))
    mail = F.concat(F.substring(head, 1, 2), stars(head, 2), F.substring(text, at, F.length(text)))
    return F.when(at > 0, mail).otherwise(F.concat(F.substring(text, 1, 3), stars(text, 3)))


def wrap(text: Column, width: int) -> Column:
    """array<string>: lines of width characters; what may not begin a line stays on the line before."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{width}}}[{NO_LINE_START}]*"), F.lit(0))


def last_turns(turns: Column, n: int) -> Column:
    """The last n of an array, none for 0."""
    return F.when(F.lit(n > 0) & (F.size(turns) > n), F.slice(turns, -max(n, 1), max(n, 1))).when(F.lit(n > 0), turns).otherwise(F.slice(turns, 1, 0))


def done_at(now: Column, hours: Column) -> Column:
    """The time a run will be done, from the hours it still needs (none given: now)."""
    return now + F.make_dt_interval(secs=F.round(F.coalesce(hours, F.lit(0.0)) * 3600, 6))


def clip(text: Column, size: int) -> Column:
    return F.when(F.length(text) > size, F.concat(F.rtrim(F.substring(text, 1, size)), F.lit("…"))).otherwise(text)


def last_parts(path: Column, n: int = 2) -> Column:
    """The last n parts of a path."""
    return F.regexp_extract(path, rf"((?:[^/]+/){{0,{n - 1}}}[^/]+)/*$", 1)


def finite(x: Column, digits: int = 4) -> Column:
    """NaN and infinities are null, others rounded half-even."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(F.bround(x, digits))


def learning_rate(step: Column, rate: float, total: int, warmup: int, least: float) -> Column:
    """Linear from 0.02 rate to rate over the warm-up, then a cosine to rate * least."""
    warm = max(1, min(warmup, total - 1))
    rest = max(total - warm, 1)
    part = F.least((step - warm) / rest, F.lit(1.0))
    cosine = F.lit(rate * least) + F.lit(rate * (1 - least) / 2) * (1 + F.cos(F.pi() * part))
    return F.when(step < warm, F.lit(rate * 0.02) + step * F.lit(rate * 0.98 / warm)).otherwise(cosine)
