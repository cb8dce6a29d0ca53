"""Cleaning, rejection, deduplication, budgets, splits and mixes of a corpus.

Order is a column (seq), unique and not null. Running sums over it go through
functions.ordered, so that no operator needs all rows in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.functions.ordered import sums_before
from corpusloom.sources.storage import materialize, spread

REASONS = ("unsuitable", "short", "low_ratio", "repetitive", "duplicate")


def screen(docs: DataFrame, script: str = T.JAPANESE, least: int = 200, most: int = 20_000, ratio: float = 0.7) -> DataFrame:
    """seq, cleaned text and the first reason against each document (null: none so far), in the
    order unsuitable (on the raw text), short, [cut to most], low_ratio, repetitive. Columns of
    docs other than seq and text stay."""
    raw = F.coalesce("text", F.lit(""))
    # generated, so that the cleaning is written into the plan once
    cleaned = spread(docs).withColumn("_raw", raw).withColumn("text", F.explode(F.array(T.clean_document(raw))))
    reason = F.when(F.col("_raw").rlike(T.REJECTED), "unsuitable").when(F.length("text") < least, "short")
    cut = cleaned.withColumn("_early", reason).withColumn("text", F.substring("text", 1, most))
    late = F.when(T.script_ratio(F.col("text"), script) < ratio, "low_ratio").when(T.is_repetitive(F.col("text")), "repetitive")
    return cut.withColumn("reason", F.coalesce("_early", late)).drop("_raw", "_early")


def first_of(rows: DataFrame, keys: list[Column], seq: str = "seq") -> DataFrame:
    """The first row of each key: a pre-aggregated minimum, then a semi-join on the unique seq,
    so a key that many rows share makes no large task."""
    firsts = rows.groupBy(*[k.alias(f"_k{n}") for n, k in enumerate(keys)]).agg(F.min(seq).alias("_first"))
    return rows.join(firsts, rows[seq] == firsts["_first"], "left_semi")


def last_of(rows: DataFrame, keys: list[Column], seq: str = "seq") -> DataFrame:
    lasts = rows.groupBy(*[k.alias(f"_k{n}") for n, k in enumerate(keys)]).agg(F.max(seq).alias("_last"))
    return rows.join(lasts, rows[seq] == lasts["_last"], "left_semi")


def reject_duplicates(screened: DataFrame, prefix: int = 200) -> DataFrame:
    """screen()'s rows, with duplicate as the reason of those that passed so far but are not the
    first with their prefix. The rows are stored first: both uses of them read that table, and
    cleaning runs once."""
    screened = materialize(screened, "corpus-screened")
    passed = screened.where("reason is null")
    firsts = passed.groupBy(T.prefix_key(F.col("text"), prefix).alias("k")).agg(F.min("seq").alias("_first")).select("_first")
    joined = screened.join(firsts, screened["seq"] == firsts["_first"], "left")
    return joined.withColumn("reason", F.when(F.col("reason").isNull() & F.col("_first").isNull(), "duplicate").otherwise(F.col("reason"))).drop("_first")


#: The first range that a budget reads, as a part of all of seq, and how much a range may grow.
FIRST_PART, GROWTH = 256, 8


def budget_cut(rows: DataFrame, target: int, size: str = "n_chars", back: bool = False) -> int | None:
    """The seq of the row at which the sizes reach the target, from the first row on (back: from
    the last); None if they do not.

    Ranges of seq are read one after the other, each as wide as the sizes so far make one
    expect, until the target lies in one; only its rows are put in order. The ranges are filters
    on seq, which reach the scan, so what is read grows with the budget where files or row groups
    hold ranges of seq."""
    if rows.schema["seq"].dataType.typeName() not in ("long", "integer", "short", "byte"):
        raise TypeError("a budget needs an integer seq")
    ends = rows.agg(F.min("seq").alias("lo"), F.max("seq").alias("hi")).first()
    if ends.lo is None:
        return None
    total, done, width = 0, 0, max(1, (ends.hi - ends.lo + 1) // FIRST_PART)
    while done <= ends.hi - ends.lo:
        width = min(width, ends.hi - ends.lo + 1 - done)
        near, far = (ends.hi - done, ends.hi - done - width + 1) if back else (ends.lo + done, ends.lo + done + width - 1)
        part = rows.where(F.col("seq").between(min(near, far), max(near, far)))
        got = part.agg(F.sum(size)).first()[0] or 0
        if total + got >= target:
            order = -F.col("seq") if back else F.col("seq")
            placed = sums_before(part.select("seq", order.alias("_at"), size), ["_at"], size, "_before").where(F.col("_before") < target - total)
            return placed.agg(F.min("seq") if back else F.max("seq")).first()[0]
        total, done = total + got, done + width
        expected = (target - total) * done // total + 1 if total > 0 else GROWTH * width
        width = min(max(expected * 9 // 8, width // GROWTH, 1), GROWTH * width)
    return None


def within_budget(rows: DataFrame, target: int, size: str = "n_chars") -> DataFrame:
    """Rows in order up to and with the one that reaches the target."""
    if target <= 0:
        return rows.where(F.lit(False))
    cut = budget_cut(rows, target, size)
    return rows if cut is None else rows.where(F.col("seq") <= cut)


def tail(rows: DataFrame, least: int, size: str = "n_chars") -> DataFrame:
    """The last rows whose sizes reach least, and no more than it takes."""
    if least <= 0:
        return rows.where(F.lit(False))
    cut = budget_cut(rows, least, size, back=True)
    return rows if cut is None else rows.where(F.col("seq") >= cut)


def numbered(rows: DataFrame, name: str = "n", order: tuple[str, ...] = ("seq",)) -> DataFrame:
    """rows with their place in the order, from 0."""
    return sums_before(rows.withColumn("_one", F.lit(1)), list(order), "_one", name).drop("_one")


def every(rows: DataFrame, k: int) -> DataFrame:
    """Every k-th row and its place n. Only seq is numbered; the rows are joined to what is chosen."""
    chosen = materialize(numbered(rows.select("seq")).where(F.col("n") % k == 0).select(F.col("seq").alias("_s"), "n"), "every")
    return rows.join(chosen, rows["seq"] == F.col("_s")).drop("_s")


def bytes_per_char(rows: DataFrame) -> float:
    """UTF-8 bytes by character of all texts (exact, where a probe of the first bytes would be an
    estimate); 0 for none."""
    one = rows.agg(F.sum(F.octet_length("text")).alias("b"), F.sum(F.length("text")).alias("c")).first()
    return (one.b or 0) / max(one.c or 0, 1)


def estimate_chars(total_bytes: int, bytes_a_char: float) -> float:
    return total_bytes / bytes_a_char if bytes_a_char else 0.0


def every_within(rows: DataFrame, k: int, target: int, sized) -> DataFrame:
    """sized(every k-th of rows (seq, text)), which gives them n_chars, up to and with the row at
    which n_chars reach the target. The rows are numbered from the first on, so a beginning that
    is long enough gives the same ones: what is numbered and sized grows with the target."""
    guess = max(1, target) * k
    while True:
        cut = budget_cut(rows.select("seq", F.length("text").cast("long").alias("n_chars")), guess)
        part = materialize(sized(every(rows if cut is None else rows.where(F.col("seq") <= cut), k)), "every-within")
        if cut is None or (part.agg(F.sum("n_chars")).first()[0] or 0) >= target:
            return within_budget(part, target)
        guess *= 2


def line_stream(lines: DataFrame, every_n: int = 1, most_chars: int = 0) -> DataFrame:
    """Every n-th line (seq, text) in order, up to and with the one at which the characters reach
    most_chars (0: all)."""
    sized = lambda rows: rows.withColumn("n_chars", F.length("text").cast("long"))
    if every_n > 1 and most_chars:
        return every_within(lines, every_n, most_chars, sized).drop("n", "n_chars")
    taken = every(lines, every_n).drop("n") if every_n > 1 else lines
    return within_budget(sized(taken), most_chars).drop("n_chars") if most_chars else taken


def text_head(lines: DataFrame, size: int) -> DataFrame:
    """seq, text: the first characters of the lines joined by line ends; the last row is cut, and
    each row but the last of all has its line end counted."""
    head = within_budget(lines.withColumn("_size", F.length("text").cast("long") + 1), size, "_size")
    placed = sums_before(head, ["seq"], "_size", "_before")
    return placed.where(F.col("_before") < size).select("seq", F.substring(F.col("text"), F.lit(1), (F.lit(size) - F.col("_before")).cast("int")).alias("text"))


def subword_sample(docs: DataFrame, target_chars: int, every_n: int, least_bytes: int = 200, most_bytes: int = 6_000) -> DataFrame:
    """seq, n, line: the sentences of every n-th document, up to and with the document at which
    their characters reach the target; a line has no line end, and no space at its ends."""

    def sized(rows: DataFrame) -> DataFrame:
        parts = rows.select("seq", T.split_sentences(F.col("text"), least_bytes, most_bytes).alias("s"))
        return parts.withColumn("n_chars", F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + F.length(x)))

    kept = every_within(docs, every_n, target_chars, sized).select("seq", F.posexplode("s").alias("n", "line"))
    return kept.select("seq", "n", T.strip(F.replace(F.col("line"), F.lit("\n"), F.lit(" "))).alias("line"))


def stride_for(total_chars: float, target: int) -> int:
    return max(1, round(total_chars / target)) if target > 0 else 1


def split_validation(rows: DataFrame, every_n: int, most: int, size: str = "n_chars") -> DataFrame:
    """rows with validation true for every n-th row while the validation so far is below most."""
    n = numbered(rows)
    chosen = sums_before(n.where(F.col("n") % every_n == 0), ["seq"], size, "before").where(F.col("before") < most)
    return n.join(chosen.select(F.col("seq").alias("_v")), n["seq"] == F.col("_v"), "left").withColumn("validation", F.col("_v").isNotNull()).drop("_v", "n")


def shuffled(rows: DataFrame, seed: int, key: str = "seq") -> DataFrame:
    """A permutation that depends on seed and key alone: its place from 0 is position."""
    keyed = rows.withColumn("_mix", T.mixed(seed, F.col(key)))
    return numbered(keyed, "position", ("_mix", key)).drop("_mix")


#: Bits of the mixed key that one step of a selection counts by, and rows that end it.
STEP_BITS, FEW = 16, 10_000
MIX_BITS = 60


def among_first(rows: DataFrame, n: int, seed: int, key: str = "seq") -> Column:
    """Whether a row is among the first n of the permutation that shuffled() makes: a condition on
    mixed(seed, key) and key. The n-th smallest mixed key is found by counting rows by its leading
    bits, then those of the bucket it lies in by the next ones, until few rows are left: no row
    is sorted or moved. key is unique."""
    mix, shift, lo, hi = T.mixed(seed, F.col(key)), MIX_BITS, 0, (1 << MIX_BITS) - 1
    keyed, left = rows.select(mix.alias("m"), F.col(key).alias("k")), n
    if n <= 0:
        return F.lit(False)
    while True:
        inside = keyed.where(F.col("m").between(lo, hi))
        shift = max(0, shift - STEP_BITS)
        counts = sorted((r.b, r["count"]) for r in inside.groupBy(F.shiftright("m", shift).alias("b")).count().collect())  # at most 2^STEP_BITS
        for bucket, count in counts:
            if left <= count:
                break
            left -= count
        else:
            return F.lit(True)  # there are no more than n
        lo, hi = bucket << shift, (bucket + 1 << shift) - 1
        if left == count:
            return mix <= hi
        if count <= FEW or not shift:
            last = keyed.where(F.col("m").between(lo, hi)).orderBy("m", "k").limit(left).agg(F.max(F.struct("m", "k")).alias("x")).first().x
            return (mix < last.m) | ((mix == last.m) & (F.col(key) <= last.k))


def repeat(rows: DataFrame, ratio: float, seed: int) -> DataFrame:
    """int(ratio) whole copies, and a sample without replacement of the rest (half-even)."""
    if ratio <= 0:
        raise ValueError("the ratio must be positive")
    whole, rest = int(ratio), ratio - int(ratio)
    copies = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(whole)))) if whole else rows.withColumn("copy", F.lit(1)).where("false")
    n = round(rows.count() * rest)
    if not n:
        return copies
    return copies.unionByName(rows.where(among_first(rows, n, seed)).withColumn("copy", F.lit(whole + 1)))


def mix(parts: list[tuple[DataFrame, float]], seed: int) -> DataFrame:
    """The parts with their ratios, numbered by part."""
    out = None
    for n, (rows, ratio) in enumerate(parts):
        one = repeat(rows, ratio, seed + n).withColumn("part", F.lit(n))
        out = one if out is None else out.unionByName(one)
    return out


def fraction_split(rows: DataFrame, fraction: float, seed: int) -> DataFrame:
    """rows with validation true for the first max(1, int(n * fraction)) of a shuffle."""
    n = max(1, int(rows.count() * fraction))
    return rows.withColumn("validation", among_first(rows, n, seed))


def source_share(rows: DataFrame, size: str = "n_chars", source: str = "source") -> DataFrame:
    by = rows.groupBy(source).agg(F.count("*").alias("docs"), F.sum(size).alias("chars"))
    total = by.agg(F.sum("chars").alias("total"))  # one row
    return by.crossJoin(F.broadcast(total)).select(source, "docs", "chars", F.bround(F.col("chars") / F.greatest("total", F.lit(1)), 4).alias("share"))


def build(sources: list[tuple[str, DataFrame, int]], **rules) -> tuple[DataFrame, DataFrame]:
    """A corpus of several sources in rank order, each (name, docs with seq and text, target
    characters). A prefix is compared with those kept of earlier sources after their cut, and
    with all earlier ones of its own. Returns the corpus (source, seq, text, n_chars) and the
    rejections (source, reason, n), counted up to each source's last row.

    A source is cleaned in ranges of seq, each as wide as what was kept so far makes one expect,
    until its target is reached: what is read and cleaned grows with the budget."""
    corpus = rejected = None
    for name, docs, target in sources:
        ends = docs.agg(F.min("seq").alias("lo"), F.max("seq").alias("hi")).first()
        kept = lost = None
        total, at, width = 0, ends.lo, max(1, ((ends.hi or 0) - (ends.lo or 0) + 1) // FIRST_PART)
        while total < target and at is not None and at <= ends.hi:
            part = docs.where(F.col("seq").between(at, min(at + width - 1, ends.hi))).select("seq", "text")
            seen = [x.select(T.prefix_key(F.col("text")).alias("_p")) for x in (corpus, kept) if x is not None]
            judged = _judged(part, seen, **rules)
            passed = judged.where("reason is null")
            cut = budget_cut(passed, target - total)
            new = passed if cut is None else passed.where(F.col("seq") <= cut)
            new = materialize(new.select(F.lit(name).alias("source"), "seq", "text", "n_chars"), "corpus-kept")
            total += new.agg(F.sum("n_chars")).first()[0] or 0
            gone = judged.where("reason is not null") if cut is None else judged.where((F.col("seq") <= cut) & F.col("reason").isNotNull())
            gone = gone.groupBy(F.lit(name).alias("source"), "reason").agg(F.count("*").alias("n"))
            kept, lost = new if kept is None else kept.unionByName(new), gone if lost is None else lost.unionByName(gone)
            at += width
            expected = (target - total) * (at - ends.lo) // total + 1 if total > 0 else GROWTH * width
            width = min(max(expected * 9 // 8, 1), GROWTH * width)
        if kept is None:  # nothing is wanted, or there is nothing
            judged = _judged(docs.where(F.lit(False)).select("seq", "text"), [], **rules)
            kept = judged.select(F.lit(name).alias("source"), "seq", "text", "n_chars")
            lost = judged.groupBy(F.lit(name).alias("source"), "reason").agg(F.count("*").alias("n"))
        corpus = kept if corpus is None else corpus.unionByName(kept)
        rejected = lost if rejected is None else rejected.unionByName(lost)
    return corpus, rejected.groupBy("source", "reason").agg(F.sum("n").alias("n"))


def _judged(docs: DataFrame, seen: list[DataFrame], **rules) -> DataFrame:
    """docs (seq, text) cleaned and with their reasons, stored; seen: prefixes (_p) kept before."""
    screened = screen(docs, **rules)
    if seen:
        known = screened.withColumn("_k", T.prefix_key(F.col("text")))
        old = seen[0] if len(seen) == 1 else seen[0].unionByName(seen[1])
        screened = known.join(old.distinct(), F.col("_k") == F.col("_p"), "left").withColumn("reason", F.when(F.col("reason").isNull() & F.col("_p").isNotNull(), "duplicate").otherwise(F.col("reason"))).drop("_k", "_p")
    return materialize(reject_duplicates(screened).withColumn("n_chars", F.length("text").cast("long")), "corpus-judged")


def manifest(corpus: DataFrame, rejected: DataFrame) -> DataFrame:
    """One row: totals, a map of the sources by name, and a map of rejections."""
    entry = F.struct("source", F.struct("docs", "chars", "share").alias("s"))
    sources = source_share(corpus).agg(F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("sources"), F.coalesce(F.sum("chars"), F.lit(0)).alias("total_chars"), F.coalesce(F.sum("docs"), F.lit(0)).alias("total_documents"))
    reasons = rejected.groupBy("reason").agg(F.sum("n").alias("n")).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("reason", "n")))).alias("rejected"))
    return sources.crossJoin(reasons)
