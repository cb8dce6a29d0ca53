"""Conversations: pairing, filtering, loss masks and their summary."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import grams
from corpusloom.functions import text as T
from corpusloom.functions.chars import char_counts, holds_any
from corpusloom.operators.corpus import first_of
from corpusloom.operators.leak import MOST_SEEDS, SEED, shippable


def adjacent_pairs(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, turn (of the answer), q, a: each assistant turn after a user turn, among the user
    and assistant turns and the empty ones of any role; an empty turn breaks the pair. Texts
    are collapsed first."""
    rows = turns.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.col(role).alias("role"), T.collapse(F.coalesce(F.col(text), F.lit(""))).alias("text"))
    heard = rows.where(F.col("role").isin("user", "assistant") | (F.col("text") == ""))
    before = Window.partitionBy("conv_id").orderBy("turn")
    paired = heard.withColumn("r", F.lag("role").over(before)).withColumn("q", F.lag("text").over(before))
    return paired.where((F.col("role") == "assistant") & (F.col("text") != "") & (F.col("r") == "user") & (F.col("q") != "")).select("conv_id", "turn", "q", F.col("text").alias("a"))


def pairs_of_tree(messages: DataFrame) -> DataFrame:
    """Message trees (message_id, parent_id, role, text, flagged, seq): answers joined to their
    user parents; the last row of an id counts; flagged rows make no pair."""
    last = messages.groupBy("message_id").agg(F.max_by(F.struct("parent_id", "role", "text", "flagged"), "seq").alias("m"))
    one = last.select("message_id", "m.*")
    child = one.where((F.col("role") == "assistant") & ~F.coalesce("flagged", F.lit(False)))
    parent = one.where((F.col("role") == "user") & ~F.coalesce("flagged", F.lit(False))).select(F.col("message_id").alias("p"), F.col("text").alias("q"))
    return child.join(parent, child["parent_id"] == F.col("p")).select("message_id", "q", F.col("text").alias("a"))


def fitting(pairs: DataFrame, most_q: int = 100, least_a: int = 4, most_a: int = 300) -> DataFrame:
    return pairs.where((F.length("q") <= most_q) & F.length("a").between(least_a, most_a))


def distinct_pairs(pairs: DataFrame) -> DataFrame:
    """The first row (by seq) of each pair of texts."""
    return first_of(pairs, [F.col("q"), F.col("a")])


def rare_characters(pairs: DataFrame, least: int) -> DataFrame:
    """char, n of the characters that occur fewer than `least` times in all pairs."""
    return char_counts(pairs, "q", "a").where(F.col("n") < least)


def without_rare(pairs: DataFrame, least: int) -> DataFrame:
    """Pairs none of whose characters is rare; `least` of 1 or less keeps all."""
    if least <= 1:
        return pairs
    rare = holds_any(rare_characters(pairs, least))
    return pairs.where(~(rare(F.col("q")) | rare(F.col("a"))))


def without_exact(pairs: DataFrame, held: DataFrame) -> DataFrame:
    return pairs.join(held.select("q", "a").distinct(), ["q", "a"], "left_anti")


def fragment_test(holdout: DataFrame, size: int, most_seeds: int = MOST_SEEDS):
    """A function from a text column to whether it shares a window of `size` characters with a
    holdout text, tested where the text is read; None if the holdout's seeds are more than
    most_seeds. Any shared window holds one of the text's seeds that begin at multiples of
    size - SEED + 1; each meeting is grown to both sides."""
    stride = size - SEED + 1
    held = shippable(holdout.where(F.length("text") >= size).select("text").distinct(), "text", 1 << 30, most_seeds)
    if held is None:
        return None
    shipped = holdout.sparkSession.sparkContext.broadcast(held)  # of the size that shippable() allows

    @F.arrow_udf("boolean")
    def test(texts: pa.Array) -> pa.Array:
        seeds = grams.Seeds(shipped.value, SEED, None)
        out = [False] * len(texts)
        for at, part in grams.portions(texts.to_pylist()):
            for k, place, p, other in seeds.meetings(part, stride):
                out[at + k] = out[at + k] or grams.common(part[k], seeds.patterns[p], place, other, size)
        return pa.array(out)

    return test


def joined_fragments(texts: DataFrame, holdout: DataFrame, size: int, *keys: str) -> DataFrame:
    """The keys of the texts (keys, text) that share a window with a holdout text of any size, by
    two semi-joins: of a text's strided seeds with the holdout's distinct seeds, and of the
    windows around those that meet with its distinct windows. A seed that many texts hold
    multiplies nothing, and its rows may be split. The planner takes exploded windows to be no
    larger than the texts, so it is told to merge: they are never broadcast."""
    stride = size - SEED + 1
    held = holdout.where(F.length("text") >= size)
    own = lambda n: held.select(F.explode(T.windows(F.col("text"), n)).alias("w")).distinct().hint("merge")
    places = F.sequence(F.lit(0), F.length("text") - SEED, F.lit(stride))
    at = texts.where(F.length("text") >= size).select(*keys, F.explode(F.transform(places, lambda p: F.struct(F.substring("text", p + 1, F.lit(SEED)).alias("w"), F.substring("text", F.greatest(p - (stride - 1), F.lit(0)) + 1, F.least(p, F.lit(stride - 1)) + size).alias("around")))).alias("s")).select(*keys, "s.*")
    near = at.join(own(SEED), "w", "left_semi").select(*keys, F.explode(T.windows(F.col("around"), size)).alias("w"))
    return near.join(own(size), "w", "left_semi").select(*keys).distinct()


def seeds_shared(texts: DataFrame, holdout: DataFrame, size: int, most_seeds: int = MOST_SEEDS) -> DataFrame:
    """seq of the texts (seq, text) that share a window of `size` characters with a holdout text."""
    test = fragment_test(holdout, size, most_seeds)
    if test is None:
        return joined_fragments(texts, holdout, size, "seq")
    return texts.where(test(F.col("text"))).select("seq").distinct()


def without_fragments(pairs: DataFrame, held: DataFrame, size: int = 40, most_seeds: int = MOST_SEEDS) -> DataFrame:
    """Pairs (with seq) neither side of which shares a window with either side of a held pair."""
    sides = lambda d, *more: d.select(*more, F.explode(F.array("q", "a")).alias("text"))
    test = fragment_test(sides(held), size, most_seeds)
    if test is None:
        return pairs.join(joined_fragments(sides(pairs, "seq"), sides(held), size, "seq").hint("merge"), "seq", "left_anti")
    return pairs.where(~(test(F.col("q")) | test(F.col("a"))))


def summary(pairs: DataFrame) -> DataFrame:
    """One row: pairs, characters, distinct characters, mean lengths (1 digit, null if none)."""
    chars = char_counts(pairs, "q", "a").agg(F.count("*").alias("distinct_chars"))
    sums = pairs.agg(F.count("*").alias("pairs"), F.coalesce(F.sum(F.length("q") + F.length("a")), F.lit(0)).alias("chars"), F.bround(F.avg(F.length("q")), 1).alias("avg_q"), F.bround(F.avg(F.length("a")), 1).alias("avg_a"))
    return sums.crossJoin(chars)
