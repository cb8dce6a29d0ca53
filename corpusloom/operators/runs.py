"""Run logs, curves and evaluation records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.functions.ordered import Carry, scan
from corpusloom.operators.corpus import last_of

MOST_PROMPTS = 10_000
# Metrics, and whether less is better.
METRICS = {"bits_per_char": True, "repetition_rate": True, "topic_rate": False, "broken_rate": True}


def keep_last_run(points: DataFrame, *by: str) -> DataFrame:
    """points (line, step, ...) whose step is below every later one of their log (by): a log
    that began anew keeps its last run. A log of any length is scanned by ranges of its lines."""
    later = scan(points, ["line"], {"_m": Carry("min", "step", back=True)}, by)
    return later.where(F.col("_m").isNull() | (F.col("step") < F.col("_m"))).drop("_m")


def last_by_step(points: DataFrame) -> DataFrame:
    return last_of(points, [F.col("step")], "line")


def gaps(train: DataFrame, val: DataFrame, *by: str) -> DataFrame:
    """step, val, train (the train curve of the same run (by) interpolated at the step, its ends
    held), gap = val - train, for each point of val (step, value); null without a curve. Of several
    train points at a step the greatest counts. A run of any length is scanned by ranges."""
    point = F.when(F.col("value").isNotNull(), F.struct("step", F.col("value").alias("t")))
    both = train.select(*by, "step", F.lit(0).alias("_kind"), F.col("value").alias("v"), point.alias("_point")).union(val.select(*by, "step", F.lit(1), "value", F.lit(None)))
    # train points stand before those of val at the same step: the nearest one back may be at the step itself
    near = {"lo": Carry("near", "_point", own=True), "hi": Carry("near", "_point", back=True)}
    at = scan(both, ["step", "_kind", "v"], near, by).where("_kind = 1")
    part = (F.col("step") - F.col("lo.step")) / F.nullif(F.col("hi.step") - F.col("lo.step"), F.lit(0))
    line = F.when(F.col("lo").isNull(), F.col("hi.t")).when(F.col("hi").isNull() | (F.col("lo.step") == F.col("step")), F.col("lo.t")).otherwise(F.col("lo.t") + (F.col("hi.t") - F.col("lo.t")) * part)
    return at.select(*by, "step", F.col("v").alias("val"), line.alias("train"), (F.col("v") - line).alias("gap"))


def divergence_step(gap: DataFrame, *by: str) -> DataFrame:
    """The first step at which validation is above training; 0 if there is none."""
    return gap.groupBy(*by).agg(F.coalesce(F.min(F.when(F.col("gap") > 0, F.col("step"))), F.lit(0)).alias("divergence_step"))


def best_point(points: DataFrame, *by: str) -> DataFrame:
    """The least value, the first on a tie."""
    best = F.min(F.struct("value", "step"))
    return points.groupBy(*by).agg(best.alias("b")).select(*by, F.col("b.step").alias("best_step"), F.col("b.value").alias("best_value"))


def closest(rows: DataFrame, ratio: str = "d_over_n", to: float = 20.0) -> DataFrame:
    return rows.orderBy(F.abs(F.col(ratio) - to), "label").limit(1)


def usable_steps(shared: DataFrame, marks: DataFrame, interval: int, *by: str) -> DataFrame:
    """The steps with no mark m of their run (by) such that step - interval < m < step. Steps and
    marks meet by the interval they lie in, so it is an equi-join."""
    s, m = F.col("step"), F.col("mark")
    near = marks.select(*[F.col(x).alias(f"_{x}") for x in by], "mark", F.explode(F.array(F.floor(m / interval), F.floor(m / interval) + 1)).alias("_bin"))
    same = F.floor(s / interval) == F.col("_bin")
    for x in by:
        same = same & (F.col(x) == F.col(f"_{x}"))
    return shared.join(near, same & (m > s - interval) & (m < s), "left_anti")


def curve_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """step, diff on shared steps."""
    return a.select("step", F.col("value").alias("x")).join(b.select("step", F.col("value").alias("y")), "step").select("step", F.abs(F.col("x") - F.col("y")).alias("diff"))


def max_abs_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """The key (key, value rows) that differs most; an error if the keys differ."""
    both = a.select("key", F.col("value").alias("x")).join(b.select(F.col("key").alias("k"), F.col("value").alias("y")), F.col("key") == F.col("k"), "full_outer")
    checked = both.select(F.when(F.col("key").isNull() | F.col("k").isNull(), F.raise_error(F.lit("the keys differ"))).otherwise(F.col("key")).alias("key"), F.abs(F.col("x") - F.col("y")).alias("diff"))
    return checked.agg(F.max(F.struct("diff", "key")).alias("m")).select("m.key", "m.diff")


def interval_means(log: DataFrame, k: int) -> DataFrame:
    """Mean loss and throughput of each k steps: interval, loss, tok_per_sec."""
    return log.groupBy(F.floor((F.col("step") - 1) / k).alias("interval")).agg(F.avg("loss").alias("loss"), (F.sum("tokens") / F.sum("seconds")).alias("tok_per_sec"))


def pivot_scores(scores: DataFrame, domains: list[str]) -> DataFrame:
    """model × domain; a missing score is null."""
    return scores.groupBy("model").pivot("domain", domains).agg(F.first("bits_per_char"))


def lookup(rows: DataFrame, keys: dict[str, str], order: str) -> DataFrame:
    """The first row with the keys; an error if there is none."""
    for k, v in keys.items():
        rows = rows.where(F.col(k) == v)
    found = rows.orderBy(order).limit(1)
    if found.isEmpty():
        raise KeyError(keys)
    return found


def model_prompts(models: DataFrame, prompts: DataFrame) -> DataFrame:
    """Every model with every prompt. The prompts are broadcast; more than MOST_PROMPTS are an
    error, as this is meant for two short lists."""
    if prompts.limit(MOST_PROMPTS + 1).count() > MOST_PROMPTS:
        raise ValueError(f"more than {MOST_PROMPTS} prompts")
    return models.crossJoin(F.broadcast(prompts))


def comparison(now: DataFrame, before: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """metric, now, before, delta, verdict, cost (a worsening is positive) of rows (metric, value)."""
    lower = F.element_at(F.create_map(*[F.lit(x) for kv in METRICS.items() for x in kv]), F.col("metric"))
    both = now.select("metric", F.col("value").alias("now")).join(before.select("metric", F.col("value").alias("before")), "metric", "left")
    delta = F.col("now") - F.col("before")
    verdict = F.when(delta.isNull(), None).when(F.abs(delta) < tolerance, "unchanged").when((delta < 0) == lower, "improved").otherwise("worsened")
    return both.select("metric", "now", "before", delta.alias("delta"), verdict.alias("verdict"), F.when(lower, delta).otherwise(-delta).alias("cost"))


def reply_flags(replies: DataFrame) -> DataFrame:
    """replies (text, truncated, keywords) with repetition, broken and keyword_hit (null without
    keywords)."""
    hit = F.when(F.size("keywords") > 0, F.exists("keywords", lambda k: F.contains(F.col("text"), k)))
    return replies.withColumns({"repetition": T.has_repetition(F.col("text")), "broken": T.is_broken_reply(F.col("text"), F.col("truncated")), "keyword_hit": hit})


def reply_rates(flagged: DataFrame) -> DataFrame:
    rate = lambda c: F.avg(F.col(c).cast("int"))
    return flagged.agg(rate("repetition").alias("repetition_rate"), rate("broken").alias("broken_rate"), rate("keyword_hit").alias("topic_rate"), F.avg(F.length("text")).alias("avg_reply_len"))


def scaling_verdict(runs: DataFrame) -> DataFrame:
    """runs (place, divergence_step) in order: none (all later are 0), later (each is 0 or after
    the one before, the first not 0) or unordered. A list of runs is one window."""
    w = Window.orderBy("place")
    d = F.col("divergence_step")
    pairs = runs.withColumn("p", F.lag(d).over(w)).withColumn("f", F.first(d).over(w))
    judged = pairs.agg(F.bool_and(F.when(F.col("p").isNotNull(), d == 0)).alias("all_zero"), F.bool_and(F.when(F.col("p").isNotNull(), (d == 0) | (d > F.col("p")))).alias("rising"), F.max("f").alias("first"))
    return judged.select(F.when(F.coalesce("all_zero", F.lit(True)), "none").when((F.col("first") > 0) & F.col("rising"), "later").otherwise("unordered").alias("verdict"))


def run_table(train: DataFrame, val: DataFrame) -> DataFrame:
    """run, final_train, best_step, best_value and divergence_step (0: none) of curves (run, step,
    value)."""
    final = train.groupBy("run").agg(F.max_by("value", "step").alias("final_train"))
    onset = divergence_step(gaps(train, val, "run"), "run")
    return final.join(best_point(val, "run"), "run").join(onset, "run")


def key_sets(a: DataFrame, b: DataFrame, key: str = "key") -> DataFrame:
    """key, side of the distinct keys: both, left or right."""
    x, y = a.select(F.col(key).alias("_x")).distinct(), b.select(F.col(key).alias("_y")).distinct()
    side = F.when(F.col("_y").isNull(), "left").when(F.col("_x").isNull(), "right").otherwise("both")
    return x.where("_x is not null").join(y.where("_y is not null"), F.col("_x") == F.col("_y"), "full_outer").select(F.coalesce("_x", "_y").alias(key), side.alias("side"))


def distinct_in_order(rows: DataFrame, value: str) -> DataFrame:
    return rows.groupBy(value).agg(F.min("seq").alias("first_seq"))


def budget(tok_per_sec: Column, seconds: float, tokens_per_step: Column, params: Column) -> dict[str, Column]:
    """tokens_in_budget, steps_in_budget and d_over_n for a time budget; counts truncate."""
    tokens = (tok_per_sec * seconds).cast("long")
    return {"tokens_in_budget": tokens, "steps_in_budget": F.floor(tokens / tokens_per_step).cast("long"), "d_over_n": tokens / params}


def epochs(steps: Column, batch: int, block: int, tokens: Column) -> Column:
    return steps * (batch * block) / tokens
