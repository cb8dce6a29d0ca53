"""Rules over growing tables with keyed state: nothing that came before is read again.

The state of a key lives in Spark's state store, under the query's checkpoint, with the source's
offsets: a query that was stopped, or whose executors were lost, goes on where it was, and ends
with what a batch over all rows gives. The state store is RocksDB, which keeps state on disk.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CURVE = "run string, points long, best_step long, best_value double, first_step long, last_step long, lines long"


class _FirstWins(StatefulProcessor):
    """Gives the first row of a key, once."""

    def __init__(self, columns: list[str]):
        self.columns = columns

    def init(self, handle) -> None:
        self.seen = handle.getValueState("seen", "seq long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for part in rows:  # a key's rows of a batch come in parts
            low = part.loc[part["seq"].idxmin() :].head(1)
            first = low if first is None or low["seq"].iloc[0] < first["seq"].iloc[0] else first
        if first is not None and not self.seen.exists():
            self.seen.update((int(first["seq"].iloc[0]),))
            yield first[self.columns]

    def close(self) -> None:
        pass


def first_wins(rows: DataFrame, key) -> DataFrame:
    """The rows (seq, ...) of a stream whose key none before had; of a batch's rows of one key that
    of the least seq. Where files come in the order of seq, these are the rows that first_of()
    keeps of all. A key's state is one number; rows of one key in a batch are one group, taken
    in parts."""
    schema = rows.schema
    return rows.withColumn("_key", key).groupBy("_key").transformWithStateInPandas(_FirstWins(rows.columns), schema, "Append", "None")


class _LastRun(StatefulProcessor):
    """Keeps the points of a log whose step is below every later one's, as a stack."""

    def init(self, handle) -> None:
        self.kept = handle.getValueState("kept", "steps array<long>, values array<double>, lines long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        steps, values, lines = self.kept.get() if self.kept.exists() else ([], [], 0)
        steps, values = list(steps), list(values)
        new = sorted((int(n), int(s), None if pd.isna(v) else float(v)) for part in rows for n, s, v in zip(part["line"], part["step"], part["value"]))
        for _, step, value in new:
            while steps and steps[-1] >= step:
                steps.pop()
                values.pop()
            steps.append(step)
            values.append(value)
        lines += len(new)
        self.kept.update((steps, values, lines))
        best = min(((v, s) for s, v in zip(steps, values) if v is not None), default=(None, None))
        yield pd.DataFrame({"run": [key[0]], "points": [len(steps)], "best_step": pd.array([best[1]], "Int64"), "best_value": [best[0]], "first_step": [steps[0]], "last_step": [steps[-1]], "lines": [lines]})

    def close(self) -> None:
        pass


def last_runs(points: DataFrame) -> DataFrame:
    """For each run of a stream (run, line, step, value) that has new lines: how many points its
    last run keeps (those of keep_last_run()), the best of them (the first on a tie), their first
    and last step, and the lines so far. Lines come in order between batches. The state of a run
    is its kept points, at most one for each step."""
    return points.select("run", "line", "step", "value").groupBy("run").transformWithStateInPandas(_LastRun(), CURVE, "Update", "None")


def drain(rows: DataFrame, mode: str, checkpoint: str, take: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Call take(rows of a batch, batch) for all that is there, and end; the checkpoint makes the
    next call go on from there. take may see a batch again after a failure."""
    conf, key = rows.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(key, None)
    conf.set(key, PROVIDER)
    try:  # a query keeps the settings it was started with
        return rows.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(take).trigger(availableNow=True).start()
    finally:
        if before is None:
            conf.unset(key)
        else:
            conf.set(key, before)


def keep_batches(path: str) -> Callable[[DataFrame, int], None]:
    """A take() that keeps each batch in a folder of its own, so that a repeated one replaces itself."""

    def take(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={n}")

    return take


def latest(spark: SparkSession, path: str, key: str) -> DataFrame:
    """The row of the last batch for each key of what keep_batches() wrote."""
    rows = spark.read.parquet(path)
    return rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in (key, "batch")]), "batch").alias("r")).select(key, "r.*")
