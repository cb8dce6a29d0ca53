"""Streams over growing logs: heartbeats, staleness and curves by micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusloom.functions.text import finite
from corpusloom.sources.storage import replace

STALE_SECONDS = 180
THROTTLE = "30 seconds"


def status(finished: Column, updated_at: Column, now: Column) -> Column:
    """finished, stale (no update for more than STALE_SECONDS) or running."""
    return F.when(finished, "finished").when(now - updated_at > STALE_SECONDS, "stale").otherwise("running")


def heartbeat(points: DataFrame) -> DataFrame:
    """The last state of each run of a (streaming or batch) log: run, step, loss (null unless
    finite), updated_at."""
    last = points.groupBy("run").agg(F.max_by(F.struct("step", "loss", "updated_at"), "step").alias("s"))
    return last.select("run", "s.step", finite(F.col("s.loss")).alias("loss"), "s.updated_at")


def write_heartbeats(points: DataFrame, path: str, checkpoint: str, throttle: str | None = THROTTLE) -> StreamingQuery:
    """Keep the last states at path, written anew at most every throttle; without one, all that
    is there is taken and the query ends. The checkpoint makes it go on where it stopped. A new
    state is written beside the old one and put in its place, so a reader sees a whole one."""

    def put(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").json(f"{path}.new")
        replace(batch.sparkSession, f"{path}.new", path)

    writer = heartbeat(points).writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(put)
    return (writer.trigger(processingTime=throttle) if throttle else writer.trigger(availableNow=True)).start()


def follow(spark: SparkSession, folder: str, schema: str, checkpoint: str, on_log: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Call on_log(the whole log so far, batch) whenever Parquet files come into the folder, for
    rules such as keep-last-run that need all of a log."""

    def batch(_: DataFrame, n: int) -> None:
        on_log(spark.read.schema(schema).parquet(folder), n)

    stream = spark.readStream.schema(schema).parquet(folder)
    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(batch).trigger(availableNow=True).start()


def run_while_advancing(run: Callable[[], None], step: Callable[[], int], most: int = 20) -> None:
    """Call run() again after it failed, `most` times in all, as long as step() has advanced since
    it began; a failure without an advance, or the last, is raised."""
    for left in reversed(range(most)):
        before = step()
        try:
            return run()
        except Exception:
            if not left or step() <= before:
                raise


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """An extension: counts and sums of events (ts, event_type, value) by time window, with a
    watermark for late rows."""
    by = F.window("ts", width)
    return events.withWatermark("ts", late).groupBy(by, "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")
