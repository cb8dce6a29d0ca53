"""Scans with a carry over a total order, without a single-partition window.

Rows are dealt by ranges of (by, order) and stored. Each range is scanned on its own by a
window; one row a range and key then carries what stands before (or after) the range into
it. A key that spans ranges begins at the first or ends at the last row of each of them, so
at most one key of a range takes a carry from either side: the carries are no more rows than
ranges, and are broadcast. A run of any length is thereby shared by as many tasks as it has
ranges, and no task holds more than one range.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.sources.storage import materialize, stored_bytes

#: A range has not much over so many rows, or bytes (of a stored table: as stored).
ROWS_A_RANGE, BYTES_A_RANGE = 4_000_000, 32 << 20


@dataclass(frozen=True)
class Carry:
    """What a row is given of the rows before it in the order (back: after it), with its own
    value if own: their sum (0 for none), min or max, or near, the nearest value that is not
    null. value may be a struct for near."""

    how: str
    value: str
    back: bool = False
    own: bool = False


def _within(c: Carry, v: Column) -> Column:
    return {"sum": F.sum, "min": F.min, "max": F.max, "near": lambda x: F.last(x, ignorenulls=True)}[c.how](v)


def _whole(c: Carry, order: list[str]) -> Column:
    """The value of all rows of a range for those beyond it."""
    v = F.col(c.value)
    if c.how == "near":
        at = F.when(v.isNotNull(), F.struct(*order))
        return F.min_by(v, at) if c.back else F.max_by(v, at)
    return _within(c, v)


def _joined(c: Carry, here: Column, carried: Column) -> Column:
    if c.how == "sum":
        return F.coalesce(here, F.lit(0)) + F.coalesce(carried, F.lit(0))
    return {"min": F.least, "max": F.greatest, "near": F.coalesce}[c.how](here, carried)


def n_ranges(rows: int, spark, size: int = 0) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS_A_RANGE), -(-size // BYTES_A_RANGE))


def parts_by_size(rows: DataFrame, *columns: str, least: int = 1) -> int:
    """So many partitions that none has much over BYTES_A_RANGE bytes of the columns' texts."""
    size = rows.agg(sum(F.coalesce(F.sum(F.octet_length(c)), F.lit(0)) for c in columns)).first()[0]
    return max(least, -(-size // BYTES_A_RANGE))


def scan(df: DataFrame, order: list[str], carries: dict[str, Carry], by: tuple[str, ...] = (), partitions: int | None = None) -> DataFrame:
    """df with a column for each carry, over the rows of its own key (by; null is a key). The
    order is unique within a key; where it is not, equal rows stand in any order.

    The rows are stored and counted first, unless partitions says how many ranges to take."""
    spark, by = df.sparkSession, list(by)
    n = partitions
    if n is None:
        df = materialize(df, "unordered")
        n = n_ranges(df.count(), spark, stored_bytes(df))
    ranged = materialize(df.repartitionByRange(n, *by, *order).withColumn("_range", F.spark_partition_id()), "ordered")
    wholes = ranged.groupBy("_range", *by).agg(*[_whole(c, order).alias(f"_whole_{name}") for name, c in carries.items()])
    beyond = []
    for name, c in carries.items():
        ranges = Window.partitionBy(*by).orderBy(F.desc("_range") if c.back else F.asc("_range")).rowsBetween(Window.unboundedPreceding, -1)
        beyond.append(_within(c, F.col(f"_whole_{name}")).over(ranges).alias(f"_beyond_{name}"))
    spans = F.count("*").over(Window.partitionBy(*by)) > 1
    carried = wholes.select("_range", *by, spans.alias("_spans"), *beyond).where("_spans").select(F.col("_range").alias("_r"), *[F.col(b).alias(f"_by_{b}") for b in by], *[f"_beyond_{x}" for x in carries])
    carried = materialize(carried, "carries")  # one row for each range that a key reaches into
    same = reduce(lambda a, b: a & b, [F.col("_range") == F.col("_r"), *[F.col(b).eqNullSafe(F.col(f"_by_{b}")) for b in by]])
    met = ranged.join(F.broadcast(carried), same, "left")
    for name, c in carries.items():
        way = [F.desc(x) if c.back else F.asc(x) for x in order]
        rows = Window.partitionBy("_range", *by).orderBy(*way).rowsBetween(Window.unboundedPreceding, 0 if c.own else -1)
        met = met.withColumn(name, _joined(c, _within(c, F.col(c.value)).over(rows), F.col(f"_beyond_{name}")))
    return met.select(*df.columns, *carries)


def sums_before(df: DataFrame, order: list[str], value: str, out: str, partitions: int | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """df with the sum of value over all rows before each row in the order (a unique one), of its
    own key if by names one."""
    return scan(df, order, {out: Carry("sum", value)}, by, partitions).withColumn(out, F.col(out).cast("long"))
