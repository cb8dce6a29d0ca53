"""Character statistics by vectors over code points.

A task adds up one vector of all code points and gives a row for each character that it has
seen, so what is shuffled is bounded by tasks and distinct characters, whatever the texts' size.
A set of characters is a table of one byte a code point, which bounds what is broadcast.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.batches import bounded_batches
from corpusloom.functions.grams import codes_of, portions

CODE_POINTS = 0x110000


def char_counts(texts: DataFrame, *columns: str) -> DataFrame:
    """char, n over all texts of the columns; a null text has none."""

    def run(batches):
        seen = np.zeros(CODE_POINTS, np.int64)
        for batch in batches:
            for column in batch.columns:
                for _, part in portions(column.to_pylist()):
                    found = np.bincount(codes_of(part)[0])
                    seen[: len(found)] += found
        held = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(list(map(chr, held.tolist())), pa.string()), pa.array(seen[held])], ["char", "n"])

    bounded_batches(texts.sparkSession)
    return texts.select(*columns).mapInArrow(run, "char string, n long").groupBy("char").agg(F.sum("n").alias("n"))


def holds_any(chars: DataFrame):
    """A function from a text column to whether it holds one of the characters (char)."""
    held = np.zeros(CODE_POINTS, bool)
    rows = chars.select(F.ascii("char").alias("c")).toArrow()  # a row a code point at most
    held[rows.column("c").to_numpy()] = True
    shipped = chars.sparkSession.sparkContext.broadcast(np.packbits(held))

    @F.arrow_udf("boolean")
    def test(texts: pa.Array) -> pa.Array:
        table, out = np.unpackbits(shipped.value).astype(bool), []
        for _, part in portions(texts.to_pylist()):
            codes, lengths = codes_of(part)
            found = np.concatenate(([0], np.cumsum(table[codes])))
            ends = np.cumsum(lengths)
            out.append(found[ends] > found[ends - lengths])
        return pa.array(np.concatenate([np.zeros(0, bool), *out]))

    def flag(text: Column) -> Column:
        return test(text)

    return flag
