"""Arrow batches whose rows, and the bytes handled at a time, are bounded."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

BATCH_ROWS = 1000
#: Bytes that a value of a list counts for.
ITEM = 16


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of BATCH_ROWS rows, where the session has Spark's default of 10,000: a batch of
    so many long texts takes hundreds of megabytes beside the heap of an executor."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(BATCH_ROWS))


def portions(batch: pa.RecordBatch, column: str, size: int = 2 << 20):
    """Slices of a batch, in order, of about so many bytes of a column of texts or lists, so that
    the Python objects made from them at one time are bounded; a longer value is a slice of its own."""
    import pyarrow.compute as pc

    if not batch.num_rows:
        return
    values = batch.column(column)
    lengths, each = (pc.list_value_length(values), ITEM) if pa.types.is_list(values.type) else (pc.binary_length(values), 1)
    ends = np.cumsum(pc.fill_null(lengths, 0).to_numpy(zero_copy_only=False).astype(np.int64) * each + 64)
    at = 0
    while at < batch.num_rows:
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right")))
        yield batch.slice(at, stop - at)
        at = stop
    pa.default_memory_pool().release_unused()  # so that a worker does not keep what its largest batch took
