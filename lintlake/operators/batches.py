"""Arrow batches of bounded size for operators whose Python holds several objects per byte of a batch."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession

BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
#: The largest batch that is sent to a worker, and what it turns into Python objects at a time.
MOST_BATCH, MOST_SLICE = 8 << 20, 1 << 20


def small_batches(spark: SparkSession) -> None:
    """Lower the default size of Arrow batches for the session, as tables are read after they return; a size that is set stays."""
    if spark.conf.get(BATCH_BYTES) in ("67108864b", "67108864", "64m", "64MB"):
        spark.conf.set(BATCH_BYTES, str(MOST_BATCH))


def slices(batch: pa.RecordBatch, most: int = MOST_SLICE) -> Iterator[pa.RecordBatch]:
    """A batch in parts of about ``most`` bytes, halved until they fit; a row is never cut."""
    if batch.num_rows < 2 or batch.nbytes <= most:
        yield batch
        return
    half = batch.num_rows // 2
    yield from slices(batch.slice(0, half), most)
    yield from slices(batch.slice(half), most)
