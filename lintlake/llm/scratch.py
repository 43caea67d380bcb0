"""Tables that cut lineage, kept in the folder that driver and executors share."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest table, in bytes, that an operator here sends to every executor.
BROADCAST_BYTES = 32 << 20
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only where none is set, in local mode."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="lintlake-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def keep(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and return a reader of what was written."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of finished tables now, not when the driver next collects garbage."""
    for _ in range(2):  # the first round frees what Python holds of the driver's objects, the second these
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.5)


def broadcast_if_small(df: DataFrame, row_bytes: int, rows: int | None = None) -> DataFrame:
    """Hint a broadcast when ``rows * row_bytes`` is within bounds, else leave the join to Catalyst."""
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n * row_bytes <= BROADCAST_BYTES else df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def small_batches(spark: SparkSession) -> None:
    """Lower the default size of Arrow batches: operators on long texts hold several arrays per byte of a batch.

    It stays lowered, as the operators' tables are read after they return; a size that the user has set is kept.
    """
    if spark.conf.get(BATCH_BYTES) in ("67108864b", "67108864", "64m", "64MB"):
        spark.conf.set(BATCH_BYTES, "8m")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def crc_mod(column: str, modulus: int) -> Column:
    """crc32 of the column as text, modulo ``modulus``; a null counts as the text ``""``."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % F.lit(modulus)


class Plain:
    """A table's columns under names that clash with nothing, and the way back.

    ``df`` has the columns named in ``used`` as they are and all others as ``given<i>``.
    """

    def __init__(self, table: DataFrame, *used: str):
        self.columns = table.columns
        self.names = [c if c in used else f"given{i}" for i, c in enumerate(self.columns)]
        self.df = table.toDF(*self.names)

    def restored(self, df: DataFrame) -> DataFrame:
        """The table's own columns of ``df``, named and ordered as they were."""
        return df.select(*[F.col(n).alias(c) for n, c in zip(self.names, self.columns, strict=True)])
