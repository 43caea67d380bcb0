"""Positions and running values in a total order, without one task per run.

Rows are dealt by ranges of (group, order), so a run of any size is spread over many tasks; each range
is numbered by itself, and what lies before it comes from a small table with a row per group and range.
Ranges are written once, as Spark samples their bounds anew each time they are worked out.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Largest table, in rows, that is sent to every executor.
BROADCAST_ROWS = 200_000


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only where none is set, in local mode."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="lintlake-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def keep(df: DataFrame, label: str, codec: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and return a reader of what was written."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ranges(rows: DataFrame, group: str, order: list[Column]) -> DataFrame:
    """``rows`` with range_no and range_seq: ranges of (group, order), and the place in that order within a range."""
    dealt = rows.repartitionByRange(F.col(group), *order).sortWithinPartitions(F.col(group), *order)
    place = F.monotonically_increasing_id()
    numbered = dealt.select("*", F.shiftright(place, 33).cast("int").alias("range_no"), place.alias("range_seq"))
    return keep(numbered, "ranges")


def _with_carry(rows: DataFrame, group: str, sums: Column, carry) -> DataFrame:
    """``rows`` beside ``carry`` (over the ranges of a group before a row's own) of the ranges' ``sums``."""
    before = W.partitionBy(group).orderBy("range_no").rowsBetween(W.unboundedPreceding, -1)
    totals = rows.groupBy(group, "range_no").agg(sums.alias("range_sum"))
    totals = totals.withColumn("carry", carry(F.col("range_sum")).over(before)).drop("range_sum")
    few = totals.count() <= BROADCAST_ROWS
    return rows.join(F.broadcast(totals) if few else totals, [group, "range_no"], "left")


def positions(rows: DataFrame, group: str, order: list[Column], name: str) -> DataFrame:
    """``rows`` with their place, from 1, in the total order of their group."""
    dealt = ranges(rows, group, order)
    first = F.struct(F.min("range_seq").alias("least"), F.count(F.lit(1)).alias("n"))
    firsts = dealt.groupBy(group, "range_no").agg(first.alias("f"))
    before = W.partitionBy(group).orderBy("range_no").rowsBetween(W.unboundedPreceding, -1)
    starts = firsts.select(group, "range_no", "f.least", F.coalesce(F.sum("f.n").over(before), F.lit(0)).alias("before"))
    few = starts.count() <= BROADCAST_ROWS
    out = dealt.join(F.broadcast(starts) if few else starts, [group, "range_no"])
    place = F.col("before") + F.col("range_seq") - F.col("least") + 1
    return out.select(*rows.columns, place.cast("long").alias(name))


def running_max(rows: DataFrame, group: str, order: list[Column], value: str, name: str) -> DataFrame:
    """``rows`` with the greatest ``value`` of their group up to and with each of them, in order; nulls say nothing."""
    dealt = _with_carry(ranges(rows, group, order), group, F.max(value), F.max)
    own = F.max(value).over(W.partitionBy(group, "range_no").orderBy("range_seq").rowsBetween(W.unboundedPreceding, 0))
    return dealt.select(*rows.columns, F.greatest(own, F.col("carry")).alias(name))


def running_sum(rows: DataFrame, group: str, order: list[Column], value: str, name: str) -> DataFrame:
    """``rows`` with the sum of ``value`` over the rows of their group before each of them, in order."""
    dealt = _with_carry(ranges(rows, group, order), group, F.sum(value), F.sum)
    before = W.partitionBy(group, "range_no").orderBy("range_seq").rowsBetween(W.unboundedPreceding, -1)
    none = F.lit(0).cast(dict(rows.dtypes)[value])
    total = F.coalesce(F.sum(value).over(before), none) + F.coalesce("carry", none)
    return dealt.select(*rows.columns, total.alias(name))
