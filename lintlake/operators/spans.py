"""Byte spans of files: unions, gaps, tilings and what contains what."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def merged(spans: DataFrame) -> DataFrame:
    """The union of a file's spans; touching ones become one, empty ones vanish."""
    by_start = W.partitionBy("file_id").orderBy("start_byte", "end_byte", "seq")
    rows = spans.where("end_byte > start_byte").withColumn(
        "reach", F.max("end_byte").over(by_start.rowsBetween(W.unboundedPreceding, -1))
    )
    opens = F.when(F.col("reach").isNull() | (F.col("start_byte") > F.col("reach")), 1).otherwise(0)
    rows = rows.withColumn("island", F.sum(opens).over(by_start.rowsBetween(W.unboundedPreceding, 0)))
    return rows.groupBy("file_id", "island").agg(F.min("start_byte").alias("start_byte"), F.max("end_byte").alias("end_byte")).drop("island")


def tiling_problems(spans: DataFrame, files: DataFrame) -> DataFrame:
    """Bytes of a file (file_id, size) that not exactly one span claims: file_id, problem, start, end."""
    by_start = W.partitionBy("file_id").orderBy("start_byte", "end_byte", "seq")
    at = F.coalesce(F.max("end_byte").over(by_start.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = spans.withColumn("cursor", F.greatest(at, F.lit(0)))
    inner = rows.where("start_byte <> cursor").select(
        "file_id",
        F.when(F.col("start_byte") > F.col("cursor"), "gap").otherwise("overlap").alias("problem"),
        F.least("start_byte", "cursor").alias("p_start"),
        F.when(F.col("start_byte") > F.col("cursor"), F.col("start_byte"))
        .otherwise(F.least("cursor", "end_byte")).alias("p_end"),
    )
    ends = files.join(spans.groupBy("file_id").agg(F.max("end_byte").alias("cursor")), "file_id", "left")
    ends = ends.withColumn("cursor", F.greatest(F.coalesce("cursor", F.lit(0)), F.lit(0))).where("cursor <> size")
    tail = ends.select(
        "file_id",
        F.when(F.col("cursor") < F.col("size"), "gap").otherwise("overlap").alias("problem"),
        F.least("cursor", "size").alias("p_start"),
        F.greatest("cursor", "size").alias("p_end"),
    )
    return inner.unionByName(tail)


def containing_arms(points: DataFrame, arms: DataFrame) -> DataFrame:
    """For each point (file_id, offset) the labels of the arms around it, in the arms' order.

    The file is an equality key, so the range test is a residual of a hash or merge join.
    """
    inside = (points["file_id"] == arms["file_id"]) & (arms["start_byte"] <= points["offset"]) & (points["offset"] < arms["end_byte"])
    found = points.join(arms.select("file_id", "start_byte", "end_byte", "seq", "label"), inside, "left").select(
        points["file_id"], points["offset"], "seq", "label"
    )
    ordered = F.array_sort(F.collect_list(F.when(F.col("seq").isNotNull(), F.struct("seq", "label"))))
    return found.groupBy("file_id", "offset").agg(ordered.alias("l")).select(
        "file_id", "offset", F.array_join(F.col("l.label"), " && ").alias("condition")
    )


def overlapped(units: DataFrame, dead: DataFrame) -> DataFrame:
    """C11: units with whether any dead span of their file overlaps them."""
    d = dead.select(F.col("file_id").alias("f"), F.col("start_byte").alias("s"), F.col("end_byte").alias("e"))
    hit = units.join(
        d, (F.col("file_id") == F.col("f")) & (F.col("start_byte") < F.col("e")) & (F.col("s") < F.col("end_byte")), "left_semi"
    )
    marked = hit.select("file_id", "seq").distinct().withColumn("dead", F.lit(True))
    return units.join(marked, ["file_id", "seq"], "left").withColumn("dead", F.coalesce("dead", F.lit(False)))


def claimed(extents: DataFrame) -> DataFrame:
    """A file's function extents in order, without those that overlap an accepted one or leave the file.

    ``extents`` has file_id, size, start_byte, end_byte, seq. A file's extents are folded together.
    """
    items = F.array_sort(F.collect_list(F.struct("start_byte", "end_byte", "seq")))
    start = F.struct(
        F.lit(0).cast("long").alias("cursor"),
        F.array().cast("array<struct<kind:string,start_byte:bigint,end_byte:bigint>>").alias("out"),
    )

    def tile(kind: str, a: Column, b: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), a.cast("long").alias("start_byte"), b.cast("long").alias("end_byte"))

    def step(acc: Column, x: Column) -> Column:
        s, e = x["start_byte"], x["end_byte"]
        gap = F.when(s > acc["cursor"], F.array(tile("module-scope", acc["cursor"], s))).otherwise(F.array().cast("array<struct<kind:string,start_byte:bigint,end_byte:bigint>>"))
        ok = (s >= acc["cursor"]) & (e <= F.col("size")) & (e > s)
        return F.when(
            ok, F.struct(e.cast("long").alias("cursor"), F.concat(acc["out"], gap, F.array(tile("function", s, e))).alias("out"))
        ).otherwise(acc)

    def close(acc: Column) -> Column:
        rest = F.array(tile("module-scope", acc["cursor"], F.col("size")))
        return F.when(F.col("size") > acc["cursor"], F.concat(acc["out"], rest)).otherwise(acc["out"])

    files = extents.groupBy("file_id", "size").agg(items.alias("items"))
    return files.select("file_id", F.inline(F.aggregate("items", start, step, close)))


def chunks(text: Column, most: int) -> Column:
    """Ends of the pieces of ``text`` of at most ``most`` characters, cut after the last line feed that fits.

    Two neighbouring pieces together are longer than ``most``, which bounds the number of steps.
    """
    steps = F.sequence(F.lit(1), (F.ceil(F.length(text) * 2 / most) + 1).cast("int"))

    def step(ends: Column, _: Column) -> Column:
        at = F.element_at(ends, -1)
        rest = F.length(text) - at
        window = F.substring(text, at + 1, F.lit(most))
        last = F.length(window) - F.locate("\n", F.reverse(window)) + 1
        cut = F.when(F.contains(window, F.lit("\n")) & (last > 1), last).otherwise(most)
        return F.when(rest <= 0, ends).otherwise(
            F.concat(ends, F.array(F.when(rest <= most, F.length(text)).otherwise(at + cut)))
        )

    return F.aggregate(steps, F.array(F.lit(0)), step)
