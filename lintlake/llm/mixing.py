"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source gets the same fractional number of copies, target / source size. The whole
part is taken as it is. The fractional parts are rounded dependently: two documents exchange mass,
measured in words, in a random direction until one of them is integral; the other one carries on to
meet the next. Blocks of bounded size do this in parallel and leave one residual each; residuals meet
in a reduction tree until a source has one left, so a source's words miss its target by less than one
document. Expected copies are kept, and all randomness comes from a seed and the documents' keys.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lintlake.llm.scratch import Plain, broadcast_if_small, documents, keep, text_or_empty

WEIGHTS = (5.0, 2.0, 1.0)
EPOCHS = 1.5
MOST_COPIES = 2
BLOCK_ROWS = 2048
FAN_IN = 64
SCHEMA = (
    "doc_id long, locator long, source string, size long, source_size long, target double,"
    " whole int, part double, block long, open boolean"
)


def word_count() -> Column:
    return F.regexp_count(text_or_empty(), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def source_targets(
    sizes: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    epochs: float = EPOCHS,
    most: int = MOST_COPIES,
) -> DataFrame:
    """source, source_size, n_docs, target: the budget shared by weight under a cap of ``most`` sizes.

    Sources are full in the order of cap / weight, so running sums over that order give the level at
    which the first open source, and with it every later one, stands.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    place = F.row_number().over(W.orderBy(F.asc_nulls_last("source"))) - 1
    cycle = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int"))
    shares = totals.withColumn("weight", cycle).withColumn("cap", F.col("source_size") * float(most))
    by_level = W.orderBy(F.col("cap") / F.col("weight"), F.asc_nulls_last("source"))
    before = F.coalesce(F.sum("cap").over(by_level.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(by_level.rowsBetween(0, W.unboundedFollowing))
    whole = W.partitionBy(F.lit(1))
    shares = shares.withColumn("level", (F.sum("source_size").over(whole) * epochs - before) / rest)
    shares = shares.withColumn("full", F.col("cap") <= F.col("level") * F.col("weight"))
    level = F.max(F.when(~F.col("full"), F.col("level"))).over(whole)
    return shares.select(
        "source",
        "source_size",
        "n_docs",
        F.when(F.col("full"), F.col("cap")).otherwise(level * F.col("weight")).alias("target"),
    )


def _rounded(parts: np.ndarray, sizes: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, int]:
    """Parts after the exchange, and the position of the one still open (-1: none)."""
    parts = parts.copy()
    draws = rng.random(len(parts))
    held = -1
    for i in range(len(parts)):
        if not 1e-12 < parts[i] < 1 - 1e-12:
            parts[i] = round(parts[i])
            continue
        if held < 0:
            held = i
            continue
        give = min(parts[held] * sizes[held], (1 - parts[i]) * sizes[i])
        take = min(parts[i] * sizes[i], (1 - parts[held]) * sizes[held])
        moved = give if draws[i] * (give + take) < take else -take
        parts[held] -= moved / sizes[held]
        parts[i] += moved / sizes[i]
        still = [k for k in (held, i) if 1e-12 < parts[k] < 1 - 1e-12]
        for k in (held, i):
            if k not in still:
                parts[k] = round(parts[k])
        held = still[0] if still else -1
    return parts, held


def _round_block(seed: int, level: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        ids = table["locator"].to_numpy()
        order = np.lexsort((table["doc_id"].fill_null(0).to_numpy(), ids))
        table = table.take(pa.array(order))
        name = "|".join(str(k.as_py()) for k in key)
        rng = np.random.default_rng(zlib.crc32(f"{seed}|{level}|{name}".encode()))
        sizes = np.maximum(table["size"].to_numpy().astype(float), 1.0)
        parts, held = _rounded(table["part"].to_numpy().astype(float), sizes, rng)
        is_open = np.arange(len(parts)) == held
        names = table.column_names
        table = table.set_column(names.index("part"), "part", pa.array(parts))
        return table.set_column(names.index("open"), "open", pa.array(is_open))

    return run


def mix(
    spark: SparkSession,
    docs: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    epochs: float = EPOCHS,
    most: int = MOST_COPIES,
    seed: int = 17,
) -> DataFrame:
    """One row per input row: doc_id, locator, source, size, source_size, target, copies, taken.

    Null and blank texts have size 0 and are taken 0 times. A null source is a source, the last one.
    Repeated rows are drawn one by one. An empty table gives no rows. Further columns are ignored.
    """
    sizes = keep(
        docs.select("doc_id", "source", F.xxhash64(text_or_empty()).alias("locator"), word_count().alias("size")),
        "mix-sizes",
    )
    targets = keep(source_targets(sizes, weights, epochs, most), "mix-targets")
    most_docs = targets.agg(F.max("n_docs")).first()[0] or 0
    levels = max(0, math.ceil(math.log(max(1, most_docs / BLOCK_ROWS), FAN_IN)))
    shares = targets.select(
        F.col("source").alias("s"), "source_size", "target", F.ceil(F.col("n_docs") / BLOCK_ROWS).alias("blocks")
    )
    copies = F.when(F.col("size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = (
        sizes.join(broadcast_if_small(shares, 128), F.col("source").eqNullSafe(F.col("s")))
        .withColumn("copies", copies)
        .select(
            "doc_id",
            "locator",
            "source",
            "size",
            "source_size",
            "target",
            F.floor("copies").cast("int").alias("whole"),
            (F.col("copies") - F.floor("copies")).alias("part"),
            F.pmod(F.xxhash64("doc_id", "locator", F.lit(seed)), F.col("blocks")).cast("long").alias("block"),
            F.lit(True).alias("open"),
        )
    )
    done = []
    for level in range(levels + 1):
        rows = rows.groupBy("source", "block").applyInArrow(_round_block(seed, level), SCHEMA)
        rows = keep(rows, f"mix-level{level}")
        done.append(rows.where("not open"))
        rows = rows.where("open").withColumn("block", F.floor(F.col("block") / FAN_IN))
    coin = F.pmod(F.xxhash64("doc_id", "locator", F.lit(seed + 1)), F.lit(1 << 30)) / float(1 << 30)
    last = F.when(coin < F.col("part"), 1.0).otherwise(0.0)
    out = rows.withColumn("part", last)
    for part in done:
        out = out.unionByName(part)
    copies = F.col("whole") + F.round("part").cast("int")
    return out.select(
        "doc_id",
        "locator",
        "source",
        "size",
        "source_size",
        "target",
        copies.alias("copies"),
        (F.col("size") * copies).cast("long").alias("taken"),
    )


def mixed_documents(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, with their columns as they were.

    Rows that repeat one identifier and text share the sum of their copies evenly, which the join by
    (doc_id, content) keeps whole: their number is divided among them by position.
    """
    plain = Plain(docs, "doc_id", "text", "source")
    drawn = mix(spark, plain.df, **options)
    per_row = drawn.groupBy("doc_id", "locator").agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("rows"))
    per_row = per_row.select(F.col("doc_id").alias("its_id"), F.col("locator").alias("its_locator"), "copies", "rows")
    marked = plain.df.withColumn("at", F.xxhash64(text_or_empty()))
    same = F.col("doc_id").eqNullSafe(F.col("its_id")) & (F.col("at") == F.col("its_locator"))
    per_row = keep(per_row.where("copies > 0"), "mix-copies")
    counted = marked.join(per_row.where("rows = 1"), same).withColumn("n", F.col("copies"))
    if not (repeated := per_row.where("rows > 1")).isEmpty():
        place = F.row_number().over(W.partitionBy("its_id", "its_locator").orderBy(F.lit(1))) - 1
        one_more = F.when(F.col("place") < F.col("copies") % F.col("rows"), 1).otherwise(0)
        several = marked.join(repeated, same).withColumn("place", place)
        several = several.withColumn("n", F.floor(F.col("copies") / F.col("rows")) + one_more).drop("place")
        counted = counted.unionByName(several.where("n > 0"))
    copies = F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("copy")
    return plain.restored(counted.select("*", copies))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark, documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "source")
