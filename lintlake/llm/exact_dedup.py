"""Exact deduplication with keyed streaming state.

One row for every document goes through a stateful streaming aggregation keyed by the digest of its
normalised text. The state lives in RocksDB on the executors' disks, is logged to the shared folder,
and never expires. For every digest it retains the identifier of the row that stays, the locator of
that row's content and the number of rows. Rows come in several batches, so later ones meet the state
of earlier ones, and a named store can be continued by another call. Where the state reports a hit (a
digest seen before) the full normalised bytes are compared; texts whose digests agree though their
bytes differ are told apart by the bytes.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake.llm.scratch import Plain, broadcast_if_small, documents, keep, new_path, text_or_empty

#: ASCII white space, which does not count when texts are compared.
BLANKS = r"[\x20\x09-\x0D]+"
#: Batches that one call's rows are streamed in.
BATCHES = 3
INDEX = "doc_id long, digest string, text_sha256 string, n_points long, locator long, times long"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STREAM_CONF = {
    "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "100",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # many small stores: no space ahead of need
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",  # else every partition's store stays open
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
    "spark.sql.streaming.metricsEnabled": "false",
}


def normalised(name: str = "text") -> Column:
    return F.regexp_replace(text_or_empty(name), BLANKS, "")


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def content_index(docs: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row per distinct (identifier, content): digest, code points, locator, how often it occurs.

    ``locator`` is a hash of the original text; with ``doc_id`` it finds the row again.
    """
    text = normalised()
    return (
        docs.select(
            "doc_id",
            digest(text).alias("digest"),
            sha256(text).alias("text_sha256"),
            F.char_length(text_or_empty()).cast("long").alias("n_points"),
            F.xxhash64(text_or_empty()).alias("locator"),
        )
        .groupBy("doc_id", "digest", "text_sha256", "n_points", "locator")
        .agg(F.count(F.lit(1)).alias("times"))
    )


def best_row() -> Column:
    """Most code points first, then the smallest identifier (a null one last), then the locator."""
    return F.max(F.struct("n_points", F.bitwise_not(F.col("doc_id")).alias("inverse_id"), "locator"))


def run_stream(stream: DataFrame, checkpoint: str) -> None:
    """Feed index rows into the keyed state until the source has no more."""
    state = stream.groupBy("digest").agg(best_row().alias("best"), F.sum("times").alias("total"))
    query = (
        state.writeStream.format("noop")
        .outputMode("update")
        .trigger(availableNow=True)
        .option("checkpointLocation", checkpoint)
        .start()
    )
    query.awaitTermination()


def read_state(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The retained state: digest, best (n_points, inverse_id, locator), total."""
    raw = spark.read.format("statestore").load(checkpoint)
    best, total = raw.schema["value"].dataType.names[:2]
    return raw.select(
        F.col("key").getField(raw.schema["key"].dataType.names[0]).alias("digest"),
        F.col("value").getField(best).alias("best"),
        F.col("value").getField(total).alias("total"),
    )


def keyed_state(spark: SparkSession, store: str, n_files: int, batches: int) -> DataFrame:
    """Stream the index files that are new in ``store`` through its state, in some batches; the state after that."""
    before = {k: spark.conf.get(k, None) for k in STREAM_CONF}
    for k, v in STREAM_CONF.items():
        spark.conf.set(k, v)
    try:
        folder, checkpoint = f"{store}/index", f"{store}/state"
        stream = (
            spark.readStream.schema(INDEX)
            .option("maxFileAge", "36500d")
            .option("recursiveFileLookup", "true")
            .option("maxFilesPerTrigger", max(1, -(-n_files // batches)))
            .parquet(folder)
        )
        run_stream(stream, checkpoint)
        return keep(read_state(spark, checkpoint), "dedup-groups")
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def exact_groups(
    spark: SparkSession,
    docs: DataFrame,
    digest: Callable[[Column], Column] = sha256,
    store: str | None = None,
    batches: int = BATCHES,
) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, n_points, locator, times.

    Null text counts as empty, and all blank texts are equal. A null ``doc_id`` takes part and loses
    every tie. Of identical rows (same identifier, same text) the first copy stays. An empty table
    gives no rows; further columns of ``docs`` are ignored.

    ``store`` names a folder whose state is continued: rows then meet those of all earlier calls with it
    too, and ``keep_id`` may be of one of those. Bytes are compared among the rows of this call.
    """
    store = store or new_path(spark, "dedup-store")
    part = f"{store}/index/{uuid.uuid4().hex}"
    content_index(docs, digest).write.parquet(part)
    index = spark.read.schema(INDEX).parquet(part)
    groups = keyed_state(spark, store, len(index.inputFiles()), batches)
    hits = groups.where("total > 1").select("digest")
    n_hits = hits.count()
    collided = None
    if n_hits:
        texts = docs.select(digest(normalised()).alias("digest"), normalised().alias("norm"))
        checked = (
            texts.join(broadcast_if_small(hits, 200, n_hits), "digest", "left_semi")
            .groupBy("digest")
            .agg(F.min("norm").alias("low"), F.max("norm").alias("high"))
            .where("low <> high")
            .select("digest")
        )
        collided = keep(checked, "dedup-collisions")
        if collided.isEmpty():
            collided = None
    joined = index.join(groups, "digest")
    if collided is not None:
        joined = _by_bytes(joined, docs, collided, digest)
    kept = (
        F.bitwise_not(F.col("doc_id")).eqNullSafe(F.col("best.inverse_id"))
        & (F.col("n_points") == F.col("best.n_points"))
        & (F.col("locator") == F.col("best.locator"))
    )
    copies = F.explode(F.sequence(F.lit(1), F.col("times"))).alias("copy")
    return joined.select("*", copies).select(
        "doc_id",
        F.bitwise_not(F.col("best.inverse_id")).alias("keep_id"),
        F.col("total").cast("long").alias("group_size"),
        (kept & (F.col("copy") == 1)).alias("kept"),
        "text_sha256",
        "n_points",
        "locator",
        "times",
    )


def _by_bytes(joined: DataFrame, docs: DataFrame, collided: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    """Rows whose digest stands for several texts are grouped by the normalised bytes, the rest stay as they are."""
    texts = docs.select(
        F.col("doc_id").alias("its_id"),
        digest(normalised()).alias("digest"),
        F.xxhash64(text_or_empty()).alias("its_locator"),
        F.char_length(text_or_empty()).cast("long").alias("its_points"),
        normalised().alias("norm"),
    ).join(collided, "digest", "left_semi")
    order = F.struct(
        F.col("its_points").alias("n_points"),
        F.bitwise_not(F.col("its_id")).alias("inverse_id"),
        F.col("its_locator").alias("locator"),
    )
    exact = texts.groupBy("digest", "norm").agg(F.max(order).alias("b"), F.count(F.lit(1)).alias("t"))
    own = texts.distinct().join(exact, ["digest", "norm"]).drop("norm").withColumnRenamed("digest", "its_digest")
    same = (
        (F.col("digest") == F.col("its_digest"))
        & F.col("doc_id").eqNullSafe(F.col("its_id"))
        & (F.col("locator") == F.col("its_locator"))
        & (F.col("n_points") == F.col("its_points"))
    )
    return (
        joined.join(own, same, "left")
        .withColumn("best", F.coalesce("b", "best"))
        .withColumn("total", F.coalesce("t", "total"))
        .select(*joined.columns)
    )


def deduplicate(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns as they were; nulls, ties and repeats as in ``exact_groups``.

    Of rows that repeat one identifier and text, any one stays where that text does.
    """
    plain = Plain(docs, "doc_id", "text")
    groups = keep(exact_groups(spark, plain.df), "dedup-decisions")
    told = groups.groupBy("doc_id", "locator").agg(F.max("kept").alias("stays"), F.max("times").alias("times"))
    told = told.select(F.col("doc_id").alias("its_id"), F.col("locator").alias("its_locator"), "stays", "times")
    same = F.col("doc_id").eqNullSafe(F.col("its_id")) & (F.col("at") == F.col("its_locator"))
    marked = plain.df.withColumn("at", F.xxhash64(text_or_empty()))
    left = marked.join(broadcast_if_small(told.where("not stays"), 48), same, "left_anti")
    repeated = keep(told.where("times > 1 and stays"), "dedup-repeated")
    if not repeated.isEmpty():
        once = left.join(repeated, same, "left_semi").dropDuplicates(["doc_id", "at"])
        left = left.join(repeated, same, "left_anti").unionByName(once)
    return plain.restored(left)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(spark, documents(spark, sf_dir)).select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256"
    )


SQL = r"""
with t as (
  select doc_id, length(coalesce(text, '')) as n_points,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) as text_sha256
  from documents)
select doc_id,
       first_value(doc_id) over w as keep_id,
       count(*) over (partition by text_sha256) as group_size,
       doc_id = first_value(doc_id) over w as kept,
       text_sha256
from t
window w as (partition by text_sha256 order by n_points desc, doc_id
             rows between unbounded preceding and unbounded following)
"""
