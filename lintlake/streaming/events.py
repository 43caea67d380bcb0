"""Analysis events as a stream: live state, bounded log, ceilings, heartbeats and progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lintlake.operators.ordering import running_max

EVENT_SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
LOG_ROWS = 2000


def event_stream(spark: SparkSession, path: str, schema: str = EVENT_SCHEMA) -> DataFrame:
    """Events as they arrive in a folder of Parquet files."""
    return spark.readStream.schema(schema).option("maxFileAge", "36500d").parquet(path)


def live_state(events: DataFrame) -> DataFrame:
    """Last status, last progress that was given and last heartbeat of every unit; batch or stream.

    As a stream it is an update-mode aggregation whose state is one row per unit of a run.
    """
    at = F.struct("ts", "event_id")
    return events.groupBy("run_id", "unit").agg(
        F.max_by("status", at).alias("status"),
        F.max_by("progress", F.when(F.col("progress").isNotNull(), at)).alias("progress"),
        F.max(F.when(F.col("status") == "heartbeat", F.col("ts"))).alias("last_heartbeat"),
        F.count(F.lit(1)).alias("n_events"),
    )


def bounded_log(events: DataFrame, rows: int = LOG_ROWS) -> DataFrame:
    """The last ``rows`` events of each run; apply it to every micro-batch joined with what was kept before."""
    place = F.row_number().over(W.partitionBy("run_id").orderBy(F.desc("ts"), F.desc("event_id")))
    return events.withColumn("place", place).where(F.col("place") <= rows)


def ceilings(events: DataFrame, kind: Column, limit: int) -> DataFrame:
    """The first event of each session at which more than ``limit`` events of the kind have been seen."""
    so_far = F.count_if(kind).over(W.partitionBy("session").orderBy("seq").rowsBetween(W.unboundedPreceding, 0))
    over = events.withColumn("n", so_far).where(kind & (F.col("n") == limit + 1))
    return over.select("session", "seq", "n")


def monotone_progress(events: DataFrame) -> DataFrame:
    """A run's progress as shown, which never falls."""
    return running_max(events, "run_id", [F.col("ts"), F.col("event_id")], "progress", "shown")


def beats(events: DataFrame, ends: Column, every_ms: int, budget_ms: int, until_ms: Column) -> DataFrame:
    """T03 in a batch: beats of each unit from its first event to its end, its budget or ``until_ms``, what comes first."""
    ms = F.unix_millis("ts")
    units = events.groupBy("run_id", "unit").agg(F.min(ms).alias("started"), (F.min(F.when(ends, ms)) - 1).alias("end"))
    due = F.least(F.coalesce("end", until_ms), until_ms) - F.col("started")
    n = F.greatest(F.lit(0), F.floor(F.least(due, F.lit(budget_ms)) / every_ms)).cast("int")
    rows = units.withColumn("n", n).where("n > 0").select("run_id", "unit", "started", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("k"))
    elapsed = F.col("k").cast("long") * every_ms
    return rows.select(
        "run_id", "unit", "k", F.timestamp_millis(F.col("started") + elapsed).alias("at"), (elapsed / 1000).alias("elapsed"),
        ((F.lit(budget_ms) - elapsed) / 1000).alias("remaining"),
    )


def heartbeats(events: DataFrame, budget_seconds: float) -> DataFrame:
    """Of each unit that gives heartbeats, the time it has taken at the last one and what is left of its budget."""
    seconds = lambda c: F.unix_micros(c.cast("timestamp")) / 1e6
    beat = F.max(F.when(F.col("status") == "heartbeat", F.col("ts")))
    out = events.groupBy("run_id", "unit").agg(F.min("ts").alias("started"), beat.alias("last_heartbeat"))
    out = out.where("last_heartbeat is not null").withColumn("elapsed", seconds(F.col("last_heartbeat")) - seconds(F.col("started")))
    return out.withColumn("remaining", F.greatest(F.lit(0.0), F.lit(float(budget_seconds)) - F.col("elapsed")))


def eta(events: DataFrame, window: int = 10) -> DataFrame:
    """Seconds until each unit's progress reaches 1 at the mean pace of its last ``window`` events; null while it does not move."""
    unit = W.partitionBy("run_id", "unit").orderBy("ts", "event_id")
    recent = unit.rowsBetween(1 - window, 0)
    gained = F.col("progress") - F.first("progress", ignorenulls=True).over(recent)
    took = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.first(F.col("ts").cast("timestamp")).over(recent))) / 1e6
    left = F.greatest(F.lit(0.0), 1 - F.col("progress"))
    return events.withColumn("eta", F.when((gained > 0) & (took > 0), left * took / gained))


def session_meta(events: DataFrame) -> DataFrame:
    """Events, tool calls (any kind named after a tool) and errors of each unit."""
    return events.groupBy("run_id", "unit").agg(
        F.count(F.lit(1)).alias("events"),
        F.count_if(F.contains(F.lower("status"), F.lit("tool"))).alias("tool_calls"),
        F.count_if(F.col("status") == "error").alias("errors"),
    )


def session_findings(meta: DataFrame, findings: DataFrame) -> DataFrame:
    """``meta`` with the findings and the malformed answers of each unit; ``findings`` says which are malformed."""
    counts = findings.groupBy("run_id", "unit").agg(
        F.count_if(~F.col("malformed")).alias("findings"), F.count_if("malformed").alias("malformed")
    )
    return meta.join(counts, ["run_id", "unit"], "left").fillna(0, ["findings", "malformed"])


def run_to_end(stream: DataFrame, checkpoint: str, name: str, mode: str = "complete") -> DataFrame:
    """Feed a stream everything its source holds and return the result table."""
    query = (
        stream.writeStream.format("memory").queryName(name).outputMode(mode)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return stream.sparkSession.table(name)


def log_line() -> Column:
    """E41."""
    return F.format_string("%s [%s] %s", F.date_format("ts", "HH:mm:ss"), F.col("run_id"), F.col("status"))
