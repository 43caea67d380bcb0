"""Event operators as streams: the same results as in batches, from state that is carried along."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import IntegerType, StructField, StructType

from lintlake.operators.ordering import shared_dir
from lintlake.streaming.events import bounded_log

PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def _new_folder(spark: SparkSession, label: str) -> str:
    import uuid

    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def run_batches(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Feed a stream all that its source holds, batch after batch."""
    query = (
        stream.writeStream.foreachBatch(each).outputMode(mode).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()


def collected(stream: DataFrame, mode: str = "append", folder: str | None = None) -> DataFrame:
    """All rows that a stream gives until its source is exhausted, with ``batch``; a batch that runs again replaces itself.

    A stream with a ``folder`` of its own goes on where it stopped: state and earlier rows are in there.
    """
    spark = stream.sparkSession
    folder = folder or _new_folder(spark, "stream")

    def each(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/rows/batch={batch}")

    run_batches(stream, each, f"{folder}/checkpoint", mode)
    schema = StructType([*stream.schema.fields, StructField("batch", IntegerType())])
    try:
        return spark.read.schema(schema).parquet(f"{folder}/rows")
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)  # a source that holds nothing gives no batch


def latest(updates: DataFrame, *keys: str) -> DataFrame:
    """Of every key the row of the last batch that changed it."""
    values = [c for c in updates.columns if c not in (*keys, "batch")]
    out = updates.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("v"))
    return out.select(*keys, "v.*")


def log_stream(stream: DataFrame, rows: int) -> DataFrame:
    """The last ``rows`` events of each run, kept from batch to batch: the log, never the stream, is rewritten."""
    spark = stream.sparkSession
    folder = _new_folder(spark, "log")
    last: list[str] = []

    def each(batch_rows: DataFrame, batch: int) -> None:
        path = f"{folder}/log/{batch}"
        before = [p for p in last if p != path]
        merged = batch_rows
        for kept in before[-1:]:
            merged = batch_rows.unionByName(spark.read.schema(stream.schema).parquet(kept))
        bounded_log(merged, rows).drop("place").write.mode("overwrite").parquet(path)
        last.append(path)

    run_batches(stream, each, f"{folder}/checkpoint")
    # a source that holds nothing gives no batch, and so an empty log
    kept = spark.read.schema(stream.schema).parquet(last[-1]) if last else spark.createDataFrame([], stream.schema)
    return bounded_log(kept, rows)


#: Rows of a key that are made into objects at a time.
STATE_ROWS = 10_000


def _with_state(stream: DataFrame, key: str, order: list[str], values: list[str], start, step, out: str, state: str) -> DataFrame:
    """Rows of each key in order within a batch: ``step(state, key, row)`` gives the next state and an output row or None.

    A key's ``order`` and ``values`` of a batch are held as plain arrays, a few bytes a row; rows are made and
    given back in short frames.
    """
    names = list(dict.fromkeys([*order, *values]))

    def run(own: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        now = held.get if held.exists else start
        parts: dict[str, list] = {n: [] for n in names}
        for frame in frames:
            for n in names:
                parts[n].append(frame[n].array.copy())  # a view would keep the frame
        rows = {n: pd.concat([pd.Series(p) for p in parts.pop(n)], ignore_index=True) for n in names}
        places = pd.DataFrame({n: rows[n] for n in order}, copy=False).sort_values(order, kind="stable").index.to_numpy()
        for at in range(0, len(places), STATE_ROWS):
            chosen = places[at : at + STATE_ROWS]
            given = []
            for row in pd.DataFrame({n: rows[n].iloc[chosen] for n in names}).itertuples(index=False):
                now, shown = step(now, own[0], row)
                if shown is not None:
                    given.append(shown)
            if given:
                yield pd.DataFrame(given, columns=[c.split()[0] for c in out.split(", ")])
        held.update(now)

    return stream.select(key, *names).groupBy(key).applyInPandasWithState(run, out, state, "append", GroupStateTimeout.NoTimeout)


def ceiling_stream(stream: DataFrame, limit: int) -> DataFrame:
    """The event of each session, once, at which more than ``limit`` rows with ``counts`` have been seen."""

    def step(now, session, row):
        n = now[0] + bool(row.counts)
        return (n,), (session, row.seq, n) if row.counts and n == limit + 1 else None

    return _with_state(stream, "session", ["seq"], ["counts"], (0,), step, "session long, seq long, n long", "n long")


def progress_stream(stream: DataFrame) -> DataFrame:
    """A run's progress as shown, which never falls from batch to batch either."""

    def step(now, _, row):
        known = [v for v in (now[0], row.progress) if v is not None and v == v]
        top = max(known, default=None)
        return (top,), (row.event_id, top)

    return _with_state(stream, "run_id", ["ts", "event_id"], ["progress"], (None,), step, "event_id long, shown double", "top double")


def ledger_stream(stream: DataFrame, order: list[str], prompt_budget: int, completion_budget: int) -> DataFrame:
    """The budget ledger of each run: whether a unit's ``cost`` and ``reserved`` tokens still fit, in the order of arrival."""

    def step(now, run, row):
        spent, held = now
        refused = "cost" if spent + row.cost > prompt_budget else "reserved" if held + row.reserved > completion_budget else None
        after = now if refused else (spent + row.cost, held + row.reserved)
        return after, (run, row.unit_id, refused, after[0], after[1])

    out = "run_id string, unit_id long, refused_by string, prompt_spent long, completion_reserved long"
    return _with_state(stream, "run_id", order, ["unit_id", "cost", "reserved"], (0, 0), step, out, "spent long, held long")


TICK = "run_id string, unit long, k int, at timestamp, elapsed double, remaining double"
_TICK_STATE = "started long, told int, ended boolean"


class Heartbeats(StatefulProcessor):
    """A beat every so often for each unit that runs, whether or not anything is heard of it.

    State is one row per unit: when it started, how many beats have been told, whether it has ended. A timer
    in event time stands for the next beat; what arrives only moves the end. Beats before an end that comes
    with the same batch are told at once.
    """

    def __init__(self, every_ms: int, budget_ms: int):
        self.every, self.budget = every_ms, budget_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("unit", _TICK_STATE)

    def _beats(self, key: tuple, started: int, told: int, until: int) -> tuple[int, pd.DataFrame]:
        """Beats that are due by ``until`` and not told yet, as many as the budget allows."""
        due = max(told, min(until - started, self.budget) // self.every)
        k = range(told + 1, due + 1)
        elapsed = [n * self.every for n in k]
        return due, pd.DataFrame(
            {
                "run_id": pd.Series([key[0]] * len(k), dtype=object), "unit": pd.Series([key[1]] * len(k), dtype="int64"), "k": pd.Series(list(k), dtype="int32"),
                "at": pd.to_datetime([started + e for e in elapsed], unit="ms"),
                "elapsed": [e / 1000 for e in elapsed], "remaining": [(self.budget - e) / 1000 for e in elapsed],
            }
        )

    def _wait(self, started: int, told: int) -> None:
        if (told + 1) * self.every <= self.budget:
            self.handle.registerTimer(started + (told + 1) * self.every)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first, end = None, None
        for frame in rows:  # a unit's rows pass by in frames of bounded size
            least, ends = frame["ms"].min(), frame.loc[frame["ends"], "ms"]
            first = least if first is None else min(first, least)
            end = ends.min() if end is None and len(ends) else min(end, ends.min()) if len(ends) else end
        known = self.state.get() if self.state.exists() else None
        started, told, ended = known if known else (int(first), 0, False)
        if ended:
            return
        if not known:
            self._wait(started, told)
        if end is None:
            self.state.update((started, told, False))
            return
        told, shown = self._beats(key, started, told, int(end) - 1)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.state.update((started, told, True))
        yield shown

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        started, told, ended = self.state.get()
        if ended:
            return
        told, shown = self._beats(key, started, told, timerValues.getCurrentWatermarkInMs())
        self._wait(started, told)
        self.state.update((started, told, False))
        yield shown

    def close(self) -> None:
        pass


def heartbeat_stream(stream: DataFrame, ends: Column, every_ms: int, budget_ms: int, delay: str) -> DataFrame:
    """The beats of all units of a stream of events (run_id, unit, ts, status); ``ends`` tells which stop a unit.

    A unit starts with the first event of the batch that it first occurs in. Beats of silent units are told
    when the watermark, ``delay`` behind the latest event, has passed them; the end of a unit that arrives
    later than that is dropped with other late events.
    """
    rows = stream.withWatermark("ts", delay).select("run_id", "unit", "ts", F.unix_millis("ts").alias("ms"), F.coalesce(ends, F.lit(False)).alias("ends"))
    return rows.groupBy("run_id", "unit").transformWithStateInPandas(
        statefulProcessor=Heartbeats(every_ms, budget_ms), outputStructType=TICK, outputMode="Append", timeMode="EventTime"
    )


def with_timers(stream: DataFrame, folder: str | None = None) -> DataFrame:
    """``collected``, with the state store that timers need for as long as the stream runs."""
    conf, before = stream.sparkSession.conf, stream.sparkSession.conf.get(PROVIDER, None)
    conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        return collected(stream, folder=folder)
    finally:
        conf.unset(PROVIDER) if before is None else conf.set(PROVIDER, before)
