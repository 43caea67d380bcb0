"""Registered queries of the event operators; the streaming one runs its source to the end."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lintlake.plans.bindings import EVENTS, UNITS, view
from lintlake.operators.ordering import positions, shared_dir
from lintlake.streaming import events as E
from lintlake.streaming import stateful as S

_E = f"with v as ({EVENTS})"


def _events(s, d):
    return view(s, d, "v_events")


def _sessions(s, d):
    return s.read.parquet(f"{d}/conversations.parquet").select(F.col("conv_id").alias("session"), F.col("turn").alias("seq"), "role")


def _definitions(s, d, text):
    """First definition of each name: functions before prototypes, then by path and position.

    Paths are numbered in their order (a null one is 0), so that the place of a name is one number: later, path and
    position. The least number of a name is found by hashing, while a least string or struct would sort all names.
    """
    sources = view(s, d, "v_sources")
    numbers = positions(sources.select(F.lit(0).alias("all"), "path").distinct(), "all", [F.col("path")], "path_no").drop("all")
    names = sources.join(numbers, "path", "left").select(
        F.coalesce("path_no", F.lit(0)).alias("path_no"),
        F.posexplode(F.regexp_extract_all(text, F.lit(r"([A-Za-z_][A-Za-z0-9_]*)"), F.lit(1))).alias("pos", "name"),
    )
    later = F.when(F.col("pos") % 3 != 0, F.lit(1 << 62)).otherwise(F.lit(0))
    place = later + F.shiftleft("path_no", 31) + F.col("pos")
    first = names.groupBy("name").agg(F.min(place).alias("first"), (F.count(F.lit(1)) - 1).alias("duplicates"))
    at = F.col("first").bitwiseAND(F.lit((1 << 62) - 1))
    found = first.withColumn("path_no", F.shiftright(at, 31)).join(numbers, "path_no", "left")
    return found.select(
        "name", "path", at.bitwiseAND(F.lit((1 << 31) - 1)).cast("int").alias("pos"),
        (F.col("first") < F.lit(1 << 62)).alias("is_function"), "duplicates",
    )


def _stream(s, d):
    """The events table as a stream, with the columns of the events view."""
    return E.event_stream(s, f"{d}/event[s].parquet").selectExpr(
        "event_id", "ts", "concat('run-', cast(user_id % 8 as string)) as run_id", "user_id as unit", "event_type as status",
        "value as progress", "props",
    )


def _daily_stream(s, d):
    """The events as a stream of three files, ten days each, one to a batch."""
    folder = f"{shared_dir(s)}/events-{uuid.uuid4().hex}"
    rows = s.read.parquet(f"{d}/events.parquet").selectExpr(
        "concat('run-', cast(user_id % 8 as string)) as run_id", "user_id as unit", "cast(ts as timestamp) as ts", "event_type as status"
    )
    for part in range(3):
        own = rows.where(F.least(F.lit(2), F.floor((F.dayofmonth("ts") - 1) / 10)) == part)
        own.coalesce(1).write.mode("append").parquet(folder)
    return s.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def _talk_stream(s, d):
    talk = s.readStream.schema("conv_id long, turn long, role string, text string").parquet(f"{d}/conversation[s].parquet")
    return talk.selectExpr("conv_id as session", "turn as seq", "role = 'assistant' as counts")


def _unit_stream(s, d):
    """Units as they are in the orders table, as a stream, with their costs."""
    kinds = s.read.parquet(f"{d}/orders.parquet").schema
    rows = s.readStream.schema(kinds).parquet(f"{d}/order[s].parquet")
    units = s.sql(UNITS.replace("from orders", "from {o}"), o=rows)
    return units.withColumns({"cost": F.greatest(F.lit(1), F.ceil(F.col("byte_length") / 4)), "reserved": F.lit(800)})


def _eta(s, d):
    rows = _events(s, d).withColumn("progress", F.expr("progress / 1000"))
    return E.eta(rows).select("event_id", F.round("eta", 6).alias("eta"))


def _meta(s, d):
    named = _events(s, d).withColumn("status", F.expr("case when status = 'click' then 'Tool.Call' else status end"))
    items = s.read.parquet(f"{d}/lineitem.parquet").selectExpr(
        "concat('run-', cast(l_suppkey % 8 as string)) as run_id", "l_suppkey as unit", "l_returnflag = 'R' as malformed"
    )
    return E.session_findings(E.session_meta(named), items)


_BEATS = lambda s, d: _events(s, d).withColumn(
    "status", F.expr("case when status = 'view' then 'heartbeat' else status end")
)

QUERIES = {
    "t01_event_stream": lambda s, d: S.collected(_stream(s, d)).select("event_id", "run_id", "unit", "status", "progress"),
    "t02_live_state_stream": lambda s, d: S.latest(S.collected(E.live_state(_stream(s, d)), "update"), "run_id", "unit"),
    "t03_heartbeats": lambda s, d: E.heartbeats(_BEATS(s, d), 86_400).select(
        "run_id", "unit", F.round("elapsed", 3).alias("elapsed"), F.round("remaining", 3).alias("remaining")
    ),
    "t03_heartbeat_stream": lambda s, d: S.with_timers(
        S.heartbeat_stream(_daily_stream(s, d), F.col("status") == "error", 21_600_000, 20 * 86_400_000, "5 seconds")
    ).drop("batch"),
    "t04_bounded_log_stream": lambda s, d: S.log_stream(_stream(s, d), 100).select("run_id", "event_id", "place"),
    "t05_ceilings_stream": lambda s, d: S.collected(S.ceiling_stream(_talk_stream(s, d), 2)).drop("batch"),
    "t06_monotone_progress_stream": lambda s, d: S.collected(S.progress_stream(_stream(s, d))).drop("batch"),
    "t07_budget_ledger": lambda s, d: S.collected(
        S.ledger_stream(_unit_stream(s, d), ["unit_id"], 500_000, 160_000)
    ).drop("batch"),
    "z05_eta_seconds": _eta,
    "t02_live_state": lambda s, d: E.live_state(_events(s, d)),
    "t04_bounded_log": lambda s, d: E.bounded_log(_events(s, d), 100).select("run_id", "event_id", "place"),
    "t05_ceilings": lambda s, d: E.ceilings(_sessions(s, d), F.col("role") == "assistant", 2),
    "t06_monotone_progress": lambda s, d: E.monotone_progress(_events(s, d)).select("event_id", "shown"),
    "d25_session_meta": _meta,
    "e41_log_lines": lambda s, d: _events(s, d).select("event_id", E.log_line().alias("line")),
    "z05_eta": lambda s, d: _events(s, d).select(
        "event_id",
        F.expr("round(avg(progress) over (partition by run_id order by ts, event_id rows between 9 preceding and current row), 6)").alias("mean"),
    ),
    "d22_symbol_table_whole": lambda s, d: _definitions(s, d, F.col("content")),
}
ORACLES = {
    "t02_live_state": f"""{_E} select run_id, unit, arg_max(status, (ts, event_id)) as status, arg_max(progress, (ts, event_id)) as progress,
      max(ts) filter (status = 'heartbeat') as last_heartbeat, count(*) as n_events from v group by 1, 2""",
    "t04_bounded_log": f"""{_E} select run_id, event_id, place from (select *, row_number() over (partition by run_id order by ts desc, event_id desc) as place from v)
      where place <= 100""",
    "t05_ceilings": """with t as (select conv_id as session, turn as seq, role, count(*) filter (role = 'assistant') over (partition by conv_id order by turn rows unbounded preceding) as n
      from conversations) select session, seq, n from t where role = 'assistant' and n = 3""",
    "t06_monotone_progress": f"{_E} select event_id, max(progress) over (partition by run_id order by ts, event_id rows unbounded preceding) as shown from v",
    "d25_session_meta": f"""{_E}, e as (select run_id, unit, count(*) as events, count(*) filter (status = 'click') as tool_calls,
        count(*) filter (status = 'error') as errors from v group by 1, 2),
      f as (select 'run-' || l_suppkey % 8 as run_id, l_suppkey as unit, count(*) filter (l_returnflag <> 'R') as findings,
        count(*) filter (l_returnflag = 'R') as malformed from lineitem group by 1, 2)
      select e.*, coalesce(findings, 0) as findings, coalesce(malformed, 0) as malformed from e left join f using (run_id, unit)""",
    "t01_event_stream": f"{_E} select event_id, run_id, unit, status, progress from v",
    "t03_heartbeats": f"""{_E}, b as (select run_id, unit, (epoch_us(max(ts) filter (status = 'view')) - epoch_us(min(ts))) / 1e6 as elapsed from v group by 1, 2)
      select run_id, unit, round(elapsed, 3) as elapsed, round(greatest(0, 86400 - elapsed), 3) as remaining from b where elapsed is not null""",
    "t03_heartbeat_stream": f"""{_E}, u as (select run_id, unit, epoch_us(min(ts)) // 1000 as started, epoch_us(min(ts) filter (status = 'error')) // 1000 - 1 as ended from v group by 1, 2),
      n as (select *, greatest(0, (least(coalesce(ended, w), w, started + 1728000000) - started) // 21600000) as n
        from u, (select epoch_us(max(ts)) // 1000 - 5000 as w from v)),
      k as (select run_id, unit, started, unnest(generate_series(1, n::bigint)) as k from n)
      select run_id, unit, k::int as k, make_timestamp_ms(started + k * 21600000) as at, k * 21600.0::double as elapsed, 1728000.0::double - k * 21600 as remaining from k""",
    "t07_budget_ledger": f"""with recursive u as ({UNITS}), t as (select run_id, unit_id, greatest(1, ceil(byte_length / 4))::bigint as cost,
        row_number() over (partition by run_id order by unit_id) as n from u),
    f as (select run_id, unit_id, 0::bigint as n, ''::varchar as refused_by, 0::bigint as prompt_spent, 0::bigint as completion_reserved from t where n = 1
      union all select run_id, unit_id, n, refused_by, case when refused_by is null then spent + cost else spent end,
          case when refused_by is null then held + 800 else held end
        from (select t.run_id, t.unit_id, t.cost, t.n, f.prompt_spent as spent, f.completion_reserved as held,
            case when f.prompt_spent + t.cost > 500000 then 'cost' when f.completion_reserved + 800 > 160000 then 'reserved' end as refused_by
          from f join t on t.run_id = f.run_id and t.n = f.n + 1))
    select run_id, unit_id, refused_by, prompt_spent, completion_reserved from f where n > 0""",
    "z05_eta_seconds": f"""{_E}, p as (select event_id, ts, progress / 1000 as p, first_value(progress / 1000 ignore nulls) over w as p0, first_value(ts) over w as t0
        from v window w as (partition by run_id, unit order by ts, event_id rows between 9 preceding and current row))
      select event_id, round(case when p - p0 > 0 and ts > t0 then greatest(0, 1 - p) * ((epoch_us(ts) - epoch_us(t0)) / 1e6) / (p - p0) end, 6) as eta from p""",
    "e41_log_lines": f"{_E} select event_id, strftime(ts, '%H:%M:%S') || ' [' || run_id || '] ' || status as line from v",
    "z05_eta": f"{_E} select event_id, round(avg(progress) over (partition by run_id order by ts, event_id rows between 9 preceding and current row), 6) as mean from v",
}
for _name in ("t02_live_state", "t04_bounded_log", "t05_ceilings", "t06_monotone_progress"):
    ORACLES[f"{_name}_stream"] = ORACLES[_name]
