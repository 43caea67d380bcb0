"""Registered queries of the accounting and span operators, each with the SQL of its result."""

from __future__ import annotations

from pyspark.sql import functions as F

from lintlake.functions.severity import SCANNERS
from lintlake.operators import accounting as A
from lintlake.operators import spans as P
from lintlake.plans.bindings import EVENTS, SOURCES, SPANS, UNITS, view

RESULTS = """
select run_id, case when unit_id % 17 = 0 then unit_id + 1000000000 else unit_id end as unit_id, producer, status from v_units
union all
select run_id, unit_id, 'llm-security', case when unit_id % 6 = 1 then 'completed' else 'failed' end from v_units where unit_id % 4 = 1
"""
_U = f"with v_units as ({UNITS})"
_R = f"{_U}, results as ({RESULTS})"
_OUT = f"""{_R}, got as (select run_id, unit_id, bool_or(status = 'completed') as done, list(distinct status) as statuses from results group by 1, 2),
outcome as (select u.*, coalesce(g.done, false) as scanned, g.statuses from v_units u left join got g using (run_id, unit_id))"""


def _units(s, d):
    return view(s, d, "v_units")


def _results(s, d):
    return s.sql(RESULTS.replace("v_units", "{u}"), u=_units(s, d))


def _scanners(s):
    return s.createDataFrame([(i, p) for i, p in enumerate(SCANNERS)], "scanner_pos int, producer string")


def _tools(s, d):
    units = _units(s, d)
    tools = A.unit_status(units, "run_id", "producer")
    return tools.selectExpr(
        "run_id", "producer", "run_id <> 'run-3' or producer <> 'llm-security' as requested",
        "case when run_id in ('run-5', 'run-6') then 'completed' else status end as status", "valid_reports",
        "run_id <> 'run-6' as stable", "'completed' as export_status", "'disabled' as review_status",
    )


_STATUS = """case when bool_or(status = 'interrupted') then 'interrupted' when bool_and(status = 'completed') then 'completed'
  when bool_or(valid_report) then 'partial' when bool_and(status in ('timed_out', 'unscheduled')) then 'timed_out' else 'failed' end"""
_COUNTS = """count(*) as planned, count(*) filter (status in ('completed', 'partial', 'timed_out', 'failed', 'interrupted')) as started,
  count(*) filter (status = 'completed') as completed, count(*) filter (status in ('failed', 'partial')) as failed,
  count(*) filter (status = 'timed_out') as timed_out, count(*) filter (status = 'unscheduled') as unscheduled"""
_COVER = f"""{_U}, c as (select run_id, producer,
  count(distinct path) filter (status in ('completed', 'partial', 'failed', 'timed_out')) as attempted,
  count(distinct path) filter (valid_report) as analyzed,
  count(distinct path) filter (not valid_report and status = 'failed') as excluded, count(distinct path) as total from v_units group by 1, 2),
cover as (select *, greatest(0, total - excluded) as effective_total,
  case when greatest(0, total - excluded) = 0 then null else analyzed / greatest(0, total - excluded) end as ratio from c)"""


def _inventory(s, d, after: bool):
    rows = view(s, d, "v_sources")
    if after:
        rows = rows.where("path not like 'src3/%'").withColumn(
            "content", F.when(F.expr("path like 'src5/%'"), F.concat("content", F.lit("x"))).otherwise(F.col("content"))
        )
    else:
        rows = rows.where("path not like 'src7/%'")
    return rows.select("run_id", "path", F.octet_length("content").cast("long").alias("size"), F.sha2("content", 256).alias("sha256"))


_INV = f"""with v as ({SOURCES}),
before as (select run_id, path, strlen(content) as size, sha256(content) as sha256 from v where path not like 'src7/%'),
after as (select run_id, path, sha256(case when path like 'src5/%' then content || 'x' else content end) as sha256 from v where path not like 'src3/%')"""


def _runs(s, d):
    ev = view(s, d, "v_events")
    return ev.groupBy("run_id", F.expr("unit % 5").alias("source")).agg(F.max(F.date_trunc("hour", "ts")).alias("finished_at"))


def _cache(s, d):
    return A.cache_counts(A.cache_lookup(_keyed(s, d), _keyed(s, d).where("status = 'completed'")))


def _stored_cache(s, d):
    """The cache of completed units after the answers of all units have been put in; every fifth was cut off by its provider."""
    cache = _keyed(s, d).where("status = 'completed' and unit_id % 2 = 0").select("cache_key")
    asked = _keyed(s, d).withColumn("provider_stopped", F.expr("unit_id % 5 = 0"))
    return A.cache_store(A.cache_lookup(asked, cache), cache)


def _keyed(s, d):
    """Units with their cache keys; the prompt stands for path, kind and tier."""
    fields = {k: F.lit(v) for k, v in _KEY.items() if v is not None}
    prompt = F.concat_ws("|", "path", "kind", "tier")
    return _units(s, d).withColumn(
        "cache_key",
        A.cache_key(unit_sha256=F.sha2("path", 256), prompt_sha256=F.sha2(prompt, 256), producer=F.col("producer"), **fields),
    )


_KEY = {
    "version": 1, "unit_sha256": None, "prompt_sha256": None, "skill_version": "2", "skill_sha256": "ab", "model": "m",
    "endpoint": "http://host/v1", "temperature": "0.0", "seed": 7, "max_completion_tokens": 800, "context_window": 16384,
    "producer": None,
}
_KEY_SQL = "sha256(concat_ws(chr(0), " + ", ".join(
    {"unit_sha256": "sha256(path)", "prompt_sha256": "sha256(path || '|' || kind || '|' || tier)", "producer": "producer"}.get(k, f"'{v}'")
    for k, v in _KEY.items()
) + "))"


def _spans(s, d):
    return view(s, d, "v_spans")


def _files(s, d):
    return _spans(s, d).groupBy("file_id").agg((F.sum(F.expr("end_byte * 0 + 1")) * 30).alias("size"))


def _arms(s, d):
    return _spans(s, d).where("tag % 3 = 0").withColumn("label", F.concat(F.lit("#if T"), F.expr("tag % 10").cast("string")))


def _points(s, d):
    return _spans(s, d).select("file_id", F.col("end_byte").alias("offset")).distinct()


_S = f"with v as ({SPANS})"
_FOLD_ORDER = ["tier_rank", "path", "unit_id"]


def _tasks(s, d):
    rank = F.array_position(F.array(*map(F.lit, A.TIERS)), F.col("tier"))
    return _units(s, d).withColumn("tier_rank", rank.cast("int")).withColumn("cost", F.greatest(F.lit(1), F.ceil(F.col("byte_length") / 4)))


QUERIES = {
    "e24_cache_key": lambda s, d: _keyed(s, d).select("run_id", "unit_id", "cache_key"),
    "d10_unit_counts": lambda s, d: A.unit_counts(_units(s, d), "run_id", "producer"),
    "d11_unit_status": lambda s, d: A.unit_status(_units(s, d), "run_id", "path"),
    "d12_run_status": lambda s, d: A.run_status(_tools(s, d)),
    "c12_known_results": lambda s, d: A.known_results(_results(s, d), _units(s, d)),
    "d14_coverage_report": lambda s, d: A.coverage_report(_units(s, d), _results(s, d)),
    "d15_coverage_by_scanner": lambda s, d: A.coverage_by_scanner(
        _units(s, d), _results(s, d), _scanners(s).select("producer")
    ),
    "d16_tier_counts": lambda s, d: A.tier_counts(_units(s, d), _results(s, d)),
    "d17_unscanned_reasons": lambda s, d: A.unscanned_reasons(_units(s, d), _results(s, d)),
    "d07_tool_coverage": lambda s, d: A.tool_coverage(_units(s, d), "run_id", "producer"),
    "d08_coverage_gaps": lambda s, d: A.coverage_gaps(A.tool_coverage(_units(s, d), "run_id", "producer")),
    "w10_dispatch_order": lambda s, d: A.dispatch_order(
        _units(s, d).withColumn("start_byte", F.col("byte_length")), _scanners(s).withColumnRenamed("producer", "scanner")
    ).select("run_id", "unit_id", "scanner", "place"),
    "w11_budget_admission": lambda s, d: A.admitted(
        _tasks(s, d).withColumn("reserved", F.lit(800)), ["run_id"], _FOLD_ORDER, {"cost": 500_000, "reserved": 160_000}, []
    ).select("run_id", "unit_id", "cost", "admitted", "refused_by"),
    "w12_context_fill": lambda s, d: A.admitted(_tasks(s, d), ["run_id", "path"], ["unit_id"], {"cost": 6_000}, ["tier"]).select(
        "run_id", "path", "unit_id", "admitted"
    ),
    "w13_shards": lambda s, d: A.shards(view(s, d, "v_sources").select("run_id", "path"), 30, 400),
    "w03_ordinals": lambda s, d: A.ordinals(
        _units(s, d).withColumns({"name": F.col("tier"), "start_byte": F.col("byte_length")})
    ).select("run_id", "unit_id", "ordinal"),
    "c05_inventory_diff": lambda s, d: A.inventory_diff(_inventory(s, d, False), _inventory(s, d, True)),
    "d21_inventory_digest": lambda s, d: A.inventory_digest(
        view(s, d, "v_sources").select("run_id", "path", F.octet_length("content").cast("long").alias("size"), F.sha2("content", 256).alias("sha256"))
    ),
    "a21_latest_run": lambda s, d: A.latest_run(_runs(s, d)),
    "c13_cache_lookup": _cache,
    "c13_cache_store": _stored_cache,
    "e31_process_outcome": lambda s, d: view(s, d, "v_events").select(
        "event_id", A.process_outcome(F.expr("unit % 7 = 0"), F.expr("status = 'error'"), F.expr("event_id % 2 = 0"), F.expr("event_id % 3 = 0")).alias("outcome")
    ),
    "e31_finish_status": lambda s, d: view(s, d, "v_events")
    .select("event_id", A.finish_status(F.expr("case unit % 5 when 0 then 'Stop' when 1 then 'length' when 2 then 'aborted' when 3 then status else null end"), F.expr("event_id % 3 <> 0")).alias("unit_status")),
    "w04_merged_spans": lambda s, d: P.merged(_spans(s, d)),
    "w05_tiling_problems": lambda s, d: P.tiling_problems(_spans(s, d), _files(s, d)),
    "c10_containing_arms": lambda s, d: P.containing_arms(_points(s, d), _arms(s, d)),
    "c11_dead_units": lambda s, d: P.overlapped(_spans(s, d).select("file_id", "seq", "start_byte", "end_byte"), _spans(s, d).where("tag % 5 = 0")),
    "w06_tiles": lambda s, d: P.claimed(_spans(s, d).join(_files(s, d), "file_id")),
}

ORACLES = {
    "e24_cache_key": f"{_U} select run_id, unit_id, {_KEY_SQL} as cache_key from v_units",
    "d10_unit_counts": f"{_U} select run_id, producer, {_COUNTS} from v_units group by 1, 2",
    "d11_unit_status": f"{_U} select run_id, path, {_STATUS} as status, count(*) filter (valid_report) as valid_reports from v_units group by 1, 2",
    "d12_run_status": f"""{_U}, t as (select run_id, producer, run_id <> 'run-3' or producer <> 'llm-security' as requested,
      case when run_id in ('run-5', 'run-6') then 'completed' else {_STATUS} end as status,
      count(*) filter (valid_report) as valid_reports, run_id <> 'run-6' as stable from v_units group by 1, 2),
    s as (select run_id, case when bool_or(requested and status = 'interrupted') then 'interrupted'
      when bool_or(requested and status <> 'not_applicable') and bool_and(not requested or status in ('completed', 'not_applicable'))
        and bool_and(stable) then 'complete'
      when bool_or(requested and valid_reports > 0) then 'partial' else 'failed' end as status from t group by 1)
    select *, case status when 'complete' then 0 when 'partial' then 10 when 'failed' then 20 else 130 end as exit_code from s""",
    "c12_known_results": f"{_R} select r.*, u.path, u.kind, u.tier, u.byte_length from results r join v_units u using (run_id, unit_id)",
    "d14_coverage_report": f"""{_OUT}, f as (select run_id, path, bool_and(scanned) as scanned,
      count(*) filter (kind = 'function' and scanned) as functions, count(*) filter (kind = 'function') as all_functions,
      coalesce(sum(byte_length) filter (scanned), 0) as bytes, sum(byte_length) as all_bytes from outcome group by 1, 2),
    s as (select run_id, count(*) filter (scanned) as files, count(*) as all_files, sum(functions)::bigint as functions,
      sum(all_functions)::bigint as all_functions, sum(bytes)::bigint as bytes, sum(all_bytes)::bigint as all_bytes from f group by 1)
    select *, round_even(files / all_files, 4) as files_ratio, coalesce(round_even(functions / nullif(all_functions, 0), 4), 0) as functions_ratio,
      round_even(bytes / all_bytes, 4) as bytes_ratio from s""",
    "d15_coverage_by_scanner": f"""{_R}, known as (select r.run_id, r.producer, u.* exclude (run_id, producer, status)
        from results r join v_units u using (run_id, unit_id) where r.status = 'completed'),
    g as (select run_id, producer, count(*) as units, count(*) filter (kind = 'function') as functions, sum(byte_length)::bigint as bytes,
      count(distinct path) as files from known group by 1, 2),
    grid as (select * from (select distinct run_id from v_units), (values {", ".join(f"('{p}')" for p in SCANNERS)}) as p(producer))
    select run_id, producer, coalesce(units, 0) as units, coalesce(functions, 0) as functions, coalesce(bytes, 0) as bytes,
      coalesce(files, 0) as files from grid left join g using (run_id, producer)""",
    "d16_tier_counts": f"{_OUT} select run_id, tier, count(*) as planned, count(*) filter (scanned) as scanned from outcome group by 1, 2",
    "d17_unscanned_reasons": f"""{_OUT}, r as (select run_id, case when statuses is null then 'no_result'
        when list_contains(statuses, 'interrupted') then 'interrupted' when list_contains(statuses, 'failed') then 'failed'
        when list_contains(statuses, 'timed_out') then 'timed_out' when list_contains(statuses, 'unscheduled') then 'unscheduled'
        else 'failed' end as reason from outcome where not scanned
      union all select run_id, 'parse_confidence_low' from outcome where parse_confidence < 0.5)
    select run_id, reason, count(*) as n from r group by 1, 2""",
    "d07_tool_coverage": f"{_COVER} select * from cover",
    "d08_coverage_gaps": f"""{_COVER} select *, greatest(0, effective_total - analyzed) as unanalyzed from cover
      where excluded > 0 or greatest(0, effective_total - analyzed) > 0""",
    "w10_dispatch_order": f"""{_U} select run_id, unit_id, scanner, row_number() over (partition by run_id order by
      list_position(['critical', 'high', 'medium', 'low'], tier), path, byte_length, unit_id, pos) as place
      from v_units, (values {", ".join(f"({i}, '{p}')" for i, p in enumerate(SCANNERS))}) as s(pos, scanner)""",
    "w11_budget_admission": f"""with recursive v_units as ({UNITS}), t as (select run_id, unit_id, greatest(1, ceil(byte_length / 4))::bigint as cost,
        row_number() over (partition by run_id order by list_position(['critical', 'high', 'medium', 'low'], tier), path, unit_id) as n from v_units),
    f as (select run_id, unit_id, cost, 0::bigint as n, ''::varchar as refused_by, 0::bigint as spent, 0::bigint as reserved from t where n = 1
      union all select run_id, unit_id, cost, n, refused_by, case when refused_by is null then spent + cost else spent end,
          case when refused_by is null then reserved + 800 else reserved end
        from (select t.run_id, t.unit_id, t.cost, t.n, f.spent, f.reserved,
            case when f.spent + t.cost > 500000 then 'cost' when f.reserved + 800 > 160000 then 'reserved' end as refused_by
          from f join t on t.run_id = f.run_id and t.n = f.n + 1))
    select run_id, unit_id, cost, refused_by is null as admitted, refused_by from f where n > 0""",
    "w12_context_fill": f"""with recursive v_units as ({UNITS}), t as (select run_id, path, unit_id, greatest(1, ceil(byte_length / 4))::bigint as cost,
        row_number() over (partition by run_id, path order by unit_id) as n from v_units),
    f as (select run_id, path, unit_id, n, cost <= 6000 as admitted, case when cost <= 6000 then cost else 0 end as spent from t where n = 1
      union all select t.run_id, t.path, t.unit_id, t.n, f.spent + t.cost <= 6000,
        case when f.spent + t.cost <= 6000 then f.spent + t.cost else f.spent end
        from f join t on t.run_id = f.run_id and t.path = f.path and t.n = f.n + 1)
    select run_id, path, unit_id, admitted from f""",
    "w13_shards": f"""with recursive v as ({SOURCES}), t as (select run_id, path, strlen(path) + 1 as cost,
        row_number() over (partition by run_id order by path) as n from v),
    f as (select run_id, path, n, 1 as files, 200 + cost as size, 0 as shard from t where n = 1
      union all select t.run_id, t.path, t.n, case when f.files >= 30 or f.size + t.cost > 400 then 1 else f.files + 1 end,
        case when f.files >= 30 or f.size + t.cost > 400 then 200 + t.cost else f.size + t.cost end,
        case when f.files >= 30 or f.size + t.cost > 400 then f.shard + 1 else f.shard end
        from f join t on t.run_id = f.run_id and t.n = f.n + 1)
    select run_id, path, shard from f""",
    "w03_ordinals": f"""{_U} select run_id, unit_id, row_number() over (partition by run_id, path, kind, tier order by byte_length, unit_id) - 1 as ordinal
      from v_units""",
    "c05_inventory_diff": f"""{_INV} select run_id, path, case when b.sha256 is null then 'added' when a.sha256 is null then 'deleted' else 'changed' end as change
      from before b full join after a using (run_id, path) where b.sha256 is distinct from a.sha256""",
    "d21_inventory_digest": f"""with v as ({SOURCES}), l as (select run_id, path, path || chr(9) || strlen(content) || chr(9) || sha256(content) as line from v),
      b as (select run_id, substr(sha256(path), 1, 4) as block, sha256(string_agg(line, chr(10) order by path, line)) as digest from l group by 1, 2)
      select run_id, sha256(string_agg(block || ' ' || digest, chr(10) order by block)) as digest from b group by 1""",
    "a21_latest_run": f"""with v as ({EVENTS}), r as (select run_id, unit % 5 as source, max(date_trunc('hour', ts)) as finished_at from v group by 1, 2)
      select source, run_id from (select *, row_number() over (partition by source order by finished_at desc, run_id desc) as n from r) where n = 1""",
    "c13_cache_store": f"""{_U}, k as (select *, {_KEY_SQL} as key from v_units), c as (select key from k where status = 'completed' and unit_id % 2 = 0)
      select key as cache_key from c union select key from k where key not in (select key from c) and status in ('completed', 'partial') and unit_id % 5 <> 0""",
    "c13_cache_lookup": f"""{_U}, k as (select *, {_KEY_SQL} as key from v_units),
      h as (select k.*, key in (select key from k where status = 'completed') as hit from k)
      select run_id, count(*) filter (hit) as hits, count(*) filter (not hit) as misses,
        count(*) filter (not hit and status in ('completed', 'partial')) as stored from h group by 1""",
    "e31_process_outcome": f"""with v as ({EVENTS}) select event_id, case when unit % 7 = 0 then 'interrupted'
      when status = 'error' and event_id % 3 = 0 then 'partial' when status = 'error' then 'timed_out' when event_id % 2 = 0 then 'completed'
      when event_id % 3 = 0 then 'partial' else 'failed' end as outcome from v""",
    "e31_finish_status": f"""with v as ({EVENTS}), f as (select event_id, event_id % 3 <> 0 as valid, case unit % 5 when 0 then 'completed' when 1 then 'partial'
        when 2 then 'interrupted' when 3 then case when status = 'error' then 'failed' else 'failed' end else 'failed' end as state from v)
      select event_id, case when state in ('completed', 'partial') and not valid then 'failed' else state end as unit_status from f""",
    "w04_merged_spans": f"""{_S}, r as (select *, max(end_byte) over (partition by file_id order by start_byte, end_byte, seq
        rows between unbounded preceding and 1 preceding) as reach from v where end_byte > start_byte),
      i as (select *, sum(case when reach is null or start_byte > reach then 1 else 0 end) over (partition by file_id order by start_byte, end_byte, seq
        rows unbounded preceding) as island from r)
      select file_id, min(start_byte) as start_byte, max(end_byte) as end_byte from i group by file_id, island""",
    "w05_tiling_problems": f"""{_S}, f as (select file_id, count(*) * 30 as size from v group by 1),
      r as (select *, greatest(0, coalesce(max(end_byte) over (partition by file_id order by start_byte, end_byte, seq
        rows between unbounded preceding and 1 preceding), 0)) as c from v)
      select file_id, case when start_byte > c then 'gap' else 'overlap' end as problem, least(start_byte, c) as p_start,
        case when start_byte > c then start_byte else least(c, end_byte) end as p_end from r where start_byte <> c
      union all select file_id, case when c < size then 'gap' else 'overlap' end, least(c, size), greatest(c, size)
        from (select file_id, greatest(0, max(end_byte)) as c from v group by 1) join f using (file_id) where c <> size""",
    "c10_containing_arms": f"""{_S}, p as (select distinct file_id, end_byte as o from v), a as (select *, '#if T' || tag % 10 as label from v where tag % 3 = 0)
      select p.file_id, p.o as "offset", coalesce(string_agg(label, ' && ' order by seq, label), '') as condition
      from p left join a on a.file_id = p.file_id and a.start_byte <= p.o and p.o < a.end_byte group by 1, 2""",
    "c11_dead_units": f"""{_S} select file_id, seq, start_byte, end_byte, exists (select 1 from v d where d.file_id = u.file_id and d.tag % 5 = 0
        and u.start_byte < d.end_byte and d.start_byte < u.end_byte) as dead from v u""",
    "w06_tiles": f"""with recursive v as ({SPANS}), f as (select file_id, count(*) * 30 as size from v group by 1),
      t as (select v.*, size, row_number() over (partition by file_id order by start_byte, end_byte, seq) as n from v join f using (file_id)),
      g as (select file_id, size, 0::bigint as n, 0::bigint as cursor, 0::bigint as s, 0::bigint as e, false as ok, 0::bigint as was from f
        union all select t.file_id, t.size, t.n, case when t.start_byte >= g.cursor and t.end_byte <= t.size and t.end_byte > t.start_byte then t.end_byte else g.cursor end,
          t.start_byte, t.end_byte, t.start_byte >= g.cursor and t.end_byte <= t.size and t.end_byte > t.start_byte, g.cursor
          from g join t on t.file_id = g.file_id and t.n = g.n + 1)
      select file_id, 'function' as kind, s as start_byte, e as end_byte from g where ok
      union all select file_id, 'module-scope', was, s from g where ok and s > was
      union all select file_id, 'module-scope', max(cursor), max(size) from g group by file_id having max(size) > max(cursor)""",
}
