"""Registered queries of the planner over the C files made of documents; they stand on the index queries' SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lintlake.operators import planner as P
from lintlake.operators import source_index as X
from lintlake.operators.accounting import TIERS
from lintlake.operators.ordering import keep
from lintlake.operators.spans import chunks
from lintlake.plans.bindings import SOURCES, view
from lintlake.plans.source_queries import _F, _SYMBOLS, _V, _bytes, _upto


def _index(s, d):
    files = view(s, d, "v_csources").select("run_id", "path", "content", F.col("content").cast("binary").alias("raw"))
    return keep(X.source_index(files), "index", "zstd")


def _units(s, d):
    return P.scan_units(_index(s, d))


def _full(s, d):
    index = _index(s, d)
    return P.with_context(keep(P.scan_units(index), "units", "zstd"), index, keep(X.symbol_table(index), "symbols", "zstd"))


_names = lambda c: F.array_join(F.transform(F.coalesce(c, F.array()), lambda e: e["name"]), ",")

QUERIES = {
    "x03_w06_w07_segments": lambda s, d: _units(s, d).groupBy("run_id", "path", "kind").agg(
        F.min("start_byte").alias("first"), F.max("end_byte").alias("last"), F.sum("byte_length").alias("bytes"),
        F.bool_or("dead").alias("dead"), F.max("line_end").alias("line_end"),
    ),
    "x03_function_units": lambda s, d: _units(s, d).where("kind = 'function'").select(
        "run_id", "path", "name", "ordinal", "unit_id", "start_byte", "signature", "conditional", "risk_tier", "risk_reason"
    ),
    "x03_every_byte_once": lambda s, d: _units(s, d).groupBy("run_id", "path").agg(
        F.sum("byte_length").alias("bytes"), F.max("end_byte").alias("size"), F.max("byte_length").alias("longest")
    ).select("run_id", "path", "bytes", "size", (F.col("longest") <= P.MOST_BYTES).alias("within")),
    "w08_chunks": lambda s, d: view(s, d, "v_sources").select("run_id", "path", F.regexp_replace("content", r"[^\x01-\x7F]", "?").alias("t")).select(
        "run_id", "path", F.array_join(F.transform(chunks(F.col("t"), 700), lambda x: x.cast("string")), ",").alias("ends")
    ),
    "c08_referenced": lambda s, d: _full(s, d).where("kind = 'function'").select(
        "run_id", "path", "name", _names("types").alias("types"), _names("macros").alias("macros"), _names("globals").alias("globals")
    ),
    "c09_callees_callers": lambda s, d: _full(s, d).where("kind = 'function'").select(
        "run_id", "path", "name", F.array_join(F.transform(F.coalesce("callees", F.array()), lambda e: F.concat_ws("|", e["name"], e["signature"])), ",").alias("callees"),
        _names("callers").alias("callers"),
    ),
    "x04_prompts": lambda s, d: P.unit_prompts(_full(s, d)).select(
        "run_id", "unit_id", F.length("prompt").cast("long").alias("chars"), F.sha2("prompt", 256).alias("prompt_sha256")
    ),
    "c16_ranks": lambda s, d: view(s, d, "v_units").select("tier", "producer").distinct().select(
        "tier", "producer", P.rank_of(F.upper("tier"), TIERS).alias("tier_rank"), P.rank_of(F.col("producer"), ("llm-security",)).alias("producer_rank")
    ),
}

_TAIL = f"strlen({_upto(12)})"
_GAPS = "v2 as (select *, strlen(content) as size, strlen(" + _upto(7) + ") as a, strlen(" + _upto(8) + ") as b, strlen(" + _upto(9) + ") as c, strlen(" + _upto(10) + f") as e, strlen({_upto(11)}) as f, {_TAIL} as g from r)"
_LINES = "(length({0}) - length(replace({0}, chr(10), '')) + 1)::int"
_ORDER = "list_sort(list(distinct regexp_replace(caller, '^.*::', '')))[:32]"
ORACLES = {
    "x03_function_units": f"""{_F} select run_id, path, name, (row_number() over (partition by run_id, path, name order by start_byte) - 1)::int as ordinal,
        substr(regexp_replace(replace(path, '/', '__'), '[^A-Za-z0-9._-]', '_', 'g'), 1, 80) || '-' || substr(sha256(concat_ws(chr(0), path, 'function', name,
          (row_number() over (partition by run_id, path, name order by start_byte) - 1)::varchar)), 1, 12) as unit_id,
        start_byte, signature, conditional,
        case when regexp_matches(path, '\\.(h|hpp)$') then 'low' else 'medium' end as risk_tier,
        case when regexp_matches(path, '\\.(h|hpp)$') then 'header' else 'default' end as risk_reason from f""",
    "x03_w06_w07_segments": f"""{_V}, {_GAPS}
        select run_id, path, 'function' as kind, a as first, case when doc_id % 10 in (5, 7) then g else case when doc_id % 10 = 3 then g + 1 else size end end as last,
          (b - a + e - c + case when doc_id % 10 in (5, 7) then g when doc_id % 10 = 3 then g + 1 else size end - f)::bigint as bytes, false as dead,
          {_LINES.format(_upto(12))} + case when doc_id % 10 in (5, 7) then 0 else 0 end as line_end from v2
        union all select run_id, path, 'module-scope', 0, case when doc_id % 10 in (5, 7) then size else f end,
          (a + c - b + f - e + case when doc_id % 10 in (5, 7) then size - g else 0 end)::bigint, true,
          case when doc_id % 10 in (5, 7) then {_LINES.format("content")} - 1 else {_LINES.format(_upto(11))} - 1 end from v2
        union all select run_id, path, 'raw-span', g + 1, size, (size - g - 1)::bigint, false, {_LINES.format("content")} - 1 from v2 where doc_id % 10 = 3""",
    "x03_every_byte_once": f"""{_V} select run_id, path, strlen(content)::bigint as bytes, strlen(content)::bigint as size, true as within from r""",
    "w08_chunks": f"""with recursive v as ({SOURCES}), t as (select run_id, path, regexp_replace(content, '[^\\x01-\\x7F]', '?', 'g') as t from v),
      c as (select run_id, path, t, 0::bigint as p, [0::bigint] as ends from t
        union all select run_id, path, t, nxt, ends || [nxt] from (select *, case when length(t) - p <= 700 then length(t)
            when position(chr(10) in substr(t, p + 2, 699)) > 0 then p + 700 - position(chr(10) in reverse(substr(t, p + 1, 700))) + 1 else p + 700 end as nxt
          from c where p < length(t)))
      select run_id, path, array_to_string(ends, ',') as ends from c where p >= length(t)""",
    "c08_referenced": f"""{_F} select run_id, path, name, '' as types, case when name like 'fallback_%' then 'MIN,LIMIT_' || doc_id % 20 else '' end as macros,
        '' as globals from f join (select path, doc_id from v) using (path)""",
    "c09_callees_callers": f"""{_SYMBOLS}, byname as (select run_id, callee, array_to_string({_ORDER}, ',') as callers from edges group by 1, 2),
        own as (select f.run_id, f.path, f.name, string_agg(c || '|' || y.signature, ',' order by c) as callees
          from f, unnest(string_split(f.calls, ',')) as t(c) join symbols y on y.run_id = f.run_id and y.name = c group by 1, 2, 3)
        select f.run_id, f.path, f.name, coalesce(callees, '') as callees, coalesce(callers, '') as callers from f
          left join own using (run_id, path, name) left join byname b on b.run_id = f.run_id and b.callee = f.name""",
    "c16_ranks": """with u as (select distinct case substr(o_orderpriority, 1, 1) when '1' then 'critical' when '2' then 'high' when '3' then 'medium' else 'low' end as tier,
        case o_custkey % 3 when 0 then 'llm-memory-safety' when 1 then 'llm-security' else 'llm-firmware-concurrency' end as producer from orders)
      select tier, producer, (list_position(['critical', 'high', 'medium', 'low'], tier) - 1)::int as tier_rank, (producer <> 'llm-security')::int as producer_rank from u""",
}
