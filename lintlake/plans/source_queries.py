"""Registered queries of the source index: every document becomes the text of a C file, whole."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from lintlake.operators import source_index as X
from lintlake.plans.bindings import PIECES, VIEWS, view

_ALL = " || ".join(PIECES)
_FIELDS = "run_id, path, ord, name, start_byte, end_byte, body_start, line_start, line_end, signature, kr_style, macro_header, conditional, dead"


def _index(s, d):
    return X.source_index(view(s, d, "v_csources").select("run_id", "path", "content"))


def _q(step):
    return lambda s, d: step(_index(s, d))


def _definitions(index):
    tables = [X.definition_table(index, t).withColumn("section", F.lit(t)) for t in ("types", "macros", "globals")]
    out = tables[0].unionByName(tables[1]).unionByName(tables[2])
    return out.select("run_id", "section", "name", "kind", "path", "line", "definition", "duplicates")


def _calls(index):
    return X.call_edges(index, X.symbol_table(index))


def _directives_only(text):
    """A parser of another kind: what a file includes, and nothing else."""
    found = re.finditer(r'(?m)^#include\s*([<"])([^>"\n]*)', text)
    return {"includes": [{"target": m[2], "system": m[1] == "<", "line": text.count("\n", 0, m.start()) + 1} for m in found]}


def _two_parsers(s, d):
    """Texts are read for their includes only, other headers by a parser that does not exist, the rest as C."""
    files = view(s, d, "v_csources").select("run_id", "path", "content")
    kind = F.when(F.endswith("path", F.lit(".txt")), "directives").when(F.endswith("path", F.lit(".hpp")), "d")
    index = X.source_index(files, {"directives": _directives_only}, kind).where("readable")
    return index.select(
        "run_id", "path", F.size("functions").alias("functions"), F.size("macros").alias("macros"),
        F.array_join(F.transform("includes", lambda i: i["target"]), ",").alias("includes"), F.expr("get(parse_problems, 0) = 'no parser d'").alias("unknown"),
    ).fillna(False, ["unknown"])


QUERIES = {
    "x01_x05_two_parsers": _two_parsers,
    "x02_source_index": _q(
        lambda i: X.part(i, "functions").select(*_FIELDS.split(", "), F.array_join("calls", ",").alias("calls"))
    ),
    "d13_index_totals": _q(X.totals),
    "d22_symbol_table": _q(X.symbol_table),
    "d23_definitions": _q(_definitions),
    "c06_resolved_calls": _q(_calls),
    "c07_callers": _q(
        lambda i: X.callers(_calls(i)).select("run_id", "callee", F.array_join("callers", ",").alias("callers"))
    ),
    "d26_u05_parse_confidence": _q(
        lambda i: i.select("run_id", "path", "parse_confidence", F.array_join("parse_problems", ",").alias("problems"), "unparsed_from")
    ),
    "w15_conditional_arms": _q(lambda i: X.part(i, "conditionals")),
    "e17_macros": _q(lambda i: X.part(i, "macros")),
    "e17_includes": _q(lambda i: X.part(i, "includes")),
    "w17_declarations": _q(
        lambda i: X.part(i, "types").unionByName(X.part(i, "globals")).select(
            "run_id", "path", "name", "kind", "start_byte", "end_byte", "line", "definition"
        )
    ),
    "b24_unreadable": _q(
        lambda i: i.where("not readable").select(
            "run_id", "path", "parse_confidence", F.array_join("parse_problems", ",").alias("problems"),
            F.size("functions").alias("functions"),
        )
    ),
}

_upto = lambda k: " || ".join(PIECES[:k]) if k else "''"
_bytes = lambda e: f"strlen({e})"
_line = lambda e: f"(length({e}) - length(replace({e}, chr(10), '')) + 1)::int"
_V = f"with v as ({VIEWS['v_csources']}), r as (select * from v where content is not null)"


def _function(ord_, k, name, signature, body_at, conditional, old, calls):
    """A function that piece ``k`` is, with its body after ``body_at`` bytes of the piece."""
    head, whole = _upto(k), _upto(k + 1)
    return f"""select run_id, path, {ord_} as ord, {name} as name, {_bytes(head)} as start_byte, {_bytes(whole)} as end_byte,
      {_bytes(head)} + {body_at} as body_start, {_line(head)} as line_start, {_line(whole)} as line_end, {signature} as signature,
      {old} as kr_style, false as macro_header, {conditional} as conditional, false as dead, {calls} as calls from r"""


_HELPER, _BACK, _OLD = "'helper_' || doc_id % 35", "'fallback_' || doc_id % 12", "'old_' || doc_id % 15"
_FUNCTIONS = " union all ".join(
    (
        _function(0, 7, _HELPER, f"'static int ' || {_HELPER} || '(int a, char *b)'", "position(chr(123) in p7) - 1",
                  "'#ifdef CONFIG_' || doc_id % 3", "false", "'helper_' || doc_id % 40 || ',log_' || doc_id % 10"),
        _function(1, 9, _BACK, f"'int ' || {_BACK} || '(void)'", "position(chr(123) in p9) - 1", "'#else'", "false", "'MIN'"),
        _function(2, 11, _OLD, f"'int ' || {_OLD} || '(a, b) int a; char *b;'", "position(chr(123) in p11) - 1", "''", "true",
                  _BACK),
    )
)
_F = f"{_V}, f as ({_FUNCTIONS})"
_declared = lambda k, name, kind, definition: f"""select run_id, path, {name} as name, '{kind}' as kind, {_bytes(_upto(k))} as start_byte,
    {_bytes(_upto(k + 1))} - 1 as end_byte, {_line(_upto(k))} as line, {definition} as definition from r"""  # noqa: E731
_TYPES = _declared(3, "'item_t_' || doc_id % 30", "typedef", "rtrim(p3, chr(10))")
_GLOBALS = (
    _declared(4, "'helper_' || doc_id % 40", "prototype", "rtrim(p4, chr(10))")
    + " union all "
    + _declared(5, "'counter_' || doc_id % 25", "global", "rtrim(p5, chr(10))")
)
_FIRST_BYTE = "strlen(p0 || p1)"
_LIMIT = "'#define LIMIT_' || doc_id % 20 || ' ' || doc_id % 7"
_MACROS = f"""select run_id, path, 0 as ord, 'LIMIT_' || doc_id % 20 as name, false as function_like, {_FIRST_BYTE} as start_byte,
    {_FIRST_BYTE} + strlen({_LIMIT}) as end_byte, {_line("p0 || p1")} as line, {_LIMIT} as definition from r
  union all select run_id, path, 1, 'MIN', true, {_FIRST_BYTE} + strlen({_LIMIT}) + 1, {_bytes(_upto(3))} - 1,
    {_line("p0 || p1")} + 1, '#define MIN(a, b) ' || chr(92) || ' ((a) < (b) ? (a) : (b))' from r"""
_ENDS = f"(strlen({_upto(12)}) + 1)"
_SYMBOLS = f"""{_F}, g as ({_GLOBALS}),
  s as (select run_id, path, ord, name, 'function' as kind, line_start as line, signature, 0 as later,
      'defined at ' || path || ':' || line_start || '-' || line_end || '; calls ' || replace(calls, ',', ', ') as summary from f
    union all select run_id, path, 0, name, kind, line, rtrim(definition, ';'), 1, 'declared in ' || path from g where kind = 'prototype'),
  symbols as (select run_id, name, path, kind, line, signature, summary, n - 1 as duplicates from (
    select *, row_number() over w as k, count(*) over (partition by run_id, name) as n from s
    window w as (partition by run_id, name order by later, path, ord)) where k = 1),
  edges as (select distinct f.run_id, f.path || '::' || f.name as caller, c as callee
    from f, unnest(string_split(f.calls, ',')) as t(c) join symbols y on y.run_id = f.run_id and y.name = c)"""

_OF = lambda other, c: f"case doc_id % 6 when 4 then {other} when 3 then 0 else {c} end::int"
ORACLES = {
    "x01_x05_two_parsers": f"""{_V} select run_id, path, {_OF(0, 3)} as functions, {_OF(0, 2)} as macros,
      case when doc_id % 6 = 3 then '' else 'sys/k' || doc_id % 4 || '.h,m' || doc_id % 50 || '.h' end as includes, doc_id % 6 = 3 as unknown from r""",
    "x02_source_index": f"{_F} select {_FIELDS}, calls from f",
    "d13_index_totals": f"""{_V} select run_id, count(*) as files, 3 * count(content) as functions, coalesce(sum(strlen(content)), 0)::bigint as bytes,
        count(*) - count(content) as unreadable,
        count(*) - count(content) + count(*) filter (content is not null and doc_id % 10 in (3, 7) and confidence < 0.5) as parse_confidence_low
        from (select *, case when doc_id % 10 = 3 then 0.4 - 0.5 * strlen(substr(p12, 2)) / strlen(content) else 1 - 0.4 - 0.1 end as confidence from v)
        group by 1""",
    "d22_symbol_table": f"{_SYMBOLS} select * from symbols",
    "d23_definitions": f"""{_V}, t as (select 'types' as section, * from ({_TYPES}) union all select 'globals', * from ({_GLOBALS}) where kind = 'global'
        union all select 'macros', run_id, path, name, 'macros', start_byte, end_byte, line, definition from ({_MACROS}))
        select run_id, section, name, kind, path, line, definition, n - 1 as duplicates from (
          select *, row_number() over (partition by run_id, section, name order by path) as k, count(*) over (partition by run_id, section, name) as n
          from t) where k = 1""",
    "c06_resolved_calls": f"{_SYMBOLS} select * from edges",
    "c07_callers": f"""{_SYMBOLS} select run_id, callee, array_to_string(list_sort(list(distinct regexp_replace(caller, '^.*::', '')))[:32], ',') as callers
        from edges group by 1, 2""",
    "d26_u05_parse_confidence": f"""{_V} select run_id, path, case when content is null then 0.0 else round(
          case doc_id % 10 when 3 then 0.5 when 7 then 0.6 when 5 then 0.8 else 1.0 end - 0.1
          - case when doc_id % 10 = 3 then 0.5 * (strlen(content) - {_ENDS}) / strlen(content) else 0 end, 4) end as parse_confidence,
        case when content is null then 'unreadable' else case doc_id % 10 when 3 then 'unbalanced braces'
          when 7 then 'unterminated string or character literal' when 5 then 'unbalanced closing brace' else '' end end as problems,
        case when content is not null and doc_id % 10 = 3 then {_ENDS} end as unparsed_from from v""",
    "w15_conditional_arms": f"""{_V}, h as (select *, strlen({_upto(6)}) as a, strlen(p6) - 1 as na, strlen({_upto(8)}) + 1 as b,
          strlen({_upto(10)}) + 1 as c, {_line(_upto(6))} as la, {_line(f"{_upto(8)} || chr(10)")} as lb, {_line(f"{_upto(10)} || chr(10)")} as lc,
          strlen('int dead_' || doc_id % 5 || '(void) ' || chr(123) || ' return 0; ' || chr(125)) as nd from r)
        select run_id, path, 0 as ord, 'ifdef' as kind, 'CONFIG_' || doc_id % 3 as condition, 0 as depth, a as start, a + na as body_start, b as body_end,
          la as line_start, lb - 1 as line_end, false as dead from h
        union all select run_id, path, 1, 'else', '', 0, b, b + 5, c, lb, lc - 1, false from h
        union all select run_id, path, 2, 'if', '0', 0, c + 7, c + 12, c + 12 + 1 + nd + 1, lc + 1, lc + 2, true from h""",
    "e17_macros": f"{_V} {_MACROS}",
    "e17_includes": f"""{_V} select run_id, path, 0 as ord, 'sys/k' || doc_id % 4 || '.h' as target, true as system, {_line("p0")} as line from r
        union all select run_id, path, 1, 'm' || doc_id % 50 || '.h', false, {_line("p0")} + 1 from r""",
    "w17_declarations": f"{_V} {_TYPES} union all {_GLOBALS}",
    "b24_unreadable": f"""{_V} select run_id, path, 0.0 as parse_confidence, 'unreadable' as problems, 0 as functions from v where content is null""",
}
