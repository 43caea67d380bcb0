"""Registered queries of the response reader: every document is the description of a finding in a model's answer."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from lintlake.plans.bindings import SOURCES, view
from lintlake.sources import responses as R

_TEXT = "replace(replace(replace(replace(replace(content, chr(92), ''), chr(34), ''), chr(10), ' '), chr(13), ' '), chr(9), ' ')"
#: A good finding and one with a fault, in one of nine forms of answer.
RESPONSES = f"""
select run_id, doc_id, said, case
    when doc_id % 9 = 0 and doc_id % 2 = 0 then '[' || a || ',' || b || ']'
    when doc_id % 9 = 0 then '{{"findings":[' || a || ',' || b || ']}}'
    when doc_id % 9 = 1 then 'Here:' || chr(10) || '```json' || chr(10) || '{{"findings":[' || a || ',' || b || ']}}' || chr(10) || '```' || chr(10) || 'bye'
    when doc_id % 9 = 2 then 'I think {{not json}} so {{"unit_id":"u","findings":[' || a || ',' || b || ']}} ok'
    when doc_id % 9 = 3 then '```json' || chr(10) || '{{"findings":[' || a || ',' || b || ']}}'
    when doc_id % 9 = 4 then '{{"findings":[' || a || ',' || b || ', ],}}'
    when doc_id % 9 = 5 then '{{"result":{{"findings":[' || a || ',' || b || ']}}}}'
    when doc_id % 9 = 6 then a when doc_id % 9 = 7 then '{{"findings": "none"}}' else ' ' end as text
from (select run_id, doc_id, {_TEXT} as said,
    '{{"file":" src/a' || doc_id % 30 || '.c ","line_range":[' || (doc_id % 50 + 1) || ',' || (doc_id % 50 + 3)
      || '],"category":"Uninitialised","severity":"HIGH","message":"m ' || doc_id || '","description":"' || {_TEXT} || '",'
      || case doc_id % 4 when 0 then '"cwe":" cwe_0' || (doc_id % 90 + 1) || '"' when 1 then '"cwe":' || (doc_id % 90 + 1) when 2 then '"cwe":" "' else '"cwe":null' end
      || case doc_id % 3 when 0 then ',"confidence":0.25' when 1 then ',"confidence":1' else '' end || '}}' as a,
    case doc_id % 8 when 0 then '{{"file":"","message":"x"}}' when 1 then '{{"file":"f","message":"x","category":"made-up"}}'
      when 2 then '{{"file":"f","message":"x","category":"race","severity":"grave"}}'
      when 3 then '{{"file":"f","message":"x","category":"race","severity":"low","line_range":[9,3]}}'
      when 4 then '{{"file":"f","message":"x","category":"race","severity":"low","line_start":true}}'
      when 5 then '{{"file":"f","message":"x","category":"race","severity":"low","line":4,"cwe":"CVE-1"}}'
      when 6 then '{{"file":"f","message":"x","category":"race","severity":"low","line_range":[4],"confidence":2}}' else '7' end as b
  from v_sources) s
""".replace("{{", "{").replace("}}", "}")
_V = f"with v_sources as ({SOURCES}), r as ({RESPONSES})"
_PARSED = "doc_id % 9 < 7"


def _items(s, d):
    sql = RESPONSES.replace("{", "{{").replace("}", "}}").replace("from v_sources", "from {v}")
    return R.response_items(s.sql(sql, v=view(s, d, "v_sources")))


def _findings(s, d):
    return R.judged(_items(s, d))


QUERIES = {
    "a08_e29_e30_response_findings": lambda s, d: _findings(s, d).where("reason is null").select(
        "run_id", "doc_id", "idx", "file", "line_start", "line_end", "category", "severity", "message",
        F.sha2("description", 256).alias("description"), "cwe", "confidence",
    ),
    "b13_refused_findings": lambda s, d: R.errors(i := _items(s, d), R.judged(i), "doc_id"),
    "e39_schema_hash": lambda s, d: _findings(s, d).groupBy("run_id").agg(
        F.count(F.lit(1)).alias("n"), F.lit(R.schema_hash()).alias("schema_hash")
    ),
}
_DOCUMENT = json.dumps(R.schema_document(), sort_keys=True, separators=(",", ":"))
ORACLES = {
    "a08_e29_e30_response_findings": f"""{_V} select run_id, doc_id, 0 as idx, 'src/a' || doc_id % 30 || '.c' as file, doc_id % 50 + 1 as line_start,
        doc_id % 50 + 3 as line_end, 'uninitialized' as category, 'high' as severity, 'm ' || doc_id as message,
        case when trim(said) <> '' then sha256(trim(said)) end as description,
        case doc_id % 4 when 0 then 'CWE-' || (doc_id % 90 + 1) when 1 then 'CWE-' || (doc_id % 90 + 1) end as cwe,
        case doc_id % 3 when 0 then 0.25 when 1 then 1.0 end as confidence from r where {_PARSED}""",
    "b13_refused_findings": f"""{_V} select doc_id, 'finding[1]: ' || case doc_id % 8 when 0 then 'file must be a non-empty string'
        when 1 then 'category made-up is not a declared category' when 2 then 'severity grave is not one of critical/high/medium/low/info'
        when 3 then 'line_range [9, 3] is not an ordered 1-based range' when 4 then 'line_range entries must be integers'
        when 5 then 'cwe is not in CWE-<number> form' when 6 then 'confidence is not a number in [0, 1]' else 'not an object' end as error
        from r where doc_id % 9 < 6
      union all select doc_id, case doc_id % 9 when 7 then 'response: response has no findings array' else 'response: empty response' end
        from r where doc_id % 9 > 6""",
    "e39_schema_hash": f"""{_V} select run_id, sum(case when doc_id % 9 < 6 then 2 when doc_id % 9 = 6 then 1 else 0 end)::bigint as n,
        sha256('{_DOCUMENT}') as schema_hash from r where {_PARSED} group by 1""",
}
