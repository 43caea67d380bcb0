"""Registered queries of the review operators, each with the SQL of its result."""

from __future__ import annotations

from pyspark.sql import functions as F

from lintlake.functions import severity as S
from lintlake.operators import review as R
from lintlake.operators.ordering import keep
from lintlake.plans.bindings import FINDINGS, view


def _case(value: str, table: dict, default: object) -> str:
    quote = lambda v: f"'{v}'" if isinstance(v, str) else str(v)
    arms = " ".join(f"when {quote(k)} then {quote(v)}" for k, v in table.items())
    return f"case {value} {arms} else {quote(default)} end"


_NUMBER = "case when isnan(try_cast(raw as double)) then -1 else try_cast(raw as double) end"
_BY_NUMBER = " ".join(
    f"when number >= case when severity_scale = 'security-severity' then {a} else {b} end then '{name}'"
    for name, a, b in (("critical", 9, 5), ("high", 7, 4), ("medium", 4, 3))
)
_CWE_ARMS = " ".join(f"when num in ({', '.join(map(str, ns))}) then '{c}'" for c, ns in S.CWE_CATEGORIES)
_LLM_CWE_ARMS = " ".join(
    f"when engine = 'llm' and num in ({', '.join(map(str, ns))}) then '{c}'" for c, ns in S.SCANNER_CWE_CATEGORIES
)
_WORD_ARMS = " ".join(f"when regexp_matches(val, '{p}', 'i') then '{c}'" for c, p in S.KEYWORDS)
_LLM_WORD_ARMS = " ".join(
    f"when engine = 'llm' and regexp_matches(val, '{p}', 'i') then '{c}'" for c, p in S.SCANNER_KEYWORDS
)
_INGEST = ", ".join(R.INGEST)

#: CTEs that derive the reviewed findings.
REVIEW = f"""with v as ({FINDINGS}),
first as (select * from (select *, row_number() over (
    partition by run_id, {", ".join(R.FINDING_KEY)} order by {_INGEST}) as n from v) where n = 1),
g1 as (select *, lower(regexp_replace(original_severity, '^\\s+|\\s+$', '', 'g')) as raw,
    lower(declared) as named, concat_ws(' ', cwe, rule_id, message) as val from first),
g2 as (select *, {_NUMBER} as number,
    try_cast(regexp_extract(val, '(?i)CWE-?(\\d+)', 1) as int) as num from g1),
g3 as (select *,
    case when engine = 'llm' then {_case("raw", {k: k for k in S.SEVERITY_RANK}, "unknown")}
         when tool = 'cppcheck' then {_case("raw", S.CPPCHECK_SEVERITY, "unknown")}
         when tool = 'flawfinder' and number is null then {_case("raw", S.FLAWFINDER_WORDS, "unknown")}
         when tool = 'flawfinder' then case {_BY_NUMBER} when number > 0 then 'low' when number = 0 then 'info' else 'unknown' end
         else 'unknown' end as severity,
    case when raw in ('information', 'style', 'warning', 'error') then raw else 'unmapped' end as review_level,
    case when engine = 'llm' and named <> '' then {_case("named", {k: v for k, v in S.CATEGORY_ALIASES.items() if k}, "?")}
         {_CWE_ARMS} {_LLM_CWE_ARMS} {_WORD_ARMS} {_LLM_WORD_ARMS}
         when num is not null then 'CWE-' || num else 'unknown' end as category0
    from g2),
g4 as (select *, case when category0 = '?' then named else category0 end as category,
    {_case("severity", S.SEVERITY_RANK, 0)} as rank, {_case("tool", {p: i for i, p in enumerate(S.PRODUCERS)}, 6)} as producer_rank,
    cast(line as int) as line_no, file as canonical_path, engine = 'static' as gate_eligible,
    sha256(concat_ws(chr(0), lower(tool), lower(file), line, col, lower(rule_id), lower(message))) as fingerprint
    from g3),
review as (select *, row_number() over (partition by run_id order by rank desc, producer_rank, canonical_path, line_no, line,
    fingerprint, {_INGEST}) as sort_pos from g4)
"""

_SHOWN = "run_id, sort_pos, tool, canonical_path, line, rule_id, severity, rank, review_level, category, fingerprint"


def _review(spark, sf_dir):
    return R.reviewed(view(spark, sf_dir, "v_findings"))


_BARE = _SHOWN.replace("sort_pos, ", "")


def _shown(rows, columns=_BARE):
    return rows.select(*columns.split(", "))


def _q(step):
    return lambda spark, sf_dir: step(_review(spark, sf_dir))


def _top(column, keep_empty=True):
    return _q(lambda r: R.top_values(r, column, keep_empty=keep_empty).select("run_id", "value", "n", "place"))


def _top_sql(column, keep_empty=True):
    where = "" if keep_empty else f"where {column} <> ''"
    return f"""{REVIEW} select run_id, value, n, place from (
      select *, row_number() over (partition by run_id order by n desc, p) as place from (
        select run_id, case when {column} = '' then '<unknown>' else {column} end as value, count(*) as n, min(sort_pos) as p
        from review {where} group by 1, 2)) where place <= 20"""


def _fair_cap_sql(cap):
    return f"""{REVIEW}, t as (select run_id, engine, count(*) as total from review group by 1, 2),
    s as (select *, least(total, floor({cap} / count(*) over (partition by run_id))) as quota,
          case engine when 'static' then 0 else 1 end as o from t),
    u as (select *, {cap} - sum(quota) over (partition by run_id) as spare,
          coalesce(sum(total - quota) over (partition by run_id order by o rows between unbounded preceding and 1 preceding), 0) as before from s),
    w as (select run_id, engine, quota + greatest(0, least(total - quota, spare - before)) as quota from u)
    select {_BARE} from (select r.*, w.quota, row_number() over (partition by r.run_id, r.engine order by sort_pos) as place
      from review r join w on r.run_id = w.run_id and r.engine = w.engine) where place <= quota"""


_OVERLAP_SQL = """{review}, rows as (select * from review where canonical_path <> '' {native}),
lines as (select run_id, canonical_path, category, list_sort(list(distinct line_no)) as ls from rows group by 1, 2, 3),
firsts as (select run_id, canonical_path, category, list_reduce(list_transform(ls, lambda x: [x]),
    lambda acc, x: case when x[1] - acc[-1] <= case when category = 'unknown' then 0 else 3 end then acc else acc || x end) as anchors from lines),
anchored as (select r.*, list_max(list_filter(anchors, lambda a: a <= r.line_no)) as line_start
    from rows r join firsts f on r.run_id = f.run_id and r.canonical_path = f.canonical_path and r.category = f.category)
select run_id, substr(sha256(concat_ws(chr(0), canonical_path, category, cast(line_start as varchar), cast(max(line_no) as varchar))), 1, 16) as id,
  canonical_path, category, line_start, max(line_no) as line_end,
  array_to_string(list_transform(list_sort(list(distinct [cast(producer_rank as varchar), tool])), lambda t: t[2]), ',') as tools,
  string_agg(fingerprint, ',' order by line_no, producer_rank, sort_pos) as fingerprints,
  case when not bool_or(engine = 'llm') then 'static-only' when bool_and(engine = 'llm') then 'llm-only' else 'both' end as origin
from anchored group by run_id, canonical_path, category, line_start having count(distinct tool) >= {least}"""

_SETS = "(run_id, measure, value), (run_id, measure, value, evidence_context), (run_id, measure, value, engine)"
_NAMES = list(S.SEVERITY_RANK)
_MODES = {"priority": "rank desc", "location": "canonical_path, line_no", "tool": "tool", "rule": "rule_id"}


def _page_sql(mode, number, size):
    return f"""{REVIEW} select {_BARE}, place from (
      select *, row_number() over (partition by run_id order by {_MODES[mode]}, sort_pos) as place,
        greatest(1, ceil(count(*) over (partition by run_id) / {size})) as last from review)
      where place > (least({number}, last) - 1) * {size} and place <= least({number}, last) * {size}"""


def _page(mode, number, size):
    def run(spark, sf_dir):
        firsts = R.first_of_each(view(spark, sf_dir, "v_findings"), R.FINDING_KEY)
        return R.page(firsts, mode, number, size).select(*_BARE.split(", "), "place")

    return run


_FINDING_FIELDS = "run_id, tool, evidence_context, file, line, rule_id, message, l_orderkey, l_linenumber"
_MARK = (
    "'- review level `' || review_level || '`; normalized severity `' || severity || '`; `' || tool || '` `' || evidence_context"
    " || '` `' || rule_id || '` ' || canonical_path || ':' || line || ' — ' || message"
)

def _drill_down(review):
    """The review is written once, as the groups and the findings in them are both made of it."""
    review = keep(review, "review")
    members = R.overlap_groups(review).select("run_id", F.explode(F.split("fingerprints", ",")).alias("fingerprint"))
    return _shown(review.join(members, ["run_id", "fingerprint"], "left_semi"))


def _thrice(rows):
    """The table read three times: every row shares its place with two copies of itself."""
    return rows.withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).drop("copy")


QUERIES = {
    "u01_w01_first_findings": lambda s, d: R.first_of_each(view(s, d, "v_findings"), R.FINDING_KEY).select(
        *_FINDING_FIELDS.split(", ")
    ),
    "w01_repeated_findings": lambda s, d: R.first_of_each(_thrice(view(s, d, "v_findings")), R.FINDING_KEY).select(
        *_FINDING_FIELDS.split(", ")
    ),
    "d03_repeated_findings": lambda s, d: R.tool_summary(R.reviewed(_thrice(view(s, d, "v_findings")))),
    "e02_severity": lambda s, d: R.graded(view(s, d, "v_findings"))
    .groupBy("tool", "original_severity", "severity_scale", "severity", "rank")
    .agg(F.count(F.lit(1)).alias("n")),
    "e04_review_level": lambda s, d: R.graded(view(s, d, "v_findings"))
    .groupBy("original_severity", "review_level")
    .agg(F.count(F.lit(1)).alias("n")),
    "e06_fingerprint": _q(lambda r: r.select("run_id", "l_orderkey", "l_linenumber", "fingerprint")),
    "e07_category": _q(lambda r: r.groupBy("engine", "declared", "cwe", "message", "category").agg(F.count(F.lit(1)).alias("n"))),
    "w19_total_order": lambda s, d: R.ordered_findings(view(s, d, "v_findings"), tuple(_SHOWN.split(", "))),
    "d01_severity_counts": _q(R.severity_counts),
    "d03_tool_summary": _q(R.tool_summary),
    "d06_top_files": _top("canonical_path"),
    "d06_top_rules": _top("rule_id"),
    "d06_top_cwes": _top("cwe", keep_empty=False),
    "d18_heat_map": _q(R.heat_map),
    "d19_tool_chart": _q(lambda r: R.tool_summary(r).where("build_aware > 0 or source_only > 0")),
    "d20_facet_counts": _q(lambda r: r.groupBy("run_id", "evidence_context").agg(F.count(F.lit(1)).alias("n"))),
    "b14_gate": _q(lambda r: R.gate(r, "critical")),
    "b20_faceted": _q(lambda r: _shown(R.faceted(r, context="build-aware", engine="static", severity="high", text="BUFFER"))),
    "o04_w14_page_location": _page("location", 2, 50),
    "o04_w14_page_rule_last": _page("rule", 10_000, 50),
    "o04_w14_page_tool": _page("tool", 1, 25),
    "o04_w14_page_priority": _page("priority", 3, 25),
    "w09_fair_cap": _q(lambda r: _shown(R.fair_cap(r, 200))),
    "w02_overlap_groups": _q(R.overlap_groups),
    "z01_cross_engine_groups": _q(lambda r: R.overlap_groups(r, least=1, native_only=False)),
    "c14_overlap_drill_down": _q(_drill_down),
    "a16_markdown": _q(lambda r: R.markdown(r, 50)),
}

ORACLES = {
    "u01_w01_first_findings": f"{REVIEW} select {_FINDING_FIELDS} from first",
    "e02_severity": REVIEW.replace("where n = 1", "")
    + " select tool, original_severity, severity_scale, severity, rank, count(*) as n from g4 group by all",
    "e04_review_level": REVIEW.replace("where n = 1", "")
    + " select original_severity, review_level, count(*) as n from g4 group by all",
    "e06_fingerprint": f"{REVIEW} select run_id, l_orderkey, l_linenumber, fingerprint from review",
    "e07_category": f"{REVIEW} select engine, declared, cwe, message, category, count(*) as n from review group by all",
    "w19_total_order": f"{REVIEW} select {_SHOWN} from review",
    "d01_severity_counts": f"""{REVIEW}, long as (
        select run_id, evidence_context, engine, 'severity' as measure, severity as value from review union all
        select run_id, evidence_context, engine, 'review_level', review_level from review)
        select run_id, measure, value, evidence_context, engine, count(*) as n from long group by grouping sets ({_SETS})""",
    "d03_tool_summary": f"""{REVIEW} select run_id, tool, count(*) as total, count(*) filter (evidence_context = 'build-aware') as build_aware,
        count(*) filter (evidence_context = 'source-only') as source_only from review group by 1, 2""",
    "d06_top_files": _top_sql("canonical_path"),
    "d06_top_rules": _top_sql("rule_id"),
    "d06_top_cwes": _top_sql("cwe", keep_empty=False),
    "d18_heat_map": f"""{REVIEW} select * from (select *, row_number() over (partition by run_id order by total desc, canonical_path) as place
        from (select run_id, canonical_path, {", ".join(f"count(*) filter (severity = '{n}') as {n}" for n in _NAMES)}, count(*) as total
              from review group by 1, 2)) where place <= 12""",
    "d20_facet_counts": f"{REVIEW} select run_id, evidence_context, count(*) as n from review group by 1, 2",
    "b14_gate": f"{REVIEW} select run_id, bool_or(rank >= 5 and gate_eligible) as tripped from review group by 1",
    "b20_faceted": f"""{REVIEW} select {_BARE} from review where evidence_context = 'build-aware' and engine = 'static' and severity = 'high'
        and (contains(lower(rule_id), 'buffer') or contains(lower(cwe), 'buffer') or contains(lower(canonical_path), 'buffer')
             or contains(lower(message), 'buffer'))""",
    "o04_w14_page_location": _page_sql("location", 2, 50),
    "o04_w14_page_rule_last": _page_sql("rule", 10_000, 50),
    "o04_w14_page_tool": _page_sql("tool", 1, 25),
    "o04_w14_page_priority": _page_sql("priority", 3, 25),
    "w09_fair_cap": _fair_cap_sql(200),
    "w02_overlap_groups": _OVERLAP_SQL.format(review=REVIEW, native="and engine = 'static'", least=2),
    "z01_cross_engine_groups": _OVERLAP_SQL.format(review=REVIEW, native="", least=1),
    "a16_markdown": f"""{REVIEW} select run_id, string_agg({_MARK}, chr(10) order by sort_pos) as findings
        from review where sort_pos <= 50 group by 1""",
}
_THRICE = REVIEW.replace("from v)", "from (select v.* from v cross join range(3)))", 1)
assert _THRICE != REVIEW
ORACLES["w01_repeated_findings"] = f"{_THRICE} select {_FINDING_FIELDS} from first"
ORACLES["d03_repeated_findings"] = ORACLES["d03_tool_summary"].replace(REVIEW, _THRICE)
ORACLES["d19_tool_chart"] = ORACLES["d03_tool_summary"]
_inner = _OVERLAP_SQL.format(review="", native="and engine = 'static'", least=2).lstrip(", \n")
_ctes, _, _final = _inner.partition("\nselect run_id, substr")
ORACLES["c14_overlap_drill_down"] = (
    f"{REVIEW}, {_ctes}, og as (select run_id, substr{_final}) select {_BARE} from review r"
    " where exists (select 1 from og where og.run_id = r.run_id and contains(og.fingerprints, r.fingerprint))"
)
