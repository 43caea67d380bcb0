"""Deterministic views that give every operator an input table of the driver's.

The same SQL text defines a view for Spark and for the oracle.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

FINDINGS = """
select concat('run-', cast(l_orderkey % 16 as varchar(9))) as run_id,
  l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
  case when l_linenumber >= 6 then 'llm' else 'static' end as engine,
  case when l_linenumber >= 6
       then case l_suppkey % 3 when 0 then 'llm-memory-safety' when 1 then 'llm-security' else 'llm-firmware-concurrency' end
       else case l_suppkey % 3 when 0 then 'cppcheck' when 1 then 'flawfinder' else 'splint' end end as tool,
  case when l_linestatus = 'F' then 'build-aware' else 'source-only' end as evidence_context,
  concat('src/m', cast(l_partkey % 20 as varchar(9)), '/f', cast(l_partkey % 7 as varchar(9)), '.c') as file,
  cast(l_orderkey % 400 + 1 as varchar(9)) as line,
  cast(l_suppkey % 5 as varchar(9)) as col,
  concat('R', cast(l_partkey % 11 as varchar(9))) as rule_id,
  case when l_linenumber >= 6
       then case cast(l_quantity as int) % 6 when 0 then 'info' when 1 then 'low' when 2 then 'Medium' when 3 then 'high' when 4 then ' critical ' else 'odd' end
       when l_suppkey % 3 = 1
       then case cast(l_quantity as int) % 9 when 6 then 'error' when 7 then 'nan' when 8 then '9.5' else cast(cast(l_quantity as int) % 9 as varchar(9)) end
       else case l_returnflag when 'A' then 'error' when 'N' then 'warning' else 'style' end end as original_severity,
  case when l_partkey % 2 = 0 then 'security-severity' else 'level' end as severity_scale,
  case l_suppkey % 5 when 0 then 'isr' when 1 then 'Overflow' when 2 then 'dma' else '' end as declared,
  case l_partkey % 8 when 0 then 'CWE-476' when 1 then 'CWE-120' when 2 then 'CWE-457' when 3 then 'CWE-401'
                     when 4 then 'CWE-134' when 5 then 'CWE-330' when 6 then 'CWE-190' else '' end as cwe,
  concat(case l_partkey % 5 when 0 then 'buffer overflow' when 1 then 'data race' when 2 then 'memory leak' when 3 then 'watchdog' else 'finding' end,
         ' on ', l_returnflag, ' ', l_linestatus) as message
from lineitem
"""

UNITS = """
select concat('run-', cast(o_orderkey % 16 as varchar(9))) as run_id, o_orderkey as unit_id,
  concat('src/m', cast(o_custkey % 50 as varchar(9)), '/f', cast(o_orderkey % 40 as varchar(9)), '.c') as path,
  case when o_orderkey % 4 = 0 then 'module' else 'function' end as kind,
  case o_custkey % 3 when 0 then 'llm-memory-safety' when 1 then 'llm-security' else 'llm-firmware-concurrency' end as producer,
  case when o_orderstatus = 'F' and o_orderkey % 5 <> 0 then 'completed'
       else case substr(o_orderpriority, 1, 1) when '1' then 'partial' when '2' then 'failed' when '3' then 'timed_out'
                 when '4' then 'unscheduled' else 'interrupted' end end as status,
  case substr(o_orderpriority, 1, 1) when '1' then 'critical' when '2' then 'high' when '3' then 'medium' else 'low' end as tier,
  o_orderkey % 3 <> 0 as valid_report,
  cast(floor(o_totalprice) as bigint) % 16384 + 1 as byte_length,
  case when o_orderkey % 9 = 0 then 0.4 else 0.9 end as parse_confidence
from orders
"""

SOURCES = """
select concat('run-', cast(doc_id % 4 as varchar(9))) as run_id, doc_id,
  concat(source, '/', lang, '/', cast(doc_id as varchar(20)),
         case doc_id % 6 when 0 then '.c' when 1 then '.h' when 2 then '.CPP' when 3 then '.hpp' when 4 then '.txt' else '.cc' end) as path,
  coalesce(text, '') as content
from documents
"""

EVENTS = """
select event_id, ts, concat('run-', cast(user_id % 8 as varchar(9))) as run_id, user_id as unit, event_type as status,
  value as progress, props
from events
"""

SPANS = """
select l_orderkey as file_id, cast(sum(l_quantity) over w as bigint) - cast(l_quantity as bigint) +
    case when l_partkey % 7 = 0 then 5 when l_partkey % 11 = 0 then -3 else 0 end as start_byte,
  cast(sum(l_quantity) over w as bigint) as end_byte,
  row_number() over w as seq, l_partkey as tag
from lineitem
window w as (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice rows unbounded preceding)
"""

#: What the C file of a document is made of: the text in a comment, then directives, declarations and functions.
_PIECES = (
    "'/* ' || replace(content, '*/', '* /') || ' */' || chr(10)",
    "'#include <sys/k' || doc_id % 4 || '.h>' || chr(10) || '#include \"m' || doc_id % 50 || '.h\"' || chr(10)",
    "'#define LIMIT_' || doc_id % 20 || ' ' || doc_id % 7 || chr(10) || '#define MIN(a, b) ' || chr(92) || chr(10)"
    " || '  ((a) < (b) ? (a) : (b))' || chr(10)",
    "'typedef struct item_' || doc_id % 30 || ' { int x; char *name; } item_t_' || doc_id % 30 || ';' || chr(10)",
    "'extern int helper_' || doc_id % 40 || '(int a);' || chr(10)",
    "'static int counter_' || doc_id % 25 || ' = ' || doc_id % 9 || ';' || chr(10)",
    "'#ifdef CONFIG_' || doc_id % 3 || chr(10)",
    "'static int helper_' || doc_id % 35 || '(int a, char *b)' || chr(10) || '{' || chr(10) || '  if (a) { log_' || doc_id % 10"
    " || '(\"} // not code\"); return helper_' || doc_id % 40 || '(a); }' || chr(10) || '  return sizeof(b);' || chr(10) || '}'",
    "chr(10) || '#else' || chr(10)",
    "'int fallback_' || doc_id % 12 || '(void) { return MIN(1, LIMIT_' || doc_id % 20 || '); }'",
    "chr(10) || '#endif' || chr(10) || '#if 0' || chr(10) || 'int dead_' || doc_id % 5 || '(void) { return 0; }' || chr(10)"
    " || '#endif' || chr(10)",
    "'int old_' || doc_id % 15 || '(a, b)' || chr(10) || 'int a;' || chr(10) || 'char *b;' || chr(10)"
    " || '{ return fallback_' || doc_id % 12 || '(a); }'",
    "chr(10) || case doc_id % 10 when 3 then 'void broken(void) { if (1) {' || chr(10)"
    " when 7 then 'char *s = \"open' || chr(10) when 5 then '}' || chr(10) else '' end",
)
PIECES = tuple(f"p{i}" for i in range(len(_PIECES)))
#: Every document as a C file; some cannot be read.
CSOURCES = f"""
select *, case when doc_id % 97 = 96 then null else {" || ".join(PIECES)} end as content from (
  select run_id, path, doc_id, {", ".join(f"{e} as {p}" for e, p in zip(_PIECES, PIECES, strict=True))} from ({SOURCES}) s) p
"""

VIEWS = {"v_csources": CSOURCES, "v_findings": FINDINGS, "v_units": UNITS, "v_sources": SOURCES, "v_events": EVENTS, "v_spans": SPANS}
_TABLE = {"v_csources": "documents", "v_findings": "lineitem", "v_units": "orders", "v_sources": "documents", "v_events": "events", "v_spans": "lineitem"}


def view(spark: SparkSession, sf_dir: str, name: str, dealt_by: str | None = None) -> DataFrame:
    """The view as a DataFrame over the table it reads.

    With ``dealt_by`` the table is shuffled by that column before the view makes its wider columns of it.
    """
    table = spark.read.parquet(f"{sf_dir}/{_TABLE[name]}.parquet")
    if dealt_by:
        named = set(re.findall(r"\w+", VIEWS[name]))
        table = table.select(*[c for c in table.columns if c in named]).repartition(dealt_by)
    sql = VIEWS[name].replace("{", "{{").replace("}", "}}").replace(f"from {_TABLE[name]}", "from {source}")
    return spark.sql(sql, source=table)


def with_views(sql: str, *names: str) -> str:
    """Oracle SQL with the definitions of the views that it names put in front."""
    heads = ", ".join(f"{n} as ({VIEWS[n]})" for n in names)
    return f"with {heads}, {sql}" if sql.lstrip().startswith("--cte") else f"with {heads} {sql}"
