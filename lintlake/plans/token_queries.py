"""Registered queries of the token tables, over every document as a C file."""

from __future__ import annotations

from pyspark.sql import functions as F

from lintlake.operators import token_tables as T
from lintlake.operators.ordering import keep
from lintlake.plans.bindings import PIECES, view
from lintlake.plans.source_queries import ORACLES as _SOURCE, _V, _upto

#: Small blocks, so that the documents' files have several.
_SIZE = 1024


def _files(s, d):
    return view(s, d, "v_csources").select("run_id", "path", F.col("content").cast("binary").alias("content"))


def _lexed(s, d):
    return T.lexed(_files(s, d), _SIZE)


def _visible(s, d):
    lexed = keep(_lexed(s, d), "lexed")  # read for the bytes and for the problems
    seen = F.length(F.regexp_replace(F.decode("masked", "ISO-8859-1"), r"[ \t\r\n]+", ""))
    rows = lexed.groupBy("run_id", "path").agg(F.sum(seen).cast("long").alias("visible"))
    return rows.join(T.lexical_problems(lexed), ["run_id", "path"])


def _arms(lexed, files):
    found = T.directives(T.lines(lexed))
    return found, T.switched_off(T.arms(found, T.sizes(files)))


def _hidden(found, arms):
    return found.select("run_id", "path", "start", "end").unionByName(
        arms.where("dead").select("run_id", "path", F.col("body_start").alias("start"), F.col("body_end").alias("end"))
    )


def _spans(s, d):
    lexed = keep(_lexed(s, d), "lexed")
    return T.top_level(T.brace_depths(lexed, _hidden(*_arms(lexed, _files(s, d)))))


QUERIES = {
    "e16_visible_bytes": _visible,
    "w18_lines": lambda s, d: T.lines(_lexed(s, d)).groupBy("run_id", "path").agg(
        F.count(F.lit(1)).alias("lines"), F.max("line").alias("last_line"), F.max("start").alias("last_start"), F.sum("start").alias("starts")
    ),
    "w15_arms_by_sums": lambda s, d: _arms(keep(_lexed(s, d), "lexed"), _files(s, d))[1].select(
        "run_id", "path", "kind", "condition", "depth", "start", "body_start", "body_end", "line_start", "line_end", "dead"
    ),
    "w16_brace_spans": _spans,
}

_seen = lambda p: f"strlen(regexp_replace({p}, '[ \\t\\r\\n]+', '', 'g'))"
_body = lambda k, until: f"""select run_id, path, strlen({_upto(k)}) + position(chr(123) in p{k}) - 1 as start, {until} as "end" from r"""
ORACLES = {
    # a piece of text is a comment; of literals, one holds ten visible bytes, one the name of a header, an open one four
    "e16_visible_bytes": f"""{_V} select run_id, path, ({" + ".join(_seen(p) for p in PIECES[1:])} - 10
        - strlen('m' || doc_id % 50 || '.h') - case when doc_id % 10 = 7 then 4 else 0 end)::bigint as visible, false as open_comment, doc_id % 10 = 7 as open_literal from r""",
    "w18_lines": f"""{_V}, w as (select run_id, path, string_split(content, chr(10)) as ls from r),
      x as (select run_id, path, len(ls) as n, unnest(ls) as l, generate_subscripts(ls, 1) as k from w),
      y as (select run_id, path, n, k, (coalesce(sum(strlen(l) + 1) over (partition by run_id, path order by k rows between unbounded preceding and 1 preceding), 0))::bigint as start from x)
      select run_id, path, count(*) as lines, max(k)::bigint as last_line, max(start) as last_start, sum(start)::bigint as starts from y group by 1, 2""",
    "w15_arms_by_sums": f"select * exclude (ord) from ({_SOURCE['w15_conditional_arms']})",
    "w16_brace_spans": f"""{_V} {_body(3, f"strlen({_upto(3)}) + position(chr(125) in p3)")} union all {_body(7, f"strlen({_upto(8)})")}
      union all {_body(9, f"strlen({_upto(10)})")} union all {_body(11, f"strlen({_upto(12)})")}
      union all {_body(12, "null::bigint")} where doc_id % 10 = 3""",
}
