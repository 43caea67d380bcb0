"""Registered queries of the text, path and redaction functions, each with the SQL of its result."""

from __future__ import annotations

from pyspark.sql import functions as F

from lintlake.functions import severity as S
from lintlake.functions import text as T
from lintlake.operators import redaction as X
from lintlake.operators.ordering import positions
from lintlake.plans.bindings import EVENTS, SOURCES, view

#: Whole documents with made-up host paths and links behind them.
NOTES = """
select run_id, doc_id, path, content, concat('file:///work/src/', path, '%20x/../', cast(doc_id as varchar(20)), '.c') as uri,
  concat(content, ' at /home/user', cast(doc_id % 7 as varchar(9)), '/p/', path,
    case when doc_id % 3 = 0 then concat(' and C:\\Users\\bob', cast(doc_id % 5 as varchar(9)), '\\x.c') else '' end,
    case when doc_id % 5 = 0 then ' and /mnt/c/x/Users/ann/y' else '' end,
    case when doc_id % 6 = 1 then concat(' on ', chr(92), chr(92), 'srv1', chr(92), 'share$', chr(92), 'x') else '' end,
    case when doc_id % 8 = 3 then concat(' in D:', chr(92), 'work', chr(92), 'src', chr(92), 'm.c') else '' end,
    case when doc_id % 4 = 0 then ' key s3cr3t-value /work/src/main.c' else '' end) as note,
  concat('https://', case when doc_id % 2 = 0 then 'me:pw@' else '' end, 'host', cast(doc_id % 9 as varchar(9)), '/v1?q=a@b') as url
from v_sources
"""
_N = f"with v_sources as ({SOURCES}), notes as ({NOTES})"
PREFIXES = {"/work/src": "<SRC>", "/work": "<ROOT>", "/mnt/d/work/src": "<SRC>"}
SECRETS = ["s3cr3t-value", "short"]
_HOME_SQL = [
    ("/home/[^/\\s\"''<>]+", "g"),
    ("/mnt/[A-Za-z]/(?:[^/\\s\"''<>]+/)*Users/[^/\\s\"''<>]+", "gi"),
    ("[A-Za-z]:\\\\+(?:[^\\\\\\r\\n\"''<>]+\\\\+)*Users\\\\+[^\\\\\\r\\n\"''<>]+", "gi"),
]


def _notes(s, d):
    sources = view(s, d, "v_sources")
    return s.sql(NOTES.replace("C:\\Users\\bob", "C:\\\\Users\\\\bob").replace("'\\x.c'", "'\\\\x.c'").replace("v_sources", "{v}"), v=sources)


def _scrubbed(value: str) -> str:
    for pattern, flags in _HOME_SQL:
        value = f"regexp_replace({value}, '{pattern}', '<HOME>', '{flags}')"
    return value


def _select(build):
    return lambda s, d: _notes(s, d).select("doc_id", *build())


def _redacted(s, d):
    return X.redact(_notes(s, d), "note", PREFIXES, SECRETS)


def _many(s, d):
    """A thousand secrets beside the usual ones; two of three notes begin with one of them."""
    notes = _notes(s, d).withColumn("note", F.concat(F.lit("token-"), F.expr("cast(doc_id % 1500 as string)"), F.lit("-end | "), F.col("note")))
    return X.redact(notes, "note", PREFIXES, [*SECRETS, *(f"token-{i}-end" for i in range(1000))])


c = F.col
_ws = lambda e: f"trim(regexp_replace({e}, '\\s+', ' ', 'g'))"
_words = "list_filter(regexp_split_to_array(lower(path), '[^a-z0-9]+'), lambda w: w <> '')"
_kw = ", ".join(f"'{k}'" for k in T.KEYWORDS)
_code = lambda text: F.concat(F.lit("int f"), F.expr("doc_id % 9"), F.lit("(void) { if (g("), F.replace(text, F.lit(" "), F.lit("( "))
                              , F.lit(")) return sizeof(x); h (1); }"))
_calls = lambda text: F.array_join(T.calls(F.regexp_replace(_code(text), r"[^ -~\n]", "")), ",").alias("calls")
_CODE = "concat('int f', doc_id % 9, '(void) { if (g(', replace(content, ' ', '( '), ')) return sizeof(x); h (1); }')"
_ASCII = "regexp_replace({}, '[^ -~\\n]', '', 'g')"

#: A document as bytes: sound, cut in the middle of a character, with a stray byte at its end, or at its beginning.
_URL = """case doc_id % 6 when 0 then url when 1 then concat('http://u@h', doc_id, ':80') when 2 then concat('https://h/', doc_id, '/a@b')
  when 3 then concat('https://a:b:c@h?x=', doc_id) when 4 then concat('ftp://me:p%40w@h/', doc_id, '#f@g') else concat('h', doc_id, '/me@x') end"""
_LINK_HEAD = lambda: F.expr("element_at(array('', 'a/../', '/', 'a b/', './', 'x//', 'javascript:'), cast(doc_id % 7 + 1 as int))")
_BYTES = lambda: F.expr("concat(case when doc_id % 4 = 3 then x'ff' else x'' end, cast(content as binary),"
                " case doc_id % 4 when 1 then x'e282' when 2 then x'c0af' else x'' end)")  # noqa: E731

QUERIES = {
    "b01_is_source": _select(lambda: [T.is_source(c("path")).alias("is_source"), T.language(c("path")).alias("language")]),
    "b02_glob_filter": _select(lambda: [T.matches(c("path"), ["**/*.c", "src1/", "src2/*/1*.h"]).alias("included")]),
    "b03_ignore_rules": _select(lambda: [T.ignored(c("path"), ["*.c", "!src0/", "/src1/en/", "fr/", "src[2-3]*/", "!src2/en/1*.h"]).alias("ignored")]),
    "e01_canonical_path": _select(lambda: [T.canonical_path(c("uri"), "/work/src").alias("canonical_path")]),
    "e05_cwe": _select(
        lambda: [S.cwe_of(F.concat(F.expr("case when doc_id % 3 = 0 then 'see ' else 'see cwe-' end"), F.expr("doc_id % 900"), F.lit(" x"))).alias("cwe")]
    ),
    "e08_host_paths": _select(lambda: [T.scrub_host_paths(c("note")).alias("scrubbed")]),
    "e12_slug": _select(lambda: [T.slug(F.concat(F.lit("/"), c("path"), F.lit("/a b"))).alias("slug")]),
    "e13_unit_id": _select(lambda: [T.unit_id(c("path"), F.lit("function"), F.lit("f"), F.expr("doc_id % 3")).alias("unit_id")]),
    "e14_definition": _select(lambda: [T.definition(F.regexp_replace("content", r"[^ -~\n]", "")).alias("definition")]),
    "e18_calls": _select(lambda: [_calls(c("content"))]),
    "e19_fragments": _select(lambda: [F.array_join(F.array_sort(F.array_distinct(T.fragments(c("path")))), ",").alias("words")]),
    "e23_numbered": _select(
        lambda: [
            T.numbered(c("content"), F.expr("doc_id % 120 + 1")).alias("listing"),
            T.summary(F.regexp_replace("content", r"[^ -~\n]", "")).alias("summary"),
        ]
    ),
    "e25_token_estimate": _select(lambda: [T.token_estimate(c("content")).alias("tokens")]),
    "e28_single_line": _select(lambda: [T.single_line(F.regexp_replace("content", r"[^ -~\n]", "")).alias("line")]),
    "e35_html_safe": _select(lambda: [T.html_safe(F.concat(F.lit("<a&b>"), c("note"))).alias("safe")]),
    "e36_location": _select(
        lambda: [T.location(c("path"), F.expr("case when doc_id % 2 = 0 then cast(doc_id as string) end"), F.expr("case when doc_id % 4 = 0 then '7' else '' end")).alias("location")]
    ),
    "e37_safe_link": _select(lambda: [T.safe_link(F.concat(_LINK_HEAD(), c("path"))).alias("safe")]),
    "e38_endpoint": _select(lambda: [T.without_userinfo(F.expr(_URL)).alias("endpoint")]),
    "b18_utf8": _select(lambda: [T.first_bad_byte(_BYTES()).alias("first_bad_byte"), T.first_bad_byte(_BYTES()).isNull().alias("valid")]),
    "d05_suffix_counts": lambda s, d: view(s, d, "v_sources")
    .groupBy("run_id", F.lower(T.suffix(c("path"))).alias("suffix")).agg(F.count(F.lit(1)).alias("n")),
    "a01_selected": lambda s, d: view(s, d, "v_sources").where(
        T.selected(c("path"), ["src1*/**", "**/*.h", "src2/"], ["src12/", "**/9*.h"], ["/src13/en/"])
    ).select("run_id", "path"),
    "o03_inventory_order": lambda s, d: positions(
        view(s, d, "v_sources").where(T.is_source(c("path"))).select("run_id", "path"), "run_id", [c("path")], "place"
    ),
    "a01_inventory": lambda s, d: view(s, d, "v_sources").where(T.is_source(c("path"))).select(
        "run_id", "path", F.octet_length("content").cast("long").alias("size"), F.sha2("content", 256).alias("sha256"),
        T.language(c("path")).alias("language"),
    ),
    "e34_duration": lambda s, d: view(s, d, "v_events").groupBy("run_id").agg(
        T.duration(F.min("ts").cast("string"), F.max("ts").cast("string")).alias("seconds")
    ),
    "e26_redacted": lambda s, d: _redacted(s, d).select("doc_id", "note", *(f"n_{r}" for r in X.RULES)),
    "e26_many_secrets": lambda s, d: _many(s, d).select("doc_id", "note", *(f"n_{r}" for r in X.RULES)),
    "d24_redaction_report": lambda s, d: X.report(_redacted(s, d)),
    "b17_leaks": lambda s, d: X.leaks(_notes(s, d), "note", PREFIXES, SECRETS).groupBy("doc_id", "leak").agg(F.count(F.lit(1)).alias("n")),
    "b17_no_leaks_left": lambda s, d: X.leaks(X.redact(_notes(s, d), "note", PREFIXES, SECRETS), "note", PREFIXES, SECRETS).select("doc_id", "leak"),
    "b19_export_policy": _select(
        lambda: [X.export_policy(F.concat(F.expr("element_at(array('llm/sessions/a/', 'llm/units/', 'tools/', 'exports/', 'llm/sessions/b/u/'), cast(doc_id % 5 + 1 as int))"), F.expr("case when doc_id % 7 = 0 then 'findings.json' else 'x.json' end"))).alias("policy")]
    ),
    "e27_json_redaction": lambda s, d: _notes(s, d).select(
        "doc_id", X.json_text(F.to_json(F.struct(c("path").alias("/work/src"), F.lit("s3cr3t-value").alias("key"),
            F.concat(F.lit("/home/bob"), c("doc_id"), F.lit("/x")).alias("/home/ann"), F.lit("D:\\work\\src\\y").alias("at"))), PREFIXES, SECRETS).alias("json")
    ),
}

#: The names these had while the others read beginnings of documents only.
_WHOLE = ("e08_host_paths", "e18_calls", "e23_numbered", "e35_html_safe", "e26_redacted", "d24_redaction_report", "b17_leaks", "b17_no_leaks_left")
QUERIES |= {f"{n}_whole": QUERIES[n] for n in _WHOLE}

_WIN = "'D:' || chr(92) || 'work' || chr(92) || 'src'"
_LIT = f"replace(replace(replace(replace(note, 's3cr3t-value', '<SECRET>'), {_WIN}, '<SRC>'), '/work/src', '<SRC>'), '/work', '<ROOT>')"
_UNC = "(^|[^\\\\])\\\\{2,4}[A-Za-z0-9][A-Za-z0-9._-]+\\\\{1,2}[A-Za-z0-9$_. -]{2,}(?:\\\\{1,2}[^\\\\\\r\\n\"''<>]+)*"
_times = lambda what: f"(length(note) - length(replace(note, {what}, ''))) // length({what})"
_RED = f"""{_N}, r as (select doc_id, note, {_times("'s3cr3t-value'")} as n_secret_value, {_times("'/work'")} + {_times(_WIN)} as n_prefix,
  {_LIT} as t from notes),
q as (select doc_id, cast(n_prefix as int) as n_prefix, cast(n_secret_value as int) as n_secret_value,
  len(regexp_extract_all(t, '(?i){_HOME_SQL[0][0]}')) + len(regexp_extract_all(t, '(?i){_HOME_SQL[1][0]}')) as n_linux_home_pattern,
  len(regexp_extract_all(t, '(?i){_HOME_SQL[2][0]}')) as n_windows_user_pattern,
  len(regexp_extract_all({_scrubbed("t")}, '{_UNC}')) as n_unc_pattern,
  regexp_replace({_scrubbed("t")}, '{_UNC}', '\\1<HOST>', 'g') as note from r)"""
_one = lambda expr, name: f'{_N} select doc_id, {expr} as "{name}" from notes'
_SUFFIX = "regexp_extract(path, '(\\.[^./]+)$', 1)"
_SET = ", ".join(f"'{s}'" for s in T.SUFFIXES)
_HEAD = ", ".join(f"'{s}'" for s in T.HEADERS)
_LANG = f"case when {_SUFFIX} in ({_HEAD}) then 'header' when {_SUFFIX} = '.c' then 'c' else 'cpp' end"

ORACLES = {
    "b01_is_source": f"{_N} select doc_id, {_SUFFIX} in ({_SET}) as is_source, {_LANG} as language from notes",
    "b02_glob_filter": _one("path like '%.c' or path like 'src1/%' or regexp_matches(path, '(^|/)src2/[^/]*/1[^/]*\\.h$')", "included"),
    "b03_ignore_rules": _one(
        "case when regexp_matches(path, '(^|/)fr/') or path like 'src1/en/%' or regexp_matches(path, '^src[2-3][^/]*/') then true"
        " when path like 'src0/%' then false else path like '%.c' end", "ignored"
    ),
    "e01_canonical_path": _one("regexp_replace(path, '/[^/]*$', '') || '/' || doc_id || '.c'", "canonical_path"),
    "e05_cwe": _one("case when doc_id % 3 = 0 then '' else 'CWE-' || doc_id % 900 end", "cwe"),
    "e08_host_paths": _one(_scrubbed("note"), "scrubbed"),
    "e12_slug": _one(
        "replace(replace(path, '/', '__'), ' ', '_') || '__a_b-' || substr(sha256('/' || path || '/a b'), 1, 8)", "slug"
    ),
    "e13_unit_id": _one(
        "substr(replace(path, '/', '__'), 1, 80) || '-' || substr(sha256(path || chr(0) || 'function' || chr(0) || 'f' || chr(0) || doc_id % 3), 1, 12)", "unit_id"
    ),
    "e14_definition": f"""{_N}, t as (select doc_id, {_ws(_ASCII.format("content"))} as f from notes)
      select doc_id, case when length(f) > 2000 then substr(f, 1, 2000) || ' ...' else f end as definition from t""",
    "e18_calls": _one(
        f"array_to_string(list_sort(list_filter(list_distinct(regexp_extract_all({_ASCII.format(_CODE)}, '\\b([A-Za-z_][A-Za-z0-9_]*)\\s*\\(', 1)), lambda n: n not in ({_kw}))), ',')", "calls"
    ),
    "e19_fragments": _one(
        f"array_to_string(list_sort(list_distinct({_words} || list_transform(regexp_extract_all(path, '[A-Z]+|[a-z]+|[0-9]+'), lambda x: lower(x)) || list_filter(string_split(lower(path), '/'), lambda w: w <> ''))), ',')", "words"
    ),
    "e23_numbered": f"""{_N}, t as (select doc_id, string_split(regexp_replace(content, '\\n$', ''), chr(10)) as l, doc_id % 120 + 1 as s,
        {_ws(_ASCII.format("content"))} as f from notes)
      select doc_id, array_to_string(list_transform(l, lambda x, i: lpad(cast(s + i - 1 as varchar), cast(length(cast(s + len(l) - 1 as varchar)) as int), ' ') || ' | ' || x), chr(10)) as listing,
        case when length(f) > 120 then rtrim(substr(f, 1, 119)) || '…' else f end as summary from t""",
    "e25_token_estimate": _one("greatest(1, ceil(length(content) / 4))::bigint", "tokens"),
    "e28_single_line": _one(_ws(_ASCII.format("content")), "line"),
    "e35_html_safe": _one("replace(replace(replace('<a&b>' || note, '&', '\\u0026'), '<', '\\u003c'), '>', '\\u003e')", "safe"),
    "e36_location": _one("path || case when doc_id % 2 = 0 then ':' || doc_id else '' end || case when doc_id % 4 = 0 then ':7' else '' end", "location"),
    "e37_safe_link": _one(
        "regexp_full_match(h || path, '[A-Za-z0-9._-]+(/[A-Za-z0-9._-]+)*') and len(list_filter(string_split(h || path, '/'), lambda x: x in ('.', '..'))) = 0", "safe"
    ).replace("from notes", "from (select *, ['', 'a/../', '/', 'a b/', './', 'x//', 'javascript:'][doc_id % 7 + 1] as h from notes)"),
    "e38_endpoint": _one("regexp_replace(u, '^([a-z]+://)[^/?#]*@', '\\1')", "endpoint").replace(
        "from notes", "from (select *, " + _URL + " as u from notes)"
    ),
    "b18_utf8": f"""{_N} select doc_id, case doc_id % 4 when 1 then strlen(content) when 2 then strlen(content) when 3 then 0 end as first_bad_byte,
      doc_id % 4 = 0 as valid from notes""",
    "d05_suffix_counts": f"with v as ({SOURCES}) select run_id, lower({_SUFFIX}) as suffix, count(*) as n from v group by 1, 2",
    "a01_selected": f"""with v as ({SOURCES}) select run_id, path from v where {_SUFFIX} in ({_SET})
      and (path like 'src1%' or path like '%.h' or path like 'src2/%') and path not like 'src12/%'
      and not regexp_matches(path, '/9[^/]*\\.h$') and path not like 'src13/en/%'""",
    "o03_inventory_order": f"""with v as ({SOURCES}) select run_id, path, row_number() over (partition by run_id order by path) as place
      from v where {_SUFFIX} in ({_SET})""",
    "a01_inventory": f"""with v as ({SOURCES}) select run_id, path, strlen(content) as size, sha256(content) as sha256, {_LANG} as language
      from v where {_SUFFIX} in ({_SET})""",
    "e34_duration": f"with v as ({EVENTS}) select run_id, epoch(date_trunc('second', max(ts)))::bigint - epoch(date_trunc('second', min(ts)))::bigint as seconds from v group by 1",
    "e26_redacted": f"{_RED} select * from q",
    "e26_many_secrets": f"""{_RED} select * replace (case when doc_id % 1500 < 1000 then '<SECRET>' else 'token-' || doc_id % 1500 || '-end' end || ' | ' || note as note,
        n_secret_value + if(doc_id % 1500 < 1000, 1, 0) as n_secret_value) from q""",
    "d24_redaction_report": f"""{_RED} select 'prefix' as rule, sum(n_prefix)::bigint as n from q union all select 'secret_value', sum(n_secret_value)::bigint from q
      union all select 'linux_home_pattern', sum(n_linux_home_pattern)::bigint from q union all select 'windows_user_pattern', sum(n_windows_user_pattern)::bigint from q union all select 'unc_pattern', sum(n_unc_pattern)::bigint from q""",
    "b17_leaks": f"""{_N}, l as (select doc_id, unnest(list_filter([case when contains(note, 's3cr3t-value') then 'secret_value' end,
        case when contains(note, '/work/src') then 'dynamic_prefix' end, case when contains(note, '/work') then 'dynamic_prefix' end,
        case when contains(note, {_WIN}) then 'dynamic_prefix' end,
        case when regexp_matches(note, '/home/[^/\\s"''<>]+', 'i') then 'sensitive_path_pattern' end,
        case when regexp_matches(note, '/mnt/[a-z]/[^\\s"''<>]*/users/[^/\\s"''<>]+', 'i') then 'sensitive_path_pattern' end,
        case when regexp_matches(note, '[a-z]:\\\\+[^\\r\\n]*\\\\+users\\\\+', 'i') or regexp_matches(note, '[a-z]:\\\\+users\\\\+x^', 'i') then 'sensitive_path_pattern' end,
        case when regexp_matches(note, '{_UNC}') then 'sensitive_path_pattern' end], lambda x: x is not null)) as leak from notes)
      select doc_id, leak, count(*) as n from l group by 1, 2""",
    "b17_no_leaks_left": f"{_N} select doc_id, path as leak from notes where false",
    "b19_export_policy": _one(
        "case doc_id % 5 when 0 then case when doc_id % 7 = 0 then 'shipped' else 'excluded' end when 1 then 'excluded' when 2 then 'shipped' when 3 then 'omitted' else case when doc_id % 7 = 0 then 'shipped' else 'excluded' end end", "policy"
    ),
    "e27_json_redaction": _one("'{\"<SRC>\":\"' || path || '\",\"key\":\"<SECRET>\",\"<HOME>\":\"<HOME>/x\",\"at\":\"<SRC>' || chr(92) || chr(92) || 'y\"}'", "json"),
}

ORACLES |= {f"{n}_whole": ORACLES[n] for n in _WHOLE}
