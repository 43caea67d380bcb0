"""Registered queries of the risk rules over units named after parts and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from lintlake.operators import risk as K

_DIRS = ("boot", "net_http", "drivers/ledCtl", "src", "myParser", "test", "lib")
_NAMES = ("irqHandler", "read_frame", "getState", "main", "copy", "gpio_init")
_SIGNATURES = ("int f(void *p, size_t len)", "int f(int a)", "void g(uint8_t *b)")
_pick = lambda values, key: f"element_at(array({', '.join(repr(v) for v in values)}), cast({key} % {len(values)} + 1 as int))"
_PICK = lambda values, key: f"[{', '.join(repr(v) for v in values)}][{key} % {len(values)} + 1]"


def _fields(pick):
    return (
        f"select l_orderkey, l_linenumber, l_partkey, l_suppkey, concat({pick(_DIRS, 'l_partkey')}, '/f', cast(l_suppkey % 4 as varchar(9)), '.c') as path,"
        f" {pick(_NAMES, 'l_orderkey')} as name, case when l_linenumber = 5 then 'module' else 'function' end as kind,"
        f" {pick(_SIGNATURES, 'l_suppkey')} as signature, l_linenumber = 6 as is_header, l_linenumber = 7 as dead from "
    )


def _units(s, d):
    return s.sql(_fields(_pick) + "{t}", t=s.read.parquet(f"{d}/lineitem.parquet"))


def _tiers(s, d):
    c = F.col
    tier = K.automatic_tier(c("path"), c("name"), c("kind"), c("signature"), c("is_header"), c("dead"))
    return _units(s, d).withColumn("r", tier)


OVERRIDES = [("src", "high"), ("*/f1.c", "low"), ("test/f2.c", "critical")]
QUERIES = {
    "b23_risk_tier": lambda s, d: _tiers(s, d).groupBy("path", "name", "kind", "signature", "is_header", "dead", F.col("r.tier").alias("tier"), F.col("r.reason").alias("reason"))
    .agg(F.count(F.lit(1)).alias("n")),
    "c17_risk_overrides": lambda s, d: _tiers(s, d).select(
        "path", K.at_least(K.overridden(F.col("path"), F.col("r.tier"), OVERRIDES), "medium").alias("tier")
    ).groupBy("path", "tier").agg(F.count(F.lit(1)).alias("n")),
}

_sql_list = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
_frag = lambda e: (
    f"list_distinct(list_filter(regexp_split_to_array(lower({e}), '[^a-z0-9]+'), lambda w: w <> '') || "
    f"list_transform(regexp_extract_all(regexp_replace({e}, '([a-z])([A-Z])', '\\1 \\2', 'g'), '[A-Z]*[a-z]+|[A-Z]+|[0-9]+'), lambda x: lower(x)))"
)
_hit = lambda e, words: f"list_sort(list_intersect({e}, {_sql_list(words)}))"
_BASE = f"""with u as ({_fields(_PICK)} lineitem), f as (select *, {_frag("path")} as pw, {_frag("name")} as nw from u),
h as (select *, {_hit("pw", K.CRITICAL_PATH)} as a, {_hit("nw", K.CRITICAL_SYMBOL)} as b, {_hit("pw", K.HIGH_PATH)} as c, {_hit("nw", K.HIGH_SYMBOL)} as d,
  {_hit("pw", K.LOW_PATH)} as e, {_hit("nw", K.LOW_SYMBOL)} as g, kind = 'function' as fn from f),
t as (select *, case when len(a) > 0 then 'critical|path:' || array_to_string(a, ',') when fn and len(b) > 0 then 'critical|symbol:' || array_to_string(b, ',')
  when fn and signature like '%len%' then 'critical|signature:opaque-buffer-with-length' when len(c) > 0 then 'high|path:' || array_to_string(c, ',')
  when fn and len(d) > 0 then 'high|symbol:' || array_to_string(d, ',') when not fn then 'low|kind:' || kind when is_header then 'low|header'
  when dead then 'low|inactive-preprocessor-branch' when len(e) > 0 then 'low|path:' || array_to_string(e, ',')
  when len(g) > 0 then 'low|symbol:' || array_to_string(g, ',') else 'medium|default' end as r from h)"""
ORACLES = {
    "b23_risk_tier": f"""{_BASE} select path, name, kind, signature, is_header, dead, split_part(r, '|', 1) as tier, split_part(r, '|', 2) as reason, count(*) as n
      from t group by all""",
    "c17_risk_overrides": f"""{_BASE}, o as (select path, case when path = 'test/f2.c' then 'critical' when path like '%/f1.c' then 'low' when path like 'src/%' then 'high'
      else split_part(r, '|', 1) end as tier from t) select path, case when tier = 'low' then 'medium' else tier end as tier, count(*) as n from o group by all""",
}
