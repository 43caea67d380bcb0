"""Registered queries of the compile-database operators; databases are written from the documents' paths and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from lintlake.functions import text as T
from lintlake.operators import compile_db as C
from lintlake.operators.ordering import keep
from lintlake.plans.bindings import SOURCES, view

_SUFFIX = "regexp_extract(path, '(\\.[^./]+)$', 1)"
_SET = ", ".join(f"'{s}'" for s in T.SUFFIXES)
_HEAD = ", ".join(f"'{s}'" for s in T.HEADERS)
_DB = "concat('build', cast(floor(doc_id / 64) as int), '/compile_commands.json')"
_SQL = f"""with v as ({SOURCES}), inventory as (select run_id, path, case when {_SUFFIX} in ({_HEAD}) then 'header' when {_SUFFIX} = '.c' then 'c' else 'cpp' end as language
  from v where {_SUFFIX} in ({_SET})),
entries as (select run_id, {_DB} as db_path, row_number() over (partition by run_id, doc_id // 64 order by doc_id) - 1 as ord,
  case when doc_id % 161 = 0 then '' else 'src' || doc_id % 5 end as directory, case when doc_id % 7 = 0 then path || '.gone' else path end as path, doc_id from v)"""


def _inventory(s, d):
    rows = view(s, d, "v_sources").where(T.is_source(F.col("path")))
    return rows.select("run_id", "path", T.language(F.col("path")).alias("language"))


def _databases(s, d):
    """One database for every 64 documents of a run, which bounds the size of its text; every document is in one."""
    rows = view(s, d, "v_sources").select(
        "run_id", "doc_id", F.expr(_DB).alias("db_path"), F.expr("floor(doc_id / 64)").alias("no"),
        F.struct(
            F.expr("case when doc_id % 161 = 0 then '' else concat('src', doc_id % 5) end").alias("directory"),
            F.expr("concat('/', case when doc_id % 7 = 0 then concat(path, '.gone') else path end)").alias("file"),
            F.expr("case when doc_id % 2 = 0 then 'cc -c x.c' end").alias("command"),
            F.expr("case when doc_id % 3 = 0 then array('cc') when doc_id % 13 = 0 then array() when doc_id % 2 = 1 and doc_id % 211 <> 0 then array('cc', '-c') end").alias("arguments"),
        ).alias("e"),
    )
    items = F.array_sort(F.collect_list(F.struct("doc_id", "e")))
    texts = rows.groupBy("run_id", "db_path", "no").agg(F.to_json(F.transform(items, lambda x: x["e"])).alias("text"))
    return texts.withColumn("mtime", F.expr("no * 37 % 1000 + 400")).drop("no")


def _entries(s, d):
    return C.entries(_databases(s, d)).withColumn("path", F.substring("path", 2, 1 << 20))


def _tree(s, d):
    """What exists: most documents' files, with the time each was written, and four of five directories."""
    rows = view(s, d, "v_sources")
    files = rows.where("doc_id % 17 <> 5").select(
        "run_id", "path", F.lit(False).alias("is_dir"), F.expr("doc_id * 31 % 1500").alias("mtime"), T.is_source(F.col("path")).alias("in_source")
    )
    dirs = rows.where("doc_id % 5 <> 3").select(
        "run_id", F.expr("concat('src', doc_id % 5)").alias("path"), F.lit(True).alias("is_dir"), F.lit(0).cast("bigint").alias("mtime"), F.lit(False).alias("in_source")
    )
    return files.unionByName(dirs.distinct())


def _inspected(s, d):
    databases = keep(_databases(s, d), "compile-databases")  # the entries and the tables beside them are made of it
    rows = C.entries(databases).withColumn("path", F.substring("path", 2, 1 << 20))
    return C.inspected(databases, rows, _tree(s, d))


QUERIES = {
    "a09_compile_entries": lambda s, d: _entries(s, d).select("run_id", "db_path", "ord", "directory", "path"),
    "b16_entry_problems": lambda s, d: C.entry_problem(_entries(s, d)).select("run_id", "db_path", "ord", "problem"),
    "c01_covered_entries": lambda s, d: C.covered(_entries(s, d), _inventory(s, d)).select("run_id", "db_path", "ord", "path"),
    "c02_fallback_files": lambda s, d: C.fallback(_entries(s, d), _inventory(s, d)),
    "c03_configurations": lambda s, d: C.configurations(_entries(s, d), _inventory(s, d)),
    "a10_database_statistics": _inspected,
    "o06_best_database": lambda s, d: C.best(_inspected(s, d)),
    "c18_database_remarks": lambda s, d: C.degraded(_inspected(s, d)),
}
_BROKEN = """case when directory = '' then 'directory is missing'
      when doc_id % 2 <> 0 and doc_id % 3 <> 0 and doc_id % 13 <> 0 and doc_id % 211 = 0 then 'neither arguments nor command'
      when doc_id % 2 <> 0 and doc_id % 3 <> 0 and doc_id % 13 = 0 then 'arguments and command are empty' end"""
_STATS = f"""{_SQL},
tree as (select run_id, path, doc_id * 31 % 1500 as mtime, {_SUFFIX} in ({_SET}) as in_source from v where doc_id % 17 <> 5),
b as (select *, {_BROKEN} as problem from entries),
w as (select run_id, db_path, count(*) as entries, count(problem) as broken, count(*) filter (directory in ('src0', 'src1', 'src2', 'src4')) as dirs,
    cast(split_part(substr(db_path, 6), '/', 1) as bigint) * 37 % 1000 + 400 as mtime from b group by 1, 2),
f as (select e.run_id, e.db_path, count(*) as files, count(*) filter (t.path is null) as missing, count(*) filter (t.in_source) as covered,
    max(t.mtime) filter (t.in_source) as newest
  from (select distinct run_id, db_path, path from entries) e left join tree t on t.run_id = e.run_id and t.path = e.path group by 1, 2),
s as (select run_id, db_path, mtime, broken = 0 as valid, if(broken = 0, entries, 0) as entries, if(broken = 0, files, 0) as files,
    if(broken = 0, missing, 0) as missing_files, if(broken = 0, covered, 0) as covered_sources,
    if(broken = 0, round_even(covered / files, 6), 0.0) as source_ratio, if(broken = 0, dirs, 0) as valid_directories,
    if(broken = 0, entries - dirs, 0) as invalid_directories, if(broken = 0, round_even(dirs / entries, 6), 0.0) as directory_ratio,
    coalesce(broken = 0 and newest > mtime, false) as possibly_stale, broken = 0 and dirs > 0 and covered > 0 as usable
  from w join f using (run_id, db_path))"""
ORACLES = {
    "a09_compile_entries": f"{_SQL} select run_id, db_path, ord, directory, path from entries",
    "b16_entry_problems": f"{_SQL} select run_id, db_path, ord, {_BROKEN} as problem from entries",
    "c01_covered_entries": f"""{_SQL} select run_id, db_path, ord, path from entries
      where (run_id, path) in (select run_id, path from inventory where language <> 'header')""",
    "c02_fallback_files": f"""{_SQL} select run_id, path from inventory where language <> 'header' and (run_id, path) not in (select run_id, path from entries)""",
    "c03_configurations": f"""{_SQL} select i.run_id, i.path, e.ord, e.ord is not null as in_build from inventory i
      left join entries e on e.run_id = i.run_id and e.path = i.path where language = 'c'""",
    "a10_database_statistics": f"{_STATS} select * from s",
    "o06_best_database": f"""{_STATS} select run_id, db_path from (select *, row_number() over (partition by run_id
      order by covered_sources desc, directory_ratio desc, mtime desc, db_path) as n from s where usable) where n = 1""",
    "c18_database_remarks": f"""{_STATS} select run_id, db_path, 'database is not valid' as remark from s where not valid
      union all select run_id, db_path, invalid_directories || ' working directories do not exist' from s where invalid_directories > 0
      union all select run_id, db_path, missing_files || ' source files do not exist' from s where missing_files > 0
      union all select run_id, db_path, 'a covered source is newer than the database' from s where possibly_stale
      union all select run_id, db_path, 'no working directory or no source exists' from s where valid and not usable""",
}
