"""Stored evidence of runs: documents read back, artifact indexes, snapshots, exports, and checks of their structure."""

from __future__ import annotations

import shlex

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from lintlake.operators import redaction as X
from lintlake.sources import reports as P

#: Names and places of what is no evidence: the manifest itself, files being written, and the analyzers' caches.
NOT_EVIDENCE = r"(^|/)(manifest\.json|\.manifest\.json\.tmp|\.recover-[^/]*)$|^tools/[^/]+/[^/]+/(build|tmp)/.+"
DATABASE = "compile_commands.json"
SCHEMAS = (1, 2, 3)


def _documents(files: DataFrame) -> DataFrame:
    return files.select(
        F.col("path"), F.element_at(F.split("path", "/"), -2).alias("run_id"), F.col("content").cast("string").alias("text")
    )


def stored_documents(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Every document called ``name`` below a folder of runs: path, text, and its run, the folder it lies in."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", name).load(folder)
    return _documents(files)


def pack_documents(documents: DataFrame, folder: str) -> None:
    """Documents (run_id, name, text) of many runs as rows of path and content in a few files.

    A file of its own costs every document a directory, a rename by the driver and an entry of a listing.
    """
    path = F.concat_ws("/", "run_id", "name").alias("path")
    documents.select(path, F.col("text").cast("binary").alias("content")).write.parquet(folder)


def packed_documents(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """``stored_documents`` of runs that ``pack_documents`` has stored."""
    files = spark.read.schema("path string, content binary").parquet(folder)
    return _documents(files.where(F.element_at(F.split("path", "/"), -1) == name))


def _kind(v: Column, path: str) -> Column:
    return F.coalesce(F.schema_of_variant(F.try_variant_get(v, path, "variant")), F.lit(""))


def _values_are_objects(v: Column, path: str) -> Column:
    """Whether an object holds nothing but objects."""
    values = F.map_values(F.try_variant_get(v, path, "map<string,variant>"))
    return F.startswith(_kind(v, path), F.lit("OBJECT")) & F.coalesce(
        F.forall(values, lambda x: F.startswith(F.coalesce(F.schema_of_variant(x), F.lit("")), F.lit("OBJECT"))), F.lit(False)
    )


def _objects(v: Column, path: str) -> Column:
    return F.startswith(_kind(v, path), F.lit("ARRAY<OBJECT")) | (_kind(v, path) == "ARRAY<VOID>")


def manifest_problem(text: Column) -> Column:
    """Why a manifest cannot be used; null if it can."""
    v = F.try_parse_json(text)
    return (
        F.when(v.isNull() | ~F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), "expected a JSON object")
        .when(F.coalesce(F.try_variant_get(v, "$.manifest_schema_version", "int"), F.lit(0)) != 2, "unsupported or missing manifest schema version")
        .when(~_values_are_objects(v, "$.tools"), "tools must be an object of objects")
        .when(~_objects(v, "$.artifacts"), "artifacts must be a list of objects")
        .when((_kind(v, "$.run_id") != "STRING") | (F.try_variant_get(v, "$.run_id", "string") == ""), "run_id is required")
    )


def review_problem(text: Column) -> Column:
    """Why a stored review cannot be used; null if it can. Reviews before the third schema have no scanners."""
    v = F.try_parse_json(text)
    out = (
        F.when(v.isNull() | ~F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), "expected a JSON object")
        .when(~F.coalesce(F.try_variant_get(v, "$.review_schema_version", "int").isin(*SCHEMAS), F.lit(False)), "invalid core review schema")
        .when(~_values_are_objects(v, "$.tools"), "tools must contain objects")
        .when(~F.startswith(_kind(v, "$.source_manifest"), F.lit("OBJECT")), "source_manifest must be an object")
        .when(F.try_variant_get(v, "$.scanners", "variant").isNotNull() & ~_values_are_objects(v, "$.scanners"), "scanners must be an object of objects")
    )
    for key in ("findings", "diagnostics", "overlap_groups"):
        out = out.when(~_objects(v, f"$.{key}"), f"{key} must be a list of objects")
    return out.when(
        ~_kind(v, "$.source_manifest.files").isin("ARRAY<STRING>", "ARRAY<VOID>"), "source_manifest.files must be a list of strings"
    )


def defaulted(findings: DataFrame) -> DataFrame:
    """Findings of older schemas with what they lack."""
    for name in ("evidence_context", "review_level", "engine", "producer", "evidence_class"):
        if name not in findings.columns:
            findings = findings.withColumn(name, F.lit(None).cast("string"))
    given = lambda name, other: F.when(F.coalesce(name, F.lit("")) != "", F.col(name)).otherwise(other)
    engine = F.when(F.col("engine") == "llm", "llm").otherwise("static")
    return findings.withColumns(
        {
            "evidence_context": given("evidence_context", "source-only"), "review_level": given("review_level", "unmapped"),
            "engine": engine, "producer": given("producer", F.coalesce("tool", F.lit(""))),
            "evidence_class": given("evidence_class", F.when(engine == "llm", "generated").otherwise("native")),
        }
    )


def canonical_documents(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """One canonical JSON text per row: fields in alphabetical order, nulls kept out, equal input giving equal bytes."""
    return rows.select(key, F.to_json(F.struct(*sorted(columns))).alias("document"))


def event_lines(events: DataFrame, columns: list[str]) -> DataFrame:
    """A run's event log, one JSON object per line in the order of time; ``write.text`` makes files of it."""
    return events.select("run_id", "ts", "event_id", F.to_json(F.struct(*sorted(columns))).alias("line"))


def artifact_index(files: DataFrame, known: DataFrame) -> DataFrame:
    """Path, size and digest of a run's evidence; files whose size and time are known already are not read again.

    ``files`` has run_id, path, size, modified, content; ``known`` an earlier index with modified.
    """
    evidence = files.where(~F.col("path").rlike(NOT_EVIDENCE))
    before = known.select("run_id", "path", "size", "modified", F.col("sha256").alias("known_sha256"))
    joined = evidence.join(before, ["run_id", "path", "size", "modified"], "left")
    reused = F.col("known_sha256").isNotNull()
    return joined.select(
        "run_id", "path", "size", "modified", F.when(reused, F.col("known_sha256")).otherwise(F.sha2("content", 256)).alias("sha256"), reused.alias("reused")
    )


def replaced(index: DataFrame, new: DataFrame) -> DataFrame:
    """An index with the rows of ``new`` in place of those of the same path."""
    return index.join(new.select("run_id", "path"), ["run_id", "path"], "left_anti").unionByName(new.select(*index.columns))


def attached(units: DataFrame, index: DataFrame) -> DataFrame:
    """Units with the artifacts of their directory, in order; a unit without any keeps an empty list.

    ``units`` has run_id, unit_id and directory; an artifact belongs to the directory it lies in.
    """
    own = index.withColumn("directory", F.regexp_replace("path", "/[^/]*$", ""))
    listed = own.groupBy("run_id", "directory").agg(F.array_sort(F.collect_list(F.struct("path", "size", "sha256"))).alias("artifacts"))
    out = units.join(listed, ["run_id", "directory"], "left")
    return out.withColumn("artifacts", F.coalesce("artifacts", F.array().cast(listed.schema["artifacts"].dataType)))


def sanitised(artifacts: DataFrame, prefixes: dict[str, str], secrets: list[str]) -> DataFrame:
    """Artifacts (run_id, path, text) as an export may hold them: kind, text and what was done with each.

    Texts that quote source are withheld. XML keeps the tokens as data; JSON and tables are checked before
    and after, and what cannot be cleaned or still leaks is refused by itself.
    """
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    kind = F.when(suffix == "xml", "xml").when(suffix == "sarif", "sarif").when(suffix == "json", "json").when(suffix == "csv", "csv").otherwise("text")
    rows = artifacts.withColumns({"kind": kind, "policy": X.export_policy(F.col("path")), "original": F.col("text")})
    clean = X.redact(rows, "text", prefixes, secrets).drop(*[f"n_{r}" for r in X.RULES])
    marked = F.col("text")
    for token in ("SRC", "OUT", "ROOT", "HOME", "HOST", "SECRET"):
        marked = F.replace(marked, F.lit(f"<{token}>"), F.lit(f"&lt;{token}&gt;"))
    as_json = X.json_text(F.col("original"), prefixes, secrets)
    text = F.when(F.col("kind") == "xml", marked).when(F.col("kind").isin("json", "sarif"), as_json).otherwise(F.col("text"))
    clean = clean.withColumn("text", text)
    parsed = F.try_parse_json("text")
    version = F.coalesce(F.try_variant_get(parsed, "$.version", "string"), F.lit(""))
    problem = (
        F.when((F.col("kind") == "xml") & ~F.col("text").rlike(r"(?s)^\s*<.*>\s*$"), "cannot sanitize XML")
        .when(F.col("kind").isin("json", "sarif") & parsed.isNull(), "cannot sanitize JSON")
        .when((F.col("kind") == "sarif") & (version != "2.1.0"), "invalid SARIF after sanitization")
        .when(F.col("kind") == "csv", P.csv_problem(F.col("text")))
    )
    status = F.when(F.col("policy") != "shipped", F.col("policy")).when(problem.isNotNull(), "refused").otherwise("shipped")
    out = clean.withColumns({"problem": F.when(F.col("policy") == "shipped", problem), "status": status})
    return out.withColumn("text", F.when(F.col("status") == "shipped", F.col("text"))).select("run_id", "path", "kind", "status", "problem", "text")


def export_report(exported: DataFrame) -> DataFrame:
    """D24 for exports: artifacts of each run by kind and by what was done with them."""
    return exported.groupBy("run_id", "kind", "status").agg(F.count(F.lit(1)).alias("n"))


def snapshot(inventory: DataFrame, entries: DataFrame) -> DataFrame:
    """A run's inputs as one table: its files, and those compile entries whose file is among them."""
    files = inventory.select("run_id", F.lit("inventory").alias("what"), "path", "sha256")
    used = entries.join(inventory.select("run_id", "path"), ["run_id", "path"], "left_semi")
    return files.unionByName(used.select("run_id", F.lit("compile-entry").alias("what"), "path", F.lit(None).cast("string").alias("sha256")))


def candidate_databases(files: DataFrame, most: int = 64, depth: int = 4) -> DataFrame:
    """Compile databases at the root of a source or in its build folders, at most ``depth`` below these; the first ``most``."""
    from pyspark.sql import Window as W

    parts = F.split("path", "/")
    top = F.element_at(parts, 1)
    level = F.size(parts) - 2
    built = (top == "out") | F.startswith(top, F.lit("build")) | F.startswith(top, F.lit("cmake-build-"))
    found = files.where((F.element_at(parts, -1) == DATABASE) & ((F.size(parts) == 1) | (built & (level <= depth))))
    place = F.row_number().over(W.partitionBy("run_id").orderBy(F.size(parts) > 1, "path"))
    return found.withColumn("place", place).where(F.col("place") <= most)


@F.udf(returnType=ArrayType(StringType()), useArrow=True)
def _split_command(command):
    try:
        return shlex.split(command or "")
    except ValueError:
        return []


def include_flags(arguments: Column, command: Column, directory: Column) -> Column:
    """The include paths (absolute) and macro definitions of a compilation, in order; all other options go.

    Only commands given as one text are split by Python; the rest folds over the arguments with the
    option that still waits for its value.
    """
    words = F.coalesce(arguments, _split_command(F.when(arguments.isNull(), command)))
    words = F.slice(words, 2, F.greatest(F.lit(0), F.size(words) - 1))
    absolute = lambda p: F.when(F.startswith(p, F.lit("/")), p).otherwise(F.concat_ws("/", directory, p))
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("waits"))
    added = lambda acc, flag: F.struct(F.concat(acc["out"], F.array(flag)).alias("out"), F.lit("").alias("waits"))
    same = lambda acc, waits: F.struct(acc["out"].alias("out"), F.lit(waits).alias("waits"))

    def step(acc: Column, word: Column) -> Column:
        glued = F.regexp_extract(word, r"^(?:-isystem|-iquote|-I)(.+)$", 1)
        return (
            F.when(acc["waits"] == "I", added(acc, F.concat(F.lit("-I"), absolute(word))))
            .when(acc["waits"].isin("-D", "-U"), added(acc, F.concat(acc["waits"], word)))
            .when(acc["waits"] == "skip", same(acc, ""))
            .when(word.isin("-I", "-isystem", "-iquote"), same(acc, "I"))
            .when(glued != "", added(acc, F.concat(F.lit("-I"), absolute(glued))))
            .when(word == "-D", same(acc, "-D"))
            .when(word == "-U", same(acc, "-U"))
            .when(word.rlike("^-[DU]."), added(acc, word))
            .when(word == "-include", same(acc, "skip"))
            .otherwise(same(acc, ""))
        )

    return F.aggregate(words, start, step, lambda acc: acc["out"])


def headers_seen(cells: DataFrame, headers: DataFrame) -> DataFrame:
    """Headers that the cells of a run's valid reports name: their path occurs in a cell, as part of a longer one or by itself.

    A cell is cut into its path-like runs, and every tail of one that begins at a directory is looked up, so
    the join is by equality and no cell meets every header.
    """
    words = F.explode(F.regexp_extract_all("cell", F.lit(r"[^\s\"',:;()<>]+"), F.lit(0))).alias("word")
    rows = cells.select("run_id", words)
    parts = F.split("word", "/")
    tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, n, F.size(parts)), "/"))
    named = rows.select("run_id", F.explode(tails).alias("path")).distinct()
    return headers.join(named, ["run_id", "path"], "left_semi")


def scanner_records(units: DataFrame, scanners: DataFrame) -> DataFrame:
    """One record per run and scanner definition: its version, counts and the statuses of its units.

    ``scanners`` (producer, skill_version, categories) is a small dimension; a scanner without units keeps a record.
    """
    one = F.count(F.lit(1))
    got = units.groupBy("run_id", "producer").agg(
        one.alias("total"), F.count_if(F.col("status") != "unscheduled").alias("attempted"),
        F.count_if("valid_report").alias("analyzed"), F.count_if(F.col("status") == "completed").alias("completed"),
    )
    grid = units.select("run_id").distinct().crossJoin(F.broadcast(scanners))
    out = grid.join(got, ["run_id", "producer"], "left").fillna(0, ["total", "attempted", "analyzed", "completed"])
    return out.withColumn("ratio", F.try_divide(F.col("analyzed"), F.col("total")))


def audit(candidates: DataFrame) -> DataFrame:
    """Candidates by origin, by verdict and by both, and how many only scanners found that were confirmed."""
    sets = [["run_id", "origin"], ["run_id", "verdict"], ["run_id", "origin", "verdict"]]
    grouped = candidates.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in ("run_id", "origin", "verdict")])
    confirmed = F.count_if((F.col("origin") == "llm-only") & (F.col("verdict") == "confirmed"))
    return grouped.agg(F.count(F.lit(1)).alias("n"), confirmed.alias("llm_only_confirmed"))


def replan_observation(review: DataFrame, units: DataFrame) -> DataFrame:
    """After a round, findings by category and by severity and units by tier, in one long table; findings are read once."""
    one = F.count(F.lit(1)).alias("n")
    measures = [F.struct(F.lit(c).alias("measure"), F.col(c).alias("value")) for c in ("category", "severity")]
    found = review.select("run_id", F.inline(F.array(*measures))).groupBy("run_id", "measure", "value").agg(one)
    return found.unionByName(units.groupBy("run_id", F.lit("tier").alias("measure"), F.col("tier").alias("value")).agg(one))
