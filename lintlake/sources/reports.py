"""Readers of native analyzer reports: one whole report per row in, findings and diagnostics out.

A report table has run_id, unit_id, text, evidence_context and, where units declare it, valid_report.
A malformed report costs only itself: it gives no findings and exactly one integrity diagnostic.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from lintlake.functions import severity as S
from lintlake.functions.text import bound, scrub_host_paths
from lintlake.operators.batches import slices

# What makes a message a diagnostic of the tool rather than a finding, and of which kind.
DIAGNOSTIC = (
    r"(?i)parse.?error|syntax.?error|preprocess(?:or|ing)?(?:.?error)?|cannot (?:continue|parse)|internal.?(?:bug|error)"
    r"|cannot (?:find|open|read).*include|include file .*not found|missing.?include|configuration.?error"
    r"|unrecognized (?:option|flag|identifier)|unknown option|no valid configuration"
)
FATAL = r"(?i)fatal|parse.?error|syntax.?error|cannot (?:continue|parse)|internal.?(?:bug|error)"
CATEGORIES = (
    ("parsing", r"(?i)parse|syntax|cannot continue|internal|unrecognized identifier"),
    ("include", r"(?i)include"),
    ("configuration", r"(?i)preprocess|configuration|macro|option|flag"),
)
FINDING = ("run_id", "unit_id", "tool", "file", "line", "col", "rule_id", "cwe", "message", "original_severity", "evidence_context")
XML_SCHEMA = (
    "errors struct<error: array<struct<_id: string, _msg: string, _verbose: string, _severity: string, _cwe: string,"
    " location: array<struct<_file: string, _line: string, _column: string>>>>>, _corrupt_record string"
)
SARIF_SCHEMA = (
    "version string, runs array<struct<tool: struct<driver: struct<rules: array<struct<id: string, name: string,"
    " properties: map<string, string>>>>>, results: array<struct<ruleId: string, level: string, message: struct<text: string>,"
    " properties: map<string, string>, locations: array<struct<physicalLocation: struct<artifactLocation: struct<uri: string>,"
    " region: struct<startLine: string, startColumn: string>>>>>>, invocations: array<struct<toolExecutionNotifications:"
    " array<struct<level: string, message: struct<text: string>>>>>>>, _corrupt_record string"
)
SCANNER_SCHEMA = (
    "schema_version int, valid_report boolean, producer string, unit_id string, malformed array<string>,"
    " findings array<struct<file: string, line: int, line_range: array<int>, category: string, severity: string, cwe: string,"
    " rule_id: string, symbol: string, message: string, confidence: double>>"
)


def is_diagnostic(text: Column) -> Column:
    """B04."""
    return text.rlike(DIAGNOSTIC)


def is_fatal(text: Column) -> Column:
    return text.rlike(FATAL)


def diagnostic_category(text: Column) -> Column:
    """The first kind that fits."""
    out = F.when(F.lit(False), "")
    for name, pattern in CATEGORIES:
        out = out.when(text.rlike(pattern), name)
    return out.otherwise("tool")


def evidence_context(tool: Column, unit_id: Column, scope: Column, declared: Column) -> Column:
    """What the unit declares, else what its tool implies."""
    implied = ((tool == "cppcheck") & (unit_id == "compile-db")) | ((tool == "splint") & (scope == "build"))
    return F.when(declared.isin("build-aware", "source-only"), declared).when(implied, "build-aware").otherwise("source-only")


def _known(reports: DataFrame, problem: Column) -> Column:
    """What is wrong with a report: its column ``problem`` where it has been checked already."""
    return F.col("problem") if "problem" in reports.columns else problem


def integrity(reports: DataFrame, problem: Column, category: str = "report-integrity") -> DataFrame:
    """One diagnostic for each report that is undeclared, missing or malformed."""
    problem = _known(reports, problem)
    declared = F.col("valid_report") if "valid_report" in reports.columns else F.lit(True)
    reason = (
        F.when(~F.coalesce(declared, F.lit(False)), "unit did not declare a valid native report")
        .when(F.col("text").isNull(), "declared valid report is missing")
        .otherwise(problem)
    )
    rows = reports.withColumn("message", reason).where("message is not null")
    return rows.select(
        "run_id", "unit_id", "tool", F.lit("warning" if category.startswith("llm") else "error").alias("severity"),
        F.lit(category).alias("category"), "message", F.lit(False).alias("fatal"), "evidence_context",
    )


def sound(reports: DataFrame, problem: Column) -> DataFrame:
    declared = F.col("valid_report") if "valid_report" in reports.columns else F.lit(True)
    return reports.where(F.coalesce(declared, F.lit(False)) & F.col("text").isNotNull() & _known(reports, problem).isNull())


def xml_problem(text: Column, doc: Column | None = None) -> Column:
    """Null for well-formed XML under a ``results`` root."""
    doc = F.from_xml(text, XML_SCHEMA) if doc is None else doc
    root = F.regexp_extract(text, r"^\s*(?:<\?[^>]*\?>\s*|<!--.*?-->\s*)*<([A-Za-z_][\w.-]*)", 1)
    broken = doc["_corrupt_record"].isNotNull() | ~text.rlike(r"(?s)<results[^>]*/>\s*$|</results>\s*$")
    return F.when(root != "results", "Cppcheck XML root is not results").when(broken, "invalid Cppcheck XML")


def sarif_document(text: Column) -> Column:
    """A SARIF text by the reader's schema. Naming a mode keeps Spark from parsing for one field alone, which would
    leave faults in the others unseen."""
    return F.from_json(text, SARIF_SCHEMA, {"mode": "PERMISSIVE"})


def sarif_problem(text: Column, parsed: Column | None = None, doc: Column | None = None) -> Column:
    """Null for SARIF 2.1.0 of the expected shape in every run; the first rule that fails is named.

    A text that the reader's schema takes as it is, and in which nothing is null, breaks none of the rules, which
    say no more than the schema does; the rules are gone through for the others only.
    """
    v = F.try_parse_json(text) if parsed is None else parsed
    doc = sarif_document(text) if doc is None else doc
    is_plain = doc["_corrupt_record"].isNull() & doc["runs"].isNotNull() & ~F.contains(text, F.lit("null"))
    at = lambda x, path: F.try_variant_get(x, path, "variant")
    kind = lambda x, path: F.coalesce(F.schema_of_variant(at(x, path)), F.lit(""))
    has = lambda x, path: at(x, path).isNotNull()
    is_object = lambda x, path: ~has(x, path) | F.startswith(kind(x, path), F.lit("OBJECT"))
    is_array = lambda x, path: ~has(x, path) | F.startswith(kind(x, path), F.lit("ARRAY"))
    of_objects = lambda x, path: ~has(x, path) | F.startswith(kind(x, path), F.lit("ARRAY<OBJECT")) | (kind(x, path) == "ARRAY<VOID>")
    each = lambda x, path: F.coalesce(F.try_variant_get(x, path, "array<variant>"), F.array().cast("array<variant>"))
    in_results = lambda r, ok: F.forall(r["results"], ok)
    in_places = lambda r, ok: in_results(r, lambda x: F.forall(each(x, "$.locations"), ok))
    physical = lambda x: (
        is_object(x, "$.physicalLocation") & is_object(x, "$.physicalLocation.region") & is_object(x, "$.physicalLocation.artifactLocation")
    )
    rules = (
        ("results must be an array", lambda r: is_array(r["run"], "$.results")),
        ("results must contain objects", lambda r: of_objects(r["run"], "$.results")),
        ("tool must be an object", lambda r: is_object(r["run"], "$.tool")),
        ("driver rules must be an array of objects", lambda r: is_object(r["run"], "$.tool.driver") & of_objects(r["run"], "$.tool.driver.rules")),
        ("locations must be an array of objects", lambda r: in_results(r, lambda x: of_objects(x, "$.locations"))),
        ("physical locations must be objects", lambda r: in_places(r, physical)),
        ("invocations must be an array of objects", lambda r: of_objects(r["run"], "$.invocations")),
        (
            "notifications must be an array of objects",
            lambda r: F.forall(each(r["run"], "$.invocations"), lambda x: of_objects(x, "$.toolExecutionNotifications")),
        ),
    )

    def faults(runs: Column) -> Column:
        out = F.when(F.lit(False), "")
        for said, sound_run in rules:
            out = out.when(~F.forall(runs, sound_run), f"invalid Flawfinder SARIF: {said}")
        return out

    parts = F.transform(each(v, "$.runs"), lambda r: F.struct(r.alias("run"), each(r, "$.results").alias("results")))
    fault = bound({"runs": parts}, lambda x: faults(x["runs"]))
    return (
        F.when(v.isNull(), "invalid Flawfinder SARIF")
        .when(F.coalesce(F.try_variant_get(v, "$.version", "string"), F.lit("")) != "2.1.0", "Flawfinder report is not SARIF 2.1.0")
        .when(is_plain, F.lit(None).cast("string"))
        .when(~has(v, "$.runs") | ~of_objects(v, "$.runs"), "invalid Flawfinder SARIF: runs must be an array of objects")
        .otherwise(F.coalesce(fault, F.when(doc["runs"].isNull(), "invalid Flawfinder SARIF: unexpected shape")))
    )


def _csv_rows(text: str) -> tuple[list[list[str]], str | None]:
    """Rows of a table that are not blank, or what keeps it from being read."""
    if not text.strip() or "\0" in text:
        return [], "report is empty or contains NUL"
    try:
        rows = [r for r in csv.reader(io.StringIO(text, newline=""), strict=True) if any(c.strip() for c in r)]
    except csv.Error as error:
        return [], str(error)
    if not rows or len(rows[0]) < 2:
        return [], "expected comma-separated columns"
    return rows, "inconsistent or truncated rows" if any(len(r) != len(rows[0]) for r in rows) else None


@F.udf(returnType=StringType(), useArrow=True)
def _csv_said(text):
    problem = _csv_rows(text)[1] if text is not None else None
    return f"invalid Splint CSV: {problem}" if problem else None


def csv_problem(text: Column) -> Column:
    """Null for a rectangular table of at least two columns. A report is bounded and read in one pass."""
    return _csv_said(text)


def scanner_problem(text: Column, parsed: Column | None = None, doc: Column | None = None) -> Column:
    """Null for a scanner report whose findings all have a message."""
    v = F.try_parse_json(text) if parsed is None else parsed
    kind = lambda path: F.coalesce(F.schema_of_variant(F.try_variant_get(v, path, "variant")), F.lit(""))
    doc = F.from_json(text, SCANNER_SCHEMA) if doc is None else doc
    said = F.forall(doc["findings"], lambda f: F.trim(F.coalesce(f["message"], F.lit(""))) != "")
    head = "invalid LLM findings report: "
    return (
        F.when(v.isNull(), "invalid LLM findings report")
        .when(~F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), head + "expected a JSON object")
        .when(kind("$.schema_version") != "BIGINT", head + "schema_version must be an integer")
        .when(kind("$.valid_report") != "BOOLEAN", head + "valid_report must be a boolean")
        .when(F.coalesce(F.when(kind("$.producer") == "STRING", doc["producer"]), F.lit("")) == "", head + "producer must be a non-empty string")
        .when(~F.startswith(kind("$.findings"), F.lit("ARRAY<OBJECT")) & (kind("$.findings") != "ARRAY<VOID>"), head + "findings must be an array of objects")
        .when(~F.coalesce(said, F.lit(True)), head + "every finding needs a message")
    )


def checked(reports: DataFrame, kind: str) -> DataFrame:
    """Reports of a kind that can be malformed with what they are parsed to, ``doc``, and their ``problem``; parsed once."""
    if kind == "csv":
        return reports.mapInArrow(_check_csv, StructType([*reports.schema.fields, *CSV_CHECKED]))
    parse, problem = {
        "xml": (lambda t: F.from_xml(t, XML_SCHEMA), xml_problem), "sarif": (sarif_document, sarif_problem),
        "json": (lambda t: F.from_json(t, SCANNER_SCHEMA), scanner_problem),
    }[kind]
    values = {"doc": parse(F.col("text"))} | ({} if kind == "xml" else {"parsed": F.try_parse_json("text")})
    rows = reports.select("*", F.inline(F.array(F.struct(*(v.alias(n) for n, v in values.items())))))
    return rows.withColumn("problem", problem(F.col("text"), **{n: F.col(n) for n in values})).drop("parsed")


def _documents(reports: DataFrame, kind: str) -> DataFrame:
    """The documents of reports in which nothing is wrong."""
    return sound(reports if "doc" in reports.columns else checked(reports, kind), F.col("problem"))


def cppcheck(reports: DataFrame) -> DataFrame:
    """One row per error and location; an error without a location gives one row."""
    doc = _documents(reports, "xml").select("run_id", "unit_id", "tool", "evidence_context", F.col("doc").alias("x"))
    errors = doc.select("run_id", "unit_id", "tool", "evidence_context", F.posexplode("x.errors.error").alias("pos", "e"))
    at = errors.select("*", F.posexplode_outer("e.location").alias("loc_pos", "l"))
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    message = F.when(empty("e._msg") != "", F.col("e._msg")).otherwise(empty("e._verbose"))
    cwe = F.when(empty("e._cwe") != "", F.concat(F.lit("CWE-"), F.col("e._cwe"))).otherwise(S.cwe_of(message))
    return at.select(
        "run_id", "unit_id", "tool", empty("l._file").alias("file"), empty("l._line").alias("line"), empty("l._column").alias("col"),
        empty("e._id").alias("rule_id"), cwe.alias("cwe"), message.alias("message"),
        F.when(empty("e._severity") == "", "unknown").otherwise(F.col("e._severity")).alias("original_severity"), "evidence_context",
        is_diagnostic(F.concat_ws(" ", empty("e._id"), message)).alias("is_diagnostic"), "pos", "loc_pos",
    )


def first_given(values: list[tuple[Column, str]]) -> tuple[Column, Column]:
    """The first value that is neither null nor empty, and the name of its scale."""
    value, scale = F.when(F.lit(False), ""), F.when(F.lit(False), "")
    for v, name in values:
        given = F.coalesce(v.cast("string"), F.lit("")) != ""
        value, scale = value.when(given, v.cast("string")), scale.when(given, name)
    return value.otherwise("unknown"), scale


def flawfinder(reports: DataFrame) -> DataFrame:
    """One row per result and location, with the rule's own grade where the result has none."""
    doc = _documents(reports, "sarif").select("run_id", "unit_id", "tool", "evidence_context", F.col("doc").alias("j"))
    runs = doc.select("run_id", "unit_id", "tool", "evidence_context", F.posexplode("j.runs").alias("run_no", "r"))
    rules = F.coalesce("r.tool.driver.rules", F.array())
    results = runs.select("run_id", "unit_id", "tool", "evidence_context", "run_no", rules.alias("rules"), F.posexplode("r.results").alias("pos", "x"))
    # Of rules with one id the last counts; rules without an id are nobody's.
    rule = F.try_element_at(F.filter("rules", lambda r: r["id"] == F.col("x.ruleId")), F.lit(-1))
    rows = results.withColumn("rule", rule).select("*", F.posexplode_outer("x.locations").alias("loc_pos", "l"))
    prop = lambda base, key: F.try_element_at(F.col(f"{base}.properties"), F.lit(key))
    value, scale = first_given(
        [
            (prop("x", "security-severity"), "security-severity"), (prop("x", "level"), "level"),
            (prop("rule", "security-severity"), "security-severity"), (prop("rule", "level"), "level"), (F.col("x.level"), "level"),
        ]
    )
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    said = F.concat_ws(" ", empty("x.ruleId"), empty("x.message.text"), F.coalesce(F.to_json("rule"), F.lit("")))
    return rows.select(
        "run_id", "unit_id", "tool", empty("l.physicalLocation.artifactLocation.uri").alias("file"),
        empty("l.physicalLocation.region.startLine").alias("line"), empty("l.physicalLocation.region.startColumn").alias("col"),
        empty("x.ruleId").alias("rule_id"), S.cwe_of(said).alias("cwe"), empty("x.message.text").alias("message"),
        value.alias("original_severity"), scale.alias("severity_scale"), "evidence_context",
        is_diagnostic(F.concat_ws(" ", empty("x.ruleId"), empty("x.message.text"))).alias("is_diagnostic"), "run_no", "pos", "loc_pos",
    )


def notifications(reports: DataFrame) -> DataFrame:
    """What the tool says of its own execution, from the first invocation of every run."""
    doc = _documents(reports, "sarif").select("run_id", "unit_id", "tool", "evidence_context", F.col("doc").alias("j"))
    runs = doc.select("run_id", "unit_id", "tool", "evidence_context", F.explode("j.runs").alias("r"))
    first = F.try_element_at("r.invocations", F.lit(1))["toolExecutionNotifications"]
    rows = runs.select("run_id", "unit_id", "tool", "evidence_context", F.explode(first).alias("n"))
    level = F.coalesce("n.level", F.lit("warning"))
    return rows.select(
        "run_id", "unit_id", "tool", level.alias("severity"), F.lit("tool").alias("category"),
        F.coalesce("n.message.text", F.lit("")).alias("message"), (level == "error").alias("fatal"), "evidence_context",
    )


# The names of the columns of a Splint table, any of which may head it.
CSV_NAMES = {
    "file": ("file", "filename", "path", "source"), "line": ("line", "linenumber", "line number"), "col": ("column", "col"),
    "message": ("message", "warning", "description", "text"), "rule_id": ("rule", "rule_id"),
}


def _csv_findings(rows: list[list[str]]) -> Iterator[dict[str, str | int]]:
    """Lines with a message by the names of their columns; of equal names the last one counts."""
    head = {name.strip().lower(): i for i, name in enumerate(rows[0])}
    for pos, row in enumerate(rows[1:]):
        given = {
            c: next((row[head[n]] for n in names if n in head and row[head[n]]), "") for c, names in CSV_NAMES.items()
        }
        if not given["message"] and len(row) >= 3:
            given |= {"file": row[0], "line": row[1], "message": ",".join(row[2:])}
        if given["message"]:
            yield given | {"rule_id": given["rule_id"] or "splint-warning", "pos": pos}


#: What a checked table has beside its report.
_CSV_FINDING = StructType([*(StructField(c, StringType()) for c in CSV_NAMES), StructField("pos", IntegerType())])
CSV_CHECKED = (StructField("doc", ArrayType(_CSV_FINDING)), StructField("problem", StringType()))
_CSV_DOC = pa.list_(pa.struct([*((c, pa.string()) for c in CSV_NAMES), ("pos", pa.int32())]))


def _check_csv(batches):
    """Findings of every table, none where it has a problem."""
    for batch in (part for whole in batches for part in slices(whole)):
        read = [_csv_rows(text) if text is not None else ([], None) for text in batch["text"].to_pylist()]
        docs = [[] if problem or not rows else list(_csv_findings(rows)) for rows, problem in read]
        said = [f"invalid Splint CSV: {problem}" if problem else None for _, problem in read]
        yield batch.append_column("doc", pa.array(docs, _CSV_DOC)).append_column("problem", pa.array(said, pa.string()))


def splint_csv(reports: DataFrame) -> DataFrame:
    """One row per line with a message, columns found by any of their names."""
    rows = _documents(reports, "csv").select("run_id", "unit_id", "tool", "evidence_context", F.inline("doc"))
    return rows.withColumns(
        {"original_severity": F.lit("unknown"), "cwe": S.cwe_of(F.col("message")), "is_diagnostic": is_diagnostic(F.col("message"))}
    )


def splint_log(logs: DataFrame) -> DataFrame:
    """Located messages of a text log; wrapped locations are joined, indented lines continue a message.

    Blank lines and closing words are left out, then a log is cut in front of every line that is not indented, so
    each part is a message with its continuation, and no line is shuffled.
    """
    joined = F.regexp_replace("text", r"(?m)^(\S[^\n]*?:\d+):[ \t]*\n[ \t]+(\d+):[ \t]+", "$1:$2: ")
    joined = F.regexp_replace(joined, r"(?m)^([^\s:][^\n:]*/[^\n:]*)\n[ \t]+([^\n:]+:\d+(?::\d+)?:[ \t])", "$1$2")
    kept = F.regexp_replace(F.replace(joined, F.lit("\r\n"), F.lit("\n")), r"(?i)(?<=\n|\A)(?: *|finished checking[^\n]*+)(?:\n|\z)", "")
    parts = logs.select("run_id", "unit_id", "tool", "evidence_context", F.posexplode(F.split(kept, r"\n(?=\S)")).alias("pos", "part"))
    parts = parts.where(F.col("part").rlike(r"^\S")).withColumn("raw", F.split_part("part", F.lit("\n"), F.lit(1)))
    located = r"^(\S.*?):(\d+)(?::(\d+))?:\s+(.+)$"
    unknown = r"(?i)^<\s*Location unknown\s*>:\s+(.+)$"
    c = F.col
    parts = parts.withColumn("kind", F.when(c("raw").rlike(unknown), "unknown").when(c("raw").rlike(located), "located").otherwise("other"))
    following = F.filter(F.split("part", "\n"), lambda x, i: (i > 0) & (x != ""))
    more = F.when(F.contains("part", F.lit("\n")), F.array_join(F.transform(following, lambda x: F.trim(x)), " ")).otherwise("")
    text = F.when(c("kind") == "located", F.trim(F.regexp_extract("raw", located, 4))).when(
        c("kind") == "unknown", F.trim(F.regexp_extract("raw", unknown, 1))
    ).otherwise(F.trim("raw"))
    message = F.when((c("kind") == "located") & (more != ""), F.concat_ws(" ", text, more)).otherwise(text)
    group = lambda n: F.when(c("kind") == "located", F.regexp_extract("raw", located, n)).otherwise("")
    out = parts.select(
        "run_id", "unit_id", "tool", F.when(c("kind") == "unknown", "< Location unknown >").otherwise(group(1)).alias("file"),
        group(2).alias("line"), group(3).alias("col"), F.lit("splint-warning").alias("rule_id"), message.alias("message"),
        F.lit("unknown").alias("original_severity"), "evidence_context", "pos", "kind",
    ).withColumns({"cwe": S.cwe_of(c("message")), "is_diagnostic": is_diagnostic(c("message"))})
    return out.where("kind <> 'other' or is_diagnostic").drop("kind")


def encoding_exclusions(logs: DataFrame) -> DataFrame:
    """Files a tool left out for their encoding, with the byte it stopped at."""
    pattern = r"(?is)Error:\s*encoding error in ([^\r\n]+).*?position\s+(\d+)"
    pairs = F.arrays_zip(F.regexp_extract_all("text", F.lit(pattern), F.lit(1)).alias("f"), F.regexp_extract_all("text", F.lit(pattern), F.lit(2)).alias("n"))
    return logs.select("run_id", "unit_id", F.explode(pairs).alias("x")).select(
        "run_id", "unit_id", F.trim("x.f").alias("file"), F.col("x.n").cast("long").alias("byte_offset")
    )


def scanner(reports: DataFrame) -> DataFrame:
    """Findings of scanner reports, host paths scrubbed, with their line span."""
    doc = _documents(reports, "json").select("run_id", "unit_id", "tool", "evidence_context", F.col("doc").alias("j"))
    rows = doc.select("run_id", "unit_id", "tool", "evidence_context", F.posexplode("j.findings").alias("pos", "f"))
    clean = lambda c: scrub_host_paths(F.trim(F.coalesce(F.col(c), F.lit(""))))
    given = F.when(F.size("f.line_range") == 2, F.col("f.line_range")).otherwise(F.array("f.line", "f.line"))
    span = F.when((given[0] > 0) & given[1].isNotNull(), F.array(given[0], F.greatest(given[0], given[1])))
    category = F.lower(F.trim(F.coalesce("f.category", F.lit(""))))
    return rows.select(
        "run_id", "unit_id", "tool", clean("f.file").alias("file"), F.coalesce(span[0].cast("string"), F.lit("")).alias("line"),
        F.lit("").alias("col"),
        F.when(clean("f.rule_id") != "", clean("f.rule_id")).when(category != "", category).otherwise("llm-finding").alias("rule_id"),
        S.cwe_of(F.coalesce("f.cwe", F.lit(""))).alias("cwe"), clean("f.message").alias("message"),
        F.when(S.clean(F.col("f.severity")) == "", "unknown").otherwise(S.clean(F.col("f.severity"))).alias("original_severity"),
        "evidence_context", F.when(category == "", "unknown").otherwise(category).alias("category"), span.alias("line_range"), "pos",
    )


def dropped_findings(reports: DataFrame) -> DataFrame:
    """One diagnostic for a scanner report that says some of its findings were dropped."""
    doc = _documents(reports, "json").select("run_id", "unit_id", "tool", F.col("doc").alias("j"))
    reasons = F.filter(F.coalesce("j.malformed", F.array()), lambda r: F.trim(r) != "")
    said = F.format_string("%d model finding(s) failed validation and were dropped: %s", F.size(reasons), F.try_element_at(reasons, F.lit(1)))
    return doc.where(F.size(reasons) > 0).select("run_id", "unit_id", "tool", F.lit("llm-malformed").alias("category"), scrub_host_paths(said).alias("message"))
