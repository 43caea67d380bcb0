"""The symbol index of source files: one row per file, tables of its parts, and what they resolve to.

Files are parsed where they are read, one at a time; everything across files is joins and sums keyed
by ``run_id``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from lintlake.operators.batches import slices, small_batches
from lintlake.sources.c_source import parse

LOW_CONFIDENCE = 0.5
MOST_CALLEES, MOST_NAMES = 64, 32
_PARTS = {
    "functions": "name string, start_byte long, end_byte long, body_start long, line_start int, line_end int, signature string,"
    " kr_style boolean, macro_header boolean, conditional string, dead boolean, calls array<string>",
    "types": "name string, kind string, start_byte long, end_byte long, line int, definition string",
    "globals": "name string, kind string, start_byte long, end_byte long, line int, definition string",
    "macros": "name string, function_like boolean, start_byte long, end_byte long, line int, definition string",
    "includes": "target string, system boolean, line int",
    "conditionals": "kind string, condition string, depth int, start long, body_start long, body_end long, line_start int,"
    " line_end int, dead boolean",
    "dead_spans": "start_byte long, end_byte long",
}


def _struct(fields: str) -> str:
    return "struct<" + ", ".join(f.strip().replace(" ", ": ", 1) for f in fields.split(",")) + ">"


PARSED = ", ".join(
    [f"{name} array<{_struct(fields)}>" for name, fields in _PARTS.items()]
    + ["parse_confidence double", "parse_problems array<string>", "unparsed_from long", "sha256 string", "size long"]
)
_UNREAD = {name: [] for name in _PARTS} | {
    "parse_confidence": 0.0, "parse_problems": ["unreadable"], "unparsed_from": None, "sha256": None, "size": None,
}


#: What makes a file's text (Latin-1, so that positions are bytes) into the parts of an index; parts it leaves out are empty.
Parser = Callable[[str], dict[str, Any]]
#: The parsers that may be named, beside those handed in.
PARSERS: dict[str, Parser] = {"c": parse}


def _parsed(parser: Parser | None, name: str, content: bytes) -> dict[str, Any]:
    own = {"sha256": hashlib.sha256(content).hexdigest(), "size": len(content)}
    if parser is None:
        return _UNREAD | {"parse_problems": [f"no parser {name}"]} | own
    try:
        return _UNREAD | {"parse_problems": [], "parse_confidence": 1.0} | parser(content.decode("latin-1")) | own
    except Exception as problem:  # a parser handed in may fail on any file, and costs that file only
        return _UNREAD | {"parse_problems": [f"parser {name} failed: {type(problem).__name__}"]} | own


def _parse(arrow: pa.Schema, parsers: dict[str, Parser]):
    def run(batches):
        for batch in (s for b in batches for s in slices(b)):
            rows = []
            for name, content in zip(batch["parser"].to_pylist(), batch["content"].to_pylist(), strict=True):
                rows.append(_UNREAD if content is None else _parsed(parsers.get(name), name, content))
            kept = batch.drop_columns(["content", "parser"])
            columns = [pa.array([r[f.name] for r in rows], f.type) for f in arrow]
            yield pa.RecordBatch.from_arrays([*kept.columns, *columns], [*kept.schema.names, *arrow.names])

    return run


def source_index(files: DataFrame, parsers: dict[str, Parser] | None = None, choose: Column | None = None) -> DataFrame:
    """One row per file of ``files`` (run_id, path, content, ...).

    ``content`` is binary, as only bytes have offsets; a null one leaves an unreadable file of zero
    confidence. The other columns stay as they are. ``parsers`` are more parsers by name, shipped to the
    workers as they are; ``choose`` is the name of each file's (a column of the path, say), "c" where it is
    null. A parser that fails, or a name without one, costs its own files their parts, and says so.
    """
    parsed = StructType.fromDDL(PARSED)
    others = files.drop("content")
    schema = StructType(others.schema.fields + parsed.fields)
    name = F.coalesce(choose if choose is not None else F.lit(None).cast("string"), F.lit("c"))
    rows = files.select(*others.columns, name.alias("parser"), F.col("content").cast("binary").alias("content"))
    small_batches(files.sparkSession)
    out = rows.mapInArrow(_parse(to_arrow_schema(parsed), PARSERS | (parsers or {})), schema)
    return out.withColumn("readable", F.col("size").isNotNull())


def part(index: DataFrame, name: str) -> DataFrame:
    """One row per element of a part, with its place in the file."""
    fields = [f.split()[0] for f in _PARTS[name].split(", ")]
    rows = index.select("run_id", "path", F.posexplode(name).alias("ord", "p"))
    return rows.select("run_id", "path", "ord", *[F.col(f"p.{f}").alias(f) for f in fields])


def totals(index: DataFrame) -> DataFrame:
    """Files, functions, bytes, unreadable files and files of low confidence of each run."""
    return index.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("files"),
        F.sum(F.size("functions")).cast("long").alias("functions"),
        F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"),
        F.count_if(~F.col("readable")).alias("unreadable"),
        F.count_if(F.col("parse_confidence") < LOW_CONFIDENCE).alias("parse_confidence_low"),
    )


def first_definition(rows: DataFrame, *payload: str, prefer: Column | None = None) -> DataFrame:
    """The first row of each name by path and place, after those that ``prefer`` (false first) puts behind.

    Sums before the shuffle leave one row of a name per task, so the commonest name is no large group.
    """
    order = F.struct(*([prefer.alias("later")] if prefer is not None else []), "path", "ord")
    best = F.min_by(F.struct("path", *payload), order)
    out = rows.groupBy("run_id", "name").agg(best.alias("b"), (F.count(F.lit(1)) - 1).alias("duplicates"))
    return out.select("run_id", "name", "b.*", "duplicates")


def summary(path: Column, line_start: Column, line_end: Column, calls: Column) -> Column:
    head = F.concat(F.lit("defined at "), path, F.lit(":"), line_start.cast("string"), F.lit("-"), line_end.cast("string"))
    shown = F.array_join(F.slice(calls, 1, 4), ", ")
    return F.when(F.size(calls) > 0, F.concat(head, F.lit("; calls "), shown)).otherwise(head)


def symbol_table(index: DataFrame) -> DataFrame:
    """The first function of each name, else its first prototype, and how many others there are."""
    functions = part(index, "functions").select(
        "run_id", "path", "ord", "name", F.lit("function").alias("kind"), F.col("line_start").alias("line"), "signature",
        summary(F.col("path"), F.col("line_start"), F.col("line_end"), F.col("calls")).alias("summary"),
    )
    prototypes = part(index, "globals").where("kind = 'prototype'").select(
        "run_id", "path", "ord", "name", "kind", "line", F.rtrim("definition", F.lit(";")).alias("signature"),
        F.concat(F.lit("declared in "), "path").alias("summary"),
    )
    rows = functions.unionByName(prototypes)
    return first_definition(rows, "kind", "line", "signature", "summary", prefer=F.col("kind") != "function")


def definition_table(index: DataFrame, section: str) -> DataFrame:
    """The first definition of each type, macro or global; prototypes define nothing."""
    rows = part(index, section)
    if section == "macros":
        rows = rows.withColumn("kind", F.lit("macros"))
    rows = rows.where("name <> '' and kind <> 'prototype'")
    return first_definition(rows, "kind", "line", "definition")


def call_edges(index: DataFrame, symbols: DataFrame) -> DataFrame:
    """Caller (path::name) and callee of every call of a known symbol."""
    calls = part(index, "functions").select(
        "run_id", F.concat_ws("::", "path", "name").alias("caller"), F.explode("calls").alias("callee")
    )
    known = symbols.select("run_id", F.col("name").alias("callee"))
    return calls.distinct().join(known, ["run_id", "callee"], "left_semi")


def callers(edges: DataFrame, most: int = MOST_NAMES) -> DataFrame:
    """Of each callee the first ``most`` names of functions that call it.

    A name is the last part of the caller's key. The names are cut to the first ones before they are
    collected, so that a function called from everywhere is no large group.
    """
    names = edges.select("run_id", "callee", F.substring_index("caller", "::", -1).alias("name")).distinct()
    place = F.row_number().over(W.partitionBy("run_id", "callee").orderBy("name"))
    first = names.withColumn("place", place).where(F.col("place") <= most)
    return first.groupBy("run_id", "callee").agg(F.array_sort(F.collect_list("name")).alias("callers"))


def callees(index: DataFrame, symbols: DataFrame, most: int = MOST_CALLEES) -> DataFrame:
    """C06 for units: per function its calls of known symbols among the first ``most`` it makes."""
    calls = part(index, "functions").select(
        "run_id", "path", "start_byte", F.posexplode(F.slice("calls", 1, most)).alias("at", "name")
    )
    found = calls.join(symbols.select("run_id", "name"), ["run_id", "name"], "left_semi")
    ordered = F.array_sort(F.collect_list(F.struct("at", "name")))
    return found.groupBy("run_id", "path", "start_byte").agg(F.transform(ordered, lambda x: x["name"]).alias("callees"))
