"""Compile databases: parsing, validity, joins with the inventory, and how good a candidate is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ENTRIES = "array<struct<directory: string, file: string, command: string, arguments: array<string>, output: string>>"


def entries(databases: DataFrame) -> DataFrame:
    """One row per entry of each database (run_id, db_path, text), with the absolute path of its file."""
    rows = databases.select("run_id", "db_path", F.posexplode(F.from_json("text", ENTRIES)).alias("ord", "e"))
    path = F.when(F.startswith("e.file", F.lit("/")), F.col("e.file")).otherwise(F.concat_ws("/", "e.directory", "e.file"))
    return rows.select("run_id", "db_path", "ord", "e.*", F.regexp_replace(path, r"/(?:\./)+", "/").alias("path"))


def entry_problem(rows: DataFrame) -> DataFrame:
    """The first rule that an entry breaks, null for a valid one; arguments or a command are enough, one of them."""
    given = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    arguments = (F.size("arguments") > 0) & F.forall("arguments", lambda a: a.isNotNull())
    problem = (
        F.when(~given("file"), "file is missing")
        .when(~given("directory"), "directory is missing")
        .when(F.col("arguments").isNull() & F.col("command").isNull(), "neither arguments nor command")
        .when(~(F.coalesce(arguments, F.lit(False)) | given("command")), "arguments and command are empty")
    )
    return rows.withColumn("problem", problem)


def covered(rows: DataFrame, inventory: DataFrame) -> DataFrame:
    """Entries whose file is an inventory file and no header; inventory has run_id, path, language."""
    files = inventory.where("language <> 'header'").select("run_id", "path")
    return rows.join(files, ["run_id", "path"], "left_semi")


def fallback(rows: DataFrame, inventory: DataFrame) -> DataFrame:
    """Source files that no entry covers."""
    files = inventory.where("language <> 'header'").select("run_id", "path")
    return files.join(rows.select("run_id", "path"), ["run_id", "path"], "left_anti")


def configurations(rows: DataFrame, inventory: DataFrame) -> DataFrame:
    """Every C file with each of its build configurations, or with none."""
    files = inventory.where("language = 'c'").select("run_id", "path")
    return files.join(rows.select("run_id", "path", "ord"), ["run_id", "path"], "left").select(
        "run_id", "path", "ord", F.col("ord").isNotNull().alias("in_build")
    )


def inspected(databases: DataFrame, rows: DataFrame, tree: DataFrame) -> DataFrame:
    """How good every database (run_id, db_path, mtime, text) is for its source tree.

    ``rows`` are all its entries, ``tree`` what exists there: run_id, path, is_dir, mtime, in_source (a source
    file of the tree under review). One row per database: whether it is valid (not empty and without a
    broken entry), entries, distinct files and how many of these are missing, covered sources and their
    share of the files, entries whose working directory exists and their share, the newest covered source,
    whether one is newer than the database, and whether it can be used. Entries are counted by directory
    and by file before they meet the tree, so a directory that all entries share is one row.
    """
    key = ["run_id", "db_path"]
    checked = entry_problem(rows)
    whole = checked.groupBy(*key).agg(F.count(F.lit(1)).alias("entries"), F.count("problem").alias("broken"))
    there = lambda d: tree.where(F.col("is_dir") if d else ~F.col("is_dir"))
    dirs = there(True).select("run_id", F.col("path").alias("directory"), F.lit(True).alias("exists"))
    by_directory = checked.groupBy(*key, "directory").agg(F.count(F.lit(1)).alias("n")).join(dirs, ["run_id", "directory"], "left")
    directories = by_directory.groupBy(*key).agg(F.coalesce(F.sum(F.when(F.col("exists"), F.col("n"))), F.lit(0)).alias("valid_directories"))
    own = there(False).select("run_id", "path", F.col("mtime").alias("file_mtime"), "in_source")
    by_file = checked.select(*key, "path").distinct().join(own, ["run_id", "path"], "left")
    files = by_file.groupBy(*key).agg(
        F.count(F.lit(1)).alias("files"),
        F.count_if(F.col("in_source").isNull()).alias("missing_files"),
        F.count_if("in_source").alias("covered_sources"),
        F.max(F.when(F.col("in_source"), F.col("file_mtime"))).alias("newest_source"),
    )
    counted = whole.join(directories, key).join(files, key)
    out = databases.select(*key, "mtime").join(counted, key, "left")
    valid = F.coalesce(F.col("broken") == 0, F.lit(False))
    out = out.withColumn("valid", valid)
    for name in ("entries", "files", "missing_files", "covered_sources", "valid_directories"):
        out = out.withColumn(name, F.when(F.col("valid"), F.col(name)).otherwise(F.lit(0)))
    share = lambda a, b: F.coalesce(F.bround(F.try_divide(F.col(a), F.col(b)), 6), F.lit(0.0))
    return out.select(
        *key, "mtime", "valid", "entries", "files", "missing_files", "covered_sources", share("covered_sources", "files").alias("source_ratio"),
        "valid_directories", (F.col("entries") - F.col("valid_directories")).alias("invalid_directories"),
        share("valid_directories", "entries").alias("directory_ratio"),
        F.coalesce(F.col("valid") & (F.col("newest_source") > F.col("mtime")), F.lit(False)).alias("possibly_stale"),
        ((F.col("valid_directories") > 0) & (F.col("covered_sources") > 0)).alias("usable"),
    )


def best(stats: DataFrame) -> DataFrame:
    """Of each run's usable databases the one that covers most sources, then with the greatest share of
    existing directories, then the youngest; of equals the first path."""
    order = F.struct(
        -F.col("covered_sources"), -F.col("directory_ratio"), -F.coalesce(F.col("mtime").cast("double"), F.lit(0.0)), F.col("db_path").alias("db_path")
    )
    return stats.where("usable").groupBy("run_id").agg(F.min(order).alias("k")).select("run_id", "k.db_path")


def degraded(stats: DataFrame) -> DataFrame:
    """What a review should say about each database: one row per remark."""
    remark = lambda test, text: F.when(test, text)
    said = F.array(
        remark(~F.col("valid"), F.lit("database is not valid")),
        remark(F.col("invalid_directories") > 0, F.concat(F.col("invalid_directories").cast("string"), F.lit(" working directories do not exist"))),
        remark(F.col("missing_files") > 0, F.concat(F.col("missing_files").cast("string"), F.lit(" source files do not exist"))),
        remark(F.col("possibly_stale"), F.lit("a covered source is newer than the database")),
        remark(F.col("valid") & ~F.col("usable"), F.lit("no working directory or no source exists")),
    )
    return stats.select("run_id", "db_path", F.explode(F.array_compact(said)).alias("remark"))
