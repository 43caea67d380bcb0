"""Offline re-derivation of reviews from stored reports, of changed runs only.

A store is a folder of parts and catalogues. A part holds what one update derived, partitioned by run, and is
never changed. A catalogue says of every run which digest its reports had when it was derived and which part
has the outcome. An update compares the digests of the reports given with those of the last catalogue, reads
and derives only the runs that are new or different, writes them as a part, then writes the next
catalogue and last a commit, one file with one row that names it: readers see the runs of one catalogue or
those of the next, never a mixture, and an update that fails leaves files that nothing names. One update runs
at a time. The native reports are only read.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from lintlake.operators.full_review import Review
from lintlake.operators.ordering import BROADCAST_ROWS

TABLES = ("findings", "diagnostics")
COMMIT = "version long, catalogue string"
CATALOGUE = "run_id string, digest string, part string"
REPORT = ("unit_id", "tool", "kind", "evidence_context", "valid_report")


def report_digests(reports: DataFrame, content: Column | None = None) -> DataFrame:
    """run_id and a digest of all its reports, in any order; repeated reports count.

    ``content`` stands for a report's text where its digest is stored already, so that the text is not read.
    """
    own = F.sha2("text", 256) if content is None else content
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in REPORT]
    row = F.sha2(F.concat_ws("\1", *parts, F.coalesce(own, F.lit("\0"))), 256)
    # the sum of two halves of the rows' digests: the same for every order, and partial sums meet after the shuffle
    half = lambda at: F.sum(F.conv(F.substring(row, at, 15), 16, 10).cast("decimal(38,0)")).cast("string")
    out = reports.groupBy("run_id").agg(F.count(F.lit(1)).cast("string").alias("n"), half(1).alias("a"), half(16).alias("b"))
    return out.select("run_id", F.concat_ws("-", "n", "a", "b").alias("digest"))


@dataclass
class Update:
    """What an update found: runs by what became of them, and the catalogue now in force."""

    version: int
    added: int
    replaced: int
    removed: int
    kept: int


class Derivations:
    """Derived reviews in ``folder``, kept up to date with the reports of ``source``."""

    def __init__(self, spark: SparkSession, folder: str, source: str):
        self.spark, self.folder, self.source = spark, folder.rstrip("/"), source

    def _commits(self) -> list[tuple[int, str]]:
        """(version, catalogue) of every update that was completed and not cleared away, in order."""
        try:
            rows = self.spark.read.schema(COMMIT).parquet(f"{self.folder}/commits").collect()
        except AnalysisException as problem:
            if problem.getCondition() != "PATH_NOT_FOUND":
                raise
            return []
        return sorted((r["version"], r["catalogue"]) for r in rows)

    def catalogue(self, version: int | None = None) -> DataFrame:
        """run_id, digest and part of every run; of the last version, or of an earlier one, as long as it is there."""
        commits = self._commits()
        if version is None and not commits:
            return self.spark.createDataFrame([], CATALOGUE)
        name = commits[-1][1] if version is None else dict(commits)[version]
        return self.spark.read.schema(CATALOGUE).parquet(f"{self.folder}/catalogue/{name}")

    def update(self, reports: DataFrame, content: Column | None = None) -> Update:
        """Bring the store to the state of ``reports``; unchanged runs are not derived again."""
        commits = self._commits()
        version = commits[-1][0] if commits else -1
        before = self.catalogue().select("run_id", F.col("digest").alias("old"), "part")
        part = uuid.uuid4().hex
        now = report_digests(reports, content)
        joined = now.join(before, "run_id", "full_outer")
        path = f"{self.folder}/compared/{part}"
        joined.write.parquet(path)  # the digests are worked out once
        joined = self.spark.read.schema(joined.schema).parquet(path)
        changed = joined.where("digest is not null and (old is null or digest <> old)").select("run_id")
        n = joined.agg(
            F.count_if(F.expr("old is null")).alias("added"),
            F.count_if(F.expr("digest <> old")).alias("replaced"),
            F.count_if(F.expr("digest is null")).alias("removed"),
            F.count_if(F.expr("digest = old")).alias("kept"),
        ).first()
        if n["added"] + n["replaced"]:
            few = F.broadcast(changed) if n["added"] + n["replaced"] <= BROADCAST_ROWS else changed
            review = Review(reports.join(few, "run_id", "left_semi"), self.source)
            for name, rows in zip(TABLES, (review.grade(), review.distinct_diagnostics), strict=True):
                rows.write.partitionBy("run_id").parquet(f"{self.folder}/{name}/{part}", compression="zstd")
        if n["added"] + n["replaced"] + n["removed"] or not commits:
            version += 1
            fresh = F.when(F.col("digest").eqNullSafe(F.col("old")), F.col("part")).otherwise(part)
            rows = joined.where("digest is not null").select("run_id", "digest", fresh.alias("part"))
            rows.write.parquet(f"{self.folder}/catalogue/{part}")
            commit = self.spark.createDataFrame([(version, part)], COMMIT)
            commit.coalesce(1).write.mode("append").parquet(f"{self.folder}/commits")
        return Update(version, n["added"], n["replaced"], n["removed"], n["kept"])

    def table(self, name: str, version: int | None = None) -> DataFrame:
        """``findings`` or ``diagnostics`` of all runs in the catalogue; parts that no run is in are not opened."""
        catalogue = self.catalogue(version).select("run_id", "part")
        parts = [r["part"] for r in catalogue.select("part").distinct().collect()]  # one for each update that still counts
        if not parts:
            raise ValueError("nothing has been derived yet")
        out = None
        for part in parts:
            # run_id stays a string, whatever it looks like; part is a literal, so each file meets its own runs only
            own = self.spark.read.schema(self._schema(name, part)).parquet(f"{self.folder}/{name}/{part}")
            own = own.join(catalogue.where(F.col("part") == part).select("run_id"), "run_id", "left_semi")
            out = own if out is None else out.unionByName(own, allowMissingColumns=True)
        return out

    def _schema(self, name: str, part: str):
        found = self.spark.read.parquet(f"{self.folder}/{name}/{part}").schema
        return StructType([StructField("run_id", StringType()) if f.name == "run_id" else f for f in found])
