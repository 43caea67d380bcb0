"""Exports that are committed as a whole or not at all.

An export is written in two phases. First Spark's tasks write the sanitised artifacts to a folder of the
export's own; then what was *written* is read back and searched for anything that should not leave. Only
if nothing is found is the manifest written, and last a commit of one row that names it. A task that fails,
an executor that is lost or a leak leaves files that no commit names, and readers follow commits only.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake.operators import redaction as X
from lintlake.operators.stored import sanitised

COMMIT = "export string, artifacts long, bytes long"
MANIFEST = "run_id string, path string, kind string, status string, problem string, size long, sha256 string"


class ExportError(ValueError):
    """An export that was not committed, with the rules that still found something and how often."""


class Exports:
    """Committed exports in ``folder``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def publish(self, artifacts: DataFrame, prefixes: dict[str, str], secrets: list[str]) -> str:
        """Sanitise, write, verify and commit ``artifacts`` (run_id, path, text); the name of the export.

        The manifest has every artifact, with the size and digest of what is shipped; those that are withheld
        or refused are named there without any text.
        """
        name = uuid.uuid4().hex
        data = f"{self.folder}/data/{name}"
        sanitised(artifacts, prefixes, secrets).write.parquet(data)
        written = self.spark.read.parquet(data)
        found = X.leaks(written.where("text is not null").select("text"), "text", prefixes, secrets).groupBy("leak").count().collect()
        if found:
            raise ExportError(", ".join(sorted(f"{r['leak']}: {r['count']}" for r in found)))
        size = F.octet_length("text").cast("long")
        manifest = written.select("run_id", "path", "kind", "status", "problem", size.alias("size"), F.sha2("text", 256).alias("sha256"))
        manifest.write.parquet(f"{self.folder}/manifests/{name}")
        total = self.spark.read.schema(MANIFEST).parquet(f"{self.folder}/manifests/{name}").agg(
            F.lit(name).alias("export"), F.count(F.lit(1)).alias("artifacts"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("bytes")
        )
        total.coalesce(1).write.mode("append").parquet(f"{self.folder}/commits")
        return name

    def committed(self) -> DataFrame:
        """export, artifacts, bytes of every export that was completed."""
        try:
            return self.spark.read.schema(COMMIT).parquet(f"{self.folder}/commits")
        except AnalysisException as problem:
            if problem.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], COMMIT)

    def _of(self, name: str, part: str) -> DataFrame:
        if self.committed().where(F.col("export") == name).isEmpty():
            raise ExportError(f"no committed export {name}")
        return self.spark.read.parquet(f"{self.folder}/{part}/{name}")

    def manifest(self, name: str) -> DataFrame:
        return self._of(name, "manifests")

    def read(self, name: str) -> DataFrame:
        """run_id, path, kind, text of what an export ships."""
        return self._of(name, "data").where("status = 'shipped'").select("run_id", "path", "kind", "text")

    def damaged(self, name: str) -> DataFrame:
        """Shipped artifacts that are missing or differ from the manifest: run_id, path."""
        there = self.read(name).select("run_id", "path", F.sha2("text", 256).alias("found"))
        wanted = self.manifest(name).where("status = 'shipped'").select("run_id", "path", "sha256")
        return wanted.join(there, ["run_id", "path"], "left").where("found is null or found <> sha256").select("run_id", "path")
