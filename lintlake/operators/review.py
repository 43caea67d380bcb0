"""Derivation of a review from findings: duplicates, grades, total order, counts, overlap, listings.

All tables carry ``run_id``; every window and group starts with it, so runs are independent.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from lintlake.functions import severity as S
from lintlake.operators.ordering import BROADCAST_ROWS, keep

#: The row order of a report, which decides between duplicates and ends every tie.
INGEST = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
FINDING_KEY = ("tool", "evidence_context", "file", "line", "col", "rule_id", "message")
DIAGNOSTIC_KEY = ("tool", "unit_id", "evidence_context", "file", "line", "col", "category", "message")
OVERLAP_LINES = 3


def first_of_each(rows: DataFrame, key: tuple[str, ...], order: tuple[str, ...] = INGEST) -> DataFrame:
    """The first row of each key within its run; the key holds the tool, so producers never merge.

    ``order`` is where a row stood; of rows that share even that, one stays. Each task keeps one row of a key
    before rows are shuffled, so a key of any frequency is a few rows. Rows are sorted by a hash first, which
    is one number, and by the key itself only where hashes meet.
    """
    place = F.row_number().over(W.partitionBy("key_hash", "run_id", *key).orderBy(*order))
    hashed = rows.withColumn("key_hash", F.xxhash64("run_id", *key))
    return hashed.withColumn("key_place", place).where("key_place = 1").drop("key_hash", "key_place")


def key_digest(*columns: str) -> Column:
    """16 bytes of the SHA-256 of these columns, which stand for them where only whether they are equal counts."""
    text = [F.col(c).cast("string") for c in columns]
    parts = [F.concat(F.coalesce(F.length(c).cast("string"), F.lit("-")), F.lit(":"), F.coalesce(c, F.lit(""))) for c in text]
    return F.substring(F.unhex(F.sha2(F.concat(*parts), 256)), 1, 16)


def narrow_firsts(rows: DataFrame, key: tuple[str, ...], columns: tuple[str, ...], order: str = "ingest") -> DataFrame:
    """``columns`` of the first row of each key within its run; a digest of the key is shuffled in its place."""
    narrow = rows.select(key_digest("run_id", *key).alias("key_digest"), order, *columns)
    place = F.row_number().over(W.partitionBy("key_digest").orderBy(order))
    return narrow.withColumn("key_place", place).where("key_place = 1").select(*columns)


def placed(findings: DataFrame, paths: bool = True) -> DataFrame:
    """Severity of every finding, and what it is ordered by before its fingerprint.

    With ``paths`` the file is its own canonical path, else there is a column of these already.
    """
    c = F.col
    out = S.with_severity(findings, c("tool"), c("original_severity"), c("severity_scale"), c("engine"))
    out = out.withColumns({"rank": S.severity_rank(c("severity")), "canonical_path": c("file") if paths else c("canonical_path")})
    return located(out)


def located(findings: DataFrame) -> DataFrame:
    """Findings with their producer's rank and their line as a number."""
    return findings.withColumns({"producer_rank": S.producer_rank(F.col("tool")), "line_no": S.line_number(F.col("line"))})


def described(findings: DataFrame) -> DataFrame:
    """Review level, category and fingerprint of every finding, which cost most."""
    c = F.col
    rows = S.with_category(findings, c("engine"), c("declared"), c("cwe"), c("rule_id"), c("message"))
    return rows.withColumns(
        {
            "review_level": S.review_level(c("original_severity")),
            "gate_eligible": c("engine") == "static",
            "fingerprint": S.fingerprint(c("tool"), c("file"), c("line"), c("col"), c("rule_id"), c("message")),
        }
    )


def graded(findings: DataFrame, paths: bool = True) -> DataFrame:
    """Severity, review level, fingerprint and category of every finding."""
    return described(placed(findings, paths))


def total_order(ingest: tuple[str, ...] = INGEST) -> list[Column]:
    keys = [F.desc("rank"), "producer_rank", "canonical_path", "line_no", "line", "fingerprint"]
    return [F.col(k) if isinstance(k, str) else k for k in (*keys, *ingest)]


def reviewed(findings: DataFrame) -> DataFrame:
    """W01, E*: de-duplicated, graded findings; ``total_order`` is their order."""
    return graded(first_of_each(findings, FINDING_KEY))


#: A finding that is met more often is reduced to one row of each task before rows are dealt by ranges.
FREQUENT = 100_000


def _frequent_reduced(rows: DataFrame, most: int, ingest: tuple[str, ...]) -> DataFrame:
    """``rows``, of which those of keys met more than ``most`` times have been de-duplicated, so that no key fills a range."""
    hashed = rows.withColumn("key_hash", F.xxhash64("run_id", *FINDING_KEY))
    counts = hashed.groupBy("key_hash").agg(F.count(F.lit(1)).alias("n"))
    often = keep(counts.where(F.col("n") > most).select("key_hash"), "frequent")
    n = often.count()
    if not n:
        return rows
    few = F.broadcast(often) if n <= BROADCAST_ROWS else often
    rare = hashed.join(few, "key_hash", "left_anti").select(*rows.columns)
    return rare.unionByName(first_of_each(hashed.join(few, "key_hash", "left_semi").select(*rows.columns), FINDING_KEY, ingest))


def ordered_findings(
    findings: DataFrame, columns: tuple[str, ...], frequent: int = FREQUENT, grade: Callable[[DataFrame], DataFrame] = graded,
    path: str = "file", ingest: tuple[str, ...] = INGEST,
) -> DataFrame:
    """``columns`` of the findings, each once and graded, with its place ``sort_pos`` in the run's total order.

    Rows are shuffled once, by ranges of what comes after the severity in that order, so that copies of a finding
    meet in a range. There are few severities, so they are counted in every range, and a place follows from the
    counts before it. Ranges are written once, with the columns wanted only. ``path`` names the column that holds
    the canonical path, which follows from the file. The findings are read three times.
    """
    c = F.col
    prints = S.fingerprint(c("tool"), c("file"), c("line"), c("col"), c("rule_id"), c("message"))  # not shuffled
    rows = _frequent_reduced(findings, frequent, ingest)
    dealt = rows.repartitionByRange(c("run_id"), S.producer_rank(c("tool")), c(path), S.line_number(c("line")), c("line"), prints)
    same = W.partitionBy("run_id", "producer_rank", path, "line_no", "fingerprint", *[k for k in FINDING_KEY if k != path])  # what ranges are of, else rows are shuffled again
    place = F.row_number().over(same.orderBy(*ingest))
    firsts = grade(dealt).withColumn("key_place", place).where("key_place = 1").sortWithinPartitions("run_id", *total_order(ingest))
    at = F.monotonically_increasing_id()
    wanted = [n for n in dict.fromkeys(("run_id", "rank", *columns)) if n != "sort_pos"]
    written = keep(firsts.select(*wanted, F.shiftright(at, 33).cast("int").alias("range_no"), at.alias("range_seq")), "ordered", "zstd")
    first = F.struct(F.min("range_seq").alias("least"), F.count(F.lit(1)).alias("n"))
    counts = written.groupBy("run_id", "rank", "range_no").agg(first.alias("f"))
    before = W.partitionBy("run_id").orderBy(F.desc("rank"), "range_no").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select("run_id", "rank", "range_no", "f.least", F.coalesce(F.sum("f.n").over(before), F.lit(0)).alias("before"))
    few = starts.count() <= BROADCAST_ROWS
    out = written.join(F.broadcast(starts) if few else starts, ["run_id", "rank", "range_no"])
    return out.withColumn("sort_pos", (c("before") + c("range_seq") - c("least") + 1).cast("long")).select(*columns)


def order_key(*first: Column, ingest: tuple[str, ...] = INGEST) -> Column:
    """The total order as one value that sorts, after ``first``."""
    rest = [(-F.col("rank")).alias("r")] + [F.col(c) for c in ("producer_rank", "canonical_path", "line_no", "line", "fingerprint", *ingest)]
    return F.struct(*first, *rest)


def severity_counts(review: DataFrame) -> DataFrame:
    """Counts by severity and by level, in total, by context and by engine, in one pass."""
    one = F.count(F.lit(1)).alias("n")
    long = review.select(
        "run_id",
        "evidence_context",
        "engine",
        F.inline(
            F.array(
                F.struct(F.lit("severity").alias("measure"), F.col("severity").alias("value")),
                F.struct(F.lit("review_level").alias("measure"), F.col("review_level").alias("value")),
            )
        ),
    )
    sets = [["run_id", "measure", "value"], ["run_id", "measure", "value", "evidence_context"], ["run_id", "measure", "value", "engine"]]
    columns = [F.col(c) for c in ("run_id", "measure", "value", "evidence_context", "engine")]
    grouped = long.groupingSets([[F.col(c) for c in s] for s in sets], *columns)
    return grouped.agg(one)


def tool_summary(review: DataFrame) -> DataFrame:
    """Findings of each producer by context."""
    return review.groupBy("run_id", "tool").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("evidence_context") == "build-aware").alias("build_aware"),
        F.count_if(F.col("evidence_context") == "source-only").alias("source_only"),
    )


def top_values(review: DataFrame, column: str, n: int = 20, keep_empty: bool = True) -> DataFrame:
    """The most frequent values of each run; of equal counts the one seen first in the total order."""
    value = F.when(F.coalesce(F.col(column), F.lit("")) == "", "<unknown>").otherwise(F.col(column))
    rows = review if keep_empty else review.where(F.coalesce(F.col(column), F.lit("")) != "")
    counts = rows.groupBy("run_id", value.alias("value")).agg(
        F.count(F.lit(1)).alias("n"), F.min(order_key()).alias("first_pos")
    )
    place = F.row_number().over(W.partitionBy("run_id").orderBy(F.desc("n"), "first_pos"))
    return counts.withColumn("place", place).where(F.col("place") <= n)


def heat_map(review: DataFrame, n: int = 12) -> DataFrame:
    """Files by severity, the ``n`` files with most findings of each run."""
    names = list(S.SEVERITY_RANK)
    table = review.groupBy("run_id", "canonical_path").agg(
        *(F.count_if(F.col("severity") == s).alias(s) for s in names), F.count(F.lit(1)).alias("total")
    )
    place = F.row_number().over(W.partitionBy("run_id").orderBy(F.desc("total"), "canonical_path"))
    return table.withColumn("place", place).where(F.col("place") <= n)


def gate(review: DataFrame, policy: str) -> DataFrame:
    """Whether a run's own findings reach the policy; scanners' findings never count."""
    least = S.SEVERITY_RANK[policy]
    return review.groupBy("run_id").agg(
        F.bool_or((F.col("rank") >= least) & F.col("gate_eligible")).alias("tripped")
    )


def faceted(
    review: DataFrame,
    context: str | None = None,
    engine: str | None = None,
    level: str | None = None,
    severity: str | None = None,
    tool: str | None = None,
    cwe: str | None = None,
    text: str | None = None,
) -> DataFrame:
    """Findings that match every facet given; ``text`` is sought in four columns, each by itself."""
    facets = {
        "evidence_context": context, "engine": engine, "review_level": level,
        "severity": severity, "tool": tool, "cwe": cwe,
    }
    for column, wanted in facets.items():
        if wanted is not None:
            review = review.where(F.col(column) == wanted)
    if text:
        found = F.lit(False)
        for column in ("rule_id", "cwe", "canonical_path", "message"):
            found = found | F.contains(F.lower(F.coalesce(F.col(column), F.lit(""))), F.lit(text.lower()))
        review = review.where(found)
    return review


#: What the dashboard sorts by before the total order.
DASHBOARD = {"priority": (), "location": ("canonical_path", "line_no"), "tool": ("tool",), "rule": ("rule_id",)}
#: The longest listing, in rows of a run, that is cut in one pass.
SHORT_LISTING = 10_000


def dashboard_order(mode: str) -> list[Column]:
    """Priority, location, tool or rule first; the total order ends ties."""
    return [*map(F.col, DASHBOARD[mode]), *total_order()]


def _up_to(rows: DataFrame, mode: str, most: int) -> DataFrame:
    """Rows that may be among the first ``most`` of their run: those of the groups of equal first keys that begin before that.

    Groups are counted, which leaves a few numbers to sort, and rows are compared with the last group of their run.
    """
    names = dict.fromkeys((*DASHBOARD[mode], "rank", "producer_rank", "canonical_path"))
    key = F.struct(*[(-F.col(c) if c == "rank" else F.col(c)).alias(c) for c in names])
    groups = rows.groupBy("run_id", *names).agg(F.count(F.lit(1)).alias("n")).select("run_id", key.alias("last_key"), "n")
    before = F.sum("n").over(W.partitionBy("run_id").orderBy("last_key").rowsBetween(W.unboundedPreceding, -1))
    begun = groups.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < most)
    last = keep(begun.groupBy("run_id").agg(F.max("last_key").alias("last_key")), "page-ends")
    few = last.count() <= BROADCAST_ROWS
    return rows.join(F.broadcast(last) if few else last, "run_id").where(key <= F.col("last_key")).drop("last_key")


def page(findings: DataFrame, mode: str, number: int, size: int) -> DataFrame:
    """One page of each run of ``findings`` (each once, not graded yet), the number clamped to the run's pages.

    Rows are cut before they are described: every task keeps those of a run that the keys before the fingerprint
    put among the first ``number * size``, and ties; a longer listing is cut by counts of these keys first.
    A run has as many pages as the first rows fill, or more than are asked for.
    """
    number = max(1, number)
    most = number * size
    run = W.partitionBy("run_id")
    rows = placed(findings)
    if most > SHORT_LISTING:
        rows = _up_to(keep(rows, "page"), mode, most)
    else:
        near = F.rank().over(run.orderBy(*dashboard_order(mode)[: -len(INGEST) - 1]))
        rows = rows.withColumn("near", near).where(F.col("near") <= most).drop("near")
    place = F.row_number().over(run.orderBy(*dashboard_order(mode)))
    rows = described(rows).withColumn("place", place).where(F.col("place") <= most)
    at = F.least(F.lit(number), F.ceil(F.max("place").over(run) / size))
    rows = rows.withColumn("at", at)
    return rows.where((F.col("place") > (F.col("at") - 1) * size) & (F.col("place") <= F.col("at") * size)).drop("at")


def fair_cap(review: DataFrame, cap: int) -> DataFrame:
    """The first ``cap`` findings of a run, an equal share for each engine, spare shares handed on."""
    totals = review.groupBy("run_id", "engine").agg(F.count(F.lit(1)).alias("total"))
    run = W.partitionBy("run_id")
    order = run.orderBy(F.when(F.col("engine") == "static", 0).when(F.col("engine") == "llm", 1).otherwise(2), "engine")
    shares = totals.withColumn("quota", F.least("total", F.floor(F.lit(cap) / F.count(F.lit(1)).over(run))))
    shares = shares.withColumns(
        {
            "want": F.col("total") - F.col("quota"),
            "spare": F.lit(cap) - F.sum("quota").over(run),
        }
    )
    before = F.coalesce(F.sum("want").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    granted = F.greatest(F.lit(0), F.least(F.col("want"), F.col("spare") - before))
    shares = shares.select("run_id", "engine", (F.col("quota") + granted).alias("quota"))
    place = F.row_number().over(W.partitionBy("run_id", "engine").orderBy(*total_order()))
    first = review.withColumn("place", place).where(F.col("place") <= cap)
    return first.join(shares, ["run_id", "engine"]).where(F.col("place") <= F.col("quota"))


_CLUSTER = ("run_id", "canonical_path", "category")


def _anchored(batches):
    """Rows sorted by cluster key and line -> line_start: a cluster ends OVERLAP_LINES after its first line."""
    key, first = None, None
    for batch in batches:
        columns = [batch[c].to_pylist() for c in (*_CLUSTER, "line_no")]
        starts = []
        for *own, line in zip(*columns, strict=True):
            reach = 0 if own[2] == "unknown" else OVERLAP_LINES
            if own != key or line - first > reach:
                key, first = own, line
            starts.append(first)
        yield batch.append_column("line_start", pa.array(starts, pa.int32()))


def overlap_groups(
    review: DataFrame, key: str = "tool", least: int = 2, native_only: bool = True, ingest: tuple[str, ...] = INGEST
) -> DataFrame:
    """W02 (and Z01): findings of several producers on one file and category within a few lines.

    Clusters are anchored at their first line. The narrow rows are shuffled and sorted by file and
    category once and streamed in order with a state of one line; an origin tells which engines met.
    """
    rows = review.where((F.col("canonical_path") != "") & (F.col("line_no") < S.NO_LINE))
    if native_only:
        rows = rows.where(F.col("tool").isin(*S.NATIVE_TOOLS))
    at = order_key(F.col("line_no").alias("at_line"), F.col("producer_rank").alias("at_rank"), ingest=ingest)
    rows = rows.select(*_CLUSTER, "line_no", F.col(key).alias("producer"), "producer_rank", "engine", "fingerprint", at.alias("at"))
    dealt = rows.repartition(*_CLUSTER).sortWithinPartitions(*_CLUSTER, "line_no")
    anchored = dealt.mapInArrow(_anchored, StructType([*rows.schema.fields, StructField("line_start", IntegerType())]))
    tools = F.sort_array(F.collect_set(F.struct("producer_rank", "producer")))  # array_sort compares by a lambda
    origin = (
        F.when(~F.bool_or(F.col("engine") == "llm"), "static-only")
        .when(F.bool_and(F.col("engine") == "llm"), "llm-only")
        .otherwise("both")
    )
    out = anchored.groupBy(*_CLUSTER, "line_start").agg(
        F.max("line_no").alias("line_end"), tools.alias("t"), F.sort_array(F.collect_list(F.struct("at", "fingerprint"))).alias("f"),
        origin.alias("origin"),
    )
    out = out.where(F.size("t") >= least)
    span = F.concat_ws("\0", "canonical_path", "category", F.col("line_start").cast("string"), F.col("line_end").cast("string"))
    return out.select(
        "run_id",
        F.substring(F.sha2(span, 256), 1, 16).alias("id"),
        "canonical_path",
        "category",
        "line_start",
        "line_end",
        F.array_join(F.col("t.producer"), ",").alias("tools"),
        F.array_join(F.col("f.fingerprint"), ",").alias("fingerprints"),
        "origin",
    )


def overlap_spans(review: DataFrame, least: int = 2) -> DataFrame:
    """Place and tools of the groups of ``overlap_groups``, which need one row for each line and tool of a cluster only."""
    rows = review.where((F.col("canonical_path") != "") & (F.col("line_no") < S.NO_LINE) & F.col("tool").isin(*S.NATIVE_TOOLS))
    rows = rows.select(*_CLUSTER, "line_no", "producer_rank", F.col("tool").alias("producer"))
    one = rows.groupBy(*_CLUSTER, "line_no", "producer_rank", "producer").agg(F.count(F.lit(1)).alias("n")).drop("n")
    dealt = one.repartition(*_CLUSTER).sortWithinPartitions(*_CLUSTER, "line_no")
    anchored = dealt.mapInArrow(_anchored, StructType([*one.schema.fields, StructField("line_start", IntegerType())]))
    tools = F.sort_array(F.collect_set(F.struct("producer_rank", "producer")))
    out = anchored.groupBy(*_CLUSTER, "line_start").agg(F.max("line_no").alias("line_end"), tools.alias("t")).where(F.size("t") >= least)
    return out.select(*_CLUSTER, "line_start", "line_end", F.array_join(F.col("t.producer"), ",").alias("tools"))


def markdown(review: DataFrame, n: int = 200) -> DataFrame:
    """A run's findings section, its first ``n`` findings in order, as one text."""
    path = F.when(F.col("canonical_path") == "", "<unknown>").otherwise(F.col("canonical_path"))
    line = F.format_string(
        "- review level `%s`; normalized severity `%s`; `%s` `%s` `%s` %s:%s — %s",
        "review_level", "severity", "tool", "evidence_context", "rule_id", path, "line", "message",
    )
    place = F.row_number().over(W.partitionBy("run_id").orderBy(*total_order()))
    rows = review.withColumn("place", place).where(F.col("place") <= n).withColumn("entry", line)
    return rows.groupBy("run_id").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("place", "entry"))), lambda e: e["entry"]), "\n"
        ).alias("findings")
    )
