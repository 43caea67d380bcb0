"""Accounting of scan units, tools and runs: statuses, coverage, gaps, budgets and caches."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StringType, StructField, StructType

from lintlake.operators.ordering import keep, positions, running_sum

# Unit statuses, tiers in order, finish reasons and exit codes.
STARTED = ("completed", "partial", "timed_out", "failed", "interrupted")
TIERS = ("critical", "high", "medium", "low")
FINISH_STATUS = {
    "completed": "completed", "complete": "completed", "stop": "completed", "end_turn": "completed",
    "max-tokens": "partial", "max_tokens": "partial", "length": "partial",
    "aborted": "interrupted", "cancelled": "interrupted", "canceled": "interrupted",
    "timeout": "timed_out", "timed_out": "timed_out", "error": "failed", "refusal": "failed",
}
EXIT_CODES = {"complete": 0, "partial": 10, "failed": 20, "interrupted": 130}
LOW_CONFIDENCE = 0.5


def _one() -> Column:
    return F.count(F.lit(1))


def ratio(part: Column, whole: Column) -> Column:
    """Part / whole to four places, 0 over nothing."""
    return F.coalesce(F.bround(F.try_divide(part, whole), 4), F.lit(0.0))


def unit_counts(units: DataFrame, *keys: str) -> DataFrame:
    """Planned, started, completed, failed, timed_out, unscheduled."""
    n = lambda *names: F.count_if(F.col("status").isin(*names))
    return units.groupBy(*keys).agg(
        _one().alias("planned"),
        n(*STARTED).alias("started"),
        n("completed").alias("completed"),
        n("failed", "partial").alias("failed"),
        n("timed_out").alias("timed_out"),
        n("unscheduled").alias("unscheduled"),
    )


def unit_status(units: DataFrame, *keys: str) -> DataFrame:
    """One status for a set of units."""
    s = F.col("status")
    status = (
        F.when(F.bool_or(s == "interrupted"), "interrupted")
        .when(F.bool_and(s == "completed"), "completed")
        .when(F.bool_or(F.coalesce("valid_report", F.lit(False))), "partial")
        .when(F.bool_and(s.isin("timed_out", "unscheduled")), "timed_out")
        .otherwise("failed")
    )
    return units.groupBy(*keys).agg(
        status.alias("status"), F.count_if(F.coalesce("valid_report", F.lit(False))).alias("valid_reports")
    )


def run_status(tools: DataFrame) -> DataFrame:
    """A run's status and exit code from its requested tools and the steps around them.

    ``tools`` has run_id, requested, status, valid_reports, stable, export_status, review_status.
    """
    s = F.col("status")
    done = F.col("stable") & F.col("export_status").isin("completed", "disabled") & F.col("review_status").isin(
        "completed", "disabled"
    )
    asked = tools.withColumn("done", F.coalesce(done, F.lit(False)))
    of = lambda cond: F.when(F.col("requested"), cond)
    some = lambda cond: F.coalesce(F.bool_or(of(cond)), F.lit(False))
    every = F.coalesce(F.bool_and(of(s.isin("completed", "not_applicable"))), F.lit(True))
    status = (
        F.when(some(s == "interrupted"), "interrupted")
        .when(some(s != "not_applicable") & every & F.bool_and("done"), "complete")
        .when(some(F.col("valid_reports") > 0), "partial")
        .otherwise("failed")
    )
    out = asked.groupBy("run_id").agg(status.alias("status"))
    codes = F.create_map(*[F.lit(x) for pair in EXIT_CODES.items() for x in pair])
    return out.withColumn("exit_code", codes[F.col("status")])


def known_results(results: DataFrame, units: DataFrame) -> DataFrame:
    """Results of known units with what the unit says of itself."""
    about = units.select("run_id", "unit_id", "path", "kind", "tier", "byte_length")
    return results.join(about, ["run_id", "unit_id"])


def unit_outcomes(units: DataFrame, results: DataFrame) -> DataFrame:
    """Every unit with whether any producer completed it, and the statuses it got."""
    got = results.groupBy("run_id", "unit_id").agg(
        F.bool_or(F.col("status") == "completed").alias("scanned"), F.collect_set("status").alias("statuses")
    )
    return (
        units.drop("status", "producer")
        .join(got, ["run_id", "unit_id"], "left")
        .withColumn("scanned", F.coalesce("scanned", F.lit(False)))
    )


def coverage_report(units: DataFrame, results: DataFrame) -> DataFrame:
    """Files, functions and bytes scanned; a file counts once all of its units are done."""
    outcome = unit_outcomes(units, results)
    files = outcome.groupBy("run_id", "path").agg(
        F.bool_and("scanned").alias("scanned"),
        F.count_if((F.col("kind") == "function") & F.col("scanned")).alias("functions"),
        F.count_if(F.col("kind") == "function").alias("all_functions"),
        F.sum(F.when(F.col("scanned"), F.col("byte_length")).otherwise(0)).alias("bytes"),
        F.sum("byte_length").alias("all_bytes"),
    )
    sums = files.groupBy("run_id").agg(
        F.count_if("scanned").alias("files"),
        _one().alias("all_files"),
        *(F.sum(c).alias(c) for c in ("functions", "all_functions", "bytes", "all_bytes")),
    )
    return sums.withColumns({f"{c}_ratio": ratio(F.col(c), F.col(f"all_{c}")) for c in ("files", "functions", "bytes")})


def coverage_by_scanner(units: DataFrame, results: DataFrame, scanners: DataFrame) -> DataFrame:
    """Units, functions, bytes and files each scanner completed; scanners without any keep a zero row."""
    done = known_results(results.where("status = 'completed'"), units)
    got = done.groupBy("run_id", "producer").agg(
        _one().alias("units"),
        F.count_if(F.col("kind") == "function").alias("functions"),
        F.sum("byte_length").alias("bytes"),
        F.count_distinct("path").alias("files"),
    )
    grid = units.select("run_id").distinct().crossJoin(F.broadcast(scanners))
    return grid.join(got, ["run_id", "producer"], "left").fillna(0, ["units", "functions", "bytes", "files"])


def tier_counts(units: DataFrame, results: DataFrame) -> DataFrame:
    """Planned and scanned units of each tier."""
    return unit_outcomes(units, results).groupBy("run_id", "tier").agg(
        _one().alias("planned"), F.count_if("scanned").alias("scanned")
    )


def unscanned_reasons(units: DataFrame, results: DataFrame) -> DataFrame:
    """Why units are not done, the gravest status first; low confidence is counted beside that."""
    got = F.col("statuses")
    reason = F.when(F.size(F.coalesce(got, F.array())) == 0, "no_result")
    for name in ("interrupted", "failed", "timed_out", "unscheduled"):
        reason = reason.when(F.array_contains(got, name), name)
    outcome = unit_outcomes(units, results)
    counted = F.array_compact(
        F.array(
            F.when(~F.col("scanned"), reason.otherwise("failed")),
            F.when(F.col("parse_confidence") < LOW_CONFIDENCE, "parse_confidence_low"),
        )
    )
    return outcome.select("run_id", F.explode(counted).alias("reason")).groupBy("run_id", "reason").agg(_one().alias("n"))


def tool_coverage(units: DataFrame, *keys: str) -> DataFrame:
    """Distinct files attempted and analysed, and the ratio; files without a path count for neither."""
    attempted = F.col("status").isin("completed", "partial", "failed", "timed_out")
    out = units.groupBy(*keys).agg(
        F.count_distinct(F.when(attempted, F.col("path"))).alias("attempted"),
        F.count_distinct(F.when(F.col("valid_report"), F.col("path"))).alias("analyzed"),
        F.count_distinct(F.when(~F.col("valid_report") & (F.col("status") == "failed"), F.col("path"))).alias("excluded"),
        F.count_distinct("path").alias("total"),
    )
    out = out.withColumn("effective_total", F.greatest(F.lit(0), F.col("total") - F.col("excluded")))
    return out.withColumn("ratio", F.try_divide("analyzed", "effective_total"))


def coverage_gaps(coverage: DataFrame) -> DataFrame:
    """Tools that excluded files or analysed fewer than they could."""
    missing = F.greatest(F.lit(0), F.col("effective_total") - F.col("analyzed"))
    return coverage.withColumn("unanalyzed", missing).where((F.col("excluded") > 0) | (F.col("unanalyzed") > 0))


def dispatch_order(units: DataFrame, scanners: DataFrame) -> DataFrame:
    """Units times scanners in the order they are sent out; ``scanners`` is a small dimension."""
    tier = F.array_position(F.array(*map(F.lit, TIERS)), F.col("tier"))
    tasks = units.withColumn("tier_rank", tier).crossJoin(F.broadcast(scanners))
    order = [F.col(c) for c in ("tier_rank", "path", "start_byte", "unit_id", "scanner_pos")]
    return positions(tasks, "run_id", order, "place").drop("tier_rank")


def _in_order(rows: DataFrame, group: list[str], order: list[str], step, schema: StructType) -> DataFrame:
    """Fold each group in order, a row at a time: ``step(state, row)`` gives the next state and the row's own value.

    For folds that are sequential by definition. A group is streamed by one task, whatever its size, in
    Arrow batches and with one state; groups run beside each other.
    """

    def run(batches):
        key, state = None, None
        for batch in batches:
            values = []
            for row in batch.to_pylist():
                own = [row[g] for g in group]
                if own != key:
                    key, state = own, None
                state, value = step(state, row)
                values.append(value)
            yield batch.append_column(schema[-1].name, pa.array(values, to_arrow_type(schema[-1].dataType)))

    return rows.repartition(*group).sortWithinPartitions(*group, *order).mapInArrow(run, schema)


def admitted(tasks: DataFrame, group: list[str], order: list[str], budgets: dict[str, int], payload: list[str]) -> DataFrame:
    """In order, what all budgets of its group let in; later and smaller ones may follow a skipped one.

    ``budgets`` has the budget of each cost column, such as prompt and completion tokens; ``refused_by``
    names the first that a row did not fit. Whether a row is admitted depends on every row admitted
    before it, so a group is one ordered stream.
    """
    rows = tasks.select(*dict.fromkeys([*group, *order, *budgets, *payload]))

    def step(spent, row):
        spent = spent or dict.fromkeys(budgets, 0)
        after = {c: spent[c] + row[c] for c in budgets}
        refused = next((c for c, most in budgets.items() if after[c] > most), None)
        return (spent if refused else after), refused

    out = _in_order(rows, group, order, step, StructType([*rows.schema.fields, StructField("refused_by", StringType())]))
    return out.withColumn("admitted", F.col("refused_by").isNull())


def next_starts(rows: DataFrame, most_rows: int, most_cost: int) -> DataFrame:
    """run_id, pos and next: the row that begins the next shard if one begins at ``pos``.

    ``rows`` have run_id, pos (from 1, without gaps), cost (at least 1) and before, the cost of all rows before.
    How many rows from one on fit is a count over a range of ``before``. Rows are dealt by buckets as wide as
    the cap, each also to the bucket before its own, so that a bucket holds all that its rows can reach: at most
    twice the cap in rows, however long the run is.
    """
    ends = rows.groupBy("run_id").agg((F.max("pos") + 1).alias("pos"), F.sum("cost").alias("before"))
    points = rows.select("run_id", "pos", "before", F.lit(True).alias("asks")).unionByName(ends.withColumn("asks", F.lit(False)))
    own = F.floor(F.col("before") / (most_cost + 1))
    dealt = points.select(
        "run_id", "pos", "before",
        F.inline(F.array(F.struct(own.alias("bucket"), "asks"), F.struct((own - 1).alias("bucket"), F.lit(False).alias("asks")))),
    )
    reach = W.partitionBy("run_id", "bucket").orderBy("before").rangeBetween(0, most_cost)
    counted = dealt.withColumn("n", F.count(F.lit(1)).over(reach)).where("asks")
    return counted.select("run_id", "pos", (F.col("pos") + F.greatest(F.lit(1), F.least(F.lit(most_rows), F.col("n") - 1))).alias("next"))


def reached(links: DataFrame) -> DataFrame:
    """The rows (run_id, pos) that are met from row 1 of each run along ``links`` (run_id, pos, next), by pointer doubling.

    After k rounds the first 2**k of them are known, and links lead 2**k rows on; so a run of n shards takes
    log n joins of evenly dealt rows. Each round is written, which cuts its lineage.
    """
    links = keep(links, "links")
    found = keep(links.where("pos = 1").select("run_id", "pos"), "reached")
    known = found.count()
    while True:
        found = keep(found.unionByName(found.join(links, ["run_id", "pos"]).select("run_id", F.col("next").alias("pos"))), "reached")
        n = found.count()
        if n == known:
            return found
        known = n
        onward = links.select("run_id", F.col("pos").alias("next"), F.col("next").alias("after"))
        links = keep(links.join(onward, ["run_id", "next"]).select("run_id", "pos", F.col("after").alias("next")), "links")


def shards(files: DataFrame, most_files: int = 1000, most_bytes: int = 256 * 1024, prefix: int = 200) -> DataFrame:
    """Greedy shards of a run's sorted paths, closed before the file or byte cap would be passed.

    No task holds a run: places and sums come from ranges, each row's next start from its bucket, and the starts
    that count from pointer doubling. A path that is longer than the cap has a shard of its own.
    """
    rows = keep(files.select("run_id", "path", (F.octet_length("path") + 1).cast("long").alias("cost")), "paths")
    placed = positions(rows, "run_id", [F.col("path")], "pos")
    summed = keep(running_sum(keep(placed, "places"), "run_id", [F.col("pos")], "cost", "before"), "sums")
    starts = reached(next_starts(summed, most_files, max(0, most_bytes - prefix))).withColumn("starts", F.lit(1).cast("long"))
    marked = keep(summed.join(starts, ["run_id", "pos"], "left").fillna(0, ["starts"]), "starts")
    numbered = running_sum(marked, "run_id", [F.col("pos")], "starts", "earlier")
    return numbered.select("run_id", "path", (F.col("earlier") + F.col("starts") - 1).cast("int").alias("shard"))


def inventory_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Files added, deleted or changed between two inventories of a run."""
    a = before.select("run_id", "path", F.col("sha256").alias("a"))
    b = after.select("run_id", "path", F.col("sha256").alias("b"))
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "deleted").when(F.col("a") != F.col("b"), "changed")
    return a.join(b, ["run_id", "path"], "full_outer").select("run_id", "path", change.alias("change")).where("change is not null")


#: Blocks that a run's inventory is dealt to for its digest, by the first two bytes of the path's own digest.
DIGEST_VERSION = 2


def inventory_digest(inventory: DataFrame) -> DataFrame:
    """One digest of a run's inventory: of its blocks' digests in order, each of its rows in path order.

    Version 2. Blocks (65,536 a run) are worked out beside each other, so no task holds a run.
    """
    block = F.substring(F.sha2("path", 256), 1, 4)
    line = F.concat_ws("\t", "path", F.col("size").cast("string"), "sha256")
    sorted_lines = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*c))), lambda r: r["line"]), "\n")
    rows = inventory.select("run_id", block.alias("block"), "path", line.alias("line"))
    blocks = rows.groupBy("run_id", "block").agg(F.sha2(sorted_lines(("path", "line")), 256).alias("digest"))
    blocks = blocks.withColumn("line", F.concat_ws(" ", "block", "digest"))
    return blocks.groupBy("run_id").agg(F.sha2(sorted_lines(("block", "line")), 256).alias("digest"))


def latest_run(runs: DataFrame) -> DataFrame:
    """The last finished run of each source; of equal times the greater run_id."""
    return runs.groupBy("source").agg(F.max_by("run_id", F.struct("finished_at", "run_id")).alias("run_id"))


# What a cached answer depends on, in the order in which the key joins it.
CACHE_KEY = (
    "version", "unit_sha256", "prompt_sha256", "skill_version", "skill_sha256", "model", "endpoint", "temperature", "seed",
    "max_completion_tokens", "context_window", "producer",
)


def cache_key(**fields: Column) -> Column:
    """The key of a unit's answer by one producer, of all twelve fields."""
    missing = set(CACHE_KEY) ^ set(fields)
    if missing:
        raise ValueError(f"a cache key has exactly the fields {', '.join(CACHE_KEY)}; not so: {', '.join(sorted(missing))}")
    return F.sha2(F.concat_ws("\0", *[F.coalesce(fields[k].cast("string"), F.lit("")) for k in CACHE_KEY]), 256)


def cache_lookup(keyed: DataFrame, cache: DataFrame) -> DataFrame:
    """Whether the cache holds the answer of each row's ``cache_key``."""
    known = cache.select("cache_key").distinct().withColumn("hit", F.lit(True))
    return keyed.join(known, "cache_key", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def cache_store(looked_up: DataFrame, cache: DataFrame) -> DataFrame:
    """The cache with the answers that missed and ended completed or partial, one of each key."""
    new = looked_up.where(~F.col("hit") & F.col("status").isin("completed", "partial") & ~F.coalesce("provider_stopped", F.lit(False)))
    return cache.select("cache_key").unionByName(new.select("cache_key")).distinct()


def cache_counts(looked_up: DataFrame) -> DataFrame:
    """Hits, misses and what would be stored: missed units that ended completed or partial."""
    miss = ~F.col("hit")
    return looked_up.groupBy("run_id").agg(
        F.count_if("hit").alias("hits"),
        F.count_if(miss).alias("misses"),
        F.count_if(miss & F.col("status").isin("completed", "partial")).alias("stored"),
    )


def process_outcome(interrupted: Column, timed_out: Column, succeeded: Column, valid: Column) -> Column:
    """The status of one tool process."""
    return (
        F.when(interrupted, "interrupted")
        .when(timed_out, F.when(valid, "partial").otherwise("timed_out"))
        .when(succeeded, "completed")
        .when(valid, "partial")
        .otherwise("failed")
    )


def finish_status(reason: Column, valid: Column) -> Column:
    """A unit's status from a model's finish reason; without a valid report nothing is complete."""
    table = F.create_map(*[F.lit(x) for pair in FINISH_STATUS.items() for x in pair])
    state = F.coalesce(F.try_element_at(table, F.lower(F.trim(F.coalesce(reason, F.lit(""))))), F.lit("failed"))
    return F.when(state.isin("completed", "partial") & ~valid, "failed").otherwise(state)


def ordinals(units: DataFrame) -> DataFrame:
    """The number of a unit among those of its path, kind and name."""
    place = F.row_number().over(W.partitionBy("run_id", "path", "kind", "name").orderBy("start_byte", "unit_id"))
    return units.withColumn("ordinal", place - 1)
