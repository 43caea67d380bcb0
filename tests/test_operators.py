"""Operators on small tables with known results."""

import datetime
import os
import random

from pyspark.sql import functions as F

from lintlake.functions import severity as S
from lintlake.functions import text as T
from lintlake.operators import accounting as A
from lintlake.operators import ordering as O
from lintlake.operators import redaction as X
from lintlake.operators import review as R
from lintlake.operators import spans as P
from lintlake.operators import stored as D
from lintlake.operators.derivation import Derivations
from lintlake.operators.full_review import Review
from lintlake.operators.ordering import shared_dir
from lintlake.operators.planner import pieces, prompt, segments
from lintlake.plans import report_queries
from lintlake.sources import reports
from lintlake.sources.c_source import masked, parse
from lintlake.sources.responses import repaired
from lintlake.streaming import events as E
from lintlake.streaming import stateful as S2


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_severity_scales(spark):
    cases = [
        ("cppcheck", "Error", None, "static", "high"), ("flawfinder", "5", None, "static", "critical"),
        ("flawfinder", "5", "security-severity", "static", "medium"), ("flawfinder", "nan", None, "static", "unknown"),
        ("flawfinder", "0", None, "static", "info"), ("flawfinder", "note", None, "static", "info"),
        ("splint", "error", None, "static", "unknown"), ("llm-security", " High", None, "llm", "high"), ("x", None, None, "llm", "unknown"),
    ]
    df = spark.createDataFrame(cases, "tool string, v string, scale string, engine string, want string")
    got = df.withColumn("got", S.severity(F.col("tool"), F.col("v"), F.col("scale"), F.col("engine")))
    assert got.where("got <> want").count() == 0


def test_clusters_are_anchored_at_their_first_line(spark):
    import pyarrow as pa

    rows = [("r", "a.c", k, line) for k in ("buffer", "unknown") for line in (1, 2, 5, 6, 20)]
    batches = [pa.RecordBatch.from_pylist([dict(zip(("run_id", "canonical_path", "category", "line_no"), r, strict=True)) for r in part]) for part in (rows[:3], rows[3:])]
    starts = [s for b in R._anchored(iter(batches)) for s in b["line_start"].to_pylist()]
    assert starts == [1, 1, 5, 5, 20, 1, 2, 5, 6, 20]  # the state is carried across batches


def test_pages_read_their_findings_once_and_long_ones_are_cut_alike(spark, sf_dir, monkeypatch):
    from lintlake.plans import review_queries as Q

    for mode, number, size in (("rule", 2, 7), ("location", 10_000, 7), ("priority", 1, 5)):
        pages = Q._page(mode, number, size)
        monkeypatch.setattr(R, "SHORT_LISTING", 10**9)
        short = pages(spark, sf_dir)
        plan = short._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning(key_hash") == 1  # pages were counted over findings made anew
        monkeypatch.setattr(R, "SHORT_LISTING", 0)
        assert sorted(map(tuple, pages(spark, sf_dir).collect())) == sorted(map(tuple, short.collect()))


def test_repeated_rows_keep_one_copy(spark):
    row = ("r", 1, "cppcheck", "source-only", "a.c", "1", "", "R", "m")
    names = "run_id string, place long, tool string, evidence_context string, file string, line string, col string, rule_id string, message string"
    df = spark.createDataFrame([row, row, (*row[:1], 0, *row[2:]), (*row[:-1], None), (*row[:-1], None)], names)
    got = R.first_of_each(df, R.FINDING_KEY, ("place",))
    assert sorted((r["place"], r["message"] or "") for r in got.collect()) == [(0, "m"), (1, "")]
    assert got.columns == df.columns
    assert R.first_of_each(df.where("false"), R.FINDING_KEY, ("place",)).count() == 0


def test_a_report_stored_twice_keeps_its_findings(spark):
    text = '<results><errors><error id="a" msg="m CWE-12" severity="style"/></errors></results>'
    row = ("r", 1, "cppcheck", "xml", "source-only", text, True)
    names = "run_id string, unit_id long, tool string, kind string, evidence_context string, text string, valid_report boolean"
    assert Review(spark.createDataFrame([row, row], names), "/work/src").findings.count() == 1


def test_budget_skips_what_does_not_fit_and_goes_on(spark):
    df = spark.createDataFrame([("r", i, c) for i, c in enumerate([5, 9, 4, 2, 1])], "run_id string, i int, cost long")
    got = A.admitted(df, ["run_id"], ["i"], {"cost": 10}, [])
    assert [r["admitted"] for r in got.orderBy("i").collect()] == [True, False, True, False, True]
    both = A.admitted(df.withColumn("n", F.lit(1)), ["run_id"], ["i"], {"cost": 10, "n": 2}, [])
    assert [r["refused_by"] for r in both.orderBy("i").collect()] == [None, "cost", None, "cost", "n"]


def test_shards_are_those_of_a_plain_walk(spark):
    rng = random.Random(8)
    rows = [(f"r{r}", f"{i:04d}" + "x" * rng.choice([0, 1, 30, 90])) for r, n in enumerate((1, 7, 300)) for i in range(n)]
    want = {}
    for r in sorted(rows):
        n, size, shard = want.get(r[0], (0, 20, 0))
        if n and (n >= 9 or size + len(r[1]) + 1 > 120):
            n, size, shard = 0, 20, shard + 1
        want[r[0]], want[r] = (n + 1, size + len(r[1]) + 1, shard), shard
    got = A.shards(spark.createDataFrame(rows, "run_id string, path string"), 9, 120, 20)
    assert {(r["run_id"], r["path"]): r["shard"] for r in got.collect()} == {k: v for k, v in want.items() if isinstance(k, tuple)}
    assert A.shards(spark.createDataFrame([], "run_id string, path string")).count() == 0


def test_chunks_cut_after_line_feeds(spark):
    rng = random.Random(1)
    for _ in range(30):
        text = "".join(rng.choice("ab\n") if rng.random() < 0.3 else "x" for _ in range(rng.randrange(1, 120)))
        most, at, want = 16, 0, [0]
        while len(text) - at > most:
            cut = text.rfind("\n", at, at + most)
            at = cut + 1 if cut > at else at + most
            want.append(at)
        want.append(len(text))
        assert one(spark, P.chunks(F.lit(text), most)) == want


def test_malformed_reports_cost_only_themselves(spark):
    good = '<results><errors><error id="a" msg="m CWE-12" severity="style"/></errors></results>'
    rows = [("r", i, "cppcheck", "source-only", t, True) for i, t in enumerate([good, good[:-5], "<x></x>", "", None])]
    df = spark.createDataFrame(rows, "run_id string, unit_id long, tool string, evidence_context string, text string, valid_report boolean")
    found = reports.cppcheck(df).collect()
    assert [(r["unit_id"], r["file"], r["cwe"]) for r in found] == [(0, "", "CWE-12")]
    problems = reports.integrity(df, reports.xml_problem(F.col("text"))).collect()
    assert sorted(r["unit_id"] for r in problems) == [1, 2, 3, 4]


def test_splint_csv(spark):
    text = 'File,Line,Column,Warning\na.c,3,1,"says ""x"", twice"\n\nb.c,4,,cannot parse\n'
    rows = [("r", 1, "splint", "source-only", text, True), ("r", 2, "splint", "source-only", "a,b\n1", True)]
    df = spark.createDataFrame(rows, "run_id string, unit_id long, tool string, evidence_context string, text string, valid_report boolean")
    got = sorted((r["file"], r["line"], r["message"], r["is_diagnostic"]) for r in reports.splint_csv(df).collect())
    assert got == [("a.c", "3", 'says "x", twice', False), ("b.c", "4", "cannot parse", True)]
    bad = reports.integrity(df, reports.csv_problem(F.col("text"))).collect()
    assert [(r["unit_id"], r["message"]) for r in bad] == [(2, "invalid Splint CSV: inconsistent or truncated rows")]


def test_paths(spark):
    path = lambda raw: one(spark, T.canonical_path(F.lit(raw), "/work/src"))
    assert path("file:///work/src/a%20b/../c.c") == "c.c"
    assert path("./x/./y.c") == "x/y.c"
    assert path("/etc/a+b.h") == "/etc/a+b.h"
    assert path("../up.c") == "/work/up.c"
    assert path("") == ""


def test_values_are_worked_out_once(spark):
    rows = spark.createDataFrame([("a",) * 5], "engine string, declared string, cwe string, rule string, message string")
    plan = lambda c: rows.select(c.alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan(S.category(*map(F.col, rows.columns))).count("regexp_extract(") == 1
    assert plan(T.canonical_path(F.col("message"), "/work/src")).lower().count("urlcodec") == 1


def test_plain_and_folded_paths_agree(spark):
    cases = [
        ("a/b.c", "a/b.c"), ("a//b.c", "a/b.c"), ("./a.c", "a.c"), ("a/./b.c", "a/b.c"), ("a/../b.c", "b.c"), ("../x.c", "/work/x.c"),
        ("/work/src/a.c", "a.c"), ("/etc/a.c", "/etc/a.c"), ("file:///work/src/a%20b.c", "a b.c"), ("a/", "a"), ("a+b.c", "a+b.c"),
        ("a/..", "/work/src"), ("a%zz", "a%zz"), ("", ""), (None, ""), (".hid/..x/c.", ".hid/..x/c."), ("file:x", "file:x"),
    ]
    df = spark.createDataFrame(cases, "raw string, want string").withColumn("got", T.canonical_path(F.col("raw"), "/work/src"))
    assert df.where("not got <=> want").collect() == []


def test_packed_documents_are_the_stored_ones_in_few_files(spark, tmp_path):
    rows = [(f"r{i}", "manifest.json" if i % 3 else "review.json", f"text {i}\n\u00e9 ") for i in range(60)]
    for run, name, text in rows:
        (tmp_path / "loose" / run).mkdir(parents=True)
        (tmp_path / "loose" / run / name).write_text(text, encoding="utf-8")
    D.pack_documents(spark.createDataFrame(rows, "run_id string, name string, text string").coalesce(2), f"file://{tmp_path}/packed")
    assert len(list((tmp_path / "packed").glob("part-*"))) == 2
    read = lambda documents: sorted(map(tuple, documents.select("run_id", "text").collect()))
    packed = read(D.packed_documents(spark, f"file://{tmp_path}/packed", "manifest.json"))
    assert packed == read(D.stored_documents(spark, f"file://{tmp_path}/loose", "manifest.json"))
    assert packed == sorted((r, t) for r, n, t in rows if n == "manifest.json")


def test_live_state_streams_to_the_batch_result(spark, tmp_path):
    path = str(tmp_path / "events")
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").write.parquet(path)
    raw = spark.read.parquet(path)
    shape = lambda df: df.selectExpr(
        "event_id", "ts", "concat('run-', user_id % 8) as run_id", "user_id as unit", "event_type as status", "value as progress"
    )
    batch = E.live_state(shape(raw))
    stream = E.live_state(shape(E.event_stream(spark, path, raw.schema)))
    live = E.run_to_end(stream, str(tmp_path / "c"), "live_state")
    assert sorted(map(tuple, live.collect()), key=repr) == sorted(map(tuple, batch.collect()), key=repr)


def test_positions_and_running_values_spread_over_ranges(spark):
    rng = random.Random(5)
    rows = [(f"r{rng.randrange(3)}", rng.randrange(500), i, rng.choice([None, float(rng.randrange(90))])) for i in range(2000)]
    df = spark.createDataFrame(rows, "run_id string, k int, i int, v double").repartition(7)
    order = [F.col("k"), F.col("i")]
    placed = {r["i"]: r["place"] for r in O.positions(df, "run_id", order, "place").collect()}
    tops = {r["i"]: r["top"] for r in O.running_max(df, "run_id", order, "v", "top").collect()}
    sums = {r["i"]: r["before"] for r in O.running_sum(df, "run_id", order, "v", "before").collect()}
    for run in ("r0", "r1", "r2"):
        top, total = None, 0.0
        for n, (_, _, i, v) in enumerate(sorted((r for r in rows if r[0] == run), key=lambda r: r[1:3]), 1):
            assert abs(sums[i] - total) < 1e-6
            top = v if top is None else top if v is None else max(top, v)
            total += v or 0.0
            assert (placed[i], tops[i]) == (n, top)


def sarif(rules, runs=""):
    return '{"version":"2.1.0","runs":[{"tool":{"driver":{"rules":[' + rules + ']}},"results":[{"ruleId":"R","message":{"text":"m"}}]}' + runs + "]}"


REPORT = "run_id string, unit_id long, tool string, evidence_context string, text string, valid_report boolean"


def test_sarif_rules_that_repeat_or_have_no_id_cost_nothing(spark):
    twice = sarif('{"id":"R","properties":{"level":"note"}},{"id":"R","properties":{"level":"error"}},{"name":"x"},{"id":null}')
    texts = [twice, sarif("", ',{"results":7}'), sarif("", ',{"results":[{"locations":[7]}]}'), sarif("", ',{"tool":7}'), sarif("", ',{"invocations":[7]}')]
    df = spark.createDataFrame([("r", i, "flawfinder", "source-only", t, True) for i, t in enumerate(texts)], REPORT)
    assert [(r["unit_id"], r["original_severity"]) for r in reports.flawfinder(df).collect()] == [(0, "error")]
    said = {r["unit_id"]: r["message"].split(": ")[1] for r in reports.integrity(df, reports.sarif_problem(F.col("text"))).collect()}
    assert said == {
        1: "results must be an array", 2: "locations must be an array of objects", 3: "tool must be an object",
        4: "invocations must be an array of objects",
    }


def test_splint_csv_with_repeated_header_and_wide_rows(spark):
    wide = ",".join(["File", "Line"] + ["x"] * 150) + "\n" + ",".join(["a.c", "3"] + [f"w{i}" for i in range(150)])
    texts = ["File,File,Line,Message\nold.c,new.c,7,m\n", wide, 'a,b\n"open']
    df = spark.createDataFrame([("r", i, "splint", "source-only", t, True) for i, t in enumerate(texts)], REPORT)
    got = {r["unit_id"]: (r["file"], r["line"], r["message"]) for r in reports.splint_csv(df).collect()}
    assert got == {0: ("new.c", "7", "m"), 1: ("a.c", "3", ",".join(f"w{i}" for i in range(150)))}


def test_ignored_directories_are_pruned(spark):
    ignored = lambda path, *rules: one(spark, T.ignored(F.lit(path), list(rules)))
    assert ignored("buildx/a.c", "build*/")
    assert ignored("src/gen/a.c", "gen/", "!src/gen/a.c")  # what is below an ignored directory does not come back
    assert not ignored("src/a.c", "*.c", "!src/a.c")
    assert ignored("x/[a].c", "[[]a].c") and ignored("q1/f.c", "q[0-9]") and not ignored("qx/f.c", "q[0-9]")
    assert one(spark, T.left_out(F.lit("a/b/c.c"), ["a/b"])) and not one(spark, T.left_out(F.lit("ab/c.c"), ["a"]))


def test_json_is_redacted_by_all_rules(spark):
    text = '{"/home/ann":["/home/bob/x","C:\\\\Users\\\\eve\\\\q","D:\\\\src\\\\y",7,null],"k":"s3cr3t-value"}'
    got = one(spark, X.json_text(F.lit(text), {"/mnt/d/src": "<SRC>"}, ["s3cr3t-value"]))
    assert got == '{"<HOME>":["<HOME>/x","<HOME>\\\\q","<SRC>\\\\y",7,null],"k":"<SECRET>"}'


def test_first_bad_byte(spark):
    rows = [(b"fine \xc3\xa9", None), (b"ab\xff", 2), (b"", None), (None, None), ("é".encode() + b"\xe2\x82", 2)]
    df = spark.createDataFrame(rows, "content binary, want long")
    assert all(r["got"] == r["want"] for r in df.withColumn("got", T.first_bad_byte(F.col("content"))).collect())


SOURCE = """/* a { " */
#include <x.h>
#include "y.h"
#define LIM 3
#define MIN(a,b) \\
  ((a)<(b))
typedef struct it { int x; } it_t;
extern int proto(int a);
static int g = 3, h[2];
#ifdef A
static int f(int a, char *b)
{ if (a) { log("} // x"); return proto(a); } return 1'000; }
#elif 0
int gone(void) { return 1; }
#else
int fb(void) noexcept { return MIN(1, LIM); }
#endif
int old(a, b)
int a; char *b;
{ return a; }
Foo::Foo(int a) : x(a), y(b) { go(); }
const char *s = R"x(abc " ; })x";
"""


def test_index_of_one_file():
    got = parse(SOURCE)
    assert [(f["name"], f["line_start"], f["conditional"], f["kr_style"], f["calls"]) for f in got["functions"]] == [
        ("f", 11, "#ifdef A", False, ["log", "proto"]), ("fb", 16, "#else", False, ["MIN"]), ("old", 18, "", True, []), ("Foo::Foo", 21, "", False, ["go"]),
    ]
    for f in got["functions"]:
        assert SOURCE[f["body_start"]] == "{" and SOURCE[f["end_byte"] - 1] == "}"
    assert [(t["name"], t["kind"]) for t in got["types"] + got["globals"]] == [("it_t", "typedef"), ("proto", "prototype"), ("g", "global"), ("s", "global")]
    assert [(m["name"], m["function_like"]) for m in got["macros"]] == [("LIM", False), ("MIN", True)]
    assert [(i["target"], i["system"]) for i in got["includes"]] == [("x.h", True), ("y.h", False)]
    assert [(a["kind"], a["depth"], a["dead"]) for a in got["conditionals"]] == [("ifdef", 0, False), ("elif", 0, True), ("else", 0, False)]
    assert got["parse_problems"] == [] and got["parse_confidence"] == round(1 - 0.3 / 4, 4)


def test_masking_keeps_every_offset():
    rng = random.Random(2)
    for _ in range(300):
        text = "".join(rng.choice(['"', "'", "/*", "*/", "//", "\\", "\n", "a", "1", "R\"(", ")\"", "{", "}", ";", "#if 0\n", "#endif\n"]) for _ in range(40))
        plain, _ = masked(text)
        assert len(plain) == len(text)
        assert [i for i, c in enumerate(plain) if c == "\n"] == [i for i, c in enumerate(text) if c == "\n"]
        parts = segments(text, (got := parse(text))["functions"], got["unparsed_from"])
        spans = [span for kind, a, b, _ in parts for span in pieces(text, a, b, kind, 16)]
        assert [a for a, _ in spans] == [0, *(b for _, b in spans)][:-1] and (not text or spans[-1][1] == len(text))


def test_broken_answers_are_repaired():
    find = lambda text: (repaired(text)[0], repaired(text)[1])
    one_ = {"file": "f", "message": "m"}
    import json

    plain = json.dumps({"findings": [one_]})
    for text in (plain, f"so\n```json\n{plain}\n```\nok", f"```json\n{plain}", f"I {{think}} {plain} so", plain[:-2] + ",],}", json.dumps(one_),
                 json.dumps({"a": {"b": {"findings": [one_]}}}), json.dumps([one_])):
        assert find(text) == ([one_], None), text
    assert find("") == (None, "empty response") and find("7") == (None, "response is not a JSON object or array")
    assert find('{"a":1}') == (None, "response has no findings array")
    assert find("nothing [here") == (None, "no JSON object or array found in the response")


def test_prompts_hold_the_source_and_the_budget():
    unit = {
        "unit_id": "u", "path": "a.c", "kind": "function", "name": "f", "line_start": 9, "line_end": 10, "risk_tier": "medium", "conditional": "#if A",
        "parse_confidence": 1.0, "source": "int f(void)\n{}", "types": [], "macros": None, "globals": [{"name": "g", "definition": "int g;"}],
        "callees": [{"name": f"c{i}", "signature": f"int c{i}(void) {{ body", "summary": "s " * 90} for i in range(8)], "callers": None,
    }
    text = prompt(unit)
    assert " 9 | int f(void)\n10 | {}" in text and "body" not in text and "int g;" not in text
    assert text.count("- `int c") == 6 and "(2 further context entries omitted: context budget)" in text
    critical = prompt(unit | {"risk_tier": "critical"})
    assert "### Globals\n```c\nint g;" in critical and critical.count("- `int c") == 8


def test_log_stream_keeps_the_last_of_all_batches(spark, tmp_path):
    rows = [(i, i % 3, f"r{i % 2}") for i in range(60)]
    path = str(tmp_path / "in")
    for k in range(0, 60, 20):
        spark.createDataFrame(rows[k : k + 20], "event_id long, ts long, run_id string").coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema("event_id long, ts long, run_id string").option("maxFilesPerTrigger", 1).parquet(path)
    got = S2.log_stream(stream, 5)
    want = E.bounded_log(spark.read.parquet(path), 5)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_progress_never_falls_across_batches(spark, tmp_path):
    path = str(tmp_path / "p")
    schema = "event_id long, ts long, run_id string, progress double"
    for part in ([(0, 0, "r", 0.5)], [(1, 1, "r", 0.2), (2, 2, "r", None)], [(3, 3, "r", 0.9)]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    got = {r["event_id"]: r["shown"] for r in S2.collected(S2.progress_stream(stream)).collect()}
    assert got[2] is not None and got[3] >= got[0] and max(got.values()) == 0.9


def test_heartbeats_fire_by_timer_and_survive_a_restart(spark, tmp_path):
    schema = "run_id string, unit long, ts timestamp, status string"
    at = lambda s: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)
    parts = [
        [("r", 1, at(0), "start"), ("r", 2, at(1), "start")], [("r", 2, at(25), "x")], [("r", 2, at(47), "done"), ("r", 3, at(50), None)],
        [("r", 4, at(130), "start"), ("r", 4, at(131), "done")], [("r", 5, at(200), "start")],
    ]
    path, folder, done = str(tmp_path / "e"), str(tmp_path / "state"), F.col("status") == "done"
    for some in (parts[:2], parts[2:]):
        for part in some:
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
        got = S2.with_timers(S2.heartbeat_stream(stream, done, 10_000, 60_000, "5 seconds"), folder)
    events = spark.read.parquet(path)
    until = events.agg(F.unix_millis(F.max("ts")) - 5000).first()[0]
    want = E.beats(events, done, 10_000, 60_000, F.lit(until))
    assert sorted(map(tuple, got.drop("batch").collect())) == sorted(map(tuple, want.collect()))
    assert {r["unit"] for r in got.collect()} == {1, 2, 3}  # 1 and 3 are never heard of again


def test_streams_of_empty_sources_give_no_rows(spark, tmp_path):
    schema = "event_id long, ts timestamp, run_id string, unit long, status string, progress double"
    (tmp_path / "none").mkdir()
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "none"))
    assert S2.log_stream(stream, 5).count() == 0
    assert S2.collected(S2.progress_stream(stream)).count() == 0
    assert S2.collected(E.live_state(stream), "update").count() == 0
    assert S2.with_timers(S2.heartbeat_stream(stream, F.lit(False), 10, 60, "5 seconds")).count() == 0


def test_include_flags(spark):
    command = "cc -Iinc -I /abs -isystem sys -DX=1 -D 'Y=a b' -U Z -include pre.h -O2 -iquoteq -c f.c"
    flags = one(spark, D.include_flags(F.lit(None).cast("array<string>"), F.lit(command), F.lit("/w")))
    assert flags == ["-I/w/inc", "-I/abs", "-I/w/sys", "-DX=1", "-DY=a b", "-UZ", "-I/w/q"]
    assert one(spark, D.include_flags(F.lit(None).cast("array<string>"), F.lit("cc 'open"), F.lit("/w"))) == []


def test_readers_parse_a_report_once_and_still_see_its_faults(spark):
    from lintlake.sources import reports as P

    good = '{"version":"2.1.0","runs":[{"results":[{"ruleId":"R","message":{"text":"m"},"locations":[]}]}]}'
    texts = {
        good: None, good.replace("[]}]", "7}]"): "locations must be an array of objects",
        good.replace('"locations":[]', '"locations":null'): "locations must be an array of objects",
        good.replace('{"results"', '{"tool":[],"results"'): "tool must be an object",
        good.replace('"runs":[', '"runs":[null,'): None,
        good.replace('"R"', 'null'): None, good.replace('"m"', '["m"]'): None,
    }
    rows = spark.createDataFrame([("r", str(i), "flawfinder", "c", t) for i, t in enumerate(texts)], "run_id string, unit_id string, tool string, evidence_context string, text string")
    said = {r[0]: r[1] for r in rows.select("text", P.sarif_problem(F.col("text"))).collect()}
    assert {t: x and x.removeprefix("invalid Flawfinder SARIF: ") for t, x in said.items()} == texts
    plan = P.flawfinder(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == 1
    assert P.flawfinder(rows).count() == 4


def test_batches_are_bounded_and_cut_into_slices(spark):
    import pyarrow as pa

    from lintlake.operators.batches import BATCH_BYTES, slices, small_batches
    from lintlake.sources.responses import response_items

    batch = pa.RecordBatch.from_pydict({"t": ["x" * 1000] * 40})
    parts = list(slices(batch, 8_000))
    assert pa.Table.from_batches(parts).equals(pa.Table.from_batches([batch])) and all(p.nbytes <= 8_000 for p in parts)
    assert [p.num_rows for p in slices(pa.RecordBatch.from_pydict({"t": ["x" * 9000]}), 8_000)] == [1]
    before = spark.conf.get(BATCH_BYTES)
    try:
        spark.conf.set(BATCH_BYTES, "67108864b")
        response_items(spark.createDataFrame([("{}",)], "text string"))
        assert int(spark.conf.get(BATCH_BYTES)) == 8 << 20  # was left at 64 MiB
        spark.conf.set(BATCH_BYTES, "1000")
        small_batches(spark)
        assert spark.conf.get(BATCH_BYTES) == "1000"
    finally:
        spark.conf.set(BATCH_BYTES, before)


def test_a_streams_state_is_fed_in_short_frames(spark, tmp_path, monkeypatch):
    from lintlake.streaming import stateful as S2

    rows = [("r", k, 3 if k % 2 else 4, 1) for k in range(25, 0, -1)]
    spark.createDataFrame(rows, "run_id string, unit_id long, cost long, reserved long").coalesce(1).write.parquet(f"{tmp_path}/in")
    monkeypatch.setattr(S2, "STATE_ROWS", 4)
    stream = spark.readStream.schema("run_id string, unit_id long, cost long, reserved long").parquet(f"{tmp_path}/in")
    got = sorted((r["unit_id"], r["refused_by"], r["prompt_spent"]) for r in S2.collected(S2.ledger_stream(stream, ["unit_id"], 20, 100)).collect())
    want, spent = [], 0
    for k in range(1, 26):
        cost = 3 if k % 2 else 4
        refused = None if spent + cost <= 20 else "cost"
        spent += 0 if refused else cost
        want.append((k, refused, spent))
    assert got == want


def test_first_names_and_the_replan_are_hashed_and_read_once(spark, sf_dir):
    from lintlake.plans import event_queries as E
    from lintlake.plans import stored_queries as D

    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    symbols = E.QUERIES["d22_symbol_table_whole"](spark, sf_dir)
    assert "SortAggregate" not in plan(symbols)  # every name of every text was sorted
    words = spark.sql(
        "select path, posexplode(regexp_extract_all(content, '([A-Za-z_][A-Za-z0-9_]*)', 1)) as (pos, name) from {v}", v=E.view(spark, sf_dir, "v_sources")
    )
    want = words.groupBy("name").agg(F.min(F.struct((F.col("pos") % 3 != 0).alias("l"), "path", "pos")).alias("d"), F.count("*").alias("n"))
    want = want.selectExpr("name", "d.path", "d.pos", "not d.l as is_function", "n - 1 as duplicates")
    assert sorted(map(tuple, symbols.collect())) == sorted(map(tuple, want.collect()))
    assert plan(D.QUERIES["z03_replan"](spark, sf_dir)).count("Exchange hashpartitioning(key_hash") == 1  # was 2


def test_members_of_a_group_are_sorted_natively(spark, sf_dir):
    from lintlake.plans import review_queries as Q

    plan = Q.QUERIES["z01_cross_engine_groups"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "sort_array" in plan and "array_sort" not in plan  # which compares by a lambda, twice for each pair


def test_tables_of_a_review_that_need_no_grades_are_made_without(spark):
    xml = ('<?xml version="1.0"?><results version="2"><errors><error id="R" severity="error" msg="buffer overflow">'
           '<location file="a.c" line="4" column="1"/></error></errors></results>')
    table = "File,Line,Column,Warning,Rule\na.c,5,1,Buffer overrun,R2\na.c,90,1,alone,R3\n"
    said = '{"schema_version":1,"valid_report":true,"producer":"p","findings":[{"file":"a.c","line":5,"message":"overflow"}]}'
    rows = [("r", 1, "cppcheck", "xml", xml), ("r", 2, "splint", "csv", table), ("r", 3, "llm-security", "json", said), ("r", 4, "splint", "csv", 'a,b\n"open')]
    df = spark.createDataFrame(rows, "run_id string, unit_id long, tool string, kind string, text string").selectExpr(
        "*", "'source-only' as evidence_context", "true as valid_report")
    review = Review(df, "/work/src")
    spans, levels = review.overlap_spans.collect(), {tuple(r) for r in review.levels.select("tool", "review_level").collect()}
    assert "graded" not in vars(review)
    assert [tuple(r) for r in spans] == [("r", "a.c", "buffer", 4, 5, "cppcheck,splint")]
    assert levels == {("cppcheck", "error"), ("splint", "unmapped"), ("llm-security", "unmapped")}
    columns = spans[0].asDict().keys()
    assert [tuple(r) for r in review.overlap_groups.select(*columns).collect()] == [tuple(r) for r in spans]
    assert [tuple(r) for r in review.overlap_spans.collect()] == [tuple(r) for r in spans]
    assert {r["unit_id"] for r in review.diagnostics.collect()} == {4}


def test_plain_words_are_found_as_their_patterns_would_find_them(spark):
    values = ["a Null Pointer", "STRCPY", "use-DEF", "Kmemcpy", "rand (", "RAND(", "tab\tuninit", "", "Kformat", "nothing"]
    df = spark.createDataFrame([(v,) for v in values], "v string").withColumn("low", S.ascii_lower(F.col("v")))
    for _, pattern in S.KEYWORDS:
        assert df.where(S.mentions(F.col("v"), F.col("low"), pattern) != F.col("v").rlike(f"(?i){pattern}")).count() == 0


def test_findings_are_ordered_in_one_shuffle_however_often_they_are_met(spark, sf_dir):
    from lintlake.operators.ordering import positions
    from lintlake.plans.bindings import view

    rows = view(spark, sf_dir, "v_findings").where("l_orderkey % 16 < 3")
    # copies of one finding, later ones with another grade and in another context
    often = rows.where("tool = 'cppcheck'").limit(1).crossJoin(spark.range(300).select(F.col("id").alias("k"))).selectExpr(
        *[c for c in rows.columns if c not in ("l_linenumber", "original_severity", "evidence_context")], "cast(k + 10 as int) as l_linenumber",
        "case when k % 2 = 0 then 'style' else 'error' end as original_severity", "case when k % 3 = 0 then 'build-aware' else 'source-only' end as evidence_context")
    rows = rows.unionByName(often.select(*[F.col(f.name).cast(f.dataType) for f in rows.schema]))
    columns = ("run_id", "sort_pos", "fingerprint", "rank", "canonical_path", "evidence_context", "l_linenumber")
    want = positions(O.keep(R.reviewed(rows), "test"), "run_id", R.total_order(), "sort_pos").select(*columns)
    want = sorted(map(tuple, want.collect()))
    for frequent in (5, R.FREQUENT):
        assert sorted(map(tuple, R.ordered_findings(rows, columns, frequent).collect())) == want


def _mixed_reports(spark):
    """Reports of all kinds, some of them malformed, with findings that are met again in other reports."""
    xml = ('<?xml version="1.0"?><results version="2"><errors><error id="R" severity="{}" msg="buffer overflow">'
           '<location file="a.c" line="4" column="1"/></error><error id="E" severity="error" msg="syntax error"/></errors></results>')
    sarif = '{"version":"2.1.0","runs":[{"results":[{"ruleId":"F","message":{"text":"strcpy"},"locations":[{"physicalLocation":{"artifactLocation":{"uri":"./a.c"},"region":{"startLine":6}}}]}]}]}'
    table = "File,Line,Column,Warning,Rule\na.c,5,1,Buffer overrun,R2\na.c,90,1,alone,R3\n"
    said = '{"schema_version":1,"valid_report":true,"producer":"p","findings":[{"file":"a.c","line":5,"message":"overflow","severity":"high"}]}'
    log = "a.c:7:1: Buffer overrun\n   twice\n\nFinished checking --- 1\n   more\nb.c:2: fine\n< Location unknown >: parse error\n"
    rows = [
        (run, unit + more, tool, kind, text) for run in ("r", "s") for more in (0, 10)
        for unit, tool, kind, text in (
            (1, "cppcheck", "xml", xml.format("error")), (2, "cppcheck", "xml", xml.format("style")), (3, "cppcheck", "xml", "<results>"), (4, "flawfinder", "sarif", sarif),
            (5, "flawfinder", "sarif", "{"), (6, "splint", "csv", table), (7, "splint", "csv", 'a,b\n"open'), (8, "splint", "log", log), (9, "llm-security", "json", said))
    ]
    return spark.createDataFrame(rows, "run_id string, unit_id long, tool string, kind string, text string").selectExpr(
        "*", "'source-only' as evidence_context", "true as valid_report")


def test_counts_of_a_review_are_made_of_narrow_rows(spark):
    df = _mixed_reports(spark)
    narrow, whole = Review(df, "/work/src"), Review(df, "/work/src")
    assert whole.graded.count() == 14
    for table in ("counts", "tools", "overlap_spans"):
        assert {tuple(r) for r in getattr(narrow, table).collect()} == {tuple(r) for r in getattr(whole, table).collect()}
    assert "graded" not in vars(narrow)
    assert {r["review_level"] for r in narrow.levels.where("tool = 'cppcheck' and run_id = 'r'").collect()} == {"error"}  # of the first copy
    assert {(r["run_id"], r["tool"], r["total"], r["diagnostics"]) for r in narrow.tools.collect() if r["run_id"] == "r"} == {
        ("r", "cppcheck", 1, 6), ("r", "flawfinder", 1, 2), ("r", "splint", 4, 4), ("r", "llm-security", 1, 0)}


def test_integrity_of_reports_is_told_without_reading_their_findings(spark):
    df = _mixed_reports(spark)
    checked, read = Review(df, "/work/src"), Review(df, "/work/src")
    assert read.distinct_diagnostics.where("category = 'report-integrity'").count() == 12
    rows = {tuple(r) for r in checked.integrity.collect()}
    assert rows == {tuple(r) for r in read.integrity.collect()} == {("r", "partial", 8, 6), ("s", "partial", 8, 6)}
    assert "_own" not in vars(checked)


def test_an_ordered_review_is_shuffled_by_ranges_once(spark):
    df = _mixed_reports(spark)
    columns = ("run_id", "tool", "file", "line", "message", "severity", "canonical_path", "sort_pos")
    review = Review(df, "/work/src")
    ordered = review.ordered(*columns)
    assert "graded" not in vars(review)
    assert {tuple(r) for r in ordered.collect()} == {tuple(r) for r in review.findings.select(*columns).collect()}
    assert ordered.count() == 14


def test_key_digests_tell_apart_what_joined_text_would_not(spark):
    rows = [("a", "bc"), ("ab", "c"), ("a", None), (None, "a"), ("", "a"), ("a", ""), ("-:", "a"), (None, ":a"), ("a", "bc")]
    df = spark.createDataFrame(rows, "x string, y string").select(R.key_digest("x", "y").alias("d"))
    assert df.distinct().count() == len(set(rows))
    assert {len(r["d"]) for r in df.collect()} == {16}


def test_lines_of_a_log_are_not_shuffled(spark):
    log = " lost\na.c:1:2: one\n   \n\ttwo\r\nFinished checking\n   three\nnoise\n   of it\nb.c:3:\n   4: four\n"
    df = spark.createDataFrame([("r", 1, "splint", "x", log)], "run_id string, unit_id long, tool string, evidence_context string, text string")
    out = reports.splint_log(df)
    assert [(r["file"], r["line"], r["col"], r["message"]) for r in out.orderBy("pos").collect()] == [
        ("a.c", "1", "2", "one \ttwo three"), ("b.c", "3", "4", "four")]
    assert "Exchange" not in out._jdf.queryExecution().sparkPlan().toString() and "Window" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_a_store_writes_what_it_derives_once(spark, tmp_path):
    before = set(os.listdir(shared_dir(spark).removeprefix("file://")))
    store = Derivations(spark, str(tmp_path), "/work/src")
    store.update(_mixed_reports(spark))
    assert store.table("findings").count() == 14
    assert not [n for n in set(os.listdir(shared_dir(spark).removeprefix("file://"))) - before if n.startswith("review-")]


def test_reports_of_all_kinds_are_written_in_one_pass_over_the_table(spark, sf_dir):
    plan = report_queries._texts(spark, sf_dir, **{kind: make() for kind, make in report_queries._FORMS.items()})._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("FileScan") == 1
    assert "lineitem" not in report_queries._stored(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()


def test_the_source_of_units_is_joined_with_their_context_once(spark, sf_dir):
    from lintlake.plans import planner_queries as Q

    plan = Q._full(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert sum(" source#" in line for line in plan.splitlines() if "Project [" in line) <= 2
