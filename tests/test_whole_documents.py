"""Queries over whole documents against brute force; what they look for stands after long prefixes."""

import re
from collections import Counter

import pytest

from lintlake.functions.text import HOST_PATHS, KEYWORDS, LEAKED_PATHS, UNC
from lintlake.plans import registry

LATE = {
    1: "word " * 100 + "late_name (x) while (y)\nlast s3cr3t-value line",
    2: "word " * 300 + "see /home/ann/p and /work/src/a.c & \\\\host\\share <b>",
    3: "word " * 90 + "C:\\Users\\eve\\q.c\n" + "/mnt/d/y/Users/zoe/r late_name(",
    4: "short text",
    5: None,
}
SUFFIX = [".c", ".h", ".CPP", ".hpp", ".txt", ".cc"]
NAME = r"[A-Za-z_][A-Za-z0-9_]*"


def path(d):
    return f"web/en/{d}{SUFFIX[d % 6]}"


def note(d):
    return (
        (LATE[d] or "") + f" at /home/user{d % 7}/p/{path(d)}" + (f" and C:\\Users\\bob{d % 5}\\x.c" if d % 3 == 0 else "")
        + (" and /mnt/c/x/Users/ann/y" if d % 5 == 0 else "") + (" on \\\\srv1\\share$\\x" if d % 6 == 1 else "")
        + (" in D:\\work\\src\\m.c" if d % 8 == 3 else "") + (" key s3cr3t-value /work/src/main.c" if d % 4 == 0 else "")
    )


def redacted(d):
    text, n = note(d), Counter()
    for rule, literal, token in (("secret_value", "s3cr3t-value", "<SECRET>"), ("prefix", "D:\\work\\src", "<SRC>"), ("prefix", "/work/src", "<SRC>"), ("prefix", "/work", "<ROOT>")):
        n[rule] += text.count(literal)
        text = text.replace(literal, token)
    for rule, pattern, token in (
        ("linux_home_pattern", "(?i)" + HOST_PATHS[0], "<HOME>"), ("linux_home_pattern", HOST_PATHS[1], "<HOME>"),
        ("windows_user_pattern", HOST_PATHS[2], "<HOME>"), ("unc_pattern", UNC, "<HOST>"),
    ):
        text, k = re.subn(pattern, token, text)
        n[rule] += k
    return text, n


@pytest.fixture(scope="module")
def got(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("whole"))
    rows = [(k, t, "en", "web", len(t or "")) for k, t in LATE.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    return lambda name: [r.asDict() for r in registry.QUERIES[name](spark, d).collect()]


def test_symbol_table_reads_whole_documents(got):
    places = {}
    for d, text in LATE.items():
        for pos, name in enumerate(re.findall(NAME, text or "")):
            places.setdefault(name, []).append((pos % 3 != 0, path(d), pos))
    want = {n: (*min(p)[1:], not min(p)[0], len(p) - 1) for n, p in places.items()}
    assert {r["name"]: (r["path"], r["pos"], r["is_function"], r["duplicates"]) for r in got("d22_symbol_table_whole")} == want
    assert "late_name" in want


def test_text_queries_read_whole_documents(got):
    calls = {}
    for d, text in LATE.items():
        code = f"int f{d % 9}(void) {{ if (g({(text or '').replace(' ', '( ')})) return sizeof(x); h (1); }}"
        names = set(re.findall(rf"\b({NAME})\s*\(", re.sub(r"[^ -~\n]", "", code)))
        calls[d] = ",".join(sorted(names - set(KEYWORDS)))
    assert {r["doc_id"]: r["calls"] for r in got("e18_calls_whole")} == calls
    assert "late_name" in calls[1]
    listing = {}
    for d, text in LATE.items():
        lines = (text or "").split("\n")
        width = len(str(d + len(lines)))
        listing[d] = "\n".join(f"{str(d + 1 + i).rjust(width)} | {x}" for i, x in enumerate(lines))
    assert {r["doc_id"]: r["listing"] for r in got("e23_numbered_whole")} == listing
    safe = {d: "<a&b>" + note(d) for d in LATE}
    for raw, code in (("&", "\\u0026"), ("<", "\\u003c"), (">", "\\u003e")):
        safe = {d: t.replace(raw, code) for d, t in safe.items()}
    assert {r["doc_id"]: r["safe"] for r in got("e35_html_safe_whole")} == safe
    scrubbed = {d: note(d) for d in LATE}
    for pattern in HOST_PATHS:
        scrubbed = {d: re.sub(pattern, "<HOME>", t) for d, t in scrubbed.items()}
    assert {r["doc_id"]: r["scrubbed"] for r in got("e08_host_paths_whole")} == scrubbed


def test_redaction_reads_whole_documents(got):
    rules = ("prefix", "secret_value", "linux_home_pattern", "windows_user_pattern", "unc_pattern")
    want = {d: (redacted(d)[0], *(redacted(d)[1][r] for r in rules)) for d in LATE}
    assert {r["doc_id"]: (r["note"], *(r[f"n_{x}"] for x in rules)) for r in got("e26_redacted_whole")} == want
    totals = sum((redacted(d)[1] for d in LATE), Counter())
    assert {r["rule"]: r["n"] for r in got("d24_redaction_report_whole")} == {r: totals[r] for r in rules}
    assert totals["unc_pattern"] == 2
    leaks = Counter()
    for d in LATE:
        leaks[d, "secret_value"] += "s3cr3t-value" in note(d)
        leaks[d, "dynamic_prefix"] += ("/work/src" in note(d)) + ("/work" in note(d)) + ("D:\\work\\src" in note(d))
        leaks[d, "sensitive_path_pattern"] += sum(bool(re.search(p, note(d))) for p in ("(?i)" + LEAKED_PATHS[0], *LEAKED_PATHS[1:], UNC))
    assert {(r["doc_id"], r["leak"]): r["n"] for r in got("b17_leaks_whole")} == +leaks
    assert got("b17_no_leaks_left_whole") == []
