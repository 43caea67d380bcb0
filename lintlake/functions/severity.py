"""Column functions that grade, classify and identify findings."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintlake.functions.text import bound

# Ranks, native levels and producer order that results must keep.
SEVERITY_RANK = {"critical": 5, "high": 4, "medium": 3, "low": 2, "info": 1, "unknown": 0}
REVIEW_LEVEL_RANK = {"error": 4, "warning": 3, "style": 2, "information": 1, "unmapped": 0}
NATIVE_TOOLS = ("cppcheck", "flawfinder", "splint")
SCANNERS = ("llm-memory-safety", "llm-security", "llm-firmware-concurrency")
PRODUCERS = NATIVE_TOOLS + SCANNERS
CPPCHECK_SEVERITY = {
    "error": "high", "warning": "medium", "style": "low", "performance": "low",
    "portability": "low", "information": "info", "debug": "info",
}
FLAWFINDER_WORDS = {"error": "high", "warning": "medium", "note": "info", "none": "unknown"}
NO_LINE = 2**31 - 1
# Declared categories of scanners and the canonical names they stand for.
CATEGORY_ALIASES = {
    "": "unknown", "other": "unknown", "out-of-bounds": "buffer", "unsafe-copy": "buffer", "overflow": "buffer",
    "use-after-free": "lifetime", "undefined-behaviour": "undefined-behavior", "concurrency": "race",
    "isr": "isr-safety", "isr-race": "isr-safety", "interrupt": "isr-safety", "register-access": "mmio",
    "reset-behaviour": "reset-behavior", "information-leak": "info-leak", "volatile": "volatile-misuse",
    "rtos": "rtos-sync", "secrets": "hardcoded-secret", "hardcoded-key": "hardcoded-secret",
    "crypto": "crypto-misuse", "protocol": "protocol-parsing", "auth": "authentication",
}
# Weakness numbers by category, first for every engine, then for scanners alone.
CWE_CATEGORIES = (
    ("null-dereference", (476,)),
    ("buffer", (119, 120, 121, 122, 124, 125, 126, 127, 131, 680, 787, 788, 805)),
    ("uninitialized", (457,)),
    ("resource-leak", (401, 404, 772, 775)),
    ("format", (134,)),
    ("randomness", (327, 330, 338)),
)
SCANNER_CWE_CATEGORIES = (
    ("integer-overflow", (190, 191, 192, 194, 195, 196, 197, 680, 681)),
    ("lifetime", (415, 416, 562, 590, 761, 825)),
    ("input-validation", (20, 129, 1284)),
    ("protocol-parsing", (112, 130, 240, 444)),
    ("info-leak", (200, 209, 212, 226, 532)),
    ("hardcoded-secret", (259, 321, 798)),
    ("authentication", (287, 288, 290, 306, 592)),
    ("trust-boundary", (250, 269, 501, 668, 807)),
    ("crypto-misuse", (261, 310, 326, 328, 347, 916)),
    ("race", (362, 364, 366, 367, 421, 543, 821)),
    ("firmware-update", (345, 494, 565, 829)),
    ("debug-backdoor", (489, 506, 511, 912)),
    ("stack-usage", (674, 770, 789)),
    ("undefined-behavior", (188, 469, 588, 704, 758)),
)
# Keywords by category in order of precedence, for every engine, then for scanners alone.
KEYWORDS = (
    ("null-dereference", r"null pointer|nullpointer|nullderef"),
    ("buffer", r"buffer|overflow|strcpy|strcat|memcpy|memmove"),
    ("uninitialized", r"uninit|used before definition|use.?def"),
    ("resource-leak", r"memory leak|resource leak|not released"),
    ("format", r"format|string format|printf|scanf"),
    ("randomness", r"random|srand|rand\("),
)
SCANNER_KEYWORDS = (
    ("integer-overflow", r"integer overflow|signed overflow|unsigned wrap|truncat|sign.?(?:ed )?conversion"),
    ("lifetime", r"use.?after.?free|double free|dangling|freed memory|after it is freed"),
    ("race", r"\brace\b|data race|concurrent|reentran|thread.?unsafe"),
    ("isr-safety", r"\bisr\b|\birq\b|interrupt (?:handler|context|service)"),
    ("volatile-misuse", r"\bvolatile\b"),
    ("atomicity", r"atomic|read.?modify.?write"),
    ("rtos-sync", r"\brtos\b|mutex|semaphore|spinlock|critical section|freertos"),
    ("watchdog", r"watchdog"),
    ("mmio", r"\bmmio\b|memory.?mapped|register (?:access|write|read)"),
    ("dma", r"\bdma\b"),
    ("timeout", r"timeout|deadline|busy.?wait|infinite loop"),
    ("reset-behavior", r"\breset\b|reboot|power.?on"),
    ("protocol-parsing", r"protocol|packet|frame header|decoder|\btlv\b"),
    ("input-validation", r"input validation|unvalidated|untrusted input|sanitiz"),
    ("trust-boundary", r"trust boundary|privilege|attacker.?controlled"),
    ("crypto-misuse", r"crypto|cipher|\baes\b|\brsa\b|\bhmac\b|nonce"),
    ("hardcoded-secret", r"hard.?coded (?:key|secret|password|credential)|api key"),
    ("info-leak", r"information (?:leak|disclosure)|leaks? (?:the )?(?:key|address|memory)"),
    ("authentication", r"authenticat|authoriz|password check"),
    ("firmware-update", r"firmware update|\bota\b|image signature|signature verif"),
    ("debug-backdoor", r"backdoor|debug port|\bjtag\b|\bswd\b"),
    ("stack-usage", r"stack (?:usage|overflow|frame)|alloca|variable.?length array"),
    ("undefined-behavior", r"undefined behaviou?r|strict aliasing|unsequenced"),
)


def clean(value: Column) -> Column:
    """Lower case without surrounding white space; null counts as empty."""
    return F.lower(F.trim(F.coalesce(value, F.lit("")), F.lit(" \t\n\x0b\f\r")))


def lookup(value: Column, table: dict[str, object], default: object) -> Column:
    """A small constant table as a map literal, which constant folding keeps in the plan once."""
    pairs = [F.lit(x) for pair in table.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), value), F.lit(default))


def severity(tool: Column, value: Column, scale: Column, engine: Column) -> Column:
    """Normalised severity of a native grade; NaN grades and words unknown to the tool are ``unknown``."""
    return bound({"raw": clean(value), "scale": scale, "tool": tool, "engine": engine}, lambda x: _severity(x))


def _severity(x: Column | dict[str, Column], number: Column | None = None) -> Column:
    raw, tool = x["raw"], x["tool"]
    cvss = x["scale"] == "security-severity"

    def graded(number: Column) -> Column:
        number = F.when(F.isnan(number), F.lit(-1.0)).otherwise(number)
        return (
            F.when(number >= F.when(cvss, 9).otherwise(5), "critical")
            .when(number >= F.when(cvss, 7).otherwise(4), "high")
            .when(number >= F.when(cvss, 4).otherwise(3), "medium")
            .when(number > 0, "low")
            .when(number == 0, "info")
            .otherwise("unknown")
        )

    # a cast that fails costs an exception, so words are asked for before numbers, and a number is read once
    return (
        F.when(x["engine"] == "llm", F.when(raw.isin(*SEVERITY_RANK), raw).otherwise("unknown"))
        .when(tool == "cppcheck", lookup(raw, CPPCHECK_SEVERITY, "unknown"))
        .when((tool == "flawfinder") & raw.isin(*FLAWFINDER_WORDS), lookup(raw, FLAWFINDER_WORDS, "unknown"))
        .when((tool == "flawfinder") & (raw != ""), bound({"number": raw.try_cast("double")}, lambda y: graded(y["number"])) if number is None else graded(number))
        .otherwise("unknown")
    )


def with_severity(rows: DataFrame, tool: Column, value: Column, scale: Column, engine: Column) -> DataFrame:
    """``rows`` with ``severity``; what it is made of is held in columns, which are compiled, not in a lambda."""
    parts = {"severity_raw": clean(value), "severity_scale_of": scale, "severity_tool": tool, "severity_engine": engine}
    x = {n: F.col(f"severity_{m}") for n, m in (("raw", "raw"), ("scale", "scale_of"), ("tool", "tool"), ("engine", "engine"))}
    read = (x["tool"] == "flawfinder") & (x["engine"] != "llm") & ~x["raw"].isin("", *FLAWFINDER_WORDS)
    rows = rows.withColumns(parts).withColumn("severity_number", F.when(read, x["raw"].try_cast("double")))
    return rows.withColumn("severity", _severity(x, F.col("severity_number"))).drop(*parts, "severity_number")


def severity_rank(value: Column) -> Column:
    return lookup(value, SEVERITY_RANK, 0)


def review_level(value: Column) -> Column:
    raw = clean(value)
    return F.when(raw.isin("information", "style", "warning", "error"), raw).otherwise("unmapped")


def review_level_rank(level: Column) -> Column:
    return lookup(level, REVIEW_LEVEL_RANK, 0)


def producer_rank(name: Column) -> Column:
    """Place in the order of producers; unknown ones sort last."""
    return lookup(name, {p: i for i, p in enumerate(PRODUCERS)}, len(PRODUCERS))


def cwe_of(value: Column) -> Column:
    """``CWE-n`` of the first mention, else empty."""
    number = F.regexp_extract(value, r"(?i)CWE-?(\d+)", 1)
    return F.when(number != "", F.concat(F.lit("CWE-"), number)).otherwise("")


def line_number(value: Column) -> Column:
    trimmed = F.trim(value)
    return F.coalesce(F.when(trimmed != "", trimmed).try_cast("int"), F.lit(NO_LINE))  # a cast that fails costs an exception


def fingerprint(tool: Column, path: Column, line: Column, column: Column, rule: Column, message: Column) -> Column:
    return F.sha2(F.concat_ws("\0", *(clean(c) for c in (tool, path, line, column, rule, message))), 256)


def category(engine: Column, declared: Column, cwe: Column, rule: Column, message: Column) -> Column:
    """A scanner's own category by its canonical name, else the weakness number, else the first keyword."""
    return bound(category_parts(engine, declared, cwe, rule, message), category_of)


def category_parts(engine: Column, declared: Column, cwe: Column, rule: Column, message: Column) -> dict[str, Column]:
    """What a category is made of; a table that holds these as columns works each out once."""
    value = F.concat_ws(" ", *(F.coalesce(c, F.lit("")) for c in (cwe, rule, message)))
    digits = F.nullif(F.regexp_extract(value, r"(?i)CWE-?(\d+)", 1), F.lit(""))  # a cast that fails costs an exception
    return {"named": clean(declared), "value": value, "lowered": ascii_lower(value), "number": digits.try_cast("int"), "scanner": engine == "llm"}


def with_category(rows: DataFrame, engine: Column, declared: Column, cwe: Column, rule: Column, message: Column) -> DataFrame:
    """``rows`` with ``category``; what it is made of is held in columns, which are compiled, not in a lambda."""
    parts = category_parts(engine, declared, cwe, rule, message)
    held = {n: F.col(f"category_{n}") for n in parts}
    rows = rows.withColumns({f"category_{n}": v for n, v in parts.items()})
    return rows.withColumn("category", category_of(held)).drop(*(f"category_{n}" for n in parts))


def category_of(x: Column | dict[str, Column]) -> Column:
    named, value, lowered, number, scanner = (x[n] for n in ("named", "value", "lowered", "number", "scanner"))
    out = F.when(scanner & (named != ""), F.coalesce(F.try_element_at(_aliases(), named), named))
    said = F.when(F.lit(False), "")
    for name, pattern in KEYWORDS:
        said = said.when(mentions(value, lowered, pattern), name)
    # few rows get this far; a lambda keeps what they need out of the compiled code, which the JVM compiles only up to a size
    said_by_scanner = bound({"value": value}, lambda y: reduce(
        lambda arms, rule: arms.when(y["value"].rlike(f"(?i){rule[1]}"), rule[0]), SCANNER_KEYWORDS, F.when(F.lit(False), "")))
    return F.coalesce(
        out, F.try_element_at(_by_number(CWE_CATEGORIES), number), F.when(scanner, F.try_element_at(_by_number(SCANNER_CWE_CATEGORIES), number)),
        said, F.when(scanner, said_by_scanner), F.concat(F.lit("CWE-"), number.cast("string")), F.lit("unknown"),
    )


def ascii_lower(value: Column) -> Column:
    """A-Z in lower case and nothing else, which is what ``(?i)`` takes as equal."""
    return F.translate(value, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def mentions(value: Column, lowered: Column, pattern: str) -> Column:
    """Whether ``value`` matches any of the alternatives, whatever the case; plain words are looked for in ``lowered`` as such."""
    found = F.lit(False)
    for one in pattern.split("|"):
        word = one.replace("\\(", "(")
        found = found | (F.contains(lowered, F.lit(word)) if re.fullmatch(r"[a-z0-9 (]+", word) else value.rlike(f"(?i){one}"))
    return found


def _by_number(categories: tuple[tuple[str, tuple[int, ...]], ...]) -> Column:
    """Category by weakness number as a map literal; of two categories of one number the first."""
    names = {n: name for name, numbers in reversed(categories) for n in numbers}
    return F.create_map(*[F.lit(y) for pair in names.items() for y in pair])


def _aliases() -> Column:
    return F.create_map(*[F.lit(x) for pair in CATEGORY_ALIASES.items() for x in pair])
