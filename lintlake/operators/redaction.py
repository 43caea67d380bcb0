"""Redaction of secrets and host paths, with counts, and the check that nothing is left."""

from __future__ import annotations

import json
import re
from bisect import bisect_left
from collections.abc import Callable
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from lintlake.functions.text import HOST_PATHS, LEAKED_PATHS, UNC
from lintlake.operators.batches import small_batches

SECRET = "<SECRET>"
LEAST_SECRET = 8
#: Rules by pattern: name, what a text must contain first (cheap), pattern, token.
PATTERNS = (
    ("linux_home_pattern", "/home/", "(?i)" + HOST_PATHS[0], "<HOME>"),
    ("linux_home_pattern", "/users/", HOST_PATHS[1], "<HOME>"),
    ("windows_user_pattern", "users\\", HOST_PATHS[2], "<HOME>"),
    ("unc_pattern", "\\\\", UNC, "<HOST>"),
)
LITERAL_RULES = ("prefix", "secret_value")
#: Literals that are sought by a column expression each; of more, an automaton.
MOST_EXPRESSIONS = 16
RULES = (*LITERAL_RULES, "linux_home_pattern", "windows_user_pattern", "unc_pattern")


def literal_rules(prefixes: dict[str, str], secrets: list[str]) -> list[tuple[str, str, str]]:
    """(rule, literal, token): secrets first, then prefixes, each longest first; too short ones are left out."""
    by_length = lambda items: sorted(items, key=lambda v: (-len(v), v))
    prefixes = {p: t for p, t in prefixes.items() if len(p) > 2}
    prefixes |= {w: t for p, t in prefixes.items() if (w := windows_form(p))}
    rules = [("secret_value", s, SECRET) for s in by_length({s for s in secrets if len(s) >= LEAST_SECRET})]
    return rules + [("prefix", p, prefixes[p]) for p in by_length(prefixes)]


def windows_form(path: str) -> str:
    """What Windows calls a path below ``/mnt/<drive>/``; empty for others."""
    found = re.fullmatch(r"/mnt/([A-Za-z])/(.*)", path)
    return f"{found[1].upper()}:\\" + found[2].replace("/", "\\") if found else ""


@lru_cache(maxsize=4)
def _automaton(rules: tuple[tuple[str, str, str], ...]):
    """One automaton over all literals; its values are the places of the rules."""
    found = ahocorasick.Automaton()
    for place, (_, literal, _) in enumerate(rules):
        if literal not in found:
            found.add_word(literal, place)
    found.make_automaton()
    return found


def replaced_literals(text: str, rules: tuple[tuple[str, str, str], ...]) -> tuple[str, list[tuple[str, int]]]:
    """``text`` with tokens for literals, and how often each rule was applied: one pass, whatever the number of rules.

    Of matches that overlap, the rule that comes first takes its bytes, and of those of one rule the leftmost,
    as if the rules were applied one after the other.
    """
    spans = sorted((place, end + 1 - len(rules[place][1]), end + 1) for end, place in _automaton(rules).iter(text))
    if not spans:
        return text, []
    taken: list[tuple[int, int]] = []  # disjoint, in order
    tokens: dict[int, str] = {}
    counts: dict[str, int] = {}
    for place, start, end in spans:
        at = bisect_left(taken, (start, end))
        if (at and taken[at - 1][1] > start) or (at < len(taken) and taken[at][0] < end):
            continue
        taken.insert(at, (start, end))
        tokens[start] = rules[place][2]
        counts[rules[place][0]] = counts.get(rules[place][0], 0) + 1
    out, done = [], 0
    for start, end in taken:
        out += [text[done:start], tokens[start]]
        done = end
    return "".join([*out, text[done:]]), list(counts.items())


def _literals(rules: tuple[tuple[str, str, str], ...]) -> Callable[[Column], Column]:
    @F.pandas_udf(StructType([StructField("text", StringType()), *(StructField(r, IntegerType()) for r in LITERAL_RULES)]))
    def run(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            shown, counts = replaced_literals(text, rules)
            rows.append((shown, *(dict(counts).get(r, 0) for r in LITERAL_RULES)))
        return pd.DataFrame(rows, columns=["text", *LITERAL_RULES]).astype({"text": object})

    return run


def redact(rows: DataFrame, column: str, prefixes: dict[str, str], secrets: list[str]) -> DataFrame:
    """``column`` redacted, and a count per rule beside it.

    A few literals are column expressions, one after the other. Of more, an automaton finds all in one pass
    over a text, so that a thousand secrets cost what ten do; both ways take the longest literal first.
    """
    text = F.coalesce(F.col(column), F.lit(""))
    counts = {r: F.lit(0) for r in RULES}
    rules = tuple(literal_rules(prefixes, secrets))
    if len(rules) > MOST_EXPRESSIONS:
        small_batches(rows.sparkSession)
        rows = rows.withColumn("__found", _literals(rules)(text))
        text = F.col("__found.text")
        counts |= {r: F.col(f"__found.{r}") for r in LITERAL_RULES}
    else:
        for rule, literal, token in rules:
            found = F.size(F.split(text, re.escape(literal), -1)) - 1
            counts[rule] = counts[rule] + found
            text = F.replace(text, F.lit(literal), F.lit(token))
    rows = rows.withColumns({"__text": text, **{f"n_{r}": c for r, c in counts.items()}})
    for rule, hint, pattern, token in PATTERNS:
        hit = F.contains(F.lower("__text"), F.lit(hint))
        n = F.when(hit, F.regexp_count("__text", F.lit(pattern))).otherwise(0)
        rows = rows.withColumn(f"n_{rule}", F.col(f"n_{rule}") + n)
        rows = rows.withColumn("__text", F.when(hit, F.regexp_replace("__text", pattern, token)).otherwise(F.col("__text")))
    return rows.withColumn(column, F.col("__text")).drop("__text", "__found")


def _any_literal(rules: tuple[tuple[str, str, str], ...]) -> Callable[[Column], Column]:
    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([sorted({rules[p][0] for _, p in _automaton(rules).iter(t or "")}) for t in texts])

    return run


def leaks(rows: DataFrame, column: str, prefixes: dict[str, str], secrets: list[str]) -> DataFrame:
    """One row per rule that still finds something; none for a text that may be shown."""
    names = {"secret_value": "secret_value", "prefix": "dynamic_prefix"}
    rules = tuple(literal_rules(prefixes, secrets))
    if len(rules) > MOST_EXPRESSIONS:
        small_batches(rows.sparkSession)
        rows = rows.withColumn("__rules", _any_literal(rules)(F.col(column)))
        found = [F.when(F.array_contains("__rules", r), names[r]) for r in LITERAL_RULES]
    else:
        found = [F.when(F.contains(F.col(column), F.lit(literal)), names[rule]) for rule, literal, _ in rules]
    found += [
        F.when(F.contains(F.lower(column), F.lit(hint)) & F.col(column).rlike(pattern), "sensitive_path_pattern")
        for (_, hint, _, _), pattern in zip(PATTERNS, ("(?i)" + LEAKED_PATHS[0], *LEAKED_PATHS[1:], UNC), strict=True)
    ]
    return rows.withColumn("leak", F.explode(F.array_compact(F.array(*found)))).drop("__rules")


def report(redacted: DataFrame) -> DataFrame:
    """How often each rule was applied, over all texts."""
    sums = redacted.agg(*(F.sum(f"n_{r}").alias(r) for r in RULES))
    return sums.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, RULES)), F.array(*RULES))).alias("rule", "n"))


def json_text(column: Column, prefixes: dict[str, str], secrets: list[str]) -> Column:
    """Free JSON by its text: keys and values alike go through all rules, and the text stays JSON.

    Inside JSON a backslash is doubled, so literals are sought in that form too; the patterns allow for it.
    """
    for _, literal, token in literal_rules(prefixes, secrets):
        for form in dict.fromkeys((json.dumps(literal, ensure_ascii=False)[1:-1], literal)):
            column = F.replace(column, F.lit(form), F.lit(token))
    for _, hint, pattern, token in PATTERNS:
        column = F.when(F.contains(F.lower(column), F.lit(hint)), F.regexp_replace(column, pattern, token)).otherwise(column)
    return column


def export_policy(path: Column) -> Column:
    """What an export does with an artifact: texts that quote source are left out."""
    session = path.rlike(r"^llm/sessions/[^/]+/") & ~F.endswith(path, F.lit("/findings.json"))
    quotes = session | path.rlike(r"^llm/units/") | (path == "llm/index.json")
    left_out = path.rlike(r"^exports/|(^|/)(build|tmp)(/|$)") | (path == "inputs/sanitizer-map.private.json")
    return F.when(left_out, "omitted").when(quotes, "excluded").otherwise("shipped")
