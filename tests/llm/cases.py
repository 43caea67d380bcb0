"""Small tables that every operator must get through, and plain versions to compare with."""

import re

from pyspark.sql import functions as F

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOREM = "the quick brown fox jumps over the lazy dog while many small birds sing in the old green garden near our house"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, row long, key string"


def ascii_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return WORDS.findall(ascii_lower(text))


def hard_rows():
    """Nulls, empty, blank and very long texts, copies, ties, repeated rows, odd characters, clashing columns."""
    near = LOREM.replace("lazy", "sleepy")
    texts = [
        LOREM, LOREM, LOREM.upper(), LOREM.replace(" ", "  "), near, None, "", " \t\n", "a", "A", "a b c d", "x" * 5000,
        ("word " * 20000).strip(), "Ünïcödé ΣΑΣ İ ☃ 日本語 don't 12 <|endoftext|> b", "a\x1cb  c d e", "!!! ??? ###",
    ]
    rows = [(i, t, "en", f"s{i % 3}" if i % 5 else None, None, "clash", i, "k") for i, t in enumerate(texts)]
    rows += [(0, LOREM, "en", "s0", None, "clash", 1, "k")]  # a repeated row
    rows += [(None, LOREM, None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]
    return rows


def hard(spark):
    return spark.createDataFrame(hard_rows(), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def saved(df, path):
    df.write.mode("overwrite").parquet(str(path))
    return str(path)


def rows_of(df):
    return [r.asDict() for r in df.collect()]


__all__ = ["F", "LOREM", "SCHEMA", "ascii_lower", "empty", "hard", "hard_rows", "rows_of", "saved", "words"]
