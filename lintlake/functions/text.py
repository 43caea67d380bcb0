"""Column functions on paths, texts and identifiers."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

HOME = "<HOME>"
# Patterns of host paths, in the order they are replaced.
HOST_PATHS = (
    r"/home/[^/\s\"'<>]+",
    r"(?i)/mnt/[A-Za-z]/(?:[^/\s\"'<>]+/)*Users/[^/\s\"'<>]+",
    r"(?i)[A-Za-z]:\\+(?:[^\\\r\n\"'<>]+\\+)*Users\\+[^\\\r\n\"'<>]+",
)
UNC = r"(?i)(?<!\\)\\{2,4}[A-Za-z0-9][A-Za-z0-9._-]+\\{1,2}[A-Za-z0-9$_. -]{2,}(?:\\{1,2}[^\\\r\n\"'<>]+)*"
# Looser patterns by which a text that still holds host paths is told.
LEAKED_PATHS = (
    HOST_PATHS[0],
    r"(?i)/mnt/[A-Za-z]/[^\s\"'<>]*/Users/[^/\s\"'<>]+",
    r"(?i)[A-Za-z]:\\+[^\r\n]*\\+Users\\+",
)
# Source suffixes and directories that are never scanned.
SUFFIXES = (".c", ".C", ".cc", ".cpp", ".cxx", ".c++", ".h", ".H", ".hh", ".hpp", ".hxx", ".h++")
HEADERS = (".h", ".H", ".hh", ".hpp", ".hxx", ".h++")
SKIPPED_DIRS = (
    ".git", ".hg", ".svn", ".agents", ".codex", "__pycache__", ".pytest_cache", ".mypy_cache", ".ruff_cache",
    ".tox", ".nox", ".venv", "venv", "env", "node_modules", "build", "out", "dist", "CMakeFiles",
)
# The reserved words of C and C++, which are never called.
KEYWORDS = tuple(
    """
    alignas alignof and and_eq asm auto bitand bitor bool break case catch char char8_t char16_t char32_t class
    compl concept const consteval constexpr constinit const_cast continue co_await co_return co_yield decltype
    default delete do double dynamic_cast else enum explicit export extern false float for friend goto if inline
    int long mutable namespace new noexcept not not_eq nullptr operator or or_eq private protected public register
    reinterpret_cast requires restrict return short signed sizeof static static_assert static_cast struct switch
    template this thread_local throw true try typedef typeid typename union unsigned using virtual void
    volatile wchar_t while xor xor_eq defined offsetof va_arg va_start va_end _Alignas _Alignof _Atomic _Bool
    _Complex _Generic _Imaginary _Noreturn _Static_assert _Thread_local __attribute__ __asm__ __declspec
    __typeof__ __extension__ __restrict __restrict__ __inline__
    """.split()
)
IDENTIFIER = r"[A-Za-z_][A-Za-z0-9_]*"
CAMEL = r"[A-Z]+(?![a-z])|[A-Z][a-z]+|[a-z]+|[0-9]+"


def bound(values: dict[str, Column], use: Callable[[Column], Column]) -> Column:
    """``use`` of values that are worked out once, however often it names them; Spark would repeat them in every branch."""
    return F.transform(F.array(F.struct(*(v.alias(n) for n, v in values.items()))), use)[0]


def suffix(path: Column) -> Column:
    return F.regexp_extract(path, r"(\.[^./]+)$", 1)


def is_source(path: Column) -> Column:
    """A C or C++ suffix (case matters) and no skipped directory above the file."""
    parts = F.split(path, "/")
    dirs = F.slice(parts, 1, F.greatest(F.lit(0), F.size(parts) - 1))
    skipped = F.arrays_overlap(dirs, F.array(*map(F.lit, SKIPPED_DIRS)))
    built = F.exists(dirs, lambda d: F.startswith(d, F.lit("cmake-build-")))
    return suffix(path).isin(*SUFFIXES) & ~skipped & ~built


def language(path: Column) -> Column:
    """B22."""
    return F.when(suffix(path).isin(*HEADERS), "header").when(suffix(path) == ".c", "c").otherwise("cpp")


def glob_regex(pattern: str) -> str:
    """A path glob as a regular expression: ``*`` and ``?`` stay within a directory, ``**`` crosses them."""
    import re

    out, i = "", 0
    while i < len(pattern):
        if pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        elif pattern[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif pattern[i] == "?":
            out, i = out + "[^/]", i + 1
        elif pattern[i] == "[" and (found := re.match(r"\[(!?)(\]?[^\]/]*)\]", pattern[i:])):
            inside = found[2].replace("\\", r"\\").replace("[", r"\[").replace("^", r"\^")
            out, i = out + f"[{'^/' if found[1] else ''}{inside}]", i + found.end()
        else:
            out, i = out + re.escape(pattern[i]), i + 1
    return out


def matches(path: Column, patterns: list[str]) -> Column:
    """Whether any glob matches the path's end, names it, or names a directory above it."""
    found = F.lit(False)
    for p in patterns:
        plain = p.rstrip("/")
        found = found | path.rlike(f"(?:^|/){glob_regex(p.removeprefix('**/'))}$")
        found = found | (path == plain) | F.startswith(path, F.lit(plain + "/"))
    return found


def ancestors(path: Column) -> Column:
    """The directories above a path, outermost first."""
    parts = F.split(path, "/")
    depths = F.filter(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: n > 0)
    return F.transform(depths, lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def left_out(path: Column, patterns: list[str]) -> Column:
    """Whether a glob names the path or a directory above it, below which nothing is looked at."""
    return F.exists(ancestors(path), lambda d: matches(d, patterns)) | matches(path, patterns)


def ignored(path: Column, lines: list[str]) -> Column:
    """Ordered ignore rules, of which the last that matches decides; ``!`` takes a path back in.

    Directories are asked first, from the outermost, and nothing below an ignored one comes back.
    """
    return F.exists(ancestors(path), lambda d: _ignored(d, lines)) | _ignored(path, lines)


def selected(path: Column, include: list[str], exclude: list[str], ignore: list[str]) -> Column:
    """What an inventory holds of all paths: sources that are included, not left out and not ignored."""
    wanted = F.lit(True) if not include or "**/*" in include else matches(path, include)
    return is_source(path) & wanted & ~left_out(path, exclude) & ~ignored(path, ignore)


def _ignored(path: Column, lines: list[str]) -> Column:
    out = F.lit(False)
    for line in (x.strip() for x in lines):
        if not line or line.startswith("#"):
            continue
        rule = line.removeprefix("!")
        name = rule.rstrip("/").lstrip("/")
        if not name:
            continue
        body = glob_regex(name)
        anchored = rule.startswith("/")
        if "/" not in name:
            hit = path.rlike(f"(?:^|/){body}$" if any(c in name for c in "*?[") else f"(?:^|/){body}(?:/|$)")
        elif anchored:
            hit = path.rlike(f"^{body}(?:/|$)")
        else:
            hit = path.rlike(f"(?:^|/){body}$") | F.startswith(path, F.lit(name + "/"))
        out = F.when(hit, not line.startswith("!")).otherwise(out)
    return out


#: What folding would change in a path below a plain source: escapes, roots, empty and dotted parts.
UNFOLDED = r"%|//|^/|/\Z|(?:^|/)\.{1,2}(?:/|\Z)"


def canonical_path(raw: Column, source: str) -> Column:
    """Decoded, without ``file://``, folded lexically and relative to ``source`` where it lies below it.

    Symbolic links are not resolved; there is no file system behind the column.
    """
    base = source.rstrip("/") + "/"
    decoded = F.coalesce(F.try_url_decode(F.replace(raw, F.lit("+"), F.lit("%2B"))), raw)
    rooted = bound({"plain": F.regexp_replace(decoded, "^file://[^/]*", "")}, lambda x: F.when(
        F.startswith(x["plain"], F.lit("/")), x["plain"]).otherwise(F.concat(F.lit(base), x["plain"])))
    parts = F.filter(F.split(rooted, "/"), lambda p: (p != "") & (p != "."))
    keep = lambda acc, p: F.when(p == "..", F.slice(acc, 1, F.greatest(F.lit(0), F.size(acc) - 1))).otherwise(
        F.concat(acc, F.array(p))
    )
    folded = F.concat(F.lit("/"), F.array_join(F.aggregate(parts, F.array().cast("array<string>"), keep), "/"))
    relative = bound({"path": folded}, lambda x: F.when(
        F.startswith(x["path"], F.lit(base)), F.substring(x["path"], len(base) + 1, 1 << 30)).otherwise(x["path"]))
    out = F.when(F.coalesce(raw, F.lit("")) == "", "")
    if source.startswith("/") and not re.search(UNFOLDED, base[1:-1]):
        out = out.when(~raw.rlike(UNFOLDED), raw)  # folding it below the source would change nothing
    return out.otherwise(relative)


@F.udf(returnType=LongType(), useArrow=True)
def _bad_byte(content):
    try:
        bytes(content or b"").decode("utf-8")
    except UnicodeDecodeError as error:
        return error.start
    return None


def first_bad_byte(content: Column) -> Column:
    """Where bytes stop being UTF-8; null if they are. Only invalid contents are sent to Python."""
    return _bad_byte(F.when(~F.is_valid_utf8(content.cast("string")), content))


def scrub_host_paths(text: Column) -> Column:
    """E08."""
    for pattern in HOST_PATHS:
        text = F.regexp_replace(text, pattern, HOME)
    return text


def unit_id(path: Column, kind: Column, name: Column, ordinal: Column) -> Column:
    """A readable prefix and twelve digits of a hash; offsets are left out, so edits above do not change it."""
    safe = F.regexp_replace(F.translate(path, "\\", "/"), "/", "__")
    safe = F.regexp_replace(safe, r"(?U)[^\p{Alnum}._-]", "_")
    digest = F.sha2(F.concat_ws("\0", path, kind, name, ordinal.cast("string")), 256)
    return F.concat(F.substring(safe, 1, 80), F.lit("-"), F.substring(digest, 1, 12))


def slug(path: Column) -> Column:
    """A directory name for a source path; a short digest tells apart what replacing made alike."""
    raw = F.replace(F.regexp_replace(path, r"^/+|/+$", ""), F.lit("/"), F.lit("__"))
    safe = F.regexp_replace(raw, r"[^A-Za-z0-9._-]", "_")
    safe = F.when(safe == "", "source").otherwise(safe)
    digest = F.concat(F.lit("-"), F.substring(F.sha2(path, 256), 1, 8))
    trim = lambda c: F.regexp_replace(c, r"[._-]+$", "")
    out = F.when((safe != raw) | F.contains(path, F.lit("__")), F.concat(trim(safe), digest)).otherwise(safe)
    return F.when(F.length(out) > 120, F.concat(trim(F.substring(out, 1, 111)), digest)).otherwise(out)


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def definition(text: Column, most: int = 2000) -> Column:
    """E14."""
    flat = collapse(text)
    return F.when(F.length(flat) > most, F.concat(F.substring(flat, 1, most), F.lit(" ..."))).otherwise(flat)


def summary(text: Column, most: int = 120) -> Column:
    """E23."""
    flat = collapse(text)
    return F.when(F.length(flat) > most, F.concat(F.rtrim(F.substring(flat, 1, most - 1)), F.lit("…"))).otherwise(flat)


def signature(text: Column) -> Column:
    """What stands before the body."""
    return collapse(F.split_part(text, F.lit("{"), F.lit(1)))


def numbered(text: Column, first: Column) -> Column:
    """Every line with its number in front."""
    lines = F.split(F.regexp_replace(text, "\n$", ""), "\n")
    width = F.length((first + F.size(lines) - 1).cast("string"))
    return F.array_join(
        F.transform(lines, lambda line, i: F.concat(F.lpad((first + i).cast("string"), width, F.lit(" ")), F.lit(" | "), line)),
        "\n",
    )


def single_line(text: Column) -> Column:
    """No control characters, no runs of blanks."""
    return collapse(F.regexp_replace(text, r"[\x00-\x1f\x7f]", " "))


def calls(body: Column) -> Column:
    """Sorted names that stand before a parenthesis, without keywords."""
    names = F.regexp_extract_all(body, F.lit(rf"\b({IDENTIFIER})\s*\("), F.lit(1))
    return F.array_sort(F.array_except(F.array_distinct(names), F.array(*map(F.lit, KEYWORDS))))


def fragments(text: Column) -> Column:
    """Lower-case words of a path or name, cut at separators and camel case, and its path parts."""
    low = F.lower(text)
    words = F.filter(F.split(low, "[^a-z0-9]+"), lambda w: w != "")
    humps = F.transform(F.regexp_extract_all(text, F.lit(f"({CAMEL})"), F.lit(1)), F.lower)
    parts = F.filter(F.split(low, "/"), lambda p: p != "")
    return F.array_union(F.array_union(words, humps), parts)


def token_estimate(text: Column) -> Column:
    """E25."""
    return F.greatest(F.lit(1), F.ceil(F.length(text) / 4)).cast("long")


def html_safe(json: Column) -> Column:
    """JSON that can stand inside a script element."""
    for raw, code in (("&", "\\u0026"), ("<", "\\u003c"), (">", "\\u003e"), (" ", "\\u2028"), (" ", "\\u2029")):
        json = F.replace(json, F.lit(raw), F.lit(code))
    return json


def location(path: Column, line: Column, column: Column) -> Column:
    """E36."""
    part = lambda c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(":"), c)).otherwise("")
    return F.concat(F.when(F.coalesce(path, F.lit("")) == "", "?").otherwise(path), part(line), part(column))


def safe_link(path: Column) -> Column:
    """Whether a path can be linked to from a report beside it."""
    return F.coalesce(
        path.rlike(r"^[A-Za-z0-9._-]+(/[A-Za-z0-9._-]+)*$") & ~path.rlike(r"(^|/)\.{1,2}(/|$)"), F.lit(False)
    )


def without_userinfo(url: Column) -> Column:
    """E38."""
    return F.regexp_replace(F.trim(url), r"^([A-Za-z][A-Za-z0-9+.-]*://)[^/?#@]*@", "$1")


def duration(start: Column, end: Column) -> Column:
    """Seconds between two ISO times; null where one is missing or they are reversed."""
    seconds = F.unix_timestamp(F.try_to_timestamp(end)) - F.unix_timestamp(F.try_to_timestamp(start))
    return F.when(seconds >= 0, seconds)
