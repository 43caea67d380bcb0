"""C sources as tables of tokens: a file of any size is cut into blocks that many tasks work on.

What a byte means depends on all bytes before it: whether it stands in a comment, a literal or code. The lexer
is therefore an automaton of few states (``STEP``), and a block is worked on for all states it could begin in,
which gives the block's map from states to states. Composing the maps of a file's blocks in order tells the
state each block begins in; then every block is masked by itself. Line numbers, conditional arms and brace
depths are prefix sums over small tables of marks.

Raw string literals end at a fence of their own, which no finite automaton knows: a file that has one is
one block, as large as it is.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lintlake.operators.ordering import keep, running_max, running_sum

BLOCK_BYTES = 1 << 16
#: Bytes that are stepped through for all states at once, beside as many others as a block has.
CHUNK = 256
(CODE, WORD, NUMBER, TICK, SLASH, LINE, LINE_BACK, LINE_RETURN, BLOCK, STAR, STRING, STRING_BACK, CHAR, CHAR_BACK) = range(14)
STATES = 14
RAW = r'(?<![A-Za-z0-9_])(?:u8|u|U|L)?R"'
FILE = ("run_id", "path")


def _steps() -> np.ndarray:
    """STEP[state, byte]: the state after a byte."""
    step = np.zeros((STATES, 256), np.uint8)
    for byte in range(256):
        c = chr(byte)
        wordish, digit = bool(re.match(r"[\w.]", c)), bool(re.match(r"\d", c))
        code = {"/": SLASH, '"': STRING, "'": CHAR}.get(c, WORD if wordish else CODE)
        step[CODE, byte] = step[SLASH, byte] = NUMBER if digit else code
        step[WORD, byte] = code
        step[NUMBER, byte] = TICK if c == "'" else NUMBER if wordish else code
        step[LINE, byte] = {"\n": CODE, "\\": LINE_BACK}.get(c, LINE)
        step[LINE_BACK, byte] = {"\r": LINE_RETURN, "\\": LINE_BACK}.get(c, LINE)
        step[LINE_RETURN, byte] = {"\\": LINE_BACK}.get(c, LINE)
        step[BLOCK, byte] = STAR if c == "*" else BLOCK
        step[STAR, byte] = {"*": STAR, "/": CODE}.get(c, BLOCK)
        step[STRING, byte] = {'"': CODE, "\\": STRING_BACK, "\n": CODE}.get(c, STRING)
        step[CHAR, byte] = {"'": WORD, "\\": CHAR_BACK, "\n": CODE}.get(c, CHAR)
        step[STRING_BACK, byte], step[CHAR_BACK, byte] = STRING, CHAR
        # a tick in a number belongs to it only before a further digit or letter, else it opens a literal
        step[TICK, byte] = NUMBER if wordish and c != "." else step[CHAR, byte]
    step[SLASH, ord("/")], step[SLASH, ord("*")] = LINE, BLOCK
    return step


STEP = _steps()
_COMMENT = np.isin(np.arange(STATES), [LINE, LINE_BACK, LINE_RETURN, BLOCK, STAR])
_LITERAL = np.isin(np.arange(STATES), [STRING, STRING_BACK, CHAR, CHAR_BACK])
_CODE = np.isin(np.arange(STATES), [CODE, WORD, NUMBER, SLASH])


#: STEP by byte and then state, with one more symbol, of padding, which changes no state.
_PAD = 256
_STEP_BY_BYTE = np.concatenate((STEP.T, np.arange(STATES, dtype=np.uint8)[None])).ravel()


class _Group:
    """Blocks laid out in chunks of ``CHUNK`` bytes, the last of each padded, that are stepped through together."""

    def __init__(self, datas: list[bytes]):
        self.sizes = np.array([len(d) for d in datas], np.int64)
        self.counts = -(-self.sizes // CHUNK)
        self.first = np.cumsum(self.counts) - self.counts
        raw = np.full((int(self.counts.sum()), CHUNK), _PAD, np.uint16)
        flat = raw.ravel()
        for at, data in zip((self.first * CHUNK).tolist(), datas, strict=True):
            flat[at : at + len(data)] = np.frombuffer(data, np.uint8)
        self.raw = flat
        self.columns = raw.T.astype(np.int32) * STATES
        self.steps = int(min(CHUNK, self.sizes.max(initial=0)))

    def chunk_maps(self) -> np.ndarray:
        """(states, chunks): the state after each chunk for every state before it."""
        state = np.repeat(np.arange(STATES, dtype=np.uint8)[:, None], self.columns.shape[1], axis=1)
        for column in self.columns[: self.steps]:
            state = _STEP_BY_BYTE[column + state]
        return state

    def along(self, maps: np.ndarray, state: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The n-th chunks of all blocks that have one, and the blocks they are of, for every n."""
        for n in range(int(self.counts.max(initial=0))):
            own = np.flatnonzero(self.counts > n)
            chunks = self.first[own] + n
            yield own, chunks
            state[own] = np.take_along_axis(maps.T[chunks], state[own].astype(np.intp).reshape(len(own), -1), 1).reshape(state[own].shape)

    def maps(self) -> np.ndarray:
        """(blocks, states): the state after each block for every state before it."""
        out = np.repeat(np.arange(STATES, dtype=np.uint8)[None], len(self.sizes), axis=0)
        for _ in self.along(self.chunk_maps(), out):
            pass
        return out

    def states(self, firsts: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """The states before and after each byte of the layout, for the state each block begins in."""
        begins, state = np.zeros(self.columns.shape[1], np.uint8), np.array(firsts, np.uint8)
        for own, chunks in self.along(self.chunk_maps(), state):
            begins[chunks] = state[own]
        out = np.empty((self.columns.shape[1], CHUNK + 1), np.uint8)
        out[:, 0] = begins
        for k, column in enumerate(self.columns):
            out[:, k + 1] = _STEP_BY_BYTE[column + out[:, k]]
        return out[:, :CHUNK].ravel(), out[:, 1:].ravel()


def groups(sizes: list[int], most: int = 1 << 20) -> Iterator[slice]:
    """Neighbouring blocks of up to ``most`` bytes together; a larger one is alone."""
    start, total = 0, 0
    for at, size in enumerate(sizes):
        if at > start and total + size > most:
            yield slice(start, at)
            start, total = at, 0
        total += size
    if start < len(sizes):
        yield slice(start, len(sizes))


def _laid_out(data: bytes) -> int:
    return -(-len(data) // CHUNK) * CHUNK


def block_map(data: np.ndarray) -> np.ndarray:
    """The state after ``data`` for every state before it."""
    return _Group([data.tobytes()]).maps()[0]


def masked_blocks(datas: list[bytes], afters: list[bytes], firsts: list[int]) -> list[tuple[bytes, bool, int]]:
    """Blocks with comments and insides of literals blanked, whether a literal met a line end, the last state."""
    group = _Group(datas)
    raw = group.raw
    before, then = group.states(firsts)
    begin, end = group.first * CHUNK, group.first * CHUNK + group.sizes
    following = np.append(raw[1:], np.uint16(32))
    some = group.sizes > 0
    following[end[some] - 1] = np.array([(a[:1] or b" ")[0] for a in afters], np.uint16)[some]
    opens = _CODE[before] & (then == SLASH) & ((following == ord("/")) | (following == ord("*")))
    blank = _COMMENT[before] | opens | ((before == SLASH) & _COMMENT[then])
    blank |= _LITERAL[before] & ~((then == CODE) | (then == WORD)) | ((before == TICK) & _LITERAL[then])
    broken = np.append(0, np.cumsum((raw == 10) & ((before == STRING) | (before == CHAR) | (before == TICK))))
    out = np.where(blank & (raw != 10), np.uint16(32), raw).astype(np.uint8)
    return [
        (out[b:e].tobytes(), bool(broken[e] > broken[b]), int(then[e - 1]) if e > b else int(first))
        for b, e, first in zip(begin.tolist(), end.tolist(), firsts, strict=True)
    ]


def masked_block(data: bytes, after: bytes, first: int) -> tuple[bytes, bool, int]:
    return masked_blocks([data], [after], [first])[0]


def blocks(files: DataFrame, size: int = BLOCK_BYTES) -> DataFrame:
    """run_id, path, block, data and the byte after it; null and empty contents have no blocks."""
    whole = F.decode("content", "ISO-8859-1").rlike(RAW)
    rows = files.where(F.octet_length("content") > 0).select(*FILE, "content", F.when(whole, F.octet_length("content")).otherwise(F.lit(size)).alias("size"))
    count = F.ceil(F.octet_length("content") / F.col("size")).cast("int")
    cut = rows.select(*FILE, "content", "size", F.explode(F.sequence(F.lit(0), count - 1)).alias("block"))
    at = F.expr("cast(block * size + 1 as int)")
    return cut.select(
        *FILE, "block", (F.col("block") * F.col("size")).cast("long").alias("start"), F.substring("content", at, F.col("size").cast("int")).alias("data"),
        F.substring("content", at + F.col("size").cast("int"), F.lit(1)).alias("after"), (F.col("size") != size).alias("raw"),
    ).repartition(*FILE, "block")


def _maps(batches):
    for batch in batches:
        datas = batch["data"].to_pylist()
        maps = [m.tobytes() for own in groups([_laid_out(d) for d in datas]) for m in _Group(datas[own]).maps()]
        lines = [d.count(b"\n") for d in datas]
        yield batch.select([*FILE, "block"]).append_column("map", pa.array(maps, pa.binary())).append_column("lines", pa.array(lines, pa.int64()))


def _entries(batches):
    """Maps of a file's blocks, in order -> the state and line each block begins in."""
    for batch in batches:
        states, firsts = [], []
        for maps in batch["maps"].to_pylist():
            state, line, own, at = CODE, 1, [], []
            for m in maps:
                own.append(state)
                at.append(line)
                state, line = m["map"][state], line + m["lines"]
            states.append(own)
            firsts.append(at)
        yield batch.select(list(FILE)).append_column("states", pa.array(states, pa.list_(pa.int32()))).append_column("firsts", pa.array(firsts, pa.list_(pa.int64())))


def _masked(batches):
    from lintlake.sources.c_source import masked

    for batch in batches:
        datas, afters, states, raws = (batch[c].to_pylist() for c in ("data", "after", "state", "raw"))
        found: list = [None] * len(datas)
        for at in (i for i, raw in enumerate(raws) if raw):
            text, problems = masked(datas[at].decode("latin-1"))
            last_state = BLOCK if "unterminated block comment" in problems else CODE
            found[at] = text.encode("latin-1"), "unterminated string or character literal" in problems, last_state
        plain = [i for i, raw in enumerate(raws) if not raw]
        for own in groups([_laid_out(datas[i]) for i in plain]):
            some = plain[own]
            for i, row in zip(some, masked_blocks(*([c[i] for i in some] for c in (datas, afters, states))), strict=True):
                found[i] = row
        out, broken, last = zip(*found, strict=True) if found else ([], [], [])
        columns = [pa.array(out, pa.binary()), pa.array(broken, pa.bool_()), pa.array(last, pa.int32())]
        kept = batch.select([*FILE, "block", "start", "first_line"])
        yield pa.RecordBatch.from_arrays([*kept.columns, *columns], [*kept.schema.names, "masked", "broken", "last"])


def lexed(files: DataFrame, size: int = BLOCK_BYTES) -> DataFrame:
    """Masked blocks (run_id, path, block, start, first_line, masked, broken, last) of all ``files``.

    One row of a file holds a few bytes for each of its blocks while their maps are composed; everything
    else is work on single blocks.
    """
    cut = blocks(files, size)
    kinds = {f.name: f.dataType.simpleString() for f in files.schema}
    own = ", ".join(f"{c} {kinds[c]}" for c in FILE)
    maps = cut.select(*FILE, "block", "data").mapInArrow(_maps, f"{own}, block int, map binary, lines long")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("block", "map", "lines"))), lambda m: F.struct(m["map"].alias("map"), m["lines"].alias("lines")))
    entries = maps.groupBy(*FILE).agg(ordered.alias("maps")).mapInArrow(_entries, f"{own}, states array<int>, firsts array<long>")
    begins = entries.select(*FILE, F.posexplode(F.arrays_zip("states", "firsts")).alias("block", "e"))
    begins = begins.select(*FILE, "block", F.col("e.states").alias("state"), F.col("e.firsts").alias("first_line"))
    rows = cut.join(begins, [*FILE, "block"])
    return rows.mapInArrow(_masked, f"{own}, block int, start long, first_line long, masked binary, broken boolean, last int")


def lexical_problems(lexed_blocks: DataFrame) -> DataFrame:
    """Per file whether a block comment or a literal is never closed."""
    last = F.max_by("last", "block")
    open_literal = F.bool_or("broken") | last.isin(STRING, STRING_BACK, CHAR, CHAR_BACK, TICK)
    return lexed_blocks.groupBy(*FILE).agg(last.isin(BLOCK, STAR).alias("open_comment"), open_literal.alias("open_literal"))


def lines(lexed_blocks: DataFrame) -> DataFrame:
    """run_id, path, line, start, text of every line of masked text; lines across blocks are put together."""
    text = F.decode("masked", "ISO-8859-1")
    parts = lexed_blocks.select(*FILE, "start", "first_line", F.posexplode(F.split(text, "\n")).alias("k", "text"), F.size(F.split(text, "\n")).alias("n"))
    length = F.length("text").cast("long") + 1
    before = F.sum(length).over(W.partitionBy(*FILE, "start").orderBy("k").rowsBetween(W.unboundedPreceding, -1))
    rows = parts.select(
        *FILE, (F.col("first_line") + F.col("k")).alias("line"), (F.col("start") + F.coalesce(before, F.lit(0))).alias("start"), "text",
        ((F.col("k") == 0) | (F.col("k") == F.col("n") - 1)).alias("border"),
    )
    border = rows.where("border").groupBy(*FILE, "line").agg(
        F.min("start").alias("start"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "text"))), lambda p: p["text"]), "").alias("text")
    )
    return rows.where("not border").drop("border").unionByName(border)


def sizes(files: DataFrame) -> DataFrame:
    """run_id, path, size in bytes and the line of the last byte."""
    inner = F.decode(F.substring("content", F.lit(1), F.greatest(F.lit(0), F.octet_length("content") - 1)), "ISO-8859-1")
    ends = F.length(inner) - F.length(F.replace(inner, F.lit("\n"), F.lit("")))
    return files.where("content is not null").select(*FILE, F.octet_length("content").cast("long").alias("size"), (ends + 1).cast("long").alias("last_line"))


def directives(line_rows: DataFrame) -> DataFrame:
    """Preprocessor directives with their continued lines: run_id, path, line, last_line, start, end, kind, condition.

    A line continues the one before it where that ends in a backslash; only lines that start a directive,
    end in a backslash or follow such a line are put in order.
    """
    goes_on = F.col("text").rlike(r"\\\r?\z")
    rows = line_rows.select("*", goes_on.alias("goes_on"), F.col("text").rlike(r"\A[ \t\r\f\x0b]*#").alias("opens"))
    ends = rows.where("goes_on").select(*FILE, (F.col("line") + 1).alias("line"), F.lit(True).alias("continues"))
    few = rows.join(ends, [*FILE, "line"], "left").where("opens or goes_on or continues").fillna(False, ["continues"])
    run = F.sum(F.when(F.col("continues"), 0).otherwise(1)).over(W.partitionBy(*FILE).orderBy("line"))
    said = F.struct("line", "start", "text", "opens")
    # a directive begins at the first line of its run that starts one; a line that is continued text starts none
    joined = few.withColumn("run", run).groupBy(*FILE, "run").agg(F.array_sort(F.collect_list(said)).alias("own"))
    first = F.array_min(F.transform(F.filter("own", lambda x: x["opens"]), lambda x: x["line"]))
    joined = joined.withColumn("first", first).where("first is not null")
    own = F.filter("own", lambda x: x["line"] >= F.col("first"))
    joined = joined.select(*FILE, own.alias("own"))
    whole = F.array_join(F.col("own.text"), "\n")
    lead = F.length(F.regexp_extract(whole, r"\A([ \t\r\f\x0b]*)#", 1))
    text = F.substr(whole, lead + 1)
    start = F.col("own")[0]["start"] + lead
    return joined.select(
        *FILE, F.col("own")[0]["line"].alias("line"), F.element_at("own", -1)["line"].alias("last_line"), start.alias("start"),
        (start + F.length(text)).alias("end"), text.alias("text"), F.regexp_extract(text, r"\A#\s*(\w+)", 1).alias("kind"),
        F.regexp_replace(F.regexp_extract(text, r"(?s)\A\S+\s+(.*)\z", 1), r"\A\s+|\s+\z", "").alias("condition"), (lead > 0).alias("indented"),
    )


def arms(directive_rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """Arms of conditionals from sums over a file's directives: no stack, and no file in memory.

    ``sizes`` has run_id, path, size, last_line. The depth of a directive is the number of open conditionals
    before it; an ``#endif`` without one counts for nothing. An arm ends where the next directive of its own
    conditional begins. A conditional inside one that is switched off is off too.
    """
    opens, closes = F.col("kind").isin("if", "ifdef", "ifndef"), F.col("kind") == "endif"
    turns = F.col("kind").isin("elif", "elifdef", "elifndef", "else")
    order = W.partitionBy(*FILE).orderBy("start")
    upto = order.rowsBetween(W.unboundedPreceding, 0)
    rows = directive_rows.drop("last_line").where(opens | closes | turns)
    rows = rows.withColumn("total", F.sum(F.when(opens, 1).when(closes, -1).otherwise(0)).over(upto))
    lifted = F.greatest(F.lit(0), F.max(-F.col("total")).over(upto))
    rows = rows.withColumn("after", F.col("total") + lifted).withColumn("before", F.coalesce(F.lag("after").over(order), F.lit(0)))
    rows = rows.where(opens | (F.col("before") > 0))
    # the depth that a directive stands at: its conditional's own
    rows = rows.withColumn("depth", F.when(opens, F.col("before")).otherwise(F.col("before") - 1))
    level = W.partitionBy(*FILE, "depth").orderBy("start")
    before_stop = F.lead(F.col("line") - F.when(F.col("indented"), 0).otherwise(1)).over(level)
    rows = rows.withColumns({"body_end": F.lead("start").over(level), "line_end": before_stop})
    bare = F.regexp_replace("condition", " ", "")
    off = F.col("kind").isin("if", "elif") & bare.isin("0", "(0)")
    found = rows.where(~closes).withColumn("off", off).join(sizes, list(FILE), "left")
    return found.select(
        *FILE, "kind", "condition", "depth", F.col("start"), F.col("end").alias("body_start"),
        F.coalesce("body_end", "size").alias("body_end"), F.col("line").alias("line_start"), F.coalesce("line_end", "last_line").alias("line_end"), "off",
    )


def switched_off(arm_rows: DataFrame) -> DataFrame:
    """The arms with ``dead``: off themselves or inside an arm that is.

    Arms that are off have a few rows at most per depth; an arm meets those of its own file that begin before
    it, by a running maximum of where they end, for an arm inside another ends before that does.
    """
    upto = W.partitionBy(*FILE).orderBy("start").rowsBetween(W.unboundedPreceding, 0)
    reach = F.max(F.when(F.col("off"), F.col("body_end"))).over(upto)
    return arm_rows.withColumn("dead", F.coalesce(F.col("off") | (F.col("start") < reach), F.lit(False)))


def _marks(batches):
    for batch in batches:
        keys, at, kinds = [], [], []
        for row, (data, start) in enumerate(zip(batch["masked"].to_pylist(), batch["start"].to_pylist(), strict=True)):
            raw = np.frombuffer(data, np.uint8)
            found = np.flatnonzero(np.isin(raw, [ord("{"), ord("}")]))
            keys += [row] * len(found)
            at += (found + start).tolist()
            kinds += raw[found].tolist()
        own = batch.select(list(FILE)).take(pa.array(keys, pa.int64()))
        yield own.append_column("at", pa.array(at, pa.int64())).append_column("delta", pa.array([1 if k == ord("{") else -1 for k in kinds], pa.int64()))


def brace_depths(lexed_blocks: DataFrame, hidden: DataFrame) -> DataFrame:
    """Every brace of code with the number of braces open before it; closing ones too many count for nothing.

    ``hidden`` has spans (run_id, path, start, end) of directives and dead arms. Their ends are events among the
    braces, so that two running sums, dealt by ranges of all files together, tell which braces are hidden and how
    deep the others lie: a file of any size is many tasks.
    """
    kinds = {f.name: f.dataType.simpleString() for f in lexed_blocks.schema}
    own = ", ".join(f"{c} {kinds[c]}" for c in FILE)
    braces = lexed_blocks.select(*FILE, "start", "masked").mapInArrow(_marks, f"{own}, at long, delta long")
    ends = lambda c, d: hidden.where("start < end").select(*FILE, F.col(c).alias("at"), F.lit(0).cast("long").alias("delta"), F.lit(d).cast("long").alias("span"))
    events = braces.withColumn("span", F.lit(0).cast("long")).unionByName(ends("start", 1)).unionByName(ends("end", -1))
    events = events.withColumn("file", F.concat_ws("\0", *FILE))
    place = [F.col("at"), F.col("span") == 0]  # spans begin before and end before a brace at the same place
    shown = running_sum(keep(events, "brace-events"), "file", place, "span", "inside").where("delta <> 0 and inside = 0")
    summed = running_sum(keep(shown.drop("span", "inside"), "braces"), "file", [F.col("at")], "delta", "total")
    summed = summed.withColumn("below", -(F.col("total") + F.col("delta")))
    lifted = running_max(keep(summed, "brace-sums"), "file", [F.col("at")], "below", "most")
    after = F.col("total") + F.col("delta") + F.greatest(F.lit(0), F.col("most"))
    stray = (F.col("delta") < 0) & (F.col("below") == F.col("most")) & (F.col("most") > 0)
    return lifted.select(*FILE, "at", "delta", (after - F.when(stray, 0).otherwise(F.col("delta"))).alias("depth"), stray.alias("stray"))


def top_level(depths: DataFrame) -> DataFrame:
    """Spans of braces that open at depth 0; ``end`` is null where they never close."""
    edge = depths.where("not stray and ((delta > 0 and depth = 0) or (delta < 0 and depth = 1))")
    closing = F.lead("at").over(W.partitionBy(*FILE).orderBy("at"))
    rows = edge.withColumn("end", closing + 1).where("delta > 0")
    return rows.select(*FILE, F.col("at").alias("start"), "end")
