"""Token tables of odd sources against the parser that reads a file as a whole."""

import random
import re

import numpy as np

from lintlake.operators import token_tables as T
from lintlake.sources.c_source import DIRECTIVE, masked, parse

PIECES = [
    "/", "*", "//", "/*", "*/", '"', "'", "\\", "\n", "\r\n", "\\\n", "\\\r\n", "a", "1", "1.5", "1'000", "1'", ".", "x1", "{", "}", " ", "é",
    "0x1f", "'a'", '"s\\"t"', "\xb2", "\t", ";", "\n#if 0\n", "\n#ifdef A\n", "\n  #else\n", "\n#elif (0) // x\n", "\n#endif\n", "\n#define M \\\n y {\n",
]
FILES = "run_id string, path string, content binary"


def odd_texts(n, longest, seed):
    rng = random.Random(seed)
    for _ in range(n):
        text = "".join(rng.choice(PIECES) for _ in range(rng.randrange(1, longest)))
        yield re.sub(T.RAW, 'x"', text)


def test_blocks_cut_anywhere_are_masked_as_the_whole():
    rng = random.Random(1)
    for text in odd_texts(800, 30, 2):
        data, size, state, out, broken = text.encode("latin-1"), rng.choice([1, 2, 3, 7, 300]), T.CODE, b"", False
        for at in range(0, len(data), size):
            part = data[at : at + size]
            shown, problem, last = T.masked_block(part, data[at + size : at + size + 1], state)
            assert T.block_map(np.frombuffer(part, np.uint8))[state] == last
            out, broken, state = out + shown, broken or problem, last
        want, problems = masked(text)
        assert out.decode("latin-1") == want
        assert (state in (T.BLOCK, T.STAR)) == ("unterminated block comment" in problems)
        unclosed = broken or state in (T.STRING, T.STRING_BACK, T.CHAR, T.CHAR_BACK, T.TICK)
        assert unclosed == ("unterminated string or character literal" in problems)


def test_blocks_masked_together_are_those_masked_alone():
    rng = random.Random(5)
    datas = [t.encode("latin-1") * rng.choice([1, 1, 40]) for t in odd_texts(300, 40, 6)] + [b"", b"/" * T.CHUNK, b'"' * (2 * T.CHUNK)]
    firsts, afters = [rng.randrange(T.STATES) for _ in datas], [rng.choice([b"", b"/", b"*", b"x"]) for _ in datas]
    maps = T._Group(datas).maps()
    for data, after, first, row, own in zip(datas, afters, firsts, T.masked_blocks(datas, afters, firsts), maps, strict=True):
        assert row == T.masked_block(data, after, first)
        for state in range(T.STATES):
            last = state
            for byte in data:
                last = T.STEP[last, byte]
            assert own[state] == last
    sizes = [rng.randrange(1, 50) for _ in range(200)] + [500, 1]
    cut = list(T.groups(sizes, 100))
    assert [i for s in cut for i in range(s.start, s.stop)] == list(range(len(sizes)))
    assert all(sum(sizes[s]) <= 100 or s.stop - s.start == 1 for s in cut)
    assert list(T.groups([])) == []


def test_tables_of_odd_files(spark):
    texts = [*odd_texts(60, 60, 3), "", "\n", "#if 1", 'auto s = R"x( " /* )x"; {}', None]
    files = spark.createDataFrame([("r", str(i), None if t is None else bytearray(t.encode("latin-1"))) for i, t in enumerate(texts)], FILES)
    lexed = T.lexed(files, 16).cache()
    read = {i: t for i, t in enumerate(texts) if t}
    parsed = {i: parse(t) for i, t in read.items()}
    whole = {i: "" for i in read}
    for r in sorted(lexed.collect(), key=lambda r: (r["path"], r["block"])):
        whole[int(r["path"])] += bytes(r["masked"]).decode("latin-1")
    assert whole == {i: masked(t)[0] for i, t in read.items()}
    rows = T.lines(lexed).collect()
    for i, text in whole.items():
        own = sorted((r["line"], r["start"], r["text"]) for r in rows if r["path"] == str(i))
        assert [x[2] for x in own] == text.split("\n")
        assert all(text[start : start + len(line)] == line for _, start, line in own)
    found = T.directives(T.lines(lexed)).cache()
    want = {(i, m.start(1), m.end(1)) for i, t in whole.items() for m in DIRECTIVE.finditer(t)}
    assert {(int(r["path"]), r["start"], r["end"]) for r in found.collect()} == want
    arms = T.switched_off(T.arms(found, T.sizes(files))).cache()
    names = ("kind", "condition", "depth", "start", "body_start", "body_end", "line_start", "line_end", "dead")
    shown = {(int(r["path"]), *(r[n] for n in names)) for r in arms.collect()}
    assert shown == {(i, *(a[n] for n in names)) for i, p in parsed.items() for a in p["conditionals"]}
    hidden = found.select("run_id", "path", "start", "end").unionByName(
        arms.where("dead").selectExpr("run_id", "path", "body_start as start", "body_end as end")
    )
    depths = T.brace_depths(lexed, hidden).collect()
    for i, text in whole.items():
        spans = [(r["start"], r["end"]) for r in hidden.where(f"path = '{i}'").collect()] if i % 6 == 0 else None
        if spans is None:
            continue
        depth, own = 0, []
        for at, c in enumerate(text):
            if c in "{}" and not any(s <= at < e for s, e in spans):
                own.append((at, depth, c == "}" and depth == 0))
                depth = max(0, depth + (1 if c == "{" else -1))
        assert sorted((r["at"], r["depth"], r["stray"]) for r in depths if r["path"] == str(i)) == own
