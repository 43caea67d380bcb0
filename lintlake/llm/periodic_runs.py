"""Periodic runs of words: online dyadic square catching.

Words are appended to a ``SquareCatcher``. Whenever a block of 2**k words is complete, that is words
[i * 2**k, (i + 1) * 2**k), a catcher is set over it. Every appended word gives a new suffix of each of these
lengths, and a catcher compares its block with the suffixes that begin 2**k up to 2**(k+1) - 1 words after
it (from one word on in the least blocks). A suffix equal to a block at distance p begins a square of period
p; from there it is extended word by word in both directions, and what squares of one period share becomes
one run. Runs that still reach the last word are open: each append carries them on before it looks for others.

A run of period p and length of at least 3 p holds a whole block of the greatest 2**k up to p together with
the copy of it p words later, so its catcher finds it; n words cost about n comparisons in each of log n
levels, made for all catchers of a level at once. Blocks are compared by 64-bit hashes and every extension
word by word, so that a run is never one of hashes alone.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake.llm import workers
from lintlake.llm.filter_audit import words
from lintlake.llm.hashing import mix, powers
from lintlake.llm.scratch import Plain, documents, small_batches, text_or_empty
from lintlake.llm.vocab import text_slices

#: A run is at least LEAST words long and TIMES its period; the least blocks have LEAST / TIMES words.
LEAST, TIMES = 24, 3
BLOCK = LEAST // TIMES
#: Words appended at once, which bounds what the comparisons of one level hold.
APPENDED = 1 << 16
_U = np.uint64


class SquareCatcher:
    """The runs of a sequence of word numbers that grows by ``append``; ``finish`` returns them."""

    def __init__(self):
        self.n = 0
        self.ids = np.empty(64, np.int64)
        self.sums = np.zeros(65, _U)  # hashes of all prefixes
        self.open: list[tuple[int, int, int]] = []  # (start, end, period) with end == n
        self.found: list[tuple[int, int, int]] = []

    def append(self, ids: np.ndarray) -> None:
        old, self.n = self.n, self.n + len(ids)
        self._store(ids, old)
        known = [(s, e + self._equal_after(e - p, p), p) for s, e, p in self.open]
        self._catch(self._in_least_blocks(old), BLOCK, known)
        level = 2 * BLOCK
        while 2 * level <= self.n:
            self._catch([self._in_blocks(level, old)], level, known)
            level *= 2
        self.open = [r for r in known if r[1] == self.n]
        self.found += [r for r in known if r[1] < self.n and _is_run(r)]

    def finish(self) -> list[tuple[int, int, int]]:
        """(start, length, period) of every run, by start and then period."""
        self.found += [r for r in self.open if _is_run(r)]
        self.open = []
        return sorted((s, e - s, p) for s, e, p in self.found)

    def _store(self, ids: np.ndarray, old: int) -> None:
        if self.n > len(self.ids):
            room = max(self.n, 2 * len(self.ids))
            ids_before, sums_before = self.ids[:old], self.sums[: old + 1]
            self.ids, self.sums = np.empty(room, np.int64), np.empty(room + 1, _U)
            self.ids[:old], self.sums[: old + 1] = ids_before, sums_before
        self.ids[old : self.n] = ids
        values = mix((ids.astype(_U) + _U(1)) * _U(0x9E3779B97F4A7C15))
        up = powers(self.n + 1)[0]
        np.cumsum(np.concatenate((self.sums[old : old + 1], values * up[old : self.n])), out=self.sums[old : self.n + 1])

    def _blocks(self, first: int, last: int, size: int) -> np.ndarray:
        """Hashes of the ``size`` words from each of the positions [first, last) on."""
        down = powers(self.n + 1)[1]
        return (self.sums[first + size : last + size] - self.sums[first:last]) * down[first:last]

    def _in_least_blocks(self, old: int):
        """(starts, distance) for all distances below twice the least size."""
        first = max(0, (old - 3 * BLOCK) // BLOCK * BLOCK)
        if self.n - first <= BLOCK:
            return
        hashes = self._blocks(first, self.n - BLOCK + 1, BLOCK)
        # what stands in for suffixes yet to come may match by chance; an extension that stays short is no match
        ahead = np.concatenate((hashes, np.zeros(2 * BLOCK, _U)))
        windows = sliding_window_view(ahead, 2 * BLOCK)[: len(hashes) : BLOCK]
        at, distances = np.nonzero(windows[:, 1:] == windows[:, :1])
        for p in np.unique(distances + 1).tolist():
            starts = first + BLOCK * at[distances + 1 == p]
            yield starts[starts + p + BLOCK > old], p

    def _in_blocks(self, size: int, old: int):
        """(starts, distances) of matches at distances [size, 2 * size): the windows of all catchers lie side by side."""
        first = max(0, (old - 3 * size) // size * size)
        hashes = self._blocks(first, self.n - size + 1, size)
        own, later = hashes[::size], hashes[size:]
        rows = -(-len(later) // size)
        whole = len(later) // size
        at = np.flatnonzero((later[: whole * size].reshape(whole, size) == own[:whole, None]).ravel())
        if rows > whole:
            at = np.concatenate((at, whole * size + np.flatnonzero(later[whole * size :] == own[whole])))
        starts = first + at // size * size
        distances = size + at % size
        new = starts + distances + size > old
        return starts[new], distances[new]

    def _catch(self, matches, size: int, known: list[tuple[int, int, int]]) -> None:
        """Extend matches of blocks of ``size`` to runs and add them to ``known``.

        A match inside a known run of a period up to ``size`` is one of a multiple of that period, which
        says nothing new; every other one is of a least period. Of matches in one run the first is extended.
        """
        finer = None
        for starts, periods in matches:
            if not len(starts):
                continue
            periods = np.broadcast_to(periods, starts.shape)
            if finer is None or size == BLOCK:
                finer = _reach([r for r in known if r[2] <= size])
            left = ~_covered(finer, starts, starts + periods + size)
            starts, periods = starts[left], periods[left]
            for p in np.unique(periods).tolist():
                own = starts[periods == p]
                own = own[~_covered(_reach([r for r in known if r[2] == p]), own, own + p + size)]
                while len(own):
                    s = int(own[0])
                    after = self._equal_after(s, p)
                    end = s + p + after
                    if after >= size:
                        known.append((s - self._equal_before(s, p), end, p))
                    own = own[max(1, np.searchsorted(own, end - p - size, "right")) :]

    def _equal_after(self, at: int, p: int) -> int:
        """How many words from ``at`` on equal those ``p`` later."""
        count, step = 0, 64
        while True:
            later = self.ids[at + p + count : min(self.n, at + p + count + step)]
            other = np.flatnonzero(later != self.ids[at + count : at + count + len(later)])
            if len(other):
                return count + int(other[0])
            count += len(later)
            if len(later) < step:
                return count
            step *= 2

    def _equal_before(self, at: int, p: int) -> int:
        """How many words before ``at`` equal those ``p`` later."""
        count, step = 0, 64
        while True:
            low = max(0, at - count - step)
            mine = self.ids[low : at - count]
            other = np.flatnonzero(mine != self.ids[low + p : at - count + p])
            if len(other):
                return count + len(mine) - 1 - int(other[-1])
            count += len(mine)
            if len(mine) < step:
                return count
            step *= 2


def _is_run(stretch: tuple[int, int, int]) -> bool:
    start, end, period = stretch
    return end - start >= max(LEAST, TIMES * period)


def _reach(known: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted starts of stretches, and the greatest end of those up to each."""
    table = np.array(sorted(known), np.int64).reshape(-1, 3)
    return table[:, 0], np.maximum.accumulate(table[:, 1]) if len(table) else table[:, 1]


def _covered(reach: tuple[np.ndarray, np.ndarray], starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether some stretch holds [start, end)."""
    begins, furthest = reach
    if not len(begins):
        return np.zeros(len(starts), bool)
    at = np.searchsorted(begins, starts, "right") - 1
    return (at >= 0) & (furthest[at] >= ends)


def runs_of(ids: np.ndarray, appended: int = APPENDED) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of a sequence of numbers."""
    if len(ids) < LEAST:
        return []
    catcher = SquareCatcher()
    for at in range(0, len(ids), appended):
        catcher.append(ids[at : at + appended])
    return catcher.finish()


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of ``n`` words stay if every run is cut down to its first period; a word goes if any run drops it."""
    edges = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        edges[start + period] += 1
        edges[start + length] -= 1
    return np.cumsum(edges)[:n] == 0


def _collapse(columns: list[str]):
    def run(batches):
        workers.begin("periodic-runs")
        for batch in batches:
            for first, texts in text_slices(batch["text"]):
                found, collapsed = [], []
                for text in texts:
                    own = text.split()  # bytes split at the six ASCII blanks, and at nothing else
                    numbers: dict[bytes, int] = {}
                    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in own), np.int64, len(own))
                    runs = runs_of(ids)
                    found.append([{"start": s, "length": m, "period": p} for s, m, p in runs])
                    collapsed.append(b" ".join(compress(own, kept_words(len(own), runs)) if runs else own))
                kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))
                own = batch.select(columns).slice(first, len(texts))
                runs_column = pa.array(found, kind)
                yield own.append_column("runs", runs_column).append_column("collapsed", pa.array(collapsed, pa.binary()).cast(pa.utf8()))

    return run


def collapse(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``runs``, an array of (start, length, period), and ``collapsed``: every run's first period only.

    Words are runs of characters other than ASCII blanks; ``collapsed`` joins those that stay by one space.
    Null, empty and blank texts have no words: no runs, and the empty text. Equal texts have equal runs; a
    null ``doc_id``, repeated rows and further columns, of any name, do no harm. A document is worked on
    by itself, and one of n words takes about 24 n bytes and n log n steps.
    """
    small_batches(docs.sparkSession)
    plain = Plain(docs, text)
    rows = plain.df.withColumnRenamed(text, "text").withColumn("text", text_or_empty())
    names = [n if n != text else "text" for n in plain.names]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    out = rows.mapInArrow(
        _collapse(names), f"{schema}, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    )
    kept = [F.col(n).alias(c) for n, c in zip(names, plain.columns, strict=True)]
    return out.select(*kept, "runs", "collapsed")


def rewritten(docs: DataFrame) -> DataFrame:
    """doc_id and text; in a tenth of all documents the words from some place on repeat those after that place."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    rows = docs.select("doc_id", text_or_empty().alias("text"), h.alias("h"), F.floor(h / 10).alias("g"))
    rows = rows.withColumn("own", F.when(F.col("h") % 10 == 0, words(F.col("text")))).withColumn("n", F.size("own"))
    rows = rows.withColumn("a", (F.col("g") % F.when(F.col("n") > 0, F.col("n"))).cast("int"))
    rows = rows.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    own, a, p, rest = F.col("own"), F.col("a"), F.col("p"), F.col("n") - F.col("a")
    tail = F.slice(F.flatten(F.array_repeat(F.slice(own, a + 1, p), F.ceil(rest / p).cast("int"))), F.lit(1), rest)
    text = F.when(F.col("a").isNotNull(), F.array_join(F.concat(F.slice(own, F.lit(1), a), tail), " ")).otherwise(F.col("text"))
    return rows.select("doc_id", text.alias("text"))


def summary(collapsed: DataFrame) -> DataFrame:
    """Of every document its number of runs, the one of greatest length / period, and digests of all and of the text left."""
    # exact: lengths are compared after multiplying by the other's period; the array is in order of start and period
    best = F.aggregate(
        F.col("runs"), F.col("runs")[0],
        lambda b, r: F.when(r["length"] * b["period"] > b["length"] * r["period"], r).otherwise(b),
    )
    line = lambda r: F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period")))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    found = collapsed.select("doc_id", "runs", "collapsed", F.when(F.size("runs") > 0, best).alias("best"))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *(F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary(collapse(rewritten(documents(spark, sf_dir))))
