"""Hierarchical multi-length packing of documents into training sequences.

A document's ids are cut into windows of the longest context; what is left over is routed to the
smallest context tier that holds it. Tiers are packed from the longest down, each into windows of its
own size: a window opens with the longest piece of its tier, its gap is filled with the longest pieces
of its own and the shorter tiers that fit, and what still gapes is filled by cutting the shortest piece
that is longer, whose remainder goes back to the tier it then belongs to. So every sequence is full, at
a tier's size, but for the last of a group. Groups of documents of bounded size are packed
independently, and each tier's sequences are dealt to steps that hold equal numbers of tokens. Of ids,
only those left over from whole windows are shuffled.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake.llm import workers
from lintlake.llm.scratch import documents, small_batches
from lintlake.llm.vocab import text_slices, tokenizer_path, word_ids

#: Context sizes, powers of two: a sequence of one of these sizes needs no padding.
TIERS = (2048, 1024, 512, 256)
END_ID = 1
GROUP_DOCS = 4096
STEP_TOKENS = 64 * 2048
#: Bytes of texts cut at once: a slice takes about forty times its bytes in arrays of points, hashes and ids.
SLICE_BYTES = 1 << 20
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, rest binary"
PACKED = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int,"
    " step_group long"
)


def _cut(path: str, context: int):
    """Ids of whole texts, cut into windows of ``context`` and a rest, which alone keeps its ids; one row per piece."""
    width = 4 * context
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches):
        workers.begin("packing")
        ids_of = word_ids(path)
        for batch in batches:
            for first, texts in text_slices(batch["text"], SLICE_BYTES):
                rows, starts, lengths, crcs, totals, rests = [], [], [], [], [], []
                for k, ids in enumerate(ids_of.encode(texts)):
                    ids += end
                    for at in range(0, len(ids), width):
                        piece = ids[at : at + width]
                        rows.append(first + k)
                        starts.append(at // 4)
                        lengths.append(len(piece) // 4)
                        crcs.append(zlib.crc32(piece))
                        totals.append(len(ids) // 4)
                        rests.append(piece if len(piece) < width else None)
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].take(pa.array(rows, pa.int64()))]
                    + [pa.array(x, pa.int64()) for x in (starts, lengths, crcs, totals)]
                    + [pa.array(rests, pa.binary())],
                    ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "rest"],
                )

    return run


class _Waiting:
    """Pieces (position, start, length) by length; of equal lengths the first one put in leaves first."""

    def __init__(self, lengths: list[int]):
        self.of: dict[int, deque[tuple[int, int]]] = {}
        self.sizes: list[int] = []
        for position, length in enumerate(lengths):
            self.put((position, 0, length))

    def put(self, piece: tuple[int, int, int]) -> None:
        position, start, length = piece
        if length not in self.of:
            self.of[length] = deque()
            insort(self.sizes, length)
        self.of[length].append((position, start))

    def _take(self, at: int) -> tuple[int, int, int]:
        length = self.sizes[at]
        piece = (*self.of[length].popleft(), length)
        if not self.of[length]:
            del self.of[length], self.sizes[at]
        return piece

    def longest(self, most: int, over: int = 0) -> tuple[int, int, int] | None:
        """The longest piece of at most ``most``, if that is longer than ``over``."""
        at = bisect_right(self.sizes, most) - 1
        return self._take(at) if at >= 0 and self.sizes[at] > over else None

    def head(self, length: int) -> tuple[int, int, int] | None:
        """The first ``length`` of the shortest piece that is longer; what remains of it waits on."""
        at = bisect_right(self.sizes, length)
        if at == len(self.sizes):
            return None
        position, start, whole = self._take(at)
        self.put((position, start + length, whole - length))
        return position, start, length


def pack_hierarchy(
    lengths: list[int], tiers: tuple[int, ...] = TIERS
) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """Tier and pieces (position in ``lengths``, start, length) of each sequence; all but the last are full."""
    waiting = _Waiting(lengths)
    sequences = []
    sizes = sorted(tiers, reverse=True)
    for tier, lower in zip(sizes, [*sizes[1:], 0], strict=True):
        while piece := waiting.longest(tier, lower):
            window, gap = [piece], tier - piece[2]
            while gap and (piece := waiting.longest(gap) or waiting.head(gap)):
                window.append(piece)
                gap -= piece[2]
            sequences.append((tier, window))
    return sequences


def _steps(tier: int, n: int) -> np.ndarray:
    """The step of each of ``n`` sequences of one tier: as equal in number as can be, STEP_TOKENS at most."""
    steps = max(1, -(-n * tier // STEP_TOKENS))
    return np.arange(n) % steps


def _crc_of(rest: pa.Scalar, start: int, length: int) -> int:
    return zlib.crc32(memoryview(rest.as_buffer())[4 * start : 4 * (start + length)])


def _pack_group(tiers: tuple[int, ...]):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        group = key[0].as_py()
        order = np.lexsort([table[c].fill_null(-1).to_numpy() for c in ("ids_crc32", "start", "doc_tokens", "doc_id")])
        rests = table["rest"]  # most of a group's bytes: they stay where they are, of pieces that are cut one is copied
        table = table.drop_columns("rest").take(pa.array(order))
        lengths, crcs = table["length"].to_pylist(), table["ids_crc32"].to_pylist()
        sequences = pack_hierarchy(lengths, tiers)
        kinds = np.array([tier for tier, _ in sequences])
        steps = np.zeros(len(sequences), np.int64)
        for k, tier in enumerate(sorted(set(kinds.tolist()), reverse=True)):
            steps[kinds == tier] = (k << 24) + _steps(tier, int((kinds == tier).sum()))
        out: list[tuple] = []
        for n, (tier, window) in enumerate(sequences):
            offset = 0
            for position, start, length in window:
                whole = length == lengths[position]
                crc = crcs[position] if whole else _crc_of(rests[int(order[position])], start, length)
                out.append((position, start, length, crc, (group << 32) + n, offset, tier, (group << 32) + steps[n]))
                offset += length
        position, start, *rest = (np.array(c) for c in zip(*out, strict=True))
        base = table.select(["doc_id", "start", "doc_tokens"]).take(pa.array(position))
        names = ("length", "ids_crc32", "sequence_id", "offset", "tier", "step_group")
        columns = {n: pa.array(c, pa.int32() if n == "tier" else pa.int64()) for n, c in zip(names, rest, strict=True)}
        columns |= {"doc_id": base["doc_id"], "doc_tokens": base["doc_tokens"]}
        columns["start"] = pa.array(base["start"].to_numpy() + start)
        return pa.table({c.split()[0]: columns[c.split()[0]] for c in PACKED.split(", ")})

    return run


def pack_tiers(
    spark: SparkSession,
    docs: DataFrame,
    tokenizer: str | None = None,
    tiers: tuple[int, ...] = TIERS,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier, step_group.

    A null or blank text has the end id alone. A null ``doc_id`` is kept as it is; repeated rows are
    packed each for itself, ties by their order in the group. An empty table gives no rows. Further
    columns of ``docs`` are ignored.
    """
    small_batches(spark)
    groups = max(1, -(-docs.count() // GROUP_DOCS))
    path = tokenizer or tokenizer_path("word_bpe_49k.json")
    pieces = docs.select("doc_id", "text").mapInArrow(_cut(path, max(tiers)), PIECES)
    part = F.pmod(F.xxhash64("doc_id", "doc_tokens", "start", "ids_crc32"), F.lit(groups)).cast("long")
    return pieces.withColumn("part", part).groupBy("part").applyInArrow(_pack_group(tiers), PACKED)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_tiers(spark, documents(spark, sf_dir))
