"""Near duplicates by HyperMinHash, with exact verification and connected components.

A document's shingles fall into buckets by their hash. A bucket's least hash is stored as a register:
its number of leading zeros and a few mantissa bits; empty buckets borrow another's register, each in
its own fixed order. Bands of registers find candidates, whose Jaccard similarity is estimated from
equal registers, corrected for accidental ones. Candidates above a margin below the threshold are
verified on their full shingle sets, and links are closed to components.

Documents with equal sets are one class and are compared once. Neither buckets nor candidate groups
are ever expanded to pairs: inside a task a search from document to document looks only at those not
yet reached, so a dense group costs little more than its size, and returns a spanning forest. Groups
too large for a task are split into tiles of two blocks each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake.llm import workers
from lintlake.llm.components import components
from lintlake.llm.hashing import mix, sequence_hashes, words_of
from lintlake.llm.scratch import Plain, broadcast_if_small, documents, keep, small_batches, text_or_empty
from lintlake.llm.vocab import text_slices

WORDS = 5
#: Links are pairs with 100 * intersection >= PERCENT * union.
PERCENT = 75
REGISTERS = 128
MANTISSA_BITS = 10
BAND_ROWS = 4
#: 4.5 standard deviations of the estimate below 0.75 with 128 registers.
LEAST_ESTIMATE = 0.58
#: Sets of up to so many shingles are signed by hashes of their own for every bucket; so are those that a
#: set of that size can be linked with.
SMALL = 64
#: Chance that two different least hashes leave the same register.
COLLISION = 0.4 / (1 << MANTISSA_BITS)
BUCKET_TILE = 1024
TILE_SHINGLES = 400_000
_U = np.uint64
_BITS = REGISTERS.bit_length() - 1
_EDGES = np.arange(REGISTERS, dtype=_U) << _U(64 - _BITS)
_SALTS = mix(np.arange(1, REGISTERS + 1, dtype=_U))
_DONORS = np.array([np.random.default_rng([7, i]).permutation(REGISTERS) for i in range(REGISTERS)])
SIGNATURES = "doc_id long, n_shingles long, set_digest binary, registers binary, small_registers binary"


def shingle_sets(texts: list[bytes]) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text; fewer than WORDS words make one shingle."""
    hashes, counts = words_of(texts)
    windows = sequence_hashes(hashes, WORDS)
    at = 0
    for n in counts:
        if n >= WORDS:
            yield np.unique(windows[at : at + n - WORDS + 1])
        else:
            yield sequence_hashes(hashes[at : at + n], n) if n else hashes[:0]
        at += n


def _compressed(least: np.ndarray) -> np.ndarray:
    """Leading zeros and mantissa bits of 64-bit least hashes."""
    zeros = 53 - np.frexp((least >> _U(11)).astype(np.float64))[1]
    mantissa = (least << (zeros + 1).astype(_U)) >> _U(64 - MANTISSA_BITS)
    return (zeros.astype(np.uint16) << np.uint16(MANTISSA_BITS)) | mantissa.astype(np.uint16)


def small_registers(sets: list[np.ndarray]) -> np.ndarray:
    """As ``registers``, but every bucket has a hash of its own and sees the whole set.

    In few shingles, two that fall into one bucket would hide one another; here none does.
    """
    out = np.empty((len(sets), REGISTERS), np.uint16)
    for at in range(0, len(sets), 256):
        part = sets[at : at + 256]
        sizes = np.array([len(s) for s in part])
        hashes = mix(np.concatenate(part)[:, None] ^ _SALTS)
        out[at : at + len(part)] = _compressed(np.minimum.reduceat(hashes, np.cumsum(sizes) - sizes, axis=0))
    return out


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """One row of registers for each non-empty sorted set."""
    least = np.zeros((len(sets), REGISTERS), _U)
    filled = np.zeros((len(sets), REGISTERS), bool)
    for k, s in enumerate(sets):
        first = np.searchsorted(s, _EDGES)
        have = first < len(s)
        found = s[np.minimum(first, len(s) - 1)]
        have &= (found >> _U(64 - _BITS)) == np.arange(REGISTERS, dtype=_U)
        least[k], filled[k] = found << _U(_BITS), have
    out = _compressed(least)
    row, col = np.nonzero(~filled)
    for step in range(REGISTERS):
        if not len(row):
            break
        donor = _DONORS[col, step]
        ok = filled[row, donor]
        out[row[ok], col[ok]] = out[row[ok], donor[ok]]
        row, col = row[~ok], col[~ok]
    return out


def _sign(batches):
    workers.begin("near dedup")
    for batch in batches:
        for first, texts in text_slices(batch["text"], 2 << 20):
            sets = list(shingle_sets(texts))
            signs: list[list[bytes | None]] = [[None] * len(sets), [None] * len(sets)]
            kinds = ((registers, SMALL + 1, np.inf), (small_registers, 1, SMALL * 100 / PERCENT))
            for kind, (sign, least, most) in enumerate(kinds):
                some = [k for k, s in enumerate(sets) if least <= len(s) <= most]
                for k, row in zip(some, sign([sets[k] for k in some]), strict=True):
                    signs[kind][k] = row.astype("<u2").tobytes()
            digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"].slice(first, len(texts)),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(digests, pa.binary()),
                    pa.array(signs[0], pa.binary()),
                    pa.array(signs[1], pa.binary()),
                ],
                ["doc_id", "n_shingles", "set_digest", "registers", "small_registers"],
            )


def spanning_forest(n: int, linked: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """Edges that connect what is connected; ``linked(i, others)`` says which of ``others`` link to i."""
    edges: list[tuple[int, int]] = []
    left = np.arange(n)
    while len(left) > 1:
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            i = queue.pop()
            hit = linked(i, left)
            edges += [(i, int(j)) for j in left[hit]]
            queue += left[hit].tolist()
            left = left[~hit]
    return edges


def _runs(batches, keys: list[str], columns: list[str]):
    """Groups of neighbouring rows with equal keys, across batches: lists of columns as Python values."""
    current, held = None, None
    for batch in batches:
        if not len(batch):
            continue
        marks = list(zip(*(batch[k].to_pylist() for k in keys), strict=True))
        values = [batch[c].to_pylist() for c in columns]
        at = 0
        while at < len(marks):
            end = at
            while end < len(marks) and marks[end] == marks[at]:
                end += 1
            part = [v[at:end] for v in values]
            if marks[at] == current:
                held = [a + b for a, b in zip(held, part, strict=True)]
            else:
                if held is not None:
                    yield held
                current, held = marks[at], part
            at = end
    if held is not None:
        yield held


def _edge_batches(edges: Iterator[tuple[int, int]]):
    rows: list[tuple[int, int]] = []
    pack = lambda: pa.RecordBatch.from_arrays(
        [pa.array([r[i] for r in rows], pa.int64()) for i in (0, 1)], ["a", "b"]
    )
    for edge in edges:
        rows.append(edge)
        if len(rows) >= 50_000:
            yield pack()
            rows = []
    yield pack()


def _estimated(least: float):
    def run(batches):
        def edges():
            for ids, signs in _runs(batches, ["key", "i", "j"], ["doc_id", "registers"]):
                rows = np.frombuffer(b"".join(signs), "<u2").reshape(len(ids), REGISTERS)

                def linked(i, others, rows=rows):
                    equal = (rows[others] == rows[i]).mean(axis=1)
                    return (equal - COLLISION) / (1 - COLLISION) >= least

                for a, b in spanning_forest(len(ids), linked):
                    yield ids[a], ids[b]

        seen: set[tuple[int, int]] = set()

        def fresh():
            for edge in edges():
                if edge not in seen:
                    if len(seen) > 200_000:
                        seen.clear()
                    seen.add(edge)
                    yield edge

        yield from _edge_batches(fresh())

    return run


def _sets(batches):
    workers.begin("near dedup")
    for batch in batches:
        for first, texts in text_slices(batch["text"], 2 << 20):
            sets = [s.tobytes() for s in shingle_sets(texts)]
            part = batch.slice(first, len(texts)).select(["doc_id", "group", "blocks"])
            yield part.append_column("shingles", pa.array(sets, pa.binary()))


def _verified(percent: int):
    def run(batches):
        def edges():
            for ids, packed in _runs(batches, ["group", "i", "j"], ["doc_id", "shingles"]):
                sets = [np.frombuffer(p, _U) for p in packed]
                sizes = np.array([len(s) for s in sets])

                def linked(i, others, sets=sets, sizes=sizes):
                    joined = np.concatenate([sets[j] for j in others])
                    at = np.minimum(np.searchsorted(sets[i], joined), sizes[i] - 1)
                    starts = np.cumsum(sizes[others]) - sizes[others]
                    both = np.add.reduceat((sets[i][at] == joined).astype(np.int64), starts)
                    return 100 * both >= percent * (sizes[i] + sizes[others] - both)

                for a, b in spanning_forest(len(ids), linked):
                    yield ids[a], ids[b]

        yield from _edge_batches(edges())

    return run


def _tiles(rows: DataFrame, key: str, payload: str) -> DataFrame:
    """Rows of each group of ``blocks`` blocks, dealt to all pairs of blocks and sorted by tile.

    A group of one block is one tile; in others every two blocks meet, which covers each block too.
    """
    block = F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int")))
    dealt = rows.select(key, "doc_id", payload, block.alias("own"), other.alias("other"), "blocks")
    dealt = dealt.where("blocks = 1 or own <> other").select(
        key, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "doc_id", payload
    )
    return dealt.repartition(key, "i", "j").sortWithinPartitions(key, "i", "j")


def _band_key(band: Column) -> Column:
    part = F.substring(F.col("registers"), band * (2 * BAND_ROWS) + 1, F.lit(2 * BAND_ROWS))
    return F.xxhash64("kind", band, part)


def candidate_edges(classes: DataFrame, least: float = LEAST_ESTIMATE) -> DataFrame:
    """Edges (a, b) that connect all candidates with one another: same band, estimate at least ``least``."""
    keys = F.transform(F.sequence(F.lit(0), F.lit(REGISTERS // BAND_ROWS - 1)), _band_key)
    signs = classes.select("doc_id", F.posexplode(F.array("registers", "small_registers")).alias("kind", "registers"))
    signs = signs.where("registers is not null")
    bands = signs.select("doc_id", "kind", F.explode(keys).alias("key"))
    busy = (
        bands.groupBy("key")
        .agg(F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select("key", F.ceil(F.col("n") / BUCKET_TILE).alias("blocks"))
    )
    members = bands.join(busy, "key").join(signs, ["doc_id", "kind"])
    return _tiles(members, "key", "registers").mapInArrow(_estimated(least), "a long, b long")


def near_duplicates(
    spark: SparkSession, docs: DataFrame, percent: int = PERCENT, least: float = LEAST_ESTIMATE
) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    Texts without words (null, empty, blank) have no shingles and link with nothing. Rows with one
    ``doc_id`` are one node of the links; rows without it link with nothing and have no component. An empty
    table gives no rows; further columns are ignored.
    """
    small_batches(spark)
    signed = keep(docs.select("doc_id", "text").mapInArrow(_sign, SIGNATURES), "signatures")
    some = signed.where("doc_id is not null and n_shingles > 0")
    classes = keep(
        some.groupBy("set_digest").agg(
            F.min("doc_id").alias("doc_id"),
            F.first("registers").alias("registers"),
            F.first("small_registers").alias("small_registers"),
            F.first("n_shingles").alias("n_shingles"),
        ),
        "set-classes",
    )
    near = components(candidate_edges(classes, least))
    nodes = near.unionByName(near.select(F.col("component").alias("node"), "component").distinct())
    members = nodes.join(classes, F.col("node") == F.col("doc_id")).select("doc_id", "component", "n_shingles")
    groups = members.groupBy("component").agg(F.ceil(F.sum("n_shingles") / TILE_SHINGLES).alias("blocks"))
    members = keep(
        members.join(groups, "component").select("doc_id", F.col("component").alias("group"), "blocks").distinct(),
        "candidates",
    )
    texts = docs.select("doc_id", text_or_empty().alias("text")).join(broadcast_if_small(members, 32), "doc_id")
    sets = texts.mapInArrow(_sets, "doc_id long, group long, blocks long, shingles binary").where(
        F.octet_length("shingles") > 0
    )
    links = _tiles(sets, "group", "shingles").mapInArrow(_verified(percent), "a long, b long")
    root = keep(components(links), "components")
    rep = classes.select("set_digest", F.col("doc_id").alias("rep"))
    out = signed.join(rep, "set_digest", "left").join(root, F.col("rep") == F.col("node"), "left")
    component = F.coalesce("component", "rep", "doc_id")
    return out.select(
        "doc_id",
        "n_shingles",
        F.when(F.col("doc_id").isNotNull(), component).alias("component_id"),
        (F.col("doc_id").isNull() | (component == F.col("doc_id"))).alias("kept"),
    )


def deduplicate(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay: those of each component's smallest identifier, columns as they were.

    Rows without words or without ``doc_id`` stay, and so do all rows that repeat an identifier that stays.
    """
    plain = Plain(docs, "doc_id", "text")
    gone = keep(near_duplicates(spark, plain.df).where("not kept").select("doc_id").distinct(), "near-gone")
    gone = gone.select(F.col("doc_id").alias("gone_id"))
    return plain.restored(plain.df.join(broadcast_if_small(gone, 16), F.col("doc_id") == F.col("gone_id"), "left_anti"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, documents(spark, sf_dir))
