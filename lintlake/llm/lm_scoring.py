"""Language-model scores from a log-frequency Bloom filter.

Counts of words and of neighbouring word pairs are quantised on a logarithmic scale; an n-gram of
level q is put into a Bloom filter q times, together with each level up to q. Its count is read back
by probing level after level until one is missing. The filter grows with the corpus, so it is never
sent whole to anyone: it is built in shards by the hash of the n-gram, one group of bounded size per
shard, and each shard is copied to the workers that probe it, one worker for every so many chunks of
text. Texts are dealt to chunks of bounded size; a chunk asks each shard once for its distinct n-grams
there, and the levels come back to the chunk, which scores its texts. This is the only path, at every
size, and every text is scored by the same probes.

The model interpolates pairs with words: P(w | h) = (1 - a) P(w) + a c(hw) / (c(h) + f V), where f is
the filter's rate of false positives and V the number of words: f V is the false mass that a history
is expected to gather. The weight a is a constant times c(h) / (c(h) + f V), so histories too rare to
stand out from false ones say little. P(w) is normalised by the mass of the quantised counts; a pair
counts as the least count of its level and a history as the greatest of its own, so the probabilities
of all words sum to one at most, but for false positives.

Exact word counts for the base score do not come from the filter: the shard's sorted count table is
asked beside it.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake.llm import workers
from lintlake.llm.hashing import mix, sequence_hashes, words_of
from lintlake.llm.scratch import crc_mod, documents, keep, release, small_batches
from lintlake.llm.vocab import text_slices

#: Base of the count scale, bits per filter entry, probes per membership test.
LOG_BASE = 1.5
BITS_PER_ENTRY = 10
PROBES = 7
PAIR_WEIGHT = 0.5
#: Bytes of text behind one shard of the filter, in one chunk, and in a slice that is counted at once.
SHARD_BYTES = 16 << 20
CHUNK_BYTES = 8 << 20
SLICE_BYTES = 8 << 20
#: Chunks that ask one copy of a shard.
CHUNKS_PER_COPY = 20_000
_U = np.uint64
#: Stands for the end of a text, and as a history for its beginning.
EDGE = mix(np.array([0x9E3779B9], _U))[0]
_HALF = _U(32)
#: Lowest bits of an n-gram's hash that do not count, by its order: pairs, many more, are told apart by 48 bits.
DROPPED = {1: 0, 2: 16}


def edged(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts with EDGE before each text and after the last; and words + 1 per text."""
    hashes, counts = words_of(texts)
    sizes = counts + 1
    out = np.full(int(sizes.sum()) + 1, EDGE, _U)
    starts = np.cumsum(sizes) - sizes
    place = np.ones(len(out), bool)
    place[starts] = False
    place[-1] = False
    out[place] = hashes
    return out, sizes


def pairs_of(words: np.ndarray) -> np.ndarray:
    drop = _U(DROPPED[2])
    return sequence_hashes(words, 2) >> drop << drop


def pack(grams: np.ndarray, drop: int) -> bytes:
    """Sorted n-grams without their ``drop`` lowest bits: the first, then differences in as many bytes as these need."""
    if not len(grams):
        return b""
    grams = grams >> _U(drop)
    steps = np.diff(grams)
    width = max(1, (int(steps.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + grams[:1].tobytes() + steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpack(packed: bytes, drop: int) -> np.ndarray:
    if not packed:
        return np.empty(0, _U)
    width = packed[0]
    wide = np.zeros(((len(packed) - 9) // width + 1, 8), np.uint8)
    wide[1:, :width] = np.frombuffer(packed, np.uint8, offset=9).reshape(-1, width)
    grams = wide.view("<u8").ravel()
    grams[0] = np.frombuffer(packed[1:9], "<u8")[0]
    return np.cumsum(grams, dtype=_U) << _U(drop)


def shard_of(grams: np.ndarray, shards: int) -> np.ndarray:
    return ((grams >> _HALF) * _U(shards)) >> _HALF


def _sharded(grams: np.ndarray, shards: int):
    """(shard, slice) of each non-empty shard of sorted ``grams``."""
    at = shard_of(grams, shards)
    cuts = np.flatnonzero(np.diff(at)) + 1
    for a, b in zip(np.concatenate(([0], cuts)), np.concatenate((cuts, [len(grams)])), strict=True):
        if b > a:
            yield int(at[a]), slice(int(a), int(b))


def _count_grams(shards: int):
    def run(batches):
        workers.begin("lm")
        for batch in batches:
            for _, texts in text_slices(batch["text"], SLICE_BYTES):
                words, _ = edged(texts)
                rows = []
                for order, grams in ((1, words[1:]), (2, pairs_of(words))):
                    found, counts = np.unique(grams, return_counts=True)
                    counts = counts.astype("<u4")
                    for shard, part in _sharded(found, shards):
                        rows.append((order, shard, pack(found[part], DROPPED[order]), counts[part].tobytes()))
                kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)],
                    ["gram_order", "shard", "grams", "counts"],
                )

    return run


def level_of(counts: np.ndarray) -> np.ndarray:
    """1 + floor(log of the count), by the limits below so that it is exact."""
    return np.searchsorted(_LIMITS, counts, "right")


_LIMITS = np.unique(np.ceil(LOG_BASE ** np.arange(110) - 1e-9))[:64]
#: The least, the greatest and the middle count of each level; level 0 stands for no count.
LEAST = np.concatenate(([0.0], _LIMITS))
GREATEST = np.concatenate(([0.0], _LIMITS[1:] - 1, [_LIMITS[-1] * LOG_BASE]))
MIDDLE = (LEAST + GREATEST) / 2


def _level_salt(level: int) -> np.uint64:
    return _U(0xD1B54A32D192ED03 * level % (1 << 64))


def _positions(grams: np.ndarray, level: int, bits: int):
    """Bit positions of each probe, one array after the other."""
    h = mix(grams + _level_salt(level))
    low, step = h & _U(0xFFFFFFFF), (h >> _HALF) | _U(1)
    for i in range(PROBES):
        yield (((low + _U(i) * step) & _U(0xFFFFFFFF)) * _U(bits)) >> _HALF


def build_bits(grams: np.ndarray, counts: np.ndarray, bits_per_entry: int = BITS_PER_ENTRY) -> np.ndarray:
    """The filter of one shard, as packed bits."""
    levels = level_of(counts)
    n_bits = -(-int(levels.sum()) * bits_per_entry // 8) * 8 + 64
    cells = np.zeros(n_bits, bool)
    for level in range(1, int(levels.max()) + 1):
        for at in _positions(grams[levels >= level], level, n_bits):
            cells[at.astype(np.int64)] = True
    return np.packbits(cells, bitorder="little")


TABLES = "shard int, words binary, word_counts binary, n_words long, total long, mass double, bits binary, fill double"


def _build_shard(bits_per_entry: int):
    return lambda table: _shard_tables(table, bits_per_entry)


def _shard_tables(table: pa.Table, bits_per_entry: int) -> pa.Table:
    def summed(order: int) -> tuple[np.ndarray, np.ndarray]:
        rows = table.filter(pc.equal(table["gram_order"], order))
        grams = np.concatenate([unpack(g.as_py(), DROPPED[order]) for g in rows["grams"]] or [np.empty(0, _U)])
        counts = np.frombuffer(b"".join(rows["counts"].to_pylist()), "<u4").astype(np.int64)
        order_ = np.argsort(grams, kind="stable")
        grams, counts = grams[order_], counts[order_]
        first = np.flatnonzero(np.concatenate(([True], grams[1:] != grams[:-1]))) if len(grams) else order_
        return grams[first], np.add.reduceat(counts, first) if len(first) else counts

    words, word_counts = summed(1)
    pairs, pair_counts = summed(2)
    bits = build_bits(np.concatenate((words, pairs)), np.concatenate((word_counts, pair_counts)), bits_per_entry)
    return pa.table(
        {
            "shard": pa.array([table["shard"][0].as_py()], pa.int32()),
            "words": [pack(words, 0)],
            "word_counts": [word_counts.astype("<u8").tobytes()],
            "n_words": [len(words)],
            "total": [int(word_counts.sum())],
            "mass": [float(MIDDLE[level_of(word_counts)].sum())],
            "bits": [bits.tobytes()],
            "fill": [float(np.unpackbits(bits).mean())],
        }
    )


class Shard:
    """One shard of the filter: levels of its n-grams by repeated membership probes."""

    def __init__(self, bits: bytes):
        self.data = np.frombuffer(bits, np.uint8)
        self.n_bits = _U(8 * len(bits))

    def holds(self, grams: np.ndarray, level: int) -> np.ndarray:
        left = np.arange(len(grams) if self.n_bits else 0)
        h = mix(grams + _level_salt(level))
        for i in range(PROBES):
            x = h[left]
            at = (((x & _U(0xFFFFFFFF)) + _U(i) * ((x >> _HALF) | _U(1))) & _U(0xFFFFFFFF)) * self.n_bits >> _HALF
            at = at.astype(np.int64)
            left = left[(self.data[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1]
        out = np.zeros(len(grams), bool)
        out[left] = True
        return out

    def levels(self, grams: np.ndarray) -> np.ndarray:
        """Probes level after level, each n-gram until its first missing one."""
        out = np.zeros(len(grams), np.uint8)
        left = np.arange(len(grams))
        for level in range(1, len(MIDDLE)):
            left = left[self.holds(grams[left], level)]
            if not len(left):
                break
            out[left] = level
        return out


class Model:
    """What scoring needs besides levels: training tokens, distinct words, quantised mass, false positives."""

    def __init__(self, total: int, n_words: int, mass: float, false_rate: float, pair_weight: float = PAIR_WEIGHT):
        self.total, self.n_words, self.mass, self.pair_weight = total, n_words, mass, pair_weight
        self.false_mass = false_rate * n_words

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 0.1) / (self.total + 0.1 * (self.n_words + 1)))

    def probability(self, word: np.ndarray, history: np.ndarray, pair: np.ndarray) -> np.ndarray:
        """From levels, P(word | history)."""
        alone = (MIDDLE[word] + 0.1) / (self.mass + 0.1 * (self.n_words + 1))
        seen = np.maximum(GREATEST[history] + self.false_mass, 1.0)
        weight = self.pair_weight * GREATEST[history] / seen
        follows = np.where((word > 0) & (history > 0), LEAST[pair], 0.0) / seen
        return np.minimum((1 - weight) * alone + weight * np.minimum(follows, 1.0), 1.0)


ASKED = "chunk long, shard int, part int, words binary, pairs binary"
ANSWERS = "chunk long, shard int, counts binary, word_levels binary, pair_levels binary"
SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _texts(table: pa.Table) -> list[bytes]:
    return table["text"].cast(pa.large_string()).fill_null("").cast(pa.large_binary()).to_pylist()


def _ask(shards: int, parts: int):
    """The distinct n-grams of a chunk, one row for each shard that holds some of them."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        chunk = key[0].as_py()
        words, _ = edged(_texts(table))
        asked: dict[int, list[bytes]] = {}
        for order, grams in ((1, words), (2, pairs_of(words))):
            distinct = np.unique(grams)
            for shard, cut in _sharded(distinct, shards):
                asked.setdefault(shard, [b"", b""])[order - 1] = pack(distinct[cut], DROPPED[order])
        n = len(asked)
        return pa.table(
            {
                "chunk": pa.array([chunk] * n, pa.int64()),
                "shard": pa.array(asked.keys(), pa.int32()),
                "part": pa.array([chunk % parts] * n, pa.int32()),
                "words": pa.array([a[0] for a in asked.values()], pa.binary()),
                "pairs": pa.array([a[1] for a in asked.values()], pa.binary()),
            }
        )

    return run


def _answer(asked: pa.Table, table: pa.Table) -> pa.Table:
    """What the chunks asked one copy of a shard: exact counts of words, levels of words and pairs."""
    at_hand = table.to_pylist()[0] if len(table) else {"words": b"", "word_counts": b"", "bits": b""}
    known, counts = unpack(at_hand["words"], 0), np.frombuffer(at_hand["word_counts"], "<u8")
    shard = Shard(at_hand["bits"])
    out: list[tuple[bytes, bytes, bytes]] = []
    for words, pairs in zip(asked["words"], asked["pairs"], strict=True):
        given = unpack(words.as_py(), DROPPED[1])
        found = np.zeros(len(given), "<u8")
        if len(known):
            at = np.minimum(np.searchsorted(known, given), len(known) - 1)
            found = np.where(known[at] == given, counts[at], 0).astype("<u8")
        out.append((found.tobytes(), shard.levels(given).tobytes(), shard.levels(unpack(pairs.as_py(), DROPPED[2])).tobytes()))
    answers = {n: pa.array([o[i] for o in out], pa.binary()) for i, n in enumerate(("counts", "word_levels", "pair_levels"))}
    return pa.table({"chunk": asked["chunk"], "shard": asked["shard"]} | answers)


def _score(model: Model):
    """A chunk's texts and the answers of all shards, which in order of shards are those of its sorted n-grams."""

    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        answers = answers.sort_by("shard")
        joined = lambda name, kind: np.frombuffer(b"".join(answers[name].to_pylist()), kind)
        words, sizes = edged(_texts(texts))
        starts = np.cumsum(sizes) - sizes
        at = np.unique(words, return_inverse=True)[1]
        counts = joined("counts", "<u8")[at[1:]]
        level = joined("word_levels", np.uint8)[at]
        base = np.add.reduceat(model.base(counts.astype(float)), starts)
        known = np.add.reduceat((counts > 0).astype(np.int64), starts)
        at = np.unique(pairs_of(words), return_inverse=True)[1]
        pair = joined("pair_levels", np.uint8)[at]
        score = np.add.reduceat(np.log10(model.probability(level[1:], level[:-1], pair)), starts)
        return pa.table(
            {
                "doc_id": texts["doc_id"],
                "held_out": texts["held_out"],
                "n_tokens": pa.array(sizes.astype(np.int64)),
                "n_known": pa.array(known),
                "base_score": pa.array(base),
                "score": pa.array(score),
            }
        )

    return run


def lm_scores(
    spark: SparkSession,
    docs: DataFrame,
    held_out: Column,
    shard_bytes: int = SHARD_BYTES,
    chunk_bytes: int = CHUNK_BYTES,
    pair_weight: float = PAIR_WEIGHT,
    bits_per_entry: int = BITS_PER_ENTRY,
) -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from the rows where ``held_out`` is false. Null and blank texts have the end alone. With no
    training rows nothing is known, and every token has the probability of the one unknown word, 1. Null
    ids and repeated rows are scored each for itself; ties cannot occur; further columns are ignored; no
    rows give no rows.
    """
    small_batches(spark)
    rows = docs.select("doc_id", "text", held_out.alias("held_out"))
    n_bytes = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, math.ceil(n_bytes / shard_bytes))
    chunks = max(1, math.ceil(n_bytes / chunk_bytes))
    parts = math.ceil(chunks / CHUNKS_PER_COPY)
    grams = rows.where("not held_out").select("text").mapInArrow(
        _count_grams(shards), "gram_order int, shard int, grams binary, counts binary"
    )
    tables = keep(grams.groupBy("shard").applyInArrow(_build_shard(bits_per_entry), TABLES), "lm-tables")
    release(spark)
    sums = tables.agg(F.sum("total"), F.sum("n_words"), F.sum("mass"), F.avg("fill")).first()
    total, n_words, mass, fill = sums[0] or 0, sums[1] or 0, sums[2] or 0.0, sums[3] or 0.0
    model = Model(total, n_words, mass, fill**PROBES, pair_weight)
    dealt = rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("long"))
    asked = dealt.groupBy("chunk").applyInArrow(_ask(shards, parts), ASKED)
    copies = tables.select(
        "shard", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "words", "word_counts", "bits"
    )
    answers = asked.groupBy("shard", "part").cogroup(copies.groupBy("shard", "part")).applyInArrow(_answer, ANSWERS)
    answers = keep(answers, "lm-answers")
    release(spark)
    scored = dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_score(model), SCORED)
    return scored.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score"
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(spark, documents(spark, sf_dir), crc_mod("doc_id", 10) == 0)
