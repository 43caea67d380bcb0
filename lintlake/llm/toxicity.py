"""Toxicity: noisy-channel deobfuscation, then a score of the restored text.

1. A character model (4-grams, backing off to 3-grams) is counted over all texts.
2. Tokens that may be disguised (digits or signs among letters, letters dragged out, letters set apart) become
   character lattices: every position has the characters that may be meant and what it costs to write them so.
   Viterbi decoding finds the reading of least cost under the channel and the model; "1d10t" is read as the
   word that the model knows, while "mail7" stays.
3. Words of the restored text are scored by their hashed character n-grams: how much likelier a document with
   the n-gram is toxic, at the lower end of its uncertainty. A document is judged by its worst words, so one
   insult in a long text counts as in a short one; a logistic model of a few such figures gives the score.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake.llm import workers
from lintlake.llm.quality import blanks, code_points, features
from lintlake.llm.scratch import broadcast_if_small, crc_mod, documents, keep, small_batches, text_or_empty
from lintlake.llm.vocab import text_slices

#: Symbols of the character model: a blank, a to z, digit, other letter, other sign.
BLANK, DIGIT, LETTER, SIGN, SYMBOLS = 0, 27, 28, 29, 32
ORDER = 4
CELLS = SYMBOLS**ORDER
#: Weight of the shorter history in a probability.
BACKOFF = 5.0
#: What a sign or digit may be written for. Fixed by how texts are disguised in practice.
MEANT = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "¡": "i", "(": "c", "<": "c",
}
#: Signs set between the letters of a word.
APART = " .-_*~'`^,:;/\\#%&=?"
#: Costs, as natural logarithms, of writing another character, of a sign between letters, of leaving a blank out
#: between single letters, and of dragging a letter out.
OTHER, BETWEEN, JOINED, DRAGGED = 1.5, 1.5, 0.3, 1.0
_SPACED = re.compile(r"(?<!\S)(?:[\w@$!|+€][ \t]){3,}[\w@$!|+€](?!\S)")
_TRAILING = re.compile(r"[^\w@$!|+€]+$|([!$|+@*#%&?])\1+$|[!?.,]+$")
_PLAIN = re.compile(r"[^\W\d_]*")
_DRAGGED = re.compile(r"([^\W\d_])\1\1")
#: Tokens a worker remembers the reading of.
REMEMBERED = 1 << 18

BITS = 20
#: Documents of its label that a feature occurs in, at least, and standard errors its weight is lowered by.
LEAST_DOCUMENTS, CAUTION = 3, 1.5
#: Labelled documents of each label that the last, logistic model is fitted on, at most.
SAMPLE_ROWS = 2000
#: Word scores from which a word counts as suspect.
SUSPECT = (1.0, 2.0)
FIGURES = 6
THRESHOLD = 0.5


def _symbol_table() -> np.ndarray:
    table = np.full(0x250, SIGN, np.uint8)
    for point in range(0x250):
        c = chr(point)
        table[point] = (
            BLANK if c.isspace() else 1 + point - 97 if "a" <= c <= "z" else DIGIT if c.isdigit() else LETTER if c.isalpha() else SIGN
        )
    return table


TABLE = _symbol_table()


def symbols(codes: np.ndarray) -> np.ndarray:
    """The model's symbol of each code point of lower-case text; those beyond the table count as letters."""
    return np.where(codes < len(TABLE), TABLE[np.minimum(codes, len(TABLE) - 1)], LETTER).astype(np.int64)


def _count_grams(batches):
    workers.begin("toxicity")
    total = np.zeros(CELLS, np.int64)
    for batch in batches:
        for _, texts in text_slices(batch["text"], 1 << 20):
            s = symbols(code_points([t.decode().lower().encode() for t in texts])[0])
            s = s[(s != BLANK) | (np.append(s[1:], 1) != BLANK)]  # one blank between words
            if len(s) >= ORDER:
                grams = s[: len(s) - ORDER + 1]
                for k in range(1, ORDER):
                    grams = grams * SYMBOLS + s[k : len(s) - ORDER + 1 + k]
                total += np.bincount(grams, minlength=CELLS)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["cell", "n"])


def character_model(docs: DataFrame) -> np.ndarray:
    """Costs (negative logarithms of probabilities) of every symbol after every three, from all texts.

    The counts have at most ``CELLS`` rows, whatever the table's size.
    """
    counted = docs.select(text_or_empty().alias("text")).mapInArrow(_count_grams, "cell long, n long")
    got = counted.groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(CELLS)
    counts[got["cell"].to_numpy()] = got["n"].to_numpy()
    return costs_of(counts)


def costs_of(counts: np.ndarray) -> np.ndarray:
    counts = counts.reshape([SYMBOLS] * ORDER)
    shorter = np.full(SYMBOLS, 1 / SYMBOLS)
    for lost in range(ORDER - 1, -1, -1):
        own = counts.sum(axis=tuple(range(lost))) if lost else counts
        shorter = (own + BACKOFF * shorter) / (own.sum(axis=-1, keepdims=True) + BACKOFF)
    return -np.log(shorter).astype(np.float32).ravel()


class Decoder:
    """Reads disguised tokens under a character model."""

    def __init__(self, costs: np.ndarray):
        self.costs = costs
        self.read: dict[str, str] = {}

    def restored(self, text: str) -> str:
        """``text`` in lower case, its blanks as they were, with every disguised token as it was meant."""
        text = text.lower()
        if _SPACED.search(text):
            text = _SPACED.sub(lambda m: self._of(m.group()), text)
        read, out = self.read, {}
        for token in set(text.split()):
            known = read.get(token)
            if known is None:
                known = self._of(token)
            if known != token:
                out[token] = known
        if not out:
            return text
        return "".join(out.get(part, part) for part in re.split(r"(\s+)", text))

    def _of(self, token: str) -> str:
        known = self.read.get(token)
        if known is None:
            if len(self.read) >= REMEMBERED:
                self.read.clear()
            known = self.read[token] = self._decoded(token)
        return known

    def _decoded(self, token: str) -> str:
        bare = token
        while (m := _TRAILING.search(bare)) and m.start():
            bare = bare[: m.start()]
        if _PLAIN.fullmatch(bare) and not _DRAGGED.search(bare):
            return token
        letters = sum(c.isalpha() for c in bare)
        if letters < 2 or "://" in bare or ("@" in bare and "." in bare.rpartition("@")[2]):
            return token
        return viterbi(lattice(bare), self.costs) + token[len(bare) :]


def lattice(token: str) -> list[list[tuple[str, float]]]:
    """For each position the strings that may be meant, and their costs in the channel."""
    out: list[list[tuple[str, float]]] = []
    spaced = " " in token or "\t" in token
    at = 0
    while at < len(token):
        c = token[at]
        end = at + 1
        while end < len(token) and token[end] == c:
            end += 1
        n = end - at
        if c in " \t":
            arcs = [(" ", 0.0), ("", JOINED)]
        elif c.isalpha() and not spaced:
            arcs = [(c * n, 0.0)] if n < 3 else [(c, DRAGGED), (c * 2, DRAGGED), (c * n, 0.0)]
        else:
            arcs = [(c * n, 0.0)]
            arcs += [(m, OTHER * min(n, 3)) for m in MEANT.get(c, "")]
            if n == 2:
                arcs += [(m * 2, OTHER * 2) for m in MEANT.get(c, "")]
            if c in APART and at:
                arcs.append(("", BETWEEN))
        out.append(arcs)
        at = end
    return out


def _symbol(c: str) -> int:
    point = ord(c)
    return int(TABLE[point]) if point < len(TABLE) else LETTER


def viterbi(arcs: list[list[tuple[str, float]]], costs: np.ndarray) -> str:
    """The string of least cost through the lattice, read after and before a blank; of equal ones the first."""
    whole = CELLS // SYMBOLS
    paths = {0: (0.0, "")}  # the last three symbols -> cost, string
    for choices in [*arcs, [(" ", 0.0)]]:
        after: dict[int, tuple[float, str]] = {}
        for state, (cost, said) in paths.items():
            for string, price in choices:
                total, at = cost + price, state
                for c in string:
                    cell = at * SYMBOLS + _symbol(c)
                    total += float(costs[cell])
                    at = cell % whole
                if at not in after or total < after[at][0]:
                    after[at] = (total, said + string)
        paths = after
    return min(paths.values(), key=lambda p: p[0])[1][:-1]


_decoders: dict[int, Decoder] = {}
workers.on_change(_decoders.clear)


def _decoder(costs: np.ndarray) -> Decoder:
    """One decoder per worker and model, so that readings are remembered from batch to batch."""
    key = hash(costs.tobytes())
    if key not in _decoders:
        _decoders.clear()
        _decoders[key] = Decoder(costs)
    return _decoders[key]


def _restore(model, columns: list[str]):
    def run(batches):
        workers.begin("toxicity")
        decoder = _decoder(model.value)
        for batch in batches:
            for first, texts in text_slices(batch["text"]):
                own = batch.select(columns).slice(first, len(texts))
                yield own.append_column("restored", pa.array([decoder.restored(t.decode()) for t in texts], pa.string()))

    return run


def restore(docs: DataFrame, costs: np.ndarray, columns: list[str]) -> DataFrame:
    """``columns`` of every row of ``docs`` (with ``text``) and its text as it was meant; a null text is empty."""
    small_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(costs)
    rows = docs.select(*columns, text_or_empty().alias("text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*columns).schema)
    return rows.mapInArrow(_restore(model, columns), f"{schema}, restored string")


def _codes(decoder: Decoder, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return code_points([decoder.restored(t.decode()).encode() for t in texts])


def _count_features(model, wanted):
    """(text, fold) -> documents of each fold that each bucket occurs in; only ``wanted`` buckets, if given."""

    def run(batches):
        workers.begin("toxicity")
        decoder = _decoder(model.value)
        total = np.zeros((2, 1 << BITS), np.int64)
        for batch in batches:
            folds = batch["fold"].to_pylist()
            for first, texts in text_slices(batch["text"]):
                for text, fold in zip(texts, folds[first:], strict=False):
                    found = [b for _, b in features(_codes(decoder, [text])[0], BITS)]
                    total[fold][np.unique(np.concatenate(found))] += 1
        for fold in (0, 1):
            at = np.flatnonzero(total[fold] if wanted is None else total[fold] * wanted.value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(at), pa.array(np.full(len(at), fold, np.int32)), pa.array(total[fold][at])], ["bucket", "fold", "n"]
            )

    return run


def _feature_counts(rows: DataFrame, model, wanted=None) -> np.ndarray:
    """(2, buckets): documents by fold. At most two rows per bucket reach the driver."""
    counted = rows.mapInArrow(_count_features(model, wanted), "bucket long, fold int, n long")
    got = counted.groupBy("bucket", "fold").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros((2, 1 << BITS))
    out[got["fold"].to_numpy(), got["bucket"].to_numpy()] = got["n"].to_numpy()
    return out


def weights_of(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    """Per bucket the logarithm of how much likelier toxic documents hold it, less ``CAUTION`` errors, at least 0."""
    t, c = toxic + 0.5, clean + 0.5
    ratio = np.log(t / (n_toxic + 1)) - np.log(c / (n_clean + 1))
    weights = np.maximum(0, ratio - CAUTION * np.sqrt(1 / t + 1 / c))
    return np.where(toxic >= LEAST_DOCUMENTS, weights, 0).astype(np.float32)


def figures(codes: np.ndarray, starts: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """(documents, FIGURES): the three greatest different word scores, suspect words, and their share of all words.

    All are 0 without suspect words, whatever the length, so an empty text is judged by the bias alone.
    """
    per_position = np.zeros(len(codes), np.float32)
    for at, buckets in features(codes, BITS):
        per_position[at] = np.maximum(per_position[at], weights[buckets])
    blank = blanks(codes)
    first = np.flatnonzero(blank[:-1] & ~blank[1:])  # an n-gram may begin with the blank before its word
    out = np.zeros((len(starts), FIGURES))
    if not len(first):
        return out
    scores = np.maximum.reduceat(per_position, first)
    doc = np.searchsorted(starts, first, "right") - 1
    n = np.bincount(doc, minlength=len(starts))
    for k, least in enumerate(SUSPECT):
        out[:, 3 + k] = np.log1p(np.bincount(doc[scores > least], minlength=len(starts)))
    out[:, 5] = np.log1p(100 * np.expm1(out[:, 3]) / (n + 1))
    some = np.flatnonzero(scores > 0)
    some = some[np.lexsort((-scores[some], doc[some]))]
    d, s = doc[some], scores[some]
    new = np.ones(len(some), bool)
    new[1:] = (d[1:] != d[:-1]) | (s[1:] != s[:-1])
    d, s = d[new], s[new]
    rank = np.arange(len(d)) - np.searchsorted(d, d)
    for k in range(3):
        out[d[rank == k], k] = s[rank == k]
    return out


def _figures(model, weights, columns: list[str]):
    """Rows with ``figures`` as bytes, under the weights of the other fold where there are two."""

    def run(batches):
        workers.begin("toxicity")
        decoder = _decoder(model.value)
        for batch in batches:
            folds = batch["fold"].to_pylist()
            rows = []
            for first, texts in text_slices(batch["text"]):
                for text, fold in zip(texts, folds[first:], strict=False):
                    rows.append(figures(*_codes(decoder, [text]), weights.value[1 - fold])[0].tobytes())
            yield batch.select(columns).append_column("figures", pa.array(rows, pa.binary()))

    return run


def logistic(x: np.ndarray, y: np.ndarray, steps: int = 30, ridge: float = 0.1) -> tuple[np.ndarray, float]:
    """Coefficients and bias by Newton's method on scaled columns, ``ridge`` on all."""
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = np.column_stack(((x - mean) / spread, np.ones(len(x))))
    w = np.zeros(z.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -50, 50)))
        slope = z.T @ (p - y) + ridge * w
        curve = (z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w))
        w -= np.linalg.solve(curve, slope)
    own = w[:-1] / spread
    return own, float(w[-1] - own @ mean)


def fit(docs: DataFrame, labels: DataFrame, usable: Column) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Character costs, feature weights, coefficients of the figures, bias.

    Features are counted over all labelled documents where ``usable`` (a condition on doc_id) holds, equal
    texts once; the logistic model is fitted on at most ``SAMPLE_ROWS`` of each label, those of least hash,
    under weights of the half of texts that a document is not in. Its bias is moved by how much the sample's
    ratio of labels differs from that of all.
    """
    spark = docs.sparkSession
    small_batches(spark)
    costs = character_model(docs)
    model = spark.sparkContext.broadcast(costs)
    told = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & usable)
    told = told.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    own = docs.select("doc_id", text_or_empty().alias("text")).join(broadcast_if_small(told, 24), "doc_id")
    hashed = own.select("doc_id", "toxic", F.xxhash64("text").alias("hash"))
    chosen = hashed.groupBy("hash").agg(F.min("doc_id").alias("doc_id"), F.max("toxic").alias("toxic"))
    chosen = keep(chosen.withColumn("fold", F.pmod("hash", F.lit(2)).cast("int")), "toxic-labels")
    n = {(r["toxic"], r["fold"]): r["count"] for r in chosen.groupBy("toxic", "fold").count().collect()}
    count = lambda y, f: n.get((y, f), 0)
    t, c = count(1, 0) + count(1, 1), count(0, 0) + count(0, 1)
    none = np.zeros(1 << BITS, np.float32)
    if not t or not c:
        odds = t / (t + c + 1)
        return costs, none, np.zeros(FIGURES), math.log(odds / (1 - odds)) if odds else -50.0
    few = broadcast_if_small(chosen.select("doc_id", "hash", "toxic", "fold"), 40, t + c)
    # a doc_id of several rows has the text chosen for it among them; of equal rows one is enough
    texts = docs.select("doc_id", text_or_empty().alias("text")).withColumn("hash", F.xxhash64("text"))
    texts = texts.join(few, ["doc_id", "hash"])
    toxic = _feature_counts(texts.where("toxic = 1").select("text", "fold"), model)
    wanted = spark.sparkContext.broadcast((toxic.sum(axis=0) >= LEAST_DOCUMENTS).astype(np.uint8))
    clean = _feature_counts(texts.where("toxic = 0").select("text", "fold"), model, wanted)
    halves = np.stack([weights_of(toxic[f], clean[f], count(1, f), count(0, f)) for f in (0, 1)])
    parts = [chosen.where(F.col("toxic") == y).orderBy(F.xxhash64("hash"), "hash").limit(SAMPLE_ROWS) for y in (0, 1)]
    sample = F.broadcast(parts[0].unionByName(parts[1]))
    rows = docs.select("doc_id", text_or_empty().alias("text")).withColumn("hash", F.xxhash64("text")).join(sample, ["doc_id", "hash"])
    run = _figures(model, spark.sparkContext.broadcast(halves), ["hash", "toxic"])
    got = sorted({(r["hash"], r["toxic"], bytes(r["figures"])) for r in rows.mapInArrow(run, "hash long, toxic int, figures binary").collect()})
    x, y = np.array([np.frombuffer(g[2]) for g in got]), np.array([g[1] for g in got])
    coefficients, bias = logistic(x, y)
    bias += math.log(t / c) - math.log(y.sum() / (len(y) - y.sum()))
    return costs, weights_of(toxic.sum(axis=0), clean.sum(axis=0), t, c), coefficients, bias


def _score(model, columns: list[str]):
    def run(batches):
        workers.begin("toxicity")
        costs, weights, coefficients, bias = model.value
        decoder = _decoder(costs)
        for batch in batches:
            scores = [np.empty(0)]
            for _, texts in text_slices(batch["text"], 1 << 20):
                logits = figures(*_codes(decoder, texts), weights) @ coefficients + bias
                scores.append(1 / (1 + np.exp(-np.clip(logits, -50, 50))))
            yield batch.select(columns).append_column("score", pa.array(np.concatenate(scores)))

    return run


def score(docs: DataFrame, model: tuple, columns: list[str]) -> DataFrame:
    """``columns`` of every row of ``docs`` and its score; null texts count as empty."""
    small_batches(docs.sparkSession)
    given = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(*columns, text_or_empty().alias("text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*columns).schema)
    return rows.mapInArrow(_score(given, columns), f"{schema}, score double")


def held_out() -> Column:
    return crc_mod("doc_id", 5) == 0


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted.

    Labels of held-out rows are not used. Without any usable label every score is 0, with one kind only all
    are the same. Labels of unknown documents and null labels are ignored; of several labels of a document
    or of equal texts the greatest counts. Null, empty and blank texts have no words and score by the bias;
    equal texts score alike; null ids, repeated rows and further columns, of any name, do no harm; an empty
    table gives no rows.
    """
    scored = score(docs, fit(docs, labels, ~held_out()), ["doc_id"])
    return scored.select(
        "doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
