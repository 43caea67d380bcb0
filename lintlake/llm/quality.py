"""Quality classifier: supervised subword embeddings.

A document is the average of the learned vectors of its words and character n-grams, all hashed into
one table; a softmax layer over that average gives the class. Training is plain numpy stochastic
gradient descent over a bounded sample of labelled rows. As the output is linear in the average, a
trained table is reduced to one number per bucket, which is what executors get for scoring.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake.llm import workers
from lintlake.llm.hashing import span_hashes, spans
from lintlake.llm.scratch import Plain, crc_mod, documents, keep, small_batches
from lintlake.llm.vocab import text_slices

BUCKET_BITS = 17
DIMENSIONS = 12
GRAMS = (3, 4, 5, 6)
EPOCHS = 6
RATE = 0.5
#: Labelled rows the model is fitted on, at most, for each of the two labels.
SAMPLE_ROWS = 1500
THRESHOLD = 0.7
#: Text scored at once; the arrays of its n-grams take some eighty times as much.
SCORED_BYTES = 1 << 18
BLANKS = np.array([0x20, *range(0x09, 0x0E), 0x85, 0xA0, 0x2028, 0x2029, 0x3000], np.uint32)
_U = np.uint32


def code_points(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, a blank before and after each, and where each text starts."""
    parts = [np.frombuffer(t.decode().encode("utf-32-le"), _U) for t in texts]
    sizes = np.fromiter((len(p) + 2 for p in parts), np.int64, len(parts))
    starts = np.cumsum(sizes) - sizes
    codes = np.full(int(sizes.sum()), 32, _U)
    for at, part in zip(starts, parts, strict=True):
        codes[at + 1 : at + 1 + len(part)] = part
    return codes, starts


def blanks(codes: np.ndarray) -> np.ndarray:
    blank = (codes <= 0x20) | (codes >= 0x85)
    blank[blank] = np.isin(codes[blank], BLANKS)
    return blank


def features(codes: np.ndarray, bits: int = BUCKET_BITS):
    """(positions, buckets) of words, then of the n-grams of each length.

    An n-gram may begin or end with the blank beside a word, but holds none inside.
    """
    blank = blanks(codes)
    starts, ends = spans(blank)
    words = span_hashes(codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), starts, ends)
    yield starts, (words >> np.uint64(64 - bits)).astype(np.int64)
    values = codes * _U(0x9E3779B1)
    values ^= values >> _U(15)
    values[blank] = 0x2545F491
    inside = np.concatenate(([0], np.cumsum(blank)))
    total = np.zeros(len(codes), _U)
    for n in range(1, max(GRAMS) + 1):
        if len(codes) < n:
            return
        total = total[: len(codes) - n + 1] * _U(0x01000193) + values[n - 1 :]
        if n in GRAMS:
            at = np.flatnonzero(inside[n - 1 : len(codes)] == inside[1 : len(codes) - n + 2])
            h = (total[at] ^ _U(n)) * _U(0x85EBCA6B)
            h ^= h >> _U(13)
            h *= _U(0xC2B2AE35)
            yield at, (h >> _U(32 - bits)).astype(np.int64)


def _featurise(batches):
    """(quality, text) -> (quality, buckets, shares): what a document's average is made of."""
    workers.begin("quality")
    for batch in batches:
        for first, texts in text_slices(batch["text"]):
            rows = []
            for text in texts:
                found = [b for _, b in features(code_points([text])[0])]
                buckets, counts = np.unique(np.concatenate(found), return_counts=True)
                shares = (counts / max(1, counts.sum())).astype(np.float32)
                rows.append((buckets.astype(np.int32).tobytes(), shares.tobytes()))
            yield pa.RecordBatch.from_arrays(
                [
                    batch["quality"].slice(first, len(texts)),
                    pa.array([r[0] for r in rows], pa.binary()),
                    pa.array([r[1] for r in rows], pa.binary()),
                    batch["doc_id"].slice(first, len(texts)),
                ],
                ["quality", "buckets", "shares", "doc_id"],
            )


def train(documents: list[tuple[int, np.ndarray, np.ndarray]], seed: int = 3) -> tuple[np.ndarray, float]:
    """Stochastic gradient descent on the softmax loss; returns the table of scores and the bias."""
    rng = np.random.default_rng(seed)
    table = rng.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (1 << BUCKET_BITS, DIMENSIONS)).astype(np.float32)
    out = np.zeros((2, DIMENSIONS), np.float32)
    bias = np.zeros(2, np.float32)
    step, steps = 0, EPOCHS * len(documents)
    for _ in range(EPOCHS):
        for k in rng.permutation(len(documents)):
            label, buckets, shares = documents[k]
            rate = RATE * (1 - step / steps)
            step += 1
            vectors = table[buckets]
            hidden = shares @ vectors
            logits = out @ hidden + bias
            odds = np.exp(logits - logits.max())
            error = odds / odds.sum()
            error[label] -= 1
            back = error @ out
            out -= rate * np.outer(error, hidden)
            bias -= rate * error
            # The update of each averaged vector is scaled up to that of the average itself.
            table[buckets] = vectors - rate * np.outer(shares * (1 / (shares @ shares)), back)
    return table @ (out[1] - out[0]), float(bias[1] - bias[0])


def _train_group(table: pa.Table) -> pa.Table:
    labels = table["quality"].to_pylist()
    rows = [
        (y, np.frombuffer(b, np.int32), np.frombuffer(s, np.float32))
        for y, b, s, _ in sorted(
            zip(labels, table["buckets"].to_pylist(), table["shares"].to_pylist(), table["doc_id"].to_pylist(), strict=True),
            key=lambda r: (r[3] is None, r[3] or 0, r[1]),
        )
    ]
    if len(set(labels)) < 2:
        weights, bias = np.zeros(1 << BUCKET_BITS, np.float32), 4.0 if 1 in labels else -4.0
    else:
        weights, bias = train(rows)
    return pa.table({"weights": [weights.astype(np.float32).tobytes()], "bias": [bias]})


def fit(
    spark: SparkSession, docs: DataFrame, labels: DataFrame, usable: Column, sample_rows: int = SAMPLE_ROWS
) -> tuple[bytes, float]:
    """Weights per bucket and bias, from at most ``sample_rows`` labelled documents per label.

    The sample is the rows of least hash among those documents where ``usable`` (a condition on doc_id)
    holds. The bias is moved by how much the sample's ratio of labels differs from that of all usable
    documents, so a score means the same whatever share of them the sample is.
    """
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & usable)
    known = known.groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    known = keep(known.join(docs.select("doc_id"), "doc_id", "left_semi"), "labelled")
    n = {r["quality"]: r["count"] for r in known.groupBy("quality").count().collect()}
    parts = [
        known.where(F.col("quality") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
        for y in (0, 1)
    ]
    sample = parts[0].unionByName(parts[1])
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", "quality", "text")
    found = texts.mapInArrow(_featurise, "quality int, buckets binary, shares binary, doc_id long")
    model = found.withColumn("model", F.lit(1)).groupBy("model").applyInArrow(_train_group, "weights binary, bias double").first()
    if model is None:
        return b"", 0.0
    prior = 0.0
    if len(n) == 2:
        taken = {y: min(n[y], sample_rows) for y in n}
        prior = math.log(n[1] / n[0]) - math.log(taken[1] / taken[0])
    return bytes(model["weights"]), model["bias"] + prior


def _score(model, columns: list[str]):
    def run(batches):
        workers.begin("quality")
        weights, bias = model.value
        weights = np.frombuffer(weights, np.float32) if weights else np.zeros(1 << BUCKET_BITS, np.float32)
        for batch in batches:
            scores = []
            for _, texts in text_slices(batch["text"], SCORED_BYTES):
                codes, starts = code_points(texts)
                total, count = np.zeros(len(codes)), np.zeros(len(codes), np.int32)
                for at, buckets in features(codes):
                    total[at] += weights[buckets]
                    count[at] += 1
                mean = np.add.reduceat(total, starts) / np.maximum(1, np.add.reduceat(count, starts))
                scores.append(1 / (1 + np.exp(-np.clip(mean + bias, -50, 50))))
            scored = np.concatenate(scores) if scores else np.empty(0)
            yield batch.select(columns).append_column("score", pa.array(scored, pa.float64()))

    return run


def score(spark: SparkSession, docs: DataFrame, model: tuple[bytes, float], columns: list[str]) -> DataFrame:
    """``columns`` of every row of ``docs`` and its score. Null texts count as empty and score by the bias."""
    small_batches(spark)
    given = spark.sparkContext.broadcast(model)
    rows = docs.select(*columns, *(["text"] if "text" not in columns else []))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*columns).schema)
    return rows.mapInArrow(_score(given, columns), f"{schema}, score double")


def held_out() -> Column:
    return crc_mod("doc_id", 4) == 2


def classify(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted.

    Labels of held-out rows are not used. Without any label every score is 0.5; with one kind only the
    scores are constant. Labels of unknown documents and null labels are ignored; of several labels of
    a document the largest counts. Null ids, repeated rows and further columns do no harm.
    """
    model = fit(spark, docs, labels, ~held_out())
    scored = score(spark, docs, model, ["doc_id"])
    return scored.select(
        "doc_id",
        held_out().alias("held_out"),
        "score",
        F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"),
    )


def accepted(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier predicts to be good, with their columns as they were.

    Null, empty and blank texts are judged by the bias alone; equal texts get equal scores, so of repeated
    rows all stay or none; a null ``doc_id`` does no harm; an empty table gives no rows.
    """
    model = fit(spark, docs, labels, ~held_out())
    plain = Plain(docs, "text")
    return plain.restored(score(spark, plain.df, model, plain.df.columns).where(F.col("score") >= THRESHOLD))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(spark, documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
