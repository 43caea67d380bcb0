"""Token counts from pre-tokens, without materialising ids.

Pre-tokens are counted over the corpus, each distinct one is encoded once and only its number of
pieces is kept. Documents are reduced to pre-token frequencies, joined to those numbers and summed.
The most frequent pre-tokens, a table of bounded size, are sent to every executor and are summed
where the document is read; the others meet their documents in a shuffle join.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake.llm import workers
from lintlake.llm.scratch import documents, keep, small_batches
from lintlake.llm.vocab import load, text_slices, tokenizer_path

#: Pre-tokens sent to executors, and the longest of them in characters.
HOT = 131_072
HOT_LENGTH = 48
#: Characters that every version of Unicode classifies alike; other texts go through the library.
SETTLED = re.compile(
    "[^\t\n\x0b\x0c\r -~¡-ʯΑ-ΡΣ-ϿЀ-ӿ‐-‧‰-⁞€"
    "ぁ-ゖァ-ヺ一-龥가-힣]"
)


class PreTokenizer:
    """Splits texts as the tokenizer of ``path`` does before it merges pieces."""

    def __init__(self, path: str):
        import public_tokenizers
        import regex

        self.tokenizer = load(path)
        self.find = regex.compile(public_tokenizers.PATTERN).findall
        marks = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.marks = re.compile("|".join(map(re.escape, sorted(marks, key=len, reverse=True)))) if marks else None

    def split(self, text: str) -> tuple[list[str], int]:
        """Pre-tokens, and how many special strings stood between them."""
        parts = self.marks.split(text) if self.marks else [text]
        out: list[str] = []
        for part in parts:
            if SETTLED.search(part):
                out += [part[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(part)]
            else:
                out += self.find(part)
        return out, len(parts) - 1


@lru_cache(maxsize=2)
def pre_tokenizer(path: str) -> PreTokenizer:
    return PreTokenizer(path)


workers.on_change(pre_tokenizer.cache_clear)


def _count_pretokens(path: str):
    def run(batches):
        workers.begin("token counts")
        split = pre_tokenizer(path).split
        for batch in batches:
            seen: Counter = Counter()
            for _, texts in text_slices(batch["text"]):
                for text in texts:
                    seen.update(split(text.decode())[0])
            yield pa.RecordBatch.from_pydict(
                {"pretoken": pa.array(seen.keys(), pa.string()), "n": pa.array(seen.values(), pa.int64())}
            )

    return run


def _count_pieces(path: str):
    def run(batches):
        workers.begin("token counts")
        tokenizer = load(path)
        for batch in batches:
            words = batch["pretoken"].to_pylist()
            pieces = []
            for at in range(0, len(words), 4096):
                coded = tokenizer.encode_batch_fast(words[at : at + 4096], add_special_tokens=False)
                pieces += [len(c.ids) for c in coded]
            yield batch.append_column("pieces", pa.array(pieces, pa.int64()))

    return run


def _frequencies(path: str, hot):
    """For each row: one record of its own with what the hot table settles, one per other pre-token."""

    def run(batches):
        workers.begin("token counts")
        split = pre_tokenizer(path).split
        known = hot.value
        for batch in batches:
            for first, texts in text_slices(batch["text"]):
                n = len(texts)
                own, rest_row, rest_word, rest_n = [], [], [], []
                for k, text in enumerate(texts):
                    words, total = split(text.decode())
                    for word, times in Counter(words).items():
                        pieces = known.get(word)
                        if pieces is None:
                            rest_row.append(first + k)
                            rest_word.append(word)
                            rest_n.append(times)
                        else:
                            total += pieces * times
                    own.append(total)
                here = batch.slice(first, n)
                yield pa.RecordBatch.from_pydict(
                    {
                        "row": here["row"],
                        "doc_id": here["doc_id"],
                        "n_bytes": pa.array([len(t) for t in texts], pa.int64()),
                        "pretoken": pa.nulls(n, pa.string()),
                        "n": pa.array(own, pa.int64()),
                    }
                )
                if rest_row:
                    m = len(rest_row)
                    yield pa.RecordBatch.from_pydict(
                        {
                            "row": batch["row"].take(pa.array(rest_row)),
                            "doc_id": pa.nulls(m, pa.int64()),
                            "n_bytes": pa.nulls(m, pa.int64()),
                            "pretoken": pa.array(rest_word, pa.string()),
                            "n": pa.array(rest_n, pa.int64()),
                        }
                    )

    return run


def piece_table(docs: DataFrame, path: str) -> DataFrame:
    """pretoken, n (occurrences in the corpus), pieces: each distinct pre-token is encoded once."""
    counts = docs.select("text").mapInArrow(_count_pretokens(path), "pretoken string, n long")
    distinct = counts.groupBy("pretoken").agg(F.sum("n").alias("n"))
    return distinct.mapInArrow(_count_pieces(path), "pretoken string, n long, pieces long")


def token_counts(spark: SparkSession, docs: DataFrame, tokenizer: str | None = None, hot: int = HOT) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_tokens.

    A null or empty text has no bytes and no tokens; blank texts have the tokens of their blanks.
    Repeated rows are counted each for itself, a null ``doc_id`` stays null, an empty table gives no
    rows and further columns are ignored.
    """
    small_batches(spark)
    path = tokenizer or tokenizer_path("byte_bpe_50k.json")
    pieces = keep(piece_table(docs, path), "pieces")
    top = pieces.where(F.length("pretoken") <= HOT_LENGTH).orderBy(F.desc("n"), "pretoken").limit(hot)
    table = top.select("pretoken", "pieces").toArrow()
    known = spark.sparkContext.broadcast(
        dict(zip(table["pretoken"].to_pylist(), table["pieces"].to_pylist(), strict=True))
    )
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text").mapInArrow(
        _frequencies(path, known), "row long, doc_id long, n_bytes long, pretoken string, n long"
    )
    # A row's own record has a key that no pre-token has: they never mix controls with digits.
    key = F.coalesce("pretoken", F.concat(F.lit("\0"), F.col("row").cast("string")))
    joined = rows.withColumn("key", key).join(pieces.select(F.col("pretoken").alias("key"), "pieces"), "key", "left")
    return (
        joined.groupBy("row")
        .agg(
            F.max("doc_id").alias("doc_id"),
            F.max("n_bytes").alias("n_bytes"),
            F.sum(F.col("n") * F.coalesce("pieces", F.lit(1))).alias("n_tokens"),
        )
        .drop("row")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts(spark, documents(spark, sf_dir))
    return counts.withColumn("over_limit", F.col("n_tokens") > 512)
