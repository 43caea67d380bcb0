"""Filter interaction audit: what every filter of a pipeline removes, in every order of the filters.

A document fails some of five filters, so a part of the corpus is a 2x2x2x2x2 table of counts: one axis
for each filter, 0 for passing and 1 for failing. Any step of any order is one contraction of that tensor
with a vector for each axis: ``PASS`` selects those that pass, ``FAIL`` those that fail, ``ALL`` sums over
both. Spark works out the conditions of each document and counts them by part; a part's tensor has 32
cells, however many documents it stands for.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake.llm.scratch import Plain, documents, keep, text_or_empty

FILTERS = "ABCDE"
LEAST_WORDS = 100
#: Percent of words that must be distinct, and percent of characters that may be capitals.
LEAST_DISTINCT, MOST_CAPITALS = 80, 10
PASS, FAIL, ALL = np.array([[1, 0], [0, 1], [1, 1]], np.int64)
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
SCHEMA = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS)


def words(text: Column) -> Column:
    """The words of a text, in order: runs of characters other than ASCII blanks."""
    return F.array_remove(F.split(text, "[\\x20\\x09-\\x0D]+"), "")


def content_failures(text: Column) -> list[Column]:
    """Whether a text fails A (too short), B (repetitive), C (shouting), D (symbols); ``text`` is not null."""
    w = words(text)
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return [
        F.size(w) < LEAST_WORDS,
        100 * F.size(F.array_distinct(w)) < LEAST_DISTINCT * F.size(w),
        100 * capitals > MOST_CAPITALS * F.length(text),
        text.rlike("[#$%&*|]"),
    ]


def failures(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, part, and the filters it fails as A, B, C, D, E (boolean).

    E fails where a smaller doc_id, anywhere in the table, has the same text. A null text is the empty one,
    a null lang the part "". A null doc_id counts as greater than every other, and repeated rows, which
    have the same doc_id, do not fail for each other. Texts are told apart by their SHA-256. A text's least
    doc_id is worked out with a partial sum in every task and joined by text *and* doc_id, so that a text
    of many copies is no hot key.
    """
    t = F.col("body")
    rows = Plain(docs, "doc_id", "text", "lang").df
    rows = rows.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), text_or_empty().alias("body"))
    flags = [c.alias(n) for n, c in zip(FILTERS, content_failures(t), strict=False)]
    rows = keep(rows.select("doc_id", "part", F.unhex(F.sha2(t, 256)).alias("digest"), *flags), "audit-flags")
    # min ignores nulls: of a text that only rows without an id have, the least id is null, and all of them pass
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("least")).withColumn("first", F.lit(True))
    same = rows["digest"].eqNullSafe(first["digest"]) & rows["doc_id"].eqNullSafe(first["least"])
    return rows.join(first, same, "left").select("doc_id", "part", *FILTERS[:4], F.col("first").isNull().alias("E"))


def tensors(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents by part and cell (bit i set: fails filter i): n, and of these the good and the toxic ones.

    A label table may hold a document several times: one row that says so is enough. Labels of null ids
    belong to no document.
    """
    told = labels.where("doc_id is not null").groupBy("doc_id").agg(
        F.coalesce(F.bool_or(F.col("quality") == 1), F.lit(False)).alias("good"),
        F.coalesce(F.bool_or(F.col("toxic") == 1), F.lit(False)).alias("toxic"),
    ).where("good or toxic")
    cell = sum((F.col(f).cast("int") * (1 << i) for i, f in enumerate(FILTERS)), F.lit(0))
    rows = failed.select("doc_id", "part", cell.alias("cell")).join(told, "doc_id", "left")
    return rows.groupBy("part", "cell").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic")
    )


def _selections() -> tuple[np.ndarray, np.ndarray, list[tuple[str, int]]]:
    """For every step of every order: a vector for each axis, with FAIL on the step's own; own axes; names."""
    chosen, own, names = [], [], []
    for order in permutations(range(len(FILTERS))):
        for step, axis in enumerate(order):
            vectors = np.tile(ALL, (len(FILTERS), 1))
            vectors[list(order[:step])] = PASS
            vectors[axis] = FAIL
            chosen.append(vectors)
            own.append(axis)
            names.append(("".join(FILTERS[a] for a in order), step + 1))
    return np.array(chosen), np.array(own), names


def _with(chosen: np.ndarray, own: np.ndarray, on: np.ndarray | None, elsewhere: np.ndarray | None) -> np.ndarray:
    """``chosen`` with the vector ``on`` on each step's own axis and ``elsewhere`` on all others; None leaves them."""
    out = chosen.copy() if elsewhere is None else np.tile(elsewhere, (*chosen.shape[:2], 1))
    out[np.arange(len(own)), own] = chosen[np.arange(len(own)), own] if on is None else on
    return out


def contracted(tensor: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """(measures, 2, 2, 2, 2, 2) with a vector for each of the axes of each step -> (measures, steps)."""
    return np.einsum("mabcde,na,nb,nc,nd,ne->mn", tensor, *vectors.transpose(1, 0, 2), optimize=True)


def audit_of(tensor: np.ndarray) -> dict[str, np.ndarray]:
    """All counts of all steps from a (3, 2, 2, 2, 2, 2) tensor of all, good and toxic documents."""
    chosen, own, _ = _selections()
    removed, good, toxic = contracted(tensor, chosen)
    failing = contracted(tensor[:1], _with(chosen, own, None, ALL))[0]
    shares = np.array([removed[own == axis].sum() for axis in range(len(FILTERS))])
    return {
        "kept": contracted(tensor[:1], _with(chosen, own, PASS, None))[0],
        "removed": removed,
        "redundant": failing - removed,
        "unique_fails": contracted(tensor[:1], _with(chosen, own, None, PASS))[0],
        "good_lost": good,
        "toxic_lost": toxic,
        "shapley": shares[own],
    }


def _audit_part(cells: pd.DataFrame) -> pd.DataFrame:
    tensor = np.zeros((3, 1 << len(FILTERS)), np.int64)
    tensor[:, cells["cell"].to_numpy()] = cells[["n", "good", "toxic"]].to_numpy(np.int64).T
    # the lowest bit is the first filter, so the axes come out in reverse
    tensor = tensor.reshape(3, *[2] * len(FILTERS)).transpose(0, *range(len(FILTERS), 0, -1))
    out = pd.DataFrame(audit_of(tensor))
    names = _selections()[2]
    out.insert(0, "step", np.array([s for _, s in names], np.int32))
    out.insert(0, "filter_order", [o for o, _ in names])
    out.insert(0, "part", cells["part"].iloc[0])
    return out


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """600 rows per part: for every order of the filters and every step what it keeps and what it removes.

    See ``failures`` and ``tensors`` for nulls, repeated rows and ties. An empty table has no parts, so no
    rows; further columns of either table, of any name, do no harm.
    """
    counts = tensors(failures(docs), labels)
    return counts.groupBy("part").applyInPandas(_audit_part, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


SQL = f"""
with d as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as body from documents),
w as (select *, list_filter(regexp_split_to_array(body, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as ws from d),
f as (select doc_id, part,
    case when len(ws) < {LEAST_WORDS} then 1 else 0 end
  + case when 100 * len(list_distinct(ws)) < {LEAST_DISTINCT} * len(ws) then 2 else 0 end
  + case when 100 * length(regexp_replace(body, '[^A-Z]', '', 'g')) > {MOST_CAPITALS} * length(body) then 4 else 0 end
  + case when regexp_matches(body, '[#$%&*|]') then 8 else 0 end
  + case when doc_id > min(doc_id) over (partition by body) then 16 else 0 end as cell from w),
l as (select doc_id, bool_or(quality = 1) as good, bool_or(toxic = 1) as toxic from labels group by doc_id),
t as (select part, cell, count(*) as n, count(*) filter (good) as good, count(*) filter (toxic) as toxic
  from f left join l using (doc_id) group by all),
letters as (select unnest(['A', 'B', 'C', 'D', 'E']) as x),
orders as (select a.x || b.x || c.x || d.x || e.x as filter_order from letters a, letters b, letters c, letters d, letters e
  where len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps as (select filter_order, step, instr('ABCDE', substr(filter_order, step, 1)) - 1 as own,
    list_sum([0] || list_transform(range(1, step), lambda k: 1 << (instr('ABCDE', substr(filter_order, k, 1)) - 1))) as earlier
  from orders, range(1, 6) r(step)),
c as (select part, filter_order, step, own, n, good, toxic, (cell // (1 << own)) % 2 = 1 as fails,
    (cell & earlier::bigint) = 0 as reached, cell = (1 << own) as alone from t, steps),
s as (select part, filter_order, step, own,
    coalesce(sum(n) filter (reached and not fails), 0)::bigint as kept,
    coalesce(sum(n) filter (reached and fails), 0)::bigint as removed,
    coalesce(sum(n) filter (not reached and fails), 0)::bigint as redundant,
    coalesce(sum(n) filter (alone), 0)::bigint as unique_fails,
    coalesce(sum(good) filter (reached and fails), 0)::bigint as good_lost,
    coalesce(sum(toxic) filter (reached and fails), 0)::bigint as toxic_lost
  from c group by all)
select part, filter_order, step::int as step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) over (partition by part, own))::bigint as shapley from s
"""
