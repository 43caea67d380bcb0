"""Filter audit, periodic runs and toxicity against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter
from itertools import permutations

import numpy as np
from pyspark.sql import functions as F

from lintlake.llm import filter_audit, periodic_runs, toxicity
from tests.llm.cases import SCHEMA, empty, hard, hard_rows, rows_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "/root/testdata/sf0.001/documents.parquet"
LABELS = "doc_id long, quality int, toxic int, lang string"


def plain_audit(rows, labels):
    """Filters applied one after the other to lists of documents, for each of the 120 orders."""
    def fails(r):
        text = r[1] or ""
        w = WORD.findall(text)
        capitals = sum("A" <= c <= "Z" for c in text)
        smaller = [o[0] for o in rows if (o[1] or "") == text and o[0] is not None and (r[0] is None or o[0] < r[0])]
        return {
            "A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * capitals > 10 * len(text),
            "D": any(c in text for c in "#$%&*|"), "E": bool(smaller),
        }

    good = {r[0] for r in labels if r[1] == 1 and r[0] is not None}
    toxic = {r[0] for r in labels if r[2] == 1 and r[0] is not None}
    out = Counter()
    for part in {r[2] or "" for r in rows}:
        own = [(r[0], fails(r)) for r in rows if (r[2] or "") == part]
        removed_by = Counter()
        lines = []
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, f in enumerate(order, 1):
                gone = [r for r in left if r[1][f]]
                left = [r for r in left if not r[1][f]]
                failing = [r for r in own if r[1][f]]
                removed_by[f] += len(gone)
                alone = sum(sum(r[1].values()) == 1 for r in failing)
                counts = (len(left), len(gone), len(failing) - len(gone), alone, sum(r[0] in good for r in gone), sum(r[0] in toxic for r in gone))
                lines.append((part, order, step, *counts, f))
        out.update((*line[:-1], removed_by[line[-1]]) for line in lines)
    return out


def test_audit_is_that_of_filters_run_in_every_order(spark):
    rows = [*hard_rows(), (40, "HELLO $ " * 200, None, "s", None, "", 1, ""), (41, "a b " * 60, "de", None, None, None, None, None)]
    labels = [(0, 1, 1, "x"), (0, 0, 0, "x"), (1, 1, None, "x"), (2, None, 1, "x"), (None, 1, 1, "x"), (40, 0, 1, "x"), (99, 1, 1, "x")]
    got = rows_of(filter_audit.audit(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, LABELS)))
    names = ("part", "filter_order", "step", *filter_audit.COUNTS)
    assert Counter(tuple(g[n] for n in names) for g in got) == plain_audit(rows, labels)


def test_audit_of_no_documents_and_no_labels(spark):
    none = spark.createDataFrame([], LABELS)
    assert rows_of(filter_audit.audit(empty(spark), none)) == []
    got = filter_audit.audit(hard(spark), none)
    assert got.count() == 600 * hard(spark).select(F.coalesce("lang", F.lit(""))).distinct().count()
    assert got.where("good_lost > 0 or toxic_lost > 0").count() == 0


def test_audit_of_documents(spark):
    """The identities that hold in every audit, over a whole table."""
    docs = spark.read.parquet(DOCS)
    got = rows_of(filter_audit.audit(docs, spark.read.parquet(DOCS.replace("documents", "labels"))))
    total = {r["part"]: r["n"] for r in docs.groupBy(F.coalesce("lang", F.lit("")).alias("part")).agg(F.count("*").alias("n")).collect()}
    assert len(got) == 600 * len(total)
    last = {(g["part"], g["kept"]) for g in got if g["step"] == 5}
    assert len(last) == len(total)  # what is left at the end is the same in every order
    for g in got:
        assert g["unique_fails"] <= g["removed"] <= total[g["part"]] and g["redundant"] >= 0


def plain_runs(ids):
    """Every run of a sequence, by trying every period."""
    ids, out = np.asarray(ids), []
    n = len(ids)
    for q in range(1, n // 3 + 1):
        equal = np.concatenate(([False], ids[:-q] == ids[q:], [False])).astype(np.int8)
        edge = np.diff(equal)
        for s, e in zip(np.flatnonzero(edge == 1).tolist(), (np.flatnonzero(edge == -1) + q).tolist(), strict=True):
            least = not any((ids[s : e - r] == ids[s + r : e]).all() for r in range(1, q))
            if e - s >= max(24, 3 * q) and least:
                out.append((s, e - s, q))
    return sorted(out)


def sequences():
    rng = random.Random(5)
    for _ in range(150):
        n, k = rng.randrange(20, 220), rng.choice([1, 2, 2, 3, 5])
        w = [rng.randrange(k) for _ in range(n)]
        for _ in range(rng.randrange(4)):
            a = rng.randrange(n)
            p = 1 + rng.randrange(max(1, (n - a) // 3))
            for i in range(a + p, min(n, a + rng.randrange(p, n + 1))):
                w[i] = w[i - p]
        yield w
    x, y = [0], [1]
    for _ in range(7):  # words whose polynomial hashes modulo powers of two are equal
        x, y = x + y, y + x
    yield x * 3
    a, b = [0], [0, 1]
    for _ in range(11):  # overlapping runs of many periods
        a, b = b, b + a
    yield b
    yield [0] * 23
    yield [0, 1, 2, 3, 4, 5, 6, 7] * 3


def test_runs_are_those_of_all_periods_however_words_are_appended():
    found = 0
    for i, w in enumerate(sequences()):
        want, ids = plain_runs(w), np.array(w, np.int64)
        found += len(want)
        for step in (1, 7, 64, 5000) if i % 5 == 0 else (13, 5000):
            assert periodic_runs.runs_of(ids, step) == want
    assert found > 100


def test_long_runs_take_few_steps():
    for w, want in (
        (np.zeros(200_000, np.int64), [(0, 200_000, 1)]),
        (np.tile(np.arange(1000), 200), [(0, 200_000, 1000)]),
        (np.concatenate((np.arange(50_000), np.tile(np.arange(7), 9), np.arange(50_000))), [(50_000, 70, 7)]),
    ):
        assert periodic_runs.runs_of(w) == want


def plain_summary(doc_id, text):
    w = WORD.findall(text or "")
    n, h = len(w), zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    ids = {}
    runs = plain_runs([ids.setdefault(x, len(ids)) for x in w])
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    from fractions import Fraction

    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (
        doc_id, len(runs), *best, best[1] and 1000 * best[1] // best[2],
        digest("".join(f"{s},{m},{q}\n" for s, m, q in runs)), digest(" ".join(x for i, x in enumerate(w) if i not in gone)),
    )


def shown_runs(df):
    names = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    return Counter(tuple(r[n] for n in names) for r in rows_of(df))


def test_run_summaries(spark):
    docs = spark.read.parquet(DOCS)
    want = Counter(plain_summary(r["doc_id"], r["text"]) for r in docs.collect() if len((r["text"] or "").split()) < 1500)
    got = shown_runs(periodic_runs.query(spark, DOCS.rsplit("/", 1)[0]))
    assert sum(got.values()) == docs.count() and not want - got
    assert sum(k[1] > 0 for k in got) > 10


def test_runs_of_hard_rows(spark):
    small = hard(spark).where("length(text) < 6000 or text is null")
    kept = [(r["doc_id"], r["text"]) for r in small.collect()]
    got = periodic_runs.summary(periodic_runs.collapse(periodic_runs.rewritten(small)))
    assert shown_runs(got) == Counter(plain_summary(*r) for r in kept)
    whole = periodic_runs.collapse(hard(spark).withColumnRenamed("row", "runs"))
    assert whole.columns == [*hard(spark).withColumnRenamed("row", "runs").columns, "runs", "collapsed"]
    assert "word" in [r[-1] for r in whole.collect()]
    assert rows_of(periodic_runs.collapse(empty(spark))) == []


BAD = ("idiot", "worthless", "moron", "pathetic", "scum")
GOOD = "the of and garden river lantern window quiet table morning letter harbour walking people story small mail7".split()


def talk(n=240, seed=4):
    """Small talk; every fourth document holds an insult. As many again, held out, hold disguised ones."""
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        w = [rng.choice(GOOD) for _ in range(rng.randrange(12, 60))]
        if i % 4 == 0:
            w.insert(rng.randrange(len(w)), BAD[i // 4 % len(BAD)])
        rows.append((i, " ".join(w), "en", "s", None, None, None, None))
        labels.append((i, None, int(i % 4 == 0), "en"))
    return rows, labels


DISGUISED = {
    "1d10t": "idiot", "m o r o n": "moron", "w-o-r-t-h-l-e-s-s": "worthless", "p@th3tic": "pathetic", "sc.um": "scum", "idiooooot": "idiot",
    "$cum": "scum", "M0R0N!!": "moron!!",
}
PLAIN = ("mail7", "jo.81@mail7.example.com", "2020", "story***", "https://a.b/c1d2", "walking, people.", "", "  \t")


def model_of(spark, rows, labels):
    docs, told = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, LABELS)
    return toxicity.fit(docs, told, ~toxicity.held_out())


def test_disguised_words_are_restored_and_scored(spark):
    model = model_of(spark, *talk())
    decoder = toxicity.Decoder(model[0])
    assert {w: decoder.restored(w) for w in DISGUISED} == DISGUISED
    assert [decoder.restored(w) for w in PLAIN] == list(PLAIN)
    texts = [f"the quiet garden {w} small table morning" for w in (*DISGUISED, *BAD, *PLAIN)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model, ["doc_id"]).collect()}
    bad = len(DISGUISED) + len(BAD)
    assert min(got[i] for i in range(bad)) > 0.5 > max(got[i] for i in range(bad, len(texts)))
    restored = toxicity.restore(docs, model[0], ["doc_id"]).collect()
    assert {r["restored"] for r in restored if r["doc_id"] == 0} == {"the quiet garden idiot small table morning"}


def test_lattice_decoding_is_the_least_of_all_readings():
    rng = np.random.default_rng(3)
    costs = toxicity.costs_of(rng.integers(0, 50, toxicity.CELLS).astype(float))

    def cost(string):
        at, total = 0, 0.0
        for c in string + " ":
            cell = at * toxicity.SYMBOLS + toxicity._symbol(c)
            total, at = total + float(costs[cell]), cell % (toxicity.CELLS // toxicity.SYMBOLS)
        return total

    def readings(arcs):
        if not arcs:
            yield "", 0.0
            return
        for string, price in arcs[0]:
            for rest, more in readings(arcs[1:]):
                yield string + rest, price + more

    for token in ("1d10t", "m o r", "a--b", "sss1", "$t4r", "x"):
        arcs = toxicity.lattice(token)
        best = min(price + cost(string) for string, price in readings(arcs))
        found = toxicity.viterbi(arcs, costs)
        assert abs(min(p for s, p in readings(arcs) if s == found) + cost(found) - best) < 1e-6


def test_one_insult_in_a_long_text_counts(spark):
    model = model_of(spark, *talk())
    long = " ".join(GOOD * 2000)
    docs = spark.createDataFrame([(0, long), (1, long + " moron"), (2, None)], "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model, ["doc_id"]).collect()}
    assert got[1] > got[0] and got[0] < 0.5 and got[2] < 0.5


def test_toxicity_of_hard_rows_and_missing_labels(spark):
    none = spark.createDataFrame([], LABELS)
    docs = hard(spark)
    got = toxicity.classify(docs, none)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    assert {(r["score"] < 1e-9, r["predicted"]) for r in got.collect()} == {(True, 0)}
    rows, labels = talk()
    told = spark.createDataFrame([*labels, (None, 1, 1, "x"), (7, 0, None, "x"), (99999, 0, 1, "x")], LABELS)
    mixed = spark.createDataFrame([*rows, *hard_rows()], SCHEMA)
    got = rows_of(toxicity.classify(mixed, told))
    assert len(got) == len(rows) + len(hard_rows()) and all(0 <= g["score"] <= 1 for g in got)
    assert len({g["score"] for g in got if g["doc_id"] is None}) <= 2
    only = spark.createDataFrame([(r[0], 0, 0, "x") for r in labels], LABELS)
    assert sum(g["predicted"] for g in rows_of(toxicity.classify(mixed, only))) == 0
    assert rows_of(toxicity.classify(empty(spark), told)) == []


def test_toxicity_of_documents_that_were_held_out(spark):
    """Insults in English documents are found; clean documents are left alone."""
    folder = "/root/testdata/sf0.01"
    told = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    english = {r["doc_id"] for r in spark.read.parquet(f"{folder}/documents.parquet").where("lang = 'en'").collect()}
    got = [g for g in rows_of(toxicity.query(spark, folder)) if g["held_out"] and g["doc_id"] in told]
    clean = [g["predicted"] for g in got if told[g["doc_id"]] == 0]
    assert sum(clean) <= 0.05 * len(clean)
    toxic = [g["score"] for g in got if told[g["doc_id"]] == 1 and g["doc_id"] in english]
    fine = [g["score"] for g in got if told[g["doc_id"]] == 0 and g["doc_id"] in english]
    pairs = [(t > f) + 0.5 * (t == f) for t in toxic for f in fine]
    assert sum(pairs) >= 0.9 * len(pairs)
