"""Committed exports, and redaction by many literals."""

import random

import pytest
from pyspark.sql import functions as F

from lintlake.operators import redaction as X
from lintlake.operators.exports import ExportError, Exports

ROWS = "run_id string, path string, text string"


def test_an_export_is_committed_as_a_whole_or_not_at_all(spark, tmp_path):
    rows = spark.createDataFrame([("r", "review/a.txt", "at /work/src/a.c key s3cr3t-value"), ("r", "llm/units/x.c", "int x;"), ("r", "n.txt", None)], ROWS)
    exports = Exports(spark, str(tmp_path))
    assert exports.committed().count() == 0
    name = exports.publish(rows, {"/work/src": "<SRC>"}, ["s3cr3t-value"])
    assert {(r["path"], r["status"], r["sha256"] is None) for r in exports.manifest(name).collect()} >= {("llm/units/x.c", "excluded", True)}
    assert "at <SRC>/a.c key <SECRET>" in [r["text"] for r in exports.read(name).collect()]
    assert exports.damaged(name).count() == 0

    def broken(value):
        raise RuntimeError("a task fails")

    failing = rows.withColumn("text", F.when(F.col("path") == "review/a.txt", F.udf(broken, "string")("text")).otherwise(F.col("text")))
    with pytest.raises(Exception, match="a task fails"):
        exports.publish(failing, {}, [])
    assert [r["export"] for r in exports.committed().collect()] == [name]
    with pytest.raises(ExportError, match="no committed export"):
        exports.read("another")


def test_what_still_leaks_is_not_committed(spark, tmp_path, monkeypatch):
    rows = spark.createDataFrame([("r", "review/a.txt", "key s3cr3t-value")], ROWS)
    exports = Exports(spark, str(tmp_path))
    monkeypatch.setattr("lintlake.operators.exports.sanitised", lambda a, p, s: a.withColumns({"kind": F.lit("text"), "status": F.lit("shipped"), "problem": F.lit(None).cast("string")}))
    with pytest.raises(ExportError, match="secret_value: 1"):
        exports.publish(rows, {}, ["s3cr3t-value"])
    assert exports.committed().count() == 0


def test_many_literals_are_replaced_as_one_after_the_other():
    rng = random.Random(6)
    for _ in range(500):
        literals = list({"".join(rng.choice("abc") for _ in range(rng.randrange(2, 6))) for _ in range(6)})
        rules = tuple(("secret_value", v, "#") for v in sorted(literals, key=lambda v: (-len(v), v)))
        text = "".join(rng.choice("abc.") for _ in range(rng.randrange(40)))
        want, n = text, 0
        for _, v, token in rules:
            n += want.count(v)
            want = want.replace(v, token)
        assert X.replaced_literals(text, rules) == (want, [("secret_value", n)] if n else [])


def test_a_thousand_secrets_give_what_a_few_give(spark):
    texts = spark.createDataFrame([(0, "a token-0001-x and token-0002-x /work/src/m.c"), (1, None), (2, "")], "i int, t string")
    few = ["token-0001-x", "token-0002-x"]
    many = few + [f"other-{i:05d}" for i in range(1000)]
    shown = lambda secrets: sorted(map(tuple, X.redact(texts, "t", {"/work/src": "<SRC>"}, secrets).collect()))
    assert shown(few) == shown(many)
    leaks = lambda secrets: sorted((r["i"], r["leak"]) for r in X.leaks(texts.where("t is not null"), "t", {"/work/src": "<SRC>"}, secrets).distinct().collect())
    assert leaks(few) == leaks(many) == [(0, "dynamic_prefix"), (0, "secret_value")]
