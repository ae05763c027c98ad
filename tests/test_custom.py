"""Models, metrics and properties that users bring; language; streams with state and late rows."""

import sys

import pandas as pd
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from plumbline.functions.language import WEIGHTS, train_language_model
from plumbline.operators import custom, evaluation, models
from plumbline.streaming import checks as streams

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import tests


class Rule:
    def predict(self, rows):
        return ["a" if x > 5 else "b" for x in rows["x"]]

    def predict_proba(self, rows):
        return [[0.9, 0.1] if x > 5 else [0.2, 0.8] for x in rows["x"]]


class MeanOf(custom.BatchMetric):
    def initial(self):
        return (0, 0.0)

    def update(self, state, batch):
        return state[0] + len(batch), state[1] + float(batch["x"].sum())

    def merge(self, a, b):
        return a[0] + b[0], a[1] + b[1]

    def compute(self, state):
        return state[1] / state[0] if state[0] else None


@pytest.fixture(scope="module")
def numbers(spark):
    return spark.range(40).select(F.col("id").cast("double").alias("x"), F.when(F.col("id") > 4, "a").otherwise("b").alias("y")).repartition(7)


def test_models_of_users(numbers):
    said, names = custom.FunctionModel(Rule(), ["x"], classes=["a", "b"]).with_scores(numbers)
    assert evaluation.averaged_metrics(said, "y", "prediction").first().accuracy == 39 / 40
    assert {r["class"] for r in evaluation.roc_auc(said, "y", names).collect()} == {"a", "b"}


def test_metrics_over_batches(numbers):
    assert custom.run_batch_metric(numbers, MeanOf(), ["x"], fan_in=2) == 19.5
    assert custom.run_batch_metric(numbers.where("x < 0"), MeanOf()) is None


def test_properties_of_users(spark, numbers):
    assert custom.batch_property(lambda part: part["x"] * 2, "twice")(numbers).where("twice != x * 2").count() == 0

    def classifier(texts):
        if len(texts) > 1 or "bad" in texts[0]:
            raise RuntimeError("too large")
        return [float(len(t.split())) for t in texts]

    df = spark.createDataFrame([("one two three four five",), ("bad",), (None,)], "t string")
    got = {r.t: r.v for r in custom.predict_in_chunks(df, "t", classifier, "v", chunk_words=2, batch=4).collect()}
    assert got["one two three four five"] == pytest.approx(5 / 3) and got["bad"] is None and got[None] is None


def test_checks_of_models():
    ok = custom.model_check("info", lambda m: [{"type": type(m).__name__}])(Rule())
    assert ok.rows == [{"type": "Rule"}] and custom.model_check("broken", lambda m: 1 / 0)(Rule()).error
    with pytest.raises(ImportError):
        custom.to_wandb(ok)


def test_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("length(text) > 100").select("doc_id", "text", "lang")
    own = train_language_model(docs.where("doc_id % 4 != 0"), "text", "lang", 800)
    got = docs.where("doc_id % 4 = 0").select("lang", own.language(F.col("text")).alias("said")).where("said is not null").agg(F.avg((F.col("lang") == F.col("said")).cast("double")), F.count("*")).first()
    assert got[0] > 0.9 and got[1] > 10
    # The whole text counts: what stands behind the first 600 characters too.
    one = lambda lang: docs.where(F.col("lang") == lang).orderBy("doc_id").first().text
    mixed = spark.createDataFrame([(one("en")[:600].ljust(600) + " " + one("de") * 30,)], "t string")
    assert mixed.select(own.language(F.col("t"))).first()[0] == "de"
    assert own.weight in WEIGHTS and 0 < len(own.table) <= 800
    assert spark.createDataFrame([("123 ...",), (" ",)], "t string").select(own.language(F.col("t")).alias("l")).where("l is not null").count() == 0
    empty = train_language_model(docs.limit(0), "text", "lang")
    assert docs.limit(2).select(empty.language(F.col("text")).alias("l")).where("l is not null").count() == 0
    assert spark.createDataFrame([("",), (None,)], "t string").select(own.language(F.col("t")).alias("l")).where("l is not null").count() == 0


def test_importance_permutes_without_a_whole_sort(numbers):
    df = numbers.withColumn("z", F.lit(1.0))
    got = {r.feature: r.importance for r in models.permutation_importance(df, custom.FunctionModel(Rule(), ["x"]), ["x", "z"], "y").collect()}
    assert got["x"] == 1.0 and got["z"] == 0.0


def test_streams_with_state_and_late_rows(spark, tmp_path):
    schema = "k string, v double, ts timestamp"
    first = [("a", 1.0, "2026-01-01 10:00:00"), ("a", 3.0, "2026-01-01 20:00:00"), ("b", 5.0, "2026-01-03 10:00:00")]
    second = [("a", 8.0, "2026-01-01 11:00:00"), ("b", 7.0, "2026-01-03 11:00:00")]
    write = lambda rows, n: spark.createDataFrame(pd.DataFrame(rows, columns=["k", "v", "ts"])).select("k", "v", F.to_timestamp("ts").alias("ts")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    write(first, 0)
    given = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    state = streams.running_values(given, "k", "v").writeStream.format("memory").queryName("state").outputMode("update").start()
    windows = streams.windowed_values(given, "ts", "v", "k", late="1 hour").writeStream.format("memory").queryName("late").outputMode("update").start()
    for q in (state, windows):
        q.processAllAvailable()
    write(second, 1)
    for q in (state, windows):
        q.processAllAvailable()
        q.stop()
    last = {}
    for r in spark.table("state").collect():
        if r.n > last.get(r.k, (0,))[0]:
            last[r.k] = (r.n, r["mean"], r.low, r.high)
    assert last == {"a": (3, 4.0, 1.0, 8.0), "b": (2, 6.0, 5.0, 7.0)}
    counts = {}
    for r in spark.table("late").collect():
        counts[str(r.window_start)[:10]] = max(r.n, counts.get(str(r.window_start)[:10], 0))
    assert counts == {"2026-01-01": 2, "2026-01-03": 2}  # the row that came after its window was closed is left out
