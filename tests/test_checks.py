import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from plumbline.core import Category, Check, CheckResult, Dataset, Suite, SuiteResult, at_most
from plumbline.functions.strings import average_word_length, email_addresses_count, urls_count
from plumbline.operators import evaluation, integrity, models, neighbours, power, text, train_test, vision
from plumbline.plans import suites


def test_duplicates_count_nulls_as_equal(spark):
    df = spark.createDataFrame([(1, None)] * 4 + [(i, "x") for i in range(5)] + [(0, "x")], "a int, b string")
    assert integrity.data_duplicates(df).first().percent == pytest.approx(0.4)


def test_percent_of_nulls_counts_nan(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", math.nan), (None, None), (None, 2.0)], "foo string, bar double")
    assert {r.column: r.percent for r in integrity.percent_of_nulls(df).collect()} == {"foo": 0.5, "bar": 0.5}


def test_string_mismatch(spark):
    df = spark.createDataFrame([(x,) for x in ["Deep", "deep", "deep!!!", "$deeP$", "earth", "foo", "bar", "foo?"]], "c string")
    found = integrity.string_mismatch(df).groupBy("base").count().collect()
    assert {r.base: r["count"] for r in found} == {"deep": 4, "foo": 2}


def test_index_leakage(spark):
    ids = lambda v: spark.createDataFrame([(x,) for x in v], "i int")
    assert train_test.index_leakage(ids([1, 2, 3, 4, 10, 11]), ids([4, 5, 6, 7]), "i").first().ratio == 0.25


def test_new_category(spark):
    col = lambda v: spark.createDataFrame([(x,) for x in v], "c string")
    (row,) = train_test.new_categories(col("abc"), col("abcd"), ["c"]).collect()
    assert (row.category, row.n, row.ratio) == ("d", 1, 0.25)


def test_conflicting_labels_and_mixed_nulls(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (None, "a"), (None, "c")], "x int, y string")
    assert integrity.conflicting_labels(df, ["x"], "y").first().percent == 0.8
    nulls = spark.createDataFrame([("None",), ("null",), ("x",), (None,), ("",)], "c string")
    assert {r.kind: r.n for r in integrity.mixed_nulls(nulls).collect()} == {"None": 1, "null": 1, "<null>": 1, "": 1}


def test_empty_table(spark):
    empty = spark.createDataFrame([], "a int, b string")
    assert integrity.data_duplicates(empty).first().percent is None
    assert integrity.string_mismatch(empty).count() == 0
    assert integrity.class_imbalance(empty, "b").count() == 0


def test_perfect_and_absent_classes(spark):
    df = spark.createDataFrame([("a", "a"), ("b", "b"), ("b", "c"), (None, "a")], "y string, p string")
    per = {r["class"]: r for r in evaluation.class_metrics(df, "y", "p").collect()}
    assert per["a"].f1 == 1 and per["c"].support == 0 and per["c"].recall == 0
    assert evaluation.averaged_metrics(df, "y", "p").first().accuracy == pytest.approx(2 / 3)


def test_text_properties(spark):
    df = spark.createDataFrame([("see http://a.b and https://c.d x@y.org",), ("",), (None,)], "t string")
    got = df.select(urls_count(F.col("t")).alias("u"), email_addresses_count(F.col("t")).alias("e"), average_word_length(F.col("t")).alias("w")).collect()
    assert (got[0].u, got[0].e) == (2, 1) and (got[1].u, got[1].w) == (0, 0.0) and got[2].u is None


def test_text_duplicates_normalise(spark):
    df = spark.createDataFrame([("Hello, World!",), ("hello world",), ("bye",)], "t string")
    assert text.text_duplicates(df, "t").first().percent == pytest.approx(1 / 3)


def test_token_metrics(spark):
    df = spark.createDataFrame([(1, ["B-P", "I-P", "O", "B-Q"], ["B-P", "I-P", "O", "O"])], "i int, y array<string>, p array<string>")
    per = {r["class"]: r for r in text.token_metrics(df, "i", "y", "p").collect()}
    assert per["P"].f1 == 1 and per["Q"].recall == 0


def test_token_spans_equal_brute_force_and_shuffle_classes_only(spark):
    """Spans of odd tags against plain Python, also where ids are missing or occur twice, which the SQL counts too."""
    rng = random.Random(5)
    tags = ["O", "B-P", "I-P", "B-Q", "I-Q", "P", "O-P", None, "B-"]
    rows = [(None if i % 7 == 0 else i // 2, *([rng.choice(tags) for _ in range(n)] for _ in range(2))) for i, n in enumerate([*range(12), *[9] * 40])] + [(99, None, ["B-P"])]

    def spans(x):
        out, before = set(), None
        for i, t in enumerate(x or []):
            kind = None if t is None or t == "O" else t[2:] if t[:2] in ("B-", "I-", "O-") else t
            if kind is not None and (t.startswith("B-") or kind != before or not i):
                out.add((kind, i, i))
                begun = (kind, i, i)
            elif kind is not None:
                out.discard(begun)
                begun = (kind, begun[1], i)
                out.add(begun)
            before = kind
        return out

    df = spark.createDataFrame(rows, "i int, y array<string>, p array<string>")
    plan = text.token_metrics(df, "i", "y", "p")
    assert "Window" not in plan._jdf.queryExecution().toString() and "Join" not in plan._jdf.queryExecution().toString()
    want = {}
    for _, y, p in rows:
        for k, found in enumerate((spans(y), spans(p), spans(y) & spans(p))):
            for c, _, _ in found:
                want.setdefault(c, [0, 0, 0])[k] += 1
    got = {r["class"]: (r.support, r.precision, r.recall) for r in plan.collect()}
    assert got == {c: (n, both / said if said else 0.0, both / n if n else 0.0) for c, (n, said, both) in want.items()}
    assert sorted(tuple(r)[1:] for r in text.entity_spans(df, "i", "p").collect()) == sorted(s for _, _, p in rows for s in spans(p))


def test_detection_and_segmentation(spark):
    box = "array<struct<cls:long,x:double,y:double,w:double,h:double>>"
    said = "array<struct<cls:long,x:double,y:double,w:double,h:double,conf:double>>"
    df = spark.createDataFrame([(1, [(0, 0.0, 0.0, 10.0, 10.0)], [(0, 0.0, 0.0, 10.0, 10.0, 0.9), (0, 50.0, 0.0, 5.0, 5.0, 0.8)])], f"i long, g {box}, p {said}")
    row = vision.detection_metrics(df, "i", "g", "p").first()
    assert (row.tp, row.fp, row.fn) == (1, 1, 0)
    assert {r.iou: r.ap for r in vision.mean_average_precision(df, "i", "g", "p", (0.5, 0.95)).collect()} == {0.5: 1.0, 0.95: 1.0}
    masks = spark.createDataFrame([([0, 0, 1, 1], [0, 1, 1, 1])], "g array<int>, p array<int>")
    assert {r.cls: round(r.iou, 2) for r in vision.segmentation_metrics(masks, "g", "p").collect()} == {0: 0.5, 1: 0.67}


def test_outlier_scores_single_out_the_far_row(spark):
    rows = spark.createDataFrame([(i, float(i % 10), "a") for i in range(60)] + [(99, 500.0, "z")], "id long, x double, c string")
    top = integrity.outlier_samples(rows, rows, "id", ["x"], ["c"]).orderBy(F.desc("score")).first()
    assert top.id == 99 and top.score > 0.7


def test_outlier_scores_read_all_rows(spark):
    rows = spark.createDataFrame([(i, float(i * 7 % 90) if i % 11 else None, "ab"[i % 2] if i % 13 else None) for i in range(90)] + [(99, 500.0, "z")], "id long, x double, c string")
    want = {(r.id, r.neighbour): r.distance for r in integrity.nearest_neighbours(rows, rows, "id", ["x"], ["c"], 4).collect()}
    got = {(r.id, r.neighbour): r.distance for r in integrity.all_neighbours(rows, "id", ["x"], ["c"], 4, block=20).collect()}
    assert set(got) == set(want) and all(got[p] == pytest.approx(want[p]) for p in want)
    every = {r.id: r.score for r in integrity.outlier_samples(rows, rows, "id", ["x"], ["c"], 5).collect()}
    some = {r.id: r.score for r in integrity.outlier_samples(rows, rows.where("id > 85"), "id", ["x"], ["c"], 5).collect()}
    assert len(every) == 91 and some == {i: pytest.approx(every[i]) for i in (86, 87, 88, 89, 99)}


def test_predictive_power(spark):
    rows = spark.range(400).select((F.col("id") % 4).cast("double").alias("x"), (F.xxhash64("id") % 100).cast("double").alias("noise"), (F.col("id") % 2).cast("string").alias("y"))
    score = {r.feature: r.score for r in models.predictive_power(rows, ["x", "noise"], "y").collect()}
    assert score["x"] > 0.95 and score["noise"] < 0.3


def test_models_report_all_rows(spark, monkeypatch):
    rows = spark.range(600).select((F.col("id") / 600).alias("a"), (F.col("id") * 7 % 600 / 600).alias("b"), (F.col("id") >= 180).cast("double").alias("s"))
    found = models.weak_segments(rows, ["a", "b"], "s").first()
    assert found.average == pytest.approx(0.7) and found.score < 0.1 and found.n > 100  # of the 200 that are fitted, some 50
    cells = power.power_cells(rows.withColumn("s", F.col("s").cast("string")), ["a", "b"], "s")
    assert {r.feature: r.n for r in cells.groupBy("feature").agg(F.sum("n").alias("n")).collect()} == {"a": 600, "b": 600}
    assert models.predictive_power(rows.withColumn("s", F.col("s").cast("string")), ["a"], "s").first().score > 0.9
    seen, evaluate = [], models.BinaryClassificationEvaluator.evaluate
    monkeypatch.setattr(models.BinaryClassificationEvaluator, "evaluate", lambda self, df: seen.append(df.count()) or evaluate(self, df))
    far = models.domain_classifier(rows.where("s = 0"), rows.where("s = 1"), ["a", "b"], [], n_samples=100).first()
    assert far.auc > 0.95 and 400 < seen[-1] < 500


def test_frequent_substrings_grow_to_the_shared_sentence(spark):
    shared = " ".join(f"s{k}" for k in range(20)) + "."
    rows = [(f"a{i} b{i} c{i} d{i} e{i}. " + (shared if i % 2 else "") + f" f{i} g{i} h{i} i{i}.",) for i in range(40)] + [(None,)]
    found = text.frequent_substrings(spark.createDataFrame(rows, "t string"), "t").collect()
    assert [tuple(r) for r in found] == [(shared, 20, 0.5)]
    # A part that is more frequent by the margin stays in place of the whole; so does what comes before a steep drop.
    assert text._longest_runs({"a b c d e": 0.1, "a b c d": 0.3, "b c d e": 0.1}, 0.02) == {"a b c d": 0.3, "b c d e": 0.1}
    assert [g for g, _ in text._frequency_cut({"a": 0.2, "b": 0.19, "c": 0.06}, 0.3, 0.05)] == ["a", "b"]
    assert [g for g, _ in text._frequency_cut({"a": 0.9, "b": 0.31, "c": 0.3}, 0.3, 0.05)] == ["a", "b", "c"]


def test_frequent_substrings_keep_only_what_may_be_frequent(spark, monkeypatch):
    """Texts are cut to their frequent stretches before longer runs are counted, and all counts are those of brute force."""
    rng = random.Random(8)
    phrases = [" ".join(f"p{k}w{i}" for i in range(6 + 9 * k)) for k in range(4)]
    texts = []
    for i in range(60):
        parts = [" ".join(f"u{i}x{j}x{k}" for k in range(12)) if rng.random() < 0.7 else rng.choice(phrases) for j in range(5)]
        texts.append(" ".join(parts) + ("" if i % 9 else " " + " ".join(parts[:1])))
    kept, ratios, kept_at, cut = [], [], text.kept_at, text._longest_runs
    monkeypatch.setattr(text, "kept_at", lambda df: kept.append(kept_at(df)) or kept[-1])
    sizes = []
    monkeypatch.setattr(text, "remove", lambda spark, place: sizes.append(sum(len(str(r[-1]).split()) for r in spark.read.parquet(place).collect())))
    monkeypatch.setattr(text, "_longest_runs", lambda ratio, margin: ratios.append(ratio) or cut(ratio, margin))
    text.frequent_substrings(spark.createDataFrame([(t,) for t in texts], "t string"), "t", min_ratio=0.05).collect()
    want = Counter()
    for t in texts:
        w = t.split()
        want.update({" ".join(w[i : i + n]) for n in range(4, len(w) + 1) for i in range(len(w) - n + 1)})
    assert ratios == [{g: n / 60 for g, n in want.items() if n >= 3}] and max(g.count(" ") for g in ratios[0]) > 20
    assert sizes[1] < sizes[0] / 2  # the words of no frequent run are gone after the first round


def test_conditions_and_writers(spark):
    df = spark.createDataFrame([(None, "a"), (1, "b")], "x int, y string")
    nulls = Check("nulls", lambda d: integrity.percent_of_nulls(d.df), (at_most("percent", 0.05),))
    broken = Check("broken", lambda d: d.df.select("absent"))
    result = Suite("s", nulls, Suite("inner", broken)).run(Dataset(df, label="y"))
    assert result.results[0].conditions[0].category is Category.FAIL and result.results[1].error
    assert not result.passed
    again = SuiteResult.from_json(result.to_json())
    assert again.results[0].to_dict() == CheckResult.from_json(result.results[0].to_json()).to_dict()
    assert 'failures="1" errors="1"' in result.to_junit() and "<table>" in result.to_html() and "| nulls |" in result.to_markdown()
    assert result.frame(spark).count() == 2


def test_suites_run(spark):
    df = spark.range(300).select("id", (F.col("id") % 3).cast("string").alias("y"), (F.col("id") % 50).cast("double").alias("x"), F.lit("one").alias("c"), F.timestamp_seconds(F.col("id") * 1000).alias("t"), (F.col("id") % 3).cast("string").alias("p"))
    d = Dataset(df, label="y", index="id", datetime="t", features=("x", "c"))
    train, test = d.split(0.5, by=["id"])
    assert not [r.error for r in suites.data_integrity().run(d).results if r.error]
    assert not [r.error for r in suites.train_test_validation().run(train, test).results if r.error]
    found = suites.model_evaluation("p").run(train, test)
    assert not [r.error for r in found.results if r.error] and found.results[0].passed


def test_streams_match_batches(spark, tmp_path):
    from plumbline.streaming import checks as streams

    rows = spark.range(500).select(F.timestamp_seconds(F.col("id") * 700).alias("ts"), F.col("id").cast("double").alias("value"), (F.col("id") % 3).cast("string").alias("kind"))
    rows.write.parquet(str(tmp_path / "in"))
    given = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    query = streams.windowed_values(given, "ts", "value", "kind").writeStream.format("memory").queryName("w").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    want = {tuple(r) for r in streams.windowed_values(rows, "ts", "value", "kind").collect()}
    assert {tuple(r) for r in spark.table("w").collect()} == want
    seen = []
    run = streams.drift_of_batches(given, rows, ["value"], ["kind"], lambda df, n: seen.append(df.count()), str(tmp_path / "ck"))
    run.processAllAvailable()
    run.stop()
    assert seen == [2]


def test_formatting():
    from datetime import datetime

    from plumbline.functions.formatting import format_datetime, format_list, format_number, format_percent, split_camel_case, to_snake_case

    assert split_camel_case("TextLength") == "Text Length" and to_snake_case("TextLength") == "text_length"
    assert format_percent(0.5) == "50%" and format_percent(0.999999) == "99.99%" and format_percent(0.1234, sign=True) == "+12.34%"
    assert format_number(1234.5) == "1,234.5" and format_list(list(range(12)), 2) == "0, 1, and 10 more"
    assert format_datetime(datetime(2020, 1, 2)) == "2020/01/02"


def test_boxes_and_heatmaps(spark):
    box, said = "array<struct<cls:long,x:double,y:double,w:double,h:double>>", "array<struct<cls:long,x:double,y:double,w:double,h:double,conf:double>>"
    df = spark.createDataFrame([(1, [(0, 0.0, 0.0, 10.0, 10.0), (1, 30.0, 0.0, 5.0, 5.0)], [(1, 0.0, 0.0, 10.0, 10.0, 0.9), (1, 30.0, 0.0, 5.0, 5.0, 0.1)])], f"i long, g {box}, p {said}")
    assert {tuple(r) for r in vision.detection_confusion(df, "i", "g", "p").collect()} == {(0, 1, 1), (1, -1, 1)}
    other = spark.createDataFrame([(1, [(7, 0.0, 0.0, 1.0, 1.0)], [])], df.schema)
    assert [tuple(r) for r in vision.new_box_labels(df, other, "g").collect()] == [(7, 1, 1.0)]
    image = lambda v: spark.createDataFrame([([float(v)] * 4,)], "p array<double>")
    assert {r.difference for r in vision.heatmap_comparison(image(1), image(3), "p").collect()} == {2.0}


def test_named_metrics_and_simple_models(spark):
    df = spark.createDataFrame([(i, "a" if i % 4 else "b", "a") for i in range(40)], "i long, y string, p string")
    rows = {(r.metric, r["class"]): r.value for r in evaluation.score(df, "y", "p", ["accuracy", "recall"]).collect()}
    assert rows[("accuracy", None)] == 0.75 and rows[("recall", "a")] == 1
    assert {r.simple for r in models.simple_predictions(df, "y", ["i"]).collect()} == {"a"}
    drawn = models.simple_predictions(df, "y", ["i"], "stratified").groupBy("simple").count().collect()
    assert {r.simple for r in drawn} == {"a", "b"} and max(drawn, key=lambda r: r["count"]).simple == "a"
    assert evaluation.log_loss(spark.createDataFrame([("a", [0.5, 0.5])], "y string, p array<double>"), "y", "p", ["a", "b"]).first().log_loss == pytest.approx(math.log(2))


@pytest.mark.parametrize(("k", "block", "pivots"), [(1, 2048, None), (4, 16, 9), (7, 5, 40), (300, 64, 6)])
def test_neighbours_equal_brute_force(spark, k, block, pivots):
    """Nulls of several kinds, ties, copies, a column without spread, and rows that are asked but are none of the table."""
    rng = random.Random(k)
    row = lambda i: (i, rng.choice([None, rng.randrange(6) * 1.0, rng.random() * 6]), rng.choice([None, rng.gauss(0, 1)]), 3.0, rng.choice(["a", "b", None]))
    rows = [row(i) for i in range(150)] + [(200 + i, 1.0, 0.5, 3.0, "a") for i in range(60)] + [(None, 1.0, 1.0, 3.0, "a")]
    more = [row(i) for i in range(140, 160)] + [(500, None, None, None, "b"), (None, 1.0, 1.0, 3.0, "a")]
    schema = "id long, x double, y double, z double, c string"
    df, asked = (spark.createDataFrame(r, schema).repartition(3) for r in (rows, more))
    width = [max(r[j] for r in rows if r[j] is not None) - min(r[j] for r in rows if r[j] is not None) for j in (1, 2, 3)]

    def brute(a):
        near = []
        for b in rows:
            if b[0] is not None and b[0] != a[0]:
                both = [j for j in (1, 2, 3) if a[j] is not None and b[j] is not None]
                near.append(((sum(abs(a[j] - b[j]) / width[j - 1] for j in both if width[j - 1]) + (a[4] != b[4])) / (len(both) + 1), b[0]))
        return sorted((round(d, 9), i) for d, i in near)[:k]

    for given, queries in ((rows, None), (more, asked)):
        counted = spark.sparkContext.accumulator(0)
        got = {}
        for r in neighbours.gower_neighbours(df, queries, "id", ["x", "y", "z"], ["c"], k, block, pivots, counted).collect():
            got.setdefault(r.id, []).append((round(r.distance, 9), r.neighbour, r.place))
        assert {i: sorted(x[:2] for x in v) for i, v in got.items()} == {a[0]: brute(a) for a in given if a[0] is not None}
        assert all([x[2] for x in sorted(v)] == list(range(1, len(v) + 1)) for v in got.values())
        assert 0 < counted.value <= len(given) * len(rows)


def test_neighbours_compare_few_pairs(spark):
    df = spark.range(3000).select("id", (F.hash("id") % 1000).cast("double").alias("x"), (F.hash(F.lit(1), "id") % 1000).cast("double").alias("y"), (F.col("id") % 5).cast("string").alias("c"))
    counted = spark.sparkContext.accumulator(0)
    assert neighbours.gower_neighbours(df, None, "id", ["x", "y"], ["c"], 5, compared=counted).count() == 15_000
    assert counted.value < 0.1 * 3000 * 3000
    assert neighbours.gower_neighbours(df.limit(0), None, "id", ["x", "y"], ["c"], 5).count() == 0


def test_sample_and_rest_are_the_table(spark):
    rows = [(i % 40 if i % 7 else None, ["a", None, "b"][i % 3]) for i in range(300)] + [(1, "a")] * 200
    df = spark.createDataFrame(rows, "x int, y string").repartition(4)
    for n in (0, 1, 37, 250, 499, 500, 900):
        sample, rest = models.sample_and_rest(df, n, ["x", "y"])
        assert sample.count() == min(n, 500)
        assert sorted(map(tuple, sample.collect() + rest.collect()), key=str) == sorted(rows, key=str)
        again, _ = models.sample_and_rest(df.repartition(2), n, ["x", "y"])
        assert sorted(map(tuple, again.collect()), key=str) == sorted(map(tuple, sample.collect()), key=str)
    assert "Exchange" not in models.sample_and_rest(df.select("x", "y"), 37, ["x", "y"])[1]._jdf.queryExecution().optimizedPlan().toString()
