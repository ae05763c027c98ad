"""Curves of scores, importance by permutation, and checks that train models."""

import random

import pytest

from plumbline.operators import evaluation, models

ROWS = [(random.Random(i).choice("ab"), random.Random(i + 1).randrange(11) / 10, None if i % 9 == 0 else i % 7 / 6, 0.5) for i in range(120)] + [(None, 0.3, 0.3, 0.5), ("a", float("nan"), 0.0, 0.5)] * 2
SCHEMA = "y string, `s.a` double, sb double, sc double"
NAMES = {"a": "s.a", "b": "sb", "c": "sc"}


def scored(k, c):
    return [(r[k], r[0] == c) for r in ROWS if r[0] is not None and r[k] is not None and r[k] == r[k]]


def test_roc_curve_equals_brute_force(spark):
    got = {(r["class"], r.threshold): (r.tpr, r.fpr) for r in evaluation.roc_curve(spark.createDataFrame(ROWS, SCHEMA), "y", NAMES).collect()}
    want = {}
    for k, c in enumerate(NAMES, 1):
        own = scored(k, c)
        right, wrong = sum(y for _, y in own), sum(not y for _, y in own)
        for t in {s for s, _ in own}:
            said = [y for s, y in own if s >= t]
            want[c, t] = (sum(said) / right if right else None, (len(said) - sum(said)) / wrong)
    assert set(got) == set(want) and all(got[p] == pytest.approx(want[p]) for p in want)
    assert got["c", 0.5] == (None, 1.0)  # no row is of this class


def test_calibration_curve_equals_brute_force(spark):
    got = {(r["class"], r.bin): (r.mean_score, r.positives, r.n) for r in evaluation.calibration_curve(spark.createDataFrame(ROWS, SCHEMA), "y", NAMES, bins=5).collect()}
    want = {}
    for k, c in enumerate(NAMES, 1):
        for b in range(5):
            own = [(s, y) for s, y in scored(k, c) if b == sum(s > e / 5 for e in range(1, 5))]
            if own:
                want[c, b] = (sum(s for s, _ in own) / len(own), sum(y for _, y in own) / len(own), len(own))
    assert set(got) == set(want) and all(got[p] == pytest.approx(want[p]) for p in want)


class Sign:
    def transform(self, df):
        return df.selectExpr("*", "CAST(`a.b` > 5 AS INT) AS prediction")


def test_permutation_importance(spark):
    df = spark.range(400).selectExpr("CAST(id % 10 AS DOUBLE) AS `a.b`", "CAST(id % 3 AS DOUBLE) AS b", "CAST(id % 10 > 5 AS INT) AS y", "id")
    found = {r.feature: (r.importance, r.rounds) for r in models.permutation_importance(df, Sign(), ["a.b", "b"], "y").collect()}
    assert found == {"a.b": (1.0, 3), "b": (0.0, 3)}
    assert {r.rounds for r in models.permutation_importance(df, Sign(), ["a.b"], "y", rounds=4, budget=600).collect()} == {4}
    # A budget that one round has spent leaves it at that one.
    assert [tuple(r) for r in models.permutation_importance(df, Sign(), ["a.b"], "y", rounds=4, budget=0.001).collect()] == [("a.b", 1.0, 1)]
    assert [r.importance for r in models.permutation_importance(df.limit(0), Sign(), ["a.b"], "y").collect()] == [0.0]


def test_permutations_keep_values(spark):
    """A column is dealt anew: the same values as before, in other rows."""
    seen = []

    class Spy(Sign):
        def transform(self, df):
            seen.append(sorted(r["a.b"] for r in df.where("__round = 1").select("`a.b`").collect()))
            return super().transform(df)

    df = spark.range(300).selectExpr("CAST(id AS DOUBLE) AS `a.b`", "CAST(id > 5 AS INT) AS y")
    models.permutation_importance(df, Spy(), ["a.b"], "y", rounds=2).collect()
    assert seen == [[float(i) for i in range(300)]]


def test_unused_features_share_the_variance(spark):
    """One feature varies alone, two are one: shares add up to 1, kinds follow importance and variance."""
    df = spark.range(300).selectExpr("CAST(id % 17 AS DOUBLE) AS a", "CAST(id % 13 AS DOUBLE) AS b", "CAST(2 * (id % 13) AS DOUBLE) AS c", "IF(id % 50 = 0, 9.0, 1.0) AS d")
    got = {r.feature: r for r in models.unused_features(df, ["a", "b", "c", "d"], {"a": 0.9}).collect()}
    assert sum(r.variance for r in got.values()) == pytest.approx(1.0) and got["b"].variance == pytest.approx(got["c"].variance)
    assert got["a"].kind == "used" and got["b"].kind == "unused high variance" and {got[k].importance for k in "bcd"} == {0.0}


def test_boosting_errors_fall_on_train(spark):
    df = spark.range(400).selectExpr("CAST(id % 20 AS DOUBLE) AS x", "CAST(id % 7 AS DOUBLE) AS z", "CAST(id % 20 > 9 AS DOUBLE) AS y")
    rows = models.boosting_overfit(df.where("z < 5"), df.where("z >= 5"), ["x", "z"], "y", steps=4).orderBy("trees").collect()
    assert [r.trees for r in rows] == [1, 2, 3, 4]
    assert all(a.train_error > b.train_error for a, b in zip(rows, rows[1:])) and rows[-1].test_error < rows[0].test_error


def test_embeddings_drift_of_moved_and_equal_vectors(spark):
    vectors = spark.range(800).selectExpr("id", "transform(sequence(0, 5), k -> pmod(xxhash64(id, k), 1000) / 1000D) AS v")
    moved = vectors.selectExpr("id", "transform(v, x -> x + 1) AS v")
    assert models.embeddings_drift(vectors, moved, "v", components=3).first().drift > 0.9
    assert models.embeddings_drift(vectors.where("id % 2 = 0"), vectors.where("id % 2 = 1"), "v", components=3).first().drift < 0.3
