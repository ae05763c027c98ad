"""Predictive power against a version in plain Python that grows trees on lists of rows."""

import datetime
import hashlib
import statistics
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from plumbline.operators import power


def brute_bins(values, bins, number):
    """value -> bin, as the docstrings have it."""
    n = Counter(values)
    if not number:
        order = sorted(n, key=lambda v: (-n[v], v))
        return {v: min(k, bins - 1) for k, v in enumerate(order)}
    order, below, raw = sorted(n), 0, {}
    for k, v in enumerate(order):
        raw[v] = k if len(order) <= bins else below * bins // len(values)
        below += n[v]
    dense = {b: k for k, b in enumerate(sorted(set(raw.values())))}
    return {v: dense[raw[v]] for v in order}


def brute_power(pairs, feature, number, regression, folds, bins):
    pairs = [(x, y) for x, y in pairs if x is not None and x == x and y is not None and y == y]
    if not pairs:
        return 0.0
    bin_of = brute_bins([x for x, _ in pairs], bins, number)
    cells = Counter((bin_of[x], y) for x, y in pairs)
    rows = []  # (bin, y, fold) for each row
    for (b, y), n in cells.items():
        single = min(n, power.DRAWN)
        for i in range(1, single + 1):
            rows.append((b, y, int(hashlib.md5(f"{feature}|{b}|{y}|{i}".encode()).hexdigest()[:8], 16) % folds))
        rows += [(b, y, i % folds) for i in range(n - single)]
    said = []
    for k in range(folds):
        train = defaultdict(list)
        for b, y, f in rows:
            if f != k:
                train[b].append(y)
        for b, y, f in rows:
            if f == k:
                near = train[min(train, key=lambda t: (abs(t - b), t))]
                c = Counter(near)
                said.append((y, statistics.fmean(near) if regression else min(c, key=lambda v: (-c[v], v))))
    if regression:
        middle = statistics.median(y for y, _ in said)
        base = statistics.fmean(abs(y - middle) for y, _ in said)
        return max(0.0, 1 - statistics.fmean(abs(y - p) for y, p in said) / base) if base else 0.0
    own, guess, hit = Counter(y for y, _ in said), Counter(p for _, p in said), Counter(y for y, p in said if y == p)
    f1 = sum(own[c] * 2 * hit[c] / (own[c] + guess[c]) for c in own) / len(said)
    p = max(own.values()) / len(said)
    base = max(2 * p * p / (1 + p), sum((n / len(said)) ** 2 for n in own.values()))
    return max(0.0, (f1 - base) / (1 - base)) if base < 1 else 0.0


def hashed(k, n):
    return F.pmod(F.xxhash64(F.lit(k), "id"), F.lit(n))


@pytest.fixture(scope="module")
def rows(spark):
    """600 rows, of which one value holds a third; nulls, NaN, infinite values, rare categories and labels."""
    word = F.concat(F.lit("w"), F.when(hashed(1, 3) == 0, 0).otherwise(hashed(2, 40)).cast("string"))
    x = F.when(hashed(3, 3) == 0, 5.0).otherwise(hashed(4, 90) / 3.0)
    df = spark.range(600).select(
        F.when(hashed(5, 20) > 0, x).alias("x.1"),
        F.when(hashed(6, 20) > 0, F.when(hashed(7, 30) == 0, float("nan")).when(hashed(7, 30) == 1, float("inf")).otherwise(F.col("id") / 7.0)).alias("steady"),
        F.when(hashed(8, 15) > 0, word).alias("word"),
        F.date_add(F.lit(datetime.date(2020, 1, 1)), hashed(9, 12).cast("int")).alias("day"),
        F.lit(None).cast("double").alias("none"),
        F.lit("same").alias("same"),
        F.when(hashed(10, 25) > 0, F.when(hashed(11, 4) == 0, "noise").when(x < 8, "low").when(x < 18, F.when(word == "w0", "first").otherwise("mid")).otherwise(F.concat(F.lit("h"), hashed(9, 12).cast("string")))).alias("y"),
        F.when(hashed(12, 25) > 0, F.round(x * x + hashed(13, 9), 2)).alias("z"),
    )
    return df.cache()


@pytest.mark.parametrize("bins", [8, 256])
@pytest.mark.parametrize("regression", [False, True])
def test_predictive_power_equals_brute_force(rows, regression, bins):
    label, features = "z" if regression else "y", [c for c in rows.columns if c not in "yz"]
    found = {r.feature: r.score for r in power.predictive_power(rows, features, label, regression, folds=3, bins=bins).collect()}
    seconds = datetime.datetime(1970, 1, 1)
    data = [r.asDict() for r in rows.collect()]
    for f in features:
        number = f not in ("word", "same")
        of = lambda v: (datetime.datetime.combine(v, datetime.time()) - seconds).total_seconds() if isinstance(v, datetime.date) else None if v == float("inf") else v
        assert found[f] == pytest.approx(brute_power([(of(r[f]), r[label]) for r in data], f, number, regression, 3, bins)), f
    assert found["x.1"] > 0.2 and found["none"] == found["same"] == 0


def test_dealt_keeps_every_row_of_hot_cells(spark):
    cells = spark.createDataFrame([("f", 0, "a", 1_000_003), ("f", 1, "a", 1), ("f", 1, "b", 63)], "feature string, bin int, y string, n long")
    per = power.dealt(cells, 4).groupBy("bin", "y", "n").agg(F.sum("m").alias("m"), F.min("m").alias("least"), F.count("*").alias("k")).collect()
    assert all(r.m == r.n and r.k == 4 for r in per) and next(r.least for r in per if r.n > 64) >= 249_984


def test_jobs_do_not_grow_with_features(spark, rows):
    def jobs(k):
        spark.sparkContext.setJobGroup(f"power-{k}", "")
        power.predictive_power(rows.select("y", *(F.col("`x.1`").alias(f"x{i}") for i in range(k))), [f"x{i}" for i in range(k)], "y").collect()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"power-{k}"))

    try:
        assert jobs(7) <= jobs(1) + 1
    finally:
        spark.sparkContext._jsc.clearJobGroup()


def test_odd_tables(spark):
    empty = spark.createDataFrame([], "a double, b string, y string")
    assert {tuple(r) for r in power.predictive_power(empty, ["a", "b"], "y").collect()} == {("a", 0.0), ("b", 0.0)}
    one = spark.createDataFrame([(1.0, "", "p"), (1.0, None, "p"), (None, "", None)], "a double, b string, y string")
    assert {tuple(r) for r in power.predictive_power(one, ["a", "b"], "y").collect()} == {("a", 0.0), ("b", 0.0)}
