"""Correlations of all pairs against pandas and plain counting."""

import math
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from plumbline.operators import correlations


@pytest.fixture(scope="module")
def rows(spark):
    """500 rows of which one value holds a third; ties, nulls, NaN, a constant and an empty column."""
    h = lambda k, n: F.pmod(F.xxhash64(F.lit(k), "id"), F.lit(n))
    hot = F.when(h(1, 3) == 0, 7).otherwise(h(2, 50))
    return spark.range(500).select(
        hot.cast("double").alias("a"),
        F.when(h(3, 6) > 0, F.when(h(4, 9) == 0, float("nan")).otherwise(hot * hot + h(5, 300))).alias("b.c"),
        F.when(h(6, 4) > 0, h(7, 20) - hot).cast("int").alias("d"),
        F.lit(2).alias("e"),
        F.lit(None).cast("double").alias("f"),
        F.when(h(8, 10) > 0, F.concat(F.lit("p"), F.floor(hot / 10).cast("string"))).alias("p"),
        F.when(h(9, 10) > 0, F.concat(F.lit("q"), F.floor(hot / 17).cast("string"), h(10, 2).cast("string"))).alias("q"),
        F.lit("same").alias("r"),
        F.lit("same").alias("s"),
    ).cache()


NUMERIC, CATEGORICAL = ["a", "b.c", "d", "e", "f"], ["p", "q", "r", "s"]


def entropy(values):
    n = Counter(values)
    return -sum(k / len(values) * math.log(k / len(values)) for k in n.values())


def expected(data, x, y):
    pairs = [(r[x], r[y]) for r in data if r[x] is not None and r[y] is not None and r[x] == r[x] and r[y] == r[y]]
    a, b = [p[0] for p in pairs], [p[1] for p in pairs]
    if x in NUMERIC and y in NUMERIC:
        if len(set(a)) < 2 or len(set(b)) < 2:
            return None
        rank = lambda own: [sum(w < v for w in own) + (sum(w == v for w in own) + 1) / 2 for v in own]
        ra, rb = rank(a), rank(b)
        ma, mb = sum(ra) / len(ra), sum(rb) / len(rb)
        return sum((u - ma) * (v - mb) for u, v in zip(ra, rb)) / math.sqrt(sum((u - ma) ** 2 for u in ra) * sum((v - mb) ** 2 for v in rb))
    if x in CATEGORICAL:
        both = entropy(a) + entropy(b)
        return 2 * (both - entropy(pairs)) / both if both else None
    if not pairs:
        return 0.0
    mean, total = sum(a) / len(a), 0.0
    for c in set(b):
        own = [v for v, w in pairs if w == c]
        total += len(own) * (sum(own) / len(own) - mean) ** 2
    spread = sum((v - mean) ** 2 for v in a)
    return math.sqrt(total / spread) if spread else 0.0


def test_feature_correlation_equals_brute_force(rows):
    found = {(r.feature_1, r.feature_2): r.score for r in correlations.feature_correlation(rows, NUMERIC, CATEGORICAL).collect()}
    assert set(found) == set(combinations(NUMERIC + CATEGORICAL, 2))
    data = [r.asDict() for r in rows.collect()]
    for (x, y), score in found.items():
        want = expected(data, x, y)
        assert score == (None if want is None else pytest.approx(want, abs=1e-9)), (x, y)
    assert found["a", "b.c"] > 0.5 and found["a", "p"] > 0.5 and found["p", "q"] > 0.3


def test_jobs_do_not_grow_with_columns(spark, rows):
    def jobs(k):
        spark.sparkContext.setJobGroup(f"correlations-{k}", "")
        correlations.feature_correlation(rows.select(*(F.col("a").alias(f"x{i}") for i in range(k)), *(F.col("p").alias(f"y{i}") for i in range(k))), [f"x{i}" for i in range(k)], [f"y{i}" for i in range(k)]).collect()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"correlations-{k}"))

    try:
        assert jobs(6) <= jobs(2) + 2
    finally:
        spark.sparkContext._jsc.clearJobGroup()


def test_empty_table_and_one_column(spark):
    empty = spark.createDataFrame([], "a double, b double, p string, q string")
    assert {tuple(r) for r in correlations.feature_correlation(empty, ["a", "b"], ["p", "q"]).collect()} == {("a", "b", None), ("a", "p", 0.0), ("a", "q", 0.0), ("b", "p", 0.0), ("b", "q", 0.0), ("p", "q", None)}
    assert correlations.feature_correlation(empty, ["a"], []).count() == 0


def test_ranks_meet_heavy_values_without_a_shuffle(spark, monkeypatch):
    """A value of most rows brought them all to one task; scores are the same whichever values are heavy."""
    rows = [(float(i % 7), None if i % 5 == 0 else float(i * 37 % 101), 1.0 if i % 9 else float(i)) for i in range(600)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    found = []
    for most in (1, 20, 10**6):
        monkeypatch.setattr(correlations, "MOST_HEAVY", most)
        found.append({r.pair: r.score for r in correlations.rank_correlations(df, ["a", "b", "c"]).collect()})
    assert found[0].keys() == {0, 1, 2}
    for other in found[1:]:
        assert other == pytest.approx(found[0], rel=1e-12)
