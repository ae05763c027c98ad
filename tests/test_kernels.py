import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import running
from plumbline.operators import kernels


def _numbers(spark, a, b):
    frame = lambda v: spark.createDataFrame([(float(x),) for x in v], "x double")
    return kernels.tag(frame(a), frame(b), ["x"], "double")


def _counts(spark, a, b):
    rows = [("x", k, a.get(k, 0), b.get(k, 0)) for k in {**a, **b}]
    return spark.createDataFrame(rows, "feature string, v string, a long, b long")


@pytest.mark.parametrize(("a", "b", "want"), [([1] * 100, [0] * 100, 1), (range(100), range(50, 150), 1 / 3)])
def test_emd(spark, a, b, want):
    assert kernels.emd(_numbers(spark, a, b)).first().score == pytest.approx(want, abs=0.01)


def test_emd_leaves_margins_out(spark):
    assert kernels.emd(_numbers(spark, [10] * 99 + [100], [0] * 99 + [1]), 0.01).first().score == pytest.approx(1)


def test_ks(spark):
    assert kernels.ks(_numbers(spark, [0] * 100, [0] * 100)).first().score == 0
    assert kernels.ks(_numbers(spark, [1] * 100, [0] * 100)).first().score == 1
    rng = random.Random(1)
    a, b = [rng.gauss(0, 1) for _ in range(10_000)], [rng.gauss(1, 1) for _ in range(10_000)]
    assert kernels.ks(_numbers(spark, a, b)).first().score == pytest.approx(0.382, abs=0.02)


@pytest.mark.parametrize(
    ("a", "b", "want"),
    [({"a": 200, "b": 800}, {"a": 400, "b": 600}, 0.21), ({"a": 1000}, {"b": 1000}, 1), ({"a": 1000}, {"a": 1000}, 0), ({"a": 200, "b": 800, "n": 100}, {"a": 400, "b": 600}, 0.3)],
)
def test_cramers_v(spark, a, b, want):
    assert kernels.cramers_v(_counts(spark, a, b)).first().score == pytest.approx(want, abs=0.011)


def test_rare_categories_fold(spark):
    counts = _counts(spark, {"a": 200, "b": 800, "c": 10, "d": 10}, {"a": 400, "b": 620})
    assert kernels.cramers_v(counts).first().score == pytest.approx(0.228, abs=0.01)
    folded = kernels.fold_rare(counts, 0.1)
    assert {r.v for r in folded.collect()} == {"a", "b"}
    assert kernels.cramers_v(folded).first().score == pytest.approx(0.208, abs=0.01)


@pytest.mark.parametrize(("b", "want"), [(10_000, 0.56), (1_000, 0.45), (100, 0.14)])
def test_cramers_v_balanced(spark, b, want):
    assert kernels.cramers_v(_counts(spark, {"0": 9900, "1": 100}, {"0": b}), balance=True).first().score == pytest.approx(want, abs=0.01)


def test_iqr_fences(spark):
    df = spark.createDataFrame([(float(i),) for i in range(10)], "v double")
    one = kernels.iqr_fences(df, ["v"], scale=1).first()
    assert (one.low, one.high) == (-2.25, 11.25)
    wide = kernels.iqr_fences(df, ["v"], scale=1.5).first()
    assert (wide.low, wide.high) == (-4.5, 13.5)
    flat = kernels.iqr_fences(df.unionByName(spark.createDataFrame([(0.0,)] * 1000, "v double")), ["v"]).first()
    assert (flat.low, flat.high) == (-0.001, 0.001)


def test_auc_and_ranks_with_ties(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(2), rng.randrange(20) / 20) for _ in range(500)]
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    df = spark.createDataFrame(rows, "y int, s double")
    assert kernels.auc(df, "y", "s").first().auc == pytest.approx(want)


def test_running_sums_match_one_window(spark):
    from plumbline.functions.running import running_sums

    df = spark.range(1000).select(F.col("id").alias("v"), (F.col("id") % 7).alias("n"))
    got = {r.v: r.s for r in running_sums(df, [], "v", {"s": "n"}, buckets=5).collect()}
    total = 0
    for v in range(1000):
        total += v % 7
        assert got[v] == total


def test_empty_tables(spark):
    empty = _numbers(spark, [], [])
    assert kernels.ks(empty).collect() == []
    assert kernels.psi(_counts(spark, {}, {})).collect() == []


def test_running_sums_over_any_order(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), i, rng.randrange(9), f"k{rng.randrange(10**6)}") for i in range(3000)]
    df = spark.createDataFrame(rows, "p string, v int, n int, s string")
    got = {(r.p, r.v): r for r in running.running_sums(df, ["p"], "v", {"upto": "n"}, "next", totals=True, buckets=7).collect()}
    assert len(got) == len(rows)
    for p in ("a", "b", None):
        own, total = [r for r in rows if r[0] == p], 0
        for i, r in enumerate(own):
            total += r[2]
            found = got[p, r[1]]
            assert (found.upto, found.next, found.upto_n) == (total, own[i + 1][1] if i + 1 < len(own) else None, sum(x[2] for x in own))
    by_two = running.running_sums(df.dropDuplicates(["n", "s"]), [], ["n", "s"], {"upto": "v"}, buckets=5).orderBy("n", "s").collect()
    total = 0
    for r in by_two:
        total += r.v
        assert r.upto == total
    assert running.running_sums(df.limit(0), [], "v", {"upto": "n"}).count() == 0


def test_drift_reads_its_table_once(spark, tmp_path):
    """What a drift query returns reads the rank index, and no plan of it the table again."""
    spark.range(2000).selectExpr("id % 97 AS x", "id / 7.0 AS y").write.parquet(str(tmp_path / "given"))
    df = spark.read.parquet(str(tmp_path / "given"))
    tagged = kernels.tag(df.where("x < 50"), df.where("x >= 50"), ["x", "y"], "double")
    plan = kernels.emd(tagged, 0.025)._jdf.queryExecution().executedPlan().toString()
    assert "given" not in plan and plan.count("FileScan") <= 5


@pytest.mark.parametrize("margin", [0.0, 0.025, 0.2])
def test_emd_equals_brute_force(spark, margin):
    rng = random.Random(int(margin * 1000))
    sides = [[rng.choice([rng.gauss(s, 2), rng.randrange(4)]) for _ in range(300)] for s in (0, 1)]
    df = spark.createDataFrame([(s, float(v)) for s, own in enumerate(sides) for v in own] + [(0, None), (1, float("nan"))], "side int, v double")
    got = kernels.emd(kernels.tag(df.where("side = 0"), df.where("side = 1"), ["v"], "double"), margin).first().score
    kept = []
    for own in sides:
        low, high = np.quantile(own, [margin, 1 - margin])
        kept.append(np.sort([v for v in own if low <= v <= high]))
    every = np.sort(np.concatenate(kept))
    gaps = np.abs(np.searchsorted(kept[0], every[:-1], "right") / len(kept[0]) - np.searchsorted(kept[1], every[:-1], "right") / len(kept[1]))
    assert got == pytest.approx((gaps * np.diff(every)).sum() / (every[-1] - every[0]))
