"""Weak segments of all pairs: bins, trees and filters against row by row versions."""

import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import models, weak


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(6)
    out = []
    for i in range(600):
        x, y, k, c = rng.choice([None, rng.random() * 10, rng.randrange(4) * 1.0]), rng.gauss(0, 1), rng.choice(["a", "b", "c", None]), f"t{int(rng.random() ** 3 * 40)}"
        s = 0.2 if (x or 0) > 5 and k == "b" else 0.9 if c in ("t0", "t1") else 0.6
        out.append((i, x, y, k, c, None if i % 50 == 0 else s + rng.random() / 10))
    return out


def test_leaves_equal_trees_of_rows(spark, rows):
    df = spark.createDataFrame(rows, "id long, x double, y double, k string, c string, s double").repartition(3)
    numeric, categorical, bins, least = ["x", "y"], ["k", "c"], 8, 0.04
    names = ["id", "x", "y", "k", "c", "s"]
    table = [dict(zip(names, r)) for r in rows if r[5] is not None]
    own = {}
    for f in numeric:
        v = [r[f] for r in table if r[f] is not None]
        own[f] = sorted({float(q) for q in np.quantile(v, [i / bins for i in range(1, bins)]) if q < max(v)})
    for f in categorical:
        count, total = {}, {}
        for r in table:
            if r[f] is not None:
                count[r[f]] = count.get(r[f], 0) + 1
                total[r[f]] = total.get(r[f], 0) + r["s"]
        often = sorted(count, key=lambda v: (-count[v], v))[: bins - 1]
        means = {v: total[v] / count[v] for v in often}
        others = [v for v in count if v not in often]
        if others:
            means[None] = sum(total[v] for v in others) / sum(count[v] for v in others)
        own[f] = sorted(means, key=lambda v: -means[v])
    found = weak.feature_bins(df, numeric, categorical, "s", bins)
    assert all(found[f] == pytest.approx(own[f]) for f in numeric) and all(found[f] == own[f] for f in categorical)

    def place(r, f):
        if r[f] is None:
            return None
        return sum(e < r[f] - 1e-12 for e in own[f]) if f in numeric else own[f].index(r[f] if r[f] in own[f] else None)

    def tree(part, a, b, depth):
        """The cut of rows that leaves the least squared error, again and again."""
        error = lambda p: sum((r["s"] - np.mean([q["s"] for q in p])) ** 2 for r in p) if p else 0.0
        best = (error(part) - 1e-9, None)
        for f in (a, b) if depth else ():
            for edge in sorted({place(r, f) for r in part})[:-1]:
                low, high = [r for r in part if place(r, f) <= edge], [r for r in part if place(r, f) > edge]
                if min(len(low), len(high)) >= least * len(table):
                    cost = error(low) + error(high)
                    if cost < best[0] - 1e-9:
                        best = (cost, (low, high))
        if best[1] is None:
            return [part]
        return tree(best[1][0], a, b, depth - 1) + tree(best[1][1], a, b, depth - 1)

    want = {}
    for a, b in combinations([*numeric, *categorical], 2):
        want[a, b] = sorted((len(p), round(float(np.mean([r["s"] for r in p])), 9)) for p in tree([r for r in table if r[a] is not None and r[b] is not None], a, b, 2))
    leaves = weak.segment_leaves(df, numeric, categorical, "s", least, 2, bins)
    got = {}
    for a, b, _, n, mean in leaves:
        got.setdefault((a, b), []).append((n, round(mean, 9)))
    assert {p: sorted(v) for p, v in got.items()} == want
    # The filters find the same rows again, each once.
    scored = df.where("s IS NOT NULL")
    again = scored.agg(*(x for i, (a, b, f, _, _) in enumerate(leaves) for on in [f.column() & F.col(a).isNotNull() & F.col(b).isNotNull()] for x in (F.count_if(on).alias(f"n{i}"), F.avg(F.when(on, F.col("s"))).alias(f"s{i}")))).first()
    assert all(again[f"n{i}"] == n and again[f"s{i}"] == pytest.approx(mean) for i, (_, _, _, n, mean) in enumerate(leaves))


def test_the_weak_part_is_found(spark, rows):
    df = spark.createDataFrame(rows, "id long, x double, y double, k string, c string, s double")
    first = models.weak_segments(df, ["x", "y", "k"], "s", 0.03, categorical=["k"]).first()  # the part has 4 % of the rows
    assert {first.feature_1, first.feature_2} == {"x", "k"} and "k in b" in first.segment and first.score < 0.4 and first.average > 0.5
    assert models.weak_segments(df, ["x"], "s").count() == 0 and models.weak_segments(df.limit(0), ["x", "y"], "s").count() == 0
    nothing = models.weak_segments(df.withColumn("x", F.lit(None).cast("double")), ["x", "y"], "s")
    assert nothing.count() == 0
