"""Densities of rows on few lines against brute force, with ties, copies and values far from each other."""

import math
import random

import pytest

from plumbline.operators import integrity
from plumbline.operators.lines import line_density


def brute(rows, k, extent=3.0):
    """(pd, mean, epd) by id; rows are (id, x, z, c)."""
    span = [max(r[i] for r in rows) - min(r[i] for r in rows) or math.inf for i in (1, 2)]
    near = {}
    for q in rows:
        d = sorted(((abs(q[1] - o[1]) / span[0] + abs(q[2] - o[2]) / span[1] + (q[3] != o[3])) / 3, o[0]) for o in rows if o[0] != q[0])
        near[q[0]] = d[:k]
    pd = {i: extent * math.sqrt(sum(d * d for d, _ in found) / len(found)) for i, found in near.items()}
    return {i: (pd[i], sum(d for d, _ in found) / len(found), sum(pd[o] for _, o in found) / len(found)) for i, found in near.items()}


def drawn(kind):
    r = random.Random(kind)
    ids = [f"{'é' * (i % 3)}{i}" if kind == "words" else i * 11 % 307 for i in range(300)]
    x = {
        "grid": lambda i: float(r.randrange(40)), "words": lambda i: float(r.randrange(12)), "cents": lambda i: round(r.uniform(-999, 9999), 2),
        "copies": lambda i: 5.0 if i < 200 else float(r.randrange(30)), "clusters": lambda i: (i % 2) * 1e6 + r.random() * 1e-3, "far": lambda i: 1e9 if i == 7 else r.random(),
    }[kind]
    return [(ids[i], x(i), float(r.randrange(3)), "ab"[r.randrange(2)] if r.random() < 0.9 else None) for i in range(300)]


@pytest.mark.parametrize("kind, k", [("grid", 3), ("grid", 30), ("words", 30), ("cents", 30), ("copies", 30), ("clusters", 30), ("far", 30)])
def test_densities_equal_brute_force(spark, kind, k):
    rows = drawn(kind)
    df = spark.createDataFrame(rows, f"id {'string' if kind == 'words' else 'long'}, x double, z double, c string")
    got = {r.id: (r.pd, r.mean_distance, r.epd) for r in line_density(df, "id", ["x", "z"], ["c"], k, 3.0, least_asked=9, least_held=4).collect()}
    want = brute(rows, k)
    assert set(got) == set(want)
    assert all(got[i] == pytest.approx(want[i], rel=1e-9, abs=0) for i in want)


def test_scores_on_few_lines_need_no_row_per_pair(spark, monkeypatch):
    rows = drawn("grid")
    df = spark.createDataFrame(rows, "id long, x double, z double, c string")
    want = {r.id: (r.mean_distance, r.score) for r in _by_pairs(df, monkeypatch).collect()}
    monkeypatch.setattr(integrity, "all_neighbours", lambda *a, **k: pytest.fail("a row per pair was written"))
    got = {r.id: (r.mean_distance, r.score) for r in integrity.outlier_samples(df, df, "id", ["x", "z"], ["c"]).collect()}
    assert got == {i: pytest.approx(v, rel=1e-9, abs=1e-12) for i, v in want.items()}


def _by_pairs(df, monkeypatch):
    with monkeypatch.context() as m:
        m.setattr(integrity, "line_density", lambda *a, **k: None)
        return integrity.outlier_samples(df, df, "id", ["x", "z"], ["c"])


def test_densities_leave_other_tables_alone(spark):
    """Few rows, everything in one line, more neighbours asked than there are, a missing number, ids twice."""
    made = lambda rows: spark.createDataFrame(rows, "id long, x double, z double, c string")
    ask = lambda rows, numeric, k=5: line_density(made(rows), "id", numeric, [], k, 3.0)
    one = {r.id: r.mean_distance for r in ask([(1, 0.0, 1.0, None), (2, 1.0, 1.0, None), (3, 4.0, 1.0, None)], ["x"]).collect()}
    assert one == {1: pytest.approx(2.5 / 4), 2: pytest.approx(2 / 4), 3: pytest.approx(3.5 / 4)}
    assert ask([(1, 0.0, 1.0, None), (2, None, 1.0, None), (3, 4.0, 1.0, None)], ["x"]) is None
    assert ask([(1, 0.0, 1.0, None), (1, 2.0, 1.0, None), (3, 4.0, 1.0, None)], ["x"]) is None
    assert ask([(1, 1.0, 1.0, None), (2, 1.0, 1.0, None)], ["x"]) is None and ask([(1, 1.0, 1.0, None)], ["x"]) is None and ask([], ["x"]) is None
