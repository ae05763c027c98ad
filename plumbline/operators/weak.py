"""Weak segments: where two features together tell that a score is low, for all pairs of features in one pass.

Every feature is cut into at most ``BINS`` bins: a number at exact quantiles, a
category into its most frequent values and all others, in the order of their
mean score (target encoding). One aggregate counts rows and scores by (pair,
bin, bin), which each task adds up for itself: pairs times ``BINS`` squared
cells, whatever the rows. From a pair's cells a tree is grown that cuts at the
edges of bins; its leaves are filters, their means and sizes those of all rows.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.running import at_quantiles, running_sums
from .segments import Filter

#: Bins of a feature.
BINS = 32


def feature_bins(df: DataFrame, numeric: list[str], categorical: list[str], score: str, bins: int = BINS) -> dict[str, list]:
    """Of numbers the edges that part their bins, of categories the values that have a bin, by falling mean score; the bin of all others is among them as None."""
    out: dict[str, list] = {}
    s = F.col(f"`{score}`").cast("double")
    scored = df.where(s.isNotNull())
    if numeric:
        cells = F.array(*(F.struct(F.lit(c).alias("feature"), F.col(f"`{c}`").cast("double").alias("v")) for c in numeric))
        counts = scored.select(F.inline(cells)).where(F.col("v").isNotNull() & ~F.isnan("v")).groupBy("feature", "v").agg(F.count("*").alias("n"))
        ran = running_sums(counts, ["feature"], "v", {"upto": "n"}, totals=True)
        rows = ran.groupBy("feature").agg(F.array(*at_quantiles("v", "upto", [i / bins for i in range(1, bins)])).alias("q"), F.max("v").alias("most")).collect()  # a row per feature
        out |= {c: [] for c in numeric} | {r.feature: sorted({x for x in r.q if x < r.most}) for r in rows}
    for c in categorical:
        per = scored.where(F.col(f"`{c}`").isNotNull()).groupBy(F.col(f"`{c}`").alias("v")).agg(F.count("*").alias("n"), F.sum(s).alias("s"))
        total = per.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
        often = per.orderBy(F.desc("n"), "v").limit(bins - 1).collect()
        means = {r.v: r.s / r.n for r in often}
        rest = (total.n or 0) - sum(r.n for r in often)
        if rest:
            means[None] = (total.s - sum(r.s for r in often)) / rest
        out[c] = sorted(means, key=lambda v: (-means[v], v is None, str(v)))
    return out


def _bin(column: str, own: list, number: bool) -> Column:
    """The bin of a row, from 0; null for nulls (and NaN), which are in no segment."""
    c = F.col(f"`{column}`")
    if number:
        v = c.cast("double")
        above = F.size(F.filter(F.array(*map(F.lit, own)), lambda e: e < v)) if own else F.lit(0)
        return F.when(v.isNotNull() & ~F.isnan(v), above)
    known = [v for v in own if v is not None]
    place = F.array_position(F.array(*map(F.lit, known)), c).cast("int") if known else F.lit(0)
    at = {i + 1: own.index(v) for i, v in enumerate(known)} | ({0: own.index(None)} if None in own else {})
    return F.when(c.isNotNull(), F.get(F.array(*(F.lit(at.get(i, -1)) for i in range(len(known) + 1))), place))


def pair_cells(df: DataFrame, features: list[str], bins: dict[str, list], numeric: list[str], score: str) -> DataFrame:
    """(pair, a, b, n, s): rows and summed scores of every pair of features, by bins; pairs are numbered as ``combinations`` has them."""
    rows = df.select(F.col(f"`{score}`").cast("double").alias("__s"), *(_bin(f, bins[f], f in numeric).alias(f"b{i}") for i, f in enumerate(features))).where(F.col("__s").isNotNull())
    cells = F.array(*(F.struct(F.lit(k).alias("pair"), F.col(f"b{i}").alias("a"), F.col(f"b{j}").alias("b")) for k, (i, j) in enumerate(combinations(range(len(features)), 2))))
    return rows.select("__s", F.inline(cells)).where("a IS NOT NULL AND b IS NOT NULL").groupBy("pair", "a", "b").agg(F.count("*").alias("n"), F.sum("__s").alias("s"))


def grow(cells: dict[tuple[int, int], tuple[int, float]], least: float, depth: int) -> list[tuple[tuple[int, int, int, int], int, float]]:
    """Leaves (bins from a0 up to a1, from b0 up to b1; rows; sum of scores) of a tree that takes, node by node, the cut with the largest gain of variance explained.

    Both sides of a cut have ``least`` rows; equal gains go to the first axis
    and the lowest edge.
    """

    def inside(box):
        return [(p, n, s) for p, (n, s) in cells.items() if box[0] <= p[0] < box[1] and box[2] <= p[1] < box[3]]

    def walk(box, left):
        own = inside(box)
        n, s = sum(x[1] for x in own), sum(x[2] for x in own)
        best = None
        for axis in (0, 1) if left else ():
            by: dict[int, list] = {}
            for p, m, t in own:
                held = by.setdefault(p[axis], [0, 0.0])
                held[0] += m
                held[1] += t
            low_n, low_s = 0, 0.0
            for edge in sorted(by)[:-1]:
                low_n, low_s = low_n + by[edge][0], low_s + by[edge][1]
                if min(low_n, n - low_n) >= max(least, 1):
                    gain = low_s**2 / low_n + (s - low_s) ** 2 / (n - low_n) - s**2 / n
                    if gain > 1e-9 and (best is None or gain > best[0] * (1 + 1e-9)):
                        best = gain, axis, edge + 1
        if best is None:
            return [(box, n, s)]
        _, axis, edge = best
        first, second = list(box), list(box)
        first[2 * axis + 1] = second[2 * axis] = edge
        return walk(tuple(first), left - 1) + walk(tuple(second), left - 1)

    if not cells:
        return []
    return walk((0, max(a for a, _ in cells) + 1, 0, max(b for _, b in cells) + 1), depth)


def _inside(out: Filter, column: str, own: list, number: bool, low: int, high: int) -> Filter:
    """``out`` and the bins from ``low`` up to ``high`` of a column."""
    if number:
        out = out.above(column, own[low - 1]) if low > 0 else out
        return out.upto(column, own[high - 1]) if high <= len(own) else out
    if low == 0 and high >= len(own):
        return out
    chosen = own[low:high]
    if None in chosen:
        return out.without(column, [v for v in own if v is not None and v not in chosen])
    return out.among(column, chosen)


def segment_leaves(df: DataFrame, numeric: list[str], categorical: list[str], score: str, min_size: float = 0.05, depth: int = 3, bins: int = BINS) -> list[tuple[str, str, Filter, int, float]]:
    """(feature, feature, filter, rows, mean score) of every leaf of every pair of features; the filters can be applied again.

    ``min_size`` is of all rows with a score. Rows with a null in one of a
    pair's features are in none of its leaves. What is collected is the cells:
    at most ``bins`` squared a pair.
    """
    features = [*numeric, *categorical]
    own = feature_bins(df, numeric, categorical, score, bins)
    pairs = list(combinations(features, 2))
    total = df.where(F.col(f"`{score}`").isNotNull()).count()
    cells: dict[int, dict] = {}
    if pairs:
        for r in pair_cells(df, features, own, numeric, score).collect():
            cells.setdefault(r.pair, {})[r.a, r.b] = r.n, r.s
    out = []
    for k, (a, b) in enumerate(pairs):
        for box, n, s in grow(cells.get(k, {}), min_size * total, depth):
            inside = _inside(_inside(Filter(), a, own[a], a in numeric, *box[:2]), b, own[b], b in numeric, *box[2:])
            out.append((a, b, inside, n, s / n))
    return out


def weak_segments(df: DataFrame, features: list[str], score: str, min_size: float = 0.05, depth: int = 3, top: int = 3, categorical: list[str] | None = None, bins: int = BINS) -> DataFrame:
    """(feature_1, feature_2, segment, score, average, n): the segments of two features with the lowest mean ``score``, one a pair, a report of ``top`` rows.

    ``features`` are numbers, but for those named in ``categorical``.
    """
    cat = list(categorical or [])
    leaves = segment_leaves(df, [f for f in features if f not in cat], cat, score, min_size, depth, bins)
    average = df.agg(F.avg(F.col(f"`{score}`").cast("double"))).first()[0]
    worst: dict[tuple[str, str], tuple] = {}
    for a, b, inside, n, mean in leaves:
        row = (a, b, inside.describe(), float(mean), average, n)
        if (a, b) not in worst or (mean, row[2]) < (worst[a, b][3], worst[a, b][2]):
            worst[a, b] = row
    rows = sorted(worst.values(), key=lambda r: (r[3], r[:3]))[:top]
    return df.sparkSession.createDataFrame(rows, "feature_1 string, feature_2 string, segment string, score double, average double, n long")
