"""Filters, partitions of columns, and segments of a table as filters that can be applied again."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.running import at_quantiles, running_sums
from . import kernels


@dataclass(frozen=True)
class Filter:
    """Rows inside intervals (low, high] of numbers, among values of categories and not among others, all at once."""

    intervals: dict[str, tuple[float | None, float | None]] = field(default_factory=dict)
    values: dict[str, tuple] = field(default_factory=dict)
    name: str = ""
    excluded: dict[str, tuple] = field(default_factory=dict)

    def above(self, column: str, threshold: float) -> Filter:
        """This and ``column > threshold``."""
        low, high = self.intervals.get(column, (None, None))
        return replace(self, intervals={**self.intervals, column: (threshold if low is None else max(low, threshold), high)})

    def upto(self, column: str, threshold: float) -> Filter:
        """This and ``column <= threshold``."""
        low, high = self.intervals.get(column, (None, None))
        return replace(self, intervals={**self.intervals, column: (low, threshold if high is None else min(high, threshold))})

    def among(self, column: str, values: Iterable) -> Filter:
        """This and ``column`` being one of ``values``."""
        values = tuple(values)
        known = self.values.get(column)
        return replace(self, values={**self.values, column: values if known is None else tuple(v for v in known if v in values)})

    def without(self, column: str, values: Iterable) -> Filter:
        """This and ``column`` being none of ``values``: all other categories, however many there are."""
        return replace(self, excluded={**self.excluded, column: tuple(dict.fromkeys((*self.excluded.get(column, ()), *values)))})

    def __and__(self, other: Filter) -> Filter:
        """Both."""
        out = self
        for c, (low, high) in other.intervals.items():
            out = out if low is None else out.above(c, low)
            out = out if high is None else out.upto(c, high)
        for c, values in other.values.items():
            out = out.among(c, values)
        for c, values in other.excluded.items():
            out = out.without(c, values)
        return replace(out, name=" and ".join(filter(None, (self.name, other.name))))

    def column(self) -> Column:
        """The condition on a row; nulls are not inside."""
        parts = []
        for c, (low, high) in self.intervals.items():
            parts += [F.col(f"`{c}`") > low] * (low is not None) + [F.col(f"`{c}`") <= high] * (high is not None)
        parts += [F.col(f"`{c}`").isin(*values) if values else F.lit(False) for c, values in self.values.items()]
        parts += [~F.col(f"`{c}`").isin(*values) if values else F.col(f"`{c}`").isNotNull() for c, values in self.excluded.items()]
        return F.coalesce(reduce(lambda a, b: a & b, parts, F.lit(True)), F.lit(False))

    def apply(self, df: DataFrame) -> DataFrame:
        return df.where(self.column())

    def describe(self) -> str:
        parts = []
        for c, (low, high) in self.intervals.items():
            parts.append(f"{low:g} < {c} <= {high:g}" if low is not None and high is not None else f"{c} > {low:g}" if low is not None else f"{c} <= {high:g}")
        parts += [f"{c} in {', '.join(map(str, v))}" for c, v in self.values.items()]
        parts += [f"{c} not in {', '.join(map(str, v))}" for c, v in self.excluded.items()]
        return " and ".join(parts) or "all rows"


def combine(filters: Iterable[Filter], df: DataFrame) -> DataFrame:
    """``df`` inside all filters."""
    return reduce(lambda a, f: a & f, filters, Filter()).apply(df)


def tree_filters(model, features: list[str]) -> list[tuple[Filter, float]]:
    """The leaves of a pyspark.ml decision tree on numbers, as (filter, prediction), from left to right."""
    out: list[tuple[Filter, float]] = []

    def walk(node, inside: Filter) -> None:
        if node.numDescendants() == 0:
            out.append((inside, node.prediction()))
            return
        split = node.split()
        name, threshold = features[split.featureIndex()], split.threshold()
        walk(node.leftChild(), inside.upto(name, threshold))
        walk(node.rightChild(), inside.above(name, threshold))

    walk(model._call_java("rootNode"), Filter())
    return out


# --- partitions --------------------------------------------------------------


def _counts(df: DataFrame, column: str) -> DataFrame:
    """(value, kind, n): categories as text and as they are, with their rows; nulls left out."""
    c = F.col(f"`{column}`")
    return df.where(c.isNotNull()).groupBy(c.cast("string").alias("value")).agg(F.min(c).alias("kind"), F.count("*").alias("n"))


def cumulative_shares(df: DataFrame, column: str) -> DataFrame:
    """(value, n, share, upto): categories by falling frequency with the share of rows up to each, however many there are."""
    ran = running_sums(_counts(df, column).drop("kind").withColumn("__down", -F.col("n")), [], ["__down", "value"], {"__upto": "n"}, totals=True)
    return ran.select("value", "n", (F.col("n") / F.col("__upto_n")).alias("share"), (F.col("__upto") / F.col("__upto_n")).alias("upto"))


def _largest(df: DataFrame, column: str, most: int, share: float) -> tuple[list, bool]:
    """The most frequent categories (value, kind), and whether there are others."""
    counts = _counts(df, column)
    total = counts.agg(F.sum("n")).first()[0] or 0
    rows = counts.orderBy(F.desc("n"), "value").limit(most).collect()
    out, before = [], 0
    for r in rows:
        if before >= share * total:
            break
        out.append((r.value, r.kind))
        before += r.n
    return out, before < total


def largest_categories(df: DataFrame, column: str, most: int = 10, share: float = 0.9) -> list[str]:
    """The most frequent categories: as many as cover ``share`` of the rows, ``most`` at most."""
    return [value for value, _ in _largest(df, column, most, share)[0]]


def partition_column(df: DataFrame, column: str, categorical: bool, most: int = 10, share: float = 0.9) -> list[Filter]:
    """Filters that cut a column into segments: quantile bins of a number, the largest categories and all others.

    The filters cover every row whose value is not null, each once.
    """
    if categorical:
        large, more = _largest(df, column, most, share)
        out = [Filter(values={column: (kind,)}, name=value) for value, kind in large]
        return [*out, Filter(name="others").without(column, [kind for _, kind in large])] if more else out
    edges = kernels.quantile_edges(df, column, most)
    if not edges:
        return []
    bins = list(zip(edges[:-1], edges[1:])) or [(edges[0], edges[0])]
    out = []
    for k, (low, high) in enumerate(bins):
        inside = Filter(name=f"({low:g}, {high:g}]" if k else f"[{low:g}, {high:g}]").upto(column, high)
        out.append(inside.above(column, low) if k else inside)
    return out


def edges_around(df: DataFrame, column: str, low: float, high: float, more: int = 4) -> list[float]:
    """Edges of bins around the segment (low, high], about ``more`` of them, in proportion to the rows on either side."""
    c = F.col(column)
    row = df.where(c.isNotNull()).agg(F.min(c).alias("a"), F.max(c).alias("b"), F.count_if(c <= low).alias("left"), F.count_if(c > high).alias("right")).first()
    sides = row.left + row.right
    n_left = round(more * row.left / sides) if sides else 0
    n_left = min(max(n_left, 1 if row.left else 0), more - (1 if row.right else 0))
    n_right = more - n_left if row.right else 0
    counts = df.where(c.isNotNull()).select(c.cast("double").alias("v"), F.when(c <= low, 0).when(c > high, 1).alias("side")).where("side IS NOT NULL").groupBy("side", "v").agg(F.count("*").alias("n"))
    ran = running_sums(counts, ["side"], "v", {"upto": "n"}, totals=True)
    sides = {side: [i / n for i in range(n + 1)] for side, n in ((0, n_left), (1, n_right)) if n}
    of = {r.side: r for r in ran.groupBy("side").agg(*(q.alias(f"q{k}_{i}") for k, at in sides.items() for i, q in enumerate(at_quantiles("v", "upto", at)))).collect()} if sides else {}
    cut = lambda side: [of[side][f"q{side}_{i}"] for i in range(len(sides[side]))] if side in of and side in sides else []
    left, right = cut(0), cut(1)
    return sorted({*(left[:-1] if left else []), *([low] if low > float("-inf") else []), *([high] if high < float("inf") else []), *(right[1:] if right else [])})


# --- segments ----------------------------------------------------------------


def segment_score(df: DataFrame, inside: Filter, score: Column) -> DataFrame:
    """(segment, score, n, share): a mean of ``score`` inside a filter, and how much of the table that is."""
    flag = inside.column()
    return df.agg(F.avg(F.when(flag, score)).alias("score"), F.count_if(flag).alias("n"), F.count("*").alias("t")).select(F.lit(inside.describe()).alias("segment"), "score", "n", F.try_divide("n", "t").alias("share"))


def segment_error(df: DataFrame, inside: Filter, error: str) -> DataFrame:
    """(segment, score, n, share) by a column of errors."""
    return segment_score(df, inside, F.col(error).cast("double"))


def error_by_category(df: DataFrame, column: str, error: str) -> DataFrame:
    """(value, mean_error, n, upto): categories by falling mean error, with the share of rows up to each, however many there are."""
    per = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("value")).agg(F.avg(F.col(error).cast("double")).alias("mean_error"), F.count("*").alias("n"))
    # A category without an error has no mean and comes last.
    ran = running_sums(per.withColumn("__down", F.coalesce(-F.col("mean_error"), F.lit(float("inf")))), [], ["__down", "value"], {"__upto": "n"}, totals=True)
    return ran.select("value", "mean_error", "n", (F.col("__upto") / F.col("__upto_n")).alias("upto"))


def error_segments(df: DataFrame, feature: str, error: str, categorical: bool, least: float = 0.05, most: int = 1000, n_samples: int = 10_000) -> list[Filter]:
    """One feature cut in two by error: the worse side first. Empty if no cut leaves ``least`` of the rows on both sides.

    Numbers are cut by a tree over ``n_samples`` rows. Categories with the
    largest mean errors, of half of the rows together, are the worse side, as
    a list of ``most`` at most: if it takes more, no list of them is a segment.
    """
    if categorical:
        ran = error_by_category(df, feature, error)
        row = ran.agg(F.count_if(F.col("upto") <= 0.5).alias("k"), F.max(F.when(F.col("upto") <= 0.5, F.col("upto"))).alias("share")).first()
        worse = ran.where(F.col("upto") <= 0.5) if row.k else ran
        if row.k > most:
            return []
        found = worse.orderBy(F.col("mean_error").desc_nulls_last(), "value").limit(row.k or 1).collect()
        share = max((r.upto for r in found), default=0.0)
        if not least <= share <= 1 - least:
            return []
        names = [r.value for r in found]
        kinds = [r[0] for r in df.where(F.col(feature).cast("string").isin(*names)).groupBy(F.col(feature).cast("string").alias("v")).agg(F.min(feature).alias("k")).select("k").collect()]
        return [Filter(name="worse").among(feature, kinds), Filter(name="better").without(feature, kinds)]
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import DecisionTreeRegressor

    from .models import hash_sample

    rows = hash_sample(df.where(F.col(feature).isNotNull()).select(F.col(feature).cast("double").alias(feature), F.col(error).cast("double").alias("__e")), n_samples, [feature, "__e"])
    rows = VectorAssembler(inputCols=[feature], outputCol="__x").transform(rows)
    tree = DecisionTreeRegressor(featuresCol="__x", labelCol="__e", maxDepth=1, minInstancesPerNode=max(1, int(least * rows.count())), seed=42).fit(rows)
    leaves = sorted(tree_filters(tree, [feature]), key=lambda x: -x[1])
    return [f for f, _ in leaves] if len(leaves) == 2 else []
