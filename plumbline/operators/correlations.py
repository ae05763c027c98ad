"""The correlation of every pair of columns, each kind of pair from one pass over the table.

Two numbers have the rank correlation of Spearman, two categories the
symmetric uncertainty of Theil, a number and a category the correlation ratio.
A pair is about the rows that have both values. How often the table is read
doesn't depend on the number of columns: a row becomes one term of each of its
pairs' sums, which every task adds up for itself.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.running import running_sums
from ..sources.scratch import kept

Pair = tuple[int, int]

#: Values that more than this part of all distinct rows' values are of are heavy; there are at most so many.
MOST_HEAVY = 10_000


def _terms(pairs: list[Pair], x, y) -> Column:
    """A row's (pair, x, y) for each pair, nulls included."""
    return F.inline(F.array(*(F.struct(F.lit(k).alias("pair"), x(*p).alias("x"), y(*p).alias("y")) for k, p in enumerate(pairs))))


def rank_correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """(pair, score) of numbers, pairs numbered as ``combinations`` has them; ties have their average rank, nulls and NaN take no part.

    Distinct rows are counted, and each value gets its rank from one index
    over all columns. A column with missing values changes the ranks of those
    it is paired with, so a value has a rank among all rows and one among the
    rows that have each such column.
    """
    pairs = list(combinations(range(len(columns)), 2))
    values = [F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None).cast("double")).alias(f"v{k}") for k, c in enumerate(columns)]
    rows = kept(df.select(*values).groupBy(*(f"v{k}" for k in range(len(columns)))).agg(F.count("*").alias("k")).withColumn("id", F.monotonically_increasing_id()))
    missing = rows.agg(*(F.max(F.col(f"v{k}").isNull()).alias(f"v{k}") for k in range(len(columns)))).first()
    holed = [k for k in range(len(columns)) if missing[f"v{k}"]]
    present = F.array(F.lit(True), *(F.col(f"v{k}").isNotNull() for k in holed))
    cells = F.array(*(F.struct(F.lit(k).alias("at"), F.col(f"v{k}").alias("v")) for k in range(len(columns))))
    long = rows.select("id", "k", present.alias("present"), F.inline(cells)).where(F.col("v").isNotNull())
    slots = range(len(holed) + 1)
    counts = long.groupBy("at", "v").agg(F.count("*").alias("d"), *(F.sum(F.when(F.col("present")[s], F.col("k")).otherwise(0)).alias(f"n{s}") for s in slots))
    ran = running_sums(counts, ["at"], "v", {f"u{s}": f"n{s}" for s in slots})
    ranks = ran.select("at", "v", "d", F.array(*(F.col(f"u{s}") - (F.col(f"n{s}") - 1) / 2 for s in slots)).alias("ranks"))
    # Values of many rows would bring all of these to one task: their ranks, few as they are, go to the rows.
    share = counts.agg(F.sum("d") / MOST_HEAVY).first()[0] or 0.0
    ranks = kept(ranks)
    heavy, light = F.broadcast(ranks.where(F.col("d") > share).drop("d")), ranks.where(F.col("d") <= share).drop("d")
    known = long.join(heavy, ["at", "v"], "left")
    met = known.where("ranks IS NOT NULL").unionByName(known.where("ranks IS NULL").drop("ranks").join(light, ["at", "v"]), allowMissingColumns=True)
    ranked = met.groupBy("id").agg(F.max("k").alias("k"), *(F.max(F.when(F.col("at") == k, F.col("ranks")[s])).alias(f"r{k}_{s}") for k in range(len(columns)) for s in slots))  # numbers, as arrays would be sorted
    rank = lambda own, other: F.col(f"r{own}_{holed.index(other) + 1 if other in holed else 0}")
    terms = ranked.select("k", _terms(pairs, rank, lambda a, b: rank(b, a))).where("x IS NOT NULL AND y IS NOT NULL")
    k, x, y = F.col("k"), F.col("x"), F.col("y")
    sums = terms.groupBy("pair").agg(*(F.sum(e).alias(n) for n, e in {"n": k, "a": k * x, "b": k * y, "aa": k * x * x, "bb": k * y * y, "ab": k * x * y}.items()))
    spread = lambda q, m: F.col(q) - F.col(m) * F.col(m) / F.col("n")
    return sums.select("pair", F.try_divide(F.col("ab") - F.col("a") * F.col("b") / F.col("n"), F.sqrt(spread("aa", "a") * spread("bb", "b"))).alias("score"))


def uncertainties(df: DataFrame, columns: list[str]) -> DataFrame:
    """(pair, score) of categories: how much of both entropies the other column explains; null if both are constant."""
    pairs = list(combinations(columns, 2))
    value = lambda c: F.col(f"`{c}`").cast("string")
    cells = kept(df.select(_terms(pairs, lambda a, b: value(a), lambda a, b: value(b))).where("x IS NOT NULL AND y IS NOT NULL").groupBy("pair", "x", "y").agg(F.count("*").alias("n")))
    total = cells.groupBy("pair").agg(F.sum("n").alias("t"))
    own = {c: cells.groupBy("pair", c).agg(F.sum("n").alias(f"n{c}")) for c in "xy"}
    part = lambda n: F.col(n) / F.col("t")
    given = cells.join(own["x"], ["pair", "x"]).join(own["y"], ["pair", "y"]).join(F.broadcast(total), "pair")
    left = given.groupBy("pair").agg(F.sum(part("n") * (F.log(F.col("nx") / F.col("n")) + F.log(F.col("ny") / F.col("n")))).alias("left"))
    entropy = [own[c].join(F.broadcast(total), "pair").groupBy("pair").agg(F.sum(-part(f"n{c}") * F.log(part(f"n{c}"))).alias(f"h{c}")) for c in "xy"]
    both = F.col("hx") + F.col("hy")
    return entropy[0].join(entropy[1], "pair").join(left, "pair").select("pair", F.try_divide(both - F.col("left"), both).alias("score"))


def correlation_ratios(df: DataFrame, numeric: list[str], categorical: list[str]) -> DataFrame:
    """(pair, score) of each number with each category: the square root of the share of variance between categories; 0 without variance. Nulls and NaN take no part."""
    pairs = [(x, y) for x in numeric for y in categorical]
    number = lambda x, y: F.nanvl(F.col(f"`{x}`").cast("double"), F.lit(None).cast("double"))
    terms = df.select(_terms(pairs, number, lambda x, y: F.col(f"`{y}`").cast("string"))).where("x IS NOT NULL AND y IS NOT NULL")
    groups = kept(terms.groupBy("pair", "y").agg(F.count("*").alias("n"), F.avg("x").alias("m"), F.var_pop("x").alias("s")))
    whole = groups.groupBy("pair").agg((F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("mean"))  # a row per pair
    spread = groups.join(F.broadcast(whole), "pair").groupBy("pair").agg(F.sum(F.col("n") * F.pow(F.col("m") - F.col("mean"), 2)).alias("ssb"), F.sum(F.col("n") * F.col("s")).alias("ssw"))
    return spread.select("pair", F.when(F.col("ssb") + F.col("ssw") > 0, F.sqrt(F.col("ssb") / (F.col("ssb") + F.col("ssw")))).otherwise(F.lit(0.0)).alias("score"))


def feature_correlation(df: DataFrame, numeric: list[str], categorical: list[str]) -> DataFrame:
    """(feature_1, feature_2, score) for each pair: Spearman, symmetric Theil's U, or the correlation ratio.

    A pair without rows that have both has no score, but 0 as a correlation
    ratio; so have numbers of which one is constant.
    """
    spark = df.sparkSession
    parts = [
        (list(combinations(numeric, 2)), None, lambda: rank_correlations(df, numeric)),
        ([(x, y) for x in numeric for y in categorical], 0.0, lambda: correlation_ratios(df, numeric, categorical)),
        (list(combinations(categorical, 2)), None, lambda: uncertainties(df, categorical)),
    ]
    out = spark.createDataFrame([], "feature_1 string, feature_2 string, score double")
    for pairs, absent, scores in parts:
        if pairs:
            named = spark.createDataFrame([(k, x, y) for k, (x, y) in enumerate(pairs)], "pair int, feature_1 string, feature_2 string")
            out = out.unionByName(named.join(scores(), "pair", "left").select("feature_1", "feature_2", F.coalesce("score", F.lit(absent).cast("double")).alias("score")))
    return out
