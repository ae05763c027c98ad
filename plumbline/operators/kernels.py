"""Statistical kernels: drift measures, entropies, correlations, outlier fences and ranks.

Every kernel works on long rows (feature, side, value), so that any number of
columns costs one shuffle on (feature, value); what follows is as large as the
distinct values or categories.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.running import at_quantiles, exact_quantiles, running_sums

OTHER = "Other rare categories"
#: Shares below this count as this in the population stability index.
PSI_FLOOR = 0.01


def tag(train: DataFrame, test: DataFrame, columns: list[str], kind: str) -> DataFrame:
    """(feature, side, v): all values of ``columns`` (cast to ``kind``), side 0 for train and 1 for test."""
    parts = [df.select(F.lit(side).alias("side"), *(F.col(f"`{c}`").cast(kind).alias(c) for c in columns)) for side, df in enumerate((train, test))]
    both = parts[0].unionByName(parts[1])
    cells = F.array(*(F.struct(F.lit(c).alias("feature"), F.col(f"`{c}`").alias("v")) for c in columns))
    return both.select("side", F.inline(cells)).select("feature", "side", "v")


def value_counts(tagged: DataFrame) -> DataFrame:
    """(feature, v, a, b): how often each value occurs in train and in test."""
    return tagged.groupBy("feature", "v").agg(F.sum((F.col("side") == 0).cast("long")).alias("a"), F.sum((F.col("side") == 1).cast("long")).alias("b"))


def sizes(counts: DataFrame) -> DataFrame:
    return counts.groupBy("feature").agg(F.sum("a").alias("na"), F.sum("b").alias("nb"))


def _number(tagged: DataFrame) -> DataFrame:
    return tagged.where(F.col("v").isNotNull() & ~F.isnan("v"))


def ranked_values(tagged: DataFrame) -> DataFrame:
    """(feature, v, a, b, ca, cb, next, ca_n, cb_n): the rank index of both sides of all features, which :func:`ks` and :func:`emd` read; nulls and NaN left out."""
    return running_sums(value_counts(_number(tagged)), ["feature"], "v", {"ca": "a", "cb": "b"}, "next", totals=True)


def ks(tagged: DataFrame) -> DataFrame:
    """(feature, score): the Kolmogorov-Smirnov distance of train and test, nulls left out."""
    gap = F.abs(F.col("ca") / F.col("ca_n") - F.col("cb") / F.col("cb_n"))
    return ranked_values(tagged).groupBy("feature").agg(F.max(gap).alias("score"))


def _rows_at(side: str, q: float, with_own: bool) -> Column:
    """An aggregate over :func:`ranked_values`: the rows of a side below its q-quantile, or up to it."""
    upto, row = F.col(f"c{side}"), F.lit(float(q)) * (F.col(f"c{side}_n") - 1)
    value = lambda k: F.min(F.when(upto > k, F.col("v")))
    reached = F.ceil(row) if with_own else F.floor(row)
    # Between two values the quantile is none of them.
    at_value = F.min(F.when(upto > reached, upto if with_own else upto - F.col(side)))
    return F.when(value(F.floor(row)) == value(F.ceil(row)), at_value).otherwise(F.max(F.floor(row)) + 1)


def emd(tagged: DataFrame, margin: float = 0.0) -> DataFrame:
    """(feature, score): the earth mover's distance after scaling both sides to their joint range.

    With ``margin``, values outside the quantiles margin and 1 - margin of
    their side are left out first. Equal values throughout give 0. Fences,
    what they leave out, and the distance are read from one rank index.
    """
    ran = ranked_values(tagged)
    inside = {n: F.col(n) > 0 for n in ("a", "b")}
    share = lambda n: F.col(f"c{n}") / F.col(f"c{n}_n")
    if margin:
        # Each side's fences, how many of its rows lie below the lower one, and how many up to the upper one, in one aggregate.
        found = []
        for n in ("a", "b"):
            low, high = at_quantiles("v", f"c{n}", [margin, 1 - margin])
            found += [low.alias(f"{n}0"), high.alias(f"{n}1"), _rows_at(n, margin, False).alias(f"{n}_low"), _rows_at(n, 1 - margin, True).alias(f"{n}_upto")]
        ran = ran.join(F.broadcast(ran.groupBy("feature").agg(*found)), "feature")
        inside = {n: (F.col(n) > 0) & (F.col("v") >= F.col(f"{n}0")) & (F.col("v") <= F.col(f"{n}1")) for n in ("a", "b")}
        share = lambda n: (F.least(F.greatest(F.col(f"c{n}"), F.col(f"{n}_low")), F.col(f"{n}_upto")) - F.col(f"{n}_low")) / (F.col(f"{n}_upto") - F.col(f"{n}_low"))
    gap = F.abs(share("a") - share("b"))
    left = inside["a"] | inside["b"]
    # Beyond the last value that is left, both shares are 1: no gap.
    whole = ran.groupBy("feature").agg(F.sum(gap * (F.col("next") - F.col("v"))).alias("area"), (F.max(F.when(left, F.col("v"))) - F.min(F.when(left, F.col("v")))).alias("range"))
    return whole.select("feature", F.when(F.col("range") > 0, F.col("area") / F.col("range")).otherwise(F.lit(0.0)).alias("score"))


def fold_rare(counts: DataFrame, min_ratio: float = 0.01, max_categories: int | None = None) -> DataFrame:
    """Counts with the categories that are rare in train folded into one, which stays if it is no longer rare on either side."""
    sized = counts.join(F.broadcast(sizes(counts)), "feature")
    rare = F.col("a") < min_ratio * F.col("na")
    if max_categories:
        # Only the first of each task get to the window.
        place = F.row_number().over(Window.partitionBy("feature").orderBy(F.desc("a"), "v"))
        first = sized.withColumn("place", place).where(F.col("place") <= max_categories).select("feature", F.col("v").alias("__v"), F.lit(True).alias("__first"))
        sized = sized.join(F.broadcast(first), (sized["feature"] == first["feature"]) & sized["v"].eqNullSafe(first["__v"]), "left").drop(first["feature"], first["__v"])
        rare = rare | F.col("__first").isNull()
    folded = sized.withColumn("v", F.when(rare, F.lit(OTHER)).otherwise(F.col("v"))).groupBy("feature", "v").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.max("na").alias("na"), F.max("nb").alias("nb"))
    stays = (F.col("v") != OTHER) | (F.col("a") > min_ratio * F.col("na")) | (F.col("b") > min_ratio * F.col("nb"))
    return folded.where(F.coalesce(stays, F.lit(True))).select("feature", "v", "a", "b")


def psi(counts: DataFrame) -> DataFrame:
    """(feature, score): the population stability index of counted categories."""
    sized = counts.join(F.broadcast(sizes(counts)), "feature")
    p, q = (F.greatest(F.col(c) / F.col(n), F.lit(PSI_FLOOR)) for c, n in (("a", "na"), ("b", "nb")))
    return sized.groupBy("feature").agg(F.sum((p - q) * F.log(p / q)).alias("score"))


def _balanced(scaled: DataFrame) -> DataFrame:
    """Train with equal counts, and test with the change that each category had (one added to both), at the same total."""
    per = scaled.groupBy("feature").agg(F.count("*").alias("k"), F.floor(F.sum(F.col("b") + 1) / F.count("*")).cast("double").alias("even"))
    moved = scaled.join(F.broadcast(per), "feature").select("feature", "k", "even", F.bround(F.col("even") * (F.col("b") + 1) / (F.col("a") + 1)).alias("b"))
    total = moved.groupBy("feature").agg(F.sum("b").alias("t"))
    return moved.join(F.broadcast(total), "feature").select("feature", F.col("even").alias("a"), F.bround(F.col("b") * F.col("k") * F.col("even") / F.col("t")).alias("b"))


def cramers_v(counts: DataFrame, balance: bool = False) -> DataFrame:
    """(feature, score): bias-corrected Cramér's V of side against category.

    The larger side is scaled down to the smaller one and rounded (half to
    even); two categories get the correction for continuity. With
    ``balance``, all categories weigh alike whatever their size in train.
    """
    sized = counts.join(F.broadcast(sizes(counts)), "feature")
    least = F.least("na", "nb")
    fit = lambda c, n: F.col(c) * least / F.col(n)
    scaled = sized.select("feature", fit("a", "na").alias("a"), fit("b", "nb").alias("b"))
    scaled = _balanced(scaled) if balance else scaled.select("feature", F.bround("a").alias("a"), F.bround("b").alias("b"))
    scaled = scaled.where("a + b > 0")
    totals = scaled.groupBy("feature").agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"), F.count("*").alias("k"))
    cells = scaled.join(F.broadcast(totals), "feature").withColumn("n", F.col("ta") + F.col("tb"))

    def part(own: str, total: str) -> Column:
        expected = (F.col("a") + F.col("b")) * F.col(total) / F.col("n")
        off = F.abs(F.col(own) - expected)
        off = F.when(F.col("k") == 2, off - F.least(F.lit(0.5), off)).otherwise(off)
        return off * off / expected

    chi = cells.groupBy("feature").agg(F.sum(part("a", "ta") + part("b", "tb")).alias("chi2"), F.max("n").alias("n"), F.max("k").alias("k"))
    phi = F.greatest(F.lit(0.0), F.col("chi2") / F.col("n") - (F.col("k") - 1) / (F.col("n") - 1))
    columns = F.col("k") - (F.col("k") - 1) * (F.col("k") - 1) / (F.col("n") - 1)
    rows = 2 - 1 / (F.col("n") - 1)
    return chi.select("feature", F.when(F.col("k") < 2, F.lit(0.0)).otherwise(F.sqrt(phi / F.least(columns - 1, rows - 1))).alias("score"))


def theil_u(df: DataFrame, x: str, y: str) -> DataFrame:
    """(h_x, h_x_given_y, u): entropies with natural logarithms and how much of x's y explains; 1 if x is constant."""
    pairs = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(F.col(x).alias("x"), F.col(y).alias("y")).agg(F.count("*").alias("n"))
    total = pairs.agg(F.sum("n").alias("t"))
    by_y = pairs.groupBy("y").agg(F.sum("n").alias("ny"))
    given = pairs.join(by_y, "y").crossJoin(F.broadcast(total)).agg(F.sum(F.col("n") / F.col("t") * F.log(F.col("ny") / F.col("n"))).alias("h_x_given_y"))
    own = pairs.groupBy("x").agg(F.sum("n").alias("nx")).crossJoin(F.broadcast(total)).agg(F.sum(-F.col("nx") / F.col("t") * F.log(F.col("nx") / F.col("t"))).alias("h_x"))
    both = own.crossJoin(given)  # one row each
    return both.select("h_x", "h_x_given_y", F.when(F.col("h_x") == 0, F.lit(1.0)).otherwise((F.col("h_x") - F.col("h_x_given_y")) / F.col("h_x")).alias("u"))


def symmetric_theil_u(df: DataFrame, x: str, y: str) -> DataFrame:
    """(score): the mean of both directions, weighted by the entropies."""
    a, b = theil_u(df, x, y), theil_u(df, y, x)
    both = a.select(F.col("h_x").alias("hx"), F.col("u").alias("ux")).crossJoin(b.select(F.col("h_x").alias("hy"), F.col("u").alias("uy")))
    return both.select(F.try_divide(F.col("ux") * F.col("hx") + F.col("uy") * F.col("hy"), F.col("hx") + F.col("hy")).alias("score"))


def correlation_ratio(df: DataFrame, category: str, number: str) -> DataFrame:
    """(score): the square root of the share of a number's variance that lies between categories; 0 without variance."""
    rows = df.where(F.col(category).isNotNull() & F.col(number).isNotNull())
    groups = rows.groupBy(category).agg(F.count("*").alias("n"), F.avg(number).alias("m"), F.var_pop(number).alias("s"))
    whole = groups.agg(F.sum("n").alias("t"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("mean"))
    spread = groups.crossJoin(F.broadcast(whole)).agg(F.sum(F.col("n") * F.pow(F.col("m") - F.col("mean"), 2)).alias("ssb"), F.sum(F.col("n") * F.col("s")).alias("ssw"))
    return spread.select(F.when(F.col("ssb") + F.col("ssw") > 0, F.sqrt(F.col("ssb") / (F.col("ssb") + F.col("ssw")))).otherwise(F.lit(0.0)).alias("score"))


def average_ranks(df: DataFrame, value: str, part: list[str] | None = None) -> DataFrame:
    """(part, value, rank, n): each distinct value's average rank, from 1, and how often it occurs."""
    part = part or []
    counts = df.groupBy(*part, value).agg(F.count("*").alias("n"))
    ran = running_sums(counts, part, value, {"upto": "n"})
    return ran.select(*part, value, (F.col("upto") - (F.col("n") - 1) / 2).alias("rank"), "n")


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """(score): the rank correlation of two numbers, ties at their average rank."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    pairs = rows.groupBy("x", "y").agg(F.count("*").alias("k"))
    rx, ry = (average_ranks(rows, c).select(c, F.col("rank").alias(f"r{c}")) for c in ("x", "y"))
    ranked = pairs.join(rx, "x").join(ry, "y")
    s = {n: F.sum(e).alias(n) for n, e in {"n": F.col("k"), "a": F.col("k") * F.col("rx"), "b": F.col("k") * F.col("ry"), "aa": F.col("k") * F.col("rx") * F.col("rx"), "bb": F.col("k") * F.col("ry") * F.col("ry"), "ab": F.col("k") * F.col("rx") * F.col("ry")}.items()}
    sums = ranked.agg(*s.values())
    top = F.col("ab") - F.col("a") * F.col("b") / F.col("n")
    spread = lambda q, m: F.col(q) - F.col(m) * F.col(m) / F.col("n")
    return sums.select(F.try_divide(top, F.sqrt(spread("aa", "a") * spread("bb", "b"))).alias("score"))


def auc(df: DataFrame, positive: str, score: str, part: list[str] | None = None) -> DataFrame:
    """(part, auc): the area under the ROC curve of a 0/1 column and a score, by ranks; null if one class is absent."""
    part = part or []
    counts = df.groupBy(*part, score).agg(F.count("*").alias("n"), F.sum(F.col(positive).cast("long")).alias("p"))
    ran = running_sums(counts, part, score, {"upto": "n"}).withColumn("rank", F.col("upto") - (F.col("n") - 1) / 2)
    sums = ran.groupBy(*part).agg(F.sum("p").alias("p"), F.sum("n").alias("n"), F.sum(F.col("p") * F.col("rank")).alias("r"))
    area = F.try_divide(F.col("r") - F.col("p") * (F.col("p") + 1) / 2, F.col("p") * (F.col("n") - F.col("p")))
    return sums.select(*part, area.alias("auc"))


def average_precision(df: DataFrame, positive: str, score: str) -> DataFrame:
    """(average_precision): precision at each distinct score, weighted by the recall it adds."""
    counts = df.groupBy(score).agg(F.count("*").alias("n"), F.sum(F.col(positive).cast("long")).alias("p")).withColumn("down", -F.col(score))
    ran = running_sums(counts, [], "down", {"seen": "n", "hit": "p"})
    return ran.agg(F.try_divide(F.sum(F.col("p") * F.col("hit") / F.col("seen")), F.sum("p")).alias("average_precision"))


def iqr_fences(df: DataFrame, columns: list[str], percentiles: tuple[float, float] = (25, 75), scale: float = 1.5, sharp_drop_ratio: float = 0.9) -> DataFrame:
    """(feature, low, high): fences around the given percentiles.

    Where both percentiles are equal: 0.001 around them if one value has more
    than ``sharp_drop_ratio`` of the rows, else around them by the distance to
    the nearest other value.
    """
    cells = F.array(*(F.struct(F.lit(c).alias("feature"), F.col(f"`{c}`").cast("double").alias("v")) for c in columns))
    rows = df.select(F.inline(cells)).where(F.col("v").isNotNull() & ~F.isnan("v"))
    counts = rows.groupBy("feature", "v").agg(F.count("*").alias("n"))
    return fences_of(running_sums(counts, ["feature"], "v", {"upto": "n"}, totals=True), percentiles, scale, sharp_drop_ratio)


def fences_of(ran: DataFrame, percentiles: tuple[float, float], scale: float, sharp_drop_ratio: float = 0.9) -> DataFrame:
    """(feature, low, high): :func:`iqr_fences` of a rank index (feature, v, n, upto, upto_n)."""
    q = ran.groupBy("feature").agg(F.array(*at_quantiles("v", "upto", [p / 100 for p in percentiles])).alias("q"))
    near = ran.join(F.broadcast(q), "feature").groupBy("feature").agg(
        F.first("q").alias("q"),
        (F.sum(F.when(F.col("v") == F.col("q")[0], F.col("n")).otherwise(0)) / F.first("upto_n")).alias("share"),
        F.min(F.when(F.col("v") != F.col("q")[0], F.abs(F.col("v") - F.col("q")[0]))).alias("near"),
    )
    q1, q3 = F.col("q")[0], F.col("q")[1]
    by = F.when(q1 != q3, (q3 - q1) * scale).when(F.col("share") > sharp_drop_ratio, F.lit(0.001)).otherwise(F.coalesce(F.col("near"), F.lit(0.001)) * scale)
    return near.select("feature", (q1 - by).alias("low"), (q3 + by).alias("high"))


def sharp_drop(counts: DataFrame, value: str, n: str, ratio: float = 0.9, mass: float = 0.95) -> DataFrame:
    """(value, share) of the categories behind the first sharp drop of shares beyond ``mass``: outliers. Few categories only."""
    total = counts.agg(F.sum(n).alias("t"))
    shares = counts.crossJoin(F.broadcast(total)).select(F.col(value).alias("value"), (F.col(n) / F.col("t")).alias("share"))
    order = Window.orderBy(F.desc("share"), "value")
    ran = shares.withColumn("upto", F.sum("share").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("before", F.lag("share").over(order)).withColumn("had", F.lag("upto").over(order))
    drop = ran.withColumn("drop", (F.col("had") >= mass) & (F.col("share") <= (1 - ratio) * F.col("before")))
    return drop.withColumn("out", F.max(F.col("drop").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))).where("out = 1").select("value", "share")


def quantile_edges(df: DataFrame, column: str, segments: int) -> list[float]:
    """Distinct edges of about ``segments`` quantile bins of one column."""
    edges, k = [], segments
    while k <= 64 * segments:
        edges = sorted(set((exact_quantiles(df, [], column, [i / k for i in range(k + 1)]).first() or ([],))[0]))
        if len(edges) > segments or k >= 4 * segments:
            break
        k *= 2
    if len(edges) > segments + 1:
        keep = [round(i * (len(edges) - 1) / segments) for i in range(segments + 1)]
        edges = [edges[i] for i in sorted(set(keep))]
    return edges


def segment(column: str, edges: list[float]) -> Column:
    """The bin of a number among ``edges``, as text; the last bin is closed."""
    c = F.col(f"`{column}`")
    bins = list(zip(edges[:-1], edges[1:])) or [(edges[0], edges[0])]
    label = lambda lo, hi, last: f"[{lo:g}, {hi:g}" + ("]" if last else ")")
    tests = [((c >= lo) & ((c <= hi) if k == len(bins) - 1 else (c < hi)), label(lo, hi, k == len(bins) - 1)) for k, (lo, hi) in enumerate(bins)]
    return reduce(lambda a, t: a.when(t[0], F.lit(t[1])), tests[1:], F.when(tests[0][0], F.lit(tests[0][1])))
