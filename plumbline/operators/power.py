"""How well one feature alone predicts a label, for all features from one aggregate.

A fully grown tree on one feature says, for each value, the commonest label (or
the mean) of its training rows. So all that its cross validation needs are the
counts of (feature, bin of its values, label): they are counted once for all
features, dealt to folds as counts, and scored. How often the table is read
doesn't depend on the number of features, and no row is sampled.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer, StringIndexerModel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.running import at_quantiles, running_sums
from ..sources.scratch import kept

#: Bins of a feature.
BINS = 256
#: Rows of a cell that are dealt to folds one by one, by hash; what a cell has beyond them is dealt evenly.
DRAWN = 64
NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double", "date", "timestamp", "timestamp_ntz")


def _is_number(kind: str) -> bool:
    return kind in NUMBERS or kind.startswith("decimal")


def _number(column: str, kind: str) -> Column:
    """A finite double, or null; times are seconds."""
    c = F.col(f"`{column}`")
    v = (c.cast("timestamp") if kind in ("date", "timestamp_ntz") else c).cast("double")
    return F.when(F.abs(v) < float("inf"), v)


def _long(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(at, v): the values of several columns, numbered, without nulls."""
    cells = F.array(*(F.struct(F.lit(int(c[1:])).alias("at"), F.col(c).alias("v")) for c in columns))
    return rows.select(F.inline(cells)).where(F.col("v").isNotNull())


def _edges(rows: DataFrame, columns: list[str], bins: int) -> dict[str, list[float]]:
    """The least value of each bin but the first. A column of at most ``bins`` values has a bin for each; of others a value's bin is ``bins`` times the share of rows below it."""
    counts = _long(rows, columns).groupBy("at", "v").agg(F.count("*").alias("n"), F.lit(1).cast("long").alias("one"))
    ran = running_sums(counts, ["at"], "v", {"upto": "n", "place": "one"}, totals=True)
    bin_ = F.when(F.col("place_n") <= bins, F.col("place") - 1).otherwise(F.floor((F.col("upto") - F.col("n")) * bins / F.col("upto_n")))
    found = ran.groupBy("at", bin_.alias("bin")).agg(F.min("v").alias("low")).collect()  # a row per column and bin
    return {c: sorted(r.low for r in found if f"f{r['at']}" == c)[1:] for c in columns}


def _often(rows: DataFrame, columns: list[str], bins: int) -> dict[str, list[str]]:
    """The ``bins`` - 1 most frequent values of each column, by falling frequency, then by value."""
    counts = _long(rows, columns).groupBy("at", "v").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("at").orderBy(F.desc("n"), "v"))  # each task passes on the first ones of a column only
    found = counts.withColumn("place", place).where(F.col("place") < bins).collect()  # a row per column and bin
    return {c: [r.v for r in sorted(found, key=lambda r: r.place) if f"f{r['at']}" == c] for c in columns}


def power_cells(df: DataFrame, features: list[str], label: str, regression: bool = False, bins: int = BINS) -> DataFrame:
    """(feature, bin, y, n): rows by the bin of each feature and by label, a table that is written; rows without the label or the feature are left out.

    Numbers, dates and times lie in bins in their order, NaN and infinite ones
    in none; other values in one bin each, by falling frequency, those beyond
    the most frequent ``bins`` - 1 together in the last one.
    """
    kinds = dict(df.dtypes)
    number = [f"f{k}" for k, f in enumerate(features) if _is_number(kinds[f])]
    text = [f"f{k}" for k in range(len(features)) if f"f{k}" not in number]
    y = _number(label, kinds[label]) if regression else F.col(f"`{label}`").cast("string")
    own = [(_number(f, kinds[f]) if f"f{k}" in number else F.col(f"`{f}`").cast("string")).alias(f"f{k}") for k, f in enumerate(features)]
    rows = df.select(*own, y.alias("y")).where(F.col("y").isNotNull())
    edges = _edges(rows, number, bins) if number else {}
    values = _often(rows, text, bins) if text else {}
    binned = rows
    cut = [c for c in number if edges[c]]
    if cut:
        splits = [[-float("inf"), *edges[c], float("inf")] for c in cut]
        binned = Bucketizer(splitsArray=splits, inputCols=cut, outputCols=[f"b_{c}" for c in cut], handleInvalid="keep").transform(binned)
    known = [c for c in text if values[c]]
    if known:
        binned = StringIndexerModel.from_arrays_of_labels([values[c] for c in known], known, [f"b_{c}" for c in known], handleInvalid="keep").transform(binned)
    place = lambda c: F.when(F.col(c).isNotNull(), F.col(f"b_{c}").cast("int") if c in [*cut, *known] else F.lit(0))
    cells = F.array(*(F.struct(F.lit(f).alias("feature"), place(f"f{k}").alias("bin")) for k, f in enumerate(features)))
    return kept(binned.select("y", F.inline(cells)).where(F.col("bin").isNotNull()).groupBy("feature", "bin", "y").agg(F.count("*").alias("n")))


def dealt(cells: DataFrame, folds: int) -> DataFrame:
    """(feature, bin, y, n, fold, m): how many of a cell's ``n`` rows are in each fold.

    Rows of a cell are alike to a tree on its feature, so they are dealt as
    counts: ``DRAWN`` of them each by the hash of the cell and their number, as
    if at random, and the others evenly.
    """
    single = F.least(F.col("n"), F.lit(DRAWN))
    key = lambda i: F.md5(F.concat_ws("|", "feature", F.col("bin").cast("string"), F.col("y").cast("string"), i.cast("string")))
    drawn = F.transform(F.sequence(F.lit(1).cast("long"), single), lambda i: F.conv(F.substring(key(i), 1, 8), 16, 10).cast("long") % folds)
    rest = F.col("n") - single
    even = lambda k: F.floor(rest / folds) + F.when(rest % folds > k, 1).otherwise(0)
    of = lambda k: F.size(F.filter("__drawn", lambda f: f == k))
    shares = F.array(*((of(k) + even(k)).cast("long") for k in range(folds)))
    return cells.withColumn("__drawn", drawn).select("feature", "bin", "y", "n", F.posexplode(shares).alias("fold", "m"))


def _said(rows: DataFrame, regression: bool) -> DataFrame:
    """(feature, fold, bin, p): what the tree that hasn't seen a fold says of a bin; where it saw none of the bin's rows, what it says of the nearest bin, of the lower of two."""
    t = F.col("n") - F.col("m")
    top = F.when(F.sum(t) > 0, F.sum(t * F.col("y")) / F.sum(t)) if regression else F.min(F.when(t > 0, F.struct((-t).alias("t"), "y")))["y"]
    per = rows.groupBy("feature", "fold", "bin").agg(top.alias("top"))
    seen = F.when(F.col("top").isNotNull(), F.struct("bin", "top"))
    along = Window.partitionBy("feature", "fold").orderBy("bin")  # a row per bin
    low, high = F.last(seen, True).over(along.rowsBetween(Window.unboundedPreceding, 0)), F.first(seen, True).over(along.rowsBetween(0, Window.unboundedFollowing))
    near = per.withColumn("low", low).withColumn("high", high)
    lower = F.col("high").isNull() | (F.col("bin") - F.col("low.bin") <= F.col("high.bin") - F.col("bin"))
    return near.select("feature", "fold", "bin", F.when(lower, F.col("low.top")).otherwise(F.col("high.top")).alias("p"))


def predictive_power(df: DataFrame, features: list[str], label: str, regression: bool = False, folds: int = 4, bins: int = BINS) -> DataFrame:
    """(feature, score): how much better a tree on one feature predicts the label than a naive guess, by cross validation over all rows; from 0 to 1.

    Classification: how far the weighted F1 lies between the better one of two
    guesses (always the commonest label; the labels in random order, as
    expected) and 1. Regression: 1 - MAE / MAE of the median. Equal counts
    say the smaller label. A feature or label without values scores 0.
    """
    cells = power_cells(df, features, label, regression, bins)
    rows = dealt(cells, folds)
    judged = rows.where("m > 0").join(_said(rows, regression), ["feature", "fold", "bin"])
    if regression:
        mae = judged.groupBy("feature").agg((F.sum(F.col("m") * F.abs(F.col("y") - F.col("p"))) / F.sum("m")).alias("mae"))
        ran = running_sums(cells.groupBy("feature", "y").agg(F.sum("n").alias("n")), ["feature"], "y", {"upto": "n"}, totals=True)
        middle = ran.groupBy("feature").agg(at_quantiles("y", "upto", [0.5])[0].alias("q"))
        base = cells.join(F.broadcast(middle), "feature").groupBy("feature").agg((F.sum(F.col("n") * F.abs(F.col("y") - F.col("q"))) / F.sum("n")).alias("base"))
        scored = mae.join(base, "feature").select("feature", F.when(F.col("base") > 0, F.greatest(F.lit(0.0), 1 - F.col("mae") / F.col("base"))).alias("score"))
    else:
        right, zero = F.when(F.col("y") == F.col("p"), F.col("m")).otherwise(0), F.lit(0).cast("long")
        sides = F.array(F.struct(F.col("y").alias("c"), F.col("m").alias("own"), right.alias("hit"), zero.alias("said")), F.struct(F.col("p").alias("c"), zero.alias("own"), zero.alias("hit"), F.col("m").alias("said")))
        per = judged.select("feature", F.inline(sides)).groupBy("feature", "c").agg(*(F.sum(x).cast("double").alias(x) for x in ("own", "hit", "said")))
        whole = per.groupBy("feature").agg(F.sum("own").alias("n"), F.sum(F.col("own") * 2 * F.col("hit") / (F.col("own") + F.col("said"))).alias("f"), F.max("own").alias("most"), F.sum(F.col("own") * F.col("own")).alias("squares"))
        share = F.col("most") / F.col("n")
        base = F.greatest(2 * share * share / (1 + share), F.col("squares") / (F.col("n") * F.col("n")))
        scored = whole.select("feature", (F.col("f") / F.col("n")).alias("f1"), base.alias("base")).select("feature", F.when(F.col("base") < 1, F.greatest(F.lit(0.0), (F.col("f1") - F.col("base")) / (1 - F.col("base")))).alias("score"))
    names = df.sparkSession.createDataFrame([(f,) for f in features], "feature string")
    return names.join(scored, "feature", "left").select("feature", F.coalesce("score", F.lit(0.0)).alias("score"))
