"""Integrity checks: one table in, one small result table out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType

from ..functions import running
from ..functions.strings import NULL_FORMS, base_form, base_form_or_text, is_number, is_only_special
from ..sources.scratch import kept
from . import kernels
from .lines import line_density
from .neighbours import BLOCK, gower_neighbours


def _is_null(df: DataFrame, c: str):
    kind = df.schema[c].dataType.typeName()
    column = F.col(f"`{c}`")
    return column.isNull() | F.isnan(column) if kind in ("double", "float") else column.isNull()


def _strings(df: DataFrame, columns: list[str] | None) -> list[str]:
    return columns or [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]


def string_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(feature, v, n): the distinct values of string columns and how often each occurs, nulls left out."""
    cells = F.array(*(F.struct(F.lit(c).alias("feature"), F.col(f"`{c}`").alias("v")) for c in _strings(df, columns)))
    return df.select(F.inline(cells)).where(F.col("v").isNotNull()).groupBy("feature", "v").agg(F.count("*").alias("n"))


def class_imbalance(df: DataFrame, label: str, ignore_nan: bool = True) -> DataFrame:
    """(label, ratio): each label's share of the rows, rounded half to even to two places."""
    rows = df.where(F.col(label).isNotNull()) if ignore_nan else df
    counts = rows.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("t"))
    return counts.crossJoin(F.broadcast(total)).select("label", F.bround(F.col("n") / F.col("t"), 2).alias("ratio"))


def profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, n, n_null, n_distinct, fractional): one pass over the table; exact distinct counts."""
    names = columns or df.columns
    aggs = []
    for i, c in enumerate(names):
        column = F.col(f"`{c}`")
        number = df.schema[c].dataType.typeName() in ("double", "float")
        aggs += [F.sum(_is_null(df, c).cast("long")).alias(f"u{i}"), F.count_distinct(column).alias(f"d{i}"), (F.max((column % 1 != 0).cast("int")) if number else F.lit(0)).alias(f"f{i}")]
    row = df.agg(F.count("*").alias("n"), *aggs)
    cells = F.array(*(F.struct(F.lit(c).alias("column"), F.col("n"), F.coalesce(F.col(f"u{i}"), F.lit(0)).alias("n_null"), F.col(f"d{i}").alias("n_distinct"), F.coalesce(F.col(f"f{i}"), F.lit(0)).cast("int").alias("fractional")) for i, c in enumerate(names)))
    return row.select(F.inline(cells))


def columns_info(df: DataFrame, label: str | None = None, index: str | None = None, datetime: str | None = None, cat_features: list[str] | None = None, max_ratio: float = 0.01) -> DataFrame:
    """(column, role): index, date, label, categorical feature, numerical feature or other feature.

    Without ``cat_features``, a column is categorical if its distinct values are
    few: under ``max_ratio`` of the rows (1000 at least) and at most 150 for
    strings, 30 for whole numbers, 5 for fractions and times.
    """
    found = profile(df)
    kinds = {f.name: f.dataType for f in df.schema.fields}
    few = F.col("n_distinct") / F.greatest(F.col("n") - F.col("n_null"), F.lit(1000)) < max_ratio
    role = None
    for name, kind in kinds.items():
        most = F.lit(150) if isinstance(kind, StringType) else F.when(F.col("fractional") == 1, 5).otherwise(30) if isinstance(kind, NumericType) else F.lit(5)
        if name in (index, datetime, label):
            own = F.lit({index: "index", datetime: "date", label: "label"}[name])
        elif cat_features is not None:
            own = F.lit("categorical feature" if name in cat_features else "numerical feature" if isinstance(kind, NumericType) else "other feature")
        else:
            own = F.when(few & (F.col("n_distinct") <= most), F.lit("categorical feature")).otherwise(F.lit("numerical feature" if isinstance(kind, NumericType) else "other feature"))
        test = F.col("column") == name
        role = F.when(test, own) if role is None else role.when(test, own)
    return found.select("column", role.alias("role"))


def conflicting_labels(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """(percent, n_conflicting): share of the rows whose features occur with several labels; nulls are equal."""
    pairs = df.groupBy(*features, F.col(label).alias("__label")).agg(F.count("*").alias("n"))
    groups = pairs.groupBy(*features).agg(F.sum("n").alias("n"), F.count("*").alias("labels"))
    return groups.agg((F.sum(F.when(F.col("labels") > 1, F.col("n")).otherwise(0)) / F.sum("n")).alias("percent"), F.sum(F.when(F.col("labels") > 1, F.col("n")).otherwise(0)).alias("n_conflicting"))


def data_duplicates(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(percent, n_rows, n_unique): share of the rows that repeat another one; nulls are equal."""
    groups = df.groupBy(*(columns or df.columns)).agg(F.count("*").alias("n"))
    return groups.agg((1 - F.count("*") / F.sum("n")).alias("percent"), F.sum("n").alias("n_rows"), F.count("*").alias("n_unique"))


def duplicate_groups(df: DataFrame, columns: list[str] | None = None, top: int = 5) -> DataFrame:
    """The most frequent repeated rows with their counts: a report of ``top`` rows."""
    names = columns or df.columns
    return df.groupBy(*names).agg(F.count("*").alias("n")).where("n > 1").orderBy(F.desc("n"), *names).limit(top)


def is_single_value(df: DataFrame, columns: list[str] | None = None, ignore_nan: bool = True) -> DataFrame:
    """(column, n_distinct, single): columns with one value only; without ``ignore_nan`` null is a value."""
    null = F.when(F.col("n_null") > 0, 1).otherwise(0)
    n = F.col("n_distinct") if ignore_nan else F.col("n_distinct") + null
    return profile(df, columns).select("column", n.cast("long").alias("n_distinct"), (n == 1).alias("single"))


def mixed_data_types(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, numbers, strings): shares of values that read as numbers and of others, for columns with both."""
    counts = string_counts(df, columns).groupBy(F.col("feature").alias("column")).agg((F.sum(F.when(is_number(F.col("v")), F.col("n")).otherwise(0)) / F.sum("n")).alias("numbers"))
    return counts.where((F.col("numbers") > 0) & (F.col("numbers") < 1)).select("column", "numbers", (1 - F.col("numbers")).alias("strings"))


def mixed_nulls(df: DataFrame, columns: list[str] | None = None, null_strings: list[str] | None = None) -> DataFrame:
    """(column, kind, n): how often each way to write a missing value occurs; SQL null is ``<null>``."""
    cells = F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("v")) for c in _strings(df, columns)))
    rows = df.select(F.inline(cells)).groupBy("column", "v").agg(F.count("*").alias("n"))
    forms = NULL_FORMS if null_strings is None else null_strings
    return rows.where(F.col("v").isNull() | base_form(F.col("v")).isin(forms)).select("column", F.coalesce("v", F.lit("<null>")).alias("kind"), "n")


def percent_of_nulls(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, percent): share of null or NaN values."""
    return _null_shares(df, columns or df.columns)


def _null_shares(df: DataFrame, names: list[str]) -> DataFrame:
    row = df.agg(*(F.avg(_is_null(df, c).cast("double")).alias(f"u{i}") for i, c in enumerate(names)))
    return row.select(F.inline(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"u{i}").alias("percent")) for i, c in enumerate(names)))))


def special_characters(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, percent): share of all values, nulls included, that are not empty and have no letter or digit."""
    names = _strings(df, columns)
    row = df.agg(*(F.avg(F.coalesce(is_only_special(F.col(f"`{c}`")), F.lit(False)).cast("double")).alias(f"u{i}") for i, c in enumerate(names)))
    return row.select(F.inline(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"u{i}").alias("percent")) for i, c in enumerate(names)))))


def string_mismatch(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, base, variant, n, percent): values that differ from others of their column in case and special characters only."""
    counts = string_counts(df, columns).withColumn("base", base_form_or_text(F.col("v")))
    totals = counts.groupBy("feature").agg(F.sum("n").alias("t"))
    several = counts.groupBy("feature", "base").agg(F.count("*").alias("k")).where("k > 1").select("feature", "base")
    found = counts.join(several, ["feature", "base"]).join(F.broadcast(totals), "feature")
    return found.select(F.col("feature").alias("column"), "base", F.col("v").alias("variant"), "n", (F.col("n") / F.col("t")).alias("percent"))


def string_length_out_of_bounds(df: DataFrame, columns: list[str] | None = None, inner: float = 94, factor: float = 4, min_difference: int = 5, min_ratio: float = 0.5) -> DataFrame:
    """(column, low, high, n_outliers): lengths outside the inner quantile range widened by ``factor``.

    The bounds are those quantiles less or plus ``factor`` times half the
    range; an outlier also differs from the median by ``min_difference``
    characters and by ``min_ratio`` of it.
    """
    counts = string_counts(df, columns).groupBy("feature", F.length("v").alias("len")).agg(F.sum("n").alias("n"))
    low, high = (100 - inner) / 200, 1 - (100 - inner) / 200
    q = counts.groupBy("feature").agg(F.percentile("len", F.array(F.lit(low), F.lit(0.5), F.lit(high)), F.col("n")).alias("q"))
    half = factor * (F.col("q")[2] - F.col("q")[0]) / 2
    joined = counts.join(F.broadcast(q), "feature").withColumn("low", F.col("q")[1] - half).withColumn("high", F.col("q")[1] + half)
    far = F.abs(F.col("len") - F.col("q")[1])
    out = ((F.col("len") < F.col("low")) | (F.col("len") > F.col("high"))) & (far >= min_difference) & (far >= min_ratio * F.col("q")[1])
    return joined.groupBy(F.col("feature").alias("column")).agg(F.first("low").alias("low"), F.first("high").alias("high"), F.sum(F.when(out, F.col("n")).otherwise(0)).alias("n_outliers"))


def iqr_outliers(df: DataFrame, columns: list[str], percentiles: tuple[float, float] = (25, 75), scale: float = 1.5) -> DataFrame:
    """(feature, low, high, n_outliers, ratio) of numeric columns."""
    cells = F.array(*(F.struct(F.lit(c).alias("feature"), F.col(f"`{c}`").cast("double").alias("v")) for c in columns))
    counts = df.select(F.inline(cells)).where(F.col("v").isNotNull()).groupBy("feature", "v").agg(F.count("*").alias("n"))
    # NaN, the largest value, is in the index but in no quantile: it counts as an outlier.
    ran = running.running_sums(counts.withColumn("own", F.when(F.isnan("v"), F.lit(0)).otherwise(F.col("n"))), ["feature"], "v", {"upto": "own"}, totals=True)
    fences = kernels.fences_of(ran.where(~F.isnan("v")), percentiles, scale)
    out = F.sum(F.when((F.col("v") < F.col("low")) | (F.col("v") > F.col("high")), F.col("n")).otherwise(0))
    return ran.join(F.broadcast(fences), "feature").groupBy("feature").agg(F.first("low").alias("low"), F.first("high").alias("high"), out.alias("n_outliers"), (out / F.sum("n")).alias("ratio"))


def nearest_neighbours(df: DataFrame, queries: DataFrame, id_column: str, numeric: list[str], categorical: list[str], k: int) -> DataFrame:
    """(id, neighbour, distance, place): the ``k`` nearest rows of ``df`` by Gower distance for each row of ``queries``, see :mod:`.neighbours`."""
    return gower_neighbours(df, queries, id_column, numeric, categorical, k)


def all_neighbours(df: DataFrame, id_column: str, numeric: list[str], categorical: list[str], k: int, block: int = BLOCK) -> DataFrame:
    """(id, neighbour, distance): what :func:`nearest_neighbours` gives for every row of ``df`` as query, rows without an id left out."""
    return gower_neighbours(df, None, id_column, numeric, categorical, k, block).drop("place")


def outlier_samples(df: DataFrame, queries: DataFrame, id_column: str, numeric: list[str], categorical: list[str], k: int | None = None, extent: float = 3.0) -> DataFrame:
    """(id, mean_distance, score): local outlier probability of the query rows among all rows of ``df``, which holds them.

    The density of a row is the root mean square distance to its k nearest
    rows of ``df``, times ``extent``; the score compares it with its
    neighbours' density, and with what is usual for all rows. Without ``k`` it
    is a hundredth of the rows, 5 at least. Every row's neighbours are needed
    for that, so the work is the same for few queries as for all. Rows on few
    lines (see :mod:`.lines`) need no row per pair; others are quadratic if k
    grows with the rows.
    """
    if k is None:
        k = max(df.where(F.col(id_column).isNotNull()).count() // 100, 5)
    dense = line_density(df, id_column, numeric, categorical, k, extent)
    if dense is None:
        near = kept(all_neighbours(df, id_column, numeric, categorical, k))  # read three times below
        spread = near.groupBy("id").agg((extent * F.sqrt(F.avg(F.col("distance") * F.col("distance")))).alias("pd"), F.avg("distance").alias("mean_distance"))
        around = near.join(spread.select(F.col("id").alias("neighbour"), F.col("pd").alias("npd")), "neighbour").groupBy("id").agg(F.avg("npd").alias("epd"))
        dense = spread.join(around, "id")
    plof = kept(dense).withColumn("plof", F.when(F.col("epd") > 0, F.col("pd") / F.col("epd") - 1).when(F.col("pd") == 0, F.lit(0.0)))  # read twice below
    scale = plof.agg((extent * F.sqrt(F.avg(F.col("plof") * F.col("plof")))).alias("nplof"))
    x = F.col("plof") / (F.col("nplof") * F.sqrt(F.lit(2.0)))
    # Abramowitz and Stegun's approximation 7.1.26 of the error function, good to 1.5e-7.
    t = 1 / (1 + 0.3275911 * F.abs(x))
    erf = 1 - ((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t * F.exp(-x * x)
    # Among neighbours that are all copies, a row that is none has no finite factor: it is an outlier.
    score = F.when(F.col("plof").isNull(), F.lit(1.0)).when((F.col("nplof") > 0) & (x > 0), erf).otherwise(F.lit(0.0))
    asked = queries.select(F.col(id_column).alias("id")).distinct()
    return plof.crossJoin(F.broadcast(scale)).select("id", "mean_distance", score.alias("score")).join(asked, "id", "left_semi")
