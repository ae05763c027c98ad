"""Checks that compare a train table with a test table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import kept
from . import kernels
from .integrity import string_counts
from ..functions.strings import base_form_or_text


def datasets_size(train: DataFrame, test: DataFrame) -> DataFrame:
    """(n_train, n_test)."""
    return train.agg(F.count("*").alias("n_train")).crossJoin(test.agg(F.count("*").alias("n_test")))


def new_categories(train: DataFrame, test: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, category, n, ratio): categories of test that train lacks, and their share of all test rows; nulls left out."""
    counts = kernels.value_counts(kernels.tag(train, test, columns, "string").where(F.col("v").isNotNull()))
    n = test.agg(F.count("*").alias("t"))
    return counts.where("a = 0").crossJoin(F.broadcast(n)).select("feature", F.col("v").alias("category"), F.col("b").alias("n"), (F.col("b") / F.col("t")).alias("ratio"))


def new_labels(train: DataFrame, test: DataFrame, label: str) -> DataFrame:
    """(label, n, ratio): labels of test that train lacks; a null that only test has is one."""
    counts = kernels.value_counts(kernels.tag(train, test, [label], "string"))
    n = test.agg(F.count("*").alias("t"))
    return counts.where("a = 0").crossJoin(F.broadcast(n)).select(F.col("v").alias("label"), F.col("b").alias("n"), (F.col("b") / F.col("t")).alias("ratio"))


def string_mismatch_comparison(train: DataFrame, test: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, base, variant, place, n_train, n_test): variants of base forms that both tables have, where the tables' variants differ.

    ``place`` is train, test or both.
    """
    both = string_counts(train, columns).select("feature", "v", F.col("n").alias("a"), F.lit(0).cast("long").alias("b")).unionByName(string_counts(test, columns).select("feature", "v", F.lit(0).cast("long").alias("a"), F.col("n").alias("b")))
    counts = both.groupBy("feature", "v").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).withColumn("base", base_form_or_text(F.col("v")))
    bases = counts.groupBy("feature", "base").agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"), F.max(((F.col("a") == 0) | (F.col("b") == 0)).cast("int")).alias("differ"))
    bases = bases.where("ta > 0 AND tb > 0 AND differ = 1").select("feature", "base")
    place = F.when(F.col("b") == 0, "train").when(F.col("a") == 0, "test").otherwise("both")
    return counts.join(bases, ["feature", "base"]).select(F.col("feature").alias("column"), "base", F.col("v").alias("variant"), place.alias("place"), F.col("a").alias("n_train"), F.col("b").alias("n_test"))


def date_leakage_duplicates(train: DataFrame, test: DataFrame, datetime: str) -> DataFrame:
    """(ratio): share of test rows whose time some train row has."""
    counts = kernels.value_counts(kernels.tag(train, test, [datetime], "timestamp"))
    return counts.agg((F.sum(F.when((F.col("a") > 0) & F.col("v").isNotNull(), F.col("b")).otherwise(0)) / F.sum("b")).alias("ratio"))


def date_leakage_overlap(train: DataFrame, test: DataFrame, datetime: str) -> DataFrame:
    """(ratio): share of test rows before the last train time."""
    last = train.agg(F.max(datetime).alias("last"))
    return test.crossJoin(F.broadcast(last)).agg(F.avg(F.coalesce(F.col(datetime) < F.col("last"), F.lit(False)).cast("double")).alias("ratio"))


def index_leakage(train: DataFrame, test: DataFrame, index: str) -> DataFrame:
    """(ratio, n_common): distinct ids of both tables over the rows of test."""
    counts = kernels.value_counts(kernels.tag(train, test, [index], "string"))
    common = F.sum(((F.col("a") > 0) & (F.col("b") > 0) & F.col("v").isNotNull()).cast("long"))
    return counts.agg((common / F.sum("b")).alias("ratio"), common.alias("n_common"))


def samples_mix(train: DataFrame, test: DataFrame, columns: list[str]) -> DataFrame:
    """(ratio, n_common): test rows that train has as well, all ``columns`` equal, null like null. One shuffle of both tables."""
    both = train.select(*columns, F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(test.select(*columns, F.lit(0).alias("a"), F.lit(1).alias("b")))
    groups = both.groupBy(*columns).agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    common = F.sum(F.when(F.col("a") > 0, F.col("b")).otherwise(0))
    return groups.agg((common / F.sum("b")).alias("ratio"), common.alias("n_common"))


def feature_drift(train: DataFrame, test: DataFrame, numeric: list[str], categorical: list[str], numeric_method: str = "KS", categorical_method: str = "cramers_v", margin: float = 0.025, min_ratio: float = 0.01, max_categories: int | None = None, balance: bool = False) -> DataFrame:
    """(feature, method, score): how far each column's distribution moved from train to test."""
    out = None
    if numeric:
        rows = kernels.tag(train, test, numeric, "double")
        score = kernels.ks(rows) if numeric_method == "KS" else kernels.emd(rows, margin)
        out = score.select("feature", F.lit(numeric_method).alias("method"), "score")
    if categorical:
        counts = kernels.fold_rare(kept(kernels.value_counts(kernels.tag(train, test, categorical, "string").where(F.col("v").isNotNull()))), min_ratio, max_categories)
        score = kernels.psi(counts) if categorical_method == "PSI" else kernels.cramers_v(counts, balance)
        part = score.select("feature", F.lit(categorical_method).alias("method"), "score")
        out = part if out is None else out.unionByName(part)
    return out


def label_drift(train: DataFrame, test: DataFrame, label: str, numeric: bool = False, **parameters) -> DataFrame:
    return feature_drift(train, test, [label] if numeric else [], [] if numeric else [label], **parameters)


#: A prediction column drifts as a label does; probabilities as numbers.
prediction_drift = label_drift
