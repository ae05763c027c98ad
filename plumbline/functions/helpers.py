"""Small driver-side helpers: dictionaries, numbers, calls and configurations."""

from __future__ import annotations

import inspect
import math
from collections.abc import Callable, Hashable, Iterable
from importlib import import_module
from typing import Any

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def entry_by_value(values: dict, choose: Callable = max) -> tuple:
    """The (key, value) whose value ``choose`` picks, the first of equal ones."""
    best = choose(values.values())
    return next((k, v) for k, v in values.items() if v == best)


def sort_by_value(values: dict, reverse: bool = True) -> dict:
    return dict(sorted(values.items(), key=lambda x: x[1], reverse=reverse))


def ordinals(values: Iterable[Hashable]) -> dict:
    """value -> its number by first appearance."""
    return {v: i for i, v in enumerate(dict.fromkeys(values))}


def round_significant(x: float, digits: int = 2) -> float:
    return x if x == 0 or not math.isfinite(x) else round(x, digits - 1 - math.floor(math.log10(abs(x))))


def plain(value: Any) -> Any:
    """numpy numbers and arrays, also inside lists and dictionaries, as Python's own."""
    if isinstance(value, np.generic):
        return plain(value.item())
    if isinstance(value, np.ndarray):
        return [plain(v) for v in value.tolist()]
    if isinstance(value, dict):
        return {plain(k): plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    return value


def call_with_known(function: Callable, **given) -> Any:
    """``function`` with those of the arguments that it takes."""
    return function(**{k: v for k, v in given.items() if k in inspect.signature(function).parameters})


def constructor_values(thing: Any, defaults: bool = False) -> dict:
    """The parameters a thing was made with, as far as it keeps them under their names; without ``defaults`` those that differ."""
    out = {}
    for name, p in inspect.signature(type(thing).__init__).parameters.items():
        if name != "self" and p.kind not in (p.VAR_KEYWORD, p.VAR_POSITIONAL) and hasattr(thing, name):
            value = getattr(thing, name)
            if defaults or p.default is p.empty or value != p.default:
                out[name] = value
    return out


def check_config(config: dict, version: str | None = None, mismatch: str = "warn") -> dict:
    """A check's configuration: it names a module and class that exist; other versions warn, raise or pass."""
    import warnings

    if not {"module_name", "class_name"} <= config.keys():
        raise ValueError("a configuration names module_name and class_name")
    if version and config.get("version") not in (None, version):
        said = f"the configuration is of version {config['version']}, this is {version}"
        if mismatch == "raise":
            raise ValueError(said)
        if mismatch == "warn":
            warnings.warn(said, stacklevel=2)
    if not hasattr(import_module(config["module_name"]), config["class_name"]):
        raise ValueError(f"{config['module_name']} has no {config['class_name']}")
    return config


def last_stage(model: Any) -> Any:
    """The model at the end of a pipeline, or the model itself."""
    stages = getattr(model, "stages", None)
    return last_stage(stages[-1]) if stages else model


def floats(df: DataFrame) -> DataFrame:
    """Integer columns as doubles."""
    whole = ("tinyint", "smallint", "int", "bigint")
    return df.select(*(F.col(f"`{c}`").cast("double").alias(c) if t in whole else F.col(f"`{c}`") for c, t in df.dtypes))


def fill_nulls(df: DataFrame, categorical: Iterable[str] = (), word: str = "None") -> DataFrame:
    """Categories without a value get a word, numbers their column's mean."""
    categorical = set(categorical)
    numbers = [c for c, t in df.dtypes if c not in categorical and (t in ("tinyint", "smallint", "int", "bigint", "float", "double") or t.startswith("decimal"))]
    means = df.agg(*(F.avg(F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None).cast("double"))).alias(c) for c in numbers)).first().asDict() if numbers else {}
    out = []
    for c, t in df.dtypes:
        column = F.col(f"`{c}`")
        if c in categorical:
            out.append(F.coalesce(column.cast("string"), F.lit(word)).alias(c))
        elif c in numbers:
            out.append(F.coalesce(F.nanvl(column.cast("double"), F.lit(None).cast("double")), F.lit(means[c])).alias(c))
        else:
            out.append(column)
    return df.select(*out)


def density(df: DataFrame, column: str, at: list[float], bins: int = 200) -> list[float]:
    """A Gaussian kernel density at given points, from a histogram of ``bins`` (one pass), with Scott's bandwidth."""
    c = F.col(column).cast("double")
    row = df.where(c.isNotNull()).agg(F.min(c).alias("a"), F.max(c).alias("b"), F.stddev_samp(c).alias("s"), F.count(c).alias("n")).first()
    if not row.n:
        return [0.0] * len(at)
    if row.a == row.b or not row.s:
        return [1.0 if x == row.a else 0.0 for x in at]
    width = (row.b - row.a) / bins
    place = F.least(F.floor((c - row.a) / width), F.lit(bins - 1))
    counts = {r.k: r.n for r in df.where(c.isNotNull()).groupBy(place.alias("k")).agg(F.count("*").alias("n")).collect()}  # a row per bin
    h = row.s * row.n ** (-1 / 5)
    centres = np.array([row.a + (k + 0.5) * width for k in counts])
    weights = np.array(list(counts.values()), float) / row.n
    return [float((weights * np.exp(-0.5 * ((x - centres) / h) ** 2)).sum() / (h * math.sqrt(2 * math.pi))) for x in at]


def top_by_importance(df: DataFrame, column: str, importance: dict[str, float], n: int = 10) -> DataFrame:
    """The rows of the ``n`` most important features (a top-k report); the other way round the importance is not known."""
    return df.join(F.broadcast(df.sparkSession.createDataFrame(sorted(importance.items(), key=lambda x: (-x[1], x[0]))[:n], f"`{column}` string, importance double")), column).orderBy(F.desc("importance"), column)


def top_of_dict(values: dict, importance: dict[str, float] | None = None, n: int = 10) -> dict:
    """The entries of the ``n`` most important features; a key can be a tuple that begins with the feature."""
    name = lambda k: k[0] if isinstance(k, tuple) else k
    keys = sorted(values, key=lambda k: -(importance or {}).get(name(k), 0.0)) if importance else list(values)
    return {k: values[k] for k in keys[:n]}


def nearest_rank(values: list[float], q: float, how: str = "nearest") -> float:
    """The q-quantile as one of the sorted ``values``: the nearest rank (halves to the even one) or the higher."""
    at = q * (len(values) - 1)
    return values[math.ceil(at) if how == "higher" else round(at)]


def row_quantile(df: DataFrame, column: str, q: float, how: str = "nearest") -> DataFrame:
    """(value): the q-quantile of a column as one of its values, by rank over distinct values, without a sort in one task."""
    from .running import running_sums

    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("v")).agg(F.count("*").alias("n"))
    ran = running_sums(counts, [], "v", {"upto": "n"}, totals=True)
    at = F.lit(q) * (F.col("upto_n") - 1)
    rank = F.ceil(at) if how == "higher" else F.bround(at)
    return ran.where(F.col("upto") > rank).agg(F.min("v").alias("value"))


def first_per(df: DataFrame, label: str, order: list[str]) -> DataFrame:
    """One row of each label: the first in the given order."""
    names = df.columns
    row = F.struct(*order, F.struct(*names).alias("__row"))
    return df.groupBy(F.col(label).alias("__l")).agg(F.min(row).alias("r")).select("r.__row.*")


def group_numbers(df: DataFrame, group: str, order: str) -> DataFrame:
    """(group, number): groups numbered by their first row in the given order; the groups are few, or a report of some."""
    from pyspark.sql import Window

    firsts = df.groupBy(group).agg(F.min(order).alias("first"))
    return firsts.select(group, (F.row_number().over(Window.orderBy("first", group)) - 1).alias("number"))


def rows_of_groups(df: DataFrame, key: list[str], least: int = 2) -> DataFrame:
    """The rows whose key at least ``least`` rows have."""
    groups = df.groupBy(*key).agg(F.count("*").alias("__n")).where(F.col("__n") >= least).drop("__n")
    on = [df[k].eqNullSafe(groups[k]) for k in key]
    condition = on[0]
    for c in on[1:]:
        condition = condition & c
    return df.join(groups, condition, "left_semi")
