"""What columns are: kinds, categories, tasks, schemas; and validation of inputs.

A column's kind is decided from one aggregate over the table for all columns.
"""

from __future__ import annotations

from collections.abc import Hashable, Iterable, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.strings import is_number

#: Most distinct values of a category, by kind of column; a category's share of distinct values stays under ``RATIO``.
MOST = {"string": 150, "int": 30, "float": 5, "time": 5, "other": 30}
RATIO, LEAST_ROWS = 0.01, 1000

INTEGERS = ("tinyint", "smallint", "int", "bigint")


@dataclass(frozen=True)
class ColumnProfile:
    """Counts of one column: non-null rows, distinct values, and what they look like."""

    name: str
    dtype: str
    rows: int
    distinct: int
    whole: bool
    numeric_text: bool

    @property
    def kind(self) -> str:
        """int, float, time, string or other; strings that all read as numbers are numbers."""
        if self.dtype in INTEGERS:
            return "int"
        if self.dtype in ("float", "double") or self.dtype.startswith("decimal"):
            return "float"
        if self.dtype in ("date", "timestamp", "timestamp_ntz"):
            return "time"
        if self.dtype == "string":
            return ("int" if self.whole else "float") if self.numeric_text and self.rows else "string"
        return "other"

    def categorical(self, ratio: float = RATIO, most: dict[str, int] | None = None) -> bool:
        """Few values, and few in proportion to the rows (of at least ``LEAST_ROWS``). Floats that are whole count as integers."""
        most = {**MOST, **(most or {})}
        if self.dtype == "boolean":
            return True
        kind = "string" if self.dtype == "string" else self.kind
        limit = most["int"] if kind == "float" and self.whole else most[kind]
        return self.distinct / max(self.rows, LEAST_ROWS) < ratio and self.distinct <= limit


def column_profiles(df: DataFrame, columns: list[str] | None = None) -> dict[str, ColumnProfile]:
    """The profile of each column, from one pass."""
    kinds = {c: t for c, t in df.dtypes if columns is None or c in columns}
    known = {c: t for c, t in kinds.items() if not t.startswith(("array", "map", "struct", "binary", "variant"))}
    aggs = []
    for i, (c, t) in enumerate(known.items()):
        column = F.col(f"`{c}`")
        value = F.nanvl(column, F.lit(None).cast(t)) if t in ("float", "double") else column
        number = value.try_cast("double")
        whole = F.min(number % 1 == 0) if t in (*INTEGERS, "float", "double", "string") or t.startswith("decimal") else F.lit(False)
        aggs += [F.count(value).alias(f"n{i}"), F.count_distinct(value).alias(f"d{i}"), F.coalesce(whole, F.lit(False)).alias(f"w{i}"), F.coalesce(F.min(is_number(value)) if t == "string" else F.lit(False), F.lit(False)).alias(f"s{i}")]
    row = df.agg(*aggs).first() if aggs else None
    found = {c: ColumnProfile(c, t, row[f"n{i}"], row[f"d{i}"], bool(row[f"w{i}"]), bool(row[f"s{i}"])) for i, (c, t) in enumerate(known.items())}
    return {c: found.get(c) or ColumnProfile(c, t, 0, 0, False, False) for c, t in kinds.items()}


def column_kind(df: DataFrame, column: str) -> str:
    """int, float, time, string or other."""
    return column_profiles(df, [column])[column].kind


def is_categorical(df: DataFrame, column: str, ratio: float = RATIO, most: dict[str, int] | None = None) -> bool:
    return column_profiles(df, [column])[column].categorical(ratio, most)


def categorical_features(df: DataFrame, columns: list[str] | None = None, ratio: float = RATIO, most: int | None = None) -> list[str]:
    """The columns that hold categories. ``most`` limits the distinct values of all kinds."""
    limits = dict.fromkeys(MOST, most) if most is not None else None
    nested = ("array", "map", "struct", "binary")
    return [c for c, p in column_profiles(df, columns).items() if not p.dtype.startswith(nested) and p.rows and p.categorical(ratio, limits)]


def numerical_features(df: DataFrame, columns: list[str] | None = None, categorical: Iterable[str] = ()) -> list[str]:
    """Columns that read as numbers and are no categories."""
    return [c for c, p in column_profiles(df, columns).items() if c not in set(categorical) and p.kind in ("int", "float")]


def task_of_classes(n: int) -> str:
    """binary or multiclass, by the number of classes."""
    if n < 2:
        raise ValueError(f"a classification has at least two classes, not {n}")
    return "binary" if n == 2 else "multiclass"


def infer_task(df: DataFrame, label: str, ratio: float = 0.05) -> str:
    """binary, multiclass or regression, by the label's values."""
    p = column_profiles(df, [label])[label]
    if p.dtype in ("string", "boolean") or p.categorical(ratio):
        return "binary" if p.distinct <= 2 else "multiclass"
    return "regression"


def all_labels(*columns: tuple[DataFrame, str]) -> list[str]:
    """The distinct values, as sorted strings, of (table, column) pairs: labels and predictions of both sides."""
    out = None
    for df, column in columns:
        rows = df.where(F.col(column).isNotNull()).select(F.col(column).cast("string").alias("label")).distinct()
        out = rows if out is None else out.union(rows)
    return [r.label for r in out.distinct().orderBy("label").collect()]  # a row per class


def observed_and_model_classes(train: DataFrame, test: DataFrame | None, label: str, prediction: str | None = None, kind: str = "text", names: list[str] | None = None) -> tuple[list[str], list[str]]:
    """The classes that are seen in labels and predictions, and those of the model.

    ``kind`` is text (one label a row), multilabel (arrays of 0 and 1, named by
    ``names``) or token (arrays of IOB tags: the entities, without O).
    """
    columns = [label, *([prediction] if prediction else [])]
    seen: set[str] = set()
    for df in filter(None, (train, test)):
        for c in columns:
            if kind == "text":
                seen.update(all_labels((df, c)))
            elif kind == "token":
                tags = df.select(F.explode(c).alias("t")).where("t != 'O'").select(F.regexp_replace("t", "^[BIO]-", "").alias("t"))
                seen.update(r.t for r in tags.distinct().collect())  # a row per entity
            else:
                places = df.select(F.posexplode(c).alias("k", "v")).where("v > 0").select("k").distinct()
                seen.update(names[r.k] if names else str(r.k) for r in places.collect())  # a row per class
    observed = sorted(seen)
    return observed, sorted(set(names or []) | seen)


def compare_schemas(a: DataFrame, b: DataFrame, a_categorical: Iterable[str] = (), b_categorical: Iterable[str] = ()) -> dict[str, list[str]]:
    """Columns that only one table has, that differ in type, or that only one side takes for categories."""
    x, y = dict(a.dtypes), dict(b.dtypes)
    both = [c for c in x if c in y]
    kinds_x, kinds_y = set(a_categorical), set(b_categorical)
    return {"only_first": [c for c in x if c not in y], "only_second": [c for c in y if c not in x], "types": [c for c in both if x[c] != y[c]], "categories": [c for c in both if (c in kinds_x) != (c in kinds_y)]}


def split_columns(table: DataFrame, expected_rows: int | None = None, categorical: Iterable[str] | None = None) -> tuple[list[str], list[str]]:
    """The categorical and numerical columns of a table of metadata or properties, whose rows must be as many as expected."""
    if expected_rows is not None and (n := table.count()) != expected_rows:
        raise ValueError(f"the table has {n} rows, not {expected_rows}")
    missing = set(categorical or ()) - set(table.columns)
    if missing:
        raise ValueError(f"no such columns: {sorted(missing)}")
    chosen = list(categorical) if categorical is not None else categorical_features(table)
    return chosen, numerical_features(table, categorical=chosen)


# --- validation --------------------------------------------------------------


def check_raw_text(df: DataFrame, column: str) -> None:
    """A column of texts is a string column."""
    if dict(df.dtypes).get(column) != "string":
        raise TypeError(f"{column} must be a string column")


def check_tokens(df: DataFrame, column: str) -> None:
    if dict(df.dtypes).get(column) != "array<string>":
        raise TypeError(f"{column} must be an array of strings")


def check_importance(importance: dict[str, float], features: list[str], tolerance: float = 0.001) -> dict[str, float]:
    """Importances of exactly the features, none negative or missing, that add up to 1."""
    if set(importance) != set(features):
        raise ValueError("importances and features are not the same")
    if any(v is None or v != v or v < 0 for v in importance.values()):
        raise ValueError("importances must be numbers of 0 or more")
    total = sum(importance.values())
    if not total:
        raise ValueError("importances are all 0")
    return importance if abs(total - 1) <= tolerance else {f: v / total for f, v in importance.items()}


def _none(df: DataFrame, bad, what: str) -> None:
    if df.where(bad).limit(1).count():
        raise ValueError(what)


def check_probabilities(df: DataFrame, column: str, n_classes: int, tolerance: float = 1e-3) -> None:
    """Arrays of one probability per class that add up to 1."""
    p = F.col(column)
    total = F.aggregate(p, F.lit(0.0), lambda a, x: a + x.cast("double"))
    _none(df, p.isNotNull() & ((F.size(p) != n_classes) | (F.abs(total - 1) > tolerance) | F.exists(p, lambda x: x < 0)), f"{column} must hold {n_classes} probabilities that add up to 1")


def check_images(df: DataFrame, pixels: str = "pixels", height: str = "height", width: str = "width", channels: str = "channels") -> None:
    """Flat images of height x width x channels values between 0 and 255, of one or three channels."""
    p = F.col(pixels)
    bad = (F.size(p) != F.col(height) * F.col(width) * F.col(channels)) | ~F.col(channels).isin(1, 3) | F.exists(p, lambda x: (x < 0) | (x > 255))
    _none(df, p.isNotNull() & bad, "images must be height x width x (1 or 3) values from 0 to 255")


def check_labels(df: DataFrame, label: str, task: str) -> None:
    """classification: one class; detection: boxes of class, x, y, w, h; segmentation: a flat mask of classes."""
    kind = df.schema[label].dataType
    if task == "classification":
        if kind.simpleString().startswith(("array", "struct", "map")):
            raise TypeError("a class label is one value")
    elif task == "detection":
        names = {f.name for f in getattr(getattr(kind, "elementType", None), "fields", [])}
        if not {"cls", "x", "y", "w", "h"} <= names:
            raise TypeError("box labels are arrays of structs with cls, x, y, w and h")
        _none(df, F.exists(label, lambda b: (b["w"] < 0) | (b["h"] < 0)), "boxes have no negative sides")
    elif task == "segmentation":
        if kind.simpleString() not in ("array<int>", "array<bigint>", "array<smallint>", "array<tinyint>"):
            raise TypeError("a mask is an array of class numbers")
    else:
        raise ValueError(f"no such task: {task}")


def check_predictions(df: DataFrame, prediction: str, task: str, n_classes: int | None = None) -> None:
    """classification: probabilities that add up to 1; detection: boxes with conf as well; segmentation: a mask."""
    if task == "classification":
        n = n_classes or (df.select(F.max(F.size(prediction))).first()[0] or 0)
        check_probabilities(df, prediction, n)
    elif task == "detection":
        check_labels(df, prediction, task)
        if "conf" not in {f.name for f in df.schema[prediction].dataType.elementType.fields}:
            raise TypeError("predicted boxes have conf, their confidence")
    else:
        check_labels(df, prediction, task)


def check_same_task(a: str, b: str) -> None:
    if a != b:
        raise ValueError(f"the tasks differ: {a} and {b}")


def as_list(value: Any, message: str = "expected a hashable value or a list of them, not {kind}") -> list:
    """A value, or a list of values, as a list."""
    if is_sequence(value):
        if all(isinstance(v, Hashable) for v in value):
            return list(value)
    elif isinstance(value, Hashable):
        return [value]
    raise ValueError(message.format(kind=type(value).__name__))


def is_sequence(value: Any) -> bool:
    """Whether a value is a sequence, but no string."""
    return isinstance(value, Sequence) and not isinstance(value, (str, bytes, bytearray))
