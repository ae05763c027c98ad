"""Scorers: named metrics, those of users, defaults by task, and what a result says in one number."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import evaluation

#: Metrics that are read by default, and those of single classes.
DEFAULTS = {
    "binary": ["accuracy", "precision", "recall"],
    "multiclass": ["accuracy", "precision_macro", "recall_macro"],
    "regression": ["neg_rmse", "neg_mae", "r2"],
    "token": ["token_f1_macro", "token_precision_macro", "token_recall_macro"],
    "detection": ["average_precision", "average_recall"],
}
PER_CLASS = {"binary": ["f1", "precision", "recall"], "multiclass": ["f1", "precision", "recall"], "token": ["f1", "precision", "recall"], "detection": ["average_precision", "average_recall"]}


@dataclass(frozen=True)
class Scorer:
    """A named score: ``function(df, label, prediction)`` gives a number, or {class: number}; more is better unless said."""

    name: str
    function: Callable[[DataFrame, str, str], float | dict[str, float]]
    greater_is_better: bool = True
    per_class: bool = False

    def __call__(self, df: DataFrame, label: str, prediction: str) -> float | dict[str, float]:
        """Of the rows that have a label and a prediction."""
        rows = df.where(F.col(label).isNotNull() & F.col(prediction).isNotNull())
        found = self.function(rows, label, prediction)
        if self.per_class != isinstance(found, dict):
            raise TypeError(f"{self.name} must give {'a dict by class' if self.per_class else 'a number'}")
        return {str(k): _number(v) for k, v in found.items()} if isinstance(found, dict) else _number(found)


def _number(value) -> float:
    if value is None:
        return float("nan")
    return float(value)


def _averaged(metric: str, sign: int, family) -> Callable:
    return lambda df, label, prediction: None if (v := family(df, label, prediction).first()[metric]) is None else sign * v


def _by_class(metric: str) -> Callable:
    return lambda df, label, prediction: {r["class"]: r[metric] for r in evaluation.class_metrics(df, label, prediction).collect()}  # a row per class


def _positive(metric: str) -> Callable:
    """Of a binary task's positive class, the larger one in the order of text."""

    def score(df: DataFrame, label: str, prediction: str) -> float:
        rows = {r["class"]: r[metric] for r in evaluation.class_metrics(df, label, prediction).collect()}
        return rows[max(rows)] if rows else float("nan")

    return score


def scorer(name: str, per_class: bool = False) -> Scorer:
    """A scorer by name: a metric of ``evaluation.METRICS``, ``neg_`` before one where less is better, or with ``_per_class``."""
    if name.endswith("_per_class"):
        return scorer(name.removesuffix("_per_class"), True)
    negative = name.startswith("neg_")
    metric = name.removeprefix("neg_")
    if metric not in evaluation.METRICS:
        raise ValueError(f"unknown scorer {name}; known: {', '.join(sorted(evaluation.METRICS))}")
    family, better = evaluation.METRICS[metric]
    if family is evaluation.class_metrics:
        return Scorer(name, _by_class(metric) if per_class else _positive(metric), better, per_class)
    return Scorer(name, _averaged(metric, -1 if negative else 1, family), better or negative)


def scorers(given: list | dict | None = None, task: str = "multiclass", per_class: bool = False) -> list[Scorer]:
    """Scorers from names, functions of (df, label, prediction) and scorers; without any, the task's defaults."""
    if given is None:
        return default_scorers(task, per_class)
    if not given:
        raise ValueError("no scorers given")
    pairs = given.items() if isinstance(given, dict) else [(getattr(g, "name", g if isinstance(g, str) else getattr(g, "__name__", "score")), g) for g in given]
    out = []
    for name, g in pairs:
        if isinstance(g, Scorer):
            out.append(Scorer(name, g.function, g.greater_is_better, g.per_class))
        elif isinstance(g, str):
            s = scorer(g, per_class and g in PER_CLASS["multiclass"])
            out.append(Scorer(name, s.function, s.greater_is_better, s.per_class))
        elif callable(g):
            out.append(Scorer(name, g, per_class=per_class))
        else:
            raise TypeError(f"{name} is neither a name, a function nor a scorer")
    return out


def default_scorers(task: str, per_class: bool = False) -> list[Scorer]:
    if per_class and task in ("binary", "multiclass"):
        return [scorer(m, True) for m in PER_CLASS[task]]
    return [scorer(m) for m in DEFAULTS[task]]


def is_class_wise(s: Scorer) -> bool:
    return s.per_class


def performance(df: DataFrame, label: str, prediction: str, given: list | dict | None = None, task: str = "multiclass", per_class: bool = False) -> DataFrame:
    """(metric, class, value) of each scorer."""
    rows = []
    for s in scorers(given, task, per_class):
        found = s(df, label, prediction)
        rows += [(s.name, c, v) for c, v in found.items()] if isinstance(found, dict) else [(s.name, None, found)]
    return df.sparkSession.createDataFrame(rows, "metric string, class string, value double")


def train_test_performance(train: DataFrame, test: DataFrame, label: str, prediction: str, **options) -> DataFrame:
    """(dataset, metric, class, value) of both sides."""
    sides = [performance(df, label, prediction, **options).select(F.lit(n).alias("dataset"), "*") for n, df in (("train", train), ("test", test))]
    return sides[0].unionByName(sides[1])


def models_performance(df: DataFrame, label: str, predictions: dict[str, str], **options) -> DataFrame:
    """(model, metric, class, value) of several prediction columns."""
    out = None
    for model, column in predictions.items():
        row = performance(df, label, column, **options).select(F.lit(model).alias("model"), "*")
        out = row if out is None else out.unionByName(row)
    return out


def average_scores(scores: dict[str, dict[str, float]], classes: list[str] | None = None) -> dict[str, float]:
    """Of each metric the mean over (some) classes."""
    out = {}
    for metric, by in scores.items():
        values = [v for c, v in by.items() if classes is None or c in classes]
        out[metric] = sum(values) / len(values) if values else float("nan")
    return out


def greater_is_better(given: list[Scorer]) -> bool:
    """Whether more of a reduced value is better: all scorers must say the same."""
    said = {s.greater_is_better for s in given}
    if len(said) > 1:
        raise ValueError("scorers of both directions can't be reduced to one number")
    return said != {False}


def best_cutoff(df: DataFrame, label: str, score: str, positive: str) -> DataFrame:
    """(threshold, tpr, fpr): the score at which the true positive rate exceeds the false positive rate most."""
    from ..functions.running import running_sums

    y = (F.col(label).cast("string") == positive).cast("long")
    counts = df.where(F.col(label).isNotNull() & F.col(score).isNotNull()).groupBy((-F.col(score).cast("double")).alias("down")).agg(F.count("*").alias("n"), F.sum(y).alias("p"))
    ran = running_sums(counts, [], "down", {"seen": "n", "hit": "p"})
    total = counts.agg(F.sum("p").alias("t"), (F.sum("n") - F.sum("p")).alias("f"))
    points = ran.crossJoin(F.broadcast(total)).select((-F.col("down")).alias("threshold"), F.try_divide("hit", "t").alias("tpr"), F.try_divide(F.col("seen") - F.col("hit"), F.col("f")).alias("fpr"))
    best = points.agg(F.max_by(F.struct("threshold", "tpr", "fpr"), F.struct(F.col("tpr") - F.col("fpr"), "threshold")).alias("b"))
    return best.select("b.*")


def one_vs_rest_power(df: DataFrame, features: list[str], label: str, **options) -> DataFrame:
    """(class, feature, score): how well each feature tells each class from the others."""
    from .models import predictive_power

    out = None
    for c in [r[0] for r in df.where(F.col(label).isNotNull()).select(F.col(label).cast("string")).distinct().orderBy(label).collect()]:  # a row per class
        own = df.where(F.col(label).isNotNull()).withColumn("__is", (F.col(label).cast("string") == c).cast("string"))
        row = predictive_power(own, features, "__is", **options).select(F.lit(c).alias("class"), "*")
        out = row if out is None else out.unionByName(row)
    return out


# --- reduced results ---------------------------------------------------------


def reduce_performance(rows: list[dict]) -> dict[str, float]:
    """{metric} or {metric of a class: value}."""
    return {r["metric"] if r.get("class") is None else f"{r['metric']} of {r['class']}": r["value"] for r in rows}


def reduce_drift(rows: list[dict], how: str = "max", sizes: dict[str, int] | None = None) -> dict[str, float]:
    """Drift of several classes: each, their maximum or mean, or the mean weighted by the classes' sizes."""
    values = {str(next(iter(r.values()))): r["score"] for r in rows if r["score"] is not None}
    if how == "none":
        return values
    if not values:
        return {}
    if how == "weighted":
        total = sum((sizes or {}).get(c, 1) for c in values)
        return {"weighted": sum(v * (sizes or {}).get(c, 1) for c, v in values.items()) / total}
    return {"max": max(values.values())} if how == "max" else {"mean": sum(values.values()) / len(values)}


def reduce_mixed_nulls(rows: list[dict]) -> dict[str, int]:
    """How many columns have more than one kind of null: rows are (column, kind, ...)."""
    kinds: dict[str, int] = {}
    for r in rows:
        kinds[r["column"]] = kinds.get(r["column"], 0) + 1
    return {"columns with several kinds of null": sum(n > 1 for n in kinds.values())}


def reduce_string_mismatch(rows: list[dict], total: int) -> dict[str, float]:
    """The share of rows whose string is one of several variants: rows are (column, base, variant, n)."""
    by: dict[str, int] = {}
    for r in rows:
        by[r["column"]] = by.get(r["column"], 0) + r["n"]
    return {c: n / total for c, n in by.items()} if total else {}


def reduce_new_values(rows: list[dict], total: int, column: str = "feature") -> dict[str, float]:
    """Of each column the share of test rows with new values."""
    by: dict[str, int] = {}
    for r in rows:
        by[r.get(column, "label")] = by.get(r.get(column, "label"), 0) + r["n"]
    return {c: n / total for c, n in by.items()} if total else {}
