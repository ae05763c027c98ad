"""What users bring: models, metrics that gather state over batches, properties, and checks of models."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..core import Check, CheckResult, Condition


class FunctionModel:
    """Any model with ``predict`` (and ``predict_proba``) over pandas frames, as a transformer: batches run where the data lies.

    The model travels to the workers by pickle; ``classes`` are the names of
    the probabilities' columns.
    """

    def __init__(self, model: Any, features: list[str], kind: str = "string", classes: list[str] | None = None) -> None:
        self.model, self.features, self.kind, self.classes = model, features, kind, classes

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with prediction, and probabilities if the model gives them."""
        model, features, probable = self.model, self.features, hasattr(self.model, "predict_proba")
        schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name not in ("prediction", "probabilities")), f"prediction {self.kind}", *["probabilities array<double>"] * probable])
        plain = str if self.kind == "string" else (lambda v: v)

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                given = part[features]
                out = part.assign(prediction=[plain(v) for v in model.predict(given)])
                yield out.assign(probabilities=[[float(p) for p in row] for row in model.predict_proba(given)]) if probable else out

        return df.drop("prediction", "probabilities").mapInPandas(run, schema)

    def with_scores(self, df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
        """Predictions with a column per class probability, and their names by class, as the checks of curves take them."""
        out = self.transform(df)
        names = {c: f"p_{k}" for k, c in enumerate(self.classes or [])}
        return out.select("*", *(F.get("probabilities", F.lit(k)).alias(n) for k, n in enumerate(names.values()))), names


class BatchMetric:
    """A metric that gathers state over batches: ``update`` changes a state, ``merge`` joins two, ``compute`` ends."""

    def initial(self) -> Any:
        raise NotImplementedError

    def update(self, state: Any, batch: pd.DataFrame) -> Any:
        raise NotImplementedError

    def merge(self, a: Any, b: Any) -> Any:
        raise NotImplementedError

    def compute(self, state: Any) -> Any:
        return state


def run_batch_metric(df: DataFrame, metric: BatchMetric, columns: list[str] | None = None, fan_in: int = 64) -> Any:
    """The metric's value over all rows: states are made per partition and merged ``fan_in`` at a time until few are left for the driver."""
    rows = df.select(*columns) if columns else df

    def gather(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, seen = metric.initial(), False
        for part in parts:
            state, seen = metric.update(state, part), True
        if seen:
            yield pd.DataFrame({"state": [pickle.dumps(state)]})

    def join(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state = None
        for part in parts:
            for packed in part["state"]:
                other = pickle.loads(packed)
                state = other if state is None else metric.merge(state, other)
        if state is not None:
            yield pd.DataFrame({"state": [pickle.dumps(state)]})

    states = rows.mapInPandas(gather, "state binary")
    n = rows.rdd.getNumPartitions()
    while n > fan_in:
        n = -(-n // fan_in)
        states = states.repartition(n).mapInPandas(join, "state binary")
    state = metric.initial()
    for r in states.collect():  # at most ``fan_in`` states
        state = metric.merge(state, pickle.loads(r.state))
    return metric.compute(state)


def batch_property(function: Callable[[pd.DataFrame], list], name: str, kind: str = "double") -> Callable[[DataFrame], DataFrame]:
    """A property by a function of batches: adds a column; ``array<...>`` kinds can be flattened."""

    def add(df: DataFrame) -> DataFrame:
        schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name != name), f"`{name}` {kind}"])

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                yield part.assign(**{name: list(function(part))})

        return df.drop(name).mapInPandas(run, schema)

    return add


def predict_in_chunks(df: DataFrame, text: str, classifier: Callable[[list[str]], list[float]], name: str, chunk_words: int = 350, batch: int = 32) -> DataFrame:
    """``df`` with a text property by a classifier: long texts in chunks whose mean counts; a batch that fails is halved, and a text that fails alone has none."""

    def values(texts: list[str]) -> list[float | None]:
        try:
            return [float(v) for v in classifier(texts)]
        except Exception:  # noqa: BLE001  a classifier's own limits: tried again in halves
            if len(texts) == 1:
                return [None]
            half = len(texts) // 2
            return values(texts[:half]) + values(texts[half:])

    def score(part: pd.DataFrame) -> list[float | None]:
        chunks, owner = [], []
        for i, t in enumerate(part[text]):
            words = (t or "").split()
            for k in range(0, len(words), chunk_words):
                chunks.append(" ".join(words[k : k + chunk_words]))
                owner.append(i)
        found: dict[int, list[float]] = {}
        for k in range(0, len(chunks), batch):
            for i, v in zip(owner[k : k + batch], values(chunks[k : k + batch])):
                if v is not None:
                    found.setdefault(i, []).append(v)
        return [sum(found[i]) / len(found[i]) if i in found else None for i in range(len(part))]

    return batch_property(score, name)(df)


def model_check(name: str, function: Callable[[Any], list[dict]], *conditions: Condition) -> Callable[[Any], CheckResult]:
    """A check of a model alone: ``function(model)`` gives rows."""

    def run(model: Any) -> CheckResult:
        try:
            rows = function(model)
        except Exception as error:  # noqa: BLE001  a failed check is a result
            return CheckResult(name, error=f"{type(error).__name__}: {error}")
        return CheckResult(name, rows, [c.decide(rows) for c in conditions])

    return run


def comparison_check(name: str, function: Callable[..., DataFrame], *conditions: Condition) -> Check:
    """A check over several models: ``function(datasets by model)`` gives a table with a column ``model``."""
    return Check(name, function, tuple(conditions))


def to_wandb(result, project: str | None = None) -> None:
    """Send a result's rows and conditions to Weights & Biases, where its client is installed."""
    try:
        import wandb
    except ImportError as missing:
        raise ImportError("the wandb client is not installed") from missing
    own = wandb.run is None
    run = wandb.init(project=project) if own else wandb.run
    for r in getattr(result, "results", [result]):
        table = wandb.Table(columns=["condition", "category", "details"], data=[[c.name, c.category.value, c.details] for c in r.conditions])
        run.log({f"{r.name}/conditions": table, f"{r.name}/value": json_rows(r.rows)})
    if own:
        run.finish()


def json_rows(rows: list[dict]) -> str:
    import json

    return json.dumps(rows, default=str)
