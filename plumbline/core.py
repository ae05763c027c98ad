"""Datasets, results, conditions, checks and suites: the driver's side.

A check's value is a small DataFrame; conditions look at its collected rows
only. Suites run checks side by side, and one that fails does not stop others.
"""

from __future__ import annotations

import html
import json
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace
from enum import Enum
from typing import Any
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Dataset:
    """A table and the roles of its columns. Nothing is copied."""

    df: DataFrame
    label: str | None = None
    features: tuple[str, ...] | None = None
    cat_features: tuple[str, ...] | None = None
    index: str | None = None
    datetime: str | None = None
    name: str | None = None

    def __post_init__(self) -> None:
        names = self.df.columns
        if len(set(names)) < len(names):
            raise ValueError("the table has repeated column names")
        for column in (self.label, self.index, self.datetime, *(self.features or ()), *(self.cat_features or ())):
            if column is not None and column not in names:
                raise ValueError(f"column {column} is not in the table")
        roles = {self.label, self.index, self.datetime}
        if self.features is None:
            object.__setattr__(self, "features", tuple(c for c in names if c not in roles))
        if self.cat_features is None:
            kinds = dict(self.df.dtypes)
            object.__setattr__(self, "cat_features", tuple(c for c in self.features if kinds[c] in ("string", "boolean")))

    @property
    def numerical_features(self) -> list[str]:
        kinds = dict(self.df.dtypes)
        number = ("int", "bigint", "smallint", "tinyint", "double", "float")
        return [c for c in self.features if c not in self.cat_features and (kinds[c] in number or kinds[c].startswith("decimal"))]

    def select(self, columns: list[str] | None = None, ignore: list[str] | None = None) -> Dataset:
        """Only some features; columns that have a role stay."""
        if columns and ignore:
            raise ValueError("give columns or ignore, not both")
        kept = tuple(c for c in self.features if (not columns or c in columns) and c not in (ignore or ()))
        return replace(self, features=kept, cat_features=tuple(c for c in self.cat_features if c in kept))

    def with_df(self, df: DataFrame) -> Dataset:
        return replace(self, df=df)

    def drop_na_labels(self) -> Dataset:
        return self.with_df(self.df.where(F.col(self.label).isNotNull()))

    def sample(self, n: int, seed: int = 42) -> Dataset:
        """``n`` rows by hash order, the same ones every time."""
        return self.with_df(self.df.orderBy(F.xxhash64(F.lit(seed), *self.df.columns)).limit(n))

    def split(self, test_size: float = 0.25, seed: int = 42, by: list[str] | None = None) -> tuple[Dataset, Dataset]:
        """Train and test by the hash of a row (or of the columns ``by``)."""
        place = F.pmod(F.xxhash64(F.lit(seed), *(by or self.df.columns)), F.lit(1_000_000)) < int(test_size * 1_000_000)
        return self.with_df(self.df.where(~place)), self.with_df(self.df.where(place))


class Category(Enum):
    PASS = "PASS"
    FAIL = "FAIL"
    WARN = "WARN"
    ERROR = "ERROR"


#: The order in which results are listed.
PRIORITY = {Category.FAIL: 1, Category.WARN: 2, Category.ERROR: 3, Category.PASS: 4}


@dataclass(frozen=True)
class ConditionResult:
    category: Category
    details: str = ""
    name: str = ""

    @property
    def passed(self) -> bool:
        return self.category is Category.PASS


@dataclass(frozen=True)
class Condition:
    """A named predicate over a check's rows; a bool stands for PASS or ``otherwise``."""

    name: str
    test: Callable[[list[dict]], bool | tuple[bool, str] | ConditionResult]
    otherwise: Category = Category.FAIL

    def decide(self, rows: list[dict]) -> ConditionResult:
        try:
            found = self.test(rows)
        except Exception as error:  # noqa: BLE001  what a condition raises is its result
            return ConditionResult(Category.ERROR, f"{type(error).__name__}: {error}", self.name)
        if isinstance(found, ConditionResult):
            return replace(found, name=self.name)
        good, details = found if isinstance(found, tuple) else (found, "")
        return ConditionResult(Category.PASS if good else self.otherwise, details, self.name)


def every(column: str, test: Callable[[Any], bool], name: str, otherwise: Category = Category.FAIL, skip_null: bool = True) -> Condition:
    """All rows' values of a column hold a test; the details name those that don't."""

    def decide(rows: list[dict]) -> tuple[bool, str]:
        bad = [r for r in rows if not (skip_null and r[column] is None) and not test(r[column])]
        return not bad, "; ".join(f"{_first(r)}: {_short(r[column])}" for r in bad[:5])

    return Condition(name, decide, otherwise)


def at_most(column: str, limit: float, otherwise: Category = Category.FAIL) -> Condition:
    return every(column, lambda v: v <= limit, f"{column} is not greater than {limit}", otherwise)


def less_than(column: str, limit: float, otherwise: Category = Category.FAIL) -> Condition:
    return every(column, lambda v: v < limit, f"{column} is less than {limit}", otherwise)


def greater_than(column: str, limit: float, otherwise: Category = Category.FAIL) -> Condition:
    return every(column, lambda v: v > limit, f"{column} is greater than {limit}", otherwise)


def no_rows(name: str, otherwise: Category = Category.FAIL) -> Condition:
    return Condition(name, lambda rows: (not rows, f"{len(rows)} found"), otherwise)


def number_exceeding(column: str, limit: float, allowed: int = 0, otherwise: Category = Category.FAIL) -> Condition:
    """At most ``allowed`` rows reach the limit: the condition of drift scores, which fails on equality."""
    return Condition(f"{column} is less than {limit}, but for {allowed}", lambda rows: (sum(r[column] is not None and r[column] >= limit for r in rows) <= allowed, ""), otherwise)


def relative_degradation(metric: str, limit: float = 0.1) -> Condition:
    """A test score is less than ``limit`` of the train score below it."""

    def decide(rows: list[dict]) -> tuple[bool, str]:
        by = {r["dataset"]: r[metric] for r in rows}
        a, b = by["train"], by["test"]
        lost = (a - b) / abs(a) if a else float(b != 0)
        return lost < limit, f"{metric} fell by {lost:.2%}"

    return Condition(f"{metric} degrades by less than {limit}", decide)


def _first(row: dict) -> str:
    return str(next(iter(row.values())))


def _short(value: Any) -> str:
    return f"{value:.4g}" if isinstance(value, float) else str(value)


@dataclass
class CheckResult:
    name: str
    rows: list[dict] = field(default_factory=list)
    conditions: list[ConditionResult] = field(default_factory=list)
    error: str | None = None
    seconds: float = 0.0

    @property
    def priority(self) -> int:
        return 998 if self.error else min((PRIORITY[c.category] for c in self.conditions), default=5)

    @property
    def passed(self) -> bool:
        return not self.error and all(c.passed for c in self.conditions)

    def reduce(self, column: str, how: str = "max", weights: dict[str, float] | None = None) -> dict[str, float]:
        """One number from a column: max, mean, or the mean or root mean power weighted by feature (weighted, l3_weighted, l5_weighted)."""
        pairs = [(_first(r), float(r[column])) for r in self.rows if r[column] is not None]
        values = [v for _, v in pairs]
        if not values:
            return {}
        if how == "none":
            return dict(pairs)
        if how == "max":
            return {"max": max(values)}
        if how == "mean" or not weights:
            return {"mean": sum(values) / len(values)}
        power = {"weighted": 1, "l3_weighted": 3, "l5_weighted": 5}[how]
        w = [weights.get(n, 0.0) for n, _ in pairs]
        return {how: (sum(a * v**power for a, v in zip(w, values)) / (sum(w) or 1.0)) ** (1 / power)}

    def to_dict(self) -> dict:
        return {"check": self.name, "value": self.rows, "error": self.error, "conditions": [{"name": c.name, "category": c.category.value, "details": c.details} for c in self.conditions]}

    def to_json(self) -> str:
        return json.dumps(self.to_dict(), default=str)

    @classmethod
    def from_json(cls, text: str) -> CheckResult:
        d = json.loads(text)
        return cls(d["check"], d["value"], [ConditionResult(Category(c["category"]), c["details"], c["name"]) for c in d["conditions"]], d["error"])

    def to_html(self) -> str:
        cell = lambda v: f"<td>{html.escape(_short(v))}</td>"
        conditions = "".join(f"<tr>{cell(c.category.value)}{cell(c.name)}{cell(c.details)}</tr>" for c in self.conditions)
        names = list(self.rows[0]) if self.rows else []
        head = "".join(f"<th>{html.escape(n)}</th>" for n in names)
        body = "".join("<tr>" + "".join(cell(r[n]) for n in names) + "</tr>" for r in self.rows[:100])
        return f"<h2>{html.escape(self.name)}</h2><table>{conditions}</table>" + (f"<p>{html.escape(self.error)}</p>" if self.error else f"<table><tr>{head}</tr>{body}</table>")


@dataclass(frozen=True)
class Check:
    """A named function of (train, test, ...) datasets to a small DataFrame, with conditions."""

    name: str
    value: Callable[..., DataFrame]
    conditions: tuple[Condition, ...] = ()

    def add_condition(self, *conditions: Condition) -> Check:
        return replace(self, conditions=(*self.conditions, *conditions))

    def run(self, *datasets: Dataset) -> CheckResult:
        import time

        began = time.perf_counter()
        try:
            rows = [r.asDict(recursive=True) for r in self.value(*datasets).collect()]
        except Exception as error:  # noqa: BLE001  a failed check is a result of the suite
            return CheckResult(self.name, error=f"{type(error).__name__}: {str(error)[:500]}", seconds=time.perf_counter() - began)
        return CheckResult(self.name, rows, [c.decide(rows) for c in self.conditions], seconds=time.perf_counter() - began)


@dataclass
class SuiteResult:
    name: str
    results: list[CheckResult]

    @property
    def passed(self) -> bool:
        return all(r.passed for r in self.results)

    def sorted(self) -> list[CheckResult]:
        return sorted(self.results, key=lambda r: r.priority)

    def to_json(self) -> str:
        return json.dumps({"name": self.name, "results": [r.to_dict() for r in self.results]}, default=str)

    @classmethod
    def from_json(cls, text: str) -> SuiteResult:
        d = json.loads(text)
        return cls(d["name"], [CheckResult.from_json(json.dumps(r)) for r in d["results"]])

    def to_html(self) -> str:
        return f"<html><head><title>{html.escape(self.name)}</title></head><body><h1>{html.escape(self.name)}</h1>{''.join(r.to_html() for r in self.sorted())}</body></html>"

    def to_markdown(self) -> str:
        lines = [f"# {self.name}", "", "| check | condition | status | details |", "|-|-|-|-|"]
        for r in self.sorted():
            lines += [f"| {r.name} | {c.name} | {c.category.value} | {c.details} |" for c in r.conditions] or [f"| {r.name} | | {'ERROR' if r.error else ''} | {r.error or ''} |"]
        return "\n".join(lines)

    def to_junit(self) -> str:
        cases = []
        for r in self.results:
            bad = [c for c in r.conditions if not c.passed]
            inside = "".join(f"<failure message={quoteattr(c.name)}>{escape(c.details)}</failure>" for c in bad) + (f"<error message={quoteattr(r.error)}/>" if r.error else "")
            cases.append(f'<testcase classname={quoteattr(self.name)} name={quoteattr(r.name)} time="{r.seconds:.3f}">{inside}</testcase>')
        failures, errors = sum(not r.passed and not r.error for r in self.results), sum(bool(r.error) for r in self.results)
        return f'<testsuite name={quoteattr(self.name)} tests="{len(cases)}" failures="{failures}" errors="{errors}">{"".join(cases)}</testsuite>'

    def frame(self, spark) -> DataFrame:
        """(check, condition, category, details) of every condition."""
        rows = [(r.name, c.name, c.category.value, c.details) for r in self.results for c in r.conditions] + [(r.name, "", "ERROR", r.error) for r in self.results if r.error]
        return spark.createDataFrame(rows, "check string, condition string, category string, details string")


@dataclass
class Suite:
    """Checks in order; suites inside suites are flattened."""

    name: str
    checks: list[Check]

    def __init__(self, name: str, *checks: Check | Suite) -> None:
        self.name, self.checks = name, []
        for c in checks:
            self.add(c)

    def add(self, check: Check | Suite) -> Suite:
        self.checks += check.checks if isinstance(check, Suite) else [check]
        return self

    def remove(self, name: str) -> Suite:
        self.checks = [c for c in self.checks if c.name != name]
        return self

    def run(self, *datasets: Dataset, parallel: int = 4) -> SuiteResult:
        with ThreadPoolExecutor(parallel) as pool:
            return SuiteResult(self.name, list(pool.map(lambda c: c.run(*datasets), self.checks)))


def collect_all(results: Iterable[CheckResult]) -> dict[str, list[dict]]:
    return {r.name: r.rows for r in results}
