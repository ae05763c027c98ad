"""Ready conditions with their default limits, by the check whose rows they judge.

Each function makes a :class:`Condition` over the rows of one check; its
docstring says what fails. What a limit does on equality is part of it.
"""

from __future__ import annotations

import math

from ..core import Category, Condition, at_most, every, greater_than, less_than, no_rows, number_exceeding, relative_degradation

WARN, FAIL = Category.WARN, Category.FAIL


def _total(rows: list[dict], column: str, by: str) -> dict[str, float]:
    out: dict[str, float] = {}
    for r in rows:
        out[r[by]] = out.get(r[by], 0) + (r[column] or 0)
    return out


# --- integrity ---------------------------------------------------------------


def class_ratio_less_than(limit: float = 0.1) -> Condition:
    """WARN when the rarest label's share of the commonest one's is ``limit`` or more, as the check defines it."""
    return Condition(f"least over most frequent label is less than {limit}", lambda rows: not rows or min(r["ratio"] for r in rows) / max(max(r["ratio"] for r in rows), 1e-12) < limit, WARN)


def correlated_pairs(threshold: float = 0.9, allowed: int = 0) -> Condition:
    """FAIL when more than ``allowed`` pairs of features score above ``threshold``."""
    return Condition(f"at most {allowed} pairs correlate above {threshold}", lambda rows: sum(r["score"] is not None and r["score"] > threshold for r in rows) <= allowed)


def power_less_than(limit: float = 0.8, column: str = "score") -> Condition:
    """FAIL when a feature's predictive power is ``limit`` or more (0.3 for properties of texts and images)."""
    return less_than(column, limit)


def identifier_power_at_most(limit: float = 0.0) -> Condition:
    """FAIL when an identifier or a date predicts the label better than ``limit``."""
    return at_most("score", limit)


def not_single_value() -> Condition:
    """FAIL when a column has one value only."""
    return every("single", lambda v: not v, "no column has one value only")


def rare_type_not_in(low: float = 0.01, high: float = 0.1) -> Condition:
    """WARN when the rarer of numbers and strings has between ``low`` and ``high`` (both excluded) of a column."""
    return every("numbers", lambda v: not low < min(v, 1 - v) < high, f"no type has between {low} and {high} of a column", WARN)


def null_kinds_at_most(limit: int = 1) -> Condition:
    """FAIL when a column writes missing values in more than ``limit`` ways; rows are (column, count)."""
    return at_most("count", limit)


def outlier_samples_at_most(ratio: float = 0.005, score: float = 0.7) -> Condition:
    """WARN when more than ``ratio`` of the rows have an outlier score above ``score``; at 0 the ratio counts as a thousandth."""

    def decide(rows: list[dict]) -> tuple[bool, str]:
        values = sorted(r["score"] for r in rows if r["score"] is not None)
        if not values:
            return True, ""
        at = values[min(len(values) - 1, math.ceil((1 - max(ratio, 0.001)) * (len(values) - 1)))]
        return at <= score, f"{sum(v > score for v in values)} of {len(values)} rows"

    return Condition(f"at most {ratio} of the rows score above {score}", decide, WARN)


def no_outlier_samples(score: float = 0.7) -> Condition:
    return outlier_samples_at_most(0.0, score)


def nulls_at_most(limit: float = 0.05) -> Condition:
    """FAIL when a column has a larger share of nulls."""
    return at_most("percent", limit)


def special_characters_at_most(limit: float = 0.001) -> Condition:
    """WARN when a larger share of a column's values has no letter or digit."""
    return at_most("percent", limit, WARN)


def length_outliers_at_most(limit: int = 0) -> Condition:
    """FAIL when a column has more strings of outlying length."""
    return at_most("n_outliers", limit)


def length_outlier_ratio_at_most(limit: float = 0.0, total: int | None = None) -> Condition:
    """WARN when a larger share of a column's strings has an outlying length; ``total`` rows, or n of each row."""
    return Condition(f"share of outlying lengths is not greater than {limit}", lambda rows: all(r["n_outliers"] / max(r.get("n") or total or 1, 1) <= limit for r in rows), WARN)


def _variants(rows: list[dict]) -> dict[tuple, int]:
    out: dict[tuple, int] = {}
    for r in rows:
        out[r["column"], r["base"]] = out.get((r["column"], r["base"]), 0) + 1
    return out


def variants_at_most(limit: int) -> Condition:
    """WARN when a base form has more than ``limit`` variants."""
    return Condition(f"at most {limit} variants of a string", lambda rows: all(n <= limit for n in _variants(rows).values()), WARN)


def no_variants() -> Condition:
    return no_rows("no variants of strings", WARN)


def variant_ratio_at_most(limit: float = 0.01) -> Condition:
    """FAIL when the variants of a column make up more than ``limit`` of it."""
    return Condition(f"share of variants is not greater than {limit}", lambda rows: all(v <= limit for v in _total(rows, "percent", "column").values()))


def conflicting_labels_at_most(limit: float = 0.0) -> Condition:
    return at_most("percent", limit)


def duplicates_at_most(limit: float = 0.05) -> Condition:
    return at_most("percent", limit, WARN)


# --- train and test ----------------------------------------------------------


def test_larger_than(limit: int = 100) -> Condition:
    """FAIL when test has ``limit`` rows or fewer."""
    return every("n_test", lambda n: n > limit, f"test has more than {limit} rows")


def test_train_ratio_greater_than(limit: float = 0.01) -> Condition:
    return Condition(f"test over train is greater than {limit}", lambda rows: all(r["n_test"] > limit * r["n_train"] for r in rows))


def train_not_smaller() -> Condition:
    return Condition("train has as many rows as test", lambda rows: all(r["n_train"] >= r["n_test"] for r in rows))


def leakage_at_most(limit: float = 0.0) -> Condition:
    """FAIL when a larger share of test rows shares a date, lies before the last one of train, or shares an id."""
    return at_most("ratio", limit)


def power_difference_less_than(limit: float = 0.2, negative: bool = True) -> Condition:
    """FAIL when a feature's power differs by ``limit`` or more between train and test; ``negative``: in either direction."""
    return every("difference", lambda v: (abs(v) if negative else v) < limit, f"power differs by less than {limit}")


def train_power_less_than(limit: float = 0.7) -> Condition:
    return less_than("train", limit)


def drift_less_than(limit: float = 0.25, column: str = "drift") -> Condition:
    """FAIL when the drift of the whole table (embeddings, images: 0.1) is ``limit`` or more."""
    return less_than(column, limit)


def new_categories_at_most(limit: int = 0) -> Condition:
    """FAIL when a column has more new categories."""

    def decide(rows: list[dict]) -> tuple[bool, str]:
        by: dict[str, int] = {}
        for r in rows:
            by[r["feature"]] = by.get(r["feature"], 0) + 1
        return all(n <= limit for n in by.values()), "; ".join(f"{c}: {n}" for c, n in by.items() if n > limit)

    return Condition(f"at most {limit} new categories", decide)


def new_category_ratio_at_most(limit: float = 0.0) -> Condition:
    return Condition(f"share of new categories is not greater than {limit}", lambda rows: all(v <= limit for v in _total(rows, "ratio", "feature").values()))


def new_labels_at_most(limit: int = 0) -> Condition:
    return Condition(f"at most {limit} new labels", lambda rows: (len(rows) <= limit, f"{len(rows)} found"))


def new_label_ratio_at_most(limit: float = 0.0) -> Condition:
    """FAIL when new labels (of image boxes: 0.005) have a larger share of test."""
    return Condition(f"share of new labels is not greater than {limit}", lambda rows: sum(r["ratio"] for r in rows) <= limit)


def _new_variants(rows: list[dict]) -> dict[str, float]:
    out: dict[str, float] = {}
    totals: dict[str, int] = {}
    for r in rows:
        totals[r["column"]] = totals.get(r["column"], 0) + r["n_test"]
        if r["place"] == "test":
            out[r["column"]] = out.get(r["column"], 0) + r["n_test"]
    return {c: n / max(totals[c], 1) for c, n in out.items()}


def no_new_variants() -> Condition:
    """FAIL when test has a variant of a string that train lacks."""
    return new_variants_at_most(0.0)


def new_variants_at_most(limit: float) -> Condition:
    """FAIL when such variants make up more than ``limit`` of the strings with variants."""
    return Condition(f"share of new variants is not greater than {limit}", lambda rows: all(v <= limit for v in _new_variants(rows).values()))


def feature_drift_less_than(categorical: float = 0.2, numeric: float = 0.2, allowed: int = 0) -> Condition:
    """FAIL when more than ``allowed`` columns drift by their limit or more; the method tells categories from numbers."""

    def decide(rows: list[dict]) -> tuple[bool, str]:
        kinds = ("cramers_v", "psi", "Cramer's V", "PSI")
        bad = [r for r in rows if r["score"] is not None and r["score"] >= (categorical if r.get("method") in kinds else numeric)]
        return len(bad) <= allowed, "; ".join(f"{next(iter(r.values()))}: {r['score']:.3g}" for r in bad[:5])

    return Condition(f"drift is less than {categorical} (categories) and {numeric} (numbers), but for {allowed}", decide)


def label_drift_at_most(limit: float = 0.15) -> Condition:
    """FAIL when a label or prediction drifts by more than ``limit``."""
    return at_most("score", limit)


def image_label_drift_less_than(limit: float = 0.15) -> Condition:
    """FAIL when a property of labels or predictions drifts by ``limit`` or more."""
    return number_exceeding("score", limit)


def image_property_drift_less_than(limit: float = 0.2) -> Condition:
    return number_exceeding("score", limit)


def common_samples_at_most(limit: float = 0.05) -> Condition:
    return at_most("ratio", limit)


# --- models ------------------------------------------------------------------


def performance_greater_than(threshold: float, metrics: list[str] | None = None, classes: str = "all") -> Condition:
    """FAIL unless the values (metric, class, value) of all classes, of any, or of a named one exceed ``threshold``."""
    return _performance(threshold, metrics, classes, 1)


def performance_less_than(threshold: float, metrics: list[str] | None = None, classes: str = "all") -> Condition:
    return _performance(threshold, metrics, classes, -1)


def _performance(threshold: float, metrics: list[str] | None, classes: str, sign: int) -> Condition:
    def decide(rows: list[dict]) -> tuple[bool, str]:
        by: dict[str, list[float]] = {}
        for r in rows:
            if (metrics is None or r["metric"] in metrics) and (classes in ("all", "any") or str(r["class"]) == classes):
                by.setdefault(r["metric"], []).append(sign * r["value"])
        if missing := set(metrics or ()) - set(by):
            raise ValueError(f"no such metrics: {sorted(missing)}")
        bad = [m for m, v in by.items() if not (max(v) if classes == "any" else min(v)) > sign * threshold]
        return not bad, ", ".join(bad)

    return Condition(f"{'scores' if not metrics else ', '.join(metrics)} {'greater' if sign > 0 else 'less'} than {threshold} for {classes} classes", decide)


def test_performance_greater_than(least: float) -> Condition:
    """FAIL when a test value is ``least`` or less."""
    return Condition(f"test scores are greater than {least}", lambda rows: all(r["value"] > least for r in rows if r["dataset"] == "test"))


def degradation_less_than(limit: float = 0.1) -> Condition:
    """FAIL when a metric (of a class) is lower on test than on train by ``limit`` of it or more."""

    def decide(rows: list[dict]) -> tuple[bool, str]:
        by: dict[tuple, dict] = {}
        for r in rows:
            by.setdefault((r["metric"], r["class"]), {})[r["dataset"]] = r["value"]
        bad = []
        for (metric, c), v in by.items():
            if len(v) == 2 and v["train"] != v["test"]:
                lost = (v["train"] - v["test"]) / abs(v["train"]) if v["train"] else math.inf if v["test"] < 0 else -math.inf
                if lost >= limit:
                    bad.append(f"{metric}{'' if c is None else f' of {c}'}: {lost:.2%}")
        return not bad, "; ".join(bad)

    return Condition(f"scores degrade by less than {limit}", decide)


def class_imbalance_less_than(metric: str, limit: float = 0.3) -> Condition:
    """FAIL when, on either side, the worst class's score is lower than the best one's by ``limit`` of it or more."""

    def decide(rows: list[dict]) -> tuple[bool, str]:
        by: dict[str, list[tuple]] = {}
        for r in rows:
            if r["metric"] == metric and r["class"] is not None:
                by.setdefault(r.get("dataset", ""), []).append((r["value"], r["class"]))
        if not by:
            raise ValueError(f"no scores {metric} by class")
        bad = []
        for side, values in by.items():
            low, high = min(values), max(values)
            ratio = abs(low[0] - high[0]) / abs(high[0]) if high[0] else 0.0
            if ratio >= limit:
                bad.append(f"{side} {low[1]} against {high[1]}: {ratio:.2%}")
        return not bad, "; ".join(bad)

    return Condition(f"{metric} of classes differs by less than {limit}", decide)


def auc_greater_than(limit: float = 0.7) -> Condition:
    return greater_than("auc", limit)


def gain_greater_than(limit: float = 0.1, most: float = 50.0, classes: list[str] | None = None, average: bool = False) -> Condition:
    """FAIL when a class's gain over the simple model is ``limit`` or less; perfect scores pass; ``average``: the mean over classes."""

    def decide(rows: list[dict]) -> tuple[bool, str]:
        own = [r for r in rows if (classes is None or r["class"] in classes) and r["score"] is not None]
        if average:
            score, simple = (sum(r[c] for r in own) / max(len(own), 1) for c in ("score", "simple"))
            own = [{"class": "all", "score": score, "gain": (score - simple) / (1 - simple) if simple != 1 else 0.0}]
        bad = [r for r in own if r["score"] < 1 and not min(r["gain"], most) > limit]
        return not bad, "; ".join(f"{r['class']}: {r['gain']:.3g}" for r in bad[:5])

    return Condition(f"gain over the simple model is greater than {limit}", decide)


def misclassified_lower_than(limit: float = 0.2) -> Condition:
    """FAIL when a cell off the diagonal has more than ``limit`` of all rows, rounded up."""

    def decide(rows: list[dict]) -> tuple[bool, str]:
        most = math.ceil(limit * sum(r["n"] for r in rows))
        bad = [r for r in rows if r["label"] != r["prediction"] and r["n"] > most]
        return not bad, "; ".join(f"{r['label']} as {r['prediction']}: {r['n']}" for r in bad[:5])

    return Condition(f"no confusion has more than {limit} of the rows", decide)


def decline_less_than(limit: float = 0.05) -> Condition:
    """FAIL when the last boosting step's test score lies below the best one's by ``limit`` of it or more; errors count as negative scores."""

    def decide(rows: list[dict]) -> tuple[bool, str]:
        scores = [r["test"] if "test" in r else -r["test_error"] for r in sorted(rows, key=lambda r: r["trees"])]
        best, last = max(scores), scores[-1]
        lost = (best - last) / abs(best) if best else float(best != last)
        return lost < limit, f"{lost:.2%}"

    return Condition(f"test score declines by less than {limit}", decide)


def inference_time_less_than(limit: float = 0.001) -> Condition:
    return less_than("seconds", limit)


def bias_between(low: float, high: float = math.inf) -> Condition:
    """FAIL when a group's score differs from its baseline by less than ``low`` or more than ``high``."""
    return every("diff", lambda v: low <= v <= high, f"scores differ from the baseline between {low} and {high}")


def relative_bias_between(low: float, high: float = math.inf) -> Condition:
    """The same of the difference over the baseline; groups with a baseline of 0 take no part."""

    def decide(rows: list[dict]) -> tuple[bool, str]:
        bad = [r for r in rows if r["diff"] is not None and r["baseline"] and not low <= r["diff"] / r["baseline"] <= high]
        return not bad, "; ".join(str(r["protected"]) for r in bad[:5])

    return Condition(f"scores differ from the baseline by {low} to {high} of it", decide)


def kurtosis_greater_than(limit: float = -0.1) -> Condition:
    return every("kurtosis", lambda v: v > limit, f"kurtosis is greater than {limit}", WARN)


def systematic_error_less_than(limit: float = 0.01) -> Condition:
    """FAIL when the mean error is ``limit`` of the root mean square error or more."""
    return less_than("systematic_ratio", limit)


def unused_high_variance_at_most(limit: int = 5) -> Condition:
    """WARN when more features of high variance go unused."""
    return Condition(f"at most {limit} unused features of high variance", lambda rows: (n := sum(r["kind"] == "unused high variance" for r in rows)) <= limit or (False, f"{n} found"), WARN)


def weak_segment_greater_than(change: float = 0.2) -> Condition:
    """WARN unless the weakest segment's score exceeds the average less ``change`` of it (plus, where the average is negative)."""

    def decide(rows: list[dict]) -> tuple[bool, str]:
        if not rows:
            return True, "no weak segments"
        weak = min(rows, key=lambda r: r["score"])
        average = weak["average"]
        least = average * (1 - change if average > 0 else 1 + change)
        return weak["score"] > least, f"{weak['segment']}: {weak['score']:.3g} against {average:.3g}"

    return Condition(f"no segment is worse than the average by {change} of it", decide, WARN)


# --- texts and images --------------------------------------------------------


def substrings_fewer_than(limit: int = 1) -> Condition:
    """WARN when ``limit`` or more substrings are frequent."""
    return Condition(f"fewer than {limit} frequent substrings", lambda rows: (len(rows) < limit, f"{len(rows)} found"), WARN)


def samples_with_special_characters_at_most(limit: float = 0.05, per_sample: float = 0.2) -> Condition:
    """FAIL when more than ``limit`` of the texts have more than ``per_sample`` special characters; rows have the share of each text, or n and n_over."""

    def decide(rows: list[dict]) -> bool:
        if rows and "n_over" in rows[0]:
            return sum(r["n_over"] for r in rows) <= limit * sum(r["n"] for r in rows)
        return sum(r["share"] > per_sample for r in rows) <= limit * len(rows)

    return Condition(f"at most {limit} of the texts have more than {per_sample} special characters", decide)


def property_outliers_at_most(limit: float = 0.05, ignore: tuple[str, ...] = ()) -> Condition:
    """FAIL when a property has a larger share of outliers."""
    return Condition(f"share of outliers is not greater than {limit}", lambda rows: all(r["ratio"] is None or r["ratio"] <= limit for r in rows if r["feature"] not in ignore))


def annotation_greater_than(limit: float = 0.7) -> Condition:
    """FAIL when in the weakest segment ``limit`` of the rows or fewer have a label; an error without segments."""
    return Condition(f"more than {limit} of every segment has labels", lambda rows: min(r["score"] for r in rows) > limit)


def unknown_words_at_most(limit: float = 0.0) -> Condition:
    """FAIL when unknown words are more than ``limit`` of all; rows are (word, n) with total, or of unknown words only when none are allowed."""
    return Condition(f"share of unknown words is not greater than {limit}", lambda rows: not rows or sum(r["n"] for r in rows) / max(rows[0].get("total") or sum(r["n"] for r in rows), 1) <= limit)


def map_cells_greater_than(least: float) -> Condition:
    """FAIL when a cell of the precision report is ``least`` or less."""
    return Condition(f"all average precisions are greater than {least}", lambda rows: all(r[c] is None or r[c] > least for r in rows for c in ("map", "ap_50", "ap_75")))


def map_greater_than(least: float = 0.3) -> Condition:
    """FAIL when the mean average precision over all boxes is ``least`` or less."""
    return Condition(f"mean average precision is greater than {least}", lambda rows: all(r["map"] > least for r in rows if r["size"] == "all"))


def recall_greater_than(least: float) -> Condition:
    """FAIL when the lowest average recall is below ``least``."""
    return Condition(f"average recalls reach {least}", lambda rows: all(r["recall"] is None or r["recall"] >= least for r in rows))


__all__ = [n for n in dir() if not n.startswith("_") and n not in ("annotations", "math", "Category", "Condition", "WARN", "FAIL")] + ["relative_degradation"]
