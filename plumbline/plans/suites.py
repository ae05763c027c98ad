"""Ready-made suites with default conditions: of tables, of texts and of images, for one side, two sides and models.

A check that lacks a role it needs (a label, an index, predictions) is left
out of a suite, as are checks that a caller names in ``without``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import inference
from ..core import Check, Dataset, Suite
from ..data import TextData, VisionData
from ..operators import correlations, evaluation, integrity, models, scoring, text, train_test, vision
from . import conditions as c


def _features(d: Dataset) -> list[str]:
    return list(d.features)


def _strings(d: Dataset) -> list[str]:
    kinds = dict(d.df.dtypes)
    return [x for x in d.features if kinds[x] == "string"]


def _suite(name: str, checks: list[Check], without: tuple[str, ...] = ()) -> Suite:
    return Suite(name, *(x for x in checks if x.name not in without))


def _regression(d: Dataset) -> bool:
    return inference.infer_task(d.df, d.label) == "regression"


def _power(d: Dataset, features: list[str]) -> DataFrame:
    return models.predictive_power(d.df, features, d.label, _regression(d))


def _outliers(d: Dataset) -> DataFrame:
    key = d.index or "__id"
    df = d.df if d.index else d.df.withColumn(key, F.xxhash64(*d.df.columns))
    return integrity.outlier_samples(df, df, key, d.numerical_features, list(d.cat_features))


# --- tables ------------------------------------------------------------------


def data_integrity(label: bool = True, identifiers: bool = False, without: tuple[str, ...] = ("outlier samples",)) -> Suite:
    """One table. ``label``: it has one; ``identifiers``: it has an index or a date. Outlier samples cost the square of the rows: ask for them by ``without=()``."""
    checks = [
        Check("is single value", lambda d: integrity.is_single_value(d.df, _features(d)), (c.not_single_value(),)),
        Check("percent of nulls", lambda d: integrity.percent_of_nulls(d.df, _features(d)), (c.nulls_at_most(),)),
        Check("special characters", lambda d: integrity.special_characters(d.df, _strings(d)), (c.special_characters_at_most(),)),
        Check("mixed nulls", lambda d: integrity.mixed_nulls(d.df, _strings(d)).groupBy("column").count(), (c.null_kinds_at_most(),)),
        Check("mixed data types", lambda d: integrity.mixed_data_types(d.df, _strings(d)), (c.rare_type_not_in(),)),
        Check("string mismatch", lambda d: integrity.string_mismatch(d.df, _strings(d)), (c.no_variants(),)),
        Check("string length out of bounds", lambda d: integrity.string_length_out_of_bounds(d.df, _strings(d)), (c.length_outliers_at_most(),)),
        Check("data duplicates", lambda d: integrity.data_duplicates(d.df, _features(d)), (c.duplicates_at_most(),)),
        Check("outlier samples", _outliers, (c.outlier_samples_at_most(),)),
        Check("feature correlation", lambda d: correlations.feature_correlation(d.df, d.numerical_features, list(d.cat_features)), (c.correlated_pairs(),)),
        Check("columns info", lambda d: integrity.columns_info(d.df, d.label, d.index, d.datetime)),
    ]
    if label:
        checks += [
            Check("conflicting labels", lambda d: integrity.conflicting_labels(d.df, _features(d), d.label), (c.conflicting_labels_at_most(),)),
            Check("class imbalance", lambda d: integrity.class_imbalance(d.df, d.label), (c.class_ratio_less_than(),)),
            Check("feature label correlation", lambda d: _power(d, _features(d)), (c.power_less_than(),)),
        ]
    if label and identifiers:
        checks.append(Check("identifier label correlation", lambda d: _power(Dataset(_times(d), d.label), [x for x in (d.index, d.datetime) if x]), (c.identifier_power_at_most(),)))
    return _suite("data integrity", checks, without)


def _times(d: Dataset) -> DataFrame:
    return d.df.withColumn(d.datetime, F.unix_timestamp(d.datetime).cast("double")) if d.datetime else d.df


def train_test_validation(label: bool = True, index: bool = True, datetime: bool = True, without: tuple[str, ...] = ()) -> Suite:
    """Two tables with the same roles."""
    checks = [
        Check("datasets size", lambda a, b: train_test.datasets_size(a.df, b.df), (c.test_larger_than(),)),
        Check("new categories", lambda a, b: train_test.new_categories(a.df, b.df, list(a.cat_features)), (c.new_categories_at_most(),)),
        Check("string mismatch comparison", lambda a, b: train_test.string_mismatch_comparison(a.df, b.df, _strings(a)), (c.no_new_variants(),)),
        Check("samples mix", lambda a, b: train_test.samples_mix(a.df, b.df, [*a.features, *([a.label] if a.label else [])]), (c.common_samples_at_most(),)),
        Check("feature drift", lambda a, b: train_test.feature_drift(a.df, b.df, a.numerical_features, list(a.cat_features)), (c.feature_drift_less_than(),)),
        Check("multivariate drift", lambda a, b: models.domain_classifier(a.df, b.df, a.numerical_features, list(a.cat_features)), (c.drift_less_than(),)),
    ]
    if datetime:
        checks += [
            Check("date leakage duplicates", lambda a, b: train_test.date_leakage_duplicates(a.df, b.df, a.datetime), (c.leakage_at_most(),)),
            Check("date leakage overlap", lambda a, b: train_test.date_leakage_overlap(a.df, b.df, a.datetime), (c.leakage_at_most(),)),
        ]
    if index:
        checks.append(Check("index leakage", lambda a, b: train_test.index_leakage(a.df, b.df, a.index), (c.leakage_at_most(),)))
    if label:
        checks += [
            Check("new labels", lambda a, b: train_test.new_labels(a.df, b.df, a.label), (c.new_labels_at_most(),)),
            Check("label drift", lambda a, b: train_test.label_drift(a.df, b.df, a.label), (c.label_drift_at_most(),)),
            Check("feature label correlation change", lambda a, b: models.predictive_power_change(a.df, b.df, _features(a), a.label, regression=_regression(a)), (c.power_difference_less_than(), c.train_power_less_than())),
        ]
    return _suite("train test validation", checks, without)


def _score_rows(score: str) -> Callable[[Dataset], DataFrame]:
    """The rows with a per-sample score: of a class 1 where it is right, of a number the negative squared error."""
    return lambda d: d.df.withColumn("__score", evaluation.neg_squared_error(d.label, score) if _regression(d) else (F.col(d.label).cast("string") == F.col(score).cast("string")).cast("double"))


def model_evaluation(prediction: str, scores: dict[str, str] | None = None, task: str = "multiclass", importance: dict[str, float] | None = None, model=None, scorers: list | dict | None = None, without: tuple[str, ...] = ()) -> Suite:
    """Predictions in a column of both tables; ``scores``: a column of probabilities by class; ``model``: what made them, for its time and its trees."""
    rows = _score_rows(prediction)
    checks = [
        Check("train test performance", lambda a, b: scoring.train_test_performance(a.df, b.df, a.label, prediction, given=scorers, task=task), (c.degradation_less_than(),)),
        Check("prediction drift", lambda a, b: train_test.prediction_drift(a.df, b.df, prediction), (c.label_drift_at_most(),)),
        Check("weak segments", lambda a, b: models.weak_segments(rows(b), b.numerical_features, "__score"), (c.weak_segment_greater_than(),)),
    ]
    if task == "regression":
        checks.append(Check("regression error distribution", lambda a, b: evaluation.regression_errors(b.df, b.label, prediction), (c.kurtosis_greater_than(), c.systematic_error_less_than())))
    else:
        checks += [
            Check("confusion matrix", lambda a, b: evaluation.confusion_matrix(b.df, b.label, prediction), (c.misclassified_lower_than(),)),
            Check("simple model comparison", lambda a, b: evaluation.simple_model_comparison(b.df, b.label, prediction), (c.gain_greater_than(),)),
        ]
    if scores:
        checks += [
            Check("roc auc", lambda a, b: evaluation.roc_auc(b.df, b.label, scores), (c.auc_greater_than(),)),
            Check("calibration score", lambda a, b: evaluation.calibration_score(b.df, b.label, scores)),
        ]
    if importance:
        checks.append(Check("unused features", lambda a, b: models.unused_features(b.df, b.numerical_features, importance), (c.unused_high_variance_at_most(),)))
    if model is not None:
        checks.append(Check("inference time", lambda a, b: b.df.sparkSession.createDataFrame([(evaluation.inference_time(model, b.df),)], "seconds double"), (c.inference_time_less_than(),)))
        if hasattr(model, "trees") and hasattr(model, "treeWeights"):
            score = lambda df, y, p: df.agg(F.avg((F.col(y).cast("double") == F.col(p)).cast("double"))).first()[0]
            checks.append(Check("boosting overfit", lambda a, b: models.partial_scores(a.df, b.df, model, a.label, score), (c.decline_less_than(),)))
    return _suite("model evaluation", checks, without)


def production(prediction: str | None = None, task: str | None = None, comparative: bool = True, scorers: list | dict | None = None, without: tuple[str, ...] = ()) -> Suite:
    """A table of production, alone or (comparative) as test beside a reference as train; ``task`` with labels at hand."""
    one = lambda f: (lambda *ds: f(ds[-1]))
    checks = [
        Check("is single value", one(lambda d: integrity.is_single_value(d.df, _features(d))), (c.not_single_value(),)),
        Check("percent of nulls", one(lambda d: integrity.percent_of_nulls(d.df, _features(d))), (c.nulls_at_most(),)),
    ]
    if task and prediction:
        rows = _score_rows(prediction)
        checks.append(Check("weak segments", one(lambda d: models.weak_segments(rows(d), d.numerical_features, "__score")), (c.weak_segment_greater_than(),)))
        if task == "regression":
            checks.append(Check("regression error distribution", one(lambda d: evaluation.regression_errors(d.df, d.label, prediction)), (c.kurtosis_greater_than(), c.systematic_error_less_than())))
        else:
            checks.append(Check("confusion matrix", one(lambda d: evaluation.confusion_matrix(d.df, d.label, prediction)), (c.misclassified_lower_than(),)))
        if not comparative:
            checks.append(Check("performance", one(lambda d: scoring.performance(d.df, d.label, prediction, scorers, task))))
    if comparative:
        checks += [
            Check("new categories", lambda a, b: train_test.new_categories(a.df, b.df, list(a.cat_features)), (c.new_category_ratio_at_most(),)),
            Check("string mismatch comparison", lambda a, b: train_test.string_mismatch_comparison(a.df, b.df, _strings(a)), (c.no_new_variants(),)),
            Check("feature drift", lambda a, b: train_test.feature_drift(a.df, b.df, a.numerical_features, list(a.cat_features)), (c.feature_drift_less_than(),)),
            Check("multivariate drift", lambda a, b: models.domain_classifier(a.df, b.df, a.numerical_features, list(a.cat_features)), (c.drift_less_than(),)),
        ]
        if prediction:
            checks.append(Check("prediction drift", lambda a, b: train_test.prediction_drift(a.df, b.df, prediction), (c.label_drift_at_most(),)))
        if task and prediction:
            checks += [
                Check("label drift", lambda a, b: train_test.label_drift(a.df, b.df, a.label), (c.label_drift_at_most(),)),
                Check("new labels", lambda a, b: train_test.new_labels(a.df, b.df, a.label), (c.new_label_ratio_at_most(),)),
                Check("train test performance", lambda a, b: scoring.train_test_performance(a.df, b.df, a.label, prediction, given=scorers, task=task), (c.degradation_less_than(),)),
            ]
    return _suite("production", checks, without)


def _on_first(suite: Suite) -> Suite:
    """A suite of one side as checks of the first of two."""
    return Suite(suite.name, *(Check(x.name, (lambda f: (lambda *ds: f(ds[0])))(x.value), x.conditions) for x in suite.checks))


def full(prediction: str, **options) -> Suite:
    """Everything about two tables with labels and predictions."""
    return Suite("full", model_evaluation(prediction, **options), train_test_validation(index=False, datetime=False), _on_first(data_integrity()))


class ModelsSuite:
    """Checks over several models, each with its tables: ``run`` takes (train, test, prediction column) by name."""

    def __init__(self, name: str = "models", scorers: list | dict | None = None, task: str = "multiclass") -> None:
        self.name, self.scorers, self.task = name, scorers, task

    def run(self, given: dict[str, tuple[Dataset, Dataset, str]]) -> DataFrame:
        """(model, dataset, metric, class, value)."""
        out = None
        for model, (a, b, prediction) in given.items():
            row = scoring.train_test_performance(a.df, b.df, a.label, prediction, given=self.scorers, task=self.task).select(F.lit(model).alias("model"), "*")
            out = row if out is None else out.unionByName(row)
        return out


# --- texts -------------------------------------------------------------------


def text_integrity(column: str = "text") -> Suite:
    """A Dataset with a column of texts."""
    return Suite(
        "text integrity",
        Check("text duplicates", lambda d: text.text_duplicates(d.df, column), (c.duplicates_at_most(),)),
        Check("special characters", lambda d: text.text_special_characters(d.df, column)),
        Check("property outliers", lambda d: text.property_outliers(d.df, column, ["text_length", "average_word_length", "lexical_density"]), (c.property_outliers_at_most(),)),
        Check("conflicting labels", lambda d: text.text_conflicting_labels(d.df, column, d.label), (c.conflicting_labels_at_most(),)),
    )


def _numeric(t: TextData, kind: str) -> list[str]:
    types = t.metadata_types() if kind == "metadata" else t.properties_types()
    return sorted(n for n, k in types.items() if k == "numeric")


def _special_shares(t: TextData) -> DataFrame:
    from ..functions.strings import percentage_special_characters

    return t.df.where(F.col(t.text).isNotNull()).agg(F.count("*").alias("n"), F.count_if(percentage_special_characters(F.col(t.text)) > 0.2).alias("n_over"))


def _unknown(t: TextData, vocabulary: DataFrame) -> DataFrame:
    found = text.unknown_tokens(t.df, t.text, vocabulary)
    words = t.df.select(F.explode(F.split(F.lower(t.text), r"[^\p{L}\p{N}]+")).alias("w")).where("w != ''").agg(F.count("*").alias("total"))
    return found.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).crossJoin(F.broadcast(words))


def text_data_integrity(label: bool = True, properties: bool = True, metadata: bool = False, vocabulary: DataFrame | None = None, without: tuple[str, ...] = ()) -> Suite:
    """A TextData."""
    checks = [
        Check("text duplicates", lambda t: text.text_duplicates(t.df, t.text), (c.duplicates_at_most(),)),
        Check("special characters", _special_shares, (c.samples_with_special_characters_at_most(),)),
        Check("frequent substrings", lambda t: text.frequent_substrings(t.df, t.text), (c.substrings_fewer_than(),)),
    ]
    if properties:
        checks.append(Check("property outliers", lambda t: integrity.iqr_outliers(t.properties, _numeric(t, "properties"), (25, 75), 2.0), (c.property_outliers_at_most(),)))
    if vocabulary is not None:
        checks.append(Check("unknown tokens", lambda t: _unknown(t, vocabulary), (c.unknown_words_at_most(),)))
    if label:
        checks.append(Check("conflicting labels", lambda t: text.text_conflicting_labels(t.df, t.text, t.label), (c.conflicting_labels_at_most(),)))
        for kind in ["properties"] * properties + ["metadata"] * metadata:
            if kind == "properties":
                checks.append(Check("property label correlation", lambda t: models.predictive_power(t.joined("properties"), _numeric(t, "properties"), t.label), (c.power_less_than(0.3),)))
            checks.append(Check(f"under annotated {kind} segments", lambda t, kind=kind: models.under_annotated_segments(t.joined(kind), _numeric(t, kind), t.label), (c.annotation_greater_than(),)))
    return _suite("text data integrity", checks, without)


def text_train_test_validation(properties: bool = True, embeddings: bool = False, without: tuple[str, ...] = ()) -> Suite:
    """Two TextData."""
    checks = [
        Check("label drift", lambda a, b: train_test.label_drift(a.df, b.df, a.label), (c.label_drift_at_most(),)),
        Check("samples mix", lambda a, b: text.text_samples_mix(a.df, b.df, a.text), (c.common_samples_at_most(),)),
    ]
    if properties:
        checks.append(Check("property drift", lambda a, b: train_test.feature_drift(a.properties, b.properties, _numeric(a, "properties"), [n for n, k in a.properties_types().items() if k == "categorical"]), (c.feature_drift_less_than(),)))
    if embeddings:
        checks.append(Check("embeddings drift", lambda a, b: models.embeddings_drift(a.embeddings, b.embeddings, "embedding"), (c.drift_less_than(),)))
    return _suite("text train test validation", checks, without)


def text_model_evaluation(properties: bool = True, metadata: bool = False, task: str = "multiclass", without: tuple[str, ...] = ()) -> Suite:
    """Two TextData with predictions: classes, or IOB tags (``task`` token)."""
    if task == "token":
        one = lambda t: text.token_metrics(t.df, t.key, t.label, t.prediction)
        rows = lambda a, b: one(a).select(F.lit("train").alias("dataset"), "*").unionByName(one(b).select(F.lit("test").alias("dataset"), "*"))
        cells = F.inline(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in ("f1", "precision", "recall"))))
        return _suite("text model evaluation", [Check("train test performance", lambda a, b: rows(a, b).select("dataset", "class", cells), (c.degradation_less_than(),))], without)
    checks = [
        Check("prediction drift", lambda a, b: train_test.prediction_drift(a.df, b.df, a.prediction), (c.label_drift_at_most(),)),
        Check("train test performance", lambda a, b: scoring.train_test_performance(a.df, b.df, a.label, a.prediction, task=task), (c.degradation_less_than(),)),
        Check("confusion matrix", lambda a, b: evaluation.confusion_matrix(b.df, b.label, b.prediction), (c.misclassified_lower_than(),)),
    ]
    for kind in ["properties"] * properties + ["metadata"] * metadata:
        checks.append(Check(f"{kind} segments performance", lambda a, b, kind=kind: models.weak_segments(b.joined(kind).withColumn("__score", (F.col(b.label) == F.col(b.prediction)).cast("double")), _numeric(b, kind), "__score"), (c.weak_segment_greater_than(),)))
    return _suite("text model evaluation", checks, without)


def text_full(properties: bool = True, **options) -> Suite:
    return Suite("text full", text_model_evaluation(properties, **options), text_train_test_validation(properties), _on_first(text_data_integrity(properties=properties)))


# --- images ------------------------------------------------------------------

PROPERTIES = ["aspect_ratio", "area", "brightness", "rms_contrast", "mean_red", "mean_green", "mean_blue", "texture_level"]


def _wide(rows: DataFrame, names: list[str]) -> DataFrame:
    """(property, value) rows as one column per property."""
    return rows.select(*(F.when(F.col("property") == n, F.col("value")).alias(n) for n in names))


def _names(rows: DataFrame) -> list[str]:
    return [r[0] for r in rows.select("property").distinct().orderBy("property").collect()]  # a few names


def _value_drift(a: DataFrame, b: DataFrame) -> DataFrame:
    """Drift of label or prediction properties: classes as categories, others as numbers."""
    names = _names(a)
    cat = [n for n in names if n == "samples_per_class"]
    x, y = (_wide(d, names) for d in (a, b))
    if cat:
        x, y = (d.withColumn(cat[0], F.col(cat[0]).cast("string")) for d in (x, y))
    return train_test.feature_drift(x, y, [n for n in names if n not in cat], cat)


def vision_data_integrity(label: bool = True, properties: list[str] | None = None, without: tuple[str, ...] = ()) -> Suite:
    """A VisionData with pixels."""
    chosen = properties or PROPERTIES
    checks = [Check("image property outliers", lambda v: vision.image_property_outliers(v.image_properties(), chosen))]
    if label:

        def label_outliers(v: VisionData) -> DataFrame:
            rows = v.label_properties()
            names = [n for n in _names(rows) if n != "samples_per_class"]
            return integrity.iqr_outliers(_wide(rows, names), names) if names else v.df.sparkSession.createDataFrame([], "feature string, low double, high double, n_outliers long, ratio double")

        def power(v: VisionData) -> DataFrame:
            rows = vision.property_label_rows(v.df.select(v.label, v.pixels, v.height, v.width, v.channels), v.task, v.label, v.pixels, v.height, v.width, v.channels)
            target = "cls" if v.task == "detection" else v.label
            return models.predictive_power(rows.withColumn(target, F.col(target).cast("string")), chosen, target)

        checks += [Check("label property outliers", label_outliers), Check("property label correlation", power, (c.power_less_than(0.3),))]
    return _suite("vision data integrity", checks, without)


def vision_train_test_validation(label: bool = True, pixels: bool = True, properties: list[str] | None = None, without: tuple[str, ...] = ()) -> Suite:
    """Two VisionData."""
    chosen = properties or PROPERTIES
    checks = []
    if label:
        total = lambda v: v.label_classes()

        def new_labels(a: VisionData, b: VisionData) -> DataFrame:
            n = total(b).agg(F.sum("n").alias("t"))
            return total(b).join(total(a).select("cls"), "cls", "left_anti").crossJoin(F.broadcast(n)).select(F.col("cls").cast("string").alias("label"), "n", (F.col("n") / F.col("t")).alias("ratio"))

        checks += [
            Check("new labels", new_labels, (c.new_label_ratio_at_most(0.005),)),
            Check("label drift", lambda a, b: _value_drift(a.label_properties(), b.label_properties()), (c.image_label_drift_less_than(),)),
        ]
    if pixels:
        checks += [
            Check("heatmap comparison", lambda a, b: vision.heatmap_comparison(a.df, b.df, a.pixels).agg(F.avg("difference").alias("mean"), F.max("difference").alias("max"))),
            Check("image property drift", lambda a, b: vision.image_property_drift(a.image_properties(), b.image_properties(), chosen), (c.image_property_drift_less_than(),)),
            Check("image dataset drift", lambda a, b: models.domain_classifier(a.image_properties(), b.image_properties(), chosen, []), (c.drift_less_than(0.1),)),
        ]
        if label:

            def change(a: VisionData, b: VisionData) -> DataFrame:
                x, y = (vision.property_label_rows(v.df.select(v.label, v.pixels, v.height, v.width, v.channels), v.task, v.label, v.pixels, v.height, v.width, v.channels) for v in (a, b))
                target = "cls" if a.task == "detection" else a.label
                return models.predictive_power_change(*(d.withColumn(target, F.col(target).cast("string")) for d in (x, y)), chosen, target)

            checks.append(Check("property label correlation change", change, (c.power_difference_less_than(0.2, False), c.train_power_less_than(0.2))))
    return _suite("vision train test validation", checks, without)


def _sided(function: Callable[[VisionData], DataFrame]) -> Callable[[VisionData, VisionData], DataFrame]:
    return lambda a, b: function(a).select(F.lit("train").alias("dataset"), "*").unionByName(function(b).select(F.lit("test").alias("dataset"), "*"))


def class_performance(v: VisionData) -> DataFrame:
    """(class, metric, value): precision, recall and f1 of classes, of boxes at an overlap of 0.5, or of mask pixels."""
    if v.task == "classification":
        per = evaluation.class_metrics(v.judged(), "label", "predicted")
    elif v.task == "detection":
        per = vision.detection_metrics(v.df, v.key, v.label, v.prediction).withColumn("class", F.col("cls").cast("string")).where("tp + fn > 0")
    else:
        n = vision.mask_counts(v.df, v.label, v.prediction).withColumn("class", F.col("cls").cast("string"))
        ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
        per = n.withColumn("precision", ratio(F.col("tp"), F.col("said"))).withColumn("recall", ratio(F.col("tp"), F.col("real"))).withColumn("f1", ratio(2 * F.col("tp"), F.col("said") + F.col("real")))
    return per.select("class", F.inline(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in ("precision", "recall", "f1")))))


def vision_model_evaluation(task: str = "classification", properties: list[str] | None = None, pixels: bool = False, without: tuple[str, ...] = ()) -> Suite:
    """Two VisionData with predictions."""
    checks = [
        Check("class performance", _sided(class_performance), (c.degradation_less_than(),)),
        Check("prediction drift", lambda a, b: _value_drift(a.prediction_properties(), b.prediction_properties()), (c.image_label_drift_less_than(),)),
    ]
    if task == "detection":
        checks += [
            Check("mean average precision", lambda a, b: vision.average_precision_report(b.df, b.key, b.label, b.prediction), (c.map_greater_than(),)),
            Check("mean average recall", lambda a, b: vision.average_recall_report(b.df, b.key, b.label, b.prediction)),
            Check("confusion matrix", lambda a, b: vision.detection_confusion(b.df, b.key, b.label, b.prediction), (c.misclassified_lower_than(),)),
        ]
    elif task == "classification":
        checks += [
            Check("confusion matrix", lambda a, b: evaluation.confusion_matrix(b.judged(), "label", "predicted"), (c.misclassified_lower_than(),)),
            Check("simple model comparison", lambda a, b: vision.simple_model_comparison(b.judged(), "label", "predicted"), (c.gain_greater_than(),)),
        ]
        if pixels:
            chosen = (properties or PROPERTIES)[:4]

            def weak(a: VisionData, b: VisionData) -> DataFrame:
                rows = b.image_properties().join(b.judged().select(b.key, (F.col("label") == F.col("predicted")).cast("double").alias("__score")), b.key)
                return models.weak_segments(rows, chosen, "__score")

            checks.append(Check("weak segments", weak, (c.weak_segment_greater_than(),)))
    return _suite("vision model evaluation", checks, without)


def vision_full(task: str = "classification", pixels: bool = True, **options) -> Suite:
    return Suite("vision full", vision_model_evaluation(task, pixels=pixels, **options), vision_train_test_validation(pixels=pixels), *([_on_first(vision_data_integrity())] if pixels else []))
