"""Checks of predictions. Counting metrics all come from one count of (label, prediction) pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.running import exact_quantiles, running_sums
from . import kernels


def confusion_matrix(df: DataFrame, label: str, prediction: str, *by: str) -> DataFrame:
    """(by, label, prediction, n): pairs that occur; rows without a label or prediction are left out."""
    rows = df.where(F.col(label).isNotNull() & F.col(prediction).isNotNull())
    return rows.groupBy(*by, F.col(label).cast("string").alias("label"), F.col(prediction).cast("string").alias("prediction")).agg(F.count("*").alias("n"))


def class_metrics(df: DataFrame, label: str, prediction: str, *by: str) -> DataFrame:
    """(by, class, tp, fp, fn, support, precision, recall, f1, jaccard, fpr, fnr, tnr): of each class that occurs."""
    cells = confusion_matrix(df, label, prediction, *by)
    sides = cells.select(*by, F.col("label").alias("class"), F.col("n").alias("real"), F.lit(0).alias("said"), F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0).alias("hit")).unionByName(
        cells.select(*by, F.col("prediction").alias("class"), F.lit(0).cast("long").alias("real"), F.col("n").alias("said"), F.lit(0).cast("long").alias("hit"))
    )
    per = sides.groupBy(*by, "class").agg(F.sum("hit").alias("tp"), (F.sum("said") - F.sum("hit")).alias("fp"), (F.sum("real") - F.sum("hit")).alias("fn"), F.sum("real").alias("support"))
    total = cells.groupBy(*by).agg(F.sum("n").alias("total")) if by else cells.agg(F.sum("n").alias("total"))
    per = per.join(total, list(by)) if by else per.crossJoin(F.broadcast(total))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    tn = F.col("total") - tp - fp - fn
    return per.select(
        *by, "class", "tp", "fp", "fn", "support",
        ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), ratio(tp, tp + fp + fn).alias("jaccard"),
        ratio(fp, fp + tn).alias("fpr"), ratio(fn, fn + tp).alias("fnr"), ratio(tn, tn + fp).alias("tnr"),
    )


def averaged_metrics(df: DataFrame, label: str, prediction: str, *by: str) -> DataFrame:
    """(by, accuracy, balanced_accuracy, precision/recall/f1/jaccard x macro/micro/weighted, n)."""
    per = class_metrics(df, label, prediction, *by)
    out = [F.try_divide(F.sum("tp"), F.sum("support")).alias("accuracy"), F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy"), F.sum("support").alias("n")]
    for m in ("precision", "recall", "f1", "jaccard"):
        out += [F.avg(m).alias(f"{m}_macro"), F.try_divide(F.sum(F.col(m) * F.col("support")), F.sum("support")).alias(f"{m}_weighted")]
    micro = {"precision": ("tp", "fp"), "recall": ("tp", "fn")}
    out += [F.try_divide(F.sum("tp"), F.sum(F.col(a) + F.col(b))).alias(f"{m}_micro") for m, (a, b) in micro.items()]
    return per.groupBy(*by).agg(*out) if by else per.agg(*out)


def regression_metrics(df: DataFrame, label: str, prediction: str, *by: str) -> DataFrame:
    """(by, mse, rmse, mae, r2, max_error, explained_variance, median_absolute_error, n)."""
    rows = df.where(F.col(label).isNotNull() & F.col(prediction).isNotNull()).select(*by, F.col(label).cast("double").alias("y"), F.col(prediction).cast("double").alias("p"))
    e = F.col("y") - F.col("p")
    aggs = [
        F.avg(e * e).alias("mse"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), (1 - F.try_divide(F.avg(e * e), F.var_pop("y"))).alias("r2"),
        F.max(F.abs(e)).alias("max_error"), (1 - F.try_divide(F.var_pop(e), F.var_pop("y"))).alias("explained_variance"), F.count("*").alias("n"),
    ]
    found = rows.groupBy(*by).agg(*aggs) if by else rows.agg(*aggs)
    median = exact_quantiles(rows.withColumn("e", F.abs(e)), list(by), "e", [0.5]).select(*by, F.col("q")[0].alias("median_absolute_error"))
    return found.join(median, list(by), "left") if by else found.join(F.broadcast(median), F.lit(True), "left")


def regression_errors(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """(mean_error, median_error, kurtosis, rmse, systematic_ratio): the distribution of label less prediction."""
    e = F.col(label).cast("double") - F.col(prediction).cast("double")
    rows = df.select(e.alias("e")).where(F.col("e").isNotNull())
    found = rows.agg(F.avg("e").alias("mean_error"), F.kurtosis("e").alias("kurtosis"), F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse"))
    found = found.join(F.broadcast(exact_quantiles(rows, [], "e", [0.5]).select(F.col("q")[0].alias("median_error"))), F.lit(True), "left")
    return found.withColumn("systematic_ratio", F.try_divide(F.abs("mean_error"), F.col("rmse")))


def train_test_performance(train: DataFrame, test: DataFrame, label: str, prediction: str) -> DataFrame:
    """The averaged metrics of both tables, by ``dataset``."""
    both = train.select(F.lit("train").alias("dataset"), label, prediction).unionByName(test.select(F.lit("test").alias("dataset"), label, prediction))
    return averaged_metrics(both, label, prediction, "dataset")


def models_performance(df: DataFrame, label: str, models: dict[str, str]) -> DataFrame:
    """The averaged metrics of several prediction columns, by ``model``, from one pass."""
    cells = F.array(*(F.struct(F.lit(m).alias("model"), F.col(c).cast("string").alias("__p")) for m, c in models.items()))
    return averaged_metrics(df.select(F.col(label).alias("__y"), F.inline(cells)), "__y", "__p", "model")


def roc_auc(df: DataFrame, label: str, scores: dict[str, str]) -> DataFrame:
    """(class, auc): one against the rest, from a probability column for each class."""
    cells = F.array(*(F.struct(F.lit(c).alias("class"), F.col(p).cast("double").alias("s"), (F.col(label).cast("string") == c).cast("int").alias("y")) for c, p in scores.items()))
    rows = df.where(F.col(label).isNotNull()).select(F.inline(cells)).where(F.col("s").isNotNull())
    return kernels.auc(rows, "y", "s", ["class"])


def calibration_score(df: DataFrame, label: str, scores: dict[str, str]) -> DataFrame:
    """(class, brier, log_loss): of each class's probability."""
    cells = F.array(*(F.struct(F.lit(c).alias("class"), F.col(p).cast("double").alias("s"), (F.col(label).cast("string") == c).cast("double").alias("y")) for c, p in scores.items()))
    rows = df.where(F.col(label).isNotNull()).select(F.inline(cells))
    s = F.greatest(F.least("s", F.lit(1 - 1e-15)), F.lit(1e-15))
    loss = -(F.col("y") * F.log(s) + (1 - F.col("y")) * F.log(1 - s))
    return rows.groupBy("class").agg(F.avg(F.pow(F.col("s") - F.col("y"), 2)).alias("brier"), F.avg(loss).alias("log_loss"))


def _class_scores(df: DataFrame, label: str, scores: dict[str, str]) -> DataFrame:
    """(class, s, y): each row's score of each class and whether that is its label; without rows that lack either, or whose score is NaN."""
    cells = F.array(*(F.struct(F.lit(c).alias("class"), F.col(f"`{s}`").cast("double").alias("s"), (F.col(f"`{label}`").cast("string") == c).cast("long").alias("y")) for c, s in scores.items()))
    return df.select(F.inline(cells)).where(F.col("s").isNotNull() & ~F.isnan("s") & F.col("y").isNotNull())


def roc_curve(df: DataFrame, label: str, scores: dict[str, str]) -> DataFrame:
    """(class, threshold, tpr, fpr): a point for each distinct score of a class, where rows at or above it are said to be of the class; a rate of no rows is null.

    The points of all classes come from one rank index over counted scores.
    """
    counts = _class_scores(df, label, scores).groupBy("class", (0 - F.col("s")).alias("down")).agg(F.count("*").alias("n"), F.sum("y").alias("p"))
    ran = running_sums(counts, ["class"], "down", {"seen": "n", "hit": "p"}, totals=True)
    return ran.select("class", (0 - F.col("down")).alias("threshold"), F.try_divide("hit", "hit_n").alias("tpr"), F.try_divide(F.col("seen") - F.col("hit"), F.col("seen_n") - F.col("hit_n")).alias("fpr"))


def calibration_curve(df: DataFrame, label: str, scores: dict[str, str], bins: int = 10) -> DataFrame:
    """(class, bin, mean_score, positives, n): of equal parts of 0 to 1, each with its upper edge; parts without rows have no row."""
    part = sum(((F.col("s") > k / bins).cast("int") for k in range(1, bins)), F.lit(0))
    return _class_scores(df, label, scores).groupBy("class", part.alias("bin")).agg(F.avg("s").alias("mean_score"), F.avg("y").alias("positives"), F.count("*").alias("n"))


def gain(base: Column, score: Column, perfect: Column, most: float = 50.0) -> Column:
    """How much of the way from a simple model's score to the perfect one a score goes, between -most and most."""
    return F.when(perfect == base, F.when(score == base, F.lit(0.0)).otherwise(F.lit(-most))).otherwise(F.greatest(F.lit(-most), F.least(F.lit(most), (score - base) / (perfect - base))))


def simple_model_comparison(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """(class, score, simple, gain): f1 of a model against that of always saying the most frequent label (ties: the smallest)."""
    counts = df.where(F.col(label).isNotNull()).groupBy(F.col(label).cast("string").alias("class")).agg(F.count("*").alias("n"))
    top = counts.agg(F.max("n").alias("most"), F.sum("n").alias("t"))
    first = counts.crossJoin(F.broadcast(top)).where("n = most").agg(F.min("class").alias("said"))
    simple = counts.crossJoin(F.broadcast(top.select("t"))).crossJoin(F.broadcast(first))
    f1 = F.when(F.col("class") == F.col("said"), 2 * F.col("n") / (F.col("n") + F.col("t"))).otherwise(F.lit(0.0))
    own = class_metrics(df, label, prediction).select("class", F.col("f1").alias("score"))
    both = own.join(simple.select("class", f1.alias("simple")), "class", "left").withColumn("simple", F.coalesce("simple", F.lit(0.0)))
    return both.withColumn("gain", gain(F.col("simple"), F.col("score"), F.lit(1.0)))


def segment_performance(df: DataFrame, feature_1: str, feature_2: str, label: str, prediction: str, max_segments: int = 10) -> DataFrame:
    """(segment_1, segment_2, accuracy, n): over a grid of quantile bins of two numbers."""
    edges = {c: kernels.quantile_edges(df, c, max_segments) for c in (feature_1, feature_2)}
    rows = df.select(kernels.segment(feature_1, edges[feature_1]).alias("segment_1"), kernels.segment(feature_2, edges[feature_2]).alias("segment_2"), (F.col(label) == F.col(prediction)).cast("double").alias("hit"))
    return rows.groupBy("segment_1", "segment_2").agg(F.avg("hit").alias("accuracy"), F.count("*").alias("n"))


def performance_bias(df: DataFrame, label: str, prediction: str, protected: str, control: str | None = None, min_size: int = 5) -> DataFrame:
    """(protected, control, score, baseline, n, diff): accuracy of each subgroup against its baseline; null under ``min_size`` rows."""
    hit = F.avg((F.col(label) == F.col(prediction)).cast("double"))
    keys = [F.col(protected).cast("string").alias("protected"), (F.col(control).cast("string") if control else F.lit("all")).alias("control")]
    groups = df.groupBy(*keys).agg(hit.alias("score"), F.count("*").alias("n"))
    base = groups.groupBy("control").agg((F.sum(F.col("score") * F.col("n")) / F.sum("n")).alias("baseline"))
    joined = groups.join(base, "control").withColumn("score", F.when(F.col("n") >= min_size, F.col("score")))
    return joined.select("protected", "control", "score", "baseline", "n", (F.col("score") - F.col("baseline")).alias("diff"))


def neg_squared_error(label: str, prediction: str) -> Column:
    """A sample's score of a regression: higher is better."""
    return -F.pow(F.col(label).cast("double") - F.col(prediction).cast("double"), 2)


def log_probability(label: str, probabilities: str, classes: list) -> Column:
    """A sample's score of a classification: the log of the probability (array in the order of ``classes``) of its label."""
    at = F.array_position(F.array(*(F.lit(str(c)) for c in classes)), F.col(label).cast("string"))
    return F.when(at > 0, F.log(F.get(F.col(probabilities), (at - 1).cast("int")) + 1e-15))


def log_loss(df: DataFrame, label: str, probabilities: str, classes: list) -> DataFrame:
    """(log_loss) over all classes."""
    return df.agg(F.avg(-log_probability(label, probabilities, classes)).alias("log_loss"))


def multilabel_rows(df: DataFrame, label: str, prediction: str, classes: list[str]) -> DataFrame:
    """(class, y, p): a row per sample and class of 0/1 arrays, for the class metrics of multilabel tasks."""
    names = F.array(*(F.lit(c) for c in classes))
    return df.select(F.inline(F.arrays_zip(names.alias("class"), F.col(label).alias("y"), F.col(prediction).alias("p")))).toDF("class", "y", "p")


#: Metrics by name: where they are found, and whether more is better.
METRICS = {
    **{m: (averaged_metrics, True) for m in ("accuracy", "balanced_accuracy", "precision_macro", "precision_micro", "precision_weighted", "recall_macro", "recall_micro", "recall_weighted", "f1_macro", "f1_weighted", "jaccard_macro", "jaccard_weighted")},
    **{m: (class_metrics, True) for m in ("precision", "recall", "f1", "jaccard", "tnr")},
    **{m: (class_metrics, False) for m in ("fpr", "fnr")},
    **{m: (regression_metrics, False) for m in ("mse", "rmse", "mae", "max_error", "median_absolute_error")},
    **{m: (regression_metrics, True) for m in ("r2", "explained_variance")},
}


def score(df: DataFrame, label: str, prediction: str, metrics: list[str]) -> DataFrame:
    """(metric, class, value): named metrics, each family computed once."""
    out = None
    for family in dict.fromkeys(METRICS[m][0] for m in metrics):
        names = [m for m in metrics if METRICS[m][0] is family]
        found = family(df, label, prediction)
        owner = F.col("class") if family is class_metrics else F.lit(None).cast("string")
        rows = found.select(owner.alias("class"), F.inline(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in names)))).select("metric", "class", "value")
        out = rows if out is None else out.unionByName(rows)
    return out


def inference_time(model, df: DataFrame, n: int = 1000) -> float:
    """Seconds per row that ``model.transform`` takes on at most ``n`` rows (a sampling operator)."""
    import time

    rows = df.limit(n).cache()
    count = rows.count()
    began = time.perf_counter()
    model.transform(rows).write.format("noop").mode("overwrite").save()
    seconds = time.perf_counter() - began
    rows.unpersist()
    return seconds / max(count, 1)


def model_info(model) -> dict:
    """The type of a model (the last stage of a pipeline) and its parameters."""
    last = model.stages[-1] if getattr(model, "stages", None) else model
    return {"type": type(last).__name__, "parameters": {p.name: v for p, v in last.extractParamMap().items()}}
