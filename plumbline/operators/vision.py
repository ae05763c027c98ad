"""Image properties and box metrics. Images are arrays of pixels; decoding files is the caller's part."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import kept

PROPERTIES = "aspect_ratio double, area long, brightness double, rms_contrast double, mean_red double, mean_green double, mean_blue double, texture_level double"


def image_properties(df: DataFrame, pixels: str = "pixels", height: str = "height", width: str = "width", channels: str = "channels") -> DataFrame:
    """``df`` less the pixels, with the properties of each image (flat array of pixels, rows first). Gray images have no colour shares."""
    kept = [c for c in df.columns if c != pixels]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*kept).schema.fields), PROPERTIES])

    def one(flat, h: int, w: int, c: int) -> tuple:
        image = np.asarray(flat, float).reshape(h, w, c)
        gray = image[..., 0] if c == 1 else image[..., :3] @ np.array([0.2125, 0.7154, 0.0721])
        total = image.sum(2)
        shares = [None] * 3 if c == 1 else [float(np.divide(image[..., k], total, out=np.full(total.shape, 1 / 3), where=total > 0).mean()) for k in range(3)]
        padded = np.pad(gray, 1, mode="reflect" if min(h, w) > 1 else "edge")
        edges = padded[:-2, 1:-1] + padded[2:, 1:-1] + padded[1:-1, :-2] + padded[1:-1, 2:] - 4 * gray
        return (h / w, h * w, float(gray.mean()), float(gray.std()), *shares, float(edges.var()))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [p.split()[0] for p in PROPERTIES.split(", ")]
        for part in parts:
            rows = [one(*x) for x in zip(part[pixels], part[height], part[width], part[channels])]
            found = pd.DataFrame(rows, columns=names)
            yield pd.concat([part[kept].reset_index(drop=True), found], axis=1)

    return df.mapInPandas(run, schema)


def box_iou(a: Column, b: Column) -> Column:
    """Intersection over union of two boxes (x, y, w, h)."""
    w = F.greatest(F.lit(0.0), F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"]))
    h = F.greatest(F.lit(0.0), F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"]))
    inside = w * h
    return F.coalesce(F.try_divide(inside, a["w"] * a["h"] + b["w"] * b["h"] - inside), F.lit(0.0))


def convert_box(a: Column, b: Column, c: Column, d: Column, notation: str) -> Column:
    """A box in xywh from ``xywh``, ``xyxy`` or ``cxcywh`` numbers."""
    x, y, w, h = {"xywh": (a, b, c, d), "xyxy": (a, b, c - a, d - b), "cxcywh": (a - c / 2, b - d / 2, c, d)}[notation]
    return F.struct(x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"))


#: Limits of a box's area: small below the first, large from the second on.
AREAS = (32.0**2, 96.0**2)
#: The thresholds of overlap that averages go over.
IOUS = (0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95)


def match_boxes(df: DataFrame, image: str, labels: str, predictions: str, ious: float | tuple[float, ...] = 0.5, most: int | None = None) -> DataFrame:
    """(image, iou, cls, conf, area, tp) of each predicted box, and one row with conf null per label that none matched.

    ``labels`` is array<struct<cls,x,y,w,h>>, ``predictions`` has conf as well.
    Per image and class, predictions in falling confidence (ties in their
    order) take the free label they overlap most, if by the threshold at
    least; with ``most``, an image's first ones only. ``area`` is the matched
    label's, or the box's own. An image is one row, so the matching needs no
    shuffle; its overlaps are computed once for all thresholds.
    """
    return _matched(df, image, labels, predictions, ious, most).drop("place")


def _matched(df: DataFrame, image: str, labels: str, predictions: str, ious: float | tuple[float, ...], most: int | None = None) -> DataFrame:
    """What :func:`match_boxes` gives, and the place of each predicted box among its image's, from 1 on, null of labels.

    A box's match depends on those before it only: the first boxes of an image match as they would alone.
    """
    limits = (ious,) if isinstance(ious, float) else tuple(ious)
    g, p = F.coalesce(F.col(labels), F.array().cast(df.schema[labels].dataType)), F.coalesce(F.col(predictions), F.array().cast(df.schema[predictions].dataType))
    at = F.sequence(F.lit(1), F.size(p))
    ranked = F.when(F.size(p) > 0, F.array_sort(F.transform(at, lambda k: F.struct((-F.element_at(p, k)["conf"].cast("double")).alias("down"), k.alias("k")))))
    ranked = F.coalesce(F.slice(ranked, 1, most) if most else ranked, F.array().cast("array<struct<down:double,k:int>>"))
    rows = df.select(F.col(image).alias("image"), g.alias("g"), p.alias("p"), ranked.alias("r"))
    # Per prediction in rank order: how far it overlaps each label of its class.
    share = F.transform("r", lambda x: F.transform("g", lambda t: F.when(t["cls"] == F.element_at(F.col("p"), x["k"])["cls"], box_iou(F.element_at(F.col("p"), x["k"]), t)).otherwise(F.lit(-1.0))))
    rows = rows.withColumn("o", share).withColumn("iou", F.explode(F.array(*(F.lit(float(x)) for x in limits))))
    start = F.array().cast("array<int>")  # the label that each prediction takes, 0 for none

    def take(taken: Column, over: Column) -> Column:
        free = F.filter(F.transform(over, lambda v, i: F.struct(v.alias("v"), (-i).alias("down"))), lambda c: (c["v"] >= F.col("iou")) & ~F.array_contains(taken, 1 - c["down"]))
        return F.concat(taken, F.array(F.coalesce(1 - F.array_max(free)["down"], F.lit(0))))

    rows = rows.withColumn("t", F.aggregate("o", start, take))
    area = lambda b: (b["w"] * b["h"]).cast("double")
    said = F.transform(
        F.arrays_zip("r", "t"),
        lambda z, i: F.struct(
            F.element_at(F.col("p"), z["r"]["k"])["cls"].cast("long").alias("cls"), (-z["r"]["down"]).alias("conf"),
            F.when(z["t"] > 0, area(F.try_element_at(F.col("g"), z["t"]))).otherwise(area(F.element_at(F.col("p"), z["r"]["k"]))).alias("area"), (z["t"] > 0).cast("int").alias("tp"), (i + 1).alias("place"),
        ),
    )
    missed = F.transform(
        F.filter(F.transform("g", lambda t, i: F.struct(t.alias("t"), i.alias("i"))), lambda c: ~F.array_contains(F.col("t"), c["i"] + 1)),
        lambda c: F.struct(c["t"]["cls"].cast("long").alias("cls"), F.lit(None).cast("double").alias("conf"), area(c["t"]).alias("area"), F.lit(0).alias("tp"), F.lit(None).cast("int").alias("place")),
    )
    return rows.select("image", "iou", F.inline(F.concat(said, missed)))


def detection_metrics(df: DataFrame, image: str, labels: str, predictions: str, iou: float = 0.5, confidence: float = 0.5) -> DataFrame:
    """(cls, tp, fp, fn, precision, recall, f1, fpr, fnr); fpr is fp / (tp + fn), and what a class without labels lacks is -1."""
    boxes = match_boxes(df.withColumn(predictions, F.filter(predictions, lambda p: p["conf"] >= confidence)), image, labels, predictions, iou)
    per = boxes.groupBy("cls").agg(F.sum("tp").alias("tp"), F.sum((F.col("conf").isNotNull() & (F.col("tp") == 0)).cast("long")).alias("fp"), F.sum(F.col("conf").isNull().cast("long")).alias("fn"))
    tp, fp, fn = (F.col(c) for c in ("tp", "fp", "fn"))
    real = lambda c: F.when(tp + fn > 0, c).otherwise(F.lit(-1.0))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return per.select("cls", "tp", "fp", "fn", real(ratio(tp, tp + fp)).alias("precision"), real(ratio(tp, tp + fn)).alias("recall"), real(ratio(2 * tp, 2 * tp + fp + fn)).alias("f1"), real(ratio(fp, tp + fn)).alias("fpr"), real(ratio(fn, tp + fn)).alias("fnr"))


def detection_averages(per_class: DataFrame) -> DataFrame:
    """(metric, average, value): macro, micro and weighted means over the classes with labels of :func:`detection_metrics`."""
    tp, fp, fn = (F.sum(c) for c in ("tp", "fp", "fn"))
    real = per_class.where("tp + fn > 0")
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    micro = {"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn), "fpr": ratio(fp, tp + fn), "fnr": ratio(fn, tp + fn)}
    cells = []
    for m, whole in micro.items():
        cells += [(m, "macro", F.avg(m)), (m, "micro", whole), (m, "weighted", ratio(F.sum(F.col(m) * (F.col("tp") + F.col("fn"))), tp + fn))]
    one = real.agg(*(c.alias(f"{m}|{a}") for m, a, c in cells))
    return one.select(F.inline(F.array(*(F.struct(F.lit(m).alias("metric"), F.lit(a).alias("average"), F.col(f"`{m}|{a}`").cast("double").alias("value")) for m, a, _ in cells))))


def _precision_points(counts: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """(by, positives) and (by, precision, recall) at each distinct confidence, of counts (by, conf, n, tp) of boxes that are written once: both read them."""
    from ..functions.running import running_sums

    positives = counts.groupBy(*by).agg(F.sum(F.when(F.col("conf").isNull(), F.col("n")).otherwise(F.col("tp"))).alias("positives"))
    at = counts.where("conf is not null").select(*by, (-F.col("conf")).alias("down"), "n", F.col("tp").alias("p"))
    ran = running_sums(at, by, "down", {"seen": "n", "hit": "p"}).join(positives, by)
    return positives, ran.select(*by, (F.col("hit") / F.col("seen")).alias("precision"), F.try_divide(F.col("hit"), F.col("positives")).alias("recall"))


def _counted(boxes: DataFrame, *by: str | Column) -> DataFrame:
    """(by, conf, n, tp) of boxes."""
    return boxes.groupBy(*by, "conf").agg(F.count("*").alias("n"), F.sum("tp").alias("tp"))


def mean_average_precision(df: DataFrame, image: str, labels: str, predictions: str, ious: tuple[float, ...] = IOUS) -> DataFrame:
    """(cls, iou, ap): precision over recall at 101 points, all thresholds from one matching."""
    counts = kept(_counted(match_boxes(df, image, labels, predictions, ious), "cls", "iou"))
    positives, points = _precision_points(counts, ["cls", "iou"])
    best = points.select("cls", "iou", "precision", F.explode(F.when(F.col("recall").isNotNull(), F.sequence(F.lit(0), F.floor(F.col("recall") * 100 + 1e-9).cast("int")))).alias("k")).groupBy("cls", "iou", "k").agg(F.max("precision").alias("best"))
    ap = best.groupBy("cls", "iou").agg((F.sum("best") / 101).alias("ap"))
    return positives.join(ap, ["cls", "iou"], "left").select("cls", "iou", F.coalesce("ap", F.lit(0.0)).alias("ap"))


def box_size(area: Column, areas: tuple[float, float] = AREAS) -> Column:
    return F.when(area < areas[0], "small").when(area < areas[1], "medium").otherwise("large")


def average_precision_report(df: DataFrame, image: str, labels: str, predictions: str, areas: tuple[float, float] = AREAS, ious: tuple[float, ...] = IOUS) -> DataFrame:
    """(size, map, ap_50, ap_75): means over the classes, for all boxes and those of each size."""
    by = ["size", "cls", "iou"]
    sized = kept(_counted(match_boxes(df, image, labels, predictions, ious), box_size(F.col("area"), areas).alias("size"), "cls", "iou"))
    whole = sized.groupBy("cls", "iou", "conf").agg(F.sum("n").alias("n"), F.sum("tp").alias("tp")).withColumn("size", F.lit("all"))
    positives, points = _precision_points(kept(sized.unionByName(whole)), by)
    best = points.select(*by, "precision", F.explode(F.when(F.col("recall").isNotNull(), F.sequence(F.lit(0), F.floor(F.col("recall") * 100 + 1e-9).cast("int")))).alias("k")).groupBy(*by, "k").agg(F.max("precision").alias("best"))
    ap = positives.where("positives > 0").join(best.groupBy(*by).agg((F.sum("best") / 101).alias("ap")), by, "left").withColumn("ap", F.coalesce("ap", F.lit(0.0)))
    at = lambda x: F.avg(F.when(F.abs(F.col("iou") - x) < 1e-9, F.col("ap")))
    return ap.groupBy("size").agg(F.avg("ap").alias("map"), at(0.5).alias("ap_50"), at(0.75).alias("ap_75"))


def average_recall_report(df: DataFrame, image: str, labels: str, predictions: str, most: tuple[int, ...] = (1, 10, 100), areas: tuple[float, float] = AREAS, ious: tuple[float, ...] = IOUS) -> DataFrame:
    """(size, most, recall): the mean over classes and thresholds of the share of labels that an image's first ``most`` boxes find."""
    if not most:
        raise ValueError("most must name at least one number of boxes")
    # Boxes that match nothing count for neither sum, so the labels of a size are the same for all numbers.
    boxes = _matched(df, image, labels, predictions, ious, max(most))
    found = [F.sum(F.when(F.col("place") <= k, F.col("tp")).otherwise(0)).alias(f"tp{k}") for k in most]
    per = boxes.groupBy(box_size(F.col("area"), areas).alias("size"), "cls", "iou").agg(F.sum(F.when(F.col("conf").isNull(), 1).otherwise(F.col("tp"))).alias("real"), *found)
    both = per.select(F.explode(F.array(F.lit("all"), F.col("size"))).alias("size"), "cls", "iou", "real", *(f"tp{k}" for k in most)).groupBy("size", "cls", "iou").agg(F.sum("real").alias("real"), *(F.sum(f"tp{k}").alias(f"tp{k}") for k in most))
    means = both.where("real > 0").groupBy("size").agg(*(F.avg(F.col(f"tp{k}") / F.col("real")).alias(f"r{k}") for k in most))
    return means.select("size", F.inline(F.array(*(F.struct(F.lit(k).alias("most"), F.col(f"r{k}").alias("recall")) for k in most))))


def per_image_iou(df: DataFrame, image: str, labels: str, predictions: str) -> DataFrame:
    """(image, mean_iou): the mean over predicted boxes of the largest overlap with a label of their class; 0 without boxes on either side."""
    best = F.transform(F.coalesce(F.col(predictions), F.array()), lambda p: F.coalesce(F.array_max(F.transform(F.filter(labels, lambda t: t["cls"] == p["cls"]), lambda t: box_iou(p, t))), F.lit(0.0)))
    mean = F.when(F.size(best) > 0, F.aggregate(best, F.lit(0.0), lambda a, x: a + x) / F.size(best)).otherwise(F.lit(0.0))
    return df.select(F.col(image).alias("image"), mean.alias("mean_iou"))


def simple_model_comparison(df: DataFrame, label: str, prediction: str, strategy: str = "most_frequent", key: list[str] | None = None) -> DataFrame:
    """(class, score, simple, perfect, gain): f1 of image classes against a model that says the commonest one (or draws labels) and the perfect one."""
    from . import evaluation, models

    if strategy == "most_frequent":
        return evaluation.simple_model_comparison(df, label, prediction).withColumn("perfect", F.lit(1.0))
    drawn = models.simple_predictions(df, label, key or df.columns, strategy)
    own = evaluation.class_metrics(df, label, prediction).select("class", F.col("f1").alias("score"))
    both = own.join(evaluation.class_metrics(drawn, label, "simple").select("class", F.col("f1").alias("simple")), "class", "left").withColumn("simple", F.coalesce("simple", F.lit(0.0))).withColumn("perfect", F.lit(1.0))
    return both.withColumn("gain", evaluation.gain(F.col("simple"), F.col("score"), F.col("perfect")))


def top_confusions(cells: DataFrame, k: int) -> DataFrame:
    """The ``k`` largest cells off the diagonal (a top-k report; ties by name)."""
    return cells.where(F.col("label") != F.col("prediction")).orderBy(F.desc("n"), "label", "prediction").limit(k)


def classes_to_show(metrics: DataFrame, metric: str, n: int, show: str = "largest", size: str = "support", dataset: str | None = None) -> list[str]:
    """Names of ``n`` classes: the largest, smallest, best, worst, or random ones by the hash of their names (a top-k report)."""
    rows = metrics.where(F.col("dataset") == dataset) if dataset else metrics
    order = {"largest": F.desc(size), "smallest": F.asc(size), "best": F.desc(metric), "worst": F.asc(metric), "random": F.xxhash64("class").asc()}[show]
    return [r["class"] for r in rows.orderBy(order, "class").limit(n).collect()]


def metric_rows(results: dict[str, dict], dataset: str, names: dict | None = None) -> list[dict]:
    """(dataset, metric, class, class_name, value) rows of per-class results; a number stands for no class."""
    out = []
    for metric, values in results.items():
        pairs = values.items() if isinstance(values, dict) else [(None, values)]
        out += [{"dataset": dataset, "metric": metric, "class": c, "class_name": (names or {}).get(c, c), "value": v} for c, v in pairs if v is None or v != -1]
    return out


# --- images ------------------------------------------------------------------


def image_size(height: str = "height", width: str = "width") -> Column:
    return F.struct(F.col(height).alias("height"), F.col(width).alias("width"))


def image_dimension(channels: str = "channels") -> Column:
    return F.col(channels)


def image_hash(pixels: str = "pixels") -> Column:
    """Equal images have equal hashes."""
    return F.xxhash64(pixels)


def sample_pixels(pixels: str, channels: str, n: int, seed: int = 42) -> Column:
    """At most ``n`` whole pixels of a flat image, spread by the hash of their places: a sampling operator."""
    c = F.col(channels)
    places = F.sequence(F.lit(0), (F.size(pixels) / c).cast("int") - 1)
    drawn = F.slice(F.array_sort(F.transform(places, lambda i: F.struct(F.xxhash64(F.lit(seed), i).alias("h"), i.alias("i")))), 1, n)
    kept = F.flatten(F.transform(F.array_sort(F.transform(drawn, lambda x: x["i"])), lambda i: F.slice(pixels, (i * c + 1).cast("int"), c.cast("int"))))
    return F.when(F.size(pixels) > n * c, kept).otherwise(F.col(pixels))


def crop(pixels: str, width: str, channels: str, x: Column, y: Column, w: Column, h: Column) -> Column:
    """The pixels of a box of a flat image, which lies inside it."""
    c = F.col(channels)
    return F.when((w > 0) & (h > 0), F.flatten(F.transform(F.sequence(y, y + h - 1), lambda r: F.slice(pixels, ((r * F.col(width) + x) * c + 1).cast("int"), (w * c).cast("int"))))).otherwise(F.array().cast("array<double>"))


def crops(df: DataFrame, boxes: str, pixels: str = "pixels", width: str = "width", channels: str = "channels") -> DataFrame:
    """``df`` with a row per box: its class as ``cls``, and its pixels, height and width in place of the image's."""
    rows = df.withColumn("__box", F.explode(boxes))
    whole = lambda n: F.col("__box")[n].cast("int")
    cut = rows.withColumn("__cut", crop(pixels, width, channels, whole("x"), whole("y"), whole("w"), whole("h")))
    return cut.withColumn("cls", F.col("__box")["cls"]).withColumn(pixels, F.col("__cut")).withColumn("height", whole("h")).withColumn(width, whole("w")).drop("__box", "__cut").where(F.size(pixels) > 0)


def property_label_rows(df: DataFrame, task: str, label: str, pixels: str = "pixels", height: str = "height", width: str = "width", channels: str = "channels") -> DataFrame:
    """Image properties with the label they may betray: of each image by class, or of each box's part of it."""
    if task == "detection":
        return image_properties(crops(df, label, pixels, width, channels).drop(label), pixels, "height", width, channels)
    return image_properties(df, pixels, height, width, channels)


def evaluate_properties(df: DataFrame, properties: dict[str, Column]) -> DataFrame:
    """``df`` with each named property as a column, of an image, a label or a prediction; arrays can be flattened."""
    return df.select("*", *(c.alias(n) for n, c in properties.items()))


def flatten_properties(df: DataFrame, name: str) -> DataFrame:
    """A row per value of a property that is a list."""
    return df.withColumn(name, F.explode_outer(name))


def predicted_class(probabilities: str) -> Column:
    """The place of the largest probability, the first of equal ones."""
    return (F.array_position(probabilities, F.array_max(probabilities)) - 1).cast("int")


def mask_classes(mask: str) -> Column:
    """The classes of a flat mask."""
    return F.array_sort(F.array_distinct(mask))


def mask_class_count(mask: str) -> Column:
    return F.size(F.array_distinct(mask))


def mask_areas(mask: str) -> Column:
    """map of class -> pixels."""
    classes = mask_classes(mask)
    return F.map_from_arrays(classes, F.transform(classes, lambda c: F.size(F.filter(mask, lambda v: v == c))))


def predicted_mask(probabilities: str, classes: int) -> Column:
    """The flat mask of the most probable classes, from flat probabilities (class by class)."""
    p = F.col(probabilities)
    n = (F.size(p) / classes).cast("int")
    one = lambda i: F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda k: F.get(p, (k * n + i).cast("int")))
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: (F.array_position(one(i), F.array_max(one(i))) - 1).cast("int")))


def class_counts(df: DataFrame, label: str, task: str = "classification") -> DataFrame:
    """(cls, n): images of a class, boxes of a class, or images with a class in their mask."""
    if task == "detection":
        return box_classes(df, label)
    column = F.explode(mask_classes(label)) if task == "segmentation" else F.col(label)
    return df.where(F.col(label).isNotNull()).select(column.alias("cls")).groupBy("cls").agg(F.count("*").alias("n"))


def predicted_class_counts(df: DataFrame, prediction: str, task: str = "classification") -> DataFrame:
    """(cls, n) of predictions: the most probable class, boxes, or masks."""
    if task == "classification":
        df, prediction = df.select(predicted_class(prediction).alias("__c")), "__c"
    return class_counts(df, prediction, task)


def parse_notation(notation: str) -> dict:
    """What a notation of boxes says: ``label`` before or after, ``normalized``, and one of xywh, xyxy, cxcywh; parts joined by - or _."""
    parts = [p for p in notation.lower().replace("_", "-").split("-") if p]
    if any(p not in ("label", "l", "n", "normalized", "xywh", "xyxy", "cxcywh") for p in parts):
        raise ValueError(f"unknown box notation: {notation}")
    boxes = [p for p in parts if p in ("xywh", "xyxy", "cxcywh")]
    if len(boxes) != 1 or len(parts) != len(set(parts)):
        raise ValueError(f"a notation has one of xywh, xyxy and cxcywh: {notation}")
    labels = [i for i, p in enumerate(parts) if p in ("label", "l")]
    if labels and labels[0] not in (0, len(parts) - 1):
        raise ValueError(f"the label is first or last: {notation}")
    return {"boxes": boxes[0], "label": None if not labels else "first" if labels[0] == 0 else "last", "normalized": any(p in ("n", "normalized") for p in parts)}


def convert_boxes(rows: str, notation: str, image_width: str | None = None, image_height: str | None = None) -> Column:
    """Arrays of numbers in a notation as array<struct<cls,x,y,w,h>> in pixels."""
    said = parse_notation(notation)
    if said["normalized"] and not (image_width and image_height):
        raise ValueError("normalized boxes need the images' sizes")
    first = 1 if said["label"] == "first" else 0

    def one(r: Column) -> Column:
        n = [r[first + k].cast("double") for k in range(4)]
        if said["normalized"]:
            n = [v * F.col(image_width if k % 2 == 0 else image_height) for k, v in enumerate(n)]
        box = convert_box(*n, said["boxes"])
        cls = r[0] if said["label"] == "first" else r[4] if said["label"] == "last" else F.lit(0)
        return F.struct(cls.cast("long").alias("cls"), *(box[k].alias(k) for k in "xywh"))

    return F.transform(rows, one)


def mask_counts(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """(cls, tp, real, said): pixels of each class over all masks."""
    rows = df.select(F.inline(F.arrays_zip(F.col(label).alias("g"), F.col(prediction).alias("p")))).toDF("g", "p").groupBy("g", "p").agg(F.count("*").alias("n"))
    sides = rows.select(F.inline(F.array(F.struct(F.col("g").alias("cls"), F.col("n").alias("real"), F.lit(0).cast("long").alias("said"), F.when(F.col("g") == F.col("p"), F.col("n")).otherwise(F.lit(0)).alias("tp")), F.struct(F.col("p").alias("cls"), F.lit(0).cast("long").alias("real"), F.col("n").alias("said"), F.lit(0).cast("long").alias("tp")))))
    return sides.groupBy("cls").agg(F.sum("tp").alias("tp"), F.sum("real").alias("real"), F.sum("said").alias("said"))


def per_image_dice(df: DataFrame, image: str, label: str, prediction: str, smooth: float = 1e-3) -> DataFrame:
    """(image, dice): the mean over the classes in an image's masks."""
    rows = df.select(F.col(image).alias("image"), F.inline(F.arrays_zip(F.col(label).alias("g"), F.col(prediction).alias("p")))).toDF("image", "g", "p")
    sides = rows.select("image", F.inline(F.array(F.struct(F.col("g").alias("cls"), F.lit(1).alias("n"), (F.col("g") == F.col("p")).cast("int").alias("both")), F.struct(F.col("p").alias("cls"), F.lit(1).alias("n"), F.lit(0).alias("both")))))
    per = sides.groupBy("image", "cls").agg(F.sum("n").alias("n"), F.sum("both").alias("b"))
    return per.groupBy("image").agg(F.avg((2 * F.col("b") + smooth) / (F.col("n") + smooth)).alias("dice"))


def segmentation_metrics(df: DataFrame, label: str, prediction: str, smooth: float = 1e-3) -> DataFrame:
    """(cls, dice, iou): means over the images that have the class in label or prediction; both are flat arrays of class ids."""
    # Numbered before the arrays are taken apart, so that a number stands for an image.
    rows = df.select(F.arrays_zip(F.col(label).alias("g"), F.col(prediction).alias("p")).alias("z")).withColumn("i", F.monotonically_increasing_id()).select("i", F.inline("z")).toDF("i", "g", "p")
    sides = rows.select("i", F.inline(F.array(F.struct(F.col("g").alias("cls"), F.lit(1).alias("real"), F.lit(0).alias("said"), (F.col("g") == F.col("p")).cast("int").alias("both")), F.struct(F.col("p").alias("cls"), F.lit(0).alias("real"), F.lit(1).alias("said"), F.lit(0).alias("both")))))
    per = sides.groupBy("i", "cls").agg(F.sum("real").alias("g"), F.sum("said").alias("p"), F.sum("both").alias("b"))
    dice, iou = (2 * F.col("b") + smooth) / (F.col("g") + F.col("p") + smooth), (F.col("b") + smooth) / (F.col("g") + F.col("p") - F.col("b") + smooth)
    return per.groupBy("cls").agg(F.avg(dice).alias("dice"), F.avg(iou).alias("iou"))


def image_property_outliers(df: DataFrame, properties: list[str], scale: float = 1.5) -> DataFrame:
    """(feature, low, high, n_outliers, ratio) of columns that :func:`image_properties` made."""
    from .integrity import iqr_outliers

    return iqr_outliers(df, properties, (25, 75), scale)


def image_property_drift(train: DataFrame, test: DataFrame, properties: list[str]) -> DataFrame:
    from .train_test import feature_drift

    return feature_drift(train, test, properties, [])


def box_classes(df: DataFrame, boxes: str) -> DataFrame:
    """(cls, n): how many boxes of each class."""
    return df.select(F.explode(F.transform(boxes, lambda b: b["cls"])).alias("cls")).groupBy("cls").agg(F.count("*").alias("n"))


def box_properties(df: DataFrame, boxes: str) -> DataFrame:
    """``df`` with n_boxes and, per box, classes and areas."""
    return df.withColumn("n_boxes", F.size(boxes)).withColumn("classes", F.transform(boxes, lambda b: b["cls"])).withColumn("areas", F.transform(boxes, lambda b: b["w"] * b["h"]))


def new_box_labels(train: DataFrame, test: DataFrame, boxes: str) -> DataFrame:
    """(cls, n, ratio): classes of test boxes that train has none of."""
    new = box_classes(test, boxes).join(box_classes(train, boxes).select("cls"), "cls", "left_anti")
    total = test.agg(F.sum(F.size(boxes)).alias("t"))
    return new.crossJoin(F.broadcast(total)).select("cls", "n", (F.col("n") / F.col("t")).alias("ratio"))


def heatmap(df: DataFrame, pixels: str) -> DataFrame:
    """(at, mean): the mean image of images of one size; partial sums per task, a row per pixel."""
    return df.select(F.posexplode(pixels).alias("at", "v")).groupBy("at").agg(F.avg("v").alias("mean"))


def heatmap_comparison(train: DataFrame, test: DataFrame, pixels: str) -> DataFrame:
    """(at, difference): how far the mean images differ at each pixel."""
    a, b = heatmap(train, pixels).withColumnRenamed("mean", "a"), heatmap(test, pixels).withColumnRenamed("mean", "b")
    return a.join(b, "at").select("at", F.abs(F.col("a") - F.col("b")).alias("difference"))


def detection_confusion(df: DataFrame, image: str, labels: str, predictions: str, iou: float = 0.5, confidence: float = 0.3) -> DataFrame:
    """(label, prediction, n): matched boxes whatever their class, pairs of most overlap first; -1 stands for no box. Filtered boxes take no part."""
    none = lambda c: F.coalesce(F.col(c), F.array().cast(df.schema[c].dataType))
    rows = df.select(none(labels).alias("g"), F.filter(none(predictions), lambda p: p["conf"] > confidence).alias("p"))
    pairs = F.flatten(F.transform("g", lambda t, i: F.transform("p", lambda q, j: F.struct((-box_iou(q, t)).alias("down"), (i + 1).alias("i"), (j + 1).alias("j")))))
    ranked = F.array_sort(F.filter(pairs, lambda x: -x["down"] > iou))
    start = F.array().cast("array<struct<i:int,j:int>>")
    clash = lambda taken, x: F.exists(taken, lambda t: (t["i"] == x["i"]) | (t["j"] == x["j"]))
    rows = rows.withColumn("t", F.aggregate(ranked, start, lambda taken, x: F.when(clash(taken, x), taken).otherwise(F.concat(taken, F.array(F.struct(x["i"].alias("i"), x["j"].alias("j")))))))
    cls = lambda side, k: F.element_at(F.col(side), k)["cls"].cast("long")
    met = F.transform("t", lambda x: F.struct(cls("g", x["i"]).alias("label"), cls("p", x["j"]).alias("prediction")))
    lone = lambda side, n: F.filter(F.transform(side, lambda b, k: F.struct(b["cls"].cast("long").alias("c"), (k + 1).alias("k"))), lambda x: ~F.exists("t", lambda t: t[n] == x["k"]))
    nothing = F.lit(-1).cast("long")
    missed = F.transform(lone("g", "i"), lambda x: F.struct(x["c"].alias("label"), nothing.alias("prediction")))
    extra = F.transform(lone("p", "j"), lambda x: F.struct(nothing.alias("label"), x["c"].alias("prediction")))
    return rows.select(F.inline(F.concat(met, missed, extra))).groupBy("label", "prediction").agg(F.count("*").alias("n"))
