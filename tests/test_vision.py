"""Box matching, its averages, and image, label and prediction properties against plain Python."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import vision

BOX = "cls long, x double, y double, w double, h double"
SCHEMA = f"i long, g array<struct<{BOX}>>, p array<struct<{BOX}, conf double>>"


def overlap(p, g):
    w = max(0.0, min(p[1] + p[3], g[1] + g[3]) - max(p[1], g[1]))
    h = max(0.0, min(p[2] + p[4], g[2] + g[4]) - max(p[2], g[2]))
    union = p[3] * p[4] + g[3] * g[4] - w * h
    return w * h / union if union else 0.0


@pytest.fixture(scope="module")
def images():
    rng = random.Random(4)
    rows = []
    for i in range(25):
        real = [(rng.randrange(3), rng.randrange(100), rng.randrange(100), rng.choice([10, 20, 60, 120]), rng.choice([15, 40, 100])) for _ in range(rng.randrange(5))]
        said = []
        for c, x, y, w, h in real:
            for _ in range(rng.randrange(3)):
                said.append((c if rng.random() < 0.8 else rng.randrange(3), x + rng.randrange(-4, 5), y + rng.randrange(-4, 5), w + rng.randrange(0, 5), h, round(rng.random(), 3)))
        rows.append((i, [tuple(map(float, (*b,))) for b in real], [tuple(map(float, b)) for b in said]))
    rows.append((99, None, None))
    return [(i, g and [(int(b[0]), *b[1:]) for b in g], p and [(int(b[0]), *b[1:]) for b in p]) for i, g, p in rows]


@pytest.fixture(scope="module")
def boxes(spark, images):
    return spark.createDataFrame(images, SCHEMA)


def matched(images, iou, most=None):
    out = []
    for _, g, p in images:
        free = list(enumerate(g or []))
        for b in sorted(p or [], key=lambda b: -b[5])[:most]:
            same = [(overlap(b, t), -k, t) for k, t in free if t[0] == b[0]]
            best = max(same, default=None)
            hit = best is not None and best[0] >= iou
            if hit:
                free = [x for x in free if x[0] != -best[1]]
            area = best[2][3] * best[2][4] if hit else b[3] * b[4]
            out.append((b[0], b[5], area, int(hit)))
        out += [(t[0], None, t[3] * t[4], 0) for _, t in free]
    return out


@pytest.mark.parametrize("iou", [0.5, 0.75])
def test_matching_equals_brute_force(boxes, images, iou):
    got = [(r.cls, r.conf, r.area, r.tp) for r in vision.match_boxes(boxes, "i", "g", "p", (0.5, 0.75)).collect() if r.iou == iou]
    assert sorted(got, key=str) == sorted(matched(images, iou), key=str)


def test_recall_by_number_of_boxes_and_size(boxes, images):
    got = {(r.size, r.most): r.recall for r in vision.average_recall_report(boxes, "i", "g", "p", (1, 10), ious=(0.5, 0.75)).collect()}
    size = lambda a: "small" if a < 32**2 else "medium" if a < 96**2 else "large"
    for most in (1, 10):
        for s in ("all", "small", "medium", "large"):
            shares = []
            for iou in (0.5, 0.75):
                rows = [r for r in matched(images, iou, most) if s in ("all", size(r[2]))]
                for c in {r[0] for r in rows}:
                    tp = sum(r[3] for r in rows if r[0] == c)
                    real = tp + sum(r[1] is None for r in rows if r[0] == c)
                    if real:
                        shares.append(tp / real)
            if shares:
                assert got[s, most] == pytest.approx(np.mean(shares))


def test_average_precision_of_perfect_and_missing_boxes(spark):
    g = [(1, 0.0, 0.0, 10.0, 10.0), (1, 50.0, 0.0, 200.0, 100.0)]
    df = spark.createDataFrame([(1, g, [(*g[0], 0.9), (*g[1], 0.8)]), (2, g[:1], [])], SCHEMA)
    got = {r.size: r for r in vision.average_precision_report(df, "i", "g", "p").collect()}
    assert got["large"].map == 1.0 and got["small"].map == pytest.approx(51 / 101) and got["all"].ap_50 == pytest.approx(67 / 101)
    per = vision.detection_metrics(df, "i", "g", "p")
    r = per.first()
    assert (r.tp, r.fp, r.fn, r.precision, r.recall) == (2, 0, 1, 1.0, 2 / 3)
    means = {(x.metric, x.average): x.value for x in vision.detection_averages(per).collect()}
    assert means["recall", "micro"] == means["recall", "macro"] == means["recall", "weighted"] == pytest.approx(2 / 3)


@pytest.mark.parametrize("report", [lambda df: vision.average_precision_report(df, "i", "g", "p"), lambda df: vision.mean_average_precision(df, "i", "g", "p"), lambda df: vision.average_recall_report(df, "i", "g", "p")])
def test_boxes_are_matched_once(spark, boxes, report):
    """Each report read and matched its images three times."""
    seen = spark.sparkContext.accumulator(0)

    def through(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    assert len(report(boxes.mapInArrow(through, boxes.schema)).collect()) > 2
    assert seen.value == boxes.count()


def test_mean_overlap_per_image(boxes, images):
    got = {r.image: r.mean_iou for r in vision.per_image_iou(boxes, "i", "g", "p").collect()}
    for i, g, p in images:
        best = [max((overlap(b, t) for t in g or [] if t[0] == b[0]), default=0.0) for b in p or []]
        assert got[i] == pytest.approx(np.mean(best) if best else 0.0)


def test_confusion_equals_brute_force(boxes, images):
    want: dict = {}
    for _, g, p in images:
        p = [b for b in p or [] if b[5] > 0.3]
        pairs = sorted(((-overlap(b, t), i, j) for i, t in enumerate(g or []) for j, b in enumerate(p)))
        left, right, cells = set(range(len(g or []))), set(range(len(p))), []
        for v, i, j in pairs:
            if -v > 0.5 and i in left and j in right:
                left.discard(i)
                right.discard(j)
                cells.append((g[i][0], p[j][0]))
        for c in cells + [(g[i][0], -1) for i in left] + [(-1, p[j][0]) for j in right]:
            want[c] = want.get(c, 0) + 1
    assert {(r.label, r.prediction): r.n for r in vision.detection_confusion(boxes, "i", "g", "p").collect()} == want


def test_masks_and_probabilities(spark):
    df = spark.createDataFrame([(1, [0, 1, 1, 2], [0, 1, 2, 2], [0.1, 0.7, 0.2], [0.9, 0.2, 0.1, 0.8])], "i long, g array<int>, p array<int>, q array<double>, flat array<double>")
    r = df.select(vision.mask_classes("g").alias("c"), vision.mask_class_count("g").alias("n"), vision.mask_areas("g").alias("a"), vision.predicted_class("q").alias("k"), vision.predicted_mask("flat", 2).alias("m")).first()
    assert (r.c, r.n, r.a, r.k, r.m) == ([0, 1, 2], 3, {0: 1, 1: 2, 2: 1}, 1, [0, 1])
    assert {x.cls: (x.tp, x.real, x.said) for x in vision.mask_counts(df, "g", "p").collect()} == {0: (1, 1, 1), 1: (1, 2, 1), 2: (1, 1, 2)}
    assert vision.per_image_dice(df, "i", "g", "p").first().dice == pytest.approx((1 + 2 / 3 + 2 / 3) / 3, abs=1e-3)
    assert {x.cls: x.n for x in vision.class_counts(df, "g", "segmentation").collect()} == {0: 1, 1: 1, 2: 1}
    assert {x.cls: x.n for x in vision.predicted_class_counts(df, "q").collect()} == {1: 1}


def test_crops_samples_and_notations(spark):
    image = np.arange(4 * 5 * 3).reshape(4, 5, 3).astype(float)
    df = spark.createDataFrame([(1, image.ravel().tolist(), 4, 5, 3, [(7, 1.0, 2.0, 3.0, 2.0)])], f"i long, pixels array<double>, height int, width int, channels int, g array<struct<{BOX}>>")
    r = vision.crops(df, "g").first()
    assert (r.cls, r.height, r.width) == (7, 2, 3) and r.pixels == image[2:4, 1:4].ravel().tolist()
    few = df.select(vision.sample_pixels("pixels", "channels", 6).alias("p"), vision.sample_pixels("pixels", "channels", 20).alias("all")).first()
    assert len(few.p) == 18 and few.all == image.ravel().tolist() and {tuple(few.p[k : k + 3]) for k in range(0, 18, 3)} <= {tuple(x) for x in image.reshape(-1, 3)}
    assert vision.property_label_rows(df, "detection", "g").first().area == 6 and vision.property_label_rows(df, "classification", "g").first().area == 20
    rows = spark.createDataFrame([([[3.0, 0.1, 0.2, 0.5, 0.6]], 100, 50)], "b array<array<double>>, w int, h int")
    box = rows.select(vision.convert_boxes("b", "label_xyxy_n", "w", "h").alias("b")).first().b[0]
    assert (box.cls, box.x, box.y, box.w, box.h) == (3, pytest.approx(10), pytest.approx(10), pytest.approx(40), pytest.approx(20))
    assert vision.parse_notation("cxcywh_label") == {"boxes": "cxcywh", "label": "last", "normalized": False}
    for bad in ("xyz", "xywh_xyxy", "n_label_xywh"):
        with pytest.raises(ValueError):
            vision.parse_notation(bad)


def test_shown_classes_and_rows(spark):
    cells = spark.createDataFrame([("a", "b", 5), ("a", "a", 9), ("b", "a", 7)], "label string, prediction string, n long")
    assert [r.n for r in vision.top_confusions(cells, 1).collect()] == [7]
    per = spark.createDataFrame([("a", 0.5, 10), ("b", 0.9, 3), ("c", 0.1, 7)], "class string, f1 double, support long")
    assert [vision.classes_to_show(per, "f1", 2, s) for s in ("largest", "smallest", "best", "worst")] == [["a", "c"], ["b", "c"], ["b", "a"], ["c", "a"]]
    assert vision.metric_rows({"f1": {0: 0.5, 1: -1}, "map": 0.7}, "test", {0: "cat"}) == [
        {"dataset": "test", "metric": "f1", "class": 0, "class_name": "cat", "value": 0.5}, {"dataset": "test", "metric": "map", "class": None, "class_name": None, "value": 0.7}]
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("b", "b"), ("b", "a")], "y string, p string")
    got = {r["class"]: r for r in vision.simple_model_comparison(df, "y", "p").collect()}
    assert got["a"].simple == 0 and got["b"].simple == pytest.approx(0.75) and got["b"].perfect == 1.0
    assert vision.simple_model_comparison(df, "y", "p", "stratified").count() == 2
    assert df.select(F.array(F.lit(1)).alias("v")).transform(lambda x: vision.flatten_properties(x, "v")).count() == 5
