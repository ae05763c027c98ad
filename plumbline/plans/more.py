"""Further queries of the catalogue: kernels, scorers, text properties and image checks, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import helpers, running
from ..functions.language import train_language_model
from ..operators import evaluation, models, scoring, segments, text, train_test, vision
from ..sources.tables import read
from .catalog import FENCES, JUDGED, KS, PER_CLASS, WORDS, _judged, query

# --- kernels -----------------------------------------------------------------


@query("""SELECT value, n, n / t AS share, sum(n) OVER (ORDER BY n DESC, value ROWS UNBOUNDED PRECEDING) / t AS upto FROM (SELECT lang AS value, count(*) AS n, (SELECT count(*) FROM documents) AS t FROM documents GROUP BY 1)""")
def cumulative_shares(spark, d):
    return segments.cumulative_shares(read(spark, d, "documents", "lang"), "lang")


@query("""SELECT value, mean_error, n, sum(n) OVER (ORDER BY mean_error DESC, value ROWS UNBOUNDED PRECEDING) / sum(n) OVER () AS upto FROM (
SELECT l_linestatus || l_returnflag AS value, avg(abs(l_extendedprice - l_quantity * 1500)) AS mean_error, count(*) AS n FROM lineitem GROUP BY 1)""")
def error_by_category(spark, d):
    li = read(spark, d, "lineitem", "l_linestatus", "l_returnflag", "l_extendedprice", "l_quantity")
    return segments.error_by_category(li.select(F.concat("l_linestatus", "l_returnflag").alias("k"), F.abs(F.col("l_extendedprice") - F.col("l_quantity") * 1500).alias("e")), "k", "e")


@query("""WITH r AS (SELECT l_extendedprice AS v, row_number() OVER (ORDER BY l_extendedprice) - 1 AS i, count(*) OVER () - 1 AS n FROM lineitem)
SELECT 'nearest' AS how, min(v)::DOUBLE AS value FROM r WHERE i = round_even(0.37 * n, 0) UNION ALL SELECT 'higher', min(v)::DOUBLE FROM r WHERE i = ceil(0.37 * n)""")
def rank_quantiles(spark, d):
    li = read(spark, d, "lineitem", "l_extendedprice")
    near, high = (helpers.row_quantile(li, "l_extendedprice", 0.37, how).select(F.lit(how).alias("how"), "value") for how in ("nearest", "higher"))
    return near.unionByName(high)


@query("""SELECT l_returnflag, quantile_cont(l_extendedprice, 0.1)::DOUBLE AS low, quantile_cont(l_extendedprice, 0.5)::DOUBLE AS middle, quantile_cont(l_extendedprice, 0.9)::DOUBLE AS high, count(*) AS n FROM lineitem GROUP BY 1""")
def exact_quantiles(spark, d):
    q = running.exact_quantiles(read(spark, d, "lineitem", "l_returnflag", "l_extendedprice"), ["l_returnflag"], "l_extendedprice", [0.1, 0.5, 0.9])
    return q.select("l_returnflag", *(F.col("q")[k].alias(n) for k, n in enumerate(("low", "middle", "high"))), "n")


@query("""SELECT o_orderstatus, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice, o_orderkey) AS k FROM orders) WHERE k = 1""")
def first_row_per_label(spark, d):
    return helpers.first_per(read(spark, d, "orders", "o_orderstatus", "o_orderkey", "o_totalprice"), "o_orderstatus", ["o_totalprice", "o_orderkey"])


@query("""SELECT o_orderpriority, row_number() OVER (ORDER BY min(o_orderkey), o_orderpriority)::INT - 1 AS number FROM orders GROUP BY 1""")
def group_numbers(spark, d):
    return helpers.group_numbers(read(spark, d, "orders", "o_orderpriority", "o_orderkey"), "o_orderpriority", "o_orderkey")


@query("""SELECT doc_id FROM documents WHERE text IN (SELECT text FROM documents GROUP BY text HAVING count(*) > 1)""")
def rows_of_duplicates(spark, d):
    docs = read(spark, d, "documents", "doc_id", "text").select("doc_id", F.sha2("text", 256).alias("h"))
    return helpers.rows_of_groups(docs, ["h"]).select("doc_id")


@query("""SELECT 'l_quantity' AS x, 'l_extendedprice' AS y, corr(l_quantity, l_extendedprice) AS value FROM lineitem UNION ALL SELECT 'l_quantity', 'l_tax', corr(l_quantity, l_tax) FROM lineitem
UNION ALL SELECT 'l_discount', 'l_extendedprice', corr(l_discount, l_extendedprice) FROM lineitem UNION ALL SELECT 'l_discount', 'l_tax', corr(l_discount, l_tax) FROM lineitem""")
def column_pairs(spark, d):
    li = read(spark, d, "lineitem", "l_quantity", "l_discount", "l_extendedprice", "l_tax")
    li = li.select(F.struct(*li.columns).alias("r"), F.monotonically_increasing_id().alias("k"))
    x, y = (li.select("k", *(F.col(f"r.{c}").cast("double").alias(c) for c in names)) for names in (("l_quantity", "l_discount"), ("l_extendedprice", "l_tax")))
    return models.column_pairs(x, y, F.corr, ["k"])


# --- evaluation --------------------------------------------------------------


@query(f"""WITH c AS (SELECT p_a AS s, count(*) AS n, sum((l_returnflag = 'A')::INT) AS p FROM {JUDGED} GROUP BY 1),
r AS (SELECT s, sum(p) OVER o / (SELECT sum(p) FROM c) AS tpr, (sum(n) OVER o - sum(p) OVER o) / (SELECT sum(n) - sum(p) FROM c) AS fpr FROM c WINDOW o AS (ORDER BY s DESC))
SELECT s AS threshold, tpr, fpr FROM r ORDER BY tpr - fpr DESC, s DESC LIMIT 1""")
def best_cutoff(spark, d):
    return scoring.best_cutoff(_judged(spark, d), "l_returnflag", "p_a", "A")


@query(f"""WITH m AS {PER_CLASS.format(by='')}
SELECT 'accuracy' AS metric, NULL AS class, sum(tp) / sum(support) AS value FROM m UNION ALL SELECT 'recall_macro', NULL, avg(tp / (tp + fn)) FROM m
UNION ALL SELECT 'f1', class, 2 * tp / (2 * tp + fp + fn) FROM m UNION ALL SELECT 'fpr', class, fp / (total - tp - fn) FROM m""")
def named_scores(spark, d):
    return evaluation.score(_judged(spark, d), "l_returnflag", "pred", ["accuracy", "recall_macro", "f1", "fpr"])


@query(f"""SELECT 'recall' AS metric, c AS class, avg((pred = c)::INT) AS value FROM (SELECT *, l_returnflag AS c FROM {JUDGED}) GROUP BY c UNION ALL SELECT 'share', NULL, avg((l_returnflag = pred)::INT) FROM {JUDGED}""")
def scorer_values(spark, d):
    rows = _judged(spark, d)
    share = lambda df, y, p: df.agg(F.avg((F.col(y) == F.col(p)).cast("double"))).first()[0]
    return scoring.performance(rows, "l_returnflag", "pred", [scoring.scorer("recall", True), scoring.Scorer("share", share)])


@query(f"""SELECT avg(-ln(CASE l_returnflag WHEN 'A' THEN p_a WHEN 'N' THEN 1 - p_a ELSE 0 END + 1e-15)) AS log_loss FROM {JUDGED}""")
def log_loss(spark, d):
    rows = _judged(spark, d).withColumn("p", F.array(F.col("p_a"), 1 - F.col("p_a"), F.lit(0.0)))
    return evaluation.log_loss(rows, "l_returnflag", "p", ["A", "N", "R"])


@query("""WITH p AS (SELECT q.c_custkey AS id, c.c_mktsegment AS c, CASE WHEN q.c_acctbal > 3000 THEN 'BUILDING' ELSE 'MACHINERY' END AS said, min(sqrt(pow(q.c_acctbal - c.c_acctbal, 2) + pow(q.c_nationkey - c.c_nationkey, 2))) AS d
FROM customer q, customer c WHERE q.c_custkey % 100 = 0 AND q.c_custkey <> c.c_custkey GROUP BY ALL)
SELECT id, min(d) FILTER (c <> said) / (coalesce(min(d) FILTER (c = said), 'infinity'::DOUBLE) + 1e-12) AS trust FROM p GROUP BY id""")
def trust_scores(spark, d):
    """The stated query set is every customer whose key is divisible by 100, against all customers."""
    c = read(spark, d, "customer", "c_custkey", "c_acctbal", "c_nationkey", "c_mktsegment")
    asked = c.where("c_custkey % 100 = 0").withColumn("said", F.when(F.col("c_acctbal") > 3000, "BUILDING").otherwise("MACHINERY"))
    return models.trust_scores(c, asked, "c_custkey", ["c_acctbal", "c_nationkey"], "c_mktsegment", "said").select("id", "trust")


@query("""SELECT m AS simple, count(*)::BIGINT AS n FROM (SELECT mode(l_returnflag) AS m FROM lineitem), lineitem GROUP BY 1""")
def most_frequent_model(spark, d):
    li = read(spark, d, "lineitem", "l_returnflag", "l_orderkey")
    return models.simple_predictions(li, "l_returnflag", ["l_orderkey"]).groupBy("simple").agg(F.count("*").alias("n"))


# --- texts -------------------------------------------------------------------

SYLLABLES = r"list_sum(list_transform(w, lambda x: greatest(len(regexp_extract_all(lower(x), '[aeiouy]+')) - regexp_matches(lower(x), '[^aeiouyl]e$')::INT, 1)))"
SENTENCES = r"len(list_filter(regexp_split_to_array(text, '[.!?]+(?:\s+|$)'), lambda s: trim(s) <> ''))"


@query(rf"""SELECT doc_id, CASE WHEN n > 0 AND s > 0 THEN round_even(206.835 - 1.015 * n / s - 84.6 * y / n, 3) END AS readability_score, CASE WHEN s > 0 THEN round_even(y / s, 2) END AS average_syllable_length,
s::INT AS sentences_count, u::INT AS unique_syllables_count FROM (SELECT doc_id, len(w) AS n, {SENTENCES} AS s, coalesce({SYLLABLES}, 0) AS y, len(list_distinct(list_transform(w, lambda x: lower(x)))) AS u FROM (SELECT *, {WORDS.format('text')} AS w FROM documents))""")
def text_readability(spark, d):
    return text.text_properties(read(spark, d, "documents", "doc_id", "text"), "text", ["readability_score", "average_syllable_length", "sentences_count", "unique_syllables_count"]).drop("text")


TAGS = "CASE WHEN x IN ('the', 'and', 'der', 'la') THEN 'B-Q' WHEN x LIKE 'a%' THEN 'B-P' ELSE 'O' END"


@query(rf"""WITH t AS (SELECT doc_id, x, {TAGS} AS y, CASE WHEN length(x) % 5 = 0 THEN 'O' ELSE {TAGS} END AS p FROM (SELECT doc_id, unnest(regexp_split_to_array(text, ' ')) AS x FROM documents)),
m AS (SELECT c AS class, sum((y = 'B-' || c)::INT) AS support, sum((p = 'B-' || c)::INT) AS said, sum((y = 'B-' || c AND p = y)::INT) AS tp FROM t, (SELECT unnest(['P', 'Q']) AS c) GROUP BY c)
SELECT class, tp / said AS precision, tp / support AS recall, 2 * tp / (said + support) AS f1, support::BIGINT AS support FROM m""")
def token_metrics(spark, d):
    """Words of a rule as entities of one token each; the prediction misses words of some lengths."""
    w = F.split("text", " ")
    tag = lambda x: F.when(x.isin("the", "and", "der", "la"), "B-Q").when(x.startswith("a"), "B-P").otherwise("O")
    rows = read(spark, d, "documents", "doc_id", "text").select("doc_id", F.transform(w, tag).alias("y"), F.transform(w, lambda x: F.when(F.length(x) % 5 == 0, "O").otherwise(tag(x))).alias("p"))
    return text.token_metrics(rows, "doc_id", "y", "p")


# --- images ------------------------------------------------------------------

PIXELS = "(SELECT vec_id, list_transform(embedding, lambda x: abs(x)::DOUBLE) AS p, list_transform(embedding, lambda x: CASE WHEN x > 0.1 THEN 2 WHEN x > 0 THEN 1 ELSE 0 END) AS g, list_transform(embedding, lambda x: CASE WHEN x > 0.05 THEN 2 WHEN x > 0 THEN 1 ELSE 0 END) AS q FROM embeddings)"
PROPERTIES = f"(SELECT vec_id, list_avg(p) AS brightness, list_stddev_pop(p) AS rms_contrast FROM {PIXELS})"


def _images(spark, d):
    """Embeddings as gray images of 8 by 8 pixels, with masks by two limits."""
    level = lambda limit: F.transform("embedding", lambda x: F.when(x > limit, 2).when(x > 0, 1).otherwise(0))
    e = read(spark, d, "embeddings", "vec_id", "embedding")
    return e.select("vec_id", F.transform("embedding", lambda x: F.abs(x).cast("double")).alias("pixels"), F.lit(8).alias("height"), F.lit(8).alias("width"), F.lit(1).alias("channels"), level(0.1).alias("g"), level(0.05).alias("q"))


@query(FENCES.format(s=1.5, rows=f"SELECT 'brightness' AS f, brightness AS v FROM {PROPERTIES} UNION ALL SELECT 'rms_contrast', rms_contrast FROM {PROPERTIES}"))
def image_property_outliers(spark, d):
    return vision.image_property_outliers(vision.image_properties(_images(spark, d).drop("g", "q")), ["brightness", "rms_contrast"])


@query("SELECT feature, 'KS' AS method, score FROM (" + KS.format(rows=f"SELECT 'brightness' AS f, (vec_id % 2)::INT AS side, brightness AS v FROM {PROPERTIES} UNION ALL SELECT 'rms_contrast', (vec_id % 2)::INT, rms_contrast FROM {PROPERTIES}") + ")")
def image_property_drift(spark, d):
    p = vision.image_properties(_images(spark, d).drop("g", "q"))
    return vision.image_property_drift(p.where("vec_id % 2 = 0"), p.where("vec_id % 2 = 1"), ["brightness", "rms_contrast"])


@query(f"""SELECT pos::INT AS "at", abs(avg(v) FILTER (vec_id % 2 = 0) - avg(v) FILTER (vec_id % 2 = 1)) AS difference FROM (SELECT vec_id, unnest(p) AS v, generate_subscripts(p, 1) - 1 AS pos FROM {PIXELS}) GROUP BY pos""")
def heatmap_comparison(spark, d):
    i = _images(spark, d)
    return vision.heatmap_comparison(i.where("vec_id % 2 = 0"), i.where("vec_id % 2 = 1"), "pixels")


CELLS = f"(SELECT vec_id, unnest(g) AS g, unnest(q) AS q FROM {PIXELS})"


@query(f"""SELECT c::INT AS cls, sum((g = c AND q = c)::INT)::BIGINT AS tp, sum((g = c)::INT)::BIGINT AS real, sum((q = c)::INT)::BIGINT AS said FROM {CELLS}, (SELECT unnest([0, 1, 2]) AS c) GROUP BY c HAVING sum((g = c)::INT) + sum((q = c)::INT) > 0""")
def mask_counts(spark, d):
    return vision.mask_counts(_images(spark, d), "g", "q")


PER_MASK = f"(SELECT vec_id, c, sum((g = c)::INT) AS a, sum((q = c)::INT) AS b, sum((g = c AND q = c)::INT) AS i FROM {CELLS}, (SELECT unnest([0, 1, 2]) AS c) GROUP BY 1, 2 HAVING a + b > 0)"


@query(f"SELECT c::INT AS cls, avg((2 * i + 0.001) / (a + b + 0.001)) AS dice, avg((i + 0.001) / (a + b - i + 0.001)) AS iou FROM {PER_MASK} GROUP BY c")
def segmentation_metrics(spark, d):
    return vision.segmentation_metrics(_images(spark, d), "g", "q")


@query(f"SELECT vec_id AS image, avg((2 * i + 0.001) / (a + b + 0.001)) AS dice FROM {PER_MASK} GROUP BY 1")
def per_image_dice(spark, d):
    return vision.per_image_dice(_images(spark, d), "vec_id", "g", "q")


@query(f"SELECT c::INT AS cls, count(*) AS n FROM {PER_MASK} WHERE a > 0 GROUP BY c")
def mask_class_counts(spark, d):
    return vision.class_counts(_images(spark, d), "g", "segmentation")


def _boxed(spark, d):
    """Orders as images: boxes of line items, predictions moved by their discount."""
    li = read(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax")
    box = lambda dx: [(F.col("l_linenumber") * 10.0 + dx).alias("x"), F.lit(0.0).alias("y"), (F.col("l_quantity") * 1.0 + 1).alias("w"), F.lit(10.0).alias("h")]
    cls = (F.col("l_linenumber") % 3).cast("long").alias("cls")
    return li.groupBy("l_orderkey").agg(F.collect_list(F.struct(cls, *box(F.lit(0.0)))).alias("real"), F.collect_list(F.struct(cls, *box(F.col("l_discount") * 20), (1 - F.col("l_tax")).alias("conf"))).alias("said"))


BOXES = "(SELECT l_orderkey AS o, l_linenumber % 3 AS c, l_linenumber * 10.0::DOUBLE AS x, l_linenumber * 10.0::DOUBLE + l_discount * 20 AS px, l_quantity + 1.0::DOUBLE AS w, row_number() OVER () AS r FROM lineitem)"


@query(f"""WITH b AS {BOXES}, k AS (SELECT p.o, p.r, max(CASE WHEN least(p.px + p.w, g.x + g.w) > greatest(p.px, g.x) THEN (least(p.px + p.w, g.x + g.w) - greatest(p.px, g.x)) * 10 / (p.w * 10 + g.w * 10 - (least(p.px + p.w, g.x + g.w) - greatest(p.px, g.x)) * 10) ELSE 0 END) AS v
FROM b p JOIN b g ON p.o = g.o AND p.c = g.c GROUP BY 1, 2) SELECT o AS image, avg(v) AS mean_iou FROM k GROUP BY o""")
def per_image_iou(spark, d):
    return vision.per_image_iou(_boxed(spark, d), "l_orderkey", "real", "said")


@query("""SELECT l_linenumber % 3 AS cls, count(*) AS n FROM lineitem GROUP BY 1""")
def box_class_counts(spark, d):
    return vision.box_classes(_boxed(spark, d), "real")


@query("""SELECT (l_linenumber % 3)::BIGINT AS cls, count(*) AS n, count(*) / (SELECT count(*) FROM lineitem WHERE l_orderkey % 2 = 1) AS ratio FROM lineitem WHERE l_orderkey % 2 = 1 AND l_linenumber % 3 = 0 GROUP BY 1""")
def new_box_labels(spark, d):
    rows = _boxed(spark, d)
    train = rows.where("l_orderkey % 2 = 0").withColumn("real", F.filter("real", lambda b: b["cls"] != 0))
    return vision.new_box_labels(train, rows.where("l_orderkey % 2 = 1"), "real")


@query()
def mean_average_recall(spark, d):
    """Held against brute force in tests/test_vision.py, as are the matching and the precision report."""
    return vision.average_recall_report(_boxed(spark, d), "l_orderkey", "real", "said", (1, 10, 100), ious=(0.5, 0.75))


@query()
def average_precision_report(spark, d):
    return vision.average_precision_report(_boxed(spark, d), "l_orderkey", "real", "said", ious=(0.5, 0.75))


@query()
def detection_confusion(spark, d):
    return vision.detection_confusion(_boxed(spark, d), "l_orderkey", "real", "said")


@query()
def detection_averages(spark, d):
    return vision.detection_averages(vision.detection_metrics(_boxed(spark, d), "l_orderkey", "real", "said", 0.5, 0.9))


@query(f"""SELECT feature, 'KS' AS method, score FROM ({KS.format(rows="SELECT 'bounding_box_area' AS f, (l_orderkey % 2)::INT AS side, (l_quantity + 1) * 10.0::DOUBLE AS v FROM lineitem UNION ALL SELECT 'boxes_per_image', (l_orderkey % 2)::INT, count(*)::DOUBLE FROM lineitem GROUP BY l_orderkey")})""")
def label_property_drift(spark, d):
    from ..data import VisionData
    from .suites import _wide

    v = VisionData(_boxed(spark, d), "l_orderkey", "detection", "real", "said")
    names = ["bounding_box_area", "boxes_per_image"]
    a, b = (_wide(v.label_properties().where(f"l_orderkey % 2 = {k}"), names) for k in (0, 1))
    return train_test.feature_drift(a, b, names, [])


# --- segments ----------------------------------------------------------------


@query("""WITH c AS (SELECT p_type AS v, count(*) AS n FROM part GROUP BY 1), r AS (SELECT v, n, row_number() OVER (ORDER BY n DESC, v) AS k,
coalesce(sum(n) OVER (ORDER BY n DESC, v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS had, sum(n) OVER () AS t FROM c)
SELECT CASE WHEN k <= 5 AND had < 0.9 * t THEN v ELSE 'others' END AS segment, sum(n)::BIGINT AS n FROM r GROUP BY 1""")
def category_partition(spark, d):
    """Every row of the table in one of six segments: the five largest categories and all others, by exclusion."""
    p = read(spark, d, "part", "p_type")
    cuts = segments.partition_column(p, "p_type", True, 5)
    return p.agg(*(F.count_if(f.column()).alias(f.name) for f in cuts)).select(F.inline(F.array(*(F.struct(F.lit(f.name).alias("segment"), F.col(f"`{f.name}`").alias("n")) for f in cuts))))


@query("""WITH r AS (SELECT count(*) FILTER (l_quantity <= 20) AS a, count(*) FILTER (l_quantity > 30) AS b FROM lineitem),
n AS (SELECT least(greatest(round_even(4 * a / (a + b), 0)::INT, 1), 3) AS l FROM r),
k AS (SELECT l, unnest(range(l)) AS i, 0 AS side FROM n UNION ALL SELECT 4 - l, unnest(range(1, 5 - l)), 1 FROM n),
v AS (SELECT l_quantity AS v, CASE WHEN l_quantity <= 20 THEN 0 ELSE 1 END AS side, row_number() OVER (PARTITION BY l_quantity <= 20 ORDER BY l_quantity) - 1 AS pos, count(*) OVER (PARTITION BY l_quantity <= 20) - 1 AS last
  FROM lineitem WHERE l_quantity <= 20 OR l_quantity > 30)
SELECT DISTINCT edge::DOUBLE AS edge FROM (SELECT max(v) FILTER (pos = floor(i * last / l)) + (max(v) FILTER (pos = ceil(i * last / l)) - max(v) FILTER (pos = floor(i * last / l))) * (max(i * last / l) - floor(max(i * last / l))) AS edge
  FROM k JOIN v USING (side) GROUP BY side, i, l UNION ALL SELECT 20.0 UNION ALL SELECT 30.0)""")
def edges_around_segment(spark, d):
    edges = segments.edges_around(read(spark, d, "lineitem", "l_quantity"), "l_quantity", 20.0, 30.0)
    return spark.createDataFrame([(e,) for e in edges], "edge double")


@query("""WITH e AS (SELECT l_linestatus || l_returnflag AS k, abs(l_extendedprice - l_quantity * 1500) AS e FROM lineitem),
c AS (SELECT k, avg(e) AS m, count(*) AS n FROM e GROUP BY k), r AS (SELECT *, sum(n) OVER (ORDER BY m DESC, k) / sum(n) OVER () AS upto, row_number() OVER (ORDER BY m DESC, k) AS i FROM c),
w AS (SELECT k FROM r WHERE upto <= 0.5 OR (i = 1 AND NOT EXISTS (SELECT 1 FROM r WHERE upto <= 0.5)))
SELECT CASE WHEN k IN (SELECT k FROM w) THEN 'worse' ELSE 'better' END AS segment, avg(e) AS score, count(*) AS n FROM e GROUP BY 1""")
def error_sides(spark, d):
    """A table cut in two by the mean error of its categories."""
    li = read(spark, d, "lineitem", "l_linestatus", "l_returnflag", "l_extendedprice", "l_quantity")
    rows = li.select(F.concat("l_linestatus", "l_returnflag").alias("k"), F.abs(F.col("l_extendedprice") - F.col("l_quantity") * 1500).alias("e"))
    worse, _ = segments.error_segments(rows, "k", "e", True)
    return rows.groupBy(F.when(worse.column(), "worse").otherwise("better").alias("segment")).agg(F.avg("e").alias("score"), F.count("*").alias("n"))


@query()
def document_language(spark, d):
    """(lang, n, n_right, n_unsure): what a model trained on the labelled rows says of all documents; tests/test_custom.py states its accuracy on rows it has not seen."""
    docs = read(spark, d, "documents", "text", "lang")
    said = docs.select("lang", train_language_model(docs, "text", "lang").language(F.col("text")).alias("said"))
    return said.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.col("lang") == F.col("said")).alias("n_right"), F.count_if(F.col("said").isNull()).alias("n_unsure"))


@query(f"""WITH t AS (SELECT *, (l_returnflag = pred)::INT AS hit FROM {JUDGED}), c AS (SELECT l_linestatus AS a, l_tax > 0.04 AS b, avg(hit) AS score, count(*) AS n FROM t GROUP BY ALL)
SELECT CASE WHEN b THEN 'l_tax > 0.04' ELSE 'l_tax <= 0.04' END || ' and l_linestatus in ' || a AS segment, score, n FROM c""")
def segment_means(spark, d):
    """Segments as filters, all counted in one pass."""
    rows = _judged(spark, d).withColumn("hit", (F.col("l_returnflag") == F.col("pred")).cast("double"))
    cuts = [tax.among("l_linestatus", [s]) for tax in (segments.Filter().above("l_tax", 0.04), segments.Filter().upto("l_tax", 0.04)) for s in ("F", "O")]
    found = rows.agg(*(x for i, f in enumerate(cuts) for x in (F.avg(F.when(f.column(), F.col("hit"))).alias(f"s{i}"), F.count_if(f.column()).alias(f"n{i}"))))
    return found.select(F.inline(F.array(*(F.struct(F.lit(f.describe()).alias("segment"), F.col(f"s{i}").alias("score"), F.col(f"n{i}").alias("n")) for i, f in enumerate(cuts)))))


@query()
def weak_segments_of_categories(spark, d):
    """All pairs of two numbers and two categories; tests/test_weak.py grows the same trees row by row."""
    rows = _judged(spark, d).withColumn("hit", (F.col("l_returnflag") == F.col("pred")).cast("double")).withColumn("month", F.date_format("l_shipdate", "MM"))
    return models.weak_segments(rows, ["l_quantity", "l_tax", "l_linestatus", "month"], "hit", categorical=["l_linestatus", "month"], top=6)
