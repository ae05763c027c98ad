"""Filter interaction audit: what each filter removes in every order, from one count of failures.

A document fails some of the five filters: a mask of five bits. Per part, 32
counts say all there is to know. The subset-zeta transform (a running sum along
each of the five axes of a 2x2x2x2x2 array) turns them into the survivors of
every set of filters; a step of an order removes the difference between two
sets that differ by its filter. Likewise for the counts of labelled documents.

Texts are read once and give a mask and a digest. Copies are found by digest
without bringing them together: rows are counted by digest, part and label
first, in partial sums per task, so a group of a third of all rows is a few
rows when its first document is looked up.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import Tables, keep, map_rows, prepare

FILTERS = "ABCDE"
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS = 100, 80, 10
SYMBOLS = re.compile(rb"[#$%&*|]")
CAPITALS, CONTINUED = bytes(range(0x41, 0x5B)), bytes(range(0x80, 0xC0))
#: The bit of the filter that no document decides by itself.
COPY = 1 << FILTERS.index("E")
COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
RESULT = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS)


def text_mask(text: bytes) -> int:
    """Which of A to D a text fails, A being the lowest bit."""
    words = text.split()  # bytes are split at x20 and x09 to x0D, and nothing else
    n = len(words)
    capitals, points = len(text) - len(text.translate(None, CAPITALS)), len(text.translate(None, CONTINUED))
    return (n < MIN_WORDS) | (100 * len(set(words)) < MIN_DISTINCT * n) << 1 | (100 * capitals > MAX_CAPITALS * points) << 2 | bool(SYMBOLS.search(text)) << 3


def masked_documents(docs: DataFrame, doc_id: str, text: str, part: str) -> DataFrame:
    """(id, part, mask, digest) a document: the filters that it fails by itself, and 128 bits of its text."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
        masks = pa.array([text_mask(t) for t in texts], pa.int32())
        digests = pa.array([hashlib.md5(t).digest() for t in texts], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("part"), masks, digests], names=["id", "part", "mask", "digest"])

    given = docs.select(F.col(doc_id).cast("long").alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.col(text).alias("text"))
    return map_rows(given, run, "id long, part string, mask int, digest binary")


def mask_counts(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """(part, mask, n, good, toxic): documents of a part by the filters that they fail, and how many of them are labelled so; at most 32 rows a part."""
    one = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)))
    labelled = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("of")).agg(one("quality").alias("good"), one("toxic").alias("toxic"))
    with Tables(docs.sparkSession) as tables:
        rows = tables.keep(masked_documents(docs, doc_id, text, part))
        # Rows without an id have no label; they would meet in one task.
        known = rows.where("id IS NOT NULL").join(labelled, F.col("id") == F.col("of"), "left").drop("of")
        unknown = rows.where("id IS NULL").withColumn("good", F.lit(None).cast("boolean")).withColumn("toxic", F.lit(None).cast("boolean"))
        label = lambda c: F.coalesce(c, F.lit(False)).alias(c)
        by = ["digest", "part", "mask", "good", "toxic"]
        single = known.unionByName(unknown).select("id", "digest", "part", "mask", label("good"), label("toxic")).groupBy("id", *by).agg(F.count("*").alias("n"))
        # Of each group of copies: rows, rows without an id, the smallest id and the rows that have it.
        grouped = tables.keep(
            single.groupBy(*by).agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("id").isNull(), F.col("n"))), F.lit(0)).alias("lost"), F.min("id").alias("first"), F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n")))["n"].alias("firsts"))
        )
        least = grouped.groupBy("digest").agg(F.min("first").alias("least"))
        met = grouped.join(least, "digest")
        stays = F.col("lost") + F.when(F.col("first") == F.col("least"), F.col("firsts")).otherwise(0)
        dealt = met.select("part", "good", "toxic", F.explode(F.array(F.struct(F.col("mask"), stays.alias("n")), F.struct((F.col("mask") + COPY).alias("mask"), (F.col("n") - stays).alias("n")))).alias("x"))
        dealt = dealt.select("part", F.col("x.mask").alias("mask"), F.col("x.n").alias("n"), "good", "toxic").where("n > 0")
        of = lambda c: F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias(c)
        return keep(dealt.groupBy("part", "mask").agg(F.sum("n").alias("n"), of("good"), of("toxic")))


def survivors(counts: np.ndarray) -> np.ndarray:
    """Of 32 counts by mask: for each set of filters, the documents that fail none of it (the zeta transform, read at the complement)."""
    cube = counts.reshape([2] * len(FILTERS))
    for axis in range(cube.ndim):
        cube = np.cumsum(cube, axis=axis)
    return cube.reshape(-1)[::-1]


def _audit(n: np.ndarray, good: np.ndarray, toxic: np.ndarray) -> list[tuple]:
    """The rows of one part, without its name."""
    left, left_good, left_toxic = survivors(n), survivors(good), survivors(toxic)
    size = len(FILTERS)
    bit = {f: 1 << i for i, f in enumerate(FILTERS)}
    fails = {f: int(left[0] - left[bit[f]]) for f in FILTERS}
    # Orders in which exactly the set s comes before the filter.
    share = {f: sum(factorial(s.bit_count()) * factorial(size - 1 - s.bit_count()) * int(left[s] - left[s | bit[f]]) for s in range(1 << size) if not s & bit[f]) for f in FILTERS}
    rows = []
    for order in permutations(FILTERS):
        s = 0
        for step, f in enumerate(order, 1):
            t = s | bit[f]
            removed = int(left[s] - left[t])
            rows.append(("".join(order), step, int(left[t]), removed, fails[f] - removed, int(n[bit[f]]), int(left_good[s] - left_good[t]), int(left_toxic[s] - left_toxic[t]), share[f]))
            s = t
    return rows


def filter_audit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """Per part, order of the five filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    A document is a copy (E) if a smaller id has the same text anywhere in the
    table. Null texts are empty texts; null parts are the part "". Rows without
    an id are no copies, make no copies and have no labels; repeated rows of
    one id count each, and neither is the other's copy. A document with several
    rows of labels is good (toxic) if one of them says so. Other columns are
    not read. An empty table has no parts, so no rows.
    """
    prepare(docs.sparkSession)
    counts = mask_counts(docs, labels, doc_id, text, part)
    parts = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("m"))  # 32 at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                table = np.zeros((3, 1 << len(FILTERS)), dtype=np.int64)
                for m in row["m"]:
                    table[:, m["mask"]] = m["n"], m["good"], m["toxic"]
                columns = list(zip(*_audit(*table), strict=True))
                kinds = [pa.string(), pa.int32(), *[pa.int64()] * len(COUNTS)]
                arrays = [pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([row["part"]] * len(arrays[0]), pa.string()), *arrays], names=["part", "filter_order", "step", *COUNTS])

    return parts.mapInArrow(run, RESULT)
