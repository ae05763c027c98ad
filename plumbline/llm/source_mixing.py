"""Mixing sources to target weights by a low-discrepancy schedule.

Targets: each source gets its weight's share of the words, at most ``MOST``
times what it has; the excess goes to the others by weight until none is above.

Schedule: a source's documents, in a shuffled order, are cut into blocks of
``BLOCK`` words; its target needs so many slots, a block each. The slots of
all sources are laid side by side as cumulative weights, and the van der
Corput points of 0, 1, 2, ... (their bits mirrored) pick one after the other:
so every stretch of the mix, however short, has the sources near their shares,
and all slots together hit each target to the word. A slot's rank in its
source is a closed sum over the bits of its number, so slots are neither
sorted nor shuffled to be ranked. The rank names epoch and block, which the
slot meets by a join.

The order of documents is that of a digest of id and text. Its leading bits
deal a source over small buckets; where a document starts is the sum of the
buckets before and of the documents before it in its own, so a source of a
third of all rows is spread like the others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import keep, map_rows, prepare

WEIGHTS, MOST, BLOCK = (5, 2, 1), 3, 1024
#: Documents of a bucket, on average over the table; slots of a task.
BUCKET_ROWS, TASK_SLOTS = 256, 1 << 18
#: Sources are set by weight, one by one: more than this are refused. A row for each reaches the driver and is broadcast.
MAX_SOURCES = 1_000_000


def sized_documents(docs: DataFrame, doc_id: str, text: str, source: str) -> DataFrame:
    """(doc_id, source, size, shuffle, key): words of each text and the digest that shuffles; ``key`` is its leading 32 bits. Texts are read once."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids, sources, texts = batch.columns
        sizes, digests = [], []
        for i, t in zip(ids.to_pylist(), texts.cast(pa.binary()).to_pylist(), strict=True):
            sizes.append(len((t or b"").split()))  # bytes are split at x20 and x09 to x0D, and nothing else
            digests.append(hashlib.md5(f"{'' if i is None else i}:{hashlib.md5(t or b'').hexdigest()}".encode()).hexdigest())
        yield pa.RecordBatch.from_arrays([ids, sources, pa.array(sizes, pa.int64()), pa.array(digests), pa.array([int(d[:8], 16) for d in digests], pa.int64())], names=["doc_id", "source", "size", "shuffle", "key"])

    given = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), F.col(text).alias("text"))
    kind = docs.schema[doc_id].dataType.simpleString()
    return map_rows(given, run, f"doc_id {kind}, source string, size long, shuffle string, key long")


def mixing_targets(sizes: Sequence[int], weights: Sequence[int], most: int = MOST) -> list[tuple[int, int]]:
    """Each source's target as a fraction (numerator, denominator): its share by weight of all sizes, at most ``most`` times its own."""
    caps, capped, rest = [most * n for n in sizes], set(), sum(sizes)
    while True:
        free = [i for i in range(len(sizes)) if i not in capped]
        whole = sum(weights[i] for i in free)
        over = [i for i in free if rest * weights[i] > caps[i] * whole]
        if not over:
            return [(caps[i], 1) if i in capped else (rest * weights[i], whole) for i in range(len(sizes))]
        capped.update(over)
        rest -= sum(caps[i] for i in over)


def mixing_sources(sized: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST, block: int = BLOCK) -> DataFrame:
    """(no, source, source_size, target, quota, blocks, first, slots) a source, in the order of code points, null last.

    quota is the whole words of the target; blocks those of one epoch; first
    and slots the stretch of cumulative slots that is the source's.
    """
    counted = sized.groupBy("source").agg(F.sum("size").alias("n")).orderBy(F.col("source").asc_nulls_last()).limit(MAX_SOURCES + 1).collect()
    if len(counted) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    sizes = [r.n for r in counted]
    rows, first = [], 0
    for no, (r, (a, b)) in enumerate(zip(counted, mixing_targets(sizes, [weights[i % len(weights)] for i in range(len(sizes))], most), strict=True)):
        quota, blocks = a // b, -(-r.n // block)
        slots = quota // r.n * blocks + -(-(quota % r.n) // block) if r.n else 0
        rows.append((no, r.source, r.n, a / b, quota, blocks, first, slots))
        first += slots
    return sized.sparkSession.createDataFrame(rows, "no int, source string, source_size long, target double, quota long, blocks long, first long, slots long").coalesce(1)


def placed_documents(sized: DataFrame, sources: DataFrame) -> DataFrame:
    """``sized`` with its source's row and start, the words of the source before the document in the shuffled order; a written table."""
    bits = max(2, min(32, sized.count() // BUCKET_ROWS).bit_length())
    half = bits // 2
    known = sources.withColumnRenamed("source", "of")
    rows = sized.join(F.broadcast(known), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    rows = rows.withColumn("bucket", F.shiftright("key", 32 - bits))
    before = lambda of, by: F.coalesce(F.sum("n").over(Window.partitionBy(*of).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # Two levels, so that not even the bucket totals of one source are one group.
    fine = rows.groupBy("no", "bucket").agg(F.sum("size").alias("n")).withColumn("coarse", F.shiftright("bucket", bits - half))
    coarse = fine.groupBy("no", "coarse").agg(F.sum("n").alias("n")).withColumn("far", before(["no"], "coarse")).drop("n")
    fine = fine.withColumn("near", before(["no", "coarse"], "bucket")).join(coarse, ["no", "coarse"]).select("no", "bucket", (F.col("far") + F.col("near")).alias("base"))
    inside = Window.partitionBy("no", "bucket").orderBy("shuffle", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("ahead", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(fine, ["no", "bucket"])
    return keep(rows.withColumn("start", F.col("base") + F.col("ahead")).drop("bucket", "key", "ahead", "base"))


def mirrored(n: np.ndarray, bits: int) -> np.ndarray:
    out = np.zeros_like(n)
    for _ in range(bits):
        out, n = (out << 1) | (n & 1), n >> 1
    return out


def slot_ranks(n: np.ndarray, low: np.ndarray, bits: int) -> np.ndarray:
    """How many m < n have mirrored(m) < low.

    The numbers below n fall into runs, one for each set bit j of n: the bits
    above j as in n, bit j zero, those below free. In a run the mirrored
    numbers lie evenly, 2 ** (bits - j) apart from the mirror of its fixed bits.
    """
    total, tail = np.zeros_like(n), np.zeros_like(n)  # tail: mirror of the bits of n above j
    for j in range(bits - 1, -1, -1):
        step = bits - j
        count = np.clip((low - tail + (1 << step) - 1) >> step, 0, 1 << j)
        on = (n >> j) & 1
        total += np.where(on == 1, count, 0)
        tail |= on << (step - 1)
    return total


def mixing_slots(sources: DataFrame, block: int = BLOCK) -> DataFrame:
    """(slot, no, epoch, block, upto): the schedule in order of slot; a slot reads ``upto`` words of its block at most, which is the rest of the quota in a source's last slot."""
    spark = sources.sparkSession
    prepare(spark)
    rows = sources.select("slots", "first", "blocks", "quota", "source_size").orderBy("no").collect()  # at most MAX_SOURCES
    need, first, blocks, quota, size = (np.array([r[c] for r in rows], dtype=np.int64) for c in range(5))
    total = int(need.sum())
    bits = max(1, (total - 1).bit_length())
    ends = first + need

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column(0).to_numpy()
            cell = mirrored(n, bits)
            n, cell = n[cell < total], cell[cell < total]
            no = np.searchsorted(ends, cell, side="right")
            rank = slot_ranks(n, ends[no], bits) - slot_ranks(n, first[no], bits)
            epoch, at = rank // np.maximum(blocks[no], 1), rank % np.maximum(blocks[no], 1)
            upto = np.minimum(block, quota[no] - epoch * size[no] - at * block)
            yield pa.RecordBatch.from_arrays([pa.array(n), pa.array(no.astype(np.int32)), pa.array(epoch.astype(np.int32)), pa.array(at), pa.array(upto)], names=["slot", "no", "epoch", "block", "upto"])

    n = 1 << bits if total else 0
    numbers = spark.range(0, n, 1, max(spark.sparkContext.defaultParallelism, n // TASK_SLOTS))
    return numbers.mapInArrow(run, "slot long, no int, epoch int, block long, upto long")


def mixing_schedule(placed: DataFrame, sources: DataFrame, block: int = BLOCK) -> DataFrame:
    """(slot, no, epoch, start, doc_id, shuffle, skip, take): which words of which document a slot reads, ``take`` words after the first ``skip``.

    Rows of one slot are read in order of start. Slots meet the documents of
    their block by source and block, of which no two are alike in size by more
    than a block.
    """
    blocks = placed.where("size > 0").select("no", "start", "doc_id", "shuffle", "size", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block))).alias("block"))
    met = mixing_slots(sources, block).join(blocks, ["no", "block"])
    begin = F.greatest(F.col("start"), F.col("block") * block)
    end = F.least(F.col("start") + F.col("size"), F.col("block") * block + F.col("upto"))
    return met.where(end > begin).select("slot", "no", "epoch", "start", "doc_id", "shuffle", (begin - F.col("start")).alias("skip"), (end - begin).alias("take"))


def mix_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[int] = WEIGHTS, most: int = MOST, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """The mix as two tables: a row per document (doc_id, source, size, source_size, target, taken), and the schedule of :func:`mixing_schedule`.

    taken is what the schedule's slots read of the document, repeats counted:
    at most ``most`` times its size. A source's documents give the whole words
    of its target together. Null texts and texts without words have size 0 and
    are never read; null sources are one source, the last; rows without an id
    and repeated rows are documents of their own. A source without words has
    target 0. Other columns of ``docs`` are not read. Runs agree: the order
    depends on ids and texts alone.
    """
    sized = keep(sized_documents(docs, doc_id, text, source))
    sources = mixing_sources(sized, weights, most, block)
    placed = placed_documents(sized, sources)
    schedule = mixing_schedule(placed, sources, block)
    # Documents that have words differ in where they start.
    taken = schedule.groupBy(F.col("no").alias("__no"), F.col("start").alias("__at")).agg(F.sum("take").alias("__taken"))
    same = (F.col("no") == F.col("__no")) & (F.col("start") == F.col("__at")) & (F.col("size") > 0)
    per = placed.join(taken, same, "left").withColumn("taken", F.coalesce("__taken", F.lit(0).cast("long")))
    return per.select("doc_id", "source", "size", "source_size", "target", "taken"), schedule


def mixed_texts(docs: DataFrame, schedule: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(slot, text) in words joined by one space: what each slot of a schedule of ``docs`` reads, in order of slot where sorted by it."""
    shuffle: Column = F.md5(F.concat_ws(":", F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.md5(F.coalesce(F.col(text), F.lit("")))))
    texts = docs.select(shuffle.alias("shuffle"), F.col(text).alias("t")).dropDuplicates(["shuffle"])
    words = F.slice(F.regexp_extract_all("t", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)), F.col("skip").cast("int") + 1, F.col("take").cast("int"))
    parts = schedule.join(texts, "shuffle").select("slot", F.struct("start", F.array_join(words, " ").alias("s")).alias("part"))
    joined = parts.groupBy("slot").agg(F.sort_array(F.collect_list("part")).alias("parts"))  # of one block, so bounded by its words
    return joined.select("slot", F.array_join(F.transform("parts", lambda p: p["s"]), " ").alias("text"))
