"""Substring deduplication by a relative Lempel-Ziv parse of documents against the earlier ones.

The reference holds every phrase of ``window`` words once: where it first
occurs, by document id and place. Its index is dealt over partitions (the
reference blocks) by the phrases' hash, and each document is factored against
every block:

* A factor starts at the first phrase that an earlier document holds. As a
  phrase stands once in the reference, the longest match from there is known:
  the factor grows while the next phrase is the reference's next one.
* Where a factor ends, its boundary is checked: the phrases that lie across it
  are looked up as well, and the first that the reference holds starts the next
  factor, which may overlap the last. Factors have ``window`` words or more, so
  their spans are the words to remove.

What can't be of a factor is not looked up:

* Texts that are whole copies need no phrases: all but the earliest of them are
  one factor.
* Of the others, each text reports its content-defined anchors (25-word runs
  whose hash is the smallest of some 26 in a row: every phrase holds one, and
  equal phrases hold equal ones). An anchor that occurs in one text only rules
  its phrases out.

What meets by key is a minimum and a maximum over texts, added up per task
before the shuffle, however often an anchor occurs. Phrases go to their block
once, in the order of documents, and the block is read as a stream. Phrases
around an anchor that very many texts have are dealt over several tasks by
document; the firsts of these shares meet afterwards. Texts are shuffled only
if they may have phrases to look up or factors, as a sieve of their ids tells.
Phrases are compared by two 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import Tables, by_keys, keep, prepare, sifted
from .wordhash import BASES, minima, run_hashes, sliding, word_hashes

WINDOW, GRAM = 50, 25
#: An anchor of more texts than this is hot: phrases with it are dealt over SALTS tasks by their document.
HOT, SALTS = 1_000, 64


def _text_hash(words: list[bytes]) -> int:
    return xxhash.xxh3_64_intdigest(b" ".join(words))


def _signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def _thinned(grams: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """Anchors less those that an equal one before and an equal one after make needless.

    Text that repeats a few words has equal minima everywhere; each ``width``
    grams in a row still hold one of those that stay.
    """
    same = grams[at[1:]] == grams[at[:-1]]
    if not same.any():
        return at
    keep_it, last = np.ones(len(at), bool), 0
    for k in np.flatnonzero(same[:-1] & same[1:]) + 1:
        last = k - 1 if keep_it[k - 1] else last
        keep_it[k] = at[k + 1] - at[last] > width
    return at[keep_it]


def text_anchors(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, text_hash, n_words, anchors, places) per document with an id and ``window`` words or more."""
    gram = min(GRAM, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes, sizes, anchors, places = [], [], [], [], []
            for d, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = (t.as_py() or "").encode("utf-8", "surrogatepass").split()
                if d is None or len(words) < window:
                    continue
                grams = run_hashes(word_hashes(words), gram)
                at = _thinned(grams, minima(grams, window - gram + 1), window - gram + 1)
                ids.append(d)
                hashes.append(_text_hash(words))
                sizes.append(len(words))
                anchors.append(_signed(grams[at]))
                places.append(at.astype(np.int32))
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(a) for a in anchors])]).astype(np.int32))
            flat = lambda parts, kind: pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(parts) if parts else np.zeros(0, kind)))  # noqa: E731, B023
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(np.array(hashes, np.uint64).view(np.int64)), pa.array(sizes, pa.int32()), flat(anchors, np.int64), flat(places, np.int32)],
                names=["doc_id", "text_hash", "n_words", "anchors", "places"],
            )

    prepare(docs.sparkSession)
    return docs.mapInArrow(run, "doc_id long, text_hash long, n_words int, anchors array<long>, places array<int>")


def _phrases(rows: DataFrame, window: int) -> DataFrame:
    """(doc_id, text_hash, p1, p2, at, salt): the phrases of each text that hold one of its ``places``.

    An id can have several texts; the hash tells which of them the places are
    of. A phrase whose smallest anchor is among ``hot`` has a salt by its
    document, any other 0.
    """
    gram = min(GRAM, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for d, t, own, places, hot in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), batch.column(3), batch.column(4)):
                words = t.as_py().encode("utf-8", "surrogatepass").split()
                if _text_hash(words) != own & (1 << 64) - 1:
                    continue
                hashes = word_hashes(words)
                n = len(hashes) - window + 1
                mark = np.zeros(n + 1, np.int64)
                at = places.values.to_numpy(zero_copy_only=False)
                np.add.at(mark, np.maximum(at - (window - gram), 0), 1)
                np.add.at(mark, np.minimum(at + 1, n), -1)
                starts = np.flatnonzero(np.cumsum(mark[:-1]) > 0)
                salt = np.zeros(len(starts), np.int32)
                if len(hot):
                    least = sliding(run_hashes(hashes, gram), window - gram + 1, np.minimum)[starts]
                    salt[np.isin(_signed(least), hot.values.to_numpy(zero_copy_only=False))] = 1 + d % SALTS
                out.append((np.full(len(starts), d), np.full(len(starts), own), *(_signed(run_hashes(hashes, window, b)[starts]) for b in BASES), starts.astype(np.int32), salt))
                if sum(len(x[0]) for x in out) > 100_000:
                    yield _columns(out)
                    out = []
            if out:
                yield _columns(out)

    def _columns(out):
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=["doc_id", "text_hash", "p1", "p2", "at", "salt"])

    return rows.mapInArrow(run, "doc_id long, text_hash long, p1 long, p2 long, at int, salt int")


def lz_factors(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, text_hash, starts, lengths, sources, source_starts): the factors of each document, in words, ``window`` words or longer.

    ``docs`` has the columns doc_id (long) and text. A factor's words are those
    of its source, the earliest document with its phrases, from source_starts
    on. Documents without a factor have no row; a null id has none.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    with Tables(docs.sparkSession) as tables:
        texts = tables.keep(text_anchors(docs, window))
        member = texts.select("doc_id", "text_hash", "n_words")
        first = member.groupBy("text_hash", "n_words").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
        first = first.where(F.col("first") < F.col("last")).select("text_hash", "n_words", "first")
        copied = tables.keep(by_keys(member, tables.keep(first), ["text_hash", "n_words"], "inner").where(F.col("first") < F.col("doc_id")))
        copies = copied.select("doc_id", "text_hash", F.array(F.lit(0)).alias("starts"), F.array("n_words").alias("lengths"), F.array("first").alias("sources"), F.array(F.lit(0)).alias("source_starts"))

        # An anchor of two different texts: the smallest and the largest hash of its texts differ.
        pairs = texts.select("text_hash", F.explode(F.array_distinct("anchors")).alias("anchor"))
        met = pairs.groupBy("anchor").agg(F.min("text_hash").alias("a"), F.max("text_hash").alias("b"), (F.count("*") > HOT).alias("hot"))
        shared = tables.keep(met.where("a != b").select("anchor", "hot"))  # a table of its own, so that Spark can split an anchor that many texts have
        own = by_keys(texts, copied.select("doc_id", "text_hash"), ["doc_id", "text_hash"], "left_anti")
        places = own.select("doc_id", "text_hash", F.explode(F.arrays_zip("anchors", "places")).alias("x")).select("doc_id", "text_hash", F.col("x.anchors").alias("anchor"), F.col("x.places").alias("place"))
        places = places.join(shared, "anchor").groupBy("doc_id", "text_hash").agg(F.collect_set("place").alias("places"), F.collect_set(F.when(F.col("hot"), F.col("anchor"))).alias("hot"))
        places = tables.keep(places)
        tables.drop(texts, shared)

        whole = sifted(docs.where(F.col("text").isNotNull()), F.col("doc_id"), places.select("doc_id")).where("__maybe")
        own = whole.join(places.hint("merge"), "doc_id").select("doc_id", "text", "text_hash", "places", "hot")
        dealt = _phrases(own, window).repartition("p1", "salt").sortWithinPartitions("p1", "p2", "salt", "doc_id", "at")
        found = tables.keep(_in_reference(dealt))
        # Hot phrases have a first document in each of their shares; the reference's is the first of these.
        hot = found.where(F.col("p1").isNotNull())
        heads = tables.keep(hot.groupBy("p1", "p2").agg(F.min(F.struct("source", "place")).alias("h")).select("p1", "p2", "h.*"))
        of_hot = by_keys(hot.drop("source", "place"), heads, ["p1", "p2"], "inner").where(F.col("source") < F.col("doc_id"))
        names = ["doc_id", "text_hash", "at", "source", "place"]
        found = found.where(F.col("p1").isNull()).select(names).unionByName(of_hot.select(names))
        found = found.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("at", "source", "place")).alias("found"))
        return keep(copies.unionByName(_greedy(found, window)))


def _in_reference(rows: DataFrame) -> DataFrame:
    """(doc_id, text_hash, at, source, place, p1, p2): the phrases that an earlier document holds, with where the reference has them.

    ``rows`` come by phrase, salt, document and place, so a phrase's first row
    is the reference's. Salted phrases are all returned, with their p1 and p2
    and the first row of their share.
    """
    names = ["doc_id", "text_hash", "at", "source", "place", "p1", "p2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the phrase that the batch before ended in, with its first document and place
        for batch in batches:
            if not batch.num_rows:
                continue
            doc, own, p1, p2, at, salt = (batch.column(k).to_numpy() for k in range(6))
            new = np.ones(len(doc), bool)
            new[1:] = (p1[1:] != p1[:-1]) | (p2[1:] != p2[:-1]) | (salt[1:] != salt[:-1])
            if goes_on := held is not None and (p1[0], p2[0], salt[0]) == held[:3]:
                new[0] = False
            start = np.flatnonzero(new)
            group = np.cumsum(new) - (not goes_on)
            source, place = doc[start], at[start]
            if goes_on:
                source, place = (np.concatenate([[h], x]).astype(x.dtype) for h, x in ((held[3], source), (held[4], place)))
            held = (p1[-1], p2[-1], salt[-1], source[-1], place[-1])
            source, place = source[group], place[group]
            if (out := (source < doc) | (salt > 0)).any():
                cold = salt[out] == 0
                yield pa.RecordBatch.from_arrays([*(pa.array(x[out]) for x in (doc, own, at, source, place)), *(pa.array(x[out], mask=cold) for x in (p1, p2))], names=names)

    return rows.mapInArrow(run, "doc_id long, text_hash long, at int, source long, place int, p1 long, p2 long")


def _greedy(found: DataFrame, window: int) -> DataFrame:
    """The factors of each document, from left to right: a phrase that is not the last one's next in the reference starts one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            phrases = batch.column(2)
            row = np.repeat(np.arange(batch.num_rows), phrases.value_lengths().to_numpy())
            at, source, place = (x.to_numpy() for x in phrases.flatten().flatten())
            order = np.lexsort((at, row))
            row, at, source, place = (x[order] for x in (row, at, source, place))
            new = np.ones(len(row), bool)
            new[1:] = (row[1:] != row[:-1]) | (at[1:] != at[:-1] + 1) | (source[1:] != source[:-1]) | (place[1:] != place[:-1] + 1)
            start = np.flatnonzero(new)
            lengths = (np.diff(np.append(start, len(row))) + window - 1).astype(np.int32)
            offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row[start], minlength=batch.num_rows))]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (at[start], lengths, source[start], place[start])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *lists], names=["doc_id", "text_hash", "starts", "lengths", "sources", "source_starts"])

    return found.mapInArrow(run, "doc_id long, text_hash long, starts array<int>, lengths array<int>, sources array<long>, source_starts array<int>")


def dedup_substrings(docs: DataFrame, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text", digest: bool = False) -> DataFrame:
    """``docs`` without the words that windows shared with a smaller id cover.

    Adds n_words and n_removed; where words went, ``text`` becomes the kept
    words joined by one space, else it stays as it is. With ``digest``, adds
    kept_sha256 (of the kept words joined by one space) instead of changing
    the text. Words are runs of other than ASCII white space. A null text has
    no words and stays null. Texts shorter than ``window`` words lose nothing.
    Rows of one id and text are one document; a null id is no reference and
    loses nothing. Columns of ``docs`` named like an added one are replaced.
    """
    prepare(docs.sparkSession)
    added = ["n_words", "n_removed"] + ["kept_sha256"] * digest
    docs = docs.drop(*added)
    factors = lz_factors(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), window)
    of_each = factors.groupBy(F.col("doc_id").alias("__d")).agg(F.collect_set(F.struct("text_hash", "starts", "lengths")).alias("__factors"))
    order = [c for c in docs.columns if c != text]
    names = [*(f"`{c}`" for c in order), f"`{text}`", "__factors"]
    # Only texts that may have factors are shuffled.
    told = sifted(docs, F.col(f"`{doc_id}`").cast("long"), factors.select("doc_id"))
    having = told.where("__maybe").join(of_each.hint("merge"), F.col(f"`{doc_id}`").cast("long") == F.col("__d"), "left").select(*names)
    joined = having.unionByName(told.where("NOT __maybe").withColumn("__factors", F.lit(None).cast(of_each.schema["__factors"].dataType)).select(*names))
    schema = docs.select(*(F.col(f"`{c}`") for c in [*order, text])).schema
    for name in added:
        schema = schema.add(name, "string" if name == "kept_sha256" else "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {n: [] for n in ("text", *added)}
            for t, given in zip(batch.column(len(order)), batch.column(len(order) + 1)):
                plain = t.as_py()
                words = (plain or "").encode("utf-8", "surrogatepass").split()
                kept = words
                if (given := given.as_py()) and words:
                    own = _text_hash(words)
                    gone = np.zeros(len(words) + 1, np.int64)
                    for f in given:
                        if f["text_hash"] & (1 << 64) - 1 == own:
                            for start, length in zip(f["starts"], f["lengths"]):
                                gone[start] += 1
                                gone[start + length] -= 1
                    stays = np.cumsum(gone[:-1]) == 0
                    if not stays.all():
                        kept = [w for w, s in zip(words, stays) if s]
                out["text"].append(plain if digest or len(kept) == len(words) else b" ".join(kept).decode("utf-8", "surrogatepass"))
                out["n_words"].append(len(words))
                out["n_removed"].append(len(words) - len(kept))
                if digest:
                    out["kept_sha256"].append(hashlib.sha256(b" ".join(kept)).hexdigest())
            kinds = {"n_words": pa.int64(), "n_removed": pa.int64()}
            arrays = [pa.array(out[n], kinds.get(n, pa.string())) for n in ("text", *added)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(order)], *arrays], names=[*batch.schema.names[: len(order) + 1], *added])

    done = joined.mapInArrow(run, schema)
    return done.select(*(F.col(f"`{c}`") for c in docs.columns), *added)
