"""Benchmark decontamination by winnowing.

DataFrame functions only. A text's fingerprints are the hashes of its 5-word
grams that are the smallest of some window of six grams in a row; ten equal
words in two texts hold such a window, and its smallest gram is a fingerprint
of both. Documents and items therefore meet on fingerprints, and each meeting
is extended over the six 10-word windows around it: a window is shared if both
its 5-word halves are equal, compared by their two 64-bit hashes.

Fingerprints of documents are never shuffled while those of the benchmark are
few enough to be broadcast, which is checked; beyond that the join shuffles.
Hits are grouped by document, whose text bounds them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import by_keys, keep, lower_ascii, once

#: What stands between words: ASCII without letters and digits.
APART = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Words of a window and of a gram; grams in a window.
WINDOW, GRAM = 10, 5
GRAMS = WINDOW - GRAM + 1
#: Benchmark fingerprints (about 150 bytes each) that are still broadcast.
BROADCAST_ROWS = 200_000


def _split(text: Column) -> Column:
    """Cut between words, which takes less than a tenth of the time of matching each of them."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), APART), "")


def words_of(text: Column) -> Column:
    return _split(lower_ascii(text))


def _grams(rows: DataFrame) -> DataFrame:
    """Adds __h, the hashes of all 5-word grams of __w."""
    n = F.size("__w")
    gram = lambda i: F.xxhash64(*(F.get(F.col("__w"), i + k) for k in range(GRAM)))
    return rows.withColumn("__n", n).withColumn("__h", F.when(n >= WINDOW, F.transform(F.sequence(F.lit(0), n - GRAM), gram)).otherwise(F.array().cast("array<bigint>")))


def fingerprints(rows: DataFrame, text: str, *keys: Column) -> DataFrame:
    """(keys, fp, at, near): the fingerprints of each text of ten words or more.

    ``near`` holds the grams from five before to five after, null beyond the
    text, which is what extending needs.
    """
    hashed = _grams(once(rows.select(*keys, F.col(text).alias("__t")), "__w", words_of(F.col("__t"))).drop("__t"))
    h = F.col("__h")
    least = F.when(F.size(h) > 0, F.transform(F.sequence(F.lit(0), F.size(h) - GRAMS), lambda j: F.least(*(F.get(h, j + k) for k in range(GRAMS)))))
    hashed = hashed.drop("__w").withColumn("__m", least)
    pad = F.array_repeat(F.lit(None).cast("bigint"), GRAM)
    hashed = hashed.withColumn("__p", F.concat(pad, h, pad))
    m = F.col("__m")
    # A gram is the smallest of a window that has it if the largest of those windows' minima is its own hash.
    chosen = F.filter(F.sequence(F.lit(0), F.size(h) - 1), lambda i: F.greatest(*(F.get(m, i - k) for k in range(GRAMS))) == F.get(h, i))
    found = F.transform(chosen, lambda i: F.struct(F.get(h, i).alias("fp"), i.alias("at"), F.slice(F.col("__p"), i + 1, 2 * GRAM + 1).alias("near")))
    names = [c for c in hashed.columns if not c.startswith("__")]
    listed = hashed.select(*names, F.explode_outer(F.when(F.size(h) > 0, found)).alias("__f"))
    return listed.select(*names, "__f.*").where(F.col("fp").isNotNull())


def _windows(d: Column, i: Column, at: Column) -> Column:
    """Starts in the document of the 10-word windows around a common fingerprint that are equal on both sides."""
    equal = lambda o: (F.get(d, GRAM - o) == F.get(i, GRAM - o)) & (F.get(d, 2 * GRAM - o) == F.get(i, 2 * GRAM - o))
    return F.transform(F.filter(F.sequence(F.lit(0), F.lit(GRAMS - 1)), lambda o: F.coalesce(equal(o), F.lit(False))), lambda o: at - o)


def _runs(words: Column, n: int) -> Column:
    """All runs of ``n`` words, joined, with their starts and ``n``."""
    at = F.when(F.size(words) >= n, F.sequence(F.lit(0), F.size(words) - n)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.struct(i.alias("at"), F.lit(n).alias("len"), F.concat_ws(" ", *(F.get(words, i + k) for k in range(n))).alias("g")))


def window_hits(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", item_text: str = "text") -> DataFrame:
    """(d, key, item, starts, len): the windows of items that documents have; len is a window's words.

    An item with fewer words than a window is one window by itself; such items
    are compared word for word with the documents' grams of their lengths.
    """
    spark = docs.sparkSession
    of_items = fingerprints(items, item_text, F.col(item_id).alias("item")).select("item", F.col("fp").alias("ifp"), F.col("near").alias("inear"))
    if of_items.count() <= BROADCAST_ROWS:
        of_items = F.broadcast(of_items)
    of_docs = fingerprints(docs, text, F.col(doc_id).alias("d"), F.xxhash64(text).alias("key"))
    met = of_docs.join(of_items, of_docs["fp"] == of_items["ifp"])
    hits = once(met, "starts", _windows(F.col("near"), F.col("inear"), F.col("at"))).where(F.size("starts") > 0)
    hits = hits.select("d", "key", "item", "starts", F.lit(WINDOW).alias("len"))

    short = once(items, "w", words_of(F.col(item_text))).where((F.size("w") > 0) & (F.size("w") < WINDOW)).select(F.col(item_id).alias("item"), "w")
    lengths = sorted(r.n for r in short.select(F.size("w").alias("n")).distinct().collect())  # nine at most
    if not lengths:
        return hits
    short = short.select("item", F.size("w").alias("sn"), F.array_join("w", " ").alias("s"))
    if short.count() <= BROADCAST_ROWS:
        short = F.broadcast(short)
    rows = once(docs.select(F.col(doc_id).alias("d"), F.xxhash64(text).alias("key"), F.col(text).alias("t")), "w", words_of(F.col("t"))).where(F.size("w") >= lengths[0])
    runs = F.explode_outer(F.flatten(F.array(*(_runs(F.col("w"), n) for n in lengths))))
    rows = rows.select("d", "key", runs.alias("r")).select("d", "key", "r.*")
    met = rows.join(short, (rows["len"] == short["sn"]) & (rows["g"] == short["s"]))
    return hits.unionByName(met.select("d", "key", "item", F.array("at").alias("starts"), "len"))


def _spans_by_document(hits: DataFrame) -> DataFrame:
    """(__d, __k, __items, __hit) per document with a hit: the items, and how many words their windows cover."""
    spans = F.array_sort(F.flatten(F.collect_set(F.transform("starts", lambda s: F.struct(s.alias("s"), (s + F.col("len")).alias("e"))))))
    grouped = hits.groupBy("d", "key").agg(spans.alias("spans"), F.array_sort(F.collect_set(F.col("item").cast("string"))).alias("__items"))
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    step = lambda a, x: F.struct((a["n"] + F.greatest(x["e"] - F.greatest(a["end"], x["s"]), F.lit(0))).alias("n"), F.greatest(a["end"], x["e"]).alias("end"))
    return grouped.select(F.col("d").alias("__d"), F.col("key").alias("__k"), "__items", F.aggregate("spans", start, step, lambda a: a["n"]).alias("__hit"))


def contaminated_removed(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", item_text: str = "text") -> DataFrame:
    """``docs`` without the documents that hold a window of an item.

    Only ids and hashes of the few that go are joined; texts stay where they
    are. Null and empty texts stay; rows that share id and text go together.
    """
    gone = keep(window_hits(docs, items, doc_id, item_id, text, item_text).select(F.col("d").alias("__d"), F.col("key").alias("__k")).distinct())
    return by_keys(docs, gone, docs[doc_id].eqNullSafe(gone["__d"]) & (F.xxhash64(docs[text]) == gone["__k"]), "left_anti")


def decontaminate(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", item_text: str = "text") -> DataFrame:
    """``docs`` with n_words, n_hit (words inside a window of an item), item_ids (strings, sorted) and contaminated.

    Null and empty texts have no words, on either side. Rows that share id and
    text get the same result; an empty benchmark hits nothing. Columns of
    ``docs`` named like an added one are replaced.
    """
    docs = docs.drop("n_words", "n_hit", "item_ids", "contaminated")
    hits = window_hits(docs, items, doc_id, item_id, text, item_text)
    grouped = _spans_by_document(hits)
    base = docs.withColumn("n_words", F.size(_split(F.col(text))).cast("long")).withColumn("__key", F.xxhash64(text))
    joined = base.join(grouped, base[doc_id].eqNullSafe(grouped["__d"]) & (base["__key"] == grouped["__k"]), "left")
    return (
        joined.withColumn("n_hit", F.coalesce("__hit", F.lit(0)).cast("long"))
        .withColumn("item_ids", F.coalesce("__items", F.array().cast("array<string>")))
        .withColumn("contaminated", F.col("n_hit") > 0)
        .drop("__d", "__k", "__key", "__hit", "__items")
    )
