"""Quality rules: repetition and length rules inside a document, and the frequency of its lines across documents.

DataFrame functions only. Line frequency: lines are normalised (A-Z lower
case, white space runs one space) and hashed; a line's frequency is the number
of documents of the same host that have it. Lines of more than ``max_docs``
documents are boilerplate and go, except in the document with the host's
smallest id that has them: so of many copies the first stays whole. A document
that keeps less than ``min_left`` of its words is depleted and rejected.

Rows that have a line are counted first, each row reporting its lines once, in
partial sums per task: so neither a host with a third of all rows nor a line
that all documents have gathers in one task. That is the only exchange of all
lines. The few that more than ``max_docs`` rows have are looked up in the texts
again, and counted by document: these counts decide.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import Tables, by_keys, keep, lower_ascii, once

WORD = r"[^\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"
#: Documents of one host that may share a line; share of its words that a document must keep.
MAX_DOCS, MIN_LEFT = 20, 0.2
#: Words of a window whose repetition counts; the least words; the most repeated words in percent.
REPEAT, MIN_WORDS, MAX_REPEAT = 5, 10, 20
#: Columns of the result.
ADDED = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_line_words", "kept"]


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def _repeated(words: Column, grams: Column) -> Column:
    """How many words lie in windows that occur twice or more; ``grams`` are the windows' hashes."""
    ordered = F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def twins(x: Column) -> Column:
        """Positions of windows with an equal neighbour in hash order."""
        at = F.sequence(F.lit(0), F.size(x) - 1)
        same = lambda k: F.coalesce(F.get(x, k)["h"] == F.get(x, k + 1)["h"], F.lit(False))
        return F.array_sort(F.transform(F.filter(at, lambda k: same(k) | same(k - 1)), lambda k: F.get(x, k)["i"]))

    def covered(at: Column) -> Column:
        start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
        step = lambda a, p: F.struct((a["n"] + p + REPEAT - F.greatest(a["end"], p)).alias("n"), (p + REPEAT).alias("end"))
        return F.aggregate(at, start, step, lambda a: a["n"])

    # An array of one, so that the sorted windows are made once and not for each position.
    single = F.transform(F.array(ordered), lambda x: covered(twins(x)))
    return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0)).otherwise(F.get(single, F.lit(0)))


def document_rules(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) and base_failed.

    A null text has no words and fails. One projection; no shuffle.
    """
    has_word = lambda line: line.rlike(WORD)
    given = docs.withColumn("__t", F.coalesce(F.col(text), F.lit("")))
    given = once(given, "__w", words_of(F.col("__t"))).withColumn("__l", F.filter(F.split("__t", "\n"), has_word))
    n = F.size("__w")
    gram = lambda i: F.xxhash64(*(F.get(F.col("__w"), i + k) for k in range(REPEAT)))
    given = given.withColumn("__n", n).withColumn("__g", F.when(n >= REPEAT, F.transform(F.sequence(F.lit(0), n - REPEAT), gram)).otherwise(F.array().cast("array<bigint>")))
    repeated = _repeated(F.col("__w"), F.col("__g"))
    given = (
        given.withColumn("n_words", F.col("__n").cast("long"))
        .withColumn("word_chars", F.length(F.regexp_replace("__t", r"[\x20\x09-\x0D]+", "")).cast("long"))
        .withColumn("n_symbols", (F.length("__t") - F.length(F.translate("__t", "#*$%&|<>", ""))).cast("long"))
        .withColumn("n_dup_lines", (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long"))
    )
    given = once(given, "n_repeat_words", repeated.cast("long"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    return given.withColumn("base_failed", failed).drop("__t", "__w", "__l", "__n", "__g")


def _normalised(line: Column) -> Column:
    return F.trim(F.regexp_replace(lower_ascii(line), r"[\x20\x09-\x0D]+", " "))


def document_lines(docs: DataFrame, doc_id: str, text: str, host: str) -> DataFrame:
    """(d, key, host, line, n): id, text hash and host of a document with each of its normalised lines, as a hash, and its words; a line comes as often as the text has it."""
    lines = F.filter(F.transform(F.split(text, "\n"), _normalised), lambda s: s != "")
    rows = docs.select(F.col(doc_id).alias("d"), F.xxhash64(text).alias("key"), F.col(host).alias("host"), F.explode_outer(lines).alias("s")).where(F.col("s").isNotNull())
    n = F.length("s") - F.length(F.translate("s", " ", "")) + 1
    return rows.select("d", "key", "host", F.xxhash64("s").alias("line"), n.alias("n"))


def possible_lines(docs: DataFrame, text: str, host: str, max_docs: int = MAX_DOCS) -> DataFrame:
    """(of, often): host and hash of lines that more than ``max_docs`` rows of a host have; all that more documents have, and those of repeated rows."""
    lines = F.array_distinct(F.transform(F.filter(F.transform(F.split(text, "\n"), _normalised), lambda s: s != ""), lambda s: F.xxhash64(s)))
    rows = docs.select(F.col(host).alias("of"), F.explode_outer(lines).alias("often")).where(F.col("often").isNotNull())
    return rows.groupBy("of", "often").agg(F.count("*").alias("rows")).where(F.col("rows") > max_docs).select("of", "often")


def frequent_lines(lines: DataFrame, max_docs: int = MAX_DOCS) -> DataFrame:
    """(of, often, first): host and hash of lines of more than ``max_docs`` documents of a host, with the smallest id that has each; ``lines`` has each line of a document once."""
    counted = lines.groupBy("host", "line").agg(F.count("*").alias("docs"), F.min("d").alias("first"))
    return counted.where(F.col("docs") > max_docs).select(F.col("host").alias("of"), F.col("line").alias("often"), "first")


def quality_rules(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source", max_docs: int = MAX_DOCS, min_left: float = MIN_LEFT) -> DataFrame:
    """``docs`` with the columns of :func:`document_rules`, n_line_words (words in lines that go) and kept.

    kept is false if the base rules fail, or if the lines that other documents
    of the host share leave less than ``min_left`` of the words. Null texts
    have no words: not kept. Rows of one id and text get one result each; rows
    without an id have lines like others but are never the first. Null hosts
    are one host. Columns of ``docs`` named like an added one are replaced.
    """
    docs = docs.drop(*ADDED)
    return _ruled(docs, _gone_lines(docs, doc_id, text, host, max_docs), doc_id, text, host, min_left).drop("__lines")


def _gone_lines(docs: DataFrame, doc_id: str, text: str, host: str, max_docs: int) -> DataFrame:
    """(__d, __k, __h, __gone, __lines) per document that loses lines: how many words they have, and their hashes; a written table."""
    with Tables(docs.sparkSession) as tables:
        possible = tables.keep(possible_lines(docs, text, host, max_docs))
        same = F.col("host").eqNullSafe(F.col("of")) & (F.col("line") == F.col("often"))
        found = by_keys(document_lines(docs, doc_id, text, host), possible, same, "left_semi")
        lines = tables.keep(found.groupBy("d", "key", "host", "line").agg(F.sum("n").alias("n")))
        often = frequent_lines(lines, max_docs)
        return keep(
            lines.join(often, same & ~F.col("d").eqNullSafe(F.col("first")))
            .groupBy(F.col("d").alias("__d"), F.col("key").alias("__k"), F.col("host").alias("__h"))
            .agg(F.sum("n").alias("__gone"), F.collect_set("line").alias("__lines"))  # of one document, so bounded by its text
        )


def _ruled(docs: DataFrame, gone: DataFrame, doc_id: str, text: str, host: str, min_left: float, join: Callable[..., DataFrame] = DataFrame.join) -> DataFrame:
    """The result of :func:`quality_rules` with __lines, the hashes of the lines that go (null if none); ``gone`` is that of :func:`_gone_lines`."""
    ruled = document_rules(docs, text).withColumn("__key", F.xxhash64(text))
    joined = join(ruled, gone, F.col(doc_id).eqNullSafe(F.col("__d")) & (F.col("__key") == F.col("__k")) & F.col(host).eqNullSafe(F.col("__h")), "left")
    n_gone = F.coalesce("__gone", F.lit(0)).cast("long")
    depleted = F.col("n_words") - n_gone < min_left * F.col("n_words")
    return joined.withColumn("n_line_words", n_gone).withColumn("kept", ~F.col("base_failed") & ~depleted).drop("__d", "__k", "__h", "__key", "__gone")


def remove_frequent_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source", max_docs: int = MAX_DOCS) -> DataFrame:
    """``docs`` whose texts lack the lines that :func:`quality_rules` counts as gone; other lines stay as they are."""
    gone = _gone_lines(docs, doc_id, text, host, max_docs).drop("__gone")
    keyed = docs.withColumn("__key", F.xxhash64(text))
    joined = keyed.join(gone, F.col(doc_id).eqNullSafe(F.col("__d")) & (F.col("__key") == F.col("__k")) & F.col(host).eqNullSafe(F.col("__h")), "left")
    return joined.withColumn(text, _without(text, "__lines")).drop("__d", "__k", "__h", "__key", "__lines")


def _without(text: str, gone: str) -> Column:
    """The text without the lines whose hashes ``gone`` has."""
    stays = lambda line: ~F.array_contains(F.col(gone), F.xxhash64(_normalised(line)))
    return F.when(F.col(gone).isNull(), F.col(text)).otherwise(F.array_join(F.filter(F.split(text, "\n"), stays), "\n"))


def clean_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source", max_docs: int = MAX_DOCS, min_left: float = MIN_LEFT) -> DataFrame:
    """The documents that :func:`quality_rules` keeps, their texts without the lines that it counts as gone; frequencies are those of all of ``docs``.

    The lines that go are written first, by document. Texts stay where they
    are while the documents that lose lines are few enough to be broadcast;
    beyond that both are shuffled.
    """
    given = docs.drop(*ADDED)
    gone = _gone_lines(given, doc_id, text, host, max_docs)
    kept = _ruled(given, gone, doc_id, text, host, min_left, by_keys).where("kept")
    return kept.withColumn(text, _without(text, "__lines")).select(*(F.col(f"`{c}`") for c in docs.columns))
