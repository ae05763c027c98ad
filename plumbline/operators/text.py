"""Checks of text columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.strings import SYLLABIC, TEXT_PROPERTIES, UNSPECIAL, at_hand, count_syllables, normalize_text, split_sentences, split_words
from ..sources.scratch import kept_at, remove
from . import kernels


def _normal(df: DataFrame, text: str, **options) -> DataFrame:
    """(norm, ...): a 128-bit digest of the normalised text stands for it, so that long texts are not shuffled."""
    return df.withColumn("norm", F.md5(normalize_text(F.col(text), **options)))


def text_duplicates(df: DataFrame, text: str, **options) -> DataFrame:
    """(percent, n_rows, n_unique) over normalised texts, nulls left out."""
    groups = _normal(df.where(F.col(text).isNotNull()).select(text), text, **options).groupBy("norm").agg(F.count("*").alias("n"))
    return groups.agg((1 - F.count("*") / F.sum("n")).alias("percent"), F.sum("n").alias("n_rows"), F.count("*").alias("n_unique"))


def text_conflicting_labels(df: DataFrame, text: str, label: str, **options) -> DataFrame:
    """(percent, n_conflicting): rows whose normalised text occurs with several labels."""
    pairs = _normal(df.where(F.col(text).isNotNull()).select(text, label), text, **options).groupBy("norm", label).agg(F.count("*").alias("n"))
    groups = pairs.groupBy("norm").agg(F.sum("n").alias("n"), F.count("*").alias("k"))
    bad = F.sum(F.when(F.col("k") > 1, F.col("n")).otherwise(0))
    return groups.agg((bad / F.sum("n")).alias("percent"), bad.alias("n_conflicting"))


def text_samples_mix(train: DataFrame, test: DataFrame, text: str, **options) -> DataFrame:
    """(ratio, n_common): test texts whose normalised form train has."""
    from .train_test import samples_mix

    return samples_mix(*(_normal(df.where(F.col(text).isNotNull()).select(text), text, **options).select("norm") for df in (train, test)), ["norm"])


def text_special_characters(df: DataFrame, text: str, allowed: str = UNSPECIAL) -> DataFrame:
    """(char, n_texts, ratio): texts that have each character outside the allowed class."""
    rows = df.where(F.col(text).isNotNull()).select(F.array_distinct(F.split(F.regexp_replace(text, f"[{allowed}]", ""), "")).alias("c"))
    n = df.where(F.col(text).isNotNull()).agg(F.count("*").alias("t"))
    chars = rows.select(F.explode("c").alias("char")).where("char != ''").groupBy("char").agg(F.count("*").alias("n_texts"))
    return chars.crossJoin(F.broadcast(n)).select("char", "n_texts", (F.col("n_texts") / F.col("t")).alias("ratio"))


def text_properties(df: DataFrame, text: str, properties: list[str] | None = None, extra: dict[str, Column] | None = None) -> DataFrame:
    """``df`` with one column per property; null texts have null properties. Model-backed ones come in through ``extra``."""
    chosen: dict[str, Callable[[Column], Column]] = {p: TEXT_PROPERTIES[p] for p in properties or TEXT_PROPERTIES}
    given = df.columns
    # Split and counted once per row: a generator stands between, so this is not copied into every property.
    syllables = count_syllables if any(p in SYLLABIC for p in chosen) else lambda w: F.lit(None).cast("int")
    split = F.explode_outer(F.transform(F.array(split_words(F.col(text))), lambda w: F.struct(w.alias("w"), split_sentences(F.col(text)).alias("s"), syllables(w).alias("y"))))
    rows = df.select("*", split.alias("__split"))
    with at_hand(F.col("__split.w"), F.col("__split.s"), F.col("__split.y")):
        made = {n: f(F.col(text)) for n, f in chosen.items()}
    new = {n: F.when(F.col(text).isNotNull(), c).alias(n) for n, c in {**made, **(extra or {})}.items()}
    return rows.select(*(F.col(f"`{c}`") for c in given if c not in new), *new.values())


def property_outliers(df: DataFrame, text: str, properties: list[str], scale: float = 2.0) -> DataFrame:
    """(feature, low, high, n_outliers, ratio) of numeric text properties."""
    from .integrity import iqr_outliers

    return iqr_outliers(text_properties(df, text, properties), properties, (25, 75), scale)


def category_outliers(df: DataFrame, column: str) -> DataFrame:
    """(value, share) of a column's rare categories behind a sharp drop."""
    return kernels.sharp_drop(df.groupBy(column).agg(F.count("*").alias("n")), column, "n")


def property_drift(train: DataFrame, test: DataFrame, text: str, properties: list[str]) -> DataFrame:
    from .train_test import feature_drift

    return feature_drift(*(text_properties(df.select(text), text, properties) for df in (train, test)), properties, [])


def unknown_tokens(df: DataFrame, text: str, vocabulary: DataFrame, word: str = "word") -> DataFrame:
    """(word, n): words of the texts (lower case) that a vocabulary table lacks; counted before they are looked up."""
    counts = df.select(F.explode(F.split(F.lower(text), r"[^\p{L}\p{N}]+")).alias("word")).where("word != ''").groupBy("word").agg(F.count("*").alias("n"))
    known = vocabulary.select(F.col(word).alias("known")).distinct()
    return counts.join(known, counts["word"] == known["known"], "left_anti")


#: Lengths of word runs that are counted in one round.
LENGTHS = 16
#: Counters that runs share in a first count: 1.3 MB a task. They tell frequent runs while a text has far fewer runs than counters times the least ratio.
COUNTERS = 1 << 17


def _frequent_runs(rows: DataFrame, n: int, last: int, least: float) -> dict[str, int]:
    """The runs of ``n`` to ``last`` words that at least ``least`` rows have in their parts, with the number of rows.

    A first count adds up runs by counters, so that only runs of full counters are shuffled, whatever the number of runs.
    """
    of_part = lambda w: F.flatten(F.transform(F.sequence(F.lit(n), F.least(F.size(w), F.lit(last))), lambda k: F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: F.array_join(F.slice(w, i + 1, k), " "))))
    grams = rows.select(F.explode(F.array_distinct(F.flatten(F.transform(F.filter("parts", lambda w: F.size(w) >= n), of_part)))).alias("g"))
    grams = grams.withColumn("at", F.pmod(F.xxhash64("g"), F.lit(COUNTERS)).cast("int"))
    full = grams.groupBy("at").agg(F.count("*").alias("k")).where(F.col("k") >= least).select("at")
    often = grams.join(F.broadcast(full), "at", "left_semi").groupBy("g").agg(F.count("*").alias("k")).where(F.col("k") >= least)
    return {r.g: r.k for r in often.collect()}


def _stretches(frequent: set[str], length: int):
    """For ``mapInArrow`` over parts of texts: the stretches of words in which every run of ``length`` is frequent."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for parts in batch.column(0).to_pylist():
                cut = []
                for w in parts:
                    start = None  # where the stretch at hand begins
                    for i in range(len(w) - length + 1):
                        if " ".join(w[i : i + length]) in frequent:
                            start = i if start is None else start
                        elif start is not None:
                            cut.append(w[start : i - 1 + length])
                            start = None
                    if start is not None:
                        cut.append(w[start:])
                out.append(cut)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.list_(pa.string())))], names=["parts"])

    return run


def frequent_substrings(df: DataFrame, text: str, min_words: int = 4, min_ratio: float = 0.05, n_sentences: int = 5, significant_ratio: float = 0.3, margin: float = 0.02, min_change: float = 0.05) -> DataFrame:
    """(substring, n_texts, ratio): the longest word runs in the first and last sentences that many texts share.

    Runs of ``min_words`` and more in at least ``min_ratio`` of the texts. The
    shortest are counted first; a text is then cut to the stretches in which
    all of them are frequent, as longer frequent runs lie inside these. So it
    goes on with ``LENGTHS`` lengths a round. Of runs inside
    one another the longest stays, unless a shorter one is more frequent by
    more than ``margin``. By frequency, those before the steepest drop of over
    ``min_change`` stay, and those of ``significant_ratio``. What is frequent
    is collected: its number is bounded by the words of a text's sentences
    over ``min_ratio``, whatever the number of texts.
    """
    s = F.filter(F.split(F.lower(text), r"(?<=[.!?])\s+"), lambda x: F.trim(x) != "")
    ends = F.when(F.size(s) <= 2 * n_sentences, s).otherwise(F.concat(F.slice(s, 1, n_sentences), F.slice(s, -n_sentences, n_sentences)))
    given = df.where(F.col(text).isNotNull())
    total = given.count()
    rows = given.select(F.array(F.filter(F.split(F.array_join(ends, " "), r"\s+"), lambda w: w != "")).alias("parts"))
    rows, place = kept_at(rows.where(F.size(F.col("parts")[0]) >= min_words))
    found: dict[str, int] = {}
    n = last = min_words
    while True:
        # Several lengths in one pass, as many texts share long passages; shorter runs of one frequent run are all frequent.
        often = _frequent_runs(rows, n, last, min_ratio * total)
        found.update(often)
        longest = {g for g in often if g.count(" ") == last - 1}
        if not longest:
            break
        before = place
        rows, place = kept_at(rows.mapInArrow(_stretches(longest, last), "parts array<array<string>>").where(F.size("parts") > 0))
        n, last = last + 1, last + LENGTHS
        remove(df.sparkSession, before)
    remove(df.sparkSession, place)
    kept = _frequency_cut(_longest_runs({g: k / total for g, k in found.items()}, margin), significant_ratio, min_change)
    return df.sparkSession.createDataFrame([(g, found[g], ratio) for g, ratio in kept], "substring string, n_texts long, ratio double")


def _longest_runs(ratio: dict[str, float], margin: float) -> dict[str, float]:
    """Without runs inside longer ones; a shorter one that is more frequent by over ``margin`` takes the longer one's place."""
    left = dict(sorted(ratio.items(), key=lambda x: (-len(x[0]), x[0])))
    for run in list(left):
        if run not in left:
            continue
        for other in list(left):
            if other != run and other in left and other in run:
                if left[other] - left[run] <= margin:
                    del left[other]
                else:
                    del left[run]
                    run = other
    return left


def _frequency_cut(ratio: dict[str, float], significant: float, min_change: float) -> list[tuple[str, float]]:
    """The runs before the steepest relative drop of frequency, or all significant ones if those are more."""
    ranked = sorted(ratio.items(), key=lambda x: (x[1], x[0]), reverse=True)
    if len(ranked) <= 1:
        return ranked
    drops = [(a - b) / a for (_, a), (_, b) in zip(ranked, ranked[1:])]
    steepest = max(drops)
    peak = drops.index(steepest) + 1 if steepest > min_change else len(ranked)
    return ranked[: max(sum(r >= significant for _, r in ranked), peak)]


def _spans(tags: str):
    """For ``transform`` over a column of IOB tags: an array of (entity, first, last), one for each span; ``tags`` is evaluated at each reference, so it is a column that is at hand."""
    t = F.col(tags)
    kind = lambda x: F.when((x != "O") & x.isNotNull(), F.when(x.substr(1, 2).isin("B-", "I-", "O-"), x.substr(F.lit(3), F.length(x))).otherwise(x))
    marked = F.filter(F.transform(t, lambda x, i: F.struct(kind(x).alias("entity"), i.alias("at"))), lambda x: x["entity"].isNotNull())
    new = lambda x, i: (i == 0) | x.startswith("B-") | ~kind(x).eqNullSafe(kind(F.get(t, i - 1)))
    first = F.filter(marked, lambda m: new(F.get(t, m["at"]), m["at"]))
    last = F.filter(marked, lambda m: (m["at"] == F.size(t) - 1) | F.coalesce(kind(F.get(t, m["at"] + 1)).isNull() | new(F.get(t, m["at"] + 1), m["at"] + 1), F.lit(True)))
    return F.transform(F.arrays_zip(first.alias("f"), last.alias("l")), lambda z: F.struct(z["f"]["entity"].alias("entity"), z["f"]["at"].alias("first"), z["l"]["at"].alias("last")))


def entity_spans(df: DataFrame, tokens_id: str, tags: str) -> DataFrame:
    """(id, entity, first, last): spans of IOB tags, for token metrics; found inside a row, so tokens are not shuffled."""
    held = df.select(F.col(tokens_id).alias("id"), F.explode(F.array(F.col(tags))).alias("t"))
    return held.select("id", F.inline(_spans("t")))


def token_metrics(df: DataFrame, tokens_id: str, label: str, prediction: str) -> DataFrame:
    """(class, precision, recall, f1, support) over whole entity spans; a row is a text, its spans are compared inside it."""
    # A generator holds the tags, so that they are made once.
    held = df.select(F.inline(F.array(F.struct(F.col(label).alias("real"), F.col(prediction).alias("said")))))
    # Keys are strings, which Spark intersects by hash, structs pair by pair: places of eight digits each, then the entity.
    place = lambda c: F.lpad(F.hex(c), 8, "0")
    keys = lambda tags: F.transform(_spans(tags), lambda s: F.concat(place(s["first"]), place(s["last"]), s["entity"]))
    none = F.array().cast("array<string>")
    spans = held.select(F.inline(F.array(F.struct(F.coalesce(keys("real"), none).alias("real"), F.coalesce(keys("said"), none).alias("said")))))
    one = lambda of, name: F.transform(of, lambda k: F.struct(k.substr(F.lit(17), F.length(k)).alias("class"), F.lit(name).alias("of")))
    counts = spans.select(F.inline(F.concat(one(F.col("real"), "real"), one(F.col("said"), "said"), one(F.array_intersect("real", "said"), "both"))))
    per = counts.groupBy("class").agg(*(F.count(F.when(F.col("of") == c, 1)).alias(n) for c, n in (("real", "support"), ("said", "n_said"), ("both", "tp"))))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return per.select("class", ratio(F.col("tp"), F.col("n_said")).alias("precision"), ratio(F.col("tp"), F.col("support")).alias("recall"), ratio(2 * F.col("tp"), F.col("n_said") + F.col("support")).alias("f1"), "support")
