"""The language of a text, by a model of character trigrams that is trained on labelled texts.

Training counts over all labelled rows in Spark; the model is a bounded number
of trigrams with their log probabilities. Scoring reads whole texts, in Arrow
batches: a trigram is one number of its three code points, looked up in a
sorted array.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import kept_at, remove

#: Trigrams of the model.
MOST = 4_000
#: Rows that only calibrate: one in so many, by the hash of the text. Weights of a trigram that are tried on them.
HELD, WEIGHTS = 10, [0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.75, 1.0]


def _reader():
    """The trigrams of a text as numbers: letters in lower case, runs of anything else one space, a space at both ends."""

    def keys(text: str):
        import numpy as np
        import regex

        plain = regex.sub(r"[^\p{L}]+", " ", text.lower())
        c = np.frombuffer(f" {plain} ".encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
        return c[:-2] | c[1:-1] << 21 | c[2:] << 42

    return keys  # travels with the plan, so workers need not import this module


@dataclass(frozen=True)
class LanguageModel:
    """``table``: of its trigrams the log probability under each language; ``missing``: of any other.

    Trigrams of a text overlap, so each says less than it would by itself:
    ``weight`` is how much, as held-out rows have it.
    """

    languages: list[str]
    table: dict[int, list[float]]
    missing: list[float]
    weight: float = 0.2

    def scorer(self):
        """From a text to the sum of the log probabilities of all its trigrams, for each language."""
        import numpy as np

        keys = np.array(sorted(self.table), dtype=np.int64)
        rows = np.array([self.table[k] for k in keys.tolist()] + [self.missing])
        ends, read = np.append(keys, -1), _reader()

        def summed(text: str):
            import numpy as np

            own = read(text)
            at = np.searchsorted(keys, own)
            at[ends[at] != own] = len(keys)
            return np.bincount(at, minlength=len(rows)) @ rows

        return summed

    def language(self, text: Column, certainty: float = 0.8) -> Column:
        """The language whose share of the likelihood reaches ``certainty``; null if none does, for null texts and those without a letter."""
        summed, names, weight = self.scorer(), self.languages, self.weight

        @F.pandas_udf("string")
        def said(texts: pd.Series) -> pd.Series:
            import numpy as np

            def one(t):
                if t is None or not names or not any(c.isalpha() for c in t):
                    return None
                z = weight * summed(t)
                best = int(z.argmax())
                return names[best] if 1 / np.exp(z - z[best]).sum() >= certainty else None

            return texts.map(one)

        return said(text)


def train_language_model(df: DataFrame, text: str, language: str, most: int = MOST) -> LanguageModel:
    """A model from the rows that have a language and a text: nine in ten are counted, the others set how certain it is."""
    rows = df.where(F.col(text).isNotNull() & F.col(language).isNotNull()).select(F.col(text).alias("t"), F.col(language).cast("string").alias("l"), F.pmod(F.xxhash64(text), F.lit(HELD)).alias("fold"))
    read = _reader()

    def counted(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            names, texts = batch.column("l").to_pylist(), batch.column("t").to_pylist()
            for name in set(names):
                keys, n = np.unique(np.concatenate([read(t) for t, x in zip(texts, names) if x == name]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(keys), pa.string()), pa.array(keys), pa.array(n)], names=["l", "g", "n"])

    counts, place = kept_at(rows.where("fold > 0").select("l", "t").mapInArrow(counted, "l string, g long, n long").groupBy("l", "g").agg(F.sum("n").alias("n")))
    totals = {r.l: r.n for r in counts.groupBy("l").agg(F.sum("n").alias("n")).collect()}  # a row per language
    languages = sorted(totals)
    frequent = counts.groupBy("g").agg(F.sum("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("l", "n"))).alias("by")).orderBy(F.desc("n"), "g").limit(most).collect()
    remove(df.sparkSession, place)
    log = lambda n, name: math.log((n + 0.5) / (totals[name] + 0.5 * (most + 1)))
    model = LanguageModel(languages, {r.g: [log(r.by.get(x, 0), x) for x in languages] for r in frequent}, [log(0, x) for x in languages])
    if not languages:
        return model
    summed, number = model.scorer(), {name: k for k, name in enumerate(languages)}

    def costs(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            total = np.zeros(len(WEIGHTS))
            for name, t in zip(batch.column("l").to_pylist(), batch.column("t").to_pylist()):
                if name in number:
                    z = np.outer(WEIGHTS, summed(t))
                    z -= z.max(axis=1, keepdims=True)
                    total += np.log(np.exp(z).sum(axis=1)) - z[:, number[name]]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(WEIGHTS)), pa.int32()), pa.array(total)], names=["weight", "cost"])

    found = rows.where("fold = 0").select("l", "t").mapInArrow(costs, "weight int, cost double").groupBy("weight").agg(F.sum("cost").alias("cost")).orderBy("cost", "weight").first()
    return LanguageModel(languages, model.table, model.missing, WEIGHTS[found.weight]) if found else model
