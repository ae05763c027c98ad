"""Language-model scores of documents: likelihood over a subword lattice.

The vocabulary is that of an existing tokenizer. Its scores, which rank the
pieces, are turned into weights of 1 / (rank + 10); as a prior they stay in the
result, and expectation maximisation over the distinct words of all training
documents, each once, makes unigram probabilities of them. A word's
probability is the sum over all its segmentations into pieces, by the forward
recursion in log space. A word that training documents hold is a segment of
its own as well, with its count less a discount; what the discount takes from
all words is the share of the pieces (absolute discounting, with the discount
that the words of one and of two occurrences give). A document's probability is
the product over its words and one end. Words of a document repeat those of
others, so the recursion runs once per distinct word of a batch, over many
words at a time.

The word counts that training gathers are a table that grows with the corpus
and stays distributed. A bounded table of the most frequent words (``FREQUENT``
entries) is broadcast; a document's other words are joined with the counts by
word, where no key is frequent any more.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ._shared import Tables, keep, prepare

MARK = "▁"
#: Words whose counts are broadcast; rounds of expectation maximisation; what a piece counts beforehand on average.
FREQUENT, ROUNDS, PRIOR = 100_000, 2, 0.02
#: The discount of words' counts where the counts give none, and its limits.
DISCOUNT, DISCOUNTS = 0.5, (0.1, 0.9)
#: Words longer than this (with the mark) are scored one at a time.
LONG = 48
CACHE_ENTRIES, CACHE_CHARS = 300_000, 48
#: Words that training gathers before it goes through them.
AT_ONCE = 50_000


class Lattice:
    """The pieces of a vocabulary, and sums over the segmentations of words."""

    def __init__(self, path: str) -> None:
        from sentencepiece import sentencepiece_model_pb2 as model_pb2

        proto = model_pb2.ModelProto()
        with open(path, "rb") as file:
            proto.ParseFromString(file.read())
        self.pieces = [p.piece for p in proto.pieces if p.type in (1, 4)]
        self.rank = np.array([max(1.0, -p.score) for p in proto.pieces if p.type in (1, 4)])
        self.bytes = len(self.pieces)  # ids of the 256 bytes follow, then the end
        self.end = self.bytes + 256
        self.size = self.end + 1
        self.index = {p: i for i, p in enumerate(self.pieces)}
        self.longest = max(map(len, self.pieces))
        # Substrings are found by a hash of their characters in a table without clashes among the first of each slot.
        keys = np.array([self._key(p) for p in self.pieces], np.uint64)
        self.bits = np.uint64(64 - 20)
        self.slot = np.full(1 << 20, -1, np.int32)
        self.keys = keys
        self.clash: dict[int, int] = {}
        for i, k in enumerate(keys.tolist()):
            at = k >> int(self.bits)
            if self.slot[at] < 0:
                self.slot[at] = i
            else:
                self.clash[k] = i
        self.clash_keys = np.array(sorted(self.clash), np.uint64)
        self.clash_ids = np.array([self.clash[k] for k in sorted(self.clash)], np.int64)
        self.weights = np.full(self.size, -math.inf)

    MULTIPLY, FINISH = 0x9E3779B97F4A7C15, 0xD1B54A32D192ED03

    def _key(self, piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * self.MULTIPLY + ord(c) + 1) & (1 << 64) - 1
        return (h * self.FINISH) & (1 << 64) - 1

    def first_weights(self) -> np.ndarray:
        """Probabilities in proportion to one over the rank that the vocabulary's scores give."""
        p = np.zeros(self.size)
        p[: self.bytes] = 1 / (self.rank + 10)
        p[self.bytes :] = 1 / (len(self.pieces) + 10)
        return p / p.sum()

    def set(self, p: np.ndarray) -> Lattice:
        self.weights = np.log(p)
        return self

    def _find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where substring keys are pieces, and which: the few that are."""
        at = self.slot[(keys >> self.bits).astype(np.int64)]
        where = np.flatnonzero(at >= 0)
        piece = at[where].astype(np.int64)
        found = self.keys[piece] == keys[where]
        if not found.all():  # the slot is another's: look among the clashes
            other = keys[where[~found]]
            k = np.minimum(np.searchsorted(self.clash_keys, other), len(self.clash_keys) - 1)
            hit = self.clash_keys[k] == other
            piece[np.flatnonzero(~found)[hit]] = self.clash_ids[k[hit]]
            found[np.flatnonzero(~found)[hit]] = True
        return where[found], piece[found]

    def _edges(self, chars: np.ndarray) -> list[list[tuple]]:
        """For words of one length: by end, (start, rows, pieces, weights) of the substrings that are pieces.

        A character of no piece is an edge of its bytes; its piece is -1.
        """
        n = chars.shape[1]
        codes = chars.astype(np.uint64) + np.uint64(1)
        edges: list[list[tuple]] = [[] for _ in range(n + 1)]
        for start in range(n):
            h = np.zeros(len(chars), np.uint64)
            for end in range(start + 1, min(n, start + self.longest) + 1):
                h = h * np.uint64(self.MULTIPLY) + codes[:, end - 1]
                rows, pieces = self._find(h * np.uint64(self.FINISH))
                if len(rows):
                    edges[end].append((start, rows, pieces, self.weights[pieces]))
                if end == start + 1 and len(rows) < len(chars):
                    bare = np.setdiff1d(np.arange(len(chars)), rows)
                    weights = [sum(self.weights[self.bytes + b] for b in chr(c).encode("utf-8", "surrogatepass")) for c in chars[bare, start]]
                    edges[end].append((start, bare, np.full(len(bare), -1), np.array(weights)))
        return edges

    def forward(self, words: list[str], expect: np.ndarray | None = None, counts: np.ndarray | None = None) -> np.ndarray:
        """log P of each word (with its mark); ``expect`` gains the expected uses of pieces, ``counts`` times."""
        out = np.zeros(len(words))
        by: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            by.setdefault(len(w), []).append(i)
        for n, where in by.items():
            for k in range(0, len(where), max(1, 1_000_000 // (n * self.longest))):
                part = where[k : k + max(1, 1_000_000 // (n * self.longest))]
                chars = np.frombuffer("".join(words[i] for i in part).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(part), n)
                if n > LONG:
                    for row, i in zip(chars, part):
                        out[i] = self._long(row, expect, 1.0 if counts is None else counts[i])
                else:
                    out[part] = self._short(chars, expect, None if counts is None else counts[part])
        return out

    def _short(self, chars: np.ndarray, expect: np.ndarray | None, counts: np.ndarray | None) -> np.ndarray:
        n = chars.shape[1]
        edges = self._edges(chars)
        alpha = np.full((n + 1, len(chars)), -math.inf)
        alpha[0] = 0
        for end in range(1, n + 1):
            for start, rows, _, w in edges[end]:
                alpha[end, rows] = np.logaddexp(alpha[end, rows], alpha[start, rows] + w)
        if expect is not None:
            beta = np.full((n + 1, len(chars)), -math.inf)
            beta[n] = 0
            used, uses = [], []
            for end in range(n, 0, -1):
                for start, rows, pieces, w in edges[end]:
                    after = beta[end, rows] + w
                    beta[start, rows] = np.logaddexp(beta[start, rows], after)
                    share = np.exp(alpha[start, rows] + after - alpha[n, rows]) * (1.0 if counts is None else counts[rows])
                    if pieces[0] < 0:
                        for c, u in zip(chars[rows, start], share):
                            for b in chr(c).encode("utf-8", "surrogatepass"):
                                expect[self.bytes + b] += u
                    else:
                        used.append(pieces)
                        uses.append(share)
            if used:
                expect += np.bincount(np.concatenate(used), np.concatenate(uses), minlength=self.size)
        return alpha[n]

    def _long(self, row: np.ndarray, expect: np.ndarray | None, count: float) -> float:
        """One word of any length: its weights in strips, so memory stays linear in the word."""
        text = "".join(map(chr, row))
        n = len(text)

        def edge(s: int, e: int) -> tuple[float, list[int]]:
            if (i := self.index.get(text[s:e])) is not None:
                return self.weights[i], [i]
            if e - s == 1:
                ids = [self.bytes + b for b in text[s:e].encode("utf-8", "surrogatepass")]
                return sum(self.weights[i] for i in ids), ids
            return -math.inf, []

        alpha = np.full(n + 1, -math.inf)
        alpha[0] = 0
        for e in range(1, n + 1):
            for s in range(max(0, e - self.longest), e):
                if (w := edge(s, e)[0]) > -math.inf:
                    alpha[e] = np.logaddexp(alpha[e], alpha[s] + w)
        if expect is not None:
            beta = np.full(n + 1, -math.inf)
            beta[n] = 0
            for e in range(n, 0, -1):
                for s in range(max(0, e - self.longest), e):
                    w, ids = edge(s, e)
                    if ids:
                        beta[s] = np.logaddexp(beta[s], beta[e] + w)
                        for i in ids:
                            expect[i] += count * math.exp(alpha[s] + w + beta[e] - alpha[n])
        return float(alpha[n])


_lattices: dict[str, Lattice] = {}
_caches: dict[int, tuple] = {}


def lattice(path: str) -> Lattice:
    if path not in _lattices:
        _lattices[path] = Lattice(path)
    return _lattices[path]


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, c): how often each word occurs; each task adds up its own before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "c"])

        for batch in batches:
            for t in batch.column(0):
                if (s := t.as_py()) is not None:
                    counts.update(s.encode("utf-8", "surrogatepass").lower().split())
            if len(counts) > CACHE_ENTRIES:
                yield flush()
                counts.clear()
        yield flush()

    prepare(docs.sparkSession)
    return docs.select(text).mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def train(words: DataFrame, path: str, rounds: int = ROUNDS) -> np.ndarray:
    """Unigram probabilities of the pieces, the bytes and the end, from the distinct words in the first column of ``words``."""
    spark = words.sparkSession
    own = lattice(path)
    prior = PRIOR * own.size * own.first_weights()
    p = own.first_weights()
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(p)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            model = lattice(path).set(shared.value)
            expect = np.zeros(model.size)
            waiting: list[str] = []
            for batch in batches:
                waiting += [MARK + w.decode("utf-8", "surrogatepass") for w in batch.column(0).to_pylist()]
                if len(waiting) >= AT_ONCE:  # the vectors are as long as the words of one length
                    model.forward(waiting, expect)
                    waiting = []
            if waiting:
                model.forward(waiting, expect)
            at = np.flatnonzero(expect)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(expect[at])], names=["piece", "uses"])

        total = prior.copy()
        for r in words.mapInArrow(run, "piece int, uses double").groupBy("piece").agg(F.sum("uses").alias("uses")).collect():  # a row per piece of the vocabulary
            total[r.piece] += r.uses
        total[own.end] += 1
        p = total / total.sum()
    return p


def _frequent(counts: DataFrame, most: int) -> list:
    """The words above the lowest count that at most ``most`` words reach; counts are told apart in steps of a twelfth."""
    step = F.floor(F.log2("c") * 8).cast("int")
    seen = lowest = 0
    for r in sorted(counts.groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect(), key=lambda r: -r.step):  # a row per step, eight for each doubling
        if seen + r.n > most:
            break
        seen, lowest = seen + r.n, r.step
    return counts.where(step >= lowest).collect() if seen else []


def score_documents(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", folds: int = 7, held: int = 2, frequent: int = FREQUENT) -> DataFrame:
    """``docs`` with held_out, n_tokens, n_known, train_tokens (long), base_score and score.

    Documents whose crc32 of the id as text leaves ``held`` modulo ``folds``
    are held out of training; a null id is trained on. Tokens are the words (A-Z
    lower case) and one end. base_score is the add-one unigram log10
    probability of the words, score the lattice's of the same text. A null text
    is empty: its end alone. Repeated rows count and are scored each. With
    nothing to train on, N is 0 and pieces alone, with the weights of the
    vocabulary, make the score. The text column is not returned; columns of
    ``docs`` named like an added one are replaced.
    """
    spark = docs.sparkSession
    prepare(spark)
    added = ["held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    docs = docs.drop(*added).withColumn("held_out", F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == held, F.lit(False)))
    training = docs.where("not held_out")
    counts = keep(word_counts(training, text))
    ends = training.select("held_out").count()
    times = lambda k: F.coalesce(F.sum((F.col("c") == k).cast("long")), F.lit(0)).alias(f"n{k}")
    row = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v"), times(1), times(2)).first()
    n, v = row.n + ends, row.v + (ends > 0)
    base = math.log10(n + v + 1)
    less = min(max(row.n1 / (row.n1 + 2 * row.n2), DISCOUNTS[0]), DISCOUNTS[1]) if row.n1 else DISCOUNT
    rest = less * v / n if n else 1.0  # the pieces' share of probability
    p = train(counts, path)
    top = _frequent(counts, frequent)
    common = spark.sparkContext.broadcast((p, [bytes(r.word) for r in top], [r.c for r in top]))
    number = common._jbroadcast.id()

    others = [c for c in docs.columns if c != text]
    extra = "__row string, n_tokens long, __known long, __base double, score double, __rare array<struct<word:binary,n:long,lat:double>>"
    schema = StructType([*docs.select(*(F.col(f"`{c}`") for c in others)).schema.fields, *StructType.fromDDL(extra).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        if number not in _caches:
            weights, words, found = common.value
            model = lattice(path).set(weights)
            _caches.clear()
            _caches[number] = (model, dict(zip(words, found)), {})
        model, known, cache = _caches[number]
        end_weight = math.log10(max(ends - less, 0) / max(n, 1) + rest * math.exp(float(model.weights[model.end])))
        end_base = math.log10(ends + 1) - base
        log_of = cache.get("") or {w: math.log10(c + 1) - base for w, c in known.items()}
        cache[""] = log_of
        part, number_of = TaskContext.get().partitionId(), 0
        for batch in batches:
            texts = [Counter((t.as_py() or "").encode("utf-8", "surrogatepass").lower().split()) for t in batch.column(len(others))]
            new = list({w for words in texts for w in words if w not in cache})
            if len(cache) + len(new) > CACHE_ENTRIES:
                cache.clear()
                cache[""] = log_of
                new = list({w for words in texts for w in words})
            values = (model.forward([MARK + w.decode("utf-8", "surrogatepass") for w in new]) / math.log(10)).tolist()
            # Of frequent words the whole probability, of others that of their pieces.
            own = {w: math.log10((known[w] - less) / n + rest * 10**x) if w in known else x for w, x in zip(new, values)}
            cache.update((w, s) for w, s in own.items() if len(w) <= CACHE_CHARS)
            out: list[list] = [[] for _ in range(6)]
            for words in texts:
                tokens, n_known, of_base, score, rare = 1, int(ends > 0), end_base, end_weight, []
                for w, k in words.items():
                    tokens += k
                    value = own.get(w)
                    if value is None:
                        value = cache[w]
                    if (of_word := log_of.get(w)) is None:
                        rare.append({"word": w, "n": k, "lat": value})
                    else:
                        n_known += k
                        of_base += k * of_word
                        score += k * value
                for column, value in zip(out, (f"{part}-{number_of}", tokens, n_known, of_base, score, rare)):
                    column.append(value)
                number_of += 1
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int64()), ("lat", pa.float64())])))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(others)], *(pa.array(c, k) for c, k in zip(out, kinds))], names=schema.names)

    with Tables(spark) as tables:
        scored = tables.keep(docs.select(*(F.col(f"`{c}`") for c in others), F.col(f"`{text}`")).mapInArrow(run, schema))
        looked = scored.select("__row", F.explode("__rare").alias("r")).select("__row", "r.*").join(counts, "word", "left")
        c = F.col("c")
        of_word = F.when(c.isNull(), math.log10(rest) + F.col("lat")).otherwise(F.log10((c - less) / max(n, 1) + rest * F.pow(F.lit(10.0), F.col("lat"))))
        sums = looked.groupBy("__row").agg(
            F.sum(F.when(c.isNotNull(), F.col("n")).otherwise(0)).alias("__more"),
            F.sum(F.col("n") * (F.log10(F.coalesce("c", F.lit(0)) + 1) - base)).alias("__rest"),
            F.sum(F.col("n") * of_word).alias("__words"),
        )
        joined = scored.drop("__rare").join(sums, "__row", "left")
        return keep(
            joined.select(
                *(F.col(f"`{c}`") for c in others),
                "n_tokens",
                (F.col("__known") + F.coalesce("__more", F.lit(0))).alias("n_known"),
                F.lit(n).cast("long").alias("train_tokens"),
                (F.col("__base") + F.coalesce("__rest", F.lit(0.0))).alias("base_score"),
                (F.col("score") + F.coalesce("__words", F.lit(0.0))).alias("score"),
            )
        )
