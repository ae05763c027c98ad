"""Token counts by a map-side two-tier lookup.

Tier one is a compact table of the corpus's most frequent pre-tokens and their
lengths in tokens, broadcast to all workers; its size is bounded by
``frequent`` entries whatever the corpus. Tier two is each worker's own cache,
which encodes what the table misses. Texts never move and no pre-token is
shuffled: the only exchange adds up the tasks' bounded summaries of what is
frequent. The table decides speed alone; counts are the library's.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import Tables, prepare
from .bytelevel import CACHE_CHARS, PieceTable, is_byte_level, split
from .sentencepiece_codec import encoder

#: Entries of the broadcast table, and of what one task reports.
FREQUENT, REPORT = 32_768, 8_192

_tables: dict[tuple[str, int], PieceTable] = {}


def _lengths(ids: np.ndarray, at: np.ndarray) -> list[int]:
    """How many ids each run that starts at ``at`` has."""
    return np.diff(np.append(at, len(ids))).tolist()


def frequent_pretokens(docs: DataFrame, path: str, text: str = "text", frequent: int = FREQUENT) -> list[tuple[str, int]]:
    """The pre-tokens that occur most often, with their lengths: at most ``frequent``.

    Every task reads its texts whole and keeps a summary of bounded size
    (counts below the summary's floor are dropped as it fills, so a pre-token
    that is frequent in the corpus stays); the reports are added by key.
    """
    report = min(REPORT, frequent)

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for value in batch.column(0):
                if s := value.as_py():
                    counts.update(split(s)[1:])
            if len(counts) > 16 * report:
                counts = Counter(dict(counts.most_common(4 * report)))
        top = [(t, n) for t, n in counts.most_common(report) if n > 1 and len(t) <= CACHE_CHARS]
        yield pa.RecordBatch.from_pydict({"token": pa.array([t for t, _ in top], pa.string()), "n": pa.array([n for _, n in top], pa.int64())})

    prepare(docs.sparkSession)
    reports = docs.select(F.col(text).alias("text")).mapInArrow(summarise, "token string, n long")
    with Tables(docs.sparkSession) as tables:
        added = tables.keep(reports.groupBy("token").agg(F.sum("n").alias("n")))
        # The lowest count that at most ``frequent`` of them reach: the driver gets no more than these.
        step = F.floor(F.log2("n") * 8).cast("int")
        seen = lowest = 0
        for r in sorted(added.groupBy(step.alias("step")).agg(F.count("*").alias("k")).collect(), key=lambda r: -r.step):  # eight rows for each doubling
            if seen + r.k > frequent:
                break
            seen, lowest = seen + r.k, r.step
        found = sorted(r.token for r in added.where(step >= lowest).collect()) if seen else []
    return list(zip(found, PieceTable(path, _lengths).encode([f" {t}" for t in found])))


def count_tokens(docs: DataFrame, path: str, text: str = "text", out: str = "n_tokens", frequent: int = FREQUENT) -> DataFrame:
    """``docs`` with ``out``: how many tokens the library for ``path`` makes of each whole text.

    ``path`` is a .json (tokenizers) or .model (sentencepiece) file that every
    executor can read; no begin, end or added special tokens, no truncation,
    special strings inside texts as the library's default has them. Null and
    empty texts have 0 tokens; repeated rows stay repeated; further columns
    pass through, and a column named like ``out`` is replaced.
    """
    spark = docs.sparkSession
    prepare(spark)
    kept = [f for f in docs.schema.fields if f.name != out]
    kind = "pieces" if path.endswith(".model") else "pretokens" if is_byte_level(path) else "library"
    shared, number = None, 0
    if kind == "pretokens":
        found = frequent_pretokens(docs, path, text, frequent)
        shared = spark.sparkContext.broadcast((list(t for t, _ in found), bytes(min(n, 255) for _, n in found)))
        number = shared._jbroadcast.id()

    def counter():
        if kind == "pieces":
            bpe = encoder(path)
            return lambda texts: [bpe.count(s) for s in texts]
        if (path, number) not in _tables:
            _tables.clear()
            _tables[path, number] = PieceTable(path, _lengths, {t: n for t, n in zip(*shared.value) if n < 255} if shared else None)
        table = _tables[path, number]
        if kind == "library":
            return table.encode
        return lambda texts: list(map(sum, table.texts(texts)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter()
        for batch in batches:
            n = pa.array(count([s or "" for s in batch.column(batch.num_columns - 1).to_pylist()]), pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], n], names=[*batch.schema.names[:-1], out])

    # The text travels once: where it is not among the kept columns it ends in the worker.
    given = docs.select(*[F.col(f"`{f.name}`") for f in kept], F.col(text).alias("__text"))
    schema = docs.select(*[F.col(f"`{f.name}`") for f in kept]).schema.add(out, "long")
    return given.mapInArrow(run, schema)
