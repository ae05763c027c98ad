"""Token ids in Arrow IPC files of fixed-size lists, and reading them back.

A data set is a folder of shards in ascending document order. Shard k is two
Arrow IPC files:

* ``seq-<k>.arrow``: record batches of two columns, ``ids``
  fixed_size_list<uint16 or uint32>[length] and ``mask``
  fixed_size_list<bool>[length]. All sequences are equally long, so the i-th
  one lies at a known offset: a memory map gives it without a copy. The last
  sequence of a shard is padded; its mask is false there.
* ``doc-<k>.arrow``: doc_id, start (in the shard's ids) and n_tokens of each
  document.

Ids take 16 bits where the vocabulary fits. A task writes under a name of its
own attempt and then renames, so a lost executor or a second attempt leaves
whole files only.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import keep, prepare, shared_dir
from .bytelevel import PieceTable, is_byte_level

#: Ids in a sequence, sequences in a record batch, bytes of text in a shard (about).
LENGTH, BATCH, SHARD_BYTES = 2048, 256, 64 << 20

_tables: dict[tuple[str, str], PieceTable] = {}


def _bytes_of(dtype: str, ids: np.ndarray, at: np.ndarray) -> list[bytes]:
    """The bytes of the runs of ids that start at ``at``."""
    size, packed = np.dtype(dtype).itemsize, ids.astype(dtype).tobytes()
    ends = [*(at[1:] * size).tolist(), len(packed)]
    return [packed[a:b] for a, b in zip((at * size).tolist(), ends)]


def _coder(path: str, dtype: str):
    """Texts -> the bytes of each one's ids."""
    if (path, dtype) not in _tables:
        _tables[path, dtype] = PieceTable(path, partial(_bytes_of, dtype))
    table = _tables[path, dtype]
    if is_byte_level(path):
        return lambda texts: list(map(b"".join, table.texts(texts)))
    return table.encode


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class _SequenceFile:
    """Packs a stream of ids into equal sequences, a record batch at a time: all but a shard's last hold ``BATCH`` sequences."""

    def __init__(self, sink, dtype: str, length: int) -> None:
        kind = pa.from_numpy_dtype(np.dtype(dtype))
        self.schema = pa.schema({"ids": pa.list_(kind, length), "mask": pa.list_(pa.bool_(), length)})
        self.out = pa.ipc.new_file(sink, self.schema)
        self.dtype, self.length, self.parts, self.waiting = dtype, length, [], 0

    def add(self, ids: bytes) -> None:
        self.parts.append(ids)
        self.waiting += len(ids)
        if self.waiting >= BATCH * self.length * np.dtype(self.dtype).itemsize:
            self._write(False)

    def _write(self, last: bool) -> None:
        ids = np.frombuffer(b"".join(self.parts), self.dtype)
        step = BATCH * self.length
        whole = len(ids) // step * step
        for k in range(0, whole, step):
            self._batch(ids[k : k + step], None)
        rest = ids[whole:]
        if last and len(rest):
            padded = np.zeros(-(-len(rest) // self.length) * self.length, self.dtype)
            padded[: len(rest)] = rest
            self._batch(padded, np.arange(len(padded)) < len(rest))
            rest = rest[:0]
        self.parts, self.waiting = [rest.tobytes()], rest.nbytes

    def _batch(self, ids: np.ndarray, mask: np.ndarray | None) -> None:
        mask = np.ones(len(ids), bool) if mask is None else mask
        fixed = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (ids, mask)]
        self.out.write_batch(pa.RecordBatch.from_arrays(fixed, schema=self.schema))

    def close(self) -> None:
        self._write(True)
        self.out.close()


def write_token_files(docs: DataFrame, path: str, folder: str, end_id: int, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, shards: int | None = None) -> DataFrame:
    """Write the ids of ``docs`` under ``folder``; returns the manifest (shard, file names, n_docs, n_tokens, start).

    Documents go in ascending ``doc_id`` order (null first, then ties by the
    text's hash and text); each gets ``end_id`` after its ids; a null text is
    empty and has the end id alone. Repeated rows are written repeatedly, and
    many of one id and text are dealt over several shards. Other columns of
    ``docs`` are neither read nor written. An empty table gives an empty
    manifest. ``folder`` is a path that all executors share. ``start`` counts
    the ids of all shards before.
    """
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    prepare(spark)
    dtype = "<u2" if Tokenizer.from_file(path).get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else "<u4"
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    if shards is None:
        shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), _text_bytes(rows) // SHARD_BYTES)
    tie = F.xxhash64("text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        code, (files, base) = _coder(path, dtype), _filesystem(folder)
        end = np.array([end_id], dtype).tobytes()
        size = np.dtype(dtype).itemsize
        shard = TaskContext.get().partitionId()
        attempt = f"{base}/.attempt-{uuid.uuid4().hex}"
        sink = sequence = None
        doc_ids, starts, counts, start = [], [], [], 0
        for batch in batches:
            if sequence is None:
                files.create_dir(base, recursive=True)
                sink = files.open_output_stream(f"{attempt}-seq")
                sequence = _SequenceFile(sink, dtype, length)
            for d, ids in zip(batch.column(0).to_pylist(), code([s or "" for s in batch.column(1).to_pylist()])):
                ids += end
                sequence.add(ids)
                doc_ids.append(d)
                starts.append(start)
                counts.append(n := len(ids) // size)
                start += n
        if sequence is None:
            return
        sequence.close()
        sink.close()
        with files.open_output_stream(f"{attempt}-doc") as sink:
            batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(doc_ids, pa.int64()), "start": pa.array(starts, pa.int64()), "n_tokens": pa.array(counts, pa.int64())})
            with pa.ipc.new_file(sink, batch.schema) as out:
                out.write_batch(batch)
        for kind in ("seq", "doc"):
            files.move(f"{attempt}-{kind}", f"{base}/{kind}-{shard:06d}.arrow")
        yield pa.RecordBatch.from_pydict({"shard": [shard], "n_docs": [len(counts)], "n_tokens": [start]})

    manifest = (
        rows.withColumn("row", F.monotonically_increasing_id())  # rows that agree in id and text are alike, so it may part them
        .repartitionByRange(int(shards), F.col("doc_id").asc_nulls_first(), tie, "row")
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), tie, "text")
        .mapInArrow(write, "shard long, n_docs long, n_tokens long")
    )
    # One row per shard, so the running total is over a table of file names only.
    manifest = keep(manifest)
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def _text_bytes(rows: DataFrame) -> int:
    """Size of the table's files, read from the plan's own estimate."""
    try:
        size = int(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().toString())
        return size if size < 1 << 55 else 0  # beyond that it is a default for unknown sizes
    except Exception:  # noqa: BLE001  an estimate only, other plans may have none
        return 0


def open_sequences(uri: str):
    """The Arrow file reader of one shard's sequences; memory-mapped where the path is local."""
    files, path = _filesystem(uri)
    if files.type_name == "local":
        return pa.ipc.open_file(pa.memory_map(path))
    return pa.ipc.open_file(files.open_input_file(path))


def sequence(reader, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and mask of sequence ``k`` of a shard: the ids are a view of the file's bytes."""
    batch = reader.get_batch(k // BATCH)
    length = batch.schema.field("ids").type.list_size
    at = (k % BATCH) * length
    return batch.column(0).flatten().to_numpy(zero_copy_only=True)[at : at + length], batch.column(1).flatten().slice(at, length).to_numpy(zero_copy_only=False)


def read_token_files(spark: SparkSession, manifest: DataFrame, folder: str) -> DataFrame:
    """One row per document, from the files: doc_id, start, n_tokens, ids_crc32 (of the ids as little-endian uint32).

    Each shard is read by a task of its own, a record batch at a time: what a
    number of partitions deals out is not joined again by adaptive execution.
    """
    prepare(spark)
    shards = manifest.agg(F.coalesce(F.max("shard"), F.lit(0))).first()[0] + 1

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = _filesystem(folder)
        for given in batches:
            for shard, before in zip(*(given.column(c).to_pylist() for c in (0, 1))):
                with files.open_input_file(f"{base}/doc-{shard:06d}.arrow") as file:
                    docs = pa.ipc.open_file(file).read_all()
                reader = open_sequences(f"{folder}/seq-{shard:06d}.arrow")
                at, held, k = 0, np.zeros(0, np.uint32), 0
                starts, counts = (docs.column(c).to_pylist() for c in ("start", "n_tokens"))
                crcs = []
                for start, n in zip(starts, counts):
                    while at + len(held) < start + n:
                        batch = reader.get_batch(k)
                        ids = batch.column(0).flatten().to_numpy(zero_copy_only=True)
                        mask = batch.column(1).flatten().to_numpy(zero_copy_only=False)
                        held = np.concatenate([held[start - at :], ids[mask].astype("<u4")])
                        at, k = start, k + 1
                    crcs.append(zlib.crc32(held[start - at : start - at + n].tobytes()))
                yield pa.RecordBatch.from_arrays(
                    [docs.column("doc_id").combine_chunks(), pa.array([before + s for s in starts], pa.int64()), docs.column("n_tokens").combine_chunks(), pa.array(crcs, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    rows = manifest.select("shard", "start").repartitionById(shards, F.col("shard").cast("int"))
    return rows.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


__all__ = ["open_sequences", "read_token_files", "sequence", "shared_dir", "write_token_files"]
