"""Helpers that the training-data operators share."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes that one Arrow batch holds at most, so that a Python worker's
#: memory does not depend on how long the texts of a partition are.
ARROW_ROWS, ARROW_BYTES = 1024, 16 << 20

_prepared: set[str] = set()
#: Whose memory a Python worker holds between batches, and how it is let go.
_holder: tuple[str, Callable[[], None]] | None = None


def hold(owner: str, forget: Callable[[], None]) -> None:
    """Call before a worker-wide cache is used: a worker outlives its tasks, and keeps the caches of one owner at a time."""
    global _holder
    if _holder is not None and _holder[0] != owner:
        _holder[1]()
        pa.default_memory_pool().release_unused()
    _holder = (owner, forget)


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """One table of a data folder, pruned to ``columns``."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def prepare(spark: SparkSession) -> None:
    """Bound Arrow batches, and ship this package where workers can't import it."""
    for key, value in (("maxRecordsPerBatch", ARROW_ROWS), ("maxBytesPerBatch", ARROW_BYTES)):
        spark.conf.set(f"spark.sql.execution.arrow.{key}", str(value))
    root = Path(__file__).resolve().parents[2]
    known = {os.path.realpath(p) for p in (*os.environ.get("PYTHONPATH", "").split(os.pathsep), os.getcwd()) if p}
    app = spark.sparkContext.applicationId
    if app in _prepared or str(root) in known:
        return
    _prepared.add(app)
    archive = Path(tempfile.mkdtemp()) / "plumbline.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in (root / "plumbline").rglob("*.py"):
            out.write(path, path.relative_to(root))
    spark.sparkContext.addPyFile(str(archive))


def shared_dir(spark: SparkSession) -> str:
    """A new path in the folder that driver and executors share; it goes when the program ends.

    That is ``spark.checkpoint.dir``. Where it is unset, a local session (one
    machine, as in tests) gets a temporary folder; any other is refused, as
    its executors would write to disks that the others don't see.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="plumbline-"))
        base = context.getCheckpointDir()
    if "://" not in base and not base.startswith("file:"):
        base = "file://" + os.path.abspath(base)
    path = f"{base.rstrip('/')}/plumbline-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        hadoop = jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
    except Exception:  # noqa: BLE001  the session may have ended before
        pass


#: Spark removes a query's shuffle files as it ends; else they stay until the driver's memory happens to be cleaned.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _write(df: DataFrame) -> tuple[str, DataFrame]:
    spark = df.sparkSession
    path = shared_dir(spark)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    return path, spark.read.schema(df.schema).parquet(path)


def keep(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors. It stays until the program ends."""
    return _write(df)[1]


class Tables:
    """The intermediate tables of one call, in the shared folder: ``drop`` deletes one, the end of the ``with`` block the others.

    A plan that is run after the block reads none of them.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, {}

    def __enter__(self) -> Tables:
        return self

    def __exit__(self, *error) -> None:
        for path, _ in self.paths.values():
            _remove(self.spark, path)
        self.paths.clear()

    def keep(self, df: DataFrame) -> DataFrame:
        path, read = _write(df)
        self.paths[id(read)] = path, read
        return read

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            path, _ = self.paths.pop(id(table))
            _remove(self.spark, path)


#: Keys of rows to find or leave out that are still broadcast (some 40 bytes each); more of them meet by a shuffle.
BROADCAST_KEYS = 400_000


def by_keys(df: DataFrame, keys: DataFrame, on: list[str] | Column, how: str) -> DataFrame:
    """``df`` joined with ``keys`` (a table that is written already), which is broadcast as long as it has few rows."""
    return df.join(F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys, on, how)


#: A sieve has some SIEVE_BITS bits a key, in sheets of SHEET bits, and at most SHEETS sheets (8 MB), however many keys.
SIEVE_BITS, SHEET, SHEETS = 32, 1 << 15, 2048


def sifted(df: DataFrame, key: Column, keys: DataFrame) -> DataFrame:
    """``df`` with __maybe: true where the long ``key`` is in the only column of ``keys`` (a table that is written already), and for a few others.

    The others are one row in 32, and more of them from two million keys on,
    so an exact join has to follow. A null key is none. What is broadcast is
    bounded, so that no row has to be shuffled to be told apart.
    """
    sheets = min(SHEETS, keys.count() * SIEVE_BITS // SHEET + 1)
    value = F.col(keys.columns[0])
    sheet = lambda k: F.when(k.isNotNull(), F.pmod(F.shiftrightunsigned(F.xxhash64(k), 15), F.lit(sheets)).cast("int"))
    place = lambda k: F.xxhash64(k).bitwiseAND(F.lit(SHEET - 1))
    marks = keys.where(value.isNotNull()).select(sheet(value).alias("__sheet"), place(value).alias("p")).distinct()
    marks = marks.repartition("__sheet").groupBy("__sheet").agg(F.bitmap_construct_agg("p").alias("__marks"))
    byte = F.substring("__marks", F.shiftright(place(key), 3).cast("int") + 1, F.lit(1))
    bit = F.getbit(F.conv(F.hex(byte), 16, 10).cast("long"), place(key).bitwiseAND(F.lit(7)).cast("int"))
    joined = df.join(F.broadcast(marks), sheet(key) == F.col("__sheet"), "left")
    return joined.select(*(F.col(f"`{c}`") for c in df.columns), F.coalesce(bit == 1, F.lit(False)).alias("__maybe"))


def map_rows(df: DataFrame, function: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
    """``function`` over every Arrow batch of ``df``."""
    prepare(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from function(batch)

    return df.mapInArrow(run, schema)


def lower_ascii(column):
    """A-Z to a-z and nothing else; ``lower`` does that by itself for texts of ASCII only."""
    return F.when(F.octet_length(column) == F.length(column), F.lower(column)).otherwise(
        F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    )


def once(df: DataFrame, name: str, column: Column) -> DataFrame:
    """``df`` with ``column``, computed once per row.

    Later filters and projections can't pull the expression into themselves,
    where it would run again for every use or every element of a lambda: a
    generator stands between. (Plain ``explode`` would make the optimizer add
    a filter that computes it a second time; ``explode_outer`` does not.)
    """
    return df.select(*(F.col(f"`{c}`") for c in df.columns if c != name), F.explode_outer(F.array(column)).alias(name))
