"""Where plans are cut: tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, ``spark.checkpoint.dir``. Where it is unset, a local session gets a temporary one; others are refused."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="plumbline-"))
        folder = context.getCheckpointDir()
    return folder if "://" in folder or folder.startswith("file:") else "file://" + os.path.abspath(folder)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table that :func:`kept_at` wrote; one that is gone, or whose session is, is no error."""
    try:
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    except Exception:  # noqa: BLE001  the session may have ended before
        pass


def kept_at(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` written to a table of its own in the shared folder and read from there, and where that is; it goes with the program at the latest."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/plumbline-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def kept(df: DataFrame) -> DataFrame:
    """``df`` written once and read from there: its lineage is not run again, and lost executors cost nothing."""
    return kept_at(df)[0]
