"""Reading tables: parquet folders, CSV and JSON files, folders of files by class, and frames from memory."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """A parquet table of a data folder, pruned to ``columns``."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("header", True)
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def read_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    return spark.read.schema(schema).json(path) if schema else spark.read.json(path)


def read_class_folders(spark: SparkSession, path: str) -> DataFrame:
    """(path, label, content): files whose folder names their class."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.element_at(F.split("path", "/"), -2).alias("label"), "content")


def from_arrays(spark: SparkSession, features: Any, label: Any = None, columns: list[str] | None = None, label_name: str = "target") -> DataFrame:
    """A table from a 2-D array and a label array; columns are named 1, 2, ... unless given."""
    import pandas as pd

    frame = pd.DataFrame(features, columns=columns or [str(i + 1) for i in range(len(features[0]))])
    if label is not None:
        frame[label_name] = label
    return spark.createDataFrame(frame)


def join_by_id(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Metadata, properties, embeddings or predictions of the same rows."""
    return df.join(other, key, "left")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)
