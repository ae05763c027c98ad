"""Texts and images as tables with roles: label, prediction, properties, metadata and embeddings beside one another.

An object holds lazy tables, keyed by a sample id; roles are checked by
schema at once and by value where a check asks for it. Nothing is copied.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import inference
from .core import Dataset
from .functions.strings import TEXT_PROPERTIES
from .operators import text as text_checks
from .operators import vision

TEXT_TASKS = ("text_classification", "token_classification", "other")
IMAGE_TASKS = ("classification", "detection", "segmentation", "other")


def as_dataset(thing: DataFrame | Dataset, **roles) -> Dataset:
    """A table as a Dataset; a Dataset as it is."""
    return thing if isinstance(thing, Dataset) else Dataset(thing, **roles)


def _columns_of(table: DataFrame, key: str) -> tuple[str, ...]:
    return tuple(c for c in table.columns if c != key)


@dataclass(frozen=True)
class TextData:
    """Texts (``text``) or tokens (``tokens``) with their roles, one row per ``key``.

    ``label`` and ``prediction`` are columns of ``df``: a class, an array of
    0 and 1 (multilabel), or of IOB tags (token classification).
    ``metadata``, ``properties`` and ``embeddings`` are tables with the key.
    """

    df: DataFrame
    key: str = "sample_id"
    text: str | None = "text"
    tokens: str | None = None
    label: str | None = None
    prediction: str | None = None
    probabilities: str | None = None
    task: str = "text_classification"
    name: str | None = None
    metadata: DataFrame | None = None
    properties: DataFrame | None = None
    embeddings: DataFrame | None = None
    categorical_metadata: tuple[str, ...] | None = None
    categorical_properties: tuple[str, ...] | None = None

    def __post_init__(self) -> None:
        if self.task not in TEXT_TASKS:
            raise ValueError(f"a text task is one of {', '.join(TEXT_TASKS)}")
        for column in filter(None, (self.key, self.text, self.tokens, self.label, self.prediction, self.probabilities)):
            if column not in self.df.columns:
                raise ValueError(f"column {column} is not in the table")
        if not self.text and not self.tokens:
            raise ValueError("texts or tokens are needed")
        if self.text:
            inference.check_raw_text(self.df, self.text)
        if self.tokens:
            inference.check_tokens(self.df, self.tokens)
        if self.task == "token_classification":
            if not self.tokens:
                raise ValueError("token classification needs tokens")
            for column in filter(None, (self.label, self.prediction)):
                inference.check_tokens(self.df, column)
        for table in filter(lambda t: t is not None, (self.metadata, self.properties, self.embeddings)):
            if self.key not in table.columns:
                raise ValueError(f"the table has no key {self.key}")

    @classmethod
    def from_list(cls, spark, texts: list[str | None], labels: list | None = None, **options) -> TextData:
        """Texts of the driver, numbered in their order."""
        rows = [(i, t, None if labels is None else labels[i]) for i, t in enumerate(texts)]
        kind = "string" if labels is None else {bool: "boolean", int: "long", float: "double"}.get(type(next((x for x in labels if x is not None), "")), "string")
        df = spark.createDataFrame(rows, f"sample_id long, text string, label {kind}")
        return cls(df if labels is not None else df.drop("label"), label="label" if labels is not None else None, **options)

    @property
    def is_multilabel(self) -> bool:
        return bool(self.label) and self.task == "text_classification" and dict(self.df.dtypes)[self.label].startswith("array")

    @property
    def n_samples(self) -> int:
        return self.df.count()

    def with_metadata(self, table: DataFrame, categorical: tuple[str, ...] | None = None) -> TextData:
        return replace(self, metadata=table, categorical_metadata=categorical)

    def with_properties(self, table: DataFrame, categorical: tuple[str, ...] | None = None) -> TextData:
        return replace(self, properties=table, categorical_properties=categorical)

    def with_embeddings(self, table: DataFrame) -> TextData:
        return replace(self, embeddings=table)

    def with_builtin_properties(self, include: list[str] | None = None, ignore: list[str] | None = None, extra: dict[str, Column] | None = None) -> TextData:
        """The properties that need no downloaded model, of each text; ``extra`` adds columns of others."""
        if include and ignore:
            raise ValueError("give include or ignore, not both")
        names = [p for p in include or TEXT_PROPERTIES if p not in (ignore or ())]
        given = self.df.select(self.key, self.text)
        return self.with_properties(text_checks.text_properties(given, self.text, names, extra).drop(self.text))

    def with_computed_embeddings(self, model: Callable[[list[str]], list[list[float]]], long_texts: str = "average", most_words: int = 400) -> TextData:
        """Embeddings by a function of texts, called on Arrow batches.

        Texts over ``most_words`` words are embedded in parts and averaged, cut
        (truncate), refused (raise) or left without (nan).
        """
        import pandas as pd

        key, column = self.key, self.text
        kind = dict(self.df.dtypes)[key]

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                out = []
                for t in part[column]:
                    words = (t or "").split(" ")
                    pieces = [" ".join(words[k : k + most_words]) for k in range(0, len(words), most_words)]
                    if t is None or (len(pieces) > 1 and long_texts == "nan"):
                        out.append(None)
                        continue
                    if len(pieces) > 1 and long_texts == "raise":
                        raise ValueError("a text is too long to embed")
                    vectors = model(pieces[:1] if long_texts == "truncate" else pieces)
                    out.append([float(sum(v) / len(vectors)) for v in zip(*vectors)])
                yield pd.DataFrame({key: part[key], "embedding": out})

        return self.with_embeddings(self.df.select(key, column).mapInPandas(run, f"`{key}` {kind}, embedding array<double>"))

    def metadata_types(self) -> dict[str, str]:
        return self._types(self.metadata, self.categorical_metadata)

    def properties_types(self) -> dict[str, str]:
        return self._types(self.properties, self.categorical_properties)

    def _types(self, table: DataFrame | None, categorical: tuple[str, ...] | None) -> dict[str, str]:
        if table is None:
            raise ValueError("there is no such table")
        cat, num = inference.split_columns(table.drop(self.key), None, categorical)
        return {**dict.fromkeys(cat, "categorical"), **dict.fromkeys(num, "numeric")}

    def joined(self, kind: str = "properties") -> DataFrame:
        """Label and prediction with the columns of the metadata or the properties, by key."""
        table = self.metadata if kind == "metadata" else self.properties
        if table is None:
            raise ValueError(f"there are no {kind}")
        own = [c for c in dict.fromkeys(filter(None, (self.key, self.label, self.prediction)))]
        return self.df.select(*own).join(table, self.key)

    def dataset(self, kind: str = "properties", columns: list[str] | None = None, ignore: list[str] | None = None, most: int | None = None) -> Dataset:
        """Metadata or properties as features of a Dataset; ``most`` takes the first ones by name."""
        types = self.metadata_types() if kind == "metadata" else self.properties_types()
        names = sorted(c for c in types if (not columns or c in columns) and c not in (ignore or ()))[:most]
        cat = tuple(c for c in names if types[c] == "categorical")
        return Dataset(self.joined(kind).select(self.key, *filter(None, dict.fromkeys((self.label, self.prediction))), *names), self.label, tuple(names), cat, self.key)

    def sample(self, n: int, seed: int = 42) -> TextData:
        """At most ``n`` rows, by the hash of the key (a sampling operator)."""
        return replace(self, df=self.df.orderBy(F.xxhash64(F.lit(seed), self.key), self.key).limit(n))

    def classes(self) -> list[str]:
        kind = "token" if self.task == "token_classification" else "multilabel" if self.is_multilabel else "text"
        return inference.observed_and_model_classes(self.df, None, self.label, self.prediction, kind)[0]

    def check_compatible(self, other: TextData) -> None:
        """The other side has the same task, and metadata and properties of the same columns and types."""
        inference.check_same_task(self.task, other.task)
        for a, b in ((self.metadata, other.metadata), (self.properties, other.properties)):
            if a is not None and b is not None:
                found = inference.compare_schemas(a.drop(self.key), b.drop(other.key))
                if any(found.values()):
                    raise ValueError(f"the sides differ: {found}")

    def save_properties(self, path: str) -> None:
        """Write the properties as Parquet."""
        self.properties.write.mode("errorifexists").parquet(path)


@dataclass(frozen=True)
class VisionData:
    """Images with their roles, one row per ``key``; pixels are flat arrays with height, width and channels.

    Labels and predictions by task: a class and probabilities; arrays of boxes
    (cls, x, y, w, h, and conf of predicted ones); flat masks of classes.
    """

    df: DataFrame
    key: str = "image_id"
    task: str = "classification"
    label: str | None = None
    prediction: str | None = None
    pixels: str | None = None
    height: str = "height"
    width: str = "width"
    channels: str = "channels"
    embedding: str | None = None
    label_map: dict = field(default_factory=dict)
    name: str | None = None

    def __post_init__(self) -> None:
        if self.task not in IMAGE_TASKS:
            raise ValueError(f"an image task is one of {', '.join(IMAGE_TASKS)}")
        for column in filter(None, (self.key, self.label, self.prediction, self.pixels, self.embedding)):
            if column not in self.df.columns:
                raise ValueError(f"column {column} is not in the table")

    def validate(self) -> VisionData:
        """Look at the values of all roles; raises what is wrong."""
        if self.pixels:
            inference.check_images(self.df, self.pixels, self.height, self.width, self.channels)
        if self.label and self.task != "other":
            inference.check_labels(self.df, self.label, self.task)
        if self.prediction and self.task != "other":
            inference.check_predictions(self.df, self.prediction, self.task)
        return self

    @property
    def n_samples(self) -> int:
        return self.df.count()

    def class_name(self, number: Any) -> str:
        return str(self.label_map.get(number, number))

    def image_properties(self) -> DataFrame:
        """(key, label, properties of each image)."""
        own = [c for c in dict.fromkeys((self.key, self.label, self.pixels, self.height, self.width, self.channels)) if c]
        return vision.image_properties(self.df.select(*own), self.pixels, self.height, self.width, self.channels)

    def label_classes(self) -> DataFrame:
        """(cls, n) of the labels."""
        return vision.class_counts(self.df, self.label, self.task)

    def predicted_classes(self) -> DataFrame:
        return vision.predicted_class_counts(self.df, self.prediction, self.task)

    def judged(self) -> DataFrame:
        """(key, label, predicted) of classes, as text, for the checks of predictions."""
        if self.task != "classification":
            raise ValueError("only classes can be compared one by one")
        said = vision.predicted_class(self.prediction) if dict(self.df.dtypes)[self.prediction].startswith("array") else F.col(self.prediction)
        return self.df.select(self.key, F.col(self.label).cast("string").alias("label"), said.cast("string").alias("predicted"))

    def label_properties(self) -> DataFrame:
        return _properties(self.df.where(F.col(self.label).isNotNull()), self.key, self.label, self.task)

    def prediction_properties(self) -> DataFrame:
        """The properties of what was predicted; probabilities stand for their largest class."""
        df, column = self.df.where(F.col(self.prediction).isNotNull()), self.prediction
        if self.task == "classification":
            df, column = df.withColumn("__said", vision.predicted_class(column)), "__said"
        return _properties(df, self.key, column, self.task)

    def sample(self, n: int, seed: int = 42) -> VisionData:
        """At most ``n`` images, by the hash of the key (a sampling operator)."""
        return replace(self, df=self.df.orderBy(F.xxhash64(F.lit(seed), self.key), self.key).limit(n))

    def check_compatible(self, other: VisionData) -> None:
        inference.check_same_task(self.task, other.task)


def _properties(df: DataFrame, key: str, column: str, task: str) -> DataFrame:
    """(key, property, value) of labels or predictions: a row per value of each property."""
    if task == "detection":
        cells = {"samples_per_class": F.transform(column, lambda b: b["cls"].cast("double")), "bounding_box_area": F.transform(column, lambda b: (b["w"] * b["h"]).cast("double")), "boxes_per_image": F.array(F.size(column).cast("double"))}
    elif task == "segmentation":
        areas = vision.mask_areas(column)
        cells = {"samples_per_class": F.transform(vision.mask_classes(column), lambda c: c.cast("double")), "segment_area": F.transform(F.map_values(areas), lambda n: n.cast("double")), "classes_per_image": F.array(vision.mask_class_count(column).cast("double"))}
    else:
        cells = {"samples_per_class": F.array(F.col(column).cast("double"))}
    rows = F.inline(F.array(*(F.struct(F.lit(n).alias("property"), c.alias("values")) for n, c in cells.items())))
    return df.select(key, rows).select(key, "property", F.explode("values").alias("value"))
