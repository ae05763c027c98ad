"""The same check values over streams: windows, sessions, late rows, repeats and drift against a fixed table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import train_test


def windowed_values(events: DataFrame, time: str, value: str, category: str, size: str = "1 day", slide: str | None = None, late: str | None = "2 hours") -> DataFrame:
    """(window_start, n, n_null, mean, n_categories): of tumbling or sliding windows; on streams rows later than ``late`` are left out."""
    rows = events.withWatermark(time, late) if late and events.isStreaming else events
    span = F.window(time, size, slide) if slide else F.window(time, size)
    distinct = F.approx_count_distinct(category) if events.isStreaming else F.count_distinct(category)
    return rows.groupBy(span.alias("w")).agg(F.count("*").alias("n"), F.sum(F.col(value).isNull().cast("long")).alias("n_null"), F.avg(value).alias("mean"), distinct.alias("n_categories")).select(F.col("w.start").alias("window_start"), "n", "n_null", "mean", "n_categories")


def session_values(events: DataFrame, time: str, user: str, gap: str = "30 minutes", late: str | None = "2 hours") -> DataFrame:
    """(user, session_start, n): of sessions that end after a gap."""
    rows = events.withWatermark(time, late) if late and events.isStreaming else events
    return rows.groupBy(F.col(user).alias("user"), F.session_window(time, gap).alias("s")).agg(F.count("*").alias("n")).select("user", F.col("s.start").alias("session_start"), "n")


def deduplicated(events: DataFrame, key: list[str], time: str, late: str = "2 hours") -> DataFrame:
    """Each key once; on streams within the watermark, so that the state is bounded."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(key) if events.isStreaming else events.dropDuplicates(key)


def drift_of_batches(events: DataFrame, baseline: DataFrame, numeric: list[str], categorical: list[str], sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Starts a query that hands ``sink`` the drift of every micro-batch against ``baseline``."""

    def each(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            sink(train_test.feature_drift(baseline, batch, numeric, categorical).withColumn("batch", F.lit(number)), number)

    return events.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).start()


def running_values(stream: DataFrame, key: str, value: str) -> DataFrame:
    """(key, n, mean, low, high): of all values of a key so far, by a state of its own that every micro-batch updates."""
    from collections.abc import Iterator

    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    kind = dict(stream.dtypes)[key]

    def update(own: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, total, low, high = state.get if state.exists else (0, 0.0, float("inf"), float("-inf"))
        for part in parts:
            v = part[value].dropna()
            if len(v):
                n, total, low, high = n + len(v), total + float(v.sum()), min(low, float(v.min())), max(high, float(v.max()))
        state.update((n, total, low, high))
        yield pd.DataFrame({key: [own[0]], "n": [n], "mean": [total / n if n else None], "low": [low if n else None], "high": [high if n else None]})

    rows = stream.select(key, F.col(value).cast("double").alias(value))
    return rows.groupBy(key).applyInPandasWithState(update, f"`{key}` {kind}, n long, mean double, low double, high double", "n long, total double, low double, high double", "update", GroupStateTimeout.NoTimeout)
