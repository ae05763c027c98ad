"""Running sums and quantiles over an order without bringing a whole column into one task.

All of them rest on one rank index: the rows in pieces along the order, each
with its running sums, written once. Quantiles, fences, distances of
distributions, ranks and curves are aggregates over it, so what is below (as a
rule the counts of a scan) is run once, however many of them are asked for.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import kept

#: Pieces that an order is cut into: at least so many, as many as the session's shuffles have partitions, at most so many.
BUCKETS, MOST_BUCKETS = 8, 4096


def running_sums(df: DataFrame, part: list[str], order: str | list[str | Column], sums: dict[str, str], ahead: str | None = None, totals: bool = False, buckets: int | None = None) -> DataFrame:
    """``df`` with running sums (including the own row) of ``sums`` (new name -> column), by ``order`` within ``part``; a table that is written.

    ``order``, a column or several, is distinct within ``part``. Rows are dealt
    to pieces by ranges of part and order, and summed inside a piece; the
    totals of the pieces before, a row for each piece and part that it holds,
    are added as the table is read. ``ahead`` names a column for the next row's
    ``order`` (one column then), null for the last. With ``totals`` each running
    sum c has {c}_n beside it, the sum of the part.
    """
    buckets = buckets or min(MOST_BUCKETS, max(BUCKETS, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    orders = order if isinstance(order, list) else [order]
    cut = df.repartitionByRange(buckets, *part, *orders).withColumn("__piece", F.spark_partition_id())
    inside = Window.partitionBy("__piece", *part).orderBy(*orders)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    local = cut.select(*(F.col(f"`{c}`") for c in cut.columns), *(F.sum(c).over(upto).alias(n) for n, c in sums.items()), *([F.lead(orders[0]).over(inside).alias(ahead)] if ahead else []))
    held = kept(local)
    ends = held.groupBy("__piece", *part).agg(*(F.sum(c).alias(f"__t_{n}") for n, c in sums.items()), *([F.min(orders[0]).alias("__first")] if ahead else []))
    whole = Window.partitionBy(*(part or [F.lit(0)]))
    along = whole.orderBy("__piece")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    offsets = kept(
        ends.select(
            F.col("__piece").alias("__of"),
            *(F.col(f"`{p}`").alias(f"__p{k}") for k, p in enumerate(part)),
            *(F.coalesce(F.sum(f"__t_{n}").over(before), F.lit(0)).alias(f"__o_{n}") for n in sums),
            *(F.sum(f"__t_{n}").over(whole).alias(f"{n}_n") for n in sums if totals),
            *([F.lead("__first").over(along).alias("__next")] if ahead else []),
        )
    )
    same = reduce(lambda a, b: a & b, (F.col(f"`{p}`").eqNullSafe(F.col(f"__p{k}")) for k, p in enumerate(part)), F.col("__piece") == F.col("__of"))
    out = held.join(F.broadcast(offsets), same)
    total = lambda n: (F.col(n) + F.col(f"__o_{n}")).alias(n)
    return out.select(*(F.col(f"`{c}`") for c in df.columns), *map(total, sums), *(f"{n}_n" for n in sums if totals), *([F.coalesce(ahead, "__next").alias(ahead)] if ahead else []))


def at_quantiles(value: str, upto: str, at: list[float]) -> list[Column]:
    """Aggregates over a rank index with totals: the exact quantiles ``at``, each between two values in proportion."""

    def one(q: float) -> Column:
        place = F.lit(float(q)) * (F.max(f"{upto}_n") - 1)
        row = F.lit(float(q)) * (F.col(f"{upto}_n") - 1)
        low, high = (F.min(F.when(F.col(upto) > k, F.col(value))) for k in (F.floor(row), F.ceil(row)))
        return F.when(low == high, low).otherwise((F.ceil(place) - place) * low + (place - F.floor(place)) * high)

    return [one(q) for q in at]


def exact_quantiles(df: DataFrame, part: list[str], value: str, at: list[float]) -> DataFrame:
    """(part, q, n): the exact quantiles of a numeric column, between two values in proportion; nulls and NaN left out.

    What ``percentile`` gives, which keeps all distinct values in one task.
    """
    v = F.col(f"`{value}`").cast("double")
    counts = df.select(*part, v.alias("__v")).where(F.col("__v").isNotNull() & ~F.isnan("__v")).groupBy(*part, "__v").agg(F.count("*").alias("__n"))
    ran = running_sums(counts, part, "__v", {"__upto": "__n"}, totals=True)
    return ran.groupBy(*part).agg(F.array(*at_quantiles("__v", "__upto", at)).alias("q"), F.max("__upto_n").alias("n"))
