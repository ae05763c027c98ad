"""Exact nearest rows by Gower distance, through balls around pivots.

Some rows are pivots; every row lies in the ball of its nearest pivot. Rows
with nulls in the same numbers are a ball of their own, as a null leaves its
column out of a distance and of its divisor. Between two such kinds of rows the
columns that both have are fixed, and over these the summed differences obey the
triangle inequality, so a ball's centre and radius bound the distance to each
of its rows, from below and from above.

From the balls alone, a row each, every ball of questions learns how far its
``k``-th neighbours can be at most, and which balls may hold nearer ones. Only
these meet: a task holds the questions of one ball (cut into parts of about
``block`` rows) and sees the balls from the nearest on, one part at a time,
leaving out the questions whose neighbours are all nearer than the ball.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import kept

#: Rows of a part; pivots at most (twice the root of the rows, else). A row per pivot and kind of nulls reaches the driver.
BLOCK, MOST_PIVOTS = 2048, 4096


def gower_neighbours(df: DataFrame, queries: DataFrame | None, id_column: str, numeric: list[str], categorical: list[str], k: int, block: int = BLOCK, pivots: int | None = None, compared=None) -> DataFrame:
    """(id, neighbour, distance, place): the ``k`` nearest rows of ``df`` for each row of ``queries``, or of ``df`` itself.

    Numbers differ by their share of the column's range and are left out where
    null on either side; categories differ by 0 or 1, null like null. Of equal
    distances the smaller id is nearer; a row is no neighbour of its own id,
    rows without an id are left out. ``compared`` may be an accumulator, to
    which tasks add the distances that they compute.
    """
    import numpy as np

    spark, kind = df.sparkSession, dict(df.dtypes)[id_column]
    number = lambda c: F.col(f"`{c}`").cast("double")
    n_numbers, names = len(numeric), [*(f"n{i}" for i in range(len(numeric))), *(f"c{i}" for i in range(len(categorical)))]
    cells = [F.when(~F.isnan(number(c)), number(c)).alias(f"n{i}") for i, c in enumerate(numeric)] + [F.coalesce(F.xxhash64(c), F.lit(0)).alias(f"c{i}") for i, c in enumerate(categorical)]
    plain = lambda x: x.where(F.col(id_column).isNotNull()).select(F.col(id_column).alias("id"), F.xxhash64(id_column).alias("h"), *cells)
    base = plain(df)
    row = base.agg(F.count("*").alias("n"), *(f(f"n{i}").alias(f"{h}{i}") for i in range(n_numbers) for h, f in (("hi", F.max), ("lo", F.min)))).first()  # one row of ranges
    widths = np.array([(row[f"hi{i}"] or 0.0) - (row[f"lo{i}"] or 0.0) for i in range(n_numbers)])
    scale = np.where(widths > 0, widths, np.inf)
    middle = [((row[f"hi{i}"] or 0.0) + (row[f"lo{i}"] or 0.0)) / 2 for i in range(n_numbers)]
    m = max(1, min(pivots or int(np.ceil(2 * np.sqrt(row.n))), MOST_PIVOTS))
    found = base.select("h", *names).orderBy("h").limit(m).collect()  # m rows
    centres = sorted({(*(middle[i] if r[f"n{i}"] is None else r[f"n{i}"] for i in range(n_numbers)), *(r[f"c{i}"] for i in range(len(categorical)))) for r in found})
    numbers = np.array([c[:n_numbers] for c in centres]).reshape(len(centres), n_numbers)
    codes = np.array([c[n_numbers:] for c in centres], dtype=np.int64).reshape(len(centres), len(categorical))

    def sums(x, y, xn, yn):
        """Summed differences of all rows of x and y, over what both have, and in how many columns that is."""
        import numpy as np

        total = np.zeros((len(xn), len(yn)))
        weight = np.full_like(total, y.shape[1])
        for c in range(xn.shape[1]):
            gap = np.abs(xn[:, c, None] - yn[None, :, c])
            both = ~np.isnan(gap)
            weight += both
            total += np.where(both, gap, 0.0) / scale[c]
        for c in range(y.shape[1]):
            total += x[:, c, None] != y[None, :, c]
        return total, weight

    def table(batch):
        import numpy as np

        columns = [batch.field(n).to_numpy(zero_copy_only=False) for n in names]
        size = len(batch.field("h"))
        return np.array(columns[n_numbers:], dtype=np.int64).reshape(-1, size).T, np.array(columns[:n_numbers], dtype=float).reshape(-1, size).T

    def dealt(batches):
        """Each row with its ball (pivot and which numbers are null) and its summed difference to the pivot."""
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                code, number = table(some.to_struct_array())
                total, _ = sums(code, codes, number, numbers)
                nearest = total.argmin(1)
                nulls = np.isnan(number) @ (1 << np.arange(n_numbers, dtype=np.int64)) if n_numbers else np.zeros(len(total), dtype=np.int64)
                ball = (nulls.astype(np.int64) * len(centres)) + nearest
                yield pa.RecordBatch.from_arrays([pa.array(ball), pa.array(total[np.arange(len(total)), nearest]), *some.columns], names=["ball", "s", "id", "h", *names])

    if not centres:
        return spark.createDataFrame([], f"id {kind}, neighbour {kind}, distance double, place int")
    schema = f"ball long, s double, id {kind}, h long, " + ", ".join(f"{n} {'double' if n[0] == 'n' else 'long'}" for n in names)
    held = kept(base.mapInArrow(dealt, schema))
    asked = held if queries is None else kept(plain(queries).mapInArrow(dealt, schema))
    stats = lambda x: x.groupBy("ball").agg(F.max("s").alias("radius"), F.count("*").alias("n")).orderBy("ball").collect()  # noqa: E731  a row per ball
    of_base = stats(held)
    of_asked = of_base if queries is None else stats(asked)
    balls, radius, size = (np.array([r[c] for r in of_base]) for c in ("ball", "radius", "n"))
    centre = balls % len(centres)
    has = ~(((balls // len(centres))[:, None] >> np.arange(n_numbers, dtype=np.int64)) & 1).astype(bool)

    def reach(batches):
        """Of each ball of questions the balls that may hold neighbours, and the least distance to each."""
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for q, own, r in zip(*(c.to_pylist() for c in batch.columns)):
                pivot = q % len(centres)
                mine = ~((q // len(centres)) >> np.arange(n_numbers, dtype=np.int64) & 1).astype(bool)
                gap = np.abs(numbers[pivot][None] - numbers[centre]) / scale
                far = np.where(has & mine, gap, 0.0).sum(1) + (codes[pivot][None] != codes[centre]).sum(1)
                weight = (has & mine).sum(1) + codes.shape[1]
                with np.errstate(invalid="ignore", divide="ignore"):
                    most, least = (far + r + radius) / weight, np.maximum(far - r - radius, 0.0) / weight
                most[weight == 0] = least[weight == 0] = np.inf
                order = np.argsort(most, kind="stable")
                enough = np.searchsorted(np.cumsum(size[order]), k + 1)  # one may be the question itself
                bound = most[order[enough]] if enough < len(order) else np.inf
                near = np.flatnonzero((least <= bound + 1e-9) & (weight > 0))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(near), q)), pa.array(balls[near]), pa.array(least[near])], names=["q", "ball", "least"])

    parts = lambda x, of: x.join(F.broadcast(spark.createDataFrame([(int(r.ball), -(-int(r.n) // block)) for r in of], "ball long, parts long")), "ball").withColumn("part", F.pmod(F.xxhash64(F.lit(1), "h"), F.col("parts")))
    sets = lambda x, of: parts(x, of).groupBy("ball", "part").agg(F.sort_array(F.collect_list(F.struct("id", "h", *names))).alias("rows"))  # noqa: E731  about ``block`` rows each
    ask = sets(asked, of_asked).select(F.col("ball").alias("q"), F.col("part").alias("qpart"), F.lit(-1).cast("long").alias("ball"), F.lit(-1).cast("long").alias("part"), F.lit(-1.0).alias("least"), "rows")
    plan = spark.createDataFrame([(int(r.ball), int(r.n), float(r.radius)) for r in of_asked], "q long, n long, r double").repartition(max(1, min(len(of_asked), spark.sparkContext.defaultParallelism * 4)))
    plan = plan.mapInArrow(reach, "q long, ball long, least double")
    questions = plan.join(ask.select("q", "qpart"), "q")
    met = questions.join(sets(held, of_base), "ball").select("q", "qpart", "ball", "part", "least", "rows")
    tasks = max(1, sum(-(-int(r.n) // block) for r in of_asked))
    ordered = ask.unionByName(met).repartition(min(tasks, 4096), "q", "qpart").sortWithinPartitions("q", "qpart", "least", "ball", "part")
    where = {int(b): i for i, b in enumerate(balls)}

    def nearest(batches):
        import numpy as np
        import pyarrow as pa

        def bounds():
            """The distance of each question's last neighbour so far."""
            last = np.full(len(code), np.inf)
            n = np.bincount(best[0], minlength=len(code))
            ends = np.cumsum(n) - 1
            full = n >= k
            last[full] = best[2][ends[full]]
            return last

        def emit():
            n = np.arange(len(best[0])) - np.searchsorted(best[0], best[0]) + 1
            return pa.RecordBatch.from_arrays([ids.take(pa.array(best[0])), best[1], pa.array(best[2]), pa.array(n.astype(np.int32))], names=["id", "neighbour", "distance", "place"])

        def candidates(which, base_code, base_number, base_h, base_ids):
            total, weight = sums(code[which], base_code, number[which], base_number)
            if compared is not None:
                compared.add(total.size)
            with np.errstate(invalid="ignore", divide="ignore"):
                total = np.where((weight > 0) & (h[which][:, None] != base_h[None]), total / weight, np.inf)
            last = np.partition(total, k - 1, axis=1)[:, k - 1] if k < total.shape[1] else np.full(len(total), np.inf)
            rows, columns = np.nonzero((total <= np.minimum(last, limit[which])[:, None]) & (total < np.inf))
            return which[rows], base_ids.take(pa.array(columns)), total[rows, columns]

        ids = None
        for batch in batches:
            for i in range(batch.num_rows):
                ball, held_rows = batch.column(2)[i].as_py(), batch.column(5)[i].values
                if ball < 0:
                    if ids is not None:
                        yield emit()
                    ids, h, (code, number) = held_rows.field("id"), held_rows.field("h").to_numpy(), table(held_rows)
                    best = (np.zeros(0, np.int64), ids.slice(0, 0), np.zeros(0))
                    continue
                j, limit = where[ball], bounds()
                far, weight = sums(code, codes[centre[j]][None], np.where(has[j], number, np.nan) if n_numbers else number, numbers[centre[j]][None])
                with np.errstate(invalid="ignore", divide="ignore"):
                    least = np.where(weight[:, 0] > 0, (far[:, 0] - radius[j]) / weight[:, 0], np.inf)
                open_ = np.flatnonzero(least <= limit + 1e-9)
                if not len(open_):
                    continue
                base_code, base_number = table(held_rows)
                found = [best] + [candidates(open_[at : at + 512], base_code, base_number, held_rows.field("h").to_numpy(), held_rows.field("id")) for at in range(0, len(open_), 512)]
                who, others, gap = np.concatenate([f[0] for f in found]), pa.concat_arrays([f[1] for f in found]), np.concatenate([f[2] for f in found])
                rank = np.argsort(np.argsort(others.to_numpy(zero_copy_only=False), kind="stable"), kind="stable")
                order = np.lexsort((rank, gap, who))
                first = np.searchsorted(who[order], who[order])
                order = order[np.arange(len(order)) - first < k]
                best = (who[order], others.take(pa.array(order)), gap[order])
        if ids is not None:
            yield emit()

    # Nested functions travel with the plan, so workers need not import this module.
    return ordered.mapInArrow(nearest, f"id {kind}, neighbour {kind}, distance double, place int")


__all__ = ["gower_neighbours"]
