"""Density of every row among its k nearest rows by Gower distance, without a row per pair, where the rows lie on few lines.

Rows that are alike in all columns but one number, the axis, are a line. From a
question, another line is a constant away by the other columns, so the rows of
that line within a radius are one stretch of the axis, and how many they are and
what they add to sums of distances are differences of running sums. Each
question looks for the radius that holds its k nearest rows; only the rows at
that radius are compared one by one, so the work for a question grows with the
lines in its reach and the logarithm of their rows, not with k.

Lines are cut into pieces along the axis. A task holds the questions of one
piece and the pieces that may hold a neighbour of them; the number of pieces is
bounded, so what is shuffled grows with the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import kept

#: Lines at most, unless k is larger (a row each reaches the driver, with its cuts), and then; pieces of a line at most.
FEW_LINES, MOST_LINES, GRID = 1024, 4096, 256
#: Pieces of questions and of rows that are aimed at, and the least rows in one.
ASKED, HELD, LEAST_ASKED, LEAST_HELD = 400, 4000, 1024, 256


def line_density(df: DataFrame, id_column: str, numeric: list[str], categorical: list[str], k: int, extent: float, least_asked: int = LEAST_ASKED, least_held: int = LEAST_HELD) -> DataFrame | None:
    """(id, pd, mean_distance, epd): ``extent`` times the root mean square distance to the ``k`` nearest rows, the mean distance, and the mean of these rows' ``pd``.

    Neighbours are those of :func:`.neighbours.gower_neighbours`. None where the
    rows lie on too many lines, a number is missing or infinite, or an id occurs twice.
    """
    import numpy as np

    spark, kind = df.sparkSession, dict(df.dtypes)[id_column]
    if not numeric:
        return None
    n_numbers, names = len(numeric), [*(f"n{i}" for i in range(len(numeric))), *(f"c{i}" for i in range(len(categorical)))]
    number = lambda c: F.col(f"`{c}`").cast("double")
    cells = [F.when(~F.isnan(number(c)), number(c)).alias(f"n{i}") for i, c in enumerate(numeric)] + [F.coalesce(F.xxhash64(c), F.lit(0)).alias(f"c{i}") for i, c in enumerate(categorical)]
    plain = df.where(F.col(id_column).isNotNull()).select(F.col(id_column).alias("id"), *cells)
    of_numbers = [f(f"n{i}").alias(f"{h}{i}") for i in range(n_numbers) for h, f in (("hi", F.max), ("lo", F.min), ("has", F.count))]
    row = plain.agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"), *of_numbers).first()  # one row of ranges
    n_rows = row.n
    if n_rows < 2 or row.ids < n_rows or any(row[f"has{i}"] < n_rows for i in range(n_numbers)):
        return None
    values = plain.agg(*(F.approx_count_distinct(f"n{i}") for i in range(n_numbers))).first()
    axis = int(np.argmax(values))
    widths = np.array([row[f"hi{i}"] - row[f"lo{i}"] for i in range(n_numbers)])
    if not (np.isfinite(widths).all() and widths[axis] > 0):
        return None
    slack = 1e-12 + 8 * np.finfo(float).eps * max(abs(row[f"hi{axis}"]), abs(row[f"lo{axis}"])) / widths[axis]  # more than a distance's rounding
    others = [n for n in names if n != f"n{axis}"]
    limit = max(FEW_LINES, min(k, MOST_LINES))
    found = sorted(tuple(r) for r in plain.select(*others).distinct().limit(limit + 1).collect()) if others else [()]
    if slack > 1e-10 or len(found) > limit:
        return None
    scale, width, weight, most_near = np.where(widths > 0, widths, np.inf), float(widths[axis]), len(names), min(k, n_rows - 1)
    fixed = {n: [r[i] for r in found] for i, n in enumerate(others)}
    numbers = np.array([fixed.get(f"n{i}", [0.0] * len(found)) for i in range(n_numbers)]).T
    codes = np.array([fixed[f"c{i}"] for i in range(len(categorical))], dtype=np.int64).reshape(len(categorical), len(found)).T

    rows = plain.withColumnRenamed(f"n{axis}", "x")
    if others:
        kinds = ", ".join(f"{n} {'double' if n[0] == 'n' else 'long'}" for n in others)
        rows = rows.join(F.broadcast(spark.createDataFrame([(i, *r) for i, r in enumerate(found)], f"line long, {kinds}")), others)
    else:
        rows = rows.withColumn("line", F.lit(0).cast("long"))
    rows = kept(rows.select("id", "line", "x"))
    points = kept(rows.groupBy("line", "x").agg(F.count("*").alias("n")))
    along = points.groupBy("line").agg(F.count("*").alias("points"), F.percentile_approx("x", [i / GRID for i in range(1, GRID)], 10000).alias("grid")).collect()  # a row per line
    n_points = sum(r.points for r in along)

    def cuts(r, size):
        m = min(GRID, -(-r.points // size))
        return sorted({r.grid[j * GRID // m - 1] for j in range(1, m)})

    asked_size, held_size = max(least_asked, -(-n_points // ASKED)), max(least_held, -(-n_points // HELD))
    where = F.broadcast(spark.createDataFrame([(r.line, cuts(r, asked_size), cuts(r, held_size)) for r in along], "line long, q array<double>, b array<double>"))
    place = lambda name: (F.col("line") * GRID + F.size(F.filter(name, lambda c: c < F.col("x")))).alias(name)
    dealt = lambda df: df.join(where, "line").select(*df.columns, place("q"), place("b"))
    stats = lambda name: dealt(points).groupBy(name).agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.sum("n").alias("n")).orderBy(name).collect()  # noqa: E731  a row per piece
    of_asked, of_held = stats("q"), stats("b")
    pieces, low, high, size = (np.array([r[c] for r in of_held]) for c in ("b", "lo", "hi", "n"))

    def away(line, lines):
        """Summed differences of a line to others, the axis left out."""
        gap = (numbers[line] - numbers[lines]).__abs__() / scale
        return gap.sum(1) + (codes[line] != codes[lines]).sum(1)

    def reach(batches):
        """Of each piece of questions the pieces that may hold neighbours, and a distance within which all questions have enough."""
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for q, lo, hi in zip(*(c.to_pylist() for c in batch.columns)):
                off = away(q // GRID, pieces // GRID)
                most = (off + np.maximum(np.abs(high - lo), np.abs(hi - low)) / width) / weight
                least = (off + np.maximum(np.maximum(low - hi, lo - high), 0.0) / width) / weight
                order = np.argsort(most, kind="stable")
                enough = np.searchsorted(np.cumsum(size[order]), most_near + 1)  # one is the question itself
                bound = most[order[enough]] if enough < len(order) else 1.0
                near = np.flatnonzero(least <= bound + 1e-9)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(near), q)), pa.array(pieces[near]), pa.array(np.full(len(near), bound))], names=["q", "b", "bound"])

    tasks = max(1, min(len(of_asked), spark.sparkContext.defaultParallelism * 4))
    plan = spark.createDataFrame([(r.q, r.lo, r.hi) for r in of_asked], "q long, lo double, hi double").repartition(tasks).mapInArrow(reach, "q long, b long, bound double")

    def meeting(df, columns):
        """The points of each piece of questions, followed by the pieces in its reach along the axis."""
        sets = lambda name: dealt(df).groupBy(name).agg(F.sort_array(F.collect_list(F.struct("x", "n", *columns))).alias("rows"))  # noqa: E731  bounded points each
        ask = sets("q").select("q", F.lit(-1).cast("long").alias("b"), F.lit(1.0).alias("bound"), "rows")
        met = plan.join(sets("b"), "b").select("q", "b", "bound", "rows")
        return ask.unionByName(met).repartition(len(of_asked), "q").sortWithinPartitions("q", "b")

    def solved(solve):
        """A task's pieces of questions one after the other, each with the lines that it meets."""

        def run(batches):
            asked = None
            for batch in batches:
                for i in range(batch.num_rows):
                    b, held = batch.column(1)[i].as_py(), batch.column(3)[i].values
                    if b >= 0:
                        lines.setdefault(b // GRID, []).append(held)
                        bound = batch.column(2)[i].as_py()
                        continue
                    if asked is not None:
                        yield from solve(line, asked, bound, lines)
                    line, asked, lines = batch.column(0)[i].as_py() // GRID, held, {}
            if asked is not None:
                yield from solve(line, asked, bound, lines)

        return run

    def column(held, name):
        import numpy as np

        return np.concatenate([h.field(name).to_numpy(zero_copy_only=False) for h in held])

    def running(values, wide=True):
        import numpy as np

        return np.concatenate([[0], np.cumsum(values, dtype=np.longdouble if wide else np.int64)])

    def stretch(x, off, r, at, mid):
        """Of sorted ``x`` the rows within ``r`` of each question: from, to; none if the line is farther."""
        import numpy as np

        t = (r * weight - off) * width
        return np.where(t < 0, mid, np.searchsorted(x, at - t, "left")), np.where(t < 0, mid, np.searchsorted(x, at + t, "right"))

    def spread_out(start, end):
        """(question, place): all places of a stretch per question."""
        import numpy as np

        n = end - start
        who = np.repeat(np.arange(len(n)), n)
        return who, np.arange(len(who)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start, n)

    def distance(line, lines, at, x):
        """As the rows' distance is written: one column after the other, then the share of columns."""
        import numpy as np

        total = np.zeros(len(x))
        for c in range(n_numbers):
            total += np.abs(at - x if c == axis else numbers[line, c] - numbers[lines, c]) / scale[c]
        for c in range(codes.shape[1]):
            total += codes[line, c] != codes[lines, c]
        return total / weight

    def rim(line, tables, at, inner, outer):
        """The rows between two radii: (question, line, place, x, distance), the questions' own points left out."""
        import numpy as np

        parts = []
        for l, x, off in tables:
            if off > outer.max() * weight:
                continue
            mid = np.searchsorted(x, at, "left")
            (a, b), (c, d) = stretch(x, off, inner, at, mid), stretch(x, off, outer, at, mid)
            for who, i in (spread_out(c, a), spread_out(b, d)):
                parts.append((who, np.full(len(who), l), i, x[i]))
        who, lines, i, x = (np.concatenate(p) for p in zip(*parts))
        some = (lines != line) | (x != at[who])
        who, lines, i, x = who[some], lines[some], i[some], x[some]
        return who, lines, i, x, distance(line, lines, at[who], x)

    def densities(line, asked, bound, held):
        """Of each question point the mean and mean square of distances and the radius that holds its nearest rows."""
        import numpy as np
        import pyarrow as pa

        sums = {}
        for l in sorted(held):
            x, n = column(held[l], "x"), column(held[l], "n")
            zero = x[len(x) // 2]  # sums are about the line's middle, in extended precision
            y = (x - zero).astype(np.longdouble)
            sums[l] = (x, n, float(away(line, np.array([l]))[0]), running(n, False), zero, running(n * y), running(n * np.abs(y)), running(n * y * y))
        tables = [(l, s[0], s[2]) for l, s in sums.items()]
        every, many = asked.field("x").to_numpy(), asked.field("n").to_numpy()
        first, second, radius = (np.zeros(len(every)) for _ in range(3))
        open_ = np.flatnonzero(most_near > many - 1)  # the others have enough copies
        for begin in range(0, len(open_), 256):
            own = open_[begin : begin + 256]
            at, copies = every[own], many[own]
            need = most_near - (copies - 1)
            mids = {l: np.searchsorted(x, at, "left") for l, x, _ in tables}

            def held_within(r, some):
                count, places = np.zeros(len(some), np.int64), np.zeros(len(some), np.int64)
                for l, x, off in tables:
                    if off <= r.max() * weight:
                        a, b = stretch(x, off, r, at[some], mids[l][some])
                        count += sums[l][3][b] - sums[l][3][a]
                        places += b - a
                        if l == line:
                            count -= np.where(b > a, copies[some], 0)
                return count, places

            lo, hi = np.full(len(own), -8 * slack), np.full(len(own), min(bound, 1.0) + slack)
            at_lo, at_hi = np.zeros(len(own), np.int64), held_within(hi, np.arange(len(own)))[1]
            for _ in range(64):
                some = np.flatnonzero((at_hi - at_lo > 64) & (hi - lo > slack))
                if not len(some):
                    break
                middle = (lo[some] + hi[some]) / 2
                count, places = held_within(middle, some)
                over = count >= need[some]
                hi[some[over]], at_hi[some[over]] = middle[over], places[over]
                lo[some[~over]], at_lo[some[~over]] = middle[~over], places[~over]
            inner, outer = lo - 4 * slack, hi + 4 * slack
            inside, one, two = np.zeros(len(own), np.int64), np.zeros(len(own), np.longdouble), np.zeros(len(own), np.longdouble)
            wrong_one, wrong_two, eps = np.zeros(len(own)), np.zeros(len(own)), np.finfo(np.longdouble).eps
            for l, (x, _, off, ns, zero, s1, a1, s2) in sums.items():
                if off > inner.max() * weight:
                    continue
                mid = mids[l]
                a, b = stretch(x, off, inner, at, mid)
                z = (at - zero).astype(np.longdouble)
                left, right = ns[mid] - ns[a], ns[b] - ns[mid]
                n = left + right - (np.where(b > a, copies, 0) if l == line else 0)
                gaps = (left * z - (s1[mid] - s1[a]) + (s1[b] - s1[mid]) - right * z) / width
                squares = (s2[b] - s2[a] - 2 * z * (s1[b] - s1[a]) + (left + right) * z * z) / width / width
                some = b > a
                inside += n
                one += np.where(some, n * off + gaps, 0)
                two += np.where(some, n * off * off + 2 * off * gaps + squares, 0)
                rounding = eps * (16 + np.sqrt(len(x)))
                loss_one, loss_two = a1[-1] + (left + right) * np.abs(z), s2[-1] + 2 * np.abs(z) * a1[-1] + (left + right) * z * z
                wrong_one += np.where(some, rounding * loss_one / width, 0).astype(float)
                wrong_two += np.where(some, rounding * (loss_two / width / width + 2 * off * loss_one / width), 0).astype(float)
            who, lines, i, x, d = rim(line, tables, at, inner, outer)
            n = np.zeros(len(who), np.int64)
            for l in np.unique(lines):
                n[lines == l] = sums[l][1][i[lines == l]]
            order = np.lexsort((d, who))
            who, d, n = who[order], d[order], n[order]
            upto = running(n, False)
            before = upto[:-1] - upto[np.searchsorted(who, who)]
            taken = np.clip((need - inside)[who] - before, 0, n)
            if (np.bincount(who, taken, len(own)) + inside != need).any():
                raise ArithmeticError("a question's nearest rows were not all in reach")
            np.maximum.at(radius, own[who[taken > 0]], d[taken > 0])
            one, two = (one / weight).astype(float), (two / weight / weight).astype(float)
            rest_one, rest_two = np.bincount(who, taken * d, len(own)), np.bincount(who, taken * d * d, len(own))
            lossy = (wrong_one / weight > 1e-12 * (one + rest_one)) | (wrong_two / weight / weight > 1e-12 * (two + rest_two))
            for j in np.flatnonzero(lossy & (inside > 0)):  # close rows far from their line's middle: summed one by one
                one[j] = two[j] = 0.0
                for l, (x, n, off, *_) in sums.items():
                    a, b = stretch(x, off, inner[j : j + 1], at[j : j + 1], mids[l][j : j + 1])
                    near = slice(int(a[0]), int(b[0]))
                    d = distance(line, np.full(near.stop - near.start, l), at[j], x[near])
                    one[j] += (n[near] * d).sum()
                    two[j] += (n[near] * d * d).sum()
            first[own], second[own] = one + rest_one, two + rest_two
        mean, pd = first / most_near, extent * np.sqrt(second / most_near)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(every), line)), *map(pa.array, (every, many, pd, mean, radius))], names=["line", "x", "n", "pd", "mean_distance", "radius"])

    def around(line, asked, bound, held):
        """Of each question point the mean ``pd`` of its nearest rows; of equal distances the smaller ids are nearer."""
        import numpy as np
        import pyarrow as pa

        sums = {}
        for l in sorted(held):
            x, n, pd = (column(held[l], c) for c in ("x", "n", "pd"))
            ids = pa.concat_arrays([h.field("ids") for h in held[l]])
            sums[l] = (x, n, float(away(line, np.array([l]))[0]), running(n, False), running(n * pd), pd, ids.flatten(), running(ids.value_lengths().to_numpy(zero_copy_only=False), False))
        tables = [(l, s[0], s[2]) for l, s in sums.items()]
        every, many, own_pd, mean, radius = (asked.field(c).to_numpy() for c in ("x", "n", "pd", "mean_distance", "radius"))
        total = np.minimum(many - 1, most_near) * own_pd
        open_ = np.flatnonzero(most_near > many - 1)
        for begin in range(0, len(open_), 256):
            own = open_[begin : begin + 256]
            at, r = every[own], radius[own]
            left, near = most_near - (many[own] - 1), np.zeros(len(own), np.longdouble)
            inner, outer = r - 4 * slack, r + 4 * slack
            for l, (x, _, off, ns, s, *_) in sums.items():
                if off > inner.max() * weight:
                    continue
                mid = np.searchsorted(x, at, "left")
                a, b = stretch(x, off, inner, at, mid)
                after = np.where(b > a, mid + 1, mid) if l == line else mid  # the question's own point is counted apart
                left = left - (ns[mid] - ns[a]) - (ns[b] - ns[after])
                near += (s[mid] - s[a]) + (s[b] - s[after])
            who, lines, i, x, d = rim(line, tables, at, inner, outer)
            some = d <= r[who]
            who, lines, i, d = who[some], lines[some], i[some], d[some]
            n, pd = np.zeros(len(who), np.int64), np.zeros(len(who))
            for l in np.unique(lines):
                n[lines == l], pd[lines == l] = sums[l][1][i[lines == l]], sums[l][5][i[lines == l]]
            tied = d == r[who]
            near += np.bincount(who[~tied], n[~tied] * pd[~tied], len(own))
            left = left - np.bincount(who[~tied], n[~tied], len(own)).astype(np.int64)
            alone = np.bincount(who[tied], minlength=len(own)) == 1
            easy = tied & alone[who]
            near += np.bincount(who[easy], left[who[easy]] * pd[easy], len(own))
            hard = np.flatnonzero(tied & ~alone[who])
            if len(hard):
                parts = []
                for l in np.unique(lines[hard]):
                    of = hard[lines[hard] == l]
                    ids, ends = sums[l][6:]
                    point, j = spread_out(ends[i[of]], ends[i[of] + 1])
                    parts.append((who[of][point], pd[of][point], ids.take(pa.array(j))))
                asker, value = (np.concatenate([p[c] for p in parts]) for c in (0, 1))
                ids = pa.concat_arrays([p[2] for p in parts]).to_numpy(zero_copy_only=False)
                rank = np.argsort(np.argsort(ids, kind="stable"), kind="stable")
                order = np.lexsort((rank, asker))
                asker, value = asker[order], value[order]
                first = np.arange(len(asker)) - np.searchsorted(asker, asker) < left[asker]
                near += np.bincount(asker[first], value[first], len(own))
            total[own] += near.astype(float)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(every), line)), *map(pa.array, (every, own_pd, mean, total / most_near))], names=["line", "x", "pd", "mean_distance", "epd"])

    # Nested functions travel with the plan, so workers need not import this module.
    dense = kept(meeting(points, []).mapInArrow(solved(densities), "line long, x double, n long, pd double, mean_distance double, radius double"))
    lowest = F.row_number().over(Window.partitionBy("line", "x").orderBy("id"))  # of a point no more than k are ever needed
    ids = rows.withColumn("place", lowest).where(F.col("place") <= most_near).groupBy("line", "x").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    epd = meeting(kept(dense.join(ids, ["line", "x"])), ["pd", "mean_distance", "radius", "ids"]).mapInArrow(solved(around), "line long, x double, pd double, mean_distance double, epd double")
    return rows.join(epd, ["line", "x"]).select(F.col("id").cast(kind).alias("id"), "pd", "mean_distance", "epd")


__all__ = ["line_density"]
