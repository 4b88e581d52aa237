"""Descriptive statistics, histograms, quantiles, ranks.

Order statistics of a whole column come from exact counts, not from a sort in
one task: ``order_statistics`` narrows the value range by histograms until the
wanted ranks are known.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import stash


def numbers(df: DataFrame, feature: str | Column, log: bool = False) -> DataFrame:
    """One column ``v`` of the non-null, finite values (or their log10)."""
    v = (F.col(feature) if isinstance(feature, str) else feature).cast("double")
    v = F.log10(v) if log else v
    return df.select(v.alias("v")).where("v is not null and not isnan(v)")


def order_statistics(values: DataFrame, ranks: Sequence[int], parts: int = 4096, small: int = 20_000) -> dict[int, float]:
    """Values at 0-based ranks of ``v`` in ascending order.

    Each round counts the rows in equal parts of the range and goes on with the
    part that holds the rank; at most ``parts`` counts reach the driver. When a
    part has few rows, those are sorted.
    """
    out: dict[int, float] = {}
    for rank in sorted(set(ranks)):
        part, skip = values, rank
        while rank not in out:
            n, lo, hi = part.agg(F.count("v"), F.min("v"), F.max("v")).first()
            if skip < 0 or skip >= n:
                raise IndexError(rank)
            if lo == hi:
                out[rank] = lo
            elif n <= small:
                out[rank] = part.orderBy("v").limit(skip + 1).agg(F.max("v")).first()[0]
            else:
                step = (hi - lo) / parts
                k = F.least(F.lit(parts - 1), F.floor((F.col("v") - F.lit(lo)) / F.lit(step)).cast("int")) if step > 0 else F.lit(0)
                binned = part.withColumn("k", k)
                for b, c in sorted((r["k"], r["count"]) for r in binned.groupBy("k").count().collect()):
                    if skip < c:
                        part = binned.where(F.col("k") == b).select("v")
                        break
                    skip -= c
    return out


def stats(df: DataFrame, feature: str, log: bool = False) -> DataFrame:
    """n, mean, upper median, population sigma, min, max as one row."""
    v = numbers(df, feature, log)
    n = v.count()
    median = order_statistics(v, [n // 2])[n // 2] if n else None
    return v.agg(
        F.count("v").alias("n"), F.avg("v").alias("mean"), F.lit(median).cast("double").alias("median"),
        F.stddev_pop("v").alias("sigma"), F.min("v").alias("min"), F.max("v").alias("max"),
    )


def histogram(df: DataFrame, feature: str, bins: int = 100, lo: float | None = None, hi: float | None = None, log: bool = False, skip: Column | None = None) -> DataFrame:
    """(bin, centre, count) for all bins: step (max - min) / (bins - 1), bin floor((v - min) / step)."""
    v = numbers(df, feature, log)
    if skip is not None:
        v = v.where(~skip)
    if lo is not None and hi is not None:
        v = v.where(F.col("v").between(lo, hi))
    span = v.agg(F.coalesce(F.lit(lo), F.min("v")).cast("double").alias("lo"), F.coalesce(F.lit(hi), F.max("v")).cast("double").alias("hi"))
    span = span.withColumn("step", (F.col("hi") - F.col("lo")) / (bins - 1))
    k = F.when(F.col("step") > 0, F.floor((F.col("v") - F.col("lo")) / F.col("step"))).otherwise(0)
    counts = v.join(F.broadcast(span)).groupBy(k.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))  # span: one row
    frame = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).join(F.broadcast(span))
    out = frame.join(counts, "bin", "left")
    return out.select("bin", (F.col("lo") + (F.col("bin") + 0.5) * F.col("step")).alias("centre"), F.coalesce("n", F.lit(0)).alias("count"))


def moments(df: DataFrame, feature: str) -> DataFrame:
    """n, mean, variances, skewness and (not excess) kurtosis, merged from partial aggregates."""
    v = numbers(df, feature)
    return v.agg(
        F.count("v").alias("n"), F.avg("v").alias("mean"), F.var_pop("v").alias("var_pop"), F.var_samp("v").alias("var_samp"),
        F.skewness("v").alias("skewness"), (F.kurtosis("v") + 3).alias("kurtosis"),
    )


def sample_stats(df: DataFrame, feature: str) -> DataFrame:
    return numbers(df, feature).agg(F.avg("v").alias("mean"), F.var_samp("v").alias("variance"), F.stddev_samp("v").alias("sigma"))


def true_median(df: DataFrame, feature: str) -> float | None:
    """The mean of the middle two for an even count."""
    v = numbers(df, feature)
    n = v.count()
    if not n:
        return None
    got = order_statistics(v, [(n - 1) // 2, n // 2])
    return (got[(n - 1) // 2] + got[n // 2]) / 2


def quantile(df: DataFrame, feature: str, q: float) -> float | None:
    """The element at floor(q * n); q above 1 means percent."""
    v = numbers(df, feature)
    n = v.count()
    if not n:
        return None
    k = min(n - 1, int((q / 100 if q > 1 else q) * n))
    return order_statistics(v, [k])[k]


def interpolated_quantile(df: DataFrame, feature: str, q: float) -> float | None:
    """Linear between the two neighbouring order statistics."""
    v = numbers(df, feature)
    n = v.count()
    if not n:
        return None
    at = q * (n - 1)
    k = int(at)
    got = order_statistics(v, [k, min(k + 1, n - 1)])
    return got[k] + (at - k) * (got[min(k + 1, n - 1)] - got[k])


def bounding_box(df: DataFrame, by: Sequence[str] = (), axes: Sequence[str] = ("x", "y")) -> DataFrame:
    aggs = [f(a).alias(f"{n}_{a}") for a in axes for n, f in (("min", F.min), ("max", F.max))]
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)


def average_density(df: DataFrame, axes: Sequence[str] = ("x", "y")) -> DataFrame:
    """n, box measure, density and measure per row, over the box of whole numbers."""
    size = None
    for a in axes:
        w = F.ceil(F.max(a)) - F.floor(F.min(a))
        size = w if size is None else size * w
    return df.agg(F.count(F.lit(1)).alias("n"), size.cast("double").alias("box")).select(
        "n", "box", F.try_divide(F.col("n").cast("double"), F.col("box")).alias("density"), F.try_divide(F.col("box"), F.col("n").cast("double")).alias("per_loc")
    )


def sphere_density(n: Column, radius: Column) -> Column:
    return n / (F.lit(4 * 3.141592653589793) * radius * radius)


def rank(df: DataFrame, feature: str, method: str = "average", ascending: bool = True, by: Sequence[str] = (), name: str = "rank") -> DataFrame:
    """1-based ranks; ties get their average, smallest or largest place.

    Values are counted first, so a rank is a running sum over distinct values,
    dealt over ranges of values when the whole column is one group.
    """
    counts = df.where(F.col(feature).isNotNull()).groupBy(*by, feature).agg(F.count(F.lit(1)).alias("_c"))
    before = running_total(counts, list(by), feature, "_c", ascending)
    value = {"min": F.col("_before") + 1, "max": F.col("_before") + F.col("_c"), "average": F.col("_before") + (F.col("_c") + 1) / 2}[method]
    table = before.select(*[F.col(b).alias(f"_k{i}") for i, b in enumerate(by)], F.col(feature).alias("_v"), value.alias(name))
    on = [F.col(feature) == F.col("_v"), *[F.col(b).eqNullSafe(F.col(f"_k{i}")) for i, b in enumerate(by)]]
    return df.join(table, on, "left").drop("_v", *[f"_k{i}" for i in range(len(by))])


def in_order(df: DataFrame, *order: Column) -> DataFrame:
    """df, written, with ``_part`` and ``_at``: its range of a sort of all rows, and its place in that range.

    Ranges are cut by a sample of the values, so a heavy tail or one frequent value does not fill one task.
    """
    rows = stash(df.orderBy(*order).withColumn("_id", F.monotonically_increasing_id()), "sorted")
    return rows.withColumns({"_part": F.shiftright("_id", 33), "_at": F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))}).drop("_id")


def _before_parts(sums: DataFrame, by: Sequence[str]) -> DataFrame:
    """(_g0, _g1, ..., _p, _base): what lies before each range of a sort; sums has a row for each range and group in it."""
    earlier = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = F.coalesce(F.sum("_s").over(earlier), F.lit(0)).alias("_base")
    return sums.select(*[F.col(b).alias(f"_g{i}") for i, b in enumerate(by)], F.col("_part").alias("_p"), base)


def running_total(df: DataFrame, by: list[str], order: str, value: str, ascending: bool = True) -> DataFrame:
    """df with ``_before``: the sum of ``value`` over rows that come earlier in their group. Only rows of one range of a sort meet in a task."""
    rows = in_order(df, *[F.col(b) for b in by], F.col(order).asc() if ascending else F.col(order).desc())
    sums = _before_parts(rows.groupBy(*by, "_part").agg(F.sum(value).alias("_s")), by)
    on = [F.col("_part") == F.col("_p"), *[F.col(b).eqNullSafe(F.col(f"_g{i}")) for i, b in enumerate(by)]]
    within = Window.partitionBy(*by, "_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    out = rows.withColumn("_in", F.coalesce(F.sum(value).over(within), F.lit(0))).join(sums, on, "left")
    return out.withColumn("_before", F.col("_base") + F.col("_in")).drop("_part", "_at", "_p", "_base", "_in", *[f"_g{i}" for i in range(len(by))])


def argsort(df: DataFrame, feature: str, key: str) -> DataFrame:
    """(key, place): 0-based places in ascending order, ties by key."""
    rows = in_order(df.select(key, feature).where(F.col(feature).isNotNull()), F.col(feature), F.col(key))
    sums = _before_parts(rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_s")), [])
    return rows.join(sums, F.col("_part") == F.col("_p")).select(key, (F.col("_base") + F.col("_at")).cast("long").alias("place"))


def partial_order(df: DataFrame, feature: str, key: str, first: int) -> DataFrame:
    """(key, place) of the first rows in ascending order, ties by key; each task keeps no more than so many."""
    top = df.select(key, feature).where(F.col(feature).isNotNull()).orderBy(feature, key).limit(first)
    return top.select(key, (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(feature, key)) - 1).cast("long").alias("place"))  # of so many rows


def cumulative(hist: DataFrame) -> DataFrame:
    """A histogram with its running share of the total; histograms have few rows."""
    w = Window.partitionBy(F.lit(0)).orderBy("bin")
    total = F.sum("count").over(Window.partitionBy(F.lit(0)))
    return hist.withColumn("cdf", F.sum("count").over(w.rowsBetween(Window.unboundedPreceding, 0)) / F.greatest(total, F.lit(1)))


def probability(hist: DataFrame) -> DataFrame:
    """A histogram as a density: count / (n * distance to the next centre)."""
    w = Window.partitionBy(F.lit(0)).orderBy("bin")
    gap = F.coalesce(F.lead("centre").over(w) - F.col("centre"), F.col("centre") - F.lag("centre").over(w))
    return hist.withColumn("pdf", F.try_divide(F.col("count").cast("double"), F.sum("count").over(Window.partitionBy(F.lit(0))) * gap))


def first_crossing(curve: DataFrame, measured: str, model: str, at: str = "centre") -> DataFrame:
    """The first place where the measured curve is at or below the model."""
    return curve.agg(F.min(F.when(F.col(measured) <= F.col(model), F.col(at))).alias("threshold"))


def relabel(df: DataFrame, label: str, name: str = "dense") -> DataFrame:
    """Labels as 0, 1, 2 ... in ascending order."""
    distinct = df.select(label).where(F.col(label).isNotNull()).distinct().withColumn("_one", F.lit(1))
    table = running_total(distinct, [], label, "_one").select(F.col(label).alias("_l"), F.col("_before").cast("long").alias(name))
    return df.join(table, F.col(label) == F.col("_l"), "left").drop("_l")


def iqr_cutoff(df: DataFrame, feature: str) -> dict[str, float]:
    """Quartiles by floor(q * n) and the upper fence q75 + 1.5 * IQR."""
    v = numbers(df, feature)
    n = v.count()
    got = order_statistics(v, [int(0.25 * n), int(0.75 * n)])
    q1, q3 = got[int(0.25 * n)], got[int(0.75 * n)]
    return {"q25": q1, "q75": q3, "cutoff": q3 + 1.5 * (q3 - q1)}
