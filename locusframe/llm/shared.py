"""What several operators need: tables in the shared folder, components, ranks without a hot task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..runtime import broadcast_if, fits, stash

__all__ = ["broadcast_if", "broadcast_small", "components", "fits", "numbered", "private", "ranked", "small_batches", "stash"]

NO_ID = -(2**63)
#: Tables are broadcast up to so many bytes.
BROADCAST_BYTES = 32 << 20
#: Bytes of a batch that goes to Python.
BATCH_BYTES = 4 << 20


def private(df: DataFrame, name: str) -> str:
    """A name like this one that no column of df has."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def small_batches(spark: SparkSession) -> None:
    """From now on Spark hands batches of BATCH_BYTES at most to Python, so that neither side holds many long texts at once.

    Its own limit is 64 MB, for which the JVM keeps buffers of twice that, in and out, for each task.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    have = str(spark.conf.get(name)).rstrip("b")
    if not have.isdigit() or int(have) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def components(links: DataFrame) -> DataFrame:
    """Components of links (a, b), the same way at every size: rounds over written tables."""
    from ..operators import graph  # here, as workers that read this module have no need of it

    return graph.components(links, one_task=0)


def broadcast_small(df: DataFrame) -> DataFrame:
    """A written table with a broadcast hint if its values take at most so many bytes; else as it is, for a shuffled join."""
    width = sum((F.octet_length(F.col(f"`{f.name}`").cast("string")) if f.dataType.typeName() in ("string", "binary") else F.lit(8) for f in df.schema), F.lit(16))
    return F.broadcast(df) if (df.agg(F.sum(width)).first()[0] or 0) <= BROADCAST_BYTES else df


def numbered(docs: DataFrame, name: str, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, bool]:
    """docs with a long that names each row, and whether it is the id itself.

    It is where no id repeats (null: the smallest long). Else rows are numbered
    in the order of id (null first), then a hash of the text, then their place
    in the table; docs is written once for that.
    """
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))
    if docs.groupBy(key.alias("k")).agg(F.count(F.lit(1)).alias("c")).where("c > 1").isEmpty():
        return docs.withColumn(name, key), True
    at = private(docs, "_at")
    table = stash(docs.withColumn(at, F.monotonically_increasing_id()), "rows")
    order = table.select(F.col(at), key.alias("k"), F.xxhash64(text_col).alias("h")).orderBy("k", "h", at)
    place = stash(order.select(F.col(at), F.monotonically_increasing_id().alias(name)), "places")
    return table.join(place, at).drop(at), False


def ranked(df: DataFrame, group: list[str], order: list[Column], name: str) -> DataFrame:
    """df, written, with the 0-based rank in its group, as ``name``.

    All rows are sorted in ranges, so that a group with a third of them lies in
    many tasks; counts for each range and group tell where ranks begin.
    """
    at, part = private(df, "_at"), private(df, "_part")
    rows = stash(df.orderBy(*group, *order).withColumn(at, F.monotonically_increasing_id()), "sorted")
    rows = rows.withColumn(part, F.shiftright(at, 33))
    count = rows.groupBy(*group, part).agg(F.count(F.lit(1)).alias("_in"), F.min(at).alias("_first"))
    before = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    before = before.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("_first") - F.coalesce(F.sum("_in").over(before), F.lit(0))
    start = stash(count.select(*[F.col(k).alias(f"_k_{k}") for k in [*group, part]], start.alias("_shift")), "starts")
    start = broadcast_small(start)
    cond = rows[part] == start[f"_k_{part}"]
    for k in group:
        cond = cond & rows[k].eqNullSafe(start[f"_k_{k}"])
    out = rows.join(start, cond).withColumn(name, F.col(at) - F.col("_shift"))
    return out.drop(at, part, "_shift", *[f"_k_{k}" for k in [*group, part]])
