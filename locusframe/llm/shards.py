"""Proportional stratified interleaving into shards; DataFrame functions only.

Rows are shuffled within their source by a seeded hash of their texts and
ranked; a row's fractional rank is (rank + 1/2) / rows of its source. All rows
are put in the order of fractional ranks and cut into runs whose counts differ
by one at most, so every shard has each source in the proportion of the whole.

Equal texts have equal hashes, so copies stand side by side in their source's
order, and in about the same place of every source's: a group of copies lies in
one shard unless a cut meets it. Law ``rows`` lets counts differ by one at most,
so a group larger than a shard cannot stay whole.

Ranks come from sorts in ranges with counts of each range, so a source or a
text with a third of all rows is no hot task. Texts are not shuffled.

Null source is a source of its own; null text is empty. Repeated rows are
separate rows; equal hashes fall back on doc_id (null first), size and checksum.
An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import broadcast_small, ranked, stash

SHARDS = 24
SEED = "interleave-1"


def interleave(docs: DataFrame, shards: int = SHARDS, seed: str = SEED) -> DataFrame:
    """doc_id, source, size, text_crc32, law, shard, slot, grown_shard: one row for each row of docs."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        "source",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.md5(F.concat(F.lit(f"{seed}:"), text).cast("binary")).alias("h"),
    )
    rows = stash(rows, "rows")
    sizes = stash(rows.groupBy(F.col("source").alias("s")).agg(F.count(F.lit(1)).alias("n")), "sources")
    total = sizes.agg(F.sum("n")).first()[0] or 1
    ties = [F.col(c) for c in ("doc_id", "size", "text_crc32")]
    r = ranked(rows, ["source"], [F.col("h"), *ties], "rank")
    r = r.join(broadcast_small(sizes), F.col("source").eqNullSafe(F.col("s"))).drop("s", "h")
    r = r.withColumn("at", (F.col("rank") + 0.5) / F.col("n"))
    r = ranked(r, [], [F.col("at"), F.col("source").asc_nulls_first(), *ties], "pos")
    shard = F.expr(f"pos * {shards} div {total}")
    return r.select(
        "doc_id", "source", "size", "text_crc32", F.lit("rows").alias("law"), shard.cast("int").alias("shard"), "pos"
    ).select(
        "doc_id", "source", "size", "text_crc32", "law", "shard",
        (F.col("pos") - F.expr(f"(cast(shard as bigint) * {total} + {shards - 1}) div {shards}")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, seed: str = SEED) -> None:
    """The rows of docs as folders shard=0, 1, ... in slot order; doc_id must be unique."""
    at = interleave(docs, shards, seed).select(F.col("doc_id").alias("_id"), "shard", "slot")
    rest = [docs[c] for c in docs.columns if c not in ("shard", "slot")]
    rows = docs.join(at, docs["doc_id"] == at["_id"]).select(*rest, at["shard"], at["slot"])
    rows.repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
