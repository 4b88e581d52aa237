"""URL filters with dated lists; DataFrame functions only.

A list's history holds (list_name, entry, action, since): an entry is a domain
(it holds for the host and all below it) or host/path segments (it holds for
every URL below that path); action is ``add`` or ``remove``. Consecutive events of an entry
become validity intervals. Each capture is looked up under its host's suffixes
and its path's prefixes, among the entries that were active when it was
fetched: the state as of the last event at or before the fetch.

Null or unparsable URLs and null fetch times match nothing. Several events of
an entry at one time: ``remove`` wins. One row comes out for each row in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import broadcast_small, stash

#: Lists too large for a broadcast are joined under so many salts, as many captures share a suffix.
SALTS = 32
#: Columns that are added; captures' own columns of these names are replaced.
OUTPUT = ("host", "blocked", "n_active", "entry", "list_name")
# Fixed patterns of a URL's host and path.
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)"
PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"


def host(url: Column) -> Column:
    """Lower-case host without a closing dot; empty if there is none."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, HOST, 1)), r"\.$", "")


def intervals(history: DataFrame) -> DataFrame:
    """(list_name, entry, since, until): when each entry was active; until is null for still active ones."""
    h = history.select("list_name", F.lower("entry").alias("entry"), "action", "since").where("entry is not null and since is not null")
    one = h.groupBy("list_name", "entry", "since").agg(F.max("action").alias("action"))
    until = F.lead("since").over(Window.partitionBy("list_name", "entry").orderBy("since"))
    return one.withColumn("until", until).where("action = 'add'").select("list_name", "entry", "since", "until")


def keys(url: Column) -> Column:
    """All entries that would hold for a URL."""
    labels = F.split(host(url), r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    parts = F.array_remove(F.split(F.lower(F.regexp_extract(url, PATH, 1)), "/"), "")
    below = F.when(
        F.size(parts) > 0,
        F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat(host(url), F.lit("/"), F.array_join(F.slice(parts, 1, i), "/"))),
    ).otherwise(F.array().cast("array<string>"))
    return F.when(F.length(host(url)) > 0, F.array_distinct(F.concat(suffixes, below))).otherwise(F.array().cast("array<string>"))


def filter_captures(captures: DataFrame, history: DataFrame, id_col: str, url_col: str, time_col: str) -> DataFrame:
    """The captures with host, blocked, n_active, entry and list_name (of the longest active entry)."""
    active = stash(intervals(history), "intervals")
    small = broadcast_small(active)
    rows = captures.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), F.col(time_col).alias("_at")).distinct()
    asked = rows.select("_id", "_url", "_at", F.explode(keys(F.col("_url"))).alias("entry"))
    if small is active:
        asked = asked.withColumn("salt", F.pmod(F.xxhash64("_id", "_url", "_at"), F.lit(SALTS)))
        found = asked.join(active.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))), ["entry", "salt"])
    else:
        found = asked.join(small, "entry")
    found = found.where((F.col("_at") >= F.col("since")) & (F.col("until").isNull() | (F.col("_at") < F.col("until"))))
    best = F.max(F.struct(F.length("entry").alias("n"), "entry", "list_name"))
    per = found.groupBy("_id", "_url", "_at").agg(F.count(F.lit(1)).alias("n"), best.alias("best"))
    on = captures[id_col].eqNullSafe(per["_id"]) & captures[url_col].eqNullSafe(per["_url"]) & captures[time_col].eqNullSafe(per["_at"])
    return captures.join(per, on, "left").select(
        *[captures[c] for c in captures.columns if c not in OUTPUT],
        F.coalesce(host(captures[url_col]), F.lit("")).alias("host"),
        per["n"].isNotNull().alias("blocked"),
        F.coalesce(per["n"], F.lit(0)).alias("n_active"),
        per["best"]["entry"].alias("entry"),
        per["best"]["list_name"].alias("list_name"),
    )
