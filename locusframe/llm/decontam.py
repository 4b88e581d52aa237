"""Benchmark decontamination by a prefix-filtered set join; DataFrame functions only.

Texts are folded (A-Z only) and cut into words of digits, letters a-z and all
characters from U+0080 on. A window is ten consecutive words of an item; an
item with fewer words, but not none, is one window.

A document holds a window only if it holds every word of it, so one necessary
token suffices as the prefix: the window's rarest word over all documents. The
join runs on these tokens. A hit at some place fixes where the window would
begin; that start must lie in the document with the whole window after it
(positional and length bounds). A document's starts are collected, and the words
there are compared with the windows' in one pass over its text.

Texts are cut by a pattern once and written with one space between words; words
never stand beside a list of them in an exploded row. Benchmark tables are
broadcast only if they are small in bytes.

Null text has no words; a null item_id counts as the empty string. Each row of
docs is a document of its own, also where ids are null or repeat. Empty tables
give no rows, or no hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import broadcast_small, numbered, private, stash

SIZE = 10
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Fixed pattern: what parts words after folding.
PARTS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def spaced(text: Column) -> Column:
    """The words of a text with one space between them. Pure ASCII takes the fast way to lower case."""
    text = F.coalesce(text, F.lit(""))
    low = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.trim(F.regexp_replace(low, PARTS, " "))


def words(spaced_text: Column) -> Column:
    return F.when(spaced_text == "", F.array().cast("array<string>")).otherwise(F.split(spaced_text, " "))


def written(rows: DataFrame, name: str, *more: str) -> DataFrame:
    """(row, spaced, n_words) of rows named by a column, as a table: texts are cut by the pattern here alone."""
    cut = rows.select(F.col(name).alias("row"), *more, spaced(F.col("text")).alias("spaced"))
    gaps = F.length("spaced") - F.length(F.replace(F.col("spaced"), F.lit(" "), F.lit("")))
    return stash(cut.withColumn("n_words", F.when(F.col("spaced") == "", 0).otherwise(gaps + 1)), "spaced")


def windows(benchmark: DataFrame, size: int = SIZE) -> tuple[DataFrame, DataFrame]:
    """(window_id, tokens, n), distinct windows, and (window_id, item_id), where they come from; written."""
    item = F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id")
    w = benchmark.select(item, words(spaced(F.col("text"))).alias("w")).where(F.size("w") > 0)
    last = F.greatest(F.size("w") - size, F.lit(0))
    cut = w.select("item_id", F.explode(F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(w.w, i + 1, size))).alias("tokens"))
    cut = stash(cut.select(F.sha2(F.concat_ws(" ", "tokens"), 256).alias("window_id"), "item_id", "tokens").distinct(), "cuts")
    win = cut.groupBy("window_id").agg(F.first("tokens").alias("tokens"))
    return stash(win.withColumn("n", F.size("tokens")), "windows"), cut.select("window_id", "item_id")


def occurrences(docs: DataFrame, win: DataFrame) -> DataFrame:
    """(row, start, n, window_id): each place where a document holds a window. docs: row, spaced, n_words; written."""
    token = stash(win.select("window_id", "n", F.posexplode("tokens").alias("offset", "token")), "tokens")
    vocabulary = broadcast_small(stash(token.select("token").distinct(), "vocabulary"))
    text = docs.where("spaced != ''")
    rarity = text.select(F.explode(F.split("spaced", " ")).alias("token")).join(vocabulary, "token").groupBy("token").count()
    order = Window.partitionBy("window_id").orderBy(F.coalesce("count", F.lit(0)), "token", "offset")
    prefix = token.join(rarity, "token", "left").withColumn("r", F.row_number().over(order)).where("r = 1")
    prefix = broadcast_small(stash(prefix.select("window_id", "n", "token", "offset"), "prefix"))
    hits = text.select("row", "n_words", F.posexplode(F.split("spaced", " ")).alias("pos", "token")).join(prefix, "token")
    start = F.col("pos") - F.col("offset")
    hits = hits.where((start >= 0) & (start + F.col("n") <= F.col("n_words"))).select("row", start.alias("start"), "n", "window_id")
    tried = stash(hits.groupBy("row").agg(F.collect_list(F.struct("start", "n", "window_id")).alias("tried")), "tried")
    both = text.select("row", "spaced").join(tried, "row")
    # The words are a lambda's variable, so that they are cut once a row, not once a start.
    held = lambda w, t: F.sha2(F.array_join(F.slice(w, t["start"] + 1, t["n"]), " "), 256)
    there = F.transform(F.array(F.split("spaced", " ")), lambda w: F.filter("tried", lambda t: held(w, t) == t["window_id"]))
    found = both.select("row", F.explode(F.get(there, F.lit(0))).alias("t"))
    return stash(found.select("row", "t.start", "t.n", "t.window_id"), "occurrences")


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = SIZE) -> DataFrame:
    """One row for each row of docs: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    rows, _ = numbered(docs.select("doc_id", "text"), "row")
    body = written(rows, "row", "doc_id")
    win, items_of = windows(benchmark, size)
    found = occurrences(body, win)
    place = F.explode(F.sequence("start", F.col("start") + F.col("n") - 1)).alias("place")
    hit = found.select("row", place).distinct().groupBy("row").agg(F.count(F.lit(1)).alias("n_hit"))
    items = found.select("row", "window_id").distinct().join(broadcast_small(items_of), "window_id").select("row", "item_id").distinct()
    items = items.groupBy("row").agg(F.array_sort(F.collect_list("item_id")).alias("items"))
    marks = hit.join(items, "row").withColumnRenamed("row", "_row")
    out = body.join(marks, body["row"] == marks["_row"], "left")
    listed = F.coalesce("items", F.array().cast("array<string>"))
    return out.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("n_words").cast("long").alias("n_words"),
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(listed).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", listed), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame, size: int = SIZE) -> DataFrame:
    """The rows of docs, all columns, that hold no window."""
    name, bad = private(docs, "_row"), private(docs, "_bad")
    rows, _ = numbered(docs, name)
    found = occurrences(written(rows, name), windows(benchmark, size)[0])
    found = found.select(F.col("row").alias(bad)).distinct()
    return rows.join(found, rows[name] == found[bad], "left_anti").drop(name)
