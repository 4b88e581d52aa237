"""The queries opN_<name> over whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality_rules

    return quality_rules(table(spark, sf_dir, "documents"))


def _op1_sql() -> str:
    from .quality import CLOSING, PHRASES, SEPARATORS

    quote = lambda x: "'" + x.replace("'", "''") + "'"
    lower = "translate(l, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    said = " OR ".join(f"contains({lower}, {quote(p)})" for p in PHRASES)
    seps = ", ".join(map(quote, SEPARATORS))
    closing = ", ".join(map(quote, CLOSING))
    word = r"'[^\x20\x09-\x0D]+'"
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), {word}) AS w FROM documents),
lines AS (
  SELECT doc_id, i, l, regexp_extract_all(l, {word}) AS w FROM (
    SELECT doc_id, unnest(string_split(t, chr(10))) AS l, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM d)),
judged AS (
  SELECT doc_id, l, i, CAST(list_sum(list_transform(w, lambda x: length(x))) AS BIGINT) AS chars, len(w) AS n,
    length(l) - length(regexp_replace(l, '[#*$%&|<>]', '', 'g')) AS syms,
    length(l) - length(replace(l, '!', '')) AS bangs,
    len(list_filter(w, lambda x: x IN ({seps}))) AS seps,
    right(w[-1], 1) IN ({closing}) AS closed, ({said}) AS said
  FROM lines WHERE len(w) > 0),
verdicts AS (
  SELECT doc_id, l, chars, row_number() OVER (PARTITION BY doc_id, l ORDER BY i) > 1 AS again,
    (10 * syms > chars OR 3 * bangs > n OR (seps > 0 AND 4 * seps >= n) OR (n <= 5 AND NOT closed) OR (n <= 25 AND said)) AS bad
  FROM judged),
line_sums AS (
  SELECT doc_id, count(*) FILTER (WHERE again) AS n_dup_lines, count(*) AS n_lines, count(*) FILTER (WHERE bad) AS n_bad_lines,
    coalesce(sum(chars) FILTER (WHERE bad), 0) AS lost_chars FROM verdicts GROUP BY doc_id),
tri AS (
  SELECT doc_id, p, w[p] || ' ' || w[p + 1] || ' ' || w[p + 2] AS g FROM (
    SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS p FROM d)),
again AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, g) AS c FROM tri) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT q) AS n_repeat_words FROM (SELECT doc_id, unnest([p, p + 1, p + 2]) AS q FROM again) GROUP BY doc_id),
f AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words,
    CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines,
    coalesce(n_bad_lines, 0) AS n_bad_lines, CAST(coalesce(lost_chars, 0) AS BIGINT) AS lost_chars
  FROM d LEFT JOIN line_sums USING (doc_id) LEFT JOIN rep USING (doc_id))
SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 2 * lost_chars <= word_chars AS kept FROM f
"""


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scan_licenses

    return scan_licenses(table(spark, sf_dir, "documents"))


def _op2_sql() -> str:
    from .licenses import TEMPLATES, THRESHOLD

    rows = ", ".join("({}, '{}', '{}')".format(i, a, b.replace("'", "''")) for i, (a, b) in enumerate(TEMPLATES))
    cut = r"list_filter(regexp_split_to_array(lower({}), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
    pairs = "list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"
    return f"""
WITH t AS (SELECT template, licence, {pairs} AS g FROM (SELECT *, {cut.format("body")} AS w FROM (VALUES {rows}) v(template, licence, body))),
lines AS (
  SELECT doc_id, 0 AS line, coalesce(text, '') AS u FROM documents
  UNION ALL
  SELECT doc_id, unnest(range(1, len(l) + 1)) AS line, unnest(l) AS u FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents) WHERE len(l) > 1),
units AS (SELECT doc_id, line, {pairs} AS g FROM (SELECT doc_id, line, {cut.format("u")} AS w FROM lines)),
near AS (SELECT doc_id, line, template, licence, u.g AS a, t.g AS b FROM units u JOIN t
  ON len(u.g) * (2 - {THRESHOLD}) >= {THRESHOLD} * len(t.g) - 0.001 AND len(u.g) * {THRESHOLD} <= (2 - {THRESHOLD}) * len(t.g) + 0.001),
d AS (SELECT doc_id, line, template, licence, 2 * len(list_intersect(a, b))::DOUBLE / (len(a) + len(b)) AS dice FROM near),
hit AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY dice DESC, line, template) AS r FROM d WHERE dice >= {THRESHOLD}),
per AS (SELECT doc_id, count(DISTINCT line) AS n_units, max(licence) FILTER (WHERE r = 1) AS licence,
  round(max(dice) FILTER (WHERE r = 1), 9) AS dice, CAST(max(line) FILTER (WHERE r = 1) AS BIGINT) AS line FROM hit GROUP BY doc_id)
SELECT doc_id, coalesce(n_units, 0) AS n_units, licence, dice, coalesce(line, -1) AS line FROM documents LEFT JOIN per USING (doc_id)
"""


def op3_html_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html import extract

    return extract(table(spark, sf_dir, "pages"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix import repeated_passages

    return repeated_passages(table(spark, sf_dir, "documents"))


_OP4_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, length(hex(encode(coalesce(text, '')))) // 2 AS n FROM documents),
w AS (SELECT doc_id, p, md5(substr(x, CAST(2 * p + 1 AS BIGINT), 200)) AS h FROM (SELECT doc_id, x, unnest(range(n - 99)) AS p FROM d WHERE n >= 100)),
again AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY h ORDER BY doc_id, p) AS k FROM w) WHERE k > 1),
mark AS (SELECT doc_id, p, CASE WHEN p > lag(p) OVER o + 100 OR lag(p) OVER o IS NULL THEN 1 ELSE 0 END AS new FROM again WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
island AS (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM mark),
span AS (SELECT doc_id, k, min(p) AS a, max(p) + 100 AS b FROM island GROUP BY 1, 2),
cut AS (SELECT doc_id, a, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM span),
kept AS (SELECT doc_id, string_agg(substr(x, CAST(2 * before + 1 AS BIGINT), CAST(2 * (a - before) AS BIGINT)), '' ORDER BY a) AS y FROM cut JOIN d USING (doc_id) GROUP BY 1),
per AS (SELECT doc_id, CAST(sum(b - a) AS BIGINT) AS gone, count(*) AS spans, max(b) AS last FROM span GROUP BY 1)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, coalesce(gone, 0) AS n_removed, coalesce(spans, 0) AS n_spans,
  sha256(unhex(CASE WHEN gone IS NULL THEN x ELSE y || substr(x, CAST(2 * last + 1 AS BIGINT)) END)) AS kept_sha256
FROM d LEFT JOIN per USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


def op5_interleaved_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .shards import interleave

    return interleave(table(spark, sf_dir, "documents"))


_OP5_SQL = """
WITH RECURSIVE bits AS (
  SELECT i AS b, CAST(i AS BIGINT) AS c, 0 AS k FROM range(256) t(i)
  UNION ALL SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY b) AS tbl FROM bits WHERE k = 8),
d AS (SELECT doc_id, source, hex(encode(coalesce(text, ''))) AS x, md5('interleave-1:' || coalesce(text, '')) AS h FROM documents),
r AS (SELECT doc_id, source, h, CAST(length(x) // 2 + 8 AS BIGINT) AS size,
    xor(list_reduce(list_transform(range(length(x) // 2), lambda i: CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT)),
      lambda c, b: xor(c >> 8, tbl[(xor(c, b) & 255) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) AS text_crc32 FROM d, crc),
f AS (SELECT *, (row_number() OVER (PARTITION BY source ORDER BY h, doc_id NULLS FIRST, size, text_crc32) - 0.5::DOUBLE) / count(*) OVER (PARTITION BY source) AS fr FROM r),
p AS (SELECT *, row_number() OVER (ORDER BY fr, source NULLS FIRST, doc_id NULLS FIRST, size, text_crc32) - 1 AS pos, count(*) OVER () AS n FROM f)
SELECT doc_id, source, size, text_crc32, 'rows' AS law, CAST(pos * 24 // n AS INTEGER) AS shard,
  pos - ((pos * 24 // n) * n + 23) // 24 AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM p
"""


def op6_string_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import identify

    return identify(table(spark, sf_dir, "documents"))


def op7_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_prefix_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontam import contamination

    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_OP8_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, w[i:i + 9] AS t FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
pos AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d),
occ AS (SELECT doc_id, p, len(t) AS n, item_id FROM (SELECT doc_id, p, w, w[p] AS x FROM pos) JOIN (SELECT item_id, t, t[1] AS x FROM win) USING (x)
    WHERE w[p:p + len(t) - 1] = t),
hit AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM occ) GROUP BY doc_id),
items AS (SELECT doc_id, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS items FROM occ GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, CAST(coalesce(len(items), 0) AS BIGINT) AS n_items,
  sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def op9_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neardup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


_OP9_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))
  WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w),
cls AS (SELECT doc_id, s, len(s) AS n, CASE WHEN len(s) = 0 THEN doc_id ELSE min(doc_id) OVER (PARTITION BY array_to_string(list_sort(s), '|')) END AS class_id FROM sets),
g AS (SELECT doc_id, n, unnest(s) AS g FROM cls WHERE doc_id = class_id),
joint AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c FROM g a JOIN g b USING (g) WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM joint WHERE 100 * c >= 75 * (na + nb - c)),
e AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach(root, v) AS (SELECT doc_id, doc_id FROM cls WHERE doc_id = class_id UNION SELECT root, e.b FROM reach JOIN e ON v = e.a),
comp AS (SELECT v, min(root) AS component_id FROM reach GROUP BY v)
SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, class_id, component_id, doc_id = component_id AS kept FROM cls JOIN comp ON v = class_id
"""

#: A blocklist's history for the query: list, entry, action, day since. Pages carry no fetch time, so
#: the query takes 2024-01-01 plus page_id modulo 731 days.
HISTORY = (
    ("spam", "spam-farm.example.org", "add", "2024-02-01"),
    ("spam", "spam-farm.example.org", "remove", "2024-09-15"),
    ("spam", "spam-farm.example.org", "add", "2025-03-01"),
    ("tracking", "example.net", "add", "2024-06-01"),
    ("tracking", "example.net", "remove", "2024-08-01"),
    ("tracking", "blog.tiontion.example.com", "add", "2024-01-10"),
    ("adult", "m.ththth.example.net", "add", "2024-03-05"),
    ("adult", "m.ththth.example.net", "add", "2024-12-24"),
    ("adult", "ththre.example.com/fr", "add", "2024-01-01"),
    ("adult", "ththre.example.com/fr", "remove", "2025-10-01"),
    ("region", "blog.ththan.example.net/en", "add", "2024-07-07"),
    ("region", "therha.example.com", "remove", "2024-05-05"),
    ("region", "therha.example.com", "add", "2025-05-05"),
)


def op10_url_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .urlfilter import filter_captures

    history = spark.createDataFrame(list(HISTORY), "list_name string, entry string, action string, since string")
    history = history.withColumn("since", F.col("since").cast("date"))
    fetched = F.date_add(F.lit("2024-01-01").cast("date"), F.pmod("page_id", F.lit(731)).cast("int"))
    pages = table(spark, sf_dir, "pages").select("page_id", "url", fetched.alias("fetched"))
    return filter_captures(pages, history, "page_id", "url", "fetched")


def _op10_sql() -> str:
    rows = ", ".join(f"('{a}', '{b}', '{c}', DATE '{d}')" for a, b, c, d in HISTORY)
    return rf"""
WITH h AS (SELECT *, lead(since) OVER (PARTITION BY list_name, entry ORDER BY since) AS till FROM (VALUES {rows}) v(list_name, entry, action, since)),
p AS (SELECT page_id, url, CAST(DATE '2024-01-01' + CAST(page_id % 731 AS INTEGER) AS DATE) AS fetched,
  lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)', 1)) AS host,
  lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)) AS path FROM pages),
m AS (SELECT page_id, list_name, entry, row_number() OVER (PARTITION BY page_id ORDER BY length(entry) DESC, entry DESC, list_name DESC) AS r
  FROM p JOIN h ON action = 'add' AND fetched >= since AND (till IS NULL OR fetched < till) AND (
    host = entry OR ends_with(host, '.' || entry) OR (contains(entry, '/') AND starts_with(host || path || '/', entry || '/')))),
g AS (SELECT page_id, count(*) AS n, max(entry) FILTER (WHERE r = 1) AS entry, max(list_name) FILTER (WHERE r = 1) AS list_name FROM m GROUP BY page_id)
SELECT p.page_id, url, fetched, host, g.n IS NOT NULL AS blocked, coalesce(g.n, 0) AS n_active, entry, list_name FROM p LEFT JOIN g USING (page_id)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op") and k[2].isdigit() and callable(v)}


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_rules": _op1_sql(), "op2_license_scan": _op2_sql(), "op10_url_asof": _op10_sql(), "op4_suffix_dedup": _OP4_SQL, "op5_interleaved_shards": _OP5_SQL, "op9_hyperminhash": _OP9_SQL, "op8_prefix_decontam": _OP8_SQL}
