"""Quality rules, licence scans, decontamination and URL lists: odd inputs and plain Python."""

import datetime as dt
import hashlib
import re

import duckdb
import pandas as pd
import pytest

from locusframe.llm import decontam, licenses, quality, queries, shared, urlfilter

from .conftest import ODD

TABLES = "documents pages benchmark labels".split()


def same(a: pd.DataFrame, b: pd.DataFrame) -> bool:
    def f(v):
        if v is None or v is pd.NA or (isinstance(v, float) and v != v):
            return None
        return round(v, 6) if isinstance(v, float) else v.isoformat()[:10] if hasattr(v, "isoformat") else v

    rows = [sorted(repr([f(v) for v in r]) for r in d[sorted(d.columns)].astype(object).itertuples(index=False, name=None)) for d in (a, b)]
    return sorted(a.columns) == sorted(b.columns) and rows[0] == rows[1]


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_queries_match_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    assert same(queries.queries()[name](spark, sf).toPandas(), con.execute(queries.oracle_sql()[name]).df())


@pytest.mark.parametrize("name", ["op1_quality_rules", "op8_prefix_decontam", "op2_license_scan"])
def test_odd_documents_match_sql(spark, odd, tmp_path, name):
    odd.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "word word"), (2, None), (3, ""), (4, "a b c d"), (5, "A B!")], "item_id long, text string").coalesce(1).write.parquet(str(tmp_path / "benchmark.parquet"))
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    assert same(queries.queries()[name](spark, str(tmp_path)).toPandas(), con.execute(queries.oracle_sql()[name]).df())


def test_lines_first(docs_of):
    good = " ".join(f"word{i} goes on" for i in range(60)) + "."
    noise = "Home | News | About | Contact | Search | Help | Login | More"
    docs = docs_of([good, "\n".join([good, noise]), "\n".join([noise] * 40), "buy!!! now!!! " * 60, good + "\nClick here for all rights reserved."])
    got = {r["doc_id"]: r for r in quality.quality_rules(docs).collect()}
    assert [got[i]["kept"] for i in range(5)] == [True, True, False, False, True]
    assert got[4]["n_bad_lines"] == 1
    clean = {r["doc_id"]: r for r in quality.clean_documents(docs).collect()}
    assert set(clean) == {0, 1, 4} and all(r["n_chars"] == len(r["text"]) for r in clean.values())
    assert clean[0]["text"] == good and noise not in clean[1]["text"] and clean[4]["text"].rstrip("\n") == good


def test_empty_tables(spark, docs_of):
    e = docs_of([])
    b = spark.createDataFrame([], "item_id long, text string")
    assert quality.quality_rules(e).count() == 0 and decontam.contamination(e, b).count() == 0 and licenses.scan_licenses(e).count() == 0
    one = docs_of(["some text"])
    assert not decontam.contamination(one, b).first()["contaminated"]


def test_decontamination_against_plain_python(spark, docs_of):
    import random

    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(25)]
    items = [" ".join(rng.choices(vocabulary, k=rng.choice([3, 9, 10, 14]))) for _ in range(12)] + ["w1 w1 w1 w1 w1 w1 w1 w1 w1 w1 w1"]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randint(0, 60))) for _ in range(40)]
    for i in range(0, 40, 3):
        texts[i] += ", " + rng.choice(items).upper() + "! w2"
    texts += ["w1 " * 30]
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(items)], "item_id long, text string")
    got = {r["doc_id"]: r for r in decontam.contamination(docs_of(texts), bench).collect()}
    wide = {r["doc_id"]: r for r in _without_broadcast(docs_of(texts), bench)}
    cut = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", t.lower())
    for d, t in enumerate(texts):
        w, hit, found = cut(t), set(), set()
        for i, item in enumerate(items):
            v = cut(item)
            for win in [v[k : k + 10] for k in range(max(1, len(v) - 9))] if v else []:
                for s in range(len(w) - len(win) + 1):
                    if w[s : s + len(win)] == win:
                        hit.update(range(s, s + len(win)))
                        found.add(str(i))
        want = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
        for r in (got[d], wide[d]):
            assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) == want


def _without_broadcast(docs, bench):
    limit, shared.BROADCAST_BYTES = shared.BROADCAST_BYTES, -1
    try:
        return decontam.contamination(docs, bench).collect()
    finally:
        shared.BROADCAST_BYTES = limit


def test_repeated_rows_and_clashing_columns(spark, docs_of):
    docs = docs_of(["a b c d e f g h i j k", "other"]).selectExpr("*", "'x' as body", "1 as key", "2 as shard", "3 as rank", "'y' as words", "4 as n", "5 as label")
    docs = docs.unionByName(docs)
    bench = spark.createDataFrame([(7, "a b c d e f g h i j")], "item_id long, text string")
    assert sorted(r["n_hit"] for r in decontam.contamination(docs, bench).collect()) == [0, 0, 10, 10]
    kept = decontam.clean_documents(docs, bench)
    assert kept.columns == docs.columns and kept.count() == 2
    assert quality.quality_rules(docs).count() == 4 and quality.clean_documents(docs).columns == docs.columns


def test_licences(docs_of):
    docs = docs_of(["Text here.\nReleased under the MIT License.", "Licensed under the Apache License, Version 2.0", None, "nothing of the kind", "released\tunder THE  mit licence!"])
    got = {r["doc_id"]: (r["licence"], r["line"]) for r in licenses.scan_licenses(docs, 0.6).collect()}
    assert got[0] == ("MIT", 2) and got[1] == ("Apache-2.0", 0) and got[2] == got[3] == (None, -1)


def test_licences_across_and_inside_lines(docs_of):
    import textwrap

    from locusframe.llm.licence_texts import BODIES, OPENINGS

    body = dict(reversed(BODIES))
    prose = "\n".join(f"A line of prose {i} about rivers and hills." for i in range(30))
    inside = lambda t, width=60: f"{prose}\n{textwrap.fill(t, width)}\n{prose}"
    names = ["MIT", "BSD-3-Clause", "BSD-2-Clause", "ISC", "Apache-2.0", "GPL-3.0", "AGPL-3.0", "GPL-2.0", "LGPL-2.1"]
    texts = [inside(body[n]) for n in names] + [inside(t) for _, t in OPENINGS]
    edited = body["MIT"].replace("AUTHORS", "WRITERS").replace("THE SOFTWARE IS", "THIS PROGRAM IS")
    texts += [inside(edited), "We say: it is released under the MIT License. And so on.", "rivers\n" + body["MIT"][: len(body["MIT"]) // 5], prose]
    got = {r["doc_id"]: r for r in licenses.scan_licenses(docs_of(texts)).collect()}
    want = names + [a for a, _ in OPENINGS] + ["MIT", "MIT"]
    assert [got[i]["licence"] for i in range(len(want))] == want
    assert [got[i]["line"] for i in range(len(want))] == [31] * (len(want) - 1) + [1] and all(got[i]["n_units"] >= 1 for i in range(len(want)))
    assert got[0]["dice"] == 1 and 0.9 <= got[len(want) - 2]["dice"] < 1
    assert [(got[i]["licence"], got[i]["line"]) for i in (len(want), len(want) + 1)] == [(None, -1)] * 2


def test_url_lists(spark):
    day = lambda n: dt.date(2024, 1, n)
    history = spark.createDataFrame(
        [("a", "bad.org", "add", day(5)), ("a", "bad.org", "remove", day(10)), ("b", "x.net/private", "add", day(1)), ("b", "both.com", "add", day(3)), ("b", "both.com", "remove", day(3)), ("b", None, "add", day(1))],
        "list_name string, entry string, action string, since date",
    )
    rows = [
        (1, "https://www.Bad.org/p", day(4), False), (2, "https://www.bad.org:8080/p", day(5), True), (3, "http://bad.org", day(9), True), (4, "http://bad.org", day(10), False),
        (5, "http://notbad.org/", day(6), False), (6, "http://x.net/private/a?q=1", day(2), True), (7, "http://x.net/privateer", day(2), False), (8, "http://u:p@x.net/private#t", day(2), True),
        (9, "http://both.com", day(4), False), (10, None, day(4), False), (11, "no url", day(4), False), (12, "http://bad.org", None, False), (2, "https://www.bad.org:8080/p", day(5), True),
    ]
    caps = spark.createDataFrame([r[:3] for r in rows], "page_id long, url string, fetched date").selectExpr("*", "'z' as _id2", "1 as n", "2 as best", "3 as since")
    got = urlfilter.filter_captures(caps, history, "page_id", "url", "fetched")
    assert sorted((r["page_id"], r["blocked"]) for r in got.collect()) == sorted((r[0], r[3]) for r in rows)


def test_words_of_odd_texts(odd):
    got = {r["doc_id"]: r["n_words"] for r in quality.quality_rules(odd).collect()}
    assert got == {i: len(re.findall("[^\x20\x09-\x0d]+", t or "")) for i, t in enumerate(ODD)}


def test_long_lines_and_words_are_compared_as_such(docs_of):
    from .test_dedup import TWINS

    lines = [f"{a} and this is a line of its own." for a in TWINS]
    text = "\n".join([*lines, lines[0]])
    words = " ".join(f"{a} b c" for a in TWINS)
    got = {r["doc_id"]: r for r in quality.quality_rules(docs_of([text, words, words + " " + words])).collect()}
    assert [got[i]["n_dup_lines"] for i in range(3)] == [1, 0, 0]
    assert [got[i]["n_repeat_words"] for i in range(3)] == [26, 0, 12]


def test_repeated_ids_keep_their_own_rows(spark):
    item = "one two three four five six seven eight nine ten eleven"
    rows = [(5, item + " and more"), (5, "single"), (5, "other words " * 20), (None, item), (None, "x y"), (7, item), (7, item)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as row", "'s' as spaced", "2 as _row")
    bench = spark.createDataFrame([(1, item), (2, None), (None, "x y")], "item_id long, text string")
    got = sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) for r in decontam.contamination(docs, bench).collect())
    assert got == sorted([("5", 13, 11, 1, True), ("5", 1, 0, 0, False), ("5", 40, 0, 0, False), ("None", 11, 11, 1, True), ("None", 2, 2, 1, True), ("7", 11, 11, 1, True), ("7", 11, 11, 1, True)])
    clean = decontam.clean_documents(docs, bench)
    assert clean.columns == docs.columns and sorted(r["text"] for r in clean.collect()) == ["other words " * 20, "single"]
    rows = [(1, "Released under the MIT License."), (1, "nothing of that kind"), (None, "Licensed under CC BY-NC 4.0."), (None, "no")]
    found = licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r["doc_id"]), str(r["licence"])) for r in found) == [("1", "MIT"), ("1", "None"), ("None", "CC-BY-NC-4.0"), ("None", "None")]


def test_long_lists_are_joined_under_salts(spark, monkeypatch):
    captures = spark.createDataFrame([(i, f"http://h{i % 3}.example.com/a/{i % 5}", dt.date(2024, 1 + i % 12, 1)) for i in range(200)] + [(None, None, None), (7, "not a url", dt.date(2024, 1, 1))], "page_id long, url string, fetched date")
    history = spark.createDataFrame([("a", "com", "add", dt.date(2024, 3, 1)), ("b", "h1.example.com", "add", dt.date(2024, 5, 1)), ("b", "h1.example.com", "remove", dt.date(2024, 8, 1)), ("c", "h2.example.com/a/4", "add", dt.date(2023, 1, 1))], "list_name string, entry string, action string, since date")
    run = lambda: sorted(map(str, urlfilter.filter_captures(captures, history, "page_id", "url", "fetched").collect()))
    small = run()
    monkeypatch.setattr(shared, "BROADCAST_BYTES", -1)
    assert run() == small and len(small) == 202
    none = urlfilter.filter_captures(captures.limit(0), history, "page_id", "url", "fetched")
    assert none.count() == 0 and urlfilter.filter_captures(captures, history.limit(0), "page_id", "url", "fetched").where("blocked").count() == 0
