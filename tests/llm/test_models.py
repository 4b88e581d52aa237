"""HTML main text, language ID, shards, packing and the pipeline."""

import zlib

import numpy as np
import public_tokenizers
import pytest

from locusframe.llm import html, langid, packing, queries, shards

from .conftest import ODD

PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a = "<p>no</p>";</script></head><body>
<div class="cookie-banner"><p>We use cookies.</p><button>OK</button></div><header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a><li><a href=/n>News</a></ul></nav>
<main><article><h1>Title &amp; more</h1><p>First <b>bold</b>text, with
 space.<br>After.<p>Second paragraph, not closed &copy; 2020, that goes on for a while.<div class="ad">Buy this thing now.</div>
<ul><li>Point one, in the article.<li>Point two.</ul><aside class="sidebar"><h3>Related</h3><a href=/x>Link</a></aside></article>
<section class="comments"><h2>Comments</h2><div class="comment"><p>I disagree with all of this, honestly.</p></div></section>
<form class="newsletter"><p>Subscribe to us.</p><input></form></main><footer>&copy; Site</footer></body></html>"""


def test_page_with_everything():
    w, pair = html.model()
    assert html.main_texts([PAGE], w, pair) == [
        "Title & more First boldtext, with space. After. Second paragraph, not closed © 2020, that goes on for a while. Point one, in the article. Point two."
    ]


def test_held_out_layouts():
    w, pair = html.model()
    trees, labels = html.labelled_pages(200, seed=77)
    p, _ = html.Forest(trees).marginals(w, pair)
    y = np.concatenate([np.array(v) for v in labels])
    assert ((p > 0.5) == y).mean() > 0.99


def test_odd_pages(spark):
    rows = [(0, "u", None), (1, None, ""), (2, "u", "<"), (3, "u", "plain text only"), (4, "u", "<p>" * 3000 + "deep"), (5, "u", "</div></p>"), (6, "u", "<!-- open"), (6, "u", "<b>x"), (None, "u", "<div><span>a</span></div>"), (8, "u", "<div>" * 3000 + "deep")]
    got = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'t' as text", "1 as n_chars")).collect()
    assert len(got) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in got)
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_languages_held_out(spark, sf):
    pred = queries.op6_string_kernel(spark, "/root/testdata/sf0.01").toPandas().set_index("doc_id")
    lang = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").toPandas().set_index("doc_id")["lang"]
    held = pred[pred["held_out"]]
    assert (held["lang_pred"] == lang[held.index]).mean() > 0.98 and pred["score"].between(0, 1).all()
    assert [bool(v) for v in pred["held_out"]] == [zlib.crc32(str(i).encode()) % 4 == 2 for i in pred.index]


def test_languages_of_odd_texts(docs_of):
    texts = [*ODD, "12 34 ?!", "€ 5", *["the cat and the dog of this house"] * 20, *["der hund und die katze von dem haus"] * 20]
    lang = [None] * (len(ODD) + 2) + ["en"] * 20 + ["de"] * 20
    got = {r["doc_id"]: r for r in langid.identify(docs_of(texts, lang=lang)).collect()}
    assert all(got[i]["lang_pred"] == lang[i] for i in range(len(ODD) + 2, len(texts)))
    for i in (0, 1, 2, len(ODD), len(ODD) + 1):
        assert got[i]["lang_pred"] == "und" and got[i]["score"] == 0
    assert {r["lang_pred"] for r in langid.identify(docs_of(["a", "b"])).collect()} == {"und"}
    assert langid.identify(docs_of([])).count() == 0


def test_shards_mix_sources(docs_of):
    n = 1200
    source = ["big" if i % 3 else f"s{i % 5}" if i % 2 else None for i in range(n)]
    rows = shards.interleave(docs_of([f"text {i % 50}" for i in range(n)], source=source), shards=10).toPandas()
    assert rows.groupby("shard").size().tolist() == [120] * 10
    big = rows[rows["source"] == "big"].groupby("shard").size()
    assert big.max() - big.min() <= 2
    assert all(sorted(g["slot"]) == list(range(len(g))) for _, g in rows.groupby("shard"))
    assert rows["text_crc32"].tolist() == [zlib.crc32(f"text {i % 50}".encode()) for i in rows["doc_id"]]


def test_shards_of_few_rows(spark, odd, docs_of, tmp_path):
    got = shards.interleave(odd.unionByName(odd)).toPandas()
    sizes = got.groupby("shard").size()
    assert len(got) == 2 * len(ODD) and sizes.max() - sizes.min() <= 1
    assert shards.interleave(docs_of([])).count() == 0
    shards.write_shards(odd, str(tmp_path / "out"), 3)
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(ODD)


TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def token_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENIZER)
    return [t.encode(x or "", add_special_tokens=False).ids + [0] for x in texts]


def test_packing_of_odd_texts(docs_of):
    texts = [*ODD, "don't we'll ''s 'tis <|endoftext|> x", "ŉ İ ſ ½ ²", "it’s “quoted” – dash…", "́ mark", *[f"some words {i} " * (i % 40) for i in range(120)]]
    docs = docs_of(texts)
    rows = packing.pack(docs, TOKENIZER, 64).toPandas().sort_values(["doc_id", "piece"])
    want = token_ids(texts)
    for d, g in rows.groupby("doc_id"):
        at = 0
        for r in g.itertuples():
            part = want[d][at : at + r.length]
            assert r.start == at and r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
            at += r.length
        assert at == len(want[d]) and set(g["length"][:-1]) <= {64}
    bins = rows.sort_values(["sequence_id", "offset"]).groupby("sequence_id")
    assert all((g["offset"] == g["length"].cumsum() - g["length"]).all() and g["length"].sum() <= 64 for _, g in bins)
    assert len(bins) <= -(-rows["length"].sum() // 64) * 1.05 + 1
    got = {r["sequence_id"]: r["ids"] for r in packing.sequences(docs, TOKENIZER, 64).collect()}
    for s, g in bins:
        assert got[s] == [i for r in g.itertuples() for i in want[r.doc_id][r.start : r.start + r.length]]
    assert packing.pack(docs_of([]), TOKENIZER).count() == 0
    twice = packing.pack(docs.unionByName(docs), TOKENIZER, 64).toPandas()
    assert len(twice) == 2 * len(rows) and not twice.duplicated(["sequence_id", "offset"]).any()


def test_two_fit_replaces_the_smallest():
    """Greedy fills 6 + 3, gap 1; 2 + 2 fits the gap of 4 better than 3."""
    bins = packing.best_two_fit({6: 1, 3: 1, 2: 2}, 10)
    assert [b.lengths for b in bins] == [[6, 2, 2], [3]]


@pytest.mark.parametrize("seed", range(5))
def test_plans_use_every_piece(seed):
    rng = np.random.default_rng(seed)
    counts = {int(n): int(c) for n, c in zip(rng.integers(1, 101, 30), rng.integers(1, 400, 30), strict=True)}
    bins = packing.best_two_fit(counts, 100)
    used: dict[int, int] = {}
    for b in bins:
        assert sum(b.lengths) <= 100
        for n in b.lengths:
            used[n] = used.get(n, 0) + b.times
    assert used == counts
    assert sum(b.times for b in bins) <= sum(n * c for n, c in counts.items()) / 100 * 1.15 + 2
