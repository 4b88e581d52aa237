"""The pipeline against the same stages in plain Python."""

import re

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from locusframe.llm import packing  # noqa: E402

from .test_dedup import components, remove  # noqa: E402
from .test_models import TOKENIZER, token_ids  # noqa: E402


def cleaned(text):
    """Lines that fail go, each with its line feed."""
    from locusframe.llm.quality import CLOSING, PHRASES, SEPARATORS

    def fails(line):
        w = re.findall("[^\x20\x09-\x0d]+", line)
        if not w:
            return False
        low = re.sub("[A-Z]", lambda m: m[0].lower(), line)
        seps = sum(x in SEPARATORS for x in w)
        return (
            10 * len(re.findall(r"[#*$%&|<>]", line)) > sum(map(len, w))
            or 3 * line.count("!") > len(w)
            or (seps > 0 and 4 * seps >= len(w))
            or (len(w) <= 5 and w[-1][-1] not in CLOSING)
            or (len(w) <= 25 and any(p in low for p in PHRASES))
        )

    return "".join(line for line in re.findall("[^\n]*\n|[^\n]+", text) if not fails(line.rstrip("\n")))


def plain(spark, sf):
    from locusframe.llm import quality

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {r["doc_id"] for r in quality.quality_rules(docs).where("kept").collect()}
    text = {r["doc_id"]: cleaned(r["text"]) for r in docs.orderBy("doc_id").collect() if r["doc_id"] in kept}
    ids = sorted(text)
    comp = components([text[i] for i in ids])
    ids = [i for k, i in enumerate(ids) if comp[k] == k]
    out = {}
    for i, (_, _, _, _, gone) in zip(ids, remove([text[i] for i in ids]), strict=True):
        at, kept_chars = 0, []
        for c in text[i]:
            n = len(c.encode())
            if not all(gone[at : at + n]):
                kept_chars.append(c)
            at += n
        out[i] = "".join(kept_chars)
    cut = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    wins = set()
    for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect():
        v = cut(r["text"])
        wins |= {tuple(v[k : k + 10]) for k in range(max(1, len(v) - 9))} if v else set()
    sizes = {len(w) for w in wins}
    bad = {i for i, t in out.items() for w in [cut(t)] for n in sizes for s in range(len(w) - n + 1) if tuple(w[s : s + n]) in wins}
    return {i: t for i, t in out.items() if i not in bad}


def test_run_matches_plain_python(spark, sf):
    want = plain(spark, sf)
    rows = corpus_pipeline.run(spark, sf).toPandas()
    n = {i: len(x) for i, x in zip(want, token_ids(want.values()), strict=True)}
    assert rows.groupby("doc_id")["length"].sum().to_dict() == n
    counts = rows.groupby("length").size().to_dict()
    assert rows["sequence_id"].nunique() == sum(b.times for b in packing.best_two_fit(counts, packing.CAPACITY))


def test_stages_keep_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == docs.columns
    empty = docs.limit(0)
    assert all(stage(spark, empty, sf).count() == 0 for _, stage in corpus_pipeline.STAGES)
    assert TOKENIZER


def test_every_operator_takes_null_ids(spark, sf):
    from locusframe.llm import decontam, langid, licenses, neardup, packing, quality, shards, suffix

    rows = [(None, "some words of a text that has an id of null " * 8, None, None, None), (3, None, None, None, None), (4, "some words of a text that has an id of null " * 8, "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    bench = spark.createDataFrame([(None, "some words of a text that has an id of null some"), (2, None)], "item_id long, text string")
    near = {r["doc_id"]: r for r in neardup.near_duplicates(docs).collect()}
    assert near[None]["kept"] and near[3]["kept"] and not near[4]["kept"] and near[4]["component_id"] is None
    gone = {r["doc_id"]: r["n_removed"] == r["n_bytes"] for r in suffix.repeated_passages(docs).collect()}
    assert gone == {None: False, 3: True, 4: True}
    assert {r["doc_id"]: r["contaminated"] for r in decontam.contamination(docs, bench).collect()} == {None: True, 3: False, 4: True}
    for out in (quality.quality_rules(docs), licenses.scan_licenses(docs), shards.interleave(docs), langid.identify(docs), packing.pack(docs, TOKENIZER)):
        assert {r["doc_id"] for r in out.collect()} == {None, 3, 4}
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf).collect()
    kept = corpus_pipeline.near_dedup(spark, docs, sf).collect()
    assert {r["doc_id"] for r in kept} == {None, 3}
