"""Packing and language ID against plain versions without histograms, hashes and landmarks; recall of banding."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from locusframe.llm import langid, neardup, packing, shards
from locusframe.llm.textbuf import TextBuf


def by_document(lengths, capacity):
    """Best-two-fit piece by piece: fill greedily, then two unpacked pieces for the smallest one if they fit its gap more tightly."""
    left, bins = sorted(lengths, reverse=True), []
    while left:
        got, gap = [], capacity
        while True:
            k = next((i for i, n in enumerate(left) if n <= gap), None)
            if k is None:
                break
            got.append(left.pop(k))
            gap -= got[-1]
        if gap and len(got) > 1:
            small, room, best = got[-1], gap + got[-1], (0, 0)
            for i, a in enumerate(left):
                for b in left[i + 1 :]:
                    if a + b <= room and (a + b, a) > (sum(best), best[0]):
                        best = (a, b)
            if sum(best) > small:
                got[-1:] = best
                for n in best:
                    left.remove(n)
                left.append(small)
                left.sort(reverse=True)
        bins.append(tuple(got))
    return bins


@pytest.mark.parametrize("seed", range(8))
def test_plan_is_that_of_single_documents(seed):
    rng = random.Random(seed)
    capacity = rng.choice([20, 60, 100])
    lengths = [rng.randint(1, capacity) if rng.random() < 0.5 else rng.randint(1, max(2, capacity // 4)) for _ in range(rng.randint(1, 150))]
    counts = {n: lengths.count(n) for n in set(lengths)}
    plan = [tuple(b.lengths) for b in packing.best_two_fit(counts, capacity) for _ in range(b.times)]
    want = by_document(lengths, capacity)
    assert sorted(n for b in plan for n in b) == sorted(lengths) == sorted(n for b in want for n in b)
    assert len(plan) == len(want)
    assert sorted(map(sum, plan)) == sorted(map(sum, want))


def grams(text):
    raw = text.encode()
    raw = bytes(c + 32 if 65 <= c <= 90 else 32 if c < 128 and not 97 <= c <= 122 else c for c in raw)
    return {raw[i : i + n] for n in (1, 2, 3) for i in range(len(raw) - n + 1)}


def test_languages_against_the_exact_kernel(spark):
    """The kernel of n-gram sets themselves, all labelled rows as landmarks, one ridge regression a language."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.orderBy("doc_id").collect()
    got = {r["doc_id"]: r for r in langid.identify(docs).collect()}
    learn = [r for r in rows if not got[r["doc_id"]]["held_out"] and r["lang"] is not None and r["text"]]
    names = sorted({r["lang"] for r in learn})
    profile = {r["doc_id"]: grams(r["text"] or "") for r in rows}

    def kernel(a, b):
        return np.array([[len(p & q) / max(1.0, (len(p) * len(q)) ** 0.5) for q in b] for p in a])

    marks = [profile[r["doc_id"]] for r in learn]
    k = kernel(marks, marks)
    y = np.where(np.array([r["lang"] for r in learn])[:, None] == np.array(names), 1.0, -1.0)
    weight = 1 / np.array([sum(r["lang"] == s["lang"] for s in learn) for r in learn])
    alpha = np.linalg.solve(k + 1e-2 * np.diag(1 / weight) / len(learn), y - y.mean(0))
    known = [r for r in rows if r["text"] and any(c.isalpha() for c in r["text"])]
    scores = kernel([profile[r["doc_id"]] for r in known], marks) @ alpha
    said = [names[i] for i in scores.argmax(1)]
    agree = np.mean([got[r["doc_id"]]["lang_pred"] == s for r, s in zip(known, said, strict=True)])
    assert agree >= 0.98
    assert all(got[r["doc_id"]]["lang_pred"] == "und" for r in rows if r not in known)


def test_profiles_of_long_texts_in_pieces(monkeypatch):
    text = " ".join(random.Random(3).choices(["alpha", "beta", "größe", "ñandú", "x"], k=4000)).encode()
    import pyarrow as pa

    cells = pa.array([text, b"ab", b"", text[:7]], pa.binary())
    whole = langid.profiles(TextBuf.of(cells))
    monkeypatch.setattr(langid, "PIECE", 97)
    assert (langid.profiles(TextBuf.of(cells)) == whole).all()


def test_banding_recall(spark):
    """Of pairs at the threshold, all share a key but for a few in a million; measured here over 400 pairs just above it."""
    rng = random.Random(11)
    found = 0
    texts = []
    for i in range(400):
        base = [f"w{i}_{j}" for j in range(300)]
        other = list(base)
        for j in rng.sample(range(0, 300, 12), 7):  # 35 of 296 shingles change: similarity 0.789
            other[j] = f"v{i}_{j}"
        texts += [" ".join(base), " ".join(other)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    body = docs.select(F.col("doc_id").alias("row"), F.col("text").cast("binary").alias("body"))
    sk = body.mapInArrow(neardup.sketch(64), "row long, n_shingles long, set binary, regs binary")
    keys = sk.selectExpr("row as id", "n_shingles as n", "regs").mapInArrow(neardup.band_keys, "key long, id long, n long")
    shared = keys.join(keys.withColumnRenamed("id", "other").drop("n"), "key").where("id % 2 = 0 and other = id + 1").select("id").distinct().count()
    assert shared == 400
    found = neardup.near_duplicates(docs).where("doc_id % 2 = 1 and component_id = doc_id - 1").count()
    assert found == 400


def test_copies_share_a_shard(docs_of):
    """Groups of copies of one source stay whole but where a cut meets them: a group of ten is a fifth of a shard's rows of its source."""
    rng = random.Random(2)
    texts = [f"text {i}" for i in range(3000)] + [f"copy {i % 60}" for i in range(600)]
    pick = ["a", "a", "b", None]
    source = [pick[int(t.split()[1]) % 4] if t.startswith("copy") else rng.choice(pick) for t in texts]
    got = shards.interleave(docs_of(texts, source=source)).toPandas().set_index("doc_id")
    got["text"] = [texts[i] for i in got.index]
    counts = got.groupby("shard").size()
    assert counts.max() - counts.min() <= 1 and sorted(got.groupby("shard").size().index) == list(range(24))
    assert all(sorted(g["slot"]) == list(range(len(g))) for _, g in got.groupby("shard"))
    groups = got[got["text"].str.startswith("copy")].groupby("text")["shard"].nunique()
    assert (groups > 1).sum() <= 25 and groups.max() == 2
    share = got.assign(a=got["source"] == "a").groupby("shard")["a"].mean()
    assert (share - (np.array(source) == "a").mean()).abs().max() < 0.03
