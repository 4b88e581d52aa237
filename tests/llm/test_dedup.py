"""Near-duplicates and repeated passages against plain Python."""

import hashlib
import random
import re

import numpy as np
import pytest

from locusframe.llm import neardup, suffix
from locusframe.llm.textbuf import TextBuf

from .conftest import ODD

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sets(text):
    w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(FOLD))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def components(texts):
    s, par = [sets(t) for t in texts], list(range(len(texts)))

    def find(x):
        while par[x] != x:
            x = par[x]
        return x

    for i in range(len(s)):
        for j in range(i):
            if s[i] and s[j] and 100 * len(s[i] & s[j]) >= 75 * len(s[i] | s[j]):
                a, b = find(i), find(j)
                par[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(s))]


def family(seed, n=60, length=120):
    rng = random.Random(seed)
    base = [f"t{rng.randrange(3000)}" for _ in range(length)]
    out = [" ".join(base)]
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, 9)):
            w[rng.randrange(length)] = f"u{rng.randrange(10**6)}"
        out.append(" ".join(w).title() if rng.random() < 0.2 else " ".join(w))
    return out


def test_components_of_families(docs_of):
    texts = ODD + family(1) + family(2, length=25) + family(3, n=30, length=9) + ["a b c d e", "A b  c d e", "a b c d"] + [" ".join(f"s{i}" for i in range(k, k + 40)) for k in range(0, 60, 3)]
    random.Random(5).shuffle(texts)
    got = {r["doc_id"]: r for r in neardup.near_duplicates(docs_of(texts)).collect()}
    want = components(texts)
    assert [got[i]["component_id"] for i in range(len(texts))] == want
    assert [got[i]["n_shingles"] for i in range(len(texts))] == [len(sets(t)) for t in texts]
    assert all(got[i]["kept"] == (want[i] == i) for i in range(len(texts)))


def test_star_of_unlinked_copies(docs_of):
    """Copies linked to their base but not to each other, and a bucket's members apart from its pivot."""
    base = [f"b{i}" for i in range(200)]
    texts = []
    for k in range(24):
        w = list(base)
        for j in range(5):
            w[(k * 8 + j * 37) % 200] = f"c{k}_{j}"
        texts.append(" ".join(w))
    texts.append(" ".join(base))
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(docs_of(texts)).collect()}
    assert [got[i] for i in range(len(texts))] == components(texts)


def test_no_documents_and_repeated_rows(docs_of):
    assert neardup.near_duplicates(docs_of([])).count() == 0
    d = docs_of(["a b c d e f", "a b c d e f", "z"]).selectExpr("*", "1 as key", "2 as n", "'q' as label")
    rows = neardup.near_duplicates(d.unionByName(d)).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in rows) == [(0, 0), (0, 0), (1, 0), (1, 0), (2, 2), (2, 2)]


def test_sketch_estimates():
    rng = np.random.default_rng(0)
    g = np.sort(rng.integers(0, 2**64, 4000, dtype=np.uint64, endpoint=False))
    a, b = np.sort(g[:3000]), np.sort(g[500:])
    regs = [neardup.registers(np.zeros(len(x), np.int64), x, 1)[0] for x in (a, b)]
    assert abs((regs[0] == regs[1]).mean() - 2500 / 4000) < 0.12
    small = neardup.registers(np.zeros(3, np.int64), g[[5, 2000, 3990]], 1)[0]
    assert (small > 0).all() and len(set(small[0].tolist())) == 3


def remove(texts, length=100):
    seen, out = set(), []
    for t in texts:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            if w in seen:
                gone[p : p + length] = b"\x01" * length
            seen.add(w)
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest(), bytes(gone)))
    return out


def passages(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcé ", k=rng.randint(1, 7)))
    shared = [" ".join(word() for _ in range(rng.randint(10, 80))) for _ in range(6)]
    texts = []
    for _ in range(40):
        parts = [" ".join(word() for _ in range(rng.randint(0, 40)))]
        for _ in range(rng.randint(0, 3)):
            s = rng.choice(shared)
            a = rng.randint(0, len(s) // 2)
            parts += [s[a : a + rng.randint(50, 300)], word()]
        texts.append("".join(parts))
    return [*texts, "ab" * 400, "ab" * 130, "z" * 99, "z" * 100, "z" * 101, *ODD]


@pytest.mark.parametrize(("run", "together"), [(suffix.RUN, suffix.TOGETHER), (1, 1), (2, 1 << 24)])
def test_repeats_against_plain_python(docs_of, run, together):
    """Also with keys of two or three blocks split into several runs, and equal blocks of each batch sent apart."""
    texts = passages(3)
    got = {r["doc_id"]: r for r in suffix.repeated_passages(docs_of(texts).repartition(5), run=run, together=together).collect()}
    want = remove(texts)
    assert [(got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"], got[i]["kept_sha256"]) for i in range(len(texts))] == [w[:4] for w in want]


def test_texts_keep_whole_characters(docs_of):
    texts = ["é" * 60 + "x", "ab" + "é" * 60, None]
    docs = docs_of(texts).selectExpr("*", "7 as key", "'s' as spots")
    rows = {r["doc_id"]: r for r in suffix.without_repeats(docs).collect()}
    assert suffix.without_repeats(docs).columns == docs.columns
    assert rows[0]["text"][-1] == "x" and rows[1]["text"].startswith("ab") and set(rows[1]["text"][2:]) <= {"é"} and rows[2]["text"] == ""


def test_pieces_of_a_long_text(docs_of, monkeypatch):
    monkeypatch.setattr(suffix, "PIECE", 400)
    import pyarrow as pa

    text = bytes(random.Random(1).choices(b"abcd ", k=3000))
    cut = pa.RecordBatch.from_arrays([pa.array([5]), pa.array([text + text], pa.binary())], ["row", "body"])
    small = pa.Table.from_batches(suffix.find_blocks(100)(iter([cut]))).to_pandas()
    monkeypatch.setattr(suffix, "PIECE", 1 << 22)
    whole = pa.Table.from_batches(suffix.find_blocks(100)(iter([cut]))).to_pandas()
    places = lambda d: [*d["place"][d["more"] == b""], *np.frombuffer(b"".join(d["more"]), "<i8")[1::2].tolist()]
    covered = lambda d: {(p >> 16) + k for p in places(d) for k in range((p >> 8 & 255) - 99)}
    assert covered(small) == covered(whole) == set(range(5901))


def test_lying_hashes_are_found():
    """With hashes that all agree, neighbours are still told apart by their bytes."""
    data = np.frombuffer(b"abc" * 40 + b"abd" * 40, np.uint8)
    off, dist, run = np.array([0, 120, 240]), np.array([0, 0]), np.array([0, 0])
    plain = suffix.repeated_windows(data, off, dist, run, 100)
    real = TextBuf.prefix.fget
    try:
        TextBuf.prefix = property(lambda self: np.zeros(self.size + 1, np.uint64))
        lied = suffix.repeated_windows(data, off, dist, run, 100)
    finally:
        TextBuf.prefix = property(real)
    assert plain.tolist() == lied.tolist() == []


THUE = [bin(i).count("1") % 2 for i in range(2048)]
#: Two texts of one word whose polynomials modulo 2**64 are equal for every base.
TWINS = ["".join("ab"[x] for x in THUE), "".join("ba"[x] for x in THUE)]


def test_texts_with_equal_polynomials(docs_of):
    got = {r["doc_id"]: r for r in neardup.near_duplicates(docs_of([*TWINS, "x " + TWINS[0], "x " + TWINS[1]])).collect()}
    assert [got[i]["component_id"] for i in range(4)] == [0, 1, 2, 3]
    texts = [TWINS[0], TWINS[1], TWINS[0][:1024] + TWINS[1][:1024]]
    gone = {r["doc_id"]: r["n_removed"] for r in suffix.repeated_passages(docs_of(texts)).collect()}
    assert [gone[i] for i in range(3)] == [w[1] for w in remove(texts)]


@pytest.mark.parametrize("bits", [0, 3, 9])
def test_components_with_short_hashes(docs_of, bits):
    """Shingles whose hashes agree are told apart by their words, in sets, classes, links and the prefix filter."""
    texts = ODD + family(4, n=25) + family(5, n=20, length=25) + [" ".join(f"s{i}" for i in range(k, k + 40)) for k in range(0, 60, 3)] + TWINS
    random.Random(5).shuffle(texts)
    got = {r["doc_id"]: r for r in neardup.near_duplicates(docs_of(texts), bits=bits).collect()}
    assert [got[i]["component_id"] for i in range(len(texts))] == components(texts)
    assert [got[i]["n_shingles"] for i in range(len(texts))] == [len(sets(t)) for t in texts]


REPEATED = "doc_id long, text string, lang string, source string, n_chars long"


def repeated_ids(spark):
    long = " ".join(f"w{i}" for i in range(130))
    other = " ".join(f"v{i}" for i in range(130))
    rows = [(5, long), (5, other), (8, long + " more"), (9, other + " more"), (0, long), (0, long), (None, long), (None, "z" * 300), (None, None), (3, "")]
    return spark.createDataFrame([(i, t, None, None, None) for i, t in rows], REPEATED), rows


def test_near_duplicates_with_repeated_ids(spark):
    docs, rows = repeated_ids(spark)
    comp = components([t for _, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))])
    ids = sorted((r[0] for r in rows), key=lambda i: (i is not None, i or 0))
    want = sorted((str(i), str(ids[c])) for i, c in zip(ids, comp, strict=True))
    got = neardup.near_duplicates(docs).collect()
    assert sorted((str(r["doc_id"]), str(r["component_id"])) for r in got) == want
    kept = neardup.kept_rows(docs).collect()
    assert len(kept) == len(set(comp)) and {t for _, t in rows if t} >= {r["text"] for r in kept if r["text"]}
    assert sum(r["text"] is not None and r["text"].startswith("v") for r in kept) == 1


def test_repeats_with_repeated_ids(spark):
    docs, rows = repeated_ids(spark)
    got = sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"]) for r in suffix.repeated_passages(docs).collect())
    null = [g for g in got if g[0] == "None"]
    assert len(got) == len(rows)
    n = len(rows[0][1])
    assert sorted(null) == [("None", 0, 0), ("None", 300, 299), ("None", n, 0)]
    assert [g for g in got if g[0] == "0"] == [("0", n, n)] * 2
    assert [g for g in got if g[0] == "5"] == [("5", n, 0), ("5", n, n)]
    again = spark.createDataFrame([(0, "some text " * 60), (0, "some text " * 60)], "doc_id long, text string")
    left = sorted(len(r["text"]) for r in suffix.without_repeats(again).collect())
    first = remove(["some text " * 60])[0]
    assert left == [0, first[0] - first[1]]
