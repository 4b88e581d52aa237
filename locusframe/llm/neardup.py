"""Near-duplicate documents by HyperMinHash.

A document's set holds its distinct shingles of five words (ASCII upper case
folded); with one to four words, the whole sequence is its one shingle. Two
documents are linked if 100 * intersection >= 75 * union.

1. Sketch. A shingle's 64-bit hash, made of its words' BLAKE2 digests, falls
   into one of 256 buckets by its top bits; a bucket keeps the smallest of the
   other 56 bits, compressed to its leading-zero count and 16 mantissa bits (22
   bits for a register). Empty buckets borrow by a fixed probe sequence.
2. Documents with equal sets, told by the SHA-256 of all their shingles' words
   in order of hashes, form a class at once; only its first row goes on.
3. Banding. 80 bands of five registers give keys. At a similarity of 0.75 a
   pair shares no key with probability (1 - 0.75**5)**80 < 1e-9 for
   independent bands; bands that reuse registers leave it below 1e-6.
4. Estimate, then verify. The members of a key's bucket are compared with its
   smallest one, the pivot, not all with all. Each document first tries the
   pivot with which it shares most keys; then pivots in other components. What
   shares a bucket and is still in different components is settled by a prefix
   filter over its shingles, which loses no link. The estimated similarity of
   two sketches is corrected for register collisions; a pair goes if it lies
   more than five standard errors below the threshold, else it is confirmed on
   the full sets of shingles, by their words.
5. Components by contraction with pointer jumping, in written tables.

So every pair that shares a key is either confirmed, refuted, or already in one
component. Smallest members and counts of a key or a shingle come from a
partial aggregation and are joined back, where Spark splits a hot one; nothing
is collected. Null and blank texts have an empty set and stay alone. Rows that
repeat an id are documents of their own: a component goes by the smallest id in
it, and ``kept`` holds for each row with that id, ``first`` for one row alone.
Long texts are cut into words as a whole; tables without rows give none.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import NO_ID, components, numbered, private, small_batches, stash
from .textbuf import IS_SPACE, STEP, TextBuf, U, by_slices, coded, digests, joint, mix, order_in_docs, padded, window_starts

WORDS = 5
REGISTERS = 256
BUCKET_BITS = 8
MANTISSA_BITS = 16
ROWS = 5
BANDS = 80
#: Registers of each band.
BAND_REGISTERS = np.stack([np.random.default_rng([7, b]).choice(REGISTERS, ROWS, replace=False) for b in range(BANDS)])
SIMILAR, OF = 75, 100


def word_codes(buf: TextBuf) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Each word's number and document, and the distinct words."""
    solid = ~IS_SPACE[buf.data]
    s, e, d = buf.runs(solid)
    code, distinct = coded(buf, solid, s, e)
    return code, d, distinct


def shingle_sets(buf: TextBuf, k: int = WORDS, bits: int = 64) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles in the order of documents and hashes: documents, hashes, words (k each) and their digests.

    Shingles are told apart by their words, whatever their hashes (of so many
    bits) say; the order of equal hashes is that of digests, so it is the same in every batch.
    """
    code, d, distinct = word_codes(buf)
    if not len(code):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros((0, k), np.int64), np.zeros((1, 2), np.uint64)
    digest = np.concatenate((digests(distinct), np.zeros((1, 2), np.uint64)))
    code, d = padded(code, d, buf.n, k, len(distinct))
    at = window_starts(d, k)
    doc, words = d[at], np.stack([code[at + j].astype(np.int32) for j in range(k)], 1)
    h = np.zeros(len(at), np.uint64)
    for j in range(k):
        h += digest[words[:, j], 0] * STEP[j]
    g = mix(h)
    if bits < 64:
        g = mix(g >> U(64 - bits))
    order = order_in_docs(doc, g)
    same = lambda o: (doc[o[1:]] == doc[o[:-1]]) & (g[o[1:]] == g[o[:-1]])
    equal = lambda o: (words[o[1:]] == words[o[:-1]]).all(1)
    if (same(order) & ~equal(order)).any():
        by = [digest[words[:, j], x] for j in range(k) for x in (0, 1)]
        order = np.lexsort((*by, g, doc))
    new = np.append(True, ~(same(order) & equal(order)))
    order = order[new]
    return doc[order], g[order], words[order], digest


def registers(doc: np.ndarray, g: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Compressed registers (n, REGISTERS) with empty buckets filled, and the number of full buckets before.

    An empty bucket takes the register of another one, found by a probe
    sequence that depends on the bucket alone, so that equal parts of two sets
    fill it alike and small sets have as many registers as large ones.
    """
    out = np.zeros((n, REGISTERS), np.uint32)
    if len(g):
        bucket = (g >> U(64 - BUCKET_BITS)).astype(np.int64)
        slot = doc * REGISTERS + bucket
        first = np.ones(len(g), bool)
        first[1:] = slot[1:] != slot[:-1]
        v = g[first] & U((1 << (64 - BUCKET_BITS)) - 1)
        exponent = np.frexp(v.astype(np.float64))[1]
        zeros = 64 - BUCKET_BITS + 1 - exponent
        shift = exponent - 1 - MANTISSA_BITS
        mantissa = np.where(shift >= 0, v >> np.maximum(shift, 0).astype(np.uint64), v << np.maximum(-shift, 0).astype(np.uint64))
        reg = (zeros.astype(np.uint32) << np.uint32(MANTISSA_BITS)) | (mantissa & U((1 << MANTISSA_BITS) - 1)).astype(np.uint32)
        out.reshape(-1)[slot[first]] = reg + np.uint32(1)
    full = (out > 0).sum(1)
    rows, cols = np.nonzero((out == 0) & (full > 0)[:, None])
    dense = out.copy()
    turn = 0
    while len(rows):
        turn += 1
        probe = (mix(cols.astype(np.uint64) * STEP[10] + np.full(1, turn, np.uint64) * STEP[11]) >> U(64 - BUCKET_BITS)).astype(np.int64)
        got = out[rows, probe]
        hit = got > 0
        dense[rows[hit], cols[hit]] = got[hit]
        rows, cols = rows[~hit], cols[~hit]
    return dense, full


def pack(regs: np.ndarray) -> np.ndarray:
    """Three bytes for each register."""
    return np.ascontiguousarray(regs.astype("<u4").view(np.uint8).reshape(*regs.shape, 4)[:, :, :3]).reshape(len(regs), -1)


def unpack(arr: pa.Array) -> np.ndarray:
    from .textbuf import binary_parts

    data, _ = binary_parts(arr)
    out = np.zeros((len(arr), REGISTERS, 4), np.uint8)
    out[:, :, :3] = data.reshape(len(arr), REGISTERS, 3)
    return out.view("<u4")[:, :, 0]


def _binary(rows: np.ndarray) -> pa.Array:
    """A binary array of rows of equal width."""
    n, w = rows.shape
    off = np.arange(n + 1, dtype=np.int32) * w
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(rows))])


def sketch(bits: int):
    def work(cut: pa.RecordBatch) -> pa.RecordBatch:
        buf = TextBuf.of(cut.column("body"), lower=True)
        doc, g, words, digest = shingle_sets(buf, bits=bits)
        n = np.bincount(doc, minlength=buf.n)
        regs, _ = registers(doc, g, buf.n)
        sets, a = [], 0
        for b in np.cumsum(n).tolist():
            sha = hashlib.sha256()
            for at in range(a, b, 1 << 16):
                sha.update(np.ascontiguousarray(digest[words[at : min(b, at + (1 << 16))]]))
            sets.append(sha.digest())
            a = b
        cols = [cut.column("row"), pa.array(n.astype(np.int64)), pa.array(sets, pa.binary()), _binary(pack(regs))]
        return pa.RecordBatch.from_arrays(cols, ["row", "n_shingles", "set", "regs"])

    return by_slices(work, "body")


def band_keys(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            part = batch.slice(at, 2000)
            regs = unpack(part.column("regs")).astype(np.uint64)
            key = np.zeros((len(regs), BANDS), np.uint64)
            for j in range(ROWS):
                key += regs[:, BAND_REGISTERS[:, j]] * STEP[j]
            key = mix(key + np.arange(BANDS, dtype=np.uint64) * STEP[40])
            each = lambda name: pa.array(np.repeat(part.column(name).to_numpy(), BANDS))
            yield pa.RecordBatch.from_arrays([pa.array(key.reshape(-1).view(np.int64)), each("id"), each("n")], ["key", "id", "n"])


def estimate(batches):
    """Pairs whose sketches may come from sets that are similar enough."""
    for batch in batches:
        a, b = unpack(batch.column("regs_a")), unpack(batch.column("regs_b"))
        same = ((a == b) & (a > 0)).mean(1)
        collide = 2.0**-MANTISSA_BITS / 3  # equal leading-zero counts, then equal mantissas, of different minima
        j = (same - collide) / (1 - collide)
        n = np.minimum(REGISTERS, np.minimum(batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy()))
        t = SIMILAR / OF
        ok = j >= t - 5 * np.sqrt(t * (1 - t) / np.maximum(n, 1))
        yield batch.filter(pa.array(ok)).select(["a", "b"])


def verify(cut: pa.RecordBatch) -> pa.RecordBatch:
    """Pairs whose full sets are similar enough; words are compared as such."""
    n = cut.num_rows
    both = pa.concat_arrays([cut.column("body_a"), cut.column("body_b")])
    code, d, distinct = word_codes(TextBuf.of(both, lower=True))
    code, d = padded(code, d, 2 * n, WORDS, len(distinct))
    at = window_starts(d, WORDS)
    g, doc = joint([code[at + j] for j in range(WORDS)]), d[at]
    order = np.lexsort((g, doc))
    g, doc = g[order], doc[order]
    new = np.append(True, (g[1:] != g[:-1]) | (doc[1:] != doc[:-1])) if len(g) else np.zeros(0, bool)
    g, pair = g[new], doc[new] % n
    order = np.lexsort((g, pair))
    g, pair = g[order], pair[order]
    common = np.bincount(pair[1:][(pair[1:] == pair[:-1]) & (g[1:] == g[:-1])], minlength=n)
    union = np.bincount(pair, minlength=n) - common
    return cut.filter(pa.array((union > 0) & (OF * common >= SIMILAR * union))).select(["a", "b"])


def _linked(pairs: DataFrame, sketches: DataFrame, bodies: DataFrame) -> DataFrame:
    """The pairs (a, b) that hold, as a written table."""
    side = lambda df, end, *cols: df.select(F.col("id").alias(end), *[F.col(c).alias(f"{c}_{end}") for c in cols])
    s = pairs.join(side(sketches, "a", "n", "regs"), "a").join(side(sketches, "b", "n", "regs"), "b")
    likely = stash(s.mapInArrow(estimate, "a long, b long"), "likely")
    full = likely.join(side(bodies, "a", "body"), "a").join(side(bodies, "b", "body"), "b")
    return stash(full.mapInArrow(by_slices(verify, "body_a"), "a long, b long"), "links")


def token_rows(bits: int):
    def work(cut: pa.RecordBatch) -> pa.RecordBatch:
        doc, g, _, _ = shingle_sets(TextBuf.of(cut.column("body"), lower=True), bits=bits)
        n = np.bincount(doc, minlength=cut.num_rows)
        if len(g):  # different shingles of a document with one hash count as several tokens
            first = np.flatnonzero(np.append(True, (g[1:] != g[:-1]) | (doc[1:] != doc[:-1])))
            turn = np.arange(len(g)) - np.repeat(first, np.diff(np.append(first, len(g))))
            g = g + turn.astype(np.uint64) * STEP[12]
        label = cut.column("label").to_numpy()
        cols = [cut.column("id").to_numpy()[doc], label[doc], n[doc], g.view(np.int64)]
        return pa.RecordBatch.from_arrays(list(map(pa.array, cols)), ["id", "label", "n", "g"])

    return by_slices(work, "body")


def _across(open_ids: DataFrame, bodies: DataFrame, bits: int) -> DataFrame:
    """Pairs of documents in different components that may still be linked, by a prefix filter without loss.

    Shingles are put in one order for all: those whose documents lie in one
    component first, then the rarer ones. A linked pair's first common shingle
    lies in the prefix of both, and enough shingles must be left behind it.
    """
    rows = stash(bodies.join(open_ids, "id").mapInArrow(token_rows(bits), "id long, label long, n long, g long"), "tokens")
    spread = rows.groupBy("g").agg(F.count(F.lit(1)).alias("df"), F.min("label").alias("lo"), F.max("label").alias("hi"))
    mixed = rows.join(spread.where("lo < hi").select("g", "df"), "g")
    in_doc = Window.partitionBy("id")
    rank = F.row_number().over(in_doc.orderBy("df", "g"))
    left = F.count(F.lit(1)).over(in_doc) - rank  # shingles behind this one
    prefix = mixed.withColumn("left", left).where((F.col("left") + 1) * OF >= F.col("n") * SIMILAR)
    prefix = stash(prefix.select("id", "label", "n", "g", "left"), "prefix")
    other = prefix.select("g", *[F.col(c).alias(f"{c}_o") for c in ("id", "label", "n", "left")])
    enough = (F.least("left", "left_o") + 1) * (OF + SIMILAR) >= (F.col("n") + F.col("n_o")) * SIMILAR
    pairs = prefix.join(other, "g").where((F.col("label") < F.col("label_o")) & enough)
    return pairs.select(F.least("id", "id_o").alias("a"), F.greatest("id", "id_o").alias("b")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 64) -> DataFrame:
    """(doc_id, n_shingles, class_id, component_id, kept), one row for each row of docs.

    class_id: the smallest doc_id with an equal set; component_id: the smallest one reachable over links.
    ``bits`` is the length of shingle hashes; with short ones the result is the same, but more is compared.
    """
    name = private(docs, "_row")
    rows, plain = numbered(docs, name, id_col, text_col)
    return rows_with_components(rows, name, plain, id_col, text_col, bits).drop("_row", "first")


def kept_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each component the first row of docs, all columns."""
    name, mark = private(docs, "_row"), private(docs, "_first")
    rows, plain = numbered(docs, name, id_col, text_col)
    first = rows_with_components(rows, name, plain, id_col, text_col).where("first").select(F.col("_row").alias(mark))
    return rows.join(first, rows[name] == first[mark], "left_semi").drop(name)


def rows_with_components(docs: DataFrame, row_col: str, same_as_id: bool, id_col: str, text_col: str, bits: int = 64) -> DataFrame:
    """near_duplicates of rows as numbered() gives them, with each row's name, ``_row``, and ``first``: it stands for its component."""
    small_batches(docs.sparkSession)
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))
    docs = docs.select(F.col(row_col).alias("row"), key.alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("body"))
    sk = stash(docs.select("row", "body").mapInArrow(sketch(bits), "row long, n_shingles long, set binary, regs binary"), "sketches")
    full = sk.where("n_shingles > 0")
    classes = full.groupBy("set").agg(F.min("row").alias("class"), F.count(F.lit(1)).alias("c"))
    classes = stash(classes.where("c > 1").drop("c"), "several")
    member = full.select("row", "n_shingles", "set").join(classes, "set", "left")
    member = stash(member.select("row", "n_shingles", F.coalesce("class", "row").alias("class")), "classes")
    later = member.where("row != class").select(F.col("row").alias("id"))
    reps = full.select(F.col("row").alias("id"), F.col("n_shingles").alias("n"), "regs").join(later, "id", "left_anti")
    reps = stash(reps, "representatives")
    keyed = reps.mapInArrow(band_keys, "key long, id long, n long")
    lowest = keyed.groupBy("key").agg(F.min(F.struct("id", "n")).alias("low"), F.count(F.lit(1)).alias("c")).where("c > 1")
    lowest = lowest.select("key", F.col("low.id").alias("pivot"), F.col("low.n").alias("pivot_n"))
    bucket = stash(keyed.join(lowest, "key"), "buckets")

    near = lambda a, b: (F.least(a, b) * OF >= F.greatest(a, b) * SIMILAR)
    star = bucket.where((F.col("id") != F.col("pivot")) & near(F.col("n"), F.col("pivot_n")))
    star = stash(star.groupBy(F.col("pivot").alias("a"), F.col("id").alias("b")).agg(F.count(F.lit(1)).alias("shared")), "star")
    ids = stash(bucket.select("id").distinct(), "candidates")
    sketches = stash(reps.join(ids, "id", "left_semi"), "candidate_sketches")
    bodies = stash(docs.select(F.col("row").alias("id"), "body").join(ids, "id", "left_semi"), "candidate_texts")

    best = star.groupBy("b").agg(F.max(F.struct("shared", (-F.col("a")).alias("minus_a"))).alias("m"))
    best = stash(best.select((-F.col("m.minus_a")).alias("a"), "b"), "best")
    links = _linked(best, sketches, bodies)
    comp = components(links)
    at = lambda col, name: comp.select(F.col("v").alias(col), F.col("label").alias(name))

    def apart(pairs: DataFrame) -> DataFrame:
        p = pairs.join(at("a", "la"), "a", "left").join(at("b", "lb"), "b", "left")
        return p.where(F.coalesce("la", "a") != F.coalesce("lb", "b")).select("a", "b")

    tried = best
    second = stash(apart(star.select("a", "b").join(tried, ["a", "b"], "left_anti")), "second")
    links = links.unionByName(_linked(second, sketches, bodies))
    comp = components(links)
    tried = tried.unionByName(second)
    m = bucket.select("key", "id").join(at("id", "label"), "id", "left").withColumn("label", F.coalesce("label", "id"))
    open_keys = m.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x < y").select("key")
    m = m.join(open_keys, "key", "left_semi").select("id", "label").distinct()
    third = _across(stash(m, "open"), bodies, bits)
    third = stash(third.join(tried, ["a", "b"], "left_anti"), "third")
    links = links.unionByName(_linked(third, sketches, bodies))
    comp = components(links)
    out = sk.select("row", "n_shingles").where("n_shingles = 0").withColumn("class", F.col("row")).unionByName(member)
    out = out.join(at("class", "label"), "class", "left").withColumn("label", F.coalesce("label", "class"))
    id_of = lambda c: F.col(c)
    if not same_as_id:
        out = stash(out, "labelled")
        ids = docs.select("row", "doc_id")
        for c in ("row", "class", "label"):
            out = out.join(ids.select(F.col("row").alias(c), F.col("doc_id").alias(f"{c}_id")), c)
        id_of = lambda c: F.col(f"{c}_id")
    out = out.select(
        F.col("row").alias("_row"), id_of("row").alias("doc_id"), "n_shingles", id_of("class").alias("class_id"),
        id_of("label").alias("component_id"), (F.col("row") == F.col("label")).alias("first"),
    ).withColumn("kept", F.col("doc_id") == F.col("component_id"))
    return out.withColumns({c: F.nullif(F.col(c), F.lit(NO_ID)) for c in ("doc_id", "class_id", "component_id")})
