"""Language identification with a string kernel.

A text's profile is the presence of its byte n-grams, n = 1 to 3 (blended
spectrum), after folding ASCII case and turning what is no letter into spaces.
The kernel of two texts is the cosine of their profiles. A bounded sample of
labelled rows gives landmarks; Nyström features K(x, L) K(L, L)^(-1/2) feed one
ridge regression per language against the rest. All of that is linear in the
profile, so landmarks, whitening and weights multiply out to one matrix, and a
batch of whole texts is scored by one product.

``und`` for null text and for text without a letter. With nothing to learn
from, everything is ``und`` with score 0. The sample's bound is SAMPLE rows for
each language, LANGUAGES of them at most.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import broadcast_if, small_batches
from .textbuf import LOWER, TextBuf, U, slices

#: Bound of the training sample: labelled rows for each language, and languages.
SAMPLE = 400
LANGUAGES = 64
LANDMARKS = 160
#: Parts of hashes by which the sample is found.
PARTS = 1 << 12
RIDGE = 1e-2
#: Hashed profile sizes, as bits, of n = 1, 2, 3.
BITS = (8, 13, 14)
WIDTH = sum(1 << b for b in BITS)
SHARPNESS = 4.0
#: Texts are read in pieces of so many bytes.
PIECE = 1 << 21

_FOLD = LOWER.copy()
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[65:91] = _ASCII_LETTER[97:123] = True
_FOLD[:128][~_ASCII_LETTER[:128]] = 32


def profiles(buf: TextBuf) -> np.ndarray:
    """Presence of n-grams: (documents, WIDTH) of bool; read in pieces, so a long text needs no more memory than a batch."""
    out = np.zeros((buf.n, WIDTH), bool)
    for start in range(0, buf.size, PIECE):
        data = _FOLD[buf.data[start : start + PIECE + len(BITS) - 1]].astype(np.uint64)
        doc = buf.doc_of(np.arange(start, start + len(data)))
        at, base = data, 0
        for n, bits in enumerate(BITS, 1):
            if n > 1:
                at = (at[:-1] << U(8)) | data[n - 1 :]
            m = len(at)
            if m <= 0:
                break
            inside = doc[:m] == doc[n - 1 :]
            slot = at if n == 1 else (at * U(0x9E3779B97F4A7C15)) >> U(64 - bits)
            out[doc[:m][inside], base + slot[inside].astype(np.int64)] = True
            base += 1 << bits
    return out


def has_letter(buf: TextBuf) -> np.ndarray:
    has = buf.per_doc(_ASCII_LETTER[buf.data]) > 0
    for d in np.flatnonzero(~has & (np.diff(buf.off) > 0)).tolist():
        text = buf.data[buf.off[d] : buf.off[d + 1]].tobytes().decode("utf-8", "replace")
        has[d] = any(c.isalpha() for c in text)
    return has


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float32)
    return x / np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))


def train(sample: np.ndarray, lang: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, the matrix (WIDTH, languages) and the intercepts."""
    names = sorted(set(lang.tolist()))
    x = _unit(sample)
    each = max(1, LANDMARKS // len(names))
    mark = x[np.concatenate([np.flatnonzero(lang == n)[:each] for n in names])]
    value, vector = np.linalg.eigh((mark @ mark.T).astype(np.float64))
    good = value > 1e-8 * value.max()
    white = vector[:, good] / np.sqrt(value[good])
    phi = (x @ mark.T) @ white
    y = np.where(lang[:, None] == np.array(names), 1.0, -1.0)
    weight = 1 / np.sqrt(np.array([(lang == n).sum() for n in lang]))[:, None]  # languages count alike
    mean, target = np.average(phi, 0, weight[:, 0]), np.average(y, 0, weight[:, 0])
    a, b = (phi - mean) * weight, (y - target) * weight
    ridge = RIDGE * np.trace(a.T @ a) / a.shape[1] + 1e-9
    w = np.linalg.solve(a.T @ a + ridge * np.eye(a.shape[1]), a.T @ b)
    return names, (mark.T @ (white @ w)).astype(np.float32), target - mean @ w


def _cuts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for cut in slices(batch, "body", 1 << 20):
            for at in range(0, cut.num_rows, 256):
                yield cut.slice(at, 256)


def profile_rows(batches):
    for cut in _cuts(batches):
        p = profiles(TextBuf.of(cut.column("body")))
        ids = [np.flatnonzero(r).astype(np.int32) for r in p]
        yield pa.RecordBatch.from_arrays([cut.column("lang"), cut.column("h"), pa.array(ids, pa.list_(pa.int32()))], ["lang", "h", "grams"])


def predict(model: tuple):
    names, matrix, intercept = model

    def run(batches):
        for cut in _cuts(batches):
            buf = TextBuf.of(cut.column("body"))
            known = has_letter(buf) & (len(names) > 0)
            best, score = np.zeros(buf.n, np.int64), np.zeros(buf.n)
            if len(names):
                s = _unit(profiles(buf)) @ matrix + intercept
                e = np.exp(SHARPNESS * (s - s.max(1, keepdims=True)))
                best, score = s.argmax(1), 1 / e.sum(1)
            said = [names[k] if ok else "und" for k, ok in zip(best.tolist(), known.tolist(), strict=True)]
            cols = [cut.column("doc_id"), cut.column("held_out"), pa.array(said, pa.string()), pa.array(np.where(known, score, 0.0))]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "held_out", "lang_pred", "score"])

    return run


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score: one row for each row of docs."""
    small_batches(docs.sparkSession)
    rest = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "lang", (rest == 2).alias("held_out"), F.coalesce("text", F.lit("")).cast("binary").alias("body")
    )
    h = F.xxhash64(F.lit("sample"), "doc_id")
    learn = rows.where("not held_out and lang is not null and octet_length(body) > 0").select("doc_id", "lang", h.alias("h"))
    # The rows of smallest hash: counts of hash parts tell how many parts reach the sample's size, so that only
    # a few rows of a language are ranked, however many it has.
    learn = learn.withColumn("part", F.pmod("h", F.lit(PARTS)))
    counts = learn.groupBy("lang", "part").agg(F.count(F.lit(1)).alias("c"))
    before = F.sum("c").over(Window.partitionBy("lang").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = counts.withColumn("b", F.coalesce(before, F.lit(0))).where(F.col("b") < SAMPLE).select("lang", "part")
    few = learn.join(broadcast_if(parts, SAMPLE * LANGUAGES), ["lang", "part"], "left_semi")
    order = Window.partitionBy("lang").orderBy("part", "h", "doc_id")
    picked = few.withColumn("r", F.row_number().over(order)).where(F.col("r") <= SAMPLE).select("doc_id", "lang")
    picked = F.broadcast(picked.orderBy("lang", "doc_id").limit(SAMPLE * LANGUAGES))  # a bound of ids
    got = rows.where("not held_out").join(picked, ["doc_id", "lang"], "left_semi").withColumn("h", h)
    got = got.select("lang", "h", "body").mapInArrow(profile_rows, "lang string, h long, grams array<int>")
    sample = got.limit(SAMPLE * LANGUAGES).toPandas().sort_values(["h", "lang"])
    if len(sample) >= SAMPLE * LANGUAGES:
        warnings.warn(f"only the first {LANGUAGES} languages by name are learned", stacklevel=2)
    model: tuple = ([], None, None)
    if len(sample):
        x = np.zeros((len(sample), WIDTH), bool)
        for i, g in enumerate(sample["grams"]):
            x[i, np.asarray(g, np.int64)] = True
        model = train(x, sample["lang"].to_numpy().astype(str))
    rows = rows.select("doc_id", "held_out", "body")
    return rows.mapInArrow(predict(model), "doc_id long, held_out boolean, lang_pred string, score double")
