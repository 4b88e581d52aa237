"""Quality rules, lines first.

Each line with a word is judged by itself; lines that fail are removed, and a
document that loses too much of its text is rejected. Before that, documents
that are too short or repeat themselves fail the base rules.

Words are maximal runs of bytes other than space and 0x09 to 0x0D. The word
characters of a line are the code points in its words. A line fails as

- symbols: of ``[#*$%&|<>]`` more than a tenth of its word characters;
- shouting: more exclamation marks than a third of its words;
- separators: a quarter of its words or more are a lone ``|``, ``»``, ``•`` or ``·``;
- navigation: five words at most and no closing punctuation at its end;
- boilerplate: 25 words at most and one of the phrases below, in any ASCII case.

Null text counts as empty: no words, base rules fail. Lines without a word are
kept and weigh nothing. Repeated lines are counted, not removed. Lines and words
are compared as such, not by hashes. Every row is judged by itself, so repeated
ids and rows, null ids and empty tables need no care.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import private, small_batches
from .textbuf import IS_SPACE, LOWER, TextBuf, by_slices, coded, joint, window_starts

# Fixed values of the line rules.
PHRASES = (
    "accept cookies",
    "use of cookies",
    "enable javascript",
    "all rights reserved",
    "terms of use",
    "terms of service",
    "privacy policy",
    "click here",
    "sign up for",
    "subscribe to our",
    "share on facebook",
    "lorem ipsum",
)
SYMBOLS = "#*$%&|<>"
SEPARATORS = ("|", "»", "•", "·")
CLOSING = ".!?:;,)]}\"'…”’»"
MAX_SYMBOL_PART = 10
MAX_BANG_PART = 3
SEPARATOR_PART = 4
NAV_WORDS = 5
BOILERPLATE_WORDS = 25
#: A document is rejected if its removed word characters times this exceed all of them.
LOSS_PART = 2
MIN_WORDS = 50

_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS.encode())] = True

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "n_lines long, n_bad_lines long, lost_chars long, base_failed boolean, kept boolean"
)


def _ends_with(buf: TextBuf, s: np.ndarray, e: np.ndarray, marks: tuple[str, ...], whole: bool = False) -> np.ndarray:
    """Whether bytes s..e end with (or are) one of some short strings."""
    out = np.zeros(len(s), bool)
    for mark in {*marks}:
        raw = mark.encode()
        ok = (e - s == len(raw)) if whole else (e - s >= len(raw))
        idx = np.flatnonzero(ok)
        for j, b in enumerate(raw):
            idx = idx[buf.data[e[idx] - len(raw) + j] == b]
        out[idx] = True
    return out


def line_table(buf: TextBuf) -> dict[str, np.ndarray]:
    """Spans, counts and verdicts of all lines with a word, and the words of the batch."""
    data = buf.data
    solid = ~IS_SPACE[data]
    lead = solid & ((data & 0xC0) != 0x80)
    ws, we, wd = buf.runs(solid)
    in_line = data != 10
    ls, le, ld = buf.runs(in_line)
    code, _ = coded(buf, in_line, ls, le)
    first = np.searchsorted(ws, ls, "left")
    last = np.searchsorted(ws, le, "left")
    has = last > first
    ls, le, ld, code, first, last = ls[has], le[has], ld[has], code[has], first[has], last[has]
    n = last - first
    among = lambda at: np.searchsorted(at, le) - np.searchsorted(at, ls)
    word_chars = np.add.reduceat(lead, ws, dtype=np.int64) if len(ws) else np.zeros(0, np.int64)
    total = np.concatenate(([0], np.cumsum(word_chars)))
    n_chars = total[last] - total[first]
    n_syms, n_bangs = among(np.flatnonzero(_IS_SYMBOL[data])), among(np.flatnonzero(data == 33))
    n_seps = among(ws[_ends_with(buf, ws, we, SEPARATORS, whole=True)])
    closed = _ends_with(buf, ws[last - 1], we[last - 1], tuple(CLOSING)) if len(n) else np.zeros(0, bool)
    said = np.zeros(len(ls), bool)
    low = LOWER[data].tobytes()
    for phrase in PHRASES:
        raw, at = phrase.encode(), -1
        while (at := low.find(raw, at + 1)) >= 0:
            k = int(np.searchsorted(ls, at, "right")) - 1
            if k >= 0 and at + len(raw) <= le[k]:
                said[k] = True
    bad = (
        (MAX_SYMBOL_PART * n_syms > n_chars)
        | (MAX_BANG_PART * n_bangs > n)
        | ((n_seps > 0) & (SEPARATOR_PART * n_seps >= n))
        | ((n <= NAV_WORDS) & ~closed)
        | ((n <= BOILERPLATE_WORDS) & said)
    )
    return {"start": ls, "end": le, "doc": ld, "code": code, "chars": n_chars, "bad": bad, "ws": ws, "we": we, "wd": wd, "solid": solid, "word_chars": word_chars}


def repeated_words(code: np.ndarray, doc: np.ndarray, k: int = 3) -> np.ndarray:
    """Whether each word lies in a window of k words that its document has twice or more."""
    covered = np.zeros(len(code), bool)
    at = window_starts(doc, k)
    if len(at):
        d, g = doc[at], joint([code[at + j] for j in range(k)])
        order = np.lexsort((g, d))
        d, g = d[order], g[order]
        eq = (g[1:] == g[:-1]) & (d[1:] == d[:-1])
        again = np.zeros(len(g), bool)
        again[1:] |= eq
        again[:-1] |= eq
        first = at[order[again]]
        for j in range(k):
            covered[first + j] = True
    return covered


def measure(cut: pa.RecordBatch) -> pa.RecordBatch:
    """One row of counts and verdicts for each document of a batch (doc_id, body)."""
    buf = TextBuf.of(cut.column("body"))
    n = buf.n
    t = line_table(buf)
    count = lambda d, w=None: np.bincount(d, w, minlength=n).astype(np.int64)
    n_words = count(t["wd"])
    word_chars = count(t["wd"], t["word_chars"])
    same = np.lexsort((t["code"], t["doc"]))
    d, c = t["doc"][same], t["code"][same]
    n_dup = count(d[1:][(d[1:] == d[:-1]) & (c[1:] == c[:-1])])
    n_repeat = count(t["wd"][repeated_words(coded(buf, t["solid"], t["ws"], t["we"])[0], t["wd"])])
    n_symbols = count(buf.doc_of(np.flatnonzero(_IS_SYMBOL[buf.data])))
    lost = count(t["doc"], np.where(t["bad"], t["chars"], 0))
    failed = (n_words < MIN_WORDS) | (100 * n_repeat > 50 * n_words)
    kept = ~failed & (LOSS_PART * lost <= word_chars)
    cols = [n_words, word_chars, n_symbols, n_dup, n_repeat, count(t["doc"]), count(t["doc"][t["bad"]]), lost]
    names = ["doc_id", *(x.split()[0] for x in SCHEMA.split(", ")[1:])]
    return pa.RecordBatch.from_arrays([cut.column("doc_id"), *map(pa.array, cols), pa.array(failed), pa.array(kept)], names)


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts and verdicts, one row for each row of docs (repeated rows too), in one pass without a shuffle."""
    small_batches(docs.sparkSession)
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("body")
    ).mapInArrow(by_slices(measure, "body"), SCHEMA)


def without_bad_lines(body: pa.Array) -> tuple[pa.Array, pa.Array]:
    """The texts of a batch without the lines that fail (each goes with its line feed), and the code points left."""
    buf = TextBuf.of(body)
    t = line_table(buf)
    s, e, d = (t[x][t["bad"]] for x in ("start", "end", "doc"))
    edge = np.zeros(buf.size + 1, np.int8)
    np.add.at(edge, s, 1)
    np.add.at(edge, e + (e < buf.off[d + 1]), -1)
    stay = np.cumsum(edge[:-1], dtype=np.int8) == 0
    kept = np.ascontiguousarray(buf.data[stay])
    to = np.concatenate(([0], np.cumsum(buf.per_doc(stay)))).astype(np.int32)
    text = pa.Array.from_buffers(pa.string(), buf.n, [None, pa.py_buffer(to), pa.py_buffer(kept)])
    return text, pa.array(buf.per_doc(stay & ((buf.data & 0xC0) != 0x80)))


def clean_documents(docs: DataFrame, text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """The rows of docs that pass, all columns: the text without the lines that fail, and its code points
    in ``chars_col`` where docs has that column. Judged and cleaned in one pass. Null text never passes."""
    schema, names, body = docs.schema, docs.columns, private(docs, "_body")
    small_batches(docs.sparkSession)

    def judged(cut: pa.RecordBatch) -> pa.RecordBatch:
        bare = pa.RecordBatch.from_arrays([pa.nulls(cut.num_rows, pa.int64()), cut.column(body)], ["doc_id", "body"])
        cut = cut.filter(measure(bare).column("kept"))
        text, n_chars = without_bad_lines(cut.column(body))
        new = {chars_col: n_chars, text_col: text}
        return pa.RecordBatch.from_arrays([new[c].cast(cut.column(c).type) if c in new else cut.column(c) for c in names], names)

    return docs.select("*", F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias(body)).mapInArrow(by_slices(judged, body), schema)
