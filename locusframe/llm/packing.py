"""Best-fit packing of token sequences, by best-two-fit over a histogram of lengths.

Texts become token ids with a closing id; only documents longer than a
sequence are cut, into full pieces and a rest. What packing needs of them is
how many pieces have each length: at most ``capacity`` numbers, whatever the
corpus. The plan is made from these alone. A bin is filled greedily with the
longest pieces that fit; then its smallest piece is replaced by the two
unpacked ones that fit the expanded gap most tightly, if they fit it better.
The bin so found is repeated as often as its pieces last, so the plan has a few
bins for each length. Pieces are ranked within their length in many tasks and
take the plan's places by rank.

Null text is empty: its document is the closing id alone. doc_id should be
unique; a repeated row gets places of its own.
"""

from __future__ import annotations

import bisect
import os
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import ranked, small_batches, stash
from .textbuf import by_slices

CAPACITY = 2048
CLOSING_ID = 0
#: Words whose ids a worker remembers. The first half stays, later ones go when it is full.
REMEMBERED = 500_000
#: Longer words are not remembered.
LONG_WORD = 64

# Texts of these characters are cut into words here; others go to the tokenizer as a whole. The set leaves out
# what normalisation changes (combining marks), letters whose lower case is longer, and rare kinds of space.
_LETTERS = "a-z\u00df-\u00f6\u00f8-\u012f\u0131-\u017f"
_PLAIN = re.compile(f"[\\t-\\r -~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f\u2010-\u2027\u2030-\u205e\u20ac]*")
# Fixed pattern: how the tokenizer cuts lower-case text into words.
_WORD = re.compile(f"[{_LETTERS}]+|'s|'t|'re|'ve|'m|'ll|'d|[0-9]|[^\\s{_LETTERS}0-9]+")

_tokenizers: dict[str, _Words] = {}


class _Words(dict):
    """Ids of words as little-endian 32-bit bytes."""

    def __init__(self, tokenizer):
        super().__init__()
        self.tokenizer = tokenizer
        ends = sorted(i for w, i in tokenizer.get_vocab().items() if w.endswith("</w>"))
        self.is_end = np.zeros(tokenizer.get_vocab_size(), bool)
        self.is_end[ends] = True
        self.late: list[str] = []

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def learn(self, words: list[str]) -> None:
        """All words as one text: a word's last id is the only one that ends a word."""
        for at in range(0, len(words), 5000):
            part = words[at : at + 5000]
            ids = self.ids(" ".join(part))
            to = (np.flatnonzero(self.is_end[ids]) + 1).tolist()
            if len(to) != len(part) or to[-1] != len(ids):
                self.update((w, self.ids(w).tobytes()) for w in part)
                continue
            raw, start = ids.tobytes(), 0
            for w, end in zip(part, to, strict=True):
                self[w] = raw[4 * start : 4 * end]
                start = end

    def forget(self, new: list[str]) -> None:
        if len(self) > REMEMBERED // 2:
            self.late += [w for w in new if len(w) <= LONG_WORD]
        for w in new:
            if len(w) > LONG_WORD:
                del self[w]
        if len(self) > REMEMBERED:
            for w in self.late:
                del self[w]
            self.late = []

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text."""
        cut = [_WORD.findall(t.lower()) if "<|" not in t and _PLAIN.fullmatch(t) else None for t in texts]
        new = list(set().union(*(c for c in cut if c is not None)) - self.keys())
        self.learn(new)
        out = [self.ids(t).tobytes() if c is None else b"".join(map(self.__getitem__, c)) for t, c in zip(texts, cut, strict=True)]
        self.forget(new)
        return out


def _words(name: str, source: bytes) -> _Words:
    if name not in _tokenizers:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _tokenizers[name] = _Words(Tokenizer.from_str(source.decode()))
    return _tokenizers[name]


def cut_pieces(name: str, file, capacity: int, with_ids: bool):
    """Token ids of each text and a closing id, cut into pieces.

    The tokenizer folds case, drops white space and codes word by word, so most
    words are looked up and only new ones are coded.
    """

    def work(cut: pa.RecordBatch) -> pa.RecordBatch:
        row, piece, start, length, crc, ids = [], [], [], [], [], []
        closing = np.array([CLOSING_ID], "<u4").tobytes()
        for r, raw in enumerate(_words(name, file.value).encode(cut.column("body").to_pylist())):
            raw += closing
            n = len(raw) // 4
            for k, at in enumerate(range(0, n, capacity)):
                to = min(n, at + capacity)
                row.append(r)
                piece.append(k)
                start.append(at)
                length.append(to - at)
                body = raw[4 * at : 4 * to]
                crc.append(zlib.crc32(body))
                if with_ids:
                    ids.append(np.frombuffer(body, "<u4").astype(np.int32))
        doc = cut.column("doc_id").take(pa.array(row, pa.int64()))
        cols = [doc, pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
        names = ["doc_id", "piece", "start", "length", "ids_crc32"]
        if with_ids:
            cols, names = [*cols, pa.array(ids, pa.list_(pa.int32()))], [*names, "ids"]
        return pa.RecordBatch.from_arrays(cols, names)

    return by_slices(work, "body")


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of all documents. tokenizer: path of its file."""
    small_batches(docs.sparkSession)
    with open(tokenizer, "rb") as f:
        file = docs.sparkSession.sparkContext.broadcast(f.read())
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("body"))
    return docs.mapInArrow(cut_pieces(os.path.basename(tokenizer), file, capacity, with_ids), schema)


@dataclass
class Bin:
    """Lengths of one bin in place order, and how many such bins there are."""

    lengths: list[int]
    times: int


class _Stock:
    """What is unpacked: counts of lengths, and the lengths that are left in order."""

    def __init__(self, counts: dict[int, int]):
        self.count = dict(counts)
        self.left = sorted(counts)

    def take(self, n: int, k: int = 1) -> None:
        self.count[n] -= k
        if not self.count[n]:
            del self.left[bisect.bisect_left(self.left, n)]

    def give(self, n: int, k: int = 1) -> None:
        if not self.count.get(n):
            bisect.insort(self.left, n)
        self.count[n] = self.count.get(n, 0) + k

    def longest(self, room: int) -> int:
        k = bisect.bisect_right(self.left, room)
        return self.left[k - 1] if k else 0

    def best_two(self, room: int) -> tuple[int, int]:
        """The two lengths of largest sum within room, the longer first."""
        best = (0, 0)
        i, j = 0, bisect.bisect_right(self.left, room - 1) - 1
        while j >= 0 and i <= j:
            a, b = self.left[j], self.left[i]
            if a + b > room:
                j -= 1
                continue
            if (i < j or self.count[a] > 1) and a + b > sum(best):
                best = (a, b)
                if a + b == room:
                    break
            i += 1
        return best


def best_two_fit(counts: dict[int, int], capacity: int) -> list[Bin]:
    """Bins for so many pieces of each length."""
    stock, out = _Stock({n: c for n, c in counts.items() if c > 0}), []
    while stock.left:
        got: list[int] = []
        gap = capacity
        while n := stock.longest(gap):
            k = min(stock.count[n], gap // n)
            got += [n] * k
            stock.take(n, k)
            gap -= n * k
        if gap and len(got) > 1:
            small = got[-1]
            a, b = stock.best_two(gap + small)
            if a + b > small:
                got[-1:] = [a, b]
                stock.take(a)
                stock.take(b)
                stock.give(small)
        need = {n: got.count(n) for n in set(got)}
        more = min(stock.count[n] // k for n, k in need.items())
        for n, k in need.items():
            if more:
                stock.take(n, k * more)
        out.append(Bin(got, 1 + more))
    return out


def places(bins: list[Bin]) -> dict[str, np.ndarray]:
    """For each (bin, length): the first rank of its pieces, how many a bin takes, the first sequence, the offset."""
    rows, used, sequence = [], {}, 0
    for b in bins:
        at = 0
        for n in sorted(set(b.lengths), reverse=True):
            k = b.lengths.count(n)
            rows.append((n, used.get(n, 0), k, sequence, at))
            used[n] = used.get(n, 0) + k * b.times
            at += n * k
        sequence += b.times
    t = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return dict(zip(("length", "first", "each", "sequence", "offset"), t.T, strict=True))


def place(table: dict[str, np.ndarray], span: int):
    """Pieces with their rank in their length go to their sequence and offset."""
    key = table["length"] * span + table["first"]

    def run(batches):
        for batch in batches:
            n, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            k = np.searchsorted(key, n * span + rank, "right") - 1
            x, each = rank - table["first"][k], table["each"][k]
            seq = table["sequence"][k] + x // each
            off = table["offset"][k] + x % each * n
            names = [c for c in batch.schema.names if c != "rank"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(seq), pa.array(off)], [*names, "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row for each piece."""
    cut = stash(pieces(docs, tokenizer, capacity), "pieces")
    counts = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}  # capacity rows at most
    table = places(best_two_fit(counts, capacity))
    span = max(counts.values(), default=0) + 1
    order = [F.col(c) for c in ("doc_id", "piece", "ids_crc32")]
    with_rank = ranked(cut, ["length"], order, "rank")
    with_rank = with_rank.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("rank").cast("long"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return with_rank.mapInArrow(place(table, span), schema)


def sequences(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """(sequence_id, ids): the packed token ids themselves; doc_id must be unique."""
    put = pack(docs, tokenizer, capacity).select("doc_id", "piece", "sequence_id", "offset")
    full = pieces(docs, tokenizer, capacity, with_ids=True).select("doc_id", "piece", "ids").join(put, ["doc_id", "piece"])
    got = full.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return got.select("sequence_id", F.flatten("parts.ids").alias("ids"))
