"""Batches of texts as one byte buffer, with prefix hashes and word spans.

A batch that Spark hands over by Arrow holds its texts in one contiguous
buffer. The functions here work on that buffer as a whole with numpy, so no
Python code runs per document.

Words and lines are told apart exactly, by a dictionary of a batch's distinct
ones. Where texts of different batches must meet, a word goes by its BLAKE2
digest, and a run of words by a hash of these.

``span_hash`` is polynomial modulo 2**64 over a random table of byte values:
with ``H[i]`` the sum of ``T[b[j]] * B**j`` for j < i, the hash of bytes s..e is
``(H[e] - H[s]) * B**-s``, whatever its place. Long texts exist that differ and
have equal hashes of this kind, so who uses it must compare the bytes as well.
"""

from __future__ import annotations

import contextlib
import ctypes
import hashlib
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_rng = np.random.default_rng(20240607)
BYTE_VALUE = _rng.integers(1, 2**64, 256, dtype=np.uint64, endpoint=False)
BASE = 0x9E3779B97F4A7C15 | 1
UNBASE = pow(BASE, -1, 2**64)
STEP = (_rng.integers(1, 2**64, 64, dtype=np.uint64, endpoint=False) | U(1)).astype(np.uint64)

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of text that are worked on at once; a longer text is a slice of its own.
SLICE = 1 << 19

_power_cache: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """B**i and B**-i for i < n."""
    if n > len(_power_cache.get("up", ())):
        size = max(n, 1 << 20)
        for name, base in (("up", BASE), ("down", UNBASE)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _power_cache[name] = np.cumprod(p, dtype=np.uint64)
    return _power_cache["up"][:n], _power_cache["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def binary_parts(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a binary array without nulls; offsets start at 0."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if len(arr) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_binary(arr.type) or pa.types.is_large_string(arr.type) else np.int32
    off = np.frombuffer(arr.buffers()[1], kind)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    body = arr.buffers()[2]
    data = np.frombuffer(body, np.uint8)[off[0] : off[-1]] if body is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


def slices(batch: pa.RecordBatch, column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Cuts of a batch with at most so many bytes in a column, one row at least."""
    if batch.num_rows == 0:
        return
    _, off = binary_parts(batch.column(column))
    at, n = 0, batch.num_rows
    while at < n:
        to = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def give_back() -> None:
    """Freed memory goes back to the system at the end of a task, as the worker may live on beside others."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        with contextlib.suppress(OSError, AttributeError):  # another libc keeps it
            ctypes.CDLL(None).malloc_trim(0)


def by_slices(work: Callable, column: str, limit: int = SLICE) -> Callable:
    """An argument for mapInArrow: work(batch) gives a batch for each cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cut in slices(batch, column, limit):
                out = work(cut)
                if out is not None and out.num_rows:
                    yield out
        give_back()

    return run


class TextBuf:
    """Texts in one buffer; document d holds bytes off[d] up to off[d + 1]."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        self.data, self.off, self.n, self.size = data, off, len(off) - 1, len(data)
        self._prefix: np.ndarray | None = None

    @classmethod
    def of(cls, arr: pa.Array, lower: bool = False) -> TextBuf:
        data, off = binary_parts(arr)
        return cls(LOWER[data] if lower else data, off)

    @property
    def prefix(self) -> np.ndarray:
        if self._prefix is None:
            up, _ = powers(self.size)
            h = np.zeros(self.size + 1, np.uint64)
            np.cumsum(BYTE_VALUE[self.data] * up, out=h[1:])
            self._prefix = h
        return self._prefix

    def span_hash(self, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        """Of bytes s up to e."""
        _, down = powers(self.size + 1)
        h = self.prefix
        return mix((h[e] - h[s]) * down[s] + (e - s).astype(np.uint64) * STEP[63])

    def doc_of(self, pos: np.ndarray) -> np.ndarray:
        """The document that holds each position; positions ascend."""
        return np.searchsorted(self.off, pos, "right") - 1

    def runs(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Maximal runs of marked bytes that stay in one document: starts, ends, documents."""
        if not self.size:
            z = np.zeros(0, np.int64)
            return z, z, z
        cut = np.zeros(self.size + 1, bool)
        cut[self.off] = True
        starts = inside.copy()
        starts[1:] &= ~inside[:-1] | cut[1:-1]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:] | cut[1:-1]
        s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
        return s, e, self.doc_of(s)

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Maximal runs without white space."""
        return self.runs(~IS_SPACE[self.data])

    def per_doc(self, mark: np.ndarray) -> np.ndarray:
        """The number of marked bytes in each document."""
        c = np.zeros(self.size + 1, np.int64)
        np.cumsum(mark, out=c[1:])
        return c[self.off[1:]] - c[self.off[:-1]]


def order_in_docs(doc: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The order by document, then hash. Documents of a batch fit 16 bits as a rule, and a radix sort is used then."""
    by_hash = np.argsort(h)
    d = doc[by_hash]
    if len(d) and d.max() < 65536:
        d = d.astype(np.uint16)
    return by_hash[np.argsort(d, kind="stable")]


def coded(buf: TextBuf, mark: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """A number for each run s..e of marked bytes, equal for equal bytes alone, and the distinct runs in the order of numbers."""
    to = np.concatenate(([0], np.cumsum(e - s))).astype(np.int64)
    body = pa.py_buffer(np.ascontiguousarray(buf.data[mark]))
    runs = pa.Array.from_buffers(pa.large_binary(), len(s), [None, pa.py_buffer(to), body]).dictionary_encode()
    return runs.indices.to_numpy().astype(np.int64), runs.dictionary


def digests(distinct: pa.Array) -> np.ndarray:
    """Two 64-bit numbers for each string: its BLAKE2 digest of 128 bits."""
    raw = b"".join([hashlib.blake2b(x, digest_size=16).digest() for x in distinct.to_pylist()])
    return np.frombuffer(raw, "<u8").reshape(-1, 2)


def joint(codes: list[np.ndarray]) -> np.ndarray:
    """One number for each tuple of numbers, equal for equal tuples alone."""
    out = codes[0]
    for c in codes[1:]:
        if not len(c):
            return out
        a, b = int(out.max()) + 1, int(c.max()) + 1
        if a * b >= 2**63:
            out = np.unique(out, return_inverse=True)[1].reshape(-1)
        out = out * b + c
    return out


def padded(code: np.ndarray, doc: np.ndarray, n_docs: int, k: int, pad: int) -> tuple[np.ndarray, np.ndarray]:
    """Words and their documents, where documents with 1 to k - 1 words are filled up to k with one number."""
    count = np.bincount(doc, minlength=n_docs)
    lack = np.where((count > 0) & (count < k), k - count, 0)
    if not lack.any():
        return code, doc
    ends = np.repeat(np.cumsum(count), lack)
    return np.insert(code, ends, pad), np.insert(doc, ends, np.repeat(np.arange(n_docs), lack))


def window_starts(doc: np.ndarray, k: int) -> np.ndarray:
    """The words at which k consecutive words of one document begin."""
    n = len(doc) - k + 1
    return np.flatnonzero(doc[:n] == doc[k - 1 :]) if n > 0 else np.zeros(0, np.int64)
