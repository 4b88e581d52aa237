"""Exact removal of repeated passages by a hash-compared suffix sort.

A byte goes if a string of ``length`` bytes that covers it also starts earlier:
in a document with a smaller doc_id, or earlier in the same one. All strings
are judged on the input.

1. Anchors. Every window of ``length`` bytes picks one of its 24-byte grams,
   the leftmost of smallest hash. Equal windows pick the gram at the same
   place, so two equal windows meet under the gram's hash. Consecutive windows
   with one anchor form a block (about 39 bytes apart); only a block's key, the
   128-bit BLAKE2 digest of its bytes and its place are shuffled.
2. Equal blocks. Blocks are dealt out by key and digest, so that a passage that
   many rows share at its ends is no hot key; of blocks with equal digests all
   but the earliest go as a whole, those that repeat within a part of the input
   before the shuffle.
3. Several blocks. Keys with one block have no further repeats. Blocks of one key
   that differ are candidates: where several lie in one task, that is known
   there; what is left alone in its task meets the others once more, one row for
   each task at most.
4. Suffix sort of the candidates under each key: suffixes at the same distance
   from the anchor are merge-sorted, level by level for all groups at once.
   Two suffixes are compared by the longest common extension, found by binary
   search over prefix polynomial hashes. The order of neighbours is then verified
   by their bytes; a group where a hash lied is sorted anew by its bytes. A key
   with more than RUN blocks is split: its windows are dealt out into several
   runs by a hash of their bytes (equal ones of a task put together), and each
   run is sorted in the same way.
5. Spans join their documents.

Null text is empty. Rows are ordered by doc_id (null first); rows that repeat an
id are documents of their own, in the order of a hash of their texts and then of
their place in the table, so of equal rows one keeps its text. Texts shorter than
a window lose nothing. Matches never cross documents.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import broadcast_small, numbered, small_batches, stash
from .textbuf import SLICE, STEP, TextBuf, U, binary_parts, by_slices, give_back, mix, powers, slices

LENGTH = 100
GRAM = 24
#: Longer texts are read in pieces of so many bytes that overlap by a window less one byte.
PIECE = 1 << 20
INDEX_BITS = 23
#: Equal blocks are put together within so many bytes of text before the shuffle.
TOGETHER = 1 << 23
#: Blocks of a key that are sorted in one run.
RUN = 4096


def _sliding_min(key: np.ndarray, w: int) -> np.ndarray:
    """Smallest of key[i] up to key[i + w - 1]."""
    have, m = 1, key
    while 2 * have <= w:
        m = np.minimum(m[:-have], m[have:])
        have *= 2
    if have < w:
        m = np.minimum(m[: len(m) - (w - have)], m[w - have :])
    return m


def blocks(buf: TextBuf, length: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: start, size in bytes, anchor's distance, anchor's hash, document."""
    z = np.zeros(0, np.int64)
    if buf.size < length:
        return z, z, z, np.zeros(0, np.uint64), z
    spots = np.arange(buf.size - GRAM + 1)
    h = buf.span_hash(spots, spots + GRAM)
    low = U((1 << INDEX_BITS) - 1)
    best = _sliding_min((h & ~low) | spots.astype(np.uint64), length - GRAM + 1)
    anchor = (best & low).astype(np.int64)
    ok = np.zeros(len(anchor), np.int8)  # windows that stay in one document
    for a, b in zip(buf.off[:-1].tolist(), buf.off[1:].tolist(), strict=True):
        ok[a : max(a, b - length + 1)] = 1
    p = np.flatnonzero(ok)
    if not len(p):
        return z, z, z, np.zeros(0, np.uint64), z
    new = np.ones(len(p), bool)
    new[1:] = (anchor[p[1:]] != anchor[p[:-1]]) | (p[1:] != p[:-1] + 1)
    at = np.flatnonzero(new)
    first, last = p[at], p[np.append(at[1:], len(p)) - 1]
    a = anchor[first]
    return first, last - first + length, a - first, h[a], buf.doc_of(first)


def _pieces(cut: pa.RecordBatch, length: int):
    """The batch's texts, one that is too long in overlapping pieces: buffer, ids, offsets in the text."""
    ids = cut.column("row").to_numpy()
    data, off = binary_parts(cut.column("body"))
    if len(data) <= PIECE:
        yield TextBuf(data, off), ids, np.zeros(len(ids), np.int64)
        return
    for k in range(len(ids)):
        for at in range(int(off[k]), max(int(off[k]) + 1, int(off[k + 1]) - length + 1), PIECE - length + 1):
            part = data[at : min(at + PIECE, int(off[k + 1]))]
            yield TextBuf(part, np.array([0, len(part)])), ids[k : k + 1], np.array([at - int(off[k])])


def _binaries(flat: np.ndarray, size: np.ndarray) -> pa.Array:
    """Cells of so many bytes each from one run of bytes."""
    to = np.concatenate(([0], np.cumsum(size))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(to), pa.py_buffer(np.ascontiguousarray(flat))])


def find_blocks(length: int, together: int = TOGETHER):
    """One row for each block: key, digest, row of docs, place. Of equal blocks of a part of the input only the
    earliest; places of the others are handed on as repeats, in rows of their own (``more``) under any key."""
    names = ["key", "same", "same2", "row", "place", "more"]

    def settle(got: list[tuple]) -> pa.RecordBatch:
        row, key, same, same2, place = (np.concatenate(x) for x in zip(*got, strict=True))
        order = np.lexsort((place, row, same2, same, key))
        row, key, same, same2, place = (x[order] for x in (row, key, same, same2, place))
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (same[1:] != same[:-1]) | (same2[1:] != same2[:-1])
        rest = np.stack([row[~new], place[~new]], 1).astype("<i8")
        many = np.diff(np.append(np.arange(0, len(rest), 4096), len(rest)))
        spread = mix(np.arange(len(many), dtype=np.uint64) + (row[:1].astype(np.uint64) if len(row) else U(0)) * STEP[30]).view(np.int64)
        none = np.zeros(len(many), np.int64)
        cols = [(key[new], spread), (same[new], spread), (same2[new], none), (row[new], none), (place[new], none)]
        more = _binaries(rest, np.concatenate((np.zeros(int(new.sum()), np.int64), many * 16)))
        return pa.RecordBatch.from_arrays([*(pa.array(np.concatenate(x)) for x in cols), more], names)

    def run(batches):
        got, held = [], 0
        for batch in batches:
            for cut in slices(batch, "body", SLICE):
                for buf, ids, base in _pieces(cut, length):
                    s, n, d, h, doc = blocks(buf, length)
                    raw = memoryview(np.ascontiguousarray(buf.data))
                    digest = b"".join([hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(s.tolist(), (s + n).tolist(), strict=True)])
                    same = np.frombuffer(digest, "<i8").reshape(-1, 2)
                    start = s - buf.off[doc] + base[doc]
                    got.append((ids[doc], h.view(np.int64), same[:, 0], same[:, 1], (start << 16) | (n << 8) | d))
                    held += buf.size
                if held >= together:
                    yield settle(got)
                    got, held = [], 0
        if got:
            yield settle(got)
        del got
        give_back()

    return run


def whole_keys(batches):
    """Tables of all rows of the keys in them; rows come in order of the key."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column("key").to_numpy()
        cut = int(np.searchsorted(key, key[-1]))
        if held and (cut or key[-1] != last):
            yield pa.Table.from_batches([*held, batch.slice(0, cut)]).combine_chunks()
            held = []
        elif cut:
            yield pa.Table.from_batches([batch.slice(0, cut)])
        held.append(batch.slice(cut))
        last = key[-1]
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


#: What scan says of a block: a repeat as a whole, one of several under its key, alone in its task, and the sign that a key has several.
FULL, SEVERAL, ALONE, SIGN = range(4)


def scan(batches):
    """Of rows in order of (key, same, same2, row, place): repeats as a whole, and the first of equal blocks."""
    for t in whole_keys(batches):
        more = np.frombuffer(binary_parts(t.column("more"))[0].tobytes(), "<i8").reshape(-1, 2).astype(np.int64)
        plain = np.diff(binary_parts(t.column("more"))[1]) == 0
        key, same, same2, row, place = (t.column(x).to_numpy()[plain] for x in ("key", "same", "same2", "row", "place"))
        new_key = np.append(True, key[1:] != key[:-1])[: len(key)]
        first = new_key.copy()
        first[1:] |= (same[1:] != same[:-1]) | (same2[1:] != same2[:-1])
        gid = np.cumsum(new_key) - 1
        several = np.bincount(gid[first], minlength=len(key))[gid] > 1
        kind = np.where(~first, FULL, np.where(several, SEVERAL, ALONE))
        sign = key[new_key & several]
        none, gone = np.zeros(len(sign), np.int64), np.zeros(len(more), np.int64)
        cols = [(kind, none + SIGN, gone + FULL), (row, none, more[:, 0]), (place, none, more[:, 1]), (key, sign, gone)]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in cols], ["kind", "row", "place", "key"])


def settle_alone(batches):
    """Of blocks alone in their task and signs, in order of the key: the blocks whose key has others."""
    for t in whole_keys(batches):
        kind, row, place, key = (t.column(x).to_numpy() for x in ("kind", "row", "place", "key"))
        first = np.append(True, key[1:] != key[:-1])
        at = np.flatnonzero(first)
        gid = np.cumsum(first) - 1
        size = np.diff(np.append(at, len(key)))[gid]
        signed = np.bincount(gid[kind == SIGN], minlength=len(at))[gid] > 0
        ok = (kind == ALONE) & ((size > 1) | signed)
        yield pa.RecordBatch.from_arrays([pa.array(x[ok]) for x in (row, place, key)], ["row", "place", "key"])


def cut_out(length: int, at_once: int = 200_000):
    """The bytes of candidate blocks. Of a key in several parts each window is cut out, under a key of its part and its
    distance from the anchor; of equal windows (of so many) only the earliest, the others are repeats (dist -1, no bytes)."""
    names = ["key", "row", "start", "dist", "body"]

    def cold(data, start, size, dist, key, ids) -> pa.RecordBatch:
        to = np.concatenate(([0], np.cumsum(size)))
        body = data[np.repeat(start - to[:-1], size) + np.arange(to[-1])]
        return pa.RecordBatch.from_arrays([*map(pa.array, (key, ids[0], ids[1], dist)), _binaries(body, size)], names)

    def hot(data, start, size, dist, key, ids, parts) -> pa.RecordBatch:
        many = size - length + 1
        step = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        block = np.repeat(np.arange(len(size)), many)
        window = np.lib.stride_tricks.sliding_window_view(data, length)[start[block] + step]
        same = pa.FixedSizeBinaryArray.from_buffers(pa.binary(length), len(block), [None, pa.py_buffer(np.ascontiguousarray(window))])
        same = same.dictionary_encode().indices.to_numpy().astype(np.int64)
        away, at = dist[block] - step, ids[1][block] + step
        order = np.lexsort((at, ids[0][block], same, away, key[block]))
        new = np.ones(len(order), bool)
        for x in (same, away, key[block]):
            new[1:] &= x[order[1:]] == x[order[:-1]]
        again = np.zeros(len(order), bool)
        again[order[1:]] = new[1:]
        text = TextBuf(window.reshape(-1), np.arange(len(block) + 1) * length)
        part = text.span_hash(text.off[:-1], text.off[1:]) % parts[block].astype(np.uint64)
        own = mix(key[block].view(np.uint64) + part * STEP[31] + away.astype(np.uint64) * STEP[32])
        own = np.where(again, mix(np.arange(len(block), dtype=np.uint64)), own).view(np.int64)
        body = _binaries(window[~again].reshape(-1), np.where(again, 0, length))
        return pa.RecordBatch.from_arrays([*map(pa.array, (own, ids[0][block], at, np.where(again, -1, 0))), body], names)

    def run(batches):
        for batch in batches:
            for cut in slices(batch, "body", SLICE):
                ids = cut.column("row").to_numpy()
                data, off = binary_parts(cut.column("body"))
                spots = cut.column("spots")
                row = np.repeat(np.arange(len(ids)), np.diff(spots.offsets.to_numpy()))
                flat = spots.flatten()
                place, key, parts = (flat.field(j).to_numpy(zero_copy_only=False) for j in range(3))
                start, size, dist = place >> 16, (place >> 8) & 255, place & 255
                for several in (False, True):
                    chosen = np.flatnonzero((parts > 1) == several)
                    turn = np.cumsum(size[chosen] - length + 1) // at_once if several else np.zeros(len(chosen), np.int64)
                    for k in np.unique(turn).tolist():
                        c = chosen[turn == k]
                        args = (data, off[row[c]] + start[c], size[c], dist[c], key[c], (ids[row[c]], start[c]))
                        yield hot(*args, parts[c]) if several else cold(*args)

    return run


class SuffixOrder:
    """Compares suffixes of one buffer by their first ``length`` bytes."""

    def __init__(self, data: np.ndarray, length: int):
        self.data, self.length = data, length
        buf = TextBuf(data, np.array([0, len(data)]))
        self.h, self.down = buf.prefix, powers(len(data) + 1)[1]

    def common(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Bytes that suffixes p and q have in common, by binary search over hashes."""
        h, hp, hq, dp, dq = self.h, self.h[p], self.h[q], self.down[p], self.down[q]
        n = np.zeros(len(p), np.int64)
        step = 1 << (self.length.bit_length() - 1)
        while step:
            t = n + step
            in_reach = t <= self.length
            t = np.minimum(t, self.length)
            n = np.where(in_reach & ((h[p + t] - hp) * dp == (h[q + t] - hq) * dq), t, n)
            step >>= 1
        return n

    def before(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Whether suffix p comes before q; equal ones in the order of their places."""
        n = self.common(p, q)
        same = n >= self.length
        n = np.minimum(n, self.length - 1)
        return np.where(same, p < q, self.data[p + n] < self.data[q + n])

    def sort(self, pos: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
        """pos with each group (first, size) in suffix order: bottom-up merges of all groups in step."""
        pos = pos.copy()
        width = 1
        while len(size) and (wide := size > width).any():
            first, size = first[wide], size[wide]
            total = np.cumsum(size)
            slot = np.arange(total[-1]) - np.repeat(total - size, size)
            base, n = np.repeat(first, size), np.repeat(size, size)
            left = slot // (2 * width) * (2 * width)
            in_left = slot - left < width
            lo = np.where(in_left, np.minimum(left + width, n), left)
            hi = np.where(in_left, np.minimum(left + 2 * width, n), left + width)
            start, mine = lo.copy(), pos[base + slot]
            live = np.flatnonzero(lo < hi)
            while len(live):
                mid = (lo[live] + hi[live]) // 2
                other = self.before(pos[base[live] + mid], mine[live])
                lo[live] = np.where(other, mid + 1, lo[live])
                hi[live] = np.where(other, hi[live], mid)
                live = live[lo[live] < hi[live]]
            rank = np.where(in_left, slot - left, slot - left - width) + (lo - start)
            out = pos.copy()
            out[base + left + rank] = mine
            pos = out
            width *= 2
        return pos


def repeated_windows(data: np.ndarray, off: np.ndarray, dist: np.ndarray, run: np.ndarray, length: int) -> np.ndarray:
    """Starts in the buffer of windows that have an equal one earlier in the buffer, in their run and at their distance."""
    many = np.diff(off) - length + 1
    total = np.cumsum(many)
    step = np.arange(total[-1]) - np.repeat(total - many, many)
    pos = np.repeat(off[:-1], many) + step
    group = np.repeat(run * 512, many) + np.repeat(dist, many) - step
    order = np.argsort(group, kind="stable")
    pos, group = pos[order], group[order]
    first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    size = np.diff(np.append(first, len(pos)))
    view = SuffixOrder(data, length)
    pos = view.sort(pos, first[size > 1], size[size > 1])
    pair = np.flatnonzero(group[1:] == group[:-1])
    p, q = pos[pair], pos[pair + 1]
    equal = view.common(p, q) >= length
    lied = np.zeros(len(pair), bool)
    for at in range(0, len(pair), 50_000):
        part = slice(at, at + 50_000)
        x, y = (np.lib.stride_tricks.sliding_window_view(data, length)[v[part]] for v in (p, q))
        differ = x != y
        n = differ.argmax(1)
        i = np.arange(len(n))
        truly = ~differ[i, n]
        lied[part] = (truly != equal[part]) | (~truly & (x[i, n] > y[i, n])) | (truly & (p[part] > q[part]))
    found = [q[equal & ~np.isin(group[pair], group[pair][lied])]]
    for g in np.unique(group[pair][lied]).tolist():  # a hash lied: this group by its bytes
        seen: set[bytes] = set()
        for x in np.sort(pos[group == g]).tolist():
            text = data[x : x + length].tobytes()
            if text in seen:
                found.append(np.array([x]))
            seen.add(text)
    return np.sort(np.concatenate(found))


def sort_runs(length: int, limit: int = SLICE):
    """Over rows in order of (key, row, start): the spans that candidates lose."""

    def spans(t: pa.Table) -> pa.RecordBatch:
        over = t.column("dist").to_numpy() < 0
        data, off = binary_parts(t.column("body"))
        key, row, start, dist = (t.column(x).to_numpy()[~over] for x in ("key", "row", "start", "dist"))
        gone = [t.column(x).to_numpy()[over] for x in ("row", "start")]
        cols = [gone[0], gone[1], np.full(len(gone[0]), length)]
        if len(key):
            off = np.append(off[:-1][~over], off[-1])
            run = np.cumsum(np.append(False, key[1:] != key[:-1]))
            hit = repeated_windows(data, off, dist, run, length)
            block = np.searchsorted(off, hit, "right") - 1
            new = np.flatnonzero(np.append(True, (np.diff(hit) != 1) | (np.diff(block) != 0))) if len(hit) else np.zeros(0, np.int64)
            last = np.append(new[1:], len(hit))[: len(new)] - 1
            b = block[new]
            more = (row[b], start[b] + hit[new] - off[b], hit[last] - hit[new] + length)
            cols = [np.concatenate(x) for x in zip(cols, more, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in cols], ["row", "start", "size"])

    def run(batches):
        held, size = [], 0
        for t in whole_keys(batches):
            body, key = t.column("body").nbytes, t.column("key").to_numpy()
            if held and size + body > limit:
                yield spans(pa.concat_tables(held).combine_chunks())
                held, size = [], 0
            if body <= limit:
                held.append(t)
                size += body
                continue
            cuts = np.append(np.flatnonzero(key[1:] != key[:-1]) + 1, len(key))
            _, off = binary_parts(t.column("body"))
            at = 0
            while at < len(key):  # as many whole keys as fit, one at least
                later = cuts[cuts > at]
                to = int(max(later[0], later[np.searchsorted(off[later] - off[at], limit, "right") - 1]))
                yield spans(t.slice(at, to - at).combine_chunks())
                at = to
        if held:
            yield spans(pa.concat_tables(held).combine_chunks())
        del held
        give_back()

    return run


def removal_mask(cut: pa.RecordBatch) -> tuple[TextBuf, np.ndarray]:
    data, off = binary_parts(cut.column("_body"))
    buf = TextBuf(data, off)
    edge = np.zeros(buf.size + 1, np.int32)
    spans = cut.column("_spans")
    n = np.diff(spans.offsets.to_numpy())
    flat = spans.flatten()
    if len(flat):
        at = np.repeat(off[:-1], n) + flat.field(0).to_numpy()
        np.add.at(edge, at, 1)
        np.add.at(edge, at + flat.field(1).to_numpy(), -1)
    return buf, np.cumsum(edge[:-1]) > 0


def digest(cut: pa.RecordBatch) -> pa.RecordBatch:
    buf, gone = removal_mask(cut)
    kept = buf.data[~gone]
    size, removed = np.diff(buf.off), buf.per_doc(gone)
    to = np.concatenate(([0], np.cumsum(size - removed))).tolist()
    raw = memoryview(np.ascontiguousarray(kept))
    sha = [hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(to, to[1:], strict=False)]
    _, _, doc = buf.runs(gone)
    n_spans = np.bincount(doc, minlength=buf.n).astype(np.int64)
    cols = [cut.column("doc_id"), pa.array(size), pa.array(removed), pa.array(n_spans), pa.array(sha)]
    return pa.RecordBatch.from_arrays(cols, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def rewrite(names: list[str], text_col: str):
    """Each row with its text without the removed bytes; a character cut in part stays whole."""

    def work(cut: pa.RecordBatch) -> pa.RecordBatch:
        buf, gone = removal_mask(cut)
        if buf.size:
            lead = (buf.data & 0xC0) != 0x80
            at = np.flatnonzero(lead)
            whole = np.logical_and.reduceat(gone, at)
            gone = np.zeros(buf.size, bool)
            gone[at[0] :] = np.repeat(whole, np.diff(np.append(at, buf.size)))
        to = np.concatenate(([0], np.cumsum(np.diff(buf.off) - buf.per_doc(gone)))).astype(np.int32)
        kept = np.ascontiguousarray(buf.data[~gone])
        text = pa.Array.from_buffers(pa.string(), buf.n, [None, pa.py_buffer(to), pa.py_buffer(kept)])
        return pa.RecordBatch.from_arrays([text if c == text_col else cut.column(c) for c in names], names)

    return work


def with_spans(docs: DataFrame, length: int, run: int, text_col: str, together: int = TOGETHER) -> DataFrame:
    """docs with ``_body`` (bytes) for the text and ``_spans``, the repeated passages (start, size) to remove."""
    if not GRAM < length <= 128:
        raise ValueError("length must lie above the gram's 24 bytes and be 128 at most")
    small_batches(docs.sparkSession)
    docs, _ = numbered(docs, "_row", text_col=text_col)
    body = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    wide = docs.withColumn("_body", body).drop(text_col)
    found = docs.select(F.col("_row").alias("row"), body.alias("body"))
    found = found.mapInArrow(find_blocks(length, together), "key long, same long, same2 long, row long, place long, more binary")
    found = found.repartition("key", "same").sortWithinPartitions("key", "same", "same2", "row", "place")
    seen = stash(found.mapInArrow(scan, "kind long, row long, place long, key long"), "blocks")
    alone = seen.where(F.col("kind") >= ALONE).repartition("key").sortWithinPartitions("key")
    candidates = seen.where(F.col("kind") == SEVERAL).select("row", "place", "key")
    candidates = stash(candidates.unionByName(alone.mapInArrow(settle_alone, "row long, place long, key long")), "candidates")
    parts = candidates.groupBy("key").count().where(F.col("count") > run).select("key", F.ceil(F.col("count") / run).alias("parts"))
    candidates = candidates.join(broadcast_small(stash(parts, "parts")), "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    spots = candidates.groupBy(F.col("row").alias("_row")).agg(F.collect_list(F.struct("place", "key", "parts")).alias("spots"))
    cut = cut_out(length)

    def cut_bodies(batches):
        return cut(b.select(["_row", "_body", "spots"]).rename_columns(["row", "body", "spots"]) for b in batches)

    taken = wide.join(spots, "_row")  # this join and the last one read the same exchange of texts
    taken = taken.mapInArrow(cut_bodies, "key long, row long, start long, dist long, body binary")
    taken = taken.repartition("key").sortWithinPartitions("key", "row", "start")
    spans = taken.mapInArrow(sort_runs(length), "row long, start long, size long")
    place = F.col("place")
    whole = seen.where(F.col("kind") == FULL).select("row", F.shiftright(place, 16).alias("start"), F.shiftright(place, 8).bitwiseAND(255).alias("size"))
    spans = whole.unionByName(spans).groupBy(F.col("row").alias("_row")).agg(F.collect_list(F.struct("start", "size")).alias("_spans"))
    joined = wide.join(spans, "_row", "left")
    none = F.array().cast("array<struct<start:bigint,size:bigint>>")
    return joined.withColumn("_spans", F.coalesce("_spans", none))


def repeated_passages(docs: DataFrame, length: int = LENGTH, run: int = RUN, together: int = TOGETHER) -> DataFrame:
    """One row for each row of docs: bytes, removed bytes and runs, SHA-256 of what is left."""
    wide = with_spans(docs.select("doc_id", "text"), length, run, "text", together)
    wide = wide.withColumn("doc_id", F.col("doc_id").cast("long"))
    return wide.mapInArrow(by_slices(digest, "_body"), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame, length: int = LENGTH, run: int = RUN) -> DataFrame:
    """docs, all columns, with the repeated passages cut from the texts; a text may become empty."""
    # Columns are numbered on the way, so that none of the operator's own names can clash with theirs.
    plain = {"doc_id": "doc_id", "text": "text"}
    names = [plain.get(c, f"column {i}") for i, c in enumerate(docs.columns)]
    renamed = docs.toDF(*names)
    wide = with_spans(renamed, length, run, "text")
    return wide.mapInArrow(by_slices(rewrite(names, "text"), "_body"), renamed.schema).toDF(*docs.columns)
