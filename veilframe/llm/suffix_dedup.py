"""Suffix-array removal of repeated byte strings, built column by column.

A string of LENGTH bytes that also starts in a document with a smaller doc_id is removed where it stands. Which strings
repeat is read off the collection's Burrows-Wheeler transform and longest common prefixes: suffixes in order, runs of
neighbours that share LENGTH bytes, the smallest document of each run.

The transform takes one symbol of every string a round, from the last to the first, so it wants many short strings. The
corpus is cut for it: every LENGTH-byte window belongs to the smallest of its GRAM-byte hashes (its anchor), neighbouring
windows with the same anchor make one segment (at most 2 * LENGTH - GRAM bytes), and equal windows have equal anchors. So
segments are parted by anchor, each part is a collection by itself, and no window is lost. Segments that follow each
other make a block, up to an anchor that ends it. Equal blocks, and equal segments, count once, with the smallest of their
documents; an anchor that stands in one block only (however often that occurs) needs no more than that, so only segments
whose anchors stand in different blocks are transformed.
"""

from __future__ import annotations

import contextlib
import hashlib
import itertools
import os
import tempfile
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

LENGTH, GRAM = 50, 20
#: Stands for an anchor's GRAM bytes inside its segments; no UTF-8 text holds it.
MARK = b"\xfe"
SHORT = LENGTH - GRAM + 1
#: Segments of a block, about.
BLOCK_SEGMENTS = 12
#: Segments of a collection, small enough for its columns to stay near the processor; a larger one (of one anchor) keeps them in temporary files.
BLOCK = 4_000
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BASE2 = np.uint64(0xC2B2AE3D27D4EB4F)
_INV2 = np.uint64(pow(int(_BASE2), -1, 1 << 64))
_BYTE2 = np.random.default_rng(77).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def anchors(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """Segments of texts on end: (text number, first byte of the first window, number of windows, anchor hash, anchor's first byte), in order. data is at most a few MB."""
    n, w = len(data), length - gram + 1
    if not (np.diff(offsets) >= length).any():
        z = np.zeros(0, np.int64)
        return z, z, z, z.astype(np.uint64), z
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(common._BYTE[data] * common._power(n, _BASE, "gram-up"), out=sums[1:])
    h = common.mix((sums[gram:] - sums[:-gram]) * common._power(n, _INV, "gram-down")[: n - gram + 1])
    bits = np.uint64(31)  # for the place, so hashes compare alike in every chunk
    key = ((h >> bits) << bits) | np.arange(len(h), dtype=np.uint64)
    size = 1
    low = key
    while size * 2 <= w:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    if size < w:
        low = np.minimum(low[: len(key) - w + 1], low[w - size : w - size + len(key) - w + 1])
    at = (low & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)  # the anchor's place, for the window that starts here
    fit = np.zeros(n + 1, np.int32)  # windows that end inside their own text
    ends = offsets[1:] - length + 1
    has = ends > offsets[:-1]
    fit[offsets[:-1][has]] += 1
    np.add.at(fit, ends[has], -1)
    ok = np.cumsum(fit)[: len(at)] > 0
    first = ok.copy()
    first[1:] &= ~ok[:-1] | (at[1:] != at[:-1])
    starts_text = offsets[:-1][has]
    first[starts_text] = True
    starts = np.flatnonzero(first)
    stop = ok.copy()
    stop[:-1] &= first[1:] | ~ok[1:]
    counts = np.flatnonzero(stop) - starts + 1
    return np.searchsorted(offsets, starts, side="right") - 1, starts, counts, h[at[starts]], at[starts]


def digests_of(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128-bit digests of byte ranges of data, as two int64 each: polynomials over two bases, moved to the range's start and mixed with its length."""
    out = []
    for table, base, back, name in ((common._BYTE, _BASE, _INV, "gram"), (_BYTE2, _BASE2, _INV2, "second")):
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(table[data] * common._power(len(data), base, f"{name}-up"), out=sums[1:])
        out.append(common.mix((sums[stop] - sums[start]) * common._power(len(data), back, f"{name}-down")[start] + (stop - start).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25)).view(np.int64))
    return out[0], out[1]


def ranges_of(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of ranges on end, and where each ends."""
    sizes = stop - start
    ends = np.cumsum(sizes)
    return data[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(start - (ends - sizes), sizes)], ends


def text_key(raw) -> int:
    """Tells apart rows that repeat a doc_id with another text."""
    return (zlib.crc32(raw) << 31) | (len(raw) & 0x7FFFFFFF)


def _each(batch_ids: pa.Array, batch_texts: pa.Array):
    """Chunks of whole texts: (bytes, offsets, doc_ids, first row)."""
    data, offsets = common.utf8(batch_texts)
    ids = batch_ids.to_pylist()
    for i, j in common.chunks(offsets):
        yield data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], ids[i:j], i


def blocks_of(text: np.ndarray, at: np.ndarray, count: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First segment of each block, and each segment's block: a block ends with its text or with an anchor that says so, so equal passages have equal blocks inside."""
    if not len(a):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.ones(len(a), bool)
    first[1:] = (text[1:] != text[:-1]) | (a[:-1] % np.uint64(BLOCK_SEGMENTS) == 0)
    return np.flatnonzero(first), np.cumsum(first) - 1


def block_ends(text: np.ndarray, at: np.ndarray, count: np.ndarray, a: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte of the first window of blocks, and past that of the last."""
    begins, _ = blocks_of(text, at, count, a)
    last = np.append(begins[1:], len(a)) - 1
    last = last[np.searchsorted(begins, first)]
    return at[first], at[last] + count[last]


def blocks(docs: DataFrame) -> DataFrame:
    """(b1, b2, doc_id, tkey, at, n): every block of every text with at least LENGTH bytes: a 128-bit digest of its bytes, where it stands, and how many windows start in it."""

    def run(batches):
        for b in batches:
            for data, offsets, ids, _ in _each(b.column(0), b.column(1)):
                text, at, count, a, _ = anchors(data, offsets)
                first, _ = blocks_of(text, at, count, a)
                first = first[np.array([d is not None for d in ids], bool)[text[first]]] if None in ids else first
                if not len(first):
                    continue
                start, stop = block_ends(text, at, count, a, first)
                b1, b2 = digests_of(data, start, stop + LENGTH - 1)
                raw = data.tobytes()
                keys = np.array([text_key(raw[x:y]) for x, y in itertools.pairwise(offsets.tolist())], np.int64)
                own = text[first]
                doc = np.array([0 if d is None else d for d in ids], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(b1), pa.array(b2), pa.array(doc[own]), pa.array(keys[own]), pa.array((start - offsets[own]).astype(np.int32)), pa.array((stop - start).astype(np.int32))], ["b1", "b2", "doc_id", "tkey", "at", "n"])

    return docs.select("doc_id", "text").mapInArrow(common.lean(run), "b1 long, b2 long, doc_id long, tkey long, at int, n int")


#: Bytes of a block's digest that go with its anchors. Two blocks that alone share an anchor and agree in all of them would be missed: at 1e11 such pairs 4e-4 are expected.
TAG = 6


def shared_anchors(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(tag, anchors): for each block, by 8 * TAG bits of its digest, the anchors (32 bits of each) that also stand in other blocks, and some more at most.

    Hashes travel packed, by buckets. A batch sends an anchor once for each block, and at most twice in all: two blocks
    settle that it is shared, and what they settle goes straight on, so an anchor that stands everywhere costs a bucket
    two entries a batch.
    """
    buckets = common.parts(spark)

    def send(batches):
        for b in batches:
            out: list[tuple[int, int, int | None, bytes]] = []
            for data, offsets, ids, _ in _each(b.column(0), b.column(1)):
                text, at, count, a, place = anchors(data, offsets)
                first, block = blocks_of(text, at, count, a)
                if not len(first):
                    continue
                start, stop = block_ends(text, at, count, a, first)
                tags = digests_of(data, start, stop + LENGTH - 1)[0].view(np.uint64) & np.uint64((1 << 8 * TAG) - 1)
                known = np.array([d is not None for d in ids], bool)[text]
                a, tag = a[known], tags[block][known]
                order = np.lexsort((tag, a))
                a, tag = a[order], tag[order]
                new = np.ones(len(a), bool)
                new[1:] = (a[1:] != a[:-1]) | (tag[1:] != tag[:-1])
                a, tag = a[new], tag[new]
                if not len(a):
                    continue
                start = np.ones(len(a), bool)
                start[1:] = a[1:] != a[:-1]
                place = np.arange(len(a)) - np.flatnonzero(start)[np.cumsum(start) - 1]
                alone = start & np.append(start[1:], True)
                short = (a >> np.uint64(32)).astype("<u4")
                settled = np.flatnonzero(~alone)
                for x, y in _stretches(tag[settled := settled[np.argsort(tag[settled], kind="stable")]]):
                    out.append((int(tag[settled[x]] % np.uint64(buckets)), 1, int(tag[settled[x]]), short[settled[x:y]].tobytes()))
                pick = np.flatnonzero(place < 2)
                own = (a[pick] % np.uint64(buckets)).astype(np.int64)
                pick, own = pick[o := np.argsort(own, kind="stable")], np.sort(own, kind="stable")
                for x, y in _stretches(own):
                    part = pick[x:y]
                    t = np.ascontiguousarray(tag[part].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :TAG])
                    out.append((int(own[x]), 0, None, short[part].tobytes() + t.tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.int64(), pa.binary()), strict=True)], ["bucket", "kind", "tag", "body"])

    def receive(batches):
        held: dict[int, list[bytes]] = {}
        for b in batches:
            straight = b.filter(pa.array(b.column(1).to_numpy() == 1, pa.bool_()))
            if len(straight):
                yield pa.RecordBatch.from_arrays([straight.column(2), straight.column(3)], ["tag", "anchors"])
            for k, kind, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist(), strict=True):
                if kind == 0:
                    held.setdefault(k, []).append(v)
        for k in list(held):
            h, t = [], []
            for v in held.pop(k):
                m = len(v) // (4 + TAG)
                h.append(np.frombuffer(v, "<u4", m))
                wide = np.zeros((m, 8), np.uint8)
                wide[:, :TAG] = np.frombuffer(v, np.uint8, TAG * m, 4 * m).reshape(m, TAG)
                t.append(wide.view("<u8").ravel())
            h, t = np.concatenate(h), np.concatenate(t)
            o = np.lexsort((t, h))
            h, t = h[o], t[o]
            keep = np.zeros(len(h), bool)
            differ = (h[1:] == h[:-1]) & (t[1:] != t[:-1])
            keep[1:] |= differ
            keep[:-1] |= differ
            run = np.cumsum(np.concatenate([[True], h[1:] != h[:-1]])) - 1
            keep = np.bincount(run, keep)[run] > 0
            h, t = h[keep], t[keep]
            o = np.argsort(t, kind="stable")
            h, t = h[o], t[o]
            cuts = list(_stretches(t))
            for i in range(0, len(cuts), 8192):
                some = cuts[i : i + 8192]
                yield pa.RecordBatch.from_arrays([pa.array(t[[x for x, _ in some]].astype(np.int64), pa.int64()), pa.array([h[x:y].tobytes() for x, y in some], pa.binary())], ["tag", "anchors"])

    sent = docs.select("doc_id", "text").mapInArrow(common.lean(send), "bucket int, kind int, tag long, body binary")
    got = sent.repartitionById(buckets, "bucket").mapInArrow(common.lean(receive), "tag long, anchors binary")
    return got.groupBy("tag").agg(F.collect_list("anchors").alias("anchors"))


def _stretches(x: np.ndarray):
    """(from, to) of each stretch of equal values."""
    if len(x):
        first = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])).tolist()
        yield from zip(first, [*first[1:], len(x)], strict=True)


def _inside(batches, bits: np.ndarray, inside: bool):
    """Batches of (doc_id, ...) cut down to the rows that a bitmap holds, or does not."""
    for b in batches:
        ids = b.column(0).fill_null(0).to_numpy(zero_copy_only=False)
        hit = common.maybe_in(bits, ids) & b.column(0).is_valid().to_numpy(zero_copy_only=False)
        b = b.filter(pa.array(hit == inside, pa.bool_()))
        if len(b):
            yield b


def _wanted(docs: DataFrame, bits: np.ndarray) -> DataFrame:
    """(doc_id, tkey, text) of the documents that a bitmap holds."""

    def run(batches):
        for b in _inside(batches, bits, True):
            data, offsets = common.utf8(b.column(1))
            keys = [text_key(data[x:y]) for x, y in itertools.pairwise(offsets)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys, pa.int64()), b.column(1)], ["doc_id", "tkey", "text"])

    return docs.select("doc_id", "text").mapInArrow(common.lean(run), "doc_id long, tkey long, text string")


def _among(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Which values stand in an ordered array."""
    if not len(ordered):
        return np.zeros(len(values), bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


def _listed(blocks_: pa.ListArray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts with a list of blocks each: where the blocks begin among the bytes of all, in order, their digests, and the texts' listed anchors as ordered keys (number of the text, 32 bits)."""
    own = np.repeat(np.arange(len(blocks_)), pc.fill_null(pc.list_value_length(blocks_), 0).to_numpy())
    at, _, b1, b2, anchors_ = blocks_.flatten().flatten()
    begins = at.to_numpy() + offsets[own]
    order = np.argsort(begins, kind="stable")
    blobs = anchors_.flatten()
    texts = np.repeat(np.repeat(own, pc.list_value_length(anchors_).to_numpy()), pc.binary_length(blobs).to_numpy() // 4)
    keys = (texts.astype(np.uint64) << np.uint64(32)) | np.frombuffer(b"".join(blobs.to_pylist()), "<u4")
    keys.sort()
    return begins[order], b1.to_numpy()[order], b2.to_numpy()[order], keys


def segments(texts: DataFrame) -> DataFrame:
    """(b1, b2, at, k1, k2, anchor, doc_id, body): the segments with listed anchors in the listed blocks of (doc_id, tkey, text, blocks); at: windows before it in its block. All segments of an anchor hold the same GRAM bytes, so body has one MARK for them. body stands with one of equal segments of a batch, that of the smallest document, and is null with the others."""

    def run(batches):
        for b in batches:
            for data, offsets, ids, row in _each(b.column(0), b.column(2)):
                text, at, count, a, place = anchors(data, offsets)
                start, block = blocks_of(text, at, count, a)
                if not len(a):
                    continue
                begins, b1, b2, wanted = _listed(b.column(3).slice(row, len(ids)), offsets)
                own = (text.astype(np.uint64) << np.uint64(32)) | (a >> np.uint64(32))
                hit = np.flatnonzero(_among(own, wanted))
                k = np.searchsorted(begins, at[start[block[hit]]])
                ok = _among(at[start[block[hit]]], begins)
                hit, k = hit[ok], k[ok]
                if not len(hit):
                    continue
                x, y, g = at[hit], at[hit] + count[hit] + LENGTH - 1, place[hit]
                k1, k2 = digests_of(data, x, y)
                doc = np.array(ids, np.int64)[text[hit]]
                order = np.lexsort((doc, k2, k1))
                lead = np.ones(len(hit), bool)
                lead[order[1:]] = (k1[order[1:]] != k1[order[:-1]]) | (k2[order[1:]] != k2[order[:-1]])
                body, ends = ranges_of(np.append(data, np.uint8(MARK[0])), np.stack([x, np.full_like(x, len(data)), g + GRAM], 1)[lead].ravel(), np.stack([g, np.full_like(x, len(data) + 1), y], 1)[lead].ravel())
                sizes = np.zeros(len(hit) + 1, np.int32)
                sizes[1:][lead] = np.diff(np.concatenate([[0], ends[2::3]]))
                bodies = pa.Array.from_buffers(pa.binary(), len(hit), [pa.py_buffer(np.packbits(lead, bitorder="little").tobytes()), pa.py_buffer(np.cumsum(sizes).astype(np.int32).tobytes()), pa.py_buffer(body.tobytes())])
                yield pa.RecordBatch.from_arrays([pa.array(b1[k]), pa.array(b2[k]), pa.array((x - at[start[block[hit]]]).astype(np.int32)), pa.array(k1), pa.array(k2), pa.array(a[hit].view(np.int64)), pa.array(doc), bodies], ["b1", "b2", "at", "k1", "k2", "anchor", "doc_id", "body"])

    return texts.select("doc_id", "tkey", "text", "blocks").mapInArrow(common.lean(run), "b1 long, b2 long, at int, k1 long, k2 long, anchor long, doc_id long, body binary")


class _Columns:
    """Arrays that grow by a round: in memory, or past a bound in temporary files written and read from end to end, removed when done."""

    def __init__(self, strings: int):
        self.folder = tempfile.mkdtemp(prefix="bwt-") if strings > BLOCK else None
        self.turn = 0

    def empty(self, n: int, name: str) -> np.ndarray:
        if self.folder is None:
            return np.empty(n, np.uint8)
        self.turn += 1
        path = f"{self.folder}/{name}-{self.turn}"
        out = np.memmap(path, np.uint8, "w+", shape=(n,))
        os.unlink(path)  # lives as long as it is mapped
        return out

    def close(self) -> None:
        if self.folder is not None:
            with contextlib.suppress(OSError):
                os.rmdir(self.folder)


def transform(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(BWT, LCP) of the strings, each with an end mark of its own: 0 in the BWT, smaller than any byte plus one.

    Round j puts the suffix of length j of every string that has one among the sorted suffixes so far. Its place follows
    from the symbol before the string's last suffix (LF mapping); its common prefixes with its neighbours are one more than
    the least of the common prefixes between the places they come from.
    """
    m = len(strings)
    lengths = np.array([len(s) for s in strings], np.int64)
    flat = np.frombuffer(b"".join(strings), np.uint8)
    ends = np.cumsum(lengths)
    store = _Columns(m)

    def symbol(own: np.ndarray, j: int) -> np.ndarray:
        """The symbol before the suffix of length j; 1 to 255 for bytes (no UTF-8 text holds 0xFF), 0 where the string begins."""
        has = lengths[own] > j
        return np.where(has, flat[np.maximum(ends[own] - j - 1, 0)] + np.uint8(1), np.uint8(0))

    own = np.arange(m)
    bwt, lcp = symbol(own, 0), np.zeros(m, np.uint8)
    at = np.arange(m)
    j = 0
    while True:
        going = bwt[at] != 0
        own, at = own[going], at[going]
        if not len(own):
            break
        j += 1
        n = len(bwt)
        order = np.argsort(bwt, kind="stable")
        order = order[np.searchsorted(bwt[order], 1) if n < 64 else int((bwt == 0).sum()) :]
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(m, m + len(order))
        place = rank[at]
        s = np.argsort(place, kind="stable")
        own, place = own[s], place[s]
        size = m + len(order)
        new = np.zeros(size, bool)
        new[place] = True
        grown, common_ = store.empty(size, "bwt"), store.empty(size, "lcp")
        grown[new] = symbol(own, j)
        old = ~new
        grown[old] = bwt
        common_[old] = lcp
        # the places whose left neighbour is new or that are new themselves
        beside = new.copy()
        beside[1:] |= new[:-1]
        beside[: m + 1] = False
        near = np.flatnonzero(beside)
        q, before = order[near - m], order[near - m - 1]
        like = bwt[q] == bwt[before]
        value = np.zeros(len(near), np.uint8)
        if like.any():
            a, b = before[like] + 1, q[like] + 1
            down = np.argsort(-a, kind="stable")
            ends_of = np.empty(2 * len(down), np.int64)
            ends_of[::2], ends_of[1::2] = a[down], b[down]
            least = np.minimum.reduceat(np.append(lcp, np.uint8(255)), ends_of)[::2]
            got = np.empty(len(down), np.uint8)
            got[down] = np.minimum(least, 253) + 1
            value[like] = got
        common_[near] = value
        common_[m] = 0
        bwt, lcp, at = grown, common_, place
    store.close()
    return bwt, lcp


RUN = np.dtype([("at", "<i4"), ("n", "<i4"), ("doc", "<i8")])


def smallest(strings: list[bytes], docs: np.ndarray, groups: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each string and each window of `length` bytes in it the smallest document of all strings of its group that hold the window, read off the transform: (windows of all strings on end, how many each has).

    Neighbours that share `length` symbols are equal windows; strings of other groups among them are told apart.
    """
    bwt, lcp = transform(strings)
    m = len(strings)
    lengths = np.array([len(s) for s in strings])
    order = np.argsort(bwt, kind="stable")
    order = order[int((bwt == 0).sum()) :]
    forward = np.empty(len(bwt), np.int64)
    forward[order] = np.arange(m, m + len(order))
    run = np.cumsum(lcp < length) - 1
    at, own = np.arange(m), np.arange(m)
    counts = np.maximum(0, lengths - length + 1)
    ends = np.cumsum(counts)
    key, where = np.empty(int(counts.sum()), np.int64), 0
    slot, doc = np.empty(len(key), np.int64), np.empty(len(key), np.int64)
    for j in range(1, int(lengths.max()) + 1):  # from the end marks backwards: the place of each suffix of length j
        go = lengths[own] >= j
        own, at = own[go], forward[at[go]]
        if j >= length:
            to = where + len(own)
            key[where:to], slot[where:to], doc[where:to] = run[at] * (int(groups.max()) + 1) + groups[own], ends[own] - 1 - (j - length), docs[own]
            where = to
    by = np.lexsort((doc, key))
    first = np.ones(len(by), bool)
    first[1:] = key[by][1:] != key[by][:-1]
    flat = np.empty(len(by), np.int64)
    flat[slot[by]] = doc[by][np.flatnonzero(first)][np.cumsum(first) - 1] if len(by) else 0
    return flat, counts


def runs_of(flat: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal neighbours among each string's windows as runs: (runs of all strings on end, how many each has)."""
    ends = np.cumsum(counts)
    first = np.ones(len(flat), bool)
    first[1:] = flat[1:] != flat[:-1]
    first[(ends - counts)[counts > 0]] = True
    start = np.flatnonzero(first)
    out = np.zeros(len(start), RUN)
    own = np.searchsorted(ends, start, side="right")
    out["at"], out["n"], out["doc"] = start - (ends - counts)[own], np.diff(np.append(start, len(flat))), flat[start]
    return out, np.bincount(own, minlength=len(counts))


def windows(spark: SparkSession, strings: DataFrame) -> DataFrame:
    """(k1, k2, least, runs) of segments (k1, k2, anchor, doc_id, body), repeats of which count once with the smallest document: each one's windows' smallest documents, as runs, and in least that document if it is one for all.

    A part holds whole anchors and is transformed in collections of about BLOCK segments; an anchor with one segment only
    has nothing to sort.
    """

    def rows_of(k1: np.ndarray, k2: np.ndarray, runs: np.ndarray, counts: np.ndarray):
        ends = np.cumsum(counts)
        offsets = np.append(0, ends * RUN.itemsize).astype(np.int32)
        lone = runs["doc"][ends - counts]
        blobs = pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(runs.tobytes())])
        return pa.RecordBatch.from_arrays([pa.array(k1), pa.array(k2), pa.array(lone, pa.int64(), mask=counts != 1), blobs], ["k1", "k2", "least", "runs"])

    def run(batches):
        held = [b for b in batches if len(b)]
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        a, k1, k2, doc = (table.column(i).to_numpy() for i in range(4))
        body = table.column(4).chunk(0)
        del held
        order = np.lexsort((doc, k2, k1, a))
        a, k1, k2, doc = a[order], k1[order], k2[order], doc[order]
        lead = np.ones(len(a), bool)
        lead[1:] = (a[1:] != a[:-1]) | (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])
        start = np.flatnonzero(lead)
        with_body = np.maximum.reduceat(np.where(body.is_valid().to_numpy(zero_copy_only=False)[order], order, -1), start)
        a, k1, k2, doc = a[start], k1[start], k2[start], doc[start]
        bodies = body.take(pa.array(with_body))
        cuts = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1], [True]]))
        alone = np.repeat(np.diff(cuts) == 1, np.diff(cuts))
        size = pc.binary_length(bodies).to_numpy()
        single = np.flatnonzero(alone)
        for i in range(0, len(single), 8192):
            some = single[i : i + 8192]
            one = np.zeros(len(some), RUN)
            one["n"], one["doc"] = size[some] - SHORT + 1, doc[some]
            yield rows_of(k1[some], k2[some], one, np.ones(len(some), np.int64))
        first, stop = cuts[:-1][np.diff(cuts) > 1], cuts[1:][np.diff(cuts) > 1]
        i = 0
        while i < len(first):  # whole anchors, about BLOCK segments
            j = max(i + 1, int(np.searchsorted(np.cumsum(stop[i : i + BLOCK] - first[i : i + BLOCK]), BLOCK, side="right")) + i)
            own = np.concatenate([np.arange(x, y) for x, y in zip(first[i:j], stop[i:j], strict=True)])
            number = np.repeat(np.arange(j - i), stop[i:j] - first[i:j])
            yield rows_of(k1[own], k2[own], *runs_of(*smallest(bodies.take(pa.array(own)).to_pylist(), doc[own], number, SHORT)))
            i = j

    return strings.select("anchor", "k1", "k2", "doc_id", "body").repartition(common.parts(spark), "anchor").mapInArrow(common.lean(run), "k1 long, k2 long, least long, runs binary")


def _removals(placed: DataFrame) -> DataFrame:
    """(doc_id, tkey, spans): byte ranges to remove, from block occurrences (doc_id, tkey, at, n, least, parts): least is the block's smallest document, parts its segments' runs."""

    def run(batches):
        for b in batches:
            d, t, at, n, least = (b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(5))
            size = pc.fill_null(pc.list_value_length(b.column(5)), 0).to_numpy()
            whole, rows = np.flatnonzero(size == 0), np.flatnonzero(size > 0)
            owner, lo, hi = whole, at[whole], at[whole] + n[whole]
            if len(rows):
                # the windows of all these blocks on end, with one more between blocks that never goes
                ends = np.cumsum(n[rows] + 1)
                base = ends - n[rows] - 1
                gone = np.repeat(least[rows] < d[rows], n[rows] + 1)
                gone[ends - 1] = False
                part_at, part_runs = b.column(5).flatten().flatten()
                many = pc.binary_length(part_runs).to_numpy() // RUN.itemsize
                part = np.repeat(np.repeat(np.arange(len(rows)), size[rows]), many)
                runs = np.frombuffer(b"".join(part_runs.to_pylist()), RUN)
                m = runs["n"].astype(np.int64)
                first = base[part] + np.repeat(part_at.to_numpy().astype(np.int64), many) + runs["at"]
                gone[np.arange(int(m.sum())) + np.repeat(first - (np.cumsum(m) - m), m)] = np.repeat(runs["doc"] < d[rows][part], m)
                edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]]))).reshape(-1, 2)
                own = np.searchsorted(base, edge[:, 0], side="right") - 1
                shift = at[rows][own] - base[own]
                owner, lo, hi = np.concatenate([owner, rows[own]]), np.concatenate([lo, edge[:, 0] + shift]), np.concatenate([hi, edge[:, 1] + shift])
            if len(owner):
                order = np.argsort(owner, kind="stable")
                each, count = np.unique(owner, return_counts=True)
                pairs = np.stack([lo, hi + LENGTH - 1], axis=1)[order].astype("<i8")
                offsets = np.append(0, np.cumsum(count) * 16).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(d[each]), pa.array(t[each]), pa.Array.from_buffers(pa.binary(), len(each), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(pairs.tobytes())])], ["doc_id", "tkey", "spans"])

    return placed.select("doc_id", "tkey", "at", "n", "least", "parts").mapInArrow(common.lean(run), "doc_id long, tkey long, spans binary").groupBy("doc_id", "tkey").agg(F.collect_list("spans").alias("spans"))


def removed(n: int, spans: list[bytes]) -> np.ndarray:
    """Maximal removed ranges [[from, to], ...] of a text of n bytes."""
    x = np.frombuffer(b"".join(spans), "<i8").reshape(-1, 2)
    x = x[np.argsort(x[:, 0], kind="stable")]
    if not len(x):
        return x
    top = np.maximum.accumulate(x[:, 1])
    first = np.flatnonzero(np.concatenate([[True], x[1:, 0] > top[:-1]]))
    return np.stack([x[first, 0], top[np.append(first[1:], len(x)) - 1]], axis=1)


def spans(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(doc_id, tkey, spans) of the documents that lose bytes, as a written table."""
    placed = common.cut(spark, blocks(docs), "blocks")
    first = common.cut(spark, placed.groupBy("b1", "b2").agg(F.min(F.struct("doc_id", "tkey", "at", "n")).alias("first"), F.count("*").alias("copies")), "distinct-blocks")
    tagged = first.select("b1", "b2", "first.*", F.col("b1").bitwiseAND((1 << 8 * TAG) - 1).alias("tag"))
    listed = tagged.join(shared_anchors(spark, docs), "tag").groupBy("doc_id", "tkey").agg(F.collect_list(F.struct("at", "n", "b1", "b2", "anchors")).alias("blocks"))
    listed = common.cut(spark, listed, "listed-blocks")
    texts = _wanted(docs, common.bitmap(listed, "doc_id")).join(listed, ["doc_id", "tkey"])
    found = common.cut(spark, segments(texts), "segments")
    runs = windows(spark, found.filter("body is not null"))
    inside = found.select("k1", "k2", "b1", "b2", "at", "doc_id").join(runs, ["k1", "k2"]).filter("least is null or least <> doc_id").groupBy("b1", "b2").agg(F.collect_list(F.struct("at", "runs")).alias("parts"))
    known = first.select("b1", "b2", F.col("first.doc_id").alias("least"), "copies").join(inside, ["b1", "b2"], "left").filter("copies > 1 or parts is not null").drop("copies")
    out = common.cut(spark, _removals(placed.join(known, ["b1", "b2"]).filter("parts is not null or least < doc_id")), "spans")
    common.drop_tables(spark, placed, first, listed, found)
    return out


def digests(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row.

    Null text is empty; texts under LENGTH bytes and rows with null doc_id lose nothing. Rows that repeat a doc_id are each
    judged alone: neither counts as smaller. Equal texts: the smallest doc_id keeps all. An empty table has no rows.
    """
    cut = spans(spark, docs)
    bits = common.bitmap(cut, "doc_id")

    def run(batches):
        for b in batches:
            data, offsets = common.utf8(b.column(1))
            lists = b.column(2).to_pylist() if b.num_columns > 2 else [None] * len(b)
            n, gone, count, sha = [], [], [], []
            for x, y, s in zip(offsets[:-1], offsets[1:], lists, strict=True):
                raw = data[x:y]
                r = removed(len(raw), s or [])
                keep, at = hashlib.sha256(), 0
                for p, q in r:
                    keep.update(raw[at:p])
                    at = q
                keep.update(raw[at:])
                n.append(len(raw))
                gone.append(int((r[:, 1] - r[:, 0]).sum()))
                count.append(len(r))
                sha.append(keep.hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(count, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    some = _wanted(docs, bits).join(cut, ["doc_id", "tkey"], "left").select("doc_id", "text", "spans")
    rest = docs.select("doc_id", "text").mapInArrow(common.lean(lambda batches: run(_inside(batches, bits, False))), schema)  # one worker a task
    return some.mapInArrow(common.lean(run), schema).unionByName(rest)


def rewrite(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The rows of docs, in their own columns, with what repeats taken out of text. A character that is cut through goes as a whole; a row whose text is used up goes; n_chars, where there is one, follows the text. Null and empty texts, those under LENGTH bytes and rows with null doc_id stay as they are; rows that repeat a doc_id are each judged alone; an empty table stays empty."""
    cut = spans(spark, docs)
    bits = common.bitmap(cut, "doc_id")
    names, schema = docs.columns, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    at, (own_id, own_key, own_spans) = names.index("text"), common.fresh(docs, "_vf_id", "_vf_key", "_vf_spans")

    def split(inside: bool):
        def run(batches):
            for b in batches:
                ids = b.column(b.schema.get_field_index("doc_id"))
                hit = common.maybe_in(bits, ids.fill_null(0).to_numpy(zero_copy_only=False)) & ids.is_valid().to_numpy(zero_copy_only=False)
                b = b.filter(pa.array(hit == inside, pa.bool_()))
                if not inside:
                    yield b
                elif len(b):
                    data, offsets = common.utf8(b.column(at))
                    ids = b.column(b.schema.get_field_index("doc_id")).cast(pa.int64())
                    keys = pa.array([text_key(data[x:y]) for x, y in zip(offsets[:-1], offsets[1:], strict=True)], pa.int64())
                    yield pa.RecordBatch.from_arrays([*b.columns, ids, keys], [*names, own_id, own_key])

        return run

    def finish(batches):
        for b in batches:
            data, offsets = common.utf8(b.column(at))
            texts, stay = [], []
            for x, y, s in zip(offsets[:-1], offsets[1:], b.column(len(names)).to_pylist(), strict=True):
                raw, last, left = data[x:y], 0, []
                for p, q in removed(len(raw), s or []):
                    left.append(raw[last:p].tobytes().decode("utf-8", "ignore"))
                    last = q
                left.append(raw[last:].tobytes().decode("utf-8", "ignore"))
                texts.append("".join(left))
                stay.append(bool(texts[-1]) or y == x)
            cols = list(b.columns[: len(names)])
            cols[at] = pa.array([t if v else None for t, v in zip(texts, b.column(at).is_valid().to_pylist(), strict=True)], b.schema.field(at).type)
            if "n_chars" in names:
                i = names.index("n_chars")
                cols[i] = pa.array([n if not s else len(t) for t, s, n in zip(texts, b.column(len(names)).to_pylist(), cols[i].to_pylist(), strict=True)], pa.int64()).cast(b.schema.field(i).type)
            yield pa.RecordBatch.from_arrays(cols, names).filter(pa.array(stay, pa.bool_()))

    some = docs.mapInArrow(common.lean(split(True)), f"{schema}, {own_id} long, {own_key} long")
    spanned = cut.select(F.col("doc_id").alias(own_id), F.col("tkey").alias(own_key), F.col("spans").alias(own_spans))
    some = some.join(spanned, [own_id, own_key], "left").select(*[F.col(f"`{c}`") for c in names], own_spans)
    return some.mapInArrow(common.lean(finish), schema).unionByName(docs.mapInArrow(common.lean(split(False)), schema))


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text without the bytes of 50-byte strings that also start in a document with a smaller doc_id."""
    return digests(spark, common.table(spark, sf_dir, "documents"))
