"""N-gram Jaccard join by vertical partitioning.

All shingles stand in one global order: rarer first (by a counting table of fixed size over all documents), ties by hash.
Two sets that are alike enough must share one of the first few shingles of both; such pairs are candidates. The order is
cut into fragments of equal mass, a candidate pair's overlap is counted in each fragment separately, and the counts are
summed per pair and held against the threshold. Before that, pairs go whose overlap cannot be enough: no fragment can hold
more of it than the smaller of the two sets has there, and for this bound the shingles are cut by hash into CELLS finer
fragments. Equal sets meet by their signature and count as one.

No group is expanded into all its pairs. Each set is first compared with one other only, the centre of a group of its
shingles; what is linked so becomes one component. Then only pairs of the same shingle whose ends still lie in different
components are compared, all of them: links inside a component cannot change it.
"""

from __future__ import annotations

import itertools
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .graph import components

#: Counters of the table that orders the shingles: one byte each when broadcast, so 8 MB whatever the input.
COUNTERS_BITS = 23
#: Steps of the order in a doubling of the count.
STEPS = 12
FRAGMENTS = 8
CELLS = 256
_PIECE = 1 << 16
#: What a posting is sent as: token, set, its size, the token's place in its order; and how many wait for each other in a task at least.
_ENTRY, _WAITING = ("<u8", "<i8", "<i4", "<i4"), 1 << 18
_SIGN = np.uint64(0xA0761D6478BD642F)


def set_id(shingles: np.ndarray) -> int:
    """64 bits that stand for a whole set: equal sets are one node, whichever documents they come from."""
    both = np.array([shingles.sum(dtype=np.uint64), common.mix(shingles ^ _SIGN).sum(dtype=np.uint64), len(shingles)], np.uint64)
    return int(common.mix(both[:1] + common.mix(both[1:2] * np.uint64(31) + both[2:])).view(np.int64)[0])


def _cells(shingles: np.ndarray) -> bytes:
    """How many shingles each cell holds, in as few bytes as the largest count needs."""
    c = np.bincount((shingles & np.uint64(CELLS - 1)).astype(np.int64), minlength=CELLS)
    return c.astype("<u1" if c.max() < 256 else "<u4").tobytes()


def possible(pairs: DataFrame, cells: DataFrame, share: int) -> DataFrame:
    """The pairs (a, b, na, nb) whose overlap could be enough by the sum over cells of the smaller count. cells: (sid, cells)."""
    left, right = cells.select(F.col("sid").alias("a"), F.col("cells").alias("ca")), cells.select(F.col("sid").alias("b"), F.col("cells").alias("cb"))

    def counts(blobs: list[bytes]) -> np.ndarray:
        return np.stack([np.frombuffer(x, "<u1" if len(x) == CELLS else "<u4").astype(np.int64) for x in blobs])

    def run(batches):
        for b in batches:
            if not len(b):
                continue
            most = np.minimum(counts(b.column(4).to_pylist()), counts(b.column(5).to_pylist())).sum(axis=1)
            both = b.column(2).to_numpy().astype(np.int64) + b.column(3).to_numpy()
            got = b.filter(pa.array(most * 100 >= share * (both - most), pa.bool_()))
            yield pa.RecordBatch.from_arrays(got.columns[:4], ["a", "b", "na", "nb"])

    return pairs.select("a", "b", "na", "nb").join(left, "a").join(right, "b").select("a", "b", "na", "nb", "ca", "cb").mapInArrow(common.lean(run), "a long, b long, na int, nb int")


def text_key(text: Column) -> Column:
    """Tells apart rows that repeat a doc_id with another text."""
    return F.xxhash64(text)


def _profile(docs: DataFrame, k: int) -> DataFrame:
    """One pass: (doc_id, tkey, n, sid, vec: its cells) of each text, and each task's counts (chunk, vec)."""

    def run(batches):
        counts = np.zeros(1 << COUNTERS_BITS, np.uint32)
        for b in batches:
            n, sid, cells = [], [], []
            held, size = [], 0
            for s in common.shingle_sets(*common.utf8(b.column(1)), k):
                n.append(len(s))
                cells.append(_cells(s))
                sid.append(set_id(s))
                held.append(s)
                size += len(s)
                if size > 1 << 18:
                    np.add.at(counts, np.concatenate(held) >> np.uint64(64 - COUNTERS_BITS), np.uint32(1))
                    held, size = [], 0
            if held:
                np.add.at(counts, np.concatenate(held) >> np.uint64(64 - COUNTERS_BITS), np.uint32(1))
            m = len(n)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n, pa.int32()), pa.array(sid, pa.int64()), pa.nulls(m, pa.int32()), pa.array(cells, pa.binary())], ["doc_id", "tkey", "n", "sid", "chunk", "vec"])
        for c in range(0, len(counts), _PIECE):
            if counts[c : c + _PIECE].any():
                yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.int64()), pa.array([c // _PIECE], pa.int32()), pa.array([zlib.compress(counts[c : c + _PIECE].astype("<u8").tobytes(), 1)], pa.binary())], ["doc_id", "tkey", "n", "sid", "chunk", "vec"])

    return docs.select("doc_id", "text", text_key(F.col("text")).alias("tkey")).mapInArrow(common.lean(run), "doc_id long, tkey long, n int, sid long, chunk int, vec binary")


def _order(profile: DataFrame) -> np.ndarray:
    """The counting table, a byte a counter: the logarithm of the count in STEPS a doubling. Counts come together along a tree; a task holds the chunks it owns."""

    def merge(batches):
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for c, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                got = np.frombuffer(zlib.decompress(v), "<u8")
                held[c] = held[c] + got if c in held else got
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([zlib.compress(v.tobytes(), 1) for v in held.values()], pa.binary())], ["chunk", "vec"])

    def levels(batches):
        for b in batches:
            v = [np.minimum(255, np.round(STEPS * np.log2(1.0 + np.frombuffer(zlib.decompress(x), "<u8")))).astype(np.uint8).tobytes() for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(v, pa.binary())], ["chunk", "vec"])

    table = np.zeros(1 << COUNTERS_BITS, np.uint8)
    counts = common.fold_tree(profile.filter("chunk is not null").select("chunk", "vec"), merge, "chunk int, vec binary")
    for r in counts.mapInArrow(levels, "chunk int, vec binary").collect():  # of fixed size
        table[r.chunk * _PIECE : (r.chunk + 1) * _PIECE] = np.frombuffer(r.vec, np.uint8)
    return table


def pivots(table: np.ndarray) -> np.ndarray:
    """Levels of the table that cut the global order into FRAGMENTS of like mass."""
    mass = np.cumsum(np.bincount(table, minlength=256) * (np.exp2(np.arange(256) / STEPS) - 1))
    return np.unique(np.searchsorted(mass, mass[-1] * np.arange(1, FRAGMENTS) / FRAGMENTS)) if mass[-1] else np.zeros(0, np.int64)


def prefix_length(n: int, share: int) -> int:
    """How many of the first of n shingles must hold one in common with any set alike to share %: n - ceil(n * share / 100) + 1."""
    return n - -(-n * share // 100) + 1


def _postings(spark: SparkSession, docs: DataFrame, k: int, share: int, counts) -> DataFrame:
    """(token, sid, n, at) of the prefix shingles that stand in the prefixes of several sets. Rows travel packed by buckets of the token; equal sets within a batch send one of them."""
    buckets = common.parts(spark)

    def send(batches):
        table = np.frombuffer(counts.value, np.uint8)
        for b in batches:
            tok, doc, size, place, seen = [], [], [], [], set()
            for d, s in zip(b.column(0).to_pylist(), common.shingle_sets(*common.utf8(b.column(1)), k), strict=True):
                if d is None or not len(s) or (sid := set_id(s)) in seen:
                    continue
                seen.add(sid)
                p = prefix_length(len(s), share)
                c = table[(s >> np.uint64(64 - COUNTERS_BITS)).astype(np.int64)]
                if p < len(s):
                    near = np.flatnonzero(c <= np.partition(c, p - 1)[p - 1])
                    near = near[np.lexsort((s[near], c[near]))][:p]
                else:
                    near = np.lexsort((s, c))
                tok.append(s[near])
                doc.append(sid)
                size.append(len(s))
                place.append(len(near))
            if not tok:
                continue
            t = np.concatenate(tok)
            rows = np.zeros(len(t), [("t", "<u8"), ("d", "<i8"), ("n", "<i4"), ("at", "<i4")])
            rows["t"], rows["d"], rows["n"] = t, np.repeat(doc, place), np.repeat(size, place)
            rows["at"] = np.concatenate([np.arange(m) for m in place])
            bucket = (t % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            rows, bucket = rows[order], bucket[order]
            own, first = np.unique(bucket, return_index=True)
            blobs = [b"".join(part[c].tobytes() for c in ("t", "d", "n", "at")) for part in np.split(rows, first[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "rows"])

    def receive(batches):
        # entries go on as soon as their token is known to be shared; only lone tokens wait, so a token that stands everywhere holds nothing up
        lone, shared, waiting, size = [np.zeros(0, kind) for kind in _ENTRY], np.zeros(0, "<u8"), [], 0
        for v in itertools.chain((v for b in batches for v in b.column(1).to_pylist()), [None]):
            if v is not None:
                waiting.append(v)
                size += len(v) // 24
                if size < max(_WAITING, len(lone[0])):
                    continue
            cols = [[c] for c in lone]
            for w in waiting:
                m, at = len(w) // 24, 0
                for c, kind in enumerate(_ENTRY):
                    cols[c].append(np.frombuffer(w, kind, m, at))
                    at += np.dtype(kind).itemsize * m
            waiting, size = [], 0
            t, d, n, p = (np.concatenate(c) for c in cols)
            order = np.argsort(t, kind="stable")
            t = t[order]
            same = np.zeros(len(t) + 1, bool)
            same[1:-1] = t[1:] == t[:-1]
            ours = same[:-1] | same[1:]
            if len(shared):
                ours |= shared[np.minimum(np.searchsorted(shared, t), len(shared) - 1)] == t
            keep, rest = np.flatnonzero(ours), np.flatnonzero(~ours)
            for i in range(0, len(keep), 1 << 16):
                x = keep[i : i + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(t[x].view(np.int64), pa.int64()), pa.array(d[order[x]], pa.int64()), pa.array(n[order[x]], pa.int32()), pa.array(p[order[x]], pa.int32())], ["token", "sid", "n", "at"])
            shared = np.union1d(shared, t[keep])
            lone = [t[rest], d[order[rest]], n[order[rest]], p[order[rest]]]

    return docs.select("doc_id", "text").mapInArrow(common.lean(send), "bucket int, rows binary").repartitionById(buckets, "bucket").mapInArrow(common.lean(receive), "token long, sid long, n int, at int").distinct()


def _segments(docs: DataFrame, k: int, counts, wanted: np.ndarray) -> DataFrame:
    """(sid, fragment, tokens): the shingles of the sets that a bitmap holds, cut at the pivots of the global order; once a set."""

    def run(batches):
        table = np.frombuffer(counts.value, np.uint8)
        cut = pivots(table)
        for b in batches:
            b = b.filter(b.column(0).is_valid())
            node, frag, toks, seen = [], [], [], set()
            for s in common.shingle_sets(*common.utf8(b.column(1)), k):
                if not len(s) or (sid := set_id(s)) in seen or not common.maybe_in(wanted, np.array([sid]))[0]:
                    continue
                seen.add(sid)
                f = np.searchsorted(cut, table[(s >> np.uint64(64 - COUNTERS_BITS)).astype(np.int64)], side="left")
                for x in range(FRAGMENTS):
                    part = s[f == x]
                    if len(part):
                        node.append(sid)
                        frag.append(x)
                        toks.append(part.view(np.int64))
            sizes = np.cumsum([0, *(len(x) for x in toks)])
            values = np.concatenate(toks) if toks else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(frag, pa.int32()), pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(values, pa.int64()))], ["sid", "fragment", "tokens"])

    return docs.select("doc_id", "text").mapInArrow(common.lean(run), "sid long, fragment int, tokens array<bigint>").groupBy("sid", "fragment").agg(F.first("tokens").alias("tokens"))


def verify(pairs: DataFrame, segments: DataFrame, share: int) -> DataFrame:
    """The pairs (a, b, na, nb) whose overlap, counted in each fragment and summed, is at least share % of the union: (u, v)."""
    left = segments.select(F.col("sid").alias("a"), "fragment", F.col("tokens").alias("ta"))
    right = segments.select(F.col("sid").alias("b"), "fragment", F.col("tokens").alias("tb"))
    cut = pairs.withColumn("fragment", F.explode(F.array(*[F.lit(x) for x in range(FRAGMENTS)])))
    partial = cut.join(left, ["a", "fragment"]).join(right, ["b", "fragment"]).select("a", "b", "na", "nb", F.size(F.array_intersect("ta", "tb")).alias("overlap"))
    total = partial.groupBy("a", "b", "na", "nb").agg(F.sum("overlap").alias("overlap"))
    return total.filter(F.col("overlap") * 100 >= share * (F.col("na").cast("long") + F.col("nb") - F.col("overlap"))).select(F.col("a").alias("u"), F.col("b").alias("v"))


def _like_in_size(share: int):
    return F.least("na", "nb").cast("long") * 100 >= F.greatest("na", "nb").cast("long") * share


def _in_reach(share: int):
    """Sets so unlike in size cannot be alike. And alike sets of na and nb shingles have `least` in common, so one of these stands among the first na - least + 1 of one and the first nb - least + 1 of the other: other shared shingles tell nothing."""
    least = F.ceil((F.col("na").cast("long") + F.col("nb")) * share / (100 + share))
    return _like_in_size(share) & (F.col("pa") <= F.col("na") - least) & (F.col("pb") <= F.col("nb") - least)


def join(spark: SparkSession, docs: DataFrame, k: int, share: int) -> DataFrame:
    """(doc_id, n_shingles, component_id, tkey) of every row, tkey from text_key: documents whose sets of distinct k-word shingles have a Jaccard similarity of share % or more are linked.

    Null, empty and wordless texts have no shingles and are linked with nothing; under k words the whole sequence is one
    shingle. component_id is the smallest doc_id reachable. Rows that repeat a doc_id are judged as separate texts; rows
    with null doc_id link nothing and keep null. An empty table gives no rows. Shingles and sets are compared by 64-bit
    hashes.
    """
    profile = common.cut(spark, _profile(docs, k), "profile")
    counts = spark.sparkContext.broadcast(_order(profile).tobytes())  # 8 MB, whatever the input
    sets = profile.filter("chunk is null").select("doc_id", "tkey", "n", "sid")
    cells = profile.filter("chunk is null and n > 0").groupBy("sid").agg(F.max("vec").alias("cells"))
    postings = common.cut(spark, _postings(spark, docs, k, share, counts), "postings")

    done = [postings]

    def linked(pairs: DataFrame, name: str) -> DataFrame:
        near = common.cut(spark, possible(pairs, cells, share), f"{name}-pairs")
        ends = near.select(F.col("a").alias("sid")).union(near.select("b"))
        links = common.cut(spark, verify(near, _segments(docs, k, counts, common.bitmap(ends, "sid")), share), f"{name}-links")
        done.extend((near, links))
        return links

    # each set against one other first: the centre of a group of its shingles that it shares most shingles with. A centre has the fewest rarer
    # shingles before the shared one, so it is the text that the others were made from rather than one of them
    centres = postings.groupBy("token").agg(F.min(F.struct("at", "sid", "n")).alias("c")).select("token", F.col("c.sid").alias("y"), F.col("c.n").alias("ny"))
    star = postings.join(centres, "token").select(F.col("sid").alias("x"), F.col("n").alias("nx"), "y", "ny")
    lower = F.col("x") < F.col("y")
    star = star.filter("x <> y").select("x", "y", F.when(lower, F.col("nx")).otherwise(F.col("ny")).alias("na"), F.when(lower, F.col("ny")).otherwise(F.col("nx")).alias("nb")).filter(_like_in_size(share))
    best = star.groupBy("x", "y", "na", "nb").agg(F.count("*").alias("shared")).groupBy("x").agg(F.max(F.struct("shared", "y", "na", "nb")).alias("best"))
    tried = common.cut(spark, best.select(F.least("x", "best.y").alias("a"), F.greatest("x", "best.y").alias("b"), "best.na", "best.nb").distinct(), "star-tried")
    links = linked(tried, "star")
    near = components(spark, links)

    # what shares a shingle and still lies apart
    placed = common.cut(spark, postings.join(near, postings.sid == near.id, "left").select("token", "sid", "n", "at", F.coalesce("component", "sid").alias("comp")), "placed")
    mixed = placed.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("token")
    rest = placed.join(mixed, "token")
    x, y = rest.select("token", F.col("sid").alias("a"), F.col("n").alias("na"), F.col("at").alias("pa"), F.col("comp").alias("ca")), rest.select("token", F.col("sid").alias("b"), F.col("n").alias("nb"), F.col("at").alias("pb"), F.col("comp").alias("cb"))
    apart = x.join(y, (x.token == y.token) & (x.a < y.b) & (x.ca != y.cb) & _in_reach(share)).select("a", "b", "na", "nb").distinct().join(tried, ["a", "b", "na", "nb"], "left_anti")
    whole = components(spark, links.union(linked(apart, "late")))

    common.drop_tables(spark, tried, placed, *done)  # what is still to be read stands in other tables

    # from sets back to documents
    known = sets.filter("n > 0 and doc_id is not null").join(whole, sets.sid == whole.id, "left").select("doc_id", "tkey", "n", F.coalesce("component", "sid").alias("comp"))
    least = known.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    out = known.join(least, "comp").select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id", "tkey")
    return out.unionByName(sets.filter("n = 0 or doc_id is null").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"), "tkey"))


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents linked by a Jaccard similarity of 85 % or more of their 4-word shingles, by component."""
    return join(spark, common.table(spark, sf_dir, "documents"), 4, 85).drop("tkey")
