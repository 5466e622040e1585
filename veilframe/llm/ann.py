"""Approximate nearest neighbours over learned partitions.

The neighbour graph of a bounded sample is cut into equal parts with few edges between them; a small network learns to tell
a vector's part. Rows go to their likeliest part, queries to the several likeliest, and are ranked there by exact cosine.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Vectors the graph is built on, about; neighbours in it; hidden units.
SAMPLE, NEIGHBOURS, HIDDEN = 8192, 10, 96
#: Rows a part holds, about, as long as it has PART_SAMPLE vectors of the sample; but LEAST_PARTS parts wherever the sample has LEAST_SAMPLE vectors for each.
PART_ROWS, PART_SAMPLE, LEAST_PARTS, LEAST_SAMPLE = 512, 64, 8, 12
#: One in HELD of the sample teaches the router nothing: the probes are counted on its neighbours.
HELD = 5
#: Share of the sample's neighbours that the probed parts must hold; fewest parts probed.
AIM, LEAST_PROBES = 0.94, 2
#: Vectors in a block; a part's rows are salted so that a task ranks about SALT_ROWS of them.
ROW_BLOCK, QUERY_BLOCK, SALT_ROWS = 2048, 256, 32_768


def clean(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, float64 vectors) of those that take part, by length: not null, no null or non-finite component, not zero."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    out = []
    for width in np.unique(sizes[sizes > 0]).tolist():
        at = np.flatnonzero(sizes == width)
        x = pc.fill_null(pc.cast(column.take(pa.array(at)).flatten(), pa.float64()), float("nan")).to_numpy(zero_copy_only=False).reshape(len(at), width)
        ok = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
        if ok.any():
            out.append((at[ok], x[ok]))
    return out


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    out = np.zeros((len(x), k), np.int32)
    for i in range(0, len(x), 512):
        s = x[i : i + 512] @ x.T
        s[np.arange(len(s)), np.arange(i, i + len(s))] = -2
        out[i : i + 512] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int) -> np.ndarray:
    """A part of each vector, all of like size: halves by the main direction, then swaps of equal numbers across each cut while that saves edges."""
    label = np.zeros(len(x), int)
    both = np.concatenate([np.stack([np.repeat(np.arange(len(x)), graph.shape[1]), graph.ravel()], 1), np.stack([graph.ravel(), np.repeat(np.arange(len(x)), graph.shape[1])], 1)])
    todo = [(np.arange(len(x)), parts, 0)]
    while todo:
        own, n, first = todo.pop()
        label[own] = first
        if n == 1 or len(own) < 2:
            continue
        y = x[own] - x[own].mean(axis=0)
        axis = np.linalg.svd(y[:: max(1, len(y) // 1024)], full_matrices=False)[2][0]
        side = np.zeros(len(own), bool)
        side[np.argsort(y @ axis, kind="stable")[len(own) * (n // 2) // n :]] = True
        at = np.full(len(x), -1)
        at[own] = np.arange(len(own))
        e = at[both]
        e = e[(e >= 0).all(axis=1)]
        for _ in range(20):
            across = np.bincount(e[:, 0], (side[e[:, 0]] != side[e[:, 1]]).astype(float), minlength=len(own))
            gain = 2 * across - np.bincount(e[:, 0], minlength=len(own))
            a, b = np.flatnonzero(~side & (gain > 0)), np.flatnonzero(side & (gain > 0))
            k = min(len(a), len(b)) // 2
            if k == 0:
                break
            side[a[np.argsort(-gain[a], kind="stable")[:k]]] = True
            side[b[np.argsort(-gain[b], kind="stable")[:k]]] = False
        todo += [(own[~side], n // 2, first), (own[side], n - n // 2, first + n // 2)]
    return label


class Router:
    """A network of one hidden layer over unit vectors."""

    def __init__(self, x: np.ndarray, label: np.ndarray, parts: int):
        rng = np.random.default_rng(7)
        p = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, parts)), np.zeros(parts)]
        scale = np.sqrt(x.shape[1])
        m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
        self.scale, self.p = scale, p
        for t in range(1, 401):
            i = rng.integers(0, len(x), min(1024, len(x)))
            a = x[i] * scale
            h = np.maximum(0, a @ p[0] + p[1])
            o = h @ p[2] + p[3]
            o = np.exp(o - o.max(axis=1, keepdims=True))
            o /= o.sum(axis=1, keepdims=True)
            o[np.arange(len(i)), label[i]] -= 1
            o /= len(i)
            dh = (o @ p[2].T) * (h > 0)
            for k, g in enumerate((a.T @ dh, dh.sum(axis=0), h.T @ o, o.sum(axis=0))):
                m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                p[k] -= 0.01 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)

    def rank(self, x: np.ndarray) -> np.ndarray:
        """Parts, likeliest first."""
        h = np.maximum(0, (x * self.scale) @ self.p[0] + self.p[1])
        return np.argsort(-(h @ self.p[2] + self.p[3]), axis=1, kind="stable")


class Index(NamedTuple):
    """A router over parts (None: one part), how many parts a query probes, and how many salts a part's rows have."""

    router: Router | None
    parts: int
    probes: int
    salts: int


def parts_of(n: int, sample: int) -> int:
    """How many parts n rows have, of which so many are in the sample."""
    if sample < 2 * LEAST_SAMPLE:
        return 1
    return max(min(LEAST_PARTS, sample // LEAST_SAMPLE), min(n // PART_ROWS, sample // PART_SAMPLE))


def fit(vectors: DataFrame, aim: float = AIM, exhaustive: bool = False) -> Index:
    """Parts learned from a sample of (vec_id, embedding), about SAMPLE vectors of its commonest length; parts and salts grow with the rows.

    The router learns from most of the sample; a query probes as many parts as hold `aim` of the neighbours that the rest of the
    sample has among what was learned from. exhaustive: one part, so every vector is compared.
    """
    n = vectors.count()
    some = vectors.filter((F.xxhash64(F.col("vec_id"), F.lit("ann")).bitwiseAND(0xFFFFF) / F.lit(float(1 << 20))) < min(1.0, SAMPLE / max(1, n)))

    def run(batches):
        for b in batches:
            for _, x in clean(b.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array([v.astype("<f8").tobytes() for v in x], pa.binary())], ["v"])

    rows = [np.frombuffer(r.v, "<f8") for r in some.select("embedding").limit(2 * SAMPLE).mapInArrow(run, "v binary").collect()]
    sizes = [len(r) for r in rows]
    width = max(set(sizes), key=lambda w: (sizes.count(w), w)) if sizes else 1
    x = np.unique(np.array([r for r in rows if len(r) == width]).reshape(-1, width), axis=0)
    x = unit(x[np.random.default_rng(11).permutation(len(x))]) if len(x) else x
    asked, taught = x[: len(x) // HELD], x[len(x) // HELD :]
    parts = 1 if exhaustive else parts_of(n, len(taught))
    salts = max(1, -(-n // max(1, parts) // SALT_ROWS))
    if parts < 2:
        return Index(None, 1, 1, salts)
    router = Router(taught, balanced_parts(taught, neighbour_graph(taught, min(NEIGHBOURS, len(taught) - 1)), parts), parts)
    home = router.rank(taught)[:, 0]
    k = min(NEIGHBOURS, len(taught))
    near = np.argpartition(-(asked @ taught.T), k - 1, axis=1)[:, :k]
    need = np.take_along_axis(np.argsort(router.rank(asked), axis=1), home[near], axis=1)  # the place of each neighbour's part in the query's order
    probes = next((m for m in range(1, parts + 1) if (need < m).mean() >= aim), parts)
    return Index(router, parts, min(parts, max(LEAST_PROBES, probes)), salts)


def place(vectors: DataFrame, router: Router | None, probes: int, block: int) -> DataFrame:
    """Blocks of vectors by part: (part, block, width, ids, vecs). With probes > 1 a vector goes to so many parts."""
    shared = vectors.sparkSession.sparkContext.broadcast(router)

    def run(batches):
        held: dict[tuple[int, int], list] = {}

        def out(key):
            rows = held.pop(key)
            return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([rows[0][0] & 0x7FFFFFFF], pa.int64()), pa.array([key[1]], pa.int32()), pa.array([np.array([r[0] for r in rows], "<i8").tobytes()], pa.binary()), pa.array([np.array([r[1] for r in rows], "<f8").tobytes()], pa.binary())], ["part", "block", "width", "ids", "vecs"])

        for b in batches:
            b = b.filter(b.column(0).is_valid())
            for at, x in clean(b.column(1)):
                width, ids = x.shape[1], b.column(0).to_numpy(zero_copy_only=False)[at]
                order = shared.value.rank(unit(x))[:, :probes] if shared.value is not None and width == len(shared.value.p[0]) else np.zeros((len(x), 1), int)
                for i, v, where in zip(ids, x, order, strict=True):
                    for p in where:
                        key = (int(p), width)
                        held.setdefault(key, []).append((int(i), v))
                        if len(held[key]) >= block:
                            yield out(key)
        for key in list(held):
            yield out(key)

    return vectors.select("vec_id", "embedding").mapInArrow(run, "part int, block long, width int, ids binary, vecs binary")


def _best(query_ids, q, ids, x, k: int):
    """Rows (query, vec_id, cosine) of each query's k nearest ids in a block, by exact cosine, ties to the smaller id; all that tie are looked at. A repeated id counts once, by its nearest row."""
    rough = unit(q) @ unit(x).T
    rough[query_ids[:, None] == ids[None, :]] = -np.inf
    by_id = np.argsort(ids, kind="stable")
    first = np.flatnonzero(np.r_[True, np.diff(ids[by_id]) != 0])
    each = rough if len(first) == len(ids) else np.maximum.reduceat(rough[:, by_id], first, axis=1)
    m = min(k, each.shape[1])
    kth = -np.partition(-each, m - 1, axis=1)[:, m - 1]
    a, b = np.nonzero((rough >= kth[:, None] - 1e-9) & np.isfinite(rough))
    qn, xn = np.sqrt((q * q).sum(axis=1)), np.sqrt((x * x).sum(axis=1))
    score = np.concatenate([(q[a[i : i + 65536]] * x[b[i : i + 65536]]).sum(axis=1) for i in range(0, max(1, len(a)), 65536)]) / (qn[a] * xn[b])
    if len(first) < len(ids):
        order = np.lexsort((-score, ids[b], a))
        a, b, score = a[order], b[order], score[order]
        new = np.ones(len(a), bool)
        new[1:] = (np.diff(a) != 0) | (np.diff(ids[b]) != 0)
        a, b, score = a[new], b[new], score[new]
    order = np.lexsort((ids[b], -score, a))
    a, b, score = a[order], b[order], score[order]
    rank = np.arange(len(a)) - np.searchsorted(a, a)
    keep = rank < k
    return query_ids[a[keep]], ids[b[keep]], score[keep]


def search(queries: DataFrame, rows: DataFrame, k: int, salts: int) -> DataFrame:
    """Join blocks by part (rows salted, queries repeated for each salt) and rank: (query_id, vec_id, score). Blocks of rows that meet the same block of queries one after another give k rows a query together."""
    left = queries.select("part", "width", F.col("ids").alias("q_ids"), F.col("vecs").alias("q_vecs"), F.explode(F.array(*[F.lit(s) for s in range(salts)])).alias("salt"))
    right = rows.withColumn("salt", F.pmod(F.xxhash64("ids"), F.lit(salts)).cast("int")).drop("block")
    pairs = left.join(right, ["part", "width", "salt"]).select("width", "q_ids", "q_vecs", "ids", "vecs")

    def run(batches):
        block, best = None, None
        out = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(best, (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["query_id", "vec_id", "score"])
        for b in batches:
            for r in b.to_pylist():
                q, x = (np.frombuffer(r[c], "<f8").reshape(-1, r["width"]) for c in ("q_vecs", "vecs"))
                got = _best(np.frombuffer(r["q_ids"], "<i8"), q, np.frombuffer(r["ids"], "<i8"), x, k)
                if r["q_ids"] == block:
                    best = _merged(best, got, k)
                else:
                    if best is not None:
                        yield out()
                    block, best = r["q_ids"], got
        if best is not None:
            yield out()

    return pairs.mapInArrow(run, "query_id long, vec_id long, score double")


def _merged(a: tuple, b: tuple, k: int) -> tuple:
    """The k nearest a query of two lists (query, vec_id, cosine); a repeated id counts once, by its nearest row."""
    q, v, s = (np.concatenate(c) for c in zip(a, b, strict=True))
    order = np.lexsort((-s, v, q))
    q, v, s = q[order], v[order], s[order]
    new = np.ones(len(q), bool)
    new[1:] = (np.diff(q) != 0) | (np.diff(v) != 0)
    q, v, s = q[new], v[new], s[new]
    order = np.lexsort((v, -s, q))
    q, v, s = q[order], v[order], s[order]
    keep = np.arange(len(q)) - np.searchsorted(q, q) < k
    return q[keep], v[keep], s[keep]


def top(found: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): nearest first, ties to the smaller id; repeated ids count once."""
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("far"), "vec_id"))), 1, k).alias("best"))
    return best.select("query_id", F.posexplode("best").alias("at", "b")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "b.vec_id", (-F.col("b.far")).alias("score"))


def nearest(spark: SparkSession, vectors: DataFrame, queries: DataFrame, k: int, aim: float = AIM, exhaustive: bool = False) -> DataFrame:
    """The k nearest of vectors to each of queries (both vec_id, embedding), the query's own id left out.

    Null ids and vectors that are null, zero or not finite take no part; vectors of another length are compared with
    their like. A query whose parts hold fewer than k others is searched again over all parts.
    """
    router, parts, probes, salts = fit(vectors, aim, exhaustive)
    rows = common.cut(spark, place(vectors, router, 1, ROW_BLOCK), "ann-rows")
    found = common.cut(spark, top(search(place(queries, router, probes, QUERY_BLOCK), rows, k, salts), k), "ann-found")
    if probes == parts:
        return found
    full = found.groupBy("query_id").agg(F.count("*").alias("n")).filter(F.col("n") >= k).select(F.col("query_id").alias("vec_id"))
    short = queries.join(full, "vec_id", "left_anti")
    again = top(search(place(short, router, parts, QUERY_BLOCK), rows, k, salts), k)
    return found.join(full.withColumnRenamed("vec_id", "query_id"), "query_id", "left_semi").unionByName(again)


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest by cosine to each row whose vec_id is divisible by 50."""
    vectors = common.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(spark, vectors, vectors.filter(F.col("vec_id") % 50 == 0), 5)
