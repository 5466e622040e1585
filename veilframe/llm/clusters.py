"""Exact k-means over whole-number vectors, sped up by Yinyang bounds.

Centroids are put into groups once. A vector keeps an upper bound of the distance to its own centroid and one lower bound a
group of the distance to the group's others; both move with the centroids. A vector whose upper bound is under all its lower
bounds stays where it is (global filter), else only groups whose lower bound is not above it are looked at (group filter), and
their centroids are compared in exact arithmetic. Vectors lie in blocks of rows in the shared folder: a round reads the blocks
and writes them with new bounds and each block's sums, so no vector is ever shuffled; a lost executor costs tasks of one round.
"""

from __future__ import annotations

import hashlib
import heapq
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

CLUSTERS, ROUNDS, WIDTH, SCALE, SEED = 40, 5, 64, 256.0, 2
#: Centroids a group, about; vectors a block.
GROUP, BLOCK = 10, 4096
#: Relative slack of a bound: far more than rounding takes, far less than it matters.
SLACK = 1e-12
LONG = (1 << 63) - 1
SCHEMA = "ids array<bigint>, vecs binary, own binary, upper binary, lower binary, sums binary, far binary, scanned bigint"


def pack(a: np.ndarray) -> bytes:
    """Whole numbers of any size as bytes, in as few bytes a number as fit them."""
    if a.dtype != object:
        most = int(np.abs(a).max(initial=0))
        kind = next(k for k in ("i2", "i4", "i8") if most < 1 << (8 * int(k[1]) - 1))
        return kind.encode() + a.astype(f"<{kind}").tobytes()
    return b"tx" + " ".join(map(str, a.ravel().tolist())).encode()


def unpack(b: bytes, *shape: int) -> np.ndarray:
    if b[:2] != b"tx":
        return np.frombuffer(b, f"<{b[:2].decode()}", offset=2).astype(np.int64).reshape(shape)
    return np.array([int(v) for v in b[2:].split()], object).reshape(shape)


def whole(x: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x) as int64 where products of such numbers are exact in doubles, else as Python's whole numbers."""
    with np.errstate(over="ignore"):
        y = np.floor(scale * x)
    if np.abs(y).max(initial=0) < np.sqrt(2.0**51 / max(1, x.shape[-1])):
        return y.astype(np.int64)
    return np.array([int(v) if np.isfinite(v) else int(u) * int(scale) for v, u in zip(y.ravel().tolist(), x.ravel().tolist(), strict=True)], object).reshape(y.shape)


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of each row of x to each of c."""
    if x.dtype == object or c.dtype == object:
        return np.stack([((x.astype(object) - row.astype(object)) ** 2).sum(axis=1) for row in c], 1)
    a, b = x.astype(float), c.astype(float)
    return ((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)).astype(np.int64)


def apart(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of x to the same rows of c."""
    if x.dtype == object or c.dtype == object:
        x, c = x.astype(object), c.astype(object)
    return ((x - c) ** 2).sum(axis=1)


class Centroids(NamedTuple):
    """Centroids, the group of each, and how far each has come since the bounds were last moved."""

    at: np.ndarray
    group: np.ndarray
    moved: np.ndarray


def grouped(at: np.ndarray) -> np.ndarray:
    """Groups of like centroids, by a few rounds of k-means over the centroids themselves."""
    n = max(1, len(at) // GROUP)
    if at.dtype == object:
        return np.arange(len(at)) % n
    middle = at[np.linspace(0, len(at) - 1, n).astype(int)].astype(float)
    for _ in range(5):
        own = ((at[:, None, :] - middle) ** 2).sum(axis=2).argmin(axis=1)
        middle = np.stack([at[own == g].mean(axis=0) if (own == g).any() else middle[g] for g in range(n)])
    return np.unique(own, return_inverse=True)[1]


class Bounds(NamedTuple):
    own: np.ndarray
    upper: np.ndarray
    lower: np.ndarray


def assign(x: np.ndarray, c: Centroids, old: Bounds | None) -> tuple[Bounds, int]:
    """The nearest centroid of each row (ties: the smaller number) with its bounds, and how many distances were worked out."""
    members = [np.flatnonzero(c.group == g) for g in range(c.group.max() + 1)]
    exact = x.dtype != object and c.at.dtype != object
    root = (lambda d: np.sqrt(d.astype(float))) if exact else (lambda d: np.zeros(d.shape))  # without doubles there are no bounds, and all is scanned
    if old is None or not exact:
        d = squares(x, c.at)
        own = d.argmin(axis=1)
        if not exact:
            return Bounds(own, np.full(len(x), np.inf), np.zeros((len(x), len(members)))), d.size
        upper = root(d[np.arange(len(x)), own]) * (1 + SLACK)
        rest = d.astype(float)
        rest[np.arange(len(x)), own] = np.inf
        return Bounds(own, upper, np.stack([np.sqrt(rest[:, m].min(axis=1)) * (1 - SLACK) for m in members], 1)), d.size
    own, upper = old.own.copy(), (old.upper + c.moved[old.own]) * (1 + SLACK)
    lower = old.lower - np.array([c.moved[m].max() for m in members])
    least = lower.min(axis=1)
    i = np.flatnonzero(~(upper < least))
    scanned = len(i)
    near = np.zeros(len(x), np.int64)
    near[i] = apart(x[i], c.at[own[i]])
    upper[i] = root(near[i]) * (1 + SLACK)
    i = i[~(upper[i] < least[i])]
    before, first = own.copy(), near.copy()
    held = []
    for g, m in enumerate(members):
        j = i[lower[i, g] <= upper[i]]
        if len(j) == 0:
            continue
        d = squares(x[j], c.at[m])
        scanned += d.size
        k = d.argmin(axis=1)
        best, number = d[np.arange(len(j)), k], m[k]
        rest = d.astype(float)
        rest[np.arange(len(j)), k] = np.inf
        held.append((g, j, number, best, rest.min(axis=1)))
        closer = (best < near[j]) | ((best == near[j]) & (number < own[j]))
        own[j[closer]], near[j[closer]] = number[closer], best[closer]
    went = np.flatnonzero(own != before)
    lower[went, c.group[before[went]]] = np.minimum(lower[went, c.group[before[went]]], root(first[went]) * (1 - SLACK))
    upper[went] = root(near[went]) * (1 + SLACK)
    for g, j, number, best, second in held:
        lower[j, g] = np.sqrt(np.where(number == own[j], second, best.astype(float))) * (1 - SLACK)
    return Bounds(own, upper, lower), scanned


def blocks(vectors: DataFrame, width: int, scale: float) -> DataFrame:
    """Blocks of the vectors (vec_id, embedding) that have `width` components, none of them null or not finite, as whole numbers."""

    def run(batches):
        ids, held = [], []

        def out():
            x = np.concatenate(held) if all(h.dtype != object for h in held) else np.concatenate([h.astype(object) for h in held])
            return pa.RecordBatch.from_pydict({"ids": [ids], "vecs": [pack(x)]}, pa.schema([("ids", pa.list_(pa.int64())), ("vecs", pa.binary())]))

        for b in batches:
            lists = b.column(1)
            at = np.flatnonzero(pc.fill_null(pc.equal(pc.list_value_length(lists), width), False).to_numpy(zero_copy_only=False))
            x = pc.fill_null(pc.cast(lists.take(pa.array(at)).flatten(), pa.float64()), float("nan")).to_numpy(zero_copy_only=False).reshape(len(at), width)
            ok = np.isfinite(x).all(axis=1)
            if ok.any():
                ids += b.column(0).take(pa.array(at[ok])).to_pylist()
                held.append(whole(x[ok], scale))
            if len(ids) >= BLOCK:
                yield out()
                ids, held = [], []
        if ids:
            yield out()

    return vectors.select(F.col("vec_id").cast("long"), "embedding").mapInArrow(run, "ids array<bigint>, vecs binary")


def seeds(rows: DataFrame, width: int, k: int, seed: int) -> np.ndarray:
    """The k vectors of the smallest sha256 of `seed:vec_id`, in that order; a null vec_id is written as nothing, and of the same ids the smaller vector comes first."""

    def run(batches):
        best = []
        for b in batches:
            for ids, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                x = unpack(v, len(ids), width)
                keyed = ((hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest(), n) for n, i in enumerate(ids))
                best = heapq.nsmallest(k, best + [(h, x[n].tolist()) for h, n in heapq.nsmallest(k, keyed, key=lambda p: (p[0], x[p[1]].tolist()))])
        if best:
            yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in best]), pa.array([" ".join(map(str, v)) for _, v in best]), pa.array(range(len(best)), pa.int32())], ["h", "v", "n"])

    found = rows.select("ids", "vecs").mapInArrow(run, "h string, v string, n int").orderBy("h", "n").limit(k).collect()
    got = sorted((r.h, [int(v) for v in r.v.split()]) for r in found)
    big = any(abs(v) >= 1 << 31 for _, row in got for v in row)
    x = np.array([row for _, row in got], object if big else np.int64).reshape(len(got), width)
    return whole(x.astype(float), 1.0) if not big else x


def _step(rows: DataFrame, c: Centroids, width: int, last: bool) -> DataFrame:
    """Blocks with their vectors assigned to the nearest of c, and each block's (count, sums) a centroid; the last time also (distance, sum of distances a centroid)."""
    shared = rows.sparkSession.sparkContext.broadcast(c)
    state = "own" in rows.columns

    def run(batches):
        c = shared.value
        k = len(c.at)
        for b in batches:
            for r in b.to_pylist():
                n = len(r["ids"])
                x = unpack(r["vecs"], n, width)
                old = Bounds(np.frombuffer(r["own"], "<i4").astype(int), np.frombuffer(r["upper"], "<f8"), np.frombuffer(r["lower"], "<f8").reshape(n, -1)) if state else None
                new, scanned = assign(x, c, old)
                one = (new.own[None, :] == np.arange(k)[:, None]).astype(x.dtype if x.dtype == object else float)
                sums = np.concatenate([one.sum(axis=1)[:, None], one @ x], 1)
                far = b""
                if last:
                    d = apart(x, c.at[new.own])
                    sums = np.array([sum(d[new.own == j].tolist()) for j in range(k)], object)
                    far = pack(d)
                row = {"ids": r["ids"], "vecs": r["vecs"], "own": new.own.astype("<i4").tobytes(), "upper": new.upper.astype("<f8").tobytes(), "lower": new.lower.astype("<f8").tobytes(), "sums": pack(sums if sums.dtype == object else sums.astype(np.int64)), "far": far, "scanned": scanned}
                yield pa.RecordBatch.from_pydict({name: [v] for name, v in row.items()}, _ARROW)

    return rows.select("ids", "vecs", *(["own", "upper", "lower"] if state else [])).mapInArrow(run, SCHEMA)


_ARROW = pa.schema([("ids", pa.list_(pa.int64())), *((n, pa.binary()) for n in ("vecs", "own", "upper", "lower", "sums", "far")), ("scanned", pa.int64())])


def _total(rows: DataFrame, *shape: int) -> np.ndarray:
    """The sum of the blocks' sums: a table of so many numbers, whatever the number of blocks."""

    def run(batches):
        held = None
        for b in batches:
            for v in b.column(1).to_pylist():
                one = unpack(v, *shape).astype(object)
                held = one if held is None else held + one
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([pack(held)], pa.binary())], ["chunk", "vec"])

    some = rows.select(F.lit(0).alias("chunk"), F.col("sums").alias("vec")).mapInArrow(run, "chunk int, vec binary")
    out = np.zeros(shape, object)
    for r in common.fold_tree(some, run, "chunk int, vec binary").collect():
        out = out + unpack(r.vec, *shape)
    return out


def _moved(old: np.ndarray, new: np.ndarray) -> np.ndarray:
    if old.dtype == object or new.dtype == object:
        return np.full(len(old), np.inf)
    return np.sqrt(apart(old, new).astype(float)) * (1 + SLACK)


def _stored(spark: SparkSession, rows: DataFrame, name: str) -> DataFrame:
    path = common.work_dir(spark, name)
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


class Clustering(NamedTuple):
    """Blocks after the last assignment (own: cluster, far: squared distance), the final centroids, the inertia of each cluster, and the distances worked out in each round."""

    rows: DataFrame
    centroids: np.ndarray
    inertia: list[int]
    scanned: list[int]


def fit(spark: SparkSession, vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, width: int = WIDTH, scale: float = SCALE, seed: int = SEED) -> Clustering | None:
    """Exact k-means of (vec_id, embedding), every vector in every round. None if no vector takes part.

    Vectors that are null, of another length, or with null or non-finite components take no part; a null vec_id does; rows
    that repeat count each; equal distances go to the smaller centroid; fewer vectors than k make fewer centroids; a cluster
    that loses its vectors keeps its centroid. Numbers of any size are exact (beyond those whose products doubles hold exactly,
    in slower arithmetic without bounds). Other columns are left behind.
    """
    now = _stored(spark, blocks(vectors, width, scale), "vectors")
    at = seeds(now, width, k, seed)
    if len(at) == 0:
        return None
    c, scanned = Centroids(at, grouped(at), np.zeros(len(at))), []
    for n in range(rounds + 1):
        then = _stored(spark, _step(now, c, width, n == rounds), "clusters")
        common.drop_tables(spark, now)
        now = then
        scanned.append(now.agg(F.sum("scanned")).first()[0])
        if n < rounds:
            total = _total(now, len(at), 1 + width)
            new = np.array([row[1:] // row[0] if row[0] else old for row, old in zip(total, c.at.astype(object), strict=True)], object)
            new = whole(new.astype(float), 1.0) if np.abs(new).max() < 1 << 31 else new
            c = Centroids(new, c.group, _moved(c.at, new))
    return Clustering(now, c.at, _total(now, len(at)).tolist(), scanned)


def assigned(spark: SparkSession, found: Clustering | None) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector that took part. Numbers over the largest long are the largest long."""
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if found is None:
        return spark.createDataFrame([], schema)
    names = [hashlib.sha256(",".join(map(str, row.tolist())).encode()).hexdigest() for row in found.centroids]
    each, whole_sum = [min(LONG, v) for v in found.inertia], min(LONG, sum(found.inertia))

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                own = np.frombuffer(r["own"], "<i4").tolist()
                far = [min(LONG, v) for v in unpack(r["far"], len(own)).tolist()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(r["ids"], pa.int64()), pa.array(own, pa.int32()), pa.array(far, pa.int64()), pa.array([each[j] for j in own], pa.int64()), pa.array([whole_sum] * len(own), pa.int64()), pa.array([names[j] for j in own])],
                    ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"],
                )

    return found.rows.select("ids", "own", "far").mapInArrow(run, schema)


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five rounds of exact k-means over all embeddings, and every vector's cluster after them."""
    return assigned(spark, fit(spark, common.table(spark, sf_dir, "embeddings")))


def _sql(k: int, rounds: int) -> str:
    """The rounds one after another, every vector against every centroid."""
    near = """a{n} AS (
  SELECT r, any_value(v.vec_id) AS vec_id, any_value(v.v) AS v, min({{'d': list_sum(list_transform(range(1, len(v.v) + 1), lambda i: (v.v[i] - c.c[i]) * (v.v[i] - c.c[i])))::BIGINT, 'j': c.j}}) AS best
  FROM kept v, c{n} c GROUP BY r
)"""
    move = """s{m} AS (
  SELECT j, list(CASE WHEN s % n < 0 THEN (s - (s % n + n)) // n ELSE (s - s % n) // n END ORDER BY i) AS c
  FROM (SELECT best.j AS j, i, sum(v[i])::BIGINT AS s, count(*) AS n FROM a{n}, range(1, 65) t(i) GROUP BY best.j, i) GROUP BY j
), c{m} AS (SELECT c.j, coalesce(s.c, c.c) AS c FROM c{n} c LEFT JOIN s{m} s ON c.j = s.j)"""
    steps = []
    for n in range(rounds + 1):
        steps.append(near.format(n=n))
        if n < rounds:
            steps.append(move.format(n=n, m=n + 1))
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND coalesce(isfinite(x), false)))
), c0 AS (
  SELECT (row_number() OVER (ORDER BY h, v) - 1)::INTEGER AS j, v AS c FROM (SELECT sha256('2:' || coalesce(vec_id::VARCHAR, '')) AS h, v FROM kept ORDER BY h, v LIMIT {k})
), {", ".join(steps)}
SELECT vec_id, best.j AS cluster, best.d AS distance, sum(best.d) OVER (PARTITION BY best.j)::BIGINT AS cluster_inertia, sum(best.d) OVER ()::BIGINT AS inertia, sha256(array_to_string(c.c, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON a.best.j = c.j"""


ORACLE = {"op13_centroid_clustering": _sql(CLUSTERS, ROUNDS)}
