"""What the corpus operators share: work folders, lineage cuts, Arrow batches, text hashing."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import time
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in an Arrow batch handed to Python; texts are long, so batches are short.
ARROW_ROWS = 512
#: Bytes of text hashed at once, so that temporary arrays stay small.
CHUNK_BYTES = 1 << 18


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where none is set and all run on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='veilframe-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found if "://" in found or found.startswith("file:") else f"file://{found}"


def work_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/veilframe/{name}-{uuid.uuid4().hex}"


def cut(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write and read again: ends the lineage, and the rows outlive lost executors."""
    path = work_dir(spark, name)
    df.write.parquet(path)
    release(spark)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of plans that nothing holds any more; else they stay until the driver happens to collect its garbage."""
    gc.collect()
    spark._jvm.System.gc()
    time.sleep(0.2)
    spark._jvm.System.gc()


def drop_tables(spark: SparkSession, *frames: DataFrame) -> None:
    """Remove what cut() wrote, once nothing lazy reads it."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for df in frames:
        for f in df.inputFiles()[:1]:
            path = jvm.org.apache.hadoop.fs.Path(f.rsplit("/", 1)[0])
            path.getFileSystem(conf).delete(path, True)


def parts(spark: SparkSession) -> int:
    return max(2, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def filesystem(uri: str):
    """(pyarrow file system, path) of a URI; local and remote stores alike."""
    from pyarrow import fs

    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri)


def lean(task: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The task, after which its worker gives freed memory back: workers stay for later stages, and what each has held at most would add up."""

    def run(batches):
        try:
            yield from task(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
            if trim is not None:
                trim(0)

    return run


def texts(column: pa.Array) -> list[str]:
    return [t or "" for t in column.to_pylist()]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts on end, and the offsets of each; null is empty."""
    if column.null_count:
        column = column.fill_null("")
    if pa.types.is_large_string(column.type):
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    else:
        column = column.cast(pa.string())
        offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of whole documents of about `most` bytes each; a longer document stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWERED = _BYTE[_LOWER]
_LOWERED[_SPACE] = 0
_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {}


def _power(n: int, base: np.uint64, name: str) -> np.ndarray:
    got = _POWERS.get(name)
    if got is None or len(got) < n:
        most = CHUNK_BYTES + (1 << 16)
        got = np.full(max(n, most), base, np.uint64)
        got[0] = 1
        np.cumprod(got, dtype=np.uint64, out=got)
        if n <= most:
            _POWERS[name] = got
    return got[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: every bit depends on every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of the words of texts on end (A-Z lowered, parted by 0x20 and 0x09-0x0D), each text's range of words, and where each word begins and ends.

    Polynomial in the bytes, moved to the word's own start, then mixed: no loop over words.
    """
    n, none = len(data), np.zeros(0, np.int64)
    inside = ~_SPACE[data]
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    edges = offsets[:-1][offsets[:-1] < n]
    before[edges] = False
    after[edges[edges > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    if len(starts) == 0:
        return none.astype(np.uint64), np.zeros(len(offsets), np.int64), none, none
    sums = np.add.reduceat(_LOWERED[data] * _power(n, _BASE, "up"), starts)
    return mix(sums * _power(n, _INV, "down")[starts]), np.searchsorted(starts, offsets), starts, np.flatnonzero(inside & ~after) + 1


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return word_spans(data, offsets)[:2]


def word_heads(data: np.ndarray, starts: np.ndarray, sizes: tuple[int, ...]):
    """For each size the hashes of so many bytes from each start on."""
    sums = np.zeros(len(data) + max(sizes) + 1, np.uint64)
    np.cumsum(_LOWERED[data] * _power(len(data), _BASE, "up"), out=sums[1 : len(data) + 1])
    sums[len(data) + 1 :] = sums[len(data)]
    back = _power(len(data), _INV, "down")[starts]
    for n in sizes:
        yield mix((sums[starts + n] - sums[starts]) * back + np.uint64(n))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its k-word shingles; under k words the whole sequence is one; none without words."""
    for i, j in chunks(offsets):
        words, at = word_hashes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        m = len(words) - k + 1
        if m > 0:
            rolled = np.zeros(m, np.uint64)
            for x in range(k):
                rolled = rolled * np.uint64(0xD6E8FEB86659FD93) + words[x : x + m]
            rolled = mix(rolled)
        for d in range(j - i):
            a, b = int(at[d]), int(at[d + 1])
            if b - a >= k:
                yield np.unique(rolled[a : b - k + 1])
            elif b > a:
                short = np.uint64(b - a)
                for w in words[a:b]:
                    short = mix(np.array([(int(short) * 0xD6E8FEB86659FD93 + int(w)) & 0xFFFFFFFFFFFFFFFF], np.uint64))[0]
                yield np.array([short], np.uint64)
            else:
                yield np.zeros(0, np.uint64)


#: Vectors of one chunk that a task merges at a time, about.
MERGED = 64


def fold_tree(rows: DataFrame, task, schema: str) -> DataFrame:
    """Rows with a chunk brought together by mapInArrow(task): first by chunk and groups of about MERGED of the tasks they come from, then by chunk, so that no task gets a vector from every task of a large input."""
    tasks = rows.rdd.getNumPartitions()
    while tasks > MERGED:
        groups = -(-tasks // MERGED)
        rows = rows.withColumn("_group", F.spark_partition_id() % groups).repartition(16 * groups, "chunk", "_group").drop("_group").mapInArrow(task, schema)
        tasks = groups
    return rows.repartition(16, "chunk").mapInArrow(task, schema)


def merge_vectors(rows: DataFrame, fold: str, dtype: str) -> DataFrame:
    """Rows (chunk int, vec binary) of equal length by chunk to one row a chunk, summed or or-ed. Memory: the vectors of the chunks a task owns; partial sums travel, never rows of the corpus."""

    def per_task(batches):
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for c, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                got = np.frombuffer(v, dtype)
                if c not in held:
                    held[c] = got.copy()
                elif fold == "or":
                    held[c] |= got
                else:
                    held[c] += got
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([v.tobytes() for v in held.values()], pa.binary())], ["chunk", "vec"])

    return fold_tree(rows.select("chunk", "vec"), per_task, "chunk int, vec binary")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of df has."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n = f"_{n}"
        taken.add(n.lower())
        out.append(n)
    return out


BITS = 23


def id_slots(ids: np.ndarray, bits: int = BITS) -> np.ndarray:
    return (mix(ids.astype(np.int64).view(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64)


def bitmap(df: DataFrame, column: str, bits: int = BITS) -> np.ndarray:
    """A bitmap of fixed size (1 MB) that holds every value of a long column and some more: a filter that loses nothing, at any input size."""
    piece = 1 << 16

    def per_task(batches):
        held = np.zeros(1 << bits, bool)
        for b in batches:
            held[id_slots(b.column(0).drop_null().to_numpy(zero_copy_only=False), bits)] = True
        packed = np.packbits(held)
        for c in range(0, len(packed), piece):
            if (v := packed[c : c + piece]).any():
                yield pa.RecordBatch.from_arrays([pa.array([c // piece], pa.int32()), pa.array([v.tobytes()], pa.binary())], ["chunk", "vec"])

    out = np.zeros((1 << bits) // 8, np.uint8)
    for r in merge_vectors(df.select(F.col(column).cast("long")).mapInArrow(lean(per_task), "chunk int, vec binary"), "or", "u1").collect():
        out[r.chunk * piece : r.chunk * piece + len(r.vec)] = np.frombuffer(r.vec, np.uint8)
    return out


def maybe_in(bits: np.ndarray, ids: np.ndarray) -> np.ndarray:
    slots = id_slots(ids, int(len(bits) * 8).bit_length() - 1)
    return (bits[slots >> 3] >> (7 - (slots & 7)).astype(np.uint8)) & 1 != 0
