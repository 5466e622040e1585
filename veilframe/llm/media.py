"""Media columns: content-addressed payloads in tar shards.

A text's bytes, padded with zeros to a multiple of 64, are the 8-bit samples of a greyscale PNG of width 64 (lossless).
Each distinct payload is stored once, as the tar member named by its SHA-256; rows carry digest, shard, offset and length.
Width and height come from range reads of the members' headers alone; features come from the samples read back.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WIDTH = 64
PNG = b"\x89PNG\r\n\x1a\n"
#: Signature, IHDR chunk and the head of the first IDAT: all that metadata needs.
HEADER_BYTES = 41
DEFLATE_LEVEL = 4
#: Bytes of stored forms that a task reads at once.
TOGETHER = 1 << 22
FEATURES = "media_digest string, shard string, offset long, length long, width int, height int, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def pad(data: bytes) -> bytes:
    n = max(WIDTH, -(-len(data) // WIDTH) * WIDTH)
    return data + bytes(n - len(data))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_png(payload: bytes) -> bytes:
    """Greyscale, 8 bits, no filter, not interlaced."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    raw = np.zeros((len(rows), WIDTH + 1), np.uint8)
    raw[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return PNG + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(raw.tobytes(), DEFLATE_LEVEL)) + _chunk(b"IEND", b"")


def png_size(head: bytes) -> tuple[int, int]:
    """(width, height) from the first bytes of a file."""
    if head[:8] != PNG or head[12:16] != b"IHDR" or zlib.crc32(head[12:29]) != struct.unpack_from(">I", head, 29)[0]:
        raise ValueError("not a PNG")
    return struct.unpack_from(">II", head, 16)


def from_png(media: bytes) -> bytes:
    width, height = png_size(media)
    at, body = 33, []
    while at < len(media):
        n, kind = struct.unpack_from(">I4s", media, at)
        if struct.unpack_from(">I", media, at + 8 + n)[0] != zlib.crc32(media[at + 4 : at + 8 + n]):
            raise ValueError("bad PNG chunk")
        if kind == b"IDAT":
            body.append(media[at + 8 : at + 8 + n])
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(height, width + 1)
    if rows[:, 0].any():
        raise ValueError("filtered rows")
    return rows[:, 1:].tobytes()


def features(payload: bytes) -> str:
    x = np.frombuffer(payload, np.uint8)
    counts = np.bincount(x, minlength=256)
    p = counts[counts > 0] / len(x)
    down = np.abs(np.diff(x.reshape(-1, WIDTH).astype(np.int16), axis=0)).mean() if len(x) > WIDTH else 0.0
    return f"mean={x.mean():.4f};std={x.std():.4f};entropy={max(0.0, -(p * np.log2(p)).sum()):.4f};zeros={int(counts[0])};vdiff={down:.4f}"


def member(name: str, media: bytes) -> tuple[bytes, int]:
    """A tar member's bytes, and where its payload begins in them."""
    info = tarfile.TarInfo(name)
    info.size = len(media)
    head = info.tobuf(tarfile.USTAR_FORMAT)
    return head + media + bytes(-len(media) % 512), len(head)


def store(media: DataFrame, folder: str) -> DataFrame:
    """Write distinct (digest, media) rows into tar shards; (digest, shard, offset, length) of each. A task's shard has a name of its own in every attempt."""

    def write(batches):
        fs, root = common.filesystem(folder)
        name, at, out = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.tar", 0, None
        seen: set[bytes] = set()
        for b in batches:
            rows = []
            for digest, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                key = bytes.fromhex(digest)
                if key in seen:
                    continue
                seen.add(key)
                data, skip = member(f"{digest}.png", raw)
                if out is None:
                    fs.create_dir(root, recursive=True)
                    out = fs.open_output_stream(f"{root}/{name}")
                out.write(data)
                rows.append((digest, name, at + skip, len(raw)))
                at += len(data)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["media_digest", "shard", "offset", "length"])
        if out is not None:
            out.write(bytes(1024))
            out.close()

    return media.mapInArrow(write, "media_digest string, shard string, offset long, length long")


def _by_shard(batches, folder: str):
    """Each row of (media_digest, shard, offset, ...) with its open shard, in the order in which the shard holds them; about TOGETHER bytes at a time."""
    fs, root = common.filesystem(folder)
    for b in batches:
        rows, shard, f = sorted(b.to_pylist(), key=lambda r: (r["shard"], r["offset"])), None, None
        pairs, size = [], 0
        for r in rows:
            if r["shard"] != shard:
                if f is not None:
                    f.close()
                shard, f = r["shard"], fs.open_input_file(f"{root}/{r['shard']}")
            f.seek(r["offset"])
            pairs.append((r, f.read(r.get("reach", r["length"]))))
            size += len(pairs[-1][1])
            if size >= TOGETHER:
                yield pairs
                pairs, size = [], 0
        if f is not None:
            f.close()
        if pairs:
            yield pairs


def headers(places: DataFrame, folder: str) -> DataFrame:
    """(media_digest, shard, offset, length) with width, height and payload_bytes: range reads of the headers alone."""

    def read(batches):
        for pairs in _by_shard(batches, folder):
            sizes = [png_size(head) for _, head in pairs]
            cols = [pa.array([r[c] for r, _ in pairs]) for c in ("media_digest", "shard", "offset", "length")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([w for w, _ in sizes], pa.int32()), pa.array([h for _, h in sizes], pa.int32()), pa.array([w * h for w, h in sizes], pa.int64())], ["media_digest", "shard", "offset", "length", "width", "height", "payload_bytes"])

    return places.select("media_digest", "shard", "offset", "length", F.lit(HEADER_BYTES).alias("reach")).mapInArrow(read, "media_digest string, shard string, offset long, length long, width int, height int, payload_bytes long")


def fill(places: DataFrame, folder: str) -> DataFrame:
    """Metadata columns from headers(), then the features of the whole stored form, which must be what the row and its header say."""

    def read(batches):
        types = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        for pairs in _by_shard(batches, folder):
            rows = []
            for r, media in pairs:
                payload = from_png(media)
                digest = hashlib.sha256(payload).hexdigest()
                if digest != r["media_digest"] or len(payload) != r["payload_bytes"]:
                    raise ValueError(f"{r['shard']}: payload at {r['offset']} is not {r['media_digest']}")
                rows.append((*(r[c] for c in ("media_digest", "shard", "offset", "length", "width", "height", "payload_bytes")), digest, zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), features(payload)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], [c.split()[0] for c in FEATURES.split(", ")])

    return headers(places, folder).mapInArrow(read, FEATURES)


def encode(docs: DataFrame, repeated: bytes, shared: bool) -> DataFrame:
    """(media_digest, media) of the payloads whose digest may also stand in another row (shared) or surely does not, by the bitmap `repeated`; a task leaves out those it has had."""

    def run(batches):
        bits = np.frombuffer(repeated, np.uint8)
        seen: set[bytes] = set()
        for b in batches:
            payloads = [pad(t.encode("utf-8", "surrogatepass")) for t in common.texts(b.column(0))]
            keys = [hashlib.sha256(p).digest() for p in payloads]
            out = []
            for payload, key, again in zip(payloads, keys, common.maybe_in(bits, np.array([struct.unpack_from(">q", k)[0] for k in keys], np.int64)), strict=True):
                if bool(again) == shared and key not in seen:
                    seen.add(key)
                    out.append((key.hex(), to_png(payload)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.binary()), strict=True)], ["media_digest", "media"])

    return docs.select("text").mapInArrow(run, "media_digest string, media binary")


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media_digest) of every row."""

    def run(batches):
        for b in batches:
            raw = [t.encode("utf-8", "surrogatepass") for t in common.texts(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(r) for r in raw], pa.int64()), pa.array([hashlib.sha256(pad(r)).hexdigest() for r in raw], pa.string())], ["doc_id", "n_bytes", "media_digest"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, media_digest string")


def media_columns(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Every row's doc_id and n_bytes with the columns of its stored payload. Null text is empty: 64 zero bytes. Texts that differ
    only in zero bytes at the end share a payload and so all but n_bytes. A very long text is one payload of as many rows of
    samples. Repeated rows and null doc_ids stay; extra columns are left behind; an empty table has no rows.

    Payloads that occur once are written where they are read. Only those whose digest occurs again (by a bitmap of fixed
    size: some more at most) are brought together, so that each is stored once.
    """
    folder = common.work_dir(spark, "media")
    rows = common.cut(spark, digests(docs), "digests")
    again = rows.groupBy("media_digest").agg(F.count("*").alias("n")).filter("n > 1").select(F.conv(F.substring("media_digest", 1, 16), 16, -10).cast("long").alias("slot"))
    bits = common.bitmap(again, "slot").tobytes()
    moved = encode(docs, bits, True).repartition(common.parts(spark), "media_digest")
    places = common.cut(spark, store(encode(docs, bits, False), folder).unionByName(store(moved, folder)), "places")
    return rows.join(fill(places, folder), "media_digest").select("doc_id", "n_bytes", *[c.split()[0] for c in FEATURES.split(", ") if not c.startswith("media_digest")])


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text as a PNG payload in tar shards, read back."""
    return media_columns(spark, common.table(spark, sf_dir, "documents"))
