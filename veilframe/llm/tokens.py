"""Token ids of whole texts, written as length-delimited binary records and read back.

Record (all little-endian): u64 length of the payload, u32 masked CRC-32 of those 8 bytes, payload, u32 masked CRC-32 of
the payload. Payload: i64 doc_id, u8 bytes an id (2 where every id of the vocabulary fits, else 4), ids. Beside each shard
lies an index of fixed rows (i64 doc_id, u64 offset, u32 n_tokens, u32 CRC-32 of the ids as u32), so that a reader can
shuffle records without reading the shard.
"""

from __future__ import annotations

import itertools
import json
import os
import re
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Chunks of text whose ids a Python worker keeps in each of two generations.
CACHE_CHUNKS = 200_000
LONG_CHUNK = 64
INDEX = np.dtype([("doc_id", "<i8"), ("null", "u1"), ("offset", "<u8"), ("n_tokens", "<u4"), ("crc", "<u4")])
#: Letters, then marks without an apostrophe: one or two pre-tokens, whatever the rest of the text, that no normaliser but lower case changes.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿß]+)([!-&(-/:-@\[-`{-~]*)")
_ENCODERS: dict[str, CachedEncoder] = {}


def chunks_of(text: str) -> list[str]:
    """A text's parts between spaces and line breaks, which no pre-token holds; lower already where that is sure to change nothing (Latin-1 without special tokens): fewer kinds of chunks."""
    if "<|" not in text:
        try:
            text.encode("latin-1")
            text = text.lower()
        except UnicodeEncodeError:
            pass
    return text.replace("\n", " ").replace("\t", " ").split(" ")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return name if os.path.sep in name else public_tokenizers.path(name)


class _Chunks(dict):
    """Ids by chunk of text, in two generations; a chunk not yet known stands for itself and is noted."""

    def __init__(self):
        super().__init__({"": b""})
        self.older: dict[str, bytes] = {}
        self.lost: set[str] = set()

    def __missing__(self, chunk: str):
        known = self.older.get(chunk)
        if known is not None:
            self[chunk] = known
            return known
        self.lost.add(chunk)
        return chunk


class CachedEncoder:
    """encode(text, add_special_tokens=False) of a tokenizers file that drops white space, as ids in u32 bytes.

    No pre-token holds a space or line break, so the parts between them are encoded once each and kept (bounded). Parts of
    plain letters and marks go through the file's model with the pre-tokens already parted and lowered; all others
    through the file's whole pipeline.
    """

    def __init__(self, name: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, models, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(vocabulary(name))
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        model = json.loads(self.tokenizer.to_str())["model"]
        # the same model without the library's cache: every word comes here once
        self.plain = Tokenizer(models.BPE(vocab=model["vocab"], merges=[tuple(m) for m in model["merges"]], end_of_word_suffix=model["end_of_word_suffix"], cache_capacity=0))
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.width = 2 if len(self.ends) <= 1 << 16 else 4
        self.cache = _Chunks()
        self.words: dict[str, bytes] = {"": b""}

    def fill(self, missing) -> None:
        """Encode chunks not yet known. Plain ones share the ids of their words: case and trailing marks make many chunks of one word."""
        if len(self.words) > CACHE_CHUNKS:
            self.words = {"": b""}
        parted, other, words = [], [], self.words
        for w in missing:
            m = _PLAIN.fullmatch(w)
            if m:
                parted.append((w, m[1].lower(), m[2]))
            else:
                other.append(w)
        new = list({x for _, a, b in parted for x in (a, b) if x not in words})
        for i in range(0, len(new), 4096):
            some = new[i : i + 4096]
            ids = np.array(self.plain.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            at = [0, *((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist()]
            raw = ids.tobytes()
            words.update(zip(some, [raw[a:b] for a, b in itertools.pairwise(at)], strict=True))
        self.cache.update((w, words[a] + words[b]) for w, a, b in parted)
        for i in range(0, len(other), 4096):
            some = other[i : i + 4096]
            for w, e in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False), strict=True):
                self.cache[w] = np.array(e.ids, "<u4").tobytes()

    def forget(self) -> None:
        """Let go of the chunks and words kept so far."""
        self.cache, self.words = _Chunks(), {"": b""}

    def encode_many(self, texts: list[str]) -> list[bytes]:
        if len(self.cache) > CACHE_CHUNKS:
            older, self.cache = self.cache, _Chunks()
            self.cache.older = dict(older)
        cache = self.cache
        found = [list(map(cache.__getitem__, chunks_of(t))) for t in texts]
        missing, cache.lost = cache.lost, set()
        self.fill(missing)
        out = [b"".join([v if v.__class__ is bytes else cache[v] for v in f]) for f in found]
        for w in missing:
            if len(w) > LONG_CHUNK:
                del cache[w]
        return out


def encoder(name: str) -> CachedEncoder:
    if name not in _ENCODERS:
        _ENCODERS[name] = CachedEncoder(name)
    return _ENCODERS[name]


def masked(crc: int) -> int:
    return (((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    head = struct.pack("<Q", len(payload))
    return b"".join((head, struct.pack("<I", masked(zlib.crc32(head))), payload, struct.pack("<I", masked(zlib.crc32(payload)))))


FRAME_HEAD = 12


def framed(head: bytes) -> int:
    """How long the record is that begins with these bytes."""
    if len(head) < FRAME_HEAD or struct.unpack_from("<I", head, 8)[0] != masked(zlib.crc32(head[:8])):
        raise ValueError("bad record length")
    return struct.unpack_from("<Q", head)[0] + 16


def unframe(data: memoryview, at: int) -> tuple[bytes, int]:
    """The payload of the record at an offset, and where the next begins; raises on a wrong checksum or a cut record."""
    head = bytes(data[at : at + 8])
    if len(data) < at + 12 or struct.unpack_from("<I", data, at + 8)[0] != masked(zlib.crc32(head)):
        raise ValueError(f"bad record length at {at}")
    n = struct.unpack("<Q", head)[0]
    payload = bytes(data[at + 12 : at + 12 + n])
    if len(data) < at + 16 + n or struct.unpack_from("<I", data, at + 12 + n)[0] != masked(zlib.crc32(payload)):
        raise ValueError(f"bad record at {at}")
    return payload, at + 16 + n


def write_records(docs: DataFrame, folder: str, tokenizer: str, end_id: int | None, shards: int) -> list[dict]:
    """Write the ids of (doc_id, text) in ascending doc_id (ties by text) into shards; returns the manifest, one entry a shard with records.

    Null text is empty (the end id alone); rows with null doc_id come first; repeated rows are each written; a very long text
    is one record; an empty table has no shards. Extra columns are left behind. A shard's name is new in every attempt and only the manifest
    names it, so a task that is lost and run again leaves nothing wrong behind.
    """

    def write(batches):
        enc, end = encoder(tokenizer), b"" if end_id is None else struct.pack("<I", end_id)
        pid = TaskContext.get().partitionId()
        fs, root = common.filesystem(folder)
        name, at, rows, n, out = f"{pid:06d}-{uuid.uuid4().hex}", 0, [], 0, None
        for b in batches:
            for d, raw in zip(b.column(0).to_pylist(), enc.encode_many(common.texts(b.column(1))), strict=True):
                raw += end
                ids = np.frombuffer(raw, "<u4")
                rec = frame(struct.pack("<qBB", d or 0, d is None, enc.width) + (ids.astype("<u2") if enc.width == 2 else ids).tobytes())
                if out is None:
                    fs.create_dir(root, recursive=True)
                    out = fs.open_output_stream(f"{root}/{name}.rec")
                out.write(rec)
                rows.append((d or 0, d is None, at, len(ids), zlib.crc32(raw)))
                at, n = at + len(rec), n + len(ids)
        if out is not None:
            out.close()
            with fs.open_output_stream(f"{root}/{name}.idx") as f:
                f.write(np.array(rows, INDEX).tobytes())
            yield pa.RecordBatch.from_pydict({"shard": pa.array([pid], pa.int32()), "name": [name], "records": pa.array([len(rows)], pa.int64()), "tokens": pa.array([n], pa.int64()), "bytes": pa.array([at], pa.int64())})

    ordered = docs.select("doc_id", "text").repartitionByRange(shards, "doc_id").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())
    found = ordered.mapInArrow(write, "shard int, name string, records long, tokens long, bytes long").collect()  # a row a shard
    return [r.asDict() for r in sorted(found, key=lambda r: r.shard)]


def record(data: memoryview, at: int, row: np.void) -> tuple[int | None, int, int]:
    """(doc_id, number of ids, their checksum) of the record at a place, held against its frame and its entry of the index."""
    payload, _ = unframe(data, at)
    doc, null, width = struct.unpack_from("<qBB", payload)
    ids = np.frombuffer(payload, f"<u{width}", offset=10).astype("<u4")
    if (doc, null, len(ids), crc := zlib.crc32(ids.tobytes())) != (row["doc_id"], row["null"], row["n_tokens"], row["crc"]):
        raise ValueError(f"index and record differ: {doc}")
    return None if null else doc, len(ids), crc


def read_shuffled(spark: SparkSession, folder: str, manifest: list[dict], seed: int) -> DataFrame:
    """(place, doc_id, n_tokens, ids_crc32) of every record in an order drawn by seed, as training reads them: the indexes are shuffled, and each record is then fetched by its offset alone."""

    def entries(batches):
        fs, root = common.filesystem(folder)
        for b in batches:
            for name in b.column(0).to_pylist():
                with fs.open_input_file(f"{root}/{name}.idx") as f:
                    raw = f.read()
                yield pa.RecordBatch.from_pydict({"name": [name] * (len(raw) // INDEX.itemsize), "entry": [raw[i : i + INDEX.itemsize] for i in range(0, len(raw), INDEX.itemsize)]})

    def fetch(batches):
        fs, root = common.filesystem(folder)
        for b in batches:
            out, files = [], {}
            for place, name, raw in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                row = np.frombuffer(raw, INDEX)[0]
                if name not in files:
                    files[name] = fs.open_input_file(f"{root}/{name}.rec")
                f = files[name]
                f.seek(int(row["offset"]))
                head = f.read(FRAME_HEAD)
                out.append((place, *record(memoryview(head + f.read(framed(head) - FRAME_HEAD)), 0, row)))
            for f in files.values():
                f.close()
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in range(4)], ["place", "doc_id", "n_tokens", "ids_crc32"])

    names = spark.createDataFrame([(m["name"],) for m in manifest], "name string").repartition(max(1, min(len(manifest), 4096)))
    drawn = names.mapInArrow(entries, "name string, entry binary").select(F.xxhash64("name", "entry", F.lit(seed)).alias("place"), "name", "entry")
    return drawn.repartitionByRange(common.parts(spark), "place").sortWithinPartitions("place").mapInArrow(fetch, "place long, doc_id long, n_tokens long, ids_crc32 long")


def read_records(spark: SparkSession, folder: str, manifest: list[dict]) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every record of the shards in the manifest's order; checksums are held against the bytes."""
    starts = np.cumsum([0, *(m["tokens"] for m in manifest)]).tolist()
    shards = [(m["name"], s) for m, s in zip(manifest, starts, strict=False)]

    def read(batches):
        fs, root = common.filesystem(folder)
        for b in batches:
            for name, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with fs.open_input_file(f"{root}/{name}.idx") as f:
                    index = np.frombuffer(f.read(), INDEX)
                out = []
                with fs.open_input_file(f"{root}/{name}.rec") as f:
                    for i in range(0, len(index), 1024):
                        some = index[i : i + 1024]
                        first = int(some["offset"][0])
                        last = int(index["offset"][i + 1024]) if i + 1024 < len(index) else f.size()
                        f.seek(first)
                        data = memoryview(f.read(last - first))
                        for row in some:
                            doc, n, crc = record(data, int(row["offset"]) - first, row)
                            out.append((doc, start, n, crc))
                            start += n
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in range(4)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    rows = spark.createDataFrame(shards, "name string, start long").repartition(max(1, min(len(shards), 4096)))
    return rows.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op3_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of word_bpe_49k with end id 2, written as records in ascending doc_id order and read back from the files."""
    docs = common.table(spark, sf_dir, "documents")
    folder = common.work_dir(spark, "token-records")
    manifest = write_records(docs, folder, "word_bpe_49k.json", 2, common.parts(spark))
    return read_records(spark, folder, manifest)
