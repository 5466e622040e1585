"""Hierarchical best-fit packing of token sequences.

Partitions pack their own pieces best-fit (longest first) and emit bins that are full or nearly so; the rest travel up a
tree as items, and each node packs the residual bins of its children again. Leaves and nodes read what they get in runs of
RUN items, so their memory is bounded whatever they are dealt; bins that a run leaves underfull meet others in the next round.
The rounds end with a node that holds them all, or once a round saves next to nothing (bins that no bin fits into). No bin is
given up before.
"""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, tokens

#: Children a tree node merges.
FAN_IN = 8
#: Items (pieces, or bins of an earlier round) that are packed at once, and pieces in them at most.
RUN, MOST_PIECES = 16_384, 1 << 18
#: A round that leaves more than this share of the bins it got is the last.
STALE = 0.98
#: A bin with less room than this (in 1/1000 of capacity) is nearly full.
NEARLY = 4
ITEM = "array<struct<doc_id:bigint,piece:int,start:bigint,length:bigint,crc:bigint,offset:bigint>>"
#: Where the level and the node stand in a bin's number.
LEVEL_AT, NODE_AT = 58, 32
BIN = f"bin long, fill int, items {ITEM}"


def best_fit(sizes: list[int], capacity: int) -> list[int]:
    """The bin of each item, items taken in the given order, each into the fullest bin that still takes it. O(items): a bit mask over free room finds the bin."""
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, placed, n = 0, [], 0
    for s in sizes:
        over = mask >> s
        if over:
            room = s + (over & -over).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                mask &= ~(1 << room)
        else:
            room, b, n = capacity, n, n + 1
        placed.append(b)
        left = room - s
        if left:
            by_room[left].append(b)
            mask |= 1 << left
    return placed


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    """(doc_id, piece, start, length, crc) of every document's ids with the end id, cut after each `capacity` ids. Null text is empty: one piece with the end id."""

    def run(batches):
        enc, end = tokens.encoder(tokenizer), int(end_id).to_bytes(4, "little")
        for b in batches:
            rows = []
            for d, raw in zip(b.column(0).to_pylist(), enc.encode_many(common.texts(b.column(1))), strict=True):
                raw += end
                for p, at in enumerate(range(0, len(raw), 4 * capacity)):
                    part = raw[at : at + 4 * capacity]
                    rows.append((d, p, at // 4, len(part) // 4, zlib.crc32(part)))
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "crc"])
        enc.forget()  # the worker stays for other stages

    return docs.select("doc_id", "text").mapInArrow(common.lean(run), "doc_id long, piece int, start long, length long, crc long")


def _pack_partition(capacity: int, level: int, last: bool):
    item_type = pa.list_(pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("crc", pa.int64()), ("offset", pa.int64())]))

    def packed(got: list, first_bin: int):
        got.sort(key=lambda x: (-x[0], (first := x[1][0])["doc_id"] is None, first["doc_id"] or 0, first["piece"], first["crc"]))
        bins: dict[int, list] = {}
        fills: dict[int, int] = {}
        for (size, items), b in zip(got, best_fit([g[0] for g in got], capacity), strict=True):
            at = fills.get(b, 0)
            for i in items:
                i["offset"] += at
            bins.setdefault(b, []).extend(items)
            fills[b] = at + size
        done = [last or capacity - fills[b] <= capacity * NEARLY // 1000 for b in bins]
        return pa.RecordBatch.from_arrays([pa.array([first_bin + b for b in bins], pa.int64()), pa.array([fills[b] for b in bins], pa.int32()), pa.array(list(bins.values()), item_type), pa.array(done, pa.bool_())], ["bin", "fill", "items", "done"])

    def run(batches):
        got, size, at = [], 0, (level << LEVEL_AT) | (TaskContext.get().partitionId() << NODE_AT)
        for b in batches:
            for fill, items in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                got.append((fill, items))
                size += len(items)
                if len(got) >= RUN or size >= MOST_PIECES:
                    out = packed(got, at)
                    yield out
                    got, size, at = [], 0, at + len(out)
        if got:
            yield packed(got, at)

    return run


def pack(spark: SparkSession, cut_pieces: DataFrame, capacity: int, stale: float = STALE) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): each piece's sequence and place in it, gapless from 0.

    Full pieces are sequences by themselves. Sequence numbers are unique, not dense. Deterministic for the same rows in
    the same partitions; ties go by doc_id, piece, checksum. Null doc_ids and repeated rows are packed like any other. No
    pieces: no rows. Rounds end when one leaves more than `stale` of the open bins before it; with 1 they go on until none merge.
    """
    rows = common.cut(spark, cut_pieces, "pieces")
    full = rows.filter(F.col("length") >= capacity).select("doc_id", "piece", "start", "length", F.col("crc").alias("ids_crc32"), (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    level = rows.filter(F.col("length") < capacity).select(F.col("length").cast("int").alias("fill"), F.array(F.struct("doc_id", "piece", "start", "length", "crc", F.lit(0).cast("long").alias("offset"))).alias("items"))
    n, depth, done, waiting = max(1, level.rdd.getNumPartitions()), 1, [], None
    while True:
        last = n == 1 and waiting is not None and waiting <= RUN
        packed = common.cut(spark, level.mapInArrow(common.lean(_pack_partition(capacity, depth, last)), BIN + ", done boolean"), f"bins-{depth}")
        done.append(packed.filter("done").select("bin", "items"))
        if last:
            break
        open_bins = packed.filter("not done")
        left = open_bins.count()
        if left == 0 or (waiting is not None and (left > stale * waiting or left == waiting and n <= -(-left // RUN))):
            done[-1] = packed.select("bin", "items")
            break
        waiting, n, depth = left, max(1, -(-n // FAN_IN), -(-left // RUN)), depth + 1
        node = F.shiftright(F.col("bin").bitwiseAND((1 << LEVEL_AT) - 1), NODE_AT)
        level = open_bins.select("fill", "items", (node % n).cast("int").alias("node")).repartitionById(n, "node").select("fill", "items")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    placed = out.select("bin", F.explode("items").alias("item")).select("item.doc_id", "item.piece", "item.start", "item.length", F.col("item.crc").alias("ids_crc32"), F.col("bin").alias("sequence_id"), "item.offset")
    return full.unionByName(placed)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 4096 ids of word_bpe_49k, each document ended by id 1."""
    docs = common.table(spark, sf_dir, "documents")
    return pack(spark, pieces(docs, "word_bpe_49k.json", 1, 4096), 4096)
