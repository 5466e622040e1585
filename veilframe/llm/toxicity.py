"""Toxicity by a counterfactually regularised classifier.

Logistic regression on the words a text holds and on their beginnings. Each labelled text that names a group is written
again with its identity terms swapped for others of their families, and once more without them. Beside the loss on the
labelled texts, training pays for every change of score between a text and these copies of it, so that a neutral mention of a
group does not count.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .langid import remainder

BITS = 20
#: Labelled documents of each class that the classifier is fitted on, about.
SAMPLE = 4000
#: Words kept as features, by evidence in the sample; least documents that a feature stands in.
FEATURES, LEAST = 3000, 4
PREFIXES = (4, 6)
COUNTERFACTUAL, RIDGE, STEPS = 4.0, 2e-3, 300
#: Swapped copies of a labelled text that names a group.
COPIES = 3
#: Families of identity terms; a term is swapped for the next of its family.
IDENTITY = (
    ("women", "men", "girls", "boys", "transgender", "nonbinary"),
    ("woman", "man", "girl", "boy"),
    ("gay", "lesbian", "bisexual", "straight", "queer", "heterosexual"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "sikhs", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "sikh", "atheist"),
    ("black", "white", "asian", "latino", "african", "european", "arab"),
    ("immigrants", "refugees", "foreigners", "citizens", "natives"),
    ("disabled", "blind", "deaf", "autistic"),
    ("old", "young", "elderly", "teenage"),
    ("mexican", "chinese", "indian", "german", "french", "american", "nigerian"),
)
_MARKS = np.zeros(256, bool)
_MARKS[[b for b in range(33, 127) if not (48 <= b < 58 or 65 <= b < 91 or 97 <= b < 123)]] = True


def features(data: np.ndarray, offsets: np.ndarray):
    """For each text the sorted distinct buckets of its words and of their beginnings (PREFIXES bytes long); ASCII marks part words as spaces do, and capitals of Latin-1 count as small letters. Identity terms have no beginnings."""
    for own, _ in _read(data, offsets, False):
        yield own


def _read(data: np.ndarray, offsets: np.ndarray, copies: bool):
    """For each text its features, and with copies those of its counterfactual copies: COPIES swaps of all its identity terms, and the text without them; none where it names no group."""
    data = np.where(_MARKS[data], np.uint8(0x20), data)
    if len(data) > 1:  # U+00C0..U+00DE: capitals of Latin-1 are 0x20 below their small letters
        data[np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)) + 1] += 0x20
    for i, j in common.chunks(offsets):
        raw, own = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        words, at, starts, ends = common.word_spans(raw, own)
        slots = [(words >> np.uint64(64 - BITS)).astype(np.int32)]
        table, hashes, following = _identity()
        term = table[slots[0]]
        maybe = np.flatnonzero(term)
        term[maybe] = np.isin(words[maybe], hashes)
        for n, head in zip(PREFIXES, common.word_heads(raw, starts, PREFIXES), strict=True):
            slot = (head >> np.uint64(64 - BITS)).astype(np.int32)
            slots.append(np.where((ends - starts > n) & ~term, slot, slots[0]))
        for d in range(j - i):
            x, y = at[d], at[d + 1]
            named = np.flatnonzero(term[x:y]) + x if copies else ()
            other = []
            if len(named):
                rest = np.delete(np.arange(x, y), named - x)
                kept = np.concatenate([s[rest] for s in slots])
                turns = [[following[int(h)][t % len(following[int(h)])] for h in words[named]] for t in range(COPIES)]
                other = [np.unique(np.concatenate([kept, np.array(t, np.int32)])) for t in turns] + [np.unique(kept)]
            yield np.unique(np.concatenate([s[x:y] for s in slots])), other


@lru_cache(maxsize=1)
def _identity() -> tuple[np.ndarray, np.ndarray, dict[int, list[int]]]:
    """(buckets that hold an identity term, hashes of the terms, by hash of a term the buckets of the others of its family, in turn)."""
    terms = sorted({w for family in IDENTITY for w in family})
    data = np.frombuffer(" ".join(terms).encode(), np.uint8)
    hashes, _ = common.word_hashes(data, np.array([0, len(data)]))
    slots = (hashes >> np.uint64(64 - BITS)).astype(np.int64)
    of = dict(zip(terms, range(len(terms)), strict=True))
    following = {int(hashes[of[w]]): [int(slots[of[v]]) for v in family[i + 1 :] + family[:i]] for family in IDENTITY for i, w in enumerate(family)}
    table = np.zeros(1 << BITS, bool)
    table[slots] = True
    return table, hashes, following


def _columns(rows: list[np.ndarray], column: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the kept features of rows, on end."""
    row = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r) for r in rows])
    col = column[np.concatenate(rows)] if rows else np.zeros(0, np.int32)
    return row[col >= 0], col[col >= 0]


def train(rows: list[np.ndarray], y: np.ndarray, weight: np.ndarray, copies: list[tuple[int, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, float]:
    """(buckets, their weights, bias). rows: sorted distinct buckets of each text; copies: (row, buckets of a counterfactual copy of it)."""
    flat = np.concatenate(rows) if rows else np.zeros(0, np.int32)
    positive = np.repeat(y > 0, [len(r) for r in rows])
    n1, n0 = max(1, int(y.sum())), max(1, int((1 - y).sum()))
    c1, c0 = np.bincount(flat[positive], minlength=1 << BITS), np.bincount(flat[~positive], minlength=1 << BITS)
    pool = (c1 + c0 + 1) / (n1 + n0 + 2)
    z = np.abs((c1 + 0.5) / (n1 + 1) - (c0 + 0.5) / (n0 + 1)) / np.sqrt(pool * (1 - pool) * (1 / n1 + 1 / n0))
    z[c1 + c0 < LEAST] = 0
    terms = np.flatnonzero(_identity()[0])
    kept = np.union1d(np.argsort(-z, kind="stable")[:FEATURES], terms)
    kept = kept[(z[kept] > 3) | np.isin(kept, terms)]
    del pool, z, positive, flat
    column = np.full(1 << BITS, -1, np.int32)
    column[kept] = np.arange(len(kept))
    doc, cols = _columns(rows, column)
    of = np.array([i for i, _ in copies], np.int64)
    copy, copied = _columns([c for _, c in copies], column)
    w, bias = np.zeros(len(kept)), 0.0
    m, v, mb, vb = np.zeros(len(kept)), np.zeros(len(kept)), 0.0, 0.0
    total, k = weight.sum(), len(kept)
    for t in range(1, STEPS + 1):
        x = np.bincount(doc, w[cols], minlength=len(rows)) + bias
        r = (1 / (1 + np.exp(-x)) - y) * weight / total
        gb = r.sum()
        if len(copies):  # a change of score (in log odds) between a text and a copy
            change = COUNTERFACTUAL / len(copies) * (x[of] - bias - np.bincount(copy, w[copied], minlength=len(copies)))
            r = r + np.bincount(of, change, minlength=len(rows))
            g = np.bincount(cols, r[doc], minlength=k) - np.bincount(copied, change[copy], minlength=k)
        else:
            g = np.bincount(cols, r[doc], minlength=k)
        g = g + RIDGE * w / max(1, k) ** 0.5
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        w -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        bias -= 0.05 * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.99**t)) + 1e-8)
    return kept, w, float(bias)


def fit(docs: DataFrame, labels: DataFrame) -> dict:
    """Learn from the labels given (the caller has left out what may not be learned from) and the texts of docs. A document with several labels counts as toxic if one says so; null labels are left out. The sample, bounded by SAMPLE, is gathered in one task, which trains; weights alone come to the driver."""
    spark = docs.sparkSession
    marked = labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    per = {r.toxic: r.n for r in marked.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = F.when(F.col("toxic") == 1, F.lit(min(1.0, SAMPLE / max(1, per.get(1, 0))))).otherwise(F.lit(min(1.0, SAMPLE / max(1, per.get(0, 0)))))
    some = marked.filter((F.xxhash64(F.col("doc_id"), F.lit("toxic")).bitwiseAND(0xFFFFF) / F.lit(float(1 << 20))) < share).orderBy(F.xxhash64("doc_id"), "doc_id").limit(4 * SAMPLE)
    chosen = {r.doc_id: r.toxic for r in some.collect()}  # bounded by SAMPLE
    ids = spark.sparkContext.broadcast(chosen)

    def read(batches):
        for b in batches:
            keep = [d in ids.value for d in b.column(0).to_pylist()]
            if any(keep):
                got = b.filter(pa.array(keep))
                both = list(_read(*common.utf8(got.column(1)), True))
                raw = lambda f: f.astype("<i4").tobytes()
                yield pa.RecordBatch.from_arrays([got.column(0), pa.array([raw(f) for f, _ in both], pa.binary()), pa.array([[raw(c) for c in other] for _, other in both], pa.list_(pa.binary()))], ["doc_id", "words", "copies"])

    def learn(batches):
        held: dict[int, tuple[bytes, list[bytes]]] = {}
        for b in batches:
            for d, f, c in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if d not in held or (f, c) < held[d]:  # of rows that repeat a doc_id one
                    held[d] = f, c
        order = sorted(held)
        if not order:
            return
        y = np.array([ids.value[d] for d in order], float)
        if y.min() == y.max():
            kept, w, bias = np.zeros(0, np.int64), np.zeros(0), 2.0 if y[0] > 0 else -2.0
        else:
            back = {c: per[c] / max(1, int((y == c).sum())) for c in (0, 1)}  # classes weigh as in all labels
            copies = [(i, np.frombuffer(c, "<i4")) for i, d in enumerate(order) for c in held[d][1]]
            kept, w, bias = train([np.frombuffer(held[d][0], "<i4") for d in order], y, np.where(y == 1, back[1], back[0]), copies)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(kept, -1), pa.int64()), pa.array(np.append(w, bias), pa.float64())], ["bucket", "weight"])

    sample = docs.select("doc_id", "text").mapInArrow(common.lean(read), "doc_id long, words binary, copies array<binary>")
    table, bias = np.zeros(1 << BITS, np.float32), -2.0
    for r in sample.repartition(1).mapInArrow(common.lean(learn), "bucket long, weight double").collect():  # FEATURES and the terms
        if r.bucket < 0:
            bias = r.weight
        else:
            table[r.bucket] = r.weight
    return {"weights": table, "bias": float(bias)}


def score(docs: DataFrame, model: dict, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """The rows with score (0 to 1) and prediction (1 from 0.5 on) under these names after their own columns (which they replace on a clash of names). Null and empty texts get the score of no words; repeated rows stay, each with its score; texts are read whole, however long; a score of 0.5 is toxic; an empty table has no rows."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    own = [c for c in docs.columns if c not in names]
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*[F.col(f"`{c}`") for c in own]).schema)

    def run(batches):
        weights, bias = shared.value["weights"], shared.value["bias"]
        for b in batches:
            x = np.array([weights[f].sum(dtype=float) + bias for f in features(*common.utf8(b.column(b.schema.get_field_index("text"))))], float)
            s = 1 / (1 + np.exp(-np.clip(x, -50, 50)))
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(len(own))], pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32), pa.int32())], [*own, *names])

    return docs.select(*[F.col(f"`{c}`") for c in own]).mapInArrow(common.lean(run), f"{out}, `{names[0]}` double, `{names[1]}` int")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text's toxicity; learned from labels whose crc32(doc_id) mod 5 is not 0. Rows with null doc_id have no label and are not held out."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = common.table(spark, sf_dir, "labels").select("doc_id", "toxic")
    found = score(docs, fit(docs, labels.filter(remainder("doc_id", 5) != 0)))
    return found.select("doc_id", F.coalesce(remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")
