"""Language identification by nearest centroid.

A text's bytes (letters lowered, the rest a space) give 2- and 3-grams, hashed to DIMS counts; weights are TF-IDF, vectors
normalised. Each language has up to CENTROIDS clustered centroids; a text takes the language of the nearest by cosine and
is rejected if that is farther than almost any text of that language and length that was learned from.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

DIMS = 4096
CENTROIDS = 4
#: Documents a language's centroids are fitted on, about; the document frequencies take all learnable rows.
SAMPLE = 800
#: A text is rejected if its cosine is below this share of the QUANTILE cosine of its language's texts of like length.
REJECT_SHARE, QUANTILE = 0.75, 0.002
#: The longest length bucket whose limit is learned from pieces of longer texts where too few texts (under FEW) have that length.
SHORT, FEW = 3, 20
_LETTER = re.compile(r"[^\W\d_]")

_MAP = np.full(256, 0x20, np.uint8)
_MAP[97:123] = np.arange(97, 123)
_MAP[65:91] = np.arange(97, 123)
_MAP[128:] = np.arange(128, 256)
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[[*range(65, 91), *range(97, 123)]] = True


def remainder(doc_id: str, n: int) -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % n


def counts(data: np.ndarray, offsets: np.ndarray):
    """For each text its DIMS n-gram counts."""
    for i, j in common.chunks(offsets):
        raw = data[offsets[i] : offsets[j]]
        low = _MAP[raw]
        if len(low) > 1:  # U+00C0..U+00DE: capitals of Latin-1 are 0x20 below their small letters
            up = np.flatnonzero((low[:-1] == 0xC3) & (low[1:] >= 0x80) & (low[1:] <= 0x9E)) + 1
            low[up] += 0x20
        x = low.astype(np.uint32)
        two = (x[:-1] << np.uint32(8)) | x[1:] if len(x) > 1 else np.zeros(0, np.uint32)
        three = (two[:-1] << np.uint32(8)) | x[2:] if len(x) > 2 else np.zeros(0, np.uint32)
        h2 = ((two * np.uint32(2654435761)) >> np.uint32(20)).astype(np.int32)
        h3 = (((three ^ np.uint32(0x5BD1E995)) * np.uint32(2246822519)) >> np.uint32(20)).astype(np.int32)
        for d in range(i, j):
            a, b = offsets[d] - offsets[i], offsets[d + 1] - offsets[i]
            yield np.bincount(h3[a : max(a, b - 2)], minlength=DIMS) + np.bincount(h2[a : max(a, b - 1)], minlength=DIMS)


def vectors(rows: list[np.ndarray], idf: np.ndarray) -> np.ndarray:
    x = np.log1p(np.array(rows, np.float32)) * idf
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.maximum(norm, 1e-12)


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Over all rows given: DIMS document frequencies and the number of texts."""

    def run(batches):
        df = np.zeros(DIMS + 1, np.int64)
        for b in batches:
            for c in counts(*common.utf8(b.column(0))):
                df[:DIMS] += c > 0
                df[DIMS] += 1
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([df.tobytes()], pa.binary())], ["chunk", "vec"])

    rows = common.merge_vectors(docs.select("text").mapInArrow(common.lean(run), "chunk int, vec binary"), "sum", "i8").collect()
    got = np.frombuffer(rows[0].vec, np.int64) if rows else np.zeros(DIMS + 1, np.int64)
    return got[:DIMS], int(got[DIMS])


def cluster(x: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means, begun from far-apart rows; at most k unit centroids."""
    k = min(k, len(x))
    centres = [x.mean(axis=0)]
    for _ in range(k):
        centres.append(x[int(np.argmin((x @ np.array(centres).T).max(axis=1)))])
    c = np.array(centres[1:], np.float32)
    for _ in range(12):
        own = (x @ c.T).argmax(axis=1)
        c = np.array([x[own == i].mean(axis=0) if (own == i).any() else c[i] for i in range(len(c))], np.float32)
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def bucket(n_grams: np.ndarray) -> np.ndarray:
    """Lengths that have like cosines: by powers of four, up to 8."""
    return np.minimum(8, np.log2(np.maximum(1, n_grams)) / 2).astype(int)


def pieces(text: str, seed: int) -> list[str]:
    """A stretch of the text's words for each length bucket up to SHORT that it reaches, as a text of that length would be."""
    words, out = text.split(), []
    for s in range(SHORT + 1):
        rng = np.random.default_rng([seed, s])
        least, most = (4**s + 4) // 2, 2 * 4**s + 2  # bytes that give 4^s n-grams and under 4^(s + 1)
        size = int(rng.integers(least, most))
        at = int(rng.integers(0, max(1, len(words))))
        piece = " ".join(words[at : at + size]).encode("utf-8", "replace")[:size].decode("utf-8", "ignore")
        out.append(piece if len(piece.encode()) >= least else "")
    return out


def learn(rows: list[np.ndarray], cuts: list[list[str]], idf: np.ndarray) -> tuple[np.ndarray, list[float]]:
    """(centroids, by length bucket the cosine below which few of its texts lie) of one language's sample."""
    raw, x = np.array(rows), vectors(rows, idf)
    c = cluster(x, CENTROIDS)
    near, sizes = (x @ c.T).max(axis=1), bucket(raw.sum(axis=1))
    floor = float(np.quantile(near, QUANTILE))
    least = [min(floor, float(np.quantile(near[sizes == s], QUANTILE))) if (sizes == s).sum() >= FEW else floor for s in range(9)]
    for s in range(SHORT + 1):
        short = [p[s] for p in cuts if p[s]]
        if (sizes == s).sum() < FEW and short:
            y = vectors(list(counts(*common.utf8(pa.array(short)))), idf) @ c.T
            least[s] = min(floor, float(np.quantile(y.max(axis=1), QUANTILE)), float(near[sizes == s].min(initial=1.0)))
    return c, least


def fit(docs: DataFrame) -> dict:
    """Learn from rows of (doc_id, text, lang) with lang; the caller has left out what may not be learned from. Each language's sample, bounded by SAMPLE, is clustered in a task of its own; the driver gets centroids alone, CENTROIDS x DIMS numbers a language, of every value of lang."""
    rows = docs.filter("lang is not null and text is not null")
    per = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    df, n = document_frequencies(rows)
    idf = np.log((1 + n) / (1 + df)).astype(np.float32) + np.float32(0.1)
    if not per:
        return {"langs": [], "idf": idf, "centres": np.zeros((0, DIMS), np.float32), "owner": np.zeros(0, int), "least": np.zeros((0, 9))}
    share = F.create_map(*[F.lit(x) for lang, m in per.items() for x in (lang, min(1.0, SAMPLE / m))])[F.col("lang")]
    some = rows.filter((F.xxhash64(F.col("doc_id"), F.lit("langid")).bitwiseAND(0xFFFFF) / F.lit(float(1 << 20))) < share)

    def read(batches):
        for b in batches:
            x = list(counts(*common.utf8(b.column(1))))
            cut = [pieces(t, zlib.crc32(t.encode("utf-8", "replace"))) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([np.minimum(c, 65535).astype("<u2").tobytes() for c in x], pa.binary()), pa.array(cut, pa.list_(pa.string()))], ["lang", "counts", "cut"])

    def one(table: pa.Table) -> pa.Table:
        order = sorted(zip(table.column("counts").to_pylist(), table.column("cut").to_pylist(), strict=True))[: 4 * SAMPLE]
        c, least = learn([np.frombuffer(r, "<u2") for r, _ in order], [r for _, r in order], idf)
        return pa.table({"lang": [table.column("lang")[0].as_py()], "centres": pa.array([c.astype("<f4").tobytes()], pa.binary()), "least": pa.array([least], pa.list_(pa.float64()))})

    sample = some.select("lang", "text").mapInArrow(common.lean(read), "lang string, counts binary, cut array<string>")
    got = sorted(sample.groupBy("lang").applyInArrow(one, "lang string, centres binary, least array<double>").collect())
    centres = [np.frombuffer(r.centres, "<f4").reshape(-1, DIMS) for r in got]
    owner = np.repeat(np.arange(len(got)), [len(c) for c in centres])
    return {"langs": [r.lang for r in got], "idf": idf, "centres": np.concatenate(centres) if centres else np.zeros((0, DIMS), np.float32), "owner": owner, "least": np.array([r.least for r in got]).reshape(-1, 9)}


def judge(model: dict, column: pa.Array) -> tuple[list[str], list[float], list[bool]]:
    """(language, cosine, rejected) of each text. 'und', 0 and rejected for null, for texts without a letter and where nothing was learned."""
    data, offsets = common.utf8(column)
    rows = list(counts(data, offsets))
    n = len(rows)
    if not n or not model["langs"]:
        return ["und"] * n, [0.0] * n, [True] * n
    cos = vectors(rows, model["idf"]) @ model["centres"].T
    by_lang = np.stack([cos[:, model["owner"] == i].max(axis=1) for i in range(len(model["langs"]))], axis=1)
    best = by_lang.argmax(axis=1)
    score = np.clip(by_lang[np.arange(n), best].astype(float), 0, 1)
    rejected = score < REJECT_SHARE * model["least"][best, bucket(np.array([r.sum() for r in rows]))]
    letter = np.array([bool(_ASCII_LETTER[data[offsets[d] : min(offsets[d] + 256, offsets[d + 1])]].any()) for d in range(n)])
    for d in np.flatnonzero(~letter):  # the whole text, where its beginning has no plain letter
        letter[d] = _LETTER.search(bytes(data[offsets[d] : offsets[d + 1]]).decode("utf-8", "replace")) is not None
    return [model["langs"][b] if ok else "und" for b, ok in zip(best, letter, strict=True)], np.where(letter, score, 0.0).tolist(), (rejected | ~letter).tolist()


def predict(docs: DataFrame, model: dict, names: tuple[str, str, str] = ("lang_pred", "score", "rejected")) -> DataFrame:
    """The rows with language, score and rejection under these names after their own columns (which they replace on a clash of names). Repeated rows stay, each with its language; texts are read whole, however long; languages at the same cosine: the one that sorts first; an empty table has no rows."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # languages x CENTROIDS x DIMS
    own = [c for c in docs.columns if c not in names]
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*[F.col(f"`{c}`") for c in own]).schema)

    def run(batches):
        for b in batches:
            lang, score, rejected = judge(shared.value, b.column(b.schema.get_field_index("text")))
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(len(own))], pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], [*own, *names])

    return docs.select(*[F.col(f"`{c}`") for c in own]).mapInArrow(common.lean(run), f"{out}, `{names[0]}` string, `{names[1]}` double, `{names[2]}` boolean")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text's language; learned from rows whose crc32(doc_id) mod 3 is not 1. Rows with null doc_id teach nothing and are not held out."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs.filter(remainder("doc_id", 3) != 1))
    found = predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", F.coalesce(remainder("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")
