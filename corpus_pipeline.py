"""A corpus pipeline: language, toxicity, near duplicates, repeated passages, packing. Each stage reads what the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.llm import common, langid, ngram_join, packing, suffix_dedup, toxicity

#: Near duplicates: words a shingle, and Jaccard similarity in %.
SHINGLE_WORDS, SIMILARITY = 5, 80
CAPACITY, TOKENIZER, END_ID = 4096, "word_bpe_49k.json", 1


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose text is near a learned language; null, empty, wordless and far texts go. Repeated rows are judged alike; columns stay as they are, whatever their names; an empty table stays empty."""
    model = langid.fit(docs.select("doc_id", "text", "lang").filter(langid.remainder("doc_id", 3) != 1))
    names = common.fresh(docs, "lang_pred", "score", "rejected")
    return langid.predict(docs, model, tuple(names)).filter(f"not {names[2]}").drop(*names)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that score under 0.5. Null and empty texts get the score of no words, which stays; repeated rows are judged alike; columns stay as they are, whatever their names; an empty table stays empty."""
    labels = common.table(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = toxicity.fit(docs, labels.filter(langid.remainder("doc_id", 5) != 0))
    names = common.fresh(docs, "score", "predicted")
    return toxicity.score(docs, model, tuple(names)).filter(f"{names[1]} = 0").drop(*names)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group: the row with the smallest doc_id, of several with that id the text with the smallest key.

    Texts without words are in no group, and rows with null doc_id are compared with nothing: both stay. Rows that repeat a
    doc_id with other texts are judged apart; of rows alike in both one stays. Columns stay as they are; an empty table stays
    empty.
    """
    found = common.cut(spark, ngram_join.join(spark, docs, SHINGLE_WORDS, SIMILARITY).filter("doc_id is not null and n_shingles > 0"), "groups")
    row = found.groupBy("component_id", "doc_id", "tkey").agg(F.count("*").alias("n"))
    first = row.filter("doc_id = component_id").groupBy("component_id").agg(F.min("tkey").alias("first"))
    state = row.join(first, "component_id").select("doc_id", "tkey", "n", ((F.col("doc_id") == F.col("component_id")) & (F.col("tkey") == F.col("first"))).alias("stays"))
    gone = common.cut(spark, state.filter("not stays or n > 1").select(F.col("doc_id").alias("_gone"), F.col("tkey").alias("_gone_key"), "stays"), "gone")
    key, = common.fresh(docs, "_tkey")
    keyed = docs.withColumn(key, ngram_join.text_key(F.col("text")))
    same = (keyed["doc_id"] == gone["_gone"]) & (keyed[key] == gone["_gone_key"])
    left = keyed.join(gone, same, "left_anti")
    if not gone.filter("stays").isEmpty():  # rows alike in doc_id and text: one of them
        left = left.unionByName(keyed.join(gone.filter("stays"), same, "left_semi").dropDuplicates(["doc_id", key]))
    return left.drop(key)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out of each text what also stands in a document with a smaller doc_id."""
    return suffix_dedup.rewrite(spark, docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left as token sequences: a row a piece. Null and empty texts are the end id alone; rows with null or repeated doc_id are packed like any other; other columns are left behind; an empty table gives no rows."""
    return packing.pack(spark, packing.pieces(docs, TOKENIZER, END_ID, CAPACITY), CAPACITY)


STAGES = [("language_id", language), ("toxicity", toxic), ("ngram_jaccard_join", near_duplicates), ("suffix_array_dedup", repeated_passages), ("best_fit_packing", packed)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.cut(spark, stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
