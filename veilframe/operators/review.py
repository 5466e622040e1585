"""The review of matches: their order, the checklist, the targets a run gets, and the verdict on what it made."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .spans import KINDS

# Sections of a page in the order its rows are listed.
SECTIONS = ("ordinary", "held-part", "hidden")


def reading_order(found: DataFrame) -> DataFrame:
    """The rows with place, from 1 in each document: by page, then ordinary rows, then parts that a match across a page break holds on the page before, then rows of hidden text; by start in each."""
    rank = F.array_position(F.array(*[F.lit(s) for s in SECTIONS]), F.coalesce("section", F.lit(SECTIONS[0])))
    return found.withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy("page", rank, "start", "end", "match_id")).cast("int"))


def checklist(ordered: DataFrame, terms: list[str] | None = None) -> DataFrame:
    """(doc_id, group, group_rank, n_rows, rows, tickable): terms first, in list order, then kinds in their own; rows in reading order, and those that a tick can reach. ordered: (doc_id, match_id, kind, term, place, blocked)."""
    order = [*(f"term:{t}" for t in terms or []), *KINDS]
    group = F.when(F.col("kind") == "term", F.concat(F.lit("term:"), F.col("term"))).otherwise(F.col("kind"))
    ids = lambda free: F.transform(F.array_sort(F.collect_list(F.when(F.col("blocked").isNull() | F.lit(not free), F.struct("place", "match_id")))), lambda x: x["match_id"])
    rows = ordered.withColumn("group", group).groupBy("doc_id", "group").agg(F.count("*").alias("n_rows"), ids(False).alias("rows"), ids(True).alias("tickable"))
    return rows.withColumn("group_rank", F.array_position(F.array(*[F.lit(g) for g in order]), F.col("group")).cast("int")).filter("group_rank > 0")


def seeded(found: DataFrame) -> DataFrame:
    """What starts ticked: by default ticked and not blocked."""
    return found.filter(F.col("ticked") & F.col("blocked").isNull())


def targets_by_page(chosen: DataFrame) -> DataFrame:
    """(doc_id, page, n_targets, targets): a page's ticked rows together, in order."""
    one = F.struct("start", "end", "kind", "text")
    return chosen.groupBy("doc_id", "page").agg(F.count("*").alias("n_targets"), F.array_sort(F.collect_list(one)).alias("targets"))


def bare(text: Column) -> Column:
    return F.regexp_replace(text, r"[\s\x{FEFF}]+", "")


def target_sound(page_text: Column, start: Column, end: Column, text: Column) -> Column:
    """Does a target hold up: inside the page, not blank, and its text one run of what stands there, white space aside?"""
    inside = (start >= 0) & (end > start) & (end <= F.length(page_text))
    there = bare(F.substring(page_text, start + 1, end - start))
    return F.coalesce(inside & (F.length(bare(text)) > 0) & F.contains(there, bare(text)), F.lit(False))


def refused_targets(docs: DataFrame, targets: DataFrame) -> DataFrame:
    """(doc_id, refusal) of documents whose targets (doc_id, page, start, end, text, slanted, overreach) don't all hold up, each check over all of them before the next: 'unsupported', 'slanted-text', 'redaction-overreach'. Pages of (doc_id, text) are parted by form feeds; offsets count the text as it is."""
    pages = docs.select("doc_id", F.split("text", "\f", -1).alias("pages"))
    at = targets.join(pages, "doc_id", "left").withColumn("page_text", F.get("pages", F.col("page") - 1))
    judged = at.groupBy("doc_id").agg(
        F.bool_and(target_sound(F.col("page_text"), F.col("start"), F.col("end"), F.col("text"))).alias("sound"),
        F.bool_or(F.coalesce("slanted", F.lit(False))).alias("slanted"), F.bool_or(F.coalesce("overreach", F.lit(False))).alias("overreach"),
    )
    why = F.when(~F.col("sound"), "unsupported").when(F.col("slanted"), "slanted-text").when(F.col("overreach"), "redaction-overreach")
    return judged.select("doc_id", why.alias("refusal")).filter("refusal is not null")


def outcome(ticked: Column, structural: Column, escaped: Column, leaked: Column, unreadable: Column, replaced: Column, overreached: Column) -> Column:
    """The verdict on a rewritten document, the gravest first; with nothing ticked any change is a document that is not supported. null: pass."""
    return (
        F.when(structural | escaped, "redaction-incomplete")
        .when(~ticked & (leaked | unreadable | replaced | overreached), "unsupported")
        .when(~ticked, None)
        .when(leaked, "redaction-incomplete")
        .when(unreadable, "unsupported")
        .when(replaced, "replacement-text")
        .when(overreached, "redaction-overreach")
    )


# What a web page holds beside its text, and how it is known.
INVENTORY = {
    "document-info": r"(?i)<(meta|title)\b", "annotations": "<!--", "form-fields": r"(?i)<(form|input|textarea|select)\b", "attachments": r"(?i)\bdownload\b|href=.data:",
    "bookmarks": r"(?i)<a\s[^>]*href=.#", "javascript": r"(?i)<script\b|\bon(click|load|error)\s*=", "accessibility-tags": r"(?i)\b(alt|aria-[a-z]+)\s*=",
}


def inventory(pages: DataFrame) -> DataFrame:
    """(page_id, stripped): kinds of things beside the text that a web page (page_id, html) holds, in order."""
    return pages.select("page_id", F.array_compact(F.array(*[F.when(F.col("html").rlike(p), k) for k, p in INVENTORY.items()])).alias("stripped"))
