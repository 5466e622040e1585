"""Reports over matches, redactions and pages: counts, ranges, lists and sentences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Ranges that counts are told in; tones of page findings.
BUCKETS = ("0", "1", "2-5", "6-20", "21-50", "51+")
WARNINGS = ("covered-text", "hidden-text", "scanned", "drawn-only", "unreadable-text", "bare-picture", "off-page-picture", "marked-descriptions")


def bucket(n: Column) -> Column:
    return F.when(n.isNull() | ~(n > 0), "0").when(n <= 1, "1").when(n <= 5, "2-5").when(n <= 20, "6-20").when(n <= 50, "21-50").otherwise("51+")


def counts_by_kind(found: DataFrame, *by: str) -> DataFrame:
    return found.groupBy(*by, "kind").agg(F.count("*").alias("n"), F.count_if("ticked").alias("n_ticked"))


def result_counts(found: DataFrame) -> DataFrame:
    """By document: removed, unticked and blocked rows. found: (doc_id, ticked, blocked)."""
    return found.groupBy("doc_id").agg(
        F.count_if(F.col("ticked") & F.col("blocked").isNull()).alias("removed"), F.count_if(~F.col("ticked") & F.col("blocked").isNull()).alias("unticked"),
        F.count_if(F.col("blocked").isNotNull()).alias("blocked"), F.count("*").alias("total"),
    )


def pages_by_finding(readings: DataFrame) -> DataFrame:
    return readings.select(F.explode(F.array_distinct("findings")).alias("finding")).groupBy("finding").agg(F.count("*").alias("pages"))


def partly(findings: Column) -> Column:
    """Does any finding warn?"""
    return F.exists(findings, lambda f: f.isin(*WARNINGS))


def page_list(pages: DataFrame, *by: str) -> DataFrame:
    """(by, pages): sorted distinct numbers, three or more in a row as 'a to b', joined as a British list. pages: (by, page)."""
    w = Window.partitionBy(*by).orderBy("page")
    island = pages.select(*by, "page").distinct().withColumn("g", F.col("page") - F.row_number().over(w))
    runs = island.groupBy(*by, "g").agg(F.min("page").alias("a"), F.max("page").alias("b"))
    said = F.when(F.col("b") - F.col("a") >= 2, F.array(F.concat_ws(" to ", "a", "b"))).when(F.col("b") > F.col("a"), F.array(F.col("a").cast("string"), F.col("b").cast("string"))).otherwise(F.array(F.col("a").cast("string")))
    parts = runs.select(*by, "a", said.alias("said")).groupBy(*by).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("a", "said"))), lambda x: x["said"])).alias("p"))
    n = F.size("p")
    return parts.select(*by, F.when(n == 1, F.col("p")[0]).otherwise(F.concat(F.array_join(F.slice("p", F.lit(1), n - 1), ", "), F.lit(" and "), F.element_at("p", -1))).alias("pages"))


def count_text(n: Column) -> Column:
    return F.when(F.abs(n) < 1000, n.cast("long").cast("string")).otherwise(F.format_number(n, 0))


def counted(n: Column, one: str, many: str) -> Column:
    """'1 match', '1,234 matches'."""
    return F.concat(count_text(n), F.when(n == 1, f" {one}").otherwise(f" {many}"))


def refusal_lines(refused: DataFrame, named: int = 20) -> DataFrame:
    """(reason, n, names): the first names of each reason, in order, and how many there are. refused: (reason, name, line). Counts and names go apart, so of a hot reason each task passes on `named` names and a number."""
    first = refused.withColumn("k", F.row_number().over(Window.partitionBy("reason").orderBy("line"))).filter(F.col("k") <= named)
    names = first.groupBy("reason").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "name"))), lambda x: x["name"]), ", ").alias("names"))
    return refused.groupBy("reason").agg(F.count("*").alias("n")).join(names, "reason")


# What kinds of data, terms and stripped parts are called, one and many; the note on crooked scans.
NOUNS = {
    "email": ("email address", "email addresses"), "phone": ("phone number", "phone numbers"), "date": ("date", "dates"), "card": ("card number", "card numbers"), "iban": ("IBAN", "IBANs"),
    "us-ssn": ("Social Security number", "Social Security numbers"), "uk-nino": ("National Insurance number", "National Insurance numbers"), "term": ("match", "matches"),
}
STRIPPED_NOUNS = {
    "document-info": "document info", "xmp-metadata": "XMP metadata", "annotations": "annotations", "form-fields": "form fields", "attachments": "attachments", "bookmarks": "bookmarks", "hidden-layers": "hidden layers", "javascript": "JavaScript",
    "incremental-versions": "earlier versions", "page-thumbnails": "page thumbnails", "accessibility-tags": "accessibility tags (screen readers will read the clean file less well)",
}
CROOKED = "Some items on scanned pages can't be removed because the scan is slightly crooked."


def listed(parts: Column) -> Column:
    """An array as a British list: 'a, b and c'; '' if empty."""
    n = F.size(parts)
    return F.when(n <= 1, F.array_join(parts, "")).otherwise(F.concat(F.array_join(F.slice(parts, F.lit(1), F.greatest(n - 1, F.lit(1))), ", "), F.lit(" and "), F.element_at(parts, -1)))


def said_counts(counts: Column) -> Column:
    """A map of counts by kind as words, in the order of the kinds; kinds with none are left out."""
    return _said({k: counts[k] for k in NOUNS})


def _said(n: dict[str, Column]) -> Column:
    return F.array_compact(F.array(*[F.when(F.coalesce(n[k], F.lit(0)) > 0, counted(n[k], one, many)) for k, (one, many) in NOUNS.items()]))


def removed_sentence(removed: Column) -> Column:
    return _removed_line(said_counts(removed))


def _removed_line(parts: Column) -> Column:
    return F.when(F.size(parts) == 0, "Nothing").otherwise(listed(parts))


def left_sentence(unticked: Column, blocked: Column, engine: str = "The engine") -> Column:
    """What was left: unticked rows, then those that could not be removed."""
    return _left_line(said_counts(unticked), said_counts(blocked), engine)


def _left_line(own: Column, kept: Column, engine: str = "The engine") -> Column:
    said = F.array_compact(F.array(F.when(F.size(own) > 0, F.concat(listed(own), F.lit(" you left unticked."))), F.when(F.size(kept) > 0, F.concat(listed(kept), F.lit(f" {engine} couldn't remove.")))))
    return F.when(F.size(said) == 0, f"Nothing {engine} found.").otherwise(F.array_join(said, " "))


def stripped_sentence(kinds: Column) -> Column:
    names = F.create_map(*[F.lit(x) for p in STRIPPED_NOUNS.items() for x in p])
    text = listed(F.transform(kinds, lambda k: names[k]))
    return F.when(F.size(kinds) == 0, "Nothing else needed stripping.").otherwise(F.concat(F.upper(F.substring(text, 1, 1)), text.substr(F.lit(2), F.length(text))))


def detection_counts(found: DataFrame, *by: str) -> DataFrame:
    """(by, measure, name, n): rows by kind, blocked ones included, and blocked rows by reason. found: (by, kind, blocked)."""
    one = found.select(*by, F.explode(F.array_compact(F.array(F.struct(F.lit("found").alias("measure"), F.col("kind").alias("name")), F.when(F.col("blocked").isNotNull(), F.struct(F.lit("blocked").alias("measure"), F.col("blocked").alias("name")))))).alias("m"))
    return one.groupBy(*by, "m.measure", "m.name").agg(F.count("*").alias("n"))


def removed_counts(found: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(doc_id, kind, term, n): what was removed, by kind and, of terms, by term, in documents whose rewrite stands. found: (doc_id, kind, term, ticked, blocked); outcomes: (doc_id, outcome), null where it stands."""
    stands = outcomes.filter("outcome is null").select("doc_id").distinct()
    return found.filter("ticked and blocked is null").join(stands, "doc_id", "left_semi").groupBy("doc_id", "kind", "term").agg(F.count("*").alias("n"))


def outcome_counts(found: DataFrame, *by: str) -> DataFrame:
    """(by, removed, unticked, blocked): rows of each kind as maps. found: (by, kind, ticked, blocked)."""
    state = F.when(F.col("blocked").isNotNull(), "blocked").when(F.col("ticked"), "removed").otherwise("unticked")
    per = found.groupBy(*by, "kind", state.alias("state")).agg(F.count("*").alias("n"))
    as_map = lambda s: F.map_from_entries(F.collect_list(F.when(F.col("state") == s, F.struct("kind", "n")))).alias(s)
    return per.groupBy(*by).agg(*map(as_map, ("removed", "unticked", "blocked")))


def result_sentences(found: DataFrame, *by: str) -> DataFrame:
    """(by, removed_line, left_line) of (by, kind, ticked, blocked). Rows are counted by kind and state in one pass, in a fixed number of counters a group: no lists or maps are gathered."""
    free, ticked = F.col("blocked").isNull(), F.coalesce("ticked", F.lit(False))
    states = {"r": free & ticked, "u": free & ~ticked, "b": ~free}
    counts = found.groupBy(*by).agg(*(F.count_if((F.col("kind") == k) & held).alias(f"_{s}_{i}") for s, held in states.items() for i, k in enumerate(NOUNS)))
    said = counts.select(*by, *(_said({k: F.col(f"_{s}_{i}") for i, k in enumerate(NOUNS)}).alias(f"_{s}") for s in states))
    return said.select(*by, _removed_line(F.col("_r")).alias("removed_line"), _left_line(F.col("_u"), F.col("_b")).alias("left_line"))


def crooked_notes(found: DataFrame, readings: DataFrame) -> DataFrame:
    """(doc_id, note): documents with a row blocked as slanted on a page that is machine-read. found: (doc_id, page, blocked); readings: (doc_id, page, findings)."""
    scanned = readings.filter(F.array_contains("findings", "machine-read-text")).select("doc_id", "page")
    return found.filter("blocked = 'slanted-text'").join(scanned, ["doc_id", "page"], "left_semi").select("doc_id").distinct().withColumn("note", F.lit(CROOKED))
