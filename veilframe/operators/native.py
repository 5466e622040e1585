"""Detectors and text operators in built-in expressions only: the part of each rule that Catalyst can say. They agree with the full detectors wherever both find something."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import checks

LOCAL, LABEL = r"[\p{L}\p{M}\p{N}._%+\-]", r"[\p{L}\p{M}\p{N}\-]"
EMAIL = rf"{LOCAL}+@{LABEL}+(?:\.{LABEL}+)*+"
SPACE = "[ \\t\\n\\x0B\\f\\r]"


def located(docs: DataFrame, pattern: str, test: str | None = None) -> DataFrame:
    """(doc_id, start, end, match, text) of every match of a pattern: offsets from the lengths of what lies between. test: a cheap condition the text must meet first."""
    some = docs.filter(test) if test else docs
    cut = some.select("doc_id", "text", F.split("text", pattern, -1).alias("between"), F.regexp_extract_all("text", F.lit(pattern), F.lit(0)).alias("found"))
    both = cut.select("doc_id", "text", F.posexplode("found").alias("i", "match"), "between", "found")
    size = lambda xs, n: F.aggregate(F.slice(xs, F.lit(1), n), F.lit(0), lambda a, x: a + F.length(x))
    start = size("between", F.col("i") + 1) + size("found", F.col("i"))
    return both.select("doc_id", start.alias("start"), (start + F.length("match")).alias("end"), "match", "text")


def email_ok(match: Column) -> Column:
    local, domain = F.split_part(match, F.lit("@"), F.lit(1)), F.split_part(match, F.lit("@"), F.lit(2))
    labels = F.split(domain, "\\.")
    return (
        (F.length(local) <= 64) & ~local.rlike("^\\.|\\.$|\\.\\.") & (F.length(domain) <= 253) & (F.size(labels) >= 2)
        & ~F.exists(labels, lambda x: x.rlike("^-|-$")) & F.element_at(labels, -1).rlike("^[\\p{L}\\p{M}]+$") & F.element_at(labels, -1).rlike("\\p{L}\\p{M}*\\p{L}")
    )


def emails(docs: DataFrame) -> DataFrame:
    return located(docs, EMAIL, "contains(text, '@')").filter(email_ok(F.col("match")))


def with_context(found: DataFrame, most: int = 40) -> DataFrame:
    """before and after: up to `most` characters, runs of white space as one space."""
    left = F.regexp_replace(F.substring("text", F.lit(1), F.col("start")), f"{SPACE}+", " ")
    reach = f"^(?:{SPACE}++|[^{SPACE[1:-1]}]){{0,{most}}}"  # so many characters when runs of white space count as one
    right = F.regexp_replace(F.regexp_extract(F.substring("text", F.col("end") + 1, F.length("text")), reach, 0), f"{SPACE}+", " ")
    return found.select("doc_id", "start", "end", "match", F.right(left, F.lit(most)).alias("before"), F.left(right, F.lit(most)).alias("after"))


def cards(docs: DataFrame) -> DataFrame:
    """Unbroken runs of 13 to 19 digits that pass Luhn, with the brand that issues them."""
    runs = located(docs, "[0-9]+", "text rlike '[0-9]{13}'").filter(F.length("match").between(13, 19))
    return runs.filter(F.expr("luhn_check(match)")).withColumn("brand", checks.card_brand_column(F.col("match"))).filter("brand is not null")


PHONE = r"\+1 \([2-9][0-9]{2}\) [2-9][0-9]{2}-[0-9]{4}"


def phones(docs: DataFrame) -> DataFrame:
    """+1 (NPA) NXX-XXXX, valid by structure, not followed by a letter or digit."""
    area = F.substring("match", 5, 3)
    found = located(docs, PHONE, "contains(text, '+1 (')")
    return found.filter(~area.rlike("^(.11|.9.|37.|96.)$") & ~F.substring("text", F.col("end") + 1, F.lit(1)).rlike("[\\p{L}\\p{N}]"))


def term_counts(docs: DataFrame, terms: list[str]) -> DataFrame:
    """(doc_id, term, n): whole words equal to a term of plain letters, in any case. One pass; a row for each term found."""
    words = F.split(F.lower("text"), "[^\\p{L}\\p{N}]+")
    hits = docs.select("doc_id", F.explode(F.filter(words, lambda w: w.isin(*[t.lower() for t in terms]))).alias("term"))
    return hits.groupBy("doc_id", "term").agg(F.count("*").alias("n"))


def masked(text: Column) -> Column:
    """Text with addresses and card-like runs replaced. Texts without an @ are not searched for addresses, and a search begins only where a local part does."""
    mail = F.when(F.contains(text, F.lit("@")), F.regexp_replace(text, rf"(?:\G|(?<!{LOCAL})){LOCAL}++@{LABEL}+(?:\.{LABEL}+)*+", "[EMAIL]")).otherwise(text)
    return F.when(text.rlike("[0-9]{13}"), F.regexp_replace(mail, "[0-9]{13,19}", "[NUMBER]")).otherwise(mail)


#: Most halvings of a block's stretches: 2^LEVELS stretches.
LEVELS = 40


#: Most spans of a block that is resolved as one row.
FEW = 64


def resolve(spans: DataFrame, few: int = FEW) -> DataFrame:
    """(block, span, kind, start, end): precedence as interval difference over (block, span, rank, kind, start, end): each place goes to the least (rank, span) that claims it, and neighbouring places of a span are one row. Spans of a block have numbers of their own.

    Blocks of up to `few` spans are resolved as a row each, larger ones by a tree. Spans that lie by block already are not shuffled, others once.
    """
    whole = spans.filter("start < end and block is not null").withColumn("_of", F.count("*").over(Window.partitionBy("block")))
    return _resolve_rows(whole.filter(F.col("_of") <= few)).unionByName(_resolve_tree(whole.filter(F.col("_of") > few).drop("_of")))


def _resolve_rows(whole: DataFrame) -> DataFrame:
    """Blocks of a few spans, gathered: each stretch between bounds takes the first span, in order of precedence, that claims it."""
    claim = F.struct("rank", "span", "kind", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))
    own = whole.groupBy("block").agg(F.sort_array(F.collect_list(claim)).alias("_claims"))
    own = own.withColumn("_at", F.sort_array(F.array_distinct(F.concat("_claims.start", "_claims.end"))))
    first = lambda at: F.get(F.filter("_claims", lambda c: (c["start"] <= at) & (c["end"] > at)), F.lit(0))
    cut = F.zip_with(F.slice("_at", F.lit(1), F.size("_at") - 1), F.slice("_at", F.lit(2), F.size("_at") - 1), lambda a, z: F.struct(a.alias("start"), z.alias("end"), first(a).alias("c")))
    own = own.select("block", F.explode(F.array(F.filter(cut, lambda x: x["c"].isNotNull()))).alias("_o"))  # worked out once
    beside = lambda i, j: (F.get("_o", i)["end"] == F.get("_o", j)["start"]) & (F.get("_o", i)["c"]["span"].eqNullSafe(F.get("_o", j)["c"]["span"]))
    begins = F.filter("_o", lambda x, i: (i == 0) | ~F.coalesce(beside(i - 1, i), F.lit(False)))
    ends = F.filter("_o", lambda x, i: (i == F.size("_o") - 1) | ~F.coalesce(beside(i, i + 1), F.lit(False)))
    rows = F.zip_with(begins, ends, lambda a, z: F.struct(a["c"]["span"].alias("span"), a["c"]["kind"].alias("kind"), a["start"].alias("start"), z["end"].alias("end")))
    return own.select("block", F.explode(rows).alias("r")).select("block", "r.span", "r.kind", "r.start", "r.end")


def _resolve_tree(whole: DataFrame) -> DataFrame:
    """Blocks of any size. The bounds of all spans part a block into stretches, numbered in order, twice as many as spans at most. A span is put down
    at the few nodes of a tree over the stretches that make it up, each node keeps its least claim, and a stretch takes the
    least of the nodes above it. Rows grow as n log n in the spans, whatever their lengths.
    """
    bound = Window.partitionBy("block").orderBy("at")
    ends = whole.select("block", F.explode(F.array(F.col("start").cast("long"), F.col("end").cast("long"))).alias("at")).distinct()
    ends = ends.select("block", "at", (F.row_number().over(bound) - 1).cast("long").alias("n"), F.lead("at").over(bound).alias("next"), F.count("*").over(Window.partitionBy("block")).alias("of"))
    first, last = ends.select("block", F.col("at").alias("start"), F.col("n").alias("i")), ends.select("block", F.col("at").alias("end"), F.col("n").alias("j"))
    placed = whole.join(first, ["block", "start"]).join(last, ["block", "end"])
    power = lambda k: F.pow(F.lit(2.0), k).cast("long")

    def nodes(k: Column) -> Column:
        a, z = F.ceil(F.col("i") / power(k)).cast("long"), F.floor(F.col("j") / power(k)).cast("long")
        own = lambda at, odd: F.when((a < z) & (odd % 2 == 1), F.struct(k.alias("level"), at.alias("node")))
        return F.array(own(a, a), own(z - 1, z))

    levels = F.sequence(F.lit(0), F.least(F.lit(LEVELS), F.ceil(F.log2(F.col("j") - F.col("i") + 1)).cast("int")))
    put = placed.select("block", F.struct("rank", "span", "kind").alias("claim"), F.explode(F.array_compact(F.flatten(F.transform(levels, nodes)))).alias("at"))
    least = put.groupBy("block", "at.level", "at.node").agg(F.min("claim").alias("claim"))
    up = F.transform(F.sequence(F.lit(0), F.least(F.lit(LEVELS), F.ceil(F.log2(F.col("of") + 1)).cast("int"))), lambda k: F.struct(k.alias("level"), F.floor(F.col("n") / power(k)).cast("long").alias("node")))
    above = ends.filter("next is not null").select("block", "n", F.col("at").alias("start"), F.col("next").alias("end"), F.explode(up).alias("at")).select("block", "n", "start", "end", "at.level", "at.node")
    owner = above.join(least, ["block", "level", "node"]).groupBy("block", "n", "start", "end").agg(F.min("claim").alias("claim"))
    island = F.col("n") - F.row_number().over(Window.partitionBy("block", "claim.span").orderBy("n"))
    return owner.withColumn("_island", island).groupBy("block", "claim.span", "claim.kind", "_island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_island")
