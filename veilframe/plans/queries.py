"""Registered queries over the reference tables, and the SQL of those that SQL can express.

Kinds of data that the tables do not hold (IBANs, identity numbers, dates) are written from key columns inside the query;
such queries are named synth_*.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import checks, geometry
from ..operators import events, findings, native, page_text, pages, report, review, session
from ..sources import gates
from ..sources.shared import cut
from . import lifecycle, object_queries, page_queries

T = gates.read
S = "[ \\t\\n\\x0B\\f\\r]"
TERMS = ["the", "Licensed", "disgusting", "avec"]


def _millis():
    """Milliseconds since 1970 of a time without a zone."""
    return F.expr("timestampdiff(MILLISECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)")


def email_matches(spark: SparkSession, d: str) -> DataFrame:
    return native.emails(T(spark, d, "documents")).select("doc_id", "start", "end", "match")


def email_context(spark, d):
    return native.with_context(native.emails(T(spark, d, "documents")))


def email_by_source(spark, d):
    docs = T(spark, d, "documents")
    return native.emails(docs.select("doc_id", "text")).join(docs.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.count("*").alias("n"))


def card_matches(spark, d):
    return native.cards(T(spark, d, "documents")).select("doc_id", "start", "end", "match", "brand")


def card_by_brand(spark, d):
    return native.cards(T(spark, d, "documents")).groupBy("brand").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"))


def page_card_matches(spark, d):
    return native.cards(T(spark, d, "pages").select(F.col("page_id").alias("doc_id"), F.col("html").alias("text"))).select("doc_id", "start", "end", "match", "brand")


def phone_matches(spark, d):
    return native.phones(T(spark, d, "documents")).select("doc_id", "start", "end", "match")


def term_counts(spark, d):
    return native.term_counts(T(spark, d, "documents"), TERMS)


def conversation_terms(spark, d):
    c = T(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), "text")
    return native.term_counts(c, ["the", "of"])


def masked_text(spark, d):
    t = native.masked(F.col("text"))
    return T(spark, d, "documents").select("doc_id", F.md5(t).alias("masked_md5"), F.length(t).cast("long").alias("masked_chars"))


def no_leak_after_mask(spark, d):
    """Documents in which an address still stands after masking: none."""
    masked = T(spark, d, "documents").select("doc_id", native.masked(F.col("text")).alias("text"))
    return native.emails(masked).groupBy("doc_id").agg(F.count("*").alias("left_over"))


def multiset_compare(spark, d):
    """Words lost and added by masking, as multisets."""
    docs = T(spark, d, "documents").select("doc_id", "text", native.masked(F.col("text")).alias("new")).filter("text <> new")
    words = lambda c: docs.select("doc_id", F.explode(F.split(c, f"{S}+")).alias("word")).filter("word <> ''")
    a, b = words("text"), words("new")
    lost, added = a.exceptAll(b).groupBy("doc_id").agg(F.count("*").alias("lost")), b.exceptAll(a).groupBy("doc_id").agg(F.count("*").alias("added"))
    return lost.join(added, "doc_id", "full").select("doc_id", F.coalesce("lost", F.lit(0)).alias("lost"), F.coalesce("added", F.lit(0)).alias("added"))


def counts_by_kind(spark, d):
    docs = T(spark, d, "documents")
    rows = native.emails(docs).select(F.lit("email").alias("kind")).unionByName(native.cards(docs).select(F.lit("card").alias("kind"))).unionByName(native.phones(docs).select(F.lit("phone").alias("kind")))
    return rows.groupBy("kind").agg(F.count("*").alias("n")).withColumn("bucket", report.bucket(F.col("n")))


def gate_refusals(spark, d):
    docs = T(spark, d, "documents")
    r = gates.refusal(F.col("text"), F.ceil(F.length("text") / 3000), gates.Limits(most_pages=4, most_bytes=20_000))
    return docs.groupBy(F.coalesce(r, F.lit("opened")).alias("refusal")).agg(F.count("*").alias("n"))


def open_gates(spark, d):
    """The gates over web pages: what each whole page is refused as, or that it opens."""
    html = F.col("html")
    shown = F.regexp_replace(html, "(?is)<script.*?</script>|<style.*?</style>|<[^>]*>", "")
    why = gates.first_refusal(
        unreadable=F.length(F.regexp_replace(shown, gates.UNREADABLE, "")) < 150, layered=F.contains(html, F.lit("<!-- ad 3")), many_pages=F.size(F.split(html, "<p>")) > 13, damaged=~F.contains(html, F.lit("</html>")),
        no_header=~F.lower(F.substring(html, 1, 1024)).contains("<!doctype html"), too_large=F.octet_length(html) > 9000, locked=F.col("url").contains("pills"), empty_clip=F.contains(html, F.lit("<article></article>")),
    )
    return T(spark, d, "pages").select("page_id", F.coalesce(why, F.lit("opened")).alias("refusal"))


def removed_by_term(spark, d):
    """What was removed from documents whose rewrite stands, by kind and term."""
    rows = _rows(spark, d)
    judged = rows.groupBy("doc_id").agg(F.count("*").alias("n")).select("doc_id", F.when(F.col("n") % 4 == 0, "redaction-incomplete").alias("outcome"))
    return report.removed_counts(rows, judged)


def stripped_sentences(spark, d):
    """What each whole web page holds beside its text, as a sentence."""
    return review.inventory(T(spark, d, "pages")).select("page_id", report.stripped_sentence(F.col("stripped")).alias("sentence"))


def event_keys(spark, d):
    """Keys of valid events (name and values), and how many have each."""
    e = T(spark, d, "events").select("event_id", F.element_at(F.array(*[F.lit(j) for j, _ in SAMPLES]), (F.col("event_id") % len(SAMPLES) + 1).cast("int")).alias("json"))
    valid = events.strict_events(e).filter("valid")
    return valid.select(events.report_key(F.array_join(F.regexp_extract_all("canonical", F.lit(r'"([^"]*)"[,}\]]'), F.lit(1)), " ")).alias("key")).groupBy("key").agg(F.count("*").alias("n"))


def synth_iban(spark, d):
    """British shapes from customer keys: check digits right for most, off by one for every seventh."""
    c = T(spark, d, "customer").select("c_custkey")
    bban = F.concat(F.lit("VEIL"), F.lpad(F.col("c_custkey").cast("string"), 14, "0"))
    rest = checks.iban_remainder_column(F.concat(F.lit("GB00"), bban))
    digits = F.lpad(((98 - rest + F.when(F.col("c_custkey") % 7 == 0, 1).otherwise(0)) % 100).cast("string"), 2, "0")
    code = F.concat(F.lit("GB"), digits, bban)
    return c.select("c_custkey", code.alias("code"), ((F.length(code) == checks.iban_length_column(F.lit("GB"))) & (checks.iban_remainder_column(code) == 1)).alias("valid"))


def synth_ssn(spark, d):
    k = F.col("o_orderkey")
    o = T(spark, d, "orders").select(k, F.concat_ws("-", F.lpad((k * 37 % 1000).cast("string"), 3, "0"), F.lpad((k % 100).cast("string"), 2, "0"), F.lpad((k * 13 % 10000).cast("string"), 4, "0")).alias("code"))
    ok = F.col("code").rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$") & ~F.col("code").rlike("^(000|666|9)") & ~F.col("code").rlike("^...-00") & ~F.col("code").rlike("0000$")
    return o.select("o_orderkey", "code", ok.alias("issuable"))


def synth_nino(spark, d):
    k = F.col("c_custkey")
    letter = lambda n: F.chr((n % 26 + 65).cast("int"))
    c = T(spark, d, "customer").select(k, F.concat(letter(k), letter(F.floor(k / 26)), F.lpad((k * 7919 % 1000000).cast("string"), 6, "0"), letter(k % 4)).alias("code"))
    a, b = F.substring("code", 1, 1), F.substring("code", 2, 1)
    ok = ~a.rlike(f"[{checks.NINO_NEVER_FIRST}]") & ~b.rlike(f"[{checks.NINO_NEVER_SECOND}]") & ~F.concat(a, b).isin(*checks.NINO_NEVER_PAIR)
    return c.select("c_custkey", "code", ok.alias("valid"))


def synth_dates(spark, d):
    """Days and months from order keys, real or not, judged in both orders."""
    k = F.col("o_orderkey")
    o = T(spark, d, "orders").select(k, (k % 33).cast("int").alias("a"), (F.floor(k / 33) % 14).cast("int").alias("b"), (1880 + k % 240).cast("int").alias("y"))
    real = checks.real_day_column(F.col("y"), F.col("b"), F.col("a")) | checks.real_day_column(F.col("y"), F.col("a"), F.col("b"))
    return o.select("o_orderkey", F.concat_ws("/", "a", "b", "y").alias("written"), real.alias("is_date"))


def synth_overlap(spark, d):
    """Spans of seven kinds from line items, one block an order; what each keeps."""
    kind = F.element_at(F.array(*[F.lit(x) for x in ("email", "iban", "card", "us-ssn", "uk-nino", "phone", "date")]), (F.col("l_linenumber") - 1) % 7 + 1)
    li = T(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").repartition("l_orderkey").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"), F.min("l_suppkey").alias("s"))
    spans = li.select(F.col("l_orderkey").alias("block"), F.col("l_linenumber").alias("span"), ((F.col("l_linenumber") - 1) % 7).alias("rank"), kind.alias("kind"), (F.col("p") % 60).alias("start"), (F.col("p") % 60 + F.col("s") % 20 + 1).alias("end"))
    return native.resolve(spans)


def term_admission(spark, d):
    """Part names as a pasted list: why each is refused, in order, or None."""
    p = T(spark, d, "part").select(F.col("p_partkey").alias("line"), F.when(F.col("p_partkey") % 11 == 0, F.lit("!!")).when(F.col("p_partkey") % 13 == 0, F.lit("x")).otherwise(F.concat_ws(" ", "p_name", (F.col("p_partkey") % 5).cast("string"))).alias("term"))
    early = F.when(F.length("term") < 2, "too-short").when(F.length("term") > 100, "too-long").when(~F.col("term").rlike("[\\p{L}\\p{N}]"), "no-letter-or-digit")
    a = p.withColumn("early", early)
    first = a.filter("early is null").groupBy(F.lower("term").alias("fold")).agg(F.min("line").alias("first")).orderBy("first").limit(50)
    return a.join(F.broadcast(first), F.lower("term") == F.col("fold"), "left").select("line", "term", F.coalesce("early", F.when(F.col("first") == F.col("line"), None).when(F.col("first") < F.col("line"), "duplicate").otherwise("list-full")).alias("refusal"))


def output_names(spark, d):
    c = T(spark, d, "customer")
    name = F.when(F.col("c_custkey") % 9 == 0, F.lit(" .pdf ")).when(F.col("c_custkey") % 2 == 0, F.concat("c_name", F.lit(".PDF"))).otherwise(F.concat(F.lit("  "), "c_name"))
    form = gates.output_form(F.col("c_custkey") % 3, F.col("c_custkey") % 2 == 0)
    return c.select("c_custkey", gates.output_name(name, form).alias("output_name"))


def page_lists(spark, d):
    """Days with events by user, as a page list."""
    e = T(spark, d, "events").filter("event_type = 'error'").select("user_id", F.dayofmonth("ts").alias("page"))
    return report.page_list(e, "user_id")


def result_counts(spark, d):
    li = T(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), (F.col("l_returnflag") == "R").alias("ticked"), F.when(F.col("l_linestatus") == "F", "slanted-text").alias("blocked"))
    return report.result_counts(li)


def refusal_lines(spark, d):
    p = T(spark, d, "part").select(F.col("p_type").alias("reason"), F.col("p_name").alias("name"), F.col("p_partkey").alias("line"))
    return report.refusal_lines(p)


def report_admission(spark, d):
    """Error reports of each user: once an hour since the last admitted."""
    e = T(spark, d, "events").filter("event_type = 'error'").select(F.col("user_id").cast("string").alias("key"), _millis().alias("ts_ms"))
    return events.admitted(e, 24 * events.HOUR_MS)


def report_budget(spark, d):
    e = T(spark, d, "events").filter("event_type in ('error', 'view')").select(F.col("event_id").cast("string").alias("key"), _millis().alias("ts_ms"), (F.col("event_type") == "error").alias("from_page"))
    return events.within_budget(e).select("key", "admitted")


#: Events as they come, and whether each is valid: every shape once, and ways to be wrong.
SAMPLES = [
    ('{"name":"page-view","page":"home"}', True), ('{"name":"page-view","page":"nowhere"}', False), ('{"name":"cap-reached","cap":"size","account":"none"}', True), ('{"name":"cap-reached","cap":"bytes","account":"none"}', False),
    ('{"name":"document-opened","pages":"2-5","found":{"email":"1"},"blocked":{},"pagesWith":{"scanned":"6-20"},"tier":"free","account":"signed-in"}', True), ('{"name":"document-opened","pages":"2-5","found":{"email":"0"},"blocked":{},"pagesWith":{},"tier":"free","account":"none"}', False),
    ('{"name":"redaction-completed","removed":{"card":"51+"},"unticked":{},"blockedByKind":{},"blockedByReason":{"slanted-text":"1"},"terms":"0","termsSetAside":"0","stripped":["javascript","annotations"],"tier":"paid","account":"signed-in"}', True),
    ('{"name":"redaction-completed","removed":{},"unticked":{},"blockedByKind":{},"blockedByReason":{},"terms":"0","termsSetAside":"0","stripped":["javascript","javascript"],"tier":"paid","account":"signed-in"}', False),
    ('{"name":"run-refused","kind":"corrupt","step":"open","tier":"free","account":"unknown"}', True), ('{"name":"run-refused","kind":"corrupt","step":"close","tier":"free","account":"unknown"}', False), ('{"name":"server-crash","route":"proxy","routeType":"render"}', True),
    ('{"name":"browser-crash","page":"tool","kind":"rejection"}', True), ('{"name":"billing-failed","action":"welcome","outcome":"still-waiting"}', True), ('{"name":"billing-failed","action":"welcome"}', False), ('{"name":"subscribe-started"}', True), ('{"name":"subscription-confirmed"}', True), ('{"name":"subscription-confirmed","x":1}', False),
    ('{"name":"plan-check-failed"}', True), ('{"name":"engine-unavailable"}', True), ('[]', False), ('{"name":"page-view"', False),
]


def strict_events(spark, d):
    """Each sample shape in turn, by event_id."""
    e = T(spark, d, "events").select("event_id", F.element_at(F.array(*[F.lit(j) for j, _ in SAMPLES]), (F.col("event_id") % len(SAMPLES) + 1).cast("int")).alias("json"))
    return events.strict_events(e).select("event_id", "valid", "name")


def report_rules(spark, d):
    """Both rules of admission, by instance: a key once an hour, 20 page reports a day."""
    e = T(spark, d, "events").select((F.col("user_id") % 16).alias("instance"), F.col("event_id").alias("seq"), F.concat_ws(" ", "event_type", (F.col("user_id") % 3).cast("string")).alias("key"), _millis().alias("ts_ms"), F.col("event_type").isin("error", "view").alias("draws"))
    return events.admit_reports(e, 4 * events.HOUR_MS, 3).select("seq", "key", "admitted")


def policy_order(spark, d):
    """Are each customer's orders dated newest first by falling key?"""
    o = T(spark, d, "orders").select("o_custkey", (-F.col("o_orderkey")).alias("position"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"))
    return events.newest_first(o, "o_custkey")


def html_inventory(spark, d):
    return review.inventory(T(spark, d, "pages")).select("page_id", F.array_join("stripped", ",").alias("stripped"))


def target_refusals(spark, d):
    """Addresses as targets, some moved by a character or told otherwise, some on slanted text."""
    docs = T(spark, d, "documents").select("doc_id", F.regexp_replace("text", "\f", " ").alias("text"))
    k = F.col("doc_id")
    t = native.emails(docs).select("doc_id", F.lit(1).alias("page"), (F.col("start") + F.when(k % 3 == 0, 1).otherwise(0)).alias("start"), "end", F.col("match").alias("text"), (k % 5 == 0).alias("slanted"), (k % 7 == 0).alias("overreach"))
    return review.refused_targets(docs, t)


def _rows(spark, d):
    """Line items as rows of a review."""
    kind = F.element_at(F.array(*[F.lit(x) for x in ("email", "phone", "date", "card", "iban", "us-ssn", "uk-nino", "term")]), (F.col("l_partkey") % 8 + 1).cast("int"))
    least = lambda c, v: F.bool_and(F.col(c) >= v) & F.bool_or(F.col(c) == v)  # noqa: E731  min(c) = v, without a minimum of strings, which sorts
    li = T(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus").repartition("l_orderkey")
    li = li.groupBy("l_orderkey", "l_partkey").agg(F.min("l_suppkey").alias("s"), least("l_returnflag", "R").alias("f"), least("l_linestatus", "F").alias("z"))
    return li.select(
        F.col("l_orderkey").alias("doc_id"), F.concat_ws("-", "l_orderkey", "l_partkey").alias("match_id"), kind.alias("kind"), F.when(kind == "term", (F.col("l_partkey") % 3).cast("string")).alias("term"), (F.col("s") % 3 + 1).cast("int").alias("page"),
        (F.col("l_partkey") % 100).cast("int").alias("start"), (F.col("l_partkey") % 100 + 5).cast("int").alias("end"), F.when(F.col("s") % 4 == 0, "hidden").otherwise("ordinary").alias("section"), F.col("f").alias("ticked"), F.when(F.col("z"), F.when(F.col("s") % 2 == 0, "slanted-text").otherwise("image-overreach")).alias("blocked"),
        F.concat_ws(" ", F.lit("row"), "l_partkey").alias("text"),
    )


def review_checklist(spark, d):
    c = review.checklist(review.reading_order(_rows(spark, d)), ["0", "1", "2"])
    return c.select("doc_id", "group", "group_rank", "n_rows", F.array_join("rows", ",").alias("rows"), F.array_join("tickable", ",").alias("tickable"))


def page_targets(spark, d):
    t = review.targets_by_page(review.seeded(_rows(spark, d)))
    return t.select("doc_id", "page", "n_targets", F.array_join(F.transform("targets", lambda x: F.concat_ws(":", x["start"], x["end"], x["kind"])), ",").alias("targets"))


def detection_counts(spark, d):
    return report.detection_counts(_rows(spark, d))


def result_sentences(spark, d):
    return report.result_sentences(_rows(spark, d), "doc_id")


def crooked_notes(spark, d):
    r = _rows(spark, d)
    readings = r.select("doc_id", "page").distinct().select("doc_id", "page", F.when((F.col("doc_id") + F.col("page")) % 2 == 0, F.array(F.lit("machine-read-text"))).otherwise(F.array().cast("array<string>")).alias("findings"))
    return report.crooked_notes(r, readings).select("doc_id", F.length("note").alias("note_chars"))


def opt_out(spark, d):
    e = T(spark, d, "events").select("event_id", (F.col("event_type") == "error").alias("is_error"), (F.col("user_id") % 3 == 0).alias("gpc"), F.when(F.col("user_id") % 5 == 0, True).alias("dnt"))
    return events.kept(e).groupBy("is_error").agg(F.count("*").alias("n"))


def kept_plan(spark, d):
    """An unknown answer keeps a paid one for a while."""
    e = T(spark, d, "events").select(F.col("user_id").alias("user"), _millis().alias("ts_ms"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "purchase", "paid").when(F.col("event_type") == "error", "unknown").otherwise("free").alias("answer"))
    return events.kept_plan(e, 24 * 3_600_000).groupBy("shown").agg(F.count("*").alias("n"))


def plan_states(spark, d):
    c = T(spark, d, "customer")
    state = F.when(F.col("c_custkey") % 10 == 0, '{"granted_benefits":[]}').otherwise(F.concat(F.lit('{"granted_benefits":[{"benefit_id":"'), F.when(F.col("c_custkey") % 2 == 0, "pro").otherwise("other"), F.lit('"}],"active_subscriptions":[{"product_id":"'), F.when(F.col("c_custkey") % 3 == 0, "p1").otherwise("p2"), F.lit('","current_period_end":"2026-01-01","cancel_at_period_end":'), F.when(F.col("c_custkey") % 4 == 0, "true").otherwise("false"), F.lit("}]}")))
    return c.select("c_custkey", *events.plan_columns(state, "pro", "p1"))


def entitlements(spark, d):
    c = T(spark, d, "customer")
    said = F.when(F.col("c_custkey") % 4 == 0, "signed-out").otherwise("user")
    pro = F.when(F.col("c_custkey") % 5 == 0, None).otherwise(F.col("c_custkey") % 2 == 0)
    return c.select(*events.entitlement(F.col("c_custkey") % 7 != 0, said, pro)).groupBy("tier", "account").agg(F.count("*").alias("n"))


def page_kinds(spark, d):
    path = F.when(F.col("event_id") % 6 == 0, "/").when(F.col("event_id") % 6 == 1, "/sign-in/factor").when(F.col("event_id") % 6 == 2, "/account/billing").when(F.col("event_id") % 6 == 3, "/account").when(F.col("event_id") % 6 == 4, "/pricing").otherwise("/accounts")
    return T(spark, d, "events").select(events.page_kind(path).alias("page")).groupBy("page").agg(F.count("*").alias("n"))


def calendar_dates(spark, d):
    k = F.col("o_orderkey")
    text = F.concat(F.lpad((1990 + k % 40).cast("string"), 4, "0"), F.lit("-"), F.lpad((k % 14).cast("string"), 2, "0"), F.lit("-"), F.lpad((k % 33).cast("string"), 2, "0"))
    return T(spark, d, "orders").select(text.alias("written"), events.calendar_date(text).alias("is_date")).groupBy("is_date").agg(F.count("*").alias("n"))


def dependency_closure(spark, d):
    """Reachable from nation 0 over a small graph of nations."""
    n = T(spark, d, "nation")
    edges = n.select(F.col("n_nationkey").alias("src"), ((F.col("n_nationkey") * 3 + 1) % 25).cast("int").alias("dst")).unionByName(n.select(F.col("n_nationkey").alias("src"), ((F.col("n_nationkey") + 10) % 25).cast("int").alias("dst")).filter("src % 4 = 0"))
    return events.closure(edges, n.filter("n_nationkey = 0").select(F.col("n_nationkey").alias("node")))


def _quad(df: DataFrame) -> DataFrame:
    x, y = F.col("p_partkey") % 50 * 1.0, F.col("p_size") * 1.0
    return df.withColumn("quad", F.array(x, y, x + 10, y + F.col("p_partkey") % 3, x, y + 8, x + 10, y + 8 + F.col("p_partkey") % 3))


def geometry_scalars(spark, d):
    q = F.col("quad")
    return _quad(T(spark, d, "part")).select("p_partkey", F.round(geometry.height(q), 6).alias("height"), F.round(geometry.width(q), 6).alias("width"), F.round(geometry.area(q), 6).alias("area"), geometry.sound(q).alias("sound"), geometry.contains(q, F.lit(5.0), F.lit(20.0)).alias("holds"), *geometry.centre_columns(q))


def contrast_scalars(spark, d):
    c = lambda n: (F.col("p_partkey") % n) / (n - 1)
    lum = geometry.luminance(c(7), c(11), c(13))
    return T(spark, d, "part").select("p_partkey", F.round(lum, 6).alias("luminance"), F.round(geometry.contrast(lum, F.lit(1.0)), 5).alias("contrast"))


def document_matches(spark, d):
    return lifecycle.matches(T(spark, d, "documents"))


def page_matches(spark, d):
    return lifecycle.matches(T(spark, d, "pages").select(F.col("page_id").alias("doc_id"), F.col("html").alias("text")))


def matches_by_source(spark, d):
    docs = T(spark, d, "documents")
    return lifecycle.matches(docs, columns=("doc_id", "kind", "ticked")).join(docs.select("doc_id", "source"), "doc_id").groupBy("source", "kind").agg(F.count("*").alias("n"), F.count_if("ticked").alias("n_ticked"))


def document_terms(spark, d):
    found = lifecycle.matches(T(spark, d, "documents"), [(str(i), t) for i, t in enumerate(["Apache License", "MIT-License", "scum", "Public License"])], columns=("kind", "term", "notes"))
    return found.filter("kind = 'term'").groupBy("term", F.array_join("notes", ",").alias("notes")).agg(F.count("*").alias("n"))


def redacted_documents(spark, d):
    return lifecycle.redact_all(T(spark, d, "documents")).select("doc_id", F.md5("text").alias("text_md5"), "n_removed")


def redaction_proof(spark, d):
    proved = lifecycle.judged(lifecycle.redact_all(T(spark, d, "documents")).drop("text"))
    return proved.groupBy("verdict").agg(F.count("*").alias("n"), F.sum("n_removed").alias("removed"))


def chosen_redaction(spark, d):
    """The reader's own ticks: every third row the other way."""
    docs = T(spark, d, "documents")
    found = cut(lifecycle.matches(docs, columns=("doc_id", "match_id", "page", "start", "end", "text", "ticked", "blocked")))  # ticks, redaction and proof read it: texts are searched once
    ticks = found.filter("doc_id % 3 = 0").select("match_id", F.lit(1).alias("seq"), (~F.col("ticked")).alias("on"))
    chosen = lifecycle.selected(found, ticks)
    return lifecycle.verify(docs, lifecycle.redact(docs, chosen), chosen).groupBy("verdict").agg(F.count("*").alias("n"), F.sum("n_removed").alias("removed"))


def synth_full_detection(spark, d):
    """Every kind, written from orders, through the full detectors. Orders are dealt out before they are texts."""
    k = F.col("o_orderkey")
    text = F.concat(F.lit("Signed "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" by a."), k.cast("string"), F.lit("@mail.example.org, SSN "), F.lpad((100 + k % 500).cast("string"), 3, "0"), F.lit("-12-3456, tel +1 (212) 555-"), F.lpad((k % 10000).cast("string"), 4, "0"), F.lit(", born 3 May 1980, card 4111 1111 1111 1111, NI AB123456C, GB82 WEST 1234 5698 7654 32."))
    orders = gates.dealt(T(spark, d, "orders").select("o_orderkey", "o_orderdate"))
    return lifecycle.matches(orders.select(k.alias("doc_id"), text.alias("text")), columns=("kind", "ticked"), dealt=True).groupBy("kind", "ticked").agg(F.count("*").alias("n"))


#: Events of the table as actions of a session.
ACTIONS = {"signup": "file-chosen", "view": "opened", "click": "redact-started", "purchase": "redacted", "error": "failed"}


def _log(spark, d):
    """Each user's events as the log of a job: a match that starts ticked, and a file that fails as corrupt."""
    action = F.element_at(F.create_map(*[F.lit(x) for p in ACTIONS.items() for x in p]), F.col("event_type"))
    return T(spark, d, "events").select(F.col("user_id").cast("string").alias("job_id"), F.col("event_id").alias("seq"), action.alias("action"), F.lit('{"matches":[{"id":"m1","ticked":true}],"failure":"corrupt"}').alias("payload"))


def session_states(spark, d):
    return session.fold(_log(spark, d)).withColumn("ticked", F.array_join("ticked", ","))


def session_usage(spark, d):
    return session.usage_events(session.transitions(_log(spark, d))).groupBy("name").agg(F.count("*").alias("n"))


def _characters(spark, d):
    """Line items as characters, numbered on each page by their keys; rows alike in all keys are alike as characters."""
    li = T(spark, d, "lineitem")
    x, y, h = F.col("l_partkey") % 60 * 10.0, F.col("l_linenumber") * 14.0, 10.0 - F.when(F.col("l_suppkey") % 9 == 0, 6.0).otherwise(0.0)
    c = li.select((F.col("l_orderkey") % 200).alias("doc_id"), (F.col("l_orderkey") % 5 + 1).cast("int").alias("page"), "l_orderkey", "l_partkey", "l_suppkey", F.col("l_linenumber").alias("line"), F.when(F.col("l_suppkey") % 31 == 0, 0xFFFD).otherwise(65 + F.col("l_partkey") % 26).cast("int").alias("code"), x.alias("ox"), (y + F.when(F.col("l_suppkey") % 9 == 0, 4.0).otherwise(0.0)).alias("oy"), F.array(x, y - h, x + 6, y - h, x, y, x + 6, y).alias("quad"))
    w = Window.partitionBy("doc_id", "page").orderBy("l_orderkey", "line", "l_partkey", "l_suppkey")
    return c.withColumn("idx", F.row_number().over(w).cast("long")).drop("l_orderkey", "l_partkey", "l_suppkey")


def synth_lines(spark, d):
    return pages.lines(_characters(spark, d))


def synth_page_findings(spark, d):
    c = _characters(spark, d)
    glyphs = c.select("doc_id", "page", F.lit(1).alias("ord"), F.lit("glyph").alias("kind"), "idx", "quad", (F.col("code") != 70).alias("visible"), F.lit(False).alias("opaque"), F.lit(1.0).alias("alpha"), F.lit(21.0).alias("contrast"))
    sheet = c.select("doc_id", "page").distinct()
    cover = sheet.filter("doc_id % 10 = 0").select("doc_id", "page", F.lit(2).alias("ord"), F.lit("cover").alias("kind"), F.lit(None).cast("long").alias("idx"), F.array(*[F.lit(v) for v in (0.0, 0.0, 300.0, 0.0, 0.0, 30.0, 300.0, 30.0)]).alias("quad"), F.lit(True).alias("visible"), F.lit(True).alias("opaque"), F.lit(1.0).alias("alpha"), F.lit(21.0).alias("contrast"))
    image = sheet.filter("doc_id % 7 = 0").select("doc_id", "page", F.lit(0).alias("ord"), F.lit("image").alias("kind"), F.lit(None).cast("long").alias("idx"), F.array(*[F.lit(v) for v in (0.0, 0.0, 600.0, 0.0, 0.0, 790.0, 600.0, 790.0)]).alias("quad"), F.lit(True).alias("visible"), F.lit(True).alias("opaque"), F.lit(1.0).alias("alpha"), F.lit(21.0).alias("contrast"))
    size = sheet.withColumn("width", F.lit(612.0)).withColumn("height", F.lit(792.0))
    return report.pages_by_finding(findings.findings(size, c, glyphs.unionByName(cover).unionByName(image)))


def synth_off_line(spark, d):
    level = _characters(spark, d).withColumns({"dx": F.lit(1.0), "dy": F.lit(0.0)})
    return page_text.leaving(level).groupBy("off_line", "leaves").agg(F.count("*").alias("n"))


def synth_reading_compare(spark, d):
    """Origins on the edges of cells, moved to either side of them; each fiftieth is gone."""
    c = _characters(spark, d)
    after = c.filter("idx % 50 <> 0").withColumn("ox", F.col("ox") + F.when(F.col("idx") % 2 == 0, 0.004).otherwise(-0.004))
    return pages.compare(c, after).groupBy().agg(F.sum("missing").alias("missing"), F.sum("extra").alias("extra"))


def synth_trim(spark, d):
    """Characters on narrow pages: what lies outside goes; on some pages more is lost."""
    c = _characters(spark, d)
    sizes = c.select("doc_id", "page").distinct().select("doc_id", "page", (F.lit(203.0) + F.col("doc_id") % 3 * 100).alias("width"), F.lit(80.0).alias("height"))
    placed = pages.trim(c, sizes)
    after = placed.filter("place <> 'outside' and not (place = 'edge' and doc_id % 5 = 0) and not (doc_id % 11 = 0 and page = 2 and idx % 7 = 0)")
    return pages.trim_proof(placed, after)


def synth_replacement_text(spark, d):
    """Outlines over pages whose second reading spells some characters otherwise."""
    c = _characters(spark, d)
    sheets = c.select("doc_id", "page").distinct()
    outlines = sheets.select(F.concat_ws("-", "doc_id", "page").alias("match_id"), "doc_id", "page", F.array(*[F.lit(v) for v in (0.0, 0.0, 60.0, 0.0, 0.0, 30.0, 60.0, 30.0)]).alias("quad"))
    other = c.withColumn("code", F.when((F.col("doc_id") % 4 == 0) & (F.col("line") == 2), 63).otherwise(F.col("code")))
    return pages.replacement_text(outlines, c, other)


_E = r"[\p{L}\p{M}\p{N}._%+\-]+@[\p{L}\p{M}\p{N}\-]+(?:\.[\p{L}\p{M}\p{N}\-]+)*"


def _located(table: str, pattern: str, ident: str = "doc_id", text: str = "text", where: str = "true") -> str:
    return f"""(SELECT doc_id, text, between_, found, i, found[i+1] AS match,
      (coalesce(list_sum(list_transform(between_[1:i+1], lambda x: length(x))),0) + coalesce(list_sum(list_transform(found[1:i], lambda x: length(x))),0))::INT AS start
    FROM (SELECT *, unnest(range(len(found)))::INT AS i FROM (SELECT {ident} AS doc_id, {text} AS text, string_split_regex({text}, '{pattern}') AS between_, regexp_extract_all({text}, '{pattern}') AS found FROM {table} WHERE {where})))"""


_EMAILS = f"""(SELECT doc_id, start, (start + length(match))::INT AS "end", match, text FROM {_located("documents", _E, where="contains(text, '@')")}
  WHERE length(string_split(match,'@')[1]) <= 64 AND NOT regexp_matches(string_split(match,'@')[1], '^\\.|\\.$|\\.\\.') AND length(string_split(match,'@')[2]) <= 253
  AND len(string_split(string_split(match,'@')[2],'.')) >= 2 AND len(list_filter(string_split(string_split(match,'@')[2],'.'), lambda x: regexp_matches(x, '^-|-$'))) = 0
  AND regexp_full_match(string_split(string_split(match,'@')[2],'.')[-1], '[\\p{{L}}\\p{{M}}]+') AND regexp_matches(string_split(string_split(match,'@')[2],'.')[-1], '\\p{{L}}\\p{{M}}*\\p{{L}}'))"""
_LUHN = "(list_sum(list_transform(range(length(match)), lambda i: CASE WHEN i % 2 = 0 THEN substr(match, (length(match) - i)::BIGINT, 1)::INT WHEN substr(match, (length(match) - i)::BIGINT, 1)::INT > 4 THEN 2 * substr(match, (length(match) - i)::BIGINT, 1)::INT - 9 ELSE 2 * substr(match, (length(match) - i)::BIGINT, 1)::INT END)) % 10 = 0)"
_BRAND = "CASE " + " ".join("WHEN length(match) IN (" + ",".join(map(str, lengths)) + ") AND (" + " OR ".join(f"substr(match,1,{len(lo)}) BETWEEN '{lo}' AND '{hi}'" for lo, hi in prefixes) + f") THEN '{name}'" for name, prefixes, lengths in checks.CARD_BRANDS) + " END"


def _cards(table="documents", ident="doc_id", text="text") -> str:
    return f"""(SELECT * FROM (SELECT doc_id, start, (start + length(match))::INT AS "end", match, {_BRAND} AS brand FROM {_located(table, "[0-9]+", ident, text, f"regexp_matches({text}, '[0-9]{{13}}')")} WHERE length(match) BETWEEN 13 AND 19 AND {_LUHN}) WHERE brand IS NOT NULL)"""


_PHONES = f"""(SELECT doc_id, start, (start + length(match))::INT AS "end", match FROM {_located("documents", r"\+1 \([2-9][0-9]{2}\) [2-9][0-9]{2}-[0-9]{4}", where="contains(text, '+1 (')")}
  WHERE NOT regexp_full_match(substr(match, 5, 3), '.11|.9.|37.|96.') AND NOT regexp_matches(substr(text, (start + length(match) + 1)::BIGINT, 1), '[\\p{{L}}\\p{{N}}]'))"""
_SP = "[ \\t\\n\\x0B\\f\\r]"
_MASK = f"regexp_replace(regexp_replace(text, '{_E}', '[EMAIL]', 'g'), '[0-9]{{13,19}}', '[NUMBER]', 'g')"
_BUCKET = "CASE WHEN n IS NULL OR n <= 0 THEN '0' WHEN n <= 1 THEN '1' WHEN n <= 5 THEN '2-5' WHEN n <= 20 THEN '6-20' WHEN n <= 50 THEN '21-50' ELSE '51+' END"
_MOD = "list_reduce(list_transform(string_split(substr({c}, 5) || substr({c}, 1, 4), ''), lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN x::INT ELSE ascii(x) - 55 END), lambda r, v: (r * (CASE WHEN v > 9 THEN 100 ELSE 10 END) + v) % 97, 0)"
_WORDS = "list_filter(string_split_regex({t}, '" + _SP + "+'), lambda x: x <> '')"
_DAY = "({y} BETWEEN 1900 AND 2099 AND {m} BETWEEN 1 AND 12 AND {d} BETWEEN 1 AND CASE WHEN {m} = 2 THEN CASE WHEN ({y} % 4 = 0 AND ({y} % 100 <> 0 OR {y} % 400 = 0)) THEN 29 ELSE 28 END WHEN {m} IN (4,6,9,11) THEN 30 ELSE 31 END)"
_TERMS_SQL = "SELECT doc_id, term, count(*) AS n FROM (SELECT {i} AS doc_id, unnest(list_filter(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w IN ({t}))) AS term FROM {f}) GROUP BY 1, 2"
_Q = {"x0": "(p_partkey % 50)::DOUBLE", "y0": "p_size::DOUBLE", "k": "(p_partkey % 3)::DOUBLE"}

_ROWS = """SELECT l_orderkey AS doc_id, l_orderkey || '-' || l_partkey AS match_id, ['email','phone','date','card','iban','us-ssn','uk-nino','term'][l_partkey % 8 + 1] AS kind, CASE WHEN l_partkey % 8 = 7 THEN (l_partkey % 3)::VARCHAR END AS term, min(l_suppkey) % 3 + 1 AS page,
  l_partkey % 100 AS start, l_partkey % 100 + 5 AS "end", CASE WHEN min(l_suppkey) % 4 = 0 THEN 'hidden' ELSE 'ordinary' END AS section, min(l_returnflag) = 'R' AS ticked, CASE WHEN min(l_linestatus) = 'F' THEN CASE WHEN min(l_suppkey) % 2 = 0 THEN 'slanted-text' ELSE 'image-overreach' END END AS blocked, 'row ' || l_partkey AS text FROM lineitem GROUP BY l_orderkey, l_partkey"""
_NOUNS = "[" + ", ".join(f"'{one}'" for one, _ in report.NOUNS.values()) + "] AS ONE, [" + ", ".join(f"'{many}'" for _, many in report.NOUNS.values()) + "] AS MANY"
_CHARS = """SELECT l_orderkey % 200 AS doc_id, (l_orderkey % 5 + 1)::INT AS page, row_number() OVER (PARTITION BY l_orderkey % 200, l_orderkey % 5 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS idx, l_linenumber AS line, CASE WHEN l_suppkey % 31 = 0 THEN 65533 ELSE 65 + l_partkey % 26 END AS code, (l_partkey % 60) * 10.0::DOUBLE AS x, l_linenumber * 14.0::DOUBLE AS y,
  10.0::DOUBLE - CASE WHEN l_suppkey % 9 = 0 THEN 6 ELSE 0 END AS h, l_linenumber * 14.0::DOUBLE + CASE WHEN l_suppkey % 9 = 0 THEN 4 ELSE 0 END AS oy FROM lineitem"""

_FITS = "(a = 'file-chosen' OR (a = 'opened' AND state = 'opening') OR (a = 'redact-started' AND state = 'reviewing') OR (a = 'redacted' AND state = 'redacting') OR (a = 'failed' AND state IN ('redacting', 'opening')))"
_SESSIONS = f"""WITH RECURSIVE e AS (SELECT user_id::VARCHAR AS job_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, CASE event_type WHEN 'signup' THEN 'file-chosen' WHEN 'view' THEN 'opened' WHEN 'click' THEN 'redact-started' WHEN 'purchase' THEN 'redacted' WHEN 'error' THEN 'failed' END AS a FROM events),
  r AS (SELECT DISTINCT job_id, 0::BIGINT AS k, '' AS action, '' AS before, 'idle' AS state, 0::BIGINT AS n_changes, '' AS ticked FROM e
    UNION ALL SELECT e.job_id, e.k, a, state, CASE WHEN NOT {_FITS} THEN state WHEN a = 'file-chosen' THEN 'opening' WHEN a = 'redact-started' THEN 'redacting' WHEN a = 'redacted' THEN 'complete' WHEN a = 'failed' AND state = 'opening' THEN 'failed' ELSE 'reviewing' END,
      n_changes + {_FITS}::INT, CASE WHEN a = 'file-chosen' THEN '' WHEN a = 'opened' AND state = 'opening' THEN 'm1' ELSE ticked END FROM r JOIN e ON e.job_id = r.job_id AND e.k = r.k + 1)"""

def _key(raw: str) -> str:
    """A valid sample's key: its name and values in the order of the event's fields; maps by kind and sets in the order of their lists."""
    value, out = json.loads(raw), []
    for field, (_, allowed) in events.EVENTS[value["name"]].items():
        v = value[field]
        out += [v] if isinstance(v, str) else [v[k] for k in allowed if k in v] if isinstance(v, dict) else [k for k in allowed if k in v]
    return " ".join([value["name"], *out])


ORACLE: dict[str, str] = {
    "email_matches": f'SELECT doc_id, start, "end", match FROM {_EMAILS}',
    "email_context": f"""SELECT doc_id, start, "end", match, right(regexp_replace(substr(text, 1, start), '{_SP}+', ' ', 'g'), 40) AS before, left(regexp_replace(substr(text, "end" + 1), '{_SP}+', ' ', 'g'), 40) AS after FROM {_EMAILS}""",
    "email_by_source": f"SELECT source, count(*) AS n FROM {_EMAILS} JOIN (SELECT doc_id, source FROM documents) USING (doc_id) GROUP BY 1",
    "card_matches": f"SELECT * FROM {_cards()}",
    "card_by_brand": f"SELECT brand, count(*) AS n, count(DISTINCT doc_id) AS docs FROM {_cards()} GROUP BY 1",
    "page_card_matches": f"SELECT * FROM {_cards('pages', 'page_id', 'html')}",
    "phone_matches": f"SELECT * FROM {_PHONES}",
    "term_counts": _TERMS_SQL.format(i="doc_id", f="documents", t=", ".join(f"'{t.lower()}'" for t in TERMS)),
    "conversation_terms": _TERMS_SQL.format(i="conv_id", f="conversations", t="'the', 'of'"),
    "masked_text": f"SELECT doc_id, md5({_MASK}) AS masked_md5, length({_MASK}) AS masked_chars FROM documents",
    "no_leak_after_mask": f"SELECT doc_id, count(*) AS left_over FROM (SELECT doc_id, {_MASK} AS text FROM documents) WHERE regexp_matches(text, '{_E}') AND regexp_matches(text, '@.*\\.[a-z]{{2}}') GROUP BY 1",
    "multiset_compare": f"""WITH d AS (SELECT doc_id, text, {_MASK} AS new FROM documents WHERE text <> {_MASK}),
      a AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest({_WORDS.format(t="text")}) AS w FROM d) GROUP BY 1, 2), b AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest({_WORDS.format(t="new")}) AS w FROM d) GROUP BY 1, 2)
      SELECT doc_id, sum(greatest(coalesce(a.n,0) - coalesce(b.n,0), 0))::BIGINT AS lost, sum(greatest(coalesce(b.n,0) - coalesce(a.n,0), 0))::BIGINT AS added FROM a FULL JOIN b USING (doc_id, w) GROUP BY 1""",
    "counts_by_kind": f"SELECT *, {_BUCKET} AS bucket FROM (SELECT 'email' AS kind, count(*) AS n FROM {_EMAILS} UNION ALL SELECT 'card', count(*) FROM {_cards()} UNION ALL SELECT 'phone', count(*) FROM {_PHONES}) WHERE n > 0",
    "gate_refusals": "SELECT CASE WHEN strlen(text) > 20000 THEN 'too-large' WHEN text IS NULL THEN 'corrupt' WHEN ceil(length(text) / 3000) > 4 THEN 'too-many-pages' WHEN length(regexp_replace(text, '[\\s\\p{Cc}\\p{Co}\\x{FFFD}]', '', 'g')) = 0 THEN 'no-readable-text' ELSE 'opened' END AS refusal, count(*) AS n FROM documents GROUP BY 1",
    "synth_iban": f"WITH a AS (SELECT c_custkey, 'VEIL' || lpad(c_custkey::VARCHAR, 14, '0') AS bban FROM customer), b AS (SELECT c_custkey, bban, {_MOD.format(c='(' + chr(39) + 'GB00' + chr(39) + ' || bban)')} AS r FROM a), c AS (SELECT c_custkey, 'GB' || lpad(((98 - r + CASE WHEN c_custkey % 7 = 0 THEN 1 ELSE 0 END) % 100)::VARCHAR, 2, '0') || bban AS code FROM b) SELECT c_custkey, code, (length(code) = 22 AND {_MOD.format(c='code')} = 1) AS valid FROM c",
    "synth_ssn": "SELECT o_orderkey, code, NOT regexp_matches(code, '^(000|666|9)') AND NOT regexp_matches(code, '^...-00') AND NOT regexp_matches(code, '0000$') AS issuable FROM (SELECT o_orderkey, lpad((o_orderkey * 37 % 1000)::VARCHAR, 3, '0') || '-' || lpad((o_orderkey % 100)::VARCHAR, 2, '0') || '-' || lpad((o_orderkey * 13 % 10000)::VARCHAR, 4, '0') AS code FROM orders)",
    "synth_nino": f"SELECT c_custkey, code, NOT regexp_matches(code[1], '[{checks.NINO_NEVER_FIRST}]') AND NOT regexp_matches(code[2], '[{checks.NINO_NEVER_SECOND}]') AND code[1:2] NOT IN ({', '.join(repr(p) for p in checks.NINO_NEVER_PAIR)}) AS valid FROM (SELECT c_custkey, chr((c_custkey % 26 + 65)::INT) || chr(((c_custkey // 26) % 26 + 65)::INT) || lpad((c_custkey * 7919 % 1000000)::VARCHAR, 6, '0') || chr((c_custkey % 4 + 65)::INT) AS code FROM customer)",
    "synth_dates": f"SELECT o_orderkey, a || '/' || b || '/' || y AS written, {_DAY.format(y='y', m='b', d='a')} OR {_DAY.format(y='y', m='a', d='b')} AS is_date FROM (SELECT o_orderkey, o_orderkey % 33 AS a, (o_orderkey // 33) % 14 AS b, 1880 + o_orderkey % 240 AS y FROM orders)",
    "synth_overlap": """WITH s AS (SELECT l_orderkey AS block, l_linenumber AS span, (l_linenumber - 1) % 7 AS rank, ['email','iban','card','us-ssn','uk-nino','phone','date'][(l_linenumber - 1) % 7 + 1] AS kind, min(l_partkey) % 60 AS st, min(l_partkey) % 60 + min(l_suppkey) % 20 + 1 AS en FROM lineitem GROUP BY 1, 2),
      p AS (SELECT block, span, rank, kind, unnest(range(st, en)) AS at_ FROM s), o AS (SELECT block, at_, arg_min(span, rank * 1000 + span) AS span, arg_min(kind, rank * 1000 + span) AS kind FROM p GROUP BY 1, 2),
      g AS (SELECT *, at_ - row_number() OVER (PARTITION BY block, span ORDER BY at_) AS g FROM o) SELECT block, span, kind, min(at_) AS start, max(at_) + 1 AS "end" FROM g GROUP BY block, span, kind, g""",
    "term_admission": """WITH p AS (SELECT p_partkey AS line, CASE WHEN p_partkey % 11 = 0 THEN '!!' WHEN p_partkey % 13 = 0 THEN 'x' ELSE p_name || ' ' || (p_partkey % 5)::VARCHAR END AS term FROM part),
      a AS (SELECT *, CASE WHEN length(term) < 2 THEN 'too-short' WHEN length(term) > 100 THEN 'too-long' WHEN NOT regexp_matches(term, '[\\p{L}\\p{N}]') THEN 'no-letter-or-digit' END AS early FROM p),
      f AS (SELECT lower(term) AS fold, min(line) AS first FROM a WHERE early IS NULL GROUP BY 1), k AS (SELECT *, row_number() OVER (ORDER BY first) AS k FROM f)
      SELECT line, term, coalesce(early, CASE WHEN k > 50 THEN 'list-full' WHEN first < line THEN 'duplicate' END) AS refusal FROM a LEFT JOIN k ON lower(term) = fold AND early IS NULL""",
    "output_names": """SELECT c_custkey, CASE WHEN length(trim(stem)) = 0 THEN 'document' ELSE stem END || '-' || CASE WHEN c_custkey % 3 = 0 THEN 'cleaned' WHEN c_custkey % 2 = 0 THEN 'partly-redacted' ELSE 'redacted' END || '.pdf' AS output_name
      FROM (SELECT c_custkey, regexp_replace(trim(CASE WHEN c_custkey % 9 = 0 THEN ' .pdf ' WHEN c_custkey % 2 = 0 THEN c_name || '.PDF' ELSE '  ' || c_name END), '(?i)\\.pdf$', '') AS stem FROM customer)""",
    "page_lists": """WITH p AS (SELECT DISTINCT user_id, day(ts) AS page FROM events WHERE event_type = 'error'), g AS (SELECT *, page - row_number() OVER (PARTITION BY user_id ORDER BY page) AS g FROM p),
      r AS (SELECT user_id, g, min(page) AS a, max(page) AS b FROM g GROUP BY 1, 2), s AS (SELECT user_id, flatten(list(CASE WHEN b - a >= 2 THEN [a || ' to ' || b] WHEN b > a THEN [a::VARCHAR, b::VARCHAR] ELSE [a::VARCHAR] END ORDER BY a)) AS p FROM r GROUP BY 1)
      SELECT user_id, CASE WHEN len(p) = 1 THEN p[1] ELSE array_to_string(p[1:len(p)-1], ', ') || ' and ' || p[-1] END AS pages FROM s""",
    "result_counts": "SELECT l_orderkey AS doc_id, count(*) FILTER (l_returnflag = 'R' AND l_linestatus <> 'F') AS removed, count(*) FILTER (l_returnflag <> 'R' AND l_linestatus <> 'F') AS unticked, count(*) FILTER (l_linestatus = 'F') AS blocked, count(*) AS total FROM lineitem GROUP BY 1",
    "refusal_lines": "SELECT reason, count(*) AS n, string_agg(name, ', ' ORDER BY k) FILTER (k <= 20) AS names FROM (SELECT p_type AS reason, p_name AS name, row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) AS k FROM part) GROUP BY 1",
    "report_admission": """WITH RECURSIVE e AS (SELECT user_id::VARCHAR AS key, (epoch_us(ts) // 1000) AS ts_ms, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS k FROM events WHERE event_type = 'error'),
      r AS (SELECT key, ts_ms, k, ts_ms AS last, true AS admitted FROM e WHERE k = 1 UNION ALL SELECT e.key, e.ts_ms, e.k, CASE WHEN e.ts_ms - r.last >= 86400000 THEN e.ts_ms ELSE r.last END, e.ts_ms - r.last >= 86400000 FROM r JOIN e ON e.key = r.key AND e.k = r.k + 1)
      SELECT key, ts_ms, admitted FROM r""",
    "report_budget": "SELECT event_id::VARCHAR AS key, event_type <> 'error' OR row_number() OVER (PARTITION BY event_type, (epoch_us(ts) // 1000) // 86400000 ORDER BY (epoch_us(ts) // 1000), event_id::VARCHAR) <= 20 AS admitted FROM events WHERE event_type IN ('error', 'view')",
    "strict_events": "SELECT event_id, v AS valid, CASE WHEN v THEN n END AS name FROM (SELECT event_id, [" + ", ".join(str(ok).lower() for _, ok in SAMPLES) + f"][event_id % {len(SAMPLES)} + 1] AS v, [" + ", ".join("'" + (j.split('"')[3] if '"name"' in j else "") + "'" for j, _ in SAMPLES) + f"][event_id % {len(SAMPLES)} + 1] AS n FROM events)",
    "report_rules": """WITH RECURSIVE e AS (SELECT user_id % 16 AS i, event_id AS seq, event_type || ' ' || (user_id % 3)::VARCHAR AS key, epoch_us(ts) // 1000 AS t, event_type IN ('error', 'view') AS draws, row_number() OVER (PARTITION BY user_id % 16 ORDER BY epoch_us(ts) // 1000, event_id) AS k FROM events),
      r AS (SELECT i, 0::BIGINT AS k, NULL::BIGINT AS seq, NULL::VARCHAR AS key, false AS ok, []::STRUCT(key VARCHAR, t BIGINT)[] AS sent, -1::BIGINT AS day, 0::BIGINT AS spent FROM (SELECT DISTINCT i FROM e)
        UNION ALL SELECT i, k, seq, key, ok, CASE WHEN ok THEN list_append(list_filter(sent, lambda x: t - x.t < 14400000), {'key': key, 't': t}) ELSE sent END, CASE WHEN ok AND draws THEN t // 86400000 ELSE day END, CASE WHEN ok AND draws THEN now_spent + 1 ELSE spent END
        FROM (SELECT *, len(list_filter(sent, lambda x: x.key = key AND t - x.t < 14400000)) = 0 AND NOT (draws AND now_spent >= 3) AS ok FROM (SELECT e.i, e.k, e.seq, e.key, e.t, e.draws, r.sent, r.day, r.spent, CASE WHEN e.t // 86400000 = r.day THEN r.spent ELSE 0 END AS now_spent FROM r JOIN e ON e.i = r.i AND e.k = r.k + 1)))
      SELECT seq, key, ok AS admitted FROM r WHERE k > 0""",
    "policy_order": "SELECT o_custkey, bool_and(b IS NULL OR b > d) AS newest_first FROM (SELECT o_custkey, strftime(o_orderdate, '%Y-%m-%d') AS d, lag(strftime(o_orderdate, '%Y-%m-%d')) OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS b FROM orders) GROUP BY 1",
    "html_inventory": "SELECT page_id, array_to_string(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(html, '{p}') THEN '{k}' END" for k, p in review.INVENTORY.items()) + "], lambda x: x IS NOT NULL), ',') AS stripped FROM pages",
    "target_refusals": f"""SELECT doc_id, CASE WHEN bool_or(doc_id % 3 = 0) THEN 'unsupported' WHEN doc_id % 5 = 0 THEN 'slanted-text' WHEN doc_id % 7 = 0 THEN 'redaction-overreach' END AS refusal FROM {_EMAILS} GROUP BY doc_id HAVING refusal IS NOT NULL""",
    "review_checklist": f"""WITH r AS ({_ROWS}), p AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page, CASE section WHEN 'ordinary' THEN 1 ELSE 3 END, start, match_id) AS place FROM r),
      g AS (SELECT *, CASE WHEN kind = 'term' THEN 'term:' || term ELSE kind END AS "group" FROM p)
      SELECT doc_id, "group", list_position(['term:0','term:1','term:2','email','phone','date','card','iban','us-ssn','uk-nino'], "group")::INT AS group_rank, count(*) AS n_rows, string_agg(match_id, ',' ORDER BY place) AS rows, coalesce(string_agg(match_id, ',' ORDER BY place) FILTER (blocked IS NULL), '') AS tickable FROM g GROUP BY 1, 2""",
    "page_targets": f"SELECT doc_id, page::INT AS page, count(*) AS n_targets, string_agg(start || ':' || \"end\" || ':' || kind, ',' ORDER BY start, \"end\", kind, text) AS targets FROM ({_ROWS}) WHERE ticked AND blocked IS NULL GROUP BY 1, 2",
    "detection_counts": f"SELECT 'found' AS measure, kind AS name, count(*) AS n FROM ({_ROWS}) GROUP BY 2 UNION ALL SELECT 'blocked', blocked, count(*) FROM ({_ROWS}) WHERE blocked IS NOT NULL GROUP BY 2",
    "result_sentences": f"""WITH c AS (SELECT doc_id, kind, CASE WHEN blocked IS NOT NULL THEN 'b' WHEN ticked THEN 'r' ELSE 'u' END AS state, count(*) AS n FROM ({_ROWS}) GROUP BY 1, 2, 3),
      w AS (SELECT doc_id, state, list(n || ' ' || CASE WHEN n = 1 THEN ONE[k] ELSE MANY[k] END ORDER BY k) AS parts FROM (SELECT *, list_position(['email','phone','date','card','iban','us-ssn','uk-nino','term'], kind) AS k, {_NOUNS} FROM c) GROUP BY 1, 2),
      l AS (SELECT doc_id, state, CASE WHEN len(parts) = 1 THEN parts[1] ELSE array_to_string(parts[1:len(parts)-1], ', ') || ' and ' || parts[-1] END AS said FROM w),
      p AS (SELECT doc_id, max(said) FILTER (state = 'r') AS r, max(said) FILTER (state = 'u') || ' you left unticked.' AS u, max(said) FILTER (state = 'b') || ' The engine couldn''t remove.' AS b FROM l GROUP BY 1)
      SELECT doc_id, coalesce(r, 'Nothing') AS removed_line, CASE WHEN u IS NULL AND b IS NULL THEN 'Nothing The engine found.' ELSE concat_ws(' ', u, b) END AS left_line FROM p""",
    "crooked_notes": f"SELECT DISTINCT doc_id, {len(report.CROOKED)} AS note_chars FROM ({_ROWS}) WHERE blocked = 'slanted-text' AND (doc_id + page) % 2 = 0",
    "synth_reading_compare": f"SELECT count(*) FILTER (idx % 50 = 0) AS missing, 0::BIGINT AS extra FROM ({_CHARS})",
    "synth_page_findings": f"""WITH c AS ({_CHARS}), k AS (SELECT *, CASE WHEN code = 65533 THEN 'unmapped' WHEN code = 70 THEN 'unseen' ELSE 'seen' END AS kind FROM c),
      i AS (SELECT *, sum(CASE WHEN same THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, page ORDER BY idx, line ROWS UNBOUNDED PRECEDING) AS island FROM (SELECT *, coalesce(lag(line) OVER w = line AND lag(kind) OVER w = kind, false) AS same FROM k WINDOW w AS (PARTITION BY doc_id, page ORDER BY idx, line))),
      runs AS (SELECT doc_id, page, max(n) FILTER (kind = 'unmapped') AS unmapped, max(n) FILTER (kind = 'unseen') AS unseen FROM (SELECT doc_id, page, kind, island, count(*) AS n FROM i GROUP BY 1, 2, 3, 4) GROUP BY 1, 2),
      p AS (SELECT doc_id, page, count(*) FILTER (kind <> 'unmapped') AS readable, count(*) FILTER (kind = 'unseen') AS f, count(*) FILTER (doc_id % 10 = 0 AND line <= 2 AND x <= 290) AS covered, count(*) FILTER (kind = 'unseen' AND doc_id % 7 <> 0 AND NOT (doc_id % 10 = 0 AND line <= 2 AND x <= 290)) AS hidden FROM k GROUP BY 1, 2),
      lines AS (SELECT doc_id, page, line, min(x) AS x0, max(x + 6) AS x1, min(y - h) AS y0, max(y) AS y1 FROM k WHERE doc_id % 7 = 0 GROUP BY 1, 2, 3 HAVING bool_and(kind <> 'unseen') AND bool_or(kind = 'seen')),
      over_ AS (SELECT doc_id, page, count(DISTINCT a * 64 + b) AS points FROM lines, range(63) u(a), range(64) v(b) WHERE (a + 0.5) / 64 * 612 BETWEEN x0 AND x1 AND (b + 0.5) / 64 * 792 BETWEEN y0 AND y1 GROUP BY 1, 2),
      q AS (SELECT p.*, coalesce(runs.unmapped, 0) AS unmapped, doc_id % 7 = 0 AND coalesce(points, 0) < 0.05 * 63 * 64 AND coalesce(runs.unseen, 0) < 3 AS bare FROM p JOIN runs USING (doc_id, page) LEFT JOIN over_ USING (doc_id, page))
      SELECT finding, count(*) AS pages FROM (SELECT unnest([CASE WHEN covered > 0 THEN 'covered-text' END, CASE WHEN hidden > 0 THEN 'hidden-text' END, CASE WHEN readable < 40 AND bare THEN 'scanned' END, CASE WHEN unmapped >= 3 OR readable = 0 THEN 'unreadable-text' END,
        CASE WHEN bare AND readable >= 40 THEN 'bare-picture' END, CASE WHEN doc_id % 7 = 0 AND f > 0 THEN 'machine-read-text' END]) AS finding FROM q) WHERE finding IS NOT NULL GROUP BY 1""",
    "synth_trim": f"""WITH c AS (SELECT *, CASE WHEN x + 6 <= 0 OR y <= 0 OR x >= width OR y - h >= 80 THEN 'outside' WHEN x < 0 OR y - h < 0 OR x + 6 > width OR y > 80 THEN 'edge' ELSE 'inside' END AS place FROM (SELECT *, 203.0 + doc_id % 3 * 100 AS width FROM ({_CHARS}))),
      m AS (SELECT doc_id, page, code, x, oy, count(*) FILTER (place = 'inside') AS inside, count(*) FILTER (place = 'edge') AS edge, count(*) FILTER (place = 'outside') AS outside,
        count(*) FILTER (place <> 'outside' AND NOT (place = 'edge' AND doc_id % 5 = 0) AND NOT (doc_id % 11 = 0 AND page = 2 AND idx % 7 = 0)) AS now FROM c GROUP BY 1, 2, 3, 4, 5)
      SELECT doc_id, page, sum(outside)::BIGINT AS trimmed, CASE WHEN bool_or(now > inside + edge OR now < inside) THEN 'unsupported' WHEN bool_or(now < inside + edge) THEN 'edge-text' WHEN sum(outside) > 0 THEN 'trimmed' ELSE 'kept' END AS verdict FROM m GROUP BY 1, 2""",
    "synth_replacement_text": f"""SELECT doc_id || '-' || page AS match_id, doc_id % 4 = 0 AND bool_or(line = 2 AND x + 3 <= 60 AND y - h / 2 BETWEEN 0 AND 30 AND code <> 63) AS replaced FROM ({_CHARS}) GROUP BY doc_id, page""",
    "synth_off_line": f"""WITH c AS ({_CHARS}), m AS (SELECT doc_id, page, line, list_sort(list(h))[(count(*) // 2) + 1] AS mh FROM c GROUP BY 1, 2, 3),
      t AS (SELECT doc_id, page, line, list_sort(list(oy))[(count(*) // 2) + 1] AS my, count(*) AS tall FROM c JOIN m USING (doc_id, page, line) WHERE h > mh * 0.9 GROUP BY 1, 2, 3),
      o AS (SELECT c.*, coalesce(h <= mh * 0.9 AND abs(oy - my) >= mh * 0.15 AND tall >= 3, false) AS off FROM c JOIN m USING (doc_id, page, line) LEFT JOIN t USING (doc_id, page, line)),
      n AS (SELECT *, coalesce(NOT lag(off) OVER w, false) OR coalesce(NOT lead(off) OVER w, false) AS beside, row_number() OVER w - row_number() OVER (PARTITION BY doc_id, page, line, off ORDER BY idx) AS g FROM o WINDOW w AS (PARTITION BY doc_id, page, line ORDER BY idx)),
      l AS (SELECT off, off AND count(*) OVER r <= 4 AND bool_or(beside) OVER r AS leaves FROM n WINDOW r AS (PARTITION BY doc_id, page, line, off, g))
      SELECT off AS off_line, leaves, count(*) AS n FROM l GROUP BY 1, 2""",
    "session_states": _SESSIONS + " SELECT job_id, arg_max(state, k) AS state, max(k) AS n_actions, arg_max(n_changes, k) AS n_changes, arg_max(ticked, k) AS ticked FROM r GROUP BY 1",
    "session_usage": _SESSIONS + " SELECT name, count(*) AS n FROM (SELECT CASE WHEN before = 'opening' AND state = 'reviewing' THEN 'document-opened' WHEN before = 'redacting' AND state = 'complete' THEN 'redaction-completed' WHEN before IN ('opening', 'redacting') AND action = 'failed' THEN 'run-refused' END AS name FROM r) WHERE name IS NOT NULL GROUP BY 1",
    "opt_out": "SELECT event_type = 'error' AS is_error, count(*) AS n FROM events WHERE event_type = 'error' OR NOT (user_id % 3 = 0 OR user_id % 5 = 0) GROUP BY 1",
    "kept_plan": """WITH a AS (SELECT user_id AS u, (epoch_us(ts) // 1000) AS t, event_id AS s, CASE event_type WHEN 'purchase' THEN 'paid' WHEN 'error' THEN 'unknown' ELSE 'free' END AS answer FROM events),
      b AS (SELECT *, last_value(CASE WHEN answer = 'paid' THEN t END IGNORE NULLS) OVER w AS paid_at, last_value(CASE WHEN answer <> 'unknown' THEN answer END IGNORE NULLS) OVER w AS said FROM a WINDOW w AS (PARTITION BY u ORDER BY t, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
      SELECT CASE WHEN answer = 'unknown' AND said = 'paid' AND t - paid_at <= 86400000 THEN 'paid' ELSE answer END AS shown, count(*) AS n FROM b GROUP BY 1""",
    "plan_states": "SELECT c_custkey, CASE WHEN c_custkey % 10 <> 0 THEN c_custkey % 2 = 0 END AS pro, CASE WHEN c_custkey % 10 <> 0 AND c_custkey % 3 = 0 THEN '2026-01-01' END AS renews_at, CASE WHEN c_custkey % 10 <> 0 THEN c_custkey % 3 = 0 AND c_custkey % 4 <> 0 END AS renewing, CASE WHEN c_custkey % 10 <> 0 THEN c_custkey % 3 <> 0 END AS other_product FROM customer",
    "entitlements": "SELECT CASE WHEN c_custkey % 7 <> 0 AND c_custkey % 4 <> 0 AND c_custkey % 5 <> 0 AND c_custkey % 2 = 0 THEN 'paid' ELSE 'free' END AS tier, CASE WHEN c_custkey % 7 = 0 THEN 'none' WHEN c_custkey % 4 = 0 THEN 'signed-out' WHEN c_custkey % 5 = 0 THEN 'unknown' ELSE 'signed-in' END AS account, count(*) AS n FROM customer GROUP BY 1, 2",
    "page_kinds": "SELECT ['home','sign-in','billing','account','pricing','not-found'][event_id % 6 + 1] AS page, count(*) AS n FROM events GROUP BY 1",
    "calendar_dates": "SELECT is_date, count(*) AS n FROM (SELECT " + _DAY.format(y="(1990 + o_orderkey % 40)", m="(o_orderkey % 14)", d="(o_orderkey % 33)") + " AS is_date FROM orders) GROUP BY 1",
    "dependency_closure": "WITH RECURSIVE e AS (SELECT n_nationkey AS src, (n_nationkey * 3 + 1) % 25 AS dst FROM nation UNION ALL SELECT n_nationkey, (n_nationkey + 10) % 25 FROM nation WHERE n_nationkey % 4 = 0), r AS (SELECT 0 AS node UNION SELECT dst FROM r JOIN e ON e.src = r.node) SELECT node::INT AS node FROM r",
    "geometry_scalars": "SELECT p_partkey, 8.0::DOUBLE AS height, round(sqrt(100 + k * k), 6) AS width, 80.0::DOUBLE AS area, true AS sound, 5 BETWEEN x AND x + 10 AND 20 - (y + (5 - x) * k / 10) BETWEEN 0 AND 8 AS holds, x + 5 AS cx, y + k / 2 + 4 AS cy FROM (SELECT p_partkey, (p_partkey % 50)::DOUBLE AS x, p_size::DOUBLE AS y, (p_partkey % 3)::DOUBLE AS k FROM part)",
    "contrast_scalars": "SELECT p_partkey, round(l, 6) AS luminance, round(1.05 / (l + 0.05), 5) AS contrast FROM (SELECT p_partkey, 0.2126 * a[1] + 0.7152 * a[2] + 0.0722 * a[3] AS l FROM (SELECT p_partkey, list_transform([(p_partkey % 7) / 6, (p_partkey % 11) / 10, (p_partkey % 13) / 12], lambda c: CASE WHEN c <= 0.04045 THEN c / 12.92 ELSE pow((c + 0.055) / 1.055, 2.4) END) AS a FROM part))",
    "synth_full_detection": "SELECT kind, ticked, count(*) AS n FROM orders, (VALUES ('email', true), ('us-ssn', true), ('phone', true), ('card', true), ('uk-nino', true), ('iban', true), ('date', false), ('date', true)) v(kind, ticked) GROUP BY 1, 2",
    "synth_lines": """WITH c AS (SELECT l_orderkey % 200 AS doc_id, (l_orderkey % 5 + 1)::INT AS page, l_linenumber AS line, (l_partkey % 60) * 10.0::DOUBLE AS x, l_linenumber * 14.0::DOUBLE AS y, 10.0::DOUBLE - CASE WHEN l_suppkey % 9 = 0 THEN 6 ELSE 0 END AS h FROM lineitem)
      SELECT doc_id, page, line, min(x) AS x0, min(y - h) AS y0, max(x + 6) AS x1, max(y) AS y1, count(*) AS n FROM c GROUP BY 1, 2, 3""",
}

QUERIES = {
    f.__name__: f
    for f in (
        email_matches, email_context, email_by_source, card_matches, card_by_brand, page_card_matches, phone_matches, term_counts, conversation_terms, masked_text, no_leak_after_mask,
        multiset_compare, counts_by_kind, gate_refusals, synth_iban, synth_ssn, synth_nino, synth_dates, synth_overlap, term_admission, output_names, page_lists, result_counts, refusal_lines,
        report_admission, report_budget, strict_events, opt_out, kept_plan, plan_states, entitlements, page_kinds, calendar_dates, dependency_closure, geometry_scalars, contrast_scalars,
        document_matches, page_matches, matches_by_source, document_terms, redacted_documents, redaction_proof, synth_full_detection, session_states, session_usage, synth_lines,
        synth_page_findings, synth_off_line, synth_reading_compare, synth_trim, synth_replacement_text, report_rules, policy_order, html_inventory, target_refusals, review_checklist, page_targets,
        detection_counts, result_sentences, crooked_notes, chosen_redaction, open_gates, removed_by_term, stripped_sentences, event_keys,
    )
} | page_queries.QUERIES | object_queries.QUERIES
ORACLE |= {
    "open_gates": """SELECT page_id, CASE WHEN octet_length(encode(html)) > 9000 THEN 'too-large' WHEN NOT contains(lower(left(html, 1024)), '<!doctype html') THEN 'not-pdf' WHEN NOT contains(html, '</html>') THEN 'corrupt' WHEN contains(url, 'pills') THEN 'password-required'
      WHEN len(string_split(html, '<p>')) > 13 THEN 'too-many-pages' WHEN contains(html, '<!-- ad 3') THEN 'hidden-layers' WHEN length(regexp_replace(regexp_replace(html, '(?is)<script.*?</script>|<style.*?</style>|<[^>]*>', '', 'g'), '[\\s\\p{Cc}\\p{Co}]', '', 'g')) < 150 THEN 'no-readable-text'
      WHEN contains(html, '<article></article>') THEN 'unsupported' ELSE 'opened' END AS refusal FROM pages""",
    "removed_by_term": f"WITH r AS ({_ROWS}) SELECT doc_id, kind, term, count(*) AS n FROM r WHERE ticked AND blocked IS NULL AND doc_id NOT IN (SELECT doc_id FROM r GROUP BY doc_id HAVING count(*) % 4 = 0) GROUP BY ALL",
    "stripped_sentences": "SELECT page_id, CASE WHEN len(s) = 0 THEN 'Nothing else needed stripping.' ELSE upper(t[1]) || t[2:] END AS sentence FROM (SELECT *, CASE WHEN len(s) <= 1 THEN array_to_string(s, '') ELSE array_to_string(s[:-2], ', ') || ' and ' || s[-1] END AS t FROM (SELECT page_id, list_filter([" + ", ".join(f"CASE WHEN regexp_matches(html, '{p}') THEN '{report.STRIPPED_NOUNS[k]}' END" for k, p in review.INVENTORY.items()) + "], lambda x: x IS NOT NULL) AS s FROM pages))",
    "event_keys": "SELECT k AS key, count(*) AS n FROM (SELECT [" + ", ".join("'" + _key(j) + "'" if ok else "NULL" for j, ok in SAMPLES) + f"][event_id % {len(SAMPLES)} + 1] AS k FROM events) WHERE k IS NOT NULL GROUP BY 1",
}
ORACLE |= page_queries.ORACLE | object_queries.ORACLE
