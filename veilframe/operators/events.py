"""Event operators: strict parsing, report keys and admission, opt-out, plans and entitlements, page kinds."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.geometry import let
from ..sources.shared import cut
from .report import BUCKETS

# Closed lists that events may hold.
MATCH_KINDS = ("email", "phone", "date", "card", "iban", "us-ssn", "uk-nino", "term")
BLOCKED = ("unsound-outline", "replacement-text", "slanted-text", "image-overreach")
PAGE_FINDINGS = ("covered-text", "hidden-text", "scanned", "drawn-only", "unreadable-text", "bare-picture", "off-page-picture", "marked-descriptions", "machine-read-text", "off-page-content", "blank")
PAGE_KINDS = ("home", "tool", "pricing", "privacy", "terms", "sign-in", "sign-up", "account", "billing", "welcome", "not-found")
TIERS, ACCOUNTS = ("free", "paid"), ("none", "signed-out", "signed-in", "unknown")
STEPS, CAPS, CRASHES = ("open", "redact"), ("pages", "size"), ("error", "rejection")
FAILURES = ("engine-unavailable", "encrypted", "password-required", "corrupt", "unsupported", "too-large", "too-many-pages", "file-unreadable", "not-pdf", "hidden-layers", "redaction-incomplete", "redaction-overreach", "replacement-text", "slanted-text", "no-readable-text", "edge-text", "unreadable-structure")
STRIPPED = ("document-info", "xmp-metadata", "annotations", "form-fields", "attachments", "bookmarks", "hidden-layers", "javascript", "incremental-versions", "page-thumbnails", "accessibility-tags")
ROUTES = ("home", "tool", "pricing", "privacy", "terms", "not-found", "entitlement", "telemetry", "account", "subscribe", "billing", "welcome", "sign-in", "sign-up", "proxy", "other")
ROUTE_TYPES = ("render", "route", "action", "proxy", "other")
BILLING_ACTIONS = ("subscribe", "portal", "delete", "welcome")
BILLING_OUTCOMES = ("plan-unknown", "customer-conflict", "other-product", "checkout-failed", "portal-failed", "billing-failed", "sign-in-kept", "still-waiting")
_ONE, _MAP, _SET = "one", "map", "set"
EVENTS: dict[str, dict[str, tuple[str, tuple[str, ...]]]] = {
    "page-view": {"page": (_ONE, PAGE_KINDS)},
    "document-opened": {"pages": (_ONE, BUCKETS), "found": (_MAP, MATCH_KINDS), "blocked": (_MAP, BLOCKED), "pagesWith": (_MAP, PAGE_FINDINGS), "tier": (_ONE, TIERS), "account": (_ONE, ACCOUNTS)},
    "redaction-completed": {"removed": (_MAP, MATCH_KINDS), "unticked": (_MAP, MATCH_KINDS), "blockedByKind": (_MAP, MATCH_KINDS), "blockedByReason": (_MAP, BLOCKED), "terms": (_ONE, BUCKETS), "termsSetAside": (_ONE, BUCKETS), "stripped": (_SET, STRIPPED), "tier": (_ONE, TIERS), "account": (_ONE, ACCOUNTS)},
    "run-refused": {"kind": (_ONE, FAILURES), "step": (_ONE, STEPS), "tier": (_ONE, TIERS), "account": (_ONE, ACCOUNTS)},
    "cap-reached": {"cap": (_ONE, CAPS), "account": (_ONE, ACCOUNTS)},
    "subscribe-started": {},
    "subscription-confirmed": {},
    "server-crash": {"route": (_ONE, ROUTES), "routeType": (_ONE, ROUTE_TYPES)},
    "plan-check-failed": {},
    "browser-crash": {"page": (_ONE, PAGE_KINDS), "kind": (_ONE, CRASHES)},
    "engine-unavailable": {},
    "billing-failed": {"action": (_ONE, BILLING_ACTIONS), "outcome": (_ONE, BILLING_OUTCOMES)},
}
#: Reports that pages send; they share a budget a day, but for the one billing failure that they send.
PAGE_EVENTS = ("browser-crash", "engine-unavailable")
HOUR_MS, DAY_MS, PAGE_REPORTS = 3_600_000, 86_400_000, 20
MOST_BYTES = 2048


def _is(value: Column, kind: str) -> Column:
    """Is a variant of this kind (STRING, OBJECT, ARRAY)?"""
    return F.coalesce(F.schema_of_variant(value).startswith(kind), F.lit(False))


def _string(value: Column) -> Column:
    """A variant that is a string, or null."""
    return F.when(_is(value, "STRING"), F.try_variant_get(value, "$", "string"))


def _field(value: Column, shape: str, allowed: tuple[str, ...]) -> Column:
    """A field's canonical JSON, or null where it does not hold: one of `allowed`; a map from them to counted ranges above '0'; or a set of them. Maps and sets come in the order of `allowed`."""
    quoted = lambda t: F.concat(F.lit('"'), t, F.lit('"'))
    listed = F.array(*(F.lit(a) for a in allowed))
    if shape == _ONE:
        return let(_string(value), lambda own: F.when(own.isin(*allowed), quoted(own)))
    if shape == _MAP:

        def as_map(held: Column) -> Column:
            ok = _is(value, "OBJECT") & (F.size(F.array_except(F.map_keys(held), listed)) == 0) & F.forall(F.map_values(held), lambda v: F.coalesce(v.isin(*BUCKETS[1:]), F.lit(False)))
            kept = F.filter(listed, lambda k: F.map_contains_key(held, k))
            return F.when(ok, F.concat(F.lit("{"), F.array_join(F.transform(kept, lambda k: F.concat(quoted(k), F.lit(":"), quoted(F.element_at(held, k)))), ","), F.lit("}")))

        return let(F.transform_values(F.try_variant_get(value, "$", "map<string,variant>"), lambda _, v: _string(v)), as_map)

    def as_set(items: Column) -> Column:
        ok = _is(value, "ARRAY") & F.forall(items, lambda v: F.coalesce(v.isin(*allowed), F.lit(False))) & (F.size(F.array_distinct(items)) == F.size(items))
        return F.when(ok, F.concat(F.lit("["), F.array_join(F.transform(F.array_intersect(listed, items), quoted), ","), F.lit("]")))

    return let(F.transform(F.try_variant_get(value, "$", "array<variant>"), _string), as_set)


def strict_events(events: DataFrame, column: str = "json") -> DataFrame:
    """The rows with valid, name and canonical JSON: exactly an event's fields, closed values, no repeats, counted ranges never '0', at most MOST_BYTES bytes. Each shape is an expression over the parsed value; the first that fits, by name, decides. Text that is no JSON, or names a field twice, is not valid. An event is parsed and judged once: filters on the result do not repeat it."""
    held, name = F.col("_held"), F.col("_name")
    shapes = F.lit(None).cast("string")
    for event, fields in EVENTS.items():
        keys = F.array(*(F.lit(k) for k in sorted(["name", *fields])))
        whole = F.concat(F.lit(f'{{"name":"{event}"'), *(F.concat(F.lit(f',"{k}":'), _field(F.element_at(held, k), shape, allowed)) for k, (shape, allowed) in fields.items()), F.lit("}"))
        shapes = F.when((name == event) & (F.sort_array(F.map_keys(held)) == keys), whole).otherwise(shapes)
    short = F.when(F.octet_length(column) <= MOST_BYTES, F.try_parse_json(column))
    parsed = events.withColumn("_held", F.try_variant_get(short, "$", "map<string,variant>")).withColumn("_name", _string(F.element_at(F.col("_held"), "name")))
    found = parsed.withColumn("canonical", F.explode(F.array(shapes)))  # a filter does not pass it
    return found.select(*events.columns, F.col("canonical").isNotNull().alias("valid"), F.when(F.col("canonical").isNotNull(), name).alias("name"), "canonical")


def flatten_fields(events: DataFrame, column: str, key: str) -> DataFrame:
    """A map column as rows named '<column>_<key>'."""
    return events.select(key, F.explode(column).alias("k", "value")).select(key, F.concat_ws("_", F.lit(column), "k").alias("field"), "value")


def report_key(*fields: Column) -> Column:
    return F.concat_ws(" ", *fields)


def admitted(reports: DataFrame, window_ms: int = HOUR_MS) -> DataFrame:
    """(key, ts_ms, admitted): a report is admitted unless its key was within the window before. The window runs from the last one admitted, so it is a fold in time; keys go in parallel, and a task carries one key's last time, however many reports the key has."""

    def run(batches):
        key, last = None, None
        for b in batches:
            ok = []
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if k != key:
                    key, last = k, None
                ok.append(last is None or t - last >= window_ms)
                last = t if ok[-1] else last
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ok, pa.bool_())], ["key", "ts_ms", "admitted"])

    return reports.select("key", "ts_ms").repartition("key").sortWithinPartitions("key", "ts_ms").mapInArrow(run, "key string, ts_ms long, admitted boolean")


def within_budget(reports: DataFrame, budget: int = PAGE_REPORTS) -> DataFrame:
    """Of (key, ts_ms, from_page), the first `budget` of a UTC day that come from pages; others draw on nothing. Keys are unique. Only the first of each day are ranked: each task passes on `budget` of a day at most."""
    marked = reports.withColumn("day", F.floor(F.col("ts_ms") / DAY_MS))
    first = marked.filter("from_page").withColumn("k", F.row_number().over(Window.partitionBy("day").orderBy("ts_ms", "key"))).filter(F.col("k") <= budget).select("key", F.lit(True).alias("first"))
    return marked.join(first, "key", "left").withColumn("admitted", ~F.col("from_page") | F.coalesce("first", F.lit(False))).drop("first")


class Admission:
    """Both rules over the reports of one server instance in time: a key once a window since it was last admitted, then the day's budget of page reports. A report that either refuses leaves nothing behind."""

    def __init__(self, window_ms: int = HOUR_MS, budget: int = PAGE_REPORTS, sent: dict[str, int] | None = None, day: int = -1, spent: int = 0):
        self.window_ms, self.budget, self.sent, self.day, self.spent = window_ms, budget, dict(sent or {}), day, spent

    def take(self, key: str, ts_ms: int, draws: bool) -> bool:
        last, day = self.sent.get(key), ts_ms // DAY_MS
        spent = self.spent if day == self.day else 0
        if (last is not None and ts_ms - last < self.window_ms) or (draws and spent >= self.budget):
            return False
        self.sent[key] = ts_ms
        if draws:
            self.day, self.spent = day, spent + 1
        return True

    def forget(self, ts_ms: int) -> None:
        """Drop what no later report can meet."""
        self.sent = {k: t for k, t in self.sent.items() if ts_ms - t < self.window_ms}


def admit_reports(reports: DataFrame, window_ms: int = HOUR_MS, budget: int = PAGE_REPORTS) -> DataFrame:
    """(instance, seq, key, ts_ms, admitted) of (instance, seq, key, ts_ms, draws) by both rules; instances go in parallel, each in time, and a task holds the keys of one window."""

    def run(batches):
        instance, rule, n = None, None, 0
        for b in batches:
            ok = []
            for i, k, t, draws in zip(*(b.column(c).to_pylist() for c in (0, 2, 3, 4)), strict=True):
                if rule is None or i != instance:
                    instance, rule = i, Admission(window_ms, budget)
                ok.append(rule.take(k, t, draws))
                n += 1
                if n % 4096 == 0:
                    rule.forget(t)
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(ok, pa.bool_())], ["instance", "seq", "key", "ts_ms", "admitted"])

    order = reports.select(F.col("instance").cast("string"), F.col("seq").cast("long"), "key", "ts_ms", "draws").repartition("instance").sortWithinPartitions("instance", "ts_ms", "seq")
    return order.mapInArrow(run, "instance string, seq long, key string, ts_ms long, admitted boolean")


def kept(events: DataFrame) -> DataFrame:
    """Usage counts go unless the reader opts out (gpc or dnt); error reports always."""
    return events.filter(F.col("is_error") | ~(F.coalesce("gpc", F.lit(False)) | F.coalesce("dnt", F.lit(False))))


PLAN_STATE = "struct<granted_benefits:array<struct<benefit_id:string>>,active_subscriptions:array<struct<product_id:string,current_period_end:string,cancel_at_period_end:boolean>>>"


def plan_columns(state: Column, benefit: str, product: str) -> list[Column]:
    """pro, renews_at, renewing, other_product of a customer's state in JSON; all null where it is malformed."""
    s = F.from_json(state, PLAN_STATE)
    grants, subs = s["granted_benefits"], s["active_subscriptions"]
    own = F.filter(subs, lambda x: x["product_id"] == product)
    bad = grants.isNull() | subs.isNull() | F.exists(grants, lambda g: g["benefit_id"].isNull()) | F.exists(subs, lambda x: x["product_id"].isNull()) | F.exists(own, lambda x: x["cancel_at_period_end"].isNull()) | ((F.size(own) > 0) & F.get(own, F.lit(0))["current_period_end"].isNull())
    said = lambda c: F.when(~F.coalesce(bad, F.lit(True)), c)
    return [
        said(F.exists(grants, lambda g: g["benefit_id"] == benefit)).alias("pro"), said(F.get(own, F.lit(0))["current_period_end"]).alias("renews_at"),
        said(F.exists(own, lambda x: ~x["cancel_at_period_end"])).alias("renewing"), said(F.exists(subs, lambda x: x["product_id"] != product)).alias("other_product"),
    ]


def entitlement(billing: Column, session: Column, pro: Column) -> list[Column]:
    """tier and account: the first rule that applies."""
    account = F.when(~billing, "none").when(session != "user", session).when(pro.isNull(), "unknown").otherwise("signed-in")
    return [F.when(billing & (session == "user") & F.coalesce(pro, F.lit(False)), "paid").otherwise("free").alias("tier"), account.alias("account")]


KEEP_PAID_MS = 30 * 60 * 1000


def kept_plan(answers: DataFrame, keep_ms: int = KEEP_PAID_MS) -> DataFrame:
    """(user, ts_ms, shown): an 'unknown' answer keeps 'paid' for a while after the last answer that said so."""
    w = Window.partitionBy("user").orderBy("ts_ms", "seq")
    last_paid = F.last(F.when(F.col("answer") == "paid", F.col("ts_ms")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    last_said = F.last(F.when(F.col("answer") != "unknown", F.col("answer")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    keep = (F.col("answer") == "unknown") & (last_said == "paid") & (F.col("ts_ms") - last_paid <= keep_ms)
    return answers.select("user", "ts_ms", "seq", F.when(keep, "paid").otherwise(F.col("answer")).alias("shown"))


#: How long a read waits for an answer, and how old the page's answer may be before a read asks again.
WAIT_MS, REFRESH_MS = 4_000, 5 * 60 * 1000


def plan_at(reads: DataFrame, answers: DataFrame, keep_ms: int = KEEP_PAID_MS) -> DataFrame:
    """Each read (user, ts_ms, ...) with shown and asks, by the last answer (user, ts_ms, took_ms, answer) that had come by then: an as-of join.

    An answer counts from when it comes, and as unknown, after WAIT_MS, if it takes longer. An unknown one keeps 'paid' while the
    last paid answer is at most keep_ms old; asks: there is no answer yet, or it is older than REFRESH_MS. Both tables run
    through one window a user, answers before reads of the same moment; of answers of one moment the greatest counts.
    """
    late = F.col("took_ms") > WAIT_MS
    come = answers.select("user", (F.col("ts_ms") + F.least("took_ms", F.lit(WAIT_MS))).alias("ts_ms"), F.when(late, "unknown").otherwise(F.col("answer")).alias("_answer"), F.lit(0).alias("_side"))
    both = reads.withColumns({"_side": F.lit(1), "_answer": F.lit(None).cast("string")}).unionByName(come, allowMissingColumns=True)
    w = Window.partitionBy("user").orderBy("ts_ms", "_side", "_answer").rowsBetween(Window.unboundedPreceding, 0)
    last = lambda when, value: F.last(F.when(when, value), ignorenulls=True).over(w)
    here = F.col("_side") == 0
    both = both.withColumns({
        "_last": last(here, F.struct("_answer", "ts_ms")), "_said": last(here & (F.col("_answer") != "unknown"), F.col("_answer")), "_paid": last(here & (F.col("_answer") == "paid"), F.col("ts_ms")),
    }).filter("_side = 1")
    keeps = (F.col("_last._answer") == "unknown") & (F.col("_said") == "paid") & (F.col("ts_ms") - F.col("_paid") <= keep_ms)
    return both.select(*reads.columns, F.when(keeps, "paid").otherwise(F.coalesce("_last._answer", F.lit("unknown"))).alias("shown"), F.coalesce(F.col("ts_ms") - F.col("_last.ts_ms") > REFRESH_MS, F.lit(True)).alias("asks"))


# Paths of the pages.
PATHS = {"/": "home", "/tool": "tool", "/pricing": "pricing", "/privacy": "privacy", "/terms": "terms", "/account/billing": "billing", "/welcome": "welcome"}
UNDER = (("/sign-in", "sign-in"), ("/sign-up", "sign-up"), ("/account", "account"))


def page_kind(path: Column) -> Column:
    out = F.lit("not-found")
    for base, kind in reversed(UNDER):
        out = F.when((path == base) | path.startswith(f"{base}/"), kind).otherwise(out)
    for exact, kind in PATHS.items():
        out = F.when(path == exact, kind).otherwise(out)
    return out


def language_tag(tag: Column) -> Column:
    """Does a string have the shape of a language tag?"""
    return tag.rlike("^[A-Za-z]{2,3}([-_][A-Za-z0-9]{1,8})*$")


def calendar_date(text: Column) -> Column:
    """A real day written yyyy-mm-dd."""
    return text.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & F.try_to_timestamp(text, F.lit("yyyy-MM-dd")).isNotNull()


def newest_first(entries: DataFrame, *by: str) -> DataFrame:
    """(by, newest_first): are the dates (yyyy-mm-dd) of (by, position, date) real days, each later than the next?"""
    w = Window.partitionBy(*by).orderBy("position")
    before = F.lag("date").over(w)
    return entries.withColumn("ok", calendar_date(F.col("date")) & (before.isNull() | (before > F.col("date")))).groupBy(*by).agg(F.bool_and("ok").alias("newest_first"))


def closure(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Everything reachable from roots (node) over edges (src, dst): rounds of joins until nothing is new, the lineage cut in each."""
    seen = frontier = cut(roots.select("node").distinct())
    while not frontier.isEmpty():
        frontier = cut(frontier.join(edges, frontier.node == edges.src).select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti"))
        seen = cut(seen.union(frontier))
    return seen


def licence_verdict(expression: Column, allowed: list[str]) -> Column:
    """Is a licence expression met by allowed licences? OR needs one side, AND both, parentheses group, 'X WITH Y' is one licence; null where it cannot be read.

    A fold over its tokens. The stack holds, for each open group, what its alternatives came to and what the one being read has
    come to (null: nothing yet); `wants` says that a licence or a group must come next. A token that may not come empties the stack.
    """
    spaced = F.regexp_replace(F.regexp_replace(expression, r"([()])", " $1 "), r"(?<![^\s])(?!(?:AND|OR|WITH|[()])\s)(\S+)\s+WITH\s+(\S+)", "$1\u0001WITH\u0001$2")
    tokens = F.filter(F.split(spaced, r"\s+"), lambda t: t != "")
    level = lambda other, own: F.struct(other.cast("boolean").alias("other"), own.cast("boolean").alias("own"))
    state = lambda wants, stack: F.struct(wants.cast("boolean").alias("wants"), stack.alias("stack"))
    none = F.lit(None)
    either = lambda f: F.when(f["other"].isNull(), f["own"]).otherwise(f["other"] | f["own"])
    outer = lambda stack: F.slice(stack, F.lit(1), F.size(stack) - 1)
    lost = state(F.lit(False), F.array(level(none, none)))  # a stack that no token may leave: see the end

    def met(stack: Column, value: Column) -> Column:
        top = F.element_at(stack, -1)
        return F.concat(outer(stack), F.array(level(top["other"], F.when(top["own"].isNull(), value).otherwise(top["own"] & value))))

    def step(now: Column, token: Column) -> Column:
        stack, top = now["stack"], F.element_at(now["stack"], -1)
        deep = F.size(stack) > 1
        return (
            F.when(~now["wants"] & top["own"].isNull(), lost)
            .when(now["wants"] & (token == "("), state(F.lit(True), F.concat(stack, F.array(level(none, none)))))
            .when(now["wants"] & ~token.isin("(", ")", "AND", "OR", "WITH"), state(F.lit(False), met(stack, F.regexp_replace(token, "\u0001", " ").isin(*allowed))))
            .when(now["wants"], lost)
            .when((token == ")") & deep, state(F.lit(False), met(outer(stack), either(top))))
            .when(token == "AND", state(F.lit(True), stack))
            .when(token == "OR", state(F.lit(True), F.concat(outer(stack), F.array(level(either(top), none)))))
            .otherwise(lost)
        )

    def end(now: Column) -> Column:
        top = F.element_at(now["stack"], -1)
        return F.when(~now["wants"] & (F.size(now["stack"]) == 1) & top["own"].isNotNull(), either(top))

    return F.aggregate(tokens, state(F.lit(True), F.array(level(none, none))), step, end)
