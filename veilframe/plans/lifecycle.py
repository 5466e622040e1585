"""From documents to matches, redacted text and proof. One Arrow stage does all that needs order inside a text."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import chars
from ..operators.resolve import detect
from ..operators.terms import batch_ok, carried, find_terms, reach
from ..operators import review
from ..sources.gates import Limits, spread

BLOCK, PAGE_BREAK = "█", "\f"
MATCHES = "doc_id long, match_id string, page int, block int, kind string, term string, notes array<string>, start int, end int, text string, before string, after string, before_cut boolean, after_cut boolean, ticked boolean, section string, blocked string"
#: Rows in an Arrow batch: texts are long.
ARROW_ROWS = "512"


def pages_of(text: str) -> list[str]:
    return text.split(PAGE_BREAK)


def blocks_of(page: str):
    """(block number, start in the page, text, joins): paragraphs, between empty lines. A line break is one character, as the space that stands for it is."""
    at = 0
    for i, raw in enumerate(page.split("\n\n")):
        if raw:
            text = raw.replace("\n", " ")
            yield i, at, text, [k for k, c in enumerate(raw if "\n" in raw else "") if c == "\n" and k and k + 1 < len(raw) and raw[k - 1] not in chars.SPACES and raw[k + 1] not in chars.SPACES]
        at += len(raw) + 2


def context(page: str, start: int, end: int, most: int) -> tuple[str, str, bool, bool]:
    """Up to `most` characters of the page on either side, runs of white space as one space, and whether more stood there."""
    size = 8 * most + 8
    while len(left := chars.collapse(page[max(0, start - size) : start])) <= most and size < start:
        size *= 2
    size = 8 * most + 8
    while len(right := chars.collapse(page[end : end + size])) <= most and end + size < len(page):
        size *= 2
    return left[len(left) - most :] if len(left) > most else left, right[:most], len(left) > most, len(right) > most


def read_document(doc_id, raw: str | None, terms: list[tuple[str, str]], limits: Limits, bare: bool = False) -> list[tuple]:
    """All matches of a document, page by page: detected kinds, then terms. bare: without ids and context."""
    out = []
    tail, most = "", max((reach(t) for _, t in terms), default=0)
    for p, page in enumerate(pages_of(chars.normalise(raw or ""))):
        rows = []
        for b, at, text, joins in blocks_of(page):
            for s in detect(text, joins):
                shown = text[s.start : s.end]
                if s.kind == "email":
                    shown = "".join(c for k, c in enumerate(shown, s.start) if k not in joins)
                rows.append((b, s.kind, None, [], at + s.start, at + s.end, shown, s.ticked))
        if terms:
            joined, start = (f"{tail} {page}", len(tail) + 1) if tail else (page, 0)
            flat = joined.replace("\n", " ")
            breaks = [k for k, c in enumerate(joined) if c == "\n"] + ([start - 1] if tail else [])
            for s in find_terms(flat, terms, breaks, start):
                a, z = max(0, s.start - start), s.end - start
                rows.append((None, "term", s.term, list(s.notes), a, z, chars.collapse(page[a:z]), not s.notes))
            tail = page[carried(page, most) :] if page.strip() else tail
        for b, kind, term, notes, a, z, shown, ticked in rows:
            before, after, bcut, acut = (None, None, None, None) if bare else context(page, a, z, limits.context)
            key = None if bare else hashlib.sha256(f"{doc_id}|{p}|{a}|{z}|{kind}|{term or ''}".encode()).hexdigest()[:32]
            out.append((doc_id, key, p + 1, b, kind, term, notes, a, z, shown, before, after, bcut, acut, ticked, "held-part" if "page-break" in notes else "ordinary", None))
    return out


@lru_cache(maxsize=1)
def marked() -> tuple[str, str]:
    """Patterns for the characters whose normalised form holds @ or a digit: the plain ones, and the others, of which a character below the first of them beyond Latin-1 is refused before the long class is tried."""
    held = [n for n in range(0x80, 0x110000) if not 0xD800 <= n < 0xE000 and any(c == "@" or unicodedata.category(c) == "Nd" for c in chars.normalise(chr(n)))]
    ranges: list[list[int]] = []
    for n in held:
        if ranges and ranges[-1][1] == n - 1:
            ranges[-1][1] = n
        else:
            ranges.append([n, n])
    said = lambda rs: "[" + "".join(f"{re.escape(chr(a))}-{re.escape(chr(z))}" for a, z in rs) + "]"
    latin, rest = [r for r in ranges if r[1] < 0x100], [r for r in ranges if r[1] >= 0x100]
    return "[@0-9]", f"{said(latin)}|(?=[^\0-{chr(rest[0][0] - 1)}]){said(rest)}"


_TYPES = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.string()), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.bool_(), pa.bool_(), pa.string(), pa.string())
_NAMES = [c.split()[0] for c in MATCHES.split(", ")]


def _searchable(terms: list[tuple[str, str]] | None, limits: Limits) -> list[tuple[str, str]]:
    """A batch of terms that may be searched; any other is refused whole."""
    if terms and not batch_ok(terms, limits.most_terms, limits.most_term_chars):
        raise ValueError("terms must have ids of their own and be admissible as they are written")
    return list(terms or [])


#: Columns of the review table that cost more to write than the rest of a row.
COSTLY = {"match_id", "before", "after", "before_cut", "after_cut"}


def matches(docs: DataFrame, terms: list[tuple[str, str]] | None = None, limits: Limits = Limits(), columns: tuple[str, ...] = (), dealt: bool = False) -> DataFrame:
    """The review table of (doc_id, text), or some of its columns: offsets are code points of the normalised page. dealt: rows have been dealt out already. No shuffle; texts without @, digit or term never reach a detector."""
    names = list(columns) or _NAMES
    at, bare = [_NAMES.index(c) for c in names], not COSTLY & set(names)
    listed = _searchable(terms, limits)

    def run(batches):
        for b in batches:
            for i in range(0, len(b), 64):
                rows = [r for d, t in zip(b.column(0)[i : i + 64].to_pylist(), b.column(1)[i : i + 64].to_pylist(), strict=True) if t for r in read_document(d, t, listed, limits, bare)]
                if rows:
                    found = list(zip(*rows, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(found[k], _TYPES[k]) for k in at], names)

    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    some = docs.select(F.col("doc_id").cast("long"), "text")
    some = some if listed else some.filter(F.col("text").rlike(marked()[0]) | F.col("text").rlike(marked()[1]))
    return (some if dealt else spread(some)).mapInArrow(run, ", ".join(MATCHES.split(", ")[k] for k in at))


TERM_ROWS = "doc_id long, page int, term string, notes array<string>, part string, start int, end int, text string"


def page_terms(pages: DataFrame, terms: list[tuple[str, str]], limits: Limits = Limits()) -> DataFrame:
    """Terms in documents whose pages are rows (doc_id, page, text): what stands on a page ('whole'), and what runs over a page break, as two rows: its 'first' part on the last page before that is not blank, its 'second' on this one.

    A window in order of pages hands each page the one that it may go on from; then a page is read by itself. Null texts are
    blank; rows of the same page go by text; extra columns are left behind.
    """
    listed = _searchable(terms, limits)
    most = max((reach(t) for _, t in terms), default=0)
    before = Window.partitionBy("doc_id").orderBy("page", "text").rowsBetween(Window.unboundedPreceding, -1)
    told = F.col("text").rlike(f"[^{chars.SPACE_CHARS}]")
    rows = pages.select(F.col("doc_id").cast("long"), F.col("page").cast("int"), "text")
    rows = rows.withColumn("last", F.last(F.when(told, F.struct("page", "text")), ignorenulls=True).over(before)).filter(told).select("doc_id", "page", "text", F.col("last.page").alias("from"), F.col("last.text").alias("tail"))

    def read(doc_id, page, text, from_page, old) -> list[tuple]:
        text, old, out = chars.normalise(text), chars.normalise(old or ""), []
        at = carried(old, most)
        tail = old[at:]
        joined, start = (f"{tail} {text}", len(tail) + 1) if tail else (text, 0)
        breaks = [k for k, c in enumerate(joined) if c == "\n"] + ([start - 1] if tail else [])
        for s in find_terms(joined.replace("\n", " "), listed, breaks, start):
            over = s.start < start
            if over:
                a, z = at + s.start, at + min(s.end, len(tail))
                out.append((doc_id, from_page, s.term, list(s.notes), "first", a, z, chars.collapse(old[a:z])))
            a, z = max(0, s.start - start), s.end - start
            out.append((doc_id, page, s.term, list(s.notes), "second" if over else "whole", a, z, chars.collapse(text[a:z])))
        return out

    def run(batches):
        kinds = (pa.int64(), pa.int32(), pa.string(), pa.list_(pa.string()), pa.string(), pa.int32(), pa.int32(), pa.string())
        for b in batches:
            for i in range(0, len(b), 64):
                found = [r for row in zip(*(c[i : i + 64].to_pylist() for c in b.columns), strict=True) for r in read(*row)]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), kinds, strict=True)], [c.split()[0] for c in TERM_ROWS.split(", ")])

    pages.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    return rows.mapInArrow(run, TERM_ROWS)


def selected(found: DataFrame, ticks: DataFrame | None = None) -> DataFrame:
    """What goes: the default ticks, or a table (match_id, on) of the reader's own on top of them."""
    if ticks is None:
        return found.filter("ticked and blocked is null")
    last = ticks.groupBy("match_id").agg(F.max_by("on", "seq").alias("on"))
    return found.join(last, "match_id", "left").filter(F.coalesce("on", "ticked") & F.col("blocked").isNull()).drop("on")


def blot(page: str, spans: list[tuple[int, int]]) -> str:
    """Every character of the spans blotted out; offsets stay what they were."""
    out = list(page)
    for a, z in spans:
        out[a:z] = BLOCK * (min(z, len(out)) - a)
    return "".join(out)


def _blotted(text: str | None, spans: list[dict]) -> str | None:
    """Normalised text with spans (page, start, end) blotted out."""
    if text is None:
        return None
    pages = pages_of(chars.normalise(text))
    for p in {s["page"] for s in spans}:
        pages[p - 1] = blot(pages[p - 1], [(s["start"], s["end"]) for s in spans if s["page"] == p])
    return PAGE_BREAK.join(pages)


def _sound(text: str | None, spans: list[dict]) -> bool:
    """Do all targets hold up: on their page, not blank, and what they say stands there, white space aside?"""
    pages = pages_of(chars.normalise(text or ""))
    squeezed = lambda t: "".join(c for c in t or "" if c not in chars.SPACES)
    return all(1 <= s["page"] <= len(pages) and 0 <= s["start"] < s["end"] <= len(pages[s["page"] - 1]) and squeezed(s["text"]) and squeezed(s["text"]) in squeezed(pages[s["page"] - 1][s["start"] : s["end"]]) for s in spans)


def redact(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """(doc_id, text, n_removed, refusal): documents in normalised text with the chosen matches blotted out. Spans, a few rows a document, are gathered before they meet the text.

    A document with a target that does not hold up ('unsupported') stays as it was, with nothing removed.
    """
    spans = chosen.groupBy("doc_id").agg(F.collect_list(F.struct("page", "start", "end", "text")).alias("spans"))

    def run(batches):
        for b in batches:
            texts, n, why = [], [], []
            for t, spans_ in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                ok = _sound(t, spans_ or [])
                texts.append(_blotted(t, (spans_ or []) if ok else []))
                n.append(len(spans_ or []) if ok else 0)
                why.append(None if ok else "unsupported")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array(n, pa.int64()), pa.array(why, pa.string())], ["doc_id", "text", "n_removed", "refusal"])

    return docs.select("doc_id", "text").join(spans, "doc_id", "left").select("doc_id", "text", "spans").mapInArrow(run, "doc_id long, text string, n_removed long, refusal string")


def redact_all(docs: DataFrame, terms: list[tuple[str, str]] | None = None, limits: Limits = Limits()) -> DataFrame:
    """(doc_id, text, n_removed, leaked, lost, added): with the default ticks a document is read, blotted out and proved where it lies, in one Arrow stage: no text is shuffled."""
    listed, could = _searchable(terms, limits), regex.compile("|".join(marked()))

    def run(batches):
        for b in batches:
            for i in range(0, len(b), 64):
                rows = []
                for d, t in zip(b.column(0)[i : i + 64].to_pylist(), b.column(1)[i : i + 64].to_pylist(), strict=True):
                    found = read_document(d, t, listed, limits) if t and (listed or could.search(t)) else []
                    spans = [{"page": r[2], "start": r[7], "end": r[8]} for r in found if r[14]]
                    new = _blotted(t, spans)
                    rows.append((d, new, len(spans), *proof(t, new, spans)))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "text", "n_removed", "leaked", "lost", "added"])

    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    return spread(docs.select(F.col("doc_id").cast("long"), "text")).mapInArrow(run, "doc_id long, text string, n_removed long, leaked long, lost long, added long")


VERDICTS = ("leak", "over-reach", "replaced", "nothing-ticked", "pass")


def proof(old: str | None, new: str | None, spans: list[dict]) -> tuple[int, int, int]:
    """(leaked, lost, added) of a rewritten text: chosen spans in which a character still stands where it stood, characters outside them that are gone, and ones that were not there."""
    leaked = lost = added = 0
    was, now = pages_of(chars.normalise(old or "")), pages_of(new or "")
    for p, (x, y) in enumerate(zip(was, now, strict=False), 1):
        own = [s for s in spans if s["page"] == p]
        added += max(0, len(y) - len(x))
        if not own and x == y:
            continue
        gone = bytearray(len(x))
        for s in own:
            a, z = s["start"], s["end"]
            leaked += any(c not in chars.SPACES and c == d for c, d in zip(x[a:z], y[a:z], strict=False))
            gone[a:z] = b"\1" * (min(z, len(x)) - a)
        lost += sum(not g and c not in chars.SPACES and y[i : i + 1] != c for i, (c, g) in enumerate(zip(x, gone, strict=True)))
    return leaked, lost + sum(len(x) for x in was[len(now) :]), added + sum(len(y) for y in now[len(was) :])


def judged(proved: DataFrame) -> DataFrame:
    """Rows with leaked, lost, added, n_removed: verdict is the first of VERDICTS that applies; outcome what a run would be refused as (null: it stands)."""
    leaked, lost, added, ticked = F.col("leaked") > 0, F.col("lost") > 0, F.col("added") > 0, F.col("n_removed") > 0
    verdict = F.when(leaked, "leak").when(lost, "over-reach").when(added, "replaced").when(~ticked, "nothing-ticked").otherwise("pass")
    return proved.withColumn("verdict", verdict).withColumn("outcome", review.outcome(ticked, F.lit(False), F.lit(False), leaked, F.lit(False), added, lost))


def verify(docs: DataFrame, redacted: DataFrame, chosen: DataFrame) -> DataFrame:
    """(doc_id, leaked, lost, added, n_removed, verdict, outcome): the proof on the rewritten text."""
    spans = chosen.groupBy("doc_id").agg(F.collect_list(F.struct("page", "start", "end")).alias("spans"))
    both = docs.select("doc_id", F.col("text").alias("old")).join(redacted.select("doc_id", F.col("text").alias("new"), "n_removed"), "doc_id").join(spans, "doc_id", "left")

    def run(batches):
        for b in batches:
            rows = [proof(old, new, spans_ or []) for old, new, spans_ in zip(*(b.column(i).to_pylist() for i in (1, 2, 4)), strict=True)]
            cols = list(zip(*rows, strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in cols), b.column(3)], ["doc_id", "leaked", "lost", "added", "n_removed"])

    return judged(both.select("doc_id", "old", "new", "n_removed", "spans").mapInArrow(run, "doc_id long, leaked long, lost long, added long, n_removed long"))
