from __future__ import annotations

import duckdb
import pandas as pd
import pytest
from conftest import SF
from pyspark.sql import functions as F

from veilframe.operators import events, findings, native, pages, report, review, session, spatial
from veilframe.plans import jobs, lifecycle, queries
from veilframe.sources.gates import Limits, files_at_the_door

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(df: pd.DataFrame) -> list[tuple]:
    def cell(v):
        if v is None or v is pd.NA or (isinstance(v, float) and v != v):
            return None
        return round(float(v), 5) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    df = df[sorted(df.columns)]
    return sorted((tuple(cell(v) for v in r) for r in df.astype(object).itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_matches_sql(spark, duck, name):
    got, expected = queries.QUERIES[name](spark, SF).toPandas(), duck.sql(queries.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(expected.columns)
    assert plain(got) == plain(expected)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE)))
def test_query_runs(spark, name):
    assert queries.QUERIES[name](spark, SF).schema.fields
    queries.QUERIES[name](spark, SF).write.format("noop").mode("overwrite").save()


def test_native_and_full_detectors_agree(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    full = lifecycle.matches(docs)
    for kind, rows in (("card", native.cards(docs)),):
        a = rows.select("doc_id", "start", "end")
        b = full.filter(F.col("kind") == kind).select("doc_id", "start", "end")
        assert a.exceptAll(b).count() == 0
    a, b = native.emails(docs).select("doc_id", "match"), full.filter("kind = 'email'").select("doc_id", F.col("text").alias("match"))
    assert a.exceptAll(b).count() == 0


def test_matches_context_and_ids(spark):
    docs = spark.createDataFrame([(1, "Dear\n\nmail a@b.org now\nplease\fpage two 4111111111111111"), (2, None), (3, "")], "doc_id long, text string")
    rows = lifecycle.matches(docs).orderBy("page").collect()
    assert [(r.page, r.kind, r.text) for r in rows] == [(1, "email", "a@b.org"), (2, "card", "4111111111111111")]
    assert rows[0].before == "Dear mail " and rows[0].after == " now please"
    assert len({r.match_id for r in rows}) == 2


def test_context_goes_on_behind_long_white_space(spark):
    word = "word" * 12
    text = f"{word}{' ' * 900}a@b.org{' ' * 400}{word}"
    r = native.with_context(native.emails(spark.createDataFrame([(1, text)], "doc_id long, text string"))).first()
    full = lifecycle.matches(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (r.before, r.after) == (full.before, full.after) == (word[-39:] + " ", " " + word[:39])
    assert full.before_cut and full.after_cut
    assert lifecycle.context(f"ab{' ' * 900}X{' ' * 900}cd", 902, 903, 40) == ("ab ", " cd", False, False)


def test_marks_that_only_the_normalised_text_holds(spark):
    rows = [(1, "write to ann\uff20example.org now"), (2, "or bob\ufe6bexample.org"), (3, "card ④①①①①①①①①①①①①①①①"), (4, "nothing é 日本 here"), (5, "call ⁴¹¹¹¹¹¹¹¹¹¹¹¹¹¹¹")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    plain = [tuple(r) for r in lifecycle.matches(docs).orderBy("match_id").collect()]
    kinds = {(r[0], r[4]) for r in plain}
    assert {(1, "email"), (2, "email"), (3, "card"), (5, "card")} <= kinds and not any(d == 4 for d, _ in kinds)
    withal = [tuple(r) for r in lifecycle.matches(docs, [("zzz", "zzz")]).orderBy("match_id").collect()]
    assert plain == withal
    out = {r.doc_id: r.text for r in lifecycle.redact(docs, lifecycle.selected(lifecycle.matches(docs))).collect()}
    assert "example.org" not in out[1] and "example.org" not in out[2]


def test_redact_and_verify(spark):
    docs = spark.createDataFrame([(1, "mail a@b.org and c@d.org"), (2, "nothing"), (3, None)], "doc_id long, text string")
    found = lifecycle.matches(docs)
    off = found.filter("text = 'c@d.org'").select("match_id", F.lit(1).alias("seq"), F.lit(False).alias("on"))
    chosen = lifecycle.selected(found, off)
    out = lifecycle.redact(docs, chosen)
    assert {r.doc_id: r.text for r in out.collect()} == {1: "mail ███████ and c@d.org", 2: "nothing", 3: None}
    assert {r.doc_id: r.verdict for r in lifecycle.verify(docs, out, chosen).collect()} == {1: "pass", 2: "nothing-ticked", 3: "nothing-ticked"}
    broken = docs.select("doc_id", "text", F.lit(1).cast("long").alias("n_removed"))
    assert lifecycle.verify(docs, broken, chosen).filter("doc_id = 1").first().verdict == "leak"
    short = out.withColumn("text", F.expr("substring(text, 1, 10)"))
    assert lifecycle.verify(docs, short, chosen).filter("doc_id = 1").first().verdict == "over-reach"


def test_limits_and_door(spark, tmp_path):
    with pytest.raises(ValueError):
        Limits(free_pages=9, most_pages=3)
    with pytest.raises(ValueError):
        Limits.from_env({"MAX_PAGES": "x"})
    assert Limits.from_env({"MAX_PAGES": "60"}).most_pages == 60
    (tmp_path / "a.pdf").write_bytes(b"xx%PDF-1.7")
    (tmp_path / "b.pdf").write_bytes(b"x" * 2000 + b"%PDF-1.7")
    (tmp_path / "c.pdf").write_bytes(b"%PDF-" + b"0" * 5000)
    files = spark.read.format("binaryFile").load(str(tmp_path))
    got = {r.path[-5]: r.refusal for r in files_at_the_door(files, Limits(most_bytes=4000)).collect()}
    assert got == {"a": None, "b": "not-pdf", "c": "too-large"}


def test_strict_event_parser(spark):
    good = '{"name":"document-opened","pages":"2-5","found":{"phone":"2-5","email":"1"},"blocked":{},"pagesWith":{},"tier":"free","account":"none"}'
    bad = [good.replace('"1"', '"0"'), good.replace('"none"', '"none","x":1'), good.replace("email", "mail"), good.replace('"1"', "1"), good.replace('"2-5",', "25,", 1), good.replace("{}", "[]", 1), good.replace("{}", "null", 1), "[1]", "{", "null", '"page-view"', "", None, '{"name":"page-view"}', '{"name":7}', '{"page":"home"}', good + " " * 2048]
    df = spark.createDataFrame([(n, raw) for n, raw in enumerate([good, *bad])], "n int, json string")
    rows = sorted(events.strict_events(df).collect())
    assert [r.valid for r in rows] == [True] + [False] * len(bad) and all(r.name is None and r.canonical is None for r in rows[1:])
    assert rows[0].name == "document-opened" and '"found":{"email":"1","phone":"2-5"}' in rows[0].canonical  # in the list's order
    plan = events.strict_events(df)._jdf.queryExecution().executedPlan().toString()
    assert "Arrow" not in plan and "Python" not in plan


def brute_licence(text, ok):
    """Python's own reading of the expression, after the licences are put in; None where that can't be read."""
    import re as r

    marked = r.sub(r"([^\s()]+)\s+WITH\s+([^\s()]+)", lambda m: m[0] if m[1] in ("AND", "OR", "WITH") else f"{m[1]}~{m[2]}", text)
    words = r.sub(r"[()]", r" \g<0> ", marked).split()
    said = " ".join({"AND": "and", "OR": "or"}.get(w, w if w in "()" else "WITH" if w == "WITH" else str(w.replace("~", " WITH ") in ok)) for w in words)
    try:
        value = eval(said, {"__builtins__": {}})  # noqa: S307  of True, False, and, or and brackets alone
    except (SyntaxError, NameError, TypeError):
        return None
    return value if isinstance(value, bool) else None


def test_licence_expressions(spark):
    import random

    ok, rng = ["MIT", "Apache-2.0", "GPL-2.0 WITH Classpath"], random.Random(4)
    fixed = {"(MIT OR GPL-3.0) AND Apache-2.0": True, "MIT AND GPL-3.0": False, "GPL-2.0 WITH Classpath": True, "GPL-2.0 WITH Other": False, "MIT OR (": None, "": None, "  MIT ": True, "((MIT))": True, "MIT GPL-3.0": None, "()": None, "MIT)": None, "AND": None, "X OR Y AND MIT": False, "X AND Y OR MIT": True, "(X OR MIT)AND(MIT)": True}
    drawn = [" ".join(rng.choice(["MIT", "X", "AND", "OR", "(", ")", "GPL-2.0 WITH Classpath", "Apache-2.0"]) for _ in range(rng.randint(1, 7))) for _ in range(400)]
    df = spark.createDataFrame([(t,) for t in [*fixed, *drawn, None]], "t string").select("t", events.licence_verdict(F.col("t"), ok).alias("v"))
    got = {r.t: r.v for r in df.collect()}
    assert {t: got[t] for t in fixed} == fixed and got[None] is None
    assert {t: got[t] for t in drawn} == {t: brute_licence(t, ok) for t in drawn}


def test_plans_as_of(spark):
    hour = 3_600_000
    answers = spark.createDataFrame([("a", 1000, 500, "paid"), ("a", 10_000, 9_000, "free"), ("a", 20_000, 0, "free"), ("b", 0, 0, "paid"), ("b", 5_000, 0, "unknown"), (None, 0, 0, "paid")], "user string, ts_ms long, took_ms long, answer string")
    reads = spark.createDataFrame([("a", 1400, 1), ("a", 1500, 2), ("a", 14_000, 3), ("a", 20_000, 4), ("b", 6_000, 5), ("b", hour, 6), ("c", 1, 7), (None, 5, 8), ("a", 20_000, 4)], "user string, ts_ms long, id long")
    got = sorted((r.id, r.shown, r.asks) for r in events.plan_at(reads, answers).collect())
    assert got == [(1, "unknown", True), (2, "paid", False), (3, "paid", False), (4, "free", False), (4, "free", False), (5, "paid", False), (6, "unknown", True), (7, "unknown", True), (8, "paid", False)]
    assert events.plan_at(reads, answers.filter("false")).filter("shown <> 'unknown' or not asks").count() == 0


def test_precedence_by_stretches(spark):
    """Against every place by itself: overlaps within a kind, nested, touching and empty spans; and spans of millions of places."""
    import random

    rng, rows = random.Random(8), []
    for block in range(60):
        for span in range(rng.randint(0, 14)):
            start = rng.randint(0, 40)
            rows.append((block, span, rng.randint(0, 6), "k", start, start + rng.choice([0, 1, 3, 10, 40])))
    rows += [(100, 0, 1, "k", 0, 50_000_000), (100, 1, 0, "k", 10, 20), (100, 2, 2, "k", 5, 60_000_000), (None, 0, 0, "k", 3, 4)]
    df = spark.createDataFrame(rows, "block int, span int, rank int, kind string, start int, end int")
    got = sorted((r.block, r.start, r.end, r.span) for r in native.resolve(df).collect() if r.block is not None and r.block < 100)
    expected = []
    for block in range(60):
        own = [(r[2], r[1], r[4], r[5]) for r in rows if r[0] == block]
        at = [min(((rank, span) for rank, span, a, z in own if a <= p < z), default=None) for p in range(90)]
        start = 0
        for p in range(1, 90):
            if at[p] != at[p - 1]:
                if at[p - 1]:
                    expected.append((block, start, p, at[p - 1][1]))
                start = p
    assert got == sorted(expected)
    assert sorted((r.start, r.end, r.span) for r in native.resolve(df.filter("block = 100")).collect()) == [(0, 10, 0), (10, 20, 1), (20, 50_000_000, 0), (50_000_000, 60_000_000, 2)]


def test_session_fold_ignores_what_does_not_fit(spark):
    log = [("j", i, a, p) for i, (a, p) in enumerate([("redacted", "{}"), ("file-chosen", '{"job":"j"}'), ("opened", '{"matches":[{"id":"a","ticked":true},{"id":"b","ticked":true,"blocked":"slanted-text"}]}'), ("tick-toggled", '{"id":"b"}'), ("redact-started", "{}"), ("redacted", "{}"), ("rerun", "{}"), ("downloaded", "{}")])]
    r = session.fold(spark.createDataFrame(log, "job_id string, seq long, action string, payload string")).first()
    assert (r.state, r.n_actions, r.n_changes, r.ticked) == ("complete", 8, 5, ["a"])


def test_session_terms():
    s = session.apply(dict(session.START), "file-chosen", {"job": "j", "tier": "paid", "terms": ["t"]})
    s = session.apply(s, "opened", {"matches": [{"id": "m", "ticked": True, "term": "t"}]})
    assert s["ticked"] == {"m"} and s["terms"] == {"t": "searched"}
    s = session.apply(s, "terms-removed", {"terms": ["t"], "job": "j"})
    assert s["matches"] == {} and s["ticked"] == set()
    assert session.apply(s, "worker-lost", {})["state"] == "lost"


def test_page_list_words(spark):
    df = spark.createDataFrame([(1, p) for p in (1, 2, 3, 5, 7, 8)] + [(2, 4), (2, 4)], "k int, page int")
    assert {r.k: r.pages for r in report.page_list(df, "k").collect()} == {1: "1 to 3, 5, 7 and 8", 2: "4"}


def test_admission_runs_from_the_last_admitted(spark):
    df = spark.createDataFrame([("k", t) for t in (0, 50, 100, 150, 199, 201)], "key string, ts_ms long")
    got = {r.ts_ms: r.admitted for r in events.admitted(df, 100).collect()}
    assert got == {0: True, 50: False, 100: True, 150: False, 199: False, 201: True}


def test_reading_compare_pairs_each_once(spark):
    schema = "doc_id int, page int, idx int, code int, ox double, oy double"
    a = spark.createDataFrame([(1, 1, 0, 65, 1.0, 1.0), (1, 1, 1, 65, 1.0, 1.0), (1, 1, 2, 66, 5.0, 1.0)], schema)
    b = spark.createDataFrame([(1, 1, 0, 65, 1.004, 1.0), (1, 1, 1, 67, 9.0, 1.0)], schema)
    r = pages.compare(a, b).first()
    assert (r.missing, r.extra) == (2, 1)


def test_reading_compare_over_cell_edges_and_gaps(spark):
    schema = "doc_id int, page int, idx int, code int, ox double, oy double"
    a = spark.createDataFrame([(1, 1, 0, 65, 10.499, 1.0), (2, 1, 0, 65, 10.0, 1.0), (2, 1, 1, 65, 10.3, 1.0), (3, 1, 0, 65, 2.0, 7.4999)], schema)
    b = spark.createDataFrame([(1, 1, 0, 65, 10.503, 1.0), (2, 1, 0, 65, 10.3, 1.0), (3, 1, 0, 65, 2.0, 7.5001), (3, 1, 1, 65, 2.0, 7.52)], schema)
    assert {r.doc_id: (r.missing, r.extra) for r in pages.compare(a, b).collect()} == {1: (0, 0), 2: (1, 0), 3: (0, 1)}


def test_stream_admission(spark, tmp_path):
    from veilframe.streaming.reports import admitted_stream

    src = spark.createDataFrame([("k", t) for t in (10**12, 10**12 + 50_000, 10**12 + 4_000_000)], "key string, ms long").select("key", F.timestamp_millis("ms").alias("ts"))
    src.write.parquet(str(tmp_path / "in"))
    q = admitted_stream(spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("adm").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert {r.ts_ms: r.admitted for r in spark.table("adm").collect()} == {10**12: True, 10**12 + 50_000: False, 10**12 + 4_000_000: True}


def page(chars="", y=100.0, width=600.0, height=800.0, **glyph):
    """Characters of one line of 10-point glyphs from x = 20 on, and the drawings that show them."""
    c = [{"idx": i, "line": 1, "code": ord(ch), "quad": [20.0 + 10 * i, y - 10, 30.0 + 10 * i, y - 10, 20.0 + 10 * i, y, 30.0 + 10 * i, y]} for i, ch in enumerate(chars)]
    d = [{"ord": 1, "kind": "glyph", "idx": x["idx"], "quad": x["quad"], "visible": True, "opaque": False, "alpha": 1.0, "contrast": 21.0} | glyph for x in c]
    return c, d


def drawn(kind, x0, y0, x1, y1, order=0, opaque=True):
    return {"ord": order, "kind": kind, "idx": None, "quad": [x0, y0, x1, y0, x0, y1, x1, y1], "visible": True, "opaque": opaque, "alpha": 1.0, "contrast": 21.0}


FAR = page("Hello words over it", y=50)
SHORT, LONG, HIDDEN = page("Hello"), page("x" * 45, y=20), page("Hello there", visible=False)
HALVES = [drawn("cover", 15, 85, 45, 105, 2), drawn("cover", 40, 85, 80, 105, 3)]  # together they hide all
#: (characters, drawings, findings) of a page.
PAGES = [
    (*SHORT, []), ([], [], ["blank"]), ([], [drawn("path", 10, 10, 50, 50)], ["drawn-only"]), ([], [drawn("image", 0, 0, 600, 800)], ["scanned"]),
    ([], [drawn("path", 10, 10, 50, 50) | {"contrast": 1.0}], ["blank"]),  # a path that does not show
    # a bare picture beside vector drawings, on a page without glyphs: both are told
    ([], [drawn("image", 0, 0, 200, 200), drawn("path", 300, 300, 400, 400)], ["drawn-only", "bare-picture"]),
    (FAR[0], [*FAR[1], drawn("image", 0, 0, 60, 40)], []),  # under 5 % of the page
    # text elsewhere on the page does not clear a picture; text over it does; a scan is not a bare picture as well
    (FAR[0], [*FAR[1], drawn("image", 0, 300, 300, 700)], ["bare-picture"]), (FAR[0], [*FAR[1], drawn("image", 0, 0, 230, 200)], []), (FAR[0], [*FAR[1], drawn("image", 0, 100, 600, 800)], ["scanned"]),
    (LONG[0], [*LONG[1], *[drawn("image", 0, 500, 300, 780)] * 4], ["bare-picture"]),  # overlapping pictures count once
    (*page("ab\ufffd\ufffdcd\ufffd"), []), (*page("ab\ufffd\ufffd\ufffd"), ["unreadable-text"]), (*page("\ufffd"), ["unreadable-text"]), (*page("ab\ufffd\u0301\ufffd\ufffd"), ["unreadable-text"]), (*page("\u4e2d\u6587\u00e9"), []),
    (*HIDDEN, ["hidden-text"]), (HIDDEN[0], [*HIDDEN[1], drawn("image", 0, 0, 600, 800)], ["machine-read-text"]),  # and neither a scan nor bare
    (*page("Hello", contrast=1.0), ["hidden-text"]), (SHORT[0], [*SHORT[1], *HALVES], ["covered-text"]), (SHORT[0], [*SHORT[1], drawn("cover", 0, 0, 600, 800, 0)], []),  # drawn before the text
    (SHORT[0], [*SHORT[1], drawn("description", 0, 0, 1, 1)], ["marked-descriptions"]), (SHORT[0], [*SHORT[1], drawn("image", -5, 90, 20, 100)], ["off-page-picture"]), (SHORT[0], [*SHORT[1], drawn("path", 700, 0, 800, 10)], ["off-page-content"]),
]


def page_tables(spark, cases):
    sheets = [(n, 1, 600.0, 800.0) for n in range(len(cases))]
    chars = [(n, 1, x["idx"], x["line"], x["code"], [float(v) for v in x["quad"]]) for n, (c, *_) in enumerate(cases) for x in c]
    marks = [(n, 1, x["ord"], x["kind"], x["idx"], [float(v) for v in x["quad"]], x["visible"], x["opaque"], x["alpha"], x["contrast"]) for n, (_, d, *_) in enumerate(cases) for x in d]
    return (
        spark.createDataFrame(sheets, "doc_id int, page int, width double, height double"), spark.createDataFrame(chars, "doc_id int, page int, idx int, line int, code int, quad array<double>"),
        spark.createDataFrame(marks, "doc_id int, page int, ord int, kind string, idx int, quad array<double>, visible boolean, opaque boolean, alpha double, contrast double"),
    )


def test_page_findings_by_rule(spark):
    got = {r.doc_id: r.findings for r in findings.findings(*page_tables(spark, PAGES)).collect()}
    assert [got[n] for n in range(len(PAGES))] == [expected for *_, expected in PAGES]


def test_concealed_characters(spark):
    c, d = SHORT[0], [*SHORT[1], *HALVES]
    _, chars, marks = page_tables(spark, [(c, d), HIDDEN])
    rows = findings.concealed(findings.glyphs(chars, marks), marks).collect()
    assert {(r.doc_id, r.concealment) for r in rows} == {(0, "covered"), (1, "hidden")} and len(rows) == 5 + len(HIDDEN[0])


def test_points_meet_outlines_once(spark):
    """Against every pair, over outlines of all sizes, on edges of cells, with points and outlines without a place."""
    import random

    rng, inf = random.Random(5), float("inf")
    pts = [(1 + i % 2, i, float(rng.choice([16 * rng.randint(-9, 9), rng.uniform(-300, 300)])), float(rng.choice([16 * rng.randint(-9, 9), rng.uniform(-300, 300)]))) for i in range(400)] + [(1, 900, inf, 0.0), (None, 901, 1.0, 1.0), (1, 902, None, 1.0)]
    boxes = []
    for i in range(60):
        x, y, w, h = rng.uniform(-300, 300), rng.uniform(-300, 300), rng.choice([0.5, 16, 100, 5e3, 1e6]), rng.choice([0.5, 16, 40, 2e3])
        s = rng.choice([0, 5])
        boxes.append((1 + i % 3, i, [x, y, x + w, y + s, x - s, y + h, x + w - s, y + h + s]))
    boxes += [(None, 98, [0.0, 0.0, 2.0, 0.0, 0.0, 2.0, 2.0, 2.0]), (1, 99, [float("nan")] * 8)]
    p, q = spark.createDataFrame(pts, "page int, i int, x double, y double"), spark.createDataFrame(boxes, "page int, j int, quad array<double>")
    got = sorted((r.i, r.j) for r in spatial.inside(p, q, ["page"]).collect())

    def holds(o, x, y):
        c = [(o[0], o[1]), (o[2], o[3]), (o[6], o[7]), (o[4], o[5])]
        s = [(bx - ax) * (y - ay) - (by - ay) * (x - ax) for (ax, ay), (bx, by) in zip(c, c[1:] + c[:1], strict=True)]
        return min(s) >= 0 or max(s) <= 0

    expected = sorted((i, j) for a, i, x, y in pts for b, j, o in boxes if a == b and j != 99 and x is not None and abs(x) < inf and holds(o, x, y))
    assert got == expected and (901, 98) in got
    plan = spatial.inside(p, q, ["page"])._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_block_reasons_in_order(spark):
    """Outlines that hold their text, that hold another, whose second reading differs, that slant, and that lie over a coarse image."""
    def row(doc, text, y=100.0, dy=0.0):
        return [(doc, 1, i, ord(c), [20.0 + 10 * i, y - 10 + dy * i, 30.0 + 10 * i, y - 10 + dy * (i + 1), 20.0 + 10 * i, y + dy * i, 30.0 + 10 * i, y + dy * (i + 1)]) for i, c in enumerate(text)]

    schema = "doc_id int, page int, idx int, code int, quad array<double>"
    ordinary = spark.createDataFrame([r for d in range(1, 7) for r in row(d, "ab cd", dy=3.0 if d == 4 else 0.0)], schema)
    ignoring = spark.createDataFrame([r for d in range(1, 7) for r in row(d, "ab xd" if d == 3 else "ab cd", dy=3.0 if d == 4 else 0.0)], schema)
    whole = [20.0, 90.0, 70.0, 90.0, 20.0, 100.0, 70.0, 100.0]
    slant = [20.0, 90.0, 70.0, 105.0, 20.0, 100.0, 70.0, 115.0]
    outlines = spark.createDataFrame([(f"m{d}", d, 1, slant if d == 4 else [0.0] * 8 if d == 6 else whole) for d in range(1, 7)], "match_id string, doc_id int, page int, quad array<double>")
    texts = spark.createDataFrame([(f"m{d}", "ab c e" if d == 2 else "ab  cd") for d in range(1, 8)], "match_id string, text string")
    images = spark.createDataFrame([(5, 1, [600.0, 0.0, 0.0, 800.0, 0.0, 0.0], 10, 10), (1, 1, [600.0, 0.0, 0.0, 800.0, 0.0, 0.0], 6000, 8000)], "doc_id int, page int, transform array<double>, columns int, rows int")
    got = {r.match_id: r.blocked for r in pages.blocked(outlines, texts, ordinary, ignoring, images).collect()}
    assert got == {"m1": None, "m2": "unsound-outline", "m3": "replacement-text", "m4": "slanted-text", "m5": "image-overreach", "m6": "unsound-outline", "m7": "unsound-outline"}


def test_concealment_by_place(spark):
    chars = spark.createDataFrame([("m1", 1, 1, 10.0, 5.0), ("m1", 1, 1, 20.0, 5.0), ("m2", 1, 1, 20.005, 5.0), ("m3", 1, 1, 30.0, 5.0), ("m4", 2, 1, 10.0, 5.0)], "match_id string, doc_id int, page int, ox double, oy double")
    marks = spark.createDataFrame([(1, 1, 10.0, 5.0, "covered"), (1, 1, 20.0, 5.0, "hidden"), (1, 1, 29.98, 5.0, "covered")], "doc_id int, page int, ox double, oy double, concealment string")
    assert {r.match_id: r.concealment for r in pages.concealment(chars, marks).collect()} == {"m1": "covered", "m2": "hidden"}


def test_events_of_every_shape(spark):
    df = spark.createDataFrame([(n, raw) for n, (raw, _) in enumerate(queries.SAMPLES)], "n int, json string")
    rows = sorted(events.strict_events(df).collect())
    assert [r.valid for r in rows] == [ok for _, ok in queries.SAMPLES]
    assert set(events.EVENTS) == {r.name for r in rows if r.valid}
    assert '"stripped":["annotations","javascript"]' in rows[6].canonical  # in the list's order


def test_admission_by_both_rules():
    rule = events.Admission(window_ms=100, budget=2)
    assert [rule.take(k, t, d) for k, t, d in (("a", 0, True), ("a", 50, True), ("b", 60, True), ("c", 70, True), ("s", 75, False), ("s", 80, False), ("a", 100, True))] == [True, False, True, False, True, False, False]
    assert rule.take("c", events.DAY_MS, True)  # what the budget refused started no window, and a new day has its own budget
    rule.forget(events.DAY_MS + 50)
    assert rule.sent == {"c": events.DAY_MS}


def test_report_budget_ranks_only_the_first(spark):
    df = spark.createDataFrame([(f"k{i:03d}", i, i % 2 == 0) for i in range(100)], "key string, ts_ms long, from_page boolean")
    got = {r.key for r in events.within_budget(df, 5).filter("admitted and from_page").collect()}
    assert got == {f"k{i:03d}" for i in (0, 2, 4, 6, 8)}


def test_outcome_ladder(spark):
    names = ("ticked", "structural", "escaped", "leaked", "unreadable", "replaced", "overreached")
    rows = [("", None), ("ticked", None), ("leaked", "unsupported"), ("escaped", "redaction-incomplete"), ("ticked structural leaked", "redaction-incomplete"), ("ticked leaked unreadable", "redaction-incomplete"), ("ticked unreadable replaced", "unsupported"), ("ticked replaced overreached", "replacement-text"), ("ticked overreached", "redaction-overreach")]
    df = spark.createDataFrame([(i, *(n in said.split() for n in names)) for i, (said, _) in enumerate(rows)], "i int, " + ", ".join(f"{n} boolean" for n in names))
    got = {r.i: r.o for r in df.select("i", review.outcome(*map(F.col, names)).alias("o")).collect()}
    assert got == {i: why for i, (_, why) in enumerate(rows)}


def test_stale_targets_are_refused(spark):
    docs = spark.createDataFrame([(1, "mail a@b.org now"), (2, "call c@d.org"), (3, "x")], "doc_id long, text string")
    t = spark.createDataFrame([(1, 1, 5, 12, "a@b.org"), (2, 1, 4, 11, "c@d.org"), (3, 1, 0, 40, "x")], "doc_id long, page int, start int, end int, text string")
    out = {r.doc_id: (r.text, r.n_removed, r.refusal) for r in lifecycle.redact(docs, t).collect()}
    assert out == {1: ("mail ███████ now", 1, None), 2: ("call c@d.org", 0, "unsupported"), 3: ("x", 0, "unsupported")}
    flagged = t.withColumn("slanted", F.col("doc_id") == 1).withColumn("overreach", F.lit(False))
    assert {r.doc_id: r.refusal for r in review.refused_targets(docs, flagged).collect()} == {1: "slanted-text", 2: "unsupported", 3: "unsupported"}


def test_one_pass_redaction_is_the_same(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    chosen = lifecycle.selected(lifecycle.matches(docs))
    a = lifecycle.redact(docs, chosen).select("doc_id", "text", "n_removed")
    b = lifecycle.redact_all(docs)
    assert a.exceptAll(b.select("doc_id", "text", "n_removed")).count() == 0
    assert lifecycle.judged(b).exceptAll(lifecycle.verify(docs, a, chosen).select("doc_id", F.lit("").alias("text"), "n_removed", "leaked", "lost", "added", "verdict", "outcome").join(b.select("doc_id", F.col("text").alias("new")), "doc_id").select("doc_id", F.col("new").alias("text"), "n_removed", "leaked", "lost", "added", "verdict", "outcome")).count() == 0
    plan = b._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "Join" not in plan


def test_session_events_of_refusals(spark):
    log = [("a", 0, "file-chosen", '{"tier":"free"}'), ("a", 1, "failed", '{"failure":"too-large"}'), ("b", 0, "file-chosen", '{"tier":"paid"}'), ("b", 1, "progress", "{}"), ("b", 2, "failed", '{"failure":"too-large"}'), ("c", 0, "file-chosen", "{}"), ("c", 1, "worker-lost", "{}")]
    steps = session.transitions(spark.createDataFrame(log, "job_id string, seq long, action string, payload string"))
    got = {(r.job_id, r.name, r.cap) for r in session.usage_events(steps).collect()}
    assert got == {("a", "cap-reached", "size"), ("b", "run-refused", None), ("c", "run-refused", None), ("c", "engine-unavailable", None)}


def test_sentences_and_counts(spark):
    m = spark.createDataFrame([(1, {"email": 2, "term": 1}), (2, {})], "k int, m map<string,bigint>")
    assert {r.k: r.s for r in m.select("k", report.removed_sentence(F.col("m")).alias("s")).collect()} == {1: "2 email addresses and 1 match", 2: "Nothing"}
    s = spark.createDataFrame([(1, ["annotations", "javascript"]), (2, [])], "k int, a array<string>")
    assert {r.k: r.s for r in s.select("k", report.stripped_sentence(F.col("a")).alias("s")).collect()} == {1: "Annotations and JavaScript", 2: "Nothing else needed stripping."}
    n = spark.range(1).select(report.counted(F.lit(1), "match", "matches").alias("a"), report.counted(F.lit(1234), "match", "matches").alias("b"), report.count_text(F.lit(5)).alias("c"), report.partly(F.array(F.lit("blank"), F.lit("scanned"))).alias("d")).first()
    assert tuple(n) == ("1 match", "1,234 matches", "5", True)


def test_small_operators(spark):
    e = spark.createDataFrame([("x", {"email": "1"})], "id string, found map<string,string>")
    assert [tuple(r) for r in events.flatten_fields(e, "found", "id").collect()] == [("x", "found_email", "1")]
    t = spark.createDataFrame([("en-GB",), ("e",), ("en_GB",), ("english",)], "t string").select("t", events.language_tag(F.col("t")).alias("ok"), events.report_key(F.lit("a"), F.col("t")).alias("k"))
    assert {r.t: r.ok for r in t.collect()} == {"en-GB": True, "e": False, "en_GB": True, "english": False} and t.first().k == "a en-GB"
    r = spark.createDataFrame([(1, 1, ["scanned"]), (1, 2, ["blank"]), (2, 1, [])], "doc_id int, page int, findings array<string>")
    assert {x.doc_id: x.refusal for x in pages.document_refusal(r).collect()} == {1: "no-readable-text", 2: None}
    a = spark.createDataFrame([(1, 1, 5), (2, 1, 3)], "doc_id int, page int, trimmed int")
    b = spark.createDataFrame([(1, 1, 5), (2, 1, 3), (2, 2, 1)], "doc_id int, page int, trimmed int")
    assert {x.doc_id: x.agrees for x in pages.trim_agrees(a, b).collect()} == {1: True, 2: False}
    q = [0.0, 0.0, 10.0, 0.0, 0.0, 10.0, 10.0, 10.0]
    second = spark.createDataFrame([(1, 1, "r1", "t", 5.0, 5.0), (1, 1, "r2", "t", 5.0, 5.0), (1, 1, "r2", "t", 50.0, 5.0), (1, 1, "r3", "u", 5.0, 5.0)], "doc_id int, page int, row_id string, term string, cx double, cy double")
    first = spark.createDataFrame([(1, 1, "t", q)], "doc_id int, page int, term string, quad array<double>")
    assert {x.row_id for x in pages.hidden_rows(second, first).collect()} == {"r3"}  # r2 has a character in an ordinary row
    found = spark.createDataFrame([("m1", True), ("m2", True), ("m3", True)], "match_id string, ticked boolean")
    facts = spark.createDataFrame([("m1", False, True, True, False), ("m2", None, None, False, False)], "match_id string, unsound boolean, replaced boolean, slanted boolean, overreach boolean")
    assert {x.match_id: (x.blocked, x.ticked) for x in pages.block_matches(found, facts).collect()} == {"m1": ("replacement-text", False), "m2": (None, True), "m3": (None, True)}


def test_writer_and_door(spark, tmp_path):
    from veilframe.sources import gates

    gates.write(spark.range(3), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
    with pytest.raises(Exception):
        gates.write(spark.range(3), str(tmp_path / "out"))


def test_runs_can_be_cancelled(spark):
    import threading
    import time

    runs = jobs.Runs(spark)
    assert runs.run("a", lambda: spark.range(10).count()) == 10
    runs.cancel("b")
    with pytest.raises(jobs.Cancelled):
        runs.run("b", lambda: 1)
    slow = F.udf(lambda x: time.sleep(0.2) or x, "long")
    threading.Timer(3, runs.cancel, ("c",)).start()
    with pytest.raises(jobs.Cancelled):
        runs.run("c", lambda: spark.range(400).repartition(2).select(slow("id")).agg(F.sum("<lambda>(id)")).collect())


def test_masking_goes_on_behind_a_match(spark):
    rows = [("a@b.c_d@e.fr",), ("no at " + "x" * 50_000,), ("x" * 50_000 + " a@b.org",), ("._a@b.org 4111111111111111",)]
    got = [r.m for r in spark.createDataFrame(rows, "text string").select(native.masked(F.col("text")).alias("m")).collect()]
    assert got == ["[EMAIL][EMAIL]", rows[1][0], "x" * 50_000 + " [EMAIL]", "[EMAIL] [NUMBER]"]


def test_areas_around_a_quad(spark):
    from veilframe.functions import geometry

    q = F.array(*[F.lit(float(v)) for v in (0, 0, 100, 0, 0, 10, 100, 10)])
    r = spark.range(1).select(geometry.removal_band(q).alias("band"), geometry.line_box(q).alias("box"), geometry.padded_area(q).alias("pad")).first()
    near = lambda a, b: all(abs(x - y) < 1e-9 for x, y in zip(a, b, strict=True))
    assert near(r.band, [1, 4.5, 99, 4.5, 1, 5.5, 99, 5.5]) and near(r.box, [0, 2, 100, 2, 0, 9.3, 100, 9.3]) and near(r.pad, [-1, -2.5, 101, -2.5, -1, 12.5, 101, 12.5])
    nan, unit = float("nan"), [100.0, 0.0, 0.0, 100.0, 0.0, 0.0]
    turned = [0.0, 100.0, -100.0, 0.0, 100.0, 0.0]  # a quarter turn
    cases = [(unit, 100, [10, 10, 20, 10, 10, 20, 20, 20], 0.0), (unit, 10, [11, 10, 20, 10, 11, 20, 20, 20], 1.0), (unit, 10, [200, 200, 210, 200, 200, 210, 210, 210], 0.0), (turned, 10, [10, 12, 20, 12, 10, 20, 20, 20], 2.0), ([0.0] * 6, 10, [0, 0, 1, 0, 0, 1, 1, 1], nan), ([nan, *unit[1:]], 10, [0, 0, 1, 0, 0, 1, 1, 1], nan)]
    df = spark.createDataFrame([(n, t, k, [float(v) for v in a]) for n, (t, k, a, _) in enumerate(cases)], "n int, t array<double>, k int, a array<double>")
    got = {r.n: r.reach for r in df.select("n", geometry.image_reach(F.col("t"), F.col("k"), F.col("k"), F.col("a")).alias("reach")).collect()}
    assert all((e != e and got[n] != got[n]) or abs(got[n] - e) < 1e-9 for n, (*_, e) in enumerate(cases)), got
    level = F.array(*[F.lit(float(v)) for v in (0, 0, 100, 0.5, 0, 10, 100, 10.5)])  # a third of a degree
    steep = F.array(*[F.lit(float(v)) for v in (0, 0, 100, 9, 0, 10, 100, 19)])
    assert tuple(spark.range(1).select(geometry.slanted(q), geometry.slanted(level), geometry.slanted(steep), geometry.slanted(F.array(*[F.lit(nan)] * 8))).first()) == (False, False, True, True)


def test_only_batches_that_may_be_searched(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    for bad in ([("a", "ab"), ("a", "cd")], [("a", " ab ")], [("a", "x")], [("a", "Ab"), ("b", "aB")]):
        with pytest.raises(ValueError):
            lifecycle.matches(docs, bad)


def test_stream_of_both_rules(spark, tmp_path):
    from veilframe.streaming.reports import admit_reports_stream

    base = 1_700_000_000_000
    rows = [("i", n, k, base + t, d) for n, (k, t, d) in enumerate([("a", 0, True), ("b", 1, True), ("c", 2, True), ("s", 3, False), ("a", 4, True), ("a", 3_600_000, False)])]
    src = spark.createDataFrame(rows, "instance string, seq long, key string, ms long, draws boolean").select("instance", "seq", "key", F.timestamp_millis("ms").alias("ts"), "draws")
    src.repartition(1).write.parquet(str(tmp_path / "in"))
    q = admit_reports_stream(spark.readStream.schema(src.schema).parquet(str(tmp_path / "in")), budget=2).writeStream.format("memory").queryName("both").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    batch = events.admit_reports(spark.createDataFrame(rows, "instance string, seq long, key string, ts_ms long, draws boolean"), budget=2)
    expected = [True, True, False, True, False, True]
    assert [r.admitted for r in spark.table("both").orderBy("seq").collect()] == expected == [r.admitted for r in batch.orderBy("seq").collect()]


def test_compare_holds_one_group_at_a_time(spark, monkeypatch):
    """What Python holds while a batch is compared doesn't grow with the groups in it."""
    import tracemalloc

    import pyarrow as pa

    tasks, frame = [], type(spark.range(1))
    real = frame.mapInArrow
    monkeypatch.setattr(frame, "mapInArrow", lambda self, task, *a, **k: (tasks.append(task), real(self, task, *a, **k))[1])
    one = spark.createDataFrame([(1, 1, 65, 1, 0.0, 0.0)], "doc_id int, page int, code int, idx long, ox double, oy double")
    pages.compare(one, one)

    def peak(groups: int, size: int = 500) -> int:
        inner = pa.ListArray.from_arrays(pa.array(range(0, 2 * groups * size + 1, 2), pa.int32()), pa.array([float(i) for i in range(groups * size) for _ in "xy"]))
        listed = pa.ListArray.from_arrays(pa.array(range(0, groups * size + 1, size), pa.int32()), inner)
        batch = pa.RecordBatch.from_arrays([pa.array([1] * groups), pa.array([1] * groups), pa.array([65] * (groups - 1) + [None]), listed, listed], ["doc_id", "page", "code", "a", "b"])
        tracemalloc.start()
        (out,) = tasks[0](iter([batch]))
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert out.column(2).to_pylist() == out.column(3).to_pylist() == [0] * (groups - 1) + [size]
        return most

    peak(2)
    assert peak(60) < 3 * peak(6)


def test_places_of_boxes_are_looked_up_by_cell(spark):
    """Against each place by itself: slanted and tiny outlines, edges, places at no finite point; and findings read a table that matched characters with drawings once."""
    import random

    rng = random.Random(5)
    boxes = [(1, n, x := rng.choice([0.0, 7.5, 100.0, 290.0, 299.0]), y := rng.choice([0.0, 20.0, 27.0, 60.0]), x + rng.choice([0.0, 6.0, 40.0]), y + rng.choice([0.0, 10.0, 90.0])) for n in range(80)] + [(1, 90, float("nan"), 0.0, 5.0, 5.0), (1, 91, 0.0, 0.0, 3e12, 5.0), (None, 92, 0.0, 0.0, 5.0, 5.0)]
    quads = [(1, 0, [0.0, 0.0, 300.0, 0.0, 0.0, 30.0, 300.0, 30.0]), (1, 1, [10.0, 5.0, 120.0, 25.0, 5.0, 40.0, 115.0, 60.0]), (1, 2, [100.0, 20.0, 103.0, 20.0, 100.0, 23.0, 103.0, 23.0]), (None, 3, [0.0, 0.0, 9.0, 0.0, 0.0, 9.0, 9.0, 9.0])]
    b = spark.createDataFrame(boxes, "page int, idx int, x0 double, y0 double, x1 double, y1 double")
    q = spark.createDataFrame(quads, "page int, cover int, quad array<double>")
    got = {(r.idx, r.cover): r.m for r in spatial.places_inside(b, q, ["page"], 5).groupBy("idx", "cover").agg(F.bit_or("_mask").alias("m")).collect() if r.m}
    spots = b.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(24)))).selectExpr("page", "idx", "k", "x0 + (k % 5 + 0.5D) / 5 * (x1 - x0) as x", "y0 + (floor(k / 5) + 0.5D) / 5 * (y1 - y0) as y")
    expected = {(r.idx, r.cover): r.m for r in spatial.inside(spots, q, ["page"]).groupBy("idx", "cover").agg(F.sum(F.expr("shiftleft(1L, k)")).alias("m")).collect()}
    assert got == expected and len(got) > 50
    plan = findings.findings(*page_tables(spark, PAGES))._jdf.queryExecution().optimizedPlan().toString()
    assert "max_by" not in plan and "veilframe_" in plan


def test_precedence_of_small_and_large_blocks(spark):
    """Blocks as rows and as trees say the same, and neither meets a join or a shuffle of its own where few spans stand in a block."""
    import random

    rng = random.Random(3)
    rows = [(block, span, rng.randint(0, 6), "k", (start := rng.randint(0, 60)), start + rng.choice([0, 1, 5, 20])) for block in range(40) for span in range(rng.choice([1, 4, 7, 90]))]
    df = spark.createDataFrame(rows, "block int, span int, rank int, kind string, start int, end int")
    said = [sorted(native.resolve(df, few).collect()) for few in (0, 10, 64, 1000)]
    assert said[0] == said[1] == said[2] == said[3] and len(said[0]) > 200
    plan = native._resolve_rows(df.repartition("block"))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 1


def test_events_are_parsed_once(spark):
    """A filter on the result, and a key from it, do not parse the event again."""
    df = spark.createDataFrame([(n, raw) for n, (raw, _) in enumerate(queries.SAMPLES)], "n int, json string")
    valid = events.strict_events(df).filter("valid").select(events.report_key(F.upper("canonical"), F.lower("canonical")).alias("key"))
    assert valid._jdf.queryExecution().optimizedPlan().toString().lower().count("json(") == 1
    assert valid.count() == sum(ok for _, ok in queries.SAMPLES)


def test_sentences_gather_no_lists(spark):
    """Counts by kind and state come from one pass with fixed counters: no list, map or minimum of strings, which sort whole tasks' rows."""
    plan = queries.result_sentences(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "SortAggregate" not in plan and plan.count("Exchange") == 1
    df = spark.createDataFrame([(1, "email", True, None), (1, "email", True, None), (1, "card", None, None), (1, "term", True, "slanted-text"), (1, "other", True, None)] + [(2, "date", True, None)] * 1234, "d int, kind string, ticked boolean, blocked string")
    got = {r.d: (r.removed_line, r.left_line) for r in report.result_sentences(df, "d").collect()}
    assert got == {1: ("2 email addresses", "1 card number you left unticked. 1 match The engine couldn't remove."), 2: ("1,234 dates", "Nothing The engine found.")}


def test_chosen_redaction_searches_texts_once(spark):
    """The plan holds the redaction and the proof; what the detectors found is read."""
    plan = queries.chosen_redaction(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 2


def test_block_reasons_meet_readings_once(spark, monkeypatch):
    """All readings go through one join with the outlines and plans stay small, which the driver holds; each reason by itself says what they say together."""
    quad = lambda i, w=1: [10.0 * i, 0.0, 10.0 * (i + w), 0.0, 10.0 * i, 10.0, 10.0 * (i + w), 10.0]
    page = lambda text: spark.createDataFrame([(d, 1, i, ord(c), quad(i)) for d in (1, 2) for i, c in enumerate(text)], "doc_id int, page int, idx int, code int, quad array<double>")
    ordinary, ignoring = page("ﬁne a²"), page("ﬁne a³")
    outlines = spark.createDataFrame([("a", 1, 1, quad(0, 3)), ("a", 1, 1, quad(0, 2)), ("b", 1, 1, quad(4, 2)), ("c", 2, 1, quad(0, 3)), ("d", 2, 1, quad(1, 2)), ("e", 2, 1, quad(90))], "match_id string, doc_id int, page int, quad array<double>")
    texts = spark.createDataFrame([("a", "ﬁn e"), ("b", "a²"), ("c", "ﬁne"), ("d", "fine"), ("e", "x"), ("f", "x")], "match_id string, text string")
    images = spark.createDataFrame([(2, 1, [600.0, 0.0, 0.0, 800.0, 0.0, 0.0], 10, 10), (2, 1, None, 10, 10)], "doc_id int, page int, transform array<double>, columns int, rows int")
    met, inside = [], spatial.inside
    monkeypatch.setattr(pages.spatial, "inside", lambda *a: met.append(a) or inside(*a))
    got = pages.blocked(outlines, texts, ordinary, ignoring, images)
    assert len(met) == 1 and len(got._jdf.queryExecution().toString()) < 100_000
    assert dict(got.collect()) == {"a": None, "b": "replacement-text", "c": "image-overreach", "d": "unsound-outline", "e": "unsound-outline", "f": "unsound-outline"}
    assert len(pages.shapes(outlines, images)._jdf.queryExecution().toString()) < 500_000
    assert dict(pages.unsound(outlines, texts, ordinary).collect()) == {m: m in "def" for m in "abcdef"}
    assert dict(pages.replacement_text(outlines, ordinary, ignoring).collect()) == {m: m == "b" for m in "abcde"}
    assert dict(pages.overreach(outlines, images).collect()) == {m: True for m in "cde"}
