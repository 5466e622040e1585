from __future__ import annotations

import random

from pyspark.sql import functions as F

from veilframe.operators import objects, page_text
from veilframe.plans import lifecycle, page_queries
from veilframe.sources.shared import bucketed

RULES = [("page", "Font", "font"), ("font", "Proc", "glyph"), ("glyph", "Form", "glyph"), ("page", "Form", "drawing"), ("drawing", "Form", "drawing")]


def test_walk_by_role(spark):
    refs = [(1, "p", "Font", "f"), (1, "f", "Proc", "g"), (1, "g", "Form", "x"), (1, "x", "Form", "g"), (1, "p", "Form", "x"), (1, "p", "JS", "j"), (1, "x", "JS", "j"), (2, "p", "Font", "f"), (2, "f", "Proc", "g"), (2, "a", "Form", "b"), (3, "p", "Form", "p")]
    refs = spark.createDataFrame(refs, "doc_id int, src string, key string, dst string")
    rules = spark.createDataFrame(RULES, "role string, key string, becomes string")
    roots = spark.createDataFrame([(d, "p", "page") for d in (1, 2, 3)], "doc_id int, obj string, role string")
    reached = objects.walk(refs, rules, roots)
    got = {(r.doc_id, r.obj, r.role) for r in reached.collect()}
    # x is drawn by the page and by a glyph, and the glyph by x as a drawing: states, not objects, are looked at once
    assert got == {(1, "p", "page"), (1, "f", "font"), (1, "g", "glyph"), (1, "x", "glyph"), (1, "x", "drawing"), (1, "g", "drawing"), (2, "p", "page"), (2, "f", "font"), (2, "g", "glyph"), (3, "p", "page"), (3, "p", "drawing")}
    assert {(r.doc_id, r.obj, r.role, r.key) for r in objects.strays(refs, rules, reached).collect()} == {(1, "p", "page", "JS"), (1, "x", "glyph", "JS"), (1, "x", "drawing", "JS")}
    every = spark.createDataFrame([(1, o, k, t) for o, k, t in (("p", "page", True), ("f", "font", False), ("g", "procedure", False), ("x", "form", False), ("j", "script", False))] + [(2, "g", "procedure", True), (2, "b", "form", True), (3, "p", "page", True)], "doc_id int, obj string, kind string, shows_text boolean")
    assert {(r.doc_id, r.obj) for r in objects.unreached(every, reached).collect()} == {(1, "j"), (2, "b")}
    assert {r.doc_id: r.verdict for r in objects.glyph_rule(reached, every).collect()} == {1: "shared", 2: "text", 3: "clean"}
    assert objects.walk(refs, rules, roots.filter("false")).count() == 0


def test_spans_against_a_stack(spark):
    rng, rows, expected = random.Random(3), [], {}
    for doc in range(120):
        stack, spans, sure = [], [], True
        for pos in range(rng.randint(0, 12)):
            kind = rng.choice(["begin", "begin", "end", "end", "text", "name", "other"]) if doc % 3 else rng.choice(["begin", "text", "name"]) if pos < 5 else "end" if stack else "text"
            tag = rng.choice("ab") if kind == "begin" else (stack[-1][1] if stack and rng.random() < 0.9 else "b") if kind == "end" else None
            rows.append((doc, pos, kind, tag, rng.random() < 0.3))
            if kind == "begin":
                stack.append((pos, tag, rows[-1][4], []))
            elif kind == "end":
                if not stack or stack[-1][1] != tag:
                    sure = False
                if stack:
                    start, own, described, inside = stack.pop()
                    spans.append((start, pos, own, described, inside.count("name"), "text" in inside))
                    if stack:
                        stack[-1][3].extend(inside)
            elif stack:
                stack[-1][3].append(kind)
        if sure and not stack:
            expected[doc] = sorted(spans)
    got: dict[int, list] = {}
    unsure = set()
    for r in objects.marked_spans(spark.createDataFrame(rows, "doc int, pos int, kind string, tag string, described boolean"), ["doc"]).collect():
        if r.unsure:
            unsure.add(r.doc)
        else:
            got.setdefault(r.doc, []).append((r.start, r.end, r.tag, r.describes, r.names, r.shows_text))
    assert {d: sorted(v) for d, v in got.items()} == {d: v for d, v in expected.items() if v} and len(got) > 10
    assert unsure and not unsure & set(expected)


def test_blank_pixels_against_each_pixel(spark):
    rng, targets, images, runs, expected = random.Random(6), [], [], [], {}
    for page in range(60):
        turn = rng.choice([(60.0, 0.0, 0.0, 40.0), (0.0, 60.0, -40.0, 0.0), (50.0, 12.0, -9.0, 44.0)])
        place, n, m = (*turn, rng.uniform(-5, 5), rng.uniform(-5, 5)), rng.randint(1, 12), rng.randint(1, 9)
        images.append((page, 1, list(place), n, m))
        dark = {(i, j) for i in range(n) for j in range(m) if rng.random() < 0.1}
        for j in range(m):
            for i in range(n):
                if (i, j) in dark and (i - 1, j) not in dark:
                    last = i
                    while (last + 1, j) in dark:
                        last += 1
                    runs.append((page, 1, j, i, last))
        x, y, w, h, s = rng.uniform(-20, 50), rng.uniform(-20, 50), rng.uniform(1, 40), rng.uniform(1, 30), rng.uniform(-6, 6)
        quad = [x, y, x + w, y + s, x - s, y + h, x + w - s, y + h + s]
        targets.append((page, f"t{page}", quad))
        corners = [(quad[k], quad[k + 1]) for k in (0, 2, 6, 4)]

        def held(px, py, corners=corners):
            side = [(bx - ax) * (py - ay) - (by - ay) * (px - ax) for (ax, ay), (bx, by) in zip(corners, corners[1:] + corners[:1], strict=True)]
            return min(side) >= 0 or max(side) <= 0

        at = lambda i, j: ((i + 0.5) / n * place[0] + (j + 0.5) / m * place[2] + place[4], (i + 0.5) / n * place[1] + (j + 0.5) / m * place[3] + place[5])  # noqa: B023, E731
        expected[f"t{page}"] = not any(held(*at(i, j)) for i, j in dark)
    images.append((0, 2, [0.0] * 6, 5, 5))  # no place: nothing can be vouched for
    expected["t0"] = False
    targets.append((999, "alone", [0.0, 0.0, 1.0, 0.0, 0.0, 1.0, 1.0, 1.0]))
    expected["alone"] = True
    got = objects.blank_pixels(
        spark.createDataFrame(targets, "page int, target_id string, quad array<double>"), spark.createDataFrame(images, "page int, image int, transform array<double>, columns int, rows int"),
        spark.createDataFrame(runs, "page int, image int, row int, first int, last int"), ["page"],
    )
    assert {r.target_id: r.blank for r in got.collect()} == expected and len(set(expected.values())) == 2


def test_pages_as_rows_read_like_one_text(spark):
    texts = ["He met John", "Smith and\n John Smith, then John", "  \n ", "Smith-\nson; John ", None, "smith JOHN-", "Smith", "john"]
    terms = [("a", "John Smith"), ("b", "Smithson")]
    rows = spark.createDataFrame([(d, p, t, "kept") for d in (1, 2) for p, t in enumerate(texts[d - 1 :], 1)], "doc_id long, page int, text string, last string")
    docs = spark.createDataFrame([(d, "\f".join(t or "" for t in texts[d - 1 :])) for d in (1, 2)], "doc_id long, text string")
    got = lifecycle.page_terms(rows.repartition(5), terms).collect()
    whole = lifecycle.matches(docs, terms).filter("kind = 'term'").collect()
    assert sorted((r.doc_id, r.page, r.term, r.start, r.end, tuple(r.notes)) for r in got if r.part != "first") == sorted((r.doc_id, r.page, r.term, r.start, r.end, tuple(r.notes)) for r in whole)
    first, second = ([(r.doc_id, r.page, r.text) for r in got if r.part == p] for p in ("first", "second"))
    assert len(first) == len(second) > 0 and (1, 1, "John") in first and (1, 2, "Smith") in second
    assert {p for d, p, t in first if d == 1 and t == "John"} >= {1, 2}  # over a blank page too
    assert lifecycle.page_terms(rows.filter("false"), terms).count() == 0


def test_page_text_rules(spark):
    def line(n, text, block=0, y=100.0, marks=()):
        out = []
        for i, c in enumerate(text):
            small = i in marks
            h, up = (5.0, 4.0) if small else (10.0, 0.0)
            out.append((1, 1, n * 100 + i, block, n, ord(c), 10.0 * i, y - up, [10.0 * i, y - up - h, 10.0 * i + 10, y - up - h, 10.0 * i, y - up, 10.0 * i + 10, y - up], 1.0, 0.0))
        return out

    rows = line(0, "27th September", marks=(2, 3)) + line(1, "ﬁne Smith-", y=120) + line(2, "son  ", y=140) + line(3, "next block", block=1, y=160) + line(4, "words up", block=1, y=180, marks=(6, 7))
    rows += [(1, 1, 590, 2, 5, 0xD800, 0.0, 200.0, [0.0, 190.0, 10.0, 190.0, 0.0, 200.0, 10.0, 200.0], 1.0, 0.0), (1, 1, 591, 2, 5, 0xB2, 10.0, 200.0, [10.0, 190.0, 20.0, 190.0, 10.0, 200.0, 20.0, 200.0], 1.0, 0.0)]
    schema = "doc_id int, page int, idx int, block int, line int, code int, ox double, oy double, quad array<double>, dx double, dy double"
    mapped = page_text.points(spark.createDataFrame(rows, schema).repartition(4))
    t = page_text.texts(mapped).first()
    # the raised letters are followed by a space of the page's own; those that stand alone stay; a lone surrogate can't be read, and the superscript beside it leaves
    assert t.text == "27 September fine Smith- son  next block words up �"
    assert t.breaks == [12, 24, 40, 49] and t.line_breaks == [12, 24, 40] and [b.joins for b in t.blocks] == [[12, 24], [10], []]
    spans = spark.createDataFrame([(1, 1, 1, "phone", 0, 12), (1, 1, 2, "term", 18, 28), (1, 1, 3, "email", 18, 28), (1, 1, 4, "phone", 13, 14), (1, 1, 5, "phone", 5, 5), (1, 1, 6, "phone", 24, 25)], "doc_id int, page int, span_id int, kind string, start int, end int")
    got = {r.span_id: r for r in page_text.places(spans, mapped).collect()}
    assert (got[1].text, len(got[1].quads)) == ("27 September", 2) and got[1].quads[0] == [0.0, 90.0, 20.0, 90.0, 0.0, 100.0, 20.0, 100.0]
    assert got[2].text == "Smith-son" and got[3].text == "Smith-son" and len(got[2].quads) == 2
    assert (got[4].text, got[4].raw) == ("f", "ﬁ") and 5 not in got and got[6].text == " "
    assert page_text.texts(mapped.filter("false")).count() == 0


def test_walk_moves_only_what_is_new(spark, monkeypatch):
    """A round shuffles the states that its new ones refer to, not the references or what was seen before; each state is written once, and more roles than one whole number has bits are told apart."""
    refs = spark.createDataFrame([(1, f"o{i}", "Next", f"o{i + 1}") for i in range(6)] + [(1, "o6", "Next", "o0"), (1, "o6", "Next", "o0")], "doc_id int, src string, key string, dst string")
    roots = spark.createDataFrame([(1, "o0", "r0")], "doc_id int, obj string, role string")
    chain = ["r0", "r7", "r69", "r35", "r8"]
    rules = spark.createDataFrame([*((a, "Next", b) for a, b in zip(chain, chain[1:], strict=False)), *((f"r{i}", "Other", f"r{i}") for i in range(70))], "role string, key string, becomes string")
    plans, write, kept = [], objects.bucketed, objects.kept(refs)
    monkeypatch.setattr(objects, "bucketed", lambda df, keys, table=None: (plans.append((df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning"), table)), write(df, keys, table))[1])
    least = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        reached = objects.walk(kept, rules, roots)
        assert sorted((r.obj, r.role) for r in reached.collect()) == sorted((f"o{i}", r) for i, r in enumerate(chain))
        assert kept.count() == 7 and len(plans) == 6 and max(n for n, table in plans if table) == 1
        assert spark.table(plans[1][1]).count() == 5
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", least)


def _exchanges(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_page_text_shuffles_turns_not_characters(spark):
    """Turns are dealt out before they are characters; what is read from them, and from the kept source map, lies by page already."""
    sf = "/root/testdata/sf0.001"
    plan = page_queries.page_texts(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.index("Exchange hashpartitioning") > plan.rindex("Generate posexplode")  # the deepest nodes come last
    mapped = page_text.points(page_queries.set_pages(spark, sf), dealt=True)
    kept = spark.table(bucketed(mapped, page_text.PAGE))
    assert _exchanges(page_text.texts(kept)) == 0
    assert sorted(page_text.texts(kept).collect()) == sorted(page_text.texts(page_text.points(page_queries.set_pages(spark, sf).repartition(3))).collect())


def test_spans_meet_characters_where_they_lie(spark):
    """Over the kept source map nothing is shuffled for spans, and its characters are read once for them; long, overlapping and empty spans and ones past either end meet what each character by itself says."""
    sf = "/root/testdata/sf0.001"
    kept = spark.table(bucketed(page_text.points(page_queries.set_pages(spark, sf), dealt=True), page_text.PAGE))
    found = page_text.places(page_queries._spans(page_text.texts(kept)), kept)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert _exchanges(found) == 0 and plan.count("FileScan parquet") == 2
    small = kept.filter("doc_id < 4")
    spans = small.select("doc_id", "page").distinct().crossJoin(spark.createDataFrame([(0, -7, 3), (1, 0, 200), (2, 63, 65), (3, 64, 128), (4, 150, 9000), (5, 20, 20), (6, -9, 0), (7, 0, 64), (8, 700, 9000)], "span_id int, start int, end int")).withColumn("kind", F.lit("term"))
    got = sorted((r.doc_id, r.page, r.span_id, r.idx) for r in page_text.covered(spans, small).collect())
    chars = small.collect()
    expected = sorted((c.doc_id, c.page, s.span_id, c.idx) for s in spans.collect() for c in chars if (c.doc_id, c.page) == (s.doc_id, s.page) and s.start < s.end and s.start < c.start + len(c.points) and s.end > c.start - (c.join is not None))
    assert got == expected and len(got) > 1000
