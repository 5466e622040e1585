from __future__ import annotations

import random
import time

import pytest

from veilframe.functions import chars, checks
from veilframe.operators import codes, dates, phones, resolve
from veilframe.operators.spans import Span
from veilframe.plans import lifecycle, queries
from veilframe.sources import gates


def shown(found, text):
    return [(text[s.start : s.end], s.ticked) for s in found]


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("Write to jo.b@mail.example.org.", ["jo.b@mail.example.org"]),
        ("a..b@c.org .a@c.org a.@c.org", []),
        ("x@localhost x@a.b1 x@-a.org", []),
        ("ü@köln.de, a@b@c.org", ["ü@köln.de", "b@c.org"]),
        ("a" * 65 + "@b.org", []),
        ("me@a.co.uk1", []),
    ],
)
def test_email(text, expected):
    assert [t for t, _ in shown(codes.email(text), text)] == expected


def test_email_wrapped_line():
    text = "see jane@exam ple.org"
    assert codes.email(text, []) == []
    text = "see jane@ example.org now"
    assert shown(codes.email(text, [9]), text) == [("jane@ example.org", True)]


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("GB82WEST12345698765432", ["GB82WEST12345698765432"]),
        ("IBAN GB82 WEST 1234 5698 7654 32Bank", ["GB82 WEST 1234 5698 7654 32"]),
        ("GB83WEST12345698765432 XGB82WEST12345698765432", []),
        ("DE89 3704 0044 0532 0130 00", ["DE89 3704 0044 0532 0130 00"]),
    ],
)
def test_iban(text, expected):
    assert [t for t, _ in shown(codes.iban(text), text)] == expected


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("4111111111111111", [("4111111111111111", True)]),
        ("4111-1111-1111-1111", [("4111-1111-1111-1111", True)]),
        ("card 3782 822463 10005 ok", [("3782 822463 10005", True)]),
        ("41111111111111119", [("4111111111111111", False)]),
        ("4111 1111 1111 1112", []),
        ("4111111111111111-12/28", [("4111111111111111", True)]),
        ("0000000000000000", []),
    ],
)
def test_card(text, expected):
    assert shown(codes.card(text), text) == expected


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("123-45-6789", [("123-45-6789", True)]),
        ("666-45-6789 900-45-6789 123-00-6789 123-45-0000", []),
        ("123-45-67891", [("123-45-6789", False)]),
        ("123-45-678912", []),
        ("123456789", []),
        ("Social Security: 123456789", [("123456789", True)]),
        ("123-45 6789", []),
    ],
)
def test_ssn(text, expected):
    assert shown(codes.us_ssn(text), text) == expected


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("AB123456C", [("AB123456C", True)]),
        ("ab 12 34 56 c.", [("ab 12 34 56 c", True)]),
        ("AB 12 34 56 apply", [("AB 12 34 56", True)]),
        ("AB123456Cx", [("AB123456C", False)]),
        ("AB1234561", [("AB123456", False)]),
        ("BG123456A QQ123456A xAB123456C", []),
    ],
)
def test_nino(text, expected):
    assert shown(codes.uk_nino(text), text) == expected


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("call 020 7946 0958", [("020 7946 0958", True)]),
        ("+44 (0)20 7946 0958", [("+44 (0)20 7946 0958", True)]),
        ("+1 (743) 555-3824 ext. 12", [("+1 (743) 555-3824 ext. 12", True)]),
        ("2125550123", [("2125550123", False)]),
        ("tel 2125550123", [("2125550123", True)]),
        ("INV-2026-000123", []),
        ("05.12.1980", []),
        ("212 555 0123/0124", [("212 555 0123", True)]),
        ("9346 212 555 0123", [("9346 212 555", True), ("0123", False)]),
    ],
)
def test_phone(text, expected):
    assert shown(phones.phone(text), text) == expected


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("27.09.2026 09/27/26 2026-09-27", ["27.09.2026", "09/27/26", "2026-09-27"]),
        ("30.02.2026 31/06/1999 2026-13-01", []),
        ("27th of Sept. 2026, 3–5 June 2026", ["27th of Sept. 2026", "3–5 June 2026"]),
        ("May 1, 1980 and Mai 1, 1980", ["May 1, 1980"]),
        ("x27 September 2026 REF-05.12.1980 9/05/12/1980", []),
        ("05.12.1980a 12/05/1980-Smith", ["05.12.1980", "12/05/1980"]),
        ("2026-09-27-01", []),
        ("2026-09-01-2026-09-30", ["2026-09-01", "2026-09-30"]),
        ("27 September 20261 27 September 202612", ["27 September 2026"]),
        ("05-Jan-2026 20260927 2026.9.7 27 / 09 / 2026", ["05-Jan-2026", "20260927", "2026.9.7", "27 / 09 / 2026"]),
        ("27 Sep '26 Sep 27 10am 27th day of September 2026", ["27 Sep '26", "27th day of September 2026"]),
        ("Updated27/09/2026", ["27/09/2026"]),
    ],
)
def test_date(text, expected):
    assert [t for t, _ in shown(dates.date(text), text)] == expected


def test_date_ticks_after_birth_word():
    for text in ("Born 12/05/1980", "DOB27/09/1980", "Date of birth: 1 May 1980"):
        assert dates.date(text)[0].ticked, text
    assert not dates.date("Due 12/05/1980")[0].ticked


def test_checks():
    assert checks.luhn("79927398713") and not checks.luhn("79927398710")
    assert checks.card_brand("378282246310005") == "American Express" and checks.card_brand("9" * 16) is None
    assert checks.real_day("00", 2, 29) and not checks.real_day("1900", 2, 29)


def test_precedence_splits_lower_kinds():
    text = "aaaa 12345 bbbb"
    got = resolve.resolve(text, {"card": [Span("card", 5, 10, True)], "phone": [Span("phone", 0, 15, False)]})
    assert [(s.kind, text[s.start : s.end]) for s in got] == [("phone", "aaaa"), ("card", "12345"), ("phone", "bbbb")]


def test_resolve_is_disjoint_sorted_and_covers():
    rng = random.Random(5)
    alphabet = "0123456789-./ +()abAB@'\n"
    for _ in range(400):
        text = "".join(rng.choice(alphabet) for _ in range(60))
        rows = resolve.detect(text)
        assert all(a.end <= b.start for a, b in zip(rows, rows[1:], strict=False))
        held = {i for s in rows for i in range(s.start, s.end)}
        for kind in ("email", "iban", "card", "us-ssn", "uk-nino"):
            for s in resolve.DETECTORS[kind](text):
                assert all(i in held for i in range(s.start, s.end) if chars.alnum(text[i]))


@pytest.mark.parametrize("unit", ["1 ", "12-", "a@", "a.", "+1 ", "4111 ", "2026.9.", "1/1/", "AB12 ", "May 1 ", "(0)", "x@a.", "00 1-"])
def test_linear_time(unit):
    text = unit * (60_000 // len(unit))
    began = time.process_time()
    resolve.detect(text)
    assert time.process_time() - began < 20


def test_normalise_and_fold():
    assert chars.normalise("１２３ ﬁ ½") == "123 fi 1⁄2"
    assert chars.fold_term("  É’s­-Test ") == "e's-test"
    assert chars.term_length("éx") == 2
    assert chars.lines_of("a\r\nb\nc") == ["a", "b", "c"]


def test_numbers_of_other_plans():
    ticked = lambda t: [(t[s.start : s.end], s.ticked) for s in phones.phone(t)]
    assert ticked("call +33 1 42 68 53 00 now") == [("+33 1 42 68 53 00", True)]
    assert ticked("+49 30 901820, +34 912 345 678") == [("+49 30 901820", True), ("+34 912 345 678", True)]
    assert ticked("+353 1 679 5666") == [("+353 1 679 5666", True)]
    assert ticked("+33 1 42 68 53")[0][1] is False  # too short for its plan
    assert phones.international("999123456789") == "possible"


def test_rescued_rows_yield_to_dates():
    text = "555 123 2026-01-02 9"
    row = Span("phone", 0, 20, False, True)
    got = resolve.yield_rescued(text, [row], [Span("date", 8, 18, False)])
    assert [(s.start, s.end, s.rescued) for s in got] == [(0, 7, False)]
    assert resolve.yield_rescued(text, [row], [Span("date", 0, 3, False)]) == []
    kept = row._replace(rescued=False)
    assert resolve.yield_rescued(text, [kept], [Span("date", 0, 3, False)]) == [kept]
    assert resolve.yield_rescued(text, [row], []) == [kept]


def test_dates_ask_forms_only_where_a_month_can_stand(monkeypatch):
    """Figures without a month's name within reach are not tried against the forms with names; the longest way to the name still is."""
    asked = []
    tried = lambda text: dates.date_scans(text)[0] + dates.date_scans(text)[1]

    class Form:
        def __init__(self, form):
            self.form, self.groupindex = form, form.groupindex

        def match(self, text, *at):
            asked.append(text)
            return self.form.match(text, *at)

    common = tuple(map(Form, dates.COMMON))
    monkeypatch.setattr(dates, "COMMON_FORMS", {k: s._replace(forms=common) for k, s in dates.COMMON_FORMS.items()})
    assert tried("tel 555-0123, 4111 1111 1111 1111, 12 34 56 and 2020-01-02") and not asked
    for text in ("4th.   day   of   September 2020", "22nd\u201023rd   of   Sept. 2020", "3-may-20", "1999/MAR/3", "janov 3 2020 Nov 3, 2020"):
        assert tried(text), text


def test_matches_of_some_columns(spark):
    docs = spark.createDataFrame([(1, "born 3 May 1980, a@b.org"), (2, None)], "doc_id long, text string")
    whole = lifecycle.matches(docs)
    some = lifecycle.matches(docs, columns=("ticked", "kind", "start"))
    assert some.columns == ["ticked", "kind", "start"] and sorted(some.collect()) == sorted(whole.select("ticked", "kind", "start").collect()) and some.count() == 2
    assert lifecycle.matches(docs, columns=("match_id",)).filter("match_id is null").count() == 0


def test_detectors_look_only_where_a_value_can_stand(monkeypatch):
    """Figures too few or too far apart for a kind are not read for it; what stands beside them still is."""
    asked = []
    for module, name in ((dates, "_read"), (phones, "_unit"), (codes, "_card_units")):
        monkeypatch.setattr(module, name, lambda *a, own=getattr(module, name), name=name, **k: (asked.append(name), own(*a, **k))[1])
    dull = "Room 12, 345-678 of 2020; 1/2 and 3.4, may 12 34 and 1111 1111 1111, 12:30:45, x99"
    assert dates.date_scans(dull.replace("may", "is"))[0] == [] == codes.card(dull) and phones.phone("Room 12, 345-678 of 2020; 1/2 and 3.4") == [] and not asked
    text = "12, 345-678: +44 20 7946 0958; 4111-1111 1111 1111/2, 3 junov 2020, 3rd-4th of May, 2020 and 2020-01-02/03, 1 - 2 - 1999, 20200102"
    assert resolve.detect(text) and {"_read", "_unit", "_card_units"} == set(asked)
    cards, days = "1/4111 1111 1111 1111/2 5555-5555-5555-4444", "1 - 2 - 1999, junovember 3, 2020, 20200102"
    assert [t for t, _ in shown(codes.card(cards), cards)] == ["4111 1111 1111 1111", "5555-5555-5555-4444"]
    assert [t for t, _ in shown(dates.date(days), days)] == ["1 - 2 - 1999", "20200102"]


def test_orders_are_dealt_before_they_are_texts(spark):
    """One row group read as many splits lies in one of them; its rows still go to all tasks."""
    name = "spark.sql.files.maxPartitionBytes"
    was = spark.conf.get(name)
    spark.conf.set(name, "2k")
    try:
        read = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
        assert read.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
        plan = queries.synth_full_detection(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert plan.index("MapInArrow") < plan.index("Signed") < plan.index("RoundRobinPartitioning") < plan.index("FileScan")  # the deepest nodes come last
        rows = [len(p) for p in gates.dealt(read.select("o_orderkey")).rdd.glom().collect()]
        assert max(rows) < 2 * min(rows)
    finally:
        spark.conf.set(name, was)
