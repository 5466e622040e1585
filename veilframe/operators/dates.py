"""Dates: a day, a month and a year together, in figures or with an English month name.

A first scan takes the common forms. A second takes rarer ones, only where the first left the text free and only if they
end before its next date. What stands at a date's edges may make it part of a longer code; a label, a birth word or a time
between two joined dates may set that aside.
"""

from __future__ import annotations

import bisect
import re
from functools import lru_cache
from typing import NamedTuple

import regex

from ..functions import checks
from ..functions.chars import DIGITS, HYPHEN_CLASS, SPACE_CHARS, Words, alnum, at, hyphen, letter, number
from .spans import Span

# Words that announce a birth date; labels of the first scan; more labels of the second.
BIRTH = ("date of birth", "birth date", "birthdate", "DOB", "D.O.B", "born")
LABELS = ("date", "dated", "dt", "exp", "expiry", "expires", "expired", "issued", "valid", "from", "to", "until", "on", "effective", "signed")
MORE_LABELS = ("created", "updated", "modified", "printed", "due", "deadline", "start", "starts", "end", "ends", "issue")
MONTH_NAMES = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
MONTHS = {w: i + 1 for i, name in enumerate(MONTH_NAMES) for w in (name, name[:3])} | {"sept": 9}
SHORT = {name[:3] for name in MONTH_NAMES} | {"sept"}

BIRTH_WORDS = Words(BIRTH)
TIME_MOST, TIME_LETTERS = 40, 5
#: The longest date with a month name, and the furthest that the name begins from the date's figures ('4th.   day   of   ').
NAMED_MOST, NAME_WITHIN = 64, 24
_SP = re.escape(SPACE_CHARS)
_D = f"[{HYPHEN_CLASS}]"
_S, _ORD = f"[{_SP}]", "(?:st|nd|rd|th)?"
_GAP = f"{_S}{{1,3}}"
_MONTH, _DAY, _YEAR = "(?P<month>[a-z]{3,9})", "(?P<day>[0-9]{1,2})", "(?P<year>[0-9]{4})"
_CLOSE = rf"{_MONTH}(?P<stop>\.?),?{_GAP}{_YEAR}"
_FLUSH = f"(?P<sep>[{HYPHEN_CLASS}/.])"
_ANY_YEAR = "(?P<year>[0-9]{4}|[0-9]{2})"
_LOOSE_YEAR = f"(?P<year>[0-9]{{4}}|['{chr(0x2019)}]?[0-9]{{2}})"
_JOINT = f"(?:,{_S}{{0,3}}|{_GAP})"


def _rx(pattern: str):
    return regex.compile(pattern, regex.I)


COMMON = (
    _rx(rf"{_DAY}{_ORD}(?:{_D}(?P<day2>[0-9]{{1,2}}){_ORD})?{_GAP}(?:of{_GAP})?{_CLOSE}"),
    _rx(rf"{_MONTH}(?P<stop>\.?){_GAP}{_DAY}{_ORD}(?:{_S}{{0,3}}{_D}{_S}{{0,3}}(?P<day2>[0-9]{{1,2}}){_ORD})?,?{_GAP}{_YEAR}"),
)
RARE = (
    _rx(rf"{_DAY}{_FLUSH}{_MONTH}(?P=sep){_ANY_YEAR}"),
    _rx(rf"{_YEAR}{_FLUSH}{_MONTH}(?P=sep){_DAY}"),
    _rx(rf"{_DAY}(?P<ord>st|nd|rd|th)?\.?{_GAP}(?:(?P<legal>day){_GAP}of{_GAP}|of{_GAP})?{_MONTH}(?P<stop>\.?){_JOINT}{_LOOSE_YEAR}"),
    _rx(rf"{_MONTH}{_FLUSH}{_DAY}(?P=sep){_ANY_YEAR}"),
    _rx(rf"{_MONTH}(?P<stop>\.?)(?P<glue>,{_GAP}|{_GAP}|){_DAY}{_ORD}{_JOINT}{_LOOSE_YEAR}"),
)
#: Where a month's name may begin, and the first three letters of each.
_MONTH_AT, _MONTH_HEADS = re.compile("[JFMASONDjfmasond](?=[AEPUCOaepuco][A-Za-z])"), frozenset(name[:3] for name in MONTH_NAMES)
_HEADS = "(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)"
#: Where a date may begin beside month names: at a run of figures that goes on as the forms above and below do, up to their second separator or their month (rare: as only the second scan's do).
_RUN = re.compile("[0-9]+")
_GOES_ON = re.compile(
    rf"(?i)[0-9]{{1,4}}[{HYPHEN_CLASS}/.](?:[0-9]{{1,4}}[{HYPHEN_CLASS}/.][0-9]|{_HEADS})|[0-9]{{1,2}}{_ORD}(?:{_D}[0-9]{{1,2}}{_ORD})?\.?{_GAP}(?:(?:day{_GAP})?of{_GAP})?{_HEADS}|(?P<rare>[0-9]{{8}}|[0-9]{{1,4}}{_GAP}[{HYPHEN_CLASS}/.]{_S})"
)
_FIGURES = regex.compile(rf"([0-9]{{1,4}})([{HYPHEN_CLASS}/.])([0-9]{{1,4}})([{HYPHEN_CLASS}/.])([0-9]{{1,5}})(?![0-9])|([0-9]{{1,4}})([{HYPHEN_CLASS}/.])([0-9]{{1,4}})([{HYPHEN_CLASS}/.])([0-9]{{5}})(?=[0-9])")
_SPACED = regex.compile(rf"([0-9]{{1,4}}){_GAP}([{HYPHEN_CLASS}/.]){_GAP}([0-9]{{1,4}}){_GAP}([{HYPHEN_CLASS}/.]){_GAP}([0-9]{{1,5}})(?!\p{{N}})")


class Scan(NamedTuple):
    labels: Words
    forms: tuple  # patterns with a month name
    tests: tuple  # of dates in figures
    carries_on: tuple[str, ...]  # classes of a character that carry figures on


FIRST = Scan(Words(LABELS), COMMON, (checks.numeric_date,), ("digit", "number"))
SECOND = Scan(Words(LABELS + MORE_LABELS), COMMON + RARE, (checks.numeric_date, checks.year_first_date), ("digit",))
#: Each scan with the common forms alone, which are asked before its other figures.
COMMON_FORMS = {scan.tests: scan._replace(forms=COMMON) for scan in (FIRST, SECOND)}
#: What may stand between two joined dates: a time of day, with a digit and no long word.
_TIME = regex.compile(rf"(?s)(?=.*[0-9])(?:\p{{L}}{{1,{TIME_LETTERS}}}(?!\p{{L}})|[\p{{N}}{_SP}:.,+@{HYPHEN_CLASS}])++")
#: Separators at which a date joins another, and after which a letter makes it part of a code.
JOINERS = ("/", "-")


class Side(NamedTuple):
    """What stands beside a date: the class of the next character, that character's class as a separator ('/', '.', '-' for any hyphen, or ''), and the class of the one beyond."""

    near: str
    joint: str
    beyond: str


@lru_cache(maxsize=65536)
def _class_of(c: str) -> str:
    return "digit" if c in DIGITS else "number" if number(c) else "letter" if letter(c) else "other"


def _class(text: str, i: int) -> str:
    return _class_of(text[i]) if 0 <= i < len(text) else ""


@lru_cache(maxsize=65536)
def _kind(c: str) -> str:
    return c if c in ("/", ".") else "-" if hyphen(c) else ""


@lru_cache(maxsize=16)
def _months(text: str) -> list[int]:
    """Where month names may begin, in order: no form fits without one."""
    return [i for m in _MONTH_AT.finditer(text) if text[(i := m.start()) : i + 3].lower() in _MONTH_HEADS]


@lru_cache(maxsize=16)
def _begins(text: str) -> tuple[list[int], list[int]]:
    """Places where each scan may read a date, in order; anywhere else none of its forms fits. The second scan also tries names within names."""
    names, runs, free = [], [], 0
    for i in _months(text):
        if i >= free:
            names.append(i)
            free = i + 3
    for run in _RUN.finditer(text):
        if m := _GOES_ON.match(text, run.start()):
            runs.append((run.start(), m.lastgroup is None))
    return sorted(names + [i for i, common in runs if common]), sorted(_months(text) + [i for i, _ in runs])


@lru_cache(maxsize=256)
def _figure(text: str, i: int):
    """The match of _FIGURES here: several tests ask for it at a place."""
    return _FIGURES.match(text, i)


def _before(text: str, i: int) -> Side:
    return Side(_class(text, i - 1), _kind(at(text, i - 1)), _class(text, i - 2))


def _after(text: str, i: int) -> Side:
    return Side(_class(text, i), _kind(at(text, i)), _class(text, i + 1))


def _announced(text: str, i: int, scan: Scan) -> bool:
    """A birth word or label right before, or one separator before."""
    return any(w.ends_at(text, end) for end in ((i, i - 1) if _kind(at(text, i - 1)) else (i,)) for w in (BIRTH_WORDS, scan.labels))


def _starts_free(text: str, i: int, last: int, own: tuple[str, ...], scan: Scan) -> bool:
    """May a date begin here? Not as the tail of a code (a letter and a joiner) or of longer figures (a number and one of its own separators), unless a label or an earlier date with only a time between (it ends at `last`) says so."""
    side = _before(text, i)
    tail = (side.joint in JOINERS and side.beyond == "letter") or (side.joint in own and side.beyond in ("digit", "number"))
    if not tail or _announced(text, i, scan):
        return True
    return side.joint in JOINERS and 0 <= last >= i - 1 - TIME_MOST and (last >= i - 1 or _TIME.fullmatch(text, last, i - 1) is not None)


def _note(text: str, i: int, long_year: bool, scan: Scan) -> bool:
    """Is this a footnote's digit, one alone after a year in full?"""
    side = _after(text, i)
    return long_year and side.near == "digit" and _class(text, i + 1) not in scan.carries_on


def _ends_free(text: str, end: int, own: tuple[str, ...], long_year: bool, scan: Scan) -> bool:
    """May a date end here? Its figures must not run on, nor go on behind one of its own separators, unless that is a footnote or the next date."""
    side = _after(text, end)
    if side.near in scan.carries_on:
        return _note(text, end, long_year, scan)
    if side.joint not in own or side.beyond not in ("digit", "number"):
        return True
    return _next_date(text, end, scan) or (side.joint == "." and own == (".",) and _note(text, end + 1, long_year, scan))


def _next_date(text: str, i: int, scan: Scan) -> bool:
    return _kind(at(text, i)) in JOINERS and (any(_figures(text, i + 1, t, scan) for t in scan.tests) or _written(text, i + 1, scan, False) is not None)


def _figures(text: str, i: int, test, scan: Scan) -> tuple[int, str, bool] | None:
    """(end, separator class, year in full) of a date in figures here, its edges not asked."""
    m = _figure(text, i)
    if not m or m[6]:
        return None
    for cut in (0, 1):  # with the last digit, and with that as a footnote
        raw, end = text[i : m.end() - cut], m.end() - cut
        long_year = 4 in (len(m[1]), len(m[5]) - cut)
        if test(raw) and (not cut or (len(m[5]) >= 3 and _note(text, end, long_year, scan))):
            return end, _kind(m[2]), long_year
    return None


def _numeric(text: str, i: int, last: int, test, scan: Scan) -> int | None:
    got = _figures(text, i, test, scan)
    if not got:
        return None
    end, joint, long_year = got
    return end if _starts_free(text, i, last, (joint,), scan) and _ends_free(text, end, (joint,), long_year, scan) else None


def _eight(text: str, i: int, last: int, scan: Scan) -> int | None:
    end = i + 8
    if not checks.unseparated_date(text[i:end]) or number(at(text, end)):
        return None
    any_joint = ("/", "-", ".")
    return end if _starts_free(text, i, last, any_joint, scan) and _ends_free(text, end, any_joint, False, scan) else None


def _spaced(text: str, i: int, scan: Scan) -> int | None:
    m = _SPACED.match(text, i)
    if not m or _kind(m[2]) != _kind(m[4]):
        return None
    for cut in (0, 1):
        parts = (m[1], m[3], m[5][: len(m[5]) - cut])
        raw, end = m[2].join(parts), m.end() - cut
        if 4 in (len(parts[0]), len(parts[2])) and any(t(raw) for t in scan.tests) and (not cut or (len(m[5]) >= 3 and _note(text, end, True, scan))):
            return end
    return None


def _named(text: str, i: int) -> bool:
    """May a date with a month name begin here: a figure with a name within reach, or a name?"""
    months = _months(text)
    k = bisect.bisect_left(months, i)
    return k < len(months) and (months[k] <= i + NAME_WITHIN if _class(text, i) == "digit" else months[k] == i)


def _written(text: str, i: int, scan: Scan, edges: bool) -> int | None:
    """The end of a date with a month name here, by the first form that fits."""
    if not _named(text, i):
        return None
    begins = ("day", "year") if _class(text, i) == "digit" else ("month",)
    for form in scan.forms:
        m = form.match(text, i, min(len(text), i + NAMED_MOST))
        if m and any(m.start(g) == i for g in begins if g in form.groupindex):
            end = _fits(text, m, scan, edges)
            if end is not None:
                return end
    return None


def _fits(text: str, m, scan: Scan, edges: bool) -> int | None:
    parts = m.groupdict()
    name, year, end = parts["month"].lower(), parts["year"].lstrip("'" + chr(0x2019)), m.end()
    side = _after(text, end)
    ok = (
        name in MONTHS and (not parts.get("stop") or name in SHORT)  # a full stop only after a short name
        and (not parts.get("legal") or parts.get("ord"))  # the 4th day of, not 4 day of
        and (parts.get("glue") != "" or parts.get("stop"))  # Sept.4, not Sept4
        and all(checks.real_day(year, MONTHS[name], int(parts[d])) for d in ("day", "day2") if parts.get(d))
    )
    if ok and edges:
        short_goes_on = len(year) == 2 and (side.near == "letter" or (at(text, end) in (":", ".", ",") and side.near and _class(text, end + 1) in ("digit", "number")))
        ok = _ends_free(text, end, (), len(year) == 4, scan) and not short_goes_on
    return end if ok else None


def _read(text: str, i: int, last: int, scan: Scan) -> int | None:
    """The end of the date here: in figures day or month first, with a name, in figures year first, in eight figures, spaced, by the rarer names."""
    digit = text[i] in DIGITS
    figures, named = digit and _figure(text, i) is not None, _named(text, i)
    end = (figures and _numeric(text, i, last, checks.numeric_date, scan)) or (named and _written(text, i, COMMON_FORMS[scan.tests], True))
    if scan is SECOND:
        end = end or (figures and _numeric(text, i, last, checks.year_first_date, scan)) or (digit and (_eight(text, i, last, scan) or _spaced(text, i, scan))) or (named and _written(text, i, scan, True))
    return end or None


def _scan(text: str, scan: Scan, taken: list[Span]) -> list[Span]:
    out: list[Span] = []
    last, free, k = -1, 0, 0
    for i in _begins(text)[scan is SECOND]:
        if i < free:
            continue
        while k < len(taken) and taken[k].end <= i:
            last = max(last, taken[k].end)
            k += 1
        room = taken[k].start if k < len(taken) else len(text)
        if room <= i or (alnum(at(text, i - 1)) and not _announced(text, i, scan)):
            continue
        end = _read(text, i, last, scan)
        if end is not None and end <= room:
            out.append(Span("date", i, end, BIRTH_WORDS.before(text, i)))
            last = free = end
    return out


def date_scans(text: str) -> tuple[list[Span], list[Span]]:
    """The dates of the first scan, and those that the second adds."""
    if not any(c in text for c in "0123456789"):
        return [], []
    first = _scan(text, FIRST, [])
    return first, _scan(text, SECOND, first)


def date(text: str, joins=()) -> list[Span]:
    first, added = date_scans(text)
    return sorted(first + added, key=lambda s: s.start)
