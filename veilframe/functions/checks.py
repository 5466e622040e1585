"""Checks that make a shape a value: each as a Python function and, where Catalyst can say it, as a column."""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from .chars import HYPHEN_CLASS

# Issuer prefixes (from, to) and the lengths issued.
CARD_BRANDS: tuple[tuple[str, tuple[tuple[str, str], ...], tuple[int, ...]], ...] = (
    ("Visa", (("4", "4"),), (13, 16, 19)),
    ("Mastercard", (("51", "55"), ("2221", "2720")), (16,)),
    ("American Express", (("34", "34"), ("37", "37")), (15,)),
    ("Discover", (("6011", "6011"), ("644", "649"), ("65", "65")), (16, 17, 18, 19)),
    ("JCB", (("3528", "3589"),), (16, 17, 18, 19)),
    ("Diners Club", (("300", "305"), ("36", "36"), ("38", "38"), ("39", "39")), (14, 15, 16, 17, 18, 19)),
    ("UnionPay", (("62", "62"),), (16, 17, 18, 19)),
)

# IBAN lengths by country, as the public registry has them.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BI": 27, "BR": 29, "BY": 28,
    "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DJ": 27, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18,
    "FK": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HN": 28, "HR": 21, "HU": 28,
    "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20,
    "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MN": 20, "MR": 27, "MT": 31, "MU": 30, "NI": 28,
    "NL": 18, "NO": 15, "OM": 23, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "RU": 33, "SA": 24,
    "SC": 31, "SD": 18, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "SO": 23, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26,
    "UA": 29, "VA": 22, "VG": 24, "XK": 20, "YE": 30,
}

# Letters and pairs that no UK National Insurance prefix has.
NINO_NEVER_FIRST, NINO_NEVER_SECOND = "DFIQUV", "DFIOQUV"
NINO_NEVER_PAIR = ("BG", "GB", "KN", "NK", "NT", "TN", "ZZ")

FIRST_YEAR, LAST_YEAR = 1900, 2099


#: The digits of twice a digit, added.
_DOUBLED = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)


def luhn(digits: str) -> bool:
    return (sum(map(int, digits[-1::-2])) + sum(_DOUBLED[int(d)] for d in digits[-2::-2])) % 10 == 0


def card_brand(digits: str) -> str | None:
    for name, prefixes, lengths in CARD_BRANDS:
        if len(digits) in lengths and any(lo <= digits[: len(lo)] <= hi for lo, hi in prefixes):
            return name
    return None


def card_brand_column(digits: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, prefixes, lengths in reversed(CARD_BRANDS):
        fits = F.lit(False)
        for lo, hi in prefixes:
            fits = fits | F.substring(digits, 1, len(lo)).between(lo, hi)
        out = F.when(F.length(digits).isin(*lengths) & fits, name).otherwise(out)
    return out


_IBAN_VALUES = {ord(c): str(int(c, 36)) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"}


def iban_check(code: str) -> bool:
    """ISO 13616: the first four characters to the end, letters as two digits, remainder by 97 is 1."""
    return int((code[4:] + code[:4]).translate(_IBAN_VALUES)) % 97 == 1


def iban_remainder_column(code: Column) -> Column:
    moved = F.concat(F.substring(code, 5, 64), F.substring(code, 1, 4))
    one = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.split(moved, ""), F.lit(0), lambda r, c: (r * F.when(one(c) > 9, 100).otherwise(10) + one(c)) % 97)


def iban_length_column(country: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in IBAN_LENGTHS.items() for x in pair])[country]


def ssn_issuable(area: str, group: str, serial: str) -> bool:
    return area not in ("000", "666") and area[0] != "9" and group != "00" and serial != "0000"


def nino_prefix(pair: str) -> bool:
    a, b = pair.upper()
    return a not in NINO_NEVER_FIRST and b not in NINO_NEVER_SECOND and a + b not in NINO_NEVER_PAIR


def days_in(year: int, month: int) -> int:
    if month == 2:
        return 29 if year % 4 == 0 and (year % 100 != 0 or year % 400 == 0) else 28
    return 30 if month in (4, 6, 9, 11) else 31


def real_day(year: str, month: int, day: int) -> bool:
    """A calendar day of 1900 to 2099; a year of two digits counts in either century."""
    if not 1 <= month <= 12 or day < 1:
        return False
    years = [int(year)] if len(year) == 4 else [1900 + int(year), 2000 + int(year)]
    return any(FIRST_YEAR <= y <= LAST_YEAR and day <= days_in(y, month) for y in years)


_HYPHENS = re.compile(f"[{HYPHEN_CLASS}]")
_YEAR_FIRST, _YEAR_LAST = re.compile(r"([0-9]{4})([-/])([0-9]{2})\2([0-9]{2})"), re.compile(r"([0-9]{1,2})([-/.])([0-9]{1,2})\2([0-9]{4}|[0-9]{2})")


@lru_cache(maxsize=65536)
def numeric_date(text: str) -> bool:
    """Day and month in either order then the year, or year first with two digits each by - or /; one separator twice, dashes alike."""
    if not 6 <= len(text) <= 10:
        return False
    plain = _HYPHENS.sub("-", text)
    if m := _YEAR_FIRST.fullmatch(plain):
        return real_day(m[1], int(m[3]), int(m[4]))
    if m := _YEAR_LAST.fullmatch(plain):
        return real_day(m[4], int(m[3]), int(m[1])) or real_day(m[4], int(m[1]), int(m[3]))
    return False


def year_first_date(text: str) -> bool:
    m = re.fullmatch(r"([0-9]{4})([-/.])([0-9]{1,2})\2([0-9]{1,2})", re.sub(f"[{HYPHEN_CLASS}]", "-", text))
    return bool(m) and real_day(m[1], int(m[3]), int(m[4]))


def unseparated_date(text: str) -> bool:
    return len(text) == 8 and text.isascii() and text.isdigit() and real_day(text[:4], int(text[4:6]), int(text[6:]))


def real_day_column(year: Column, month: Column, day: Column) -> Column:
    """The same for integer columns of four-digit years; NULL-safe and never an error."""
    leap = (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))
    last = F.when(month == 2, F.when(leap, 29).otherwise(28)).when(month.isin(4, 6, 9, 11), 30).otherwise(31)
    return F.coalesce(year.between(FIRST_YEAR, LAST_YEAR) & month.between(1, 12) & day.between(1, last), F.lit(False))
