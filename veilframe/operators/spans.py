"""Spans: what detectors find in a block of text."""

from __future__ import annotations

from typing import NamedTuple

# The kinds of personal data, and which keeps a place that two claim (first wins).
KINDS = ("email", "phone", "date", "card", "iban", "us-ssn", "uk-nino")
PRECEDENCE = ("email", "iban", "card", "us-ssn", "uk-nino", "phone", "date")


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    ticked: bool
    rescued: bool = False
