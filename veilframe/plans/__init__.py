"""Whole query plans: from documents to matches, redacted text and reports."""
