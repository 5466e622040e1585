"""Operators over text blocks, spans and report tables."""
