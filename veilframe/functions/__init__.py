"""Scalar rules: characters, checks, geometry."""
