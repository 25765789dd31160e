"""Operators composed into checks and reports."""
