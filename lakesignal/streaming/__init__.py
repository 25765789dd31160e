"""The checks on streams."""
