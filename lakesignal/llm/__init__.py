"""Operators for a training-data pipeline.

One module per operator; ``queries`` registers one driver query for each.  Nothing else in the library imports this package.
"""
