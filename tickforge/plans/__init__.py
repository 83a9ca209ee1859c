"""Queries over the driver's tables."""

from tickforge.plans import books, datasets, full, messages

QUERIES = {**books.QUERIES, **messages.QUERIES, **datasets.QUERIES, **full.QUERIES}
