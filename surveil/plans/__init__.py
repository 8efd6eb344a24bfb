"""Queries over the given tables, by kind of operator. Importing this package registers them."""

from . import aggregates, checks, expressions, joins, reports, statistics, tables, texts, windows  # noqa: F401
