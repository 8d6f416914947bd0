"""Queries over the given tables, one for each operator; importing this package registers them."""

from loomstone.queries import aggregates, dedup_graph, exports, filters, imports, joins, search, text, windows  # noqa: F401
