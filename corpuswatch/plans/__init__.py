"""Queries by theme; importing the package registers them."""

from . import log_queries, page_queries, record_queries, register_queries, search_queries, version_queries  # noqa: F401
