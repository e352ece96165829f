"""Registered queries and their SQL twins."""

from . import accounting, checks, corpus, derived, figures, layout, ledger, markup, pages, regions, restored, streams, table_rewrites, tables, text, verify
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "accounting", "checks", "corpus", "derived", "figures", "layout", "ledger", "markup", "pages", "regions", "restored", "streams", "table_rewrites", "tables", "text", "verify"]
