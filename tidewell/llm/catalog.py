"""The queries of this folder's operators and their SQL."""

from __future__ import annotations

from . import exact, lines, mixing, ogg, packing, secrets, simhash, suffixes, toxicity, urls

MODULES = (toxicity, lines, ogg, mixing, exact, simhash, packing, urls, suffixes, secrets)
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
SQL = {k: v for m in MODULES for k, v in m.SQL.items()}
