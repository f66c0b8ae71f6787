"""All queries of this subpackage and their SQL."""

from __future__ import annotations

from . import decontaminate, exact_dedup, html_text, langid, licences, mixing, quality, runs, search, sharding, simhash, tokens, warc

_MODULES = [tokens, mixing, langid, quality, html_text, licences, warc, simhash, decontaminate, exact_dedup, search, sharding, runs]
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLES = {k: v for m in _MODULES for k, v in m.ORACLES.items()}
