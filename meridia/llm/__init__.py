"""Operators for preparing training corpora.

Nothing outside this subpackage imports it.  ``QUERIES`` and ``ORACLES`` hold
the registered queries and their SQL; the entry module adds them when the
subpackage can be found.
"""
