"""All queries of the subpackage and their SQL, by name."""

from __future__ import annotations

import importlib
import importlib.util

_NAMES = ["match_groups", "grouped_splits", "addresses", "overlaps", "names", "looks", "encoding", "leaks", "sentences"]
_MODULES = [importlib.import_module(f"pairloom.llm.{n}") for n in _NAMES if importlib.util.find_spec(f"pairloom.llm.{n}")]

QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
SQL = {k: v for m in _MODULES for k, v in m.SQL.items()}
