"""All queries of the library and the SQL that must give the same rows."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Modules of query groups; each has QUERIES (name -> callable) and ORACLE_SQL (name -> text).
GROUPS = ("sessions", "usage", "scope", "text", "retrieval", "documents", "streams", "rules", "sources")


def _merged(attribute: str) -> dict:
    out: dict = {}
    for name in GROUPS:
        found = getattr(importlib.import_module(f"tidewell.plans.{name}"), attribute)
        if clash := out.keys() & found.keys():
            raise ValueError(f"registered twice: {sorted(clash)}")
        out |= found
    return out


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _merged("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _merged("ORACLE_SQL")
