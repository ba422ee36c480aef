"""All registered queries of the library (without the ``llm`` subpackage) and their SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
FLAGSHIP = "hybrid_search"
MODULES: tuple[str, ...] = ("texts", "ranks", "chunks", "guard", "evals", "figures", "audits", "layout", "agents", "stores", "gates", "sections", "evidence")


def queries() -> dict[str, Query]:
    out: dict[str, Query] = {}
    for name in MODULES:
        out |= importlib.import_module(f"cairn.plans.{name}").QUERIES
    return out


def oracles() -> dict[str, str]:
    out: dict[str, str] = {}
    for name in MODULES:
        out |= importlib.import_module(f"cairn.plans.{name}").ORACLES
    return out
