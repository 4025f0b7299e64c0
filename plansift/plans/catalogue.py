"""All queries of the engine over the standard tables, with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plansift.plans import boxes, describing, forms, linking, searching, stores

_PAIRS = [*linking.PAIRS, *searching.PAIRS, *forms.PAIRS, *boxes.PAIRS, *describing.PAIRS, *stores.PAIRS]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f, _ in _PAIRS}
ORACLES: dict[str, str] = {f.__name__: sql for f, sql in _PAIRS if sql}
