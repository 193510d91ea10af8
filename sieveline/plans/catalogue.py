"""The named queries over the tables of a folder, and the SQL each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sieveline.plans import dense, evaluation, filters, fusion, lexical, maintenance, sources, text
from sieveline.plans.common import Registry

PARTS: list[Registry] = [m.registry for m in (lexical, filters, text, dense, fusion, evaluation, sources, maintenance)]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for part in PARTS for name, f in part.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in PARTS for name, sql in part.oracles.items()}
