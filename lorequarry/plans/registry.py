"""All registered queries of the core library and their oracle SQL, gathered from the plan modules."""

from __future__ import annotations

import importlib
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lorequarry.session import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
PLANS = ("search", "text", "relational", "analytics", "graphs", "security", "context", "tasks", "incremental", "streams", "sources", "parsing")


def query(name: str, sql: str | None = None):
    """Register a query under a name, with the SQL of the same rows where SQL can state them."""

    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return keep


def both(name: str, text: str) -> None:
    """A query whose one SQL text runs on Spark (tables in braces are DataFrames) and on the oracle alike."""
    tables = sorted(set(re.findall(r"\{(\w+)\}", text)))
    QUERIES[name] = lambda spark, sf_dir: spark.sql(text, **{t: read_table(spark, sf_dir, t) for t in tables})
    ORACLES[name] = re.sub(r"\{(\w+)\}", r"\1", text)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["hybrid_rerank"](spark, sf_dir)


for _plan in PLANS:
    importlib.import_module(f"lorequarry.plans.{_plan}")
