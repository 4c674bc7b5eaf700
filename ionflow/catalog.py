"""Named queries over the star tables, each with the DuckDB text that gives the same rows.

Every query binds operators of the engine to columns of the star tables. Derived doubles are
rounded half up at four digits on both sides, keys and counts are longs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ionflow.plans import star, star_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = star.QUERIES
SQL: dict[str, str] = star_sql.SQL
