"""Registered queries and their oracle SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable:
    """Registers a (spark, sf_dir) -> DataFrame function under its own name, with its oracle if it has one."""

    def add(f: Callable) -> Callable:
        if f.__name__ in QUERIES:
            raise ValueError(f"query {f.__name__} is registered twice")
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def named(name: str, f: Callable) -> Callable:
    """f under a further name, by which it was registered before."""

    def again(spark: SparkSession, sf_dir: str) -> DataFrame:
        return f(spark, sf_dir)

    again.__name__, again.__doc__ = name, f.__doc__
    return again
