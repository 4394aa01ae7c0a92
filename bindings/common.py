"""Reading the shared tables, and a registry per module."""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame, SparkSession

from faultline.session import shared_folder, tune


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def fresh_folder(spark: SparkSession, name: str) -> str:
    return shared_folder(spark, f"{name}-{uuid.uuid4().hex}")


class Registry:
    def __init__(self) -> None:
        self.queries: dict = {}
        self.sql: dict[str, str] = {}
        self.operators: dict[str, list[str]] = {}

    def query(self, operators: str, sql: str | None = None):
        """Registers a function under its name with the operators it shows."""

        def add(function):
            name = function.__name__

            @functools.wraps(function)
            def tuned(spark, folder):
                return function(tune(spark), folder)

            self.queries[name] = tuned
            self.operators[name] = operators.split()
            if sql is not None:
                self.sql[name] = sql
            return function

        return add
