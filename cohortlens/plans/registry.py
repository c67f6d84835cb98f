"""Query registry: every query with, where SQL can say it, the SQL that gives the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .. import ship

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The driver's tables of one folder, and the shared input views derived from them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        raise AttributeError(name)

    def sql(self, text: str) -> DataFrame:
        """Run shared SQL: ``{table}`` names a table, ``embedding@k`` is its k-th value as a double."""
        used = {t: getattr(self, t) for t in TABLES if "{" + t + "}" in text}
        return self.spark.sql(re.sub(r"(\w+)@(\d+)", r"cast(element_at(\1, \2) AS double)", text), **used)


def duck(text: str) -> str:
    """The same shared SQL for the oracle."""
    text = re.sub(r"(\w+)@(\d+)", r"cast(list_extract(\1, \2) AS double)", text)
    return re.sub(r"\{(\w+)\}", r"\1", text)


def query(name: str, oracle: str | None = None):
    def register(build: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            ship(spark)
            return build(Tables(spark, folder))

        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = duck(oracle)
        return build

    return register
