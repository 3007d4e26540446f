"""Catalogue of runnable queries and, where SQL can say the same, their DuckDB twins."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}



class Tables:
    """The driver's parquet tables by attribute, read lazily with naive timestamps as instants."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        naive = [f.name for f in df.schema if isinstance(f.dataType, T.TimestampNTZType)]
        df = df.withColumns({c: F.col(c).cast("timestamp") for c in naive}) if naive else df
        self.__dict__[name] = df
        return df

    def sql(self, text: str) -> DataFrame:
        """Run `text`, which names driver tables as {table}, without touching the catalog."""
        names = set(re.findall(r"\{([a-z]+)\}", text))
        escaped = re.sub(r"\{([a-z]+)\}|[{}]", lambda m: m.group() if m.group(1) else m.group() * 2, text)
        return self.spark.sql(escaped, **{n: getattr(self, n) for n in names})


def query(name: str, sql: str | None = None):
    """Register a function of `Tables` under `name`."""

    def register(build: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = lambda spark, folder: build(Tables(spark, folder))
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register
