"""Registry of named queries over the driver tables, each with its reference SQL."""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lectern.session import spread

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

_VIEW = itertools.count()
# Tables with long texts, where one row is much work.
TEXT_TABLES = ("documents", "conversations", "pages", "embeddings")
Query = Callable[[SparkSession, str], DataFrame]


class Tables:
    """Lazy access to the driver tables of one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        table = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return spread(table) if name in TEXT_TABLES else table

    def sql(self, text: str, **frames: DataFrame) -> DataFrame:
        """Spark SQL where ``{name}`` is one of ``frames`` or a driver table; other braces stay."""
        for name in set(re.findall(r"\{(\w+)\}", text)):
            if name in frames or name in TABLES:
                view = f"lectern_{name}_{next(_VIEW)}"
                (frames[name] if name in frames else getattr(self, name)).createOrReplaceTempView(view)
                text = text.replace("{" + name + "}", view)
        return self.spark.sql(text)


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def query(self, name: str, oracle: str | None = None):
        """Register ``fn(tables) -> DataFrame`` under ``name``."""

        def wrap(fn: Callable[[Tables], DataFrame]):
            if name in self.queries:
                raise ValueError(f"duplicate query {name}")
            self.queries[name] = lambda spark, folder: fn(Tables(spark, folder))
            if oracle is not None:
                self.oracles[name] = oracle
            return fn

        return wrap
