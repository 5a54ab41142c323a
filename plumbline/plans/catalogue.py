"""Every registered query of the library with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources import adaptors

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


class Views:
    """Adaptor tables of one scale by name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return getattr(adaptors, name)(self.spark, self.sf_dir)

    def table(self, name: str) -> DataFrame:
        return adaptors.read(self.spark, self.sf_dir, name)


def query(sql: str | None = None, views: str = ""):
    """Register a function of ``Views`` under its name, with DuckDB SQL over the named adaptor views."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        if sql:
            ctes = [adaptors.SQL[v] for v in views.split()]
            body = sql.strip()
            if ctes and body.upper().startswith("WITH RECURSIVE"):
                body = "WITH RECURSIVE " + ", ".join(ctes) + ", " + body[len("WITH RECURSIVE") :]
            elif ctes and body.upper().startswith("WITH"):
                body = "WITH " + ", ".join(ctes) + ", " + body[4:]
            elif ctes:
                body = "WITH " + ", ".join(ctes) + " " + body
            ORACLE[f.__name__] = body
        return f

    return add


from . import coding, detecting, recording, reporting, scoring, tracing  # noqa: E402, F401
