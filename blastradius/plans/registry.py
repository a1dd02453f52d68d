"""Registered queries and the SQL each one is checked against."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from blastradius.plans import estate
from blastradius.workspace import Workspace

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_contexts: dict[tuple[str, str], "Context"] = {}


class Context:
    """Inputs of one run: views by name, written tables by name, a workspace."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self.ws = Workspace(spark, "zstd")
        self._views: dict[str, DataFrame] = {}
        self._shared: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name in estate.TABLES:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        if name not in self._views:
            view = self.given(name)
            if name in estate.WRITTEN:
                view = self.ws.save(view, name)
            elif name in estate.TEXTS:
                view = view.repartition(estate.TEXTS[name])
            self._views[name] = view
        return self._views[name]

    def given(self, name: str) -> DataFrame:
        """A view as it is defined and not written, for queries that read few of its rows: filters reach the given tables."""
        return self.sql(estate.spelled_last(estate.VIEWS[name]))

    def sql(self, text: str) -> DataFrame:
        """Inline SQL over the given tables."""
        return estate.spark_sql(self.spark, self.sf_dir, text)

    def shared(self, name: str, build: Callable[["Context"], DataFrame]) -> DataFrame:
        """A table several queries read, computed once per session and data folder."""
        if name not in self._shared:
            self._shared[name] = build(self)
        return self._shared[name]


def context(spark: SparkSession, sf_dir: str) -> Context:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _contexts:
        _contexts[key] = Context(spark, sf_dir)
    return _contexts[key]


def forget(spark: SparkSession) -> None:
    """Drop every shared table, so that the next query starts from the given tables."""
    app = spark.sparkContext.applicationId
    for key in [k for k in _contexts if k[0] == app]:
        _contexts.pop(key).ws.drop()


def query(name: str, oracle: str | None = None) -> Callable:
    """Register a function of a Context; ``oracle`` names views as ``fx_<view>``."""

    def register(build: Callable[[Context], DataFrame]) -> Callable[[Context], DataFrame]:
        assert name not in QUERIES, name
        QUERIES[name] = lambda spark, sf_dir: build(context(spark, sf_dir))
        if oracle is not None:
            ORACLES[name] = oracle_text(oracle)
        return build

    return register


def oracle_text(body: str) -> str:
    """Prefix a check with the views it reads; CTEs of its own stand before ``/*main*/``."""
    if body.startswith("with "):
        return body
    used = [v for v in estate.VIEWS if re.search(rf"\bfx_{v}\b", body)]
    heads = [f"fx_{v} as ({estate.VIEWS[v].strip()})" for v in used]
    own, main = body.split("/*main*/") if "/*main*/" in body else ("", body)
    recursive = "recursive " if "recursive" in own else ""
    if own.strip():
        heads.append(own.strip().removeprefix("recursive").strip())
    return f"with {recursive}" + ",\n".join(heads) + "\n" + main.strip() if heads else main.strip()
