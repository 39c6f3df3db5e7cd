"""All queries of the engine's own operators, with their oracle SQL."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators import workers

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
FLAGSHIP = "rewrite_documents"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with DuckDB SQL for its rows."""

    def add(f: Query) -> Query:
        @functools.wraps(f)
        def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
            workers.prepare(spark)
            return f(spark, sf_dir)

        QUERIES[f.__name__] = prepared
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return prepared

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(spark: SparkSession) -> str:
    """The folder that the cluster names for checkpoints; where it names none, a
    local one is set if all runs on one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="glyphshift-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder for a query's files, where driver and executors both see it."""
    return f"{checkpointed(spark)}/glyphshift/{name}-{uuid.uuid4().hex}"


def values(spark: SparkSession, rows: str, columns: str) -> DataFrame:
    """Literal rows, as SQL: a rule table that a query brings along."""
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t({columns})")


from . import audit, files, graphs, inflection, knowledge, lexicon, packs, programs, rewriting, rules, stages, text, tokens, units  # noqa: E402, F401
