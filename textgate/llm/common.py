"""Helpers shared by the operators: ASCII case, words, stored intermediate tables."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textgate.storage import shared_dir

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and nothing else. A text of ASCII alone takes the cheap path."""
    return F.when(F.length(c) == F.octet_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Jobs started inside pass small Arrow batches to Python, which bounds the memory of long texts."""
    before = {k: spark.conf.get(k, None) for k in BATCHES}
    try:
        for k, v in BATCHES.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def give_back() -> None:
    """Hands freed memory, Arrow's too, back to the system: Python workers live on and would keep the peak of each stage they served."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


_scopes: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables stored inside are deleted at the end, but for those handed to the yielded function, which an outer scope may delete."""
    mine: list[str] = []
    kept: set[str] = set()

    def keep(df: DataFrame) -> DataFrame:
        kept.add(df._stored_at)
        return df

    _scopes.append(mine)
    try:
        yield keep
    finally:
        _scopes.remove(mine)
        if _scopes:
            _scopes[-1].extend(kept)
        jvm = spark._jvm
        for path in mine:
            if path not in kept:
                at = jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/textgate/{name}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    with small_batches(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
