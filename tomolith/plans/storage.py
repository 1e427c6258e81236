"""Cutting lineage: results of an iteration go to storage that every executor can read."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from tomolith.errors import InvalidArgumentError


@contextmanager
def settings(spark: SparkSession, **conf: str) -> Iterator[None]:
    """Settings of the session (names with __ for .) while plans are made; restored afterwards."""
    names = {k.replace("__", "."): v for k, v in conf.items()}
    before = {k: spark.conf.get(k) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def kept(df: DataFrame) -> DataFrame:
    """``df`` persisted with the partitioning it was given, which adaptive execution would forget: joins on its keys need no exchange of it."""
    with settings(df.sparkSession, spark__sql__adaptive__enabled="false"):
        return df.persist()


def saved_as_dealt(df: DataFrame) -> DataFrame:
    """``saved``, and what is saved keeps its partitioning: two vectors dealt by their index meet without an exchange."""
    with settings(df.sparkSession, spark__sql__adaptive__enabled="false"):
        return saved(df)


def saved(df: DataFrame) -> DataFrame:
    """``df``, checkpointed in the folder that ``spark.checkpoint.dir`` names.

    A replicated or shared folder survives lost executors, which a copy on one executor's
    disk does not. The fallback folder serves tests on one machine.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local"):
            raise InvalidArgumentError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(folder or "/tmp/checkpoints")
    return df.checkpoint(eager=True)
