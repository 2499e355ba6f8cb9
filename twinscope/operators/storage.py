"""Lineage cuts for iterative operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, which only local sessions may leave unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found is None:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = getattr(spark, "_twinscope_checkpoints", None) or tempfile.mkdtemp(prefix="twinscope-")
        spark._twinscope_checkpoints = found
    return found


def folder(spark: SparkSession, what: str) -> str:
    """A new folder of the shared one."""
    return f"{shared(spark).rstrip('/')}/twinscope/{what}-{uuid.uuid4().hex}"


@contextmanager
def spent_shuffles(spark: SparkSession) -> Iterator[None]:
    """What is run inside has its shuffles deleted once it is done, since its result is kept."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if was is None else spark.conf.set(name, was)


def cut(df: DataFrame) -> DataFrame:
    """`df` computed once and kept in the checkpoint folder, which executors share."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared(df.sparkSession))
    with spent_shuffles(df.sparkSession):
        return df.select("*").checkpoint(eager=True)  # a table made before doesn't know of the setting


def kept(df: DataFrame, what: str) -> DataFrame:
    """`df` written as a table to the shared folder and read again; many narrow rows take a fraction there of what cut() takes."""
    spark = df.sparkSession
    path = folder(spark, what)
    with spent_shuffles(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
