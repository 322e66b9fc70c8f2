"""Intermediate tables of a plan that reads them more than once."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame

_own: dict[str, str] = {}


def folder(spark) -> str:
    """The shared folder that the session names in spark.checkpoint.dir; where that is unset, a temporary one, on a single
    machine only."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="varve-", dir=os.environ.get("TMPDIR", "/tmp"))
    return _own[app]


def stage(df: DataFrame, name: str) -> DataFrame:
    """df written once and read back, so that each of its readers starts from the table."""
    path = f"{folder(df.sparkSession)}/stage-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df's rows dealt out by keys over all cores, for work that is costly per row: a small file is one task, however much is made of
    its rows. The number of parts is given, so that it isn't cut down by the size of the rows."""
    spark = df.sparkSession
    parts = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(parts, *keys)


def put_file(spark, path: str, text: str) -> None:
    """A small file that is there whole or not at all; one that stands there is replaced."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    there = hadoop.Path(path)
    fs, aside = there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop.Path(there.getParent(), f"_{there.getName()}")
    stream = fs.create(aside, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    if fs.exists(there):
        fs.delete(there, False)
    if not fs.rename(aside, there):
        raise OSError(f"{path} was put in place by someone else")


def read_file(spark, path: str) -> str:
    """A small file's text, whatever its name."""
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    stream = there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(there)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
