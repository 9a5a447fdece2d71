"""Tables that change together: a new version is written whole and verified before one pointer moves to it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

POINTER = "current"


def _files(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), spark._jvm.org.apache.hadoop.fs.Path


def current(spark: SparkSession, path: str) -> str | None:
    """The folder of the version that the pointer names; None before the first."""
    store, place = _files(spark, path)
    pointer = place(f"{path}/{POINTER}")
    if not store.exists(pointer):
        return None
    stream = store.open(pointer)
    try:
        return f"{path}/{bytes(stream.readAllBytes()).decode()}"
    finally:
        stream.close()


def read(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A table of the current version."""
    folder = current(spark, path)
    if folder is None:
        raise FileNotFoundError(f"{path} has no version")
    return spark.read.parquet(f"{folder}/{name}")


def publish(spark: SparkSession, path: str, tables: dict[str, DataFrame], verify: Callable[[dict[str, DataFrame]], DataFrame] | None = None) -> str:
    """Write ``tables`` as a new version under ``path`` and make it the current one; returns its folder.

    ``verify`` gets the tables as they were written and returns violations; any of them, like any failure before, leaves
    the pointer where it was, and the version before stays as the backup. The pointer is one small file that is put in
    place by a rename.
    """
    version = f"v-{uuid.uuid4().hex}"
    folder = f"{path}/{version}"
    for name, rows in tables.items():
        rows.write.parquet(f"{folder}/{name}")
    if verify is not None:
        wrong = verify({name: spark.read.parquet(f"{folder}/{name}") for name in tables}).take(5)
        if wrong:
            raise ValueError(f"the new version is not consistent: {wrong}")
    store, place = _files(spark, path)
    hidden = place(f"{path}/.{POINTER}-{version}")
    stream = store.create(hidden, True)
    stream.write(bytearray(version.encode()))
    stream.close()
    # a rename that takes the place of what is there
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(hidden.makeQualified(store).toUri(), spark._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(hidden, place(f"{path}/{POINTER}"), options)
    return folder
