"""Captions as a stream with state: every file is asked for once, and again only while a try fails."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

#: Keeps the keys seen on the executors' disks and writes what changes, so that a batch costs no more for a long history.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: How often a file is asked for.
TRIES = 3


def _there(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def written(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """The captions under ``path``; none before the first batch."""
    empty = spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path).select(*empty.columns) if _there(spark, path) else empty


def append_captions(
    images: DataFrame, caption: Callable[[DataFrame], DataFrame], path: str, key: str = "file", every: str | None = "60 seconds", text: str = "text", tries: int = TRIES
) -> StreamingQuery:
    """Append ``caption(new images)`` to the captions under ``path`` in batches; ``every`` None works off what there is and ends.

    Which keys have been seen is state of the stream, kept in its checkpoint: of rows of one key the first is taken, also
    after a restart, and no batch reads earlier output. The keys of captions that were under ``path`` before the stream
    began are put into its state when it starts for the first time. Where ``caption`` gives a null or blank ``text``, the row goes to ``<path>-again``,
    which the stream reads too, with a number of tries that ``caption`` can see as column ``tries``; after ``tries`` of
    them it goes to ``<path>-failed``. A batch that is run again writes its own folders anew, so nothing is there twice.
    """
    spark = images.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    base = path.rstrip("/")
    again, failed, seen = f"{base}-again", f"{base}-failed", f"{base}-seen"
    of_key = images.select(key).schema
    if not _there(spark, seen):
        written(spark, base, of_key).distinct().write.parquet(seen)
    known = spark.readStream.schema(of_key).parquet(seen).withColumn("known_", F.lit(True))
    first = images.withColumn("known_", F.lit(False)).unionByName(known, allowMissingColumns=True).dropDuplicates([key])
    first = first.where(~F.col("known_")).drop("known_").withColumn("tries", F.lit(0))
    if not _there(spark, again):
        spark.createDataFrame([], first.schema).write.mode("ignore").parquet(f"{again}/batch=-1")
    more = spark.readStream.schema(first.schema).option("recursiveFileLookup", "true").parquet(again)

    def one(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()
        # what was known and what is new may come in the first batch together
        rows = batch.join(spark.read.schema(of_key).parquet(seen), key, "left_anti") if number == 0 else batch
        found = caption(rows).persist()
        done = found.where(F.trim(text) != "")
        done.drop("tries").write.mode("overwrite").parquet(f"{base}/batch={number}")
        left = rows.join(done.select(key), key, "left_anti").withColumn("tries", F.col("tries") + 1).persist()
        left.where(F.col("tries") >= tries).write.mode("overwrite").parquet(f"{failed}/batch={number}")
        todo = left.where(F.col("tries") < tries)
        if not todo.isEmpty():
            todo.write.mode("overwrite").parquet(f"{again}/batch={number}")
        for held in (left, found, batch):
            held.unpersist()

    writer = first.unionByName(more).writeStream.foreachBatch(one).option("checkpointLocation", f"{base}-state")
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def caption_all(images: DataFrame, caption: Callable[[DataFrame], DataFrame], path: str, key: str = "file", tries: int = TRIES, **how) -> None:
    """Work off all there is, failed tries too."""
    for _ in range(tries):
        append_captions(images, caption, path, key, None, tries=tries, **how).awaitTermination()
