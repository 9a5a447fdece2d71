"""Files that an earlier run has left: objects, manifests and text entries of decks, a folder for each deck."""

from __future__ import annotations

import codecs
import json
import re
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .decks import opened, write_joined

#: Where a deck's objects may be, the first that is there counts.
OBJECT_PLACES = ("atomic_objects.json", "过程文件/img/atomic_objects.json", "_proc/img/atomic_objects.json")
BOX = "struct<x: double, y: double, w: double, h: double>"
OBJECTS = f"obj_id string, page int, kind string, name string, text string, bbox {BOX}, z_index int, source_media string, output_file string, original_format string, preview_of string"
ENTRIES = "id string, page int, type string, text string, x double, y double, w double, h double"
RECORDS = "page int, index int, kind string, output_file string, original_format string, source_media string, name string, x double, y double, shape_w double, shape_h double, note string"


#: Bytes of a file from which on it is read element by element, and that are read of it at once; characters by which an error may be due to its cut end.
LARGE, CHUNK, CUT = 64 << 20, 4 << 20, 64


def _places(spark: SparkSession, path: str, names: list[str]) -> list[tuple[int, list[str], list[str]]]:
    """The files called one of ``names`` in the folders under ``path``: the name's number, files of usual size, large ones."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    store = hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
    found = []
    for i, name in enumerate(names):
        files = [(f.getPath().toString(), f.getLen()) for f in store.globStatus(hadoop(f"{path.rstrip('/')}/*/{name}")) or ()]
        if files:
            found.append((i, [f for f, size in files if size < LARGE], [f for f, size in files if size >= LARGE]))
    return found


def elements(file: BinaryIO) -> Iterator[str]:
    """The elements of a file's JSON array as they stand, read in stretches; a file that is none raises ValueError.

    An element is cut off at a stretch's end if its error is there or in a text that doesn't end.
    """
    text, decoder, parse = "", codecs.getincrementaldecoder("utf-8-sig")(), json.JSONDecoder().raw_decode
    at, over, wanted = 0, False, "["

    def more() -> None:
        nonlocal text, at, over
        chunk = file.read(CHUNK)
        text, at, over = text[at:] + decoder.decode(chunk, not chunk), 0, not chunk

    while True:
        while (at := _SPACE.match(text, at).end()) == len(text) and not over:
            more()
        here = text[at : at + 1]
        if wanted == "[":
            if here != "[":
                raise ValueError("no array")
            at, wanted = at + 1, "first"
        elif here == "]" and wanted in ("first", ","):
            return  # whatever comes after it, as Spark does
        elif wanted == ",":
            if here != ",":
                raise ValueError("no comma")
            at, wanted = at + 1, "next"
        else:
            while True:
                try:
                    end = parse(text, at)[1]
                    if end < len(text) or over:  # a number may go on
                        break
                except json.JSONDecodeError as error:
                    if over or error.pos < len(text) - CUT and not error.msg.startswith("Unterminated"):
                        raise
                more()
            yield text[at:end]
            at, wanted = end, ","


_SPACE = re.compile(r"[ \t\r\n]*")


def _large(spark: SparkSession, files: list[str], schema: str) -> DataFrame:
    """``(file, ..., _broken)``: the rows of large files, in order; a task holds a stretch of one. A file that is no array of objects of the schema has none."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, address in zip(*(c.to_pylist() for c in batch.columns)):
                store, place = opened(address)
                try:
                    with store.open_input_stream(place) as file:
                        for _ in elements(file):
                            pass
                except ValueError:  # before any of it is given out
                    continue
                held, size = [], 0
                with store.open_input_stream(place) as file:
                    for text in elements(file):
                        held.append(text)
                        size += len(text)
                        if size >= CHUNK:
                            yield out(name, held)
                            held, size = [], 0
                if held:
                    yield out(name, held)

    def out(name: str, held: list[str]) -> pa.RecordBatch:
        return pa.record_batch([pa.array([name] * len(held)), pa.array(held, pa.string())], names=["file", "json"])

    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    listed = spark.createDataFrame([(f, hadoop(f).toUri().toString()) for f in files], "file string, address string").repartition(len(files), "file")
    parsed = listed.mapInArrow(run, "file string, json string").select("file", F.from_json("json", f"{schema}, _broken string", {"columnNameOfCorruptRecord": "_broken"}).alias("row"))
    rows = parsed.select("file", "row.*")
    return rows.join(F.broadcast(rows.where("_broken is not null").select("file").distinct()), "file", "left_anti")


def read_json(spark: SparkSession, path: str, names: list[str], schema: str) -> DataFrame:
    """``(folder, place, ...)``: the rows of the files called one of ``names`` in the folders under ``path``; place is the name's number.

    Each file holds one array of objects. A file that is no JSON has no rows, fields that are missing are null. Spark holds
    a whole file in memory, so files of LARGE bytes and more are read element by element; those have to be strict JSON.
    """
    reader = spark.read.schema(f"{schema}, _broken string").option("multiLine", "true").option("columnNameOfCorruptRecord", "_broken")
    found = spark.createDataFrame([], f"{schema}, folder string, place int")
    for i, usual, large in _places(spark, path, names):
        read = []
        if usual:
            read.append(reader.json([_escaped(f) for f in usual]).withColumn("folder", _folder(F.col("_metadata.file_path"), names[i])))
        if large:
            read.append(_large(spark, large, schema).withColumn("folder", F.left("file", F.length("file") - len(names[i]) - 1)).drop("file"))
        for rows in read:
            found = found.unionByName(rows.where("_broken is null").drop("_broken").withColumn("place", F.lit(i)))
    return found


def _escaped(path: str) -> str:
    """A path that Spark takes for itself, not for a pattern."""
    return re.sub(r"([\\*?\[\]{}])", r"\\\1", path)


def _folder(file: Column, name: str) -> Column:
    """A deck's folder from its file; Spark gives files as addresses."""
    plain = F.url_decode(F.replace(file, F.lit("+"), F.lit("%2B")))
    return F.left(plain, F.length(plain) - len(name) - 1)


def read_objects(spark: SparkSession, path: str) -> DataFrame:
    """``(folder, obj_id, page, kind, name, text, x, y, w, h, z_index, ...)`` of each deck's object file, in the first place that has one.

    A deck whose first file cannot be read has none, whatever is in other places.
    """
    rows = read_json(spark, path, list(OBJECT_PLACES), OBJECTS)
    there = spark.createDataFrame([], "folder string, place int")
    for i, usual, large in _places(spark, path, list(OBJECT_PLACES)):
        there = there.unionByName(spark.createDataFrame([(f[: -len(OBJECT_PLACES[i]) - 1], i) for f in usual + large], there.schema))
    rows = rows.join(there.groupBy("folder").agg(F.min("place").alias("place")), ["folder", "place"])
    number = lambda key: F.coalesce(f"bbox.{key}", F.lit(0.0)).alias(key)
    said = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return rows.select("folder", "obj_id", "page", said("kind"), said("name"), said("text"), *map(number, "xywh"), F.coalesce("z_index", F.lit(0)).alias("z_index"), said("source_media"), said("output_file"), said("original_format"), said("preview_of"))


def read_text_entries(spark: SparkSession, path: str) -> DataFrame:
    """``(folder, page, text_id, text, x, y, w, h)``: text entries that have an id and a page; what is missing is empty or 0."""
    rows = read_json(spark, path, ["text_entries.json"], ENTRIES).where("id <> '' and page is not null")
    return rows.select("folder", "page", F.col("id").alias("text_id"), F.coalesce("text", F.lit("")).alias("text"), *[F.coalesce(c, F.lit(0.0)).alias(c) for c in "xywh"])


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """``(folder, page, output_file, ...)``: records that name a file and a page; of records of one file on a page the last."""
    rows = read_json(spark, path, ["manifest.json"], RECORDS).where("output_file <> '' and page is not null")
    last = Window.partitionBy("folder", "page", "output_file").orderBy(F.desc("_at"))
    rows = rows.withColumn("_at", F.monotonically_increasing_id()).withColumn("_n", F.row_number().over(last)).where("_n = 1")
    return rows.select("folder", "page", "output_file", "index", "kind", "original_format", "source_media", "name", "x", "y", "shape_w", "shape_h", "note")


def json_array(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """``(key, content)``: the rows of each key as one JSON array in order, the file that the readers read."""
    own = [c for c in rows.columns if c != key]
    listed = F.array_sort(F.collect_list(F.struct(*order, F.to_json(F.struct(*own), {"ignoreNullFields": "false"}).alias("json"))))
    text = F.concat(F.lit("[\n"), F.array_join(F.transform(listed, lambda r: r["json"]), ",\n"), F.lit("\n]\n"))
    return rows.groupBy(key).agg(F.encode(text, "UTF-8").alias("content"))


def write_json_arrays(rows: DataFrame, path: str, name: Column, key: str, *order: str) -> None:
    """What ``json_array`` makes, written to the file ``name`` of each key object by object, so that no task holds a file."""
    own = [c for c in rows.columns if c != key]
    objects = rows.select(name.alias("name"), F.encode(F.to_json(F.struct(*own), {"ignoreNullFields": "false"}), "UTF-8").alias("content"), *[F.col(c).alias(f"_{i}") for i, c in enumerate(order)])
    write_joined(objects, path, *[f"_{i}" for i in range(len(order))], head="[\n", between=",\n", tail="\n]\n")
