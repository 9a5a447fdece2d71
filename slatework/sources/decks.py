"""Data sources of zipped decks and of files: archives are read by their directory, so that only wanted parts are unpacked.

``slatework_decks`` reads and writes archives, ``slatework_files`` writes rows as files. Both reach any store that pyarrow
opens by its address; a path without a scheme is a local one.
"""

from __future__ import annotations

import os
import posixpath
import re
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, Filter, In, InputPartition, IsNotNull, Not, StringContains, StringEndsWith, StringStartsWith, WriterCommitMessage,
)

from .sinks import shared_folder, stored

PARTS = "deck_id string, part string, extension string, size bigint, content binary"
#: Bytes of archives that one task reads, if they are several, and of parts that go to Spark together.
BUNDLE_BYTES, BATCH_BYTES = 64 << 20, 4 << 20


def opened(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The store of an address and the place in it."""
    if not re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", path):
        path = "file://" + os.path.abspath(path)
    return pyarrow.fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))


def extension(name: str) -> str:
    """The lower-cased end of a name after its last dot; empty without one."""
    return name.rpartition("/")[2].rpartition(".")[2].lower() if "." in name.rpartition("/")[2] else ""


def fits(rule: Filter, row: dict[str, object]) -> bool:
    """Whether a row's value passes a filter that Spark has handed down."""
    if isinstance(rule, Not):
        return not fits(rule.child, row)
    value = row[rule.attribute[0]]
    if isinstance(rule, IsNotNull):
        return value is not None
    if isinstance(rule, In):
        return value in rule.value
    if isinstance(rule, StringStartsWith):
        return value.startswith(rule.value)
    if isinstance(rule, StringEndsWith):
        return value.endswith(rule.value)
    if isinstance(rule, StringContains):
        return rule.value in value
    return value == rule.value


def _column(rule: Filter) -> str | None:
    """The column that a filter which ``fits`` understands is about."""
    if isinstance(rule, Not):
        return _column(rule.child) if not isinstance(rule.child, (Not, IsNotNull)) else None
    if isinstance(rule, (EqualTo, EqualNullSafe, In, IsNotNull, StringStartsWith, StringEndsWith, StringContains)) and len(rule.attribute) == 1:
        return rule.attribute[0]
    return None


@dataclass
class Bundle(InputPartition):
    """Archives that one task reads."""

    archives: list[str]


class DeckReader(DataSourceReader):
    """Parts of the archives under a path.

    Filters on ``deck_id`` choose archives before any is opened; those on ``part`` and ``extension`` are held against an
    archive's directory, and only what passes is unpacked. Without ``contents`` nothing is unpacked at all.
    """

    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.contents = options.get("contents", "true").lower() == "true"
        self.bundle = int(options.get("bundleBytes", BUNDLE_BYTES))
        self.rules: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for rule in filters:
            if _column(rule) in ("deck_id", "part", "extension"):
                self.rules.append(rule)
            else:
                yield rule

    def partitions(self) -> list[Bundle]:
        store, base = opened(self.path)
        info = store.get_file_info(base)
        if info.type == pyarrow.fs.FileType.File:
            found = [info]
        else:
            found = [f for f in store.get_file_info(pyarrow.fs.FileSelector(base, recursive=True)) if f.type == pyarrow.fs.FileType.File and f.path.endswith(".pptx")]
        own = [r for r in self.rules if _column(r) == "deck_id"]
        found = sorted((f for f in found if all(fits(r, {"deck_id": deck_of(f.path)}) for r in own)), key=lambda f: f.path)
        bundles: list[Bundle] = []
        room = 0
        for f in found:
            if not bundles or f.size > room:
                bundles.append(Bundle([]))
                room = self.bundle
            bundles[-1].archives.append(f.path)
            room -= f.size
        return bundles or [Bundle([])]

    def read(self, partition: Bundle) -> Iterator[pa.RecordBatch]:
        store, _ = opened(self.path)
        rows: list[tuple] = []
        held = 0
        for path in partition.archives:
            with store.open_input_file(path) as file:
                try:
                    package = zipfile.ZipFile(file)
                except (zipfile.BadZipFile, pa.ArrowInvalid):  # the latter for files too short to have a directory
                    continue
                for entry in package.infolist():
                    row = {"deck_id": deck_of(path), "part": entry.filename, "extension": extension(entry.filename)}
                    if entry.is_dir() or not all(fits(r, row) for r in self.rules):
                        continue
                    content = unpacked(package, entry) if self.contents else None
                    rows.append((*row.values(), entry.file_size, content))
                    held += len(content or b"") + 200
                    if held >= BATCH_BYTES:
                        yield _batch(rows)
                        rows, held = [], 0
        if rows:
            yield _batch(rows)


def deck_of(path: str) -> str:
    return re.sub(r"\.pptx$", "", posixpath.basename(path))


def unpacked(package: zipfile.ZipFile, entry: zipfile.ZipInfo) -> bytes | None:
    """A part's bytes; null if they are damaged, encrypted or packed in a way that is not known."""
    try:
        return package.read(entry)
    except (zipfile.BadZipFile, zipfile.zlib.error, EOFError, RuntimeError, NotImplementedError):
        return None


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["deck_id", "part", "extension", "size", "content"])


@dataclass
class Written(WriterCommitMessage):
    """How many files a task has written."""

    files: int


class _FileWriter(DataSourceArrowWriter):
    """Files that appear under their name only when they are whole; a task that runs again writes the same ones anew."""

    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.folder = ""

    def commit(self, messages: list[Written | None]) -> None:
        return None

    def abort(self, messages: list[Written | None]) -> None:
        return None

    def start(self, store: pyarrow.fs.FileSystem, place: str) -> tuple[str, pa.NativeFile]:
        folder = posixpath.dirname(place)
        if folder != self.folder:
            store.create_dir(folder, recursive=True)
            self.folder = folder
        hidden = f"{folder}/.{posixpath.basename(place)}.{uuid.uuid4().hex}"
        return hidden, store.open_output_stream(hidden)


class DeckWriter(_FileWriter):
    """Archives from rows ``(deck_id, part, content)``, those of a deck one after the other."""

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, base = opened(self.path)
        now, package, files = None, None, 0

        def close() -> None:
            package.close()
            stream.close()
            store.move(hidden, f"{base}/{now}.pptx")

        for batch in iterator:
            columns = [batch.column(batch.schema.get_field_index(n)) for n in ("deck_id", "part", "content")]
            for deck, part, content in zip(*columns):
                if deck.as_py() != now:
                    if package:
                        close()
                    now, files = deck.as_py(), files + 1
                    hidden, stream = self.start(store, f"{base}/{now}.pptx")
                    package = zipfile.ZipFile(stream, "w", zipfile.ZIP_DEFLATED)
                package.writestr(part.as_py(), content.as_py() or b"")
        if package:
            close()
        return Written(files)


class JoinedWriter(_FileWriter):
    """A file for the rows ``(name, content)`` that follow each other with one name: their contents with ``between``, ``head`` and ``tail``."""

    def __init__(self, options: dict[str, str]):
        super().__init__(options)
        self.head, self.between, self.tail = (options[k].encode() for k in ("head", "between", "tail"))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, base = opened(self.path)
        now, files = None, 0

        def close() -> None:
            stream.write(self.tail)
            stream.close()
            store.move(hidden, place)

        for batch in iterator:
            for name, content in zip(*(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("name", "content"))):
                if name != now:
                    if now is not None:
                        close()
                    now, place, files = name, inside(base, name), files + 1
                    hidden, stream = self.start(store, place)
                    stream.write(self.head)
                else:
                    stream.write(self.between)
                stream.write(content or b"")
        if now is not None:
            close()
        return Written(files)


def inside(base: str, name: str) -> str:
    """The place of a name in a folder; names that lead out of it are errors."""
    place = posixpath.normpath(f"{base}/{name}")
    if not place.startswith(base.rstrip("/") + "/"):
        raise ValueError(f"{name} is not in the folder")
    return place


class FilesWriter(_FileWriter):
    """A file for each row ``(name, content)``; a name may hold folders."""

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, base = opened(self.path)
        files = 0
        for batch in iterator:
            for name, content in zip(*(batch.column(batch.schema.get_field_index(n)) for n in ("name", "content"))):
                place = inside(base, name.as_py())
                hidden, stream = self.start(store, place)
                stream.write(content.as_py() or b"")
                stream.close()
                store.move(hidden, place)
                files += 1
        return Written(files)


class Decks(DataSource):
    """Zipped decks. Options: path; contents (false: names and sizes only); bundleBytes (of archives that one task reads)."""

    @classmethod
    def name(cls) -> str:
        return "slatework_decks"

    def schema(self) -> str:
        return PARTS

    def reader(self, schema) -> DeckReader:
        return DeckReader(self.options)

    def writer(self, schema, overwrite: bool) -> DeckWriter:
        return DeckWriter(self.options)


class Files(DataSource):
    """Rows ``(name, content)`` as files under a path."""

    @classmethod
    def name(cls) -> str:
        return "slatework_files"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema, overwrite: bool) -> _FileWriter:
        return JoinedWriter(self.options) if "between" in self.options else FilesWriter(self.options)


def read_packages(spark: SparkSession, path: str, contents: bool = True) -> DataFrame:
    """``(deck_id, part, extension, size, content)`` of every part of the .pptx files under ``path``; deck_id is the file's name.

    Filters on deck_id, part and extension are handed down to the archives' directories. A file that is no zip gives no
    parts; a part that cannot be unpacked has a null content, and so has every part if ``contents`` is false.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Decks)
    return spark.read.format("slatework_decks").option("contents", str(contents).lower()).load(path)


def write_packages(parts: DataFrame, path: str, dealt: bool = False) -> None:
    """One archive for each deck of ``parts(deck_id, part, content)``; tasks stream their decks part by part.

    With ``dealt`` the parts of a deck already follow each other in one task, and are not shuffled again.
    """
    parts.sparkSession.dataSource.register(Decks)
    rows = parts.where("deck_id is not null and part is not null").select("deck_id", "part", "content")
    rows = rows if dealt else rows.repartition("deck_id").sortWithinPartitions("deck_id", "part")
    rows.write.format("slatework_decks").mode("append").save(path)


def write_files(rows: DataFrame, path: str) -> None:
    """A file for each row of ``rows(name, content)``; of rows with the same name one stays."""
    rows.sparkSession.dataSource.register(Files)
    rows.select("name", "content").write.format("slatework_files").mode("append").save(path)


def write_joined(rows: DataFrame, path: str, *order: str, head: str, between: str, tail: str) -> None:
    """A file for each name of ``rows(name, content)``: its contents in order, one after the other."""
    rows.sparkSession.dataSource.register(Files)
    dealt = rows.repartition("name").sortWithinPartitions("name", *order).select("name", "content")
    dealt.write.format("slatework_files").options(head=head, between=between, tail=tail).mode("append").save(path)


def write_media(parts: DataFrame, path: str) -> None:
    """The media and embedded files of decks, each under its deck's folder."""
    media = parts.where(F.col("part").startswith("ppt/media/") | F.col("part").startswith("ppt/embeddings/"))
    write_files(media.select(F.concat_ws("/", "deck_id", F.regexp_replace("part", "^ppt/", "")).alias("name"), "content"), path)


#: Tasks that list or delete folders.
LISTERS = 16


def _inside(store: pyarrow.fs.FileSystem, folder: str) -> Iterator[tuple[str, int, bool]]:
    """Path, size, and whether it is a folder, of what is in a folder; names that begin with . or _ are left out, as Spark does."""
    if isinstance(store, pyarrow.fs.LocalFileSystem):  # one after the other, however many there are
        with os.scandir(folder) as found:
            for f in found:
                if f.name[0] not in "._":
                    yield f.path, 0 if f.is_dir() else f.stat().st_size, f.is_dir()
    else:
        for f in store.get_file_info(pyarrow.fs.FileSelector(folder)):
            if posixpath.basename(f.path)[0] not in "._":
                yield f.path, f.size or 0, f.type == pyarrow.fs.FileType.Directory


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """``(path, length)`` of the files under ``path``, in all its folders.

    Tasks list them, a folder each and level by level, so that the driver holds none of their names.
    """
    address = path

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = opened(address)
        held: list[tuple] = []
        out = lambda: pa.record_batch([pa.array(c, k) for c, k in zip(zip(*held), (pa.string(), pa.int64(), pa.bool_()))], names=["path", "length", "folder"])
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                for row in _inside(store, folder):
                    held.append(row)
                    if len(held) >= 8192:
                        yield out()
                        held = []
        if held:
            yield out()

    folders = spark.createDataFrame([(opened(path)[1],)], "path string")
    levels = []
    while not levels or not folders.isEmpty():
        levels.append(stored(folders.select("path").repartition(LISTERS, "path").mapInArrow(run, "path string, length bigint, folder boolean")))
        folders = levels[-1].where("folder")
    return reduce(DataFrame.unionByName, levels).where("not folder").select("path", "length")


def with_contents(files: DataFrame, path: str) -> DataFrame:
    """``files(path, length)`` with ``content``; ``path`` is an address in their store."""
    address = path

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = opened(address)
        for batch in batches:
            rows, held = [], 0
            for file, length in zip(*(c.to_pylist() for c in batch.columns)):
                with store.open_input_file(file) as f:
                    rows.append((file, length, f.read()))
                held += length + 200
                if held >= BATCH_BYTES:
                    yield out(rows)
                    rows, held = [], 0
            if rows:
                yield out(rows)

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), (pa.string(), pa.int64(), pa.binary()))], names=["path", "length", "content"])

    return files.select("path", "length").mapInArrow(run, "path string, length bigint, content binary")


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder; tasks delete what is in it."""
    address = path
    store, base = opened(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = opened(address)
        for batch in batches:
            for place in batch.column(0).to_pylist():
                kind = store.get_file_info(place).type
                if kind == pyarrow.fs.FileType.Directory:
                    store.delete_dir(place)
                elif kind == pyarrow.fs.FileType.File:
                    store.delete_file(place)
            yield batch

    def below(folder: str, deep: int) -> list[tuple[str]]:
        found = store.get_file_info(pyarrow.fs.FileSelector(folder, allow_not_found=True))
        return [x for f in found for x in (below(f.path, deep - 1) if deep and f.type == pyarrow.fs.FileType.Directory else [(f.path,)])]

    if inside := below(base, 1):
        spark.createDataFrame(inside, "path string").repartition(LISTERS, "path").mapInArrow(run, "path string").count()
        store.delete_dir(base)


def in_rounds(spark: SparkSession, rounds: int, run: Callable[[int, str], DataFrame]) -> DataFrame:
    """The rows of ``run(i, folder)`` for every round ``i``, stored together.

    A round writes its files to a folder of its own, which is deleted when its rows are stored: so there are never more
    files than one round has, and none are left.
    """
    kept = shared_folder(spark)
    for i in range(rounds):
        folder = shared_folder(spark)
        try:
            rows = run(i, folder)
            rows.write.mode("append").parquet(kept)
        finally:
            remove(spark, folder)
    return spark.read.schema(rows.schema).parquet(kept)


def listed_images(spark: SparkSession, path: str) -> DataFrame:
    """``(folder, page, file, bytes)`` of the pictures under ``path`` whose name begins with a slide's number.

    Contents are not read; files without any are left out.
    """
    named = list_files(spark, path).select(F.element_at(F.split("path", "/"), -2).alias("folder"), F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"))
    page = F.regexp_extract("file", r"^slide_(\d+)_", 1)
    return named.where(page != "").select("folder", page.cast("bigint").alias("page"), "file", "bytes")
