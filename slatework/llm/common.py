"""Helpers that the training-data operators share: shared storage, packing of arrays, components."""

from __future__ import annotations

import pickle
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_DIRS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all machines share: ``spark.checkpoint.dir``; where that is unset, a temporary one of a local session."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    app = spark.sparkContext.applicationId
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
    if app not in _OWN_DIRS:
        _OWN_DIRS[app] = "file://" + tempfile.mkdtemp(prefix="spark-slatework-")
    return _OWN_DIRS[app]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back; cuts the lineage, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/slatework/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` wrote and nothing reads any more; others are left alone."""
    for df in tables:
        spark = df.sparkSession
        own = f"{shared_dir(spark)}/slatework/".replace("file:///", "file:/")
        for folder in {name.rpartition("/")[0] for name in df.inputFiles()}:
            if folder.replace("file:///", "file:/").startswith(own):
                path = spark._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def pack(value: object, level: int = 3) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(pickle.dumps(value, protocol=5))


def unpack(blob: bytes) -> object:
    return pickle.loads(zstandard.ZstdDecompressor().decompress(blob))


def bounded_batches(spark: SparkSession, limit: int = 8 << 20) -> None:
    """Let batches of whole texts between Spark and Python hold ``limit`` bytes at most, if the session allows more."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key).rstrip("b")
    if not now.isdigit() or int(now) > limit:
        spark.conf.set(key, f"{limit}b")


def squeeze(values: np.ndarray) -> bytes:
    """Sorted unsigned 64-bit integers as differences, byte plane by byte plane; high planes of zeros vanish."""
    steps = np.diff(values, prepend=np.uint64(0))
    planes = steps.view(np.uint8).reshape(-1, 8).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unsqueeze(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), dtype=np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def chunks(batches: Iterator[pa.RecordBatch], column: int, limit: int) -> Iterator[tuple[int, pa.Table]]:
    """A task's rows in tables of about ``limit`` bytes of text, with numbers that the same input gives again."""
    part, number, held, size = TaskContext.get().partitionId(), 0, [], 0
    for batch in batches:
        begin = 0
        # chunks end after a row, wherever batches end: those depend on the columns that are read
        for row, n in enumerate(pa.compute.binary_length(batch.column(column).cast(pa.binary())).fill_null(0).to_pylist()):
            size += n
            if size >= limit:
                held.append(batch.slice(begin, row + 1 - begin))
                yield part << 32 | number, pa.Table.from_batches(held)
                number, held, size, begin = number + 1, [], 0, row + 1
        if begin < batch.num_rows:
            held.append(batch.slice(begin))
    if held:
        yield part << 32 | number, pa.Table.from_batches(held)


def signature(texts: list[bytes | None]) -> int:
    """Tells two chunks of texts apart."""
    digest = xxhash.xxh64()
    for t in texts:
        digest.update(t or b"")
        digest.update(b"\xff")
    return digest.intdigest()


def bundle(table: pa.Table) -> bytes:
    """A table of whole rows as one compressed value."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return zstandard.ZstdCompressor(level=3).compress(sink.getvalue())


def unbundle(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(blob)).read_all()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Edges that one task contracts by itself.
TASK_EDGES = 1_000_000


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's edges as stars: every node with the smallest one that these edges connect it to."""
    parent: dict[int, int] = {}

    def find(n: int) -> int:
        root = n
        while (up := parent.setdefault(root, root)) != root:
            root = up
        while parent[n] != root:
            parent[n], n = root, parent[n]
        return root

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            u, v = find(u), find(v)
            parent[max(u, v)] = min(u, v)
    stars = [(find(n), n) for n in parent if find(n) != n]
    yield pa.record_batch([pa.array([s[i] for s in stars], pa.int64()) for i in (0, 1)], names=["u", "v"])


def contracted(edges: DataFrame) -> DataFrame:
    """Fewer edges ``(u, v)``, u < v, that connect the same nodes; tasks contract up to TASK_EDGES of them each."""
    tasks = max(1, -(-edges.count() // TASK_EDGES))
    return materialize(edges.select("u", "v").coalesce(tasks).mapInArrow(_contract, "u bigint, v bigint"), "edges")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(u, v)`` as ``(node, root)``, root the smallest node.

    Tasks contract their edges to stars; where stars of different tasks share nodes, large-star and small-star steps
    follow, each a grouped minimum (combined before the shuffle) joined back to the edges, so that a node with very many
    neighbours is split like any skewed join key. Then tasks contract again, until every node has one root that has
    none. Loops (u = v) and repeated edges do no harm; an empty table gives an empty result.
    """
    given = materialize(edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u <> v"), "edges")
    edges = contracted(given)
    discard(given)
    for _ in range(max_rounds):
        twice = edges.groupBy("v").agg(F.count("*").alias("n")).where("n > 1")
        if twice.isEmpty() and edges.select("u").distinct().join(edges.select(F.col("v").alias("u")), "u", "left_semi").isEmpty():
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = materialize(both.join(low, "u").where("v > u").select(F.col("m").alias("u"), "v").where("u <> v").distinct(), "edges")
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(low, "v").select(F.col("m"), F.explode(F.array("u", "v")).alias("v"))
        stars = materialize(small.select(F.col("m").alias("u"), "v").where("u <> v").distinct(), "edges")
        discard(edges, large)
        edges = contracted(stars)
        discard(stars)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return edges.select(F.col("v").alias("node"), F.col("u").alias("root")).unionByName(edges.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())
