"""Helpers shared by the corpus operators: table access, shared storage, graph components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from contextlib import contextmanager
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of an Arrow batch and bytes of a Parquet row group where tables are written; bytes that Python turns to objects at once.
BATCH_ROWS, GROUP_BYTES, SLICE_BYTES = 1000, 16 << 20, 4 << 20
#: Rows with one key from which the key is hot; at most so many keys can be.
HOT_ROWS, HOT_KEYS = 1000, 50_000
#: Links (16 bytes each) that one task may hold whole.
LOCAL_LINKS = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where none is configured a local master gets a temporary one (tests);
    on a cluster that would be a folder of one machine, so it is refused."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not configured:
        configured = spark.sparkContext.getCheckpointDir()
    if not configured:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = "file://" + tempfile.mkdtemp(prefix="fluxweave-")
        spark.sparkContext.setCheckpointDir(configured)
    elif not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(configured)
    return configured


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder, never used before."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


@contextmanager
def small_batches(spark: SparkSession):
    """Arrow batches of few rows while a plan runs, so that long texts don't add up; the setting is put back."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(BATCH_ROWS, int(before)) if int(before) > 0 else BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def staged(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once to the shared folder and read again, so that its lineage ends there."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    with small_batches(spark):
        df.write.option("compression", "zstd").option("parquet.block.size", GROUP_BYTES).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def filesystem(uri: str):
    """(pyarrow filesystem, path) for a URI of the shared folder; plain paths are local."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if urlparse(uri).scheme else (fs.LocalFileSystem(), uri)


def release() -> None:
    """Hand freed memory back at the end of a task: workers are kept for the next one, of whatever kind."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def slices(batches, limit: int = SLICE_BYTES):
    """The batches in parts of about ``limit`` bytes, empty ones skipped; memory is released at the end."""
    try:
        for batch in batches:
            if batch.num_rows:
                step = max(1, batch.num_rows * limit // max(1, batch.nbytes))
                for at in range(0, batch.num_rows, step):
                    yield batch.slice(at, step)
    finally:
        release()


def per_batch(df: DataFrame, convert, schema: str, done=None) -> DataFrame:
    """mapInArrow with ``convert(RecordBatch) -> dict of columns`` over slices of bounded size; ``done`` is called at a
    task's end."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches):
        try:
            for batch in slices(batches):
                out = convert(batch)
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow)
        finally:
            if done:
                done()

    return df.mapInArrow(run, schema)


def spread_join(rows: DataFrame, keyed: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with ``keyed``, which has one row a key and in ``count`` how many of the ``total`` rows have
    it. Keys of more than max(HOT_ROWS, total / HOT_KEYS) rows, of which there can be HOT_KEYS at most, are broadcast;
    the others are shuffled, so no task gets more than that of one key."""
    bar = max(HOT_ROWS, total // HOT_KEYS)
    hot = keyed.where(F.col(count) > bar).drop(count)
    cold = keyed.where(F.col(count) <= bar).drop(count)
    few = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key)
    return few.unionByName(rows.join(F.broadcast(hot), key))


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, root) of the components of links a-b; root is each component's smallest node."""
    nodes, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = inverse[: len(a)], inverse[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        before = root.copy()
        np.minimum.at(root, root[x], low)
        np.minimum.at(root, root[y], low)
        root = root[root]
        if np.array_equal(before, root):
            break
    while not np.array_equal(root, root[root]):
        root = root[root]
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


def components(links: DataFrame) -> DataFrame:
    """Connected components of links (a, b): rows (node, root), root the smallest node; nodes without links are absent.

    First each partition reduces its own links to a forest. Up to LOCAL_LINKS links, counted, are then reduced in one
    task. More take alternating large-star and small-star rounds until nothing changes: minima are partially aggregated
    and go back to their rows by ``spread_join``, so a node with very many links is dealt over all tasks, and lineage is
    cut by a written table each round. Both give the same rows.
    """

    def reduce(batches):
        parts = [b for b in batches if b.num_rows]
        if parts:
            t = pa.Table.from_batches(parts)
            node, root = forest(t.column("a").to_numpy(), t.column("b").to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(root, pa.int64())], names=["a", "b"])

    edges = staged(links.select("a", "b").where("a <> b").mapInArrow(reduce, "a long, b long").distinct(), "links")
    seen, total = None, edges.count()
    if total <= LOCAL_LINKS:
        return edges.coalesce(1).mapInArrow(reduce, "a long, b long").select(F.col("a").alias("node"), F.col("b").alias("root"))
    while True:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n"))
        large = spread_join(both, least, "a", "n", 2 * total).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small = spread_join(large, low, "a", "n", 2 * total).select("b", "m").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = staged(small.union(low.select("a", F.col("m").alias("b"))).distinct(), "links")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen, total = now, now[0]
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
