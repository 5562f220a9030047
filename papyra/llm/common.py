"""What the operators share: tables in the shared folder, and connected components."""

from __future__ import annotations

import ctypes
import functools
import gc
import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where spark.checkpoint.dir is unset and Spark runs in one process (tests).
LOCAL_SHARED = "file:///tmp/checkpoints/papyra"
#: Bytes of an Arrow batch on its way to or from a Python worker; a longer row is a batch of its own.
BATCH_BYTES = 4 << 20
#: A key with more than one in HEAVY of all rows is joined by itself; so there are at most HEAVY of these.
HEAVY = 500
#: Ids that are broadcast to choose rows by (8 bytes each, about 32 in a task's table).
BROADCAST_IDS = 500_000
#: Links between documents that one task finishes; see connected_components().
ONE_TASK = 20_000
#: ASCII white space: the complement of [^\x20\x09-\x0D].
SPACE = " \t\n\x0b\x0c\r"
WORD = "[^\\x20\\x09-\\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors and the driver see."""
    conf = spark.sparkContext.getConf()
    if not (shared := conf.get("spark.checkpoint.dir")):
        if not re.match(r"local(\[|$)", conf.get("spark.master", "")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        shared = LOCAL_SHARED
    return shared


def small_batches(spark: SparkSession) -> None:
    """Arrow batches bounded by bytes: texts may be long, and a batch is held several times over
    on both sides of a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def _path(spark: SparkSession, path: str):
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jpath


def save(df: DataFrame, name: str, sweep: bool = True) -> DataFrame:
    """Write df in the shared folder and return it as read again; this cuts the lineage, so a lost
    executor costs a re-read of files and not a recomputation. The files go when the session ends, or by
    drop(). sweep: also let go of the shuffle files of what is now written."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/papyra-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    fs, jpath = _path(spark, path)
    fs.deleteOnExit(jpath)
    # shuffle files go only when the driver's garbage is collected; at this point they are the larger
    # part of the disk in use
    if sweep:
        gc.collect()
        spark.sparkContext._jvm.System.gc()
    out = spark.read.schema(df.schema).parquet(path)
    out._papyra_path = path
    return out


def trimmed(kernel: Callable) -> Callable:
    """An Arrow kernel that gives freed memory back to the system at its end: Python workers live on
    between stages, and what their allocators hold counts against the executor."""

    @functools.wraps(kernel)
    def run(batches, **options):
        yield from kernel(batches, **options)
        gc.collect()
        pa.default_memory_pool().release_unused()
        libc = ctypes.CDLL(None)
        if hasattr(libc, "malloc_trim"):
            libc.malloc_trim(0)

    return run


def drop(df: DataFrame) -> None:
    """Delete the files of a table made by save() that nothing reads any more."""
    if path := getattr(df, "_papyra_path", None):
        fs, jpath = _path(df.sparkSession, path)
        fs.delete(jpath, True)


def join_by_key(rows: DataFrame, table: DataFrame, keys: list[str], weight: str, outer: bool = False, total: int | None = None) -> DataFrame:
    """rows joined with table, which has one row a key and in `weight` the number of rows it meets.
    The few keys that hold more than one in HEAVY of all rows are broadcast (at most HEAVY rows, so
    bounded), which leaves their rows where they are; the others are shuffled. table is read several
    times and should be saved. outer: rows without a partner stay, too."""
    total = (table.agg(F.sum(weight)).first()[0] or 0) if total is None else total
    hot = F.col(weight) > total / HEAVY
    heavy, light = table.where(hot).drop(weight), table.where(~hot).drop(weight)
    rest = rows.join(F.broadcast(heavy.select(*keys)), keys, "left_anti").join(light, keys, "left" if outer else "inner")
    return rows.join(F.broadcast(heavy), keys).unionByName(rest)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links to as few as keep the same components: (member, its component's least)."""
    names, pos = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = pos[: len(a)], pos[len(a) :]
    root = np.arange(len(names))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    out = np.flatnonzero(root != np.arange(len(names)))
    return names[out], names[root[out]]


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    t = pa.Table.from_batches(list(batches), pa.schema([("u", pa.int64()), ("v", pa.int64())]))
    node, root = forest(t.column(0).to_numpy(), t.column(1).to_numpy())
    yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(root, pa.int64())], ["node", "root"])


def keep_ids(rows: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """The rows whose id is in ids (a saved table, one row an id). Up to BROADCAST_IDS ids, counted first, are
    broadcast, so that wide rows stay where they are; more are joined by a shuffle."""
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return rows.join(ids, id_col, "left_semi")


def connected_components(edges: DataFrame, rounds: int = 60, one_task: int = ONE_TASK) -> DataFrame:
    """(a, b) links between long ids to (node, root): every node but the smallest of its component,
    with that smallest id. Alternating large-star and small-star steps: each is a minimum by node
    (combined map-side) and a join in which hubs are broadcast with their minimum, so that a hub's
    links are never gathered in one task. As soon as no more than one_task links are left (16 bytes each),
    a single task finishes them. Nulls link nothing."""
    e = save(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc", False
    )
    signature = None
    for _ in range(rounds):
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == signature or not now[0]:
            break
        if now[0] <= one_task:
            return save(e.repartition(1).mapInArrow(_forest, "node long, root long"), "cc", False)
        signature = tuple(now)
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = save(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n"), "cc-low", False)
        large = save(join_by_key(both, low, ["u"], "n", total=2 * now[0]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "cc-large", False)
        least = save(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "cc-least", False)
        small = join_by_key(large, least, ["u"], "n", total=now[0]).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = save(small.union(least.select("u", "m")).distinct(), "cc", False)
        for old in (e, low, large, least):
            drop(old)
        e = new
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
