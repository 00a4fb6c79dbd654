"""Shared plumbing of the corpus operators: scratch tables, bounded broadcasts, Arrow helpers."""

from __future__ import annotations

import contextlib
import functools
import os
import tempfile
import uuid
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: ASCII white space that separates words in every contract: space and U+0009 to U+000D.
WORD_GAP = "[\\x20\\x09-\\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder, read by Spark alone so that any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir.

    Where that is unset a temporary folder is made and set if all runs on this machine, as in tests; on a cluster it is an error.
    """
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="emberwall-")
        sc.setCheckpointDir(root)
    return root.rstrip("/")


class Scratch:
    """Tables in the shared folder that cut lineage: executors may be lost, these stay."""

    def __init__(self, spark: SparkSession, label: str) -> None:
        self.spark, self.root = spark, f"{scratch_root(spark)}/emberwall-{label}-{uuid.uuid4().hex[:12]}"
        _roots.append(self.root)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str, **options) -> DataFrame:
        df.write.mode("overwrite").options(**{"compression": "zstd", **options}).parquet(self.path(name))
        return self.read(name, df.schema)

    def read(self, name: str, schema=None) -> DataFrame:
        reader = self.spark.read
        return (reader.schema(schema) if schema is not None else reader).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Deletes tables that no later step reads."""
        for name in names:
            delete(self.spark, self.path(name))

    def result(self, df: DataFrame) -> DataFrame:
        """df written as the table that stays; every other table is deleted."""
        out = self.write(df, "result")
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        for status in path.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(path):
            if status.getPath().getName() != "result":
                self.drop(status.getPath().getName())
        return out


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


#: Folders that Scratch objects of this process use, the oldest first.
_roots: list[str] = []


@contextlib.contextmanager
def swept(spark: SparkSession):
    """Deletes, after a with-block, all scratch tables that were begun in it: for results that have been written elsewhere."""
    before = len(_roots)
    try:
        yield
    finally:
        while len(_roots) > before:
            delete(spark, _roots.pop())


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """Marks df for broadcast if it has at most max_rows rows; else it is joined by shuffle.

    The count stops at max_rows + 1 rows.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


#: Rows of one key up to which join_counted leaves them to one task, and most keys that it broadcasts.
FEW_ROWS, MOST_KEYS = 1_000, 100_000


def join_counted(df: DataFrame, dim: DataFrame, key: str) -> DataFrame:
    """df left-joined with dim(key, n, ...), a written table with a row for each key and n, the rows of df that have it.

    Keys with the most rows go by broadcast, so that none lands in one task: those with over FEW_ROWS rows and over a
    MOST_KEYS-th of all rows, hence fewer than MOST_KEYS keys. The rest are joined by shuffle. n is dropped.
    """
    most = max(FEW_ROWS, (dim.agg(F.sum("n")).first()[0] or 0) // MOST_KEYS)
    often = dim.where(F.col("n") > most)
    if often.isEmpty():
        return df.join(dim, key, "left").drop("n")
    rest = df.join(F.broadcast(often.select(key)), key, "left_anti").join(dim.where(F.col("n") <= most), key, "left")
    return df.join(F.broadcast(often), key).unionByName(rest).drop("n")


def text_views(column) -> list[memoryview]:
    """UTF-8 bytes of each value of an Arrow string column, without copies; null is empty."""
    import pyarrow as pa

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = memoryview(data) if data is not None else memoryview(b"")
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    return [whole[a:b] if v else whole[:0] for a, b, v in zip(at[:-1].tolist(), at[1:].tolist(), valid.tolist(), strict=True)]


def give_back() -> None:
    """Returns freed memory to the system: workers are kept from task to task, and so is what their allocators hold."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def giving_back(run):
    """A function of batches that ends each task with give_back()."""

    @functools.wraps(run)
    def wrapped(batches):
        yield from run(batches)
        give_back()

    return wrapped


#: Most bytes of an Arrow batch, where the session holds Spark's own limit: operators work through smaller groups anyway.
BATCH_BYTES, SPARKS_BYTES = 4 << 20, "67108864b"


def in_arrow(df: DataFrame, run, schema: str) -> DataFrame:
    """df through mapInArrow with run, in batches of few bytes, so that neither Java nor Python holds many long texts at once."""
    conf, limit = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(limit) == SPARKS_BYTES:
        conf.set(limit, BATCH_BYTES)
    return df.mapInArrow(giving_back(run), schema)


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns, whatever else the table holds; a name in another case is another column."""
    return df.toDF(*[f"c{k}" for k in range(len(df.columns))]).select(*[F.col(f"c{df.columns.index(n)}").alias(n) for n in names])


def sheltered(df: DataFrame, own: Sequence[str], stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """stage(df), with columns other than own under names that no operator uses; all have their names back in the result."""
    aside = [c if c in own else f"__kept_{k}" for k, c in enumerate(df.columns)]
    return stage(df.toDF(*aside)).select(*aside).toDF(*df.columns)
