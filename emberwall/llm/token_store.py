"""Token ids in Parquet: sorted list columns, dictionary or delta encoded, with small row groups and page indexes."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import encoding
from .common import in_arrow, only, text_views

SCHEMA = "doc_id long, part int, part_start long, n_tokens int, ids array<int>"

#: Row groups of 32 MB and pages of 256 KB, so that a reader of few documents reads few pages;
#: format version 2 falls back from dictionary to delta encoding. Column indexes are written by default.
LAYOUT = {
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "2000",
    "parquet.enable.dictionary": "true",
    "parquet.dictionary.page.size": str(1 << 20),
    "parquet.writer.version": "PARQUET_2_0",
    "compression": "zstd",
}


def _writer(path: str, end_id: int):
    end = end_id.to_bytes(4, "little")

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        encoder, part, start = encoding.shared(encoding.WordEncoder, path), TaskContext.get().partitionId(), 0
        for b in batches:
            # No more than 2**22 ids or so in a batch of output, whatever the texts' lengths.
            rows, held, size = 0, [], 0
            ids = b.column("doc_id")

            def out():
                nonlocal start
                n = np.array([len(x) // 4 for x in held], np.int64)
                ends = np.concatenate(([0], np.cumsum(n)))
                flat = pa.array(np.frombuffer(b"".join(held), "<i4"), pa.int32())
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)
                cols = [ids.slice(rows - len(held), len(held)), pa.array(np.full(len(held), part, np.int32)), pa.array(start + ends[:-1]), pa.array(n, pa.int32()), lists]
                start += int(ends[-1])
                return pa.RecordBatch.from_arrays(cols, ["doc_id", "part", "part_start", "n_tokens", "ids"])

            for e in encoder.encode(text_views(b.column("text"))):
                held.append(e + end)
                rows, size = rows + 1, size + len(e)
                if size >= 1 << 24:
                    yield out()
                    held, size = [], 0
            if held:
                yield out()

    return run


def write_token_ids(docs: DataFrame, tokenizer: str, path: str, *, end_id: int) -> None:
    """Writes one row per document, in ascending doc_id over the files in name order.

    Texts (not the larger ids) move once, into ranges of doc_id; equal ids are ordered by text.
    Each row holds its range's number and the ids before it there. Null texts are empty, null ids
    come first, an empty table writes no rows.
    """
    body = only(docs, "doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    ranged = body.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    ranged.transform(in_arrow, _writer(tokenizer, end_id), SCHEMA).write.options(**LAYOUT).parquet(path)


def read_starts(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens) from the metadata columns alone; no ids are read."""
    rows = spark.read.schema(SCHEMA).parquet(path)
    return _placed(rows).select("doc_id", "start", "n_tokens")


def _placed(rows: DataFrame) -> DataFrame:
    """Adds start: ids in earlier parts (one row for each writing task, so few) and in this one."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("part").agg(F.sum(F.col("n_tokens").cast("long")).alias("n"))
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long").alias("part_before"))
    return rows.join(F.broadcast(parts), "part").withColumn("start", F.col("part_before") + F.col("part_start"))


def _digests(batches):
    import numpy as np
    import pyarrow as pa

    for b in batches:
        lists = b.column("ids")
        at = lists.offsets.to_numpy()
        flat = lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
        crc = [zlib.crc32(flat[x:y].tobytes()) for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        n = pa.array(np.diff(at).astype(np.int64))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("start"), n, pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the ids as the files hold them."""
    rows = _placed(spark.read.schema(SCHEMA).parquet(path)).select("doc_id", "start", "ids")
    return rows.transform(in_arrow, _digests, "doc_id long, start long, n_tokens long, ids_crc32 long")
