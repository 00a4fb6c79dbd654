"""Sinks: JSON and CSV of a view."""

from __future__ import annotations

import csv
import io
import json
import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from itertools import chain

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..errors import ExportError
from ..schema import EXPORTED

#: Bytes that the driver holds while it copies lines to one file.
COPY_BYTES = 1 << 16


def exported(rows: DataFrame) -> DataFrame:
    """The parsed and meta fields of a view; the label too where it was joined."""
    names = [n for n in EXPORTED if n in rows.columns]
    if "rule_label" in rows.columns:
        return rows.select(*[f"`{n}`" for n in names], F.col("rule_label").alias("__rule_label__"))
    return rows.select(*[f"`{n}`" for n in names])


def write_json(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A folder of JSON lines; fields that a row does not have are left out."""
    exported(rows).write.mode(mode).json(path)


def write_csv(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A folder of CSV files with the whole field list as header; absent fields are empty."""
    filled = exported(rows).fillna("")
    filled.write.mode(mode).option("header", True).option("emptyValue", "").option("nullValue", "").option("escape", '"').csv(path)


def write_single(rows: DataFrame, path: str) -> int:
    """One local file in the form of its extension; returns the number of rows.

    .json is one array of objects, one to a line, .csv a table. Another extension is an error, as is a view without rows.
    Executors write the lines to the shared folder, compressed, and the driver copies them in order, a block at a time.
    Where a cluster has no shared folder, the driver takes them a partition at a time.
    """
    kind = os.path.splitext(path)[1].lower()
    if kind not in (".json", ".csv"):
        raise ExportError(f"neither .json nor .csv: {path}", path=path)
    out = exported(rows)
    head, line, end = _table(out) if kind == ".csv" else ("[\n", F.concat(F.lit("  "), F.to_json(F.struct("*"), {"ignoreNullFields": "true"})), ",\n")
    lines, folder = out.select(line.alias("value")), scratch(rows.sparkSession, "single")
    n = _gathered(lines, path, head, end, folder) if folder else _iterated(lines, path, head, end)
    if not n:
        raise ExportError("nothing to export", path=path)
    if kind == ".json":  # the last object has no comma
        with open(path, "r+b") as f:
            f.seek(-len(end), os.SEEK_END)
            f.truncate()
            f.write(b"\n]\n")
    return n


def saved_rows(path: str) -> Iterator[dict]:
    """The rows of a .json file that write_single made, read one by one."""
    with open(path, encoding="utf-8") as f:
        for line in f:
            text = line.strip().removesuffix(",")
            if text not in ("[", "]"):
                yield json.loads(text)


def scratch(spark: SparkSession, name: str) -> str | None:
    """The path of a new folder that the driver and all executors share: in the one that the cluster names, or a temporary
    one where all runs on this machine. None on a cluster that names none."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            return None
        root = "file://" + os.path.realpath(tempfile.gettempdir())
    return f"{root.rstrip('/')}/emberwall-{name}-{uuid.uuid4().hex[:12]}"


def _table(out: DataFrame) -> tuple[str, Column, str]:
    """Header, line and line end of a table as Python's csv.writer makes it."""
    header = io.StringIO()
    csv.writer(header).writerow(out.columns)
    quoted = '[",\r\n]' + "|^$" * (len(out.columns) == 1)
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    cell = lambda c: F.when(c.rlike(quoted), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)
    return header.getvalue(), F.concat_ws(",", *[cell(text(F.col(f"`{c}`"))) for c in out.columns]), "\r\n"


def _gathered(lines: DataFrame, path: str, head: str, end: str, folder: str) -> int:
    spark, seen = lines.sparkSession, Observation()
    hadoop, conf = spark._jvm.org.apache.hadoop, spark._jsc.hadoopConfiguration()
    root = hadoop.fs.Path(folder)
    fs, codecs = root.getFileSystem(conf), hadoop.io.compress.CompressionCodecFactory(conf)
    try:
        lines.observe(seen, F.count(F.lit(1)).alias("n")).write.option("lineSep", end).option("compression", "gzip").text(folder)
        n = seen.get["n"]
        if not n:
            return 0
        with open(path, "wb") as f:
            f.write(head.encode())
        to = spark._jvm.java.io.FileOutputStream(os.path.realpath(path), True)  # Python and its JVM may be in different folders
        try:
            parts = [(m, s.getPath()) for s in fs.listStatus(root) if (m := re.match(r"part-(\d+).*?(?:-c(\d+))?\.", s.getPath().getName()))]
            for _, part in sorted(parts, key=lambda x: [int(k or 0) for k in x[0].groups()]):
                stream = codecs.getCodec(part).createInputStream(fs.open(part))
                try:
                    hadoop.io.IOUtils.copyBytes(stream, to, COPY_BYTES, False)
                finally:
                    stream.close()
        finally:
            to.close()
        return n
    finally:
        fs.delete(root, True)


def _iterated(lines: DataFrame, path: str, head: str, end: str) -> int:
    it, n = lines.toLocalIterator(prefetchPartitions=True), 0
    first = next(it, None)
    if first is None:
        return 0
    with open(path, "w", encoding="utf-8", newline="") as f:
        f.write(head)
        for n, row in enumerate(chain([first], it), 1):
            f.write(row["value"] + end)
    return n


def json_array(rows: DataFrame) -> DataFrame:
    """A small view as one JSON array string."""
    return exported(rows).agg(F.to_json(F.collect_list(F.struct("*"))).alias("json"))


def write_parquet(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """The whole row schema in columns, by day, so that later filters prune files and row groups."""
    rows.withColumn("day", F.to_date("ts_effective")).write.mode(mode).partitionBy("day").parquet(path)
