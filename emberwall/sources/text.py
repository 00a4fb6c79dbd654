"""Log files as lines: batch, capped, iterated, tailed."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..errors import SourceError
from ..operators.view import file_index, tail

LINES = "value string"
#: A cap up to which the driver reads the first lines itself; beyond, Spark reads the first files.
NEAR_LINES = 10_000
#: Bytes of the first read from an end of a file; later ones double.
STEP_BYTES = 1 << 16

_NEWLINE = re.compile(rb"\r\n|\r|\n")


def read_lines(spark: SparkSession, path: str | list[str], *, max_lines: int | None = None, numbered: bool = False) -> DataFrame:
    """(value, file, block[, row_idx]) of text files; lines end with \\n, \\r\\n or \\r.

    max_lines caps physical lines, before any is rejected, and stops reading early; None or 0 is no cap. A
    missing path raises SourceError. Files are split for parallel reading.
    """
    try:
        lines = spark.read.text(path)
    except AnalysisException as e:
        raise SourceError(f"cannot read {path}", path=path) from e
    lines = lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    if not max_lines:
        return file_index(lines) if numbered else lines
    if max_lines <= NEAR_LINES:
        return spark.createDataFrame(_head(spark, _files(lines), max_lines), "value string, file string, block long, row_idx long")
    return file_index(_leading_files(lines, max_lines)).where(F.col("row_idx") < max_lines)


def iterate(rows: DataFrame) -> Iterator[Row]:
    """Rows one by one; the driver holds a partition at a time."""
    return rows.toLocalIterator(prefetchPartitions=True)


def read_tail(spark: SparkSession, path: str | list[str], n: int) -> list[str]:
    """The last n whole lines, in order. Files are read backwards from the end of the last one; only
    compressed ones, which can't be, are scanned."""
    if n <= 0:
        return []
    lines = read_lines(spark, path)
    found: list[str] = []
    for file in reversed(_files(lines)):
        last = _last(spark, file, n - len(found))
        if last is None:
            scanned = file_index(lines.where(F.col("file") == file))
            last = [r["value"] for r in tail(scanned, n - len(found)).collect()]
        found = last + found
        if len(found) == n:
            break
    return found


def _files(lines: DataFrame) -> list[str]:
    """The files in the order and spelling of the column file."""
    return sorted(re.sub("^file:/+", "file:/", f) for f in lines.inputFiles())


def _leading_files(lines: DataFrame, n: int) -> DataFrame:
    """The lines of the first files that hold n lines together; a filter on file prunes the listing."""
    files, k = _files(lines), 1
    first = lambda k: lines.where(F.col("file") <= files[min(k, len(files)) - 1])
    while k < len(files) and first(k).limit(n).count() < n:
        k *= 2
    return first(k) if files else lines


def _head(spark: SparkSession, files: list[str], n: int) -> list[tuple[str, str, int, int]]:
    rows: list[tuple[str, str, int, int]] = []
    for file in files:
        for value in _first(spark, file, n - len(rows)):
            rows.append((value, file, 0, len(rows)))
        if len(rows) == n:
            break
    return rows


def _open(spark: SparkSession, file: str):
    """(stream, codec or None, length) by the cluster's own file systems."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(file))
    fs = path.getFileSystem(conf)
    return fs.open(path), jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(path), fs.getFileStatus(path).getLen()


def _texts(lines: list[bytes]) -> list[str]:
    return [line.decode("utf-8", "ignore") for line in lines]


def _first(spark: SparkSession, file: str, n: int) -> list[str]:
    """The first n lines of a file, read in growing steps."""
    stream, codec, _ = _open(spark, file)
    stream = codec.createInputStream(stream) if codec is not None else stream
    try:
        data, step, ended = b"", STEP_BYTES, False
        while True:
            more = bytes(stream.readNBytes(step))
            data, ended = data + more, len(more) < step
            lines = _NEWLINE.split(data.removeprefix(b"\xef\xbb\xbf"))
            if not ended or lines[-1] == b"":
                lines.pop()
            if ended or len(lines) >= n:
                return _texts(lines[:n])
            step *= 2
    finally:
        stream.close()


def _last(spark: SparkSession, file: str, n: int) -> list[str] | None:
    """The last n lines of a file, read in growing steps from its end; None for a compressed one."""
    stream, codec, size = _open(spark, file)
    try:
        if codec is not None:
            return None
        step = STEP_BYTES
        while True:
            start = max(0, size - step)
            stream.seek(start)
            data = bytes(stream.readNBytes(size - start))
            lines = _NEWLINE.split(data if start else data.removeprefix(b"\xef\xbb\xbf"))
            if lines[-1] == b"":
                lines.pop()
            if start == 0:
                return _texts(lines[-n:])
            if len(lines) > n:  # the first may be a line's end only
                return _texts(lines[-n:])
            step *= 2
    finally:
        stream.close()
