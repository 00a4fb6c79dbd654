"""Sharding along a Hilbert curve over metadata, for file pruning on several dimensions at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, only

#: Bits for each dimension: the curve has 2 ** (BITS * dimensions) cells.
BITS = 3
SHARDS = 8


def hilbert_index(point: tuple[int, ...], bits: int) -> int:
    """Place of a cell on the Hilbert curve (Skilling's transform, "Programming the Hilbert curve", 2004)."""
    x, n = list(point), len(point)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(n):
            if x[i] & q:
                x[0] ^= low
            else:
                swap = (x[0] ^ x[i]) & low
                x[0] ^= swap
                x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn, q = 0, 1 << (bits - 1)
    while q > 1:
        if x[n - 1] & q:
            turn ^= q - 1
        q >>= 1
    x = [v ^ turn for v in x]
    out = 0
    for b in range(bits - 1, -1, -1):
        for v in x:
            out = out << 1 | v >> b & 1
    return out


def hilbert_table(dimensions: int, bits: int) -> list[int]:
    """The curve's index of each cell, cells numbered with the first dimension as the highest bits."""
    cells = 1 << (bits * dimensions)
    low = (1 << bits) - 1
    return [hilbert_index(tuple(c >> (bits * (dimensions - 1 - d)) & low for d in range(dimensions)), bits) for c in range(cells)]


def numeric_cuts(df: DataFrame, dimensions: dict[str, Column], bits: int) -> dict[str, list]:
    """The 2**bits - 1 approximate quantiles of each numeric dimension, in one small aggregation."""
    at = [k / (1 << bits) for k in range(1, 1 << bits)]
    found = df.agg(*[F.percentile_approx(c, F.array(*map(F.lit, at)), F.lit(1000)).alias(n) for n, c in dimensions.items()]).first()
    return {n: list(found[n] or []) for n in dimensions}


def text_cuts(df: DataFrame, names: list[str], bits: int, scratch: Scratch) -> dict[str, list]:
    """The 2**bits - 1 exact quantiles of each string column (null: empty) over all rows, whole values compared.

    Distinct values are counted where they are, then sorted in ranges and their counts added up: within a range, and
    over the ranges before, which are as few as the tasks. Only the bounds come to the driver.
    """
    value = lambda n: F.struct(F.lit(n).alias("dim"), F.coalesce(F.col(n).cast("string"), F.lit("")).alias("value"))
    counted = df.select(F.inline(F.array(*[value(n) for n in names]))).groupBy("dim", "value").agg(F.count(F.lit(1)).alias("n"))
    ordered = counted.repartitionByRange("dim", "value").sortWithinPartitions("dim", "value").withColumn("id", F.monotonically_increasing_id())
    ordered = scratch.write(ordered.select("dim", "value", "n", "id", F.shiftright("id", 33).alias("range")), "values")
    earlier = Window.partitionBy("dim").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ordered.groupBy("dim", "range").agg(F.sum("n").alias("n"))
    ranges = ranges.select("dim", "range", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy("dim")).alias("all"))
    inner = F.sum("n").over(Window.partitionBy("dim", "range").orderBy("id").rowsBetween(Window.unboundedPreceding, 0))
    summed = ordered.withColumn("inner", inner).join(F.broadcast(ranges), ["dim", "range"])  # a row for each range
    # Quantile k is the least value that k / cells of all rows do not exceed.
    cells = 1 << bits
    first, last = F.expr(f"((before + inner - n) * {cells}) div `all` + 1"), F.expr(f"least(((before + inner) * {cells}) div `all`, {cells - 1})")
    bounds = summed.select("dim", "value", first.alias("first"), last.alias("last"))
    rows = bounds.where("first <= last").select("dim", "value", F.explode(F.sequence("first", "last")).alias("k")).collect()  # 2**bits - 1 for each column
    found = {n: {} for n in names}
    for r in rows:
        found[r["dim"]][r["k"]] = r["value"]
    scratch.drop("values")
    return {n: [found[n][k] for k in sorted(found[n])] for n in names}


def bucket(value: Column, cuts: list) -> Column:
    """How many cuts a value lies beyond: a value that fills several quantiles steps over as many, so few values still spread over all bits."""
    return sum(((value > b).cast("int") for b in cuts), F.lit(0))


def hilbert_shards(docs: DataFrame, *, shards: int = SHARDS, bits: int = BITS) -> DataFrame:
    """Deals docs(doc_id, text, lang, source, n_chars) into shards, runs of the Hilbert order.

    Dimensions: lang, source, n_chars and doc_id, each quantised by quantiles of its whole values. Rows are
    ordered by curve index, then lang, source, doc_id and the text's hash, numbered, and cut into
    runs whose counts differ by one at most (law "rows"). Returns doc_id, size (UTF-8
    bytes of the text and 1; null: 1), text_crc32, law, shard, slot (from 0 in its shard), grown_shard
    (null under this law), curve.

    Texts are read once and not moved: their size and checksum go into the narrow table that is
    sorted by range. Numbering needs the count of each range only. Any column may be null (its lowest
    bucket); repeated rows are numbered each; an empty table gives no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "shards")
    names = ["doc_id", "lang", "source", "n_chars"]
    narrow = only(docs, "text", *names).select(
        *names,
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.encode(F.coalesce("text", F.lit("")), "utf-8")).alias("text_crc32"),
        F.xxhash64("text").alias("text_hash"),
    )
    numbers = {n: F.coalesce(F.col(n).cast("long"), F.lit(0)) for n in ("n_chars", "doc_id")}
    texts = {n: F.coalesce(F.col(n).cast("string"), F.lit("")) for n in ("lang", "source")}
    cuts = text_cuts(only(docs, *names), [*texts], bits, scratch) | numeric_cuts(only(docs, *names), numbers, bits)
    dims = texts | numbers
    cell = sum((bucket(c, cuts[n]) * (1 << (bits * (len(dims) - 1 - k))) for k, (n, c) in enumerate(dims.items())), F.lit(0))
    curve = F.get(F.split(F.lit(",".join(map(str, hilbert_table(len(dims), bits)))), ",").cast("array<int>"), cell)
    keys = ["curve", "lang", "source", "doc_id", "text_hash"]
    ordered = narrow.withColumn("curve", curve).repartitionByRange(*keys).sortWithinPartitions(*keys)
    # The upper bits of the id are the range's number, the lower ones the row's in the range.
    placed = ordered.withColumn("place", F.monotonically_increasing_id())
    rows = scratch.write(placed.select("doc_id", "size", "text_crc32", "curve", F.shiftright("place", 33).alias("range"), F.col("place").bitwiseAND((1 << 33) - 1).alias("inner")), "rows")
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = rows.groupBy("range").agg(F.count(F.lit(1)).alias("n"))
    ranges = ranges.select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    total = rows.count()
    at = F.col("before") + F.col("inner")
    shard = F.expr(f"((before + inner + 1) * {shards} - 1) div {max(total, 1)}").cast("int")
    first = F.expr(f"(cast(shard as bigint) * {total}) div {shards}")
    return (
        rows.join(F.broadcast(ranges), "range")  # one row for each range: as many as there were tasks
        .withColumn("shard", shard)
        .select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (at - first).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "curve")
    )
