"""What a viewer shows: row numbers, table rows, pages, tails, counts."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType, TimestampNTZType, TimestampType

from ..schema import DEFAULT_PAGE, TAIL_LINES
from .enrich import decorated


def dense_index(df: DataFrame, *order: str, name: str = "row_idx") -> DataFrame:
    """Numbers rows from 0 in the given order, without a window over all rows.

    A first job deals the columns of the order alone into ranges, and the driver gets the first key and the size of
    each. They are constants of the plan: a row's number is its place in its range and the sizes of the ranges before.
    Ranges that Spark cuts itself would not do, as it cuts anew wherever it runs a part of the plan.
    """
    starts = _range_starts(df, order)
    dealt = df.withColumn("__before", _before(_order_key(df, order), starts))
    place = F.row_number().over(Window.partitionBy("__before").orderBy(*order))
    return dealt.withColumn(name, F.col("__before") + place - 1).drop("__before")


def _order_key(df: DataFrame, order: tuple[str, ...]) -> Column:
    """What rows are compared by; a time as a number, since a time zone's change makes its local form ambiguous."""
    keys = [F.unix_micros(c) if isinstance(df.select(c).schema[0].dataType, TimestampType) else F.col(c) for c in order]
    return keys[0] if len(keys) == 1 else F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys)])


def _range_starts(df: DataFrame, order: tuple[str, ...]) -> list[tuple[Column, int]]:
    """The first key of each range, in order, and the number of rows before it; a range holds all rows of its keys."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.select(_order_key(df, order).alias("key")).repartitionByRange(n, "key").withColumn("range", F.spark_partition_id())
    ranges = ranged.groupBy("range").agg(F.min("key").alias("key"), F.count(F.lit(1)).alias("n")).orderBy("key")
    kind, starts, before = ranges.schema["key"].dataType, [], 0
    for r in ranges.collect():  # at most a row for each shuffle partition
        starts.append((_constant(r["key"], kind), before))
        before += r["n"]
    return starts


def _constant(value, kind: DataType) -> Column:
    """A collected value in its own type. A wall-clock time goes as text: F.lit would make it a time of Python's zone."""
    if value is not None and isinstance(kind, StructType):
        return F.struct(*[_constant(value[f.name], f.dataType).alias(f.name) for f in kind])
    return F.lit(str(value) if value is not None and isinstance(kind, TimestampNTZType) else value).cast(kind)


def _before(key: Column, starts: list[tuple[Column, int]]) -> Column:
    """The rows before a key's range, by binary search. A NULL key, which sorts first, is not >= any."""
    if len(starts) < 2:
        return F.lit(0).cast("long")

    def pick(low: int, high: int) -> Column:
        if high - low == 1:
            return F.lit(starts[low][1]).cast("long")
        middle = (low + high) // 2
        return F.when(key >= starts[middle][0], pick(middle, high)).otherwise(pick(low, middle))

    return pick(0, len(starts))


def file_index(lines: DataFrame, name: str = "row_idx") -> DataFrame:
    """Numbers lines of text files (from read_lines, with file and block) in file order, with no sort.

    Within a split, ids rise with the lines; splits are counted and added up in order of file and
    offset. The table of splits has one row for each.
    """
    names, keyed = ["file", "block"], lines.withColumn("__id", F.monotonically_increasing_id())
    blocks = keyed.groupBy(*names).agg(F.min("__id").alias("__first"), F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(*names, "__first", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    joined = keyed.join(F.broadcast(blocks), names)  # one row for each split
    return joined.withColumn(name, F.col("__before") + F.col("__id") - F.col("__first")).drop("__id", "__first", "__before")


def table_rows(rows: DataFrame) -> DataFrame:
    """The nine columns of the table and the row's colour tag; aliases and labels where they were joined."""
    have = set(rows.columns)
    shown = lambda c: F.coalesce(decorated(F.col(c), F.col(f"{c}_alias")) if f"{c}_alias" in have else F.col(c), F.lit(""))
    return rows.select(
        *[c for c in ("row_idx", "event_id") if c in have],
        F.date_format("ts_effective", "yyyy-MM-dd HH:mm:ss").alias("timestamp"),
        "action",
        F.col("interface_display").alias("interface"),
        *[shown(c).alias(c) for c in ("src", "srcport", "dst", "dstport")],
        F.coalesce("protoname", F.lit("")).alias("protoname"),
        (F.coalesce("rule_label", F.lit("")) if "rule_label" in have else F.lit("")).alias("label"),
        row_tag().alias("row_tag"),
    )


def row_tag():
    return F.when(F.col("action") == "block", "blocked").when(F.col("action") == "pass", "passed").otherwise("")


def total_pages(n_rows: int, size: int = DEFAULT_PAGE) -> int:
    return max(1, math.ceil(n_rows / size))


def clamp_page(page: int, n_rows: int, size: int = DEFAULT_PAGE) -> int:
    return min(max(page, 0), total_pages(n_rows, size) - 1)


def page(rows: DataFrame, number: int, size: int = DEFAULT_PAGE, *, order: str = "row_idx") -> DataFrame:
    """One page of a view. Rows numbered without gaps are picked by number, which is pushed
    down to a stored table however deep the page; see page_by_rank for filtered views."""
    return rows.where((F.col(order) >= number * size) & (F.col(order) < (number + 1) * size)).orderBy(order)


def page_by_rank(rows: DataFrame, number: int, size: int = DEFAULT_PAGE, *, order: str = "row_idx") -> DataFrame:
    """One page of a filtered view, whose numbers have gaps: the top rows by order, then the last of them."""
    return rows.orderBy(order).offset(number * size).limit(size)


def tail(rows: DataFrame, n: int, *, order: str = "row_idx") -> DataFrame:
    """The last n rows, in order; none for n < 1."""
    return rows.orderBy(F.desc(order)).limit(max(n, 0)).orderBy(order)


def first_rows(rows: DataFrame, n: int, *order: str, name: str = "row_idx") -> DataFrame:
    """The first n rows in the given order, numbered from 0. Each task keeps its own n: no sort or shuffle of all rows."""
    top = rows.orderBy(*order).limit(max(n, 0))
    return top.withColumn(name, (F.row_number().over(Window.orderBy(*order)) - 1).cast("long"))  # a window over n rows


def last_rows(rows: DataFrame, n: int, *order: str, name: str = "row_idx") -> DataFrame:
    """The last n rows in the given order with their numbers among all; a count and n rows from each task."""
    back = [F.desc(c) for c in order]
    top = rows.orderBy(*back).limit(max(n, 0)).withColumn("__back", F.row_number().over(Window.orderBy(*back)))  # a window over n rows
    total = rows.agg(F.count(F.lit(1)).alias("__total"))
    numbered = top.crossJoin(F.broadcast(total))  # a single row
    return numbered.withColumn(name, F.col("__total") - F.col("__back")).drop("__total", "__back").orderBy(name)


def tail_view(lines: DataFrame, parse, size: int = DEFAULT_PAGE, *, order: str = "row_idx") -> DataFrame:
    """The parsed rows among the last size of the last TAIL_LINES lines."""
    return parse(tail(tail(lines, TAIL_LINES, order=order), size, order=order)).orderBy(order)


def counts(lines: DataFrame, rows: DataFrame, matches: DataFrame | None = None) -> DataFrame:
    """n_lines (physical), n_entries (parsed) and n_matches of a view, in one row."""
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    out = one(lines, "n_lines").crossJoin(one(rows, "n_entries"))  # single rows
    return out.crossJoin(one(matches if matches is not None else rows, "n_matches"))


def sorted_by(rows: DataFrame, column: str, descending: bool = False, *, order: str = "row_idx") -> DataFrame:
    """The view by any column, ties in file order."""
    c = F.col(f"`{column}`")
    return rows.orderBy(c.desc() if descending else c.asc(), order)


def details(rows: DataFrame, index: int, *, order: str = "row_idx") -> DataFrame:
    """(field, value) of one row: its line, its fields but the meta ones, time, host and digest."""
    from ..schema import PARSED

    names = [*PARSED, "interface_display"]
    shown = [("raw_line", F.col("raw_line")), *[(n, F.col(n)) for n in names], ("timestamp", F.col("ts_effective").cast("string")), ("host", F.col("__host__")), ("digest", F.col("__digest__"))]
    pairs = F.array(*[F.struct(F.lit(n).alias("field"), c.alias("value")) for n, c in shown])
    return rows.where(F.col(order) == index).select(F.inline(pairs)).where("value is not null")


def memory_info(n_chunks: int, n_entries: int) -> dict:
    """The estimate shown for held rows: half a kilobyte each."""
    return {"cached_chunks": n_chunks, "cached_entries": n_entries, "memory_mb": n_entries * 0.5 / 1024}


def top_values(rows: DataFrame, column: str, n: int = 10) -> DataFrame:
    """The n most frequent values of a column (an addition of this engine)."""
    return rows.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column).limit(n)


def per_hour(rows: DataFrame) -> DataFrame:
    """Rows by hour and action (an addition of this engine)."""
    return rows.groupBy(F.date_trunc("hour", "ts_effective").cast("timestamp_ntz").alias("hour"), "action").agg(F.count(F.lit(1)).alias("n"))
