"""Packet-filter lines made from a table of events, for tests and benchmarks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def filter_lines(events: DataFrame) -> DataFrame:
    """(event_id, value): one line per event, in built-in functions alone."""
    i, u = F.col("event_id"), F.col("user_id")
    s = lambda c: c.cast("string")
    number = F.when(i % 13 == 0, "112").when(i % 17 == 0, "2").when(F.col("event_type") == "view", "17").when(F.col("event_type") == "signup", "1").otherwise("6")
    port = F.get(F.array(*[F.lit(p) for p in ("80", "443", "22", "8085", "53")]), (i % 5).cast("int"))
    text = F.lit
    fields = [
        s(i % 97), text(""), text(""), F.md5(s(i % 7)), F.concat(text("vtnet"), s(u % 3)), text("match"),
        F.when(F.col("event_type") == "error", "block").otherwise("pass"), F.when(i % 2 == 0, "in").otherwise("out"), F.when(i % 11 == 0, "6").otherwise("4"),
        text("0x0"), text(""), text("64"), s(i % 65536), text("0"), text("DF"), number, text("x"), text("60"),
        F.concat(text("10.0."), s(u % 256), text("."), s(i % 256)), F.concat(text("192.168."), s(u % 4), text("."), s(i % 200)),
        s(1024 + i % 60000), port, text("0"), text("S"), s(i), text(""), text("64240"), text(""), text("mss;nop"),
    ]
    tag = F.when(i % 50 == 0, "dhclient").otherwise("filterlog")
    line = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), text(" Informational "), tag, text(" "), F.concat_ws(",", *fields))
    return events.select("event_id", line.alias("value"))
