"""Lines to rows: acceptance, tokens, positional fields, derived and meta fields."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ValidationError
from ..functions.text import BLANK, by_alphabet, field, scrubbed, strip
from ..schema import COMMON, DEFAULT_HOST, IPV4, PORTS, PROTOCOLS, TCP

TAG = "filterlog"
_ISO = "^[0-9]{4}-[0-9]{2}-[0-9]{2}T"
#: The compact form without separators; seconds may be absent.
_COMPACT = "^([0-9]{4})([0-9]{2})([0-9]{2})T([0-9]{2})([0-9]{2})"


def timestamp(token: Column) -> Column:
    """The wall clock of an ISO time (an offset is dropped), NULL for any other form."""
    spread = F.regexp_replace(F.regexp_replace(token, f"{_COMPACT}([0-9]{{2}})", "$1-$2-$3 $4:$5:$6"), _COMPACT, "$1-$2-$3 $4:$5")
    return F.when(token.rlike(_ISO), F.replace(token, F.lit("T"), F.lit(" ")).try_cast("timestamp_ntz")).when(token.rlike(_COMPACT), spread.try_cast("timestamp_ntz"))


def protocol_name(number: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in PROTOCOLS.items() for x in pair])
    return F.coalesce(F.try_element_at(names, number), number)


def parse_lines(
    lines: DataFrame,
    *,
    value: str = "value",
    layout: str = "standard",
    host: str = DEFAULT_HOST,
    fallback_ts: dt.datetime | None = None,
    require_action: bool = False,
) -> DataFrame:
    """Adds the row schema to every accepted line; other lines are dropped, other columns stay.

    layout "no_ecn" reads lines without the ECN field, whose later fields stand one place
    earlier. ts is NULL where the first word is no ISO time; ts_effective is then fallback_ts, or the time of
    the query. All expressions are total: no line can fail a task. The tag test comes first, so most foreign
    lines cost one substring search; nothing shuffles.
    """
    if layout not in ("standard", "no_ecn"):
        raise ValidationError(f"no such layout: {layout}", layout=layout)
    shift = 1 if layout == "no_ecn" else 0
    at = lambda k: k - shift if k > 10 else k
    others = [F.col(f"`{c}`") for c in lines.columns if c != value]
    raw = strip(scrubbed(F.col(f"`{value}`")))
    kept = lines.filter(F.contains(F.col(f"`{value}`"), F.lit(TAG))).select(*others, raw.alias("raw_line"))
    # The first word with the tag is the one around the tag's first place.
    rest = F.substr("raw_line", F.position(F.lit(TAG), F.col("raw_line")) + len(TAG))
    enough = lambda blank, word: F.col("raw_line").rlike(f"^{word}++(?:{blank}++{word}++){{2}}{blank}++{word}")
    after = lambda blank, word: F.regexp_replace(F.regexp_extract(rest, f"(?s)^{word}*+{blank}++(.+)$", 1), f"{blank}++", " ")
    payload = by_alphabet(F.col("raw_line"), lambda blank, word: F.when(enough(blank, word), after(blank, word)).otherwise(F.lit("")))
    first = by_alphabet(F.col("raw_line"), lambda _, word: F.regexp_extract("raw_line", f"^({word}++)", 1))
    names = [F.col(f"`{c}`") for c in lines.columns if c != value]
    # The array of one element is a fence: filters on fields and times stop above it, so that a line's
    # expensive matches are made once, and not again for every condition that is pushed down.
    split = kept.select(*names, "raw_line", F.explode(F.array(F.struct(F.split(payload, ",", -1).alias("f"), first.alias("first")))).alias("__x"))
    split = split.select(*names, "raw_line", F.col("__x.f").alias("__f"), F.col("__x.first").alias("__first"))
    split = split.filter((F.size("__f") > 1) | (F.get("__f", F.lit(0)) != ""))

    f, n = F.col("__f"), F.size("__f")
    base = split.select(*names, "raw_line", "__f", F.col("__first").alias("__timestamp__"), *[field(f, k).alias(c) for c, k in COMMON.items()], field(f, at(IPV4["protonum"])).alias("__n"))
    is_v4 = (F.col("ipversion") == "4") & (n > 9)
    has_ports = is_v4 & F.col("__n").isin("6", "17") & (n > at(20))
    is_tcp = has_ports & (F.col("__n") == "6") & (n > at(23))
    base = base.select("*", is_v4.alias("__v4"), has_ports.alias("__ports"), is_tcp.alias("__tcp"))
    null = F.lit(None).cast("string")
    out = {name: F.col(name) for name in COMMON}
    for group, condition in ((IPV4, "__v4"), (PORTS, "__ports"), (TCP, "__tcp")):
        out |= {name: F.when(F.col(condition), field(f, at(k))).otherwise(null) for name, k in group.items()}
    if shift:
        out["ecn"] = F.when(F.col("__v4"), F.lit("")).otherwise(null)
    out["protonum"] = F.when(F.col("__v4"), F.col("__n")).otherwise(null)
    out["protoname"] = F.when(F.col("__v4"), protocol_name(F.col("__n"))).otherwise(null)
    ts = timestamp(F.col("__timestamp__"))
    late = F.lit(fallback_ts).cast("timestamp_ntz") if fallback_ts is not None else F.localtimestamp()
    rows = base.select(
        *names,
        "raw_line",
        *[c.alias(k) for k, c in out.items()],
        out["interface"].alias("interface_display"),
        ts.alias("ts"),
        F.coalesce(ts, late).alias("ts_effective"),
        "__timestamp__",
        F.lit(host).alias("__host__"),
        F.md5("raw_line").alias("__digest__"),
    )
    return rows.filter("action <> ''") if require_action else rows


def rule_hash(rid: Column, raw_line: Column) -> Column:
    """A row's rule: its rid, or else the first part of 32 hexadecimal digits in the line."""
    found = F.regexp_extract(raw_line, f"(?:^|,){BLANK}*([0-9a-fA-F]{{32}}){BLANK}*(?:,|$)", 1)
    return F.coalesce(F.when(rid != "", rid), F.when(found != "", found), F.lit(""))
