"""Dimension joins: interfaces, address and port aliases, rule labels, and alias resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.netaddr import ipv4_number, network_range
from ..functions.text import strip
from .joins import BROADCAST_ROWS, bounded

#: Networks up to which each row looks through an array; beyond, rows join on their masked address.
ARRAY_NETWORKS = 256


def last_wins(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """One row per key: its last value, at the place where the key first stood."""
    return df.groupBy(key).agg(F.max_by(value, order).alias(value), F.min(order).alias(order))


def _look_up(df: DataFrame, dim: DataFrame, key: str, value: str, on: str, out: str, default: Column | None) -> DataFrame:
    """Left join on a unique key; dim is deduplicated first, so rows never multiply. The last value of a key in
    order of ord wins; without ord, which rows of a table don't have, the greatest."""
    value_of = F.max_by(value, "ord") if "ord" in dim.columns else F.max(value)
    one = dim.groupBy(F.col(key).alias("__key")).agg(value_of.alias("__value"))
    joined = df.join(bounded(one), F.col(f"`{on}`") == F.col("__key"), "left")
    found = F.col("__value") if default is None else F.coalesce("__value", default)
    return joined.withColumn(out, found).drop("__key", "__value")


def interface_display(rows: DataFrame, interfaces: DataFrame) -> DataFrame:
    """interface_display from interfaces(physical, display), the physical name where there is none."""
    return _look_up(rows, interfaces, "physical", "display", "interface", "interface_display", F.col("interface"))


def rule_labels(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """rule_label from labels(rid, description), '' where there is none."""
    return _look_up(rows, labels, "rid", "description", "rid", "rule_label", F.lit(""))


def port_alias(rows: DataFrame, ports: DataFrame, column: str) -> DataFrame:
    """<column>_alias from ports(port, alias[, ord]); NULL where there is none."""
    return _look_up(rows, ports, "port", "alias", column, f"{column}_alias", None)


def networks(spark: SparkSession, items: list[tuple[str, str]]) -> DataFrame:
    """(item, alias, ord, lo, hi, prefix, is_cidr) from alias items in order of first insertion.

    Later items of the same name replace the alias but keep the place. lo and hi are NULL for what
    isn't an IPv4 network; those can still match exactly.
    """
    order: dict[str, tuple[int, str]] = {}
    for k, (item, alias) in enumerate(items):
        order[item] = (order[item][0] if item in order else k, alias)
    rows = []
    for item, (k, alias) in order.items():
        lo, hi, prefix = (network_range(item) if "/" in item else None) or (None, None, None)
        rows.append((item, alias, k, lo, hi, prefix, "/" in item))
    return spark.createDataFrame(rows, "item string, alias string, ord long, lo long, hi long, prefix int, is_cidr boolean")


def ip_alias(rows: DataFrame, nets: DataFrame, column: str, strategy: str = "auto") -> DataFrame:
    """<column>_alias: the exact item's alias, or else that of the first network in order that holds the address.

    "array": networks (at most ARRAY_NETWORKS) as a literal that each row filters, no join at all.
    "prefix": an equi-join on the masked address for each prefix length in use, 33 at most, and the
    least ord of the hits; up to BROADCAST_ROWS networks no row moves. Neither is a range join.
    """
    ranges = nets.where("is_cidr and lo is not null")
    if strategy == "auto":
        strategy = "array" if ranges.limit(ARRAY_NETWORKS + 1).count() <= ARRAY_NETWORKS else "prefix"
    exact = nets.select(F.col("item").alias("__item"), F.col("alias").alias("__exact"))
    out = rows.join(bounded(exact), F.col(f"`{column}`") == F.col("__item"), "left").drop("__item")
    if strategy == "array":
        found = sorted((r["ord"], r["lo"], r["hi"], r["alias"]) for r in ranges.select("ord", "lo", "hi", "alias").limit(ARRAY_NETWORKS + 1).collect())
        kind = "array<struct<lo:bigint,hi:bigint,alias:string>>"
        literal = F.array(*[F.struct(F.lit(lo).cast("long").alias("lo"), F.lit(hi).cast("long").alias("hi"), F.lit(a).alias("alias")) for _, lo, hi, a in found]).cast(kind) if found else F.array().cast(kind)
        out = out.withColumn("__ip", ipv4_number(F.col(f"`{column}`")))
        hit = F.get(F.filter(literal, lambda n: (F.col("__ip") >= n["lo"]) & (F.col("__ip") <= n["hi"])), F.lit(0))["alias"]
        return out.withColumn(f"{column}_alias", F.coalesce("__exact", F.when(F.col("__ip").isNotNull(), hit))).drop("__ip", "__exact")
    lengths = sorted(r[0] for r in ranges.select("prefix").distinct().collect())  # 33 at most
    small = ranges.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    mask = lambda p: F.lit(((1 << p) - 1) << (32 - p)).cast("long")
    out = out.withColumn("__ip", ipv4_number(F.col(f"`{column}`")))
    for p in lengths:
        side = ranges.where(F.col("prefix") == p).groupBy(F.col("lo").alias("__lo")).agg(F.min(F.struct("ord", "alias")).alias(f"__hit{p}"))
        out = out.join(F.broadcast(side) if small else side, F.col("__ip").bitwiseAND(mask(p)) == F.col("__lo"), "left").drop("__lo")
    hits = [F.col(f"__hit{p}") for p in lengths]
    first = (F.least(*hits) if len(hits) > 1 else hits[0])["alias"] if hits else F.lit(None).cast("string")
    return out.withColumn(f"{column}_alias", F.coalesce("__exact", first)).drop("__exact", "__ip", *[f"__hit{p}" for p in lengths])


def decorated(value: Column, alias: Column) -> Column:
    """value, or "value (alias)" where there is an alias; an empty value stays."""
    return F.when((alias.isNotNull()) & (value != ""), F.concat(value, F.lit(" ("), alias, F.lit(")"))).otherwise(value)


def alias_items(aliases: DataFrame) -> DataFrame:
    """(alias_pos, name, type, item_pos, item) from admitted aliases(alias_pos, enabled, name, type, content).

    An alias counts if enabled is absent or '1' and it has a name and content. Items stand on lines or between commas.
    """
    admitted = aliases.where("(enabled is null or enabled = '1') and coalesce(name, '') <> '' and coalesce(content, '') <> ''")
    items = F.filter(F.transform(F.split(F.translate("content", "\n", ","), ","), lambda x: strip(x)), lambda x: x != "")
    return admitted.select("alias_pos", "name", "type", F.posexplode(items).alias("item_pos", "item"))


def resolve_aliases(aliases: DataFrame) -> DataFrame:
    """(kind, item, alias, ord): every item of address (kind ip) and port aliases, references resolved one level.

    Raw items come first, in order; then each alias again with the items of aliases that it
    names in place of the names. The last alias of an item wins; its place is that of its
    first insertion. ord is (pass, alias_pos, item_pos, inner).
    """
    items = alias_items(aliases)
    ranked = lambda n, inner: F.struct(F.lit(n).alias("pass"), F.col("alias_pos").alias("alias_pos"), F.col("item_pos").alias("item_pos"), inner.alias("inner"))
    raw = items.select("type", "item", F.col("name").alias("alias"), ranked(1, F.lit(0)).alias("ord"))
    named = items.select(F.col("name").alias("of"), F.col("item").alias("inner_item"), F.col("item_pos").alias("inner"))
    resolved = items.join(bounded(named), (F.col("item") == F.col("of")) & (F.col("name") != F.col("of")), "left")
    second = resolved.select("type", F.coalesce("inner_item", "item").alias("item"), F.col("name").alias("alias"), ranked(2, F.coalesce("inner", F.lit(0))).alias("ord"))
    kinds = F.when(F.col("type").isin("host", "network", "urltable", "geoip"), "ip").when(F.col("type") == "port", "port")
    every = raw.unionByName(second).withColumn("kind", kinds).where("kind is not null")
    ports = F.explode(F.when(F.col("kind") == "port", expanded_ports(F.col("item"))).otherwise(F.array("item")))
    every = every.withColumn("item", ports)
    return every.groupBy("kind", "item").agg(F.max_by("alias", "ord").alias("alias"), F.min("ord").alias("ord"))


def expanded_ports(item: Column) -> Column:
    """Port numbers of a range "a:b" or "a-b", both ends included; none if a > b; anything else is itself."""
    separator = F.when(F.contains(item, F.lit(":")) & ~F.contains(item, F.lit("-")), ":").when(F.contains(item, F.lit("-")), "-")
    parts = F.split(item, F.when(separator == ":", ":").otherwise("-"))
    a, b = strip(F.get(parts, F.lit(0))).try_cast("int"), strip(F.get(parts, F.lit(1))).try_cast("int")
    is_range = separator.isNotNull() & (F.size(parts) == 2) & a.isNotNull() & b.isNotNull()
    numbers = F.transform(F.when(a <= b, F.sequence(a, F.greatest(a, b))).otherwise(F.array().cast("array<int>")), lambda x: x.cast("string"))
    return F.when(is_range, numbers).otherwise(F.array(item))
