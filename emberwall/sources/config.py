"""Interfaces and aliases from the firewall's XML configuration.

Configurations are kilobytes and their tag names are data, so they are parsed on the driver; alias items
and references are then resolved as DataFrames.
"""

from __future__ import annotations

import os
import xml.etree.ElementTree as ET

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.enrich import networks, resolve_aliases

RAW_ALIAS = "alias_pos int, enabled string, name string, type string, content string"


def _root(spark: SparkSession, path: str) -> ET.Element | None:
    """The document's root, or None for a file that is missing or not well-formed. Any store that Spark reads works."""
    try:
        if os.path.isfile(path):
            with open(path, "rb") as f:
                return ET.fromstring(f.read())
        text = spark.read.text(path, wholetext=True).where("value <> ''").first()
        return ET.fromstring(text["value"]) if text else None
    except Exception:
        return None


def _text(element: ET.Element | None) -> str:
    return (element.text or "").strip() if element is not None else ""


def interface_names(spark: SparkSession, path: str) -> dict[str, str]:
    """{physical: display}: the description, or else the tag in capitals; the last of a name wins."""
    root = _root(spark, path)
    section = root.find("interfaces") if root is not None else None
    found = {}
    for entry in section if section is not None else ():
        if physical := _text(entry.find("if")):
            found[physical] = _text(entry.find("descr")) or entry.tag.upper()
    return found


def interfaces(spark: SparkSession, path: str) -> DataFrame:
    return spark.createDataFrame(list(interface_names(spark, path).items()), "physical string, display string")


def raw_aliases(spark: SparkSession, path: str) -> DataFrame:
    """The alias elements in document order; enabled is NULL where there is no such element."""
    root = _root(spark, path)
    section = None
    if root is not None:
        section = root.find(".//Firewall/Alias/aliases")
        section = root.find("aliases") if section is None else section
    rows = []
    for k, a in enumerate(section.findall("alias") if section is not None else ()):
        enabled = a.find("enabled")
        rows.append((k, _text(enabled) if enabled is not None else None, _text(a.find("name")), _text(a.find("type")), a.findtext("content") or ""))
    return spark.createDataFrame(rows, RAW_ALIAS)


def aliases(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(address aliases as networks(), port aliases(port, alias, ord)); both empty for a file that can't be used."""
    resolved = resolve_aliases(raw_aliases(spark, path))
    items = [(r["item"], r["alias"]) for r in resolved.where("kind = 'ip'").orderBy("ord").collect()]  # a configuration's aliases
    return networks(spark, items), resolved.where("kind = 'port'").select(F.col("item").alias("port"), "alias", "ord")


def config_stats(spark: SparkSession, path: str) -> dict[str, int]:
    nets, ports = aliases(spark, path)
    return {"interfaces": len(interface_names(spark, path)), "ip_aliases": nets.count(), "port_aliases": ports.count()}
