"""Every operator as a named query over the driver's tables, with its SQL.

The tables hold no firewall logs, so lines are made from events, parsed back, and compared with
what SQL computes from events without any parsing.
"""

from __future__ import annotations

import datetime as dt
import os
import tempfile
from collections.abc import Callable
from itertools import islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import SourceError, ValidationError
from ..functions.netaddr import ipv4_number
from ..functions.predicates import FilterSpec, compare, preset, row_udf
from ..functions.text import scrubbed
from ..operators import enrich, export, view
from ..operators.parse import parse_lines, rule_hash
from ..schema import COMMON, IPV4, PARSED, PORTS, TCP
from ..sources import config, rules
from ..sources.synthetic import filter_lines
from ..sources.text import iterate, read_lines, read_tail
from ..streaming.live import stream_rows
from .oracle import WITH_L

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}

FALLBACK = dt.datetime(2024, 1, 1)
PAGE = 1000
#: Rows of a saved file that the driver holds at a time.
SAVED_ROWS = 50_000

# Dimensions of the queries, the same on both sides.
INTERFACES = [("vtnet0", "LAN"), ("vtnet1", "WAN")]
NETS = [("10.0.1.1", "HostA"), ("10.0.0.0/17", "NetLow"), ("10.0.0.0/8", "NetAll"), ("192.168.2.0/24", "Dmz")]
PORT_ALIASES = [("80", "HTTP", 0), ("443", "HTTPS", 1), *[(str(p), "AltWeb", p) for p in range(8080, 8091)]]
RULES_DUMP = """pass in quick on ix0 proto tcp label "5f0c5f0c5f0c5f0c5f0c5f0c5f0c5f0c" # Mail gate (v6) out
block out on ix1 label "77aa01" # Printer room
pass out on ix2 label "c0ffee9" # Time servers
pass out on ix1 label "77aa01" # Printer floor
block in label "h2"
# next line
"""
RAW_ALIASES = [
    (0, "1", "Kiosk", "host", "172.16.9.7"),
    (1, None, "Lobby", "host", "Kiosk\n172.16.9.8"),
    (2, "1", "A", "network", "B"),
    (3, "1", "B", "network", "C"),
    (4, "1", "C", "network", "1.1.1.1"),
    (5, "0", "Off", "host", "9.9.9.9"),
    (6, "1", "Mail", "port", "25, 465,2525:2527"),
    (7, "1", "Odd", "port", "abc:def\n90:80\n465"),
    (8, "1", "Other", "external", "8.8.8.8"),
    (9, "1", "Empty", "host", ""),
]


def query(sql: str | None = None):
    """Registers a query by its function's name; sql may use l, the parsed lines."""

    def add(f):
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql if sql.startswith("WITH") else f"{WITH_L} {sql}"
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_lines(table(spark, sf_dir, "events"))


def parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_lines(raw_lines(spark, sf_dir), fallback_ts=FALLBACK)


def interfaces(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(INTERFACES, "physical string, display string")


def labels(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("0", "Rule zero"), ("1", "Rule one")], "n string, description string").select(F.md5("n").alias("rid"), "description")


def ports(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PORT_ALIASES, "port string, alias string, ord long")


def named(rows: DataFrame, spark: SparkSession) -> DataFrame:
    return enrich.interface_display(rows, interfaces(spark))


def matching(spark: SparkSession, sf_dir: str, spec: FilterSpec, *extra: str) -> DataFrame:
    return spec.apply(parsed(spark, sf_dir)).select("event_id", *extra)


def quoted(names) -> str:
    return ", ".join(f'"{n}"' for n in names)


# Parsing.


@query(f"SELECT event_id, {quoted(COMMON)} FROM l")
def parse_common(spark, d):
    return parsed(spark, d).select("event_id", *COMMON)


@query(f"SELECT event_id, {quoted(IPV4)} FROM l")
def parse_ipv4(spark, d):
    return parsed(spark, d).select("event_id", *IPV4)


@query(f"SELECT event_id, {quoted(PORTS)} FROM l WHERE protonum = '17'")
def parse_udp(spark, d):
    return parsed(spark, d).where("protonum = '17'").select("event_id", *PORTS)


@query(f"SELECT event_id, {quoted([*PORTS, *TCP])} FROM l WHERE protonum = '6'")
def parse_tcp(spark, d):
    return parsed(spark, d).where("protonum = '6'").select("event_id", *PORTS, *TCP)


@query("SELECT event_id, src, dst, srcport, tcpflags FROM l WHERE protonum = '1'")
def parse_icmp(spark, d):
    return parsed(spark, d).where("protonum = '1'").select("event_id", "src", "dst", "srcport", "tcpflags")


@query("SELECT event_id, interface, action, src, protoname FROM l WHERE ipversion = '6'")
def parse_ipv6_common_only(spark, d):
    return parsed(spark, d).where("ipversion = '6'").select("event_id", "interface", "action", "src", "protoname")


@query("SELECT CAST((SELECT count(*) FROM events) - count(*) AS BIGINT) AS n_rejected FROM l")
def parse_reject_count(spark, d):
    lines = raw_lines(spark, d)
    return view.counts(lines, parse_lines(lines)).select((F.col("n_lines") - F.col("n_entries")).alias("n_rejected"))


SHORT = [("2031-05-01T07:08:09 gate filterlog: 45,9 x",), ("three words then filterlog and odd remains",), ("a b c filterlog:",), ("a b filterlog",), ("",), ("2031-05-01T07:08:09+02:00\tx  filterlog 1,,,r,ix0,match , pass,in,4,0x0\r",)]


@query("""WITH v(rulenr, action, "interface", ipversion, tos, ts) AS (VALUES ('45', '', '', '', NULL, TIMESTAMP '2031-05-01 07:08:09'),
    ('and odd remains', '', '', '', NULL, NULL), ('1', 'pass', 'ix0', '4', '0x0', TIMESTAMP '2031-05-01 07:08:09')) SELECT * FROM v""")
def parse_short(spark, d):
    return parse_lines(spark.createDataFrame(SHORT, "value string")).select("rulenr", "action", "interface", "ipversion", "tos", "ts")


@query("SELECT protoname, CAST(count(*) AS BIGINT) AS n FROM l GROUP BY protoname")
def proto_map(spark, d):
    return parsed(spark, d).groupBy("protoname").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, raw_line, md5(raw_line) AS digest FROM l")
def digest_md5(spark, d):
    return parsed(spark, d).select("event_id", "raw_line", F.col("__digest__").alias("digest"))


@query("SELECT event_id, ts, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS token FROM l")
def ts_parse(spark, d):
    return parsed(spark, d).select("event_id", "ts", F.col("__timestamp__").alias("token"))


@query("SELECT event_id, action FROM l WHERE event_id < 500")
def max_lines_before_parse(spark, d):
    """The first 500 physical lines, of which fewer are accepted."""
    lines = view.dense_index(raw_lines(spark, d), "event_id").where("row_idx < 500")
    return parse_lines(lines).select("event_id", "action")


# Presets.


def _presets() -> None:
    for name, condition in {"all": "TRUE", "blocked": "action = 'block'", "allowed": "action = 'pass'", "tcp": "protoname = 'tcp'", "udp": "protoname = 'udp'"}.items():

        def run(spark, d, name=name):
            return view.table_rows(preset(name).apply(parsed(spark, d))).drop("label", "row_tag")

        run.__name__ = f"preset_{name}"
        columns = "strftime(ts, '%Y-%m-%d %H:%M:%S') AS \"timestamp\", action, interface, " + ", ".join(f"coalesce({c}, '') AS {c}" for c in ("src", "srcport", "dst", "dstport", "protoname"))
        query(f"SELECT event_id, {columns} FROM l WHERE {condition}")(run)


_presets()


# Predicates.


@query("SELECT p_partkey, p_type FROM part WHERE lower(p_type) = lower('PROMO ANODIZED') OR p_brand = 'Brand#1'")
def f_eq(spark, d):
    return table(spark, d, "part").where(compare(F.col("p_type"), "==", "PROMO ANODIZED") | compare(F.col("p_brand"), "==", "brand#1")).select("p_partkey", "p_type")


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE lower(o_orderpriority) <> '1-urgent'")
def f_ne(spark, d):
    return table(spark, d, "orders").where(compare(F.col("o_orderpriority"), "!=", "1-URGENT")).select("o_orderkey", "o_orderpriority")


@query("SELECT event_id, src FROM l WHERE contains(coalesce(src, ''), '.1.')")
def f_contains(spark, d):
    return matching(spark, d, FilterSpec().where("src", "contains", ".1."), "src")


@query("SELECT event_id, dst FROM l WHERE starts_with(coalesce(dst, ''), '192.168.2')")
def f_startswith(spark, d):
    return matching(spark, d, FilterSpec().where("dst", "startswith", "192.168.2"), "dst")


@query("SELECT event_id, dst FROM l WHERE coalesce(dst, '') LIKE '%.7'")
def f_endswith(spark, d):
    return matching(spark, d, FilterSpec().where("dst", "endswith", ".7"), "dst")


@query("SELECT event_id, src FROM l WHERE regexp_matches(coalesce(src, ''), '^10\\.0\\.[0-9]\\.')")
def f_regex(spark, d):
    return matching(spark, d, FilterSpec().where("src", "regex", r"^10\.0\.(?P<one>[0-9])\."), "src")


@query("SELECT o_orderkey FROM orders WHERE regexp_matches(lower(o_orderpriority), '^[1-3]-(urgent|high)')")
def f_regex_ignore_case(spark, d):
    return table(spark, d, "orders").where(compare(F.col("o_orderpriority"), "regex", "^[1-3]-(Urgent|HIGH)")).select("o_orderkey")


@query("SELECT event_id FROM l WHERE action = 'block'")
def f_bad_regex(spark, d):
    """A pattern that can't be used is false, so its negation is true."""
    return matching(spark, d, FilterSpec().where("src", "regex", "(unclosed[", negate=True).where("action", "==", "block"))


def _numeric() -> None:
    for name, op, column, value in (("f_gt", ">", "srcport", "5000.5"), ("f_lt", "<", "dstport", "100"), ("f_ge", ">=", "srcport", "8000"), ("f_le", "<=", "dstport", "80")):

        def run(spark, d, op=op, column=column, value=value):
            return matching(spark, d, FilterSpec().where(column, op, value), column)

        run.__name__ = name
        query(f"SELECT event_id, {column} FROM l WHERE coalesce(TRY_CAST({column} AS DOUBLE) {op} {value}, FALSE)")(run)


_numeric()


@query("SELECT event_id FROM l WHERE action = 'block'")
def f_uncastable(spark, d):
    """A word is no number: the comparison is false, and its negation true."""
    return matching(spark, d, FilterSpec().where("action", ">", "100", negate=True).where("action", "==", "block"))


@query("SELECT event_id FROM l WHERE NOT coalesce(TRY_CAST(srcport AS DOUBLE) > 1000, FALSE)")
def f_not_missing(spark, d):
    return matching(spark, d, FilterSpec().where("srcport", ">", "1000", negate=True))


@query("SELECT event_id FROM l WHERE TRUE")
def f_unknown_op(spark, d):
    """An unknown operator is false, so its negation is true."""
    return matching(spark, d, FilterSpec().where("src", "~~", "x", negate=True))


@query("SELECT event_id FROM l WHERE action = 'block'")
def f_missing_field(spark, d):
    return matching(spark, d, FilterSpec().where("nonexistent", "!=", "value").where("action", "==", "block"))


def fold(assoc: str) -> FilterSpec:
    """block OR tcp AND 443."""
    return FilterSpec(assoc=assoc).where("action", "==", "block").where("protoname", "==", "tcp", connective="OR").where("dstport", "==", "443", connective="AND")


@query("SELECT event_id FROM l WHERE (action = 'block' OR coalesce(protoname, '') = 'tcp') AND coalesce(dstport, '') = '443'")
def f_left_fold(spark, d):
    return matching(spark, d, fold("left"))


@query("SELECT event_id FROM l WHERE action = 'block' OR (coalesce(protoname, '') = 'tcp' AND coalesce(dstport, '') = '443')")
def f_right_fold(spark, d):
    return matching(spark, d, fold("right"))


_NAMES = "CASE interface WHEN 'vtnet0' THEN 'LAN' WHEN 'vtnet1' THEN 'WAN' ELSE interface END"


@query(f"SELECT event_id, {_NAMES} AS interface_display FROM l WHERE interface = 'lan' OR lower({_NAMES}) = 'lan'")
def f_iface_dual_eq(spark, d):
    return FilterSpec().where("interface", "==", "LAN").apply(named(parsed(spark, d), spark)).select("event_id", "interface_display")


@query(f"SELECT event_id, {_NAMES} AS interface_display FROM l WHERE interface <> 'vtnet2' OR lower({_NAMES}) <> 'vtnet2'")
def f_iface_dual_ne(spark, d):
    return FilterSpec().where("interface", "!=", "vtnet2").apply(named(parsed(spark, d), spark)).select("event_id", "interface_display")


@query("SELECT n_nationkey, n_name FROM nation WHERE contains(n_name, 'AN') AND NOT contains(n_name, 'an')")
def f_case_sensitive(spark, d):
    name = F.col("n_name")
    return table(spark, d, "nation").where(compare(name, "contains", "AN", True) & ~compare(name, "contains", "an", True)).select("n_nationkey", "n_name")


@query("SELECT event_id, ts FROM l WHERE ts >= TIMESTAMP '2024-01-02 00:00:00' AND ts <= TIMESTAMP '2024-01-05 12:00:00'")
def f_time_range(spark, d):
    return matching(spark, d, FilterSpec().between("2024-01-02 00:00:00", "2024-01-05 12:00:00"), "ts")


@query("SELECT event_id FROM l WHERE ts >= TIMESTAMP '2024-01-10 00:00:00' AND (action = 'block' OR coalesce(protoname, '') = 'udp')")
def f_time_and_expr(spark, d):
    spec = FilterSpec(assoc="right").where("action", "==", "block").where("protoname", "==", "udp", connective="OR")
    return matching(spark, d, spec.between(start="2024-01-10 00:00:00"))


@query("SELECT event_id FROM l WHERE rid = md5('1')")
def f_label(spark, d):
    rows = enrich.rule_labels(parsed(spark, d), labels(spark))
    return FilterSpec().where("Label", "contains", "rule one").apply(rows).select("event_id")


@query("SELECT event_id FROM l WHERE coalesce(protoname, '') = 'udp'")
def f_label_strict(spark, d):
    """Without joined labels the field is '', which holds nothing."""
    rows = enrich.rule_labels(parsed(spark, d), labels(spark))
    return FilterSpec(labels=False).where("Label", "contains", "rule one", negate=True).where("Protocol", "==", "udp").apply(rows).select("event_id")


# Filters as they are edited and shown.


@query("SELECT event_id FROM l WHERE action = 'block'")
def f_other_connective(spark, d):
    """A condition joined by anything but AND and OR takes no part."""
    return matching(spark, d, FilterSpec().where("action", "==", "block").where("protoname", "==", "udp", connective="XOR"))


@query("SELECT event_id FROM l WHERE coalesce(protoname, '') = 'tcp'")
def f_condition_removed(spark, d):
    return matching(spark, d, FilterSpec().where("action", "==", "block").where("protoname", "==", "tcp").without(0))


@query("SELECT event_id FROM l WHERE TRUE")
def f_cleared(spark, d):
    return matching(spark, d, FilterSpec().where("action", "==", "block").between(start="2024-01-10 00:00:00").clear())


@query("WITH v(n, summary) AS (VALUES (0, 'No filters active'), (1, 'action == ''block'' |  OR NOT src contains ''10.'' | Time range: from 2024-01-02 00:00:00 ')) SELECT * FROM v")
def f_summary(spark, d):
    spec = FilterSpec().where("Action", "==", "block").where("Source IP", "contains", "10.", connective="OR", negate=True).between(start="2024-01-02 00:00:00")
    return spark.createDataFrame([(0, FilterSpec().describe()), (1, spec.describe())], "n int, summary string")


@query("SELECT event_id FROM l WHERE action = 'block' AND coalesce(dstport, '') = '22'")
def f_row_udf(spark, d):
    rows = parsed(spark, d).select("event_id", "action", "dstport")
    return row_udf(lambda r: r["action"] == "block" and r.get("dstport", "") == "22")(rows).select("event_id")


# Joins.


@query(f"SELECT event_id, interface, {_NAMES} AS interface_display FROM l")
def j_iface_display(spark, d):
    return named(parsed(spark, d), spark).select("event_id", "interface", "interface_display")


@query("SELECT event_id, src, CASE WHEN src = '10.0.1.1' THEN 'HostA' END AS src_alias FROM l")
def j_ip_exact(spark, d):
    nets = enrich.networks(spark, [x for x in NETS if "/" not in x[0]])
    return enrich.ip_alias(parsed(spark, d), nets, "src").select("event_id", "src", "src_alias")


_OCTET3 = "CAST(split_part(src, '.', 3) AS BIGINT)"
_SRC_NET = f"CASE WHEN src = '10.0.1.1' THEN 'HostA' WHEN src IS NULL THEN NULL WHEN {_OCTET3} < 128 THEN 'NetLow' ELSE 'NetAll' END"
_DST_NET = "CASE WHEN starts_with(dst, '192.168.2.') THEN 'Dmz' END"


@query(f"SELECT event_id, {_SRC_NET} AS src_alias, {_DST_NET} AS dst_alias FROM l")
def j_ip_cidr_first(spark, d):
    nets = enrich.networks(spark, NETS)
    return enrich.ip_alias(enrich.ip_alias(parsed(spark, d), nets, "src", "array"), nets, "dst", "array").select("event_id", "src_alias", "dst_alias")


@query(f"SELECT event_id, {_SRC_NET} AS src_alias, {_DST_NET} AS dst_alias FROM l")
def j_ip_cidr_prefix(spark, d):
    nets = enrich.networks(spark, NETS)
    return enrich.ip_alias(enrich.ip_alias(parsed(spark, d), nets, "src", "prefix"), nets, "dst", "prefix").select("event_id", "src_alias", "dst_alias")


@query("SELECT event_id, CASE WHEN src = '10.0.1.1' THEN 'HostA' WHEN src IS NULL THEN NULL ELSE 'NetAll' END AS src_alias FROM l")
def j_ip_cidr_order(spark, d):
    """The wider network first: it hides the narrower one."""
    nets = enrich.networks(spark, [NETS[2], NETS[1], NETS[0]])
    return enrich.ip_alias(parsed(spark, d), nets, "src").select("event_id", "src_alias")


@query(f"SELECT event_id, CASE WHEN src IS NULL OR src = '' THEN src ELSE concat(src, ' (', {_SRC_NET}, ')') END AS shown FROM l")
def j_ip_decorated(spark, d):
    rows = enrich.ip_alias(parsed(spark, d), enrich.networks(spark, NETS), "src")
    return rows.select("event_id", enrich.decorated(F.col("src"), F.col("src_alias")).alias("shown"))


@query("SELECT event_id, dst, CAST(split_part(dst, '.', 4) AS BIGINT) + 256 * CAST(split_part(dst, '.', 3) AS BIGINT) + 3232235520 AS n FROM l")
def ip_number(spark, d):
    return parsed(spark, d).select("event_id", "dst", ipv4_number(F.col("dst")).alias("n"))


@query("SELECT event_id, dstport, CASE dstport WHEN '80' THEN 'HTTP' WHEN '443' THEN 'HTTPS' WHEN '8085' THEN 'AltWeb' END AS dstport_alias FROM l")
def j_port_alias(spark, d):
    return enrich.port_alias(parsed(spark, d), ports(spark), "dstport").select("event_id", "dstport", "dstport_alias")


@query("""WITH v(item, port) AS (VALUES ('80', '80'), ('8080:8082', '8080'), ('8080:8082', '8081'), ('8080:8082', '8082'), ('20-21', '20'), ('20-21', '21'), ('abc:def', 'abc:def'), ('5:5', '5')) SELECT * FROM v""")
def port_range_expand(spark, d):
    items = spark.createDataFrame([(x,) for x in ("80", "8080:8082", "20-21", "90:80", "abc:def", "5:5")], "item string")
    return items.select("item", F.explode(enrich.expanded_ports(F.col("item"))).alias("port"))


@query("SELECT event_id, CASE rid WHEN md5('0') THEN 'Rule zero' WHEN md5('1') THEN 'Rule one' ELSE '' END AS rule_label FROM l")
def j_rule_label(spark, d):
    return enrich.rule_labels(parsed(spark, d), labels(spark)).select("event_id", "rule_label")


@query("""WITH v(kind, item, alias) AS (VALUES ('ip', '172.16.9.7', 'Lobby'), ('ip', 'Kiosk', 'Lobby'), ('ip', '172.16.9.8', 'Lobby'),
    ('ip', 'B', 'A'), ('ip', 'C', 'A'), ('ip', '1.1.1.1', 'C'), ('port', '25', 'Mail'), ('port', '465', 'Odd'), ('port', '2525', 'Mail'), ('port', '2526', 'Mail'), ('port', '2527', 'Mail'), ('port', 'abc:def', 'Odd')) SELECT * FROM v""")
def alias_reference_resolve(spark, d):
    raw = spark.createDataFrame(RAW_ALIASES, "alias_pos int, enabled string, name string, type string, content string")
    return enrich.resolve_aliases(raw).select("kind", "item", "alias")


@query("WITH v(item, alias, ord) AS (VALUES ('a', 'three', CAST(0 AS BIGINT)), ('b', 'two', CAST(1 AS BIGINT))) SELECT * FROM v")
def alias_last_wins(spark, d):
    rows = spark.createDataFrame([("a", "one", 0), ("b", "two", 1), ("a", "three", 2)], "item string, alias string, ord long")
    return enrich.last_wins(rows, "item", "alias", "ord")


@query("""WITH v(rid, description) AS (VALUES ('5f0c5f0c5f0c5f0c5f0c5f0c5f0c5f0c', 'Mail gate (v6) out'), ('77aa01', 'Printer floor'), ('c0ffee9', 'Time servers'), ('h2', 'next line')) SELECT * FROM v""")
def rules_label_extract(spark, d):
    return rules.extract_labels(spark.createDataFrame([(RULES_DUMP,)], "value string"))


@query("SELECT event_id, rid AS by_rid, rid AS by_line FROM l")
def label_hash_fallback(spark, d):
    rows = parsed(spark, d)
    return rows.select("event_id", rule_hash(F.col("rid"), F.col("raw_line")).alias("by_rid"), rule_hash(F.lit(""), F.col("raw_line")).alias("by_line"))


# Views.

_SHOWN = f"""SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS "timestamp", action, {_NAMES} AS interface,
    coalesce(CASE WHEN src IS NULL OR src = '' THEN src ELSE concat(src, ' (', {_SRC_NET}, ')') END, '') AS src, coalesce(srcport, '') AS srcport, coalesce(dst, '') AS dst,
    coalesce(CASE dstport WHEN '80' THEN '80 (HTTP)' WHEN '443' THEN '443 (HTTPS)' WHEN '8085' THEN '8085 (AltWeb)' ELSE dstport END, '') AS dstport, coalesce(protoname, '') AS protoname,
    CASE rid WHEN md5('0') THEN 'Rule zero' WHEN md5('1') THEN 'Rule one' ELSE '' END AS label, CASE action WHEN 'block' THEN 'blocked' ELSE 'passed' END AS row_tag FROM l"""


@query(_SHOWN)
def table_projection(spark, d):
    rows = enrich.rule_labels(named(parsed(spark, d), spark), labels(spark))
    rows = enrich.port_alias(enrich.ip_alias(rows, enrich.networks(spark, NETS), "src"), ports(spark), "dstport")
    return view.table_rows(rows)


@query("SELECT CASE action WHEN 'block' THEN 'blocked' WHEN 'pass' THEN 'passed' ELSE '' END AS row_tag, CAST(count(*) AS BIGINT) AS n FROM l GROUP BY 1")
def row_tag(spark, d):
    return parsed(spark, d).select(view.row_tag().alias("row_tag")).groupBy("row_tag").agg(F.count(F.lit(1)).alias("n"))


def _numbered(spark, d) -> DataFrame:
    return view.dense_index(parsed(spark, d).select("event_id", "action", "src"), "event_id")


_ROW = "SELECT event_id, action, src, CAST(row_number() OVER (ORDER BY event_id) - 1 AS BIGINT) AS row_idx FROM l"


@query(f"SELECT * FROM ({_ROW}) WHERE row_idx < {PAGE}")
def page_first(spark, d):
    return view.first_rows(parsed(spark, d).select("event_id", "action", "src"), PAGE, "event_id")


@query(f"SELECT * FROM ({_ROW}) WHERE row_idx >= {3 * PAGE} AND row_idx < {4 * PAGE}")
def page_middle(spark, d):
    return view.page(_numbered(spark, d), 3, PAGE)


@query(f"SELECT * FROM ({_ROW}) WHERE row_idx >= {PAGE} * (((SELECT count(*) FROM l) - 1) // {PAGE})")
def page_last_clamped(spark, d):
    rows = _numbered(spark, d)
    return view.page(rows, view.clamp_page(10**6, rows.count(), PAGE), PAGE)


@query(f"SELECT event_id, action FROM (SELECT event_id, action, row_number() OVER (ORDER BY event_id) AS r FROM l WHERE action = 'block') WHERE r > {PAGE} AND r <= {PAGE + 500}")
def page_filtered(spark, d):
    return view.page_by_rank(preset("blocked").apply(parsed(spark, d)), 2, 500, order="event_id").select("event_id", "action")


@query(f"SELECT CAST(greatest(1, ceil(count(*) / {PAGE}.0)) AS BIGINT) AS n FROM l")
def total_pages(spark, d):
    n = parsed(spark, d).agg(F.count(F.lit(1)).alias("n"))
    return n.select(F.greatest(F.lit(1), F.ceil(F.col("n") / PAGE)).cast("long").alias("n"))


@query(f"SELECT * FROM ({_ROW}) ORDER BY row_idx DESC LIMIT 50")
def tail_n(spark, d):
    return view.last_rows(parsed(spark, d).select("event_id", "action", "src"), 50, "event_id")


@query("SELECT event_id, action FROM l WHERE event_id >= (SELECT max(event_id) FROM events) - 999")
def tail_view(spark, d):
    return view.tail_view(raw_lines(spark, d), parse_lines, order="event_id").select("event_id", "action")


@query("SELECT CAST((SELECT count(*) FROM events) AS BIGINT) AS n_lines, CAST(count(*) AS BIGINT) AS n_entries, CAST(sum(CASE WHEN action = 'block' THEN 1 ELSE 0 END) AS BIGINT) AS n_matches FROM l")
def view_counts(spark, d):
    lines = raw_lines(spark, d)
    rows = parse_lines(lines)
    return view.counts(lines, rows, preset("blocked").apply(rows))


@query(f"SELECT * FROM ({_ROW}) WHERE row_idx >= 100 AND row_idx < 300")
def row_range(spark, d):
    return view.page(_numbered(spark, d), 1, 200).unionByName(view.page(_numbered(spark, d), 0, 200).where("row_idx >= 100")).where("row_idx < 300")


@query("SELECT event_id, src FROM l ORDER BY src DESC NULLS LAST, event_id LIMIT 100")
def column_sort(spark, d):
    return view.sorted_by(parsed(spark, d), "src", True, order="event_id").limit(100).select("event_id", "src")


@query("SELECT src, CAST(count(*) AS BIGINT) AS n FROM l WHERE src IS NOT NULL GROUP BY src ORDER BY n DESC, src LIMIT 10")
def top_talkers(spark, d):
    return view.top_values(parsed(spark, d).where("src is not null"), "src")


@query("SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS hour, action, CAST(count(*) AS BIGINT) AS n FROM l GROUP BY 1, 2")
def actions_per_hour(spark, d):
    return view.per_hour(parsed(spark, d))


# Sinks: written, and read back.


def _scratch(spark: SparkSession, name: str) -> str:
    """A folder that all executors share."""
    path = export.scratch(spark, name)
    if path is None:
        raise ValidationError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return path


@query(f"SELECT {quoted(PARSED)} FROM l")
def export_json_roundtrip(spark, d):
    path = _scratch(spark, "json")
    export.write_json(parsed(spark, d), path)
    return spark.read.schema(", ".join(f"`{n}` string" for n in PARSED)).json(path)


@query(f"SELECT {', '.join(f'coalesce({chr(34)}{n}{chr(34)}, {chr(39)}{chr(39)}) AS {chr(34)}{n}{chr(34)}' for n in PARSED)} FROM l")
def export_csv_roundtrip(spark, d):
    path = _scratch(spark, "csv")
    export.write_csv(parsed(spark, d), path)
    return spark.read.option("header", True).option("nullValue", "\u0001").option("escape", '"').csv(path).select(*PARSED).fillna("")


@query("SELECT event_id, action FROM l WHERE action = 'block' AND ts >= TIMESTAMP '2024-01-03 00:00:00' AND ts < TIMESTAMP '2024-01-04 00:00:00'")
def parquet_pruned(spark, d):
    """Rows stored by day: the filter reads one day's folders and the row groups that may hold blocks."""
    path = _scratch(spark, "parquet")
    export.write_parquet(parsed(spark, d).select("event_id", "action", "ts_effective"), path)
    return spark.read.parquet(path).where("day = date'2024-01-03' and action = 'block'").select("event_id", "action")


# Files: text logs, the XML configuration and a rules dump, written to the shared folder and read as sources.

_LINE_NUMBER = "SELECT event_id, CAST(row_number() OVER (ORDER BY event_id) - 1 AS BIGINT) AS row_idx FROM events"


def _log_files(spark: SparkSession, d: str) -> str:
    """The lines as text files, whose names order as the events do."""
    path = _scratch(spark, "text")
    raw_lines(spark, d).repartitionByRange(4, "event_id").sortWithinPartitions("event_id").select("value").write.text(path)
    return path


@query(f"SELECT n.row_idx, l.action, l.src, l.dst FROM l JOIN ({_LINE_NUMBER}) n ON n.event_id = l.event_id")
def scan_text_files(spark, d):
    return parse_lines(read_lines(spark, _log_files(spark, d), numbered=True)).select("row_idx", "action", "src", "dst")


@query(f"SELECT n.row_idx, l.action FROM l JOIN ({_LINE_NUMBER}) n ON n.event_id = l.event_id WHERE n.row_idx < 300")
def scan_max_lines(spark, d):
    return parse_lines(read_lines(spark, _log_files(spark, d), max_lines=300)).select("row_idx", "action")


@query("SELECT src, dst, dstport FROM l WHERE action = 'block'")
def stream_blocked(spark, d):
    """The same steps as a stream over the files, run until they are read."""
    out = _scratch(spark, "stream")
    rows = stream_rows(spark, _log_files(spark, d), spec=preset("blocked")).select("src", "dst", "dstport")
    rows.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{out}/rows")


XML = """<config><interfaces><lan><if>vtnet0</if><descr>LAN</descr></lan><wan><if>vtnet1</if></wan><opt><descr>none</descr></opt></interfaces>
<x><Firewall><Alias><aliases><alias><enabled>1</enabled><name>Web</name><type>port</type><content>80,8080:8081</content></alias>
<alias><name>Servers</name><type>host</type><content>10.0.0.1&#10;10.0.0.2</content></alias><alias><enabled>0</enabled><name>Off</name><type>host</type><content>1.1.1.1</content></alias></aliases></Alias></Firewall></x></config>"""


def _whole_file(spark: SparkSession, text: str) -> str:
    path = _scratch(spark, "file")
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)
    return path


@query("WITH v(physical, display) AS (VALUES ('vtnet0', 'LAN'), ('vtnet1', 'WAN')) SELECT * FROM v")
def xml_interfaces(spark, d):
    return config.interfaces(spark, _whole_file(spark, XML))


@query("WITH v(item, alias) AS (VALUES ('10.0.0.1', 'Servers'), ('10.0.0.2', 'Servers'), ('80', 'Web'), ('8080', 'Web'), ('8081', 'Web')) SELECT * FROM v")
def xml_aliases(spark, d):
    nets, ports_ = config.aliases(spark, _whole_file(spark, XML))
    return nets.select("item", "alias").unionByName(ports_.select(F.col("port").alias("item"), "alias"))


@query("WITH v(rid, description) AS (VALUES ('5f0c5f0c5f0c5f0c5f0c5f0c5f0c5f0c', 'Mail gate (v6) out'), ('77aa01', 'Printer floor'), ('c0ffee9', 'Time servers'), ('h2', 'next line')) SELECT * FROM v")
def rules_file(spark, d):
    return rules.read_rules(spark, _whole_file(spark, RULES_DUMP))


@query(f"SELECT l.action, l.src FROM l JOIN ({_LINE_NUMBER}) n ON n.event_id = l.event_id WHERE n.row_idx >= (SELECT count(*) FROM events) - 120")
def scan_tail(spark, d):
    """The last 120 lines, read from the end of the files, and parsed."""
    last = read_tail(spark, _log_files(spark, d), 120)
    return parse_lines(spark.createDataFrame([(x,) for x in last], "value string")).select("action", "src")


@query("SELECT event_id, src FROM l WHERE action = 'block'")
def scan_iterated(spark, d):
    """A view's rows as the driver's iterator gives them."""
    rows = preset("blocked").apply(parsed(spark, d)).select("event_id", "src")
    return spark.createDataFrame(list(iterate(rows)), rows.schema)


@query("WITH v(row_idx, \"value\") AS (VALUES (CAST(0 AS BIGINT), 'grün'), (CAST(1 AS BIGINT), ''), (CAST(2 AS BIGINT), 'ab'), (CAST(3 AS BIGINT), 'last')) SELECT * FROM v")
def scan_bytes(spark, d):
    """Lines that end in each way, with bytes that are no UTF-8."""
    path = _scratch(spark, "bytes")
    raw = b"gr\xc3\xbcn\r\n\ra\xffb\nlast".hex()
    spark.range(1).coalesce(1).select(F.unhex(F.lit(raw)).cast("string").alias("value")).write.text(path)
    return read_lines(spark, path, numbered=True).select("row_idx", scrubbed(F.col("value")).alias("value"))


@query("WITH v(error) AS (VALUES ('SourceError')) SELECT * FROM v")
def scan_missing(spark, d):
    try:
        return read_lines(spark, f"{_scratch(spark, 'missing')}/none.log").select(F.lit("").alias("error"))
    except SourceError as e:
        return spark.createDataFrame([(type(e).__name__,)], "error string")


@query("SELECT action, src, dst, srcport, seq FROM l WHERE action = 'block' AND coalesce(protoname, '') = 'tcp'")
def export_view(spark, d):
    """A filtered view in one file of the driver, as a user saves it, and read back there, some rows at a time."""
    rows = FilterSpec().where("action", "==", "block").where("protoname", "==", "tcp").apply(parsed(spark, d))
    names, out = ("action", "src", "dst", "srcport", "seq"), _scratch(spark, "saved")
    schema = ", ".join(f"{n} string" for n in names)
    with tempfile.TemporaryDirectory() as folder:
        path = os.path.join(folder, "view.json")
        export.write_single(rows, path)
        saved = (tuple(r.get(n) for n in names) for r in export.saved_rows(path))
        while some := list(islice(saved, SAVED_ROWS)):
            spark.createDataFrame(some, schema, verifySchema=False).coalesce(1).write.mode("append").parquet(out)
    return spark.read.schema(schema).parquet(out)


_DETAILS = [("raw_line", "raw_line"), *[(n, f'"{n}"') for n in PARSED], ("interface_display", "interface"), ("timestamp", "strftime(ts, '%Y-%m-%d %H:%M:%S')"), ("host", "'firewall'"), ("digest", "md5(raw_line)")]


@query("SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{n}' AS field, {c} AS \"value\" FROM l WHERE event_id = (SELECT event_id FROM l ORDER BY event_id LIMIT 1 OFFSET 10)" for n, c in _DETAILS) + ") WHERE \"value\" IS NOT NULL")
def row_details(spark, d):
    return view.details(view.first_rows(parsed(spark, d), 11, "event_id"), 10)


@query("WITH v(name, n) AS (VALUES ('interfaces', 2.0::DOUBLE), ('ip_aliases', 2.0), ('port_aliases', 3.0), ('total_labels', 4.0), ('cached_chunks', 3.0), ('cached_entries', 4096.0), ('memory_mb', 2.0)) SELECT * FROM v")
def statistics(spark, d):
    """Counts of the configuration, the rule labels and held rows."""
    found = config.config_stats(spark, _whole_file(spark, XML)) | rules.label_stats(rules.read_rules(spark, _whole_file(spark, RULES_DUMP))) | view.memory_info(3, 4096)
    return spark.createDataFrame([(k, float(v)) for k, v in found.items()], "name string, n double")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
