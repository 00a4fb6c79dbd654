import ipaddress
import random

from pyspark.sql import functions as F

from emberwall.functions.netaddr import ipv4_number
from emberwall.operators import enrich
from emberwall.sources import config, rules

XML = """<?xml version="1.0"?><config>
<interfaces><lan><if>ix0</if><descr>Office floor</descr></lan><wan><if>ix1</if></wan><opt><descr>no name</descr></opt></interfaces>
<sys><Firewall><Alias><aliases>
<alias><enabled>1</enabled><name>Cameras</name><type>host</type><content>172.31.4.11\n172.31.4.12</content></alias>
<alias><name>Inside</name><type>network</type><content>10.0.0.0/8,172.16.77.3/12</content></alias>
<alias><enabled>1</enabled><name>DoorPorts</name><type>port</type><content>81,444\n7000:7010</content></alias>
<alias><enabled>0</enabled><name>Off</name><type>host</type><content>1.1.1.1</content></alias>
<alias><enabled>1</enabled><name>Geo</name><type>mac</type><content>zz</content></alias>
</aliases></Alias></Firewall></sys></config>"""


def test_interfaces(spark, tmp_path):
    p = tmp_path / "c.xml"
    p.write_text(XML)
    assert config.interface_names(spark, str(p)) == {"ix0": "Office floor", "ix1": "WAN"}
    assert config.config_stats(spark, str(p)) == {"interfaces": 2, "ip_aliases": 4, "port_aliases": 13}


def test_aliases(spark, tmp_path):
    p = tmp_path / "c.xml"
    p.write_text(XML)
    nets, ports = config.aliases(spark, str(p))
    assert {r["item"]: r["alias"] for r in nets.collect()} == {"172.31.4.11": "Cameras", "172.31.4.12": "Cameras", "10.0.0.0/8": "Inside", "172.16.77.3/12": "Inside"}
    assert {r["port"] for r in ports.collect()} == {"81", "444", *map(str, range(7000, 7011))}


def test_unusable_configuration(spark, tmp_path):
    p = tmp_path / "bad.xml"
    p.write_text("<config><interfaces>")
    for path in (str(p), str(tmp_path / "none.xml")):
        nets, ports = config.aliases(spark, path)
        assert config.interface_names(spark, path) == {} and nets.count() == 0 and ports.count() == 0


def test_references_resolve_one_level(spark):
    rows = [(0, "1", "Gate", "host", "172.31.4.11"), (1, "1", "AllCameras", "host", "Gate\n172.31.4.12")]
    got = enrich.resolve_aliases(spark.createDataFrame(rows, config.RAW_ALIAS))
    assert {r["item"]: r["alias"] for r in got.collect()} == {"172.31.4.11": "AllCameras", "172.31.4.12": "AllCameras", "Gate": "AllCameras"}


def first_match(nets, ip):
    try:
        address = ipaddress.ip_address(ip)
    except ValueError:
        return None
    for item, alias in nets:
        try:
            if "/" in item and address in ipaddress.ip_network(item, strict=False):
                return alias
        except ValueError:
            pass
    return None


def test_first_network_in_order(spark):
    rng = random.Random(3)
    nets = [(f"10.{rng.randrange(4)}.{rng.randrange(256)}.{rng.randrange(256)}/{rng.choice([8, 12, 16, 20, 24, 30, 32])}", f"n{k}") for k in range(40)]
    nets = list({n: (n, a) for n, a in nets}.values()) + [("bad/8", "bad"), ("300.1.1.1/8", "worse"), ("0.0.0.0/0", "any"), ("10.0.0.0/8", "late"), ("fe80::/10", "six")]
    ips = [f"10.{rng.randrange(5)}.{rng.randrange(256)}.{rng.randrange(256)}" for _ in range(300)] + ["bad", "10.0.0.300", "", "010.0.0.1", "8.8.8.8", "10.0.0.1 "]
    rows = spark.createDataFrame([(i,) for i in [*ips, None]], "src string")
    dim = enrich.networks(spark, nets)
    for strategy in ("array", "prefix"):
        got = {r["src"]: r["src_alias"] for r in enrich.ip_alias(rows, dim, "src", strategy).collect()}
        assert got == {**{i: first_match(nets, i) for i in ips}, None: None}


def test_exact_wins_and_order_matters(spark):
    rows = spark.createDataFrame([("10.1.2.3",), ("10.0.0.1",)], "src string")
    a = enrich.networks(spark, [("10.0.0.0/8", "A"), ("10.1.0.0/16", "B"), ("10.0.0.1", "Host")])
    b = enrich.networks(spark, [("10.1.0.0/16", "B"), ("10.0.0.0/8", "A")])
    of = lambda n: [r["src_alias"] for r in enrich.ip_alias(rows, n, "src").collect()]
    assert of(a) == ["A", "Host"] and of(b) == ["B", "A"]


def test_last_alias_keeps_first_place(spark):
    dim = enrich.networks(spark, [("10.0.0.0/8", "old"), ("10.1.0.0/16", "B"), ("10.0.0.0/8", "new")])
    rows = spark.createDataFrame([("10.1.2.3",)], "src string")
    assert enrich.ip_alias(rows, dim, "src").first()["src_alias"] == "new"


def test_duplicate_dimension_keys_do_not_multiply_rows(spark):
    rows = spark.createDataFrame([("80",), ("81",)], "dstport string")
    ports = spark.createDataFrame([("80", "one", 0), ("80", "two", 1)], "port string, alias string, ord long")
    assert [r["dstport_alias"] for r in enrich.port_alias(rows, ports, "dstport").collect()] == ["two", None]


def test_no_range_join(spark):
    rows = spark.createDataFrame([("10.1.2.3",)], "src string")
    dim = enrich.networks(spark, [("10.0.0.0/8", "A")])
    plan = enrich.ip_alias(rows, dim, "src", "prefix")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_ports(spark):
    df = spark.createDataFrame([(x,) for x in ("8080:8082", "20-21", "90:80", "abc:def", "7", "1:2:3")], "p string")
    assert [r[0] for r in df.select(enrich.expanded_ports(F.col("p"))).collect()] == [["8080", "8081", "8082"], ["20", "21"], [], ["abc:def"], ["7"], ["1:2:3"]]


def test_ipv4_numbers(spark):
    df = spark.createDataFrame([(x,) for x in ("0.0.0.0", "255.255.255.255", "1.2.3", "256.1.1.1", "01.1.1.1", None)], "p string")
    assert [r[0] for r in df.select(ipv4_number(F.col("p"))).collect()] == [0, 2**32 - 1, None, None, None, None]


def test_decorated(spark):
    df = spark.createDataFrame([("80", "HTTP"), ("", "x"), ("81", None)], "v string, a string")
    assert [r[0] for r in df.select(enrich.decorated(F.col("v"), F.col("a"))).collect()] == ["80 (HTTP)", "", "81"]


def test_rule_labels(spark):
    dump = 'a label "h1" # First\nb label "h2"\r\n# next line\r\nc label "h1" # Second \nlabel none'
    got = {r["rid"]: r["description"] for r in rules.extract_labels(spark.createDataFrame([(dump,)], "value string")).collect()}
    assert got == {"h1": "Second", "h2": "next line"}
    assert rules.extract_labels(spark.createDataFrame([("no labels",)], "value string")).count() == 0
