import datetime as dt

import pytest

from emberwall.operators.parse import parse_lines, rule_hash
from emberwall.schema import IPV4, PORTS, TCP

# Fixed value: the documented sample of the format.
TCP_LINE = "2025-09-08T20:31:34 Informational filterlog 30,,,cd4617bd680a0a5aa4c5694f2eefa56e,vtnet0,match,pass,out,4,0x0,,62,35294,0,DF,6,tcp,60,10.13.37.2,191.101.31.14,29397,29376,0,S,1162654291,,64240,,mss;sackOK;TS;nop;wscale"


def short_line(number, name, tail, k):
    """A line without the ECN field, of made-up values."""
    fields = [40 + k, 3 * k, f"set{k}", f"{k:032x}", f"igc{k}", "match", ("pass", "block", "pass")[k], ("in", "out", "in")[k], 4, "0x10", 55 + k, 900 + k, 0, "none", number, name, 48 + k, f"172.20.{k}.9", f"203.0.113.{20 + k}", *tail]
    return f"2031-05-0{k + 1}T07:08:09 gate filterlog: y " + ",".join(map(str, fields))


NO_ECN = {"tcp": short_line(6, "tcp", [50_100, 8443, 12, "PA", 77, 1, 512, ""], 0), "udp": short_line(17, "udp", [123, 124, 36], 1), "icmp": short_line(1, "icmp", [], 2)}


def parse(spark, *lines, **options):
    rows = spark.createDataFrame([(x,) for x in lines], "value string")
    return parse_lines(rows, **options).collect()


def test_whole_line(spark):
    (r,) = parse(spark, TCP_LINE)
    want = {"rulenr": "30", "rid": "cd4617bd680a0a5aa4c5694f2eefa56e", "interface": "vtnet0", "action": "pass", "dir": "out", "ecn": "", "ttl": "62", "ipflags": "DF"}
    want |= {"protonum": "6", "protoname": "tcp", "src": "10.13.37.2", "dst": "191.101.31.14", "srcport": "29397", "dstport": "29376", "datalen": "0"}
    want |= {"tcpflags": "S", "seq": "1162654291", "ack": "", "urp": "64240", "tcpopts": "", "raw_line": TCP_LINE, "interface_display": "vtnet0"}
    assert {k: r[k] for k in want} == want
    assert r["ts"] == dt.datetime(2025, 9, 8, 20, 31, 34) and r["__timestamp__"] == "2025-09-08T20:31:34"
    assert len(r["__digest__"]) == 32


@pytest.mark.parametrize(
    "line",
    ["", "2031 gate nothing of this kind", "a b filterlog:", "a b c filterlog:", "2025-09-08T20:31:34 filterlog 30,,,x", "   "],
)
def test_rejected(spark, line):
    assert parse(spark, line) == []


def test_short_lines_are_accepted(spark):
    rows = parse(spark, "2024-01-15T10:30:45 host filterlog: 100,200", "three words then filterlog and odd remains")
    assert [(r["rulenr"], r["action"], r["ts"] is None) for r in rows] == [("100", "", False), ("and odd remains", "", True)]
    assert parse(spark, "2024-01-15T10:30:45 host filterlog: 100,200", require_action=True) == []


def test_tag_is_the_first_word_that_holds_it(spark):
    (r,) = parse(spark, "2024-01-15T10:30:45 filterlog-box prog filterlog: 7,8")
    assert r["rulenr"] == "prog filterlog: 7"


def test_ipv6_has_common_fields_only(spark):
    (r,) = parse(spark, TCP_LINE.replace(",out,4,", ",out,6,"))
    assert r["interface"] == "vtnet0" and all(r[c] is None for c in [*IPV4, *PORTS, *TCP])


@pytest.mark.parametrize(("number", "name"), [("2", "2"), ("112", "carp"), ("", ""), ("1", "icmp"), ("17", "udp")])
def test_protocol_names(spark, number, name):
    (r,) = parse(spark, TCP_LINE.replace(",6,tcp,", f",{number},tcp,"))
    assert (r["protonum"], r["protoname"]) == (number, name)
    assert (r["srcport"] is None) == (number != "17") and r["tcpflags"] is None


def test_layouts(spark):
    (r,) = parse(spark, NO_ECN["tcp"])
    assert (r["protonum"], r["src"], r["dst"], r["srcport"]) == ("tcp", "203.0.113.20", "50100", None)
    t, u, i = parse(spark, *NO_ECN.values(), layout="no_ecn")
    assert (t["src"], t["srcport"], t["dstport"], t["tcpflags"], t["ecn"], t["protoname"]) == ("172.20.0.9", "50100", "8443", "PA", "", "tcp")
    assert (u["dst"], u["dstport"], u["protoname"]) == ("203.0.113.21", "124", "udp")
    assert (i["src"], i["dst"], i["srcport"], i["protoname"]) == ("172.20.2.9", "203.0.113.22", None, "icmp")
    with pytest.raises(ValueError, match="layout"):
        parse(spark, TCP_LINE, layout="odd")


def test_times(spark):
    late = dt.datetime(2020, 1, 1)
    rows = parse(spark, "Sep  8 20:31:34 host filterlog[9]: 30,1", "2024-01-15T10:30:45+02:00 a filterlog 1,2", "2024 x a filterlog 1,2", fallback_ts=late)
    assert [(r["ts"], r["ts_effective"]) for r in rows] == [(None, late), (dt.datetime(2024, 1, 15, 10, 30, 45),) * 2, (None, late)]


def test_blanks_and_bytes(spark, tmp_path):
    (tmp_path / "x.log").write_bytes(b"\t2024-01-15T10:30:45\thost  filterlog:\t 1 , 2,\xff3,r,em0 \r\n")
    (r,) = parse_lines(spark.read.text(str(tmp_path / "x.log"))).collect()
    assert (r["rulenr"], r["subrulenr"], r["anchorname"], r["interface"]) == ("1", "2", "3", "em0")
    assert not r["raw_line"].startswith("\t") and r["raw_line"].endswith("em0")


def test_digest_differs(spark):
    a, b = parse(spark, TCP_LINE, TCP_LINE + "x")
    assert a["__digest__"] != b["__digest__"]


def test_extra_columns_stay(spark):
    df = spark.createDataFrame([(5, TCP_LINE)], "id long, value string").withColumnRenamed("id", "event id")
    assert parse_lines(df).select("event id").collect()[0][0] == 5


def test_rule_hash(spark):
    rows = parse_lines(spark.createDataFrame([(TCP_LINE,)], "value string"))
    from pyspark.sql import functions as F

    r = rows.select(rule_hash(F.col("rid"), F.col("raw_line")), rule_hash(F.lit(""), F.col("raw_line"))).first()
    assert r[0] == r[1] == "cd4617bd680a0a5aa4c5694f2eefa56e"


def test_no_python_and_one_match_in_the_plan(spark):
    rows = parse_lines(spark.createDataFrame([(TCP_LINE,)], "value string")).where("action = 'block' and src = 'x' and dst = 'y'")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
    assert plan.count("(?s)^") == 2  # for ASCII and other lines, in one place


def test_compact_times(spark):
    import datetime as dt

    from pyspark.sql import functions as F

    from emberwall.operators.parse import timestamp

    tokens = ["20310501T070809", "20310501T0708", "20310501T070809.5+0200", "2031-05-01T07:08:09", "20311301T070809", "20310501", "x"]
    got = {r["t"]: r["ts"] for r in spark.createDataFrame([(t,) for t in tokens], "t string").select("t", timestamp(F.col("t")).alias("ts")).collect()}
    at = dt.datetime(2031, 5, 1, 7, 8, 9)
    assert [got[t] for t in tokens] == [at, at.replace(second=0), at.replace(microsecond=500000), at, None, None, None]
