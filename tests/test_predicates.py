import datetime as dt
import itertools

import pytest

from emberwall.errors import FilterError
from emberwall.functions.predicates import FilterSpec, Condition, as_number, preset, row_udf
from pyspark.sql import functions as F

ROW = {"action": "pass", "interface": "em0", "interface_display": "LAN Network", "src": "192.168.1.100", "dst": "10.0.0.50", "srcport": "12345", "dstport": "80", "protoname": "tcp", "rulenr": "100", "rid": "12345"}


@pytest.fixture(scope="module")
def rows(spark):
    schema = ", ".join(f"{k} string" for k in ROW) + ", ts_effective timestamp_ntz, rule_label string"
    return spark.createDataFrame([(*ROW.values(), dt.datetime(2024, 1, 15, 10), "Block SMTP")], schema)


def holds(rows, spec):
    return spec.apply(rows).count() == 1


@pytest.mark.parametrize(
    ("name", "operator", "value", "options", "want"),
    [
        ("action", "==", "pass", {}, True),
        ("action", "==", "block", {}, False),
        ("action", "!=", "block", {}, True),
        ("src", "contains", "168", {}, True),
        ("src", "startswith", "192", {}, True),
        ("src", "endswith", "100", {}, True),
        ("action", "==", "PASS", {}, True),
        ("action", "==", "PASS", {"case_sensitive": True}, False),
        ("src", "regex", r"^192\.", {}, True),
        ("src", "regex", r"^10\.", {}, False),
        ("action", "regex", "^(?P<x>P)ass(?P=x)?$", {}, True),
        ("action", "regex", "^PASS$", {"case_sensitive": True}, False),
        ("src", "regex", "[invalid(regex", {}, False),
        ("src", "regex", "[invalid(regex", {"negate": True}, True),
        ("srcport", ">", "1000", {}, True),
        ("srcport", "<", "1e5", {}, True),
        ("dstport", ">=", "80", {}, True),
        ("dstport", "<=", "79.9", {}, False),
        ("action", ">", "100", {}, False),
        ("dstport", ">", "abc", {}, False),
        ("dstport", "<", "nan", {}, False),
        ("dstport", "<", "inf", {}, True),
        ("interface", "==", "em0", {}, True),
        ("interface", "==", "lan network", {}, True),
        ("interface", "==", "WAN", {}, False),
        ("interface", "!=", "em0", {}, True),
        ("nonexistent", "==", "value", {}, False),
        ("nonexistent", "!=", "value", {}, True),
        ("nonexistent", ">", "1", {"negate": True}, True),
        ("Source IP", "==", "192.168.1.100", {}, True),
        ("Label", "contains", "smtp", {}, True),
        ("src", "~~", "x", {}, False),
    ],
)
def test_conditions(rows, name, operator, value, options, want):
    assert holds(rows, FilterSpec().where(name, operator, value, **options)) is want


def test_numbers(spark):
    texts = ["1", " 2 ", "1_000", "10d", "10f", "0x10", "", ".5", "5.", "1e3", "nan", "inf", "-Infinity", "1__0", "_1"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(as_number(F.col("t"))).collect()]

    def python(t):
        try:
            return None if (x := float(t)) != x else x
        except ValueError:
            return None

    assert got == [python(t) for t in texts]


def truth(values, connectives, assoc):
    join = lambda how, a, b: (a and b) if how == "AND" else (a or b)
    if assoc == "left":
        out = values[0]
        for how, v in zip(connectives, values[1:], strict=True):
            out = join(how, out, v)
        return out
    return values[0] if len(values) == 1 else join(connectives[0], values[0], truth(values[1:], connectives[1:], assoc))


def test_folds(spark):
    """Every combination of up to four conditions and connectives, in both associations."""
    one = spark.range(1).select(F.lit("1").alias("t"))
    cases, columns = [], []
    for n in range(1, 5):
        for values in itertools.product([True, False], repeat=n):
            for how in itertools.product(["AND", "OR"], repeat=n - 1):
                for assoc in ("left", "right"):
                    conditions = tuple(Condition("t", "==", "1" if v else "0", connective=c) for v, c in zip(values, ["AND", *how], strict=True))
                    columns.append(FilterSpec(conditions, assoc=assoc).to_column(lambda _: [F.col("t")]))
                    cases.append(truth(list(values), list(how), assoc))
    got = []
    for k in range(0, len(columns), 100):
        got += list(one.select(*[c.alias(str(i)) for i, c in enumerate(columns[k : k + 100])]).first())
    assert got == cases


def test_three_conditions_left(rows, spark):
    spec = FilterSpec().where("action", "==", "pass").where("protoname", "==", "tcp").where("action", "==", "block", connective="OR")
    data = spark.createDataFrame([("pass", "tcp"), ("pass", "udp"), ("block", "udp")], "action string, protoname string")
    kept = lambda s: [tuple(r) for r in s.apply(data).collect()]
    assert kept(spec) == [("pass", "tcp"), ("block", "udp")]
    assert kept(FilterSpec(spec.conditions, assoc="right")) == [("pass", "tcp")]


def test_other_connectives_are_ignored(rows):
    spec = FilterSpec().where("action", "==", "pass").where("action", "==", "block", connective="XOR")
    assert holds(rows, spec)


def test_empty_and_clear(rows):
    assert holds(rows, FilterSpec()) and holds(rows, FilterSpec().where("action", "==", "x").clear())


def test_time_range_is_inclusive(rows):
    assert holds(rows, FilterSpec().between("2024-01-15 10:00:00", "2024-01-15 10:00:00"))
    assert not holds(rows, FilterSpec().between(start="2024-01-15 10:00:01"))
    assert not holds(rows, FilterSpec().between(end="2024-01-15 09:59:59"))
    with pytest.raises(FilterError):
        FilterSpec().between("yesterday")


def test_strict_labels(rows):
    assert not holds(rows, FilterSpec(labels=False).where("Label", "contains", "smtp"))


def test_summary():
    assert FilterSpec().describe() == "No filters active"
    spec = FilterSpec().where("action", "==", "pass", negate=True).where("src", "contains", "10.", connective="OR")
    assert spec.describe() == "NOT action == 'pass' |  OR src contains '10.'"
    assert spec.between("2024-01-15 10:00:00", "2024-01-16 10:00:00").describe().endswith(" | Time range: from 2024-01-15 10:00:00 to 2024-01-16 10:00:00")
    assert FilterSpec().between(end="2024-01-16 10:00:00").describe() == "Time range: to 2024-01-16 10:00:00"
    assert spec.without(0).describe() == "src contains '10.'"


def test_presets(rows):
    assert holds(rows, preset("all")) and holds(rows, preset("allowed")) and holds(rows, preset("tcp"))
    assert not holds(rows, preset("blocked")) and not holds(rows, preset("udp"))
    with pytest.raises(FilterError):
        preset("none")


def test_needs_field_and_value():
    with pytest.raises(FilterError):
        FilterSpec().where("", "==", "x")
    with pytest.raises(FilterError):
        FilterSpec().where("src", "==", "")


def test_row_udf(rows):
    assert row_udf(lambda r: r["dstport"] == "80")(rows).count() == 1
    assert row_udf(lambda r: "nothing" in r)(rows).count() == 0
