import csv
import io
import json
import tracemalloc

import pytest
from pyspark.sql import functions as F

from emberwall.errors import ExportError, SourceError
from emberwall.logframe import LogFrame
from emberwall.operators import export, view
from emberwall.plans import catalog
from emberwall.sources.text import read_lines, read_tail
from tests.test_parse import NO_ECN, TCP_LINE


def log(tmp_path, lines, name="x.log"):
    p = tmp_path / name
    p.write_text("\n".join(lines) + "\n", encoding="utf-8")
    return str(p)


@pytest.fixture(scope="module")
def frame(spark, tmp_path_factory):
    lines = [TCP_LINE.replace("29397", str(k)).replace("pass", "block" if k % 4 == 0 else "pass") for k in range(100)]
    lines.insert(7, "not a packet line")
    return LogFrame.load(spark, log(tmp_path_factory.mktemp("log"), lines))


def test_line_numbers_follow_the_file(spark, tmp_path):
    path = log(tmp_path, [f"Line {k} " + "x" * 80 for k in range(5000)])
    spark.conf.set("spark.sql.files.maxPartitionBytes", 50_000)
    try:
        lines = read_lines(spark, path, numbered=True)
        assert lines.rdd.getNumPartitions() > 3
        rows = lines.orderBy("row_idx").collect()
        assert [r["row_idx"] for r in rows] == list(range(5000)) and all(r["value"].startswith(f"Line {k} ") for k, r in enumerate(rows))
        assert [x.split()[1] for x in read_tail(spark, path, 5)] == ["4995", "4996", "4997", "4998", "4999"]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_several_files_and_newlines(spark, tmp_path):
    (tmp_path / "a.log").write_bytes(b"1\r\n2\r3\n4")
    (tmp_path / "b.log").write_bytes("ü\n".encode())
    lines = read_lines(spark, [str(tmp_path / "a.log"), str(tmp_path / "b.log")], numbered=True).orderBy("row_idx")
    assert [r["value"] for r in lines.collect()] == ["1", "2", "3", "4", "ü"]


def test_tail_edges(spark, tmp_path):
    path = log(tmp_path, [f"Line {k}" for k in range(1, 11)])
    assert read_tail(spark, path, 0) == [] and read_tail(spark, path, 99)[0] == "Line 1"
    assert read_tail(spark, path, 5) == [f"Line {k}" for k in range(6, 11)]


def test_missing_file(spark, tmp_path):
    with pytest.raises(SourceError):
        read_lines(spark, str(tmp_path / "none.log"))


def test_max_lines_count_physical_lines(spark, tmp_path):
    path = log(tmp_path, ["bad", TCP_LINE, TCP_LINE])
    assert LogFrame.load(spark, path, max_lines=2).count() == 1
    assert LogFrame.load(spark, path, max_lines=0).count() == 2


def test_empty_file(spark, tmp_path):
    (tmp_path / "e.log").write_text("")
    f = LogFrame.load(spark, str(tmp_path / "e.log"))
    assert f.count() == 0 and f.total_pages() == 1 and f.page(3).collect() == []


def test_counts_and_pages(frame):
    assert tuple(frame.preset("blocked").counts()) == (101, 100, 25)
    assert frame.total_pages(30) == 4
    ports = [r["srcport"] for r in frame.page(1, 30).collect()]
    assert ports == [str(k) for k in range(30, 60)]
    assert len(frame.page(99, 30).collect()) == 10
    assert [r["srcport"] for r in frame.preset("blocked").page(1, 10).collect()] == [str(4 * k) for k in range(10, 20)]
    assert [r["srcport"] for r in frame.tail(2).collect()] == ["98", "99"]


def test_table_row(frame):
    r = frame.preset("blocked").page(0, 1).first()
    assert (r["timestamp"], r["action"], r["interface"], r["protoname"], r["label"], r["row_tag"]) == ("2025-09-08 20:31:34", "block", "vtnet0", "tcp", "", "blocked")


def test_dimensions_and_filters(frame):
    f = frame.with_interfaces({"vtnet0": "LAN"}).with_labels({"cd4617bd680a0a5aa4c5694f2eefa56e": "Allow out"})
    assert f.where("interface", "==", "LAN").count() == 100 and f.where("Label", "contains", "allow").count() == 100
    assert f.where("srcport", ">=", "90").summary == "srcport >= '90'"
    assert f.where("srcport", ">=", "90").without_filter().count() == 100
    assert f.page(0, 1).first()["label"] == "Allow out"


def test_details_and_sort(frame):
    shown = {r["field"]: r["value"] for r in frame.details(0).collect()}
    assert shown["srcport"] == "0" and shown["host"] == "firewall" and "raw_line" in shown
    assert frame.sorted_by("dstport", True).first()["row_idx"] == 0


def test_dense_index(spark):
    df = spark.range(1000).selectExpr("(id * 37) % 1000 as k")
    got = view.dense_index(df, "k").orderBy("k").collect()
    assert [r["row_idx"] for r in got] == [r["k"] for r in got] == list(range(1000))


def test_dense_index_with_random_ranges(spark):
    """Enough rows for ranges that are cut from a sample, and wide ones, which are dealt into more tasks than their keys."""
    df = spark.range(200_000).selectExpr("(id * 37) % 200000 as k", "repeat(md5(string(id)), 4) as text")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "2m")
    try:
        got = view.dense_index(df, "k")
        assert got.where("row_idx = k and length(text) = 128").count() == 200_000
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")


@pytest.mark.parametrize("order", [["t"], ["z"], ["s"], ["s", "k"], ["z", "k"]])
def test_dense_index_of_other_orders(spark, order):
    """Times with and without a zone, texts, and several columns; NULL comes first."""
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        df = spark.range(3000).selectExpr("id as k", "timestamp_seconds(nullif((id * 7) % 3000, 0) * 5 + 1729981000) as t", "nullif((id * 11) % 3000, 0) as n")
        df = df.select("k", "t", F.expr("timestamp_ntz'2024-03-31 01:00:00' + make_dt_interval(0, 0, 0, n * 5.5)").alias("z"), F.when(F.col("n").isNotNull(), F.format_string("%05d", "n")).alias("s"))
        got = view.dense_index(df, *order).orderBy("row_idx").select("k", "row_idx").collect()
        assert [r["row_idx"] for r in got] == list(range(3000))
        assert [r["k"] for r in got] == [r["k"] for r in df.coalesce(1).sortWithinPartitions(*order).select("k").collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


@pytest.mark.parametrize("kind", ["n + 0.5D", "if(n % 2 = 0, double('nan'), -n)", "cast(n / 7 as decimal(20, 9))", "date'2024-01-01' + n", "unhex(hex(n + 128))", "n > 1500", "cast(n as float)", "struct(n % 3 as a, string(n) as b)"])
def test_dense_index_of_other_types(spark, kind):
    """A column of any type that sorts, in another case or inside another."""
    df = spark.range(3000).selectExpr("id as k", "cast((id * 7) % 3000 as int) as n").selectExpr("k", f"struct({kind} as v) as x", f"{kind} as Value")
    want = [r["k"] for r in df.coalesce(1).sortWithinPartitions("value", "k").select("k").collect()]
    for order in (["value", "k"], ["x.v", "k"]):
        got = view.dense_index(df, *order).orderBy("row_idx").select("k", "row_idx").collect()
        assert [r["row_idx"] for r in got] == list(range(3000)) and [r["k"] for r in got] == want
    assert view.dense_index(df, "value").selectExpr("count(distinct row_idx)").first()[0] == 3000


def test_dense_index_of_no_rows(spark):
    assert view.dense_index(spark.range(0), "id").collect() == []


def test_exports(frame, spark, tmp_path):
    blocked = frame.preset("blocked")
    assert blocked.export(str(tmp_path / "a.json")) == 25
    rows = json.loads((tmp_path / "a.json").read_text())
    assert len(rows) == 25 and rows[1]["srcport"] == "4" and "row_idx" not in rows[0]
    assert blocked.export(str(tmp_path / "a.csv")) == 25
    with open(tmp_path / "a.csv") as f:
        table = list(csv.DictReader(f))
    assert len(table) == 25 and table[0]["ecn"] == ""
    with pytest.raises(ExportError):
        blocked.export(str(tmp_path / "a.txt"))
    with pytest.raises(ExportError):
        blocked.where("src", "==", "nobody").export(str(tmp_path / "b.json"))


def test_single_files_of_odd_rows_in_order(spark, tmp_path):
    """Python's own csv and json give the same; many parts, some empty, and no order lost."""
    odd = ['say "x"', "a,b", "", None, "line\nnext\r\n", " ü\u2028\U0001f600 ", "\x01\\\t/", "]", "["]
    rows = [(k, f"{k:05d}", odd[k % len(odd)]) for k in range(2000)]
    df = spark.createDataFrame(rows, "k int, src string, dst string").repartition(7).orderBy("k")
    assert export.write_single(df, str(tmp_path / "a.csv")) == export.write_single(df, str(tmp_path / "a.json")) == 2000
    want = io.StringIO()
    csv.writer(want).writerows([("src", "dst"), *[(s, d or "") for _, s, d in rows]])
    assert (tmp_path / "a.csv").read_bytes() == want.getvalue().encode()
    objects = [{"src": s} | ({} if d is None else {"dst": d}) for _, s, d in rows]
    assert json.loads((tmp_path / "a.json").read_text(encoding="utf-8")) == list(export.saved_rows(str(tmp_path / "a.json"))) == objects
    one = df.select("k", F.col("dst").alias("src")).where("k in (2, 3)").orderBy("k")
    export.write_single(one, str(tmp_path / "one.csv"))
    assert (tmp_path / "one.csv").read_bytes() == b'src\r\n""\r\n""\r\n'


def test_single_file_without_a_shared_folder(spark, frame, tmp_path, monkeypatch):
    frame.export(str(tmp_path / "a.json")), frame.export(str(tmp_path / "a.csv"))
    monkeypatch.setattr(export, "scratch", lambda *_: None)
    for kind in ("json", "csv"):
        assert frame.export(str(tmp_path / f"b.{kind}")) == 100
        assert (tmp_path / f"a.{kind}").read_bytes() == (tmp_path / f"b.{kind}").read_bytes()
    with pytest.raises(ExportError):
        frame.where("src", "==", "nobody").export(str(tmp_path / "c.json"))


def test_saved_view_is_not_held_by_the_driver(spark, tmp_path, monkeypatch):
    """Neither a partition of the view, nor the whole file when it is read back."""
    n = 60_000
    events = spark.range(n).selectExpr("id as event_id", "timestamp_seconds(1704067200 + id) as ts", "id % 999 as user_id", "'error' as event_type", "0.5D as value")
    events.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    monkeypatch.setattr(catalog, "SAVED_ROWS", 5000, raising=False)
    monkeypatch.setattr(type(events), "toLocalIterator", lambda *_, **__: pytest.fail("rows go to the driver by partitions"))
    tracemalloc.start()
    try:
        rows = catalog.export_view(spark, str(tmp_path))
        assert tracemalloc.get_traced_memory()[1] < 16e6
    finally:
        tracemalloc.stop()
    tcp = [k for k in range(n) if k % 50 and k % 11 and k % 13 and k % 17]
    assert rows.count() == len(tcp) and rows.selectExpr("sum(cast(seq as long))").first()[0] == sum(tcp)


def test_rows_of_all_kinds_in_one_csv(spark, tmp_path):
    f = LogFrame.load(spark, log(tmp_path, [NO_ECN["icmp"], TCP_LINE]))
    export.write_csv(f.rows, str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).count() == 2
    export.write_json(f.rows, str(tmp_path / "js"))
    assert len(json.loads(export.json_array(f.rows).first()["json"])) == 2


def test_iterates(frame):
    assert sum(1 for _ in frame) == 100


def test_memory_info():
    assert view.memory_info(50, 50_000)["memory_mb"] == pytest.approx(24.4, abs=0.02)
