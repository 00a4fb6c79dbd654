from emberwall.functions.predicates import preset
from emberwall.streaming.live import action_counts, stream_rows
from tests.test_parse import TCP_LINE


def test_stream_equals_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.log").write_text("\n".join([TCP_LINE, TCP_LINE.replace("pass", "block"), "noise"]) + "\n")
    dim = spark.createDataFrame([("vtnet0", "LAN")], "physical string, display string")
    rows = stream_rows(spark, str(tmp_path / "in"), spec=preset("blocked"), interfaces=dim)
    q = rows.writeStream.format("memory").queryName("blocked_rows").start()
    q.processAllAvailable()
    (tmp_path / "in" / "b.log").write_text(TCP_LINE.replace("pass", "block") + "\n")
    q.processAllAvailable()
    q.stop()
    got = spark.table("blocked_rows").collect()
    assert [r["interface_display"] for r in got] == ["LAN", "LAN"]


def test_windows(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.log").write_text("\n".join([TCP_LINE] * 3 + [TCP_LINE.replace("20:31", "20:36")]) + "\n")
    q = action_counts(stream_rows(spark, str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("by_action").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r["action"], r["n"]) for r in spark.table("by_action").collect()) == [("pass", 1), ("pass", 3)]
