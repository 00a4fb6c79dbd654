import hashlib

from pyspark.sql import functions as F

from emberwall.llm import chat
from emberwall.llm.queries import HOSTILE

PART = "array<struct<kind:string,text:string,ref:string,units:bigint>>"


def plain(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return df.select("conv_id", "turn", "role", chat.text_parts(F.col("text")).alias("parts"))


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_round_trip_and_loss(spark):
    rows = [(1, 2, "user", "later"), (1, 0, "user", "é <turn:x> \\l \\\\ </turn>\n"), (1, 1, "assistant", "1 < 2 > 0 \\b 😀"), (1, 3, "assistant", None), (2, 0, "assistant", ""), (-7, 0, "user", HOSTILE), (-7, 1, "assistant", HOSTILE)]
    rows += [(3, 0, "a>b<\\", "x"), (3, None, None, "first"), (4, 0, "user", "same"), (4, 0, "user", "same"), (4, 0, "assistant", "tie"), (None, 0, "user", "lost")]
    got = {r["conv_id"]: r for r in chat.report(chat.format_conversations(plain(spark, rows))).collect()}
    order = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    for conv in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == conv), key=order)
        whole = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in mine)
        loss = "".join(r[3] or "" for r in mine if r[2] == "assistant")
        r = got[conv]
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == (len(mine), digest(whole), len(loss), digest(loss))


def test_template(spark):
    r = chat.format_conversations(plain(spark, [(1, 0, "user", "a<b"), (1, 1, "assistant", "ok")])).first()
    assert r["formatted"] == "<turn:user>a\\lb</turn>\n<turn:assistant>ok</turn>\n"
    assert r["starts"] == [0, 23] and [[tuple(s) for s in t] for t in r["spans"]] == [[], [(16, 2)]]
    assert r["formatted"][23 + 16 : 23 + 18] == "ok"


def test_parts(spark):
    parts = [("text", "see ", None, None), ("image", None, "s3://x/1.png", 3), ("text", " and <image:0.1>", None, None), ("audio", None, "a.wav", 10), ("document", None, "d.pdf", None), ("odd", None, "z", 1), (None, "t", None, None)]
    df = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", [("text", "one", None, None), ("image", None, "i", 1), ("text", "two", None, None)]), (1, 2, "user", None), (1, 3, "user", [])], f"conv_id long, turn long, role string, parts {PART}")
    f = chat.format_conversations(df)
    r = f.first()
    assert r["formatted"].startswith("<turn:user>see <image:0.1> and \\limage:0.1\\g<audio:0.3><document:0.4><document:0.5><document:0.6></turn>\n<turn:assistant>one<image:1.1>two</turn>\n<turn:user></turn>\n")
    assert [tuple(a) for a in r["attachments"]] == [(0, 1, "image", "s3://x/1.png", 768), (0, 3, "audio", "a.wav", 250), (0, 4, "document", "d.pdf", 1024), (0, 5, "document", "z", 1024), (0, 6, "document", None, 1024), (1, 1, "image", "i", 256)]
    assert chat.report(f).first()["loss_sha256"] == digest("onetwo")


def test_empty_and_long(spark):
    assert chat.report(chat.format_conversations(plain(spark, []))).collect() == []
    rows = [(1, k, "assistant" if k % 2 else "user", f"{k} é\\<" * 20) for k in range(3000)]
    r = chat.report(chat.format_conversations(plain(spark, rows))).first()
    assert r["loss_sha256"] == digest("".join(x[3] for x in rows if x[2] == "assistant")) and r["n_turns"] == 3000


def test_native(spark):
    plan = chat.report(chat.format_conversations(plain(spark, [(1, 0, "user", "a")])))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
