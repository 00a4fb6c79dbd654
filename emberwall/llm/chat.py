"""Chat formatting: typed content parts to one string per conversation, with a loss mask.

The template, where a turn's role and body are escaped:

    <turn:ROLE>BODY</turn>\\n

In a body, an attachment is a placeholder <KIND:TURN.PART> (both from 0). In texts and roles a
backslash becomes \\b, "<" becomes \\l and ">" becomes \\g, so no text can hold a control string;
the three replacements undone in the order g, l, b give the text back exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import only

#: Kinds of attachments and the tokens that one unit of each takes when it is expanded
#: (a unit is an image tile, a second of audio, a page of a document).
TOKENS_PER_UNIT = {"image": 256, "audio": 25, "document": 1024}
TURN, END = "<turn:", "</turn>\n"
SPAN = "struct<inner:int,length:int>"


def escape(text: Column) -> Column:
    for plain, code in (("\\", "\\b"), ("<", "\\l"), (">", "\\g")):
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for plain, code in ((">", "\\g"), ("<", "\\l"), ("\\", "\\b")):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def text_parts(text: Column) -> Column:
    """A plain text as the only part of its turn."""
    none = F.lit(None).cast("string")
    return F.array(F.struct(F.lit("text").alias("kind"), F.coalesce(text, F.lit("")).alias("text"), none.alias("ref"), F.lit(None).cast("long").alias("units")))


def format_conversations(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """One row per conversation of turns(conv_id, turn, role, parts).

    parts: array<struct<kind string, text string, ref string, units long>>. A visitor goes
    over the parts in order: text is escaped, an image, audio or document part leaves a placeholder,
    its reference and its expanded token count in attachments; any other kind is taken as a
    document. Returns conv_id, formatted, spans (for each turn the stretches under the loss mask,
    from the start of the turn's own text), starts (each turn's place in formatted), attachments.

    Rows of a conversation are ordered by turn (null first), then role and parts, so ties are
    put in a fixed order and repeated rows stay. Null roles and texts are empty; rows with a null
    conv_id form one conversation; a conversation of any length is one value, as its format asks.
    """
    cells = only(turns, "conv_id", "turn", "role", "parts").withColumn("role", F.coalesce("role", F.lit("")))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", F.to_json("parts"))
    cells = cells.withColumn("seq", F.row_number().over(order) - 1).withColumn("head", F.concat(F.lit(TURN), escape(F.col("role")), F.lit(">")))
    kind = lambda p: F.when(p["kind"].isin(*TOKENS_PER_UNIT), p["kind"]).otherwise(F.lit("document"))
    piece = lambda p, i: F.when(p["kind"] == "text", escape(F.coalesce(p["text"], F.lit("")))).otherwise(F.concat(F.lit("<"), kind(p), F.lit(":"), F.col("seq"), F.lit("."), i, F.lit(">")))
    parts = F.coalesce("parts", F.array())
    cells = cells.withColumn("pieces", F.transform(parts, lambda p, i: F.struct(piece(p, i).alias("s"), (F.coalesce(p["kind"], F.lit("")) == "text").alias("is_text"))))
    start = F.struct(F.col("head").alias("s"), F.array().cast(f"array<{SPAN}>").alias("spans"))
    visit = lambda a, p: F.struct(
        F.concat(a["s"], p["s"]).alias("s"),
        F.when((F.col("role") == loss_role) & p["is_text"], F.concat(a["spans"], F.array(F.struct(F.length(a["s"]).alias("inner"), F.length(p["s"]).alias("length"))))).otherwise(a["spans"]).alias("spans"),
    )
    expanded = lambda p: F.coalesce(p["units"], F.lit(1)) * F.coalesce(*[F.when(p["kind"] == k, F.lit(n)) for k, n in TOKENS_PER_UNIT.items()], F.lit(TOKENS_PER_UNIT["document"]))
    noted = F.transform(
        F.filter(F.transform(parts, lambda p, i: F.struct(p.alias("p"), i.alias("i"))), lambda x: F.coalesce(x["p"]["kind"], F.lit("")) != "text"),
        lambda x: F.struct(F.col("seq").alias("turn"), x["i"].alias("part"), kind(x["p"]).alias("kind"), x["p"]["ref"].alias("ref"), expanded(x["p"]).cast("long").alias("tokens")),
    )
    cells = cells.select("conv_id", "turn", "role", "parts", "seq", F.aggregate("pieces", start, visit).alias("out"), noted.alias("noted"))
    cells = cells.select("conv_id", "turn", "role", "parts", "seq", F.concat("out.s", F.lit(END)).alias("s"), "out.spans", "noted")
    before = F.coalesce(F.sum(F.length("s").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = cells.withColumn("at", before)
    rows = cells.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("seq", "s", "spans", "at", "noted"))).alias("t"))
    return rows.select(
        "conv_id",
        F.array_join(F.transform("t", lambda x: x["s"]), "").alias("formatted"),
        F.transform("t", lambda x: x["spans"]).alias("spans"),
        F.transform("t", lambda x: x["at"]).alias("starts"),
        F.flatten(F.transform("t", lambda x: x["noted"])).alias("attachments"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Parses formatted conversations: conv_id, turns (role and body texts), loss (texts under the mask).

    Linear in the string's length: the turns are split off once, and each turn's mask is taken
    within its own stretch.
    """
    said = F.slice(F.split("formatted", TURN, -1), 2, 2**31 - 1)
    out = formatted.withColumn("said", said)
    turn = lambda x: F.struct(
        unescape(F.substring_index(x, ">", 1)).alias("role"),
        unescape(F.substring(F.substr(x, F.length(F.substring_index(x, ">", 1)) + 2), F.lit(1), F.length(x) - F.length(F.substring_index(x, ">", 1)) - F.lit(1 + len(END)))).alias("text"),
    )
    masked = lambda x, spans: F.array_join(F.transform(spans, lambda m: unescape(F.substr(x, m["inner"] - F.lit(len(TURN) - 1), m["length"]))), "")
    return out.select("conv_id", "formatted", F.transform("said", turn).alias("turns"), F.zip_with("said", "spans", masked).alias("loss"))


def report(formatted: DataFrame) -> DataFrame:
    """The digest columns, from the formatted strings and masks alone."""
    back = read_back(formatted)
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss", "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
