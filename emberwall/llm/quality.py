"""Quality rules with risk-controlled thresholds, in DataFrame expressions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_GAP, Scratch, broadcast_if_small, only

BLANKS = " \t\n\x0b\x0c\r"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Risk:
    """What the thresholds guarantee: with probability 1 - error, no stratum's share of good documents rejected exceeds limit."""

    limit: float = 0.01
    error: float = 0.05
    #: Proposals, the mildest first: (slack, share). A rule's cutoff is the quantile that leaves share of the good
    #: documents beyond it, put out further by slack times its distance from their median.
    steps: tuple[tuple[float, float], ...] = ((2.0, 0.0), (1.0, 0.0), (0.5, 0.0), (0.25, 0.0), (0.0, 0.0), (0.0, 0.001), (0.0, 0.002), (0.0, 0.004))


#: Rules: a measure, and whether too high (1) or too low (-1) values fail.
#: Cutoffs are never stricter than LEAST, so that a measure which good documents rarely have isn't held against a trace of it.
LEAST = {"symbol_share": 0.1, "dup_line_share": 0.3}
RULES = {"mean_word": 1, "short_word": -1, "symbol_share": 1, "dup_line_share": 1, "repeat_share": 1, "capital_share": 1}


def with_counts(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Adds the base counts, n_lines and n_capitals of each whole text; null has no words.

    A chain of selects: Spark does not merge steps whose arrays are used more than once, so each
    array is made once for a row. Repeated windows are found by sorting a text's own window
    hashes, and only in texts where the number of distinct ones shows a repeat.
    """
    cols = [F.col(f"`{c}`") for c in keep]
    text = F.coalesce("`text`", F.lit(""))
    trimmed = F.btrim(text, F.lit(BLANKS))
    df = docs.select(*cols, text.alias("t"), F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"{WORD_GAP}+")).alias("w"))
    lines = F.filter(F.split("t", "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    window = lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2))
    hashes = F.when(F.size("w") >= 3, F.transform(F.sequence(F.lit(0), F.size("w") - 3), window)).otherwise(F.array().cast("array<bigint>"))
    df = df.select(
        *cols,
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("t", "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace("t", "[^A-Z]+", "")).cast("long").alias("n_capitals"),
        lines.alias("lines"),
        hashes.alias("h"),
    )
    repeated = F.size(F.array_distinct("h")) < F.size("h")
    df = df.select(
        *cols, "n_words", "word_chars", "n_symbols", "n_capitals",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(repeated, F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))).alias("z"),
    )
    twice = F.filter("z", lambda x, k: (F.get("z", k - 1)["h"] == x["h"]) | F.coalesce(F.get("z", k + 1)["h"] == x["h"], F.lit(False)))
    places = F.sort_array(F.transform(twice, lambda x: x["i"]))
    # Each window covers three words; those that the window before covers count once.
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last"))
    covered = F.aggregate(places, start, lambda a, i: F.struct((a["n"] + F.least(F.lit(3), i - a["last"])).alias("n"), i.alias("last")))["n"]
    return df.select(*cols, *[c for c in df.columns if c not in (*keep, "z")], F.when(F.col("z").isNotNull(), covered).otherwise(F.lit(0)).cast("long").alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def measures() -> dict[str, Column]:
    words = F.greatest(F.col("n_words"), F.lit(1))
    mean = F.col("word_chars") / words
    return {
        "mean_word": mean,
        "short_word": mean,
        "symbol_share": F.col("n_symbols") / words,
        "dup_line_share": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "repeat_share": F.col("n_repeat_words") / words,
        "capital_share": F.col("n_capitals") / F.greatest(F.col("word_chars"), F.lit(1)),
    }


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X binomial(n, p), summed term by term from the logarithm of each.

    This is the exact (Clopper-Pearson) p-value of "the rate is p or more" after k of n.
    """
    import math

    odds = math.log(p / (1 - p))
    first = F.struct((n * math.log1p(-p)).alias("log"), F.lit(0.0).alias("sum"))
    add = lambda a, i: F.struct((a["log"] + F.log((n - i) / (i + 1)) + odds).alias("log"), (a["sum"] + F.exp(a["log"])).alias("sum"))
    return F.when(k >= n, 1.0).otherwise(F.aggregate(F.sequence(F.lit(0).cast("long"), k), first, add)["sum"])


def _cut(rule: str, step: int, slack: float) -> Column:
    """A step's cutoff from an array of the rule's median and its quantile for each step."""
    middle, far = F.get(rule, F.lit(0)), F.get(rule, F.lit(step + 1))
    cut = far + slack * (far - middle)
    return F.greatest(cut, F.lit(LEAST[rule])) if rule in LEAST else cut


def thresholds(counted: DataFrame, labels: DataFrame, risk: Risk = Risk()) -> DataFrame:
    """Tested cutoffs: stratum, step, n, k, p_value, certified and a cutoff for each rule.

    counted has doc_id, stratum and the counts; labels has doc_id and quality (1: good). Documents that pass the base rules
    take part. All labels count: of the documents labelled good, a tenth (by a hash of doc_id) proposes each step's cutoffs by its
    quantiles. The rest, untouched so far, are the holdout: of n of them k are rejected by a step's rules together, and
    p_value is the exact binomial one of "more than limit are".

    Correction: within a stratum the steps are tested in their fixed order, and the first that fails ends the sequence, so that
    each is tested at the stratum's whole level. That is error over the number of strata that have enough good documents to
    certify anything (a count that doesn't depend on how they come out).
    """
    good = only(labels, "doc_id", "quality").groupBy("doc_id").agg(F.max("quality").alias("quality")).where("quality = 1").select("doc_id")
    held = counted.where(~base_failed()).where("stratum is not null").join(good, "doc_id", "left_semi").select("stratum", "doc_id", *[c.alias(m) for m, c in measures().items()])
    held = held.withColumn("proposes", F.pmod(F.xxhash64("doc_id", F.lit("split")), F.lit(10)) == 0)
    at = F.array(F.lit(0.5), *[F.lit(1 - share) for _, share in risk.steps])
    quantiles = held.where("proposes").groupBy("stratum").agg(*[F.percentile_approx(F.col(m) * sign, at, F.lit(10_000)).alias(m) for m, sign in RULES.items()])
    cuts = quantiles.select("stratum", *[F.array(*[_cut(m, k, slack) for k, (slack, _) in enumerate(risk.steps)]).alias(f"cuts_{m}") for m in RULES])
    # One row of counts for each stratum and step: conditional sums in one pass, then unpivoted.
    tested = held.where("not proposes").join(broadcast_if_small(cuts, 100_000), "stratum")
    fails = [sum_of([F.col(m) * sign > F.get(f"cuts_{m}", F.lit(k)) for m, sign in RULES.items()]) for k in range(len(risk.steps))]
    counts = tested.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), *[F.sum(f.cast("long")).alias(f"k{k}") for k, f in enumerate(fails)])
    # A row for each stratum: the j-th largest could be certified at error / j if none of its good documents were rejected.
    ranked = counts.withColumn("j", F.row_number().over(Window.orderBy(F.desc("n"), "stratum")))
    able = ranked.agg(F.max(F.when(F.pow(F.lit(1 - risk.limit), F.col("n")) <= risk.error / F.col("j"), F.col("j"))).alias("able"))
    counts = counts.crossJoin(F.broadcast(able))  # one row
    counts = counts.select("stratum", "n", "able", F.posexplode(F.array(*[F.col(f"k{k}") for k in range(len(risk.steps))])).alias("step", "k"))
    # Beyond limit * n rejections the tail is over a half, and its terms needn't be summed.
    p = F.when(F.col("k") > F.col("n") * risk.limit, F.lit(1.0)).otherwise(binomial_tail(F.col("k"), F.col("n"), risk.limit))
    counts = counts.withColumn("p_value", p).withColumn("passes", F.coalesce(F.col("p_value") <= risk.error / F.col("able"), F.lit(False)))
    in_order = Window.partitionBy("stratum").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    counts = counts.withColumn("certified", F.min("passes").over(in_order)).drop("able", "passes")
    return counts.join(cuts, "stratum").select("stratum", "n", "step", "k", "p_value", "certified", *[F.get(f"cuts_{m}", "step").alias(f"cut_{m}") for m in RULES])


def sum_of(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def assess(docs: DataFrame, labels: DataFrame, *, stratum: str = "lang", risk: Risk = Risk()) -> DataFrame:
    """Per row of docs(doc_id, text, stratum): the base counts, base_failed, failed rules and kept.

    One scan of the texts writes the counts; thresholds and verdicts come from that narrow
    table, with the most severe certified step of each stratum. A document is kept unless the base rules fail it or a certified cutoff of its stratum
    does. A stratum that is null, or has too few labels for any certificate, rejects by the
    base rules alone. Null and empty texts have no words and fail the base rules. Labels of unknown
    documents count for nothing; several labels of one document count as the best of them.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    renamed = only(docs, "doc_id", stratum, "text").toDF("doc_id", "stratum", "text").withColumn("stratum", F.col("stratum").cast("string"))
    counted = scratch.write(with_counts(renamed, ["doc_id", "stratum"]), "counts")
    found = scratch.write(thresholds(counted, labels, risk), "thresholds")
    best = found.where("certified").withColumn("rank", F.row_number().over(Window.partitionBy("stratum").orderBy(F.desc("step")))).where("rank = 1")
    cuts = best.select("stratum", *[f"cut_{m}" for m in RULES])
    joined = counted.join(broadcast_if_small(cuts, 100_000), "stratum", "left")
    kinds = measures()
    rules = F.array(*[F.when(kinds[m] * sign > F.col(f"cut_{m}"), F.lit(m)) for m, sign in RULES.items()])
    out = joined.select("doc_id", "stratum", *COUNTS, base_failed().alias("base_failed"), F.array_compact(rules).alias("failed_rules"))
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))
