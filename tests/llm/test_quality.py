import math

import pytest
from pyspark.sql import functions as F

from emberwall.llm import quality
from tests.llm import brute, cases


def test_counts_equal_brute_force(docs, spark):
    labels = spark.createDataFrame([(7, 1), (999, 1), (None, 0)], "doc_id long, quality int")
    got = quality.assess(docs, labels).collect()
    assert len(got) == len(cases.ROWS)
    by_id = {}
    for r in cases.ROWS:
        by_id.setdefault(r[0], []).append(brute.base_counts(r[1]))
    for r in got:
        counts = tuple(r[c] for c in quality.COUNTS)
        assert counts in by_id[r["doc_id"]]
        failed = counts[0] < 50 or 100 * counts[4] > 50 * counts[0]
        assert r["base_failed"] == failed and (not failed or not r["kept"])


def test_empty_tables(no_docs, docs, spark):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.assess(no_docs, labels).collect() == []
    got = quality.assess(docs, labels).collect()
    assert all(r["kept"] == (not r["base_failed"]) for r in got)


@pytest.mark.parametrize(("k", "n", "p"), [(0, 10, 0.1), (3, 50, 0.02), (7, 1755, 0.01), (50, 50, 0.3), (99, 100_000, 0.001)])
def test_binomial_tail(spark, k, n, p):
    got = spark.range(1).select(quality.binomial_tail(F.lit(k).cast("long"), F.lit(n).cast("long"), p)).first()[0]
    log = lambda i: math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)
    assert got == pytest.approx(sum(math.exp(log(i)) for i in range(k + 1)), rel=1e-6)


@pytest.fixture(scope="module")
def labelled(spark):
    good = [(k, cases.prose(80 + k % 50, 20_000 + k), "en", 1) for k in range(1500)]
    bad = [(5000 + k, " ".join(w + "%%%" for w in cases.prose(80, 30_000 + k).split()), "en", 0) for k in range(200)]
    few = [(9000 + k, cases.prose(80, 40_000 + k), "fr", 1) for k in range(30)] + [(9500, " ".join(["a#b#c"] * 5 + cases.prose(80, 5).split()), "fr", 0)]
    rows = spark.createDataFrame(good + bad + few, "doc_id long, text string, lang string, quality int")
    return rows.select("doc_id", "text", "lang"), rows.select("doc_id", "quality")


def test_rejections_are_certified(labelled):
    docs, labels = labelled
    got = {r["doc_id"]: r for r in quality.assess(docs, labels).collect()}
    assert sum(not got[k]["kept"] for k in range(1500)) <= 0.01 * 1500
    assert all(not got[5000 + k]["kept"] and got[5000 + k]["failed_rules"] for k in range(200))
    # Thirty labels can't certify a limit of one in a hundred, so nothing is rejected there.
    assert all(r["kept"] for k, r in got.items() if k >= 9000)


def wanted(rows, good, proposing, risk=quality.Risk()):
    """{(stratum, step): (n, k, certified, cutoffs)} in plain Python."""
    sides = {}
    for d, text, stratum in rows:
        n, chars, symbols, dup, repeat = brute.base_counts(text)
        if n < 50 or 100 * repeat > 50 * n or d not in good:
            continue
        lines = sum(bool(x.strip(quality.BLANKS)) for x in text.split("\n"))
        mean, capitals = chars / n, sum("A" <= c <= "Z" for c in text)
        values = {"mean_word": mean, "short_word": -mean, "symbol_share": symbols / n, "dup_line_share": dup / max(lines, 1), "repeat_share": repeat / n, "capital_share": capitals / max(chars, 1)}
        sides.setdefault(stratum, ([], []))[d not in proposing].append(values)
    sizes = sorted((len(held) for some, held in sides.values() if some and held), reverse=True)
    able = max((j for j, n in enumerate(sizes, 1) if (1 - risk.limit) ** n <= risk.error / j), default=0)
    out = {}
    for stratum, (some, held) in sides.items():
        going = bool(able)
        for step, (slack, share) in enumerate(risk.steps):
            cut = {}
            for m in quality.RULES:
                at = lambda q, m=m: sorted(v[m] for v in some)[max(0, math.ceil(q * len(some)) - 1)]  # noqa: B023
                middle, far = at(0.5), at(1 - share)
                cut[m] = max(far + slack * (far - middle), quality.LEAST.get(m, -math.inf))
            k, n = sum(any(v[m] > cut[m] for m in cut) for v in held), len(held)
            p = sum(math.comb(n, i) * risk.limit**i * (1 - risk.limit) ** (n - i) for i in range(k + 1))
            going = going and p <= risk.error / able
            out[stratum, step] = (n, k, going, {m: round(c, 9) for m, c in cut.items()})
    return out


def test_thresholds_equal_brute_force(labelled):
    """Cutoffs, counts, the fixed sequence and the correction; few good documents certify nothing and don't tighten the others' level."""
    docs, labels = labelled
    counted = quality.with_counts(docs.withColumnRenamed("lang", "stratum"), ["doc_id", "stratum"])
    got = {(r["stratum"], r["step"]): (r["n"], r["k"], r["certified"], {m: round(r[f"cut_{m}"], 9) for m in quality.RULES}) for r in quality.thresholds(counted, labels).collect()}
    proposing = {r[0] for r in docs.where(F.pmod(F.xxhash64("doc_id", F.lit("split")), F.lit(10)) == 0).select("doc_id").collect()}
    want = wanted([tuple(r) for r in docs.select("doc_id", "text", "lang").collect()], {r["doc_id"] for r in labels.collect() if r["quality"] == 1}, proposing)
    assert got == want
    assert any(v[2] for v in got.values()) and not any(v[2] for (s, _), v in got.items() if s == "fr")


def test_native(docs, spark):
    plan = quality.with_counts(docs, ["doc_id"])._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_all_labels_count_however_many_there_are(labelled, spark):
    """Millions of labels elsewhere leave a small stratum its own."""
    docs, labels = labelled
    many = labels.unionByName(spark.range(10**6, 7 * 10**6).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality")))
    counted = quality.with_counts(docs.withColumnRenamed("lang", "stratum"), ["doc_id", "stratum"])
    rows = lambda x: sorted((r["stratum"], r["step"], r["n"], r["k"], r["certified"]) for r in quality.thresholds(counted, x).collect())
    assert rows(many) == rows(labels)
