import hashlib
import re
from collections import Counter

from pyspark.sql import functions as F

from emberwall.llm import pii
from tests.llm import brute, cases


def test_base_spans_equal_the_contract(docs):
    got = pii.report(pii.find_pii(docs, ["doc_id"])).collect()
    want = Counter()
    for r in cases.ROWS:
        spans = brute.base_spans(r[1])
        n = Counter(k for _, k, _ in spans)
        want[(r[0], n[0], n[1], n[2], n[3], hashlib.sha256(brute.spans_text(spans).encode()).hexdigest())] += 1
    assert Counter((r["doc_id"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) for r in got) == want


TRICKY = [
    "a@b.c@d.e", "a@b.c%x@d.e", "a@b..c", "@a.b", "a@b.c.", "x.y+z@q-r.s-t.uv-", "1.2.3.4", "01.002.0003.4", "1.2.3.256", "1.2.3.4.5", "999.1.2.3.4.5.6", "0000000255.1.1.1",
    "4111111111111111", "4111 1111  1111 1111", "4-1-1-1-1-1-1-1-1-1-1-1-1-1-1-1", "41111111111111111111111", "5 4111111111111111", "+1234567890", "+1 (555) 010-9999.", "+1((((2", "++15550109999", "+155501099991234567",
    "é+1 555 010 9999é", "1.2.3.4@a.b", "+1.2.3.4.5.6.7.8.9.0@x.y",
]


def test_tricky_spans(spark):
    df = spark.createDataFrame(list(enumerate(TRICKY)), "doc_id long, text string")
    got = {r["doc_id"]: [(s["start"], s["kind"], s["end"]) for s in r["base"]] for r in pii.with_base(df, "text", ["doc_id"]).collect()}
    assert got == {k: brute.base_spans(t) for k, t in enumerate(TRICKY)}


def test_empty_table(no_docs):
    assert pii.find_pii(no_docs, ["doc_id"]).collect() == []
    assert pii.redacted(no_docs).collect() == []


def test_bootstrapping(spark):
    """Seeds after "mail id" vouch for the context; an unseen identifier there is found, elsewhere it isn't."""
    texts = [f"new mail id user{k:05d}@corp.org sent" for k in range(12)] + ["new mail id u-1234567 sent", "some part no u-7654321 sold", "new mail id 123 sent"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r["doc_id"]: r for r in pii.find_pii(df, ["doc_id"]).collect()}
    assert [(s["start"], s["kind"], s["end"]) for s in rows[12]["found"]] == [(12, 0, 21)]
    assert not rows[13]["found"] and not rows[14]["found"]
    out = {r["doc_id"]: r["text"] for r in pii.redacted(df).collect()}
    assert out[12] == "new mail id [EMAIL] sent" and out[0] == "new mail id [EMAIL] sent" and out[13] == texts[13]


def test_redaction(docs, spark):
    out = Counter((r["doc_id"], r["text"]) for r in pii.redacted(docs.select("doc_id", "text", "lang", "source", "n_chars")).collect())
    assert out == Counter((r[0], brute.redact(r[1], brute.base_spans(r[1]))) for r in cases.ROWS)
    df = spark.createDataFrame([(1, "é a@b.cd 10.0.0.1"), (2, None), (3, "")], "doc_id long, text string")
    assert [r["text"] for r in pii.redacted(df).orderBy("doc_id").collect()] == ["é [EMAIL] [IP]", None, ""]


def test_native(docs):
    plan = pii.with_seeds(pii.with_base(docs.select("doc_id", "text"), "text", ["doc_id"]), "text")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_luhn(spark):
    df = spark.createDataFrame([("4111111111111111",), ("4111111111111112",), ("0",)], "d string")
    assert [r[0] for r in df.select(pii.luhn(F.col("d"))).collect()] == [True, False, True]


def found(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r["doc_id"]: r["found"] for r in pii.find_pii(df, ["doc_id"]).collect()}
    return {k: [(s["kind"], t[s["start"] : s["end"]]) for s in rows[k]] for k, t in enumerate(texts) if rows[k]}


def test_unseen_identifiers_of_any_form_are_found(spark):
    """Few digits, none at all, or digits in groups: the context decides."""
    names = [a + b for a in ("ann", "bob", "cy") for b in ("lee", "may", "roy", "fox")]
    texts = [f"send to my email: {x}@corp.org thanks" for x in names] + [f"from server at {k}.1.2.3 port" for k in range(12)]
    texts += [f"paid by card 411111111111{k} ok" for k in (1111, 1129, 1137, 1145, 1152, 1160, 1178, 1186, 1194, 1202)]
    n = len(texts)
    texts += ["send to my email: jane at corp dot org thanks", "send to my email: jane.doe(at)corp soon", "from server at 10.1.2 port", "paid by card 4111 1111 1111 1112 ok", "paid by letter 4111 1111 1111 1112 ok"]
    got = found(spark, texts)
    assert got == {n: [(0, "jane at corp dot org")], n + 1: [(0, "jane.doe(at)corp")], n + 2: [(1, "10.1.2")], n + 3: [(2, "4111 1111 1111 1112")]}


def test_common_words_are_no_identifiers(spark):
    texts = [f"write of the user{x}@corp.org now" for x in "abcdefgh"] + [f"end of the {w} now" for w in ("house", "river", "street", "people")]
    assert found(spark, texts) == {}


def test_words_before_a_phone_are_its_context(spark):
    texts = [f"Please call Agent line +1 (555) 010-{k:04d} today" for k in range(1000, 1020)]
    texts += ["Please call me, or dial: Agent line 0155-0109-22 now", "account number 987654321 here", "call Agent line 77", "please call Agent line (017) 555 7713, or wait"]
    assert found(spark, texts) == {20: [(3, "0155-0109-22")], 23: [(3, "(017) 555 7713")]}


LONG = {
    "one word": "x" * 1_000_000,
    "digits": "7" * 1_000_000,
    "signs": "@+(.-" * 200_000,
    "one mark": "send to my email: " + "!" * 500_000 + "(" * 500_000,
    "addresses": "send to my email: user@corp.org thanks " * 25_000,
    "words": "lorem " * 170_000 + "send to my email: last@corp.org end",
}


def test_texts_of_a_megabyte(spark):
    """Time grows with the length of a text, whatever it is made of."""
    import time

    names = [f"send to my email: {x}{y}@corp.org thanks" for x in "abcd" for y in "efgh"]
    texts = [*LONG.values(), *names, "send to my email: joe at corp dot org thanks"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    began = time.monotonic()
    rows = {r["doc_id"]: r for r in pii.find_pii(df, ["doc_id"]).collect()}
    out = {r["doc_id"]: r["text"] for r in pii.redacted(df).collect()}
    assert time.monotonic() - began < 120
    for k, t in enumerate(texts):
        # The plain patterns take hours over such texts, in which nothing else is personal data.
        assert [(s["start"], s["kind"], s["end"]) for s in rows[k]["base"]] == [(m.start(), 0, m.end()) for m in re.finditer(r"\b\w+@corp\.org", t)]
        assert out[k] == brute.redact(t, [(s["start"], s["kind"], s["end"]) for s in rows[k]["spans"]])
    assert len(rows[len(texts) - 1]["found"]) == 1


def test_running_totals(spark):
    for n in (0, 1, 127, 128, 129, 1000, 20_000):
        df = spark.createDataFrame([([(7 * k) % 11 for k in range(n)],)], "v array<int>")
        sums, most = df.select(pii.total(F.col("v")), pii.running(F.col("v"), F.greatest, F.lit(0))).first()
        values = [(7 * k) % 11 for k in range(n)]
        assert sums == [sum(values[: k + 1]) for k in range(n)] if n < 2000 else sums[-1] == sum(values) and len(sums) == n
        assert most == [max(values[: k + 1]) for k in range(n)] if n < 2000 else most[-1] == 10


def test_scores_equal_brute_force(spark):
    """The graph's scoring against plain Python, on random graphs."""
    import random

    from emberwall.llm.common import Scratch

    for seed in range(3):
        rng = random.Random(seed)
        cores = {f"i{k}": rng.choice([0, 1, None, None, 3]) for k in range(60)}
        slots = []
        for _ in range(700):
            core = rng.choice(list(cores))
            kind = cores[core] if rng.random() < 0.9 else None
            context = f"c{(hash_of(core) + rng.choice([0, 0, 0, 0, 1])) % 12}" if kind is not None else f"c{rng.randrange(12)}"
            slots.append((context, core if rng.random() < 0.95 else None, kind if kind is not None else None))
        slots = [(c, i, k if i is not None else None) for c, i, k in slots]
        df = spark.createDataFrame(slots, "context string, core string, seed_kind int")
        got = {(r["context"], r["kind"]): (round(r["score"], 9), r["seeds"]) for r in pii.score_patterns(df, Scratch(spark, "t")).collect()}
        want = brute.pattern_scores(slots, pii.ROUNDS, pii.LEAST_SCORE, pii.LEAST_SEEDS, pii.DOUBT)
        assert got == {k: (round(score, 9), seeds) for k, (score, seeds) in want.items()}


def hash_of(text):
    return sum(map(ord, text))
