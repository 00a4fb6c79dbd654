import pytest

from emberwall.llm import language
from tests.llm import cases

WORDS = {
    "en": "the of and to in that was with for the house water people little which there would about other their",
    "fr": "le la les des une dans pour avec être maison eau petit gens autre leur cette était où très après",
    "de": "der die das und nicht mit für über haus wasser klein leute andere ihre diese war sehr nach größe schön",
}


def text(lang, n, seed):
    import random

    return " ".join(random.Random(f"{lang}{seed}").choices(WORDS[lang].split(), k=n))


@pytest.fixture(scope="module")
def labelled(spark):
    rows = [(100 * i + k, text(l, 5 + k, k), l, f"{l}.org" if k % 3 else "mixed.org", 0) for i, l in enumerate(WORDS) for k in range(90)]
    return spark.createDataFrame(rows, cases.COLUMNS)


@pytest.fixture(scope="module")
def model(labelled):
    return language.fit(labelled)


def identify(df, model, key="doc_id"):
    scored = language.score_text(df, model, [key, "declared", "host", "suffix"])
    return {r[key]: r for r in language.fuse(scored, language.host_priors(scored, model), model, [key, "declared"]).collect()}


def test_held_out_accuracy(labelled, model, spark):
    rows = [(1000 * i + k, text(l, 4 + k % 20, 5000 + k), None, None, None) for i, l in enumerate(WORDS) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, declared string, host string, suffix string")
    got = identify(df, model)
    right = sum(got[1000 * i + k]["language"] == l for i, l in enumerate(WORDS) for k in range(60))
    assert right >= 0.97 * 180


def test_evidence_decides_where_the_text_cannot(model, spark):
    rows = [(k, text("de", 12, k), None, "a.de", "de") for k in range(30)] + [(100 + k, text("fr", 12, k), None, "b.fr", "fr") for k in range(30)]
    rows += [(200, "ok", "fr", None, None), (201, "ok", None, "a.de", "de"), (202, "ok", None, "b.fr", "fr"), (203, "ok", None, "new.de", "de"), (204, "ok", None, "new.fr", "fr"), (205, text("fr", 40, 9), "de", "a.de", "de"), (206, "12 ... 34", "fr", "b.fr", "fr"), (207, None, "fr", "b.fr", "fr"), (208, "", None, None, None), (209, "ok", "xx", "b.fr", "fr")]
    got = identify(spark.createDataFrame(rows, "doc_id long, text string, declared string, host string, suffix string"), model)
    assert [got[k]["language"] for k in (200, 201, 202, 203, 204, 205, 209)] == ["fr", "de", "fr", "de", "fr", "fr", "fr"]
    assert got[203]["posterior"] < got[201]["posterior"]  # an unknown host leans on its suffix alone
    assert [got[k]["accepted"] for k in (200, 201, 205, 206, 207, 208)] == [True, True, True, False, False, False]


def test_awkward_documents(docs, no_docs, model):
    rows = language.document_evidence(docs.drop("declared", "host"))
    scored = language.score_text(rows, model, ["doc_id", "text", "declared", "host", "suffix"])
    got = language.fuse(scored, language.host_priors(scored, model), model, ["doc_id", "text"]).collect()
    assert len(got) == len(cases.ROWS)
    assert {r["text"] for r in got} == {r[1] for r in cases.ROWS}
    none = language.fit(no_docs)
    scored = language.score_text(language.document_evidence(no_docs), none, ["doc_id", "declared", "host", "suffix"])
    assert none.languages == () and language.fuse(scored, scored, none, ["doc_id"]).collect() == []


def test_scores_do_not_depend_on_batches(labelled, model, spark):
    df = language.document_evidence(labelled)
    score = lambda x: {r["doc_id"]: [round(v, 9) for v in r["log_text"]] for r in language.score_text(x, model, ["doc_id"]).collect()}
    assert score(df) == score(df.repartition(7))


def test_pages(spark):
    html = '<!DOCTYPE html><html class="x" LANG="de-AT"><head><style>p{}</style><script>var t="</p>";</script></head><body><!-- no --><p>Hallo <b>Welt</b></p></body></html>'
    rows = [(1, "https://user@www.Example.de:80/x?y#z", html), (2, "nonsense", "plain"), (3, None, None)]
    got = language.page_evidence(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert got[0]["text"].split() == ["Hallo", "Welt"]
    assert [(r["declared"], r["host"], r["suffix"]) for r in got] == [("de", "www.example.de", "de"), (None, None, None), (None, None, None)]


FOREIGN = ["Съешь же ещё этих мягких французских булок да выпей чаю", "我能吞下玻璃而不伤身体", "xqzvk wjqpf zzgkx vbnqw kjhgx qqwzx", "TWFuIGlzIGRpc3Rpbmd1aXNoZWQsIG5vdCBvbmx5IGJ5IGhpcyByZWFzb24"]


@pytest.mark.parametrize("declared", [None, "en"])
def test_noise_and_other_languages_are_rejected(model, spark, declared):
    rows = [(k, x, declared, None, None) for k, x in enumerate(FOREIGN)] + [(10 + k, text("fr", 3 + k, k), None, None, None) for k in range(5)]
    got = identify(spark.createDataFrame(rows, "doc_id long, text string, declared string, host string, suffix string"), model)
    assert [got[k]["accepted"] for k in range(4)] == [False] * 4
    assert all(got[k]["accepted"] and got[k]["language"] == "fr" for k in range(10, 15))


def test_every_label_is_a_language(labelled, spark):
    """More than a hundred languages, and one of a single document."""
    letters = "abcdefghijklm"
    rows = [(10_000 + 10 * i + k, " ".join([a + b + a, b + a + b] * 20), a + b + "x", None, 0) for i, (a, b) in enumerate((a, b) for a in letters for b in letters if a != b) for k in range(5)]
    rows += [(1, "Съешь же ещё этих мягких булок", "ru", None, 0)]
    docs = labelled.unionByName(spark.createDataFrame(rows, cases.COLUMNS))
    model = language.fit(docs)
    assert len(model.languages) == 3 + 156 + 1 and len(model.table) == 3 + 156
    got = identify(language.document_evidence(docs.select("doc_id", "text", "lang", "source")), model)
    assert got[1]["language"] == "ru" and got[1]["accepted"]
    assert all(got[r[0]]["language"] == r[2] for r in rows)
