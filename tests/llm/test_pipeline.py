"""The pipeline's rows against a plain Python run of its stages' decisions."""

import os
import zlib
from array import array

import pytest

from emberwall.llm import pipeline as corpus_pipeline
from emberwall.llm.common import Scratch
from emberwall.llm.queries import tokenizer_path
from tests.llm import brute, cases

pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(cases.ROWS, cases.COLUMNS).selectExpr("*", "'x' as hits", "'y' as declared").coalesce(2).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(cases.BENCHMARK, "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return str(root)


def test_stages(spark, folder):
    scratch, docs = Scratch(spark, "t"), spark.read.parquet(f"{folder}/documents.parquet")
    first, kept = docs.columns, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.collect()
        docs = scratch.write(stage(spark, docs, folder), str(k))
        if k < 4:
            assert docs.columns == first
        after = docs.collect()
        kept.append((name, before, after))
    (_, before, after), dedup, clean, pii, packed = kept
    texts = lambda rows: sorted((r["doc_id"] is None, r["doc_id"], r["text"]) for r in rows)
    assert all(r["hits"] == "x" and r["declared"] == "y" for r in pii[2])
    # Language: documents without letters go, those of prose stay.
    assert not any(r["text"] is None or not any(c.isalpha() or c > "\x7f" for c in r["text"]) for r in after)
    assert {r["doc_id"] for r in after} >= {3, 4, 7, 8, 9, 10, 12}
    # Near-duplicates: one of each component.
    want, _ = brute.near_components([(r["doc_id"], r["text"]) for r in dedup[1] if r["doc_id"] is not None], 5)
    # Rows that repeat a kept id with the same text are one.
    stay = [r for r in dedup[1] if r["doc_id"] is None] + list({(r["doc_id"], r["text"]): r for r in dedup[1] if r["doc_id"] is not None and want[r["doc_id"]][1] == r["doc_id"]}.values())
    assert texts(dedup[2]) == texts(stay)
    assert len(stay) < sum(r["doc_id"] is None or want[r["doc_id"]][1] == r["doc_id"] for r in dedup[1])
    # Benchmark: no window is left.
    assert texts(clean[2]) == texts(r for r in clean[1] if not brute.decontaminate(r["text"], cases.BENCHMARK)[1])
    assert len(clean[2]) < len(clean[1])
    # Personal data: spans are replaced in place, other texts stay as they are.
    by_key = {(r["doc_id"], len(pii[1])): r for r in pii[2]}
    assert len(pii[1]) == len(pii[2]) and by_key
    for r in pii[1]:
        spans = brute.base_spans(r["text"])
        if not spans:
            assert any(x["doc_id"] == r["doc_id"] and x["text"] == r["text"] and x["n_chars"] == r["n_chars"] for x in pii[2])
    # Packing: every id of every text, once.
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    want = sorted(array("I", [*library.encode(r["text"], add_special_tokens=False).ids, 2]).tobytes() for r in packed[1])
    assert sum(r["length"] for r in packed[2]) == sum(len(b) // 4 for b in want)
    whole = [r for r in packed[2] if r["length"] == r["doc_tokens"]]
    assert {r["ids_crc32"] for r in whole} <= {zlib.crc32(b) for b in want}


def test_run(spark, folder):
    assert corpus_pipeline.run(spark, folder).count() > 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_clean_documents_stay(spark):
    """Of the smallest tables, what leaves before packing is a copy or holds a benchmark passage."""
    d = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{d}/documents.parquet").collect()
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    comp, _ = brute.near_components([(r["doc_id"], r["text"]) for r in rows], 5)
    want = {r["doc_id"] for r in rows if comp[r["doc_id"]][1] == r["doc_id"] and not brute.decontaminate(r["text"], bench)[1]}
    got = {r["doc_id"] for r in corpus_pipeline.run(spark, d).select("doc_id").distinct().collect()}
    assert got == want
