import random

import numpy as np
import pytest

from emberwall.llm import near_dedup, shingles
from emberwall.llm.components import connected_components, joined_components
from emberwall.llm.common import Scratch
from tests.llm import brute, cases


def components(rows):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows if r["doc_id"] is not None}


@pytest.mark.parametrize("words", [4, 5])
def test_awkward_documents(docs, words):
    got = near_dedup.near_duplicates(docs, words=words).collect()
    assert len(got) == len(cases.ROWS)
    want, _ = brute.near_components([(r[0], r[1]) for r in cases.ROWS if r[0] is not None], words)
    assert components(got) == want
    assert all(r["kept"] == (r["doc_id"] is not None and r["doc_id"] == r["component_id"]) for r in got)


def test_empty_table(no_docs):
    assert near_dedup.near_duplicates(no_docs).collect() == []


def edited(text, share, seed):
    rng = random.Random(seed)
    return " ".join(w if rng.random() > share else f"new{rng.randrange(10**6)}" for w in text.split())


@pytest.fixture(scope="module")
def groups(spark):
    """Large and small groups of copies at every distance from the limit, one of them hot, and texts with a common passage."""
    rows, passage = [], cases.prose(120, 77)
    for g in range(40):
        base = cases.prose(60 + 10 * g, 100 + g)
        rows += [edited(base, s, 1000 * g + k) for k, s in enumerate([0, 0, 0.005, 0.01, 0.02, 0.03, 0.04])]
    hot = cases.prose(150, 55)
    rows += [edited(hot, 0.015, 50_000 + k) for k in range(400)]
    rows += [hot] * 200
    rows += [passage + " " + cases.prose(60, 9000 + k) for k in range(300)]
    random.Random(2).shuffle(rows)
    data = list(enumerate(rows))
    return data, spark.createDataFrame(data, "doc_id long, text string").repartition(7)


def test_groups_equal_brute_force(groups):
    data, df = groups
    got = near_dedup.near_duplicates(df, words=4).collect()
    want, pairs = brute.near_components(data, 4)
    assert len(pairs) > 1000
    assert components(got) == want


def test_one_id_with_unlike_texts(spark):
    """Each of its texts has its links, and all rows of the id are one component; repeated rows change nothing."""
    one, two = cases.prose(150, 61), cases.prose(150, 62)
    rows = [(5, one), (5, two), (5, two), (6, one + " x"), (7, two + " y"), (8, cases.prose(150, 63)), (None, one)]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=4).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got if r["doc_id"]) == [(5, 5), (5, 5), (5, 5), (6, 5), (7, 5), (8, 8)]


def boilerplate(spark, n, common, own):
    shared = cases.prose(common, 71)
    rows = [(k, f"{shared} " + " ".join(f"own{k}x{j}" for j in range(own + k % 7))) for k in range(n)]
    # Some have a second version, which the forest may lose among the others.
    rows += [(n + k, rows[k][1] + " end") for k in range(0, n, 10)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string").repartition(8)


@pytest.mark.parametrize(("common", "own"), [(120, 36), (130, 26), (136, 20), (140, 14)])
def test_boilerplate_equals_brute_force(spark, common, own):
    """Documents around a common passage, at similarities on both sides of the limit."""
    rows, df = boilerplate(spark, 300, common, own)
    assert components(near_dedup.near_duplicates(df, words=4).collect()) == brute.near_components(rows, 4)[0]


def test_boilerplate_makes_no_pairs(spark):
    """Thousands of documents that share only a passage: the exact join of their region compares versions with one another alone."""
    from pyspark.sql import functions as F

    rows, df = boilerplate(spark, 3000, 120, 36)
    texts = df.select(F.col("doc_id").alias("node"), "text")
    dense = texts.select("node", F.lit(1).cast("long").alias("region"))
    none = spark.createDataFrame([], "node long, component long")
    scratch = Scratch(spark, "t")
    got = {(r["a"], r["b"]) for r in near_dedup._left_over(dense, none, texts, scratch, 4, 80).collect()}
    assert {(k, 3000 + k) for k in range(0, 3000, 10)} <= got
    assert len(got) < 2 * len(rows)


def test_candidates_stay_linear(spark, groups):
    """No all-pairs: a region of n rows gives fewer than REGION candidates for each row."""
    _, df = groups
    n = df.count()
    sketched = df.selectExpr("doc_id", "text", "doc_id as key").mapInArrow(near_dedup._sketcher(4), "doc_id long, key long, n_shingles long, digest binary, sketch binary")
    orders = sketched.withColumnRenamed("doc_id", "node").mapInArrow(near_dedup._ordered, "tree int, k1 long, k2 long, node long").repartition(1).sortWithinPartitions("tree", "k1", "k2", "node")
    pairs = orders.mapInArrow(near_dedup._neighbours(False), "kind int, a long, b long, tree int, k1 long, k2 long, node long")
    assert 0 < pairs.count() < near_dedup.ORDERS * near_dedup.REGION * n


def test_shingle_sets():
    for text in cases.TEXTS:
        t = (text or "").encode()
        (got,) = shingles.shingle_sets([memoryview(t)], 4)
        assert len(got) == len(brute.shingles(text, 4))
    a, b = shingles.shingle_sets([memoryview(b"A b  c D"), memoryview(b"a B\tc d\n")], 4)
    assert a.tolist() == b.tolist()


def test_sets_do_not_depend_on_neighbours():
    texts = [memoryview((t or "").encode()) for t in cases.TEXTS]
    together = shingles.shingle_sets(texts, 5)
    for t, s in zip(texts, together, strict=True):
        assert np.array_equal(shingles.shingle_sets([t], 5)[0], s)
    sk = shingles.sketches(together, 96)
    for k in range(len(texts)):
        assert np.array_equal(shingles.sketches([together[k]], 96)[0], sk[k])


@pytest.mark.parametrize("n", [5, 60, 1000])
def test_sketches_estimate_similarity(n):
    rng = np.random.default_rng(n)
    agree = []
    for _ in range(60):
        common = rng.integers(1, 2**63, n * 8 // 10, dtype=np.uint64)
        a, b = (np.unique(np.append(common, rng.integers(1, 2**63, n // 10, dtype=np.uint64))) for _ in range(2))
        x, y = shingles.sketches([a, b], 96)
        agree.append((x == y).mean())
    true = (n * 8 // 10) / (n * 8 // 10 + 2 * (n // 10))
    assert abs(np.mean(agree) - true) < 0.05


def test_components_of_paths_and_stars(spark):
    edges = [(k, k + 1) for k in range(0, 60)] + [(100, 100 + k) for k in range(1, 300)] + [(500, 501), (501, 502), (400, 502)]
    random.Random(1).shuffle(edges)
    found = connected_components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t"), "cc").collect()
    got = {r["node"]: r["component"] for r in found}
    assert {got[k] for k in range(61)} == {0} and {got[100 + k] for k in range(300)} == {100} and {got[k] for k in (400, 500, 501, 502)} == {400}


def test_components_joined_by_later_links(spark):
    """The same as all links at once: chains through old components, new nodes, links within one, none at all."""
    rng, table = random.Random(4), lambda e: spark.createDataFrame(e, "a long, b long")
    first = [(rng.randrange(300), rng.randrange(300)) for _ in range(150)]
    later = [(rng.randrange(400), rng.randrange(400)) for _ in range(60)] + first[:5] + [(7, 7)]
    first, whole = [e for e in first if e[0] != e[1]], {}
    for name, edges in (("once", first + [e for e in later if e[0] != e[1]]), ("old", first)):
        whole[name] = connected_components(table(edges), Scratch(spark, "t"), name)
    got = joined_components(whole["old"], table(later), Scratch(spark, "t"), "new").collect()
    assert len({r["node"] for r in got}) == len(got)
    assert sorted(map(tuple, got)) == sorted(map(tuple, whole["once"].collect()))
    same = joined_components(whole["old"], table([]), Scratch(spark, "t"), "none").collect()
    assert sorted(map(tuple, same)) == sorted(map(tuple, whole["old"].collect()))
