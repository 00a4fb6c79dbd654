import hashlib
import random
from collections import Counter

import pytest

from emberwall.llm import decontamination as dc
from tests.llm import brute, cases


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame(cases.BENCHMARK, "item_id long, text string")


def wanted():
    out = Counter()
    for r in cases.ROWS:
        n, hit, items = brute.decontaminate(r[1], cases.BENCHMARK)
        out[(r[0], n, hit, len(items), hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest(), hit > 0)] += 1
    return out


def test_equals_brute_force(docs, benchmark):
    got = dc.report(dc.find_windows(docs, benchmark)).collect()
    assert Counter(tuple(r[c] for c in ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")) for r in got) == wanted()


def test_offsets_are_of_the_original(docs, benchmark):
    rows = {r["doc_id"]: r for r in dc.find_windows(docs, benchmark, carry=("doc_id", "text")).collect()}
    hit = [(k, [r["text"][h["start"] : h["end"]] for h in r["hits"]]) for k, r in rows.items() if k is not None and r["hits"]]
    assert dict(hit)[17] == ["ALPHA beta-gamma delta epsilon zeta eta, theta iota kappa lambda mu"]
    assert dict(hit)[18] == ["short item here short ITEM here"]
    assert 19 not in dict(hit)  # only A to Z are lower-cased


def test_empty_tables(docs, no_docs, benchmark, spark):
    assert dc.find_windows(no_docs, benchmark).collect() == []
    none = dc.report(dc.find_windows(docs, spark.createDataFrame([], "item_id long, text string"))).collect()
    assert len(none) == len(cases.ROWS) and not any(r["contaminated"] for r in none)


def test_nested_and_overlapping_windows():
    found = dc.Automaton([(1, "a b c d e f g h i j k"), (2, "c d"), (3, "j k l")])
    spans, items = found.scan("x a b c d e f g h i j k l c d".encode().split())
    assert spans == [(1, 14)] and items == [1, 2, 3]
    spans, _ = found.scan(b"c d x c d".split())
    assert spans == [(0, 1), (3, 4)]


@pytest.mark.parametrize("window", [1, 2, 3, 5, 10])
def test_random_windows_equal_brute_force(window):
    """Few words, so that pieces, windows and items overlap and repeat in every way."""
    rng = random.Random(window)
    for _ in range(300):
        letters = "abc" if rng.random() < 0.5 else "abcdefghijkl"
        make = lambda n: " ".join(rng.choice(letters) for _ in range(n))  # noqa: B023, E731
        items = [(k, make(rng.randrange(0, 3 * window + 2))) for k in range(rng.randrange(0, 6))]
        parts = [make(rng.randrange(0, 2 * window)), *(t for _, t in items if rng.random() < 0.5), make(rng.randrange(0, 2 * window))]
        rng.shuffle(parts)
        text = " ".join(parts)
        spans, found = dc.Automaton(items, window).scan(text.encode().split())
        n, hit, want = brute.decontaminate(text, items, window)
        assert set(found) == want and sum(b - a + 1 for a, b in spans) == hit


def test_large_benchmark(spark):
    """Five megabytes of test texts are one automaton and one scan; the order of partitions has no part in it."""
    rng = random.Random(4)
    vocabulary = ["".join(rng.choices("abcdefghijklmnop", k=rng.randrange(2, 9))) for _ in range(20_000)]
    items = [(k, " ".join(rng.choices(vocabulary, k=80))) for k in range(12_000)]
    assert sum(len(t) for _, t in items) > 5_000_000
    rows, want = [], {}
    for k in range(600):
        words = rng.choices(vocabulary, k=200)
        if k % 3 == 0:
            item = rng.randrange(len(items))
            own = items[item][1].split()
            n = rng.choice([9, 10, 40])
            at = rng.randrange(0, 80 - n)
            words[50:50] = ["zzz", *own[at : at + n], "zzz"]
            want[k] = (n, [item]) if n >= 10 else (0, [])
        rows.append((k, " ".join(words)))
    bench = spark.createDataFrame(items, "item_id long, text string").repartition(4)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    found = dc.find_windows(df, bench)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    got = {r["doc_id"]: (sum(h["last"] - h["first"] + 1 for h in r["hits"]), r["item_ids"]) for r in found.collect()}
    assert got == {k: want.get(k, (0, [])) for k in range(600)}


def test_too_large_a_benchmark_is_an_error(docs, benchmark, monkeypatch):
    monkeypatch.setattr(dc, "MOST_BYTES", 10)
    with pytest.raises(ValueError, match="test texts"):
        dc.find_windows(docs, benchmark)
