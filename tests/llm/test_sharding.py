import itertools
import zlib
from collections import Counter

import pytest

from emberwall.llm import sharding
from tests.llm import cases


@pytest.mark.parametrize(("dims", "bits"), [(2, 4), (3, 3), (4, 2)])
def test_curve_visits_neighbours(dims, bits):
    place = {sharding.hilbert_index(p, bits): p for p in itertools.product(range(1 << bits), repeat=dims)}
    assert sorted(place) == list(range(1 << (dims * bits)))
    for k in range(len(place) - 1):
        assert sum(abs(a - b) for a, b in zip(place[k], place[k + 1], strict=True)) == 1


@pytest.mark.parametrize("parts", [1, 5])
def test_law_of_rows(docs, parts):
    got = sharding.hilbert_shards(docs.repartition(parts)).collect()
    want = Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in cases.ROWS)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    shards = {}
    for r in got:
        assert r["law"] == "rows" and r["grown_shard"] is None
        shards.setdefault(r["shard"], []).append(r["slot"])
    assert set(shards) == set(range(8))
    assert all(sorted(s) == list(range(len(s))) for s in shards.values())
    assert max(map(len, shards.values())) - min(map(len, shards.values())) <= 1
    ordered = sorted(got, key=lambda r: (r["shard"], r["slot"]))
    assert [r["curve"] for r in ordered] == sorted(r["curve"] for r in got)


def test_empty_table_and_few_rows(no_docs, docs):
    assert sharding.hilbert_shards(no_docs).collect() == []
    got = sharding.hilbert_shards(docs.where("doc_id < 3")).collect()
    assert len(got) == 3 and {r["slot"] for r in got} == {0}


def cells(rows, bits):
    """Each row's cell by the definition: for each dimension, how many of its quantiles are smaller."""
    kinds = [lambda r: r[2] or "", lambda r: r[3] or ""]
    out = []
    for value in kinds:
        ordered, n = sorted(map(value, rows)), 1 << bits
        cuts = [ordered[-(-k * len(rows) // n) - 1] for k in range(1, n)]
        out.append([sum(value(r) > c for c in cuts) for r in rows])
    return list(zip(*out, strict=True))


@pytest.mark.parametrize("bits", [2, 3])
def test_quantiles_take_whole_values(spark, bits):
    """Addresses with a long common beginning, one of them hot, and nulls."""
    import random

    from pyspark.sql import functions as F

    from emberwall.llm.common import Scratch

    rng = random.Random(bits)
    rows = [(k, "t", rng.choice(["en", "de", None]), rng.choice(["http://site.org/common/path/a", f"http://site.org/common/path/{rng.randrange(40):03d}", None]), k) for k in range(1000)]
    df = spark.createDataFrame(rows, cases.COLUMNS).repartition(5)
    cuts = sharding.text_cuts(df, ["lang", "source"], bits, Scratch(spark, "t"))
    got = df.select("doc_id", *[sharding.bucket(F.coalesce(n, F.lit("")), cuts[n]).alias(n) for n in ("lang", "source")]).collect()
    assert {r["doc_id"]: (r["lang"], r["source"]) for r in got} == dict(enumerate(cells(rows, bits)))
    assert len({r["source"] for r in got}) > 2


def test_shards_can_be_pruned(spark, tmp_path):
    """Written by shard, most files' ranges exclude a value of any dimension."""
    rows = [(k, "t", ["de", "en", "es", "fr"][k % 4], f"http://a.org/{(k * 31) % 16:02d}", (k * 7919) % 10_000) for k in range(4096)]
    got = sharding.hilbert_shards(spark.createDataFrame(rows, cases.COLUMNS), shards=64).collect()
    held = {}
    for r in got:
        held.setdefault(r["shard"], []).append(rows[r["doc_id"]])
    for column, values in ((2, ["de", "en", "es", "fr"]), (3, ["http://a.org/03", "http://a.org/12"]), (4, [100, 5000, 9000]), (0, [10, 2000, 4000])):
        for value in values:
            read = [s for s, rs in held.items() if min(r[column] for r in rs) <= value <= max(r[column] for r in rs)]
            assert len(read) <= 0.6 * 64


def test_native(docs):
    plan = sharding.hilbert_shards(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
