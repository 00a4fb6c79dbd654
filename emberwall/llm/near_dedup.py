"""Near-duplicate documents by an LSH forest over MinHash sketches, confirmed on full shingle sets."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, in_arrow, join_counted, only, text_views
from .components import connected_components, joined_components
from .encoding import grouped
from .shingles import shingle_sets, similar, sketches

#: Orders of the forest, and the sketch values each sorts by. The first DEPTH of an order are its own:
#: two documents at similarity 0.8 share them in some order with probability 1 - (1 - 0.8**4)**24 = 0.999997.
ORDERS, DEPTH, KEYS = 24, 4, 8
BINS = ORDERS * DEPTH
#: Texts are taken apart in groups of about so many bytes, of which some 40 times as much memory is in use.
SCAN_BYTES = 1_000_000
#: All pairs are candidates in a region (documents with a common prefix) of at most so many documents.
REGION = 8
#: Agreement of sketches below which a pair isn't confirmed: at similarity 0.8 lost with probability under 1e-5.
LEAST_AGREEMENT = 0.60


def _positions() -> np.ndarray:
    rng = np.random.default_rng(11)
    own = np.arange(BINS).reshape(ORDERS, DEPTH)
    more = np.array([rng.permutation(np.setdiff1d(np.arange(BINS), o))[: KEYS - DEPTH] for o in own])
    return np.concatenate([own, more], axis=1)


def _sketcher(words: int):
    def run(batches):
        import hashlib

        import pyarrow as pa

        for b in batches:
            texts, n, digest, sketch = text_views(b.column("text")), [], [], []
            for group in grouped(texts, SCAN_BYTES):
                sets = shingle_sets(group, words)
                n += [len(s) for s in sets]
                digest += [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
                sketch += [x.tobytes() for x in sketches(sets, BINS)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("key"), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(sketch, pa.binary())], ["doc_id", "key", "n_shingles", "digest", "sketch"])

    return run


def _ordered(batches):
    """A row for each order: the values it sorts by, packed into two numbers."""
    import pyarrow as pa

    at = _positions()
    for b in batches:
        values = np.frombuffer(b"".join(b.column("sketch").to_pylist()), "<u2").reshape(-1, BINS)
        for k in range(0, len(values), 2000):
            some = values[k : k + 2000][:, at].astype(">u2")  # documents x orders x values
            packed = np.ascontiguousarray(some).view(">u8").astype(np.uint64).view(np.int64).reshape(-1, KEYS // 4)
            n = len(some)
            ids = np.repeat(b.column("node").slice(k, 2000).to_numpy(zero_copy_only=False).astype(np.int64), ORDERS)
            order = np.tile(np.arange(ORDERS, dtype=np.int32), n)
            yield pa.RecordBatch.from_arrays([pa.array(order), pa.array(packed[:, 0]), pa.array(packed[:, 1]), pa.array(ids)], ["tree", "k1", "k2", "node"])


def _depth(k2: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Values (4 to 8) in the common prefix of rows whose first four agree."""
    x = (k2 ^ other).view(np.uint64)
    return DEPTH + (x < 1 << 48).astype(int) + (x < 1 << 32) + (x < 1 << 16) + (x == 0)


def _pairs(tree, k1, k2, ids, first: int, last: int):
    """Candidates (ids i, ids j), j before i, for rows i of [first, last) of a sorted stretch.

    The first item is (None, rows of [first, last) in a region of more than REGION rows).
    """
    n = len(ids)
    same = np.zeros(n, bool)
    same[1:] = (tree[1:] == tree[:-1]) & (k1[1:] == k1[:-1])
    if not same.any():
        return
    prefix = np.zeros(n, np.int64)  # common with the row before
    prefix[1:] = np.where(same[1:], _depth(k2[1:], k2[:-1]), 0)
    sizes = {}
    for d in range(DEPTH, KEYS + 1):
        run = np.cumsum(prefix < d)
        sizes[d] = np.bincount(run)[run]
    size = np.stack([sizes[d] for d in range(DEPTH, KEYS + 1)])
    rows = np.arange(first, last)
    yield None, rows[size[0, first:last] > REGION]
    low = prefix.copy()  # least prefix over the steps from i - lag to i
    for lag in range(1, REGION):
        if lag > 1:
            low[lag:] = np.minimum(low[lag:], prefix[1 : n - lag + 1])
        i = rows[(rows >= lag)]
        i = i[low[i] >= DEPTH]
        if not len(i):
            return
        if lag > 1:
            i = i[size[low[i] - DEPTH, i] <= REGION]
        yield ids[i], ids[i - lag]


def _neighbours(edges: bool):
    """From each sorted partition: candidates (kind 0) and rows of dense regions (kind 2).

    edges: its first and last rows go on too (kind 1), for what lies across partitions.
    """

    def run(batches):
        import pyarrow as pa

        names = ["kind", "a", "b", "tree", "k1", "k2", "node"]

        def pairs_out(found, held):
            for i, j in found:
                if i is None:
                    yield rows_out(2, [x[j] for x in held])
                    continue
                m = i != j
                a, b = np.minimum(i[m], j[m]), np.maximum(i[m], j[m])
                if len(a):
                    z = pa.nulls(len(a), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(a), np.int32)), pa.array(a), pa.array(b), pa.nulls(len(a), pa.int32()), z, z, z], names)

        def rows_out(kind, rows):
            n = len(rows[0])
            z = pa.nulls(n, pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), z, z, *map(pa.array, rows)], names)

        held, began, done = None, False, 0
        for b in batches:
            new = [b.column(k).to_numpy(zero_copy_only=False) for k in ("tree", "k1", "k2", "node")]
            if not len(new[0]):
                continue
            held = new if held is None else [np.concatenate(x) for x in zip(held, new, strict=True)]
            n = len(held[0])
            if edges and not began and n >= REGION:
                began = True
                yield rows_out(1, [x[:REGION] for x in held])
            # The last rows wait for what follows; as many before them stay as context.
            if n - REGION > done:
                yield from pairs_out(_pairs(*held, done, n - REGION), held)
                keep = max(0, n - 3 * REGION)
                held, done = [x[keep:] for x in held], n - REGION - keep
        if held is not None:
            yield from pairs_out(_pairs(*held, done, len(held[0])), held)
            if edges:
                if not began:
                    yield rows_out(1, [x[:REGION] for x in held])
                yield rows_out(1, [x[-REGION:] for x in held])

    return run


def _agreement(batches):
    import pyarrow as pa

    for b in batches:
        x, y = (np.frombuffer(b"".join(b.column(k).to_pylist()), "<u2").reshape(-1, BINS) for k in ("sketch_a", "sketch_b"))
        yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array((x == y).mean(axis=1))], ["a", "b", "agreement"])


def _confirm(words: int, percent: int):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            a, b, good = text_views(batch.column("text_a")), text_views(batch.column("text_b")), []
            at, size = 0, 0
            for k in range(len(a)):
                size += len(a[k]) + len(b[k])
                if size > SCAN_BYTES or k == len(a) - 1:
                    sets = shingle_sets([*a[at : k + 1], *b[at : k + 1]], words)
                    half = len(sets) // 2
                    good += [similar(sets[i], sets[half + i], percent) for i in range(half)]
                    at, size = k + 1, 0
            mask = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], ["a", "b"])

    return run


#: Shingles in more documents than this are frequent: they come last in every set's order. At most so many are frequent.
LONG_LIST, FREQUENT = 64, 500_000
#: Rows of a frequent shingle's list that one task compares with.
BLOCK_ROWS = 1000


def _sets(words: int):
    def run(batches):
        import pyarrow as pa

        for b in batches:
            at = 0
            for group in grouped(text_views(b.column("text")), SCAN_BYTES):
                sets = shingle_sets(group, words)
                flat = pa.array(np.concatenate(sets).view(np.int64)) if sets else pa.array([], pa.int64())
                ends = np.cumsum([0, *map(len, sets)])
                yield pa.RecordBatch.from_arrays([b.column("node").slice(at, len(group)), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)], ["node", "shingles"])
                at += len(group)

    return run


def _prefixes(frequent, percent: int):
    """The first shingles of each set, in an order common to all: those that aren't frequent by hash, then the frequent by rank.

    Two similar sets share one of these, and the first that they share stands so early in both that the rest can
    hold what similarity asks for: most is the size of the largest set that a row's set could still be similar to.
    """

    def run(batches):
        import pyarrow as pa

        keys, ranks = frequent.value
        for b in batches:
            lists, out = b.column("shingles"), []
            values, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
            for k in range(b.num_rows):
                s = values[ends[k] : ends[k + 1]]
                n = len(s)
                rank = np.zeros(n, np.int64)
                if len(keys):
                    at = np.minimum(np.searchsorted(keys, s), len(keys) - 1)
                    rank = np.where(keys[at] == s, ranks[at], 0)
                first = np.lexsort((s, rank))[: n - -(-percent * n // 100) + 1]
                most = (100 + percent) * (n - np.arange(len(first))) // percent - n
                out.append((s[first], np.full(len(first), k), np.full(len(first), n), most, rank[first] > 0))
            if out:
                shingle, row, n, most, often = map(np.concatenate, zip(*out, strict=True))
                of = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(shingle), b.column("node").take(of), b.column("component").take(of), pa.array(n), pa.array(most), pa.array(often)], ["shingle", "node", "component", "n", "most", "often"])

    return run


def _left_over(dense: DataFrame, found: DataFrame, texts: DataFrame, scratch: Scratch, words: int, percent: int) -> DataFrame | None:
    """Candidates (a, b, of_a, of_b, room) between components of_a and of_b that meet in a dense region: a superset of all links; None if no region holds two.

    An exact join of the documents of those regions with size, prefix and position filters. Shingles that are frequent there,
    such as those of boilerplate, come last in the order, so documents that share only them are never compared.
    A list of at most LONG_LIST documents is joined with itself. In a longer list only the documents outside its largest
    component are compared with the others, in blocks. The table of frequent shingles that is broadcast has at most FREQUENT rows.
    """
    labelled = dense.join(found, "node", "left").select("node", "region", F.coalesce("component", "node").alias("component"))
    mixed = labelled.groupBy("region").agg(F.min("component").alias("least"), F.max("component").alias("greatest")).where("least <> greatest")
    meeting = scratch.write(labelled.join(mixed.select("region"), "region", "left_semi").groupBy("node").agg(F.first("component").alias("component")), "meeting")
    if meeting.isEmpty():
        return None
    sets = texts.join(meeting.select("node"), "node", "left_semi").transform(in_arrow, _sets(words), "node long, shingles array<long>")
    sets = scratch.write(sets, "sets")
    counts = sets.select(F.explode("shingles").alias("shingle")).groupBy("shingle").agg(F.count(F.lit(1)).alias("n"))
    counts = scratch.write(counts.where(F.col("n") > LONG_LIST), "counts")
    most = max(LONG_LIST, (counts.agg(F.sum("n")).first()[0] or 0) // FREQUENT)  # fewer than FREQUENT shingles stand more often
    table = counts.where(F.col("n") > most).toPandas()
    keys = table["shingle"].to_numpy(np.int64)
    ranks = np.empty(len(keys), np.int64)
    ranks[np.lexsort((keys, table["n"].to_numpy()))] = np.arange(1, len(keys) + 1)
    by_key = np.argsort(keys)
    shared = sets.sparkSession.sparkContext.broadcast((keys[by_key], ranks[by_key]))
    schema = "shingle long, node long, component long, n long, most long, often boolean"
    rows = scratch.write(sets.join(meeting, "node").transform(in_arrow, _prefixes(shared, percent), schema), "prefixes")

    fits = (F.col("x.component") != F.col("y.component")) & (F.col("x.n") <= F.col("y.most")) & (F.col("y.n") <= F.col("x.most"))
    # How far both sizes are from what the filter would reject: the more, the likelier is a link.
    room = F.least(F.col("x.most") - F.col("y.n"), F.col("y.most") - F.col("x.n")).alias("room")
    ends = F.array_sort(F.array(*[F.struct(f"{k}.node", f"{k}.component") for k in "xy"]))
    pair = [ends[0]["node"].alias("a"), ends[1]["node"].alias("b"), ends[0]["component"].alias("of_a"), ends[1]["component"].alias("of_b"), room]
    few = rows.where("not often")
    lists = few.groupBy("shingle").agg(F.min("component").alias("least"), F.max("component").alias("greatest")).where("least <> greatest").select("shingle")
    few = scratch.write(few.join(lists, "shingle", "left_semi"), "short-lists")
    pairs = few.alias("x").join(few.alias("y"), (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.node") < F.col("y.node")) & fits).select(*pair)

    # Of two similar sets the smaller has room for its own size: without such a row a list gives no pair.
    often = rows.where("often")
    by_component = often.groupBy("shingle", "component").agg(F.count(F.lit(1)).alias("n"), F.max((F.col("most") >= F.col("n")).cast("int")).alias("root"))
    lists = by_component.groupBy("shingle").agg(F.max_by("component", F.struct("n", "component")).alias("largest"), F.sum("n").alias("of"), F.count(F.lit(1)).alias("components"), F.max("root").alias("root"))
    lists = lists.where("components > 1 and root = 1").select("shingle", "largest", F.ceil(F.col("of") / BLOCK_ROWS).cast("int").alias("blocks"))
    lists = F.broadcast(scratch.write(lists, "long-lists"))  # fewer than FREQUENT rows
    held = often.join(lists, "shingle")
    one = held.where("component <> largest").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    other = held.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    at = (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.block") == F.col("y.block"))
    pairs = pairs.union(one.alias("x").join(other.alias("y"), at & fits).select(*pair))
    pairs = scratch.write(pairs.groupBy("a", "b", "of_a", "of_b").agg(F.max("room").alias("room")), "left-over")
    shared.unpersist()
    scratch.drop("sets", "counts", "prefixes", "short-lists", "long-lists", "meeting")
    return pairs


def _repeated_ids(usable: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (a, b) between the classes of documents whose id stands in several rows with unlike texts."""
    ids = usable.groupBy("doc_id").agg(F.min(F.xxhash64("digest")).alias("lo"), F.max(F.xxhash64("digest")).alias("hi")).where("lo <> hi").select("doc_id")
    of = usable.join(ids, "doc_id").select("doc_id", "digest").distinct().join(classes, "digest").select("doc_id", "node")
    least = of.groupBy("doc_id").agg(F.min("node").alias("a"))
    return of.join(least, "doc_id").where("a <> node").select("a", F.col("node").alias("b")).distinct()


def near_duplicates(docs: DataFrame, *, words: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for docs(doc_id, text).

    Documents are linked if their sets of distinct word shingles have a Jaccard similarity of percent
    or more; a component's id is its smallest doc_id, and that document is kept.

    1. One scan makes each document's sketch and a digest of its shingle set. Documents of one
       digest are a class; only one of them, the class's node, goes on, so copies are never paired.
    2. Forest: nodes are sorted by each of ORDERS orders of sketch values, in
       ranges, so that a dense region is split anywhere. Each row is paired with its neighbour if
       at least DEPTH values agree. Regions of up to REGION documents give all their pairs; denser ones
       are taken at greater depth until they are as small, and give chains of neighbours above that.
    3. Pairs whose sketches agree enough are confirmed on full sets made anew from both texts: first
       each document's most alike partner, then, after joining components, the pairs between
       components that are still apart.
    4. Where a dense region still holds several components, depth may have cost links. Its documents go through an
       exact join with prefix and position filters (_left_over), and what it finds is confirmed the same way.

    Documents without words (or text) have no shingle and no link. Rows that repeat a doc_id share its
    component, whatever their texts; a null doc_id has none (null, not kept) and links nothing. Every step between
    scans is written to the shared folder, so a lost executor costs a stage at most; all but the result is deleted. Work
    grows as documents times ORDERS: no step makes all pairs of a group.
    """
    scratch = Scratch(docs.sparkSession, "near-dedup")
    body = only(docs, "doc_id", "text").withColumn("key", F.xxhash64("text"))
    sketched = scratch.write(body.transform(in_arrow, _sketcher(words), "doc_id long, key long, n_shingles long, digest binary, sketch binary"), "sketches")
    usable = sketched.where("n_shingles > 0 and doc_id is not null")
    classes = usable.groupBy("digest").agg(F.min(F.struct("doc_id", "key")).alias("rep"), F.count(F.lit(1)).alias("n"))
    classes = scratch.write(classes.select("digest", F.monotonically_increasing_id().alias("node"), "rep.doc_id", "rep.key", "n"), "classes")
    of = classes.select("node", *[F.col(c).alias(f"of_{c}") for c in ("doc_id", "key", "digest")]).hint("shuffle_hash")
    reps = usable.join(of, (F.col("doc_id") == F.col("of_doc_id")) & (F.col("digest") == F.col("of_digest")) & (F.col("key") == F.col("of_key")))
    reps = scratch.write(reps.dropDuplicates(["of_doc_id", "of_digest", "of_key"]).select("node", "sketch"), "reps")

    keys = ["tree", "k1", "k2", "node"]
    orders = scratch.write(reps.transform(in_arrow, _ordered, "tree int, k1 long, k2 long, node long"), "orders")
    schema = "kind int, a long, b long, tree int, k1 long, k2 long, node long"
    near = scratch.write(orders.repartitionByRange(*keys).sortWithinPartitions(*keys).transform(in_arrow, _neighbours(True), schema), "near")
    scratch.drop("orders")
    # A few rows from each partition's ends: their number is that of the partitions.
    across = near.where("kind = 1").select(*keys).dropDuplicates().repartition(1).sortWithinPartitions(*keys).transform(in_arrow, _neighbours(False), schema)
    pairs = near.where("kind = 0").select("a", "b").union(across.where("kind = 0").select("a", "b")).dropDuplicates(["a", "b"])

    def scored(some: DataFrame, name: str) -> DataFrame:
        """The pairs whose sketches agree enough."""
        side = lambda k: reps.select(F.col("node").alias(k), F.col("sketch").alias(f"sketch_{k}"))
        rows = some.join(side("a"), "a").join(side("b"), "b").transform(in_arrow, _agreement, "a long, b long, agreement double")
        return scratch.write(rows.where(F.col("agreement") >= LEAST_AGREEMENT), name)

    pairs = scored(pairs, "pairs")
    region = F.xxhash64("tree", "k1").alias("region")
    dense = scratch.write(near.where("kind = 2").select("node", region).union(across.where("kind = 2").select("node", region)).distinct(), "dense")
    scratch.drop("near")

    ends = dense.select("node").union(pairs.select("a")).union(pairs.select("b")).distinct()
    wanted = classes.join(ends, "node").select("node", F.col("doc_id").alias("of_doc_id"), F.col("key").alias("of_key"))
    texts = body.join(wanted.hint("shuffle_hash"), (F.col("doc_id") == F.col("of_doc_id")) & (F.col("key") == F.col("of_key")))
    texts = scratch.write(texts.dropDuplicates(["of_doc_id", "of_key"]).select("node", "text"), "texts")

    def confirmed(some: DataFrame, name: str) -> DataFrame:
        of = lambda k: texts.select(F.col("node").alias(k), F.col("text").alias(f"text_{k}"))
        both = some.select("a", "b").join(of("a"), "a").join(of("b"), "b")
        return scratch.write(both.transform(in_arrow, _confirm(words, percent), "a long, b long"), name)

    def tree_of(k: str, found: DataFrame) -> DataFrame:
        return found.select(F.col("node").alias(k), F.col("component").alias(f"tree_{k}"))

    links = scratch.write(_repeated_ids(usable, classes.select("digest", "node")), "repeated")
    best = pairs.groupBy("b").agg(F.max_by("a", F.struct("agreement", "a")).alias("a"))
    links = links.union(confirmed(best, "links-1"))
    found = connected_components(links, scratch, "first")
    apart = pairs.join(best, ["a", "b"], "left_anti").join(tree_of("a", found), "a", "left").join(tree_of("b", found), "b", "left")
    more = confirmed(apart.where(F.coalesce("tree_a", "a") != F.coalesce("tree_b", "b")), "links-2")
    if not more.isEmpty():
        found = joined_components(found, more, scratch, "second")
    left = _left_over(dense, found, texts, scratch, words, percent)
    if left is not None and not left.isEmpty():
        # One link joins two components, and a few likely pairs of each two find most; all pairs still apart follow.
        sides = (F.least("of_a", "of_b").alias("c"), F.greatest("of_a", "of_b").alias("d"))
        key, pair = F.xxhash64("a", "b"), F.struct("a", "b")
        some = left.groupBy(*sides).agg(F.array(F.max_by(pair, F.struct("room", key)), F.max_by(pair, key), F.min_by(pair, key)).alias("some"))
        some = scratch.write(some.select(F.inline("some")).distinct(), "likely")
        found = joined_components(found, confirmed(some, "links-3"), scratch, "third")
        apart = left.join(some, ["a", "b"], "left_anti").select("a", "b").join(tree_of("a", found), "a", "left").join(tree_of("b", found), "b", "left")
        apart = scratch.write(apart.where(F.coalesce("tree_a", "a") != F.coalesce("tree_b", "b")).select("a", "b"), "apart")
        last = None if apart.isEmpty() else confirmed(scored(apart, "left-pairs"), "links-4")
        if last is not None and not last.isEmpty():
            found = joined_components(found, last, scratch, "fourth")

    own = classes.select("digest", "node", F.col("doc_id").alias("rep"), F.col("n").alias("rows")).join(found, "node", "left")
    own = scratch.write(own, "own")
    least = scratch.write(own.where("component is not null").groupBy("component").agg(F.min("rep").alias("least"), F.count(F.lit(1)).alias("n")), "least")
    final = join_counted(own, least, "component").select("digest", F.coalesce("least", "rep").alias("component"), F.col("rows").alias("n"))
    out = join_counted(sketched.select("doc_id", "n_shingles", "digest"), scratch.write(final, "final"), "digest")
    component = F.when(F.col("doc_id").isNull() | (F.col("n_shingles") == 0), F.col("doc_id")).otherwise(F.col("component"))
    out = out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
    return scratch.result(out)
