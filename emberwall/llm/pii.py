"""Personal data: exact base patterns, and identifiers found by patterns that known ones induce.

DataFrame expressions only. Offsets are code points of the original text, ends exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, broadcast_if_small, only

#: Kinds in their fixed order.
KINDS = ("email", "ip", "card", "phone")
#: The contract's patterns with possessive repeats, which match the same and never run back. A run
#: that failed from its start fails from its middle too, so the look-behinds skip that; \G lets a match begin
#: where the last one ended.
LOCAL = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without this has no match, and the pattern isn't run.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}

SPAN = "struct<start:int,kind:int,end:int>"
SPANS = f"array<{SPAN}>"


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    reverse = F.reverse(digits)
    twice = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    numbers = F.transform(F.regexp_extract_all(reverse, F.lit("[0-9]"), F.lit(0)), lambda c, i: F.when(i % 2 == 1, twice(c.cast("int"))).otherwise(c.cast("int")))
    return F.aggregate(numbers, F.lit(0), lambda a, d: a + d) % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        # Leading zeros don't count towards a part's value.
        small = lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.substr(F.ltrim(p, F.lit("0")), F.lit(1), F.lit(3)).try_cast("int"), F.lit(0)) <= 255)
        return F.forall(F.split(match, "\\."), small)
    if kind == "card":
        return F.length(digits).between(14, 19) & luhn(digits)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(True)


def _placed(text: Column, pattern: str, first: int = 0) -> tuple[Column, Column]:
    """All matches of a pattern, and what stands between them: together they are the text."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(first)), F.split(text, pattern, -1)


def _step(kind: str):
    return lambda m, g: F.struct(F.length(g).alias("gap"), F.length(m).alias("n"), _valid(kind, m).alias("ok"))


#: Values that one pass of a running total takes. Spark has no running total for arrays, and one that
#: appends to its result copies that each time; in blocks of blocks the copies stay few for any length.
BLOCK = 128


def running(values: Column, add, zero: Column) -> Column:
    """The running total (by add) of an array column that has been made already, each value included."""

    def one(part, start):
        step = lambda a, x: F.struct(add(a["at"], x).alias("at"), F.concat(a["out"], F.array(add(a["at"], x))).alias("out"))
        return F.aggregate(part, F.struct(start.alias("at"), F.array().cast("array<int>").alias("out")), step)["out"]

    parts = F.transform(F.sequence(F.lit(0), F.expr("0") + F.floor((F.size(values) - 1) / BLOCK).cast("int")), lambda k: F.slice(values, k * BLOCK + 1, F.lit(BLOCK)))
    whole = F.transform(parts, lambda p: F.aggregate(p, zero, lambda a, x: add(a, x)))
    before = F.slice(F.concat(F.array(zero), one(whole, zero)), F.lit(1), F.size(parts))
    return F.when(F.size(values) <= BLOCK, one(values, zero)).otherwise(F.flatten(F.zip_with(parts, before, one)))


def total(values: Column) -> Column:
    return running(values, lambda a, x: a + x, F.lit(0))


def below(marks: str, places: str) -> Column:
    """For each of the places, how many of the marks (both columns of numbers, made already) are smaller, by one sort of both."""
    last = F.lit(2**31 - 1)
    mixed = F.sort_array(F.concat(F.transform(places, lambda x, k: F.struct(x.alias("at"), k.alias("k"))), F.transform(marks, lambda x: F.struct(x.alias("at"), last.alias("k")))))
    found = F.filter(F.transform(mixed, lambda m, i: F.struct(m["k"].alias("k"), i.alias("n"))), lambda m: m["k"] < last)
    return F.transform(F.sort_array(F.transform(found, lambda m, j: F.struct(m["k"].alias("k"), (m["n"] - j).alias("n")))), lambda m: m["n"])


def fenced(df: DataFrame) -> DataFrame:
    """df with all columns made before any is used: expressions above can look into arrays without making them anew."""
    return df.select(F.explode(F.array(F.struct(*[F.col(f"`{c}`") for c in df.columns]))).alias("__x")).select("__x.*")


def with_base(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """The kept columns, text and base: the sorted spans of the four kinds.

    Spark has no function for all matches' places; they follow from the lengths of the matches and of the
    pieces that the same pattern splits off. Texts without digits cost one look each.
    """
    cols = [F.col(f"`{c}`") for c in keep]
    t = F.col(text)
    digit = t.rlike("[0-9]")
    found = []
    for kind in KINDS:
        may = F.contains(t, F.lit(NEEDS[kind])) if NEEDS[kind] else F.lit(True)
        matches, gaps = _placed(t, PATTERNS[kind])
        found += [F.when(may & (digit if kind != "email" else F.lit(True)), x).alias(n) for x, n in ((matches, f"m_{kind}"), (gaps, f"g_{kind}"))]
    df = df.select(*cols, t.alias(text), *found)
    # Arrays are zipped, not looked up from inside a lambda, where Spark could make them anew for each element.
    spans = [F.when(F.size(f"m_{kind}") > 0, F.zip_with(f"m_{kind}", F.slice(f"g_{kind}", F.lit(1), F.size(f"m_{kind}")), _step(kind))).alias(f"s_{kind}") for kind in KINDS]
    df = df.select(*cols, text, *spans)
    sizes = [F.transform(f"s_{kind}", lambda x: x["gap"] + x["n"]).alias(f"l_{kind}") for kind in KINDS]
    df = df.select(*cols, text, *[f"s_{kind}" for kind in KINDS], *sizes)
    df = df.select(*cols, text, *[f"s_{kind}" for kind in KINDS], *[total(F.col(f"l_{kind}")).alias(f"e_{kind}") for kind in KINDS])

    def place(number):
        return lambda x, end: F.when(x["ok"], F.struct((end - x["n"]).alias("start"), F.lit(number).alias("kind"), end.alias("end")))

    placed = [F.coalesce(F.array_compact(F.zip_with(f"s_{kind}", f"e_{kind}", place(number))), F.array().cast(SPANS)) for number, kind in enumerate(KINDS)]
    return df.select(*cols, text, F.sort_array(F.concat(*placed)).alias("base"))


BLANK, WORD = "[\\x20\\x09-\\x0D]", "[^\\x20\\x09-\\x0D]"


#: Rounds of scoring; share of a pattern's weight that must be known; distinct known identifiers it needs.
ROUNDS, LEAST_SCORE, LEAST_SEEDS, DOUBT = 3, 0.8, 4, 1.0


def score_patterns(slots: DataFrame, scratch: Scratch, *, rounds: int = ROUNDS) -> DataFrame:
    """(context, kind, score, seeds) from slots(context, core, seed_kind); a null core is no instance, but weighs.

    The graph joins patterns (contexts) and instances (cores); an edge's weight is the number of
    slots. Instances that are base entities are certain. In each round a pattern's score is the
    share of its weight on instances of a kind (by their scores, with DOUBT added to the whole), and an unknown
    instance's score is that of its patterns taken as independent: 1 less the product of what
    they leave. All steps are grouped sums and joins on keys; a frequent context is summed
    before it moves.
    """
    edges = scratch.write(slots.groupBy("context", "core").agg(F.count(F.lit(1)).alias("n"), F.max("seed_kind").alias("seed_kind")), "edges")
    known = edges.where("seed_kind is not null").groupBy("core").agg(F.max("seed_kind").alias("kind")).withColumn("weight", F.lit(1.0))
    known = scratch.write(known, "known")
    weights = edges.groupBy("context").agg(F.sum("n").alias("total"))
    instances = known
    for k in range(rounds):
        hit = edges.join(instances, "core").groupBy("context", "kind").agg(F.sum(F.col("n") * F.col("weight")).alias("hit"), F.sum(F.when(F.col("weight") == 1.0, 1).otherwise(0)).alias("seeds"))
        patterns = hit.join(weights, "context").select("context", "kind", (F.col("hit") / (F.col("total") + DOUBT)).alias("score"), "seeds")
        patterns = scratch.write(patterns, f"patterns-{k}")
        if k < rounds - 1:
            # Only patterns that seeds support pass scores on; 1e-9 keeps the logarithm finite.
            strong = patterns.where((F.col("score") >= LEAST_SCORE) & (F.col("seeds") >= LEAST_SEEDS))
            fresh = edges.where("seed_kind is null and core is not null").join(strong, "context").groupBy("core", "kind").agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("score"), F.lit(1e-9)))))).alias("weight"))
            fresh = fresh.groupBy("core").agg(F.max_by("kind", "weight").alias("kind"), F.max("weight").alias("weight")).join(known.select("core"), "core", "left_anti")
            instances = known.unionByName(fresh.select("core", "kind", F.least("weight", F.lit(0.999)).alias("weight")))
    return patterns


#: Characters of the shortest identifier that a base pattern matches (a@b.c); most words of an unseen one.
LEAST_CHARS, MOST_WORDS = 5, 8
#: A word after an identifier is known to follow a context if it does so for this share of the context's seeds.
FOLLOWS = 0.1
#: A context can be a pattern if at least this share of its places are base entities of one kind.
LEAST_SHARE = 0.5
START, END = "\u2402", "\u2403"  # stand for words before a text's first and after its last
#: An address spelled out, and a word of several parts.
SPELLED = rf"(?i)^{WORD}++{BLANK}++[(\[]?at[)\]]?{BLANK}++{WORD}++(?:{BLANK}++[(\[]?dot[)\]]?{BLANK}++{WORD}++)++"
INNER = r"[\p{L}\p{N}][^\p{L}\p{N}\x20\x09-\x0D'\u2019]++[\p{L}\p{N}]"
#: What doesn't belong to an identifier at a group's beginning and end; a bracket does if it is closed before the end.
LEAD = r"^[^\p{L}\p{N}+(@]*+(?:\(++(?=[^)]*+\)?[^\p{L}\p{N})]*+$))?+[^\p{L}\p{N}+(@]*+"
TRAIL = r"(?<![^\p{L}\p{N}])[^\p{L}\p{N}]++$"


def _plain_words(text: Column) -> Column:
    """A text's words in lower case, each run of digits as 9."""
    return F.split(F.btrim(F.regexp_replace(F.lower(text), "[0-9]+", "9"), F.lit(" \t\n\x0b\x0c\r")), f"{BLANK}+")


def with_seeds(based: DataFrame, text: str) -> DataFrame:
    """Adds seeds to rows with text and base: each base span's kind, context (the two words before the one it begins in), the word after it, and itself.

    The word that a place lies in is found by sorting the places among the words' starts. Texts without base spans have none.
    """
    others = [F.col(f"`{c}`") for c in based.columns]
    x = F.when(F.size("base") > 0, F.col(text))
    df = _with_starts(based.select(*others, *_taken_apart(x)))

    places = F.transform("base", lambda s: s["start"] + 1), F.transform("base", lambda s: s["end"])
    df = fenced(df.select(*others, "__w", "__pieces", "__at", *[p.alias(n) for p, n in zip(places, ("__p", "__q"), strict=True)]))
    df = fenced(df.select(*others, "__w", "__pieces", "__at", below("__at", "__p").alias("__p"), below("__at", "__q").alias("__q")))

    def seed(z):
        p, q, s = z["p"] - 1, z["q"] - 1, z["s"]
        context = F.concat_ws(" ", F.coalesce(F.get("__w", p - 2), F.lit(START)), F.coalesce(F.get("__w", p - 1), F.lit(START)))
        core = F.substr(F.array_join(F.slice("__pieces", p + 1, q - p + 1), ""), s["start"] - F.get("__at", p) + 1, s["end"] - s["start"])
        return F.struct(s["kind"].alias("kind"), context.alias("context"), F.coalesce(F.get("__w", q + 1), F.lit(END)).alias("right"), core.alias("core"))

    zipped = F.arrays_zip(F.col("base").alias("s"), F.col("__p").alias("p"), F.col("__q").alias("q"))
    return df.select(*others, F.when(F.size("base") > 0, F.transform(zipped, seed)).alias("__seeds"))


def _taken_apart(text: Column) -> list[Column]:
    """A text's blank beginning's length, plain words, and words with the blanks after them."""
    return [F.length(F.regexp_extract(text, f"^{BLANK}*+", 0)).alias("__lead"), _plain_words(text).alias("__w"), F.regexp_extract_all(text, F.lit(f"{WORD}++{BLANK}*+"), F.lit(0)).alias("__pieces")]


def _with_starts(df: DataFrame) -> DataFrame:
    """Adds __at, where each of the words begins, to columns that _taken_apart made."""
    df = fenced(df.withColumn("__sizes", F.transform("__pieces", lambda x: F.length(x))))
    df = fenced(df.withColumn("__ends", F.concat(F.array(F.col("__lead")), total(F.col("__sizes")))).drop("__sizes"))
    starts = F.transform(F.slice("__ends", F.lit(1), F.size("__pieces")), lambda x, k: F.when(k == 0, x).otherwise(x + F.col("__lead")))
    return fenced(df.withColumn("__at", starts).drop("__ends", "__lead"))


def seeded_contexts(seeds: DataFrame) -> DataFrame:
    """(context, rights, known) of the contexts that stand before LEAST_SEEDS or more distinct base entities of a kind.

    No other can become a pattern (score_patterns asks for as many seeds). rights: the words that follow; known: the number of
    base spans of the context's most frequent kind.
    """
    n = seeds.groupBy("context", "kind", "core").agg(F.count(F.lit(1)).alias("n"))
    kinds = n.groupBy("context", "kind").agg(F.count(F.lit(1)).alias("cores"), F.sum("n").alias("n"))
    enough = kinds.where(F.col("cores") >= LEAST_SEEDS).groupBy("context").agg(F.max("n").alias("known"))
    after = seeds.groupBy("context", "right").agg(F.count(F.lit(1)).alias("n"))
    after = after.join(seeds.groupBy("context").agg(F.count(F.lit(1)).alias("of")), "context").where(F.col("n") >= FOLLOWS * F.col("of"))
    # At most 1 / FOLLOWS words for each context.
    return enough.join(after.groupBy("context").agg(F.collect_set("right").alias("rights")), "context")


def places(texts: DataFrame) -> DataFrame:
    """(__row, p, context) of every word of texts(__row, __t), the p-th from 0, with the two words before it."""
    words = texts.select("__row", _plain_words(F.col("__t")).alias("w"))
    back = lambda k: F.concat(F.array_repeat(F.lit(START), k), F.col("w"))
    pairs = words.select("__row", F.posexplode(F.arrays_zip(back(2).alias("a"), back(1).alias("b"), F.col("w").alias("c"))).alias("p", "x")).where("x.c <> ''")
    return pairs.select("__row", "p", F.concat_ws(" ", "x.a", "x.b").alias("context"))


def rare_enough(contexts: DataFrame, counts: DataFrame) -> DataFrame:
    """The contexts without those that stand in so many places (counts of h) that less than LEAST_SHARE of them are known."""
    keyed = contexts.withColumn("of", F.xxhash64("context"))
    counted = keyed.join(counts, F.col("h") == F.col("of"), "left")
    return counted.where(F.col("known") >= LEAST_SHARE * F.coalesce("n", F.lit(0))).select(*contexts.columns)


def frequent_seeds(texts: DataFrame, contexts: DataFrame, scratch: Scratch, *, max_contexts: int = 500_000) -> DataFrame:
    """The contexts of which LEAST_SHARE of the places in all texts(__row, __t, base) are known, so not just any two common words.

    Pairs of words are counted by hash. All pairs in texts that hold base spans come first: a context that stands in too many
    places there does so in all texts. Then only pairs that still are contexts (broadcast where there are no more than
    max_contexts) are counted in all texts, each task's together before they move.
    """
    hashes = lambda some: places(some).select(F.xxhash64("context").alias("h"))
    count = lambda some: some.groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    left = scratch.write(rare_enough(contexts, count(hashes(texts.where(F.size("base") > 0)))), "rare")
    wanted = broadcast_if_small(left.select(F.xxhash64("context").alias("of")), max_contexts)
    return rare_enough(left, count(hashes(texts).join(wanted, F.col("h") == F.col("of"), "left_semi")))


def occurrences(texts: DataFrame, contexts: DataFrame, scratch: Scratch, *, max_contexts: int = 500_000, max_rows: int = 20_000) -> DataFrame:
    """(__row, context, core, start, end, seed_kind) for every place of texts(__row, __t, base) after one of contexts.

    One look at each word of each text finds the places. There, the token group is taken: words with digits as far
    as they go; a spelled-out address; else the words up to one that is known to follow; else a single word of
    several parts. core is null if there is no such group, it is shorter than LEAST_CHARS or a base span lies in it:
    such a place only counts against its context. A place that a base entity begins at is that entity's.
    """
    hits = places(texts).join(broadcast_if_small(contexts, max_contexts), "context")
    rows = scratch.write(hits.groupBy("__row").agg(F.collect_list(F.struct("p", "context", "rights")).alias("hits")), "hits")
    df = texts.join(broadcast_if_small(rows, max_rows), "__row")
    df = _with_starts(df.select("__row", "base", "hits", *_taken_apart(F.col("__t"))))

    def near(h):
        own = F.slice("__pieces", h["p"] + 1, F.lit(MOST_WORDS))
        return F.struct(h["context"].alias("context"), h["rights"].alias("rights"), F.get("__at", h["p"]).alias("at"), own.alias("own"), F.concat(F.slice("__w", h["p"] + 1, F.lit(MOST_WORDS + 1)), F.array(F.lit(END))).alias("plain"))

    df = fenced(df.select("__row", "base", F.transform("hits", near).alias("hits")))
    starts, ends = F.transform("base", lambda s: s["start"]), F.transform("base", lambda s: s["end"])
    reach = F.transform("hits", lambda h: h["at"] + F.length(F.array_join(h["own"], "")))
    df = fenced(df.select("__row", "base", "hits", starts.alias("starts"), ends.alias("ends"), F.transform("hits", lambda h: h["at"]).alias("at"), reach.alias("reach")))
    past = F.concat(F.array(F.lit(-1)), running(F.col("ends"), F.greatest, F.lit(-1)))
    df = fenced(df.select("__row", "base", "hits", past.alias("past"), below("starts", "at").alias("first"), below("starts", "reach").alias("last")))

    def close(h, first, last):
        """The base spans that begin among the hit's words, and whether an earlier one reaches into them."""
        return F.struct(h.alias("h"), F.slice("base", first + 1, last - first).alias("base"), (F.get("past", first) > h["at"]).alias("before"))

    zipped = F.transform(F.arrays_zip("hits", "first", "last"), lambda z: close(z["hits"], z["first"], z["last"]))
    df = df.select("__row", F.explode(zipped).alias("x")).select("__row", "x.h.*", "x.base", "x.before")
    bare = lambda x: F.rtrim(x, F.lit(" \t\n\x0b\x0c\r"))
    first = F.length(bare(F.get("own", F.lit(0))))
    df = df.withColumns(
        {
            "seed": F.get(F.filter("base", lambda b: b["start"] < F.col("at") + first), F.lit(0)),
            "stop": F.array_position(F.transform("plain", lambda x, k: (k > 0) & F.array_contains("rights", x)), True).cast("int") - 1,
            "run": F.array_position(F.transform("own", lambda x, k: ~x.rlike("[0-9]") | ((k > 0) & F.coalesce(F.get("own", k - 1).rlike(f"[.,;:!?]{BLANK}*$"), F.lit(False)))), True).cast("int") - 1,
            "whole": F.array_join("own", ""),
        }
    )
    run = F.when(F.col("run") < 0, F.size("own")).otherwise(F.col("run"))
    some = lambda n: F.array_join(F.slice("own", F.lit(1), n), "")
    stop = F.when(F.col("stop").between(1, MOST_WORDS), F.col("stop"))
    spelled = F.regexp_extract("whole", SPELLED, 0)
    alone = F.get("own", F.lit(0))
    group = F.when(run > 0, some(F.least(run, F.coalesce(stop, run)))).when(spelled != "", spelled).when(stop.isNotNull(), some(stop)).when(alone.rlike(INNER), alone)
    df = df.where("not before").withColumn("group", bare(group))
    df = df.withColumn("tail", F.regexp_replace("group", LEAD, ""))
    df = df.withColumn("core", F.regexp_replace("tail", TRAIL, "")).withColumn("start", F.col("at") + F.length("group") - F.length("tail"))
    df = df.withColumn("end", F.col("start") + F.length("core"))
    good = (F.length("core") >= LEAST_CHARS) & ~F.exists("base", lambda b: (b["start"] < F.col("end")) & (b["end"] > F.col("start")))
    known = F.col("seed").isNotNull()
    text_of = lambda s: F.substr("whole", s["start"] - F.col("at") + 1, s["end"] - s["start"])
    return df.select("__row", "context", F.when(known, text_of(F.col("seed"))).when(good, F.col("core")).alias("core"), F.col("start").cast("int"), F.col("end").cast("int"), F.col("seed.kind").alias("seed_kind"))


def find_pii(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Per row of docs (with text): the kept columns, base (spans of the four kinds), found (by patterns) and spans (both).

    1. One scan finds base spans. Each is an instance; its context is the two words before the word it begins in.
    2. More scans count and take every place after a context that stands before enough of them (frequent_seeds,
       occurrences); where no context does, there is nothing to look for.
    3. Patterns are scored over all these places (score_patterns). Token groups after a high-scoring one that no
       base span touches become spans of its kind.

    Null texts are empty. Rows are told apart by an id given when the scan is written, so repeated
    rows each keep their spans. Without seeds no pattern scores, and spans equals base.
    """
    scratch = Scratch(docs.sparkSession, "pii")
    body = only(docs, *keep, "text").toDF(*keep, "__t").withColumn("__t", F.coalesce("__t", F.lit("")))
    kept = [F.col(f"`{c}`") for c in keep]
    based = with_base(body, "__t", keep).withColumn("__row", F.monotonically_increasing_id())
    based = scratch.write(with_seeds(based, "__t"), "base")
    contexts = scratch.write(seeded_contexts(based.where(F.size("__seeds") > 0).select(F.inline("__seeds"))), "contexts")
    none = F.array().cast(SPANS)
    if not contexts.isEmpty():
        contexts = scratch.write(frequent_seeds(based.select("__row", "__t", "base"), contexts, scratch), "frequent")
    if contexts.isEmpty():
        return based.select(*kept, "base", none.alias("found"), F.col("base").alias("spans"))
    slots = scratch.write(occurrences(based.select("__row", "__t", "base"), contexts, scratch), "slots")
    patterns = score_patterns(slots, scratch).where((F.col("score") >= LEAST_SCORE) & (F.col("seeds") >= LEAST_SEEDS))
    best = patterns.groupBy("context").agg(F.max_by("kind", F.struct("score", "kind")).alias("kind"))
    new = slots.where("seed_kind is null and core is not null").join(best, "context").groupBy("__row").agg(F.sort_array(F.collect_set(F.struct("start", F.col("kind").cast("int").alias("kind"), "end"))).alias("found"))
    joined = based.drop("__t", "__seeds").join(new, "__row", "left")
    found = F.coalesce("found", none)
    return joined.select(*kept, "base", found.alias("found"), F.sort_array(F.concat("base", found)).alias("spans"))


def spans_text(spans: str) -> Column:
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(found: DataFrame) -> DataFrame:
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return found.select("doc_id", *[count(k) for k in range(len(KINDS))], F.sha2(spans_text("base"), 256).alias("base_sha256"), spans_text("spans").alias("spans"))


#: Characters of the pieces that redact cuts a text into: a substring far into a long text is slow to find.
PIECE = 1024


def redact(df: DataFrame, text: str, spans: str) -> DataFrame:
    """df with each of the spans (those that overlap taken together) of the text replaced by its kind in brackets."""
    others = [F.col(f"`{c}`") for c in df.columns]
    some = F.size(spans) > 0
    df = df.select(*others, F.when(some, F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))).alias("__cut"), F.when(some, F.transform(spans, lambda s: s["end"])).alias("__ends"))
    df = fenced(df.select(*others, "__cut", F.when(some, F.concat(F.array(F.lit(0)), running(F.col("__ends"), F.greatest, F.lit(0)))).alias("__past")))
    name = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def between(start, end):
        first = F.floor(start / PIECE).cast("int")
        held = F.slice("__cut", first + 1, F.greatest(F.floor((end - 1) / PIECE).cast("int") - first + 1, F.lit(0)))
        return F.substr(F.array_join(held, ""), start - first * PIECE + 1, F.greatest(end - start, F.lit(0)))

    outer = F.filter(F.zip_with(spans, F.slice("__past", F.lit(1), F.size(spans)), lambda s, past: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), past.alias("past"))), lambda z: z["start"] >= z["past"])
    done = F.transform(outer, lambda z: F.concat(between(z["past"], z["start"]), F.get(name, z["kind"])))
    rest = between(F.element_at("__past", -1), F.length(text))
    out = F.when(some, F.concat(F.array_join(done, ""), rest)).otherwise(F.col(text))
    return df.select(*[out.alias(c) if c == text else F.col(f"`{c}`") for c in df.columns if c not in ("__cut", "__past")])


def redacted(docs: DataFrame, *, max_found: int = 100_000) -> DataFrame:
    """docs with every span of personal data in text replaced; n_chars, where there is one, counts anew.

    Base spans are found again where the text is, so texts don't move for them. Spans found by patterns
    are few; they are joined by doc_id and the text's hash, broadcast if no more than max_found rows have any.
    """
    columns = docs.columns
    keyed = docs.withColumn("__key", F.xxhash64("text"))
    found = find_pii(keyed, ["doc_id", "__key"]).where(F.size("found") > 0).select(F.col("doc_id").alias("__id"), F.col("__key").alias("__of"), "found").dropDuplicates(["__id", "__of"])
    joined = keyed.join(broadcast_if_small(found, max_found), F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__key") == F.col("__of")), "left")
    joined = joined.withColumn("__t", F.coalesce("text", F.lit("")))
    based = with_base(joined, "__t", [*columns, "found"])
    spans = F.sort_array(F.concat("base", F.coalesce("found", F.array().cast(SPANS))))
    out = redact(based.withColumn("__spans", spans), "__t", "__spans").withColumn("text", F.when(F.col("text").isNotNull(), F.col("__t")))
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.when(F.size("__spans") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*[F.col(f"`{c}`") for c in columns])
