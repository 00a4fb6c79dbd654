"""Language identification: text likelihood, declared language, address suffix and host priors in one posterior."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, broadcast_if_small, in_arrow, only, text_views
from .encoding import grouped

#: Buckets of hashed byte trigrams.
BUCKETS = 1 << 16
#: Texts are scored in groups of about so many bytes.
SCAN_BYTES = 1_000_000
#: Labelled documents per language that the text model is fitted on, at most, and at least.
FIT_DOCS, LEAST_DOCS = 500, 5
#: Trigrams overlap and repeat, so the evidence of a text counts as that of half its trigrams, and of CEILING at most.
WEIGHT, CEILING = 0.5, 400
#: Chance that a declared language or suffix's usual language is wrong, and weight (in documents) of each level's parent.
WRONG, PULL = 0.1, 20.0
#: Share of documents, before they are looked at, that are noise or in a language without labels.
OTHER = 0.01

_LOWER = np.arange(256, dtype=np.uint32)
_LOWER[65:91] += 32
_LOWER[[9, 10, 11, 12, 13]] = 32
#: ASCII digits and punctuation say nothing about a language.
_MUTE = np.zeros(256, bool)
_MUTE[33:65] = _MUTE[91:97] = _MUTE[123:127] = True


@dataclass(frozen=True)
class TextModel:
    """All labelled languages. The first len(table) have a text model; the others are too rare for one."""

    languages: tuple[str, ...]
    #: Log of a bucket's probability over that of the background (all buckets alike), a row for each language
    #: with a text model; a last bucket of zeros is for what doesn't count.
    table: np.ndarray
    #: Share of each language among the labels.
    shares: tuple[float, ...] = ()


def _trigrams(texts: list[memoryview]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all byte trigrams (those that don't count: BUCKETS), and where each text's begin."""
    raw = np.frombuffer(b"".join(b"  %b  " % bytes(t) for t in texts), np.uint8)
    lengths = np.array([len(t) + 4 for t in texts], np.int64)
    x = _LOWER[raw]
    code = x[:-2] | (x[1:-1] << np.uint32(8)) | (x[2:] << np.uint32(16))
    bucket = ((code * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int32)
    mute = _MUTE[raw]
    bucket[mute[:-2] | mute[1:-1] | mute[2:] | ((x[:-2] == 32) & (x[1:-1] == 32)) | ((x[1:-1] == 32) & (x[2:] == 32))] = BUCKETS
    return np.append(bucket, [BUCKETS, BUCKETS]), np.cumsum(lengths) - lengths


def _letters(texts: list[memoryview]) -> np.ndarray:
    """Bytes of each text that are ASCII letters or no ASCII at all."""
    raw = np.frombuffer(b"".join(b"%b " % bytes(t) for t in texts), np.uint8)
    lengths = np.array([len(t) + 1 for t in texts], np.int64)
    x = _LOWER[raw]
    return np.add.reduceat(((x >= 97) & (x <= 122) | (x >= 128)).astype(np.int64), np.cumsum(lengths) - lengths)


def _counted(batches):
    """How often each language's texts have each bucket, a row for each that occurs in a group of texts."""
    import pyarrow as pa

    for b in batches:
        k, at = b.column("k").to_numpy(), 0
        for group in grouped(text_views(b.column("text")), SCAN_BYTES):
            bucket, begins = _trigrams(group)
            sizes = np.diff(np.append(begins, len(bucket)))
            code = np.repeat(k[at : at + len(group)].astype(np.int64), sizes) * (BUCKETS + 1) + bucket
            found, n = np.unique(code, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array((found // (BUCKETS + 1)).astype(np.int32)), pa.array((found % (BUCKETS + 1)).astype(np.int32)), pa.array(n)], ["k", "bucket", "n"])
            at += len(group)


def fit(docs: DataFrame, *, label: str = "lang", per_language: int = FIT_DOCS) -> TextModel:
    """A trigram model from at most per_language (in expectation) labelled documents of each language, picked by hash.

    Trigrams are counted where the texts are; the driver gets the sums. All else in this module covers all rows.
    """
    rows = only(docs, "doc_id", "text", label).toDF("doc_id", "text", "label").where("label is not null and text is not null")
    counts = {r[0]: r[1] for r in rows.groupBy("label").count().collect()}  # a row for each language
    ample, rare = sorted(k for k in counts if counts[k] >= LEAST_DOCS), sorted(k for k in counts if counts[k] < LEAST_DOCS)
    languages, total = (*ample, *rare), sum(counts.values())
    shares = tuple(counts[k] / total for k in languages)
    if not ample:
        return TextModel(languages, np.zeros((0, BUCKETS + 1), np.float16), shares)
    share = F.broadcast(docs.sparkSession.createDataFrame([(k, min(1.0, per_language / counts[k])) for k in ample], "of string, share double"))
    picked = rows.join(share, F.col("label") == F.col("of")).where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000)) < F.col("share") * 1_000_000)
    at = F.create_map(*[x for i, k in enumerate(ample) for x in (F.lit(k), F.lit(i))])
    rows = picked.select(at[F.col("label")].alias("k"), "text").transform(in_arrow, _counted, "k int, bucket int, n long")
    # A row for each language and bucket in use: no more than the model's own cells.
    sums = rows.groupBy("k", "bucket").agg(F.sum("n").alias("n")).toPandas()
    seen = np.zeros((len(ample), BUCKETS + 1), np.float32)
    seen[sums["k"].to_numpy(), sums["bucket"].to_numpy()] = sums["n"].to_numpy()
    table = np.zeros(seen.shape, np.float16)
    for i, row in enumerate(seen):
        row = row[:BUCKETS] + 0.05
        table[i, :BUCKETS] = np.log(row / row.sum(dtype=np.float64)) + np.log(BUCKETS)
    return TextModel(languages, table, shares)


def _scorer(shared, names: list[str], scanned: str):
    def run(batches):
        import pyarrow as pa

        model = shared.value
        for b in batches:
            logs, letters = [], []
            for group in grouped(text_views(b.column(scanned)), SCAN_BYTES):
                bucket, begins = _trigrams(group)
                n = np.add.reduceat((bucket < BUCKETS).astype(np.int64), begins)
                sums = np.zeros((len(group), len(model.languages)))
                for k, row in enumerate(model.table):
                    sums[:, k] = np.add.reduceat(row[bucket], begins, dtype=np.float64)
                logs.append(sums * (np.minimum(n * WEIGHT, CEILING) / np.maximum(n, 1))[:, None])
                letters.append(_letters(group))
            flat = np.concatenate(logs).ravel() if logs else np.zeros(0)
            width = len(model.languages)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * width), pa.array(flat, pa.float64()))
            count = pa.array(np.concatenate(letters) if letters else np.zeros(0, np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([*[b.column(k) for k in names], lists, count], [*names, "log_text", "n_letters"])

    return run


def score_text(docs: DataFrame, model: TextModel, carry: list[str]) -> DataFrame:
    """The carried columns, log_text (for each language, its log likelihood over the background's) and n_letters (bytes of letters), of whole texts."""
    scanned = "text" if "text" in carry else "__scanned"
    body = only(docs, *carry, *([] if scanned == "text" else ["text"])).toDF(*carry, *([] if scanned == "text" else [scanned]))
    ddl = ", ".join(f"`{c}` {t}" for c, t in body.dtypes if c in carry)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 128 KB for each language with a text model
    return body.transform(in_arrow, _scorer(shared, carry, scanned), f"{ddl}, log_text array<double>, n_letters long")


def _literal(model: TextModel) -> Column:
    return F.lit(list(model.languages))


def host_priors(scored: DataFrame, model: TextModel) -> DataFrame:
    """(host, suffix, prior): log prior of each language, smoothed towards the suffix's and the suffix's towards all rows'.

    Grouped counts of the text's own best language, over all rows: the table of counts has a row for
    each host and language, and is aggregated where the rows are before it moves. A text that the background explains
    better counts for its declared language if that has no text model, else for none.
    """
    n, modelled = len(model.languages), len(model.table)
    best = F.array_position("log_text", F.array_max("log_text")) - 1
    rare = F.array_position(_literal(model), F.col("declared")) - 1
    own = F.when(F.array_max("log_text") > 0, best).when(rare >= modelled, rare)
    scratch = Scratch(scored.sparkSession, "hosts")
    # Hosts without any such text have a row too, of no language.
    counted = scratch.write(scored.groupBy("host", "suffix", F.when(F.col("n_letters") > 0, own).alias("k")).agg(F.count(F.lit(1)).alias("n")), "counts")
    entries = F.map_from_entries(F.collect_list(F.when(F.col("k").isNotNull(), F.struct("k", "n")))).alias("of_k")
    dense = lambda m: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.coalesce(F.try_element_at(m, k.cast("long")), F.lit(0)).cast("double"))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    level = lambda c, above: F.zip_with(c, above, lambda x, y: (x + PULL * y) / (total(c) + PULL))
    tables = lambda *by: (counted.groupBy(*by, "k").agg(F.sum("n").alias("n")).groupBy(*by).agg(entries)).select(*by, dense(F.col("of_k")).alias("c"))
    whole = tables().select(F.transform("c", lambda x: (x + 1) / (total(F.col("c")) + n)).alias("g"))
    suffixes = tables("suffix").crossJoin(F.broadcast(whole)).select(F.col("suffix").alias("of"), level(F.col("c"), F.col("g")).alias("s"))  # one row
    joined = tables("host", "suffix").join(broadcast_if_small(scratch.write(suffixes, "suffixes"), 100_000), F.col("suffix").eqNullSafe(F.col("of")))
    return joined.select("host", "suffix", F.transform(level(F.col("c"), F.col("s")), lambda x: F.log(x)).alias("prior"))


def fuse(scored: DataFrame, priors: DataFrame, model: TextModel, carry: list[str], *, least: float = 0.5, max_hosts: int = 50_000) -> DataFrame:
    """Adds language, posterior and accepted.

    Posterior of a language: its text likelihood, times that of the declared language (right
    with probability 1 - WRONG), times the host's prior (which holds the suffix's). The background, for noise and for
    languages without labels, takes part: all trigrams alike, prior OTHER, and a declaration that is wrong. A
    document is rejected if no language reaches least, or its text has no letters at all; language is then the likeliest still. Null hosts, suffixes and
    declarations are simply no evidence of their own: null hosts share one prior.
    """
    n = len(model.languages)
    if not n:
        return scored.select(*[F.col(f"`{c}`") for c in carry], F.lit(None).cast("string").alias("language"), F.lit(None).cast("double").alias("posterior"), F.lit(False).alias("accepted"))
    right, wrong = float(np.log(1 - WRONG)), float(np.log(WRONG / max(1, n - 1)))
    known = F.array_contains(_literal(model), F.col("declared"))
    stated = F.transform(_literal(model), lambda x: F.when(F.coalesce(known, F.lit(False)), F.when(x == F.col("declared"), right).otherwise(wrong)).otherwise(0.0))
    share = F.try_element_at(F.lit(list(model.shares)), F.array_position(_literal(model), F.col("declared")).cast("int"))
    other = float(np.log(OTHER)) + F.when(F.coalesce(known, F.lit(False)), F.log(WRONG * share)).otherwise(0.0)
    small = broadcast_if_small(priors.select(F.col("host").alias("of_host"), F.col("suffix").alias("of_suffix"), "prior"), max_hosts)
    joined = scored.join(small, F.col("host").eqNullSafe(F.col("of_host")) & F.col("suffix").eqNullSafe(F.col("of_suffix")))
    logs = F.zip_with(F.zip_with("log_text", "prior", lambda x, y: x + y), stated, lambda x, y: x + y)
    joined = joined.withColumn("__logs", logs).withColumn("__other", other)
    top = F.array_max("__logs")
    joined = joined.select(
        *[F.col(f"`{c}`") for c in carry],
        F.get(_literal(model), (F.array_position("__logs", top) - 1).cast("int")).alias("language"),
        (1 / F.aggregate("__logs", F.exp(F.col("__other") - top), lambda a, x: a + F.exp(x - top))).alias("posterior"),
        F.col("n_letters"),
    )
    return joined.withColumn("accepted", (F.col("posterior") >= least) & (F.col("n_letters") > 0)).drop("n_letters")


def page_evidence(pages: DataFrame) -> DataFrame:
    """(page_id, text, declared, host, suffix) of web pages: visible text, the markup's language, and the address's parts."""
    # A script, style or comment without an end runs to the end of the page, so each is looked for once.
    text = F.regexp_replace("html", "(?is)<script\\b(?:.*?</script\\s*+>|.*+)|<style\\b(?:.*?</style\\s*+>|.*+)|<!--(?:.*?-->|.*+)|<[^>]*+>", " ")
    host = F.lower(F.regexp_extract("url", "(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    declared = F.lower(F.regexp_extract("html", "(?i)<html\\b[^>]*?\\blang\\s*=\\s*[\"']?([a-z]{2,3})\\b", 1))
    blank = lambda c: F.when(c != "", c)
    return pages.select("page_id", text.alias("text"), blank(declared).alias("declared"), blank(host).alias("host"), blank(F.substring_index(host, ".", -1)).alias("suffix"))


def document_evidence(docs: DataFrame) -> DataFrame:
    """Adds declared (the table's lang), host (its source) and suffix (none) to documents."""
    return docs.withColumns({"declared": F.col("`lang`"), "host": F.col("`source`"), "suffix": F.lit(None).cast("string")})
