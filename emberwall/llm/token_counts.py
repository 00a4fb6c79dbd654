"""Token counts by a digest cache: only texts whose digest has no stored count are encoded."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import encoding
from .common import Scratch, in_arrow, join_counted, only, text_views

CACHE_SCHEMA = "digest binary, n_tokens long"


def _counter(path: str):
    def run(batches):
        import pyarrow as pa

        counter = encoding.shared(encoding.ByteCounter, path)
        for b in batches:
            n = pa.array(list(counter.count(text_views(b.column("text")))), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("digest"), n], ["digest", "n_tokens"])

    return run


#: Rows up to which the documents to encode, or those to pass over, are broadcast as keys of 16 bytes.
MOST_KEYS = 500_000


def count_tokens(docs: DataFrame, tokenizer: str, cache_dir: str, *, limit: int = 1024, most_keys: int = MOST_KEYS) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for each row of docs(doc_id, text).

    A text is normalised to itself, null to the empty text, since any other change could change
    its count. Its SHA-256 and the tokenizer's digest (file and library version) form the key.
    Only keys are joined to the cache, each digest once. Of the digests that it lacks, one carrier row each is encoded,
    and the counts are appended to cache_dir. Texts stay where they are read if the carriers are few, as with a
    warm cache, or the other rows are, as with few repeats: the few's keys are broadcast. Else
    carriers are found by a shuffle. Then all rows are joined to the counts, digests of very many rows by broadcast.
    Rows that repeat share one encoding; each keeps its own result row. An empty table gives an
    empty result; null doc_ids stay null.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "tokens")
    stored = f"{cache_dir}/{encoding.tokenizer_digest(tokenizer)}"
    body = only(docs, "doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    body = body.withColumn("digest", F.unhex(F.sha2("text", 256)))
    keys = scratch.write(body.select("doc_id", "digest", F.octet_length("text").cast("long").alias("n_bytes")), "keys")

    spark.createDataFrame([], CACHE_SCHEMA).write.mode("append").parquet(stored)
    cached = spark.read.schema(CACHE_SCHEMA).parquet(stored).dropDuplicates(["digest"])
    digests = keys.groupBy("digest").agg(F.min("doc_id").alias("carrier"), F.count(F.lit(1)).alias("n"))
    digests = scratch.write(digests.join(cached, "digest", "left"), "digests")
    misses, rows = digests.where("n_tokens is null").agg(F.count(F.lit(1)), F.sum("n")).first()
    if misses:
        missing = digests.where("n_tokens is null").select(F.col("digest").alias("of"), "carrier")
        same = (F.col("digest") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("carrier"))
        total = keys.count()
        own = [F.xxhash64("doc_id", "digest").alias("own1"), F.xxhash64("digest", "doc_id").alias("own2")]
        if min(misses, total - misses) > most_keys:
            todo = body.join(missing.hint("shuffle_hash"), same, "left_semi")
        elif misses <= total - misses:
            wanted = keys.join(missing, same, "left_semi").select(*own).distinct()
            todo = body.select("*", *own).join(F.broadcast(wanted), ["own1", "own2"], "left_semi")
        else:
            # Nearly all rows are carriers: the others are passed over.
            others = keys.join(missing, same, "left_anti").select(*own).distinct()
            todo = body.select("*", *own).join(F.broadcast(others), ["own1", "own2"], "left_anti")
        # Rows that repeat the carrier itself are encoded with it, and stored once.
        new = todo.select("digest", "text").transform(in_arrow, _counter(tokenizer), CACHE_SCHEMA).dropDuplicates(["digest"])
        new = scratch.write(new, "new")
        new.write.mode("append").parquet(stored)
        counts = digests.withColumnRenamed("n_tokens", "known").join(new, "digest", "left").select("digest", F.coalesce("known", "n_tokens").alias("n_tokens"), "n")
        digests = scratch.write(counts, "counts")
    out = join_counted(keys, digests.select("digest", "n_tokens", "n"), "digest")
    return scratch.result(out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")))
