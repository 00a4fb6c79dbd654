"""The corpus pipeline: language, near-duplicates, benchmark passages, personal data, packing.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame that is written and read again
as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, language, near_dedup, packing, pii
from .common import Scratch, broadcast_if_small, sheltered, swept, table
from .queries import END_ID, tokenizer_path


#: The columns of documents; others that a table may have are carried along untouched.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found with confidence stay.

    What is decided depends on text, lang and source alone. Scores are stored once, under a key of these; the keys of what is
    rejected then remove rows where the texts are, by broadcast if they are few.
    """
    model, scratch = language.fit(docs), Scratch(spark, "language")

    def stage(rows: DataFrame) -> DataFrame:
        parts = [F.col(c) for c in ("text", "lang", "source")]
        known = F.concat(*[F.when(c.isNull(), "0").otherwise("1") for c in parts])
        keyed = rows.withColumns({"__key1": F.xxhash64(known, *parts), "__key2": F.xxhash64(*reversed(parts), known)})
        scored = language.score_text(language.document_evidence(keyed), model, ["__key1", "__key2", "declared", "host", "suffix"])
        scored = scratch.write(scored, "scored")
        judged = language.fuse(scored, language.host_priors(scored, model), model, ["__key1", "__key2"])
        gone = scratch.write(judged.where("not accepted").select("__key1", "__key2").distinct(), "rejected")
        scratch.drop("scored")
        return keyed.join(broadcast_if_small(gone, 500_000), ["__key1", "__key2"], "left_anti").select(*rows.columns)

    return sheltered(docs, COLUMNS, stage)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest doc_id of each group stays (five words, similarity 0.8).

    Rows that repeat that document's id with the same text go too, but for one; rows of its id with other texts stay.
    """
    found = near_dedup.near_duplicates(docs, words=5, percent=80)
    gone = found.where("not kept and doc_id is not null").select("doc_id").distinct()
    twice = docs.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id")

    def stage(rows: DataFrame) -> DataFrame:
        left = rows.join(gone.hint("shuffle_hash"), "doc_id", "left_anti")
        again = Scratch(spark, "repeated").write(twice, "ids")
        if again.isEmpty():
            return left
        once = left.join(again, "doc_id", "left_anti")
        return once.unionByName(left.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]))

    return sheltered(docs, COLUMNS, stage)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with any window of a benchmark item go."""
    benchmark = table(spark, sf_dir, "benchmark")
    return sheltered(docs, COLUMNS, lambda rows: decontamination.find_windows(rows, benchmark, carry=tuple(rows.columns)).where(F.size("hits") == 0))


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; personal data in them is replaced by its kind."""
    return sheltered(docs, COLUMNS, pii.redacted)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"), end_id=END_ID)


STAGES = [
    ("language_id", language_id),
    ("minhash_near_dedup", minhash_near_dedup),
    ("benchmark_decontamination", decontaminate),
    ("pii_redaction", redact_pii),
    ("cost_balanced_packing", pack_sequences),
]

#: SQL can express neither the language model nor the tokenizer; tests compare with a plain Python version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written to the shared folder and read again; only the last one's table is left."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        with swept(spark):
            docs = scratch.write(stage(spark, docs, sf_dir), f"{k}-{name}")
        if k:
            scratch.drop(f"{k - 1}-{STAGES[k - 1][0]}")
    return docs
