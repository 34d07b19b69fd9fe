"""A corpus from raw documents to packed sequences: five stages, each written and read again before the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import packing
from textloom.llm.common import KeyFilter, Scratch, stored
from textloom.llm.line_rules import LineRules, without_lines
from textloom.llm.minhash import NearDuplicates, Plan
from textloom.llm.passages import DOCUMENT, RepeatedPassages, text_key, without_stretches
from textloom.llm.quality import QualityScores

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _with_text(docs: DataFrame, text) -> DataFrame:
    """docs with another text, and its length where it was known."""
    return docs.withColumn("text", text).withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast("long"))).select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; lines frequent on a host go from the others.

    A null text has no words and is rejected; a null source is a host of its own; rows without doc_id, repeated ids and
    repeated rows are each judged as they stand. Further columns are dropped. The verdict follows from source and text,
    so it is joined to the rows by a hash of both, and no table of the texts is kept.
    """
    rows = docs.withColumn("key", F.xxhash64(F.coalesce(F.col("source").cast("string"), F.lit("")), "text"))
    verdicts = LineRules(rows, keep=("key",)).verdicts().where("kept").select("doc_id", F.col("kept_key").alias("key"), "removed_lines").dropDuplicates(["doc_id", "key"])
    own, judged = rows.alias("own"), verdicts.alias("judged")
    kept = own.join(judged, F.col("own.doc_id").eqNullSafe(F.col("judged.doc_id")) & (F.col("own.key") == F.col("judged.key"))).select(*[f"own.{c}" for c in COLUMNS], "removed_lines")
    return _with_text(kept, without_lines(F.col("text"), F.col("removed_lines")))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on this stage's labelled documents, doesn't predict as good go.

    Empty and null texts and rows without doc_id are scored like any others; repeated rows are each scored, and count
    each in training. Without labels every score is 0.5, and all documents stay. Ties at the threshold stay.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    scored = QualityScores(docs, labels, keep=COLUMNS[1:]).scores()
    return scored.where("predicted = 1").select("doc_id", *[F.col(f"kept_{c}").alias(c) for c in COLUMNS[1:]])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of similarity 0.8 stays: that of the smallest id. Rows of one id are one document."""
    verdicts = NearDuplicates(docs, Plan(numerator=80, denominator=100, bands=32, rows=4)).verdicts()
    gone = verdicts.where("not kept and doc_id is not null").select("doc_id").distinct()
    return docs.join(stored(gone), "doc_id", "left_anti").select(*COLUMNS)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stretches of words that an earlier document has go; so do documents of which no word is left by that.

    Null texts and rows without doc_id stay as they are; rows equal in id and text lose the same words, rows of one id
    with other texts their own. Only texts that may lose words are exchanged.
    """
    spans = stored(RepeatedPassages(docs).stretches().groupBy(*DOCUMENT).agg(F.collect_list(F.struct("first_word", "n_words")).alias("spans")))
    rows, touched = docs.withColumn("text_key", text_key("text")), KeyFilter(spans, DOCUMENT)
    cut = touched.some(rows).join(spans, DOCUMENT, "left")
    cut = cut.withColumn("text", without_stretches(F.col("text"), F.col("spans")))
    left = cut.where(F.col("spans").isNull() | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return _with_text(left.select(*COLUMNS).unionByName(touched.others(rows).select(*COLUMNS)), F.col("text"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each piece of each document with its bin.

    Null texts and texts without words have no piece; a null doc_id stays null; repeated rows are packed one by one.
    """
    return packing.pack_documents(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("quality classifier", quality_classifier),
    ("min-max near-dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("best-fit packing", best_fit_packing),
]

#: Signatures, the classifier and the packing can't be put in SQL; the tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to the documents of a folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with Scratch(spark) as whole:
        for k, (_, stage) in enumerate(STAGES[:-1]):
            with Scratch(spark) as scratch:
                before, docs = docs, scratch.keep(stored(stage(spark, docs, sf_dir)))
            if k:
                whole.drop(before)
        whole.keep(docs)
    return STAGES[-1][1](spark, docs, sf_dir)
