"""One query for each corpus operator, over whole tables, with the columns that are checked."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import bpe, hamming, packing, sharding, token_file
from textloom.llm.common import scratch_dir
from textloom.llm.cross_entropy import Losses
from textloom.llm.line_rules import LEAST_DOCS, LEAST_LEFT, LEAST_WORDS, LineRules
from textloom.llm.minhash import NearDuplicates
from textloom.llm.passages import RepeatedPassages
from textloom.llm.quality import QualityScores

N_SHARDS = 40


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each piece of each document with its bin; lengths in words."""
    return packing.pack_documents(documents(spark, sf_dir))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    both = bpe.encode(documents(spark, sf_dir).select("doc_id", "text"), ranks, public_tokenizers.PATTERN, decoded="decoded")
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(bpe.ids_text(F.col("ids")), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_cross_entropy_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's losses; the target are the documents labelled as of good quality, the background all others."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").groupBy("doc_id").agg((F.max("quality") == 1).alias("target"))
    return Losses(documents(spark, sf_dir).select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, labels).scores()


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return QualityScores(documents(spark, sf_dir), labels).scores().select("doc_id", "held_out", "score", "predicted")


def op5_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(public_tokenizers.path("byte_bpe_50k.json")) as f:
        definition = f.read()
    folder = scratch_dir(spark)
    token_file.write(documents(spark, sf_dir), definition, folder)
    return token_file.read(spark, folder, crc32="ids_crc32").select("doc_id", "start", "n_tokens", "ids_crc32")


def op6_histogram_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_documents(documents(spark, sf_dir), N_SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_multi_index_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hamming.search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op8_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return LineRules(documents(spark, sf_dir)).verdicts().select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_words")


def op9_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return NearDuplicates(documents(spark, sf_dir)).verdicts()


def op10_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stretches that go, and for each the document that keeps its words."""
    return RepeatedPassages(documents(spark, sf_dir)).stretches().drop("text_key")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_best_fit_packing, op2_byte_bpe, op3_cross_entropy_difference, op4_quality_classifier, op5_token_file, op6_histogram_sharding, op7_multi_index_hashing, op8_line_rules, op9_minhash_dedup, op10_repeated_passages)}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_LINE_WORDS = rf"regexp_extract_all(translate(raw, '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+')"

#: Only what SQL can express: the other operators have encoders, fits, hashes or packings that DuckDB lacks.
ORACLES: dict[str, str] = {
    "op9_minhash_dedup": rf"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS l FROM documents),
s AS (SELECT doc_id, CASE WHEN len(l) = 0 THEN [] WHEN len(l) < 5 THEN [array_to_string(l, ' ')] ELSE list_distinct(list_transform(range(1, len(l) - 3), lambda i: array_to_string(l[i:i + 4], ' '))) END AS h FROM w),
u AS (SELECT doc_id, len(h) AS n, unnest(h) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared, any_value(a.n) AS na, any_value(b.n) AS nb FROM u a JOIN u b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p WHERE 100 * shared >= 85 * (na + nb - shared)), z AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, z.b FROM r JOIN z ON r.b = z.a), c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT doc_id, len(h)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN c ON c.a = s.doc_id""",
    "op8_line_rules": rf"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, host, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS l FROM d),
b AS (SELECT r, doc_id, host, len(l)::BIGINT AS n_words, coalesce(list_sum(list_transform(l, lambda x: length(x))), 0)::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, translate(array_to_string(l, ' '), '{_UPPER}', '{_LOWER}') AS body FROM w),
i AS (SELECT r, l, unnest(range(1, len(l) - 1)) AS k FROM w WHERE len(l) >= 3), g AS (SELECT r, k, l[k] || ' ' || l[k + 1] || ' ' || l[k + 2] AS x FROM i), often AS (SELECT r, x FROM g GROUP BY ALL HAVING count(*) > 1),
c AS (SELECT r, count(DISTINCT p)::BIGINT AS n_repeat_words FROM (SELECT r, unnest([k, k + 1, k + 2]) AS p FROM g JOIN often USING (r, x)) GROUP BY r),
n0 AS (SELECT r, unnest(string_split(t, chr(10))) AS raw FROM d), n1 AS (SELECT r, raw, {_LINE_WORDS} AS own FROM n0), n AS (SELECT r, raw, array_to_string(own, ' ') AS line, len(own) AS words FROM n1 WHERE len(own) > 0),
dup AS (SELECT r, (count(*) - count(DISTINCT raw))::BIGINT AS n_dup_lines FROM n GROUP BY r), f AS (SELECT host, line FROM n JOIN b USING (r) GROUP BY ALL HAVING count(DISTINCT body) >= {LEAST_DOCS}),
gone AS (SELECT r, sum(words)::BIGINT AS removed_words FROM n JOIN b USING (r) JOIN f USING (host, line) GROUP BY r),
a AS (SELECT b.*, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(removed_words, 0)::BIGINT AS removed_words FROM b LEFT JOIN dup USING (r) LEFT JOIN c USING (r) LEFT JOIN gone USING (r)),
z AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM a)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT (removed_words > 0 AND (n_words - removed_words < {LEAST_WORDS} OR n_words - removed_words < {LEAST_LEFT} * n_words)) AS kept, removed_words FROM z""",
}
