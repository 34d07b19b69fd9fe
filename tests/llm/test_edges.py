"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every corpus operator."""

import hashlib
import weakref
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textloom.llm import bpe, cross_entropy, hamming, packing, queries, sharding, token_file
from textloom.llm.cross_entropy import Losses
from textloom.llm.line_rules import LineRules
from textloom.llm.minhash import NearDuplicates
from textloom.llm.passages import RepeatedPassages
from textloom.llm.quality import QualityScores

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PASSAGE = " ".join(f"passage{k}" for k in range(70))
LONG = " ".join(f"w{k % 977}x{k}" for k in range(30_000))
ROWS = [
    (1, None, "en", None, None), (2, "", "en", "a", 0), (None, "no id here but some words", None, "a", 5), (4, "same text of a few words", "en", "a", 1), (4, "same text of a few words", "en", "a", 1), (5, "same text of a few words", "en", "b", 1),
    (6, LONG, "en", "a", 1), (7, f"before it {PASSAGE} and after", "en", "a", 1), (8, f"elsewhere\n{PASSAGE} stands again", "en", "b", 1), (9, " \t\n ", "en", "b", 4), (10, "🙂 ünï\r\nçødé  two  spaces", "fr", "b", 3),
]
CLASH = ("row", "h", "g", "n", "item", "ids", "shard", "slot", "score", "stats", "fold", "key", "target_loss", "cell", "hash")


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    return df.withColumns({c: F.lit("clash") for c in CLASH})


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def test_bpe(docs, empty):
    both = bpe.decode(bpe.encode(docs, RANKS, public_tokenizers.PATTERN), RANKS)
    rows = both.select("doc_id", "text", "ids", "decoded", "hash").collect()
    assert len(rows) == len(ROWS) and all(r.decoded == (r.text or "") and r.hash == "clash" for r in rows)
    assert [len(r.ids) for r in rows if not r.text] == [0, 0]
    assert bpe.decode(bpe.encode(empty, RANKS, public_tokenizers.PATTERN), RANKS).count() == 0


def test_token_file(spark, docs, empty, tmp_path):
    with open(public_tokenizers.path("byte_bpe_50k.json")) as f:
        definition = f.read()
    token_file.write(docs, definition, str(tmp_path / "a"))
    rows = token_file.ids_crc32(token_file.read(spark, str(tmp_path / "a"))).orderBy(F.col("start")).collect()
    assert [r.doc_id for r in rows] == [None, 1, 2, 4, 4, 5, 6, 7, 8, 9, 10]
    assert all(b.start == a.start + a.n_tokens for a, b in zip(rows, rows[1:], strict=False)) and rows[1].n_tokens == 1 and rows[1].ids_crc32 == zlib.crc32(bytes(4))
    assert token_file.write(empty, definition, str(tmp_path / "b"))["shards"] == []
    assert token_file.read(spark, str(tmp_path / "b")).count() == 0


def test_sharding(docs, empty):
    rows = sharding.shard_documents(docs, 3).collect()
    assert len(rows) == len(ROWS)
    for shard in {r.shard for r in rows}:
        slots = sorted(r.slot for r in rows if r.shard == shard)
        assert slots == list(range(len(slots)))
    assert {r.size for r in rows if r.doc_id in (1, 2)} == {16}
    assert sharding.shard_documents(empty, 3).count() == 0


def test_packing(docs, empty):
    rows = packing.pack_documents(docs).collect()
    assert sum(r.length for r in rows) == sum(len((t or "").encode().split()) for _, t, *_ in ROWS)
    assert max(r.length for r in rows) == packing.LENGTHS[-1] and packing.pack_documents(empty).count() == 0


def test_line_rules(docs, empty):
    rows = {r.doc_id: r for r in LineRules(docs).verdicts().collect()}
    assert rows[1].n_words == 0 and rows[1].base_failed and not rows[1].kept
    assert rows[6].kept and rows[6].n_words == 30_000
    assert LineRules(empty).verdicts().count() == 0


def test_quality(spark, docs, empty):
    labels = spark.createDataFrame([(k, k % 2) for k in range(4, 11)] + [(4, None), (None, 1)], "doc_id long, quality int")
    rows = QualityScores(docs, labels).scores().collect()
    assert len(rows) == len(ROWS) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    none = QualityScores(docs, labels.where("false")).scores().collect()
    assert {r.score for r in none} == {0.5}
    assert QualityScores(empty, labels).scores().count() == 0


def test_near_duplicates(docs, empty):
    rows = NearDuplicates(docs).verdicts().collect()
    assert len(rows) == len(ROWS)
    by_id = {r.doc_id: r for r in rows}
    assert by_id[5].component_id == 4 and not by_id[5].kept and by_id[4].kept
    assert by_id[1].n_shingles == 0 and by_id[1].component_id == 1 and by_id[9].n_shingles == 0
    assert by_id[None].component_id is None and by_id[None].kept
    assert NearDuplicates(empty).verdicts().count() == 0


def test_passages(docs, empty):
    rows = RepeatedPassages(docs).stretches().collect()
    assert {r.doc_id for r in rows} == {8} and rows[0].source_id == 7 and sum(r.n_words for r in rows) >= 40
    assert RepeatedPassages(empty).stretches().count() == 0


def test_losses(docs, empty):
    marked = docs.withColumn("target", F.when(F.col("doc_id") < 6, True))
    rows = Losses(marked, RANKS, public_tokenizers.PATTERN).scores().collect()
    assert len(rows) == len(ROWS) and all(r.score == 0 for r in rows if not r.n_tokens)
    assert Losses(empty.withColumn("target", F.lit(True)), RANKS, public_tokenizers.PATTERN).scores().count() == 0


def test_nearest(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (6, [0.0, 1.0]), (100, [0.9, 0.1]), (None, [1.0, 1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("row", F.lit("x"))
    found = hamming.search(table).orderBy("query_id", "rank").collect()
    assert [(r.vec_id, r.rank) for r in found if r.query_id == 0] == [(1, 1), (1, 2), (100, 3), (6, 4)]
    assert hamming.search(table.where("false")).count() == 0


def test_many_codes_step_through_the_tables_at_once():
    """All rows within each code's smallest radius that holds enough of them, ties included; the best of several blocks."""
    rng = np.random.default_rng(4)
    codes = rng.integers(0, 256, (300, 32), dtype=np.uint8)
    codes[200:] = codes[:100] ^ (rng.random((100, 32)) < 0.2).astype(np.uint8)
    for rows, asked, enough in ((codes, codes[::3], 24), (codes[:5], codes[:2], 64), (codes[:, :5], codes[:7, :5], 10)):
        query, row = hamming.Index(rows).search(asked, enough)
        distance = np.bitwise_count(asked[:, None] ^ rows).sum(2, dtype=np.int64)
        least = np.sort(distance, axis=1)[:, min(enough, len(rows)) - 1]
        assert list(zip(query.tolist(), row.tolist(), strict=True)) == list(zip(*(x.tolist() for x in np.nonzero(distance <= least[:, None])), strict=True))
    x = rng.normal(size=(400, 8))
    table = pa.table({"block": np.arange(400) % 3, "row": np.arange(400), "vec_id": np.arange(400), "vector": list(x)})
    found = hamming.nearest(table, table.slice(0, 50), hamming.Rotation(x), 10, least=400).to_pandas()
    for at in range(50):
        d = np.sqrt(((x - x[at]) ** 2).sum(1))
        d[at] = np.inf
        assert found[found.query_id == at].vec_id.tolist() == np.argsort(d, kind="stable")[:10].tolist()


def test_pipeline_on_edges(spark, docs, empty, tmp_path):
    import corpus_pipeline

    assert hashlib.sha256  # digests are taken by the queries
    (tmp_path / "d").mkdir()
    docs.drop(*CLASH).write.parquet(str(tmp_path / "d" / "documents.parquet"))
    spark.createDataFrame([(k, 1) for k in range(1, 12)], "doc_id long, quality int").write.parquet(str(tmp_path / "d" / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "d")).select("doc_id").distinct().count() >= 1
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path / "d")).count() == 0


def test_bpe_decodes_where_it_encodes(docs):
    both = bpe.encode(docs, RANKS, public_tokenizers.PATTERN, decoded="decoded")
    apart = bpe.decode(bpe.encode(docs, RANKS, public_tokenizers.PATTERN), RANKS)
    assert sorted(map(str, both.select("doc_id", "ids", "decoded").collect())) == sorted(map(str, apart.select("doc_id", "ids", "decoded").collect()))


def python_nodes(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return sum(plan.count(node) for node in ("MapInArrow", "ArrowEvalPython", "MapInPandas", "BatchEvalPython"))


def test_bpe_query_has_one_python_worker_a_task(spark):
    assert python_nodes(queries.op2_byte_bpe(spark, "/root/testdata/sf0.001")) == 1


def test_token_file_query_reads_with_one_python_worker_a_task(spark):
    assert python_nodes(queries.op5_token_file(spark, "/root/testdata/sf0.001")) == 1


def test_token_file_forgets_its_encoder(docs, tmp_path):
    definition = open(public_tokenizers.path("byte_bpe_50k.json")).read()
    made = weakref.ref(token_file.library_encoder(definition).__self__)
    token_file._forget_encoders()
    assert made() is None
    token_file.write(docs, definition, str(tmp_path))
    spark = docs.sparkSession
    plain = token_file.ids_crc32(token_file.read(spark, str(tmp_path))).drop("ids")
    assert sorted(map(str, token_file.read(spark, str(tmp_path), crc32="ids_crc32").collect())) == sorted(map(str, plain.collect()))


def test_cross_entropy_counts_without_the_encoder():
    with open(RANKS, "rb") as f:
        made = weakref.ref(bpe._once(bpe.Encoder, f.read(), public_tokenizers.PATTERN))
    ids = pa.array([np.array([3, 4, 3], "<u2").tobytes()], pa.binary())
    batch = pa.RecordBatch.from_arrays([pa.array([7]), pa.array([True]), ids], names=["row", "target", "ids"])
    [(rows, _, _, codes)] = cross_entropy._portions(50_000, iter([batch]))
    assert rows.tolist() == [7] and codes.tolist() == [50_000 * 50_000 + 3, 3 * 50_000 + 4, 4 * 50_000 + 3]
    assert made() is None
