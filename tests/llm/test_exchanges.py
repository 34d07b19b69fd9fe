"""What operators exchange: never more than the work needs, however many documents share a key."""

import random
import re

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from textloom.llm import cross_entropy, queries
from textloom.llm.common import KeyFilter, Scratch
from textloom.llm.cross_entropy import Losses

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture
def no_small_tables(spark):
    """All tables are too large for a broadcast that isn't asked for."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.fixture
def exchanged(spark, monkeypatch, no_small_tables):
    """Columns of each exchange of the tables stored, and of fill(df)."""
    found: list[list[str]] = []

    def fill(df):
        mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
        text = df._jdf.queryExecution().explainString(mode)
        found.extend(re.findall(r"(\w+)#\d+", columns) for columns in re.findall(r"\) Exchange *\nInput \[\d+\]: \[(.*?)\]", text))
        return df

    monkeypatch.setattr(cross_entropy, "stored", lambda df, own=cross_entropy.stored: own(fill(df)))
    return found, fill


def test_cross_entropy_exchanges_no_texts_and_no_lists_of_documents(spark, exchanged):
    found, fill = exchanged
    fill(queries.op3_cross_entropy_difference(spark, "/root/testdata/sf0.001"))
    assert any("ids" in columns for columns in found)
    assert not any({"text", "posted"} & set(columns) for columns in found)


def test_cross_entropy_targets_of_their_own(spark):
    rows = [(k, f"words of text {k % 7} " * (k % 5), k % 3 == 0) for k in range(300)] + [(None, "no id", None), (7, None, False), (7, "an id again", False)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, target boolean").repartition(5)
    targets = docs.where("doc_id is not null").groupBy("doc_id").agg(F.max("target").alias("target"))
    one = Losses(docs, RANKS, public_tokenizers.PATTERN).scores().collect()
    two = Losses(docs.drop("target"), RANKS, public_tokenizers.PATTERN, targets).scores().collect()
    near = lambda found: sorted((str(r.doc_id), r.target, r.n_tokens, round(r.target_loss, 9), round(r.background_loss, 9)) for r in found)
    assert len(one) == len(rows) and near(one) == near(two)


def test_cross_entropy_counts_each_bigram_once_a_portion(spark):
    docs = spark.range(2_000).select(F.col("id").alias("doc_id"), F.lit("the same few words").alias("text"), F.lit(True).alias("target")).coalesce(1)
    losses = Losses(docs, RANKS, public_tokenizers.PATTERN)
    counts = losses.counts()
    assert counts.count() == counts.select("portion", "gram").distinct().count() == losses.tokens.first().n_tokens
    assert len({(r.n_tokens, r.target_loss, r.background_loss) for r in losses.scores().collect()}) == 1


def test_key_filter_keeps_all_matches(spark):
    table = spark.createDataFrame([(k, f"k{k}") for k in range(0, 3_000, 10)] + [(None, "k"), (5, None)], "a long, b string")
    rows = spark.createDataFrame([(k, f"k{k}") for k in range(3_000)] + [(None, "k"), (5, None), (5, None), (None, None)], "a long, b string").withColumn("text", F.lit("x"))
    known = KeyFilter(table, ["a", "b"])
    some, others = (sorted(map(str, df.collect())) for df in (known.some(rows), known.others(rows)))
    keys = {(r.a, r.b) for r in table.collect()}
    wanted = sorted(str(r) for r in rows.collect() if (r.a, r.b) in keys)
    assert set(wanted) <= set(some) and sorted(some + others) == sorted(map(str, rows.collect())) and wanted.count("Row(a=5, b=None, text='x')") == 2
    assert len(some) < len(wanted) + 400
    nothing = KeyFilter(table.where("false"), ["a", "b"])
    assert nothing.some(rows).count() == 0 and nothing.others(rows).count() == rows.count()


def test_substring_dedup_exchanges_few_texts(spark, no_small_tables):
    rng = random.Random(3)
    words = lambda n: " ".join(f"{rng.getrandbits(48):x}" for _ in range(n))
    passage = words(60)
    rows = [(k, f"{words(700)} {passage if k in (20, 40) else ''} {words(700)}", "en", "a", 1) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)

    def written():
        context = spark.sparkContext._jsc.sc()
        context.listenerBus().waitUntilEmpty()
        return context.statusStore().executorList(False).apply(0).totalShuffleWrite()

    with Scratch(spark):
        docs = corpus_pipeline.stored(docs)
        before = written()
        left = {r.doc_id: r.text for r in corpus_pipeline.substring_dedup(spark, docs, "").collect()}
    assert written() - before < sum(len(r[1]) for r in rows)
    assert {k for k, text, *_ in rows if left[k] != text} == {40} and passage not in left[40] and len(left) == len(rows)
