"""The registered queries over the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom import oracles
from textloom.functions import text as X
from textloom.functions import words as W
from textloom.operators import evaluation, maintenance, matching, memory
from textloom.operators.fingerprint import fingerprinted, hash_hex, index_bytes, postings, stop_hashes, strict_tokens
from textloom.sources import files
from textloom.sources.scratch import scratch_path, written
from textloom.streaming import ingest

FLAGSHIP = "near_duplicate_pairs"
NOW = "timestamp_ntz'2024-02-13 12:00:00'"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", "text")


def _long(c) -> F.Column:
    return c.cast("long")


def exact_source_dedup(spark, sf_dir):
    return maintenance.distinct_sources(_docs(spark, sf_dir), "doc_id")


def source_origins(spark, sf_dir):
    return maintenance.origins(_docs(spark, sf_dir), "doc_id")


def token_estimate(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", X.estimate_tokens("text").alias("tokens"))


def message_token_estimate(spark, sf_dir):
    rows = _table(spark, sf_dir, "conversations")
    return rows.select("conv_id", "turn", X.estimate_tokens("text").alias("tokens"), X.should_compress("text").alias("long_message"))


def engine_token_counts(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", X.engine_tokens("text").alias("t")).select("doc_id", _long(F.size("t")).alias("n_tokens"), _long(F.size(F.array_distinct("t"))).alias("n_distinct"))


def strict_token_counts(spark, sf_dir):
    return strict_tokens(_docs(spark, sf_dir), "doc_id").groupBy(F.col("doc_key").alias("doc_id"), "kind").agg(F.count("*").alias("n"))


def keyword_only_documents(spark, sf_dir):
    return fingerprinted(_docs(spark, sf_dir), "doc_id", limit=None, outputs=("keyword_only",)).where("keyword_only").select(F.col("doc_key").alias("doc_id"))


def protected_terms(spark, sf_dir):
    tokens = _docs(spark, sf_dir).select("doc_id", F.explode(X.protected_tokens(X.engine_tokens("text"))).alias("term"))
    return tokens.groupBy("doc_id", "term").agg(F.count("*").alias("n"))


def sentence_reasons(spark, sf_dir):
    s = _docs(spark, sf_dir).select("doc_id", F.explode(X.sentences(X.one_line_ends(X.text_of("text")))).alias("s")).select("doc_id", X.trimmed("s").alias("s")).where("s <> ''")
    r = s.select("doc_id", F.explode(X.reasons(F.col("s"), X.engine_tokens("s"))).alias("reason"))
    return r.groupBy("doc_id", "reason").agg(F.count("*").alias("n"))


def sentence_counts(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", X.sentences(X.one_line_ends(X.text_of("text"))).alias("s")).select("doc_id", _long(F.size("s")).alias("n_sentences"), _long(F.array_max(F.transform("s", lambda x: F.length(x)))).alias("longest"))


def _noted(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", memory.noted("text", F.lit("text"), spans=False).alias("n")).select("doc_id", "n.*")


def risk_scores(spark, sf_dir):
    return _noted(spark, sf_dir).select("doc_id", _long(F.size("extracts")).alias("n_extracts"), F.col("risk.score").alias("score"), F.col("risk.level").alias("level"), F.col("risk.must_expand").alias("must_expand"), F.array_join("risk.reasons", ",").alias("reasons"))


def critical_extracts(spark, sf_dir):
    e = _noted(spark, sf_dir).select("doc_id", F.posexplode("extracts").alias("i", "e"))
    return e.select("doc_id", _long(F.col("i")).alias("i"), "e.text", "e.exact", F.array_join("e.reasons", ",").alias("reasons"), "e.token_estimate")


def char_shapes(spark, sf_dir):
    words = _docs(spark, sf_dir).select(F.explode(X.engine_tokens("text")).alias("word")).distinct()
    shape = words.withColumn("low", F.lower(X.normalized("word"))).select("word", X.char_shape("word", F.col("low")).alias("s"))
    return shape.select("word", _long(F.col("s.length")).alias("length"), "s.prefix", "s.suffix", "s.mask", "s.vc")


def anchor_terms(spark, sf_dir):
    a = _docs(spark, sf_dir).select("doc_id", F.explode(X.anchors(X.engine_tokens("text"))).alias("a"))
    return a.select("doc_id", _long(F.col("a.index")).alias("index"), F.col("a.token").alias("token"))


def text_spans(spark, sf_dir):
    s = _docs(spark, sf_dir).select("doc_id", F.posexplode(memory.text_spans("text")).alias("i", "s"))
    return s.select("doc_id", _long(F.col("i")).alias("i"), F.sha2("s", 256).alias("checksum"), _long(F.length("s")).alias("n_chars"))


def compressed_documents(spark, sf_dir):
    c = memory.compressed(_table(spark, sf_dir, "documents"), "source", "doc_id")
    return c.select("session_id", "document_id", "checksum", "summary", F.size("spans").alias("n_spans"), F.size("extracts").alias("n_extracts"), "raw_tokens", "compressed_tokens", "savings_ratio", "compression_skipped", F.sha2("compressed_text", 256).alias("compressed_sha256"))


def compressed_within_budget(spark, sf_dir):
    c = memory.compressed(_table(spark, sf_dir, "documents"), "source", "doc_id", budget=200)
    return c.select("document_id", "n_handles", "compressed_tokens", "within_budget", "compression_skipped")


def memory_levels(spark, sf_dir):
    c = memory.levels(memory.compressed(_table(spark, sf_dir, "documents"), "source", "doc_id"))
    return c.select("uri", _long(F.col("level")).alias("level"), F.sha2("payload", 256).alias("payload_sha256"))


def expanded_spans(spark, sf_dir):
    """Every span, cut from its source's bytes by its range, and whether its checksum holds."""
    docs = _table(spark, sf_dir, "documents")
    spans = memory.span_table(memory.compressed(docs, "source", "doc_id"))
    sources = docs.select(F.col("source").alias("session_id"), F.col("doc_id").cast("string").alias("document_id"), "text")
    return memory.expanded(spans, sources).select("uri", F.sha2("text", 256).alias("sha256"), "ok")


def conversation_memory(spark, sf_dir):
    m = memory.conversation_memory(memory.conversation_messages(_table(spark, sf_dir, "conversations")))
    return m.select(F.col("conversation").alias("conv_id"), "n_messages", *[f"n_{f}" for f in memory.FLAGS])


def conversation_open_questions(spark, sf_dir):
    m = memory.conversation_messages(_table(spark, sf_dir, "conversations")).where("open_questions")
    return m.select(F.col("conversation").alias("conv_id"), _long(F.col("idx")).alias("idx"), "role", "preview")


def joined_conversations(spark, sf_dir):
    j = files.joined_conversations(_table(spark, sf_dir, "conversations"))
    return j.select(F.col("conversation").alias("conv_id"), F.sha2("text", 256).alias("sha256"), "n_messages")


def code_signals(spark, sf_dir):
    lines = _table(spark, sf_dir, "pages").select("page_id", F.explode(memory.code_lines("html")).alias("l"))
    return lines.groupBy("page_id").agg(F.count("*").alias("n_lines"), F.count_if("l.is_import").alias("n_imports"), F.count_if(F.col("l.function").isNotNull()).alias("n_functions"), F.count_if(F.col("l.class_name").isNotNull()).alias("n_classes"), F.sum(F.size("l.calls")).alias("n_calls"), F.count_if("l.is_error").alias("n_errors"))


def file_modes(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", X.file_mode("url").alias("mode"))


def token_hashes(spark, sf_dir):
    fp = strict_tokens(_table(spark, sf_dir, "benchmark"), "item_id").select("value").distinct()

    @F.arrow_udf("long")
    def fnv(values):
        import numpy as np
        import pyarrow as pa

        from textloom.functions.kernel import fnv1a

        return pa.array(np.array([fnv1a(v.encode()) for v in values.to_pylist()], np.uint64).view(np.int64))

    return fp.select(F.col("value").alias("token"), hash_hex(fnv("value")).alias("hash"))


TOKENS = ("token_fps",)
PAIRS = ("sha256", "raw_byte_length", "token_values", "token_fps", "char_fps", "keyword_only", "critical")


def _fp(spark, sf_dir, outputs, table="documents", key="doc_id"):
    """All fingerprints of each text; only an interactive index has a limit for a document."""
    return fingerprinted(_table(spark, sf_dir, table), key, limit=None, outputs=outputs)


def _spread_fp(spark, sf_dir, outputs):
    """_fp() of the documents dealt by key: a file of one row group, however large, would else be one task."""
    return fingerprinted(_docs(spark, sf_dir).repartition("doc_id"), "doc_id", limit=None, outputs=outputs)


def token_fingerprints(spark, sf_dir):
    p = postings(_fp(spark, sf_dir, TOKENS), "token")
    return p.select(F.col("doc_key").alias("doc_id"), _long(F.col("position")).alias("position"), hash_hex("hash").alias("hash"))


def character_fingerprints(spark, sf_dir):
    p = postings(_fp(spark, sf_dir, ("char_fps",), "benchmark", "item_id"), "character")
    return p.select(F.col("doc_key").alias("item_id"), _long(F.col("position")).alias("position"), hash_hex("hash").alias("hash"))


def frequent_hashes(spark, sf_dir):
    return stop_hashes(postings(_fp(spark, sf_dir, TOKENS), "token"), 8).select(hash_hex("hash").alias("hash"), "n")


def index_memory(spark, sf_dir):
    return index_bytes(fingerprinted(_docs(spark, sf_dir), "doc_id", outputs=("raw_byte_length", "token_values", "token_fps", "char_fps"))).withColumnRenamed("doc_key", "doc_id")


def near_duplicate_pairs(spark, sf_dir):
    pairs = matching.near_duplicate_pairs(written(_fp(spark, sf_dir, TOKENS)))
    return pairs.select("a", "b", "votes", "top", _long(F.col("peaks")).alias("peaks"), X.fixed(F.col("dominance"), 6).alias("dominance"))


def match_classification(spark, sf_dir):
    fp = written(matching.pair_facts(_spread_fp(spark, sf_dir, PAIRS), elements=False))
    pairs = written(matching.near_duplicate_pairs(fp).select(F.col("a").alias("q"), F.col("b").alias("c")))
    m = matching.classified(matching.pair_metrics(pairs, fp))
    return m.select("q", "c", "match_kind", "score", "must_expand", "critical_diff", X.fixed(F.col("token_containment"), 6).alias("token_containment"), X.fixed(F.col("character_jaccard"), 6).alias("character_jaccard"))


def critical_difference_pairs(spark, sf_dir):
    fp = written(matching.pair_fingerprints(_spread_fp(spark, sf_dir, ("token_fps", "critical"))))
    pairs = written(matching.near_duplicate_pairs(fp).select(F.col("a").alias("q"), F.col("b").alias("c")))
    return matching.element_differences(pairs, fp)


def benchmark_contamination(spark, sf_dir):
    c = matching.contamination(_fp(spark, sf_dir, TOKENS), _fp(spark, sf_dir, TOKENS, "benchmark", "item_id"))
    return c.select(F.col("c").alias("doc_id"), F.col("q").alias("item_id"), "shared", X.fixed(F.col("containment"), 6).alias("containment"))


def search_benchmark(spark, sf_dir):
    hits = matching.search(_table(spark, sf_dir, "benchmark"), _docs(spark, sf_dir), "item_id", "doc_id")
    return hits.select(F.col("q").alias("item_id"), "rank", F.col("c").alias("doc_id"), "match_kind", "score", "must_expand", "window_start", "window_end")


def relocated_windows(spark, sf_dir):
    """Exact windows that search found, and whether the bytes there are the passage's."""
    items, docs = _table(spark, sf_dir, "benchmark"), _docs(spark, sf_dir)
    hits = matching.search(items, docs, "item_id", "doc_id").where("exact and window_start is not null").select(F.col("q").alias("item_id"), F.col("c").alias("doc_id"), "window_start", "window_end")
    both = hits.join(docs, "doc_id").join(items.select("item_id", F.col("text").alias("passage")), "item_id")
    same = F.substr(F.encode("text", "utf-8"), F.col("window_start").cast("int") + 1, (F.col("window_end") - F.col("window_start")).cast("int")) == F.encode("passage", "utf-8")
    return both.select("item_id", "doc_id", "window_start", "window_end", same.alias("same_bytes"))


def keyword_search(spark, sf_dir):
    """For each benchmark item the eight documents that hold most of its words anywhere in their text."""
    asked = _table(spark, sf_dir, "benchmark").select("item_id", F.transform(X.engine_tokens("text"), lambda t: F.lower(t)).alias("words"))
    return matching.keyword_hits(asked, _docs(spark, sf_dir), "item_id", "doc_id", 8)


def near_duplicate_classes(spark, sf_dir):
    """The document that stands for all with the same sequence of token fingerprints."""
    return matching.classes(_fp(spark, sf_dir, TOKENS)).select(F.col("doc_key").alias("doc_id"), "representative")


def usage_summary(spark, sf_dir):
    """What clamping messages to 120 units would save, by role."""
    e = _table(spark, sf_dir, "conversations").select("role", X.estimate_tokens("text").alias("raw_tokens"), X.estimate_tokens(X.clamped("text", 120)).alias("compressed_tokens"))
    e = e.withColumn("compression_skipped", F.col("compressed_tokens") > F.floor(F.col("raw_tokens") * F.lit(1 - W.MIN_SAVINGS)))
    return maintenance.usage_summary(e, "role")


def compression_usage(spark, sf_dir):
    """What compressing the documents saved, by source."""
    events = maintenance.usage_events(memory.compressed(_table(spark, sf_dir, "documents"), "source", "doc_id"))
    return maintenance.usage_summary(events, "session_id")


def session_stats(spark, sf_dir):
    return maintenance.session_stats(_table(spark, sf_dir, "conversations"), "conv_id")


def _sessions(spark, sf_dir):
    return _table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("session_id")).agg(F.max("ts").alias("last_accessed_at"), F.count("*").alias("n_events"))


def session_overview(spark, sf_dir):
    o = maintenance.overview(_sessions(spark, sf_dir), F.expr(NOW))
    return o.select("session_id", "n_events", "days_idle", "is_stale", _long(F.col("place")).alias("place"))


def prune_plan(spark, sf_dir):
    return maintenance.prune_plan(_sessions(spark, sf_dir), F.expr(NOW), older_than_days=14, max_sessions=20).select("session_id", "reason")


def last_usage_events(spark, sf_dir):
    e = maintenance.last_events(_table(spark, sf_dir, "events").select("event_id", "user_id", F.struct("ts", "event_id").alias("at")), "user_id", "at", 5)
    return e.select("event_id", "user_id")


def ledger_summary(spark, sf_dir):
    rows = [("q1", 1000, 50, 100, 200, 30, ["a", "b"], ["a", "b"]), ("regression", 100, 50, 50, 20, 10, ["c"], []), ("q3", 400, 10, 20, 100, 0, [], [])]
    table = spark.createDataFrame(rows, "id string, raw_prompt_tokens long, tool_schema_tokens long, request_tokens long, response_tokens long, expansion_tokens long, required_facts array<string>, recovered_facts array<string>")
    s = evaluation.ledger_summary(table)
    return s.withColumn("regressions", F.array_join("regressions", ",")).withColumns({c: X.fixed(F.col(c), 6) for c in ("aggregate_reduction", "median_reduction", "fact_fidelity")})


def search_recall(spark, sf_dir):
    """Share of benchmark items whose contaminated document is among the first five hits."""
    hits = matching.search(_table(spark, sf_dir, "benchmark"), _docs(spark, sf_dir), "item_id", "doc_id", limit=5).groupBy(F.col("q").alias("item_id")).agg(F.array_sort(F.collect_list(F.struct("rank", "c"))).alias("r"))
    real = benchmark_contamination(spark, sf_dir).where("containment >= 0.9").groupBy("item_id").agg(F.collect_set("doc_id").alias("relevant_ids"))
    runs = real.join(hits, "item_id", "left").select("relevant_ids", F.coalesce(F.col("r.c"), F.array().cast("array<long>")).alias("ranked_ids"))
    return evaluation.recall_at(runs, 5)


def label_quality_by_risk(spark, sf_dir):
    labels = _table(spark, sf_dir, "labels")
    joined = risk_scores(spark, sf_dir).join(labels, "doc_id")
    return joined.groupBy("level", "quality").agg(F.count("*").alias("n"), F.sum(_long(F.col("toxic"))).alias("toxic"))


def streamed_first_seen(spark, sf_dir):
    """Distinct texts of a stream of the documents, drained to a table."""
    stream = spark.readStream.schema("doc_id long, text string, lang string, source string, n_chars long").parquet(f"{sf_dir}/[d]ocuments.parquet")
    place = scratch_path(spark, "stream")
    query = ingest.first_seen(stream.select("text")).select("sha256").writeStream.format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema("sha256 string").parquet(f"{place}/out")


QUERIES = (
    exact_source_dedup, source_origins, token_estimate, message_token_estimate, engine_token_counts, strict_token_counts, keyword_only_documents, protected_terms, sentence_reasons, sentence_counts, risk_scores,
    critical_extracts, char_shapes, anchor_terms, text_spans, compressed_documents, compressed_within_budget, memory_levels, expanded_spans, conversation_memory, conversation_open_questions, joined_conversations,
    code_signals, file_modes, token_hashes, token_fingerprints, character_fingerprints, frequent_hashes, index_memory, near_duplicate_classes, near_duplicate_pairs, match_classification, critical_difference_pairs,
    benchmark_contamination, search_benchmark, relocated_windows, keyword_search, usage_summary, compression_usage, session_stats, session_overview, prune_plan, last_usage_events, ledger_summary, search_recall, label_quality_by_risk, streamed_first_seen,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return dict(oracles.SQL)
