"""The session memory as one object: compress, expand, search, retrieve, context, risk, statistics, retention.

State are two tables, documents and usage events, of which every call makes new ones; save() and load() keep them in a
TableStore. A call compresses a whole DataFrame of texts as easily as one.
"""

from __future__ import annotations

import re
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import notes
from textloom.functions import text as X
from textloom.functions import words as W
from textloom.operators import maintenance, matching, memory
from textloom.sources.files import joined_conversations
from textloom.sources.scratch import written
from textloom.sources.store import TableStore

_SESSION = re.compile(r"[A-Za-z0-9._-]{1,80}\Z")
_URI = re.compile(r"tl://([A-Za-z0-9._-]{1,80})/(doc|span)/([A-Za-z0-9._-]+)(?:/levels?/([0-4]))?\Z")
LEVELS = ("Ultra summary", "Semantic map", "Anchors", "Critical exact extracts", "Exact expansion handles")


class StaleSource(ValueError):
    code = "STALE_SOURCE"


def session_id(value: str | None) -> str:
    name = "default" if value is None else value
    if not isinstance(name, str) or not _SESSION.match(name):
        raise ValueError("a session id has 1 to 80 of A-Z a-z 0-9 . _ -")
    return name


def limit_of(value: int | None, default: int = 8) -> int:
    """1 to 50."""
    return default if value is None else max(1, min(50, int(value)))


def parsed_uri(uri: str) -> tuple[str, str, str, int | None]:
    """(session, doc or span, id, level)."""
    m = _URI.match(uri)
    if not m:
        raise ValueError(f"not a memory handle: {uri}")
    return m[1], m[2], m[3], int(m[4]) if m[4] else None


class MemoryEngine:
    """documents: session_id, document_id, label, mode, source (the text), created_at."""

    def __init__(self, spark: SparkSession, documents: DataFrame | None = None, events: DataFrame | None = None):
        self.spark = spark
        self.documents = documents if documents is not None else spark.createDataFrame([], "session_id string, document_id string, label string, mode string, source string, created_at timestamp")
        self.events = events

    def compress(self, texts: DataFrame, budget: int | None = None) -> DataFrame:
        """Adds texts (session_id, document_id, text; label and mode if there) and returns what memory.compressed() makes of them."""
        has, now = set(texts.columns), datetime.now(timezone.utc)
        rows = texts.select(F.col("session_id"), F.col("document_id").cast("string"), (F.col("label") if "label" in has else F.lit("text")).alias("label"), (F.col("mode") if "mode" in has else F.lit("text")).alias("mode"), X.text_of("text").alias("source"), F.lit(now).alias("created_at"))
        known = self.documents.select(F.sha2("source", 256).alias("checksum")).distinct().withColumn("deduplicated", F.lit(True))
        self.documents = self.documents.unionByName(rows)
        out = memory.compressed(rows.withColumnRenamed("source", "text"), "session_id", "document_id", "text", "mode", "label", budget)
        # events are written at once: their time is that of the call, however often they are read
        used = written(maintenance.usage_events(out).withColumn("created_at", F.lit(now)))
        self.events = used if self.events is None else maintenance.last_events(self.events.unionByName(used), "session_id", "created_at")
        return out.join(known, "checksum", "left").withColumn("deduplicated", F.coalesce("deduplicated", F.lit(False)))

    def compress_text(self, text: str, session: str | None = None, label: str = "text", mode: str = "text", budget: int | None = None) -> dict:
        if not isinstance(text, str) or notes.units(text) > W.MAX_TEXT:
            raise ValueError("text must be a string of at most 2,000,000 units")
        name = session_id(session)
        number = self.documents.where(F.col("session_id") == name).count() + 1
        one = self.spark.createDataFrame([(name, f"doc_{number}", label[: W.MAX_LABEL] or "text", "code" if mode == "code" else "text", text)], "session_id string, document_id string, label string, mode string, text string")
        return self.compress(one, budget).drop("source").first().asDict(True)

    def compress_conversations(self, messages: DataFrame, session: str, key: str = "conv_id") -> DataFrame:
        """messages: key, turn, role, text; each conversation becomes one document."""
        joined = joined_conversations(messages, key)
        return self.compress(joined.select(F.lit(session_id(session)).alias("session_id"), F.col("conversation").cast("string").alias("document_id"), F.lit("conversation").alias("label"), "text"))

    def _compressed(self, name: str, document: str | None = None) -> DataFrame:
        rows = self.documents.where(F.col("session_id") == name)
        if document is not None:
            rows = rows.where(F.col("document_id") == document)
        return memory.compressed(rows, "session_id", "document_id", "source", "mode", "label")

    def expand(self, uri: str) -> dict:
        """The exact text of a document or span, its checksum verified."""
        name, kind, key, _ = parsed_uri(uri)
        if kind == "doc":
            row = self.documents.where((F.col("session_id") == name) & (F.col("document_id") == key)).select("source").first()
            if row is None:
                raise KeyError(uri)
            return {"uri": uri, "text": row.source}
        spans = memory.span_table(self._compressed(name, key.rpartition(".")[0])).where(F.col("uri") == uri)
        row = memory.expanded(spans, self.documents.withColumnRenamed("source", "text")).first()
        if row is None:
            raise KeyError(uri)
        if not row.ok:
            raise StaleSource(uri)
        return {"uri": uri, "text": row.text}

    def search(self, query: str, session: str | None = None, mode: str | None = None, limit: int | None = None) -> DataFrame:
        """document_id, match_kind, score, must_expand and window of fingerprint matches, then of keyword matches."""
        if not isinstance(query, str) or notes.units(query) > W.MAX_QUERY:
            raise ValueError("a query has at most 2,000 units")
        name = session_id(session)
        docs = self._compressed(name)
        if mode is not None:
            docs = docs.where(F.col("mode") == ("code" if mode == "code" else "text"))
        texts = docs.select(F.col("document_id").alias("key"), F.col("source").alias("text"))
        asked = self.spark.createDataFrame([(0, query)], "id int, text string")
        hits = matching.search(asked, texts, "id", "key", limit=50).select(F.col("c").alias("document_id"), "match_kind", "score", "exact", "critical_diff", "window_start", "window_end")
        toks = [t.lower() for t in notes.tokens(query)]
        hay = F.lower(F.concat_ws(" ", "label", "mode", "summary", "anchors", "protected_terms", F.col("extracts.text"), F.col("code.symbols.name"), F.col("code.imports.text")))
        score = sum((F.contains(hay, F.lit(t)).cast("int") for t in toks), F.lit(0))
        words = docs.join(hits.select("document_id"), "document_id", "left_anti").withColumn("n", score).where("n > 0").select("document_id", F.lit("keyword").alias("match_kind"), F.least(F.lit(1.0), F.col("n") / max(1, len(toks))).alias("score"), F.lit(False).alias("exact"), F.lit(False).alias("critical_diff"), F.lit(None).cast("long").alias("window_start"), F.lit(None).cast("long").alias("window_end"))
        out = hits.unionByName(words).join(docs.select("document_id", "uri", "risk"), "document_id")
        must = F.when((F.col("match_kind") == "keyword"), F.col("risk.must_expand") | F.col("risk.should_expand")).otherwise(~F.col("exact") | F.col("risk.must_expand"))
        return out.withColumn("must_expand", must).drop("risk").orderBy(matching.priority(F.col("match_kind")).desc(), F.desc("score"), F.collate("uri", "UNICODE")).limit(limit_of(limit))

    def retrieve(self, uri: str, level: int | None = None) -> dict[int, str]:
        """Levels 0 up to `level` (of the uri, else 4) of a document, as JSON."""
        name, kind, key, own = parsed_uri(uri)
        top = own if own is not None else 4 if level is None else level
        rows = memory.levels(self._compressed(name, key)).where(F.col("level") <= top).collect()
        if kind != "doc" or not rows:
            raise KeyError(uri)
        return {r.level: r.payload for r in rows}

    def context(self, query: str, session: str | None = None, limit: int = 3, detail: str = "brief") -> str:
        """A compact text of the best documents for a query."""
        name = session_id(session)
        hits = self.search(query, name, limit=limit).select("document_id").withColumn("place", F.monotonically_increasing_id())
        docs = hits.join(self._compressed(name), "document_id").orderBy("place").drop("source").collect()  # at most `limit` rows
        few = detail == "brief"
        lines = [f"Compact context session={name} detail={detail}", f"Query: {query}"]
        if not docs:
            return "\n".join([*lines, "No matching memory found."])
        for k, d in enumerate(docs, 1):
            lines += ["", f"#{k} {d.label} {d.uri} mode={d.mode} risk={d.risk.level}", f"Summary: {d.summary}", f"Anchors: {', '.join(d.anchors[: 8 if few else 14]) or 'none'}"]
            if d.protected_terms:
                lines.append(f"Protected terms: {', '.join(d.protected_terms[:12])}")
            if d.extracts:
                lines += ["Critical extracts:", *[f"- {e.text}" for e in d.extracts[: 6 if few else 12]]]
            lines.append(f"Expand if exactness matters: {', '.join(d.handles[: 3 if few else 8]) or d.uri}")
        return "\n".join(lines)

    def explain(self, uri: str) -> dict:
        name, _, key, _ = parsed_uri(uri)
        row = self._compressed(name, key).select("risk").first()
        if row is None:
            raise KeyError(uri)
        return {"uri": uri, "levels": dict(enumerate(LEVELS)), "risk": row.risk.asDict(True)}

    @staticmethod
    def risk_of(text: str, mode: str = "text") -> dict:
        return notes.risk(text, mode, len(notes.extracts(text)))

    def stats(self) -> DataFrame:
        return maintenance.session_stats(self._with_spans(), "session_id", F.col("n_spans"), "source")

    def _with_spans(self) -> DataFrame:
        return self.documents.withColumn("n_spans", F.size(memory.text_spans("source")))

    def usage(self) -> DataFrame | None:
        return None if self.events is None else maintenance.usage_summary(self.events, "session_id")

    def sessions(self) -> DataFrame:
        return self.documents.groupBy("session_id").agg(F.max("created_at").alias("last_accessed_at"), F.count("*").alias("documents"))

    def overview(self) -> DataFrame:
        return maintenance.overview(self.sessions(), F.current_timestamp())

    def prune(self, older_than_days: float | None = None, max_sessions: int | None = None, dry_run: bool = False) -> DataFrame:
        """Sessions that go, with the reason; unless it is a dry run they are gone."""
        plan = maintenance.prune_plan(self.sessions(), F.current_timestamp(), older_than_days, max_sessions)
        if not dry_run:
            self.documents = maintenance.without_sessions(self.documents, plan)
        return plan

    def clear(self, session: str | None = None) -> None:
        self.documents = self.documents.where(F.lit(False) if session is None else F.col("session_id") != session_id(session))

    def save(self, store: TableStore) -> int:
        tables = {"documents": self.documents} | ({"events": self.events} if self.events is not None else {})
        return store.commit(tables, store.revision)

    @classmethod
    def load(cls, spark: SparkSession, store: TableStore) -> MemoryEngine:
        names = store.manifest()["tables"]
        return cls(spark, store.read("documents") if "documents" in names else None, store.read("events") if "events" in names else None)
