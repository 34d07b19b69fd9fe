import pytest

from textloom.plans.engine import MemoryEngine, limit_of, parsed_uri, session_id
from textloom.sources.store import TableStore

TEXT = ("The invoice 4801 must not be approved before 2026-08-01. " + "Routine review evidence explains ownership, recovery preparation and audit history in every record. " * 12).strip()


def test_compress_search_expand_save(spark, tmp_path):
    engine = MemoryEngine(spark)
    made = engine.compress_text(TEXT, "work", "ledger")
    assert made["uri"] == "tl://work/doc/doc_1" and not made["deduplicated"] and made["raw_tokens"] > made["compressed_tokens"]
    assert engine.expand(made["uri"])["text"] == TEXT
    assert engine.expand(made["handles"][0])["text"] in TEXT
    hit = engine.search(TEXT[:600], "work").first()
    assert (hit.document_id, hit.match_kind, hit.window_start) == ("doc_1", "exact", 0)
    assert "tl://work/doc/doc_1" in engine.context("invoice", "work")
    assert set(engine.retrieve(made["uri"], 2)) == {0, 1, 2}
    store = TableStore(spark, str(tmp_path))
    assert engine.save(store) == 1
    again = MemoryEngine.load(spark, store)
    assert again.stats().first().active_documents == 1
    assert again.prune(max_sessions=1, dry_run=True).count() == 0
    again.clear("work")
    assert again.documents.count() == 0


def test_arguments():
    assert session_id(None) == "default" and limit_of(900) == 50 and limit_of(0) == 1
    assert parsed_uri("tl://s/doc/doc_1/level/2") == ("s", "doc", "doc_1", 2)
    for bad in ("", "a b", "x" * 81):
        with pytest.raises(ValueError):
            session_id(bad)
    assert MemoryEngine.risk_of("Do not delete invoice 12.")["level"] == "medium"
