import pytest

from textloom.functions import notes
from textloom.sources import store


def test_commit_read_conflict(spark, tmp_path):
    s = store.TableStore(spark, str(tmp_path))
    one = spark.createDataFrame([(1, "a")], "k int, v string")
    assert s.commit({"t": one}) == 1
    assert s.read("t").collect() == one.collect()
    with pytest.raises(store.RevisionConflict):
        s.commit({"t": one}, expected_revision=0)
    assert s.transact(lambda st: {"t": st.read("t").union(one)}) == 2
    assert s.read("t").count() == 2
    with pytest.raises(store.StoreInvalid):
        s.read("missing")


def test_dead_lock_is_cleared(spark, tmp_path):
    s = store.TableStore(spark, str(tmp_path), alive=lambda pid: False)
    import json
    import socket

    (tmp_path / "_lock").write_text(json.dumps({"pid": 1, "host": socket.gethostname(), "token": "x"}))
    assert s.commit({"t": spark.range(1)}) == 1


def test_migration(spark, tmp_path):
    (tmp_path / "v1.json").write_text('{"version":1,"sessions":[{"id":"s","createdAt":"2024-01-01T00:00:00Z","lastAccessedAt":"2024-01-01T00:00:00Z","documents":[{"id":"doc_1","label":"a","mode":"text","text":"same","checksum":"c1"},{"id":"doc_2","label":"b","mode":"text","text":"same","checksum":"c2"}]}]}')
    t = store.migrated(spark, str(tmp_path / "v1.json"))
    source = t["sources"].collect()
    assert len(source) == 1 and len(source[0].origins) == 2 and source[0].legacy_checksums == ["c1", "c2"]
    assert store.invalid_sources(t["sources"]).count() == 0 and t["documents"].count() == 2


def test_spans_cover_crlf_text():
    text = "One.\r\n\r\nTwo words here.\r\nMore.\r\n\r\nThree."
    for s in notes.span_notes(text, "text"):
        assert text.encode()[s["start_byte"] : s["end_byte"]].decode() == s["text"]
