"""A revisioned store of tables: immutable Parquet for each revision, one manifest that names the current one.

A commit writes its tables under a new revision and then puts the manifest in place of the old one, under a lock; if
another writer came first, it fails without a trace. Reading the manifest gives a whole revision, never a mixture.
"""

from __future__ import annotations

import json
import os
import socket
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = 2
LOCK_TIMEOUT, LOCK_RETRY = 2.0, 0.02


class StoreError(Exception):
    code = "STORE"


class RevisionConflict(StoreError):
    code = "STORE_REVISION_CONFLICT"


class StoreBusy(StoreError):
    code = "STORE_BUSY"


class StoreInvalid(StoreError):
    code = "STORE_INVALID"


class StoreTooLarge(StoreError):
    code = "STORE_TOO_LARGE"


class TableStore:
    """Named DataFrames under a folder. The manifest and its lock are small local or mounted files of the driver."""

    def __init__(self, spark: SparkSession, folder: str, max_bytes: int | None = None, alive: Callable[[int], bool] | None = None):
        self.spark, self.folder, self.max_bytes = spark, folder.rstrip("/"), max_bytes
        self.alive = alive or _alive
        os.makedirs(self.folder, exist_ok=True)

    @property
    def manifest_path(self) -> str:
        return f"{self.folder}/_manifest.json"

    def manifest(self) -> dict:
        try:
            with open(self.manifest_path) as f:
                found = json.load(f)
        except FileNotFoundError:
            return {"version": VERSION, "revision": 0, "tables": {}}
        except ValueError as e:
            raise StoreInvalid(f"the manifest isn't JSON: {e}") from e
        if found.get("version") != VERSION or not isinstance(found.get("revision"), int) or not isinstance(found.get("tables"), dict):
            raise StoreInvalid("the manifest has another format")
        return found

    @property
    def revision(self) -> int:
        return self.manifest()["revision"]

    def read(self, name: str) -> DataFrame:
        """A table of the current revision."""
        tables = self.manifest()["tables"]
        if name not in tables:
            raise StoreInvalid(f"no table {name}")
        return self.spark.read.parquet(f"{self.folder}/{tables[name]}")

    def commit(self, tables: dict[str, DataFrame], expected_revision: int | None = None, partition_by: dict[str, str] | None = None) -> int:
        """Puts these tables in place of those of the same names, all at once; returns the new revision."""
        began = self.manifest()
        if expected_revision is not None and began["revision"] != expected_revision:
            raise RevisionConflict(f"revision {began['revision']}, not {expected_revision}")
        part = f"data/{uuid.uuid4().hex}"
        paths = {}
        for name, df in tables.items():
            writer = df.write
            if partition_by and name in partition_by:
                writer = writer.partitionBy(partition_by[name])
            paths[name] = f"{part}/{name}"
            writer.parquet(f"{self.folder}/{paths[name]}")
        self._check_size(f"{self.folder}/{part}")
        with self._lock():
            now = self.manifest()
            if now["revision"] != began["revision"]:
                raise RevisionConflict(f"revision {now['revision']}, not {began['revision']}")
            after = {"version": VERSION, "revision": now["revision"] + 1, "saved_at": time.time(), "tables": now["tables"] | paths}
            fresh = f"{self.manifest_path}.{uuid.uuid4().hex}"
            with open(fresh, "x") as f:
                json.dump(after, f)
                f.flush()
                os.fsync(f.fileno())
            os.replace(fresh, self.manifest_path)
        return after["revision"]

    def transact(self, change: Callable[[TableStore], dict[str, DataFrame]], timeout: float = LOCK_TIMEOUT) -> int:
        """commit(change(store)), again from the newer revision when another writer came first."""
        until = time.time() + timeout
        while True:
            try:
                return self.commit(change(self), self.revision)
            except RevisionConflict as e:
                if time.time() > until:
                    raise StoreBusy("other writers kept coming first") from e
                time.sleep(LOCK_RETRY)

    def _check_size(self, path: str) -> None:
        if self.max_bytes is not None:
            size = sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names)
            if size > self.max_bytes:
                raise StoreTooLarge(f"{size} bytes, {self.max_bytes} allowed")

    @contextmanager
    def _lock(self) -> Iterator[None]:
        path, mine = f"{self.folder}/_lock", json.dumps({"pid": os.getpid(), "host": socket.gethostname(), "token": uuid.uuid4().hex})
        until = time.time() + LOCK_TIMEOUT
        while True:
            try:
                with open(path, "x") as f:
                    f.write(mine)
                break
            except FileExistsError:
                self._clear_dead(path)
                if time.time() > until:
                    raise StoreBusy("another writer holds the store") from None
                time.sleep(LOCK_RETRY)
        try:
            yield
        finally:
            with open(path) as f:
                held = f.read()
            if held == mine:
                os.unlink(path)

    def _clear_dead(self, path: str) -> None:
        """A lock of a process of this host that is gone is removed."""
        try:
            with open(path) as f:
                owner = json.load(f)
            if owner["host"] == socket.gethostname() and not self.alive(owner["pid"]):
                os.unlink(path)
        except (OSError, ValueError, KeyError):
            pass


def _alive(pid: int) -> bool:
    try:
        os.kill(pid, 0)
    except ProcessLookupError:
        return False
    except PermissionError:
        pass
    return True


def invalid_sources(sources: DataFrame) -> DataFrame:
    """Sources whose digest or byte length isn't that of their text; must be empty."""
    return sources.where(F.col("text").isNotNull() & ((F.sha2("text", 256) != F.col("sha256")) | (F.octet_length("text") != F.col("byte_length"))))


SESSIONS_V1 = "array<struct<id:string,createdAt:string,lastAccessedAt:string,documents:array<struct<id:string,label:string,mode:string,text:string,checksum:string>>>>"


def migrated(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Tables of a version 1 JSON store: sources (equal texts once), documents that refer to them, sessions."""
    raw = spark.read.schema(f"version int, savedAt string, sessions {SESSIONS_V1}").json(path, multiLine=True)
    sessions = raw.select(F.explode("sessions").alias("s")).select("s.*")
    docs = sessions.select(F.col("id").alias("session_id"), F.explode("documents").alias("d")).select("session_id", F.col("d.id").alias("document_id"), "d.label", "d.mode", "d.text", F.col("d.checksum").alias("legacy_checksum"), F.sha2(F.coalesce("d.text", F.lit("")), 256).alias("sha256"))
    texts = docs.where("text is not null")
    sources = texts.groupBy("sha256").agg(F.first("text").alias("text"), F.max(F.octet_length("text")).cast("long").alias("byte_length"), F.array_sort(F.collect_set(F.struct("session_id", "document_id"))).alias("origins"), F.array_sort(F.collect_set("legacy_checksum")).alias("legacy_checksums"))
    return {"sources": sources, "documents": docs.drop("text", "legacy_checksum"), "sessions": sessions.select(F.col("id").alias("session_id"), F.to_timestamp("createdAt").alias("created_at"), F.to_timestamp("lastAccessedAt").alias("last_accessed_at"))}
