"""Token ids as flat unsigned integers on disk, with 64-bit document offsets, memory-mapped when read.

A written set is a folder with, for each shard k, in ascending document order over shards and within them:

    shard-k.bin   the ids of its documents one after another, little-endian uint16 or uint32
    shard-k.off   little-endian int64: n + 1 offsets in ids from the shard's start
    shard-k.doc   little-endian int64: the n document ids (the smallest int64 stands for null)

and manifest.json: the id type and, for each shard, its documents, its ids and its base, the number of ids in all
shards before it (the prefix sums of the shards' counts). A document's place in the whole is base + offset.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.llm.common import BATCH_BYTES, forget, slices

NULL_ID = np.iinfo(np.int64).min


def filesystem(uri: str):
    """(file system, path) of a shared folder: local paths and file: URIs, or whatever pyarrow can reach."""
    from pyarrow import fs

    if uri.startswith("file:"):
        uri = "/" + uri[5:].lstrip("/")
    if uri.startswith("/"):
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


class LibraryEncoder:
    """Ids of texts by a tokenizers file, without special tokens being added.

    No piece of the byte-level split reaches across a single space between other characters, so the parts between
    such spaces are encoded apart, and those that come up often once. Parts that aren't remembered go to the library
    many in one text; a token that begins with a space begins a part there. A text with the string of an added token
    goes to the library whole.
    """

    PORTION = 512

    def __init__(self, definition: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        from textloom.llm.bpe import Parts

        self.library = Tokenizer.from_str(definition)
        model = json.loads(definition)
        before = model.get("pre_tokenizer") or {}
        self.cuts = model.get("normalizer") is None and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space", True)
        self.added = [t["content"] for t in model.get("added_tokens", [])]
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        self.begins = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.begins[[i for token, i in vocabulary.items() if token.startswith("\u0120")]] = True  # how the files write a space
        self.parts = Parts(self._parts)

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for k in range(0, len(texts), self.PORTION):
            out += [np.array(e.ids, np.int32) for e in self.library.encode_batch_fast(texts[k : k + self.PORTION], add_special_tokens=False)]
        return out

    def _parts(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all parts, how many each has)."""
        plain, other = [], []
        for k, p in enumerate(parts):
            (plain if p[0] == " " and len(p) > 1 and " " not in p[1:] and not p[1].isspace() and not p[-1].isspace() else other).append(k)
        blocks = [plain[k : k + self.PORTION] for k in range(0, len(plain), self.PORTION)]
        order, sizes, source = [], [], [_NONE]
        for block, ids in zip(blocks, self._whole(["".join([parts[k] for k in block]) for block in blocks]), strict=True):
            first = np.flatnonzero(self.begins[ids])
            if len(first) != len(block):
                other += block
                continue
            order += block
            sizes.append(np.diff(np.append(first, len(ids))))
            source.append(ids)
        rest = self._whole([parts[k] for k in other])
        source += rest
        sizes.append(np.array([len(x) for x in rest], np.int64))
        size, place = np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64)
        at, n = np.array(order + other, np.int64), np.concatenate(sizes)
        size[at], place[at] = n, np.cumsum(n) - n
        ends = np.cumsum(size)
        return np.concatenate(source)[np.arange(int(size.sum())) + np.repeat(place - (ends - size), size)], size

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(int32 ids of all texts, where each text's begin and the last's end); null counts as empty."""
        texts = texts.fill_null("")
        special = np.zeros(len(texts), bool) | (not self.cuts)
        for content in self.added:
            special |= pc.match_substring(texts, content).to_numpy(zero_copy_only=False)
        if not special.any():
            return self.parts.encode(texts)
        ids, places = self.parts.encode(texts.filter(pa.array(~special)))
        usual, whole = iter(np.split(ids, places[1:-1]) if len(places) > 1 else []), iter(self._whole(texts.filter(pa.array(special)).to_pylist()))
        own = [next(whole if s else usual) for s in special.tolist()]
        return np.concatenate([_NONE, *own]), np.append(0, np.cumsum([len(x) for x in own])).astype(np.int64)


_NONE = np.zeros(0, np.int32)
_MADE: dict[int, LibraryEncoder] = {}


def library_encoder(definition: str) -> Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]:
    """The encoder of a tokenizers definition, kept for the life of a Python worker."""
    key = hash(definition)
    if key not in _MADE:
        _MADE[key] = LibraryEncoder(definition)
    return _MADE[key].encode


def _forget_encoders() -> None:
    forget(_MADE)


def write(docs: DataFrame, definition: str, folder: str, doc_id: str = "doc_id", text: str = "text", end_id: int = 0) -> dict:
    """Encodes all documents, writes them in ascending doc_id order under `folder` and returns the manifest.

    definition: a tokenizers file's content. end_id closes each document. Null texts count as empty (end_id only);
    rows without doc_id come first; rows with equal doc_id stand in the order of their texts' hashes and then of the
    table, so that they can be dealt over shards. Other columns are not read. An empty table gives a manifest without shards.

    One exchange by ranges of doc_id; each task then encodes its range and writes its shard under a name of its own
    attempt, moved into place when whole, so a repeated task overwrites nothing half-way.
    """
    spark = docs.sparkSession
    vocabulary = json.loads(definition)["model"]["vocab"]
    top = max([end_id, *(vocabulary.values() if isinstance(vocabulary, dict) else [len(vocabulary)]), *(t["id"] for t in json.loads(definition).get("added_tokens", []))])
    dtype = "<u2" if top < 1 << 16 else "<u4"
    sent = spark.sparkContext.broadcast(definition)  # one tokenizer file, a few MB
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"), F.xxhash64(text).alias("tie"), F.monotonically_increasing_id().alias("nth"))
    ordered = rows.repartitionByRange("id", "tie", "nth").sortWithinPartitions("id", "tie", "nth")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = library_encoder(sent.value)
        fs, base = filesystem(folder)
        fs.create_dir(base, recursive=True)
        part = TaskContext.get().partitionId()
        name, attempt = f"shard-{part:06d}", uuid.uuid4().hex
        n_docs = n_ids = 0
        files = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            if not files:
                files = {x: fs.open_output_stream(f"{base}/.{name}-{attempt}.{x}") for x in ("bin", "off", "doc")}
                files["off"].write(np.zeros(1, "<i8").tobytes())
            ids = batch.column("id")
            for k, count in slices(batch.column("text")):
                tokens, places = encode(batch.column("text").slice(k, count))
                ends = n_ids + places[1:] + np.arange(1, count + 1)
                files["bin"].write(np.insert(tokens, places[1:], end_id).astype(dtype).tobytes())
                files["off"].write(ends.astype("<i8").tobytes())
                files["doc"].write(ids.slice(k, count).fill_null(int(NULL_ID)).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
                n_ids, n_docs = int(ends[-1]), n_docs + count
        if files:
            for x, f in files.items():
                f.close()
                fs.move(f"{base}/.{name}-{attempt}.{x}", f"{base}/{name}.{x}")
            yield pa.RecordBatch.from_pylist([{"part": part, "name": name, "n_docs": n_docs, "n_ids": n_ids}])

    counts = ordered.mapInArrow(run, "part long, name string, n_docs long, n_ids long").collect()  # one row per shard
    shards, base = [], 0
    for row in sorted(counts, key=lambda r: r.part):
        shards.append({"name": row["name"], "n_docs": row.n_docs, "n_ids": row.n_ids, "base": base})
        base += row.n_ids
    manifest = {"dtype": dtype, "n_ids": base, "shards": shards}
    fs, path = filesystem(folder)
    fs.create_dir(path, recursive=True)
    with fs.open_output_stream(f"{path}/manifest.json") as f:
        f.write(json.dumps(manifest).encode())
    return manifest


def open_shard(folder: str, name: str, dtype: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, offsets, document ids) of a shard: memory-mapped where the folder is a local path."""
    fs, base = filesystem(folder)
    out = []
    for kind, t in (("bin", dtype), ("off", "<i8"), ("doc", "<i8")):
        path = f"{base}/{name}.{kind}"
        if fs.type_name == "local":
            out.append(np.memmap(path, t, "r") if os.path.getsize(path) else np.zeros(0, t))
        else:
            with fs.open_input_file(path) as f:
                out.append(np.frombuffer(f.read_buffer(), t))
    return tuple(out)


def read(spark: SparkSession, folder: str, crc32: str | None = None) -> DataFrame:
    """A row for each document, from the files: doc_id, start (ids of all documents before it), n_tokens, ids (array<int>).

    crc32: the name of a column that stands for ids, with what ids_crc32() gives for them, so that no ids leave the
    worker and none is needed for ids_crc32().
    """
    fs, base = filesystem(folder)
    with fs.open_input_file(f"{base}/manifest.json") as f:
        manifest = json.loads(f.read())
    dtype = manifest["dtype"]
    shards = [(s["name"], s["base"]) for s in manifest["shards"]]
    table = spark.createDataFrame(shards, "name string, base long")
    if shards:
        table = table.repartition(min(len(shards), 10_000))
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), (crc32, pa.int64()) if crc32 else ("ids", pa.list_(pa.int32()))])
    last = T.StructField(crc32, T.LongType(), False) if crc32 else T.StructField("ids", T.ArrayType(T.IntegerType(), False), False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _forget_encoders()  # the files are whole
        for batch in batches:
            for shard in batch.to_pylist():
                ids, offsets, docs = open_shard(folder, shard["name"], dtype)
                k = 0
                while k < len(docs):
                    stop = max(k + 1, int(np.searchsorted(offsets, offsets[k] + BATCH_BYTES // 4, "right")) - 1)
                    stop = min(stop, len(docs))
                    cut = offsets[k : stop + 1]
                    flat = pa.array(ids[cut[0] : cut[-1]].astype(np.int32))
                    lists = pa.ListArray.from_arrays(pa.array((cut - cut[0]).astype(np.int32)), flat)
                    known = docs[k:stop] != NULL_ID
                    yield pa.RecordBatch.from_arrays([pa.array(docs[k:stop], mask=~known), pa.array(shard["base"] + cut[:-1]), pa.array(np.diff(cut)), _crc32(lists) if crc32 else lists], schema=schema)
                    k = stop

    return table.mapInArrow(run, T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType(), False), T.StructField("n_tokens", T.LongType(), False), last]))


def _crc32(lists: pa.Array) -> pa.Array:
    """The unsigned crc32 of each list's ids as little-endian unsigned 32-bit integers."""
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype("<u4")
    ends = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    return pa.array([zlib.crc32(x) for x in np.split(flat, ends[:-1])] if len(lists) else [], pa.int64())


def ids_crc32(df: DataFrame, ids: str = "ids", out: str = "ids_crc32") -> DataFrame:
    """df with the unsigned crc32 of each row's ids as little-endian unsigned 32-bit integers."""

    @F.arrow_udf(T.LongType())
    def run(column: pa.Array) -> pa.Array:
        return _crc32(column)

    return df.withColumn(out, run(F.col(ids)))
