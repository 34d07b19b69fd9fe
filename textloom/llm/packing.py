"""Best-fit packing into sequences of several permitted lengths.

Each block of pieces is packed longest first: a piece goes to the open bin that it fits most tightly. If it fits none,
a bin is opened, of the length that costs least for a token: for each permitted length, a trial fills the bin from the
pieces that are left, and the length's price is divided by what the trial filled. At the end each bin shrinks to the
shortest permitted length that holds its contents.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Permitted sequence lengths, and what one costs besides its tokens (attention over padding, a row of the batch).
LENGTHS = (512, 1024, 2048, 4096)
OVERHEAD = 32
#: Pieces that are packed together; a task packs block after block.
BLOCK = 32_768


class _Left:
    """How many pieces of each length are left; finds the longest one of at most a given length."""

    def __init__(self, lengths: Sequence[int], longest: int):
        self.count = [0] * (longest + 1)
        for n in lengths:
            self.count[n] += 1
        self.down = [n if c else n - 1 for n, c in enumerate(self.count)]  # towards the next length that is left
        self.down[0] = 0

    def take(self, n: int) -> None:
        self.count[n] -= 1
        if not self.count[n]:
            self.down[n] = n - 1

    def longest(self, n: int) -> int:
        """0 if there is none."""
        down, seen = self.down, n
        while down[seen] != seen:
            seen = down[seen]
        while down[n] != n:
            down[n], n = seen, down[n]
        return seen

    def trial(self, room: int) -> int:
        """What a bin of so much room would hold, filled with the longest piece that fits, again and again."""
        filled, used = 0, {}
        n = self.longest(room)
        while n:
            times = min(self.count[n] - used.get(n, 0), (room - filled) // n)
            if times > 0:
                used[n] = used.get(n, 0) + times
                filled += times * n
            n = self.longest(min(n - 1, room - filled)) if n > 1 and room > filled else 0
        return filled


def pack(lengths: Sequence[int], permitted: Sequence[int] = LENGTHS, overhead: int = OVERHEAD) -> list[tuple[int, int, int]]:
    """(bin, offset, capacity) of each piece; lengths from 1 to the longest permitted one. Ties go by position."""
    permitted = sorted(permitted)
    top = permitted[-1]
    left = _Left(lengths, top)
    order = sorted(range(len(lengths)), key=lambda k: (-lengths[k], k))
    open_: dict[int, list[int]] = {}  # room -> bins
    mask = 0  # bit r: some bin has room r
    filled: list[int] = []
    out: list[tuple[int, int]] = [(0, 0)] * len(lengths)
    for k in order:
        n = lengths[k]
        left.take(n)
        fits = mask >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            bin_ = open_[room].pop()
            if not open_[room]:
                mask ^= 1 << room
        else:
            room = min(permitted[bisect_left(permitted, n) :], key=lambda c: ((c + overhead) / (n + left.trial(c - n)), c))
            bin_ = len(filled)
            filled.append(0)
        out[k] = (bin_, filled[bin_])
        filled[bin_] += n
        room -= n
        if room:
            if not mask >> room & 1:
                mask |= 1 << room
                open_[room] = []
            open_[room].append(bin_)
    sizes = [permitted[bisect_left(permitted, n)] for n in filled]
    return [(b, at, sizes[b]) for b, at in out]


def pieces(docs: DataFrame, length: Column, doc_id: str = "doc_id", longest: int = LENGTHS[-1]) -> DataFrame:
    """doc_id, piece (from 0), start and length: documents cut into pieces of the longest permitted length and a rest.

    Null and zero lengths give no piece.
    """
    n = docs.select(F.col(doc_id).alias("doc_id"), length.cast("long").alias("n")).where("n > 0")
    cut = n.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {longest}"))))
    return cut.select("doc_id", F.col("piece").cast("int").alias("piece"), (F.col("piece") * longest).alias("start"), F.least(F.lit(longest), F.col("n") - F.col("piece") * longest).cast("int").alias("length"))


def pack_pieces(table: DataFrame, permitted: Sequence[int] = LENGTHS, overhead: int = OVERHEAD, block: int = BLOCK) -> DataFrame:
    """doc_id, piece, start, length, and bin_id, bin_offset and capacity of each piece.

    Pieces are dealt evenly over tasks by a hash of all they have and of their place in the table, so repeated rows
    are dealt apart too, and stand there in a fixed order, so a repeated task makes the same bins; each task packs one
    block after another in bounded memory. bin_id is the task's number times 2^40 and a running number.
    """
    permitted = tuple(sorted(permitted))
    what = ["doc_id", "piece", "start", "length"]
    dealt = table.select(*what).withColumn("deal", F.xxhash64(*what, F.monotonically_increasing_id())).repartition("deal").sortWithinPartitions("deal", "doc_id", "piece")
    schema = T.StructType([T.StructField("doc_id", table.schema["doc_id"].dataType), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.IntegerType()), T.StructField("bin_id", T.LongType(), False), T.StructField("bin_offset", T.IntegerType(), False), T.StructField("capacity", T.IntegerType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 40
        waiting: list[pa.RecordBatch] = []
        rows = 0

        def packed(take: int) -> pa.RecordBatch:
            nonlocal base, waiting, rows
            all_ = pa.Table.from_batches(waiting).combine_chunks()
            now, rest = all_.slice(0, take), all_.slice(take)
            waiting, rows = rest.to_batches() if rest.num_rows else [], rest.num_rows
            placed = pack(now.column("length").to_pylist(), permitted, overhead)
            out = pa.Table.from_arrays([*(now.column(c) for c in what), pa.array([base + b for b, _, _ in placed], pa.int64()), pa.array([at for _, at, _ in placed], pa.int32()), pa.array([c for _, _, c in placed], pa.int32())], names=[*what, "bin_id", "bin_offset", "capacity"])
            base += 1 + max(b for b, _, _ in placed)
            return out.combine_chunks().to_batches()[0]

        for batch in batches:
            if batch.num_rows:
                waiting.append(batch)
                rows += batch.num_rows
            while rows >= block:
                yield packed(block)
        if rows:
            yield packed(rows)

    return dealt.mapInArrow(run, schema)


def sequences(placed: DataFrame, tokens: DataFrame, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """bin_id, capacity, tokens (the bin's tokens in order) and documents (doc_id, piece, offset, length of each part).

    placed: from pack_pieces(), with lengths in tokens; tokens: one row for each doc_id with its array of tokens.
    Pieces of documents that aren't in `tokens`, a null id's among them, are left out. A bin's parts are gathered in
    one row, which holds at most its capacity.
    """
    own = tokens.select(F.col(doc_id).alias("doc_id"), F.col(ids).alias("all_ids"))
    cut = placed.join(own, "doc_id").select("bin_id", "capacity", "doc_id", "piece", "bin_offset", "length", F.slice("all_ids", (F.col("start") + 1).cast("int"), F.col("length")).alias("part"))
    bins = cut.groupBy("bin_id", "capacity").agg(F.array_sort(F.collect_list(F.struct("bin_offset", "doc_id", "piece", "length", "part"))).alias("parts"))
    documents = F.transform("parts", lambda p: F.struct(p["doc_id"].alias("doc_id"), p["piece"].alias("piece"), p["bin_offset"].alias("offset"), p["length"].alias("length")))
    return bins.select("bin_id", "capacity", F.flatten(F.transform("parts", lambda p: p["part"])).alias("tokens"), documents.alias("documents"))


def word_count(text: str = "text") -> Column:
    """Words of a text (runs of anything but ASCII white space); 0 for null."""
    bare = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), "^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$", "")
    return F.when(bare == "", 0).otherwise(F.size(F.split(bare, "[\\x20\\x09-\\x0D]+")))


def pack_documents(docs: DataFrame, length: Column | None = None, permitted: Sequence[int] = LENGTHS, overhead: int = OVERHEAD, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Packs whole documents: pieces() and pack_pieces(). length defaults to the number of words.

    No token is dropped: a document longer than the longest length becomes several pieces. Documents without words
    have no piece; a null doc_id stays null.
    """
    return pack_pieces(pieces(docs, word_count(text) if length is None else length, doc_id, max(permitted)), permitted, overhead)
