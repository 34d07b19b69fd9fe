"""Histogram sort into shards of near-equal bytes, with DataFrame functions only.

Rows have a 120-bit sort key: a hash of the text (so equal texts stand together), then a hash of the row. The key space
is cut into candidate boundaries; the exact bytes and rows below each are counted across all partitions; only the
cells that a shard's border falls into, or that hold a large share of the rows, are cut again, until every splitter
is exact. Then the rows are exchanged once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import stored

#: Bits of the first histogram and of each refinement: 4096 cells, then 256 for each open cell.
FIRST_BITS, NEXT_BITS, HASH_BITS = 12, 8, 60
#: A key with at least this share of all rows is numbered in 256 portions.
HOT_SHARE = 1 / 512


def _digits(column: str, bits: int):
    """The first `bits` bits of a 60-bit hash."""
    return F.shiftrightunsigned(F.col(column), HASH_BITS - bits)


class _Cells:
    """The histogram so far: for each open cell where it starts, in bytes."""

    def __init__(self, keyed: DataFrame, total: int, rows: int, shards: int):
        self.keyed, self.total, self.rows, self.shards = keyed, total, rows, shards
        self.group_limit = total / shards
        self.least_hot = max(2, rows * HOT_SHARE)
        self.splitters: dict[int, tuple[int, int]] = {}
        self.hot: set[int] = set()

    def targets(self, start: int, end: int) -> list[int]:
        """Borders i (at i / shards of all bytes) with start < border < end."""
        return [i for i in range(max(1, start * self.shards // self.total), self.shards) if start * self.shards < i * self.total < end * self.shards]

    def first_at(self, start: int, size: int, key: tuple[int, int], after: tuple[int, int], whole: bool, group: bool) -> None:
        """Borders at a cell's start belong to it; if it can't be cut, those inside a group go to its nearer end, those
        inside a row to what follows."""
        for i in range(1, self.shards):
            if start * self.shards == i * self.total:
                self.splitters.setdefault(i, key)
        if whole:
            for i in self.targets(start, start + size):
                nearer_start = group and 2 * (i * self.total - start * self.shards) <= size * self.shards
                self.splitters[i] = key if nearer_start else after

    def run(self) -> None:
        open_: dict[tuple[int, int], int] = {(0, 0): 0}  # (hash so far, row hash so far) -> start
        bits, row_bits = 0, 0
        while open_ and row_bits < HASH_BITS:
            before = (bits, row_bits)
            if bits < HASH_BITS:
                bits += FIRST_BITS if not bits else NEXT_BITS
            else:
                row_bits += FIRST_BITS if not row_bits else NEXT_BITS
            open_ = self._refine(open_, before, bits, row_bits)

    def _refine(self, open_: dict, before: tuple[int, int], bits: int, row_bits: int) -> dict:
        rows = self.keyed
        if before[1]:
            parents = F.concat_ws(":", "h", _digits("g", before[1]))
            rows = rows.where(F.col("h").isin([h for h, _ in open_]) & parents.isin([f"{h}:{g}" for h, g in open_]))
        elif before[0]:
            rows = rows.where(_digits("h", before[0]).isin([h for h, _ in open_]))
        cells = rows.groupBy(_digits("h", bits).alias("h"), (_digits("g", row_bits) if row_bits else F.lit(0).cast("long")).alias("g")).agg(F.sum("size").alias("size"), F.count("*").alias("n"))
        found = sorted(tuple(r) for r in cells.collect())  # at most 256 (first 4096) for each open cell
        place: dict[tuple[int, int], int] = dict(open_)
        after: dict[tuple[int, int], int] = {}
        last = bits == HASH_BITS and row_bits == HASH_BITS
        for h, g, size, n in found:
            parent = (h, g >> (row_bits - before[1])) if row_bits else (h >> (bits - before[0]), 0)
            start = place[parent]
            place[parent] = start + size
            if bits < HASH_BITS:
                low, next_ = (h << (HASH_BITS - bits), 0), ((h + 1) << (HASH_BITS - bits), 0)
            else:
                low, next_ = (h, g << (HASH_BITS - row_bits)) if row_bits else (h, 0), (h, (g + 1) << (HASH_BITS - row_bits)) if row_bits else (h + 1, 0)
            group = bits == HASH_BITS and not row_bits
            small = group and size <= self.group_limit
            hot = not row_bits and n >= self.least_hot
            if group and hot:
                self.hot.add(h)
            whole = small or last or row_bits and n == 1
            self.first_at(start, size, low, next_, bool(whole), small)
            inside = not whole and self.targets(start, start + size)
            if inside or hot and not group:
                after[h, g] = start
        return after


def shard_by_bytes(df: DataFrame, text_hash: str, row_hash: str, size: str, n_shards: int) -> DataFrame:
    """df with shard (0 to n_shards - 1) and slot (gapless from 0 in each shard), the columns named replaced if present.

    text_hash: a long column, equal for rows of one group; row_hash: a long column that tells a group's rows apart;
    size: each row's bytes, over 0. Rows stand in the order (text_hash, row_hash). A group of at
    most a shard's bytes stays whole: a border inside it moves to its nearer end. Only a larger group is cut, between
    rows: each goes to the shard in whose byte range it starts. So a border is off by half a group or a row's size at
    most. Rows equal in both hashes stay together. An empty table stays empty.

    df is written once to the shared folder (give it narrow: keys and what has to travel), so the rows counted are
    the rows placed. Hot groups are numbered in 256 portions; no task holds a shard or a group whole.
    """
    clean = df.drop("shard", "slot")
    half = F.lit((1 << HASH_BITS) - 1)
    keyed = stored(clean.withColumns({"h": F.shiftrightunsigned(text_hash, 4), "g": F.col(row_hash).bitwiseAND(half)}))
    total, rows = keyed.agg(F.coalesce(F.sum(size), F.lit(0)), F.count("*")).first()
    cells = _Cells(keyed.withColumn("size", F.col(size)), total, rows, n_shards)
    if rows:
        cells.run()
    top = ((1 << HASH_BITS) + 1, 0)
    borders = [cells.splitters.get(i, top) for i in range(1, n_shards)]
    h, g = F.col("h"), F.col("g")
    shard = F.lit(0)
    for bh, bg in borders:
        shard = shard + ((h > bh) | ((h == bh) & (g >= bg))).cast("int")
    hot = F.array([F.lit(x).cast("long") for x in sorted(cells.hot)]).cast("array<long>")
    place = F.size(F.filter(hot, lambda x: x < h)) + F.size(F.filter(hot, lambda x: x <= h))  # odd: a hot key
    placed = keyed.withColumns({"shard": shard, "cell": _digits("h", FIRST_BITS), "near": place if cells.hot else F.lit(0)})
    placed = placed.withColumn("portion", F.when(F.col("near") % 2 == 1, _digits("g", 8)).otherwise(F.lit(0).cast("long")))
    cell = ["shard", "cell", "near", "portion"]
    in_order = Window.partitionBy("shard").orderBy(*cell[1:])
    # at most 4096 cells, one more for each border, 256 for each of at most 512 hot keys
    bases = placed.groupBy(*cell).count().withColumn("base", F.sum("count").over(in_order) - F.col("count")).drop("count")
    numbered = placed.withColumn("at", F.row_number().over(Window.partitionBy(*cell).orderBy("h", "g")))
    return numbered.join(F.broadcast(bases), cell).withColumn("slot", F.col("base") + F.col("at") - 1).select(*clean.columns, "shard", "slot")


def shard_documents(docs: DataFrame, n_shards: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size (UTF-8 bytes of the text and 16), text_crc32, shard and slot of each document, sized near-equally.

    A null text counts as empty; a null doc_id stays null; repeated rows are each placed.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    narrow = docs.select(F.col(doc_id).alias("doc_id"), (F.octet_length(body) + 16).cast("long").alias("size"), F.crc32(body).alias("text_crc32"), F.xxhash64(body).alias("text_hash"), F.coalesce(F.xxhash64(F.col(doc_id)), F.lit(0)).alias("id_hash"), F.monotonically_increasing_id().alias("row"))
    # rows of one id and text are told apart by their place in the written table
    mixed = F.shiftleft(F.shiftrightunsigned("id_hash", 34), 30).bitwiseOR(F.xxhash64("row").bitwiseAND(F.lit((1 << 30) - 1)))
    narrow = narrow.withColumn("row_hash", mixed).drop("id_hash", "row")
    return shard_by_bytes(narrow, "text_hash", "row_hash", "size", n_shards).select("doc_id", "size", "text_crc32", "shard", "slot")
