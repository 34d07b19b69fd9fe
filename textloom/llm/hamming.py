"""Approximate nearest neighbours by multi-index hashing.

A rotation is learned (principal directions, then alternating sign and orthogonal Procrustes steps, several times with
other starts for more bits) so that the signs of rotated vectors keep angles. Codes are split into substrings, each
with a table of its own. A code within Hamming radius r of the query agrees with it to within r // m bits in one of m
substrings, so probing all values that near in each table retrieves every code within r. The radius grows until enough
codes are retrieved; these are ranked by their float vectors.

Rows are dealt over blocks of bounded size, each with its tables; each block answers every query, also dealt in
blocks, with its own best, and the best of all blocks are returned. A task has several blocks and hands on the best of
all of them. Many queries step through the tables of a block at once: a table has, for each value and each number of
bits, the set of rows within that many bits, so a query's rows are the union of one set from each table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import stored

#: Vectors that the rotation is learned from, rounds of learning, rotations (each of as many bits as dimensions).
SAMPLE, ROUNDS, ROTATIONS = 16_384, 20, 4
#: Bits of a substring; rows of a block; queries of a block; the part of a block that is ranked by floats at least.
SUBSTRING, BLOCK, QUERIES, SHARE, LEAST = 8, 2048, 16_384, 0.08, 64
#: Blocks of a task at most; queries that step through the tables together.
TASK_BLOCKS, TOGETHER = 8, 128


class Rotation:
    """Signs of rotated, centred vectors."""

    def __init__(self, sample: np.ndarray, rotations: int = ROTATIONS, seed: int = 5):
        """sample: at least one row."""
        self.mean = sample.mean(0)
        x = sample - self.mean
        d = x.shape[1]
        _, _, principal = np.linalg.svd(x, full_matrices=True) if len(x) < d else (None, None, np.linalg.eigh(x.T @ x)[1].T[::-1])
        rng = np.random.default_rng(seed)
        self.matrices = []
        for _ in range(rotations):
            r, _ = np.linalg.qr(rng.normal(size=(d, d)))
            v = x @ principal.T
            for _ in range(ROUNDS):
                u, _, w = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
                r = (u @ w).T
            self.matrices.append(principal.T @ r)
        self.matrix = np.hstack(self.matrices)

    def codes(self, x: np.ndarray) -> np.ndarray:
        """uint8 rows; a row's bits are those of all rotations."""
        return np.packbits((x - self.mean) @ self.matrix >= 0, axis=1)


class Index:
    """The substring tables of one block."""

    def __init__(self, codes: np.ndarray, substring: int = SUBSTRING):
        assert substring == 8, "substrings are the codes' bytes"
        self.codes = codes
        self.m = codes.shape[1]
        padded = np.zeros((len(codes), -(-self.m // 8) * 8), np.uint8)
        padded[:, : self.m] = codes
        self.words = np.ascontiguousarray(padded.view(np.uint64).T)
        member = np.zeros((self.m, 256, -(-len(codes) // 64) * 64), bool)
        member[np.arange(self.m)[:, None], codes.T, np.arange(len(codes))] = True
        #: of each number of bits: table x value x the rows within so many bits of that value, as bits
        self.within = [np.packbits(member, axis=2, bitorder="little").view(np.uint64)]

    def _sets(self, bits: int) -> np.ndarray:
        while len(self.within) <= bits:
            last = self.within[-1]
            wider = last.copy()
            for k in range(8):
                wider |= last[:, np.arange(256) ^ (1 << k)]
            self.within.append(wider)
        return self.within[bits]

    def search(self, codes: np.ndarray, enough: int) -> tuple[np.ndarray, np.ndarray]:
        """(number of the code, row) of all rows within each code's smallest radius that m substrings can prove and that
        holds `enough` rows; ordered by both."""
        n = len(self.codes)
        enough = min(enough, n)
        padded = np.zeros((len(codes), 8 * len(self.words)), np.uint8)
        padded[:, : self.m] = codes
        asked = padded.view(np.uint64)
        left, out = np.arange(len(codes)), []
        for s in range(9):  # bits by which a substring may differ
            sets = self._sets(s)
            found = sets[0][codes[left, 0]]
            for j in range(1, self.m):
                found |= sets[j][codes[left, j]]
            found = np.unpackbits(found.view(np.uint8), axis=1, count=n, bitorder="little").view(bool)
            distance = np.zeros((len(left), n), np.uint16)
            for k, word in enumerate(self.words):
                distance += np.bitwise_count(asked[left, k, None] ^ word)
            distance[~found] = 8 * self.m + 1  # no table gave it
            least = np.partition(distance, enough - 1, axis=1)[:, enough - 1]
            done = least <= self.m * (s + 1) - 1  # a code that no table gave differs by s + 1 bits in each substring
            query, row = np.nonzero(distance[done] <= least[done, None])
            out.append((left[done][query], row))
            left = left[~done]
            if not len(left):
                break
        query, row = (np.concatenate(x) for x in zip(*out, strict=True))
        order = np.argsort(query, kind="stable")
        return query[order], row[order]


def _vectors(table: pa.Table) -> np.ndarray:
    flat = table.column("vector").combine_chunks().flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(table.num_rows, -1)


def _best(asked: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each query, by score and then id."""
    order = np.lexsort((ids, score, asked))
    sizes = np.bincount(asked)
    nth = np.arange(len(order)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return order[nth < k]


def nearest(index: pa.Table, queries: pa.Table, rotation: Rotation, k: int, share: float = SHARE, least: int = LEAST) -> pa.Table:
    """query_id, query_row, vec_id, score: the k best rows of the blocks of a task for each query, by distance and then id.

    index: block, row, vec_id, vector; queries: row, vec_id, vector.
    """
    found = [(np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))]
    if index.num_rows and queries.num_rows:
        every, block, ids, rows = _vectors(index), *(index.column(c).to_numpy() for c in ("block", "vec_id", "row"))
        q, own = _vectors(queries), queries.column("row").to_numpy()
        codes = rotation.codes(q)
        for b in np.unique(block).tolist():
            here = np.flatnonzero(block == b)
            x = every[here]
            tables = Index(rotation.codes(x))
            enough = max(least, int(np.ceil(share * len(x))), k + 1)
            for at in range(0, len(q), TOGETHER):
                asked, near = tables.search(codes[at : at + TOGETHER], enough)
                asked += at
                other = rows[here[near]] != own[asked]
                asked, near = asked[other], near[other]
                score = np.sqrt(((x[near] - q[asked]) ** 2).sum(1))
                best = _best(asked, score, ids[here[near]], k)
                found.append((asked[best], score[best], ids[here[near[best]]]))
    asked, score, near = (np.concatenate(x) for x in zip(*found, strict=True))
    best = _best(asked, score, near, k)
    asked = asked[best]
    return pa.table({"query_id": queries.column("vec_id").take(pa.array(asked)), "query_row": queries.column("row").take(pa.array(asked)), "vec_id": pa.array(near[best], pa.int64()), "score": pa.array(score[best])})


def usable(vector, size) -> object:
    """Neither null nor zero, without null or non-finite components, and of the usual size."""
    return vector.isNotNull() & (F.size(vector) == size) & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(vector, lambda x: x != 0)


def search(table: DataFrame, k: int = 10, vec_id: str = "vec_id", vector: str = "embedding", block: int = BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each query its k nearest rows found, ties to the smaller vec_id.

    Queries are the rows whose id is divisible by 100. A query isn't its own neighbour, but another
    row of the same id is. Null ids, and vectors that are null, zero, of another size than most, or hold null or
    non-finite components take no part. Codes and copies of vectors may repeat without bound: blocks are dealt by
    row. The rotation is learned from at most SAMPLE rows, those of the smallest hashes; every row is indexed.
    """
    rows = table.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector")).where("vec_id is not null")
    size = rows.where("size(vector) > 0").groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), "size").first()
    rows = stored(rows.where(usable(F.col("vector"), F.lit(size[0] if size else 1))).withColumn("row", F.monotonically_increasing_id()))
    n = rows.count()
    result = "query_id long, query_row long, vec_id long, score double"
    if not n:
        return table.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sample = rows.select(F.xxhash64("vec_id", "row").alias("h"), "vector").orderBy("h").limit(SAMPLE).select("vector").toPandas()  # bounded
    rotation = Rotation(np.stack(sample["vector"].to_numpy()).astype(np.float64))
    sent = table.sparkSession.sparkContext.broadcast(rotation)  # a few matrices of dimensions x dimensions
    asked = rows.where("vec_id % 100 = 0")
    n_blocks, n_asked = -(-n // block), -(-max(1, asked.count()) // QUERIES)
    # several blocks a task where there are many, so that queries and results are sent once for all of them
    groups = max(-(-n_blocks // TASK_BLOCKS), min(n_blocks, 3 * table.sparkSession.sparkContext.defaultParallelism))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(n_blocks)).cast("int")).withColumn("blocks", F.col("block") % groups)
    index = dealt.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(n_asked - 1))))
    asked = asked.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(n_asked)).cast("int")).withColumn("blocks", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))

    def run(index: pa.Table, queries: pa.Table) -> pa.Table:
        return nearest(index, queries, sent.value, k)

    found = index.groupBy("blocks", "part").cogroup(asked.groupBy("blocks", "part")).applyInArrow(run, result)
    order = Window.partitionBy("query_row").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
