"""Near-duplicates by min-max hashing.

Under each hash function both the smallest and the largest value of a set are kept, so 2k signature values cost k
evaluations for each shingle. Values are hashed in bands; sets that agree in a band are candidates. In each bucket the
candidates are first compared with one member, the first by a hash. What that leaves in different components is
compared in pairs where a bucket has few members, and in blocks of bounded size inside a task where it has many; a task
hands on only links that join components, never pairs. Links are confirmed on the full sets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import Scratch, all_shingles, distinct_counts, hot_join, long_lists, mix64, odd_constants, ragged_longs, sequence_keys, shingle_hashes, slices, stored, word_hashes
from textloom.llm.components import connected_components

#: Sets of candidates up to this many may be broadcast as ids (8 bytes each).
BROADCAST_IDS = 1_000_000
#: Items of one side of a comparison in memory.
BLOCK = 512
#: Shingles of one side at most, but for a set that is larger by itself.
BLOCK_SHINGLES = 500_000
SKETCH_VALUES = 128
#: Items that are compared with all others of a group at once.
ROWS = 128
#: Members of a bucket up to which it is compared in pairs.
FEW = 32
#: Bytes of text that are hashed together.
PORTION = 1 << 18


@dataclass(frozen=True)
class Plan:
    """numerator / denominator: the least similarity of a link. bands of rows values each, from `functions` hash
    functions; a set's sketch has two bits of each of 128 values (fewer functions: of as many as there are)."""

    numerator: int = 85
    denominator: int = 100
    width: int = 5
    functions: int = 64
    bands: int = 25
    rows: int = 5

    @property
    def sketched(self) -> int:
        return min(SKETCH_VALUES, 2 * self.functions)

    @property
    def least_agreement(self) -> int:
        """Sketch bits that agree in all but about one in a million pairs at the least similarity (5 deviations)."""
        s, v = self.numerator / self.denominator, self.sketched
        return int(v * (1 + s) - 5 * np.sqrt(v * s * (1 - s) + v * (1 - s) / 2))


class MinMax:
    """Signatures of one plan."""

    def __init__(self, plan: Plan):
        self.plan = plan
        self.a, self.b = odd_constants(plan.functions, 11), odd_constants(plan.functions, 12)
        self.mixers = odd_constants(plan.bands * plan.rows, 13).reshape(plan.bands, plan.rows)
        self.seeds = odd_constants(plan.bands, 14)

    def values(self, shingles: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """A row for each set: the minima, then the maxima. A set's shingles begin at its start; none is empty."""
        k = self.plan.functions
        out = np.empty((len(starts), 2 * k), np.uint64)
        for j in range(k if len(starts) else 0):
            y = shingles * self.a[j] + self.b[j]
            out[:, j], out[:, k + j] = np.minimum.reduceat(y, starts), np.maximum.reduceat(y, starts)
        return out

    def bands(self, values: np.ndarray) -> np.ndarray:
        used = values[:, : self.plan.bands * self.plan.rows].reshape(-1, self.plan.bands, self.plan.rows)
        return mix64((mix64(used) * self.mixers).sum(2, dtype=np.uint64) + self.seeds).view(np.int64)

    def sketch(self, values: np.ndarray) -> np.ndarray:
        """Two bits of each value, in longs."""
        bits = (mix64(values[:, : self.plan.sketched]) & np.uint64(3)).astype(np.uint8)
        packed = np.packbits(np.concatenate([bits & 1, bits >> 1], axis=1), axis=1)
        return np.ascontiguousarray(np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8)))).view(np.int64)


_LONGS = pa.list_(pa.int64())
ITEM = "n long, bands array<long>, sketch array<long>"


def similar(items: DataFrame, sets: Callable[[DataFrame], DataFrame], plan: Plan) -> DataFrame:
    """Links a, b (a < b) between items that keep all components of `at least as similar as the plan says`.

    items: item (long, unique), n (size of its set, over 0), bands, sketch. sets(ids) gives item and shingles
    (array<long>, distinct) of the items in the table ids (column item). Links inside a component that others make
    are not all returned; none between components is missing, but for what banding and sketches miss.
    """
    with Scratch(items.sparkSession) as scratch:
        entries = items.select("item", F.explode("bands").alias("bucket"))
        # most buckets have one member: only their hashes are exchanged to tell
        again = stored(entries.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1"))
        met = stored(entries.join(again, "bucket").select("bucket", F.col("item").alias("x"), "members"))
        scratch.drop(again)
        first = F.min(F.struct(F.xxhash64("x"), "x"))["x"]
        shared = stored(met.join(met.groupBy("bucket").agg(first.alias("y")), "bucket").select("bucket", "x", "y", "members"))
        scratch.drop(met)
        facts = stored(items.join(shared.select(F.col("x").alias("item")).distinct(), "item", "left_semi"))
        pairs = shared.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        known = _Sets(sets)
        links = stored(known.confirmed(stored(_likely(pairs, facts, plan)), plan))
        component = stored(connected_components(links)).withColumnRenamed("node", "item")
        # in a bucket of two, both were compared
        placed = shared.where("members > 2").select("bucket", F.col("x").alias("item"), F.col("y").alias("first"), "members").join(component, "item", "left").withColumn("component", F.coalesce("component", "item"))
        mixed = placed.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.min("item").alias("y")).where("low <> high").select("bucket", "y")
        open_ = stored(placed.join(mixed, "bucket").select("bucket", "item", "component", "y", "first", "members"))
        few = stored(_likely(_across(open_.where(F.col("members") <= FEW)), facts, plan))
        many = stored(open_.where(F.col("members") > FEW).drop("first", "members"))
        return scratch.keep(stored(links.unionByName(known.confirmed(few, plan)).unionByName(_crossing(many, facts, known, plan))))


def _across(open_: DataFrame) -> DataFrame:
    """Pairs a, b of one bucket and different components, without those that had its first member."""
    rest = open_.where("item <> first")
    x = rest.select("bucket", F.col("item").alias("a"), F.col("component").alias("ca"))
    y = rest.select("bucket", F.col("item").alias("b"), F.col("component").alias("cb"))
    return x.join(y, "bucket").where("a < b and ca <> cb").select("a", "b").distinct()


def blocks_of(members: Column, size: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(members / BLOCK), F.ceil(size / BLOCK_SHINGLES)).cast("int")


def _clusters(items: DataFrame) -> DataFrame:
    """Of each cluster: its largest component, members, and into how many blocks that and the others go."""
    parts = items.groupBy("cluster", "component").agg(F.count("*").alias("members"), F.sum("n").alias("size"))
    clusters = parts.groupBy("cluster").agg(F.max_by("component", F.struct("size", "component")).alias("largest"), F.sum("members").alias("all_members"), F.sum("size").alias("all_size"), F.max(F.struct("size", "component", "members")).alias("top"))
    main_blocks = blocks_of(F.col("top.members"), F.col("top.size"))
    other_blocks = blocks_of(F.col("all_members") - F.col("top.members"), F.col("all_size") - F.col("top.size"))
    return clusters.select("cluster", "largest", "all_members", main_blocks.alias("main_blocks"), other_blocks.alias("other_blocks"))


def _dealt(open_: DataFrame, facts: DataFrame, plan: Plan) -> DataFrame:
    """Items with their clusters and blocks. Items that share buckets, directly or not, are a cluster; but buckets that
    chance ties to one another would make one of all items, each sent to every block. So where a cluster sends items to
    more blocks than an item has bands, each of its buckets is a cluster of its own."""
    ties = connected_components(open_.select(F.col("item").alias("a"), F.col("y").alias("b")).distinct()).select(F.col("node").alias("item"), F.col("component").alias("cluster"))
    items = stored(open_.select("bucket", "item", "component").join(ties, "item").join(facts.select("item", "n"), "item"))
    whole = items.drop("bucket").distinct()
    clusters = stored(_clusters(whole))
    wide = stored(clusters.where(F.col("other_blocks") > plan.bands).select("cluster"))
    if wide.limit(1).count():
        apart = items.join(wide, "cluster").select("item", F.col("bucket").alias("cluster"), "component", "n")
        items = stored(whole.join(wide, "cluster", "left_anti").select(*apart.columns).unionByName(apart))
        clusters = stored(_clusters(items))
    else:
        items = stored(whole)
    items = hot_join(items, clusters, ["cluster"], "all_members").withColumn("main", F.col("component") == F.col("largest"))
    items = items.withColumn("block", F.pmod(F.xxhash64("item"), F.when(F.col("main"), F.col("main_blocks")).otherwise(F.col("other_blocks"))).cast("int"))
    return stored(items.select("cluster", "item", "component", "main", "block", "main_blocks", "other_blocks"))


def _crossing(open_: DataFrame, facts: DataFrame, known: _Sets, plan: Plan) -> DataFrame:
    """Links between components. The members of a cluster's largest component need no comparison with each other, so
    only the others are compared, with all: they and the largest component are dealt over blocks of bounded size, and
    each pair of blocks is one group, compared in memory."""
    items = _dealt(open_, facts, plan)
    full = known.full(items.select("item").distinct())
    rows = items.join(facts, "item").join(full, "item")
    with_main = F.transform(F.sequence(F.lit(0), F.when(F.col("main"), F.col("other_blocks")).otherwise(F.col("main_blocks")) - 1), lambda k: F.struct(F.when(F.col("main"), k).otherwise(F.col("block")).alias("p"), (-1 - F.when(F.col("main"), F.col("block")).otherwise(k)).alias("q")))
    with_others = F.transform(F.sequence(F.lit(0), F.col("other_blocks") - 1), lambda k: F.struct(F.least(F.col("block"), k).alias("p"), F.greatest(F.col("block"), k).alias("q")))
    rows = rows.withColumn("group", F.explode(F.when(F.col("main"), with_main).otherwise(F.concat(with_main, with_others))))
    side = F.when(F.col("group.q") < 0, F.col("main").cast("int")).otherwise(F.col("block"))
    rows = rows.select("cluster", "group.*", side.alias("block"), "item", "component", "n", "bands", "sketch", "shingles")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(joining_links(group, plan), columns=["a", "b"]).astype("int64")

    return rows.groupBy("cluster", "p", "q").applyInPandas(run, "a long, b long")


def joining_links(group: pd.DataFrame, plan: Plan) -> list[tuple[int, int]]:
    """Links among the rows of a group that join their components; of two blocks, only those across are looked for."""
    item, component, block, n = (group[c].to_numpy() for c in ("item", "component", "block", "n"))
    bands, sketch = np.stack(group["bands"].to_numpy()), np.stack(group["sketch"].to_numpy()).view(np.uint64)
    known, numbers = np.unique(np.concatenate(group["shingles"].to_numpy()), return_inverse=True)
    ids, marks = np.split(numbers, np.cumsum(n)[:-1]), np.zeros(len(known), bool)
    parent = {c: c for c in set(component.tolist())}

    def root(c: int) -> int:
        while parent[c] != c:
            parent[c] = c = parent[parent[c]]
        return c

    two = len(set(block.tolist())) > 1
    out = []
    most_apart = 2 * plan.sketched - plan.least_agreement
    for begin in range(0, len(item), ROWS):
        mine = slice(begin, begin + ROWS)
        fits = component[mine, None] != component
        fits &= np.minimum(n[mine, None], n) * plan.denominator >= np.maximum(n[mine, None], n) * plan.numerator
        fits &= np.arange(len(item)) > np.arange(len(item))[mine, None]
        if two:
            fits &= block[mine, None] != block
        apart = np.zeros(fits.shape, np.int16)
        for k in range(sketch.shape[1]):
            apart += np.bitwise_count(sketch[mine, k, None] ^ sketch[:, k])
        fits &= apart <= most_apart
        some, others = np.nonzero(fits)
        some += begin
        meet = np.zeros(len(some), bool)
        for k in range(bands.shape[1]):
            meet |= bands[some, k] == bands[others, k]
        some, others = some[meet], others[meet]
        for k in np.unique(some).tolist():
            mine = root(component[k])
            near = [j for j in others[some == k].tolist() if root(component[j]) != mine]
            if not near:
                continue
            marks[ids[k]] = True
            ends = np.cumsum([len(ids[j]) for j in near])
            both = np.add.reduceat(marks[np.concatenate([ids[j] for j in near])].astype(np.int64), np.append(0, ends[:-1]))
            marks[ids[k]] = False
            for j in np.array(near)[both * plan.denominator >= (n[k] + n[near] - both) * plan.numerator].tolist():
                x, y = root(component[k]), root(component[j])
                if x != y:
                    parent[x] = y
                    out.append((min(item[k], item[j]), max(item[k], item[j])))
    return out


def _alike(x: str, y: str, plan: Plan):
    """Set sizes and sketches that a link allows."""
    nx, ny = F.col(f"{x}.n"), F.col(f"{y}.n")
    longs = -(-2 * plan.sketched // 64)
    apart = sum((F.bit_count(F.col(f"{x}.sketch")[k].bitwiseXOR(F.col(f"{y}.sketch")[k])) for k in range(longs)), F.lit(0))
    return (F.least(nx, ny) * plan.denominator >= F.greatest(nx, ny) * plan.numerator) & (apart <= 2 * plan.sketched - plan.least_agreement)


def _likely(pairs: DataFrame, facts: DataFrame, plan: Plan) -> DataFrame:
    x = facts.select(F.col("item").alias("a"), F.struct("n", "sketch").alias("x"))
    y = facts.select(F.col("item").alias("b"), F.struct("n", "sketch").alias("y"))
    return pairs.join(x, "a").join(y, "b").where(_alike("x", "y", plan)).select("a", "b")


class _Sets:
    """Full sets, made only for items in candidate pairs."""

    def __init__(self, sets: Callable[[DataFrame], DataFrame]):
        self.sets = sets

    def full(self, ids: DataFrame) -> DataFrame:
        """item and shingles, written once."""
        ids = stored(ids)
        return stored(self.sets(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids))

    def confirmed(self, pairs: DataFrame, plan: Plan) -> DataFrame:
        """The pairs of a written table whose full sets are similar enough."""
        full = self.full(pairs.select(F.explode(F.array("a", "b")).alias("item")).distinct())
        x, y = full.select(F.col("item").alias("a"), F.col("shingles").alias("x")), full.select(F.col("item").alias("b"), F.col("shingles").alias("y"))
        both = F.size(F.array_intersect("x", "y"))
        either = F.size("x") + F.size("y") - both
        return pairs.join(x, "a").join(y, "b").where(both * plan.denominator >= either * plan.numerator).select("a", "b")


class NearDuplicates:
    """Components of documents whose sets of word shingles are similar; see the plan.

    A-Z are lower-cased; words are runs of anything but ASCII white space. A document with fewer words than a shingle
    has its whole sequence as one; without words (or null) it is linked with nothing. Documents of equal words are one
    class, whose first id stands for it. Rows without doc_id are never linked and have no component. Repeated ids
    with equal words share a class; with others they are documents of their own. Other columns are not read.
    """

    def __init__(self, docs: DataFrame, plan: Plan | None = None, doc_id: str = "doc_id", text: str = "text"):
        self.plan = plan or Plan()
        self.docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def _facts(self) -> DataFrame:
        """Set size, key, bands and sketch of every document."""
        plan, minmax = self.plan, MinMax(self.plan)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k, count in slices(batch.column("text"), PORTION):
                    hashes, places, _, _ = word_hashes(batch.column("text").slice(k, count))
                    some = np.diff(places) > 0
                    begins, sizes = places[:-1][some], np.diff(places)[some]
                    shingles, starts = all_shingles(hashes, begins, sizes, plan.width)
                    values = minmax.values(shingles, starts[:-1])
                    n, k1, k2 = np.zeros(count, np.int64), np.zeros(count, np.int64), np.zeros(count, np.int64)
                    n[some] = distinct_counts(shingles, starts)
                    k1[some], k2[some] = sequence_keys(hashes, begins, sizes)
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(k, count), pa.array(n), pa.array(k1, mask=~some), pa.array(k2, mask=~some), long_lists(minmax.bands(values), some), long_lists(minmax.sketch(values), some)], names=["doc_id", "n", "k1", "k2", "bands", "sketch"])

        return stored(self.docs.mapInArrow(run, "doc_id long, n long, k1 long, k2 long, bands array<long>, sketch array<long>"))

    def _classes(self, facts: DataFrame) -> DataFrame:
        """One item for each different sequence of words, with its first id."""
        known = facts.where("n > 0 and doc_id is not null")
        classes = known.groupBy("k1", "k2").agg(F.min("doc_id").alias("first_id"), F.min("n").alias("n"), F.min("bands").alias("bands"), F.min("sketch").alias("sketch"))
        return stored(classes.withColumn("item", F.monotonically_increasing_id()))

    def _sets(self, classes: DataFrame, ids: DataFrame) -> DataFrame:
        wanted = classes.join(ids, "item", "left_semi").select("item", "k1", "k2", F.col("first_id").alias("doc_id"))
        plan = self.plan

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k, count in slices(batch.column("text"), PORTION):
                    part = batch.slice(k, count)
                    hashes, places, _, _ = word_hashes(part.column("text"))
                    rows = np.flatnonzero(np.diff(places) > 0)
                    k1, k2 = sequence_keys(hashes, places[:-1][rows], np.diff(places)[rows])
                    rows = rows[(k1 == part.column("k1").to_numpy()[rows]) & (k2 == part.column("k2").to_numpy()[rows])]
                    sets = [np.unique(shingle_hashes(hashes[places[r] : places[r + 1]], plan.width)) for r in rows.tolist()]
                    yield pa.RecordBatch.from_arrays([part.column("item").take(pa.array(rows)), ragged_longs(np.concatenate([np.zeros(0, np.uint64), *sets]), np.append(0, np.cumsum([len(x) for x in sets])))], names=["item", "shingles"])

        wanted = stored(wanted)
        if wanted.count() <= BROADCAST_IDS // 4:
            wanted = F.broadcast(wanted)
        rows = self.docs.where("doc_id is not null and text is not null").join(wanted, "doc_id").select("item", "k1", "k2", "text")
        return rows.mapInArrow(run, "item long, shingles array<long>").dropDuplicates(["item"])

    def verdicts(self) -> DataFrame:
        """doc_id, n_shingles, component_id (the smallest doc_id reachable), kept (the smallest itself; rows without id)."""
        with Scratch(self.docs.sparkSession) as scratch:
            facts = self._facts()
            classes = self._classes(facts)
            links = similar(classes.select("item", "n", "bands", "sketch"), lambda ids: self._sets(classes, ids), self.plan)
            component = connected_components(links).withColumnRenamed("node", "item")
            named = classes.select("k1", "k2", "item", "first_id").join(component, "item", "left").withColumn("component", F.coalesce("component", "item"))
            first = named.groupBy("component").agg(F.min("first_id").alias("label"))
            labels = named.join(first, "component").select("k1", "k2", "label")
            out = facts.select("doc_id", "n", "k1", "k2").join(labels, ["k1", "k2"], "left")
            label = F.when(F.col("doc_id").isNotNull(), F.coalesce("label", "doc_id"))
            return scratch.keep(stored(out.select("doc_id", F.col("n").alias("n_shingles"), label.alias("component_id"), F.coalesce(F.col("doc_id") == label, F.lit(True)).alias("kept"))))
