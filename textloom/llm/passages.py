"""Substring dedup by paragraph MinHash banding.

Paragraphs don't depend on how a text is wrapped: a line of enough words is one, neighbouring shorter lines make one
together, and what is longer than a page is cut where its own words say. They are banded by min-max signatures tuned
for high recall; colliding ones are verified by exact Jaccard similarity and joined into components. Of each component
the document of the smallest id keeps its words.

A passage may also stand in the midst of different paragraphs. So of each window of 32 runs of 16 words the least by
hash is an anchor: texts with 47 equal words in a row have an anchor in common. A document's words around an anchor
are laid beside those of the first document that has it, and all words that are equal there are repeated. In each
document but the first, repeated stretches of enough words are removed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.llm.common import KeyFilter, Scratch, all_shingles, distinct_counts, hot_join, long_lists, mix64, odd_constants, ragged_longs, sequence_keys, shingle_hashes, slices, stored, word_hashes
from textloom.llm.components import connected_components
from textloom.llm.minhash import PORTION, MinMax, Plan, similar

#: Bands for a similarity of 0.8: a pair just there is missed three times in 10,000.
PLAN = Plan(numerator=80, denominator=100, width=5, functions=32, bands=8, rows=2)
#: Least words of a paragraph that is compared, and of a stretch that is removed; words beyond which a paragraph is cut.
LEAST, LONGEST = 24, 200
#: A cut of a long paragraph is the smallest of the word hashes up to so many words away on either side.
REACH = 24
#: Words of an anchor, anchors of a window, words looked at on either side of an anchor, words of a chunk of a source.
GRAM, WINDOW, AROUND, CHUNK = 16, 32, 48, 512

#: The columns that tell documents apart.
DOCUMENT = ["doc_id", "text_key"]

_CUTS = odd_constants(3, 21)
_GRAM = odd_constants(GRAM, 22)
_NEVER = np.uint64(2**64 - 1)


def cut_places(hashes: np.ndarray) -> np.ndarray:
    """Word positions where a part of a long paragraph begins (0 first): strict local minima of a hash of three words."""
    n = len(hashes) - 2
    if n <= 2 * REACH:
        return np.zeros(1, np.int64)
    h = mix64(hashes[:n] * _CUTS[0] + hashes[1 : n + 1] * _CUTS[1] + hashes[2:] * _CUTS[2])
    least = np.ones(n, bool)
    least[:REACH] = least[n - REACH :] = False
    for k in range(1, REACH + 1):
        least[k:] &= h[k:] < h[:-k]
        least[:-k] &= h[:-k] < h[k:]
    return np.concatenate([np.zeros(1, np.int64), np.flatnonzero(least)])


def paragraphs(hashes: np.ndarray, places: np.ndarray, line_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first word, words) of the paragraphs of many texts; places: where each text's words begin, line_of: the number
    of line ends before each word."""
    n = len(hashes)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    text_start = np.zeros(n, bool)
    text_start[places[:-1][places[:-1] < n]] = True
    start = text_start.copy()
    start[1:] |= line_of[1:] != line_of[:-1]
    lines = np.flatnonzero(start)
    sizes = np.diff(np.append(lines, n))
    short = sizes < LEAST
    joins = np.zeros(len(lines), bool)  # a short line goes on with the one before, unless a blank line is between
    joins[1:] = short[1:] & short[:-1] & ~text_start[lines[1:]] & (line_of[lines[1:]] - line_of[lines[1:] - 1] == 1)
    begins = lines[~joins]
    sizes = np.diff(np.append(begins, n))
    out = [(begins[sizes <= LONGEST], sizes[sizes <= LONGEST])]
    for k in np.flatnonzero(sizes > LONGEST).tolist():
        cuts = cut_places(hashes[begins[k] : begins[k] + sizes[k]])
        out.append((begins[k] + cuts, np.diff(np.append(cuts, sizes[k]))))
    begins, sizes = (np.concatenate(x) for x in zip(*out, strict=True))
    order = np.argsort(begins)
    begins, sizes = begins[order], sizes[order]
    return begins[sizes >= LEAST], sizes[sizes >= LEAST]


def anchors(hashes: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of the anchors of many texts: each run of words that is the least of a window of its text.

    Windows reach beyond a text's ends, so a text of one run has an anchor. Of equal least ones all are anchors.
    """
    n, sizes = len(hashes), np.diff(places)
    if n < GRAM:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    grams = np.zeros(n - GRAM + 1, np.uint64)
    for k in range(GRAM):
        grams += hashes[k : n - GRAM + 1 + k] * _GRAM[k]
    grams = mix64(grams)
    grams[grams == _NEVER] = np.uint64(0)
    counts = np.maximum(sizes - GRAM + 1, 0)
    row = np.repeat(np.arange(len(sizes)), counts)
    nth = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
    first = places[row] + nth
    # texts side by side with room between them that no window bridges
    at = nth + np.repeat(np.cumsum(counts) - counts + WINDOW * (np.arange(len(sizes)) + 1), counts)
    padded = np.full(int(counts.sum()) + WINDOW * (len(sizes) + 1), _NEVER)
    padded[at] = grams[first]
    least = padded.copy()  # least[i]: of padded[i : i + WINDOW]
    step = 1
    while step < WINDOW:
        least[:-step] = np.minimum(least[:-step], least[step:])
        step *= 2
    most = least.copy()  # most[i]: the largest of the windows that hold i
    step = 1
    while step < WINDOW:
        most[step:] = np.maximum(most[step:], most[:-step])
        step *= 2
    chosen = most[at] == grams[first]
    return first[chosen], grams[first[chosen]]


class RepeatedPassages:
    """Stretches of words that repeat across documents.

    A-Z are lower-cased. Null and empty texts have no words. Rows without doc_id take no part. A document is a doc_id
    with its text: rows equal in both are one document, rows of one id with other texts are others, told apart by a
    hash of the text (the column text_key). Repetition inside one document is left alone. Other columns are not read.
    """

    def __init__(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text"):
        self.docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_key(text).alias("text_key"), F.col(text).alias("text")).where("doc_id is not null and text is not null")

    def _units(self) -> DataFrame:
        """Paragraphs with their keys and signatures, and anchors, which have n_words 0."""
        minmax = MinMax(PLAN)
        names = ["doc_id", "text_key", "first_word", "n_words", "k1", "k2", "n", "bands", "sketch"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k, count in slices(batch.column("text"), PORTION):
                    part = batch.slice(k, count)
                    hashes, places, begins, data = word_hashes(part.column("text"))
                    ends = np.flatnonzero(data == 10)
                    first, sizes = paragraphs(hashes, places, np.searchsorted(ends, begins))
                    shingles, starts = all_shingles(hashes, first, sizes, PLAN.width)
                    values = minmax.values(shingles, starts[:-1])
                    at, grams = anchors(hashes, places)
                    k1, k2 = sequence_keys(hashes, first, sizes)
                    place = np.append(first, at)
                    row = np.searchsorted(places, place, "right") - 1
                    none = np.zeros(len(at), np.int64)
                    here = np.arange(len(place)) < len(first)
                    yield pa.RecordBatch.from_arrays(
                        [
                            part.column("doc_id").take(pa.array(row)), part.column("text_key").take(pa.array(row)), pa.array((place - places[row]).astype(np.int32)), pa.array(np.append(sizes, none).astype(np.int32)), pa.array(np.append(k1, grams.view(np.int64))),
                            pa.array(np.append(k2, none)), pa.array(np.append(distinct_counts(shingles, starts), none)), long_lists(minmax.bands(values), here), long_lists(minmax.sketch(values), here),
                        ], names=names)

        return stored(self.docs.mapInArrow(run, "doc_id long, text_key long, first_word int, n_words int, k1 long, k2 long, n long, bands array<long>, sketch array<long>"))

    def _sets(self, items: DataFrame, ids: DataFrame) -> DataFrame:
        """Full sets of some items, made from the texts."""
        wanted = stored(items.join(ids, "item", "left_semi").groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("item", "first_word", "n_words")).alias("spans")))  # one of each paragraph

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k, count in slices(batch.column("text"), PORTION):
                    part = batch.slice(k, count)
                    hashes, places, _, _ = word_hashes(part.column("text"))
                    out, sets = [], []
                    for place, own in zip(places.tolist(), part.column("spans").to_pylist(), strict=False):
                        for s in own:
                            begin = place + s["first_word"]
                            out.append(s["item"])
                            sets.append(np.unique(shingle_hashes(hashes[begin : begin + s["n_words"]], PLAN.width)))
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64()), ragged_longs(np.concatenate([np.zeros(0, np.uint64), *sets]), np.append(0, np.cumsum([len(x) for x in sets])))], names=["item", "shingles"])

        rows = KeyFilter(wanted, DOCUMENT).some(self.docs).join(wanted, DOCUMENT).select("text", "spans")
        return rows.mapInArrow(run, "item long, shingles array<long>").dropDuplicates(["item"])

    def _similar_paragraphs(self, units: DataFrame) -> DataFrame:
        """doc_id, text_key, first_word, n_words, source_id of paragraphs whose component has an earlier document."""
        lines = units.where("n_words > 0")
        document = F.struct("doc_id", "text_key")
        with Scratch(self.docs.sparkSession) as scratch:
            found = lines.groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "text_key", "first_word", "n_words", "n", "bands", "sketch")).alias("at"), F.min(document).alias("source"), F.max(document).alias("last"), F.count("*").alias("rows"))
            found = stored(found.withColumn("item", F.monotonically_increasing_id()).select("item", "k1", "k2", "at.*", "source", "last", "rows"))
            links = similar(found.select("item", "n", "bands", "sketch"), lambda ids: self._sets(found, ids), PLAN)
            component = connected_components(links).withColumnRenamed("node", "item")
            grouped = found.select("item", "k1", "k2", "source", "last", "rows").join(component, "item", "left").withColumn("component", F.coalesce("component", "item"))
            sources = grouped.groupBy("component").agg(F.min("source").alias("first"), F.max("last").alias("end")).where("first < end")
            keys = stored(grouped.join(sources, "component").select("k1", "k2", "rows", "first"))
            scratch.drop(found)
            every = hot_join(KeyFilter(keys, ["k1", "k2"]).some(lines.select("k1", "k2", "doc_id", "text_key", "first_word", "n_words")), keys, ["k1", "k2"], "rows")
            return scratch.keep(stored(every.where(document > F.col("first")).select("doc_id", "text_key", "first_word", "n_words", F.col("first.doc_id").alias("source_id"))))

    def _common_anchors(self, units: DataFrame) -> DataFrame:
        """doc_id, text_key, first_word, gram of the anchors that occur more than once; most occur once, and only their
        hashes are exchanged to tell."""
        found = units.where("n_words = 0").select("doc_id", "text_key", "first_word", F.col("k1").alias("gram"))
        with Scratch(self.docs.sparkSession) as scratch:
            again = stored(found.groupBy("gram").agg(F.count("*").alias("rows")).where("rows > 1"))
            return scratch.keep(stored(hot_join(KeyFilter(again, ["gram"]).some(found), again, ["gram"], "rows")))

    def _shared_runs(self, found: DataFrame) -> DataFrame:
        """doc_id, text_key, first_word, n_words, source_id: all words around shared anchors that are equal."""
        with Scratch(self.docs.sparkSession) as scratch:
            return scratch.keep(stored(self._runs(found, scratch)))

    def _runs(self, found: DataFrame, scratch: Scratch) -> DataFrame:
        document = F.struct("doc_id", "text_key")
        grams = found.groupBy("gram").agg(F.min(F.struct("doc_id", "text_key", "first_word")).alias("s"), F.max(document).alias("last"), F.count("*").alias("rows"))
        grams = grams.where(F.struct("s.doc_id", "s.text_key") < F.col("last")).select("gram", F.col("s.doc_id").alias("source_id"), F.col("s.text_key").alias("source_key"), F.col("s.first_word").alias("source_word"), "rows")
        met = hot_join(found, grams := stored(grams), ["gram"], "rows").where((F.col("doc_id") != F.col("source_id")) | (F.col("text_key") != F.col("source_key")))
        # anchors in one chunk of the source, and as far apart there as here, are laid beside it together
        place = ["source_id", "source_key", "chunk"]
        asked = met.groupBy("doc_id", "text_key", *place[:2], F.expr(f"source_word div {CHUNK}").cast("int").alias("chunk"), (F.col("source_word") - F.col("first_word")).alias("ahead")).agg(F.min("first_word").alias("low"), F.max("first_word").alias("high"))
        asked = stored(asked)
        scratch.drop(grams)
        chunks = stored(asked.groupBy(*place).agg(F.count("*").alias("rows")))
        wanted = asked.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct(*place, "ahead", F.greatest(F.lit(0), F.col("low") - AROUND).alias("begin"), (F.col("high") + GRAM + AROUND).alias("end"))).alias("asked"))
        given = chunks.groupBy(F.col("source_id").alias("doc_id"), F.col("source_key").alias("text_key")).agg(F.collect_list("chunk").alias("given"))
        both = stored(wanted.join(given, DOCUMENT, "full"))  # lists as long as the document has anchors at most

        def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k, count in slices(batch.column("text"), PORTION):
                    part = batch.slice(k, count)
                    hashes, places, _, _ = word_hashes(part.column("text"))
                    small = (hashes >> np.uint64(32)).astype("<u4")
                    out: dict[str, list] = {n: [] for n in ("doc_id", "text_key", *place, "ahead", "begin", "words")}
                    rows = zip(part.column("doc_id").to_pylist(), part.column("text_key").to_pylist(), part.column("asked").to_pylist(), part.column("given").to_pylist(), strict=True)
                    for r, (doc, key, asked, given) in enumerate(rows):
                        own = small[places[r] : places[r + 1]]
                        for a in asked or ():
                            out["doc_id"].append(doc)
                            out["text_key"].append(key)
                            for n in (*place, "ahead", "begin"):
                                out[n].append(a[n])
                            out["words"].append(own[a["begin"] : a["end"]].tobytes())
                        for c in given or ():
                            begin = max(0, c * CHUNK - 2 * AROUND)
                            for n, v in zip(out, (None, None, doc, key, c, None, begin, own[begin : (c + 1) * CHUNK + GRAM + 2 * AROUND].tobytes()), strict=True):
                                out[n].append(v)
                    types = {"chunk": pa.int32(), "ahead": pa.int32(), "begin": pa.int32(), "words": pa.binary()}
                    yield pa.RecordBatch.from_arrays([pa.array(v, types.get(n, pa.int64())) for n, v in out.items()], names=list(out))

        scratch.drop(asked)
        read = stored(KeyFilter(both, DOCUMENT).some(self.docs).join(both, DOCUMENT).mapInArrow(words, "doc_id long, text_key long, source_id long, source_key long, chunk int, ahead int, begin int, words binary"))
        scratch.drop(both)
        sources = read.where("doc_id is null").groupBy(*place).agg(F.first("begin").alias("source_begin"), F.first("words").alias("source_words")).join(chunks, place)
        beside = hot_join(read.where("doc_id is not null"), stored(sources), place, "rows")

        def equal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows, first, n = [], [], []
                columns = (batch.column(c).to_pylist() for c in ("ahead", "begin", "words", "source_begin", "source_words"))
                for r, (ahead, begin, mine, source_begin, theirs) in enumerate(zip(*columns, strict=True)):
                    x, y = np.frombuffer(mine, "<u4"), np.frombuffer(theirs, "<u4")
                    for a, b in equal_runs(x, y, begin + ahead - source_begin):
                        rows.append(r)
                        first.append(begin + a)
                        n.append(b - a)
                at = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in ("doc_id", "text_key")), pa.array(first, pa.int32()), pa.array(n, pa.int32()), batch.column("source_id").take(at)], names=["doc_id", "text_key", "first_word", "n_words", "source_id"])

        return beside.mapInArrow(equal, "doc_id long, text_key long, first_word int, n_words int, source_id long")

    def stretches(self) -> DataFrame:
        """doc_id, text_key, first_word, n_words, source_id: the repeated stretches of each document that isn't their source.

        source_id is the smallest id of the documents that have a part of the stretch. Stretches of a document
        don't overlap; words are numbered from 0.
        """
        with Scratch(self.docs.sparkSession) as scratch:
            units = self._units()
            repeated = self._similar_paragraphs(units)
            common = self._common_anchors(units)
            scratch.drop(units)
            runs = self._shared_runs(common)
            scratch.drop(common)
            repeated = repeated.unionByName(runs).distinct()
            by_doc = repeated.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("first_word", "n_words", "source_id")).alias("spans"))  # at most a text's paragraphs and anchors
            return scratch.keep(stored(by_doc.select("doc_id", "text_key", F.explode(_merged(F.col("spans"))).alias("s")).select("doc_id", "text_key", "s.*")))


def text_key(text: str) -> Column:
    return F.xxhash64(F.col(text))


def equal_runs(x: np.ndarray, y: np.ndarray, ahead: int) -> list[tuple[int, int]]:
    """Runs [a, b) of x, of GRAM words or more, with x[a:b] == y[a + ahead : b + ahead]."""
    low, high = max(0, -ahead), min(len(x), len(y) - ahead)
    if high - low < GRAM:
        return []
    same = np.zeros(high - low + 2, bool)
    same[1:-1] = x[low:high] == y[low + ahead : high + ahead]
    turns = np.flatnonzero(same[1:] != same[:-1])
    return [(low + a, low + b) for a, b in zip(turns[::2].tolist(), turns[1::2].tolist(), strict=True) if b - a >= GRAM]


def merged(spans: list[dict]) -> list[dict]:
    """Touching spans become one; those of too few words go."""
    out: list[dict] = []
    for s in sorted(spans, key=lambda s: (s["first_word"], s["n_words"])):
        end = s["first_word"] + s["n_words"]
        if out and s["first_word"] <= out[-1]["first_word"] + out[-1]["n_words"]:
            last = out[-1]
            last["n_words"] = max(last["n_words"], end - last["first_word"])
            last["source_id"] = min(last["source_id"], s["source_id"])
        else:
            out.append(dict(s))
    return [s for s in out if s["n_words"] >= LEAST]


def _merged(spans: Column) -> Column:
    kind = T.ArrayType(T.StructType([T.StructField("first_word", T.IntegerType()), T.StructField("n_words", T.IntegerType()), T.StructField("source_id", T.LongType())]))

    @F.arrow_udf(kind)
    def run(column: pa.Array) -> pa.Array:
        return pa.array([merged(s.as_py()) for s in column], pa.list_(pa.struct([("first_word", pa.int32()), ("n_words", pa.int32()), ("source_id", pa.int64())])))

    return run(spans)


def cut_out(text: str, spans: list[dict]) -> str:
    """The text without these words and the white space after them."""
    import re

    ends = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
    out, at = [], 0
    for s in sorted(spans, key=lambda s: s["first_word"]):
        last = s["first_word"] + s["n_words"]
        out.append(text[at : ends[s["first_word"]][0]])
        at = ends[last][0] if last < len(ends) else len(text)
    return "".join([*out, text[at:]])


def without_stretches(text: Column, spans: Column) -> Column:
    """The text without the stretches (array of first_word, n_words); unchanged where there are none."""

    @F.arrow_udf(T.StringType())
    def run(texts: pa.Array, spans: pa.Array) -> pa.Array:
        return pa.array([t if t is None or not s else cut_out(t, s) for t, s in zip(texts.to_pylist(), spans.to_pylist(), strict=True)], pa.string())

    return run(text, spans)
