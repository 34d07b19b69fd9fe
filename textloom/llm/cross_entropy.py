"""LM scoring by cross-entropy difference: a target and a background n-gram model over one vocabulary.

Texts are byte-level BPE ids; a document's ids follow one start symbol. Both are bigram models with a Dirichlet prior
from their unigrams, with the same prior and the same vocabulary (all ids of the rank file, so no word is unknown): the
target's of the documents marked as such, the background's of all others. They are matched in size: background counts,
of unigrams and of bigrams, are scaled to as many tokens as the target has, so that the priors weigh alike. A
document's score is its mean loss under the target model less that under the background model, so the lower, the more
it is like the target.

Bigrams are counted in portions of documents, then over all. For scoring, each portion asks once for each of its
bigrams and is answered with the losses, and the ids of its documents meet these in memory: what is exchanged are the
ids and, for each portion, its different bigrams, never one row for each document that has a bigram. No exchange
depends on whether a table is small enough to be broadcast, so figures of small tables carry on to large ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.llm.bpe import _MADE, Encoder, _once, _rank_bytes, parse_ranks
from textloom.llm.common import forget, slices, stored

#: Tokens that the prior of a bigram's context counts for; counts added to each unigram.
PRIOR, ADDED = 4.0, 0.5
#: Ids of a portion of documents.
PORTION = 2_000_000


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches with a column portion: a number for each PORTION of a task's ids, in their order."""
    first, before = TaskContext.get().partitionId() << 32, 0
    for batch in batches:
        n = batch.column("n_tokens").to_numpy(zero_copy_only=False)
        ends = before + np.cumsum(n)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(first + (ends - n) // PORTION)], names=[*batch.schema.names, "portion"])
        before = int(ends[-1]) if len(ends) else before


def _dtype(size: int) -> str:
    return "<u4" if size >= 1 << 16 else "<u2"


def _bigrams(size: int, ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(document, code) of each bigram of documents, some of which may have no ids; `size` is the start symbol."""
    sizes = np.array([len(x) for x in ids], np.int64)
    flat = np.concatenate([np.zeros(0, np.int64), *ids]).astype(np.int64)
    before = np.empty_like(flat)
    before[1:] = flat[:-1]
    before[(np.cumsum(sizes) - sizes)[sizes > 0]] = size
    return np.repeat(np.arange(len(ids)), sizes), before * size + flat


def _portions(size: int, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(portion of each document, targets, document of each bigram, bigram codes) of each portion; the column row has
    its number.

    The ids are all written by now, so the worker's encoder goes first.
    """
    forget(_MADE)
    rows, targets, ids = [], [], []
    for batch in batches:
        for row, target, data in zip(batch.column("row").to_pylist(), batch.column("target").to_pylist(), batch.column("ids"), strict=True):
            if rows and row != rows[0]:
                yield np.array(rows), np.array(targets), *_bigrams(size, ids)
                rows, targets, ids = [], [], []
            rows.append(row)
            targets.append(target)
            ids.append(np.frombuffer(data.as_buffer(), _dtype(size)))
    if rows:
        yield np.array(rows), np.array(targets), *_bigrams(size, ids)


class Losses:
    """Token and document losses of all documents.

    docs: doc_id, text, and target (boolean; null counts as false), or the targets in a table of their own with one
    row for each doc_id, which then meets the ids instead of the texts. Null texts are empty. Rows are told apart by
    their place in the table of ids that is written once to the shared folder. With no target documents (or no
    others) that model is the even one over the vocabulary.
    """

    def __init__(self, docs: DataFrame, ranks_path: str, pattern: str, targets: DataFrame | None = None):
        data = _rank_bytes(docs, ranks_path)
        self.size = size = max(parse_ranks(data.value).values()) + 1
        dtype, own = np.dtype(_dtype(size)), targets is None

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            encoder = _once(Encoder, data.value, pattern)
            for batch in batches:
                for k, count in slices(batch.column("text")):
                    part = batch.slice(k, count)
                    ids, places = encoder.encode_texts(part.column("text"))
                    packed = pa.Array.from_buffers(pa.binary(), count, [None, pa.py_buffer((places * dtype.itemsize).astype(np.int32)), pa.py_buffer(ids.astype(dtype))])
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("target"), pa.array(np.diff(places)), packed], names=["doc_id", "target", "n_tokens", "ids"])

        encoded = T.StructType([docs.select("doc_id").schema[0], T.StructField("target", T.BooleanType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])
        numbered = T.StructType([*encoded, T.StructField("portion", T.LongType())])
        rows = docs.select("doc_id", "text", F.coalesce("target", F.lit(False)).alias("target") if own else F.lit(None).cast("boolean").alias("target"))
        if own:
            self.tokens = stored(rows.mapInArrow(lambda batches: _numbered(run(batches)), numbered))
        else:
            met = rows.mapInArrow(run, encoded).drop("target").join(targets.select("doc_id", "target").hint("merge"), "doc_id", "left")
            self.tokens = stored(met.select("doc_id", F.coalesce("target", F.lit(False)).alias("target"), "n_tokens", "ids").mapInArrow(_numbered, numbered))

    def counts(self) -> DataFrame:
        """portion, gram (previous id * vocabulary + id), t, b: how often target and other documents of it have it.

        A portion that was read in parts has more than one row for a bigram.
        """
        size = self.size

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rows, targets, doc, codes in _portions(size, batches):
                grams, at = np.unique(codes, return_inverse=True)
                t = np.bincount(at, weights=targets[doc], minlength=len(grams)).astype(np.int64)
                b = np.bincount(at, minlength=len(grams)) - t
                for k in range(0, len(grams), 100_000):
                    part = slice(k, k + 100_000)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(grams[part]), rows[0])), pa.array(grams[part]), pa.array(t[part]), pa.array(b[part].astype(np.int64))], names=["portion", "gram", "t", "b"])

        return self.tokens.select(F.col("portion").alias("row"), "target", "ids").mapInArrow(run, "portion long, gram long, t long, b long")

    def weights(self, counts: DataFrame) -> DataFrame:
        """gram, target_loss, background_loss in bits, of the bigrams counted."""
        counts = stored(counts.groupBy("gram").agg(F.sum("t").alias("t"), F.sum("b").alias("b")))
        total_t, total_b = (int(x or 0) for x in counts.agg(F.sum("t"), F.sum("b")).first())
        scale = total_t / total_b if total_t and total_b else 1.0
        v = self.size
        # both bounded by the vocabulary: at most one row for each id
        words = counts.groupBy((F.col("gram") % v).alias("word")).agg(F.sum("t").alias("wt"), F.sum("b").alias("wb"))
        contexts = counts.groupBy(F.expr(f"gram div {v}").alias("context")).agg(F.sum("t").alias("ct"), F.sum("b").alias("cb"))
        joined = counts.withColumn("word", F.col("gram") % v).withColumn("context", F.expr(f"gram div {v}")).join(F.broadcast(words), "word").join(F.broadcast(contexts), "context")

        def loss(n: str, word: str, context: str, total: float, by: float):
            unigram = (F.col(word) * by + ADDED) / F.lit(total * by + ADDED * v)
            return -F.log2((F.col(n) * by + PRIOR * unigram) / (F.col(context) * by + PRIOR))

        return joined.select("gram", loss("t", "wt", "ct", total_t, 1.0).alias("target_loss"), loss("b", "wb", "cb", total_b, scale).alias("background_loss"))

    def scores(self) -> DataFrame:
        """doc_id, n_tokens, target_loss and background_loss (mean bits a token), score (their difference).

        A document without tokens has losses and score 0.
        """
        size = self.size
        asked = stored(self.counts())
        weights = stored(self.weights(asked))
        answers = asked.select("portion", "gram").join(weights.hint("merge"), "gram")
        result = T.StructType([*self.tokens.select("doc_id", "target", "n_tokens").schema, T.StructField("target_loss", T.DoubleType()), T.StructField("background_loss", T.DoubleType())])

        def run(tokens: pa.Table, answers: pa.Table) -> pa.Table:
            doc, codes = _bigrams(size, [np.frombuffer(x.as_buffer(), _dtype(size)) for x in tokens.column("ids")])
            grams, first = np.unique(answers.column("gram").to_numpy(), return_index=True)
            at = first[np.searchsorted(grams, codes)]
            n = np.maximum(tokens.column("n_tokens").to_numpy(), 1)
            means = (np.bincount(doc, weights=answers.column(c).to_numpy()[at], minlength=len(n)) / n for c in ("target_loss", "background_loss"))
            return pa.table([*(tokens.column(c) for c in ("doc_id", "target", "n_tokens")), *map(pa.array, means)], names=result.names)

        out = self.tokens.groupBy("portion").cogroup(answers.groupBy("portion")).applyInArrow(run, result)
        return out.withColumn("score", F.col("target_loss") - F.col("background_loss"))
