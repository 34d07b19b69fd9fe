"""Quality classifier: random Fourier features of document statistics, ridge regression, isotonic calibration.

The statistics are counts over the whole text. cos(Wx + b) with Gaussian W approximates a Gaussian kernel; the normal
equations are summed over partitions and solved on the driver (257 unknowns); scores are made monotone in the share of
good documents by pooling adjacent violators over 2048 score bins, on rows that the regression didn't see.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.llm.common import stored
from textloom.llm.line_rules import repeated_words

#: Random features, ridge penalty a row, score bins of the calibration, tasks that sum the equations.
FEATURES, RIDGE, BINS, TASKS = 256, 1e-4, 2048, 256
FOLDS = 5

_CLASS = np.full(256, 7, np.int64)  # 7: other punctuation and controls
_CLASS[128:] = 0
_CLASS[ord("a") : ord("z") + 1] = 1
_CLASS[ord("A") : ord("Z") + 1] = 2
_CLASS[ord("0") : ord("9") + 1] = 3
_CLASS[list(b"#*$%&|<>")] = 4
_CLASS[list(b"!?")] = 5
_CLASS[list(b" \t\n\r\x0b\x0c")] = 6

NAMES = (
    "log_words", "word_bytes", "high_share", "lower_share", "upper_share", "digit_share", "symbol_share", "shout_share", "space_share", "punctuation_share", "distinct_share", "adjacent_share",
    "repeated_share", "top_share", "entropy", "log_lines", "line_words", "repeated_lines", "bare_lines", "symbol_words", "upper_words", "longest_word",
)


def statistics(text: str | None) -> np.ndarray:
    """float32 values in the order of NAMES; for a null or empty text or one without words, zeros."""
    data = (text or "").encode()
    words = data.split()
    n = len(words)
    if not n:
        return np.zeros(len(NAMES), np.float32)
    size = len(data)
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    kinds = np.bincount(_CLASS, weights=counts, minlength=8) / size
    share = counts[counts > 0] / size
    tally: dict[bytes, int] = {}
    for w in words:
        tally[w] = tally.get(w, 0) + 1
    adjacent = sum(a == b for a, b in zip(words, words[1:], strict=False))
    lines = [x for x in data.split(b"\n") if x.strip()]
    text_ = text or ""
    caps = sum(w.isupper() and len(w) > 1 for w in text_.split())
    symbols = sum(n for w, n in tally.items() if any(c in w for c in _SYMBOLS))
    values = (
        np.log1p(n), (size - kinds[6] * size) / n, kinds[0], kinds[1], kinds[2], kinds[3], kinds[4], kinds[5], kinds[6], kinds[7], len(tally) / n, adjacent / n,
        repeated_words(words) / n, max(tally.values()) / n, -(share * np.log2(share)).sum(), np.log1p(len(lines)), np.log1p(n / len(lines)), 1 - len(set(lines)) / len(lines), sum(x.rstrip()[-1:] not in b".!?" for x in lines) / len(lines), symbols / n, caps / n, np.log1p(max(map(len, tally))),
    )
    return np.array(values, np.float32)


_SYMBOLS = (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">")


def with_statistics(df: DataFrame, text: str = "text", out: str = "stats") -> DataFrame:
    """df with the column `out` (array<float>): statistics() of the whole text."""

    @F.arrow_udf(T.ArrayType(T.FloatType()))
    def run(texts: pa.Array) -> pa.Array:
        rows = [statistics(t.as_py()) for t in texts]
        flat = np.concatenate(rows) if rows else np.zeros(0, np.float32)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * len(NAMES)), pa.array(flat))

    return df.withColumn(out, run(F.col(text)))


@dataclass
class Model:
    """mean, scale: of the statistics. w, b: the random features. beta: ridge weights, the last for the constant.
    edges, values: the calibrated score from each raw score on."""

    mean: np.ndarray
    scale: np.ndarray
    w: np.ndarray
    b: np.ndarray
    beta: np.ndarray
    edges: np.ndarray
    values: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x.astype(np.float64) - self.mean) / self.scale, -4, 4) @ self.w + self.b
        return np.hstack([np.sqrt(2 / len(self.b)) * np.cos(z), np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.beta

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = self.raw(x)
        return self.values[np.clip(np.searchsorted(self.edges, raw, "right") - 1, 0, len(self.values) - 1)]


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(NAMES))


def pooled(bins: np.ndarray, good: np.ndarray, all_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression of good / all over ascending bins by pooling adjacent violators: (first bins, values)."""
    blocks: list[list[float]] = []
    for at, g, n in zip(bins, good, all_, strict=True):
        blocks.append([at, g, n])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            _, g, n = blocks.pop()
            blocks[-1][1] += g
            blocks[-1][2] += n
    return np.array([b[0] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


def fit(rows: DataFrame, seed: int = 7) -> Model:
    """rows: stats, label (0 or 1) and fold (0 to FOLDS - 1); fold 1 calibrates, the others fit. All rows count.

    Without rows every score is 0.5. What reaches the driver are sums of fixed size.
    """
    rng = np.random.default_rng(seed)
    d = len(NAMES)
    w = rng.normal(size=(d, FEATURES)) / np.sqrt(d) * 1.5
    b = rng.uniform(0, 2 * np.pi, FEATURES)
    few = rows.coalesce(TASKS)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((3, d))
        for batch in batches:
            x = _matrix(batch.column("stats")).astype(np.float64)
            total += [np.full(d, len(x)), x.sum(0), (x * x).sum(0)]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d)), *map(pa.array, total)], names=["k", "n", "s", "ss"])

    sums = few.where("fold <> 1").select("stats").mapInArrow(moments, "k long, n double, s double, ss double").groupBy("k").agg(F.sum("n"), F.sum("s"), F.sum("ss")).orderBy("k").collect()
    n = sums[0][1] if sums else 0
    if not n:
        return Model(np.zeros(d), np.ones(d), w, b, np.zeros(FEATURES + 1), np.array([-np.inf]), np.array([0.5]))
    mean = np.array([r[2] for r in sums]) / n
    scale = np.sqrt(np.maximum(np.array([r[3] for r in sums]) / n - mean**2, 0))
    model = Model(mean, np.where(scale > 1e-6, scale, 1), w, b, np.zeros(FEATURES + 1), np.zeros(1), np.zeros(1))
    m = FEATURES + 1
    upper = np.triu_indices(m)

    def equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, c = np.zeros((m, m)), np.zeros(m)
        for batch in batches:
            for k in range(0, batch.num_rows, 2048):
                part = batch.slice(k, 2048)
                z = model.features(_matrix(part.column("stats")))
                a += z.T @ z
                c += z.T @ part.column("label").to_numpy(zero_copy_only=False).astype(np.float64)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(upper[0], np.arange(m))), pa.array(np.append(upper[1], np.full(m, m))), pa.array(np.append(a[upper], c))], names=["i", "j", "v"])

    a = np.zeros((m, m + 1))
    for i, j, v in few.where("fold <> 1").select("stats", "label").mapInArrow(equations, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v")).collect():
        a[i, j] = v
        if j < m:
            a[j, i] = v
    model.beta = np.linalg.solve(a[:, :m] + RIDGE * n * np.eye(m), a[:, m])

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        good, all_ = np.zeros(BINS), np.zeros(BINS)
        for batch in batches:
            at = np.clip(((model.raw(_matrix(batch.column("stats"))) + 0.5) * BINS / 2).astype(int), 0, BINS - 1)
            label = batch.column("label").to_numpy(zero_copy_only=False)
            all_ += np.bincount(at, minlength=BINS)
            good += np.bincount(at, weights=label, minlength=BINS)
        some = np.flatnonzero(all_)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(good[some]), pa.array(all_[some])], names=["bin", "good", "n"])

    bins = few.where("fold = 1").select("stats", "label").mapInArrow(binned, "bin long, good double, n double").groupBy("bin").agg(F.sum("good"), F.sum("n")).orderBy("bin").collect()
    if bins:
        first, model.values = pooled(*np.array([tuple(r) for r in bins], np.float64).T)
        model.edges = first * 2 / BINS - 0.5
    else:
        model.edges = np.linspace(-0.5, 1.5, BINS)
        model.values = np.clip(model.edges, 0, 1)
    return model


def with_score(df: DataFrame, model: Model, stats: str = "stats", out: str = "score") -> DataFrame:
    @F.arrow_udf(T.DoubleType())
    def run(column: pa.Array) -> pa.Array:
        return pa.array(model.score(_matrix(column)) if len(column) else [], pa.float64())

    return df.withColumn(out, run(F.col(stats)))


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, mod FOLDS; fold 0 is held out. A null id is in fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS, F.lit(0).cast("long"))


class QualityScores:
    """Statistics of all documents (written once to the shared folder), a model of the labelled ones, and scores.

    labels: doc_id and quality (0 or 1). Rows of fold 0 are held out; null labels are ignored; of several labels of
    one id the mean, rounded, counts. A null or empty text is scored like any other. keep: further columns of docs,
    handed through as kept_<name>.
    """

    def __init__(self, docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()):
        rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), *[F.col(c).alias(f"kept_{c}") for c in keep])
        self.table = stored(with_statistics(rows).drop("text").withColumn("fold", fold(F.col("doc_id"))))
        known = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.round(F.avg("quality")).cast("int").alias("label"))
        self.model = fit(self.table.where("fold <> 0").join(known, "doc_id").select("stats", "label", "fold"))

    def scores(self) -> DataFrame:
        """doc_id, kept columns, held_out, score, predicted (1 from a score of 0.3 on)."""
        scored = with_score(self.table, self.model)
        return scored.withColumn("held_out", F.col("fold") == 0).withColumn("predicted", (F.col("score") >= 0.3).cast("int")).drop("stats", "fold")
