"""Quality rules: per-document limits, and lines that recur in many documents of a host.

Lines are normalised (A-Z lowered, words joined by one space) and hashed. For each host and line the distinct documents
are counted: those whose whole normalised texts (all words, A-Z lowered) are equal count once, any others apart. Lines
above the limit are removed, and documents of which too little is left are rejected.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.llm.common import hot_join, stored

#: A line is boilerplate of its host from this many distinct documents on, whatever the host's size.
LEAST_DOCS = 20
#: A document is depleted if fewer words are left, or a smaller share of its words.
LEAST_WORDS, LEAST_LEFT = 20, 0.3

#: Fixed values of the base rules.
_SYMBOLS = b"#*$%&|<>"
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(_SYMBOLS)] = True

_STATS = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("word_chars", T.LongType()), T.StructField("n_symbols", T.LongType()),
    T.StructField("n_dup_lines", T.LongType()), T.StructField("n_repeat_words", T.LongType()),
    T.StructField("body", T.LongType()), T.StructField("lines", T.ArrayType(T.StructType([T.StructField("line", T.LongType()), T.StructField("words", T.IntegerType())]))),
])
_LINES = pa.list_(pa.struct([("line", pa.int64()), ("words", pa.int32())]))
_ARROW = pa.struct([("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("body", pa.int64()), ("lines", _LINES)])


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of three that comes twice or more."""
    if len(words) < 4:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    _, pair = np.unique(ids[:-1] * len(numbers) + ids[1:], return_inverse=True)
    _, inverse, counts = np.unique(pair[:-1] * len(numbers) + ids[2:], return_inverse=True, return_counts=True)
    hit = counts[inverse] > 1
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[k : k + len(hit)] |= hit
    return int(covered.sum())


def line_hash(words: list[bytes]) -> int:
    """Signed 64-bit hash of a normalised line; long lines included whole."""
    import xxhash

    return xxhash.xxh3_64_intdigest(b" ".join(words).lower()) - (1 << 63)


def document_stats(text: str | None) -> dict:
    """The counts of the base rules, a hash of the whole normalised text and, for each distinct normalised line: hash,
    words in all its occurrences."""
    text = text or ""
    data = text.encode()
    words = data.split()
    seen, dup = set(), 0
    lines: dict[int, int] = {}
    for raw in data.split(b"\n"):
        own = raw.split()
        if not own:
            continue
        dup += raw in seen
        seen.add(raw)
        h = line_hash(own)
        lines[h] = lines.get(h, 0) + len(own)
    spaces = sum(data.count(bytes([c])) for c in (32, 9, 10, 11, 12, 13))
    return {
        "n_words": len(words), "word_chars": len(text) - spaces, "n_symbols": int(_SYMBOL[np.frombuffer(data, np.uint8)].sum()), "n_dup_lines": dup, "n_repeat_words": repeated_words(words),
        "body": line_hash(words), "lines": [{"line": h, "words": n} for h, n in lines.items()],
    }


def _stats(column: Column) -> Column:
    @F.arrow_udf(_STATS)
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([document_stats(t.as_py()) for t in texts], _ARROW)

    return run(column)


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < 50) | (100 * n_repeat_words > 50 * n_words)


class LineRules:
    """The rules over one table of documents. host, doc_id and text name its columns; others are not read.

    A null text has no words, and fails; a null host is a host of its own. Rows are told apart by their place in the
    table of counts written to the shared folder, so null and repeated ids do no harm.
    """

    def __init__(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source", least_docs: int = LEAST_DOCS, least_words: int = LEAST_WORDS, least_left: float = LEAST_LEFT, keep: tuple[str, ...] = ()):
        self.limits = least_docs, least_words, least_left
        rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"), *[F.col(c).alias(f"kept_{c}") for c in keep], _stats(F.col(text)).alias("s"))
        self.table = stored(rows.select("doc_id", "host", *[f"kept_{c}" for c in keep], "s.*", F.monotonically_increasing_id().alias("row")))

    def frequent_lines(self) -> DataFrame:
        """host, line, n_docs of the lines above the limit, and n_rows, the rows that hold them."""
        least_docs, *_ = self.limits
        lines = self.table.select("host", "body", F.explode("lines.line").alias("line"))
        # each distinct document counts once for a line; both steps combine before they exchange
        copies = lines.groupBy("host", "line", "body").agg(F.count("*").alias("n"))
        return copies.groupBy("host", "line").agg(F.count("*").alias("n_docs"), F.sum("n").alias("n_rows")).where(F.col("n_docs") >= least_docs)

    def verdicts(self) -> DataFrame:
        """The table with removed_words, base_failed and kept."""
        _, least_words, least_left = self.limits
        frequent = stored(self.frequent_lines().drop("n_docs"))
        lines = self.table.select("row", "host", F.explode("lines").alias("l")).select("row", "host", "l.line", "l.words")
        removed = hot_join(lines, frequent, ["host", "line"], "n_rows").groupBy("row").agg(F.sum("words").alias("removed_words"), F.collect_set("line").alias("removed_lines"))
        out = self.table.drop("lines", "body").join(removed, "row", "left").withColumn("removed_words", F.coalesce("removed_words", F.lit(0).cast("long")))
        left = F.col("n_words") - F.col("removed_words")
        depleted = (F.col("removed_words") > 0) & ((left < least_words) | (left < least_left * F.col("n_words")))
        return out.withColumn("base_failed", base_failed(F.col("n_words"), F.col("n_repeat_words"))).withColumn("kept", ~F.col("base_failed") & ~depleted)


def without_lines(text: Column, removed: Column) -> Column:
    """The text without the lines whose hash is in `removed`; unchanged if that is null or empty. Null stays null."""

    @F.arrow_udf(T.StringType())
    def run(texts: pa.Array, lines: pa.Array) -> pa.Array:
        out = []
        for t, gone in zip(texts.to_pylist(), lines.to_pylist(), strict=True):
            if t is not None and gone:
                gone = set(gone)
                t = "\n".join(x for x in t.split("\n") if not (w := x.encode().split()) or line_hash(w) not in gone)
            out.append(t)
        return pa.array(out, pa.string())

    return run(text, removed)
