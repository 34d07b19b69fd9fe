"""Texts from files, tables and conversations."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import text as X
from textloom.functions import words as W

MAX_FILE = 8_000_000


def inside(root: str, path: str) -> str:
    """The real path of a regular file inside a root folder; links that lead out of it are refused."""
    base, real = os.path.realpath(root), os.path.realpath(os.path.join(root, path))
    if os.path.commonpath([base, real]) != base:
        raise ValueError(f"outside the workspace: {path}")
    if not os.path.isfile(real):
        raise FileNotFoundError(path)
    return real


def read_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """path, byte_length, version, mode, text and error of UTF-8 files; text is null where error says why."""
    reader = spark.read.format("binaryFile")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    files = reader.load(path)
    error = F.when(F.col("length") > MAX_FILE, "too large").when(~F.is_valid_utf8(F.col("content").cast("string")), "not UTF-8")
    text = F.decode("content", "utf-8")
    return files.select("path", F.col("length").alias("byte_length"), F.concat_ws(":", "length", F.unix_millis("modificationTime")).alias("version"), X.file_mode("path").alias("mode"), F.when(error.isNull(), text).alias("text"), error.alias("error"))


def checked_texts(df: DataFrame, text: str = "text") -> DataFrame:
    """df with error: why a text can't be compressed (null, or longer than two million units)."""
    return df.withColumn("error", F.when(F.col(text).isNull(), "no text").when(X.units(text) > W.MAX_TEXT, "too long"))


def joined_conversations(df: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conversation, text, n_messages: messages in order of turn, each after [role#index], blank lines between."""
    ordered = df.select(F.col(key).alias("conversation"), F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("unknown")).alias("role"), X.text_of(text).alias("content")).alias("m")).groupBy("conversation").agg(F.array_sort(F.collect_list("m")).alias("m"))
    lines = F.transform("m", lambda m, i: F.concat(F.lit("["), m["role"], F.lit("#"), i.cast("string"), F.lit("] "), m["content"]))
    return ordered.select("conversation", F.array_join(lines, "\n\n").alias("text"), F.size("m").cast("long").alias("n_messages"))


def stale(registered: DataFrame, fresh: DataFrame) -> DataFrame:
    """document_id of registered (document_id, version, sha256) documents whose fresh version or digest is another, or missing."""
    now = fresh.select("document_id", F.col("version").alias("new_version"), F.col("sha256").alias("new_sha256"))
    both = registered.join(now, "document_id", "left")
    return both.where(F.col("new_version").isNull() | (F.col("new_version") != F.col("version")) | (F.col("new_sha256") != F.col("sha256"))).select("document_id")
