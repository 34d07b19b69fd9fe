"""Column functions over texts: normalisation, tokens, estimates, shapes, spans, extracts, risk.

All are built-in expressions, but for NFKC, which Spark lacks: texts that aren't ASCII pass through one Arrow function.
Lengths are UTF-16 units where results depend on them (a character beyond U+FFFF counts twice).
"""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.functions import words as W

NUMBER = r"(\$?[0-9]+(,[0-9]{3})*(\.[0-9]+)?%?)|([0-9]{1,4}[/-][0-9]{1,2}([/-][0-9]{1,4})?)|([vV]?[0-9]+\.[0-9]+(\.[0-9]+)?)"
CODE_SIGNAL = rf"```|=>|function[{W.SPACE}]+[A-Za-z0-9_]+|class[{W.SPACE}]+[A-Za-z0-9_]+|(import|export|throw|return)[{W.SPACE}]+|[{{}}();]"
_B = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
ENTITY = rf"{_B}[A-Z][A-Za-z0-9_'-]{{2,}}{_B}|`[^`]+`|{_B}[A-Za-z]+[A-Z][A-Za-z0-9]*{_B}"
DECISION = rf"(?i){_B}(decided|decision|must|should|todo|pending|decidimos|debe|pendiente|restriccion|restric){_B}"
TOKEN = rf"[A-Za-z][A-Za-z0-9_'-]*|[0-9]+(?:\.[0-9]+)?|[^{W.SPACE}]"
SENTENCE = r"[^.!?\n]+[.!?\n]+|[^.!?\n]+\z"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def text_of(c: Column | str) -> Column:
    """Null counts as empty."""
    return F.coalesce(_col(c), F.lit(""))


def trimmed(c: Column | str) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(_col(c), rf"^[{W.SPACE}]+|[{W.SPACE}]+\z", "")


def units(c: Column | str) -> Column:
    """Length in UTF-16 units."""
    c = _col(c)
    return F.length(c) + F.regexp_count(c, F.lit(r"[\x{10000}-\x{10FFFF}]"))


def one_line_ends(c: Column | str) -> Column:
    """CR LF becomes LF; a lone CR stays."""
    return F.replace(_col(c), F.lit("\r\n"), F.lit("\n"))


@F.arrow_udf(T.StringType())
def nfkc(texts: pa.Array) -> pa.Array:
    return pa.array([t if t is None or t.isascii() else unicodedata.normalize("NFKC", t) for t in texts.to_pylist()], pa.string())


def normalized(c: Column | str) -> Column:
    """NFKC, white space runs as one space, trimmed."""
    return trimmed(F.regexp_replace(nfkc(text_of(c)), f"[{W.SPACE}]+", " "))


def engine_tokens(c: Column | str) -> Column:
    """Words, numbers and single other characters of the normalised text."""
    return F.regexp_extract_all(normalized(c), F.lit(f"({TOKEN})"), F.lit(1))


def tokens_of_normalized(c: Column | str) -> Column:
    return F.regexp_extract_all(_col(c), F.lit(f"({TOKEN})"), F.lit(1))


def estimate_tokens(c: Column | str) -> Column:
    """Heuristic token count: the mean of word pieces and quarter lengths, rounded up; 0 for a blank text."""
    t = trimmed(text_of(c))
    astral = F.regexp_count(t, F.lit(r"[\x{10000}-\x{10FFFF}]"))
    pieces = F.regexp_count(t, F.lit(rf"[A-Za-z0-9_]+|[^{W.SPACE}A-Za-z0-9_]")) + astral
    quarters = F.ceil((F.length(t) + astral) / 4)
    return F.when(t == "", 0).otherwise(F.greatest(F.lit(1), F.ceil((pieces + quarters) / 2))).cast("long")


def is_protected(token: Column) -> Column:
    low = F.lower(token)
    return (
        low.isin(W.PROTECTED)
        | token.rlike(r"^!?=|[<>]=?\z")
        | token.rlike(r"^[0-9]{1,4}([/-][0-9]{1,2}){1,2}\z")
        | token.rlike(r"^[0-9]+(\.[0-9]+)?%?\z")
        | token.rlike(r"^\$?[0-9]+(,[0-9]{3})*(\.[0-9]+)?\z")
        | token.rlike(r"^v?[0-9]+\.[0-9]+(\.[0-9]+)?\z")
    )


def protected_tokens(tokens: Column) -> Column:
    return F.filter(tokens, is_protected)


def salience(token: Column, index: Column) -> Column:
    """How much a token says: long, protected, cased, numeric and early ones more, stop words less; 0 without [A-Za-z0-9]."""
    score = (
        F.least(F.lit(10), units(token))
        - F.when(F.lower(token).isin(W.STOPWORDS), 6).otherwise(0)
        + F.when(is_protected(token), 8).otherwise(0)
        + F.when(token.rlike("[A-Z][a-z]+[A-Z]|_"), 4).otherwise(0)
        + F.when(token.rlike("[0-9]"), 3).otherwise(0)
        + F.when(token.rlike(r"^[A-Z][A-Za-z0-9_'-]+\z"), 2).otherwise(0)
    )
    return F.when(token.rlike("[A-Za-z0-9]"), score + F.greatest(F.lit(0.0), F.lit(3.0) - index * F.lit(0.05))).otherwise(F.lit(0.0))


def anchors(tokens: Column) -> Column:
    """The 12 most salient tokens (the earlier on ties), in text order: array of (index, token)."""
    scored = F.transform(tokens, lambda t, i: F.struct((-salience(t, i)).alias("low"), i.alias("index"), t.alias("token")))
    best = F.slice(F.array_sort(F.filter(scored, lambda x: x["low"] < 0)), 1, W.ANCHORS)
    return F.array_sort(F.transform(best, lambda x: F.struct(x["index"].alias("index"), x["token"].alias("token"))))


def unique(values: Column) -> Column:
    """In order, without repeats, nulls and empty strings."""
    return F.array_distinct(F.filter(values, lambda v: v.isNotNull() & (v != "")))


def run_lengths(c: Column | str) -> Column:
    """LLLD -> L3D."""
    runs = F.regexp_extract_all(_col(c), F.lit(r"((.)\2*)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda r: F.concat(F.left(r, F.lit(1)), F.when(F.length(r) > 1, F.length(r).cast("string")).otherwise(""))), "")


def mask(c: Column | str) -> Column:
    """Run lengths of character classes: U upper, L lower, D digit, _ itself, S space, P other."""
    marked = F.regexp_replace(_col(c), rf"[^A-Za-z0-9_{W.SPACE}]", "\u0001")
    marked = F.regexp_replace(marked, f"[{W.SPACE}]", "\u0002")
    marked = F.regexp_replace(F.regexp_replace(F.regexp_replace(marked, "[a-z]", "\u0003"), "[A-Z]", "\u0004"), "[0-9]", "\u0005")
    return run_lengths(F.translate(marked, "\u0001\u0002\u0003\u0004\u0005", "PSLUD"))


def vowel_mask(lowered: Column) -> Column:
    """Run lengths of V vowels (y too), C other letters a-z, O other characters."""
    marked = F.regexp_replace(F.regexp_replace(F.regexp_replace(lowered, "[^a-z]", "O"), "[aeiouy]", "V"), "[a-z]", "C")
    return run_lengths(marked)


def char_shape(c: Column | str, low: Column, k: int = 3) -> Column:
    """length, prefix, suffix, mask, vc and histogram (letter -> share, rounded to 3 places as it grows) of a word.

    low: a column with the word normalised and lower-cased.
    """
    letters = F.regexp_replace(low, "[^a-z]", "")
    each = F.filter(F.split(letters, ""), lambda x: x != "")
    step = F.lit(1.0) / F.greatest(F.lit(1), F.length(letters))
    histogram = F.map_from_entries(
        F.transform(F.array_distinct(each), lambda x: F.struct(x, F.aggregate(F.filter(each, lambda y: y == x), F.lit(0.0), lambda s, _: F.floor((s + step) * 1000 + 0.5) / 1000)))
    )
    return F.struct(F.length(low).alias("length"), F.left(low, F.lit(k)).alias("prefix"), F.right(low, F.lit(k)).alias("suffix"), mask(text_of(c)).alias("mask"), vowel_mask(low).alias("vc"), histogram.alias("histogram"))


def clamped(c: Column | str, n: int) -> Column:
    """Trimmed; if longer than n units, cut to n - 3, trimmed again and marked with dots."""
    t = trimmed(text_of(c))
    return F.when(units(t) <= n, t).otherwise(F.concat(trimmed(cut(t, n - 3)), F.lit("...")))


def cut(c: Column, n: int) -> Column:
    """The first n UTF-16 units; a character of two units that doesn't fit whole is left out."""
    wide = F.regexp_replace(F.left(c, F.lit(n)), r"([\x{10000}-\x{10FFFF}])", "$1\u0001")  # marks the second units
    return F.when(units(c) == F.length(c), F.left(c, F.lit(n))).otherwise(F.regexp_replace(F.left(wide, F.lit(n)), r"[\x{10000}-\x{10FFFF}]\z|\u0001", ""))


def sentences(c: Column | str) -> Column:
    """Runs up to and with their terminators; the whole text if there are none."""
    c = _col(c)
    found = F.regexp_extract_all(c, F.lit(f"({SENTENCE})"), F.lit(1))
    return F.when(F.size(found) > 0, found).otherwise(F.array(c))


def has_number(c: Column) -> Column:
    return c.rlike(NUMBER)


def has_entity(c: Column) -> Column:
    return c.rlike(ENTITY)


def has_code_signal(c: Column) -> Column:
    return c.rlike(CODE_SIGNAL)


def has_decision(c: Column) -> Column:
    return c.rlike(DECISION)


def has_negation(tokens: Column) -> Column:
    return F.exists(tokens, lambda t: F.lower(t).isin(W.PLAIN_NEGATIONS))


def should_compress(c: Column | str) -> Column:
    return (units(text_of(c)) >= W.LONG_SPAN) | (estimate_tokens(c) >= 60)


def file_mode(path: Column | str) -> Column:
    """code for known extensions, else doc."""
    return F.when(F.regexp_extract(F.lower(_col(path)), r"[^/\\](\.[^./\\]+)\z", 1).isin(W.CODE_EXTENSIONS), "code").otherwise("doc")


def checksum_matches(c: Column | str, expected: Column | str) -> Column:
    """Whether 16 to 64 hex digits are how the text's SHA-256 begins."""
    e = F.lower(_col(expected))
    return F.coalesce(e.rlike(r"^[a-f0-9]{16,64}\z") & (F.substr(F.sha2(_col(c), 256), F.lit(1), F.length(e)) == e), F.lit(False))


def reasons(sentence: Column, tokens: Column) -> Column:
    """Why a sentence must be kept as it is, in fixed order."""
    flags = (("protected-term", F.exists(tokens, is_protected)), ("number", has_number(sentence)), ("entity", has_entity(sentence)), ("code-signal", has_code_signal(sentence)), ("decision", has_decision(sentence)))
    return F.filter(F.array(*[F.when(flag, F.lit(name)) for name, flag in flags]), lambda r: r.isNotNull())


def fixed(value: Column, places: int) -> Column:
    """Rounded half up."""
    return F.floor(value * 10**places + 0.5) / 10**places
