"""Analyzers and text functions as columns."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sieveline.errors import SchemaError
from sieveline.storage import is_small, materialise

ANALYZERS = ("standard", "standard_en")
#: Tokens of this many bytes or more are dropped, before they are lower-cased.
LONG_TOKEN = 40


def standard(text: Column) -> Column:
    """Tokens: runs of letters and digits, long ones dropped, lower-cased. Null for null."""
    runs = F.regexp_extract_all(text, F.lit(r"[\p{IsAlphabetic}\p{N}]+"), F.lit(0))
    return F.transform(F.filter(runs, lambda t: F.octet_length(t) < LONG_TOKEN), lambda t: F.lower(t))


@F.pandas_udf(T.StringType())
def stem_words(words: pd.Series) -> pd.Series:
    from sieveline.functions.porter2 import stem

    known: dict[str, str] = {}
    return words.map(lambda w: known[w] if w in known else known.setdefault(w, stem(w)))


@F.arrow_udf(T.ArrayType(T.StringType()))
def stem_tokens(tokens: pa.Array) -> pa.Array:
    """Each distinct token of a batch is stemmed once."""
    from sieveline.functions.porter2 import stem

    coded = tokens.flatten().dictionary_encode()
    stems = pa.array([stem(w) for w in coded.dictionary.to_pylist()], pa.string()).take(coded.indices)
    ends = np.r_[0, np.cumsum(pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False))].astype(np.int32)
    made = pa.ListArray.from_arrays(pa.array(ends), stems)
    return pc.if_else(tokens.is_null(), pa.scalar(None, made.type), made)


def analyze(text: Column, analyzer: str = "standard") -> Column:
    if analyzer == "standard":
        return standard(text)
    if analyzer == "standard_en":
        return stem_tokens(standard(text))
    raise SchemaError(f"unknown analyzer {analyzer!r}")


def analyze_text(text: str, analyzer: str = "standard") -> list[str]:
    """The same on the driver, for one query text."""
    import regex

    from sieveline.functions.porter2 import stem

    if analyzer not in ANALYZERS:
        raise SchemaError(f"unknown analyzer {analyzer!r}")
    tokens = [t.lower() for t in regex.findall(r"[\p{Alphabetic}\p{N}]+", text) if len(t.encode()) < LONG_TOKEN]
    return [stem(t) for t in tokens] if analyzer == "standard_en" else tokens


def stem_terms(rows: DataFrame, column: str = "term") -> DataFrame:
    """rows with the column stemmed: each distinct word is stemmed once and joined back."""
    words = materialise(rows.select(column).distinct().select(F.col(column).alias("__word"), stem_words(F.col(column)).alias("__stem")), "stems")
    words = F.broadcast(words) if is_small(words) else words
    return rows.join(words, rows[column] == F.col("__word")).withColumn(column, F.col("__stem")).drop("__word", "__stem")


def passage_text(title: Column, body: Column) -> Column:
    """Title, a blank line, body."""
    return F.concat(title, F.lit("\n\n"), body)


def joined(*parts: Column) -> Column:
    """Parts joined by one space; an empty or null part brings neither itself nor its space."""
    return F.concat_ws(" ", *[F.nullif(p, F.lit("")) for p in parts])


def title_line(text: Column) -> Column:
    """What stands before the first blank line."""
    return F.substring_index(text, "\n\n", 1)


def page_url(base: str, title: Column) -> Column:
    """base and the title, every byte outside A-Z a-z 0-9 - _ . ~ / percent-encoded."""
    coded = F.url_encode(title)
    for old, new in (("+", "%20"), ("%2F", "/"), ("*", "%2A"), ("%7E", "~")):
        coded = F.replace(coded, F.lit(old), F.lit(new))
    return F.concat(F.lit(base), coded)


def position_count(text: Column) -> Column:
    """Positions of a text in a window with a start and an end mark, one for each word or sign, when no vocabulary is at hand."""
    return F.size(F.regexp_extract_all(text, F.lit(r"[\p{IsAlphabetic}\p{N}]+|[^\p{IsAlphabetic}\p{N}\s]"), F.lit(0))) + 2
