"""How strongly a term marks its record against the whole collection: residuals of correspondence analysis."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from sieveline.llm.text import WORD, compose, small_batches
from sieveline.storage import materialise, once_per_key, refuse_clash

#: The terms in most records whose statistics are broadcast; no other term is in more than 1/HOT of all pairs.
HOT = 4096
MADE = ("term", "tf", "df", "term_total", "record_total", "expected", "residual", "adjusted")


def _count_words(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    find = WORD.findall
    for batch in small_batches(batches):
        owners, terms, counts, totals = [], [], [], []
        for i, text in enumerate(batch.column(1).to_pylist()):
            if text:
                words = Counter(map(str.lower, find(compose(text))))
                owners.append((i, len(words)))
                terms += words.keys()
                counts += words.values()
                totals.append(words.total())
        times = np.array([n for _, n in owners], np.int64)
        owner = np.repeat(np.array([i for i, _ in owners], np.int64), times)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(owner)).cast(schema.field(0).type), pa.array(terms, pa.string()), pa.array(counts, pa.int32()), pa.array(np.repeat(np.array(totals, np.int64), times))], schema=schema
        )


def word_counts(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, tf, record_total) of each record: its lower-cased words, how often each occurs, words in all.

    Counted within each batch, so nothing is shuffled. Rows with a null, empty or wordless text give none.
    """
    rows = df.select(key, F.col(text).alias("__text"))
    schema = T.StructType([rows.schema[0], T.StructField("term", T.StringType()), T.StructField("tf", T.IntegerType()), T.StructField("record_total", T.LongType())])
    return rows.where(F.col(key).isNotNull() & F.col("__text").isNotNull()).mapInArrow(partial(_count_words, schema=to_arrow_schema(schema)), schema)


def residuals(counts: DataFrame, key: str) -> DataFrame:
    """Scores of (key, term, tf, record_total): residual and adjusted residual of correspondence analysis.

    expected = record_total * term_total / total, residual = (tf - expected) / sqrt(expected),
    adjusted = residual / sqrt((1 - record_total / total) * (1 - term_total / total)). Stock words come
    near 0 or below; words that few records dwell on come high. df counts the records of the term.
    A record or term that is the whole collection has no variance left: adjusted is 0.0 there.

    counts is read three times, so it should be a table. The terms of most records are joined by a
    broadcast of HOT rows and never shuffled; the rest is joined by a shuffle in which no term is hot.
    """
    stats = materialise(counts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("term_total")), "terms")
    total = stats.agg(F.sum("term_total")).first()[0] or 0
    hot = stats.orderBy(F.desc("df"), "term").limit(HOT)
    by_hot = counts.join(F.broadcast(hot), "term")
    names = F.broadcast(hot.select("term"))
    by_rest = counts.join(names, "term", "left_anti").join(stats.join(names, "term", "left_anti"), "term")
    whole = F.lit(float(total))
    expected = F.col("record_total") * F.col("term_total") / whole
    left = (1 - F.col("record_total") / whole) * (1 - F.col("term_total") / whole)
    scored = by_hot.unionByName(by_rest).withColumn("expected", expected).withColumn("residual", (F.col("tf") - F.col("expected")) / F.sqrt("expected"))
    return scored.select(key, *MADE[:-1], F.when(left > 0, F.col("residual") / F.sqrt(left)).otherwise(F.lit(0.0)).alias("adjusted"))


def distinctive_terms(df: DataFrame, key: str, text: str) -> DataFrame:
    """Each word of each record with its scores (see residuals); key and the columns of MADE.

    - null, empty and wordless texts and null keys: no row. Rows with the same key count once, as the
      least text. Words are maximal runs of letters of the composed text, lower-cased, of any length.
    - an empty table gives an empty result; other columns are ignored; a key named like a result column
      is a SchemaError. Equal scores stay equal: the result has no order.
    """
    refuse_clash([key], MADE)
    rows = once_per_key(df.select(key, text), key)
    return residuals(materialise(word_counts(rows, key, text), "words"), key)


def most_distinctive(scores: DataFrame, key: str, n: int = 10) -> DataFrame:
    """The n terms of each record with the highest adjusted residual, then by term."""
    order = Window.partitionBy(key).orderBy(F.desc(F.round("adjusted", 9)), "term")
    # Spark cuts each record's terms before the exchange, so that no record is gathered whole
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).select(key, "rank", "term", "tf", "df", "adjusted")
