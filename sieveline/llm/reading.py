"""Reading level of documents: boosted trees over features of the text, trained on ratings."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from sieveline.llm.mix import clean_lang, clean_source
from sieveline.llm.text import WORD, compose, sentences, small_batches
from sieveline.llm.trees import BoostedTrees, isotonic
from sieveline.storage import refuse_clash

#: Rated documents the model is fitted on, at most; the least for one to be fitted.
MOST_RATED, LEAST_RATED = 20_000, 5
LEVELS = (1.0, 5.0)
VOWELS = regex.compile(r"[aeiouyäöüáéíóúàèìòùâêîôû]+")
DIGITS = re.compile(r"\d+")
#: Words whose syllables a worker keeps.
KEPT = 200_000


class _Syllables(dict):
    """Runs of vowels of a word, one at least."""

    def __missing__(self, word: str) -> int:
        n = max(1, len(VOWELS.findall(word)))
        if len(self) >= KEPT:
            self.clear()
        self[word] = n
        return n


SYLLABLES = _Syllables()
#: Length, vocabulary, syntax and cohesion; the first four are also columns of the result.
FEATURES = (
    "words", "sentences", "words_per_sentence", "letters_per_word",
    "sentence_spread", "longest_sentence", "word_spread", "long_words", "short_words", "syllables", "hard_words",
    "variety", "once", "commas", "other_marks", "questions", "digits", "capitals", "overlap", "repeat", "paragraph_words",
)


def features(text: str) -> list[float] | None:
    """FEATURES of a text; None if it holds no word. A sentence is one that holds a word."""
    text = compose(text)
    counts, sets, lengths = [], [], []
    lower: list[str] = []
    capitals = 0
    for s in sentences(text):
        if own := WORD.findall(s):
            counts.append(len(own))
            capitals += sum([w[0].isupper() for w in own])
            own = [w.lower() for w in own]
            sets.append(set(own))
            lower += own
    if not lower:
        return None
    kinds = Counter(lower)
    n, m = len(lower), len(counts)
    letters = squares = long = short = syllables = hard = once = 0
    for w, c in kinds.items():
        k, s = len(w), SYLLABLES[w]
        letters += c * k
        squares += c * k * k
        syllables += c * s
        long += c * (k >= 7)
        short += c * (k <= 3)
        hard += c * (s >= 3)
        once += c == 1
    spread = sum([c * c for c in counts]) / m - (n / m) ** 2
    shared = [len(a & b) / min(len(a), len(b)) for a, b in zip(sets, sets[1:])]
    marks = text.count(";") + text.count(":") + text.count("(")
    return [
        n, m, n / m, letters / n,
        max(spread, 0.0) ** 0.5, max(counts), max(squares / n - (letters / n) ** 2, 0.0) ** 0.5, long / n, short / n, syllables / n, hard / n,
        len(kinds) / n**0.5, once / len(kinds), text.count(",") / m, marks / m, text.count("?") / m,
        sum(map(len, DIGITS.findall(text))) / n, capitals / n, sum(shared) / len(shared) if shared else 0.0, max(kinds.values()) / n, n / (text.count("\n\n") + 1),
    ]


@dataclass
class LevelModel:
    """Trees and the rising curve that calibrates them; validation: error by source, of models of the other sources; explained: the share
    of the variance of all ratings that these models explain."""

    trees: BoostedTrees
    knots: tuple[np.ndarray, np.ndarray]
    validation: list[tuple] = field(default_factory=list)
    explained: float = 0.0

    def predict(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.trees.predict(x), *self.knots), *LEVELS) if len(x) else np.zeros(0)


def _measure(batches: Iterator[pa.RecordBatch], schema: pa.Schema, model: LevelModel | None) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches):
        made = [(i, f) for i, t in enumerate(batch.column(batch.num_columns - 1).to_pylist()) if t and (f := features(t))]
        x = np.array([f for _, f in made], float).reshape(-1, len(FEATURES))
        keys = [c.take(pa.array([i for i, _ in made], pa.int64())) for c in batch.columns[:-1]]
        columns = [x[:, 0].astype(np.int64), x[:, 1].astype(np.int64), x[:, 2], x[:, 3]]
        columns.append(model.predict(x) if model else np.full(len(x), np.nan)) if len(schema) == len(keys) + 5 else columns.append(None)
        if columns[-1] is None:
            arrays = [pa.array(list(x), pa.list_(pa.float64()))]
        else:
            arrays = [pa.array(c) for c in columns[:-1]] + [pa.array(columns[-1], from_pandas=True)]
        yield pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip([*keys, *arrays], schema)], schema=schema)


def train(docs: DataFrame, ratings: DataFrame, most: int = MOST_RATED) -> LevelModel | None:
    """A model from the documents (doc_id, text, lang, source) with ratings (doc_id, rater, level).

    A document's level is the mean of its raters, each rater counted once with the mean of their levels; rows
    repeated or without a level do not count. At most `most` rated documents, chosen by a hash of their ids, go to
    the driver as rows of numbers: a fixed bound. Every source in turn is predicted by trees of the other sources;
    these guesses give the rising curve that turns a guess into a level. For the errors by source the curve, too, comes
    from the guesses for the other sources alone. None with fewer than LEAST_RATED rated documents with words.
    """
    rated = ratings.where(F.col("level").isNotNull() & F.col("doc_id").isNotNull()).distinct().groupBy("doc_id", "rater").agg(F.avg("level").alias("level")).groupBy("doc_id").agg(F.avg("level").alias("__level"))
    rated = rated.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = docs.select("doc_id", "source", "text").join(F.broadcast(rated), "doc_id").select("doc_id", "__level", F.coalesce(clean_source("source"), F.lit("none")).alias("__source"), "text")
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("x", T.ArrayType(T.DoubleType()))])
    found = rows.mapInArrow(partial(_measure, schema=to_arrow_schema(schema), model=None), schema).toPandas().sort_values("doc_id", kind="stable").drop_duplicates("doc_id")
    if len(found) < LEAST_RATED:
        return None
    x, y, source = np.stack(found["x"].to_numpy()), found["__level"].to_numpy(float), found["__source"].to_numpy()
    guess = np.full(len(y), y.mean())
    for s in np.unique(source):
        out = source == s
        if (~out).sum() >= LEAST_RATED:
            guess[out] = BoostedTrees().fit(x[~out], y[~out]).predict(x[out])
    knots = isotonic(guess, y)
    level = np.full(len(y), y.mean())
    for s in np.unique(source):
        out = source == s
        if (~out).any():
            level[out] = np.clip(np.interp(guess[out], *isotonic(guess[~out], y[~out])), *LEVELS)
    report = [(str(s), int((source == s).sum()), float(np.sqrt(np.mean((level - y)[source == s] ** 2))), float(np.mean(np.abs(level - y)[source == s])), float(y[source == s].mean()), float(level[source == s].mean())) for s in np.unique(source)]
    explained = 1 - float(((level - y) ** 2).mean() / y.var()) if y.var() > 0 else 0.0
    return LevelModel(BoostedTrees().fit(x, y), knots, report, explained)


VALIDATION = "source string, rated long, rmse double, mae double, mean_level double, mean_predicted double"
MADE = (*FEATURES[:4], "level")


def reading_levels(docs: DataFrame, model: LevelModel | None) -> DataFrame:
    """(doc_id, source, lang, words, sentences, words_per_sentence, letters_per_word, level) of every document with a word.

    One pass over the texts without a shuffle. level lies from 1 (easy) to 5 (demanding); null without a model.

    - null, empty and wordless texts: no row. A text without sentence ends is one sentence, whatever its length.
    - repeated rows repeat; an empty table gives an empty result; source and lang are cleaned (null stays
      null); other columns are ignored.
    """
    rows = docs.select("doc_id", clean_source("source").alias("source"), clean_lang("lang").alias("lang"), "text").where(F.col("text").isNotNull())
    made = [T.StructField("words", T.LongType()), T.StructField("sentences", T.LongType()), *[T.StructField(m, T.DoubleType()) for m in MADE[2:]]]
    refuse_clash(["doc_id"], MADE)
    schema = T.StructType([*rows.schema.fields[:-1], *made])
    return rows.mapInArrow(partial(_measure, schema=to_arrow_schema(schema), model=model), schema)
