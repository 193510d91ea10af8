"""Splitting texts that are too large for a window, at natural boundaries."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from sieveline.errors import SchemaError
from sieveline.llm.text import BLANK_LINE, POSITION, compose, small_batches
from sieveline.storage import refuse_clash

#: Strengths of a boundary, weakest first.
STRENGTHS = ("none", "word", "sentence", "paragraph")
#: Positions that a window needs besides those of the text.
EXTRA = 2

MADE = T.StructType(
    [
        T.StructField("piece_no", T.IntegerType()),
        T.StructField("n_pieces", T.IntegerType()),
        T.StructField("piece_start", T.IntegerType()),
        T.StructField("piece_end", T.IntegerType()),
        T.StructField("piece_size", T.IntegerType()),
        T.StructField("ends_at", T.StringType()),
        T.StructField("text_size", T.IntegerType()),
        T.StructField("longest_sentence", T.IntegerType()),
        T.StructField("piece_text", T.StringType()),
    ]
)


def boundaries(text: str, spans: list[tuple[int, int]]) -> list[int]:
    """Strength of a cut before each position; the one before the first position counts as the strongest."""
    found = [3]
    for (_, end), (start, _) in zip(spans, spans[1:]):
        if start == end:
            found.append(0)
        elif start - end > 1 and BLANK_LINE.search(text, end, start):
            found.append(3)
        else:
            found.append(2 if text[end - 1] in ".!?" else 1)
    return found


def longest_run(strengths: list[int]) -> int:
    """Positions of the longest stretch between cuts that end a sentence."""
    longest, began = 0, 0
    for i, s in enumerate([*strengths, 3]):
        if s >= 2:
            longest, began = max(longest, i - began), i
    return longest


def cuts(strengths: list[int], most: int, overlap: int) -> list[tuple[int, int]]:
    """Pieces as (first position, position after the last), each of at most `most` positions.

    The least number of pieces gives targets of equal length; each target moves to the strongest
    boundary near it, the nearest of equals. Where no sentence ends near it, the whole range that the limit
    leaves is searched for a stronger one, so that no cut is weaker than a sentence end, or a word end, that its
    piece could have had. A piece beyond the limit, or such a cut, adds one piece and starts again. If longest
    pieces, which enter each run without boundaries at its start, cut fewer times inside runs, they are taken.
    """
    n = len(strengths)
    if n <= most:
        return [(0, n)] if n else []
    count = 1 + -(-(n - most) // (most - overlap))
    while True:
        length = (n + (count - 1) * overlap) / count
        reach = int(length / 4)
        if length - 2 * reach <= overlap + 1:
            reach = 0
        if pieces := _snapped(strengths, most, overlap, count, length, reach):
            return min(pieces, _longest(strengths, most, overlap), key=partial(_inside, strengths)) if _inside(strengths, pieces) else pieces
        if length * 1.5 < most or count >= n:  # more pieces cannot help: each as long as its best boundary allows
            return _longest(strengths, most, overlap)
        count += 1


def _snapped(strengths: list[int], most: int, overlap: int, count: int, length: float, reach: int) -> list[tuple[int, int]]:
    n, start, pieces = len(strengths), 0, []
    for j in range(count - 1):
        target = round(length + j * (length - overlap))
        first, last = start + overlap + 1, min(start + most, n - 1)
        low, high = max(first, target - reach), min(last, target + reach)

        def best(a: int, b: int, target: int = target) -> int:
            return max(range(a, b + 1), key=lambda i: (_kind(strengths[i]), -abs(i - target), -i))

        end = max(range(low, high + 1), key=lambda i: (strengths[i], -abs(i - target), -i)) if low <= high else None
        if end is None or strengths[end] < 2:
            if first > last:
                return []
            widest = max(first, n - (count - 1 - j) * (most - overlap))  # the pieces that are left reach the end from here
            wider = best(widest, last) if widest <= last else None
            if wider is not None and (end is None or strengths[wider] > strengths[end]):
                end = wider
            if end is None or _kind(max(strengths[first : last + 1])) > _kind(strengths[end]):
                return []
        pieces.append((start, end))
        start = end - overlap
    return [*pieces, (start, n)] if n - start <= most else []


def _kind(strength: int) -> int:
    """A paragraph's end is a sentence's end when a wider range is searched."""
    return min(strength, 2)


def _inside(strengths: list[int], pieces: list[tuple[int, int]]) -> int:
    """Cuts inside a run without boundaries."""
    return sum(not strengths[end] for _, end in pieces[:-1])


def _longest(strengths: list[int], most: int, overlap: int) -> list[tuple[int, int]]:
    n, start, pieces = len(strengths), 0, []
    while n - start > most:
        end = max(range(start + overlap + 1, start + most + 1), key=lambda i: (_kind(strengths[i]), i))
        pieces.append((start, end))
        start = end - overlap
    return [*pieces, (start, n)]


def split_text(text: str, window: int, overlap: int, keep_whole: bool) -> list[tuple]:
    """Rows of MADE for one text."""
    text = compose(text)
    most = window - EXTRA
    if len(text) <= most and not keep_whole:
        return []
    spans = [m.span() for m in POSITION.finditer(text)] if keep_whole or len(POSITION.findall(text)) > most else []
    if not spans:
        return []
    strengths = boundaries(text, spans)
    pieces, longest = cuts(strengths, most, overlap), longest_run(strengths) + EXTRA
    rows = []
    for no, (a, b) in enumerate(pieces):
        start, end = spans[a][0], spans[b - 1][1]
        at = STRENGTHS[strengths[b]] if b < len(spans) else "end"
        rows.append((no, len(pieces), start, end, b - a + EXTRA, at, len(spans) + EXTRA, longest, text[start:end]))
    return rows


def _split_batches(batches: Iterator[pa.RecordBatch], window: int, overlap: int, keep_whole: bool, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches):
        owners, rows = [], []
        for i, text in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
            if text:
                made = split_text(text, window, overlap, keep_whole)
                owners += [i] * len(made)
                rows += made
        keys = batch.select(range(batch.num_columns - 1)).take(pa.array(owners, pa.int64()))
        columns = [pa.array([r[j] for r in rows], schema.field(len(keys.schema) + j).type) for j in range(len(MADE))]
        yield pa.RecordBatch.from_arrays([*(c.cast(schema.field(i).type) for i, c in enumerate(keys.columns)), *columns], schema=schema)


def split_oversized(df: DataFrame, keys: Sequence[str], text: str, window: int = 512, overlap: int = 48, keep_whole: bool = False) -> DataFrame:
    """Pieces of the texts of more than `window` positions (its positions plus two), each within the window.

    A piece shares its first `overlap` positions with its predecessor and ends, if it can, where a
    paragraph, a sentence or a word ends. Result: keys and the columns of MADE; offsets count
    characters of the composed (NFC) text. One pass over the rows, without a shuffle.

    - null, empty and blank texts: no row. Texts within the window: no row, or one with keep_whole.
    - a text without any white space is cut between positions; a position is never cut, however long.
    - a repeated row gives its pieces again; an empty table gives an empty result.
    - columns other than keys are ignored; a key named like a result column is a SchemaError.
    - of boundaries of equal strength and distance the earlier one is taken.
    """
    if window <= EXTRA or not 0 <= overlap < window - EXTRA:
        raise SchemaError("window must be above 2 and overlap from 0 to below window - 2")
    refuse_clash(keys, MADE.names)
    rows = df.select(*keys, F.col(text).alias("__text"))
    schema = T.StructType([*rows.schema.fields[:-1], *MADE.fields])
    return rows.where(F.length("__text") > (0 if keep_whole else (window - EXTRA) // 3)).mapInArrow(
        partial(_split_batches, window=window, overlap=overlap, keep_whole=keep_whole, schema=to_arrow_schema(schema)), schema
    )
