"""What counts as a word, a position and a sentence in the operators of this package."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex

#: White space between positions.
BLANK = " \t\r\n\xa0"
#: A position: a maximal run of letters and digits, or any other single character that is not blank.
POSITION = re.compile(rf"[^\W_]+|[^\w{BLANK}]|_")
#: A word: a maximal run of letters.
WORD = regex.compile(r"\p{L}+")
BLANK_LINE = re.compile(r"\n[ \t\r]*\n")
#: Where a sentence ends: blank space directly after . ! or ?, or a blank line.
SENTENCE_END = re.compile(rf"(?<=[.!?])[{BLANK}]|\n[ \t\r]*\n")


def compose(text: str) -> str:
    return text if text.isascii() or unicodedata.is_normalized("NFC", text) else unicodedata.normalize("NFC", text)


def sentences(text: str) -> list[str]:
    return SENTENCE_END.split(text)


def small_batches(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Slices of the batches, so that what is made of one stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
