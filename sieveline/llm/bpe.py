"""Byte-level BPE of a public tokenizer, applied to whole tables."""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache, partial
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from sieveline.llm.text import small_batches
from sieveline.storage import refuse_clash

#: How byte_bpe_50k cuts a text before it merges (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Stretches kept with their ids by each worker, and the longest one kept.
KEPT, KEPT_LENGTH = 200_000, 64


def tokenizer_file(name: str = "byte_bpe_50k.tiktoken", folder: str = "/opt/tokenizers") -> str:
    return str(Path(folder) / name)


def read_ranks(path: str) -> dict[bytes, int]:
    """Vocabulary of a .tiktoken file: lines of a base64 token and its rank, which is its id."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in Path(path).read_bytes().splitlines() if line)}


class ByteBPE:
    """Encoder and decoder over a vocabulary of ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        self.ranks = ranks
        self.strings = {i: token for token, i in ranks.items()}
        self.cut = regex.compile(pattern).findall
        self.kept = _Kept(self)

    def merge(self, data: bytes) -> list[int]:
        """Ids of one stretch.

        Symbols form a doubly linked list; a queue holds the rank of each pair of neighbours, lowest
        rank and then leftmost first. An entry is stale, and skipped, once its left symbol is gone or
        the pair no longer ends where it did.
        """
        if (whole := self.ranks.get(data)) is not None:
            return [whole]
        n, ranks = len(data), self.ranks
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))  # a symbol is named by its first byte
        alive = bytearray(b"\1") * n
        queue = [(rank, i, i + 2) for i in range(n - 1) if (rank := ranks.get(data[i : i + 2])) is not None]
        heapq.heapify(queue)
        while queue:
            _, left, end = heapq.heappop(queue)
            right = after[left]
            if not alive[left] or right >= n or after[right] != end:
                continue
            alive[right] = 0
            after[left] = end
            if end < n:
                before[end] = left
                if (rank := ranks.get(data[left : after[end]])) is not None:
                    heapq.heappush(queue, (rank, left, after[end]))
            if (prior := before[left]) >= 0 and (rank := ranks.get(data[prior:end])) is not None:
                heapq.heappush(queue, (rank, prior, end))
        ids, at = [], 0
        while at < n:
            ids.append(ranks[data[at : after[at]]])
            at = after[at]
        return ids

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        kept = self.kept
        return list(chain.from_iterable([kept[s] for s in self.cut(text)]))

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        kept = self.kept
        return sum([len(kept[s]) for s in self.cut(text)])

    def decode(self, ids: list[int]) -> str:
        return b"".join([self.strings[i] for i in ids]).decode("utf-8", "replace")


class _Kept(dict):
    """Ids of stretches; those not kept are worked out."""

    def __init__(self, codec: ByteBPE):
        super().__init__()
        self.codec = codec

    def __missing__(self, stretch: str) -> list[int]:
        ids = self.codec.merge(stretch.encode("utf-8", "surrogatepass"))
        if len(stretch) <= KEPT_LENGTH:
            if len(self) >= KEPT:
                self.clear()
            self[stretch] = ids
        return ids


class Vocabulary:
    """A vocabulary file's ranks, read by the driver and sent to each executor once."""

    def __init__(self, spark, path: str):
        self.sent = spark.sparkContext.broadcast(_bytes_of(path))

    def codec(self) -> ByteBPE:
        return _codec(self.sent.value)


@lru_cache(maxsize=4)
def _bytes_of(path: str) -> bytes:
    return Path(path).read_bytes()


@lru_cache(maxsize=2)
def _codec(content: bytes) -> ByteBPE:
    ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in content.splitlines() if line)}
    return ByteBPE(ranks)


def _encode(batches: Iterator[pa.RecordBatch], vocabulary: Vocabulary, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    codec = vocabulary.codec()
    for batch in small_batches(batches):
        ids = [codec.encode(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
        ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
        flat = np.fromiter(chain.from_iterable(ids), np.int32, int(ends[-1]))
        made = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
        yield pa.RecordBatch.from_arrays([*(c.cast(schema.field(i).type) for i, c in enumerate(batch.columns[:-1])), made.cast(schema.field(len(schema) - 1).type)], schema=schema)


def _count(batches: Iterator[pa.RecordBatch], vocabulary: Vocabulary, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    codec = vocabulary.codec()
    for batch in small_batches(batches):
        made = pa.array([codec.count(t) for t in batch.column(batch.num_columns - 1).to_pylist()], pa.int64())
        yield pa.RecordBatch.from_arrays([*(c.cast(schema.field(i).type) for i, c in enumerate(batch.columns[:-1])), made], schema=schema)


def _decode(batches: Iterator[pa.RecordBatch], vocabulary: Vocabulary, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    codec = vocabulary.codec()
    for batch in small_batches(batches):
        made = pa.array([None if ids is None else codec.decode(ids) for ids in batch.column(batch.num_columns - 1).to_pylist()], pa.string())
        yield pa.RecordBatch.from_arrays([*(c.cast(schema.field(i).type) for i, c in enumerate(batch.columns[:-1])), made], schema=schema)


def _mapped(df: DataFrame, keys: list[str], column: str, made: str, kind: T.DataType, work, vocabulary: str | None) -> DataFrame:
    refuse_clash(keys, [made])
    rows = df.select(*keys, F.col(column).alias("__in"))
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField(made, kind)])
    sent = Vocabulary(df.sparkSession, vocabulary or tokenizer_file())
    return rows.mapInArrow(partial(work, vocabulary=sent, schema=to_arrow_schema(schema)), schema)


def encode_texts(df: DataFrame, keys: list[str], text: str, vocabulary: str | None = None) -> DataFrame:
    """keys and `ids`, the tokens of each text without special tokens. One row for each row, no shuffle.

    - null and empty text: an empty list. Strings that look like special tokens are ordinary text.
    - the text is taken as it is; a stretch of any length is merged in n log n steps.
    - repeated rows repeat; an empty table gives an empty result; columns other than keys are ignored;
      a key named `ids` is a SchemaError.
    """
    return _mapped(df, keys, text, "ids", T.ArrayType(T.IntegerType(), False), _encode, vocabulary)


def count_tokens(df: DataFrame, keys: list[str], text: str, vocabulary: str | None = None) -> DataFrame:
    """keys and `tokens`, how many ids encode_texts gives; 0 for null and empty texts."""
    return _mapped(df, keys, text, "tokens", T.LongType(), _count, vocabulary)


def decode_ids(df: DataFrame, keys: list[str], ids: str, vocabulary: str | None = None) -> DataFrame:
    """keys and `text`: the strings of the ids, joined. Null ids give null; bytes that are no UTF-8 become U+FFFD."""
    return _mapped(df, keys, ids, "text", T.StringType(), _decode, vocabulary)
