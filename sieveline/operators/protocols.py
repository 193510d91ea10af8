"""What callers plug in, and stand-ins that need no model."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import partial
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.errors import ModelError


class Analyzer(Protocol):
    def tokens(self, text: str) -> list[str]: ...


class Embedder(Protocol):
    """kind is query or passage; fingerprint names model, pooling and window, and is stored with an index."""

    dim: int
    metric: str
    fingerprint: str

    def embed(self, texts: Sequence[str], kind: str) -> list[Sequence[float]]: ...


class HashingEmbedder:
    """A stand-in: every token adds a fixed random direction; each text alone, then scaled to length one."""

    def __init__(self, dim: int = 64, metric: str = "cosine"):
        self.dim, self.metric, self.fingerprint = dim, metric, f"hashing-{dim}-v1"

    def _direction(self, token: str) -> np.ndarray:
        seed = int.from_bytes(hashlib.blake2b(token.encode(), digest_size=8).digest(), "little")
        return np.random.default_rng(seed).standard_normal(self.dim)

    def embed(self, texts: Sequence[str], kind: str) -> list[list[float]]:
        from sieveline.functions.analysis import analyze_text

        out, known = [], {}
        for t in texts:
            v = np.zeros(self.dim)
            for x in [*analyze_text(t or ""), "\0"]:
                if x not in known:
                    known[x] = self._direction(x)
                v += known[x]
            out.append((v / np.linalg.norm(v)).astype(np.float32).tolist())
        return out


class LetterEmbedder:
    """A stand-in that SQL can follow: how often each of the first `dim` small Latin letters stands in a text, plus one."""

    def __init__(self, dim: int = 16, metric: str = "cosine"):
        self.dim, self.metric, self.fingerprint = dim, metric, f"letters-{dim}-v1"
        self.letters = "abcdefghijklmnopqrstuvwxyz"[:dim]

    def embed(self, texts: Sequence[str], kind: str) -> list[list[float]]:
        return [[float((t or "").count(c) + 1) for c in self.letters] for t in texts]


def _embed(batches: Iterator[pd.DataFrame], embedder: Embedder, kind: str, key: str) -> Iterator[pd.DataFrame]:
    for rows in batches:
        made = embedder.embed(rows["text"].fillna("").tolist(), kind)
        if len(made) != len(rows) or any(len(v) != embedder.dim or not np.isfinite(v).all() for v in made):
            raise ModelError("the embedder gave vectors of another number or width, or not finite")
        yield pd.DataFrame({key: rows[key], "vector": [[float(x) for x in v] for v in made]})


def embed(rows: DataFrame, embedder: Embedder, kind: str = "passage", key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, vector): one vector for each text, in batches that do not change the values."""
    kinds = dict(rows.dtypes)
    return rows.select(key, F.col(text).alias("text")).mapInPandas(partial(_embed, embedder=embedder, kind=kind, key=key), f"{key} {kinds[key]}, vector array<float>")
