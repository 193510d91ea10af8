"""Fields, schemas and configurations, checked before anything runs."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import types as T

from sieveline.errors import SchemaError, UnknownField
from sieveline.functions.analysis import ANALYZERS

#: Kinds of fields and the Spark types that hold them. date_millis is a number of milliseconds.
KINDS: dict[str, T.DataType] = {
    "text": T.StringType(), "keyword": T.StringType(), "u64": T.DecimalType(20, 0), "i64": T.LongType(),
    "f64": T.DoubleType(), "bool": T.BooleanType(), "date_millis": T.LongType(),
}
RESERVED, SPARSE_FIELD = "__sv_", "_sparse"


@dataclass(frozen=True)
class FieldDef:
    name: str
    kind: str
    indexed: bool = True
    stored: bool = True
    boost: float = 1.0
    analyzer: str = "standard"


@dataclass(frozen=True)
class Schema:
    fields: tuple[FieldDef, ...]

    def __post_init__(self):
        seen: set[str] = set()
        for f in self.fields:
            if not f.name or f.name in seen:
                raise SchemaError(f"field {f.name!r} is empty or named twice")
            if f.name.startswith(RESERVED) or f.name == SPARSE_FIELD:
                raise SchemaError(f"field name {f.name!r} is reserved")
            if f.kind not in KINDS:
                raise SchemaError(f"field {f.name!r} has unknown kind {f.kind!r}")
            if f.boost != 1.0 and f.kind != "text":
                raise SchemaError(f"only text fields take a boost, not {f.name!r}")
            if not math.isfinite(f.boost):
                raise SchemaError(f"the boost of {f.name!r} is not finite")
            if f.kind == "text" and f.analyzer not in ANALYZERS:
                raise SchemaError(f"unknown analyzer {f.analyzer!r}")
            seen.add(f.name)

    def __getitem__(self, name: str) -> FieldDef:
        for f in self.fields:
            if f.name == name:
                return f
        raise UnknownField(name)

    @property
    def text_fields(self) -> list[FieldDef]:
        return [f for f in self.fields if f.kind == "text" and f.indexed]

    def struct(self) -> T.StructType:
        return T.StructType([T.StructField(f.name, KINDS[f.kind], True, {"kind": f.kind, "indexed": f.indexed, "stored": f.stored, "boost": f.boost, "analyzer": f.analyzer}) for f in self.fields])

    def as_json(self) -> list[dict]:
        return [vars(f) for f in self.fields]

    @classmethod
    def from_json(cls, rows: Sequence[dict]) -> Schema:
        return cls(tuple(FieldDef(**r) for r in rows))


@dataclass(frozen=True)
class RerankMode:
    """alpha None: the re-ranker's order replaces the head; else both are interpolated."""

    alpha: float | None = 0.5

    def __post_init__(self):
        if self.alpha is not None and not (math.isfinite(self.alpha) and 0 <= self.alpha <= 1):
            raise SchemaError("alpha must be a number from 0 to 1")


@dataclass(frozen=True)
class SparseConfig:
    scale: int = 10
    boost: float = 1.0

    def __post_init__(self):
        if not 1 <= self.scale <= 1000 or not (math.isfinite(self.boost) and self.boost > 0):
            raise SchemaError("the sparse scale goes from 1 to 1000 and the boost is above 0")


@dataclass(frozen=True)
class HybridConfig:
    schema: Schema
    dense_fields: tuple[str, ...]
    candidate_depth: int = 100
    rrf_k: int = 60
    rerank_depth: int = 20
    rerank_mode: RerankMode = field(default_factory=RerankMode)
    compact_dead_share: float | None = None
    sparse: SparseConfig | None = None

    def __post_init__(self):
        if not self.dense_fields or any(self.schema[f].kind != "text" for f in self.dense_fields):
            raise SchemaError("dense_fields needs one text field at least, and only text fields")
        if self.candidate_depth < 1 or self.rrf_k < 1 or self.rerank_depth < 0:
            raise SchemaError("candidate_depth and rrf_k are 1 at least, rerank_depth 0 at least")
        if self.compact_dead_share is not None and not 0 <= self.compact_dead_share <= 1:
            raise SchemaError("compact_dead_share goes from 0 to 1")
