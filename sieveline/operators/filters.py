"""Metadata filters as a tree that becomes one boolean column, never null."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass
from decimal import Decimal
from functools import reduce
from operator import and_, or_
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.errors import InvalidQuery
from sieveline.operators.schema import FieldDef, Schema
from sieveline.storage import is_small

_EPOCH = dt.datetime(1970, 1, 1)
#: Ids up to which an id filter is written into the plan.
INLINE_IDS = 1000


class Filter:
    def column(self, schema: Schema) -> Column:
        raise NotImplementedError

    def __and__(self, other: Filter) -> Filter:
        return And([self, other])

    def __or__(self, other: Filter) -> Filter:
        return Or([self, other])

    def __invert__(self) -> Filter:
        return Not(self)


def millis(value: Any) -> int:
    """Milliseconds since 1970 of a number or a time without zone."""
    if isinstance(value, dt.datetime):
        return (value.replace(tzinfo=None) - _EPOCH) // dt.timedelta(milliseconds=1)
    return value


def _checked(schema: Schema, name: str, values: Sequence[Any], refused: tuple[str, ...] = ()) -> tuple[FieldDef, list]:
    field = schema[name]
    if not field.indexed:
        raise InvalidQuery(f"field {name!r} is not indexed")
    if field.kind in refused:
        raise InvalidQuery(f"a {field.kind} field does not take this filter: {name!r}")
    if field.kind == "date_millis":
        values = [millis(v) for v in values]
    kinds = {"keyword": (str,), "text": (str,), "u64": (int, Decimal), "i64": (int,), "f64": (float, int), "bool": (bool,), "date_millis": (int,)}[field.kind]
    for v in values:
        if not isinstance(v, kinds) or (isinstance(v, bool) and field.kind != "bool"):
            raise InvalidQuery(f"{v!r} is no {field.kind} for field {name!r}")
        if field.kind == "u64" and not 0 <= v < 2**64:
            raise InvalidQuery(f"{v!r} is no u64")
    return field, list(values)


def _there(column: Column, condition: Column) -> Column:
    """The condition where the column is not null, else false: never null, and in a form that reaches the scan."""
    return column.isNotNull() & condition


@dataclass(frozen=True)
class Eq(Filter):
    field: str
    value: Any

    def column(self, schema: Schema) -> Column:
        _, (value,) = _checked(schema, self.field, [self.value], ("text",))
        return _there(F.col(self.field), F.col(self.field) == F.lit(value))


@dataclass(frozen=True)
class In(Filter):
    field: str
    values: Sequence[Any]

    def column(self, schema: Schema) -> Column:
        _, values = _checked(schema, self.field, self.values, ("text",))
        return _there(F.col(self.field), F.col(self.field).isin(values)) if values else F.lit(False)


@dataclass(frozen=True)
class Range(Filter):
    """Both ends belong to it; without any end it is Exists."""

    field: str
    low: Any = None
    high: Any = None

    def column(self, schema: Schema) -> Column:
        ends = [e for e in (self.low, self.high) if e is not None]
        if not ends:
            return Exists(self.field).column(schema)
        _checked(schema, self.field, ends, ("text", "bool"))
        low, high = (millis(e) if schema[self.field].kind == "date_millis" and e is not None else e for e in (self.low, self.high))
        column, inside = F.col(self.field), F.lit(True)
        if low is not None:
            inside = inside & (column >= F.lit(low))
        if high is not None:
            inside = inside & (column <= F.lit(high))
        return _there(column, inside)


@dataclass(frozen=True)
class Exists(Filter):
    """The field is there; an empty text is."""

    field: str

    def column(self, schema: Schema) -> Column:
        _checked(schema, self.field, [])
        return F.col(self.field).isNotNull()


@dataclass(frozen=True)
class And(Filter):
    parts: Sequence[Filter]

    def column(self, schema: Schema) -> Column:
        return reduce(and_, [p.column(schema) for p in self.parts], F.lit(True))


@dataclass(frozen=True)
class Or(Filter):
    parts: Sequence[Filter]

    def column(self, schema: Schema) -> Column:
        return reduce(or_, [p.column(schema) for p in self.parts], F.lit(False))


@dataclass(frozen=True)
class Not(Filter):
    part: Filter

    def column(self, schema: Schema) -> Column:
        return ~self.part.column(schema)


@dataclass(frozen=True)
class Ids(Filter):
    """Unknown ids drop out."""

    ids: Sequence[int]

    def column(self, schema: Schema) -> Column:
        return F.col("doc_id").isin([int(i) for i in self.ids]) if self.ids else F.lit(False)


def apply_filter(docs: DataFrame, schema: Schema, condition: Filter | None) -> DataFrame:
    """The documents a filter keeps. A long list of ids becomes a join instead of a literal."""
    if condition is None:
        return docs
    if isinstance(condition, Ids) and len(condition.ids) > INLINE_IDS:
        ids = docs.sparkSession.createDataFrame([(int(i),) for i in set(condition.ids)], "doc_id long")
        return docs.join(F.broadcast(ids) if is_small(ids) else ids, "doc_id", "left_semi")
    return docs.where(condition.column(schema))


def resolve(docs: DataFrame, schema: Schema, condition: Filter | None) -> DataFrame:
    """The set of ids a filter keeps: one column, doc_id."""
    return apply_filter(docs, schema, condition).select("doc_id")


class DocSet:
    """A set of document ids as a table."""

    def __init__(self, ids: DataFrame):
        self.ids = ids.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct()

    def intersection(self, other: DocSet) -> DocSet:
        return DocSet(self.ids.intersect(other.ids))

    def union(self, other: DocSet) -> DocSet:
        return DocSet(self.ids.union(other.ids))

    def difference(self, other: DocSet) -> DocSet:
        return DocSet(self.ids.join(other.ids, "doc_id", "left_anti"))

    def contains(self, doc_id: int) -> bool:
        return not self.ids.where(F.col("doc_id") == doc_id).isEmpty()

    def __len__(self) -> int:
        return self.ids.count()

    def ascending(self) -> DataFrame:
        return self.ids.orderBy("doc_id")
