"""Vectors: eight-bit codes, scores and exact nearest-neighbour scans."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from sieveline.errors import DimensionMismatch, InvalidQuery
from sieveline.operators.scan import Best, answers, number_slabs, pack, unpack

METRICS = ("cosine", "dot", "euclidean")
TINY = 2.0**-126
#: Queries that meet a slab at once; rows of a slab, at most and at least, and its numbers.
QUERY_BLOCK, SLAB_ROWS, SLAB_LEAST, SLAB_NUMBERS = 256, 16_384, 256, 1 << 22
#: Whole numbers up to here are exact in single precision.
EXACT_SINGLE = 1 << 24


def _folded(values: Column, step) -> Column:
    return F.aggregate(values, F.lit(0.0), step)


def dot(a: Column, b: Column) -> Column:
    return _folded(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(_folded(a, lambda s, x: s + x.cast("double") * x.cast("double")))


def similarity(metric: str, a: Column, b: Column) -> Column:
    """The higher the nearer: cosine, dot, or the negative distance."""
    if metric == "dot":
        return dot(a, b)
    if metric == "cosine":
        return dot(a, b) / (norm(a) * norm(b))
    if metric == "euclidean":
        return -F.sqrt(_folded(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), lambda s, x: s + x))
    raise InvalidQuery(f"unknown metric {metric!r}")


def scale_of(vector: Column) -> Column:
    """The step of the codes: a 127th of the largest magnitude, 1 for a vector of zeros."""
    peak = F.array_max(F.transform(vector, lambda x: F.abs(x)))
    return F.when(peak == 0, F.lit(1.0).cast("float")).otherwise(F.greatest((peak.cast("double") / 127).cast("float"), F.lit(TINY).cast("float")))


def codes_of(vector: Column, scale: Column) -> Column:
    def code(x: Column) -> Column:
        step = F.round((x.cast("double") / scale.cast("double")).cast("float").cast("double"))  # half away from zero
        return F.least(F.greatest(step, F.lit(-127.0)), F.lit(127.0)).cast("tinyint")

    return F.transform(vector, code)


def quantise(rows: DataFrame, vector: str = "vector") -> DataFrame:
    """rows with codes (array<tinyint>), scale and norm (float) of a vector."""
    made = rows.withColumn("scale", scale_of(F.col(vector))).withColumn("codes", codes_of(F.col(vector), F.col("scale")))
    return made.withColumn("norm", stored_norm(F.col("codes"), F.col("scale")))


def stored_norm(codes: Column, scale: Column) -> Column:
    square = F.aggregate(codes, F.lit(0).cast("long"), lambda s, x: s + x.cast("long") * x.cast("long"))
    return (F.sqrt(square.cast("double")) * scale.cast("double")).cast("float")


def recover(codes: Column, scale: Column) -> Column:
    return F.transform(codes, lambda c: c.cast("float") * scale)


def code_dot(a: Column, b: Column) -> Column:
    """Whole-number product of two code arrays."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("int") * y.cast("int")), F.lit(0).cast("long"), lambda s, x: s + x.cast("long"))


def check_query(vector: Sequence[float], dim: int, metric: str) -> None:
    """Raised even where k is 0."""
    if metric not in METRICS:
        raise InvalidQuery(f"unknown metric {metric!r}")
    if len(vector) != dim:
        raise DimensionMismatch(f"the query has {len(vector)} numbers, the index {dim}")
    if not all(math.isfinite(x) for x in vector):
        raise InvalidQuery("the query holds a number that is not finite")
    if metric == "cosine" and not any(vector):
        raise InvalidQuery("a query of zeros has no direction")


def valid_row(vector: str, dim: int, metric: str) -> Column:
    """Whether a row may enter an index: width, finite numbers, a direction under cosine, a norm that float holds."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists(vector, lambda x: x != 0) if metric == "cosine" else F.lit(True)
    return F.coalesce((F.size(vector) == dim) & finite & some & (norm(F.col(vector)) < 3.4e38), F.lit(False))


def scores(queries: np.ndarray, rows: np.ndarray, metric: str) -> np.ndarray:
    """Similarities in double precision, queries by rows."""
    q, r = queries.astype(np.float64), rows.astype(np.float64)
    if metric == "euclidean":
        # differences one query at a time: exact where products of large numbers would not be
        return np.stack([-np.sqrt(((r - x) ** 2).sum(1)) for x in q]) if len(q) else np.zeros((0, len(r)))
    s = q @ r.T
    return s / (np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(r, axis=1)[None]) if metric == "cosine" else s


def int8_scores(qcodes: np.ndarray, qscale: np.ndarray, qnorm: np.ndarray, codes: np.ndarray, scale: np.ndarray, rnorm: np.ndarray, metric: str, queries: np.ndarray) -> np.ndarray:
    if metric == "euclidean":
        return scores(queries, codes.astype(np.float32) * scale[:, None].astype(np.float32), metric).astype(np.float32).astype(np.float64)
    # products of codes are whole numbers; their sums are exact in single precision as long as they are narrow
    kind = np.float32 if codes.shape[1] * 127 * 127 < EXACT_SINGLE else np.float64
    raw = (qcodes.astype(kind) @ codes.astype(kind).T).astype(np.float64) * qscale[:, None].astype(np.float64) * scale[None].astype(np.float64)
    if metric == "cosine":
        raw = raw / (qnorm[:, None].astype(np.float64) * rnorm[None].astype(np.float64))
    return raw.astype(np.float32).astype(np.float64)


def codes_np(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    v = vectors.astype(np.float32)
    peak = np.abs(v).max(1)
    scale = np.where(peak == 0, np.float32(1), np.maximum((peak.astype(np.float64) / 127).astype(np.float32), np.float32(TINY)))
    x = (v.astype(np.float64) / scale[:, None].astype(np.float64)).astype(np.float32).astype(np.float64)
    codes = np.clip(np.sign(x) * np.floor(np.abs(x) + 0.5), -127, 127).astype(np.int8)
    norms = (np.sqrt((codes.astype(np.int64) ** 2).sum(1).astype(np.float64)) * scale.astype(np.float64)).astype(np.float32)
    return codes, scale.astype(np.float32), norms


def _slabs(batches: Iterator[pa.RecordBatch], dim: int, int8: bool, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Many rows (id, vector) or (id, codes, scale, norm) as one."""
    most, seq = max(SLAB_LEAST, min(SLAB_ROWS, SLAB_NUMBERS // dim)), 0
    pending, size = [], 0

    def made(rows: pa.Table) -> pa.RecordBatch:
        batch = rows.combine_chunks().to_batches()[0]
        ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int8 if int8 else np.float32)
        if len(flat) != len(ids) * dim:
            raise DimensionMismatch(f"rows do not have {dim} numbers each")
        more = [c.to_numpy(zero_copy_only=False).astype(np.float32) for c in batch.columns[2:4]] if int8 else [None, None]
        return pa.RecordBatch.from_arrays([pa.array([seq], pa.int32()), pa.array([pack(ids, flat.reshape(-1, dim), *more)], pa.binary())], schema=schema)

    for batch in batches:
        pending.append(batch)
        size += batch.num_rows
        while size >= most:
            whole = pa.Table.from_batches(pending)
            yield made(whole.slice(0, most))
            pending, size, seq = whole.slice(most).to_batches(), size - most, seq + 1
    if size:
        yield made(pa.Table.from_batches(pending))


def _scan(batches: Iterator[pa.RecordBatch], dim: int, metric: str, k: int, int8: bool, digits: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The k best rows of the slabs that pass by for each query (id, vector)."""
    names, numbers, blocks = [], [], None
    for batch in batches:
        passing = pc.is_valid(batch.column(2)).to_numpy(zero_copy_only=False)
        own = batch.filter(pa.array(~passing))
        if own.num_rows:
            names.append(own.column(0))
            numbers.append(own.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float32))
        for at in np.flatnonzero(passing):
            if not names:
                break
            if blocks is None:
                asked, vectors = pa.concat_arrays(names), np.concatenate(numbers).reshape(-1, dim)
                parts = [vectors[i : i + QUERY_BLOCK] for i in range(0, len(vectors), QUERY_BLOCK)]
                blocks = [(v, codes_np(v) if int8 else None, Best(len(v), k)) for v in parts]
            ids, flat, scale, norms = unpack(batch.column(2)[int(at)].as_py())
            # products of codes are whole numbers, exact in single precision as long as they are narrow
            rough = int8 and metric != "euclidean" and dim * 127 * 127 < EXACT_SINGLE
            turned = np.ascontiguousarray(flat.T, np.float32) if rough else None
            for v, coded, best in blocks:
                if rough:
                    q, r, s = _near(coded, turned, flat, scale, norms, metric, best, digits)
                else:
                    s = int8_scores(*coded, flat, scale, norms, metric, v) if int8 else scores(v, flat, metric)
                    q, r = np.nonzero(~(s < _bound(s, best, 2 * 10.0**-digits)[:, None]))
                    s = s[q, r]
                best.add(q, np.round(s, digits) + 0.0, ids[r])
    for i, (_, _, best) in enumerate(blocks or []):
        best.settle()
        yield pa.RecordBatch.from_arrays([asked.take(pa.array(best.query + i * QUERY_BLOCK)).cast(schema.field(0).type), pa.array(best.doc), pa.array(best.score)], schema=schema)


def _bound(s: np.ndarray, best: Best, slack: float, by_query: np.ndarray | float = 1.0) -> np.ndarray:
    """For each query what a row of s must reach to be among its k best; s times by_query is a score."""
    least, at = (best.least - slack) / by_query, s.shape[1] - best.k
    if (bare := np.isneginf(least)).any() and at > 0:
        least[bare] = np.partition(s[bare], at, axis=1)[:, at] - (slack / by_query + np.zeros(len(s)))[bare]
    return least


def _near(coded: tuple, turned: np.ndarray, codes: np.ndarray, scale: np.ndarray, norms: np.ndarray, metric: str, best: Best, digits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows that may be among the k best by products in single precision, with their exact scores."""
    qcodes, qscale, qnorm = coded
    wide = lambda x: x.astype(np.float64)
    with np.errstate(divide="ignore", invalid="ignore"):
        by_row = (wide(scale) / wide(norms) if metric == "cosine" else wide(scale)).astype(np.float32)
        by_query = wide(qscale) / wide(qnorm) if metric == "cosine" else wide(qscale)
        raw = qcodes.astype(np.float32) @ turned
        raw *= by_row
        # single precision is off by less than a millionth of a score; what is not a number passes
        least = _bound(raw, best, 2 * 10.0**-digits, by_query)
        least = least - 4e-6 * np.where(np.isfinite(least), np.abs(least), 0)
        q, r = np.nonzero(~(raw < least.astype(np.float32)[:, None]))
        exact = np.empty(len(q))
        for at in range(0, len(q), 1 << 18):
            a, b = q[at : at + (1 << 18)], r[at : at + (1 << 18)]
            exact[at : at + (1 << 18)] = np.einsum("ij,ij->i", qcodes[a].astype(np.float32), codes[b].astype(np.float32))
        s = exact * wide(qscale)[q] * wide(scale)[r]
        if metric == "cosine":
            s = s / (wide(qnorm)[q] * wide(norms)[r])
    return q, r, s.astype(np.float32).astype(np.float64)


def knn(vectors: DataFrame, queries: DataFrame | Sequence[tuple[int, Sequence[float]]], k: int, metric: str = "cosine", int8: bool = False, allowed: DataFrame | None = None, digits: int = 9, dim: int | None = None) -> DataFrame:
    """(query_id, doc_id, score, rank): the k best rows for each query, by one scan of all rows.

    vectors: doc_id long and vector array<float>, or with int8 codes, scale and norm. queries: a table (query_id,
    vector) of any size, each query_id once, or a short list. Rows are packed into slabs, and slabs and queries meet in a
    grid of tasks, each of which keeps k rows for each of its queries; only these are shuffled. Equal vectors are looked
    up once. allowed: only these doc_ids take part.
    Order: score, rounded to `digits`, from high to low, -0.0 as 0.0, then the smaller id.
    """
    spark = vectors.sparkSession
    if not isinstance(queries, DataFrame):
        dim = dim or (len(queries[0][1]) if queries else 0)
        for _, v in queries:
            check_query(v, dim, metric)
        queries = spark.createDataFrame([(int(q), [float(x) for x in v]) for q, v in queries], "query_id long, vector array<float>")
    else:
        if dim is None:
            first = queries.select("vector").first()
            dim = len(first[0]) if first else 0
        good = F.size("vector") == dim
        good = good & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        if metric == "cosine":
            good = good & F.exists("vector", lambda x: x != 0)
        if (bad := queries.where(~F.coalesce(good, F.lit(False))).select("vector").first()) is not None:
            check_query([float("nan") if x is None else x for x in bad[0] or []], dim, metric)
    kind = dict(queries.dtypes)["query_id"]
    if not dim or k <= 0:
        return spark.createDataFrame([], f"query_id {kind}, doc_id long, score double, rank int")
    if allowed is not None:
        vectors = vectors.join(allowed.select("doc_id"), "doc_id", "left_semi")
    rows = vectors.select(F.col("doc_id").cast("long").alias("doc_id"), *(["codes", "scale", "norm"] if int8 else [F.col("vector").cast("array<float>").alias("vector")]))
    ddl = "seq int, payload binary"
    slabs = number_slabs(rows.mapInArrow(partial(_slabs, dim=dim, int8=int8, schema=to_arrow_schema(StructType.fromDDL(ddl))), ddl), "vector-slabs")
    asked = queries.select("query_id", F.col("vector").cast("array<float>").alias("vector"))
    return answers(asked, slabs, k, partial(_scan, dim=dim, metric=metric, k=k, int8=int8, digits=digits))


def vector_of(index: DataFrame, doc_id: int) -> list[float] | None:
    """The recovered vector of a row."""
    row = index.where(F.col("doc_id") == doc_id).select(recover(F.col("codes"), F.col("scale")).alias("v")).first()
    return row["v"] if row else None
