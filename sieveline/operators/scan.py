"""Many queries against many rows: every pair that can score meets once, and k rows are kept for each query.

Rows come packed in slabs, queries as they are. Both are dealt to the cells of a grid; a cell is one task, which takes
its queries in, lets its slabs pass by and returns k rows for each query. Only slabs, queries and these answers are
shuffled, never a row for each pair.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from sieveline.storage import materialise

K1, B = 1.2, 0.75
#: Documents of a slab, and postings after which one made from postings ends.
SLAB_DOCS, SLAB_POSTINGS = 16_384, 2_000_000
#: Slabs, and answers, that a cell takes at most; queries it takes at least, as long as others would be idle.
CELL_SLABS, CELL_ANSWERS, CELL_QUERIES = 64, 2_000_000, 64
#: Lists that hold this share of a slab are added up as whole columns; columns of a slab that are kept at once.
DENSE_SHARE, FULL_LISTS = 16, 400
SLABS = "docs long, sums array<long>, keys array<string>, dfs array<long>, payload binary"
#: Batches of the queries of a cell, and of its slabs.
Kernel = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def pack(*parts: object) -> bytes:
    raw = pickle.dumps(parts, protocol=5)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def unpack(payload: bytes) -> tuple:
    return pickle.loads(pa.decompress(payload[8:], int.from_bytes(payload[:8], "little"), "zstd", asbytes=True))


def rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """Half away from zero, as SQL has it; -0.0 as 0.0."""
    m = 10.0**digits
    return np.copysign(np.floor(np.abs(x) * m + 0.5), x) / m + 0.0


def number_slabs(made: DataFrame, label: str) -> DataFrame:
    """The slabs as a table, with the task each came from."""
    return materialise(made.withColumn("part", F.spark_partition_id()), label)


def grid(asked: DataFrame, slabs: DataFrame, kernel: Kernel, out: str, k: int) -> DataFrame:
    """What kernel returns over all cells. asked: a table with a row for each query; slabs: a table with `part` and `payload`.

    The kernel gets the columns of asked, where payload is null, and then the payloads, where the others are null.
    """
    spark = asked.sparkSession
    questions, count = asked.count(), slabs.count()
    if not questions or not count or k <= 0:
        return spark.createDataFrame([], out)
    tasks = spark.sparkContext.defaultParallelism  # each column more repeats the slabs once more
    across = max(1, min(tasks, math.ceil(questions / CELL_QUERIES)), math.ceil(questions * k / CELL_ANSWERS))
    down = max(1, min(count, max(math.ceil(tasks / across), math.ceil(count / CELL_SLABS))))
    names = asked.columns
    column = F.pmod(F.xxhash64(*names), F.lit(across)).cast("int")
    row = F.pmod(F.col("part") + F.col("seq"), F.lit(down)).cast("int")
    kinds = dict(asked.dtypes)

    def cells(first: Column, step: int, times: int) -> Column:
        return F.explode(F.sequence(first, first + F.lit(step * (times - 1)), F.lit(step))).alias("__cell")

    left = asked.select(cells(column * down, 1, down), *names, F.lit(None).cast("binary").alias("payload"))
    right = slabs.select(cells(row, down, across), *[F.lit(None).cast(kinds[n]).alias(n) for n in names], "payload")
    dealt = left.unionByName(right).withColumn("__kind", F.col("payload").isNotNull()).repartitionById(across * down, F.col("__cell")).sortWithinPartitions("__kind")
    return dealt.select(*names, "payload").mapInArrow(kernel, out)


class Best:
    """The k best (score, doc_id) of each of n queries: higher score, then smaller id. Flat arrays, by query, once settled."""

    def __init__(self, n: int, k: int):
        self.n, self.k = n, k
        self.query, self.score, self.doc = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        #: The score a row must reach; -inf where a query has fewer than k rows.
        self.least = np.full(n, -np.inf)
        self._fresh: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self._waiting = 0

    def add(self, query: np.ndarray, score: np.ndarray, doc: np.ndarray) -> None:
        """Rows wait until there are half as many as are kept: sorting is what costs."""
        if len(query):
            self._fresh.append((query, score, doc))
            self._waiting += len(query)
            if 2 * self._waiting >= len(self.query):
                self.settle()

    def settle(self) -> None:
        if not self._fresh:
            return
        query, score, doc = (np.concatenate(x) for x in zip((self.query, self.score, self.doc), *self._fresh))
        self._fresh, self._waiting = [], 0
        order = np.lexsort((doc, -score, query))
        query = query[order]
        begins = np.searchsorted(query, np.arange(self.n))
        place = np.arange(len(query)) - begins[query]
        stay = place < self.k
        order = order[stay]
        self.query, self.score, self.doc = query[stay], score[order], doc[order]
        last = np.flatnonzero(place[stay] == self.k - 1)
        self.least[self.query[last]] = self.score[last]


# postings


def norm_lengths(length: np.ndarray) -> np.ndarray:
    over = np.maximum(length.astype(np.int64) - 24, 0)
    bits = np.frexp(over.astype(np.float64))[1]
    shift = np.maximum(bits - 4, 0)
    return np.where(length < 40, length, (over >> shift << shift) + 24)


def _smallest(tf: np.ndarray) -> np.ndarray:
    if not np.issubdtype(tf.dtype, np.integer):
        return tf
    most = tf.max(initial=0)
    return tf.astype(np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.int64)


def _slab(seq: int, docs: np.ndarray, sums: Sequence[int], lengths: dict[int, np.ndarray], keys: list[str], starts: np.ndarray, rows: np.ndarray, tf: np.ndarray, kept: np.ndarray | None, schema: pa.Schema) -> pa.RecordBatch:
    """One slab: postings by key, then by row. kept: rows that may be answers; the others count only in dfs."""
    dfs = np.diff(starts)
    if kept is not None and not kept.all():
        stay = kept[rows]
        starts = np.r_[0, np.cumsum(stay)][starts]
        rows, tf = rows[stay], tf[stay]
    payload = pack(docs, lengths, keys, starts, rows.astype(np.uint16 if len(docs) <= 1 << 16 else np.int32), _smallest(tf))
    return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((len(docs), [int(s) for s in sums], keys, dfs.tolist(), payload, seq), schema.types)], schema=schema)


def token_slabs(batches: Iterator[pa.RecordBatch], words: Sequence[Sequence[str] | None], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Slabs of (doc_id, kept, tokens of a field, tokens of the next, ...), one row for each document. words: those that count, by field."""
    wanted, pending, size, seq = [w if w is None else pa.array(w, pa.string()) for w in words], [], 0, 0
    for batch in batches:
        pending.append(batch)
        size += batch.num_rows
        while size >= SLAB_DOCS:
            whole = pa.Table.from_batches(pending).combine_chunks()
            yield _count(whole.slice(0, SLAB_DOCS), wanted, seq, schema)
            pending, size, seq = whole.slice(SLAB_DOCS).to_batches(), size - SLAB_DOCS, seq + 1
    if size:
        yield _count(pa.Table.from_batches(pending), wanted, seq, schema)


def _count(docs: pa.Table, wanted: Sequence[pa.Array | None], seq: int, schema: pa.Schema) -> pa.RecordBatch:
    docs = docs.combine_chunks().to_batches()[0]
    ids = docs.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
    order = np.argsort(ids, kind="stable")
    place = np.empty(len(ids), np.int64)
    place[order] = np.arange(len(ids))
    keys, starts, rows, tfs, lengths, sums, before = [], [np.zeros(1, np.int64)], [], [], {}, [], 0
    for i, words in enumerate(wanted):
        tokens = docs.column(2 + i)
        size = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        lengths[i] = size[order].astype(np.int32)
        sums.append(size.sum())
        coded = tokens.flatten().dictionary_encode()
        code, row = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.repeat(place, size)
        if words is not None:
            there = pc.is_in(coded.dictionary, value_set=words).to_numpy(zero_copy_only=False).astype(bool)
            code, row = code[there[code]], row[there[code]]
        both, tf = np.unique(code * len(ids) + row, return_counts=True)
        code = both // len(ids)
        said, first = np.unique(code, return_index=True)
        keys += [f"{i}:{t}" for t in coded.dictionary.take(pa.array(said)).to_pylist()]
        starts.append(before + np.r_[first[1:], len(code)][: len(said)])
        rows.append(both % len(ids))
        tfs.append(tf)
        before += len(both)
    starts = np.concatenate(starts)
    kept = docs.column(1).to_numpy(zero_copy_only=False).astype(bool)[order]
    return _slab(seq, ids[order], sums, lengths, keys, starts, np.concatenate(rows), np.concatenate(tfs), kept, schema)


def posting_slabs(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Slabs of (doc_id, kept, key, tf, length) sorted by doc_id; no document is in two slabs."""
    pending, size, seq = [], 0, 0
    for batch in batches:
        pending.append(batch)
        size += batch.num_rows
        if size >= SLAB_POSTINGS:
            whole = pa.Table.from_batches(pending)
            ids = whole.column(0).to_numpy().astype(np.int64)
            end = int(np.searchsorted(ids, ids[-1]))
            for low, high in _ranges(ids[:end]):
                yield _gather(*_arrays(whole.slice(low, high - low)), seq, schema)
                seq += 1
            pending, size = whole.slice(end).to_batches(), len(ids) - end
    if size:
        whole = pa.Table.from_batches(pending)
        for low, high in _ranges(whole.column(0).to_numpy().astype(np.int64)):
            yield _gather(*_arrays(whole.slice(low, high - low)), seq, schema)
            seq += 1


def posting_parts(batches: Iterator[pa.RecordBatch], buckets: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """(bucket, payload) of (doc_id, kept, key, tf, length) in any order: many postings of a bucket of documents as one row."""
    pending, size = [], 0

    def made() -> Iterator[pa.RecordBatch]:
        ids, kept, keys, code, tf, length = _arrays(pa.Table.from_batches(pending))
        bucket = ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % buckets
        order = np.lexsort((ids, code, bucket))
        ends = np.searchsorted(bucket[order], np.arange(buckets + 1))
        for i in range(buckets):
            if len(own := order[ends[i] : ends[i + 1]]):
                said, own_code = np.unique(code[own], return_inverse=True)
                packed = pack(ids[own], kept[own], [keys[c] for c in said], _smallest(own_code), _smallest(tf[own]), length[own])
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([packed], pa.binary())], schema=schema)

    for batch in batches:
        pending.append(batch)
        size += batch.num_rows
        if size >= SLAB_POSTINGS:
            yield from made()
            pending, size = [], 0
    if size:
        yield from made()


def part_slabs(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """One slab for each bucket of (bucket, payload) sorted by bucket."""
    parts, now, seq = [], None, 0

    def made() -> pa.RecordBatch:
        numbers: dict[str, int] = {}
        codes = [np.array([numbers.setdefault(x, len(numbers)) for x in keys], np.int64)[code] for _, _, keys, code, _, _ in parts]
        ids, kept, tf, length = (np.concatenate([p[i] for p in parts]) for i in (0, 1, 4, 5))
        return _gather(ids, kept, list(numbers), np.concatenate(codes), tf, length, seq, schema)

    for batch in batches:
        for at in range(batch.num_rows):
            bucket = batch.column(0)[at].as_py()
            if parts and bucket != now:
                yield made()
                parts, seq = [], seq + 1
            now = bucket
            parts.append(unpack(batch.column(1)[at].as_py()))
    if parts:
        yield made()


def _ranges(ids: np.ndarray) -> list[tuple[int, int]]:
    """Stretches of sorted ids with SLAB_DOCS documents each."""
    begins = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])[::SLAB_DOCS] if len(ids) else np.zeros(0, int)
    return list(zip(begins.tolist(), [*begins[1:].tolist(), len(ids)]))


def _arrays(said: pa.Table) -> tuple[np.ndarray, np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
    """ids, kept, keys, codes of keys, tf and length of (doc_id, kept, key, tf, length)."""
    said = said.combine_chunks()
    coded = said.column(2).chunk(0).dictionary_encode()
    return said.column(0).to_numpy().astype(np.int64), said.column(1).to_numpy(), coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False), said.column(3).to_numpy(), said.column(4).to_numpy()


def _gather(said: np.ndarray, may: np.ndarray, keys: list[str], code: np.ndarray, tf: np.ndarray, length: np.ndarray, seq: int, schema: pa.Schema) -> pa.RecordBatch:
    ids, row = np.unique(said, return_inverse=True)
    kept = np.zeros(len(ids), bool)
    kept[row] = may
    field = np.array([int(x.partition(":")[0]) for x in keys])
    lengths = {}
    for f in np.unique(field):
        own = field[code] == f
        lengths[int(f)] = np.zeros(len(ids), length.dtype)
        lengths[int(f)][row[own]] = length[own]
    order = np.lexsort((row, code))
    starts = np.r_[0, np.cumsum(np.bincount(code, minlength=len(keys)))]
    return _slab(seq, ids, [], lengths, keys, starts, row[order], tf[order], kept, schema)


def lexical_kernel(batches: Iterator[pa.RecordBatch], k: int, digits: int, averages: dict[int, float], quantise: bool, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The k best of each query (bag_id, keys, weights) among the documents that have one of its keys."""
    names: list[pa.Array] = []
    keys: list[pa.Array] = []
    weights: list[np.ndarray] = []
    sizes: list[np.ndarray] = []
    best = None
    for batch in batches:
        slab_rows = pc.is_valid(batch.column(3)).to_numpy(zero_copy_only=False)
        own = batch.filter(pa.array(~slab_rows))
        if own.num_rows:
            names.append(own.column(0))
            keys.append(own.column(1).flatten())
            weights.append(own.column(2).flatten().to_numpy(zero_copy_only=False))
            sizes.append(pc.list_value_length(own.column(1)).to_numpy(zero_copy_only=False))
        for at in np.flatnonzero(slab_rows):
            if not names:
                break
            if best is None:
                bags = pa.concat_arrays(names)
                coded = pa.concat_arrays(keys).dictionary_encode()
                code, weight = coded.indices.to_numpy(zero_copy_only=False), np.concatenate(weights)
                ends = np.cumsum(np.concatenate(sizes))
                best = Best(len(bags), k)
            best.add(*_meet(unpack(batch.column(3)[int(at)].as_py()), coded.dictionary, code, weight, ends, best, digits, averages, quantise))
    if best is not None:
        best.settle()
        step = 100_000
        for at in range(0, len(best.query), step):
            q = best.query[at : at + step]
            yield pa.RecordBatch.from_arrays([bags.take(pa.array(q)).cast(schema.field(0).type), pa.array(best.doc[at : at + step]), pa.array(best.score[at : at + step])], schema=schema)


def _meet(slab: tuple, vocabulary: pa.Array, code: np.ndarray, weight: np.ndarray, ends: np.ndarray, best: Best, digits: int, averages: dict[int, float], quantise: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    docs, lengths, keys, starts, rows, tf = slab
    n, k, step = len(docs), best.k, 10.0**-digits
    if not len(rows):
        return np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
    at = pc.fill_null(pc.index_in(vocabulary, value_set=pa.array(keys, pa.string())), -1).to_numpy(zero_copy_only=False)
    rows = rows.astype(np.int64)
    # the share of a posting that does not depend on the query
    field = np.array([int(x.partition(":")[0]) for x in keys])
    share = {f: K1 * (1 - B + B * (norm_lengths(v) if quantise else v) / averages[f]) for f, v in lengths.items()}
    part = tf.astype(np.float64)
    for f, v in share.items():
        for a, b in _stretches(field == f, starts):
            part[a:b] = part[a:b] / (part[a:b] + v[rows[a:b]])
    counts, peaks = np.diff(starts), np.zeros(len(keys) + 1)
    held = np.flatnonzero(counts)
    peaks[held] = np.maximum.reduceat(part, starts[held])
    full: dict[int, np.ndarray] = {}
    total, line, mark = np.zeros(n), np.empty(n), np.zeros(n, bool)
    found_q, found_s, found_r = [], [], []
    begin = 0
    most = (weight * peaks[at[code]]).tolist()
    codes, weights, positive = at[code].tolist(), weight.tolist(), bool((weight > 0).all())

    def column(t: int) -> np.ndarray:
        if t not in full:
            if len(full) >= FULL_LISTS:
                full.clear()
            full[t] = np.zeros(n)
            full[t][rows[starts[t] : starts[t + 1]]] = part[starts[t] : starts[t + 1]]
        return full[t]

    for bag, end in enumerate(ends.tolist()):
        terms = [i for i in range(begin, end) if codes[i] >= 0 and counts[codes[i]]]
        begin = end
        if not terms:
            continue
        least, extra = best.least[bag] - step, set()
        if positive and least > 0:
            # documents that only have such of the terms as can not reach that score together need no look
            reach = 0.0
            for i in sorted(terms, key=most.__getitem__):
                reach += most[i]
                if reach >= least * (1 - 1e-9):
                    break
                extra.add(i)
            if len(extra) == len(terms):
                continue
        main = [codes[i] for i in terms if i not in extra]
        # sums go by the order of the terms, so that documents alike have the same score wherever they stand
        if positive and sum(int(counts[t]) for t in main) * DENSE_SHARE >= n:
            np.multiply(column(codes[terms[0]]), weights[terms[0]], out=total)
            for i in terms[1:]:
                np.multiply(column(codes[i]), weights[i], out=line)
                np.add(total, line, out=total)
            hit = np.flatnonzero(total >= least if least > 0 else total > 0)
            s = total[hit]
        else:
            if len(main) == 1:
                hit = rows[starts[main[0]] : starts[main[0] + 1]]
            else:
                for t in main:
                    mark[rows[starts[t] : starts[t + 1]]] = True
                hit = np.flatnonzero(mark)
                mark[hit] = False
            if len(terms) == 1:
                s = weights[terms[0]] * part[starts[main[0]] : starts[main[0] + 1]]
            else:
                total[hit] = 0.0
                for i in terms:
                    t = codes[i]
                    if i in extra:
                        total[hit] += weights[i] * column(t)[hit]
                    else:
                        total[rows[starts[t] : starts[t + 1]]] += weights[i] * part[starts[t] : starts[t + 1]]
                s = total[hit]
            if least > -np.inf:
                good = np.flatnonzero(s >= least)
                hit, s = hit[good], s[good]
        if not len(hit):
            continue
        if len(hit) > k:
            # those that may be among the k best once rounded
            low = np.partition(s, len(s) - k)[len(s) - k] - step
            good = np.flatnonzero(s >= low)
            hit, s = hit[good], rounded(s[good], digits)
            if len(hit) > k:
                edge = np.partition(s, len(s) - k)[len(s) - k]
                above = np.flatnonzero(s > edge)
                same = np.flatnonzero(s == edge)[: k - len(above)]  # rows go by doc_id
                pick = np.r_[above, same]
                hit, s = hit[pick], s[pick]
        else:
            s = rounded(s, digits)
        found_q.append(np.full(len(hit), bag))
        found_s.append(s)
        found_r.append(hit)
    if not found_q:
        return np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
    return np.concatenate(found_q), np.concatenate(found_s), docs[np.concatenate(found_r)]


def _stretches(own: np.ndarray, starts: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of postings of the keys marked: neighbours as one."""
    edge = np.diff(np.r_[0, own.astype(np.int8), 0])
    return [(int(starts[a]), int(starts[b])) for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1))]


def best_documents(wanted: DataFrame, slabs: DataFrame, k: int, digits: int, averages: dict[int, float], quantise: bool) -> DataFrame:
    """(query_id, doc_id, score, rank) of (query_id, key, weight)."""
    each = wanted.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("key", "weight"))).alias("bag")).select("query_id", F.col("bag.key").alias("keys"), F.col("bag.weight").alias("weights"))
    return answers(each, slabs, k, partial(lexical_kernel, k=k, digits=digits, averages=averages, quantise=quantise))


def answers(asked: DataFrame, slabs: DataFrame, k: int, kernel: Callable) -> DataFrame:
    """(query_id, doc_id, score, rank): the k best that kernel finds for each row of asked; query_id is unique in it.

    Queries that are alike in all other columns are looked up once, and share the answers.
    """
    kind, what = dict(asked.dtypes)["query_id"], [c for c in asked.columns if c != "query_id"]
    members = materialise(asked.withColumn("bag_id", F.min("query_id").over(Window.partitionBy(*what))), "bags")
    bags = members.where(F.col("query_id").eqNullSafe(F.col("bag_id"))).select("bag_id", *what)
    out = f"bag_id {kind}, doc_id long, score double"
    found = grid(bags, slabs, partial(kernel, schema=to_arrow_schema(StructType.fromDDL(out))), out, k)
    rank = F.row_number().over(Window.partitionBy("bag_id").orderBy(F.desc("score"), F.asc("doc_id")))
    top = found.withColumn("rank", rank).where(F.col("rank") <= k).withColumnRenamed("bag_id", "found_id")
    own = members.select("query_id", "bag_id")
    return top.join(own, F.col("found_id").eqNullSafe(F.col("bag_id"))).select("query_id", "doc_id", "score", "rank")


def slab_schema() -> tuple[str, pa.Schema]:
    ddl = SLABS + ", seq int"
    return ddl, to_arrow_schema(StructType.fromDDL(ddl))


def slabs_of(rows: DataFrame, maker: Callable, label: str, **more: object) -> DataFrame:
    ddl, schema = slab_schema()
    return number_slabs(rows.mapInArrow(partial(maker, schema=schema, **more), ddl), label)


def slabs_by_document(rows: DataFrame, docs: int) -> DataFrame:
    """Slabs of (doc_id, kept, key, tf, length), rows of a document anywhere: what is exchanged are packed parts. docs: about how many there are."""
    ddl = "bucket int, payload binary"
    buckets = max(1, math.ceil(docs / (SLAB_DOCS * 3 // 4)))
    parts = rows.mapInArrow(partial(posting_parts, buckets=buckets, schema=to_arrow_schema(StructType.fromDDL(ddl))), ddl)
    tasks = min(buckets, 2 * rows.sparkSession.sparkContext.defaultParallelism)
    return slabs_of(parts.repartitionById(tasks, F.pmod("bucket", F.lit(tasks))).sortWithinPartitions("bucket"), part_slabs, "slabs")


def frequencies(slabs: DataFrame) -> DataFrame:
    """(key, df) over all slabs."""
    return slabs.select(F.explode(F.arrays_zip("keys", "dfs")).alias("x")).groupBy("x.keys").agg(F.sum("x.dfs").alias("df")).withColumnRenamed("keys", "key")
