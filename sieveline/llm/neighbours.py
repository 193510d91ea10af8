"""The most similar vectors of every vector: one small-world graph per shard, answers of the shards merged."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from sieveline.llm.hnsw import Graph
from sieveline.storage import attach, materialise

#: Vectors the centres of the shards are fitted on; the index holds every vector all the same.
SAMPLE_ROWS = 40_000
#: So many vectors make one shard. Beyond, a shard has SHARD_ROOT times the root of their number on average, so that shards
#: grow in number as in size, up to SHARD_NUMBERS numbers on average, and at most twice that (larger ones are parted by a hash).
FEW_ROWS, SHARD_ROOT, SHARD_NUMBERS = 2_000, 10.0, 6_400_000
#: Shards each vector is looked up in at most, and how much farther than the nearest they may be.
PROBES, MARGIN = 8, 0.25
#: Vectors looked up by one task, and parts of a shuffle at most.
CHUNK_ROWS, MOST_TASKS = 100_000, 4_096
#: Numbers of the vectors that are scored again at once.
NUMBERS_AT_ONCE = 4_000_000


def live_vectors(steps: DataFrame, dim: int) -> DataFrame:
    """(id, vector) after the last step of a script with step_no, op, id, vector.

    An id is live when its last add or delete is an add; op counts in any case and without blanks around it.
    Steps delivered twice count once. Vectors that are null, of another width than dim, all zero, or hold null,
    NaN or infinity are similar to none and left out.
    """
    op = F.lower(F.trim("op"))
    last = steps.where(op.isin("add", "delete") & F.col("id").isNotNull()).groupBy("id").agg(F.max_by(F.struct(op.alias("op"), "vector"), "step_no").alias("last"))
    live = last.where(F.col("last.op") == "add").select("id", F.col("last.vector").cast("array<float>").alias("vector"))
    return live.where(usable("vector", dim))


def usable(column: str, dim: int):
    finite = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(column) == dim) & finite & F.exists(column, lambda x: x != 0), F.lit(False))


def _units(vectors: np.ndarray) -> np.ndarray:
    wide = vectors.astype(np.float64)
    wide /= np.abs(wide).max(1, keepdims=True)
    return wide / np.linalg.norm(wide, axis=1, keepdims=True)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, dim)


def fit_centres(sample: np.ndarray, shards: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Centres of spherical k-means."""
    rng = np.random.default_rng(seed)
    centres = sample[rng.choice(len(sample), min(shards, len(sample)), replace=False)]
    for _ in range(rounds):
        own = (sample @ centres.T).argmax(1)
        by = np.argsort(own, kind="stable")
        begins = np.flatnonzero(np.r_[True, np.diff(own[by]) > 0])
        sums = np.add.reduceat(sample[by], begins, axis=0)
        norms = np.linalg.norm(sums, axis=1)
        good = norms > 1e-6
        centres[own[by][begins][good]] = sums[good] / norms[good, None]
    return centres


def _packed(vectors: np.ndarray) -> pa.Array:
    """The rows of a matrix of single floats as binary values."""
    flat = np.ascontiguousarray(vectors, np.float32)
    ends = np.arange(len(flat) + 1, dtype=np.int32) * (flat.shape[1] * 4)
    return pa.Array.from_buffers(pa.binary(), len(flat), [None, pa.py_buffer(ends), pa.py_buffer(flat)])


def _unpacked(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, dim)


def _lists(flat: np.ndarray, times: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(times)].astype(np.int32)), pa.array(flat))


@dataclass(frozen=True)
class Cells:
    """Shards by their centres, each parted into `parts` cells by a hash of the id; cells are numbered through."""

    centres: np.ndarray
    parts: np.ndarray
    probes: int
    margin: float

    def near(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Shards from near to far, and which of them are looked at: those about as near as the nearest."""
        sims = _units(vectors).astype(np.float32) @ self.centres.T
        most = min(self.probes, sims.shape[1])
        first = np.argpartition(-sims, most - 1, axis=1)[:, :most]
        own = np.take_along_axis(sims, first, 1)
        by = np.argsort(-own, axis=1, kind="stable")
        first, own = np.take_along_axis(first, by, 1), np.take_along_axis(own, by, 1)
        return first, own >= own[:, :1] - self.margin

    def route(self, ids: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, pa.Array]:
        """The cell each vector lives in, and the other cells it is looked up in."""
        starts = np.r_[0, np.cumsum(self.parts)]
        shards, looked = self.near(vectors)
        spread = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
        home = starts[shards[:, 0]] + (spread % self.parts[shards[:, 0]].astype(np.uint64)).astype(np.int64)
        if self.parts.max() == 1:
            others = looked.copy()
            others[:, 0] = False
            return home, _lists(shards[others].astype(np.int32), others.sum(1))
        lists = [[c for s in shard[look] for c in range(starts[s], starts[s + 1]) if c != h] for shard, look, h in zip(shards, looked, home)]
        return home, pa.array(lists, pa.list_(pa.int32()))


def _count_homes(batches: Iterator[pa.RecordBatch], cells: Cells, dim: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            shards, _ = cells.near(_matrix(batch.column(1), dim))
            kinds, times = np.unique(shards[:, 0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(times, pa.int64())], schema=schema)


def _route(batches: Iterator[pa.RecordBatch], cells: Cells, dim: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            vectors = _matrix(batch.column(1), dim)
            home, others = cells.route(batch.column(0).to_numpy(zero_copy_only=False), vectors)
            yield pa.RecordBatch.from_arrays([pa.array(home, pa.int32()), batch.column(0), batch.column(2), _packed(vectors), others], schema=schema)


GRAPHS = "cell int, ids binary, vectors binary, many binary, levels binary, links binary, shape binary, id long, vector binary, others array<int>, least double, near array<long>, less array<double>, copied boolean"
ANSWERS = "id long, near array<long>, less array<double>, copied boolean"


def _answers(exact: np.ndarray, ids: np.ndarray, many: np.ndarray, found: np.ndarray, units: np.ndarray, k: int, own: np.ndarray | None, least: np.ndarray | None) -> tuple[pa.Array, pa.Array, np.ndarray, np.ndarray]:
    """(near, less, whether one of them has copies, the least of k scores) of rows found for each query, best first.

    Single precision is enough to walk; answers are scored again in double precision, to twelve places, so that
    vectors of one direction are equal to all others. own: the rows to leave out; least: scores below do not matter.
    """
    score = np.empty(found.shape)
    block = max(1, NUMBERS_AT_ONCE // (found.shape[1] * exact.shape[1]))
    for at in range(0, len(found), block):
        score[at : at + block] = np.einsum("ijk,ik->ij", exact[np.maximum(found[at : at + block], 0)], units[at : at + block])
    less = -np.round(np.clip(score, -1.0, 1.0), 12)
    keep = found >= 0
    if own is not None:
        keep &= found != own[:, None]
    if least is not None:
        keep &= -less >= least[:, None]
    named = ids[np.maximum(found, 0)]
    by = np.lexsort((named, np.where(keep, less, np.inf)), axis=1)[:, :k]
    named, less, keep, of = (np.take_along_axis(x, by, 1) for x in (named, less, keep, found))
    last = np.where(keep.sum(1) >= k, -less[:, -1], -np.inf) if less.shape[1] >= k else np.full(len(found), -np.inf)
    times = keep.sum(1)
    return _lists(named[keep], times), _lists(less[keep], times), (keep & many[np.maximum(of, 0)]).any(1), last


def _build(group: pa.Table, k: int, dim: int, ef: int, schema: pa.Schema) -> pa.Table:
    """A cell's graph in one row, and a row for each of its vectors with its answers within the cell."""
    group = group.sort_by("id")
    vectors, ids = _unpacked(group.column("vector"), dim), group.column("id").to_numpy()
    many = group.column("copies").to_numpy() > 1
    exact = _units(vectors)
    graph = Graph(exact)
    found, _ = graph.search(exact, k + 1, max(ef, k + 1))
    near, less, copied, least = _answers(exact, ids, many, found, exact, k, np.arange(len(ids)), None)
    n = len(ids)
    looks = pc.list_value_length(group.column("others")).to_numpy() > 0
    cell = group.column("cell").cast(pa.int32())
    row = graph.pack() | {"vectors": vectors.tobytes(), "ids": ids.tobytes(), "many": many.tobytes()}
    first = pa.table({"cell": cell.slice(0, 1)} | {name: pa.array([row[name]], pa.binary()) for name in ("ids", "vectors", "many", "levels", "links", "shape")})
    first = pa.table([first.column(f.name) if f.name in first.column_names else pa.nulls(1, f.type) for f in schema], schema=schema)
    # the vector travels on only with those that are looked up elsewhere
    vector = pc.if_else(pa.array(looks), group.column("vector").combine_chunks(), pa.scalar(None, pa.binary()))
    made = {"cell": cell, "id": group.column("id"), "vector": vector, "others": group.column("others"), "least": pa.array(least), "near": near, "less": less, "copied": pa.array(copied | many)}
    rest = pa.table([made[f.name] if f.name in made else pa.nulls(n, f.type) for f in schema], schema=schema)
    return pa.concat_tables([first, rest])


def _far(queries: pa.Table, index: pa.Table, k: int, dim: int, ef: int, schema: pa.Schema) -> pa.Table:
    """Answers of a cell that are as good as what a vector's own cell has."""
    if not queries.num_rows or not index.num_rows:
        return schema.empty_table()
    row = index.slice(0, 1).to_pylist()[0]
    ids, many = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["many"], bool)
    exact = _units(np.frombuffer(row["vectors"], np.float32).reshape(-1, dim))
    graph = Graph.unpack(exact.astype(np.float32).tobytes(), row["levels"], row["links"], row["shape"])
    units = _units(_unpacked(queries.column("vector"), dim))
    found, _ = graph.search(units, k, max(ef, k))
    near, less, copied, _ = _answers(exact, ids, many, found, units, k, None, queries.column("least").to_numpy())
    return pa.table([queries.column("id"), near, less, pa.array(copied)], schema=schema)


def nearest(vectors: DataFrame, dim: int, k: int = 10, ef: int = 24, far_ef: int = 16, probes: int = PROBES, margin: float = MARGIN) -> DataFrame:
    """(id, neighbour, rank, score): the k most similar other vectors of every row of (id long, vector array<float>).

    Similarity is the cosine; equal scores by smaller id. Vectors that are equal share one place in the index,
    and their ids are handed out again afterwards, so that copies cost nothing. Centres fitted on a bounded
    sample part the vectors into shards. The task that builds a shard's graph also looks its own vectors up in it (ef);
    a vector whose next centres are about as near as its own (within `margin` in cosine, `probes` shards in all) is sent to
    their graphs too (far_ef), in chunks, and they answer only what is as good as the answers at home. Graphs and
    answers are a table; only vectors with several answers are merged by a shuffle.

    - rows whose vector is unusable (see usable) or whose id is null are left out, and of rows with the same
      id the one with the least vector counts. Fewer than k other vectors: all of them. Empty table: empty result.
    - other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = vectors.where(F.col("id").isNotNull() & usable("vector", dim)).groupBy("id").agg(F.min("vector").alias("vector"))
    rows = materialise(rows, "vectors")
    classes = materialise(rows.groupBy("vector").agg(F.min("id").alias("id"), F.count("*").alias("copies")).select("id", "vector", "copies"), "classes")
    n, most_copies = classes.agg(F.count("*"), F.max("copies")).first()
    if not n:
        return spark.createDataFrame([], "id long, neighbour long, rank int, score double")
    share = min(1.0, SAMPLE_ROWS / n)
    sample = classes.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1).limit(2 * SAMPLE_ROWS).select("vector").toArrow()
    matrix = _units(_matrix(sample.column(0).combine_chunks(), dim)).astype(np.float32) if sample.num_rows else np.ones((1, dim), np.float32)
    most = max(1, SHARD_NUMBERS // dim)
    wanted = 1 if n <= FEW_ROWS else -(-n // max(1, min(most, int(SHARD_ROOT * n**0.5))))
    centres = fit_centres(matrix, min(wanted, max(1, len(matrix) // 8)))
    cells = Cells(centres, np.ones(len(centres), np.int64), probes, margin)
    if n > 2 * most:  # a shard may be too large for one graph
        counts = classes.mapInArrow(partial(_count_homes, cells=cells, dim=dim, schema=_arrow("shard int, n long")), "shard int, n long").groupBy("shard").agg(F.sum("n").alias("n"))
        for r in counts.collect():  # a row per shard
            cells.parts[r["shard"]] = max(1, -(-r["n"] // (2 * most)))

    graphs_schema, answers_schema = _arrow(GRAPHS), _arrow(ANSWERS)

    def build(group):
        return _build(group, k, dim, ef, graphs_schema)

    def look(queries, index):
        return _far(queries, index, k, dim, far_ef, answers_schema)

    routed = classes.mapInArrow(partial(_route, cells=cells, dim=dim, schema=_arrow(ROUTED)), ROUTED)
    tasks = max(1, min(int(cells.parts.sum()), MOST_TASKS))
    made = routed.repartition(tasks, "cell").groupBy("cell").applyInArrow(build, GRAPHS)
    graphs = materialise(made, "graphs")
    answers = graphs.where("id is not null").select("id", "near", "less", "copied", (F.size("others") > 0).alias("looks"))
    looks = graphs.where("id is not null and size(others) > 0").select(F.explode("others").alias("cell"), "id", "vector", "least")
    chunks = [(r["cell"], -(-r["count"] // CHUNK_ROWS)) for r in looks.groupBy("cell").count().collect()]  # a row per cell
    merged = answers.where("not looks").select("id", _pairs(), "copied")
    if chunks:
        sizes = F.broadcast(spark.createDataFrame(chunks, "cell int, chunks long"))
        looks = looks.join(sizes, "cell").select("cell", F.pmod(F.xxhash64("id"), "chunks").cast("int").alias("chunk"), "id", "vector", "least")
        held = graphs.where("ids is not null").join(sizes, "cell").select("cell", F.explode(F.sequence(F.lit(0), F.col("chunks").cast("int") - 1)).alias("chunk"), "ids", "vectors", "many", "levels", "links", "shape")
        keys, tasks = ["cell", "chunk"], max(1, min(sum(c for _, c in chunks), MOST_TASKS))
        far = looks.repartition(tasks, *keys).groupBy(*keys).cogroup(held.repartition(tasks, *keys).groupBy(*keys)).applyInArrow(look, ANSWERS)
        several = answers.where("looks").drop("looks").unionByName(far.where("size(near) > 0")).select("id", _pairs(), "copied")
        several = several.groupBy("id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("p"))), 1, k).alias("p"), F.bool_or("copied").alias("copied"))
        merged = merged.unionByName(several)
    if most_copies == 1:
        return _ranked(merged)
    merged = materialise(merged, "answers")
    return _ranked(merged.where("not copied")).unionByName(_with_copies(merged.where("copied"), rows, classes, k))


ROUTED = "cell int, id long, copies long, vector binary, others array<int>"


def _arrow(ddl: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(ddl))


def _pairs():
    return F.arrays_zip("less", "near").alias("p")


def _ranked(lists: DataFrame) -> DataFrame:
    return lists.select("id", F.posexplode("p").alias("at", "x")).select("id", F.col("x.near").alias("neighbour"), (F.col("at") + 1).cast("int").alias("rank"), (-F.col("x.less")).alias("score"))


def _with_copies(merged: DataFrame, rows: DataFrame, classes: DataFrame, k: int) -> DataFrame:
    """Answers between classes of equal vectors as answers between ids; the class of an id comes among its own answers."""
    several = classes.where("copies > 1").select("vector", F.col("id").alias("rep"))
    members = materialise(attach(rows, materialise(several, "several"), ["vector"]).select("rep", "id"), "copies")
    plain = merged.select("id", F.explode("p").alias("x")).select(F.col("id").alias("rep"), F.col("x.near").alias("near"), F.col("x.less").alias("less"))
    # the first k + 1 members of a class are all that any list can need
    first = _first_members(members, k + 1)
    owner = F.coalesce(F.col("m"), F.array("near"))
    wide = plain.join(first.withColumnRenamed("rep", "near"), "near", "left").select("rep", F.explode(owner).alias("near"), "less")
    own = first.select("rep", F.explode("m").alias("near"), F.lit(-1.0).alias("less"))
    wide = wide.where("rep != near").unionByName(own).groupBy("rep", "near").agg(F.min("less").alias("less"))
    lists = wide.groupBy("rep").agg(F.slice(F.array_sort(F.collect_list(F.struct("less", "near"))), 1, k + 1).alias("p"))
    lists = materialise(lists, "lists")
    # the representative itself lacks only itself
    single = lists.select(F.col("rep").alias("id"), F.explode("p").alias("x"))
    others = attach(members.where("id != rep"), lists, ["rep"]).select("id", F.explode("p").alias("x"))
    own = single.unionByName(others).select("id", F.col("x.near").alias("near"), F.col("x.less").alias("less")).where("id != near")
    return _cut(own, k)


def _first_members(members: DataFrame, most: int) -> DataFrame:
    """(rep, m): the `most` smallest ids of each class, cut by salts first, so that no class is gathered whole."""

    def smallest(by: list[str], from_: DataFrame) -> DataFrame:
        return from_.withColumn("__at", F.row_number().over(Window.partitionBy(*by).orderBy("id"))).where(F.col("__at") <= most).drop("__at")

    salted = smallest(["rep", "__salt"], members.withColumn("__salt", F.pmod(F.xxhash64("id"), F.lit(64))))
    return smallest(["rep"], salted.drop("__salt")).groupBy("rep").agg(F.array_sort(F.collect_list("id")).alias("m"))


def _cut(own: DataFrame, k: int) -> DataFrame:
    return _ranked(own.groupBy("id").agg(F.slice(F.array_sort(F.collect_list(F.struct("less", "near"))), 1, k).alias("p")))


def mutual(neighbours: DataFrame, least: float) -> DataFrame:
    """(id_a, id_b), id_a < id_b: each among the neighbours of the other, with a score of at least `least`."""
    close = neighbours.where(F.col("score") >= least).select(F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b"))
    return close.groupBy("id_a", "id_b").count().where("count = 2").select("id_a", "id_b")
