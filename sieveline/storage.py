"""Tables between two stages, and joins with a side whose size is checked."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sieveline.errors import IndexIoError, SchemaError

#: The folder of each application that has no setting for it.
_OWN: dict[str, str] = {}
#: Tables written between stages, by application, until they are released.
_MADE: dict[str, list[str]] = {}
#: Rows up to which a side of a join is broadcast.
BROADCAST_ROWS = 100_000


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, as spark.checkpoint.dir names it.

    Where that is unset a folder of this machine stands in, which only a session without a cluster may use.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise IndexIoError("set spark.checkpoint.dir to a folder that all executors share")
        # one process without a cluster; the setting itself can not be changed any more
        app = spark.sparkContext.applicationId
        folder = _OWN.setdefault(app, f"file://{tempfile.gettempdir()}/sieveline-{app}-{os.getpid()}")
    return folder.rstrip("/")


def materialise(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts the lineage, survives lost executors.

    The table goes when it is released, or when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/sieveline/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    _MADE.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Delete the tables that were written between stages so far, and say how many: call it once results are stored.

    Results that were not read yet can not be read afterwards.
    """
    made = _MADE.pop(spark.sparkContext.applicationId, [])
    for path in made:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    return len(made)


def refuse_clash(keys: Sequence[str], made: Sequence[str]) -> None:
    """SchemaError if a column that is carried through has the name of a column that is made."""
    if clash := sorted({k.lower() for k in keys} & {m.lower() for m in made}):
        raise SchemaError(f"columns {clash} have names of result columns; rename them first")


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether df has at most so many rows; looks at no more than one row beyond."""
    return df.limit(rows + 1).count() <= rows


def attach(big: DataFrame, small: DataFrame, keys: Sequence[str], how: str = "inner", rows: int = BROADCAST_ROWS, salts: int | None = None) -> DataFrame:
    """big JOIN small on keys where a key may hold a large part of big.

    small is broadcast if a count shows at most `rows` rows; else big is salted and each row of small
    repeated once per salt, so that no task gets a whole hot key. The repeated rows are always shuffled: Spark would
    judge them by the compressed file of small and may broadcast them. how: inner or left. salts: as many as the
    session has cores, from 16 to 64, where none are given.
    """
    keys = list(keys)
    if is_small(small, rows):
        return big.join(F.broadcast(small), keys, how)
    salts = salts or max(16, min(64, big.sparkSession.sparkContext.defaultParallelism))
    plain = [quoted(f.name) for f in big.schema.fields if _hashes(f.dataType)]
    salt = "__salt"
    salted = big.withColumn(salt, F.pmod(F.xxhash64(*plain), F.lit(salts)).cast("int"))
    copies = small.withColumn(salt, F.explode(F.array(*[F.lit(i) for i in range(salts)])))
    return salted.join(copies.hint("merge"), [*keys, salt], how).drop(salt)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _hashes(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return all(_hashes(f.dataType) for f in kind.fields)
    return _hashes(kind.elementType) if isinstance(kind, T.ArrayType) else not isinstance(kind, (T.MapType, T.VariantType))


def spread(df: DataFrame, key: str) -> DataFrame:
    """df over all cores by a hash of key, if it is read from fewer parts than there are cores; else df itself.

    Large tables come in many parts and are left alone; a table of one small file would keep one core busy.
    """
    plan = df._jdf.queryExecution()
    cores = df.sparkSession.sparkContext.defaultParallelism
    if "Exchange" in plan.executedPlan().toString() or plan.toRdd().getNumPartitions() >= cores:
        return df
    return df.repartition(cores, key)


def once_per_key(df: DataFrame, key: str) -> DataFrame:
    """df with one row for each key: the least row in the order of its columns. Null keys stay as they are.

    Only the keys are shuffled to find those that repeat; whole rows move only for these.
    """
    again = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("__times")).where("__times > 1").select(key)
    again = materialise(again, "repeats")
    if again.isEmpty():
        return df
    if is_small(again):
        again = F.broadcast(again)
    single = df.join(again, key, "left_anti").select(*df.columns)
    rest = [c for c in df.columns if c != key]
    repeated = df.join(again, key, "left_semi").groupBy(key).agg(F.min(F.struct(*rest)).alias("__row"))
    return single.unionByName(repeated.select(key, *[F.col("__row")[c].alias(c) for c in rest]))


def number_rows(df: DataFrame, order: Sequence[str], start: int = 0, name: str = "number") -> DataFrame:
    """df with dense numbers from `start` in the given order, whatever its size: rows are sorted by range over all
    tasks and numbered by their place in the range plus the rows of the ranges before."""
    return number_and_count(df, order, start, name)[0]


def number_and_count(df: DataFrame, order: Sequence[str], start: int = 0, name: str = "number") -> tuple[DataFrame, int]:
    """number_rows, and how many rows there are."""
    refuse_clash(df.columns, [name, "__range"])
    keys = [F.col(c) for c in order]
    placed = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__range", F.spark_partition_id())
    placed = materialise(placed, "numbered")
    sizes = sorted((r["__range"], r["count"]) for r in placed.groupBy("__range").count().collect())  # a row per task
    starts, at = [], start
    for r, n in sizes:
        starts.append((r, at))
        at += n
    offsets = df.sparkSession.createDataFrame(starts, "__range int, __start long")
    own = F.row_number().over(Window.partitionBy("__range").orderBy(*keys)) - 1
    numbered = placed.withColumn("__own", own).join(F.broadcast(offsets), "__range").withColumn(name, F.col("__start") + F.col("__own")).select(*df.columns, name)
    return numbered, at - start


def rank_rows(df: DataFrame, by: Sequence[str], order: Sequence[Column], name: str = "rank") -> DataFrame:
    """df with its rank from 1 among the rows of equal `by`, whatever the size of a group: rows are sorted by range over all
    tasks, and a rank is the place in the range plus the group's rows in the ranges before. Values of `by` are not null."""
    refuse_clash(df.columns, [name, "__range", "__own", "__before"])
    keys = [F.col(b) for b in by]
    placed = materialise(df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).withColumn("__range", F.spark_partition_id()), "ranked")
    sizes = placed.groupBy(*by, "__range").agg(F.count("*").alias("__size"))
    # a row per range and group: the first range a group has takes nothing
    starts = sizes.withColumn("__before", F.coalesce(F.sum("__size").over(Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    later = materialise(starts.where("__before > 0").select(*by, "__range", "__before"), "starts")
    own = F.row_number().over(Window.partitionBy(*by, "__range").orderBy(*order))
    ranked = attach(placed.withColumn("__own", own), later, [*by, "__range"], "left")
    return ranked.select(*df.columns, (F.col("__own") + F.coalesce("__before", F.lit(0))).cast("int").alias(name))


class Files:
    """Small files beside tables, on whatever file system the path names."""

    def __init__(self, spark: SparkSession, folder: str):
        self.folder, self._jvm = folder.rstrip("/"), spark._jvm
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def at(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def exists(self, name: str = "") -> bool:
        return self._fs.exists(self._path(self.at(name) if name else self.folder))

    def write(self, name: str, text: str) -> None:
        """Written beside and renamed: a reader sees the old or the new text."""
        beside = self._path(self.at(f".{name}.{uuid.uuid4().hex}"))
        out = self._fs.create(beside, True)
        out.write(bytearray(text.encode()))
        out.close()
        target = self._path(self.at(name))
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(beside.toUri(), self._jvm.org.apache.hadoop.conf.Configuration())
        options = self._jvm.java.lang.reflect.Array.newInstance(self._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 1)
        self._jvm.java.lang.reflect.Array.set(options, 0, self._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename").getEnumConstants()[1])
        context.rename(self._fs.makeQualified(beside), self._fs.makeQualified(target), options)

    def read(self, name: str) -> str:
        stream = self._fs.open(self._path(self.at(name)))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def remove(self, name: str) -> None:
        self._fs.delete(self._path(self.at(name)), True)
