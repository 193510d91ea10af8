"""The N best rows of every group, where some groups are very large."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieveline.storage import materialise

#: Rows from which a group is heavy, and the most groups that can be: the list of them is broadcast.
HEAVY_ROWS, HEAVY_GROUPS = 50_000, 50_000
#: Rows of a heavy group for each salt.
SALT_ROWS = 25_000


def top_n(df: DataFrame, groups: Sequence[str], score: str, tie: Sequence[str], n: int | str, heavy_rows: int = HEAVY_ROWS, salt_rows: int = SALT_ROWS) -> DataFrame:
    """Rows of df among the n highest scores of their group, with their `rank` from 1; df is read twice.

    n: a number, or the column that holds it in every row of a group. Order: higher score first, then
    the tie columns ascending; -0.0 equals 0.0.

    Exact counts part the groups. Light ones go to a window each. Heavy ones (heavy_rows rows or more, and
    above 1/HEAVY_GROUPS of all rows, so that the list of them is bounded) are salted: each salt keeps its
    own n best, the survivors are sorted by range over all tasks and ranked by the counts of the ranges
    before, so that no task gets a heavy group, whatever n is.

    - rows whose score is null, NaN or infinite, or whose n is null or below 1: left out.
    - null group values form a group of their own. Repeated rows are rows: dedupe first if they should
      not count; which of rows equal in score and ties gets which rank does not matter to the result.
    - an empty table gives an empty result. Other columns are carried along whatever their names; one named
      rank gives way to the rank.
    """
    groups, tie = list(groups), list(tie)
    value = F.col(score).cast("double")
    wanted = F.col(n).cast("long") if isinstance(n, str) else F.lit(int(n)).cast("long")
    by, ties = [f"g{i}" for i in range(len(groups))], [f"t{i}" for i in range(len(tie))]
    row = F.struct(*[F.col(quoted(c)) for c in df.columns])
    # names of its own from here on; 0.0 - -0.0 is 0.0
    rows = df.select(row.alias("row"), *[F.col(quoted(g)).alias(b) for g, b in zip(groups, by)], *[F.col(quoted(t)).alias(b) for t, b in zip(tie, ties)], (F.lit(0.0) - value).alias("less"), wanted.alias("n"))
    rows = rows.where(F.col("less").isNotNull() & ~F.isnan("less") & (F.abs("less") < float("inf")) & (F.col("n") >= 1))
    order = [F.col("less").asc(), *[F.col(t).asc_nulls_last() for t in ties]]
    kept = [*[F.col("row")[c].alias(c) for c in df.columns if c != "rank"], F.col("rank")]

    heavy, most = heavy_groups(rows, by, heavy_rows, F.max("n"))
    if heavy is None:
        return _ranked(rows, by, order, most).select(*kept)
    same = same_groups(by, "h")
    light = _ranked(rows.join(F.broadcast(heavy.drop("rows")), same, "left_anti"), by, order, most)
    hot = rows.join(F.broadcast(heavy), same, "inner").drop(*[f"h{g}" for g in by])
    salt = F.pmod(F.xxhash64("less", *ties) if ties else F.monotonically_increasing_id(), F.ceil(F.col("rows") / F.lit(salt_rows)))
    survivors = _ranked(hot.withColumn("salt", salt).drop("rows"), [*by, "salt"], order, most).drop("rank", "salt")
    return light.select(*kept).unionByName(_range_ranked(survivors, by, order).select(*kept))


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def heavy_groups(rows: DataFrame, by: list[str], heavy_rows: int, more: Column | None = None) -> tuple[DataFrame | None, int | None]:
    """(h + name of each group column, rows) of the groups of heavy_rows rows and more, None if there are none, by exact
    counts; and the greatest value of `more` over all groups. Their number is bounded by HEAVY_GROUPS."""
    counts = materialise(rows.groupBy(*by).agg(F.count("*").alias("rows"), (F.lit(0) if more is None else more).alias("most")), "groups")
    total, most = counts.agg(F.sum("rows"), F.max("most")).first()
    least = max(heavy_rows, -(-(total or 0) // HEAVY_GROUPS))
    heavy = counts.where(F.col("rows") >= least).select(*[F.col(g).alias(f"h{g}") for g in by], "rows")
    return (None if heavy.isEmpty() else heavy), most


def same_groups(by: list[str], other: str) -> Column:
    """Group values that are equal or both null."""
    return reduce(lambda a, g: a & F.col(g).eqNullSafe(F.col(f"{other}{g}")), by, F.lit(True))


def _ranked(rows: DataFrame, by: list[str], order: list[Column], most: int | None) -> DataFrame:
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    # the second condition, a literal, lets Spark cut each group before the shuffle
    return ranked.where((F.col("rank") <= F.col("n")) & (F.col("rank") <= F.lit(int(min(most or 1, 2**31 - 1)))))


def _range_ranked(rows: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """Ranks by a sort of all rows over ranges: the place in its range plus the group's rows in the ranges before."""
    keys = [F.col(g).asc_nulls_first() for g in by]
    placed = rows.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).withColumn("range", F.spark_partition_id())
    placed = materialise(placed, "ranges")
    sizes = placed.groupBy(*by, "range").agg(F.count("*").alias("size"))
    before = F.coalesce(F.sum("size").over(Window.partitionBy(*by).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(*[F.col(g).alias(f"s{g}") for g in by], F.col("range").alias("r"), before.alias("before"))
    own = F.row_number().over(Window.partitionBy(*by, "range").orderBy(*order))
    ranked = placed.withColumn("own", own).join(starts, (F.col("range") == F.col("r")) & same_groups(by, "s"), "inner")
    return ranked.withColumn("rank", (F.col("own") + F.col("before")).cast("int")).where(F.col("rank") <= F.col("n"))
