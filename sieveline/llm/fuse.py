"""One ranking from scores on different scales."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieveline.errors import SchemaError
from sieveline.llm.topn import HEAVY_ROWS, heavy_groups, quoted, same_groups
from sieveline.storage import attach, materialise

#: Scales a median absolute deviation to a standard deviation of normal data (fixed value).
MAD_SCALE = 1.4826


def _finite(column: str) -> Column:
    value = F.col(column).cast("double")
    return F.when(value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf")), F.lit(0.0) + value)


def combine_scores(df: DataFrame, groups: Sequence[str], scores: Sequence[str], weights: Sequence[float] | None = None, missing: str = "drop", steepness: float = 1.0, heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """df with `combined`, from 0 to 1, comparable within a group; the higher the better. df is read twice.

    A score counts by its place among the scores of its group, so that neither range nor distribution matters; equal
    scores share the mean of their places. Places are standardised by their median and median absolute deviation,
    squashed by a logistic curve, and the bounded values enter a weighted geometric mean. Of n places the median is
    (n + 1) / 2 and the deviation follows from n alone, so both are exact for groups of any size.

    missing: what becomes of rows that lack a score: `drop` leaves them out, `last` gives them the place behind the
    last of the group; a row without any score is left out.

    Light groups get their places in a window each. Heavy ones (heavy_rows or more, found by exact counts) are
    counted by value first, the values are sorted by range over all tasks, and the places come back by a join that
    is broadcast if small and salted else: no task gets a heavy group, nor all rows of one value.

    - null, NaN and infinite scores are missing; -0.0 equals 0.0. Null group values form a group of their own.
    - equal scores give equal values, and so do mirrored places: combined is rounded to twelve places. Repeated rows count as often as they occur. An empty table gives an
      empty result. Other columns are carried along whatever their names; one named combined gives way.
    """
    scores, groups = list(scores), list(groups)
    weights = [1.0] * len(scores) if weights is None else [float(w) for w in weights]
    if not scores or len(weights) != len(scores) or any(not 0 < w < float("inf") for w in weights) or missing not in ("drop", "last"):
        raise SchemaError("scores need as many positive weights, and missing is drop or last")
    values, keys = [f"v{i}" for i in range(len(scores))], [f"k{i}" for i in range(len(groups))] or ["k0"]
    row = F.struct(*[F.col(quoted(c)) for c in df.columns])
    # names of its own from here on
    grouped = [F.col(quoted(g)).alias(k) for k, g in zip(keys, groups)] or [F.lit(1).alias("k0")]
    found = df.select(row.alias("row"), *grouped, *[_finite(quoted(c)).alias(v) for v, c in zip(values, scores)])
    some: Column = F.coalesce(*values).isNotNull()
    if missing == "drop":
        for v in values:
            some = some & F.col(v).isNotNull()
    found = found.where(some)
    heavy, _ = heavy_groups(found, keys, heavy_rows)
    if heavy is None:
        placed = _light_places(found, keys, values)
    else:
        same = same_groups(keys, "h")
        light = found.join(F.broadcast(heavy), same, "left_anti")
        hot = found.join(F.broadcast(heavy.drop("rows")), same).drop(*[f"h{k}" for k in keys])
        placed = _light_places(light, keys, values).unionByName(_heavy_places(hot, keys, values))
    logs: Column = F.lit(0.0)
    for v, w in zip(values, weights):
        n = F.col(f"{v}n")
        middle, spread = (n + 1) / 2, _deviation(n) * MAD_SCALE
        z = (middle - F.coalesce(F.col(f"{v}p"), n + 1)) / F.when(spread > 0, spread).otherwise(1.0) * steepness
        z = F.greatest(F.lit(-500.0), F.least(F.lit(500.0), z))
        logs = logs - F.log1p(F.exp(-z)) * (w / sum(weights))
    return placed.select(*[F.col("row")[c].alias(c) for c in df.columns if c != "combined"], F.round(F.exp(logs), 12).alias("combined"))


def _deviation(n: Column) -> Column:
    """Median absolute deviation of the places 1 to n: they lie n/2 - i + 1/2 or less from the middle, two at each distance."""
    odd = F.ceil((n - 1) / 4)
    even = F.when(n % 4 == 0, n / 4).otherwise((n / 2 - 1) / 2 + 0.5)
    return F.when(n < 2, 0.0).when(n % 2 == 1, odd.cast("double")).otherwise(even)


def _light_places(rows: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """rows with the place (p, null where the value is) and the number (n) of each value in its group."""
    made = {}
    for v in values:
        order = Window.partitionBy(*keys).orderBy(F.col(v).desc_nulls_last())
        # the frame of an ordered count ends with the last of equal values
        made[f"{v}p"] = F.when(F.col(v).isNotNull(), (F.rank().over(order) + F.count(v).over(order)) / 2)
        made[f"{v}n"] = F.count(v).over(Window.partitionBy(*keys))
    return rows.withColumns(made)


def _heavy_places(rows: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """The same for groups that no task may hold."""
    # groups and values are joined by value, and null is a value
    rows = rows.withColumns({f"{k}s": F.struct(k) for k in keys} | {f"{v}s": F.struct(v) for v in values})
    by = [f"{k}s" for k in keys]
    for v in values:
        times = rows.where(F.col(v).isNotNull()).groupBy(*by, f"{v}s").agg(F.count("*").alias("times"))
        order = [F.col(b).asc() for b in by] + [F.col(f"{v}s").desc()]
        placed = materialise(times.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("range", F.spark_partition_id()), "values")
        sizes = materialise(placed.groupBy(*by, "range").agg(F.sum("times").alias("size")), "ranges")  # a row per task and group
        before = F.coalesce(F.sum("size").over(Window.partitionBy(*by).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        starts = sizes.select(*by, "range", before.alias("before"), F.sum("size").over(Window.partitionBy(*by)).alias(f"{v}n"))
        upto = F.sum("times").over(Window.partitionBy(*by, "range").orderBy(F.col(f"{v}s").desc()).rowsBetween(Window.unboundedPreceding, 0))
        known = placed.withColumn("upto", upto).join(starts, [*by, "range"]).select(*by, f"{v}s", (F.col("before") + F.col("upto") - (F.col("times") - 1) / 2).alias(f"{v}p"))
        rows = attach(attach(rows, materialise(known, "places"), [*by, f"{v}s"], "left"), starts.select(*by, f"{v}n").distinct(), by, "left").withColumn(f"{v}n", F.coalesce(f"{v}n", F.lit(0)))
    return rows.drop(*by, *[f"{v}s" for v in values])
