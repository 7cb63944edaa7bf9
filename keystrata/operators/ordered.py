"""Numbers, running sums and neighbours over a total order, without a single-task sort.

All of them start from a stored table: rows are dealt by range, sorted, and written once with their
partition and their place in it. A range exchange samples its bounds anew in each evaluation, so nothing
that depends on partitions may be evaluated twice; the stored table is read as often as needed. What
crosses partitions is one small row each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keystrata.sources.scratch import materialize

PART, PLACE = "_part", "_place"
#: monotonically_increasing_id() counts within a partition in its low 33 bits.
_LOW = (1 << 33) - 1


def ranged(rows: DataFrame, *order: str | Column) -> DataFrame:
    """The rows as a stored table with _part and _place: sorted by _part, then _place, they are in order.
    Ties come in any order, the same one at each reading."""
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = dealt.withColumns({PART: F.spark_partition_id(), PLACE: F.monotonically_increasing_id().bitwiseAND(F.lit(_LOW))})
    return materialize(placed)


def _before(stored: DataFrame, values: dict[str, Column]) -> DataFrame:
    """For each partition the sums over earlier ones, as before_ and the name. One row a partition."""
    sums = stored.groupBy(PART).agg(*[v.cast("long").alias(name) for name, v in values.items()])
    w = Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(PART, *[F.coalesce(F.sum(name).over(w), F.lit(0)).alias(f"before_{name}") for name in values])


def numbered(stored: DataFrame, name: str) -> DataFrame:
    """Adds name, 1..count in the order of a table of ranged()."""
    before = _before(stored, {name: F.count("*")})
    return stored.join(F.broadcast(before), PART).withColumn(name, F.col(f"before_{name}") + F.col(PLACE) + 1).drop(PART, PLACE, f"before_{name}")


def running_sums(stored: DataFrame, values: dict[str, str]) -> DataFrame:
    """Adds, for each name of values, the sum of its column from the first row to this one."""
    w = Window.partitionBy(PART).orderBy(PLACE).rowsBetween(Window.unboundedPreceding, 0)
    joined = stored.withColumns({name: F.sum(column).over(w) for name, column in values.items()}).join(F.broadcast(_before(stored, {name: F.sum(column) for name, column in values.items()})), PART)
    return joined.withColumns({name: F.col(name) + F.col(f"before_{name}") for name in values}).drop(PART, PLACE, *[f"before_{name}" for name in values])


def with_previous(stored: DataFrame, value: str, name: str) -> DataFrame:
    """Adds name, the value of the row before this one, null at the first. _part and _place stay."""
    last = stored.groupBy(PART).agg(F.max_by(F.struct(value), PLACE).alias("_last"))
    edge = last.select(PART, F.lag("_last").over(Window.orderBy(PART)).alias("_edge"))
    inside = stored.withColumn(name, F.lag(value).over(Window.partitionBy(PART).orderBy(PLACE)))
    joined = inside.join(F.broadcast(edge), PART)
    return joined.withColumn(name, F.when(F.col(PLACE) == 0, F.col(f"_edge.{value}")).otherwise(F.col(name))).drop("_edge")
