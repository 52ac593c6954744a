"""Positions, predecessors and values carried along in a total order, without one task that holds all rows or all of a group.

Rows are dealt by ranges of the order. What goes beyond one range is a row for each group and range, and these are few."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestrata.sources.stored import stored

_IN_PART = 33  # monotonically_increasing_id has a row's number in its partition in so many bits


def _ranged(df: DataFrame, columns: list[str], order: tuple[str, ...]) -> DataFrame:
    """A stored table of row (the columns as one), part (the range) and at (the place in it)."""
    keys = [(f"`k{n}`", c.startswith("-"), F.col(f"`{c.removeprefix('-')}`")) for n, c in enumerate(order)]
    wrapped = df.select(F.struct(*(f"`{c}`" for c in columns)).alias("row"), *(c.alias(k.strip("`")) for k, _, c in keys))
    sort = [F.col(k).desc_nulls_last() if down else F.col(k).asc_nulls_last() for k, down, _ in keys]
    dealt = wrapped.repartitionByRange(*sort).sortWithinPartitions(*sort).select("row", F.monotonically_increasing_id().alias("id"))
    within = F.col("id").bitwiseAND(F.lit((1 << _IN_PART) - 1))
    return stored(dealt, "ranged").select("row", F.shiftright("id", _IN_PART).alias("part"), within.alias("at"))


def numbered(df: DataFrame, *order: str, position: str = "position", first: int = 0) -> DataFrame:
    """df with each row's place from `first` on as its last column, in the order of the named columns ("-name" is descending).

    To a row's place in its range the sizes of the ranges before are added, one number for each partition. Nulls come last.
    Equal keys lie in one partition, in any order, so keys should tell rows apart. A column that is called like the position is
    replaced. An empty table stays empty."""
    table = _ranged(df, [c for c in df.columns if c != position], order)
    sizes = sorted((r["part"], r["count"]) for r in table.groupBy("part").count().collect())
    starts = accumulate((n for _, n in sizes), initial=first)
    offsets = df.sparkSession.createDataFrame([(p, s) for (p, _), s in zip(sizes, starts)], "part long, start long")
    return table.join(F.broadcast(offsets), "part").select("row.*", (F.col("start") + F.col("at")).alias(position))


def _by_group(df: DataFrame, by: list[str], order: tuple[str, ...]) -> DataFrame:
    """_ranged() in the order of groups, with the group as one column, in which nulls are equal."""
    return _ranged(df, df.columns, (*by, *order)).withColumn("g", F.struct(*(F.col("row")[c].alias(f"g{n}") for n, c in enumerate(by))))


def previous(df: DataFrame, by: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """df with the value of the row before in its group's order as `name`, null for the group's first row.

    Within a range this is a window over the group's rows there; the first of them takes the last value of the range before."""
    table = _by_group(df, by, tuple(order))
    own = F.struct(F.col("row")[value].alias("v"))
    ends = table.groupBy("g", "part").agg(F.max_by(own, "at").alias("end"))
    ends = ends.select(F.col("g").alias("of"), F.col("part").alias("end_part"), F.lag("end").over(W.partitionBy("g").orderBy("part")).alias("carry"))
    table = table.withColumn("before", F.lag(own).over(W.partitionBy("part", "g").orderBy("at")))
    return _with_carry(table, ends).select("row.*", F.coalesce("before", "carry")["v"].alias(name))


def carried(df: DataFrame, by: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """df with the last value that isn't null among the rows of the group up to this one, as `name`."""
    table = _by_group(df.withColumn("carried value", value), by, tuple(order))
    own = F.col("row")["carried value"]
    ends = table.where(own.isNotNull()).groupBy("g", "part").agg(F.max_by(own, "at").alias("end"))
    all_parts = table.select("g", "part").distinct().join(ends, ["g", "part"], "left")
    before = W.partitionBy("g").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    ends = all_parts.select(F.col("g").alias("of"), F.col("part").alias("end_part"), F.last("end", ignorenulls=True).over(before).alias("carry"))
    window = W.partitionBy("part", "g").orderBy("at").rowsBetween(W.unboundedPreceding, 0)
    table = table.withColumn("before", F.last(own, ignorenulls=True).over(window))
    return _with_carry(table, ends).select(*(F.col("row")[c].alias(c) for c in df.columns), F.coalesce("before", "carry").alias(name))


def _with_carry(table: DataFrame, ends: DataFrame) -> DataFrame:
    return table.join(ends, (F.col("g") == F.col("of")) & (F.col("part") == F.col("end_part")))
