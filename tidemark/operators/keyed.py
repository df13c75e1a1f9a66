"""Keyed operators that stay balanced when one key holds a large share of the rows.

First-per-key uses aggregates with map-side combine. Ranks, lags and running sums
over a long group are computed in two levels: inside slices of the group, and over
one row per slice, so no task ever sorts a whole hot group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import cut_lineage


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The row of each key that comes first by ``order``."""
    return _pick(df, keys, F.min_by, order)


def last_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The row of each key that comes last by ``order``."""
    return _pick(df, keys, F.max_by, order)


def _pick(df, keys, by, order):
    row = F.struct(*[F.col(c) for c in df.columns if c not in keys])
    rank = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])
    picked = df.groupBy(*keys).agg(by(row, rank).alias("_row"))
    return picked.select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns])


def merge_rows(base: DataFrame, changes: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Upsert: per key the newest row by ``order``; a change beats a base row of the same age."""
    both = base.withColumn("_src", F.lit(0)).unionByName(changes.withColumn("_src", F.lit(1)))
    return last_per_key(both, keys, [F.col(o) for o in order] + [F.col("_src")]).drop("_src")


def replace_rows(base: DataFrame, changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Upsert without an age: a changed key takes the change (``changes`` has one row per key)."""
    return base.join(changes.select(*keys), list(keys), "left_anti").unionByName(
        changes, allowMissingColumns=True
    )


def rank_in_key(df: DataFrame, keys: Sequence[str], order: str, name: str = "rank") -> DataFrame:
    """1-based position of each row in its key by a unique ``order`` column.

    Rows are cut into ranges of (key, order), as many as their size asks for, so a hot key runs over several of
    them; each is numbered on its own and shifted by the rows of its key in the ranges before. The ranges are kept,
    as their cuts come from a sample that another run would draw anew.
    """
    ranged = df.repartitionByRange(*keys, order).withColumn("_slice", F.spark_partition_id())
    sliced = cut_lineage(ranged)
    inner = Window.partitionBy(*keys, "_slice").orderBy(order)
    sizes = sliced.groupBy(*keys, "_slice").agg(F.count("*").alias("_n"))
    outer = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select(*keys, "_slice", F.coalesce(F.sum("_n").over(outer), F.lit(0)).alias("_before"))
    ranked = sliced.withColumn("_inner", F.row_number().over(inner))
    return (
        _join_slices(ranked, before, keys)
        .withColumn(name, F.col("_inner") + F.col("_before"))
        .drop("_slice", "_inner", "_before")
    )


def number_rows(df: DataFrame, order: str, name: str, start: int = 0) -> DataFrame:
    """Consecutive numbers from ``start + 1`` in the order of a unique column."""
    one = df.withColumn("_all", F.lit(1))
    ranked = rank_in_key(one, ["_all"], order, name).drop("_all")
    return ranked.withColumn(name, (F.col(name) + F.lit(start)).cast("bigint"))


def previous_in_key(
    df: DataFrame, keys: Sequence[str], slice_col: str, order: Sequence[str], values: Sequence[str]
) -> DataFrame:
    """Adds ``prev_<value>``: the values of the row before in the key.

    ``slice_col`` cuts the order into stretches (say, days), so that a long key
    spreads over many tasks; the first row of a stretch looks at the last row of the
    nearest earlier stretch of its key.
    """
    rank = F.struct(*order)
    last = df.groupBy(*keys, slice_col).agg(F.max_by(F.struct(*values), rank).alias("_last"))
    over_slices = Window.partitionBy(*keys).orderBy(slice_col)
    edges = last.select(*keys, slice_col, F.lag("_last").over(over_slices).alias("_edge"))
    inner = Window.partitionBy(*keys, slice_col).orderBy(*order)
    got = df.withColumn("_prev", F.lag(F.struct(*values)).over(inner))
    joined = _join_slices(got, edges, keys, slice_col)
    prev = F.coalesce(F.col("_prev"), F.col("_edge"))
    return joined.withColumns({f"prev_{v}": prev[v] for v in values}).drop("_prev", "_edge")


def running_sum(
    df: DataFrame, keys: Sequence[str], slice_col: str, order: Sequence[str], value: Column, name: str
) -> DataFrame:
    """Running sum of ``value`` in the key, the current row included."""
    valued = df.withColumn("_v", value)
    totals = valued.groupBy(*keys, slice_col).agg(F.sum("_v").alias("_t"))
    outer = Window.partitionBy(*keys).orderBy(slice_col).rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(*keys, slice_col, F.coalesce(F.sum("_t").over(outer), F.lit(0)).alias("_before"))
    inner = Window.partitionBy(*keys, slice_col).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    got = valued.withColumn("_inner", F.sum("_v").over(inner))
    joined = _join_slices(got, before, keys, slice_col)
    return joined.withColumn(name, F.col("_inner") + F.col("_before")).drop("_v", "_inner", "_before")


def _join_slices(rows: DataFrame, edges: DataFrame, keys: Sequence[str], slice_col: str = "_slice") -> DataFrame:
    return rows.join(edges, [*keys, slice_col], "left")


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, name: str = "rank") -> DataFrame:
    """The first k rows per key; Spark cuts each map task to k rows per key before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= k)


def rows_of(df: DataFrame, keep: Sequence[str | Column], items: Column, position: str, name: str) -> DataFrame:
    """One row per array entry, with its position.

    A plain explode lets Spark infer a filter on the size of the array and evaluate the
    whole array a second time below the stages that build it; the outer form does not.
    """
    rows = df.select(*keep, F.posexplode_outer(items).alias(position, name))
    return rows.filter(F.col(position).isNotNull())


def keep_rows(df: DataFrame, condition: Column) -> DataFrame:
    """Filter by costly computed columns.

    A plain filter is pushed below the projection that computes its columns, which then
    are evaluated for the filter and once more for the rows. Here each row is kept or
    dropped as a list of one or none, after its columns are there.
    """
    one = F.when(condition, F.array(F.struct(*df.columns)))
    return df.select(F.explode_outer(one).alias("_row")).filter(F.col("_row").isNotNull()).select("_row.*")
