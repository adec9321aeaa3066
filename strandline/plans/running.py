"""Running aggregates over ordered groups, without one task per hot group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from strandline.plans.sizing import hinted, left_lookup, lookup_side, settle

HOT_ROWS = 2_000_000
LOOK = "look"

_FOLD = {"sum": F.sum, "max": F.max, "min": F.min}

Measures = dict[str, tuple[str, Column]]


def hot_groups(df: DataFrame, by: list[str], hot_rows: int = HOT_ROWS) -> DataFrame | None:
    """Groups with more than ``hot_rows`` rows, or None when there is none.

    There are at most (all rows / ``hot_rows``) of them. The counts are combined map-side.
    """
    sizes = settle(df.groupBy(*by).agg(F.count(F.lit(1)).alias("__rows")).where(
        F.col("__rows") > hot_rows))
    return None if sizes.isEmpty() else sizes


def _windowed(df, partition, order, measures, inclusive):
    frame = Window.partitionBy(*partition).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, 0 if inclusive else -1)
    return df.select("*", *[_FOLD[kind](value).over(frame).alias(name)
                            for name, (kind, value) in measures.items()])


def _combine(kind: str, before: Column, local: Column) -> Column:
    if kind == "sum":
        return F.when(before.isNull(), local).when(local.isNull(), before).otherwise(before + local)
    return F.greatest(before, local) if kind == "max" else F.least(before, local)


def running(
    df: DataFrame,
    by: list[str],
    order: list[Column],
    measures: Measures,
    inclusive: bool = True,
    hot_rows: int = HOT_ROWS,
    hot: DataFrame | None | str = LOOK,
) -> DataFrame:
    """Add running ``sum``/``max``/``min`` columns over each group in ``order``.

    Groups up to ``hot_rows`` rows use a plain window. Larger ones are range-partitioned
    on the order itself, so that equal leading values can be split too: every range gets a
    local window, and the totals of the ranges before it come from a small table.
    ``inclusive`` says whether a row counts itself. The order has to be total in a group.
    ``hot`` takes the result of ``hot_groups`` when the groups have been counted before.
    """
    if isinstance(hot, str):
        hot = hot_groups(df, by, hot_rows)
    if hot is None:
        return _windowed(df, by, order, measures, inclusive)

    biggest = hot.agg(F.sum("__rows")).first()[0]
    ranges = max(2 * -(-biggest // hot_rows),
                 int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    marked = left_lookup(
        df, hinted(hot).drop("__rows").withColumn("__hot", F.lit(True)), by)

    cold = _windowed(marked.where(F.col("__hot").isNull()).drop("__hot"),
                     by, order, measures, inclusive)

    # The range number is stable only once written: sampling is redone on recomputation.
    ranged = settle(
        marked.where("__hot").drop("__hot")
        .repartitionByRange(ranges, *[F.col(b) for b in by], *order)
        .withColumn("__range", F.spark_partition_id()))
    totals = ranged.groupBy(*by, "__range").agg(
        *[_FOLD[kind](value).alias(f"__t_{name}") for name, (kind, value) in measures.items()])
    earlier = Window.partitionBy(*by).orderBy("__range").rowsBetween(
        Window.unboundedPreceding, -1)
    before = lookup_side(totals.select(
        *by, "__range",
        *[_FOLD[kind](f"__t_{name}").over(earlier).alias(f"__b_{name}")
          for name, (kind, _) in measures.items()]))
    local = _windowed(ranged, [*by, "__range"], order, measures, inclusive)
    joined = left_lookup(local, before, [*by, "__range"])
    warm = joined.select(*df.columns, *[
        _combine(kind, F.col(f"__b_{name}"), F.col(name)).alias(name)
        for name, (kind, _) in measures.items()])
    return cold.unionByName(warm)


def dense_position(
    df: DataFrame, by: list[str], order: list[Column], name: str, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Add the 0-based position of every row inside its group."""
    counted = running(df, by, order, {name: ("sum", F.lit(1).cast("long"))}, True, hot_rows)
    return counted.withColumn(name, F.col(name) - 1)


def keyed_position(
    df: DataFrame, by: list[str], order: list[str], key: str, name: str, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """``dense_position`` in ascending order of columns, with ``key`` to tell ties apart.

    Only group, order and key are sorted, ranged and counted; all other columns stay where they are until the join on
    the key, which has to be unique and not null.
    """
    narrow = list(dict.fromkeys([*by, *order, key]))
    placed = dense_position(df.select(narrow), by, [F.col(c) for c in dict.fromkeys([*order, key])], name, hot_rows)
    if set(df.columns) == set(narrow):
        return placed.select(*df.columns, name)
    return df.join(placed.select(key, name), key).select(*df.columns, name)
