"""Inverse-frequency weights and exact balanced sampling with replacement."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from strandline.functions.hashing import digest, unit
from strandline.operators.sampling import gathered
from strandline.plans.running import HOT_ROWS, dense_position
from strandline.plans.sizing import left_lookup, lookup_side, settle

COPY_DRAWS = 65_536


def group_counts(df: DataFrame, group: str) -> DataFrame:
    """Rows per group: ``group``, ``group_rows``."""
    return df.groupBy(group).agg(F.count(F.lit(1)).alias("group_rows"))


def balance_weights(df: DataFrame, group: str, name: str = "weight") -> DataFrame:
    """Add ``1 / rows of the group``, so that each group has a total weight of 1.

    The counts are combined map-side and looked up; the rows themselves do not move.
    """
    counts = lookup_side(group_counts(df, group))
    return left_lookup(df, counts, [group]).withColumn(
        name, F.lit(1.0) / F.col("group_rows")).drop("group_rows")


def balanced_sample(
    df: DataFrame, group: str, key: str, draws: int | None = None, seed: int = 42,
    hot_rows: int = HOT_ROWS, copy_draws: int = COPY_DRAWS,
) -> DataFrame:
    """Exactly ``draws`` rows with replacement: an even draw of a group, then of a row in it.

    This is what sampling by inverse-frequency weights means, as every group has mass 1.
    ``key`` has to be unique. Draws find their row through (group, position), both hashed
    from the draw number. The key of a row expected more than ``copy_draws`` times (a tiny group in a
    big sample) is given salted copies, so that its draws spread over many tasks; the
    wide rows move once, in the last join, and are never copied before it. Adds ``draw``.
    """
    spark = df.sparkSession
    groups = settle(group_counts(df, group))
    total = groups.agg(F.count(F.lit(1)), F.sum("group_rows")).first()
    n_groups, n_rows = total[0], total[1] or 0
    wanted = n_rows if draws is None else draws
    if not n_groups:
        return df.withColumn("draw", F.lit(None).cast("long"))
    per_group = wanted / n_groups
    copies = F.greatest(F.lit(1), F.ceil(F.lit(per_group) / F.col("group_rows") / copy_draws))
    numbered = dense_position(groups.withColumn("__all", F.lit(0)), ["__all"],
                              [F.col(group).asc_nulls_first()], "__g", hot_rows)
    sized = lookup_side(numbered.select(
        "__g", group, "group_rows", copies.cast("long").alias("__copies")))

    salted = F.explode(F.sequence(F.lit(0).cast("long"), F.col("__copies") - 1)).alias("__salt")
    by_group = sized.select(group, "__g", "__copies")
    narrow = left_lookup(df.select(group, F.col(key).alias("__key")), by_group, [group], "inner")
    placed = dense_position(
        narrow.withColumn("__digest", digest(F.col("__key"))),
        ["__g"], [F.col("__digest"), F.col("__key")], "__position", hot_rows,
    ).select("__g", "__position", "__key", salted)

    hashed = spark.range(wanted).select(
        F.col("id").alias("draw"), digest(F.lit(seed), F.col("id")).alias("__digest"))
    drawn = left_lookup(
        hashed.select("draw", F.floor(unit(F.col("__digest")) * n_groups).alias("__g"),
                      unit(F.col("__digest"), 1).alias("__u")),
        sized.select("__g", "group_rows", "__copies"), ["__g"], "inner",
    ).select("draw", "__g", F.floor(F.col("__u") * F.col("group_rows")).alias("__position"),
             (F.col("draw") % F.col("__copies")).alias("__salt"))

    picked = drawn.join(placed, ["__g", "__position", "__salt"]).select("draw", "__key")
    return gathered(df, picked, key, copy_draws)


def shuffled(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """Rows in a reproducible random order: a distributed sort on hashed keys."""
    return df.orderBy(digest(F.lit(seed), F.col(key)), F.col(key))


def shuffle_position(
    df: DataFrame, key: str, seed: int = 42, name: str = "position", hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Add the 0-based place of each row in the order of ``shuffled``.

    Keys and their hashes are placed; rows with further columns meet their place by a join on the key.
    """
    hashed = df.select(key).withColumns({"__all": F.lit(0), "__digest": digest(F.lit(seed), F.col(key))})
    placed = dense_position(hashed, ["__all"], [F.col("__digest"), F.col(key)], name, hot_rows).select(key, name)
    return placed if df.columns == [key] else df.join(placed, key).select(*df.columns, name)
