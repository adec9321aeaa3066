"""Exact sampling with replacement by any weights.

Weights become whole units of one power of two, so that their sums are exact in any order. Rows lie side by side in the
order of the md5 of their key, each as long as its units. Every draw is a place on that line: a table of bucket totals,
small enough for the driver, tells the bucket, and a search in the running sums of the bucket tells the row.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from strandline.functions.hashing import HEX_DIGITS, digest, unit
from strandline.plans import sizing
from strandline.plans.sizing import left_lookup, lookup_side, settle

BUCKET_ROWS = 65_536
MOST_BUCKETS = 1 << 20
TASK_DRAWS = 262_144
COPY_DRAWS = 65_536
COARSE_BITS, TOTAL_BITS = 31, 61
DRAW_BITS = 4 * HEX_DIGITS


def _scaled(weight: Column, exponent: int) -> Column:
    """Whole units of ``weight`` times a power of two; in two steps, as one factor may be beyond a double."""
    half = exponent // 2
    return F.floor(weight * F.lit(2.0 ** half) * F.lit(2.0 ** (exponent - half)))


def weight_exponent(rows: DataFrame, weight: str) -> int | None:
    """The power of two that brings the sum of positive weights just under ``2^TOTAL_BITS``; None without a weight.

    It follows from the largest weight and a sum of whole numbers, neither of which depends on the order of the rows.
    """
    most = rows.agg(F.max(weight)).first()[0]
    if most is None:
        return None
    if math.isinf(most):
        raise ValueError("a weight is infinite")
    first = COARSE_BITS - math.frexp(most)[1]
    coarse = rows.agg(F.sum((_scaled(F.col(weight), first) + 1).cast("decimal(38,0)"))).first()[0]
    return first + TOTAL_BITS - int(coarse).bit_length()


def _search(rows: pa.Table, draws: pa.Table) -> pa.Table:
    """The row under each draw's place, in one bucket."""
    rows = rows.sort_by([("__digest", "ascending"), ("__name", "ascending")])
    ends = np.cumsum(rows["__units"].to_numpy())
    at = np.searchsorted(ends, draws["__at"].to_numpy(), side="right")
    return pa.table({"draw": draws["draw"], "__key": rows["__key"].take(pa.array(at))})


def gathered(df: DataFrame, picks: DataFrame, key: str, copy_draws: int = COPY_DRAWS) -> DataFrame:
    """The rows of ``df`` behind ``picks`` (``draw``, ``__key``), one for each draw.

    Rows drawn more than ``copy_draws`` times are at most draws / ``copy_draws`` many; they are broadcast to their draws
    if their size allows it, so that no task has to copy one row for all of them. All others meet their draws by a join on the key.
    """
    picks = settle(picks)
    hot = settle(picks.groupBy("__key").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > copy_draws).select("__key"))
    named = df.withColumn("__key", F.col(key))
    columns = [*df.columns, "draw"]
    if hot.isEmpty():
        return named.join(picks, "__key").select(columns)
    often = lookup_side(hot)
    wide = settle(named.join(often, "__key", "left_semi"))
    if not sizing.fits_broadcast(wide):
        return named.join(picks, "__key").select(columns)
    copied = picks.join(often, "__key", "left_semi").join(F.broadcast(wide), "__key").select(columns)
    return copied.unionByName(named.join(picks.join(often, "__key", "left_anti"), "__key").select(columns))


def weighted_sample(
    df: DataFrame, weight: Column, key: str, draws: int | None = None, seed: int = 42,
    bucket_rows: int = BUCKET_ROWS, task_draws: int = TASK_DRAWS, copy_draws: int = COPY_DRAWS,
) -> DataFrame:
    """Exactly ``draws`` rows with replacement (by default as many as there are rows), each draw with a probability
    in proportion to the weight. Adds ``draw``.

    ``key`` has to be unique. Null, NaN, zero and negative weights are never drawn, nor are those under 2^-60 of the sum of all; an
    infinite weight is an error. Without any weight the result is empty. A draw has 52 bits, so among very many rows
    single probabilities are off by up to 2^-52.

    Only key and weight are shuffled for the search, by bucket; buckets that get more than ``task_draws`` draws are searched by
    several tasks. The wide rows move once, in the last join.
    """
    spark = df.sparkSession
    w = F.col("__w")
    all_rows = df.select(F.col(key).alias("__key"), weight.cast("double").alias("__w"))
    wanted = all_rows.count() if draws is None else draws
    rows = settle(all_rows.where((w > 0) & ~F.isnan(w)).withColumn("__digest", digest(F.col("__key"))))
    exponent = weight_exponent(rows, "__w")
    if exponent is None or not wanted:
        return df.withColumn("draw", F.lit(None).cast("long")).limit(0)
    placed = rows.select("__key", F.col("__key").cast("string").alias("__name"), "__digest", _scaled(w, exponent).alias("__units")).where("__units > 0")
    buckets = min(MOST_BUCKETS, -(-rows.count() // bucket_rows))
    placed = placed.withColumn("__bucket", F.floor(unit(F.col("__digest")) * buckets))
    units = np.zeros(buckets, np.int64)
    for row in placed.groupBy("__bucket").agg(F.sum("__units").alias("units")).collect():
        units[row["__bucket"]] = row.units
    ends = np.cumsum(units)
    total = int(ends[-1])
    # Draws are expected in proportion to a bucket's units; so many tasks share its search.
    pieces = np.array([1 + wanted * u // total // task_draws for u in units.tolist()], np.int64)
    table = spark.sparkContext.broadcast((ends, units, pieces))

    @F.arrow_udf("struct<bucket:long,piece:long,at:long>")
    def find(draw: pa.Array, bits: pa.Array) -> pa.Array:
        ends, units, pieces = table.value
        places = np.array([(b * total) >> DRAW_BITS for b in bits.to_pylist()], np.int64)
        bucket = np.searchsorted(ends, places, side="right")
        piece = draw.to_numpy() % pieces[bucket]
        return pa.StructArray.from_arrays([pa.array(bucket), pa.array(piece), pa.array(places - ends[bucket] + units[bucket])],
                                          names=["bucket", "piece", "at"])

    @F.arrow_udf("long")
    def shared(bucket: pa.Array) -> pa.Array:
        return pa.array(table.value[2][bucket.to_numpy()])

    bits = F.conv(F.substring(digest(F.lit(seed), F.col("id")), 1, HEX_DIGITS), 16, 10).cast("long")
    drawn = spark.range(wanted).select(F.col("id").alias("draw"), find(F.col("id"), bits).alias("f")).select(
        "draw", F.col("f.bucket").alias("__bucket"), F.col("f.piece").alias("__piece"), F.col("f.at").alias("__at"))
    dealt = placed.withColumn("__piece", F.explode(F.sequence(F.lit(0).cast("long"), shared(F.col("__bucket")) - 1)))
    kind = df.schema[key].dataType.simpleString()
    picks = dealt.groupBy("__bucket", "__piece").cogroup(drawn.groupBy("__bucket", "__piece")).applyInArrow(
        _search, f"draw long, __key {kind}")
    return gathered(df, picks, key, copy_draws)


def weight_shares(df: DataFrame, weight: Column, key: str) -> DataFrame:
    """Each key's exact share of the units that ``weighted_sample`` draws from: ``key``, ``units``, ``share``."""
    w = F.col("__w")
    rows = settle(df.select(F.col(key), weight.cast("double").alias("__w")))
    exponent = weight_exponent(rows.where((w > 0) & ~F.isnan(w)), "__w")
    units = F.lit(0).cast("long") if exponent is None else F.when((w > 0) & ~F.isnan(w), _scaled(w, exponent)).otherwise(0)
    counted = rows.select(key, units.alias("units"))
    whole = lookup_side(counted.agg(F.sum("units").alias("__all")).withColumn("__one", F.lit(1)))
    joined = left_lookup(counted.withColumn("__one", F.lit(1)), whole, ["__one"])
    return joined.select(key, "units", F.try_divide(F.col("units").cast("double"), F.col("__all").cast("double")).alias("share"))
