"""Exact stratified splits and folds.

Which row goes where is decided by the md5 of its key; how many rows of a stratum go to
each part is exact. A row is placed by comparing its md5 with a few cut values of its
stratum, so the wide rows are never shuffled: one scan counts rows per (stratum, md5
prefix), a second one ranks only the rows of the prefixes in which a cut falls, and the
final scan compares.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from strandline.functions.hashing import digest
from strandline.plans.running import HOT_ROWS, dense_position, running
from strandline.plans.sizing import BROADCAST_BYTES, fits_broadcast, hinted, left_lookup, settle

PREFIX_DIGITS = 3  # 4096 buckets per stratum

_STRATUM, _HASH, _KEY, _PREFIX = "__stratum", "__hash", "__key", "__prefix"


def _keyed(df: DataFrame, stratum: Column, key: str, seed: int, digits: int) -> DataFrame:
    hashed = digest(F.lit(seed), F.col(key))
    return df.withColumns({
        _STRATUM: stratum, _HASH: hashed, _KEY: F.col(key).cast("string"),
    }).withColumn(_PREFIX, F.substring(_HASH, 1, digits))


def prefix_counts(
    df: DataFrame, stratum: Column, key: str, seed: int = 42, digits: int = PREFIX_DIGITS, unique: bool = False,
) -> DataFrame:
    """Rows per (stratum, md5 prefix), written once; everything exact is derived from it.

    With ``unique``, the same scan counts the distinct hashes of each bucket, and rows that repeat a key of
    their stratum are an error that gives their number. Hashes are then shuffled, each once for a task.
    """
    grouped = _keyed(df, stratum, key, seed, digits).groupBy(_STRATUM, _PREFIX)
    if not unique:
        return settle(grouped.agg(F.count(F.lit(1)).alias("rows")))
    counts = settle(grouped.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(_HASH).alias("__keys")))
    repeats = counts.agg(F.sum(F.col("rows") - F.col("__keys"))).first()[0]
    if repeats:
        raise ValueError(f"{repeats} rows repeat a key of another row in their stratum, so quotas can't be exact")
    return counts.drop("__keys")


def stratum_sizes(counts: DataFrame) -> DataFrame:
    """Rows per stratum: ``stratum``, ``n``."""
    return counts.groupBy(F.col(_STRATUM).alias("stratum")).agg(F.sum("rows").alias("n"))


def _cut_values(
    keyed: DataFrame, counts: DataFrame, quotas: DataFrame,
    small: Callable[[DataFrame], DataFrame], hot_rows: int,
) -> DataFrame:
    """Per stratum the array of the (hash, key) pairs that end each part but the last."""
    upto = Window.partitionBy(_STRATUM).orderBy(_PREFIX).rowsBetween(
        Window.unboundedPreceding, 0)
    spans = counts.withColumn("__end", F.sum("rows").over(upto)).withColumn(
        "__start", F.col("__end") - F.col("rows"))
    ends = quotas.select(
        F.col("stratum").alias(_STRATUM), "n", F.posexplode("ends").alias("__part", "__rank"))
    cuts = left_lookup(ends, spans.drop("rows"), [_STRATUM], "inner").where((F.col("__rank") > F.col("__start")) & (F.col("__rank") <= F.col("__end"))
            & (F.col("__rank") < F.col("n"))).select(
        _STRATUM, _PREFIX, "__part", (F.col("__rank") - F.col("__start")).alias("__local"))

    near = left_lookup(
        keyed.select(_STRATUM, _PREFIX, _HASH, _KEY), small(cuts), [_STRATUM, _PREFIX], "left_semi")
    # A bucket may be large too: its rows are ranked in ranges then.
    ranked = dense_position(near, [_STRATUM, _PREFIX], [F.col(_HASH), F.col(_KEY)], "__local", hot_rows).withColumn(
        "__local", F.col("__local") + 1)
    found = left_lookup(
        ranked, small(cuts), [_STRATUM, _PREFIX, "__local"], "inner"
    ).select(_STRATUM, "__part", F.struct(
        F.col(_HASH).alias("h"), F.col(_KEY).alias("k")).alias("__cut"))

    # Hex digests lie between '' and 'g': an empty part ends before every row, and a part
    # that reaches the end of its stratum ends after every row.
    outside = ends.where((F.col("__rank") <= 0) | (F.col("__rank") >= F.col("n"))).select(
        _STRATUM, "__part", F.struct(
            F.when(F.col("__rank") <= 0, "").otherwise("g").alias("h"),
            F.lit("").alias("k")).alias("__cut"))
    return found.unionByName(outside).groupBy(_STRATUM).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("__part", "__cut"))),
                    lambda c: c["__cut"]).alias("__cuts"))


def assign_parts(
    df: DataFrame, stratum: Column, key: str, counts: DataFrame, quotas: DataFrame,
    n_parts: int, name: str, seed: int = 42, digits: int = PREFIX_DIGITS, hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Add the part number of each row; ``quotas`` holds ``stratum``, ``n`` and ``ends``.

    ``ends[i]`` is the number of rows of the stratum in the parts 0 to i, for all parts
    but the last. ``key`` has to be unique (``repeated_keys`` lists what is not).
    """
    keyed = _keyed(df, stratum, key, seed, digits)
    # Every table joined inside has at most one row per stratum and part, without keys. The cut
    # values hold key texts of any length: they are computed once and measured.
    fits = fits_broadcast(quotas, BROADCAST_BYTES // (4 * n_parts))
    small = F.broadcast if fits else (lambda table: table)
    cuts = hinted(settle(_cut_values(keyed, counts, quotas, small, hot_rows)))
    me = F.struct(F.col(_HASH).alias("h"), F.col(_KEY).alias("k"))
    part = F.lit(0)
    for i in range(n_parts - 1):
        part = part + (me > F.col("__cuts")[i]).cast("int")
    return left_lookup(keyed, cuts, [_STRATUM]).withColumn(name, part).drop(
        _STRATUM, _HASH, _KEY, _PREFIX, "__cuts")


def repeated_keys(df: DataFrame, key: str) -> DataFrame:
    """Keys of more than one row, with the number of their rows; exact quotas need it to be empty."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")


def fold_parts(df: DataFrame, k: int, fold: str = "fold") -> DataFrame:
    """Every row once per fold number, with its ``part`` there: val in its own fold, else train."""
    return df.withColumn("fold_number", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).withColumn(
        "part", F.when(F.col(fold) == F.col("fold_number"), "val").otherwise("train"))


def train_part(df: DataFrame, fold_number: int, fold: str = "fold") -> DataFrame:
    """Training rows of a fold: all other folds, and rows without a fold."""
    return df.where(F.col(fold).isNull() | (F.col(fold) != fold_number))


def val_part(df: DataFrame, fold_number: int, fold: str = "fold") -> DataFrame:
    """Validation rows of a fold."""
    return df.where(F.col(fold) == fold_number)


def fold_quotas(sizes: DataFrame, k: int) -> DataFrame:
    """Fold sizes per stratum: row j of the strata laid end to end belongs to fold j mod k."""
    placed = running(sizes.withColumn("__all", F.lit(0)), ["__all"], [_by_name()],
                     {"start": ("sum", F.col("n"))}, inclusive=False)
    start = F.coalesce(F.col("start"), F.lit(0))

    def upto(rows, fold):  # how many of the first `rows` rows have number = fold (mod k)
        return F.floor((rows + (k - 1 - fold)) / F.lit(k))

    ends, total = [], F.lit(0).cast("long")
    for f in range(k - 1):
        total = total + upto(start + F.col("n"), f) - upto(start, f)
        ends.append(total)
    return placed.select("stratum", "n", F.array(*ends).alias("ends"))


def stratified_kfold(
    df: DataFrame, stratum: Column, key: str, k: int = 5, name: str = "fold", seed: int = 42,
    digits: int = PREFIX_DIGITS, hot_rows: int = HOT_ROWS,
    unique: bool = False,
) -> DataFrame:
    """Add the fold number; fold sizes of a stratum differ by one row at most.

    ``unique`` makes repeated keys an error instead of rows that share a place.
    """
    counts = prefix_counts(df, stratum, key, seed, digits, unique)
    quotas = settle(fold_quotas(stratum_sizes(counts), k))
    biggest = quotas.agg(F.max("n")).first()[0]
    if biggest is not None and biggest < k:
        raise ValueError(f"no stratum has {k} rows, so {k} folds cannot be made")
    return assign_parts(df, stratum, key, counts, quotas, k, name, seed, digits, hot_rows)


def _by_name() -> Column:
    return F.col("stratum").asc_nulls_first()


def _total(table: DataFrame, value: Column) -> Column:
    """Sum over a table as a scalar subquery; 0 when it is empty."""
    return F.coalesce(table.agg(F.sum(value)).scalar(), F.lit(0))


def _share(table: DataFrame, size: str, take: Column, of: Column, name: str) -> DataFrame:
    """Split ``take`` of ``of`` rows over the strata by largest remainder, ties by name.

    Exact integer arithmetic: a stratum of c rows gets the whole part of c * take / of, and
    one more row if its remainder is among the largest.
    """
    product = F.col(size).cast("decimal(19,0)") * take.cast("decimal(19,0)")
    divisor = F.greatest(of, F.lit(1)).cast("decimal(19,0)")
    parts = table.withColumns({
        "__all": F.lit(0), "__whole": F.call_function("div", product, divisor),
        "__rest": product % divisor})
    missing = take - _total(parts, F.col("__whole"))
    ranked = dense_position(parts, ["__all"], [F.col("__rest").desc(), _by_name()], "__rank")
    return ranked.withColumn(
        name, F.col("__whole") + (F.col("__rank") < missing).cast("long")
    ).select(*table.columns, name)


def split_quotas(sizes: DataFrame, held_out: float = 0.3, test_of_held: float = 0.5) -> DataFrame:
    """Rows per stratum in ``train``, ``val`` and ``test``, and an ``undersized`` flag.

    The held-out and test sizes are rounded up. A stratum of one row stays in train, and
    strata too small to reach all three parts are flagged instead of raising an error.
    """
    n, single = F.col("n"), F.col("n") == 1
    everything, singles = _total(sizes, n), _total(sizes, single.cast("long"))
    take = F.greatest(everything - F.ceil(everything * F.lit(held_out)) - singles, F.lit(0))
    pooled = sizes.withColumn("__pool", F.when(single, 0).otherwise(n))
    first = settle(_share(pooled, "__pool", take, everything - singles, "__train").select(
        "stratum", "n", F.when(single, 1).otherwise(F.col("__train")).cast("long").alias("train"))
        .withColumn("__held", n - F.col("train")))
    held = _total(first, F.col("__held"))
    val = held - F.ceil(held * F.lit(test_of_held))
    return _share(first, "__held", val, held, "val").select(
        "stratum", "n", "train", "val", (F.col("__held") - F.col("val")).alias("test"),
        ((n < 2) | (F.col("__held") < 2)).alias("undersized"))


def stratified_split(
    df: DataFrame, stratum: Column, key: str, held_out: float = 0.3, test_of_held: float = 0.5,
    name: str = "split", seed: int = 42, digits: int = PREFIX_DIGITS, hot_rows: int = HOT_ROWS,
    unique: bool = False,
) -> DataFrame:
    """Add ``train``, ``val`` or ``test``: by default 70/15/15 with exact quotas per stratum.

    ``unique`` makes repeated keys an error instead of rows that share a place.
    """
    counts = prefix_counts(df, stratum, key, seed, digits, unique)
    quotas = settle(split_quotas(stratum_sizes(counts), held_out, test_of_held).select(
        "stratum", "n", F.array(F.col("train"), F.col("train") + F.col("val")).alias("ends")))
    parts = assign_parts(df, stratum, key, counts, quotas, 3, name, seed, digits, hot_rows)
    return parts.withColumn(name, F.element_at(
        F.array(F.lit("train"), F.lit("val"), F.lit("test")), F.col(name) + 1))
