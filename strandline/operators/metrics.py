"""Classification metrics, exact with tied scores, for one or many groups."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from strandline.plans.running import HOT_ROWS, dense_position, keyed_position
from strandline.plans.sizing import left_lookup, lookup_side

MOST_RANGES = 65_536
CURVE_METRICS = ["auc", "pr_auc"]
COUNT_METRICS = ["acc", "mcc", "f1", "recall", "precision"]


def _ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))


def count_metrics(tp: Column, fp: Column, fn: Column, tn: Column) -> dict[str, Column]:
    """Metrics of a confusion table; 0 where a denominator is 0, also on an empty table."""
    tp, fp, fn, tn = (F.coalesce(c, F.lit(0)).cast("double") for c in (tp, fp, fn, tn))
    return {
        "acc": _ratio(tp + tn, tp + fp + fn + tn),
        "mcc": _ratio(tp * tn - fp * fn, F.sqrt(tp + fp) * F.sqrt(tp + fn)
                      * F.sqrt(tn + fp) * F.sqrt(tn + fn)),
        "f1": _ratio(2.0 * tp, 2.0 * tp + fp + fn),
        "recall": _ratio(tp, tp + fn),
        "precision": _ratio(tp, tp + fp),
    }


def confusion(label: Column, prediction: Column) -> dict[str, Column]:
    """Aggregates counting the four cells of a 0/1 confusion table."""
    cells = {"tp": (1, 1), "fp": (0, 1), "fn": (1, 0), "tn": (0, 0)}
    return {name: F.sum(((label == t) & (prediction == p)).cast("long")).alias(name)
            for name, (t, p) in cells.items()}


def metrics_by_group(
    df: DataFrame, label: Column, prediction: Column, by: list[str] = [], count_skipped: bool = False,
) -> DataFrame:
    """Accuracy, MCC, F1, recall and precision per group, from one conditional aggregate.

    Rows whose label or prediction is null or not 0/1 are in no cell; ``count_skipped`` adds their
    number as ``skipped``.
    """
    cells = df.groupBy(*by).agg(*confusion(label, prediction).values(), skipped(label, prediction))
    metrics = count_metrics(*(F.col(c) for c in ("tp", "fp", "fn", "tn")))
    return cells.select(*by, *[m.alias(name) for name, m in metrics.items()], *["skipped"] * count_skipped)


def skipped(label: Column, prediction: Column) -> Column:
    """Aggregate: rows that the confusion table can't count."""
    usable = label.isin(0, 1) & prediction.isin(0, 1)
    return F.coalesce(F.sum((~F.coalesce(usable, F.lit(False))).cast("long")), F.lit(0)).alias("skipped")


def metric_bundle(
    df: DataFrame, label: Column, score: Column, prediction: Column, by: list[str] = [],
    hot_rows: int = HOT_ROWS, count_skipped: bool = False,
) -> DataFrame:
    """All seven metrics per group: ``acc mcc f1 auc pr_auc recall precision``.

    Rows whose label or prediction is null or not 0/1 are in no cell of the confusion table, and
    those with such a label on no curve; ``count_skipped`` adds their number as ``skipped``.

    Rows are first reduced to one row per distinct score, with partial sums map-side; the
    curve areas then need running counts in score order. Beyond ``hot_rows`` rows the scores are cut into ranges: the
    counts of every range are summed first, and the areas of a range start from those of the ranges above it, so that
    nothing is written but one row per group and range.
    AUC counts ties half and is 0.5 with one class; ``pr_auc`` is average precision over
    distinct thresholds.
    """
    keys = by or ["__all"]
    named = df if by else df.withColumn("__all", F.lit(0))
    cells = [F.sum((label == 1).cast("long")).alias("p"), F.sum((label == 0).cast("long")).alias("n")]
    cuts = _score_cuts(df, score, hot_rows)
    if cuts is None:
        parts = keys
    else:
        parts = [*keys, "__range"]
        named = named.withColumn("__range", _score_range(cuts)(score.cast("double")))
    points = named.groupBy(*parts, score.alias("__score")).agg(
        *cells, *confusion(label, prediction).values(), skipped(label, prediction))
    above = Window.partitionBy(*parts).orderBy(F.col("__score").desc()).rowsBetween(Window.unboundedPreceding, 0)
    curve = points.withColumns({"up_p": F.sum("p").over(above), "up_n": F.sum("n").over(above)})
    if cuts is not None:
        higher = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
        carried = lookup_side(named.groupBy(*parts).agg(*cells).select(*parts, *[
            F.coalesce(F.sum(c).over(higher), F.lit(0)).alias(f"__from_{c}") for c in ("p", "n")]))
        curve = left_lookup(curve, carried, parts).withColumns({
            f"up_{c}": F.col(f"up_{c}") + F.col(f"__from_{c}") for c in ("p", "n")})
    p, n, up_p, up_n = (F.col(c).cast("double") for c in ("p", "n", "up_p", "up_n"))
    totals = curve.groupBy(*keys).agg(
        F.sum("p").cast("double").alias("__p"), F.sum("n").cast("double").alias("__n"),
        F.sum(n * (up_p - p) + 0.5 * n * p).alias("__area"),
        F.sum(F.when(up_p + up_n > 0, p * up_p / (up_p + up_n)).otherwise(0.0)).alias("__ap"),
        *[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn", "skipped")])
    if not by:  # an empty input still gives one row
        totals = totals.groupBy().agg(*[F.sum(c).alias(c) for c in totals.columns if c != "__all"])
    both = F.coalesce(F.least("__p", "__n"), F.lit(0.0)) > 0
    metrics = count_metrics(*(F.col(c) for c in ("tp", "fp", "fn", "tn"))) | {
        "auc": F.when(both, F.col("__area") / (F.col("__p") * F.col("__n"))).otherwise(0.5),
        "pr_auc": F.when(F.col("__p") > 0, F.col("__ap") / F.col("__p")).otherwise(0.0),
    }
    return totals.select(*by, *[m.alias(name) for name, m in metrics.items()],
                         *[F.coalesce("skipped", F.lit(0)).alias("skipped")] * count_skipped)


def _score_cuts(df: DataFrame, score: Column, hot_rows: int) -> list[float] | None:
    """About evenly spaced scores to cut ranges at, or None for up to ``hot_rows`` rows."""
    rows = df.count()
    if rows <= hot_rows:
        return None
    ranges = min(MOST_RANGES, 2 * -(-rows // hot_rows))
    shares = [i / ranges for i in range(1, ranges)]
    found = df.agg(F.percentile_approx(score.cast("double"), shares, 4 * ranges)).first()[0]
    return sorted(set(found or []))


def _score_range(cuts: list[float]):
    """Number of a score's range, from the highest scores down: NaN is above all numbers, null below."""
    edges = np.array(cuts)

    @F.arrow_udf("int")
    def number(scores: pa.Array) -> pa.Array:
        values = scores.to_numpy(zero_copy_only=False)
        found = len(edges) - np.searchsorted(edges, values, side="left")
        return pa.array(np.where(scores.is_null().to_numpy(zero_copy_only=False), len(edges) + 1, found), pa.int32())

    return number


def auc_ap(
    df: DataFrame, label: Column, score: Column, by: list[str] = [], hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Exact ROC AUC and average precision per group."""
    return metric_bundle(df, label, score, F.lit(0), by, hot_rows).select(*by, *CURVE_METRICS)


def number_batches(
    df: DataFrame, epoch: str, order: list[Column] | list[str], batch_rows: int = 32,
    name: str = "batch", hot_rows: int = HOT_ROWS, key: str | None = None,
) -> DataFrame:
    """Add the number of the fixed-size batch a row falls into inside its epoch.

    With a unique ``key`` and an ``order`` of column names, only these and the epoch are sorted; the rows meet their
    batch by a join on the key.
    """
    placed = dense_position(df, [epoch], order, name, hot_rows) if key is None else keyed_position(
        df, [epoch], order, key, name, hot_rows)
    return placed.withColumn(name, F.floor(F.col(name) / batch_rows))


def epoch_loss(df: DataFrame, epoch: str, batch: str, loss: Column) -> DataFrame:
    """Loss per epoch, as mean of batch means (``batch_mean``) and over rows (``row_mean``).

    The two differ when the last batch is short.
    """
    batches = df.groupBy(epoch, batch).agg(
        F.avg(loss).alias("__mean"), F.sum(loss).alias("__sum"), F.count(loss).alias("__rows"))
    return batches.groupBy(epoch).agg(
        F.avg("__mean").alias("batch_mean"),
        (F.sum("__sum") / F.sum("__rows")).alias("row_mean"),
        F.count(F.lit(1)).alias("batches"))
