"""Queries over a metric history: best checkpoint, early stop, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from strandline.plans.running import HOT_ROWS, hot_groups, running

START = -1.0  # a value has to exceed this to count as a first improvement


def best_checkpoint(
    history: DataFrame, run: list[str], epoch: str = "epoch", value: str = "value",
    patience: int = 8, hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Per run: ``best_epoch``, ``best_value``, ``stop_epoch`` and ``last_epoch``.

    An epoch is a checkpoint when it beats every earlier one strictly, so the first of equal
    values wins. A run stops at the first epoch that is ``patience`` epochs past the last
    checkpoint, and later epochs are ignored; ``stop_epoch`` is null when it never stops.
    A run that never exceeds -1 has no checkpoint. Epochs are consecutive whole numbers.
    """
    # NaN never improves anything, while Spark would sort it above every number.
    number = F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double"))
    order = [F.col(epoch)]
    history = history.select(*run, epoch, number.alias("__v"))
    hot = hot_groups(history, run, hot_rows)
    seen = running(history, run, order, {"__before": ("max", F.col("__v"))}, False, hot_rows, hot)
    better = F.col("__v") > F.greatest(F.col("__before"), F.lit(START))
    marked = running(seen.withColumn("__better", better), run, order, {
        "__last": ("max", F.when(F.col("__better"), F.col(epoch))),
        "__best": ("max", F.when(F.col("__better"), F.col("__v"))),
        "__first": ("min", F.col(epoch)),
    }, True, hot_rows, hot)
    waited = F.col(epoch) - F.coalesce(F.col("__last"), F.col("__first") - 1)
    state = F.struct(F.col(epoch).alias("at"), "__last", "__best")
    ends = marked.groupBy(*run).agg(
        F.min(F.when(waited >= patience, state)).alias("stop"), F.max(state).alias("end"))
    final = F.coalesce(F.col("stop"), F.col("end"))
    return ends.select(
        *run, final["__last"].alias("best_epoch"), final["__best"].alias("best_value"),
        F.col("stop.at").alias("stop_epoch"), final["at"].alias("last_epoch"))


def history_report(history: DataFrame, epoch: str = "epoch", every: int = 5) -> DataFrame:
    """The epochs a training log prints: the first one and every fifth."""
    return history.where(((F.col(epoch) + 1) % every == 0) | (F.col(epoch) == 0))


def cv_summary(best: DataFrame, run: list[str]) -> DataFrame:
    """Mean best value over the folds of a run; a fold without checkpoint counts as -1."""
    return best.groupBy(*run).agg(
        F.avg(F.coalesce(F.col("best_value"), F.lit(START))).alias("mean_best"),
        F.count(F.lit(1)).alias("folds"))
