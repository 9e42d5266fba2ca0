"""Alarms of training runs from their metric log: batch windows over (run, nth, kind, iteration, train_loss, val_loss)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FLAT, GAP, DELTA, PATIENCE, WARM = 1e-3, 0.5, 1e-4, 3, 12


def with_latest_train(log: DataFrame) -> DataFrame:
    """``log`` with the latest train loss before or at each row, and what validation exceeds it by."""
    before = Window.partitionBy("run").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    out = log.withColumn("latest_train", F.last(F.when(F.col("kind") == "train", F.col("train_loss")), ignorenulls=True).over(before))
    return out.withColumn("gap", F.when(F.col("kind") == "val", F.col("val_loss") - F.col("latest_train")))


def flat_windows(log: DataFrame) -> DataFrame:
    """Train rows with the means of the run's first and last five losses, from the twelfth on."""
    order = Window.partitionBy("run").orderBy("nth")
    train = log.where("kind = 'train'").withColumn("place", F.row_number().over(order))
    first = F.avg(F.when(F.col("place") <= 5, F.col("train_loss"))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    recent = F.avg("train_loss").over(order.rowsBetween(-4, 0))
    return train.withColumns({"first_mean": first, "recent_mean": recent}).where(F.col("place") >= WARM)


def best_validation(log: DataFrame) -> DataFrame:
    """(run, nth, iteration, val_loss, best, best_iteration, since): a value counts as better only by over 1e-4.

    That is no window function, so each run's rows pass one task in order, which carries three numbers.
    """
    kinds = {f.name: f.dataType.simpleString() for f in log.schema}
    schema = f"run {kinds['run']}, nth {kinds['nth']}, iteration {kinds['iteration']}, val_loss double, best double, best_iteration long, since int"

    def follow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        run, best, at, since = None, math.inf, 0, 0
        for batch in batches:
            held = []
            for r, iteration, loss in zip(batch["run"], batch["iteration"], batch["val_loss"], strict=True):
                if r != run:
                    run, best, at, since = r, math.inf, 0, 0
                if loss < best - DELTA:
                    best, at, since = loss, iteration, 0
                else:
                    since += 1
                held.append((best, at, since))
            yield batch.assign(**{c: [h[i] for h in held] for i, c in enumerate(("best", "best_iteration", "since"))})

    val = log.where("kind = 'val'").select("run", "nth", "iteration", F.col("val_loss").cast("double").alias("val_loss"))
    return val.repartition("run").sortWithinPartitions("run", "nth").mapInPandas(follow, schema)


def alarms(log: DataFrame) -> DataFrame:
    """(run, alarm, iteration): the first iteration of each alarm: diverged, flat, no_improvement, memorising."""
    log = log.select("run", F.col("nth").cast("long").alias("nth"), "kind", F.col("iteration").cast("long").alias("iteration"), "train_loss", "val_loss")
    odd = F.isnan("train_loss") | F.col("train_loss").isin(float("inf"), float("-inf")) | F.col("train_loss").isNull()
    found = [
        log.where((F.col("kind") == "train") & odd).withColumn("alarm", F.lit("diverged")),
        flat_windows(log).where(~odd & (F.abs(F.col("recent_mean") - F.col("first_mean")) < FLAT)).withColumn("alarm", F.lit("flat")),
        best_validation(log).where(F.col("since") >= PATIENCE).withColumn("alarm", F.lit("no_improvement")),
        with_latest_train(log).where(F.col("gap") > GAP).withColumn("alarm", F.lit("memorising")),
    ]
    rows = [f.select("run", "alarm", "nth", "iteration") for f in found]
    every = rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])
    return every.groupBy("run", "alarm").agg(F.min_by("iteration", "nth").alias("iteration"))
