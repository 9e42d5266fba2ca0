"""The run monitor as a stateful stream: the same alarms as the batch form, one state for each run."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from kelpie.operators.monitor import DELTA, FLAT, GAP, PATIENCE, WARM

STATE = "first array<double>, recent array<double>, seen long, best double, best_iteration long, since int, latest double, raised array<string>"
ALARM = "run string, alarm string, iteration long"


def follow(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Rows of one run in order of ``nth``; each alarm is told once."""
    if state.exists:
        first, recent, seen, best, best_at, since, latest, raised = state.get
        first, recent, raised = list(first), list(recent), list(raised)
    else:
        first, recent, seen, best, best_at, since, latest, raised = [], [], 0, math.inf, 0, 0, math.nan, []
    rows, told = pd.concat(list(batches)).sort_values("nth"), []

    def alarm(name: str, at: int) -> None:
        if name not in raised:
            raised.append(name)
            told.append((key[0], name, at))

    for r in rows.itertuples():
        at = int(r.iteration)
        if r.kind == "train":
            loss = math.nan if pd.isna(r.train_loss) else float(r.train_loss)
            first, recent, seen, latest = (first + [loss])[:5], (recent + [loss])[-5:], seen + 1, loss
            if not math.isfinite(loss):
                alarm("diverged", at)
            elif seen >= WARM and abs(sum(recent) / 5 - sum(first) / 5) < FLAT:
                alarm("flat", at)
        else:
            loss = float(r.val_loss)
            if loss < best - DELTA:
                best, best_at, since = loss, at, 0
            else:
                since += 1
                if since >= PATIENCE:
                    alarm("no_improvement", at)
            if loss - latest > GAP:
                alarm("memorising", at)
    state.update((first, recent, seen, best, best_at, since, latest, raised))
    yield pd.DataFrame(told, columns=["run", "alarm", "iteration"])


def alarm_stream(log: DataFrame) -> DataFrame:
    """Alarms of a streaming metric log (run, nth, kind, iteration, train_loss, val_loss) as they arise.

    Rows of a run must arrive in order across batches; within a batch they are put in order.
    """
    return log.groupBy("run").applyInPandasWithState(follow, ALARM, STATE, "append", GroupStateTimeout.NoTimeout)
