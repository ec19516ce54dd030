"""Early stopping: one rule as a step of state, and the same as window functions over whole loss histories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import free_name


def improves(least, loss, delta: float):
    """Whether a loss is better than the least one so far by more than the share delta; of numbers or columns."""
    return least - loss > delta * least


def step(least: float | None, counter: int, loss: float, delta: float) -> tuple[float, int]:
    """The least loss and the losses since the last improvement, after one more loss."""
    if least is None:
        return loss, 0
    # min() keeps the least one where the loss is NaN, and a least one that is NaN
    return min(least, loss), 0 if improves(least, loss, delta) else counter + 1


class EarlyStopping:
    """Call with each loss: True once `patience` losses in a row failed to improve the minimum by the share delta."""

    def __init__(self, patience: int = 5, delta: float = 0.01) -> None:
        self.patience, self.delta, self.counter = patience, delta, 0
        self.least: float | None = None

    def __call__(self, loss: float) -> bool:
        started = self.least is not None
        self.least, self.counter = step(self.least, self.counter, loss, self.delta)
        return started and bool(self)

    def __bool__(self) -> bool:
        return self.counter >= self.patience


def early_stopping(df: DataFrame, series: Sequence[str], order: Sequence[str], loss: str, *, patience: int = 5, delta: float = 0.01) -> DataFrame:
    """df with counter and stop after each step of its series.

    A NaN loss is no improvement and leaves the least loss as it is; a first NaN stays the least one, so nothing improves it. Null losses are left out.
    """
    df = df.where(F.col(loss).isNotNull())
    run = free_name(df, "run", "counter", "stop")
    w = Window.partitionBy(*series).orderBy(*order)
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    before: Column = F.min(F.when(~F.isnan(loss), F.col(loss))).over(past)
    first = F.first(loss).over(past)
    better = ~F.isnan(loss) & ~F.isnan(first) & improves(before, F.col(loss), delta)
    df = df.withColumn(run, F.when(first.isNull() | better, 1).otherwise(0))
    df = df.withColumn(run, F.sum(run).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    counter = (F.row_number().over(Window.partitionBy(*series, run).orderBy(*order)) - 1).cast("int")
    return df.withColumn("counter", counter).withColumn("stop", F.col("counter") >= patience).drop(run)
