"""Structured Streaming forms of the statistics and of early stopping."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.stats import welford
from ..operators.training import step as next_state


def statistics_sink(stream: DataFrame, shape: Sequence[int], path: str, checkpoint: str, *, dim: Sequence[int] | None = (0,), column: str = "data") -> StreamingQuery:
    """Writes each micro-batch's (pos, count, mean, m2) under its batch id; merge() of the folder is the running total.

    A batch that is run again after a failure overwrites its own folder, so nothing counts twice.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        welford(batch, shape, dim, column=column).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stop_signals(stream: DataFrame, series: str, step: str, loss: str, *, patience: int = 5, delta: float = 0.01) -> DataFrame:
    """Rows (series, step, counter, stop) of a stream of losses; each series keeps its least loss and its counter as state.

    Steps of one series must come in order across batches; within a batch they are sorted. NaN losses count as in EarlyStopping,
    nulls are left out.
    """

    def run(key: tuple, frames: Iterator, state: GroupState) -> Iterator:
        import pandas as pd

        least, counter = state.get if state.exists else (None, 0)
        out = []
        rows = pd.concat(list(frames))[[step, loss]].sort_values([step, loss])
        for at, value in rows.itertuples(index=False):
            least, counter = next_state(least, counter, value, delta)
            out.append((key[0], at, counter, counter >= patience))
        if least is not None:
            state.update((float(least), int(counter)))
        yield pd.DataFrame(out, columns=["series", "step", "counter", "stop"])

    rows = stream.select(F.col(series).cast("string").alias(series), F.col(step).cast("long").alias(step), F.col(loss).cast("double").alias(loss)).where(F.col(loss).isNotNull())
    return rows.groupBy(series).applyInPandasWithState(run, "series string, step long, counter int, stop boolean", "least double, counter int", "append", GroupStateTimeout.NoTimeout)


class _InOrder(StatefulProcessor):
    """Early stopping of one series whose steps come in any order: a step waits in the state until those before it have come."""

    def __init__(self, names: tuple[str, str, str], first: int, patience: int, delta: float, wait: int | None) -> None:
        self.names, self.first, self.patience, self.delta, self.wait = names, first, patience, delta, wait

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rule = handle.getValueState("rule", "next long, started boolean, least double, counter int")
        self.pending = handle.getMapState("pending", "step long", "loss double")

    def handleInputRows(self, key, rows, timers):  # noqa: N802  Spark's name
        import pandas as pd

        _, step, loss = self.names
        at = self._state()[0]
        for frame in rows:
            for k, value in zip(frame[step], frame[loss], strict=True):
                if k >= at:  # a step that was released before counts once
                    self.pending.updateValue((int(k),), (float(value),))
        yield pd.DataFrame(self._release(key[0], False), columns=["series", "step", "counter", "stop"])
        if self.wait is not None and next(iter(self.pending.keys()), None) is not None:
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            self.handle.registerTimer(timers.getCurrentProcessingTimeInMs() + self.wait)

    def handleExpiredTimer(self, key, timers, expired):  # noqa: N802
        import pandas as pd

        yield pd.DataFrame(self._release(key[0], True), columns=["series", "step", "counter", "stop"])

    def _state(self) -> tuple:
        return self.rule.get() if self.rule.exists() else (self.first, False, 0.0, 0)

    def _release(self, series: str, all_: bool) -> list[tuple]:
        at, started, least, counter = self._state()
        out = []
        steps = sorted(k[0] for k in self.pending.keys()) if all_ else None
        while True:
            if all_:
                if not steps:
                    break
                at = steps.pop(0)
            if not self.pending.containsKey((at,)):
                break
            loss = self.pending.getValue((at,))[0]
            self.pending.removeKey((at,))
            least, counter = next_state(least if started else None, counter, loss, self.delta)
            started = True
            out.append((series, at, counter, counter >= self.patience))
            at += 1
        self.rule.update((at, started, float(least), int(counter)))
        return out

    def close(self) -> None:
        pass


def ordered_stop_signals(stream: DataFrame, series: str, step: str, loss: str, *, first: int = 0, wait: int | None = None, patience: int = 5, delta: float = 0.01) -> DataFrame:
    """stop_signals() for steps that come in any order across batches: first, first + 1, ... of each series are judged as they become complete.

    A step that has not come holds back those after it; with `wait`, what is held back is judged without it once a series has had no new
    rows for so many milliseconds. A step that is repeated, or comes after its turn, counts once. Steps below first and null losses are left out; NaN
    counts as in EarlyStopping. The session must keep its state in RocksDB.
    """
    rows = stream.select(F.col(series).cast("string").alias("series"), F.col(step).cast("long").alias("step"), F.col(loss).cast("double").alias("loss")).where("loss is not null and step is not null")
    processor = _InOrder(("series", "step", "loss"), first, patience, delta, wait)
    schema = "series string, step long, counter int, stop boolean"
    return rows.groupBy("series").transformWithStateInPandas(processor, schema, "Append", "None" if wait is None else "ProcessingTime")
