"""Mergeable mean and deviation of tensors: one row of (count, mean, m2) for each kept coordinate."""

from __future__ import annotations

import json
import math
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import free_name, scratch_path
from ..plans.transforms import Normalize


def _check_dims(dim: Sequence[int] | None, rank: int) -> tuple[int, ...] | None:
    """Dims of the batch: 0 is the sample axis, 1 and up are those of the sample."""
    if dim is None:
        return None
    if not dim or any(d < 0 or d > rank for d in dim) or 0 not in dim:
        raise ValueError("dims must be non-negative, within the rank, and hold the sample axis 0")
    return tuple(dim)


def coordinate(pos: Column, shape: Sequence[int], dim: Sequence[int] | None) -> Column:
    """The row-major rank of an element among the coordinates that are kept."""
    kept = [] if dim is None else [k for k in range(len(shape)) if k + 1 not in dim]
    out, size = F.lit(0).cast("long"), 1
    for k in reversed(kept):
        stride = math.prod(shape[k + 1 :])
        out = out + F.pmod(F.floor(pos / stride), F.lit(shape[k])) * size
        size *= shape[k]
    return out.cast("long")


#: Samples of up to this many elements go through Catalyst's aggregates, a row for each element; larger ones as vectors.
ROW_ELEMENTS = 256
#: Coordinates in a block of a vector state, elements that are reduced at a time, and elements of states that a task holds at most.
BLOCK, CHUNK, HELD = 4096, 1 << 20, 1 << 22
#: Tasks' states meet in this many groups before they meet in one.
FAN = 64


def welford(df: DataFrame, shape: Sequence[int], dim: Sequence[int] | None = (0,), *, column: str = "data", keys: Sequence[str] = ()) -> DataFrame:
    """Statistics (keys, pos, count, mean, m2) over dim of a tensor column; the variance is over the population.

    Null samples and null elements count nothing. Both forms aggregate before they shuffle: small samples by Catalyst, a row for each task and
    coordinate; samples of more than ROW_ELEMENTS as vectors, a row for each task, key and block of BLOCK coordinates.
    """
    dim = _check_dims(dim, len(shape))
    if math.prod(shape) > ROW_ELEMENTS:
        return _vector_welford(df, tuple(shape), dim, column, list(keys))
    cells = df.select(*keys, F.posexplode(column).alias("p", "v")).select(*keys, coordinate(F.col("p"), shape, dim).alias("pos"), F.col("v").cast("double").alias("v"))
    return cells.groupBy(*keys, "pos").agg(F.count("v").cast("double").alias("count"), F.avg("v").alias("mean"), (F.var_pop("v") * F.count("v")).alias("m2"))


State = tuple[np.ndarray, np.ndarray, np.ndarray]


def chan(a: State, b: State) -> State:
    """Two states (count, mean, m2) in one: Chan's formula, coordinate by coordinate."""
    n = a[0] + b[0]
    safe = np.maximum(n, 1)
    d = np.where(b[0] > 0, b[1] - a[1], 0) if np.all(a[0] > 0) else np.where((a[0] > 0) & (b[0] > 0), b[1] - a[1], 0)
    base = np.where(a[0] > 0, a[1], b[1])
    return n, base + d * b[0] / safe, a[2] + b[2] + d * d * a[0] * b[0] / safe


def state_of(x: np.ndarray, valid: np.ndarray | None, dim: tuple[int, ...] | None) -> State:
    """The state of samples stacked along axis 0, over dim: two passes over what lies in memory."""
    axes = tuple(range(x.ndim)) if dim is None else dim
    x = x.astype(np.float64)
    w = np.ones(x.shape) if valid is None else valid.astype(np.float64)
    x = x if valid is None else np.where(valid, x, 0)
    n = w.sum(axis=axes, keepdims=True)
    mean = x.sum(axis=axes, keepdims=True) / np.maximum(n, 1)
    m2 = (((x - mean) ** 2) * w).sum(axis=axes)
    return n.ravel(), mean.ravel(), m2.ravel()


def _states(shape: tuple[int, ...], dim: tuple[int, ...] | None, keys: int):
    """Each task's states of the rows (keys, data): a row (keys, task, block, count, mean, m2) for each key and block."""
    size = math.prod(shape)

    def emit(held: dict, task: int) -> Iterator[pa.RecordBatch]:
        for key, state in held.values():
            n = len(state[0])
            for a in range(0, n, BLOCK):
                parts = [pa.array([v[a : a + BLOCK]], pa.list_(pa.float64())) for v in state]
                yield pa.RecordBatch.from_arrays([*key.columns, pa.array([task], pa.int32()), pa.array([a // BLOCK]), *parts], names=[*key.schema.names, "task", "block", "count", "mean", "m2"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, held, total = TaskContext.get().partitionId(), {}, 0
        for batch in batches:
            batch = batch.filter(batch.column(keys).is_valid())
            step = max(1, CHUNK // size)
            for start in range(0, len(batch), step):
                part = batch.slice(start, step)
                data = part.column(keys)
                if not pc.all(pc.equal(pc.list_value_length(data), size)).as_py():
                    raise ValueError(f"samples of shape {shape} have {size} elements")
                flat = data.flatten()
                valid = None if flat.null_count == 0 else flat.is_valid().to_numpy(zero_copy_only=False).reshape(-1, *shape)
                x = flat.fill_null(0).to_numpy(zero_copy_only=False).reshape(-1, *shape)
                head = part.select(list(range(keys)))
                code = np.zeros(len(part), np.int64)
                for c in head.columns:
                    own = c.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
                    code = np.unique(code * (len(part) + 1) + own, return_inverse=True)[1]
                for k in np.unique(code):
                    at = code == k
                    state = state_of(x[at], None if valid is None else valid[at], dim)
                    row = head.slice(int(at.argmax()), 1)
                    name = tuple(repr(c[0].as_py()) for c in row.columns)
                    if name in held:
                        held[name] = (row, chan(held[name][1], state))
                    else:
                        held[name] = (row, state)
                        total += len(state[0])
                if total > HELD:
                    yield from emit(held, task)
                    held, total = {}, 0
        yield from emit(held, task)

    return run


def _folded(names: list[str]):
    """The rows of one key, block and group of tasks in one, by task and size, so that the same rows give the same sums."""

    def run(table: pa.Table) -> pa.Table:
        vectors = [[np.asarray(v.values.to_numpy(zero_copy_only=False)) for v in table[c]] for c in ("count", "mean", "m2")]
        tasks = table["task"].to_numpy()
        order = sorted(range(len(tasks)), key=lambda k: (tasks[k], float(vectors[0][k].sum()), vectors[1][k].tobytes()))
        states = [tuple(v[k] for v in vectors) for k in order]
        while len(states) > 1:  # pairwise, as a tree
            states = [chan(states[k], states[k + 1]) if k + 1 < len(states) else states[k] for k in range(0, len(states), 2)]
        first = table.slice(0, 1)
        parts = {c: pa.array([v], pa.list_(pa.float64())) for c, v in zip(("count", "mean", "m2"), states[0], strict=True)}
        return pa.table({c: parts.get(c, first[c]) for c in names})

    return run


def _vector_welford(df: DataFrame, shape: tuple[int, ...], dim: tuple[int, ...] | None, column: str, keys: list[str]) -> DataFrame:
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))  # read when the plan runs, so it stays
    rows = df.select(*[F.col(f"`{k}`") for k in keys], F.col(f"`{column}`").cast("array<double>").alias("data"))
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields[:-1])
    schema = f"{kinds}task int, block long, count array<double>, mean array<double>, m2 array<double>"
    states = rows.mapInArrow(_states(shape, dim, len(keys)), schema)
    names = [f.name for f in states.schema.fields]
    near = states.withColumn("task", F.pmod("task", F.lit(FAN)).cast("int")).groupBy(*keys, "block", "task").applyInArrow(_folded(names), schema)
    whole = near.groupBy(*keys, "block").applyInArrow(_folded(names), schema)
    cells = whole.select(*keys, "block", F.posexplode(F.arrays_zip("count", "mean", "m2")).alias("p", "s"))
    return cells.select(*keys, (F.col("block") * BLOCK + F.col("p")).alias("pos"), "s.count", F.col("s.mean").alias("mean"), "s.m2").where("count > 0")


def merge(stats: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Statistics of several parts in one, whatever their order; empty parts count nothing.

    Means are taken from the smallest one of their coordinate, then from the common mean, so that large offsets cost no digits.
    """
    same = Window.partitionBy(*keys, "pos")
    low, off = free_name(stats, "low"), free_name(stats, "off")
    rows = stats.where("count > 0").withColumn(low, F.min("mean").over(same))
    rows = rows.withColumn(off, F.sum(F.col("count") * (F.col("mean") - F.col(low))).over(same) / F.sum("count").over(same))
    apart = F.col("mean") - F.col(low) - F.col(off)
    total = rows.groupBy(*keys, "pos").agg(F.sum("count").alias("count"), F.first(F.col(low) + F.col(off)).alias("mean"), F.sum(F.col("m2") + F.col("count") * apart * apart).alias("m2"))
    return total.select(*keys, "pos", "count", "mean", "m2")


def finalize(stats: DataFrame) -> DataFrame:
    """mean and std of statistics."""
    return stats.withColumn("std", F.sqrt(F.col("m2") / F.col("count"))).drop("m2")


@dataclass(frozen=True)
class WelfordSnapshot:
    """A detached copy of one statistics table; equal if the numbers agree closely and dims and permutation exactly."""

    count: np.ndarray
    mean: np.ndarray
    m2: np.ndarray
    dim: tuple[int, ...] | None
    shape: tuple[int, ...]

    def __eq__(self, other) -> bool:
        if not isinstance(other, WelfordSnapshot):
            return NotImplemented
        same = self.dim == other.dim and self.shape == other.shape
        return same and all(np.allclose(a, b) for a, b in ((self.count, other.count), (self.mean, other.mean), (self.m2, other.m2)))

    __hash__ = None

    def state_dict(self) -> dict:
        return {"count": self.count.tolist(), "mean": self.mean.tolist(), "m2": self.m2.tolist(), "dim": None if self.dim is None else list(self.dim), "shape": list(self.shape)}

    @classmethod
    def from_state_dict(cls, state: dict) -> WelfordSnapshot:
        return cls(*(np.asarray(state[k], float) for k in ("count", "mean", "m2")), None if state["dim"] is None else tuple(state["dim"]), tuple(state["shape"]))

    def to_json(self) -> str:
        return json.dumps(self.state_dict())


class WelfordEstimator:
    """update() adds DataFrames or arrays, merge() other estimators' snapshots; finalize() gives mean, std, permutation."""

    def __init__(self, dim: Sequence[int] | None = None) -> None:
        self.dim = None if dim is None else tuple(dim)
        self._state: WelfordSnapshot | None = None

    def permutation(self, rank: int) -> tuple[int, ...] | None:
        """Sample dims that brings the reduced ones to the front, or None if they are there already."""
        if self.dim is None or tuple(self.dim) == tuple(range(len(self.dim))):
            return None
        order = [*self.dim, *(k for k in range(rank + 1) if k not in self.dim)]
        return tuple(k - 1 for k in order if k != 0)

    def update(self, df: DataFrame, shape: Sequence[int], column: str = "data") -> WelfordEstimator:
        dim = _check_dims(self.dim, len(shape))
        rows = sorted(welford(df, shape, dim, column=column).collect(), key=lambda r: r.pos)  # a row for each kept coordinate
        if rows:
            kept = tuple(s for k, s in enumerate(shape) if dim is not None and k + 1 not in dim)
            get = lambda c: np.array([r[c] for r in rows], float)
            self.merge(WelfordSnapshot(get("count"), get("mean"), get("m2"), self.dim, kept))
        return self

    def snapshot(self) -> WelfordSnapshot:
        if self._state is None:
            raise RuntimeError("nothing has been added yet")
        s = self._state
        return WelfordSnapshot(s.count.copy(), s.mean.copy(), s.m2.copy(), s.dim, s.shape)

    @classmethod
    def from_snapshot(cls, snapshot: WelfordSnapshot) -> WelfordEstimator:
        out = cls(snapshot.dim)
        out._state = snapshot
        return out

    def merge(self, *snapshots: WelfordSnapshot) -> WelfordEstimator:
        """Adds snapshots; all are checked before any counts."""
        parts = [s for s in snapshots if np.any(s.count > 0)]
        base = self._state or (parts[0] if parts else None)
        for s in parts:
            if s.dim != base.dim or s.shape != base.shape:
                raise ValueError("snapshots differ in dims or shape")
        for s in parts:
            if self._state is None:
                self.dim, self._state = s.dim, s
                continue
            a = self._state
            n = a.count + s.count
            d = s.mean - a.mean
            self._state = WelfordSnapshot(n, a.mean + d * s.count / n, a.m2 + s.m2 + d * d * a.count * s.count / n, a.dim, a.shape)
        return self

    def __add__(self, other: WelfordEstimator) -> WelfordEstimator:
        out = WelfordEstimator(self.dim)
        return out.merge(*(e._state for e in (self, other) if e._state is not None))

    def finalize(self) -> tuple[np.ndarray, np.ndarray]:
        s = self.snapshot()
        return s.mean.reshape(s.shape), np.sqrt(s.m2 / s.count).reshape(s.shape)

    def normalizer(self, sample_rank: int) -> Normalize:
        """A Normalize op for samples; kept dims keep their places."""
        mean, std = self.finalize()
        if self.dim is None:
            return Normalize(float(mean), float(std))
        spread = tuple(slice(None) if k + 1 not in self.dim else None for k in range(sample_rank))
        return Normalize(mean[spread], std[spread])


#: The most statistics that travel to every task as one row.
BROADCAST_STATS = 1 << 16


def normalize_by(df: DataFrame, stats: DataFrame, *, column: str = "data", size: int | None = None) -> DataFrame:
    """(x - mean) / (std + 1e-12) by per-element statistics (pos, mean, std).

    size is the number of statistics, a sample's elements; where it isn't given, the statistics are written to the shared folder and counted there, so that
    what they are made of is read once all the same.

    Up to BROADCAST_STATS of them are one row of arrays that is broadcast. Larger samples are cut into pieces of that
    length, which are joined with their pieces of the statistics by position, and put together again by row.
    """
    row, own = free_name(df, "statistics"), free_name(df, "sample")
    scaled = lambda v, s: (v.cast("double") - s["mean"]) / (s["std"] + 1e-12)
    if size is None:
        path = scratch_path(df.sparkSession, "statistics")
        stats.write.parquet(path)
        stats = df.sparkSession.read.schema(stats.schema).parquet(path)
        size = stats.count()
    pieces = stats.groupBy(F.floor(F.col("pos") / BROADCAST_STATS).alias("piece")).agg(F.array_sort(F.collect_list(F.struct("pos", "mean", "std"))).alias(row))
    if size <= BROADCAST_STATS:
        joined = df.crossJoin(F.broadcast(pieces.select(row)))  # one row, its length just checked
        return joined.withColumn(column, F.zip_with(column, row, scaled)).drop(row)
    rest = [c for c in df.columns if c != column]
    others = F.struct(*[F.col(f"`{c}`") for c in rest]) if rest else F.lit(True)
    cut = df.select(F.monotonically_increasing_id().alias(own), F.col(column).alias("v"), others.alias("others"))
    cut = cut.select(own, "v", "others", F.explode(F.sequence(F.lit(0), F.floor((F.size("v") - 1) / BROADCAST_STATS))).alias("piece"))
    cut = cut.select(own, "piece", F.slice("v", (F.col("piece") * BROADCAST_STATS + 1).cast("int"), BROADCAST_STATS).alias("v"), F.when(F.col("piece") == 0, F.col("others")).alias("others"))
    done = cut.join(pieces, "piece").select(own, "others", F.struct("piece", F.zip_with("v", row, scaled).alias("v")).alias("p"))
    whole = done.groupBy(own).agg(F.first("others", ignorenulls=True).alias("others"), F.flatten(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["v"])).alias(row))
    return whole.select(*[F.col(row).alias(c) if c == column else F.col(f"others.`{c}`").alias(c) for c in df.columns])
