"""Ordered selection by position or id, alignment, batches: equi-joins that carry the caller's order as view_idx."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import errors as E
from ..functions.names import free_name, scratch_path


#: Positions or ids that go into the plan as a filter beside the join; the result is the same without.
LISTED = 1000


def _wanted(df: DataFrame, values: Sequence, name: str, kind: str) -> DataFrame:
    spark = df.sparkSession
    return spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"view_idx long, {name} {kind}")


def _repeats(values: Sequence) -> list:
    seen: set = set()
    return [v for v in values if v in seen or seen.add(v)]


def select_indices(df: DataFrame, indices: Sequence[int], *, size: int | None = None) -> DataFrame:
    """Rows at positions (row_idx) in the caller's order; repeats and positions out of range are errors.

    Negative positions count from the end if the size is known. The filter on row_idx reaches the Parquet row groups.
    """
    at = [i + size if i < 0 and size is not None else i for i in indices]
    if again := _repeats(at):
        raise E.DuplicateSelectIndicesError(again)
    if bad := [i for i in at if i < 0 or (size is not None and i >= size)]:
        raise IndexError(f"positions out of range: {bad[:5]}")
    rows = df.where(F.col("row_idx").isin(at)) if 0 < len(at) <= LISTED else df
    return rows.join(_wanted(df, at, "row_idx", "long"), "row_idx")


def select_sample_ids(df: DataFrame, ids: Sequence[str], *, check: bool = True) -> DataFrame:
    """Rows of sample ids in the caller's order; of rows that repeat an id the last one counts.

    Repeats and unknown ids are errors that list them all; check=False leaves the search for unknown ones out. Up to LISTED ids
    are a filter that reaches the Parquet row groups, their statistics and Bloom filters. The check reads the id column alone.
    """
    if again := _repeats(ids):
        raise E.DuplicateSampleIdsError(again)
    wanted = _wanted(df, ids, "sample_id", "string")
    rows = df.where(F.col("sample_id").isin(list(ids))) if 0 < len(ids) <= LISTED else df
    if check:
        known = {r.sample_id for r in rows.select("sample_id").join(wanted, "sample_id", "left_semi").distinct().collect()}  # as many as were asked for
        if unknown := [i for i in ids if i not in known]:
            raise E.UnknownSampleIdsError(unknown)
    found = last_rows(rows.join(wanted, "sample_id"), "sample_id", "row_idx")
    return found.select(*df.columns, "view_idx")


def repeated_ids(df: DataFrame, column: str = "sample_id") -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n")).where("n > 1")


def last_rows(df: DataFrame, column: str, order: str) -> DataFrame:
    """The last row of each id: a partial aggregate instead of a sort of every group."""
    rest = [c for c in df.columns if c != column]
    row = F.max_by(F.struct(*[F.col(f"`{c}`") for c in rest]), F.col(f"`{order}`")).alias("r")
    return df.groupBy(column).agg(row).select(*[F.col(column) if c == column else F.col(f"r.`{c}`").alias(c) for c in df.columns])


def unknown_ids(wanted: DataFrame, df: DataFrame, column: str) -> DataFrame:
    return wanted.join(df.select(column), column, "left_anti")


#: Elements in a block of a slice, and in a slice that may be one row.
BLOCK, WHOLE = 1 << 16, 1 << 24


def _pieces(shape: tuple[int, ...], dim: int, block: int):
    """Samples (order, data) cut along dim: a row (row, block, at, data) for each slice and block that a sample has elements in."""
    inner = math.prod(shape) // shape[dim]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(batch.column(1).is_valid())
            for k in range(len(batch)):
                values = batch.column(1).slice(k, 1).flatten()
                if len(values) != math.prod(shape):
                    raise ValueError(f"samples of shape {shape} have {math.prod(shape)} elements")
                place = np.moveaxis(np.arange(len(values)).reshape(shape), dim, 0).ravel()
                start = batch.column(0)[k].as_py() * inner
                cuts = np.unique(np.concatenate([[0, inner], np.arange(-(-start // block) * block - start, inner, block)]))
                cuts = cuts[(cuts >= 0) & (cuts <= inner)]
                n, parts = shape[dim], len(cuts) - 1
                ends = (np.arange(n)[:, None] * inner + cuts[None, :-1]).ravel()
                at = np.tile(start + cuts[:-1], n)
                data = pa.ListArray.from_arrays(pa.array(np.append(ends, n * inner), pa.int32()), values.take(pa.array(place)))
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(n), parts)), pa.array(at // block), pa.array(at), data], names=["row", "block", "at", "data"])

    return run


def slice_blocks(df: DataFrame, shape: Sequence[int], dim: int, *, column: str = "data", order: str = "row_idx", block: int = BLOCK) -> DataFrame:
    """The slices of one stacked tensor (rows by `order`, then shape) along sample dim `dim`, in blocks: rows (row, block, data).

    `order` holds the samples' dense positions. Elements of a slice stand by sample, then by their other coordinates; a block has
    `block` of them, the last one the rest, so no row outgrows it. Samples are cut where they lie: what moves is a row for each sample,
    slice and block that it has elements in.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))  # read when the plan runs, so it stays
    kind = df.schema[column].dataType.simpleString()
    rows = df.select(F.col(f"`{order}`").cast("long").alias("order"), F.col(f"`{column}`").alias("data"))
    pieces = rows.mapInArrow(_pieces(tuple(shape), dim % len(shape), block), f"row long, block long, at long, data {kind}")
    whole = pieces.groupBy("row", "block").agg(F.array_sort(F.collect_list(F.struct("at", "data"))).alias("p"))
    return whole.select("row", "block", F.flatten(F.transform("p", lambda p: p["data"])).alias("data"))


def take_along(df: DataFrame, shape: Sequence[int], dim: int, *, column: str = "data", order: str = "row_idx", size: int | None = None) -> DataFrame:
    """The slices of slice_blocks() as a row (row, data) each; size is the number of samples.

    A slice of more than WHOLE elements is an error: it is read in blocks.
    """
    inner = math.prod(shape) // shape[dim]
    if (n := df.count() if size is None else size) * inner > WHOLE:
        raise ValueError(f"a slice of {n * inner} elements is too long for a row; read it by slice_blocks()")
    blocks = slice_blocks(df, shape, dim, column=column, order=order)
    parts = blocks.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("block", "data"))).alias("p"))
    return parts.select("row", F.flatten(F.transform("p", lambda p: p["data"])).alias("data"))


def collate(df: DataFrame, size: int, columns: Sequence[str], *, order: str = "view_idx") -> DataFrame:
    """Batches of `size` rows by order: (batch, n, and an ordered list of each column); the last may be short."""
    row = F.struct(order, *columns)
    groups = df.groupBy(F.floor(F.col(order) / size).alias("batch")).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(row)).alias("r"))
    return groups.select("batch", "n", *[F.col(f"r.{c}").alias(c) for c in columns])


#: Partitions whose counts are summed up in one task.
FAN = 1024


def dense_index(df: DataFrame, order: Sequence[str], *, name: str = "row_idx", ranges: int | None = None) -> DataFrame:
    """Adds 0, 1, 2, ... by `order`, nulls first.

    Rows are dealt by ranges of all order columns, sorted and written to the shared folder once; a row's number is its place in its range
    and the counts of the ranges before it, which are summed in two levels. Rows that tie in all order columns may lie in several
    ranges, so no value and no number of rows makes a range too large; their order among themselves is any. `ranges` fixes the number of ranges.
    """
    spark = df.sparkSession
    tie, id_, part, start, block = (free_name(df, c, name) for c in ("tie", "place", "part", "start", "block"))
    keys = [*[F.col(f"`{c}`") for c in order], F.col(tie)]
    tied = df.withColumn(tie, F.monotonically_increasing_id())
    ranged = tied.repartitionByRange(ranges, *keys) if ranges else tied.repartitionByRange(*keys)
    path = scratch_path(spark, "ranges")
    ranged.sortWithinPartitions(*keys).withColumn(id_, F.monotonically_increasing_id()).drop(tie).write.parquet(path)
    rows = spark.read.schema(df.withColumn(id_, F.lit(0).cast("long")).schema).parquet(path)
    rows = rows.withColumn(part, F.shiftright(id_, 33))
    sizes = rows.groupBy(part).agg(F.count("*").alias("n")).withColumn(block, F.floor(F.col(part) / FAN))
    below = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    tops = sizes.groupBy(block).agg(F.sum("n").alias("n"))
    tops = tops.select(block, below(Window.orderBy(block)).alias("base"))  # a row for each FAN ranges
    offsets = sizes.withColumn(start, below(Window.partitionBy(block).orderBy(part))).join(F.broadcast(tops), block).select(part, (F.col(start) + F.col("base")).alias(start))
    place = F.col(id_).bitwiseAND(F.lit((1 << 33) - 1))
    return rows.join(F.broadcast(offsets), part).withColumn(name, (place + F.col(start)).cast("long")).drop(part, start, id_)  # a row for each range


def splits(df: DataFrame, order: Sequence[str], sizes: tuple[int, int, int], names: tuple[str, ...] = ("train", "valid", "test"), *, seed: int | None = None) -> DataFrame:
    """Contiguous splits of the rows by `order`, or by a seeded hash of it; rows beyond all sizes are left out."""
    shuffled = free_name(df, "shuffled", "split_idx", "split")
    if seed is not None:
        df = df.withColumn(shuffled, F.xxhash64(F.lit(seed), *order))
        order = [shuffled, *order]
    rows = dense_index(df, order, name="split_idx")
    ends = [sum(sizes[: k + 1]) for k in range(len(sizes))]
    which = F.when(F.col("split_idx") < ends[0], names[0])
    for end, name in zip(ends[1:], names[1:], strict=False):
        which = which.when(F.col("split_idx") < end, name)
    rows = rows.withColumn("split", which).where("split is not null")
    return rows if seed is None else rows.drop(shuffled)
