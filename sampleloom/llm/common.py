"""Helpers that the operators of this subpackage share: written tables, sessions, components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import free_name, remove_path, scratch_path

__all__ = ["BATCH_BYTES", "bounded_batches", "components", "discard", "drop_part", "free_name", "new_path", "settled", "sized", "spread", "written"]

#: Bytes of an Arrow batch, about; a row is never cut.
BATCH_BYTES = 4 << 20
#: Inputs of fewer bytes a core than this are dealt out to all cores before Python works on them.
SMALL_BYTES = 6 << 20

#: Files of a written table up to which it is broadcast; packed, a few times less than in memory.
BROADCAST_BYTES = 4 << 20

new_path = scratch_path


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back: cuts the lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return _read_back(df, path)


def settled(df: DataFrame, name: str, *, compression: str = "snappy", by: str | None = None, **settings: str) -> DataFrame:
    """written(), and Spark drops the shuffle files of the write as soon as it is over instead of when the driver's JVM happens to collect garbage.

    A column `by` makes a folder for each of its values, which drop_part() removes alone. Further settings of spark.sql hold in the session while the write is planned and run.
    """
    path, conf = scratch_path(df.sparkSession, name), df.sparkSession.conf
    wanted = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"} | {f"spark.sql.{k}": v for k, v in settings.items()}
    before = {k: conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        conf.set(k, v)
    try:
        df.write.option("compression", compression).parquet(path, partitionBy=by)
    finally:
        for k, v in before.items():
            conf.unset(k) if v is None else conf.set(k, v)
    return _read_back(df, path)


def sized(table: DataFrame) -> DataFrame:
    """A written table as the small side of a join: broadcast if its files are small, else Spark shuffles both sides."""
    size = int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(table) if size <= BROADCAST_BYTES else table


def _read_back(df: DataFrame, path: str) -> DataFrame:
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Removes written tables that nothing reads any more; what isn't removed goes when the driver ends."""
    for t in tables:
        remove_path(t.sparkSession, t.written_at)


def drop_part(table: DataFrame, by: str, value) -> None:
    """Removes the rows of one value of a written table's folder column."""
    remove_path(table.sparkSession, f"{table.written_at}/{by}={value}")


def bounded_batches(df: DataFrame) -> DataFrame:
    """df, with its session's Arrow batches at BATCH_BYTES at most: long texts then can't fill a Python worker's memory.

    Spark reads the setting when the plan runs, after this returns, so it stays set in the session.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def spread(df: DataFrame) -> DataFrame:
    """df dealt out to all cores if it is small: a small file is a single row group, which a single task would read.

    Larger tables have many row groups and stay as they are, so this never shuffles more than SMALL_BYTES a core.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(2 * cores) if size < SMALL_BYTES * cores else df


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (u, v): rows (node, label), label the smallest node reachable.

    Each round takes the smallest label among neighbours (a partial aggregate, so hubs are safe), then jumps
    along labels; labels are nodes of the same component, so chains halve. Every round is written to the shared folder,
    and the tables of the round before are removed.
    """
    edges = settled(edges.select("u", "v").where("u != v").distinct(), "edges")
    both = settled(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))), "both")
    discard(edges)
    labels = settled(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m")).select("node", F.least("node", "m").alias("label")), "labels")
    while True:
        # the smallest label of the neighbours also hooks the old label's node (not only the row itself)
        seen = both.join(labels.select(F.col("node").alias("v"), F.col("label").alias("near")), "v").join(labels.select(F.col("node").alias("u"), F.col("label").alias("own")), "u").where("near != own")
        hooks = seen.select(F.explode(F.array("u", "own")).alias("node"), F.least("near", "own").alias("m")).groupBy("node").agg(F.min("m").alias("m"))
        hooks = settled(hooks, "hooks")
        if hooks.isEmpty():
            discard(both, hooks)
            return labels
        first = settled(labels.join(hooks, "node", "left").select("node", F.least("label", F.coalesce("m", "label")).alias("label")), "low")
        low = first
        for _ in range(2):
            up = low.select(F.col("node").alias("label"), F.col("label").alias("next"))
            low = low.join(up, "label", "left").select("node", F.coalesce("next", "label").alias("label"))
        again = settled(low, "labels")
        discard(labels, hooks, first)
        labels = again
