"""Embedding near-dedup by a pivot-permutation index: ordered nearest pivots, inverted pivot lists, shared-pivot counts, exact checks."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, components, discard, written
from .near_dup import groups

#: Pivots of n vectors: PER_ROOT * sqrt(n), so that lists and comparisons a vector grow as sqrt(n) / PER_ROOT, up to MOST_PIVOTS.
PER_ROOT, MOST_PIVOTS = 4, 8192
#: How many nearest pivots describe a vector, and how many of these two linked vectors must share.
NEAREST, SHARED = 8, 2
#: A vector is listed under its nearest pivot and asks the lists of at most VISITS nearest ones, those whose cosine is
#: less than MARGIN below the nearest one's.
VISITS, MARGIN = 4, 0.08
#: Vectors in a block of an inverted list.
BLOCK = 1024
#: Rows that the pivots are drawn from, about.
SAMPLE_ROWS = 4 * MOST_PIVOTS
#: Pivots have smaller cosines with each other.
APART = 0.9


def by_dimension(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dimension, positions, vectors in double precision) of the usable rows of a list column, for each dimension in it.

    Null, empty and zero vectors and any with a null or non-finite component are not usable.
    """
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    if not len(column):
        return
    at = np.asarray(column.offsets)
    values = column.values.to_numpy(zero_copy_only=False).astype(np.float64)  # nulls are NaN
    size = np.where(np.asarray(column.is_valid()), np.diff(at), 0)
    for dim in np.unique(size[size > 0]).tolist():
        rows = np.flatnonzero(size == dim)
        x = values[at[rows][:, None] + np.arange(dim)]
        fine = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
        if fine.any():
            yield dim, rows[fine], x[fine]


def normalised(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled first, so that no square overflows or vanishes."""
    x = x / np.abs(x).max(axis=1, initial=0)[:, None]
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def apart(x: np.ndarray, most: int, seed: int = 5) -> np.ndarray:
    """At most `most` rows of x: the first in random order that lie apart from all before them.

    Pivots from one tight group would order its members by noise, so a group gives one at most.
    """
    x = np.unique(normalised(x), axis=0)
    chosen, n = np.zeros((min(most, len(x)), x.shape[1])), 0
    for v in x[np.random.default_rng(seed).permutation(len(x))]:
        if n == len(chosen):
            break
        if not n or (chosen[:n] @ v).max() < APART:
            chosen[n] = v
            n += 1
    return chosen[:n]


def choose_pivots(vectors: DataFrame, per_root: float = PER_ROOT, sample_rows: int = SAMPLE_ROWS) -> dict[int, np.ndarray]:
    """Pivots of each dimension, from about sample_rows different rows that a hash of id and content picks.

    A dimension of which the sample has nothing has no pivots: its vectors share one list.
    """
    counts = {r.d: r.n for r in vectors.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n")).collect()}  # one row a dimension
    total = sum(counts.values())
    picked = vectors
    if total > sample_rows:
        picked = vectors.where(F.pmod(F.xxhash64("vec_id", "embedding", F.lit("pivots")), F.lit(1 << 30)) < int((1 << 30) * sample_rows / total))
    column = picked.select("embedding").dropDuplicates(["embedding"]).toArrow()["embedding"]
    return {dim: apart(x, min(MOST_PIVOTS, math.ceil(per_root * math.sqrt(counts[dim])))) for dim, _, x in by_dimension(column)}


def _describe(shared_pivots, nearest: int, visits: int, margin: float, kind: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, rows, every in by_dimension(batch.column(1)):
                ids = batch.column(0).to_numpy(zero_copy_only=False)[rows].astype(np.int64)
                pivots = shared_pivots.value.get(dim)
                for k in range(0, len(ids), 2048):
                    x = every[k : k + 2048]
                    if pivots is None:
                        near, seen = np.zeros((len(x), 1), np.int16), np.ones(len(x), np.int32)
                    else:
                        cos = normalised(x) @ pivots.T
                        m = min(nearest, len(pivots))
                        near = np.argpartition(-cos, m - 1, axis=1)[:, :m] if m < len(pivots) else np.tile(np.arange(m), (len(x), 1))
                        value = np.take_along_axis(cos, near, 1)
                        order = np.lexsort((near, -value), axis=1)
                        near, value = np.take_along_axis(near, order, 1).astype(np.int16), np.take_along_axis(value, order, 1)
                        seen = (value[:, :visits] > value[:, :1] - margin).sum(axis=1).astype(np.int32)
                    raw = [r.tobytes() for r in x.astype(kind)]
                    cells = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(seen)]), pa.int32()), pa.array(np.concatenate([r[:s] for r, s in zip(near, seen, strict=True)]).astype(np.int32)))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[k : k + 2048]), pa.array([dim] * len(x), pa.int32()), pa.array([hashlib.blake2b(r, digest_size=16).digest() for r in raw], pa.binary()), pa.array(raw, pa.binary()), pa.array([r.tobytes() for r in near], pa.binary()), cells],
                        names=["vec_id", "dim", "digest", "vector", "near", "cells"],
                    )

    return run


DESCRIBED = "vec_id long, dim int, digest binary, vector binary, near binary, cells array<int>"


def connected(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest position that each of n is connected with by pairs (a, b)."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _compare(least: float, shared: int, kind: str):
    """In each block pair of a list: how many vectors each is linked with, weighted by copies, and links that connect them.

    Vectors at home in a list (its pivot is their nearest) are compared with each other and with its visitors. Two
    vectors that are visitors of each other's homes meet twice; the list of the smaller pivot counts.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, 4):
            if len(group) < 2:
                continue
            group = group.combine_chunks()
            cell, i, j, nb = (group[c][0].as_py() for c in ("cell", "i", "j", "nb"))
            ids, own, copies, seen = (group[c].to_numpy() for c in ("rep", "own", "copies", "seen"))
            home = group["home"].to_numpy(zero_copy_only=False).astype(bool)
            x = normalised(np.frombuffer(b"".join(group["vector"].to_pylist()), kind).reshape(len(ids), -1).astype(np.float64))
            near = np.frombuffer(b"".join(group["near"].to_pylist()), np.int16).reshape(len(ids), -1)
            needed = min(shared, near.shape[1])
            at_home, visiting = np.flatnonzero(home), np.flatnonzero(~home)
            sides = [(at_home, visiting)] if len(visiting) else []
            if j < nb:
                sides.append((at_home, at_home) if i == j else (at_home[own[at_home] == i], at_home[own[at_home] == j]))
            us, vs = [], []
            for left, right in sides:
                a, b = np.nonzero(x[left] @ x[right].T >= least - 1e-12)
                a, b = left[a], right[b]
                if right is left:
                    a, b = a[a < b], b[a < b]
                for k in range(0, len(a), 1 << 14):
                    p, q = a[k : k + (1 << 14)], b[k : k + (1 << 14)]
                    good = np.einsum("kd,kd->k", x[p], x[q]) >= least
                    good &= (near[p][:, :, None] == near[q][:, None, :]).any(axis=2).sum(axis=1) >= needed
                    if right is visiting:  # both meet again in the visitor's home if p visits that
                        again = ((near[p] == near[q][:, :1]) & (np.arange(near.shape[1]) < seen[p][:, None])).any(axis=1)
                        good &= ~again | (cell < near[q][:, 0])
                    us.append(p[good])
                    vs.append(q[good])
            a, b = (np.concatenate(z) if z else np.zeros(0, int) for z in (us, vs))
            if not len(a):
                continue
            links = np.bincount(a, copies[b], len(ids)) + np.bincount(b, copies[a], len(ids))
            label = connected(len(ids), a, b)
            at, joined = np.flatnonzero(links), np.flatnonzero(label != np.arange(len(ids)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([ids[at], ids[joined]])), pa.array([None] * len(at) + ids[label[joined]].tolist(), pa.int64()), pa.array(np.concatenate([links[at].astype(np.int64), np.zeros(len(joined), np.int64)]))],
                names=["u", "v", "links"],
            )

    return run


def near_duplicate_vectors(
    vectors: DataFrame, *, least: float = 0.95, per_root: float = PER_ROOT, nearest: int = NEAREST, shared: int = SHARED, visits: int = VISITS, margin: float = MARGIN, sample_rows: int = SAMPLE_ROWS
) -> DataFrame:
    """A row (vec_id, n_links, component_id, kept) for each row of vectors (vec_id, embedding); other columns are ignored.

    Each dimension has pivots of its own, more of them the more vectors there are. A vector is described by its `nearest`
    pivots in order of nearness (ties: the smaller pivot) and listed under the first; it asks its own list and those of
    the next ones that are about as near. Vectors that so meet and share at least `shared` pivots are candidates, and
    linked if their cosine in double precision is `least` or more. Lists are cut into blocks and every pair of
    blocks is compared in one task, so that no list, whatever its share of the rows, is held whole; the work of a list
    of n different vectors in which all meet is n^2 / 2 comparisons, spread over tasks. Exact copies are one row with a count from the start.

    Vectors that are null, empty or zero, or hold null or non-finite components, link with nothing; those of different
    dimensions don't link with each other. Rows that share a vec_id are one vector in links and components (the row with the most links counts). Null
    vec_id: no links, null component, kept. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    base = bounded_batches(vectors).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding"))
    single = vectors.schema["embedding"].dataType.simpleString() == "array<float>"
    base, kind = (base, "<f4") if single else (base.withColumn("embedding", F.col("embedding").cast("array<double>")), "<f8")
    own = F.col("vec_id").isNotNull()
    pivots = choose_pivots(base.where(own), per_root, sample_rows)
    shared_pivots = spark.sparkContext.broadcast(pivots)  # MOST_PIVOTS a dimension, and no more than sample_rows in all
    described = written(base.where(own).mapInArrow(_describe(shared_pivots, nearest, visits, margin, kind), DESCRIBED), "described")
    members = written(described.select("vec_id", "digest").distinct(), "members")
    heads = written(members.groupBy("digest").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")), "heads")
    # id and digest are the key, so that the many rows of one digest are spread
    first = described.join(heads.withColumnRenamed("rep", "vec_id"), ["digest", "vec_id"]).dropDuplicates(["digest", "vec_id"])
    classes = written(first.select(F.col("vec_id").alias("rep"), "dim", "vector", "near", "cells", "copies"), "vectors")
    discard(described)
    listed = classes.select("rep", "dim", "vector", "near", "copies", F.size("cells").alias("seen"), F.posexplode("cells").alias("k", "cell")).withColumn("home", F.col("k") == 0)
    sizes = listed.groupBy("dim", "cell").agg(F.sum(F.col("home").cast("int")).alias("nh"), F.sum((~F.col("home")).cast("int")).alias("nv")).where("nh > 0 and nh + nv > 1")
    blocks = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    sizes = written(sizes.select("dim", "cell", blocks("nh").alias("nb"), blocks("nv").alias("mb")), "lists")  # a row a pivot at most
    rows = listed.join(sizes, ["dim", "cell"])
    rows = rows.withColumn("own", F.when(F.col("home"), F.pmod(F.xxhash64("rep"), "nb")).otherwise(F.pmod(F.xxhash64("rep"), F.greatest("mb", F.lit(1)))).cast("int"))
    upto = lambda n: F.sequence(F.lit(0), F.greatest(F.col(n), F.lit(1)) - 1)
    pair = lambda i, j: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"))
    among = F.transform(upto("nb"), lambda j: pair(F.least("own", j), F.greatest("own", j)))
    asked = F.when(F.col("mb") > 0, F.transform(upto("mb"), lambda j: pair(F.col("own"), F.col("nb") + j))).otherwise(F.array().cast("array<struct<i:int,j:int>>"))
    ask = F.transform(upto("nb"), lambda i: pair(i, F.col("nb") + F.col("own")))
    whole = (F.col("nb") == 1) & (F.col("mb") <= 1)  # visitors and those at home in one task
    tasks = F.when(whole, F.array(pair(F.lit(0), F.lit(0)))).when(F.col("home"), F.concat(among, asked)).otherwise(ask)
    rows = rows.select("dim", "cell", F.explode(tasks).alias("t"), "rep", "own", "home", "nb", "copies", "seen", "vector", "near").select("dim", "cell", "t.i", "t.j", "rep", "own", "home", "nb", "copies", "seen", "vector", "near")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(n, "dim", "cell", "i", "j").sortWithinPartitions("dim", "cell", "i", "j")
    found = written(rows.mapInArrow(_compare(least, shared, kind), "u long, v long, links long"), "found")
    discard(classes, sizes)
    labels = components(found.where("v is not null").select("u", "v"))
    counts = found.groupBy(F.col("u").alias("rep")).agg(F.sum("links").alias("links"))
    final = heads.join(counts, "rep", "left").join(labels.select(F.col("node").alias("rep"), "label"), "rep", "left")
    final = written(final.select("digest", F.coalesce("label", "rep").alias("top"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "final")
    # a vec_id with several different vectors connects their classes
    several = members.groupBy("vec_id").agg(F.count("*").alias("n")).where("n > 1").select("vec_id")
    joined = written(members.join(several, "vec_id").join(final, "digest").select("vec_id", "top"), "joined")
    if not joined.isEmpty():
        up = components(joined.groupBy("vec_id").agg(F.min("top").alias("u")).join(joined, "vec_id").select("u", F.col("top").alias("v")))
        again = final.join(up.select(F.col("node").alias("top"), "label"), "top", "left").select("digest", F.coalesce("label", "top").alias("top"), "n_links")
        final = written(again, "final")
    member = written(members.join(final, "digest").groupBy("vec_id").agg(F.max("n_links").alias("n_links"), F.min("top").alias("top")), "member")
    discard(members, heads, found, joined)
    component = F.coalesce("top", "vec_id")
    known = base.where(own).select("vec_id").join(member, "vec_id", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))
    return known.unionByName(base.where(~own).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.lit(None).cast("long").alias("component_id"), F.lit(True).alias("kept")))

#: The same rows by comparing all pairs of vectors.
VECTORS_SQL = r"""
WITH RECURSIVE v AS (
  SELECT DISTINCT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0 AND len(list_filter(embedding, lambda e: e <> 0)) > 0
), scaled AS (SELECT vec_id, list_transform(x, lambda e: e / list_max(list_transform(x, lambda f: abs(f)))) AS x FROM v),
unit AS (SELECT vec_id, x, sqrt(list_dot_product(x, x)) AS size FROM scaled),
link AS (SELECT DISTINCT a.vec_id AS u, b.vec_id AS v FROM unit a JOIN unit b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) AND CASE WHEN len(a.x) = len(b.x) THEN list_dot_product(a.x, b.x) / (a.size * b.size) >= 0.95 END),
reach AS (SELECT DISTINCT vec_id AS u, vec_id AS v FROM v UNION SELECT r.u, l.v FROM reach r JOIN link l ON r.v = l.u),
top AS (SELECT u, min(v) AS top FROM reach GROUP BY u),
deg AS (SELECT u, count(*) AS n FROM link GROUP BY u)
SELECT e.vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, CAST(coalesce(top, e.vec_id) AS BIGINT) AS component_id, coalesce(coalesce(top, e.vec_id) = e.vec_id, true) AS kept
FROM embeddings e LEFT JOIN top ON e.vec_id = top.u LEFT JOIN deg ON e.vec_id = deg.u
"""
