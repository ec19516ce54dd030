"""MinHash fingerprints of documents, and how like they stay when a text is edited.

A fingerprint is the minima of universal hash permutations over a text's word shingles, 16 bits of each. The share of equal
coordinates of two fingerprints estimates the Jaccard similarity of the texts' shingles. fingerprint_groups() joins bands of
coordinates and verifies the similarity exactly.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, settled
from .near_dup import near_duplicates, text_chunks
from .shingles import U, mix, shingles

#: Words of a shingle, and permutations: the likeness has a standard error of 0.044 at most.
WIDTH, PERMUTATIONS = 5, 128
#: 25 bands of 5 coordinates: a pair at similarity 0.8 misses every band with probability 5e-5.
BANDS, ROWS = 25, 5


def permutations(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Factors and summands of multiply-shift hashing, strongly universal from 32 to 32 bits: (a x + b mod 2^64) >> 32."""
    return tuple(mix(np.arange(k * size + 1, (k + 1) * size + 1, dtype=U) * U(0x9E3779B97F4A7C15)) for k in range(2))


def minima(values: np.ndarray, at: np.ndarray, size: int = PERMUTATIONS) -> np.ndarray:
    """The minima of `size` permutations of each set of shingles, values[at[k]:at[k + 1]]; all ones for an empty set."""
    out = np.full((len(at) - 1, size), 0xFFFFFFFF, U)
    full = np.flatnonzero(np.diff(at))
    if len(full):
        starts, x = at[:-1][full], (values ^ (values >> U(32))) & U(0xFFFFFFFF)
        h = np.empty_like(x)
        for j, (a, b) in enumerate(zip(*permutations(size), strict=True)):
            np.multiply(x, a, out=h)
            np.add(h, b, out=h)
            out[full, j] = np.minimum.reduceat(h, starts) >> U(32)
    return out


def fingerprints(texts: pa.Array, width: int = WIDTH, size: int = PERMUTATIONS) -> np.ndarray:
    """A row of `size` 16-bit coordinates for each text; a null is empty, fewer words than width make one shingle."""
    return minima(*shingles(texts, width), size).astype(np.uint16)  # the low bits of a minimum are as good as random


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The share of equal coordinates of rows of fingerprints."""
    return (a == b).mean(axis=1) if len(a) else np.zeros(0)


def edited(text: str, after: str) -> str:
    """text, its last half (rounded down) replaced by as much of the next one's beginning, or all of it."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


_ROW = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
_RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"


def _compared(ids: pa.Array, texts: pa.Array, after: pa.Array, mine: np.ndarray, others: np.ndarray) -> list[pa.Array]:
    """The columns of the result for texts and the texts after them, of which the fingerprints are known."""
    new = [edited(t, n) for t, n in zip(texts.to_pylist(), after.to_pylist(), strict=True)]
    changed = fingerprints(pa.array(new, pa.string()))
    raw = lambda x: pa.array([r.tobytes() for r in x.astype("<u2")], pa.binary())
    chars = pa.array([len(t) for t in texts.to_pylist()], pa.int64())
    digests = pa.array([hashlib.sha256(t.encode()).hexdigest() for t in new], pa.string())
    return [ids, chars, digests, raw(mine), raw(changed), pa.array(likeness(mine, changed)), pa.array(likeness(mine, others))]


def _in_order(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's rows, each compared with the one after it; then its first and last text, for the row between partitions."""
    part, head, held = TaskContext.get().partitionId(), None, None
    names = [*_ROW, "part", "side", "text"]

    def edge(row: pa.RecordBatch, side: int) -> pa.RecordBatch:
        empty = [pa.nulls(1, t) for t in (pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.float64(), pa.float64())]
        return pa.RecordBatch.from_arrays([row.column(0), *empty, pa.array([part], pa.int32()), pa.array([side], pa.int32()), row.column(1)], names=names)

    for batch in batches:
        for chunk in text_chunks(batch):
            head = chunk.slice(0, 1) if head is None else head
            rows = chunk if held is None else pa.Table.from_batches([held, chunk]).combine_chunks().to_batches()[0]
            n, found = len(rows) - 1, fingerprints(rows.column(1))
            held = rows.slice(n)
            if n:
                texts = rows.column(1)
                columns = _compared(rows.column(0).slice(0, n), texts.slice(0, n), texts.slice(1), found[:-1], found[1:])
                yield pa.RecordBatch.from_arrays([*columns, pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.string())], names=names)
    if head is not None:
        yield edge(head, 0)
        yield edge(held, 1)


def _pairs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns = _compared(batch.column(0), batch.column(1), batch.column(2), fingerprints(batch.column(1)), fingerprints(batch.column(2)))
        yield pa.RecordBatch.from_arrays(columns, names=_ROW)


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint, that of its edited text and their likeness: a row of docs gives a row.

    docs has doc_id and text; other columns are ignored, whatever their names. The edited text has its last floor(n / 2) code points
    replaced by the first as many (or all) of the next document, by falling doc_id; after the last comes the first. Rows without
    doc_id come last; rows that share one come by text hash, equal ones one after the other. A null text is empty; all empty texts have
    the same fingerprint, which no other text has. A single row is its own next. An empty table gives no rows.

    Texts are dealt by ranges of doc_id and sorted, once; equal rows part freely between ranges. A task holds about 2 MB of text, or
    one text and the next. Only the first and last text of each range are joined with those of its neighbours.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("h"), F.monotonically_increasing_id().alias("row"))
    order = [F.col("doc_id").desc_nulls_last(), F.col("h"), F.col("row")]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    out = settled(ranged.mapInArrow(_in_order, f"{_RESULT}, part int, side int, text string"), "fingerprints")
    heads = out.where("side = 0").select(F.col("part").alias("next"), F.col("text").alias("after"))
    tails = out.where("side = 1").select("part", "doc_id", "text")
    every = Window.orderBy("part")  # a row for each partition
    chain = out.where("side = 0").select("part", F.coalesce(F.lead("part").over(every), F.first("part").over(every)).alias("next"))
    between = tails.join(chain, "part").join(heads, "next").select("doc_id", "text", "after")
    found = out.where("side is null").select(*_ROW).unionByName(between.mapInArrow(_pairs, _RESULT))
    return found.withColumns({c: F.regexp_replace(F.base64(c), r"\s", "") for c in ("fingerprint", "edited_fingerprint")})


def grouped_fingerprints(docs: DataFrame) -> DataFrame:
    """fingerprint_documents() with each document's component_id and kept of fingerprint_groups().

    Rows that share a doc_id are one document; a row without has no component and is kept.
    """
    groups = fingerprint_groups(docs).where("doc_id is not null").groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
    groups = settled(groups, "groups")  # small: what led to it is gone before texts are dealt
    found = fingerprint_documents(docs)
    kept = F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True))
    return found.join(groups, "doc_id", "left").withColumn("kept", kept)


def _band_sketches(sets: list[np.ndarray], size: int) -> np.ndarray:
    at = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)
    return minima(np.concatenate([*sets, np.zeros(0, U)]), at, size)


def fingerprint_groups(docs: DataFrame, *, width: int = WIDTH, percent: int = 80) -> DataFrame:
    """Classes of documents by MinHash: documents whose fingerprints agree in a band are joined, and linked if the exact Jaccard
    similarity of their shingle sets is percent or more. Rows and odd cases are those of near_duplicates()."""
    return near_duplicates(docs, width=width, percent=percent, bands=BANDS, rows=ROWS, sketcher=_band_sketches)
