"""Mixing sources to target weights with DataFrame functions only: hash keys, key ranges, prefix sums, exact cuts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, free_name, written

#: Rows of a key range on average; a range is the unit that one task sorts.
RANGE_ROWS = 2_000
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Words as a long; a null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sources: DataFrame, weights: tuple[int, ...] = (5, 2, 1), percent: int = 150, most: int = 2) -> DataFrame:
    """Targets of sources (source, source_size, ...): one row a source, so windows over all of them are small.

    Sources by code point, null last, take the weights in turn. The sum to share is percent of all sizes; a target
    stops at `most` times its source's size and the excess is shared again by weight. That is one water level: with
    sources by ascending stop per weight, the level after the first i have stopped is what is left over the weight that
    is left; the smallest i whose level is at most the next stop per weight holds, and it has the largest such level.
    """
    if percent > 100 * most:
        raise ValueError("the sources' stops sum to less than the share asked for")
    k = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (k % len(weights) + 1).cast("int")).cast("long")
    s = sources.withColumn("w", weight).withColumn("stop", F.col("source_size") * most)
    order = Window.orderBy((F.col("stop") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    s = s.withColumns({
        "total": F.sum("source_size").over(every) * percent / 100,
        "before": F.sum("stop").over(order.rowsBetween(Window.unboundedPreceding, -1)),
        "w_before": F.sum("w").over(order.rowsBetween(Window.unboundedPreceding, -1)),
        "w_all": F.sum("w").over(every),
    })
    s = s.withColumn("level", (F.col("total") - F.coalesce("before", F.lit(0))) / (F.col("w_all") - F.coalesce("w_before", F.lit(0))))
    s = s.withColumn("level", F.max(F.when(F.col("level") <= F.col("stop") / F.col("w"), F.col("level"))).over(every))
    return s.withColumn("target", F.coalesce(F.least(F.col("level") * F.col("w"), F.col("stop").cast("double")), F.col("stop").cast("double"))).drop("w", "stop", "total", "before", "w_before", "w_all", "level")


def mix_sources(docs: DataFrame, *, seed: str = "mix", weights: tuple[int, ...] = (5, 2, 1), percent: int = 150, most: int = 2, range_rows: int = RANGE_ROWS) -> DataFrame:
    """A row (doc_id, size, source, source_size, target, taken) for each row of docs.

    The md5 of seed, doc_id and text is a document's key; the documents of a source stand in the order of their keys. A
    source of n documents has ceil(n / range_rows) equal key ranges: range totals are summed first, their running sums
    give each range's start, and a window within the range gives each document's. So no task holds more than a range,
    whatever the source's share. A source takes floor(target / source_size) whole epochs, then documents in order up to
    the budget that is left; the document at the cut gives only the words that still fit. A document is so taken once
    more than the epochs at most. Reruns agree: keys depend on seed, doc_id and text only.

    Null text: size 0, nothing taken. Null source: a source of its own, last. Null doc_ids are spread by their texts. Rows that repeat a doc_id are
    documents of their own; those that repeat the text too have one key and so lie in one range, whose task holds
    their sizes. Long texts count whole. Other columns are ignored, whatever their names. An empty table gives no rows; sizes that are all 0 give targets of 0.
    """
    text = F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"))
    key = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), text).cast("binary"))
    base = docs.select("doc_id", F.col("source").cast("string").alias("source"), word_count(F.col("text").cast("string")).alias("size"), key.alias("key"))
    base = written(base, "sized")
    sources = written(source_targets(base.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")), weights, percent, most), "targets")
    # 40 bits of the key: an exact double, cut into as many equal ranges as the source needs
    share = F.conv(F.substring("key", 1, 10), 16, 10).cast("double") / float(1 << 40)
    on = base["source"].eqNullSafe(sources["source"])
    ranged = base.join(sources, on).select(base["source"], "doc_id", "size", "key", "source_size", "target", F.floor(share * F.ceil(F.col("n") / range_rows)).alias("range"))
    ranged = written(ranged, "ranged")
    discard(base, sources)
    totals = ranged.groupBy("source", "range").agg(F.sum("size").alias("total"))
    start = F.sum("total").over(Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    totals = totals.select(F.col("source").alias("s_"), F.col("range").alias("r_"), F.coalesce(start, F.lit(0)).alias("start"))
    inside = Window.partitionBy("source", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = placed.join(totals, placed["source"].eqNullSafe(totals["s_"]) & (placed["range"] == totals["r_"]))
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    left = budget - epochs * F.col("source_size")
    part = F.greatest(F.lit(0), F.least("size", left - F.col("start") - F.col("inside")))
    return placed.select("doc_id", "size", "source", "source_size", F.col("target").cast("double").alias("target"), (F.col("size") * epochs + part).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the rows of docs that give words, with the words taken of each and the copies to train on.

    The three columns are named size, taken and copies, with underscores added where docs has such names. Equal rows
    share what is taken of them evenly.
    """
    size, taken, copies = (free_name(docs, c) for c in ("size", "taken", "copies"))
    doc, source = free_name(docs, "mix_doc"), free_name(docs, "mix_source")
    took = mix_sources(docs, **options).groupBy("doc_id", "source", "size").agg(F.floor(F.avg("taken")).alias("taken")).where("taken > 0")
    took = written(took, "took").select(F.col("doc_id").alias(doc), F.col("source").alias(source), F.col("size").alias(size), F.col("taken").alias(taken))
    named = docs.withColumn(size, word_count(F.col("text").cast("string")))
    on = named["doc_id"].eqNullSafe(took[doc]) & named["source"].cast("string").eqNullSafe(took[source]) & (named[size] == took[size])
    return named.join(took, on).select(*[named[f"`{c}`"] for c in docs.columns], named[size], took[taken], F.ceil(took[taken] / named[size]).alias(copies))


#: DuckDB: the same mix in one window over each source.
MIX_SQL = r"""
WITH base AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS key FROM {docs}),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM base GROUP BY source),
weighted AS (SELECT *, list_extract([5, 2, 1], CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)) AS w, 2 * source_size AS stop FROM per),
levels AS (SELECT *, ((SELECT sum(source_size) FROM per) * 150 / 100.0 - coalesce(sum(stop) OVER before, 0)) / CAST((SELECT sum(w) FROM weighted) - coalesce(sum(w) OVER before, 0) AS DOUBLE) AS level
  FROM weighted WINDOW before AS (ORDER BY stop / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (SELECT source, source_size, least((SELECT max(level) FROM levels WHERE level <= stop / w) * w, CAST(stop AS DOUBLE)) AS target FROM levels),
placed AS (SELECT base.*, source_size, target, coalesce(sum(size) OVER (PARTITION BY base.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM base JOIN targets ON base.source IS NOT DISTINCT FROM targets.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source, source_size, CAST(target AS DOUBLE) AS target,
  CAST(size * CASE WHEN source_size > 0 THEN floor(floor(target) / source_size) ELSE 0 END
    + greatest(0, least(size, floor(target) - CASE WHEN source_size > 0 THEN floor(floor(target) / source_size) ELSE 0 END * source_size - start)) AS BIGINT) AS taken
FROM placed
"""
