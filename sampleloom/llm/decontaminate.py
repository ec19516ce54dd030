"""Benchmark decontamination with DataFrame functions only: a prefix-filtered join of rare shingles, verified windows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Words of a shingle, and of a window.
SHINGLE, WINDOW = 5, 10
#: The most distinct benchmark shingles that are sent to every task as one literal set; beyond it, a shuffled join does.
LITERAL_SHINGLES = 40_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words of ASCII letters and digits and of all else beyond ASCII, with A-Z (and no other letter) as a-z."""
    ascii_only = F.length(text) == F.octet_length(text)
    low = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.array_remove(F.split(F.coalesce(low, F.lit("")), _NO_WORD), "")


def _shingles(tokens: Column, width: int) -> Column:
    """(pos, gram) of each run of `width` words, in order; none if there are fewer."""
    last = F.size(tokens) - width
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(i.alias("pos"), F.array_join(F.slice(tokens, i + 1, width), " ").alias("gram")))).otherwise(F.array().cast("array<struct<pos:int,gram:string>>"))


def benchmark_windows(items: DataFrame, shingle: int = SHINGLE, window: int = WINDOW) -> DataFrame:
    """Rows (win, width, item_ids, grams): each distinct window, its words, its items and the (pos, gram) that cover it.

    A window has `window` consecutive words; an item of fewer, but not none, is one window. Its shingles have
    min(shingle, words) words.
    """
    base = items.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text").cast("string")).alias("t")).where("size(t) > 0 and item_id is not null")
    width = F.least(F.size("t"), F.lit(window))
    base = base.select("item_id", F.explode(F.transform(F.sequence(F.lit(1), F.size("t") - width + 1), lambda i: F.slice("t", i, width))).alias("t"))
    base = base.groupBy("t").agg(F.collect_set("item_id").alias("item_ids"))
    grams = F.lit(None).cast("array<struct<pos:int,gram:string>>")
    for n in range(shingle, 0, -1):
        fits = F.size("t") == n if n < shingle else F.size("t") >= n
        grams = F.when(fits, _shingles(F.col("t"), n)).otherwise(grams)
    return base.select(F.xxhash64("t").alias("win"), F.array_join("t", " ").alias("words"), F.size("t").alias("width"), "item_ids", grams.alias("grams"))


def decontaminate(docs: DataFrame, items: DataFrame, *, shingle: int = SHINGLE, window: int = WINDOW, literal_shingles: int = LITERAL_SHINGLES) -> DataFrame:
    """A row (doc_id, n_words, n_hit, n_items, items, items_sha256, contaminated, text_hash) for each row of docs.

    A document word is hit if it lies inside an occurrence of a window of items (see benchmark_windows).

    One scan of docs finds where shingles of the benchmark occur; counting these over all documents orders the shingles by
    rarity. An occurrence must hold every shingle of its window, so a prefix of one, the rarest, is joined. Positional
    and length bounds drop windows that would start before or end after the document; the rest are confirmed by the
    text of every shingle at its place, which together cover the window's words exactly.

    Null or empty texts have no words; long texts count whole. Rows of the same doc_id (null is one) and text share their figures; other rows of a
    doc_id are apart. Of equally rare shingles of a window the one that sorts first is joined. Items without words or id, and an empty
    benchmark, hit nothing; items that repeat count once each id. Other columns are ignored, whatever their names. An empty table gives no rows.
    """
    wins = written(benchmark_windows(items, shingle, window), "windows")
    grams = wins.select("win", "width", F.explode("grams").alias("g")).select("win", "width", "g.pos", "g.gram")
    distinct = written(grams.select("gram", F.least("width", F.lit(shingle)).alias("n")).distinct(), "grams")
    sizes = sorted(r.n for r in distinct.select("n").distinct().collect())  # at most `shingle` values
    few = distinct.count() <= literal_shingles
    text = F.col("text").cast("string")
    base = docs.select("doc_id", F.xxhash64(text).alias("text_hash"), words(text).alias("t"))
    found = [_shingles(F.col("t"), n) for n in sizes]
    if few:
        known = [r.gram for r in distinct.select("gram").collect()]
        found = [F.filter(f, lambda x: x["gram"].isin(known)) for f in found]
    every = reduce(F.concat, found) if found else F.array().cast("array<struct<pos:int,gram:string>>")
    rows = base.select("doc_id", "text_hash", F.size("t").cast("long").alias("n_words"), every.alias("grams"))
    if not few:  # too many for one literal: join the positions with the shingles
        full = written(rows.select("doc_id", "text_hash", "n_words"), "counted")
        hits = rows.select("doc_id", "text_hash", "n_words", F.explode("grams").alias("g")).select("doc_id", "text_hash", "n_words", "g.pos", "g.gram")
        hits = written(hits.join(distinct.select("gram"), "gram", "left_semi").distinct(), "hits")
    else:
        full = written(rows, "matched")
        hits = full.where("size(grams) > 0").select("doc_id", "text_hash", "n_words", F.explode("grams").alias("g")).select("doc_id", "text_hash", "n_words", "g.pos", "g.gram").distinct()
        hits = written(hits, "hits")
    rarity = hits.groupBy("gram").agg(F.count("*").alias("df"))
    ranked = grams.join(rarity, "gram", "left").fillna({"df": 0})
    rank = F.row_number().over(Window.partitionBy("win").orderBy("df", "gram", "pos"))
    # a shingle that no document has ends its window: df 0 joins nothing
    prefix = ranked.withColumn("k", rank).where("k = 1 and df > 0").select("win", "width", F.col("gram"), F.col("pos").alias("at"))
    prefix = written(prefix, "prefix")
    needs = grams.join(prefix.select("win"), "win", "left_semi")
    needed = written(needs.groupBy("win").agg(F.count("*").alias("need")), "needed")
    who = ["doc_id", "text_hash"]
    starts = hits.join(prefix, "gram").select(*who, "n_words", "win", "width", (F.col("pos") - F.col("at")).alias("start"))
    starts = starts.where("start >= 0 and start + width <= n_words")
    wanted = starts.join(needs.select("win", "pos", "gram"), "win").select(*who, "win", "width", "start", (F.col("start") + F.col("pos")).alias("pos"), "gram")
    there = hits.select(F.col("doc_id").alias("d_"), F.col("text_hash").alias("h_"), F.col("pos").alias("p_"), F.col("gram").alias("g_"))
    same = wanted["doc_id"].eqNullSafe(there["d_"]) & (wanted["text_hash"] == there["h_"]) & (wanted["pos"] == there["p_"]) & (wanted["gram"] == there["g_"])
    sure = wanted.join(there, same, "left_semi").groupBy(*who, "win", "width", "start").agg(F.count("*").alias("have")).join(needed, "win").where("have = need")
    sure = written(sure.select(*who, "win", "width", "start"), "sure")
    # windows of a document in order: each adds what lies beyond all before it; at most as many as the document has words
    place = Window.partitionBy(*who).orderBy("start", "width")
    end = F.col("start") + F.col("width")
    spans = sure.groupBy(*who, "start").agg(F.max("width").alias("width"))
    reach = F.max(end).over(place.rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("add", F.greatest(F.lit(0), end - F.greatest("start", F.coalesce(reach, F.lit(0)))))
    counts = spans.groupBy(*who).agg(F.sum("add").alias("n_hit"))
    named = sure.select(*who, "win").distinct().join(wins.select("win", F.explode("item_ids").alias("item")), "win").groupBy(*who).agg(F.array_sort(F.collect_set("item")).alias("items"))
    named = named.select(F.col("doc_id").alias("d_"), F.col("text_hash").alias("h_"), "items")
    result = counts.join(named, counts["doc_id"].eqNullSafe(named["d_"]) & (counts["text_hash"] == named["h_"])).select("d_", "h_", "n_hit", "items")
    full = full.select(*who, "n_words")
    out = full.join(written(result, "result"), full["doc_id"].eqNullSafe(F.col("d_")) & (full["text_hash"] == F.col("h_")), "left")
    listed = F.coalesce("items", F.array().cast("array<string>"))
    hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select("doc_id", "n_words", hit.alias("n_hit"), F.size(listed).cast("long").alias("n_items"), listed.alias("items"), F.sha2(F.array_join(listed, ",").cast("binary"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"), "text_hash")


#: DuckDB: windows of documents and items as joined words.
DECONTAMINATE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS t FROM {docs}),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS t FROM benchmark),
bw AS (SELECT DISTINCT item, least(len(t), 10) AS w, array_to_string(t[p + 1 : p + least(len(t), 10)], ' ') AS win FROM b, unnest(range(0, greatest(len(t) - 9, 1))) AS r(p) WHERE len(t) > 0 AND item IS NOT NULL),
widths AS (SELECT DISTINCT w FROM bw),
dw AS (SELECT doc_id, p, w, array_to_string(t[p + 1 : p + w], ' ') AS win FROM d, widths, unnest(range(0, len(t) - w + 1)) AS r(p) WHERE len(t) >= w),
h AS (SELECT doc_id, p, dw.w, item FROM dw JOIN bw ON dw.win = bw.win AND dw.w = bw.w),
hits AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM h, unnest(range(p, p + w)) AS r(q) GROUP BY doc_id),
named AS (SELECT doc_id, list_sort(list(DISTINCT item)) AS items FROM h GROUP BY doc_id)
SELECT d.doc_id, CAST(len(t) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(len(items), 0) AS BIGINT) AS n_items,
  sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits ON d.doc_id IS NOT DISTINCT FROM hits.doc_id LEFT JOIN named ON d.doc_id IS NOT DISTINCT FROM named.doc_id
"""
