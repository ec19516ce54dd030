"""MinHash near-dedup: fast similarity sketches, banding, exact verification, components."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, components, discard, settled, spread
from .shingles import U, mix, shingle_sets, sketches

#: 42 bands of 6 coordinates: a pair at similarity 0.8 misses every band with probability 3e-6.
BANDS, ROWS = 42, 6
#: Documents in a block of a bucket; buckets of any size are cut into blocks.
BLOCK = 1024
#: Documents in a block where full sets are compared.
SET_BLOCK = 256
#: Standard deviations below the threshold at which a sketch's estimate rules a pair out: one of 3 million pairs at the threshold.
DEVIATIONS = 5
_CHUNK = 2 << 20


def text_chunks(batch: pa.RecordBatch, column: str = "text", limit: int = _CHUNK) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about `limit` bytes of text and 1000 rows at most, so that numpy's working memory stays bounded."""
    texts = batch.column(batch.schema.get_field_index(column))
    sizes = np.cumsum(np.nan_to_num(np.asarray(pc.binary_length(texts).to_numpy(zero_copy_only=False), float)))
    a = 0
    while a < len(batch):
        b = min(max(a + 1, int(np.searchsorted(sizes, (sizes[a - 1] if a else 0) + limit, "right"))), a + 1000)
        yield batch.slice(a, b - a)
        a = b


def _sketch(width: int, bands: int, rows: int, sketcher):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        odd = mix(np.arange(1, rows + 1, dtype=U)) | U(1)
        for batch in batches:
            for part in text_chunks(batch):
                sets = shingle_sets(part.column(1), width)
                found = sketcher(sets, bands * rows).reshape(len(sets), bands, rows)
                keys = mix((found * odd).sum(axis=2, dtype=U) + mix(np.arange(bands, dtype=U) + U(77)))
                digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(sets) * bands + 1, bands), pa.int32()), pa.array(keys.reshape(-1).view(np.int64)))
                short = (mix(found.reshape(len(sets), -1).copy()) & U(255)).astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), lists, pa.array([r.tobytes() for r in short], pa.binary())], names=["doc_id", "n_shingles", "digest", "keys", "short"]
                )

    return run


def _sets(width: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_chunks(batch):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([s.tobytes() for s in shingle_sets(part.column(1), width)], pa.binary())], names=["rep", "shingles"])

    return run


def _verify(percent: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            us, vs, a, b = (batch.column(k) for k in range(4))
            good = []
            for x, y in zip(a, b, strict=True):
                x, y = np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U)
                z = np.sort(np.concatenate([x, y]))
                common = int((z[1:] == z[:-1]).sum())
                good.append(100 * common >= percent * (len(x) + len(y) - common))
            keep = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([us.filter(keep), vs.filter(keep)], names=["u", "v"])

    return run


def groups(batches: Iterable[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Runs of rows that agree in the first `keys` columns, of batches that are sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not len(batch):
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(keys)]
        change = np.zeros(len(batch), bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), len(batch)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            key = tuple(c[a] for c in cols)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def likely(short: np.ndarray, size: np.ndarray, other: np.ndarray, other_size: np.ndarray, percent: int) -> np.ndarray:
    """For pairs of rows of two blocks how many sketch bytes agree, or 0 if sizes or that number rule the similarity out.

    Bytes of different coordinates agree by chance once in 256, which only raises the number.
    """
    p = percent / 100
    need = (p - DEVIATIONS * np.sqrt(p * (1 - p) / short.shape[1])) * short.shape[1]
    fits = 100 * np.minimum(size[:, None], other_size) >= percent * np.maximum(size[:, None], other_size)
    out, columns = np.zeros(fits.shape, np.int16), np.ascontiguousarray(other.T)
    for k in np.flatnonzero(fits.any(axis=1)).tolist():
        same = np.zeros(len(other), np.int16)
        for c in range(0, len(columns), 63):
            same += (columns[c : c + 63] == short[k, c : c + 63, None]).sum(axis=0, dtype=np.uint8)
        out[k] = np.where(fits[k] & (same >= need), same, 0)
    return out


def _likely_blocks(percent: int, best: bool):
    """What the sketches of a block pair leave open between components: the best pair of each component, or all rows with any pair."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, 3):
            group = group.combine_chunks()
            bucket, i, j = (group[c][0].as_py() for c in ("bucket", "i", "j"))
            reps, comps, own, size = (group[c].to_numpy() for c in ("rep", "comp", "own", "n"))
            if len(np.unique(comps)) < 2:
                continue
            short = np.frombuffer(b"".join(group["short"].to_pylist()), np.uint8).reshape(len(reps), -1)
            left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
            same = likely(short[left], size[left], short[right], size[right], percent)
            same[comps[left][:, None] == comps[right]] = 0
            if not best:
                at = np.unique(np.concatenate([left[same.any(axis=1)], right[same.any(axis=0)]]))
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array([bucket] * len(at), pa.int64()), pa.array(reps[at]), pa.array(comps[at])], names=["bucket", "rep", "comp"])
                continue
            a = np.concatenate([left, right])  # each row's best partner, then each component's best row
            b = np.concatenate([right[same.argmax(axis=1)], left[same.argmax(axis=0)]]) if len(left) and len(right) else a[:0]
            score = np.concatenate([same.max(axis=1), same.max(axis=0)]) if len(b) else b
            a = a[: len(b)]
            order = np.lexsort((reps[a], -score)) if len(b) else b
            first = order[np.unique(comps[a[order]], return_index=True)[1]]
            first = first[score[first] > 0]
            if len(first):
                u, v = reps[a[first]], reps[b[first]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], names=["u", "v"])

    return run


def _exact_blocks(percent: int):
    """Links between documents of different components in a block pair, by their full sets; enough to connect."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, 3):
            group = group.combine_chunks()
            reps, comps = group["rep"].to_numpy(), group["comp"].to_numpy()
            if len(np.unique(comps)) < 2:
                continue
            sets = [np.frombuffer(x.as_buffer(), U) for x in group["shingles"].chunk(0)]
            size = np.array([len(s) for s in sets])
            values, code = np.unique(np.concatenate(sets), return_inverse=True)
            order = np.argsort(code, kind="stable")
            at = np.searchsorted(code[order], np.arange(len(values) + 1))
            holders, ends = np.repeat(np.arange(len(sets)), size)[order], np.cumsum(size)
            # every pair of two components holds a document of all but one of them: the most frequent is not walked
            _, which = np.unique(comps, return_inverse=True)
            us, vs = [], []
            for k in np.flatnonzero(which != np.bincount(which).argmax()).tolist():
                own = code[ends[k] - size[k] : ends[k]]
                n = at[own + 1] - at[own]
                pick = np.repeat(at[own] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                common = np.bincount(holders[pick], minlength=len(sets))
                hit = np.flatnonzero((100 * common >= percent * (size + size[k] - common)) & (which != which[k]))
                one = hit[np.unique(which[hit], return_index=True)[1]]  # one link to each other component connects it
                us += [reps[k]] * len(one)
                vs += reps[one].tolist()
            if us:
                yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

    return run


def _dealt(rows: DataFrame, size: str, block: int) -> DataFrame:
    """rows (bucket, rep, ..., and their bucket's size) as often as their bucket has blocks: own and the block pair (i, j), first columns bucket, i, j."""
    nb = F.ceil(F.col(size) / F.lit(block)).cast("int")
    rest = [c for c in rows.columns if c not in ("bucket", size)]
    out = rows.withColumn("nb", nb).withColumn("own", F.pmod(F.xxhash64("rep"), "nb").cast("int"))
    out = out.select("bucket", "own", *rest, F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("other"))
    return out.select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", *rest)


def _joined(labels: DataFrame, more: DataFrame) -> DataFrame:
    """Labels (node, label) after further links (u, v) between nodes, known or new."""
    ends = more
    for x in "uv":
        ends = ends.join(labels.select(F.col("node").alias(x), F.col("label").alias(f"l{x}")), x, "left")
    top = components(ends.select(F.coalesce("lu", "u").alias("u"), F.coalesce("lv", "v").alias("v")))
    joined = labels.select("node", "label").unionByName(top.select("node", F.col("node").alias("label"))).distinct()
    up = top.select(F.col("node").alias("label"), F.col("label").alias("next"))
    return settled(joined.join(up, "label", "left").groupBy("node").agg(F.min(F.coalesce("next", "label")).alias("label")), "labels")


def near_duplicates(docs: DataFrame, *, width: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS, sketcher=sketches) -> DataFrame:
    """Classes of near-duplicate documents: a row (doc_id, n_shingles, component_id, kept) for each row of docs.

    docs has doc_id and text; other columns are ignored, whatever their names. Two documents are linked if
    100 * |A & B| >= percent * |A | B| over their sets of distinct `width`-word shingles; fewer words make one shingle, no
    words (or a null) none and no link. Candidates are documents that agree in a whole band of their sketches (fast similarity
    sketches unless sketcher(sets, size) gives others); links are confirmed on the full sets (64-bit hashes of the shingles, of keyed BLAKE2b hashes of their words). Documents with
    the same set are one class from the start, so copies are never paired. In each bucket every class is first compared with two random leaders of the bucket; what then still lies
    in different components of one bucket is compared in full, block by block: first by sizes and sketches, a few hundred
    bytes a document, whose best pair of each component is confirmed and joins most; then documents that still have a pair that
    the sketches don't rule out are compared on their full sets.

    Long texts count as a whole; a task holds one text and about 2 MB more at a time. Rows that share a doc_id are one document: those
    with words share the component, and equal rows of it count once. A row without doc_id links with nothing: null
    component_id, kept. An empty table gives no rows.
    """
    rows_in = bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sk = settled(spread(rows_in).mapInArrow(_sketch(width, bands, rows, sketcher), "doc_id long, n_shingles long, digest binary, keys array<long>, short binary"), "sketches")
    usable = sk.where("doc_id is not null and n_shingles > 0")
    classes = usable.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("keys").alias("keys"), F.first("short").alias("short"))
    classes = settled(classes, "classes")
    wide, sk = sk, settled(sk.select("doc_id", "n_shingles", "digest"), "digests")  # classes have the sketches now
    usable = sk.where("doc_id is not null and n_shingles > 0")
    discard(wide)
    members = classes.select("rep", "n", F.explode("keys").alias("bucket"))
    led = [F.min(F.struct(F.xxhash64("rep", F.lit(seed)).alias("h"), F.col("rep").alias("leader"), F.col("n").alias("ln"))).alias(f"l{seed}") for seed in (1, 2)]
    buckets = settled(members.groupBy("bucket").agg(F.count("*").alias("size"), *led).where("size > 1"), "buckets")
    members = settled(members.join(buckets, "bucket").select("bucket", "size", "rep", "n", "l1", "l2"), "members")
    discard(buckets)
    pairs = (
        members.select("rep", "n", F.explode(F.array("l1", "l2")).alias("l"))
        .where(f"rep != l.leader and 100 * least(n, l.ln) >= {int(percent)} * greatest(n, l.ln)")
        .select(F.least("rep", "l.leader").alias("u"), F.greatest("rep", "l.leader").alias("v"))
        .distinct()
    )
    pairs = settled(pairs, "pairs")
    wanted = settled(members.select(F.col("rep").alias("doc_id")).distinct(), "wanted")
    # equal rows of one doc_id give one set; only repeated ids are shuffled for it
    often = settled(rows_in.groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1").select("doc_id"), "often")
    once = rows_in.join(often, "doc_id", "left_anti").unionByName(rows_in.join(often, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]))
    sets = settled(once.join(wanted, "doc_id", "left_semi").mapInArrow(_sets(width), "rep long, shingles binary"), "sets")
    a, b = (sets.select(F.col("rep").alias(x), F.col("shingles").alias(f"s{x}")) for x in "uv")
    confirmed = lambda p: p.join(a, "u").join(b, "v").select("u", "v", "su", "sv").mapInArrow(_verify(percent), "u long, v long")
    links = confirmed(pairs)
    # rows of one doc_id with different texts are one document: it connects their classes
    texts = usable.select("doc_id", "digest", F.xxhash64("digest").alias("h"))
    several = texts.groupBy("doc_id").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).where("lo < hi").select("doc_id")
    several = settled(texts.join(settled(several, "several"), "doc_id", "left_semi").select("doc_id", "digest").distinct(), "repeated")
    links = links.unionByName(several.join(classes.select("digest", "rep"), "digest").select(F.col("doc_id").alias("u"), F.col("rep").alias("v")))
    labels = components(links)
    discard(pairs, wanted, often)

    n = int(rows_in.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = ["bucket", "i", "j"]
    for best in (True, False):
        known = labels.select(F.col("node").alias("rep"), F.col("label").alias("comp"))
        labelled = settled(members.select("bucket", "size", "rep", "n").join(known, "rep", "left").select("bucket", "size", "rep", "n", F.coalesce("comp", "rep").alias("comp")), "labelled")
        open_ = settled(labelled.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("bucket"), "open")
        # an unlinked pair shares few buckets, but a bucket may be open many times over: block pairs bound every task
        rest = labelled.join(open_, "bucket").join(classes.select("rep", "n", "short"), ["rep", "n"]).select("bucket", "size", "rep", "comp", "n", "short")
        rest = _dealt(rest, "size", BLOCK).repartition(n, *keyed).sortWithinPartitions(*keyed)
        if best:
            maybe = settled(rest.mapInArrow(_likely_blocks(percent, True), "u long, v long").distinct(), "maybe")
            more = settled(confirmed(maybe), "more")
        else:
            maybe = settled(rest.mapInArrow(_likely_blocks(percent, False), "bucket long, rep long, comp long").distinct(), "maybe")
            sized = maybe.join(maybe.groupBy("bucket").agg(F.count("*").alias("size")), "bucket")
            rest = _dealt(sized.select("bucket", "size", "rep", "comp"), "size", SET_BLOCK).join(sets, "rep").select(*keyed, "rep", "comp", "shingles")
            more = settled(rest.repartition(n, *keyed).sortWithinPartitions(*keyed).mapInArrow(_exact_blocks(percent), "u long, v long").distinct(), "more")
        discard(labelled, open_, maybe)
        if not more.isEmpty():
            labels = _joined(labels, more)
        discard(more)
    discard(members)
    final = settled(classes.select("digest", "rep").join(labels.select(F.col("node").alias("rep"), "label"), "rep", "left").select("digest", F.coalesce("label", "rep").alias("top")), "final")
    discard(classes, sets)
    out = sk.select("doc_id", "n_shingles", "digest").join(final, "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("top", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))

#: The same rows by comparing all pairs of different sets that share a shingle: 4 words, 80 percent.
NEAR_DUP_SQL = r"""
WITH RECURSIVE w AS MATERIALIZED (
  SELECT DISTINCT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS t, text FROM documents
), s AS MATERIALIZED (
  SELECT doc_id, text, CASE WHEN len(t) = 0 THEN [] WHEN len(t) < 4 THEN [array_to_string(t, ' ')]
    ELSE list_sort(list_distinct(list_transform(range(1, len(t) - 2), lambda i: array_to_string(t[i:i + 3], ' ')))) END AS grams FROM w
), class AS MATERIALIZED (SELECT row_number() OVER () AS c, grams, len(grams) AS n FROM (SELECT DISTINCT grams FROM s WHERE len(grams) > 0 AND doc_id IS NOT NULL)),
g AS MATERIALIZED (SELECT c, n, dense_rank() OVER (ORDER BY gram) AS gram FROM (SELECT c, n, unnest(grams) AS gram FROM class)),
linked AS MATERIALIZED (
  SELECT a.c AS u, b.c AS v FROM g a JOIN g b ON a.gram = b.gram AND a.c < b.c AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.c, b.c, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), owner AS MATERIALIZED (SELECT doc_id, c FROM s JOIN class USING (grams) WHERE doc_id IS NOT NULL),
shared AS (SELECT min(c) AS u, max(c) AS v, list(DISTINCT c) AS cs FROM owner GROUP BY doc_id HAVING count(DISTINCT c) > 1),
edge AS MATERIALIZED (SELECT u, v FROM linked UNION SELECT v, u FROM linked UNION SELECT u, unnest(cs) FROM shared UNION SELECT unnest(cs), u FROM shared),
reach AS (SELECT c AS u, c AS v FROM class UNION SELECT r.u, e.v FROM reach r JOIN edge e ON r.v = e.u),
top AS (SELECT r.u AS c, min(o.doc_id) AS top FROM reach r JOIN owner o ON o.c = r.v GROUP BY r.u),
doc AS (SELECT doc_id, min(top) AS top FROM owner JOIN top USING (c) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(s.grams) AS BIGINT) AS n_shingles, coalesce(doc.top, d.doc_id) AS component_id, coalesce(coalesce(doc.top, d.doc_id) = d.doc_id, true) AS kept
FROM documents d JOIN s ON d.doc_id IS NOT DISTINCT FROM s.doc_id AND d.text IS NOT DISTINCT FROM s.text LEFT JOIN doc ON d.doc_id = doc.doc_id
"""
