"""Cross-tokenizer alignment: which tokens of two tokenizers share bytes, and where both end.

Both tokenizers work on a text word by word, so a corpus is first cut into segments (a word with the space before it, or the signs after it)
that neither of them ever crosses. Every different segment is tokenized and aligned once, relationally: tokens exploded by
position, running sums of their lengths, an equi-join of the ends, running counts of the cuts. Documents are sequences of
segments: cut points, links and counts of a document are those of its segments, one after the other.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, discard, settled, sized, spread
from .shingles import text_bytes

BYTE_BPE, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Bytes of text, about, whose segments share one numbering; a longer text is one by itself.
BLOCK_BYTES = 24 << 20
#: Segments that a tokenizer takes at a time.
_MANY = 2000
#: A link is a number: the token id of A, that of B in so many bits, then whether A and whether B end where the link does.
_B_BITS = 24
#: A token is a number: its id, then its byte length in so many bits.
_SIZE_BITS = 20


def _byte_values() -> dict[str, int]:
    """The bytes that the characters of byte-level vocabularies stand for: printable ones themselves, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


@cache
def _tokenizer_a(folder: str):
    """An encoder of byte-level BPE, and each token's bytes."""
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    found = Tokenizer.from_file(os.path.join(folder, BYTE_BPE))
    found.encode_special_tokens = True  # their strings in a text are plain text
    values = _byte_values()
    vocabulary = found.get_vocab(with_added_tokens=True)
    tokens = [b""] * (max(vocabulary.values()) + 1)
    for token, k in vocabulary.items():
        tokens[k] = bytes(values[c] for c in token) if all(c in values for c in token) else token.encode()
    return found, tokens


@cache
def _tokenizer_b(folder: str):
    """An encoder of pieces, each piece's bytes, and whether no piece reaches over a place where segments() cuts."""
    from sentencepiece import SentencePieceProcessor

    found = SentencePieceProcessor(model_file=os.path.join(folder, PIECES))
    tokens, apart = [], True
    for k in range(found.get_piece_size()):
        piece = found.id_to_piece(k)
        tokens.append(bytes([int(piece[3:-1], 16)]) if found.is_byte(k) else piece.replace("▁", " ").encode())
        if not found.is_byte(k) and not found.is_control(k) and not found.is_unknown(k):
            kinds = _KIND[np.frombuffer(tokens[-1], np.uint8)]
            apart &= not _CUTS[kinds[:-1], kinds[1:]].any() and "▁" not in piece.lstrip("▁")
    return found, tokens, apart


#: Kinds of bytes: letters and digits of ASCII, its signs, the apostrophe, space, line feed; others, those of longer characters among them, are 0.
_KIND = np.zeros(256, np.uint8)
_KIND[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = 1
_KIND[[b for b in range(0x21, 0x7F) if not chr(b).isalnum()]] = 2
_KIND[[0x27, 0x20, 0x0A]] = 3, 4, 5
#: Where a segment ends between two kinds: a sign or apostrophe after a letter, a letter after a sign, a space or line feed after any of them.
_CUTS = np.zeros((6, 6), bool)
for _pair in ((1, 2), (1, 3), (2, 1), (1, 4), (2, 4), (3, 4), (1, 5), (2, 5), (3, 5)):
    _CUTS[_pair] = True


def _white(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the byte before each place is, or ends, white space of any kind (Unicode's White_Space, and what lies below the space)."""
    p1, p2, p3 = (data[np.maximum(at - k, 0)] for k in (1, 2, 3))
    two = (p2 == 0xC2) & ((p1 == 0x85) | (p1 == 0xA0))
    general = (p3 == 0xE2) & (p2 == 0x80) & ((p1 <= 0x8D) | (p1 == 0xA8) | (p1 == 0xA9) | (p1 == 0xAF))
    three = ((p3 == 0xE1) & (p2 == 0x9A) & (p1 == 0x80)) | general | ((p3 == 0xE2) & (p2 == 0x81) & (p1 >= 0x9F)) | ((p3 == 0xE3) & (p2 == 0x80) & (p1 == 0x80))
    return (p1 <= 0x20) | (p1 == 0x7F) | ((p1 >= 0x80) & (two | three))


def segments(column: pa.Array, apart: bool = True) -> tuple[pa.Array, np.ndarray]:
    """The segments of space + text for each text that isn't empty, all in one binary array, and each text's offsets into it.

    A segment begins at a space or line feed that follows anything but white space, and between letters or digits and signs; only after an apostrophe a letter
    goes on. There the pattern of byte-level BPE always begins a new match, whatever lies on the other side, and no piece goes on, so both tokenizers
    give a text the tokens of its segments. Spaces at the end of a text belong to its last segment. Where a vocabulary has pieces
    that do go on (not apart), a text is one segment.
    """
    data, at = text_bytes(column)
    size = np.diff(at)
    full = np.flatnonzero(size)
    # a space before every text that isn't empty
    starts = at[:-1][full] + np.arange(len(full))
    spaced = np.empty(len(data) + len(full), np.uint8)
    mask = np.ones(len(spaced), bool)
    mask[starts] = False
    spaced[mask] = data
    spaced[starts] = 0x20
    cut = np.zeros(len(spaced), bool)
    if apart and len(spaced):
        kind = _KIND[spaced]
        cut[1:] = _CUTS.ravel()[kind[:-1] * np.uint8(6) + kind[1:]]
        other = np.flatnonzero((kind[1:] == 4) & (kind[:-1] == 0)) + 1
        cut[other[~_white(spaced, other)]] = True
        for k in np.flatnonzero(spaced[np.append(starts[1:], len(spaced)) - 1] == 0x20).tolist():
            a, b = starts[k], starts[k + 1] if k + 1 < len(starts) else len(spaced)
            solid = np.flatnonzero(spaced[a:b] != 0x20)
            cut[a + (solid[-1] + 1 if len(solid) else 0) : b] = False
    cut[starts] = True
    cuts = np.flatnonzero(cut)
    offsets = np.append(cuts, len(spaced)).astype(np.int64)
    found = pa.Array.from_buffers(pa.large_binary(), len(cuts), [None, pa.py_buffer(offsets), pa.py_buffer(spaced)])
    # texts begin where the segments of those before them end; empty ones have none
    return found, np.searchsorted(cuts, np.append(starts, len(spaced)))[np.concatenate([[0], np.cumsum(size > 0)])]


def _alone(segment: str) -> str:
    """A segment as a text that the pieces' own space before it, and a sign or letter that no piece joins with it, stand before."""
    first = segment[0]
    return segment[1:] if first == " " else "," + segment if first.isalnum() else "a" + segment


def _coded(folder: str):
    """Blocks of documents: each document with the codes of its segments, and what the codes of a block stand for."""

    def emit(block: int, ids: list[pa.Array], texts: list[pa.Array]) -> Iterator[pa.RecordBatch]:
        found, place = segments(pa.chunked_array(texts).combine_chunks() if len(texts) > 1 else texts[0], _tokenizer_b(folder)[2])
        coded = found.dictionary_encode()
        docs = pa.concat_arrays(ids) if len(ids) > 1 else ids[0]
        n, m = len(docs), len(coded.dictionary)
        names = ["block", "row", "doc_id", "codes", "code", "segment"]
        lists = pa.ListArray.from_arrays(pa.array(place, pa.int32()), coded.indices.cast(pa.int32()))
        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, block)), pa.array(np.arange(n), pa.int32()), docs, lists, pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names=names)
        for a in range(0, m, 50_000):
            k = min(50_000, m - a)
            part = coded.dictionary.slice(a, k).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(k, block)), pa.nulls(k, pa.int32()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.list_(pa.int32())), pa.array(np.arange(a, a + k), pa.int32()), part], names=names)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        ids, texts, size = [], [], 0
        for batch in batches:
            more = batch.column(1).nbytes
            if texts and size + more > BLOCK_BYTES:
                yield from emit(block, ids, texts)
                ids, texts, size, block = [], [], 0, block + 1
            ids.append(batch.column(0))
            texts.append(batch.column(1))
            size += more
        if texts:
            yield from emit(block, ids, texts)

    return run


def _encoded(folder: str):
    """Segments' tokens under both tokenizers; none if the bytes of a tokenization differ from the segment."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_a, bytes_a = _tokenizer_a(folder)
        encode_b, bytes_b, _ = _tokenizer_b(folder)
        before = [len(encode_b.encode(x)) for x in ("a", ",")]
        size_a, size_b = (np.array([len(t) for t in tokens], np.int64) for tokens in (bytes_a, bytes_b))
        for whole in batches:
            for start in range(0, len(whole), _MANY):
                batch = whole.slice(start, _MANY)
                raw = batch.column(1).to_pylist()
                texts = [x.decode() for x in raw]
                found_a = [e.ids for e in encode_a.encode_batch(texts, add_special_tokens=False)]
                found_b = [ids if t[0] == " " else ids[before[t[0].isalnum()] :] for ids, t in zip(encode_b.encode(list(map(_alone, texts)), num_threads=1), texts, strict=True)]
                out = []
                for found, tokens, sizes in ((found_a, bytes_a, size_a), (found_b, bytes_b, size_b)):
                    ok = [b"".join(map(tokens.__getitem__, ids)) == x for ids, x in zip(found, raw, strict=True)]
                    out.append((found, ok, sizes))
                good = np.array(out[0][1]) & np.array(out[1][1])
                columns = [batch.column(0)]
                for found, _, sizes in out:
                    kept = [ids if g else [] for ids, g in zip(found, good, strict=True)]
                    flat = np.fromiter((k for ids in kept for k in ids), np.int64)
                    at = pa.array(np.concatenate([[0], np.cumsum([len(ids) for ids in kept])]), pa.int32())
                    columns.append(pa.ListArray.from_arrays(at, pa.array(flat << _SIZE_BITS | sizes[flat])))
                yield pa.RecordBatch.from_arrays(columns, names=["segment_id", "a", "b"])

    return run


def align_tokens(tokens: DataFrame) -> DataFrame:
    """The links of texts that two tokenizers have cut: rows (segment_id, links), links in byte order, for texts with tokens.

    tokens has segment_id and the arrays a and b of tokens (id and byte length in a number), of equal summed lengths. Token positions are
    exploded, ends are running sums of lengths; A's and B's ends meet in an equi-join, and where only one ends, the token of
    the other that is still open ends later: in falling order of ends it is the last one seen. Each end of either is so the end of
    exactly one link, the bytes that one A token and one B token share, and the ends of both are the cuts between groups.

    Everything is keyed by text, so where the session doesn't ask for all join keys in an exchange, tokens are shuffled once.
    """
    dealt = tokens.repartition("segment_id")
    along = Window.partitionBy("segment_id").orderBy("pos")

    def ends(side: str) -> DataFrame:
        rows = dealt.select("segment_id", F.posexplode(side).alias("pos", "t"))
        size = F.col("t").bitwiseAND(F.lit((1 << _SIZE_BITS) - 1))
        return rows.select("segment_id", F.sum(size).over(along).alias("end"), F.shiftright("t", _SIZE_BITS).alias(side))

    back = Window.partitionBy("segment_id").orderBy(F.col("end").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = ends("a").join(ends("b"), ["segment_id", "end"], "full")
    link = F.shiftleft(F.last("a", ignorenulls=True).over(back), _B_BITS + 2).bitwiseOR(F.shiftleft(F.last("b", ignorenulls=True).over(back), 2))
    flags = F.when(F.col("a").isNotNull(), 2).otherwise(0) + F.when(F.col("b").isNotNull(), 1).otherwise(0)
    links = met.select("segment_id", "end", link.bitwiseOR(flags.cast("long")).alias("link"))
    found = links.groupBy("segment_id").agg(F.array_sort(F.collect_list(F.struct("end", "link"))).alias("l"))  # a text's tokens, which came as one row
    return found.select("segment_id", F.transform("l", lambda x: x["link"]).alias("links"))


class _Block:
    """The aligned segments of a block as flat arrays: segment k has the links at[k]:at[k + 1]."""

    def __init__(self, table: pa.Table) -> None:
        table = table.sort_by("code").combine_chunks()
        lists = table["links"].chunk(0) if table["links"].num_chunks else pa.array([], pa.list_(pa.int64()))
        self.known = ~np.asarray(lists.is_null().to_numpy(zero_copy_only=False), bool)
        size = np.nan_to_num(np.asarray(pc.list_value_length(lists).to_numpy(zero_copy_only=False), float)).astype(np.int64)
        self.at = np.concatenate([[0], np.cumsum(size)])
        self.link = pc.list_flatten(lists).to_numpy(zero_copy_only=False)
        self.table = table

    def each(self, flat: np.ndarray) -> np.ndarray:
        """Sums of a number per link for each segment."""
        return np.diff(np.concatenate([[0], np.cumsum(flat)])[self.at])


def _documents(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all documents of a block, and each one's offsets."""
    lists = table["codes"].combine_chunks()
    lists = lists if isinstance(lists, pa.Array) else pa.concat_arrays(lists.chunks)
    size = np.asarray(pc.list_value_length(lists).to_numpy(zero_copy_only=False), np.int64)
    return pc.list_flatten(lists).to_numpy(zero_copy_only=False).astype(np.int64), np.concatenate([[0], np.cumsum(size)])


def _whole(block: _Block, codes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether every segment of a document could be aligned."""
    bad = np.concatenate([[0], np.cumsum(~block.known[codes])])
    return np.diff(bad[at]) == 0


def _pair_counts(block: _Block, codes: np.ndarray, at: np.ndarray, ok: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The id pairs of a block, and how many of its documents hold each linked."""
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    pairs, local = np.unique(block.link >> 2, return_inverse=True)
    keep, m = ok[doc], max(1, len(block.known))
    held = np.unique(doc[keep] * m + codes[keep])  # a document's different segments
    doc, codes = held // m, held % m
    size = np.diff(block.at)[codes]
    pick = np.repeat(block.at[codes] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum()) if len(codes) else np.zeros(0, np.int64)
    once = np.unique(np.repeat(doc, size) * max(1, len(pairs)) + local[pick])
    n = np.bincount(once % max(1, len(pairs)), minlength=len(pairs))
    return pairs[n > 0], n[n > 0]


def _groups(block: _Block) -> pa.Array:
    """Each segment's groups as text: A's ids, a bar, B's ids; groups apart by semicolons."""
    link = block.link
    parts = []
    cut = (link & 3) == 3
    for shift, bit, mask in ((_B_BITS + 2, 2, -1), (2, 1, (1 << _B_BITS) - 1)):
        ends = (link & bit) > 0
        ids = pc.cast(pa.array((link[ends] >> shift) & mask), pa.string())
        last = np.concatenate([[0], np.cumsum(ends)[np.flatnonzero(cut)]])  # tokens up to each cut
        parts.append(pc.binary_join(pa.ListArray.from_arrays(pa.array(last, pa.int32()), ids), ","))
    each = pc.binary_join_element_wise(*parts, "|")
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(cut)])[block.at], pa.int32()), each), ";")


def _total(per: np.ndarray, codes: np.ndarray, at: np.ndarray, ok: np.ndarray) -> np.ndarray:
    """Sums of a number per segment for each document, 0 for those that aren't ok."""
    return np.where(ok, np.diff(np.concatenate([[0], np.cumsum(per[codes])])[at]), 0)


def _cut(docs: pa.Table, dictionary: pa.Table) -> pa.Table:
    """A block's documents with what their links alone tell, then its id pairs with the number of documents."""
    block, (codes, at) = _Block(dictionary), _documents(docs)
    ok = _whole(block, codes, at)
    text, digests = _groups(block), []
    for k in range(len(at) - 1):
        mine = codes[at[k] : at[k + 1]]
        digests.append(hashlib.sha256(";".join(text.take(pa.array(mine)).to_pylist()).encode()).hexdigest() if ok[k] and len(mine) else "")
    link = block.link
    sums = {"n_a": (link & 2) > 0, "n_b": (link & 1) > 0, "n_groups": (link & 3) == 3, "n_links": np.ones(len(link), np.int64)}
    pairs, n = _pair_counts(block, codes, at, ok)
    first = {"block": docs["block"], "row": docs["row"], "doc_id": docs["doc_id"]} | {c: _total(block.each(x), codes, at, ok) for c, x in sums.items()} | {"groups_sha256": digests}
    out = pa.table(first | {"pair": pa.nulls(len(docs), pa.int64()), "n": pa.nulls(len(docs), pa.int64())})
    return pa.concat_tables([out, pa.table({"pair": pairs, "n": n})], promote_options="default")


_CUT = "block long, row int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pair long, n long"


def _scored(docs: pa.Table, dictionary: pa.Table) -> pa.Table:
    """A block's documents with their links' best and summed counts."""
    dictionary, (codes, at) = dictionary.sort_by("code"), _documents(docs)
    ok = np.diff(np.concatenate([[0], np.cumsum(np.asarray(dictionary["n_best"].is_null().to_numpy(), np.int64)[codes])])[at]) == 0
    return pa.table({"block": docs["block"], "row": docs["row"]} | {c: _total(dictionary[c].fill_null(0).to_numpy(), codes, at, ok) for c in ("n_best", "count_sum")})


def align_documents(docs: DataFrame, folder: str) -> DataFrame:
    """How the tokens of two tokenizers meet in each document: a row of counts and the digest of its groups for each row of docs.

    docs has doc_id and text; other columns are ignored, whatever their names. folder has the vocabulary files, on all executors. A text
    that is null or empty, or whose tokens don't give its bytes back, has no tokens: zeros and no digest. Every row counts as a document, repeats and null
    ids too. Long texts count as a whole: a task holds about BLOCK_BYTES of text or one longer text, and its different
    segments. An empty table gives no rows.
    """
    rows = bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    coded = settled(spread(rows).mapInArrow(_coded(folder), "block long, row int, doc_id long, codes array<int>, code int, segment binary"), "coded")
    texts = coded.where("codes is not null").select("block", "row", "doc_id", "codes")
    held = coded.where("code is not null").select("block", "code", "segment")
    distinct = settled(held.select("segment").distinct().withColumn("segment_id", F.monotonically_increasing_id()), "segments")
    encoded = settled(distinct.select("segment_id", "segment").mapInArrow(_encoded(folder), "segment_id long, a array<long>, b array<long>"), "encoded")
    links = settled(align_tokens(encoded), "links", requireAllClusterKeysForCoPartition="false")
    ids = settled(held.join(distinct, "segment").select(F.col("block").alias("of"), "code", "segment_id"), "ids")
    discard(encoded, distinct)

    side = ids.join(links, "segment_id", "left").select("of", "code", "links")
    cut = settled(texts.groupBy("block").cogroup(side.groupBy("of")).applyInArrow(_cut, _CUT), "cut")
    counts = settled(cut.where("pair is not null").groupBy("pair").agg(F.sum("n").alias("n")), "counts")
    first = F.shiftright("pair", _B_BITS)
    top = counts.groupBy(first.alias("a")).agg(F.max("n").alias("most"))
    best = settled(counts.join(top, first == F.col("a")).select("pair", "n", (F.col("n") == F.col("most")).cast("long").alias("best")), "best")
    each = links.select("segment_id", F.explode("links").alias("link")).select("segment_id", F.shiftright("link", 2).alias("pair"))
    each = settled(each.join(sized(best), "pair").groupBy("segment_id").agg(F.sum("best").alias("n_best"), F.sum("n").alias("count_sum")), "each")
    discard(links, counts, best)
    side = ids.join(each, "segment_id", "left").select("of", "code", "n_best", "count_sum")
    scored = texts.select("block", "row", "codes").groupBy("block").cogroup(side.groupBy("of")).applyInArrow(_scored, "block long, row int, n_best long, count_sum long")
    out = cut.where("row is not null").join(scored, ["block", "row"])
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
