"""Token alignment, phrases and fingerprints against plain restatements, with odd rows."""

import hashlib
import re
import tracemalloc
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from sampleloom.llm import alignment, fingerprints, near_dup, phrases, shingles

FOLDER = "/opt/tokenizers"
DATA = "/root/testdata/sf0.001"
ODD = [
    "", None, " ", "  ", "foo ", "  foo  ", "a\n b\n  c\t d", "x▁y z", "　a b", "é ﬁ ①", "<|endoftext|> <s> x", "a\x00b", "a  b", "\x1c a \x85 b", "don't we'll 's x'.s .'s", "字 " * 5 + "日本語",
    "x" * 3000, " \n ", "\n\nA", "a.\n\nB", "é, É! (x)(y) _a_ a_b 1,234.5%", "e​ ​ x", "﻿ a", "w " * 300,
]


def aligned(rows):
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, digest) of (doc_id, text), whole texts at a time."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(f"{FOLDER}/byte_bpe_50k.json"), SentencePieceProcessor(model_file=f"{FOLDER}/piece_bpe_32k.model")
    a.encode_special_tokens = True
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    values = {chr(x): x for x in plain} | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in plain)}
    found, held = [], Counter()
    for _, text in rows:
        if not text:
            found.append(None)
            continue
        e = a.encode(" " + text, add_special_tokens=False)
        ta = [(i, bytes(values[c] for c in t)) for i, t in zip(e.ids, e.tokens)]
        tb = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
        if any(b"".join(x for _, x in t) != (" " + text).encode() for t in (ta, tb)):
            found.append(None)
            continue
        ends = [np.cumsum([len(x) for _, x in t]).tolist() for t in (ta, tb)]
        cuts, low, groups = sorted(set(ends[0]) & set(ends[1])), 0, []
        for c in cuts:
            groups.append("|".join(",".join(str(i) for (i, _), end in zip(t, own) if low < end <= c) for t, own in zip((ta, tb), ends)))
            low = c
        links, j = [], 0
        for (i, x), end in zip(ta, ends[0]):
            k = j
            while k < len(tb) and ends[1][k] - len(tb[k][1]) < end:
                if ends[1][k] > end - len(x):
                    links.append((i, tb[k][0]))
                k += 1
            j = max(j, k - 2)
        held.update(set(links))
        found.append((len(ta), len(tb), len(cuts), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    top = defaultdict(int)
    for (i, _), n in held.items():
        top[i] = max(top[i], n)
    out = []
    for (doc, _), x in zip(rows, found):
        out.append((doc, 0, 0, 0, 0, 0, 0, "") if x is None else (doc, *x[:3], len(x[3]), sum(held[p] == top[p[0]] for p in x[3]), sum(held[p] for p in x[3]), x[4]))
    return out


key = lambda rows: sorted(rows, key=str)


def test_alignment(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").limit(60).collect()]
    rows = docs + [(10**6 + k, t) for k, t in enumerate(ODD)] + [(None, "some text"), (None, None), docs[0], docs[0]]
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "doc_id long, text string, block int, codes string, segment_id int")
    for n in (1, 7):
        assert key(tuple(r) for r in alignment.align_documents(df.repartition(n), FOLDER).collect()) == key(aligned(rows))
    assert alignment.align_documents(df.limit(0), FOLDER).collect() == []
    assert [r.n_links for r in alignment.align_documents(df.where("text is null"), FOLDER).collect()] == [0, 0]


def test_small_blocks_and_whole_segments_give_the_same(spark, monkeypatch):
    rows = [(k, t) for k, t in enumerate(ODD)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    monkeypatch.setattr(alignment, "BLOCK_BYTES", 1)
    monkeypatch.setattr(alignment, "_MANY", 2)
    assert key(tuple(r) for r in alignment.align_documents(df, FOLDER).collect()) == key(aligned(rows))


def test_segments():
    cut = lambda t, **o: [x.as_py().decode() for x in alignment.segments(pa.array([t]), **o)[0]]
    assert cut("Hi, it's 5  o'clock.\nYes ") == [" Hi", ",", " it", "'s", " 5", "  o", "'clock", ".", "\nYes "]
    assert cut("a\n\n b", apart=False) == [" a\n\n b"] and cut("a\n \n b") == [" a", "\n \n b"]
    found, at = alignment.segments(pa.array(["a b", None, "", "c", None]))
    assert len(found) == 3 and at.tolist() == [0, 2, 2, 2, 3, 3]
    assert alignment._tokenizer_b(FOLDER)[2]


def test_align_tokens_of_any_ids(spark):
    pack = lambda tokens: [i << 20 | n for i, n in tokens]
    df = spark.createDataFrame([(1, pack([(5, 3), (6, 1), (5, 2)]), pack([(9, 2), (8, 2), (7, 2)])), (2, [], [])], "segment_id long, a array<long>, b array<long>")
    links = [(x >> 26, x >> 2 & (1 << 24) - 1, x & 3) for x in alignment.align_tokens(df).first().links]
    assert links == [(5, 9, 1), (5, 8, 2), (6, 8, 3), (5, 7, 3)] and alignment.align_tokens(df).count() == 1


def mined(spark, df):
    con = duckdb.connect()
    con.register("documents", df.select("lang", "text").toPandas())
    want = con.sql(phrases.PHRASES_SQL).df()
    got = phrases.mine_phrases(df).select(*want.columns).toPandas()
    return (key(map(tuple, x.itertuples(index=False))) for x in (got, want))


def test_phrases(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("lang", "text")
    odd = [
        (None, "a b. a b, A B\nc" * 40), ("xx", None), ("xx", ""), (None, "é x;\té x " * 50), ("zz", "w " * 500), ("zz", "q!q q?q" * 20), ("yy", "ab\x0bab ab" * 40), ("und", "a b " * 10),
        ("t", "one two three four five. " * 31), ("t", "one two three. " * 9), ("t", "two three four " * 2),
    ]
    df = docs.unionByName(spark.createDataFrame(odd, "lang string, text string")).withColumns({c: phrases.F.lit(1) for c in ("shard", "codes", "node", "kind", "p")})
    got, want = mined(spark, df.repartition(5))
    assert got == want and len(got) > 50
    for empty in (df.limit(0), df.where("text is null")):
        assert phrases.mine_phrases(empty).collect() == []


def test_phrases_in_small_shards(spark, monkeypatch):
    df = spark.read.parquet(f"{DATA}/documents.parquet").select("lang", "text")
    monkeypatch.setattr(phrases, "BLOCK_BYTES", 1)
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    got, want = mined(spark, df)
    df.sparkSession.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == want


def test_phrase_options(spark):
    df = spark.createDataFrame([("t", "a b c d e. " * 3)], "lang string, text string")
    got = phrases.mine_phrases(df, depth=5, least=3, percent=101, top=4).orderBy("rank").collect()
    assert [r.phrase for r in got] == ["a b", "a b c", "a b c d", "a b c d e"] and {r.score for r in got} == {1_000_000}
    assert [r.phrase for r in phrases.mine_phrases(df, depth=5, least=3).collect()] == ["a b c d e"]


def test_word_codes_take_few_bytes_a_byte_of_text():
    texts = pa.array(["Some words, and others. " * 5000] * 10)
    tracemalloc.start()
    whole = phrases.word_codes(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 16 * texts.nbytes
    parts = phrases.word_codes(pa.chunked_array([texts[:3], texts[:0], texts[3:]]))
    assert whole[0].tolist() == parts[0].tolist() and whole[1].to_pylist() == parts[1].to_pylist() and whole[2].tolist() == parts[2].tolist()
    codes, words, n = phrases.word_codes(pa.chunked_array([pa.array(["a b", None]), pa.array([""]), pa.array(["b A"])]))
    assert codes.tolist() == [0, 1, -1, 1, 0] and words.to_pylist() == [b"a", b"b"] and n.tolist() == [2, 2]
    assert all(len(x) == 0 for x in phrases.word_codes(pa.chunked_array([], pa.string())))


def test_levels_leave_in_small_batches(monkeypatch):
    monkeypatch.setattr(phrases, "_SENT_ROWS", 2, raising=False)
    left = pa.table({"shard": [7], "codes": pa.array([[0, 1, 2, 3, -1, 3, 2]], pa.list_(pa.int32()))})
    right = pa.table({"of": [7] * 4, "code": pa.array([0, 1, 2, 3], pa.int32()), "node": [40, 10, 30, 20]})
    out = phrases._grow(False)((pa.scalar(7),), left, right)
    assert max(b.num_rows for b in out.to_batches()) == 2
    rows = [(r["p"], r["s"], r["n"]) for r in out.to_pylist() if r["kind"] == 1]
    assert rows == [(10, 30, 1), (20, 30, 1), (30, 20, 1), (40, 10, 1)]
    assert out.to_pylist()[0]["codes"] == [3, 0, 2, -1, 1]


def test_word_codes_keep_texts_and_pieces_apart():
    codes, words, n = phrases.word_codes(pa.array(["A b", None, "b. a;", "", "c"]))
    names = words.cast(pa.binary()).to_pylist()
    assert [names[c].decode() if c >= 0 else "|" for c in codes] == ["a", "b", "|", "b", "|", "a", "|", "c"] and n.sum() == 5


def grams(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} - {()}


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


@pytest.mark.parametrize("parts", [1, 6])
def test_fingerprints(spark, parts):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    odd = [(None, "a b c d e f g h"), (None, "a b c d e f g h"), (10**6, None), (10**6 + 1, ""), (10**6 + 2, "é" * 7), (5, "dup " * 30), (5, "dup " * 31), (None, None)]
    df = docs.unionByName(spark.createDataFrame(odd, "doc_id long, text string")).withColumns({c: fingerprints.F.lit("x") for c in ("h", "row", "part", "side", "after")}).repartition(parts)
    hashes = {r.t: r.h for r in df.selectExpr("coalesce(text, '') t", "xxhash64(coalesce(text, '')) h").collect()}
    rows = sorted(((r.doc_id, r.text or "") for r in df.collect()), key=lambda r: (r[0] is None, -(r[0] or 0), hashes[r[1]]))
    want = []
    for k, (doc, text) in enumerate(rows):
        after, half = rows[(k + 1) % len(rows)][1], len(text) // 2
        new = text[: len(text) - half] + after[:half]
        want.append((doc, len(text), hashlib.sha256(new.encode()).hexdigest(), jaccard(grams(text), grams(new)), jaccard(grams(text), grams(after)), text))
    got = fingerprints.fingerprint_documents(df).collect()
    order = lambda r: (str(r[0]), r[1], r[2])
    got, want = sorted(got, key=order), sorted(want, key=order)
    assert [tuple(g[:3]) for g in got] == [w[:3] for w in want]
    assert max(abs(g.near_edited - w[3]) for g, w in zip(got, want)) < 0.2 and max(abs(g.near_next - w[4]) for g, w in zip(got, want)) < 0.2
    assert abs(np.mean([g.near_edited - w[3] for g, w in zip(got, want)])) < 0.02
    by = {}
    for g, w in zip(got, want):
        assert by.setdefault(w[5], g.fingerprint) == g.fingerprint and len(g.fingerprint) == 344
        assert (g.near_next == 1.0) == (w[4] == 1.0)
    assert len(set(by.values())) == len({frozenset(grams(t)) for t in by})


def test_few_rows(spark):
    df = spark.createDataFrame([(3, "a b c d e f g h i j")], "doc_id int, text string")
    one = fingerprints.fingerprint_documents(df).first()
    assert one.near_next == 1.0 and one.edited_sha256 == hashlib.sha256(b"a b c d e a b c d").hexdigest() or one.n_chars == 19
    assert fingerprints.fingerprint_documents(df.limit(0)).collect() == []
    same = spark.createDataFrame([(None, "x")] * 50, "doc_id long, text string").repartition(4)
    assert [r.near_next for r in fingerprints.fingerprint_documents(same).collect()] == [1.0] * 50


def test_permutations_are_universal():
    a, b = fingerprints.permutations(64)
    assert len(set(a.tolist())) == 64 and not set(a.tolist()) & set(b.tolist())
    x = shingles.mix(np.arange(5000, dtype=np.uint64))
    found = fingerprints.minima(x, np.array([0, 3000, 3000, 5000]), 64)
    assert (found[1] == 0xFFFFFFFF).all() and abs(np.log2(found[0].mean() / (2**32 / 3000))) < 1


def test_fingerprint_groups(spark):
    words = np.random.default_rng(4).integers(0, 5000, 400).astype(str)
    texts = [" ".join(words), " ".join([*words[:390], "new"]), " ".join(words[:200]), " ".join(words[::-1]), " ".join(words), None, "", "one two"]
    rows = [(k, t) for k, t in enumerate(texts)] + [(100 + k, " ".join(np.random.default_rng(k).integers(0, 90, 60).astype(str))) for k in range(20)]
    got = {r.doc_id: r.component_id for r in fingerprints.fingerprint_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = {d: grams(t) for d, t in rows}
    want = {d: min([e for e in sets if sets[d] and sets[e] and jaccard(sets[d], sets[e]) >= 0.8] + [d]) for d in sets}  # links of these are one step
    assert got == want and got[1] == got[4] == 0 != got[2]


def test_grouped_fingerprints(spark):
    rows = [(1, "a b c d e f g"), (2, "A b c d e f g"), (2, "A b c d e f g"), (3, "x"), (None, "x"), (4, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("component_id", fingerprints.F.lit(0))
    got = sorted(((r.doc_id, r.component_id, r.kept, r.n_chars) for r in fingerprints.grouped_fingerprints(df).collect()), key=str)
    assert got == sorted([(1, 1, True, 13), (2, 1, False, 13), (2, 1, False, 13), (3, 3, True, 1), (None, None, True, 1), (4, 4, True, 0)], key=str)


def _unmix(x):
    """The inverse of shingles.mix, on whole numbers."""
    m = 2**64 - 1
    x ^= x >> 31 ^ x >> 62
    x = x * pow(0x94D049BB133111EB, -1, 2**64) & m
    x ^= x >> 27 ^ x >> 54
    x = x * pow(0xBF58476D1CE4E5B9, -1, 2**64) & m
    return x ^ x >> 30 ^ x >> 60


def test_words_that_collided_under_an_open_hash(spark):
    """Words of 16 bytes built to agree under an unkeyed, invertible hash are different words, and texts of them no near-duplicates."""
    m, one, two = 2**64 - 1, 0x9E3779B97F4A7C15, 0xA0761D6478BD642F
    mix = lambda v: int(shingles.mix(np.array([v & m], np.uint64))[0])
    assert _unmix(mix(12345)) == 12345
    half = lambda head, tail: (mix(mix(head + one) * 0xD6E8FEB86659FD93) + mix(tail ^ two)) & m
    rng, pairs = np.random.default_rng(1), []
    letters = np.frombuffer(b"abcdefghijklmnopqrstuvwxyz0123456789!#$%&()*+-/:;<=>?@[]^_{|}~", np.uint8)
    while len(pairs) < 24:
        head, tail = (int.from_bytes(rng.choice(letters, 8).tobytes(), "little") for _ in range(2))
        goal = half(head, tail)
        for _ in range(40_000):
            other = int.from_bytes(rng.choice(letters, 8).tobytes(), "little")
            new = (_unmix((goal - mix(mix(other + one) * 0xD6E8FEB86659FD93)) & m) ^ two).to_bytes(8, "little")
            if all(0x21 <= b < 0x7F and not 65 <= b <= 90 for b in new):
                pairs.append((head.to_bytes(8, "little") + tail.to_bytes(8, "little"), other.to_bytes(8, "little") + new))
                break
        if len(pairs) >= 2:
            break
    words = [" ".join(p[k].decode() for p in pairs) for k in (0, 1)]
    assert all(half(int.from_bytes(a[:8], "little"), int.from_bytes(a[8:], "little")) == half(int.from_bytes(b[:8], "little"), int.from_bytes(b[8:], "little")) for a, b in pairs)
    got = near_dup.near_duplicates(spark.createDataFrame([(1, words[0]), (2, words[1])], "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(1, 1), (2, 2)]
    values, _ = shingles.word_hashes(*shingles.text_bytes(pa.array(words)))
    assert len(set(values.tolist())) == 4
    assert set(values.tolist()).isdisjoint(shingles.word_hashes(*shingles.text_bytes(pa.array(words)), key=b"another")[0].tolist())
