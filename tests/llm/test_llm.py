"""The training-data operators against brute force, with nulls, empty and long texts, ties, repeats, empty tables, odd columns."""

import base64
import hashlib
import json
import random
import re
import time
import tracemalloc
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sampleloom.llm import chat, pii, queries, shingles, warc
from sampleloom.llm.common import components
from sampleloom.llm.decontaminate import decontaminate
from sampleloom.llm.embeddings import by_dimension, near_duplicate_vectors
from sampleloom.llm.language import LanguageModel, identify_languages
from sampleloom.llm.mixing import MIX_SQL, mix_sources, mixed_documents
from sampleloom.llm.near_dup import likely, near_duplicates
from sampleloom.llm.token_counts import WORDS_SQL, TokenRollup, count_words, deletes, inserts, replayed, revisions, token_rows, vocabulary
from sampleloom.llm.toxicity import OrdinalModel, _auc, _marks, _rank_correlation, _tokens, fit_severity, fit_toxicity, labelled_sample, predict_severity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, TAKEN int"
DATA = "/root/testdata/sf0.001"


def docs(spark, rows):
    """Rows (doc_id, text, lang, source), with columns whose names clash with results."""
    return spark.createDataFrame([(*r, None, "x", 7) for r in rows], DOCS)


WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


@pytest.fixture(scope="module")
def corpus(spark):
    r = random.Random(3)
    text = lambda n: " ".join(r.choice(WORDS) + str(r.randint(0, 30)) for _ in range(n))
    base, rows = [text(r.randint(1, 80)) for _ in range(30)], []
    for k in range(120):
        words = r.choice(base).split()
        for _ in range(r.choice([0, 0, 1, 1, 2, 4])):
            words[r.randrange(len(words))] = "edit" + str(r.randint(0, 99))
        rows.append((k, " ".join(words), "en" if k % 3 else None, f"s{k % 5}" if k % 11 else None))
    rows += [(200, None, "en", "s1"), (201, "", None, None), (202, " \n\t", "fr", "s1"), (203, "One two", "fr", "s2"), (204, "ONE\x0btwo", "fr", "s2"), (205, "one two three four", "fr", "s2")]
    rows += [(206, text(30000), "en", "s0"), rows[5], rows[5], (None, rows[7][1], "en", "s1")]
    return rows


def shingle_set(text, k):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def closure(n, links):
    label = list(range(n))
    while True:
        new = list(label)
        for a, b in links:
            new[a] = new[b] = min(new[a], new[b])
        if new == label:
            return label
        label = new


@pytest.mark.parametrize("width", [4, 5])
def test_near_duplicates(spark, corpus, width):
    got = near_duplicates(docs(spark, corpus), width=width).collect()
    assert len(got) == len(corpus) and {(r.component_id, r.kept) for r in got if r.doc_id is None} == {(None, True)}
    ids = sorted({r[0] for r in corpus if r[0] is not None})
    sets = {r[0]: shingle_set(r[1], width) for r in corpus}
    at = {d: k for k, d in enumerate(ids)}
    links = [(at[a], at[b]) for a in ids for b in ids if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = closure(len(ids), links)
    for r in got:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), ids[want[at[r.doc_id]]], ids[want[at[r.doc_id]]] == r.doc_id)
    assert near_duplicates(docs(spark, [])).collect() == []


def test_near_duplicates_of_repeated_ids(spark):
    a, b, c, d = ("one two three four five six", "a b c d e f g", "h i j k l m n", "o p q r s t u")
    rows = [(3, a), (5, a), (5, b), (5, c), (9, c), (7, d), (5, None), (11, b), (5, b)]
    got = near_duplicates(docs(spark, [(k, x, None, None) for k, x in rows])).collect()
    assert sorted((r.doc_id, r.n_shingles > 0, r.component_id, r.kept) for r in got) == sorted((k, x is not None, 7 if k == 7 else 3 if x else k, k in (3, 7) or x is None) for k, x in rows)


def test_words_of_one_structure_differ():
    """Words that collide under every polynomial hash modulo a power of two."""
    a, b = "a", "b"
    for _ in range(11):
        a, b = a + b, b + a
    words, at = shingles.word_hashes(*shingles.text_bytes(pa.array([f"{a} {b}", None, "", "Ab aB ab\x00", "z" * 16 + " " + "Z" * 17 + " " + "z" * 17, "é"])))
    assert len(set(words.tolist())) == 7 and words[2] == words[3] and words[6] == words[7] and at.tolist() == [0, 2, 2, 2, 5, 8, 9]


def test_near_duplicates_of_one_structure(spark):
    a, b = "a", "b"
    for _ in range(10):
        a, b = a + b, b + a
    got = {r.doc_id: r.component_id for r in near_duplicates(docs(spark, [(1, a, None, None), (2, b, None, None), (3, f"x {a}", None, None), (4, f"x {b}", None, None)])).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4}


def test_repeated_rows_are_no_product(spark):
    text = " ".join(f"w{k}" for k in range(60))
    rows = [(1, text, None, None)] * 3000 + [(2, text + " more", None, None)] * 3000
    began = time.time()
    got = near_duplicates(docs(spark, rows)).groupBy("doc_id", "component_id", "kept").count().collect()
    assert sorted(map(tuple, got)) == [(1, 1, True, 3000), (2, 1, False, 3000)] and time.time() - began < 60


def test_hot_bucket(spark):
    """Documents of one template that share bands below the similarity: only the true pairs are linked, by several blocks."""
    r = random.Random(11)
    head = [f"t{k}" for k in range(120)]
    rows = [(k, " ".join(head + [f"own{k}x{j}" for j in range(45)]), None, None) for k in range(1500)]
    rows += [(2000 + k, " ".join(rows[k][1].split()[:-3]), None, None) for k in r.sample(range(1500), 40)]
    got = {x.doc_id: x.component_id for x in near_duplicates(docs(spark, rows)).collect()}
    assert all(got[k] == (k if k < 2000 else k - 2000) for k in got)


def test_sketches_rule_out_no_link():
    r = np.random.default_rng(2)
    for share in (0.8, 0.82, 0.9):
        n, m = 1000, round(1000 * 2 * share / (1 + share))
        sets = []
        for _ in range(200):
            x = r.integers(0, 2**63, 2 * n - m + 2, dtype=np.uint64)
            sets += [np.unique(x[:n]), np.unique(x[n - m : 2 * n - m])]
        short = (shingles.mix(shingles.sketches(sets, 252)) & np.uint64(255)).astype(np.uint8)
        size = np.array([len(z) for z in sets])
        assert (likely(short[::2], size[::2], short[1::2], size[1::2], 80).diagonal() > 0).all()
    other = likely(short[::2][:50], size[::2][:50], short[1::2][50:100], size[1::2][50:100], 80)
    assert not other.any()


def test_sketches():
    r = np.random.default_rng(1)
    a = np.unique(r.integers(0, 2**63, 900, dtype=np.uint64))
    pair = shingles.sketches([a[:800], a[100:], a[:0], a[:1], a[:1]], 600)
    assert abs((pair[0] == pair[1]).mean() - 700 / 900) < 0.06 and (pair[3] == pair[4]).all()
    assert (pair[[0, 1, 3]] != np.iinfo(np.uint64).max).all() and (pair[2] == np.iinfo(np.uint64).max).all()


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 130)] + [(7, 7)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert set(got.values()) == {0, 100} and got[40] == 0 and len(got) == 71
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_mixing(spark, corpus):
    got = mix_sources(docs(spark, corpus), range_rows=7).collect()
    again = mix_sources(docs(spark, corpus).repartition(9), range_rows=7).collect()
    assert sorted(map(str, got)) == sorted(map(str, again)) and len(got) == len(corpus)
    sizes, taken, target = Counter(), Counter(), {}
    for r in got:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert 0 <= r.taken <= 2 * r.size
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    left, free, want = 1.5 * sum(sizes.values()), set(order), {}
    while free:
        level = left / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > 2 * sizes[s]]
        for s in over or list(free):
            want[s] = 2.0 * sizes[s] if over else level * weight[s]
            left -= want[s] if over else 0
            free.discard(s)
    for s in order:
        assert abs(want[s] - target[s]) < 1e-6 and 0 <= target[s] - taken[s] < 1
    out = mixed_documents(docs(spark, corpus))
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "size", "TAKEN", "size_", "taken_", "copies"]
    assert out.count() == sum(r.taken > 0 for r in got) or abs(out.count() - sum(r.taken > 0 for r in got)) <= 2
    assert mix_sources(docs(spark, [])).count() == 0
    zero = mix_sources(docs(spark, [(1, None, "en", "a"), (2, "", "en", None)])).collect()
    assert [(r.target, r.taken) for r in zero] == [(0.0, 0), (0.0, 0)]


def test_decontamination(spark):
    r = random.Random(5)
    w = lambda n: [r.choice(WORDS) for _ in range(n)]
    items = [(k, " ".join(w(n))) for k, n in enumerate([14, 14, 10, 9, 3, 1, 12])] + [(7, ""), (8, None), (None, "alpha beta"), (9, "É été " + " ".join(w(12)))]
    rows = []
    for k in range(60):
        words = w(r.randint(0, 40))
        for _ in range(r.randint(0, 2)):
            words += (r.choice(items)[1] or "").upper().split() + w(3)
        rows.append((k, ", ".join(words), "en", "s"))
    rows += [(100, None, "en", "s"), (101, "É ÉTÉ", None, None), rows[3], (3, "other", "en", "s"), (None, items[0][1], "en", "s")]
    tokens = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    table = spark.createDataFrame(items, "item_id long, text string")
    for limit in (40_000, 0):
        got = decontaminate(docs(spark, rows), table, literal_shingles=limit).collect()
        want = []
        for d, text, *_ in rows:
            t, hit, found = tokens(text), set(), set()
            for i, item in items:
                x = tokens(item)
                if not x or i is None:
                    continue
                n = min(10, len(x))
                for a in range(len(x) - n + 1):
                    for p in range(len(t) - n + 1):
                        if t[p : p + n] == x[a : a + n]:
                            hit |= set(range(p, p + n))
                            found.add(str(i))
            want.append((str(d), len(t), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
        assert sorted((str(x.doc_id), x.n_words, x.n_hit, x.n_items, x.items_sha256, x.contaminated) for x in got) == sorted(want)
    assert decontaminate(docs(spark, rows), table.limit(0)).where("contaminated").count() == 0
    assert decontaminate(docs(spark, []), table).count() == 0


def test_language(spark):
    rows = [(k, ("the cat and the dog sat there with him " if k % 2 else "le chat et le chien sont avec lui ") * (k % 4 + 1), "en" if k % 2 else "fr", "s") for k in range(90)]
    rows += [(1, rows[1][1], "en", "s"), (100, None, None, None), (101, "123 ²", None, None), (102, "", "xx", None), (103, "thereby cats", None, None), (104, "Chats " * 50000, None, None), (None, "the dog", None, None)]
    got = {r.doc_id: r for r in identify_languages(docs(spark, rows)).collect()}
    assert len(got) == len(rows) - 1 and all(got[k].lang_pred == ("en" if k % 2 else "fr") for k in range(90))
    assert (got[100].lang_pred, got[101].lang_pred, got[103].lang_pred, got[104].lang_pred, got[None].lang_pred) == ("und", "und", "en", "fr", "en")
    assert all(0 <= r.score <= 1 for r in got.values())
    empty = identify_languages(docs(spark, [(1, "the", None, None)])).collect()
    assert [(r.lang_pred, r.score) for r in empty] == [("und", 0.0)] and identify_languages(docs(spark, [])).count() == 0
    model = LanguageModel.of([0, 3, 1], ["word", "<wo", "w"], ["a", "b", "a"], [5, 5, 5])
    assert model.rows("word") == [model.tables[0]["word"]] and model.rows("wolf") == [model.tables[3]["<wo"]] and model.rows("yw") == [model.tables[1]["w"]] and model.rows("q") == []


def test_language_scores_restated(spark):
    """Every prediction against word by word scores; names that clash with results."""
    data = spark.read.parquet(f"{DATA}/documents.parquet")
    model = LanguageModel.fit(data)
    odd = data.withColumn("lang_pred", F.lit(1)).withColumn("SCORE", F.lit("s")).withColumn("found", F.lit(2)).withColumn("found_", F.lit(3))
    got = identify_languages(odd, model=model)
    assert got.columns == [*odd.columns, "lang_pred_", "score_"] and {(r.lang_pred, r.SCORE, r.found, r.found_) for r in got.collect()} == {(1, "s", 2, 3)}
    seen = 0
    for r in got.collect():
        words = re.findall(r"[^\W\d_]+", (r.text or "").lower())
        if not words:
            assert (r.lang_pred_, r.score_) == ("und", 0.0)
            continue
        mean = sum((model.scores[k].mean(axis=0) if (k := model.rows(w)) else np.zeros(len(model.langs))) for w in words) / len(words)
        p = np.exp((mean - mean.max()) * min(12, len(words)))
        assert abs(p.max() / p.sum() - r.score_) < 1e-3 and (r.lang_pred_ == model.langs[int(mean.argmax())] or np.sort(mean)[-1] - np.sort(mean)[-2] < 1e-4)
        seen += 1
    assert seen > 150


def test_language_of_long_words(spark):
    """Words that differ only after many letters are told apart, and very long ones are counted whole."""
    lead = "x" * 90
    rows = [(k, f"{lead}{'abcabc' if k % 2 else 'pqrpqr'}", "en" if k % 2 else "fr", "s") for k in range(60)] + [(200 + k, "y" * 300_000, "zz", "s") for k in range(6)]
    new = [(100, lead + "abcab", None, None), (101, lead + "pqrpq", None, None), (102, "y" * 200_000, None, None)]
    got = {r.doc_id: r.lang_pred for r in identify_languages(docs(spark, [*rows, *new])).collect()}
    assert all(got[k] == ("en" if k % 2 else "fr") for k in range(60)) and [got[k] for k in (100, 101, 102, 200)] == ["en", "fr", "zz", "zz"]


def test_language_held_out(spark):
    found = queries.op5_language_id(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), "doc_id").where("held_out")
    assert found.where("lang = lang_pred").count() >= 0.98 * found.count()


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def fits(kind, s):
    d = re.sub("[^0-9]", "", s)
    if kind == "ip":
        return all(int(p) <= 255 for p in s.split("."))
    if kind == "card":
        return 14 <= len(d) <= 19 and sum(int(x) if i % 2 == 0 else sum(divmod(2 * int(x), 10)) for i, x in enumerate(d[::-1])) % 10 == 0
    return kind != "phone" or 10 <= len(d) <= 15


def test_base_spans():
    r = random.Random(2)
    for _ in range(20000):
        t = "".join(r.choice("a@b.1234 -+()x%é") for _ in range(r.randint(0, 50)))
        want = sorted([(k, m.start(), m.end()) for k in PATTERNS for m in re.finditer(PATTERNS[k], t) if fits(k, m[0])], key=lambda x: (x[1], pii.BASE.index(x[0])))
        assert pii.base_spans(t) == want
    long = "a" * 200000 + "1" * 200000 + "+1 " + "(" * 100000 + "@"
    assert pii.base_spans(long) == [] and pii.find_spans([long])[0][0] == []


def test_long_spans():
    token, name = "k3Y9" * 1500, "b" * 5000
    (_, spans), (_, mail) = pii.find_spans([f'token = "{token}" and', f"contact {name} [at] {'h' * 300} [dot] com now"])
    assert [(k, e - s) for k, s, e in spans] == [("secret", 6000)] and mail[0][0] == "email" and mail[0][2] - mail[0][1] > 5300
    for text in ("a" * 300_000 + " [at", "k9" * 200_000 + "!", "+1 " * 100_000, "12 " * 100_000, "AB12 " * 60_000):
        began = time.time()
        pii.find_spans([text])
        assert time.time() - began < 10


def test_personal_data(spark):
    key = "0123456789abcdef0123456789abcdef01234567"
    rows = [(1, f'😀 mail x.1@y.example.com token = "{key}" call (212) 555-0143.', None, None), (2, None, None, None), (3, "", None, None), (4, "a clean text of 2024, order 1234-5678", None, None), (None, "10.0.0.1", None, None)]
    got = {r.doc_id: r for r in pii.personal_data_digest(docs(spark, rows)).collect()}
    assert (got[1].n_email, got[None].n_ip, got[4].spans, got[2].spans) == (1, 1, "", "")
    assert got[1].base_sha256 == hashlib.sha256(b"email:7:24").hexdigest() and "secret:" in got[1].spans and "phone:" in got[1].spans
    out = {r.doc_id: r.text for r in pii.redact(docs(spark, rows)).collect()}
    assert out[1].startswith('😀 mail [EMAIL] token = "[SECRET]"') and out[2] is None and out[4] == rows[3][1]
    assert pii.personal_data_digest(docs(spark, [])).count() == 0
    again = pii.personal_data_digest(docs(spark, [rows[0], rows[0], (1, None, None, None)])).collect()
    assert len(again) == 3 and [a.n_email for a in again].count(1) == 2
    x, y = pii.training_spans(800, 123)
    assert ((pii.fitted()[0].probability(x) > 0.5) == (y > 0.5)).mean() > 0.97


def test_embeddings(spark):
    r = np.random.default_rng(4)
    base = r.normal(0, 1, (40, 16))
    x = np.concatenate([base, base[:10], base[:15] + r.normal(0, 0.05, (15, 16)), np.repeat(base[:1], 700, 0) + r.normal(0, 0.02, (700, 16))]).astype(np.float32)
    rows = [(k, v.tolist(), 0) for k, v in enumerate(x)]
    odd = [(9000, None, 1), (9001, [0.0] * 16, 1), (9002, [float("nan")] * 16, 1), (9003, [None] * 16, 1), (9004, [], 1), (None, x[0].tolist(), 1), (9005, [1e30] + [0.0] * 15, 1)]
    some = [[1.0, 2.0, 3.0, float(k)] for k in range(120)]
    odd += [(9100 + k, v, 1) for k, v in enumerate(some)] + [(9500, (other := r.normal(0, 1, 16)).tolist(), 1), (9501, other.tolist(), 1), (9600, [2.0, 3.0], 1), (9601, [2.0, 3.1], 1)]  # four dimensions side by side
    odd += [(9700, base[0].tolist(), 1), (9700, base[1].tolist(), 1)]  # one vec_id with two vectors
    got = near_duplicate_vectors(spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, n_links int").withColumn("rep", F.lit(1)).withColumn("digest", F.lit("x"))).collect()
    assert len(got) == len(rows) + len(odd)

    def brute(v):
        u = np.asarray(v, np.float32).astype(float)
        u /= np.linalg.norm(u, axis=1)[:, None]
        near = u @ u.T >= 0.95
        np.fill_diagonal(near, False)
        return near

    by = {g.vec_id: g for g in got}
    near = brute(x)
    links = [*zip(*np.nonzero(near), strict=True), (0, 1)]  # 9700 joins the classes of 0 and 1
    want = closure(len(x), links)
    found = np.array([by[k].n_links for k in range(len(x))]) - np.array([near[0, k] or k == 0 for k in range(len(x))]) - np.array([near[1, k] or k == 1 for k in range(len(x))])
    assert (found <= near.sum(1)).all() and found.sum() >= 0.9 * near.sum()
    assert np.mean([by[k].component_id == want[k] for k in range(len(x))]) > 0.98
    near = brute(some)
    found = np.array([by[9100 + k].n_links for k in range(120)])
    assert (found <= near.sum(1)).all() and found.sum() >= 0.9 * near.sum()
    assert all(by[k].n_links == 0 and by[k].component_id == k and by[k].kept for k in range(9000, 9006)) and by[None].component_id is None
    assert [(by[k].n_links, by[k].component_id) for k in (9500, 9501, 9600, 9601)] == [(1, 9500), (1, 9500), (1, 9600), (1, 9600)]
    assert near_duplicate_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert near_duplicate_vectors(spark.createDataFrame([(1, None)], "vec_id long, embedding array<double>")).collect()[0].n_links == 0


def test_embeddings_query_by_brute_force(spark):
    rows = {r.vec_id: r.embedding for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()}
    ids = sorted(rows)
    u = np.array([rows[k] for k in ids], float)
    u /= np.linalg.norm(u, axis=1)[:, None]
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    want = closure(len(ids), list(zip(*np.nonzero(near), strict=True)))
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in queries.op9_embedding_near_dedup(spark, DATA).collect()}
    assert got == {k: (int(near[n].sum()), ids[want[n]], want[n] == n) for n, k in enumerate(ids)}


def test_recall_at_the_threshold(spark):
    """The hardest links, at cosine 0.95 among vectors without any structure."""
    r = np.random.default_rng(1)
    g = r.normal(size=(3000, 64))
    g /= np.linalg.norm(g, axis=1)[:, None]
    w = r.normal(size=g.shape)
    w -= (w * g).sum(1)[:, None] * g
    w /= np.linalg.norm(w, axis=1)[:, None]
    x = np.concatenate([g, 0.951 * g + np.sqrt(1 - 0.951**2) * w])
    got = near_duplicate_vectors(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>"))
    assert got.where("n_links > 0").count() >= 0.9 * len(x)


def test_vectors_by_dimension():
    column = pa.array([[1.0, 2.0], None, [], [0.0, 0.0], [1.0, None], [3.0], [float("inf")], [5.0, 6.0]], pa.list_(pa.float32()))
    got = [(d, rows.tolist(), x.tolist()) for d, rows, x in by_dimension(column)]
    assert got == [(1, [5], [[3.0]]), (2, [0, 7], [[1.0, 2.0], [5.0, 6.0]])] and [(d, rows.tolist()) for d, rows, _ in by_dimension(column[5:])] == [(1, [0]), (2, [2])]


PAGES = [(1, "http://a/ b", "<p>é</p>"), (2, None, None), (3, "u", "<p>é</p>"), (4, "u", ""), (5, "v", "x" * 3_000_000), (6, "v", "WARC/1.1\r\nx\r\n\r\n\x1f\x8b\x08")]


@pytest.mark.parametrize("compress", [True, False])
def test_warc(spark, compress):
    pages = spark.createDataFrame([*PAGES, (None, "n", "z")], "page_id long, url string, html string").withColumn("payload", F.lit(1))
    manifest = warc.write_archives(pages, compress=compress, file_bytes=1000)
    got = {r.page_id: r for r in warc.read_archives(manifest).collect()}
    assert all(r.gap is None for r in got.values()) and len(got) == 7
    for k, _, html in PAGES:
        raw = (html or "").encode()
        assert (got[k].payload_bytes, got[k].payload_digest) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode())
        assert bytes(got[k].payload) == (raw if got[k].type == "response" else b"")
    assert (got[1].type, got[1].refers_to, got[3].type, got[2].refers_to, got[4].type) == ("revisit", 3, "response", 4, "response")
    assert {r.type for r in warc.read_archives(warc.write_archives(pages, least_bytes=100)).collect()} == {"response"}
    assert warc.read_archives(warc.write_archives(pages.limit(0))).count() == 0
    odd = pages.select("*", *[F.lit(1).alias(c) for c in ("sha", "first", "n", "hot", "type", "path")])
    assert warc.read_archives(warc.write_archives(odd, compress=compress)).where("gap is null").count() == 7


def test_warc_long_urls_and_hot_payloads(spark, monkeypatch):
    """A url that makes a header of 2 MB; a payload of many rows goes its own way to the same result."""
    monkeypatch.setattr(warc, "HOT_ROWS", 5)
    rows = [(k, "http://x/" + "y" * (2_000_000 if k == 3 else k), "same" if k % 2 else None if k == 4 else f"p{k // 4}") for k in range(24)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in warc.read_archives(warc.write_archives(pages)).collect()}
    assert len(got) == 24 and got[3].url == rows[3][1] and all(r.gap is None for r in got.values())
    last = {}
    for k, _, html in rows:
        last[html or ""] = k
    assert all((got[k].type, got[k].refers_to) == (("response", None) if last[h or ""] == k else ("revisit", last[h or ""])) for k, _, h in rows)


def test_salvage_is_linear():
    """Bytes that look like starts of members and records, without end: time in proportion, and what follows is found."""
    good = warc.record(1, "u", b"<p>x</p>", warc.digest(b"<p>x</p>"), None)
    for junk in (b"\x1f\x8b\x08\x08", b"\x1f\x8b\x08\x1f", b"WARC/1.", b"WARC/1.0\r\n", b"X: WARC/1.0\r\n", b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\x03"):
        began = time.time()
        got = warc.salvage_bytes(junk * (600_000 // len(junk)) + good)
        assert isinstance(got[-1], warc.Record) and got[-1].block == b"<p>x</p>" and time.time() - began < 12
    bomb = zlib.compress(b"WARC/1.1\r\nContent-Length: 5\r\n\r\nabcde\r\n\r\n" + b"\0" * 300_000_000, wbits=31)
    tracemalloc.start()
    assert [type(x) for x in warc.salvage_bytes(bomb + good)] == [warc.Gap, warc.Record]
    assert tracemalloc.get_traced_memory()[1] < 20_000_000
    tracemalloc.stop()


@pytest.mark.parametrize("compress", [True, False])
def test_salvage(compress):
    bodies = [f"<p>{k}</p>".encode() * (k + 1) for k in range(12)]
    parts = [warc.record(k, "u", b, warc.digest(b), None, compress) for k, b in enumerate(bodies)]
    whole = b"".join(parts)
    assert [x.headers["x-page-id"] for x in warc.salvage_bytes(whole)] == [str(k) for k in range(12)]
    r = random.Random(1)
    for _ in range(150):
        raw, bad = bytearray(whole), set()
        at = np.cumsum([0, *map(len, parts)])
        for _ in range(r.randint(1, 2)):
            p = r.randrange(len(raw))
            raw[p] ^= 1 + r.randrange(255)
            bad.add(int(np.searchsorted(at, p, "right")) - 1)
        got = warc.salvage_bytes(bytes(raw))
        ids = {int(x.headers["x-page-id"]) for x in got if isinstance(x, warc.Record) and x.headers.get("x-page-id", "").isdigit()}
        assert set(range(12)) - bad <= ids
        assert sum(x.length for x in got) == len(raw)
    cut = warc.salvage_bytes(b"junk" + whole[: len(whole) - 5])
    assert isinstance(cut[0], warc.Gap) and cut[0].length == 4 and isinstance(cut[-1], warc.Gap) and len(cut) == 13
    assert warc.salvage_bytes(b"") == []


def test_salvage_reads_no_wrong_length(monkeypatch):
    """A length that leads to no record end is told without reading up to it."""
    parts = [warc.record(k, "u", b"<p>%d</p>" % k, warc.digest(b"<p>%d</p>" % k), None, False) for k in range(3)]
    parts[0] = parts[0].replace(b"Content-Length: 8", b"Content-Length: 20000000")
    asked, upto = [], warc._Window.upto
    monkeypatch.setattr(warc._Window, "upto", lambda w, n: asked.append(n - w.at) or upto(w, n))
    got = warc.salvage_bytes(b"".join(parts) + b" " * 30_000_000)
    assert [x.headers["x-page-id"] for x in got if isinstance(x, warc.Record)] == ["1", "2"] and max(asked) < 10_000
    assert [(x.offset, x.length) for x in got if isinstance(x, warc.Gap)] == [(0, len(parts[0])), (sum(map(len, parts)), 30_000_000)]


def test_token_rollup(spark, corpus, tmp_path):
    rows = token_rows(docs(spark, corpus), {"bpe": vocabulary("byte_bpe_50k.tiktoken", "/opt/tokenizers")}).cache()
    roll = TokenRollup(spark, f"file://{tmp_path}/roll")
    assert roll.totals().count() == 0
    assert roll.commit("a", inserts(rows)) and not roll.commit("a", inserts(rows))
    total = lambda: {(r.source, r.lang, r.tokenizer): (r.docs, r.tokens) for r in roll.totals().collect()}
    want = Counter()
    for _, text, lang, source in corpus:
        want[source, lang] += count_words(text or "")
    got = total()
    assert {k[:2]: v[1] for k, v in got.items() if k[2] == "words"} == dict(want) and sum(v[0] for v in got.values()) == 2 * len(corpus)
    some = rows.where("doc_id < 40")
    roll.commit("b", deletes(some))
    roll.commit("c", revisions(rows.where("doc_id between 50 and 59"), rows.where("doc_id between 50 and 59").withColumn("tokens", F.col("tokens") + 1)))
    before = total()
    assert sum(v[0] for v in before.values()) == 2 * len(corpus) - some.count()
    assert roll.compact()
    assert total() == before and roll.batches() == ["a", "b", "c"] and not roll.commit("b", deletes(some))
    roll.commit("d", inserts(some))
    roll.commit("e", deletes(rows.where("doc_id between 50 and 59").withColumn("tokens", F.col("tokens") + 1)))
    roll.commit("f", inserts(rows.where("doc_id between 50 and 59")))
    assert total() == got
    with pytest.raises(ValueError):
        roll.commit("../x", inserts(rows))


ONE = "doc_id long, source string, lang string, tokenizer string, tokens long"


def test_rollup_loses_and_doubles_nothing(spark, tmp_path):
    """Crashes between the steps of a commit and a compact, commits during a compact, two compacts at once."""
    one = inserts(spark.createDataFrame([(1, "s", None, "words", 10)], ONE))
    roll = TokenRollup(spark, f"file://{tmp_path}/roll")
    sums = lambda: tuple(roll.totals().select("docs", "tokens").first() or (0, 0))
    publish = TokenRollup._publish

    class Crash(Exception):
        pass

    def dies(*_):
        raise Crash

    def meanwhile(action):
        """The next entry is made only after another driver has done something."""

        def act(self, version, entry):
            TokenRollup._publish = publish
            action(TokenRollup(spark, roll.path))
            return publish(self, version, entry)

        TokenRollup._publish = act

    try:
        TokenRollup._publish = dies
        with pytest.raises(Crash):
            roll.commit("a", one)
        TokenRollup._publish = publish
        assert sums() == (0, 0) and roll.commit("a", one) and sums() == (1, 10)
        meanwhile(lambda other: other.commit("b", one))
        assert not roll.commit("b", one) and sums() == (2, 20)
        meanwhile(lambda other: other.commit("c", one))
        assert roll.commit("d", one) and sums() == (4, 40)
        meanwhile(lambda other: other.commit("e", one))
        assert roll.compact() and sums() == (5, 50) and roll.batches() == list("abcde")
        meanwhile(lambda other: other.compact())
        assert not roll.compact() and sums() == (5, 50) and roll.batches() == list("abcde")
        TokenRollup._publish = dies
        with pytest.raises(Crash):
            roll.compact()
        TokenRollup._publish = publish
        remove, roll._fs = roll._fs, None
        roll._fs = remove
        assert sums() == (5, 50) and roll.compact() and sums() == (5, 50) and not roll.commit("c", one)
        roll._local = False  # the rename without overwriting that other file systems get
        assert roll.commit("f", one) and sums() == (6, 60) and not roll._publish(roll._state().version, {"add": {}})
    finally:
        TokenRollup._publish = publish


def test_token_counts_query(spark):
    """The words by DuckDB, the byte-level BPE by a plain count, after the whole history of changes."""
    import tiktoken

    from sampleloom.llm.token_counts import BPE_PATTERN

    got = {(r.source, r.lang, r.tokenizer): (r.docs, r.tokens) for r in queries.op1_token_counts(spark, DATA).collect()}
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{DATA}/documents.parquet')")
    assert {k: v for k, v in got.items() if k[2] == "words"} == {r[:3]: r[3:] for r in con.sql(WORDS_SQL).fetchall()}
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary("byte_bpe_50k.tiktoken", "/opt/tokenizers").splitlines())}
    bpe = tiktoken.Encoding("plain", pat_str=BPE_PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter()
    for r in spark.read.parquet(f"{DATA}/documents.parquet").collect():
        want[r.source, r.lang] += len(bpe.encode_ordinary(r.text or ""))
    assert {k[:2]: v[1] for k, v in got.items() if k[2] != "words"} == dict(want)
    empty = spark.createDataFrame([], ONE)
    assert replayed(TokenRollup(spark, f"file:///tmp/none-{time.time()}"), empty).count() == 0


def test_ordinal_model():
    r = np.random.default_rng(1)
    n, true = 4000, np.array([2.0, -1.0, 0.0])
    x = r.random((n, 3)) * 2
    eta = x @ true
    grade = (eta[:, None] + r.logistic(size=(n, 1)) > np.array([0.5, 2.0, 3.0])).sum(1)
    m = OrdinalModel.fit(["a", "b", "c"], np.arange(n + 1) * 3, np.tile(np.arange(3), n), x.ravel(), grade, penalty=0.01, rounds=800)
    assert np.abs(m.weights - true).max() < 0.25 and np.abs(m.thresholds - [0.5, 2, 3]).max() < 0.3
    assert (np.diff(m.thresholds) > 0).all()


def test_toxicity(spark):
    r = random.Random(9)
    rows, marks = [], {}
    for k in range(600):
        words = [r.choice(WORDS) for _ in range(r.randint(20, 40))]
        bad = k % 5 == 0
        marks[k] = r.randint(1, 8) if bad else 0
        for at in r.sample(range(20), marks[k]):
            words[at] = r.choice(["vile", "vilest", "nasty"])
        rows.append((k, " ".join(words), int(bad)))
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model, figures = fit_toxicity(table)
    assert figures["auc"] > 0.99 and figures["rank"] > 0.6 and len(model.thresholds) == 3 and (np.diff(model.thresholds) > 0).all()
    odd = [(900, None, None, None), (901, "", None, None), (None, "vile nasty", None, None), (902, "vile " * 100_000, None, None), (0, rows[0][1], None, None)]
    found = predict_severity(docs(spark, [(k, t, None, None) for k, t, _ in rows] + odd), model).collect()
    got = {p.doc_id: p for p in found}
    assert len(found) == 605 and sum(got[k].toxic == bool(y) for k, _, y in rows) >= 594 and not got[900].toxic and got[None].toxic and got[902].toxic
    toxic = [k for k in marks if marks[k]]
    assert np.corrcoef([got[k].severity for k in toxic], [marks[k] for k in toxic])[0, 1] > 0.5
    for k, text, _ in [*rows[:40], *[(o[0], o[1], 0) for o in odd]]:  # each probability, word by word
        counts = Counter(f for w in _tokens(text) for f in _marks(w) if f in model.words)
        eta = sum(model.weights[model.words[f]] * np.log1p(c) for f, c in counts.items())
        p = 1 / (1 + np.exp(-(eta - model.thresholds)))
        assert abs(got[k].severity - p.sum()) < 1e-6 and abs(got[k].p_toxic - p[0]) < 1e-6 and got[k].grade == (p >= 0.5).sum()
    none, _ = fit_toxicity(spark.createDataFrame([], "text string, toxic int"))
    assert predict_severity(docs(spark, [(1, "x", None, None)]), none).count() == 1 and predict_severity(docs(spark, []), none).count() == 0
    graded = fit_severity(spark.createDataFrame([(" ".join(["vile"] * g + ["mild"]), g) for g in (0, 1, 2) for _ in range(30)], "text string, grade int"))
    assert [p.grade for p in predict_severity(docs(spark, [(g, " ".join(["vile"] * g + ["mild"]), None, None) for g in (0, 1, 2)]), graded).orderBy("doc_id").collect()] == [0, 1, 2]


def test_toxicity_sample(spark):
    """A repeated id brings in its different texts once; labels that repeat count once, the largest."""
    rows = [(1, "same text", None, None)] * 500 + [(k, f"text {k}", None, None) for k in range(2, 50)] + [(None, "x", None, None)]
    labels = spark.createDataFrame([(1, 0), (1, 1), (None, 1), (2, None), *[(k, 0) for k in range(3, 50)]], "doc_id long, toxic int")
    got = labelled_sample(docs(spark, rows), labels).collect()
    assert len(got) == 48 and [r.toxic for r in got if r.text == "same text"] == [1]
    assert labelled_sample(docs(spark, rows), labels, fit_rows=20).count() < 48


def test_figures():
    score, good = np.array([0.1, 0.4, 0.4, 0.9]), np.array([False, False, True, True])
    assert _auc(score, good) == 0.875 and abs(_rank_correlation(np.array([1, 2, 3.0]), np.array([10, 20, 30.0])) - 1) < 1e-12 and np.isnan(_auc(score, good & False))


def test_chat(spark):
    a = [{"role": "user", "text": "hi"}, {"role": "assistant", "text": "yo <|end|>"}]
    b = [{"role": "user", "text": "hi"}, {"role": "assistant", "text": "no"}, {"role": None, "text": None}]
    n, prompt, x, mask, y, _, usable = chat.format_pair(a, b)
    assert (n, prompt, usable) == (1, "<|user|>\nhi<|end|>\n", True) and x[mask[0]["start"] : mask[0]["end"]] == "yo < |end|><|end|>" and y.endswith("<|unknown|>\n<|end|>\n")
    assert chat.format_pair(a, a)[0] == 2 and not chat.format_pair(a, a)[-1] and not chat.format_pair(None, b)[-1] and not chat.format_pair(a, a[:1])[-1]
    turns = [(1, 0, "user", "q"), (1, 1, "assistant", "r"), (1, 2, "user", "q2"), (1, 3, "assistant", "r2"), (1, 3, "assistant", "r2"), (2, 0, "user", None), (None, None, None, None)]
    t = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit("clash"))
    got = {r.pair_id: r for r in chat.preference_examples(chat.stale_reply_pairs(chat.conversations(t))).collect()}
    assert len(got) == 3 and not got[2].usable and got[1].n_common == 5 and not got[None].usable
    alone = t.limit(2).withColumn("conv_id", F.lit(None).cast("long"))
    assert [len(r.turns) for r in chat.conversations(alone.union(alone)).collect()] == [1] * 4
    long = chat.format_pair([{"role": "assistant", "text": "x" * 3_000_000}], [])
    assert long[3][0]["end"] - long[3][0]["start"] == 3_000_007
    assert chat.preference_examples(chat.stale_reply_pairs(chat.conversations(t.limit(0)))).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "conversations", "pages"):
        con.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    want = con.sql(queries.ORACLE_SQL[name]).df()
    got = queries.QUERIES[name](spark, DATA).toPandas()[list(want.columns)]
    plain = lambda v: None if v != v or v is None else v
    key = lambda d: sorted(str([plain(v) for v in row]) for row in d.astype(object).where(d.notna(), None).values.tolist())
    if "refers_to" in want:
        got["refers_to"], want["refers_to"] = got["refers_to"].astype("Int64"), want["refers_to"].astype("Int64")
    assert key(got) == key(want)


def test_pipeline_stages_on_odd_rows(spark):
    """Nulls, repeats, long texts, clashing names and empty tables in every stage."""
    import corpus_pipeline

    names = ("lang_pred", "score", "found", "n_", "d_", "h_", "hit_doc", "hit_text", "key", "n", "row", "size", "taken", "mix_doc", "a.b", "digest", "rep")
    text = "one two three four five six seven eight nine ten "
    base = [(k, t, "en", "a") for k, t in [(1, text)] * 5 + [(None, text)] * 2 + [(None, "other words entirely here now")] * 2 + [(None, None), (2, ""), (3, "x" * 300_000), (4, "abcd efg " * 30_000), (5, text + "q"), (6, None)]]
    docs_in = spark.createDataFrame([(*b, *range(len(names))) for b in base], "doc_id long, text string, lang string, source string, " + ", ".join(f"`{n}` int" for n in names))
    kept = {"language_id": 12, "near_dedup": 7, "decontaminate": 15, "personal_data": 15, "mix": 12}
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs_in, DATA)
        assert got.columns[: len(docs_in.columns)] == docs_in.columns
        rows = got.collect()
        assert len(rows) == kept[name], name
        assert all(tuple(r)[4 : 4 + len(names)] == tuple(range(len(names))) for r in rows)
        assert stage(spark, docs_in.limit(0), DATA).count() == 0
    ids = sorted(str(r.doc_id) for r in corpus_pipeline.near_dedup(spark, docs_in, DATA).collect())
    assert ids == ["1", "2", "3", "4", "6", "None", "None"]


def test_pipeline(spark):
    """Every stage against a plain restatement on whole texts: sets of shingles, windows, spans, and the mix in SQL."""
    import corpus_pipeline

    docs_in = spark.read.parquet(f"{DATA}/documents.parquet")
    out = corpus_pipeline.run(spark, DATA)
    got = {r.doc_id: r for r in out.collect()}
    rows = {r.doc_id: r for r in docs_in.collect() if any(c.isalpha() for c in r.text or "")}
    ids = sorted(rows)
    sets = [shingle_set(rows[d].text, 5) for d in ids]
    links = [(i, j) for j in range(len(ids)) for i in range(j) if sets[i] and 4 * max(len(sets[i]), len(sets[j])) <= 5 * min(len(sets[i]), len(sets[j])) and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    kept = [ids[k] for k, top in enumerate(closure(len(ids), links)) if k == top]
    tokens = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    runs = lambda t, n: {tuple(t[k : k + n]) for k in range(len(t) - n + 1)}
    windows = {}
    for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect():
        if t := tokens(r.text):
            windows.setdefault(min(10, len(t)), set()).update(runs(t, min(10, len(t))))
    clean = [d for d in kept if not any(runs(tokens(rows[d].text), n) & w for n, w in windows.items())]
    assert links and 0 < len(clean) < len(kept) < len(ids)
    texts = {d: pii.redacted(rows[d].text, pii.find_spans([rows[d].text])[0][1]) for d in clean}
    con = duckdb.connect()
    con.execute("create table left_ (doc_id bigint, source varchar, text varchar)")
    con.executemany("insert into left_ values (?, ?, ?)", [(d, rows[d].source, texts[d]) for d in clean])
    want = {d: taken for d, taken in con.sql(f"select doc_id, taken from ({MIX_SQL.format(docs='left_')}) where taken > 0").fetchall()}
    assert {d: r.taken for d, r in got.items()} == want and out.count() == len(got)
    for d, r in got.items():
        assert r.text == texts[d] and not pii.base_spans(r.text)
    assert out.columns == [*docs_in.columns, "size", "taken", "copies"] and json.dumps(corpus_pipeline.ORACLE_SQL) == "null"
