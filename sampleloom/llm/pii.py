"""Personal data by candidates and gradient boosting: generators propose spans, boosted trees judge them."""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, spread

#: Kinds of the base spans in the order of ties, then kinds that only the boosted trees add.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret", "ssn", "iban")
SPANS = "array<struct<kind:string,start:int,end:int>>"

# Fixed patterns of the base spans, with lookbehinds that only spare hopeless starts.
_EMAIL_TAIL = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
# Generators of further candidates: high recall, they may overlap each other and base spans. Runs are possessive and have no
# longest length; the counts that are there are those of the formats (fixed values): groups of an IBAN (34 characters at most) and of card
# numbers (19 digits at most).
_MORE = (
    ("email", re.compile(r"(?<![\w.+-])[\w.+-]++\s?[\[({]\s?(?:at|AT|@)\s?[\])}]\s?[\w-]++\s?(?:[\[({]\s?(?:dot|DOT|\.)\s?[\])}]|\.)\s?[A-Za-z]{2,}+"), re.compile(r"[\[({]\s?(?:at|AT|@)\s?[\])}]")),
    ("phone", re.compile(r"(?<![0-9.+-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])"), None),
    ("ssn", re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"), None),
    ("iban", re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"), None),
    ("card", re.compile(r"(?<![0-9])[0-9]{4}(?:[ ./-]?[0-9]{4}){2}[ ./-]?[0-9]{1,7}(?![0-9])"), None),
    ("secret", re.compile(r"(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{16,}+={0,2}(?![A-Za-z0-9_+/-])"), None),
)
_DIGIT = re.compile(r"[0-9]")
_CONTEXT = re.compile(r"(?i)token|secret|passw|api|key|auth|bearer|phone|tel\b|call|mobile|ssn|social|iban|account|card|visa|mail|contact")
_NOT = re.compile(r"(?i)order|isbn|version|invoice|sku|part|serial|build|commit|sha|page|http|www|/")


# What issuers begin their keys with.
_ISSUED = re.compile(r"(?:AKIA|ASIA|AIza|gh[opsu]_|github_pat_|glpat-|sk-|sk_live_|rk_live_|xox[abprs]-)[A-Za-z0-9]")


def iban(text: str) -> bool:
    """Whether the check digits of an account number hold: the country and they go to the end, letters count from 10, the rest modulo 97 is 1."""
    s = text.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum((0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(d)] for d in even)) % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The base spans, per kind leftmost and non-overlapping, by start, then kind. Time is linear in the text.

    An e-mail is found from its `@`: the name is the run of name characters before it, back to the last e-mail's end.
    """
    found, end = [], 0
    if "@" in text:
        for m in _EMAIL_TAIL.finditer(text):
            s = m.start()
            while s > end and _LOCAL.match(text, s - 1):
                s -= 1
            if s < m.start():
                found.append(("email", s, m.end()))
                end = m.end()
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            found.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        if 14 <= len(m[0]) <= 37 and 14 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
            found.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                found.append(("phone", m.start(), m.end()))
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def candidates(text: str) -> list[tuple[str, int, int]]:
    """Spans that the generators propose, by start, then kind. All but spelt-out addresses hold a digit."""
    found = []
    if not _DIGIT.search(text) and not _MORE[0][2].search(text):
        return found
    for kind, pattern, gate in _MORE:
        if gate and not gate.search(text):
            continue
        for m in pattern.finditer(text):
            if kind != "secret" or _DIGIT.search(m[0]):
                found.append((kind, m.start(), m.end()))
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


FEATURES = 18


def features(text: str, kind: str, start: int, end: int) -> list[float]:
    """Format and context of a candidate."""
    s, before, after = text[start:end], text[max(0, start - 32) : start], text[end : end + 8]
    digits = [c for c in s if c in "0123456789"]
    seen = Counter(s)
    entropy = -sum(k / len(s) * math.log2(k / len(s)) for k in seen.values())
    near = before.rstrip()[-1:] if before.strip() else ""
    return [
        float(KINDS.index(kind)), float(min(len(s), 100)), float(len(digits)), len(digits) / len(s), entropy, len(seen) / len(s),
        sum(c in "0123456789abcdef" for c in s) / len(s), sum(c.isupper() for c in s) / len(s), float(sum(c in " .-()/_" for c in s)),
        float(len(digits) >= 12 and luhn("".join(digits))), float(bool(_CONTEXT.search(before))), float(bool(_NOT.search(before))),
        float(near in "=:\"'" and near != ""), float(after[:1].isalnum()), float(sum(a.isdigit() != b.isdigit() for a, b in zip(s, s[1:], strict=False))), float(near in ".,;$€#"[:6] and near != ""), float(kind == "iban" and iban(s)), float(bool(_ISSUED.match(s))),
    ]


def training_spans(rows: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Labelled candidates made by rule: each kind in a context that names it, and look-alikes in others."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[rng.integers(len(xs))]
    digit = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    some = lambda chars, n: "".join(chars[i] for i in rng.integers(0, len(chars), n))
    low, hexes = "abcdefghijklmnopqrstuvwxyz", "0123456789abcdef"
    full = low + low.upper() + "0123456789"

    def card() -> str:
        body = digit(15)
        return next(body + str(k) for k in range(10) if luhn(body + str(k)))

    def word() -> str:
        return some(low, int(rng.integers(2, 9)))

    def account(country: str) -> str:
        body = digit(18)
        check = 98 - int("".join(str(int(c, 36)) for c in body + country + "00")) % 97
        s = f"{country}{check:02d}{body}"
        return " ".join(s[k : k + 4] for k in range(0, len(s), 4)) if rng.random() < 0.6 else s

    def key() -> str:
        return pick(["AKIA", "ASIA"]) + some(low.upper() + "0123456789", 16) if rng.random() < 0.5 else pick(["ghp_", "gho_", "xoxb-", "AIza", "glpat-", "sk-"]) + some(full, int(rng.integers(20, 40)))

    good = {
        "email": (lambda: f"{word()} [at] {word()} [dot] {pick(['com', 'org', 'net'])}", ["contact ", "mail me: ", "write to "]),
        "phone": (lambda: f"({digit(3)}) {digit(3)}-{digit(4)}" if rng.random() < 0.5 else f"{digit(3)}-{digit(3)}-{digit(4)}", ["phone ", "call ", "tel ", "mobile: ", "reach me at "]),
        "ssn": (lambda: f"{digit(3)}-{digit(2)}-{digit(4)}", ["ssn ", "social security: ", "my ssn is "]),
        "iban": (lambda: account(pick(["DE", "FR", "ES", "GB"])), ["iban ", "account: ", "pay to ", "", "see ", "number "]),
        "card": (lambda: (c := card())[:4] + "." + c[4:8] + "." + c[8:12] + "." + c[12:], ["card ", "visa: ", "charged to card "]),
        "secret": (lambda: some(hexes, int(pick([32, 40, 64]))) if rng.random() < 0.6 else some(full, int(rng.integers(20, 64))), ['token = "', "api_key=", "secret: ", "Bearer ", 'password: "', "key = "]),
        "key": (key, ["", "see ", "page ", "key = ", "commit ", "token: "]),
    }
    bad = {
        "email": (lambda: f"{word()} (at) {word()} . {word()}", ["f", "vector ", "look "]),
        "phone": (lambda: f"{digit(3)}.{digit(3)}.{digit(4)}", ["version ", "order ", "part ", "serial "]),
        "ssn": (lambda: f"{digit(3)}-{digit(2)}-{digit(4)}", ["isbn ", "part ", "order ", "sku ", "", "see ", "code ", "on "]),
        "iban": (lambda: f"{some(low.upper(), 2)}{digit(2)} {some(low.upper(), 4)} {some(low.upper(), 4)}" if rng.random() < 0.4 else next(x for x in iter(lambda: f"{pick(['DE', 'FR', 'XK'])}{digit(20)}", "") if not iban(x)), ["serial ", "build ", "plate ", "iban ", "account: ", ""]),
        "card": (lambda: digit(16), ["order ", "invoice ", "", "value ", "number "]),
        "secret": (lambda: pick([word() + word() + word() + digit(1), f"{word()}-{word()}-{word()}-{digit(2)}", f"{word()}/{word()}/{word()}{digit(1)}", "=" * 16 + digit(1), digit(20), f"{word()}_{word()}_{digit(4)}_{word()}"]).ljust(16, "a"), ["", "http ", "page ", "see ", "commit ", "www ", "sha "]),
        "key": (lambda: pick(["AKIB", "ghx-", "sk_", "xox"]) + "-".join(word() for _ in range(4)) + digit(1), ["", "see ", "page ", "commit "]),
    }
    x, y = [], []
    for _ in range(rows):
        true = bool(rng.random() < 0.5)
        kind = pick(list(good))
        make, contexts = (good if true else bad)[kind]
        kind = "secret" if kind == "key" else kind  # a key tells itself by how it begins
        lead = " ".join(word() for _ in range(int(rng.integers(0, 5)))) + " " + pick(contexts)
        s = make()
        x.append(features(lead + s + pick([" ", ".", '"', " " + word()]), kind, len(lead), len(lead) + len(s)))
        y.append(float(true))
    return np.array(x), np.array(y)


@dataclass
class BoostedTrees:
    """Logistic gradient boosting of depth-3 trees; a tree is (features, cuts, leaves) of 7 nodes and 8 leaves."""

    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]]
    bias: float
    scale: tuple[float, float] = (1.0, 0.0)

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.bias)
        rows = np.arange(len(x))
        for f, cut, leaf in self.trees:
            node = np.zeros(len(x), int)
            for _ in range(3):
                node = 2 * node + 1 + (x[rows, f[node]] > cut[node])
            out += leaf[node - 7]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        a, b = self.scale
        return 1 / (1 + np.exp(-np.clip(a * self.raw(x) + b, -30, 30)))

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, rounds: int = 40, rate: float = 0.2) -> BoostedTrees:
        """Exact second-order splits over 16 quantile cuts a feature."""
        cuts = [np.unique(np.quantile(x[:, k], np.linspace(0.03, 0.97, 16))) for k in range(x.shape[1])]
        model = cls([], float(np.log(y.mean() / (1 - y.mean()))))
        score = np.full(len(x), model.bias)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, p * (1 - p)
            f, c, leaf, node = np.zeros(7, int), np.full(7, np.inf), np.zeros(8), np.zeros(len(x), int)
            for k in range(7):
                at = np.flatnonzero(node == k)
                best = 1e-6
                for j in range(x.shape[1]):
                    for cut in cuts[j]:
                        right = x[at, j] > cut
                        gr, hr = g[at][right].sum(), h[at][right].sum()
                        gl, hl = g[at].sum() - gr, h[at].sum() - hr
                        gain = gr**2 / (hr + 1) + gl**2 / (hl + 1) - (gr + gl) ** 2 / (hr + hl + 1)
                        if gain > best:
                            best, f[k], c[k] = gain, j, cut
                node[at] = 2 * k + 1 + (x[at, f[k]] > c[k])
            for k in range(8):
                at = node == k + 7
                leaf[k] = rate * g[at].sum() / (h[at].sum() + 1)
            model.trees.append((f, c, leaf))
            score += leaf[node - 7]
        return model


@cache
def fitted(rows: int = 1600, precision: float = 0.99) -> tuple[BoostedTrees, dict[str, float]]:
    """The trees with a Platt-scaled output, and each kind's lowest threshold that keeps the precision on other made rows.

    Both sets are made by rule (training_spans): the precision is theirs, not that of a corpus.
    """
    model = BoostedTrees.fit(*training_spans(rows))
    x, y = training_spans(rows, seed=11)
    raw, a, b = model.raw(x), 1.0, 0.0
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(a * raw + b, -30, 30)))
        a, b = a + 0.5 * float(((y - p) * raw).mean()), b + 0.5 * float((y - p).mean())
    model.scale = (a, b)
    p, limit = model.probability(x), {}
    for k, kind in enumerate(KINDS):
        own = x[:, 0] == k
        good = [t for t in np.linspace(0.5, 0.99, 50) if not (own & (p >= t)).any() or y[own & (p >= t)].mean() >= precision]
        limit[kind] = float(good[0]) if good else 2.0
    return model, limit


def _holds(spans: list[tuple[str, int, int]], starts: list[int], c: tuple[str, int, int]) -> bool:
    """Whether a candidate holds every base span that it touches."""
    return all(c[1] <= s and e <= c[2] for _, s, e in spans[: bisect_left(starts, c[2])] if e > c[1])


def find_spans(texts: list[str | None], detector: tuple[BoostedTrees, dict[str, float]] | None = None) -> list[tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]]:
    """(base spans, all spans) of each text: added spans are judged likely and overlap no base span or better one. Only an account number
    whose check digits hold may go over base spans, if it holds them whole, as it does a card number that its digits happen to give.

    Of overlapping likely spans an account number with check digits that hold stays, else the likeliest; ties go to the kind that sorts first, then the earlier and shorter span.
    """
    model, limit = detector or fitted()
    base = [base_spans(t) if t else [] for t in texts]
    asked = [(k, c) for k, t in enumerate(texts) if t for c in candidates(t)]
    starts = [[s for _, s, _ in spans] for spans in base]
    ends = [list(accumulate((e for _, _, e in spans), max)) for spans in base]
    apart = lambda k, c: not (n := bisect_left(starts[k], c[2])) or ends[k][n - 1] <= c[1]
    asked = [(k, c) for k, c in asked if apart(k, c) or (c[0] == "iban" and iban(texts[k][c[1] : c[2]]) and _holds(base[k], starts[k], c))]
    added: dict[int, list[tuple[float, str, int, int]]] = {}
    if asked:
        p = model.probability(np.array([features(texts[k], *c) for k, c in asked]))
        for (k, c), q in zip(asked, p.tolist(), strict=True):
            if q >= limit[c[0]]:
                checked = c[0] == "iban" and iban(texts[k][c[1] : c[2]])
                added.setdefault(k, []).append((-q - checked, *c))
    out = []
    for k, spans in enumerate(base):
        every = list(spans)
        taken: list[tuple[int, int]] = []
        for _, kind, s, e in sorted(added.get(k, [])):
            n = bisect_left(taken, (s, e))
            if (not n or taken[n - 1][1] <= s) and (n == len(taken) or e <= taken[n][0]):
                taken.insert(n, (s, e))
                every.append((kind, s, e))
        out.append((spans, sorted(every, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))))
    return out


def _find(shared):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        form = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            for a in range(0, len(batch), 256):
                part = batch.slice(a, 256)
                found = find_spans(part.column(1).to_pylist(), shared.value)
                lists = [pa.array([[{"kind": k, "start": s, "end": e} for k, s, e in x[i]] for x in found], form) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([part.column(0), *lists], names=["doc_id", "base", "spans"])

    return run


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def personal_data(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, base, spans) for each row of docs: arrays of (kind, start, end), offsets in code points, end exclusive.

    base are the spans of the fixed patterns, which are always kept; spans has these and what the boosted trees add.
    A null or empty text has empty arrays. Spans are by start, then kind. Long texts and runs count whole; rows that
    repeat an id or a text each get their own row; a null doc_id stays null; other columns are ignored, whatever their
    names. An empty table gives no rows. The trees are fitted once, on the driver.
    """
    rows = bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return spread(rows).mapInArrow(_find(docs.sparkSession.sparkContext.broadcast(fitted())), f"doc_id long, base {SPANS}, spans {SPANS}")


def _digest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        base = [[(x["kind"], x["start"], x["end"]) for x in row] for row in batch.column(1).to_pylist()]
        every = [[(x["kind"], x["start"], x["end"]) for x in row] for row in batch.column(2).to_pylist()]
        counts = [pa.array([sum(k == kind for k, _, _ in row) for row in base], pa.int64()) for kind in BASE]
        sha = pa.array([hashlib.sha256(joined(row).encode()).hexdigest() for row in base], pa.string())
        yield pa.RecordBatch.from_arrays([batch.column(0), *counts, sha, pa.array([joined(r) for r in every], pa.string())], names=["doc_id", *[f"n_{k}" for k in BASE], "base_sha256", "spans"])


def personal_data_digest(docs: DataFrame) -> DataFrame:
    """Counts of the base kinds, the SHA-256 of the base spans and all spans as kind:start:end, comma-joined."""
    return personal_data(docs).mapInArrow(_digest, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redacted(text: str | None, spans: list[tuple[str, int, int]]) -> str | None:
    """The text with each span replaced by its kind in brackets; of overlapping spans the union is replaced once."""
    if not spans or text is None:
        return text
    out, at = [], 0
    for kind, s, e in spans:
        if s >= at:
            out += [text[at:s], f"[{kind.upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame) -> DataFrame:
    """docs, all columns kept, with the personal data of text replaced. Texts without any, nulls too, stay as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(fitted())

    @F.pandas_udf("string")
    def run(texts):
        import pandas as pd

        values = [None if t is None or t != t else t for t in texts]
        out = []
        for a in range(0, len(values), 256):
            part = values[a : a + 256]
            out += [redacted(t, x[1]) for t, x in zip(part, find_spans(part, shared.value), strict=True)]
        return pd.Series(out, dtype=object)

    return spread(bounded_batches(docs)).withColumn("text", run(F.col("text").cast("string")))
