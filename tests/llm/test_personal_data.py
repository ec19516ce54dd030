"""Personal data on candidates labelled by hand, account numbers over base spans, keys that tell themselves."""

from pathlib import Path

import numpy as np

from sampleloom.llm import pii, warc

LABELS = [line.split("\t") for line in Path(__file__).with_name("pii_labels.tsv").read_text().splitlines()]


def test_hand_labelled_candidates():
    """Precision and recall of what is added to the base spans, per kind and over all."""
    hits = {k: [0, 0, 0] for k in pii.KINDS}
    for label, kind, text in LABELS:
        found = any(k == kind for k, _, _ in pii.find_spans([text])[0][1])
        hits[kind][0 if found and label == "1" else 1 if found else 2 if label == "1" else 0] += 1 if found or label == "1" else 0
    right, wrong, missed = np.sum(list(hits.values()), axis=0)
    assert right / (right + wrong) >= 0.95 and right / (right + missed) >= 0.9, hits


def test_an_account_number_goes_over_the_card_in_it():
    text = "iban DE89 3704 0044 0532 0130 00 and on"
    base, every = pii.find_spans([text])[0]
    assert [k for k, _, _ in base] in ([], ["card"]) and ("iban", 5, 32) in every and set(base) <= set(every)
    assert pii.redacted(text, every) == "iban [IBAN] and on"
    wrong = "iban DE88 3704 0044 0532 0130 00 and on"  # check digits that don't hold go over nothing
    base, every = pii.find_spans([wrong])[0]
    assert not any(k == "iban" and b[1] < e and s < b[2] for k, s, e in every for b in base)
    assert pii.iban("GB82 WEST 1234 5698 7654 32") and not pii.iban("GB83 WEST 1234 5698 7654 32") and not pii.iban("GB82")


def test_thresholds_come_from_rows_that_were_not_fitted():
    model, limit = pii.fitted()
    x, y = pii.training_spans(1600, seed=99)
    p = model.probability(x)
    for k, kind in enumerate(pii.KINDS):
        chosen = (x[:, 0] == k) & (p >= limit[kind])
        assert not chosen.any() or y[chosen].mean() >= 0.95


def test_hot_payloads_beyond_the_broadcast(spark, monkeypatch):
    rows = [(k, f"u{k}", f"p{k % 7}" if k % 3 else "hot") for k in range(200)] + [(None, "u", "hot"), (5, "again", "hot"), (900, None, None), (901, None, "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("salt", warc.F.lit(1))
    read = lambda: sorted((r.page_id, r.type, r.refers_to, r.payload_digest) for r in warc.read_archives(warc.write_archives(pages), payloads=False).where("page_id is not null").collect())
    plain = read()
    monkeypatch.setattr(warc, "HOT_ROWS", 5)
    assert read() == plain
    monkeypatch.setattr(warc, "MOST_HOT", 0)
    assert read() == plain
