import hashlib
import random

import numpy as np
import pytest

from docweir.llm import decontaminate as d

DOCS = "doc_id long, text string, n_hit string"


def test_wavelet_ranks_and_locate():
    rng = np.random.default_rng(1)
    sequence = rng.integers(0, 11, 300)
    tree = d.WaveletTree(sequence, 4)
    for c in range(11):
        places = np.arange(301)
        want = np.concatenate([[0], np.cumsum(sequence == c)])
        assert (tree.rank(np.full(301, c), places) == want).all()
    runs = [rng.integers(1, 4, rng.integers(1, 60)) for _ in range(20)]
    text = np.concatenate([np.append(r, 0) for r in runs])
    index = d.FMIndex(text, 3)
    for m in (1, 2, 5):
        windows = rng.integers(1, 4, (20, m))
        low, high = index.search(windows)
        for w, a, b in zip(windows, low, high, strict=True):
            want = [i for i in range(len(text) - m + 1) if (text[i : i + m] == w).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want


@pytest.mark.parametrize("block", [1, 10_000_000])
def test_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(d, "BLOCK_BYTES", block)
    rng = random.Random(3)
    words = [f"w{k}" for k in range(12)] + ["Été", "ÉTÉ", "x1"]
    make = lambda n: "".join(rng.choice(words) + rng.choice([" ", ", ", "\n", "-"]) for _ in range(n))
    items = [(k, make(n)) for k, n in enumerate([1, 2, 12, 13, 14, 40, 30])] + [(8, ""), (9, None), (10, "...")]
    texts = [make(n) for n in (0, 1, 5, 13, 200, 2000)] + [None, "", "!!"]
    texts += [f"a b {items[5][1].upper()} c", items[3][1], items[3][1], make(30) + items[6][1]]
    docs = spark.createDataFrame([(k, t, "clash") for k, t in enumerate(texts)] + [(3, texts[3], None), (None, "w1", None)], DOCS)
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = d.judged(d.find_contamination(docs.drop("n_hit"), bench)).collect()
    assert len(found) == len(texts) + 2
    held = [(str(i), t) for i, t in items if t]
    for r in found:
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == d.brute_force(r.text, held)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "some words")], "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id long, text string")
    row = d.judged(d.find_contamination(docs, bench)).first()
    assert (row.n_words, row.n_hit, row.items_sha256, row.contaminated) == (2, 0, hashlib.sha256(b"").hexdigest(), False)
    assert d.find_contamination(docs.limit(0), docs.select(docs.doc_id.alias("item_id"), "text")).count() == 0
