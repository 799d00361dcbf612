import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from docweir.llm import quality as q

PLAIN = "the river and the hill of a green land to walk in with friends by night".split()


def good(rng):
    return " ".join(" ".join(rng.choices(PLAIN, k=12)).capitalize() + "." for _ in range(6))


def junk(rng):
    words = rng.choices(PLAIN, k=50)
    return rng.choice(
        [
            " ".join(w.upper() + "!!" for w in words),
            " ".join(w + rng.choice(["%%%", "$$$", "&&&"]) for w in words),
            " ".join(w for w in words[:8] for _ in range(12)),
            " | ".join(words),
        ]
    )


def test_em_finds_good_and_bad(spark):
    rng = random.Random(3)
    rows = [(k, good(rng) if k % 5 else junk(rng), "clash") for k in range(400)]
    docs = spark.createDataFrame([*rows, (900, "", ""), (901, None, ""), (902, "word " * 30_000, "")], "doc_id long, text string, keep string")
    found = {r.doc_id: r for r in q.classify(docs).collect()}
    assert len(found) == 403
    assert sum(found[k].keep == bool(k % 5) for k, *_ in rows) >= 380
    voted = {r.doc_id: r.votes for r in q.label_votes(docs).collect()}
    posterior, *_ = q.estimate(Counter(voted.values()))
    assert sum((posterior[voted[k]] >= 0.5) == bool(k % 5) for k, *_ in rows) >= 380
    assert not found[900].keep and not found[901].keep and not found[902].keep


def test_accuracies_are_recovered():
    rng = random.Random(1)
    true = [0.95, 0.9, 0.8, 0.7, 0.6]
    rows = Counter()
    for _ in range(20_000):
        y = rng.random() < 0.7
        rows["".join("-" if rng.random() < 0.2 else str(int(y if rng.random() < a else not y)) for a in true)] += 1
    _, found, share = q.estimate(rows)
    assert all(abs(a - b) < 0.05 for a, b in zip(found, true, strict=True)) and abs(share - 0.7) < 0.05


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert q.classify(docs).count() == 0
    assert q.estimate({})[2] == 0.5


def brute_force(rows):
    """Scores of [(doc_id, text)] with plain loops: votes, EM, gradients and scores, by the definitions of each."""
    held = [q.votes(t) for _, t in rows]
    n, m = len(rows), len(q.LABELLERS)
    share, accuracy, post = 0.8, [0.9] * m, [0.8] * n
    for _ in range(100):
        for k, v in enumerate(held):
            z = math.log(share / (1 - share)) + sum(math.log(a / (1 - a)) * {"1": 1, "0": -1, "-": 0}[c] for a, c in zip(accuracy, v, strict=True))
            post[k] = 1 / (1 + math.exp(-max(-50, min(50, z))))
        for j in range(m):
            right = sum({"1": p, "0": 1 - p, "-": 0}[v[j]] for v, p in zip(held, post, strict=True))
            accuracy[j] = max(0.55, min(0.995, (right + 9) / (sum(v[j] != "-" for v in held) + 10)))
        share = max(0.5, min(0.95, sum(post) / n))

    def used(text):
        words, out = (text or "").split(), []
        for k, w in enumerate(words):
            shape = re.sub(r"(.)\1+", r"\1", "".join("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in w))
            out += [zlib.crc32(b"w" + w.lower().encode()) % 2**18, zlib.crc32(b"s" + shape.encode()) % 2**18] + [zlib.crc32(b"again") % 2**18] * (k > 0 and words[k - 1] == w)
        return out, max(1, len(words))

    own = {r: (*used(r[1]), p) for r, p in zip(rows, post, strict=True)}  # each (doc_id, text) once
    mean = sum(p for *_, p in own.values()) / len(own)
    weights, bias, scale = defaultdict(float), math.log((mean + 1e-3) / (1 - mean + 1e-3)), defaultdict(float)
    for places, words, _ in own.values():
        for p in places:
            scale[p] += 1 / words**2
    for _ in range(60):
        error = {r: p - 1 / (1 + math.exp(-max(-50, min(50, bias + sum(weights[x] for x in places) / words)))) for r, (places, words, p) in own.items()}
        step = defaultdict(float)
        for r, (places, words, _) in own.items():
            for p in places:
                step[p] += error[r] / words
        for p, g in step.items():
            weights[p] += 40.0 * g / (scale[p] ** 0.5 + 1e-3) / len(own) ** 0.5 - 1e-5 * weights[p]
        bias += sum(error.values()) / len(own)
    return [1 / (1 + math.exp(-max(-50, min(50, bias + sum(weights[x] for x in used(t)[0]) / used(t)[1])))) if (t or "").split() else 0.0 for _, t in rows]


def test_scores_by_brute_force(spark):
    rng = random.Random(5)
    rows = [(k, good(rng) if k % 3 else junk(rng)) for k in range(60)]
    rows += [(7, junk(rng)), (7, rows[7][1]), (8, ""), (9, "two two words words words")] + [rows[3]] * 30
    docs = spark.createDataFrame([(*r, "own", "own") for r in rows], "doc_id long, text string, votes string, digest string")
    got = sorted((r.doc_id, r.score) for r in q.classify(docs).collect())
    want = sorted((k, s) for (k, _), s in zip(rows, brute_force(rows), strict=True))
    assert [k for k, _ in got] == [k for k, _ in want] and [s for _, s in got] == pytest.approx([s for _, s in want], abs=1e-9)


def test_the_sample_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(q, "TRAIN_FEATURES", 400)
    taken = []
    monkeypatch.setattr(q, "train", lambda *a, f=q.train: taken.append(a) or f(*a))
    docs = spark.createDataFrame([(k, " ".join(f"w{k}x{j}" for j in range(40))) for k in range(50)] + [(99, None)] * 9, "doc_id long, text string")
    assert q.classify(docs).count() == 59
    y, sizes, place, count, words = taken[0]
    assert 200 < len(place) == len(count) == sizes.sum() <= 400 and len(y) == len(sizes) == len(words) < 12
