import random

import pytest

import corpus_pipeline
from docweir.llm import simhash as s
from docweir.llm.components import connected_components


def texts():
    rng = random.Random(5)
    words = [f"word{k}" for k in range(400)]
    out = [" ".join(rng.choices(words, k=n)) for n in (0, 1, 2, 3, 4, 50, 200, 400)]
    out += [None, "  ", "One two", "one TWO", "é É", "É é"]
    base = rng.choices(words, k=600)
    for _ in range(40):  # a chain and a cloud of near copies
        k = rng.randrange(600)
        base = [*base[:k], rng.choice(words), *base[k + 1 :]]
        out.append(" ".join(base))
    return dict(enumerate(out + out[:12]))


@pytest.mark.parametrize("limit", [2, 7, 10_000])
def test_against_brute_force(spark, limit, monkeypatch):
    monkeypatch.setattr(s, "near_links", lambda prints, f=s.near_links: f(prints, limit))
    want = s.brute_force(texts())
    docs = spark.createDataFrame([(k, t, 1, 2) for k, t in texts().items()], "doc_id long, text string, fp int, component_id int")
    got = {r.doc_id: (f"{r.fp & (1 << 64) - 1:016x}", r.component_id) for r in s.near_duplicates(docs).collect()}
    assert got == want


def test_clouds_of_fingerprints(spark):
    rng = random.Random(9)
    prints = set()
    for _ in range(30):
        centre = rng.getrandbits(64)
        for _ in range(30):
            value = centre
            for b in rng.sample(range(64), rng.randrange(6)):
                value ^= 1 << b
            prints.add(value - (1 << 64) if value >> 63 else value)
    prints = sorted(prints)
    parent = {p: p for p in prints}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(prints):
        for b in prints[:i]:
            if ((a ^ b) & (1 << 64) - 1).bit_count() <= 3:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    df = spark.createDataFrame([(p,) for p in prints], "fp long")
    for limit in (6, s.TREE_LIMIT):
        got = {r.node: r.root for r in connected_components(s.near_links(df, limit)).collect()}
        assert {p: got.get(p, p) for p in prints} == {p: root(p) for p in prints}


def test_long_path_and_no_links(spark):
    path = spark.createDataFrame([(k, k + 1) for k in range(200)] + [(5, 5), (900, 901), (901, 900)], "a long, b long")
    got = {r.node: r.root for r in connected_components(path).collect()}
    assert got == {k: 0 for k in range(201)} | {900: 900, 901: 900}
    assert connected_components(path.limit(0)).count() == 0


def test_empty_table_and_null_ids(spark):
    docs = spark.createDataFrame([(None, "a b c d"), (4, "a b c d"), (None, "x y z w")], "doc_id long, text string")
    rows = [(r.doc_id, r.component_id) for r in s.near_duplicates(docs).collect()]
    assert sorted(rows, key=str) == [(4, 4), (None, 4), (None, None)]
    assert s.near_duplicates(docs.limit(0)).count() == 0


def test_near_copies_at_similarity(spark):
    rng = random.Random(4)
    words = [f"word{k}" for k in range(3000)]
    rows, n = [], 300
    for _ in range(30):  # far apart in bits, near and not quite near in shingles; a chain among them
        base = rng.choices(words, k=n)
        rows.append(base)
        for changed in (1, 3, 5, 6, 8, 20):
            copy = list(base)
            for k in range(changed):
                copy[(k + 1) * n // (changed + 1)] = rng.choice(words)
            rows.append(copy)
    rows += [rows[1][::-1], [], ["a", "b"], ["A", "B"]]
    texts = {k: " ".join(r) for k, r in enumerate(rows)} | {len(rows): None}
    sets = {k: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := (t or "").lower().split()) else set() for k, t in texts.items()}
    prints = {k: s.fingerprint(t and t.encode()) for k, t in texts.items()}
    pairs = [(a, b) for a in texts for b in texts if a < b]
    bits = {p for p in pairs if (prints[p[0]] ^ prints[p[1]]).bit_count() <= 3 or prints[p[0]] == prints[p[1]]}
    shared = {p for p in pairs if len(sets[p[0]] & sets[p[1]]) >= 0.8 * len(sets[p[0]] | sets[p[1]])}
    assert len(shared - bits) > 30
    least = {k: k for k in texts}
    for _ in texts:
        for a, b in bits | shared:
            least[a] = least[b] = min(least[a], least[b])
    docs = spark.createDataFrame([*texts.items()], "doc_id long, text string")
    assert {r.row.doc_id: r.component_id.doc_id for r in s.near_copies(docs).collect()} == least
    kept = corpus_pipeline.near_dedup(spark, docs, "").collect()
    assert {r.doc_id for r in kept} == {*least.values()}


@pytest.mark.parametrize(("small", "part"), [(48, 1_000), (4, 30)])
def test_a_cloud_of_near_copies(spark, monkeypatch, small, part):
    """Copies of one text that are near to some of the others only: few pairs, and no link lost, in one block or in several."""
    monkeypatch.setattr(s, "SMALL_BAND", small)
    monkeypatch.setattr(s, "PART", part)
    rng = random.Random(11)
    words = [f"word{k}" for k in range(900)]
    base = rng.choices(words, k=150)
    texts = []
    for _ in range(160):
        copy = list(base)
        for k in rng.sample(range(150), rng.randrange(1, 5)):
            copy[k] = rng.choice(words)
        texts.append(" ".join(copy))
    sets = [{tuple(t.split()[i : i + 5]) for i in range(146)} for t in texts]
    prints = [s.fingerprint(t.encode()) & (1 << 64) - 1 for t in texts]
    linked = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) or (prints[a] ^ prints[b]).bit_count() <= 3
    edges = [(a, b) for a in range(len(texts)) for b in range(a) if linked(a, b)]
    least = [*range(len(texts))]
    for _ in texts:
        for a, b in edges:
            least[a] = least[b] = min(least[a], least[b])
    pairs = []
    monkeypatch.setattr(s, "_alike", lambda p, *a, f=s._alike: pairs.append(p.count()) or f(p, *a))
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    got = {r.row.doc_id: r.component_id.doc_id for r in s.near_copies(docs).collect()}
    assert got == dict(enumerate(least)) and len(edges) > 1000
    assert sum(pairs) < 160 * 30  # twenty heads, and others of small bands
