import numpy as np
import pytest

from docweir.llm import neighbours as n


def brute(rows, every, k):
    held = [(i, np.array(v, np.float32).astype(float)) for i, v in rows]
    out = {}
    for i, v in held:
        if i % every == 0:
            scored = sorted((-float((v * w).sum() / (np.sqrt((v * v).sum()) * np.sqrt((w * w).sum()))), j) for j, w in held if j != i)
            out[i] = [(j, -s) for s, j in scored[:k]]
    return out


@pytest.mark.parametrize("chunk", [60, 20_000])
def test_recall_and_ties(spark, monkeypatch, chunk):
    monkeypatch.setattr(n, "CHUNK", chunk)
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(15, 16))
    x = (centres[rng.integers(0, 15, 1500)] + 0.6 * rng.normal(size=(1500, 16))).astype(np.float32)
    x[200:900] = x[200]  # one vector has almost half of the rows
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    bad = [(5000, None), (5050, [0.0] * 16), (5100, [float("nan")] * 16), (5150, [1.0, None] * 8), (5200, [1.0] * 3), (5250, [])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows + bad], "vec_id long, embedding array<float>, rank int")
    got = {}
    for r in n.nearest(df).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    want = brute(rows, n.QUERY_EVERY, n.NEAREST)
    assert got.keys() == want.keys()
    hits = 0
    for q, found in got.items():
        found.sort()
        assert [f[0] for f in found] == [1, 2, 3, 4, 5]
        hits += len({f[1] for f in found} & {w[0] for w in want[q]})
        exact = {j: s for j, s in want[q]}
        assert all(abs(s - exact[j]) < 1e-12 for _, j, s in found if j in exact)
    assert hits >= 0.93 * 5 * len(want)
    assert [f[1] for f in got[200]] == [201, 202, 203, 204, 205]


def test_small_tables(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [0.0, 2.0])], "vec_id long, embedding array<float>")
    assert [(r["rank"], r.vec_id) for r in n.nearest(df).orderBy("rank").collect()] == [(1, 1), (2, 2)]
    assert n.nearest(df.limit(1)).count() == 0
    assert n.nearest(df.limit(0)).count() == 0


def test_doubles_stay_doubles(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(120, 8))
    x[7] = x[3] + 1e-12 * rng.normal(size=8)  # equal as floats
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in n.nearest(df, every=1).collect()}
    assert got[3, 1][0] == 7 and got[7, 1][0] == 3
    for (q, _), (j, score) in got.items():
        assert score == n.exact_cosine(x[q : q + 1], x[j : j + 1])[0]


@pytest.mark.parametrize("sub", [False, True])
def test_clustered_data_is_read_in_part(spark, monkeypatch, sub):
    """Leaves grow with the rows, and a query reads few of them where vectors have clusters."""
    monkeypatch.setattr(n, "SAMPLE_ROWS", 600 if sub else 20_000)
    monkeypatch.setattr(n, "LEAF_ROWS", 200 if sub else 4_000)
    monkeypatch.setattr(n, "QUERIES", 7)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(60, 24))
    x = (centres[rng.integers(0, 60, 6000)] + 0.35 * rng.normal(size=(6000, 24))).astype(np.float32)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>")
    want = brute([(k, v) for k, v in enumerate(x)], 50, 5)
    got = {}
    for r in n.nearest(df).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert sum(len(got[q] & {j for j, _ in w}) for q, w in want.items()) >= 0.95 * 5 * len(want)
    index = n.build_index(df)
    assert sum(index.counts.values()) == 6000 and index.tree.leaves == len(index.tree.twigs)
    if sub:
        assert index.tree.leaves > 60  # fifteen or so before
    read = [sum(index.counts[leaf] for leaf in index.leaves_of(n.unit(x[q : q + 1].astype(float))[0], 5)) for q in want]
    assert np.mean(read) < 0.2 * 6000
    assert {*map(int, index.tree.assign(n.unit(x.astype(float))))} == {*index.counts}


def by_ids(rows, every, k):
    """Brute force where an id is one candidate and one query, by its nearest vectors."""
    held = [(i, np.array(v, np.float32).astype(float)) for i, v in rows]
    out = {}
    for i in {i for i, _ in held if i % every == 0}:
        best = {}
        for j, w in held:
            if j != i:
                score = max(float((v * w).sum() / (np.sqrt((v * v).sum()) * np.sqrt((w * w).sum()))) for q, v in held if q == i)
                best[j] = max(best.get(j, -2.0), score)
        out[i] = [j for _, j in sorted((-s, j) for j, s in best.items())[:k]]
    return out


def test_repeated_rows_and_ids(spark):
    """Five ids for each query wherever there are five: with copies of rows, ids with other vectors, and queries that repeat."""
    rng = np.random.default_rng(8)
    same = rng.normal(size=6).astype(np.float32).tolist()
    rows = [(1, same)] * 7 + [(2, same)] * 7 + [(k, rng.normal(size=6).astype(np.float32).tolist()) for k in range(40, 101)]
    rows += [(3, rng.normal(size=6).astype(np.float32).tolist()) for _ in range(9)] + [(3, same)] + [(50, same)] + [(50, rows[20][1])] * 3
    df = spark.createDataFrame([(i, v, 0.5, "q") for i, v in rows], "vec_id long, embedding array<float>, score double, query_id string").repartition(5)
    got = {}
    for r in n.nearest(df).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    want = by_ids(rows, n.QUERY_EVERY, n.NEAREST)
    assert {q: [i for _, i in sorted(found)] for q, found in got.items()} == want


def test_one_id_with_most_rows(spark):
    """A query whose leaves hold one id over and over still gets its five."""
    rng = np.random.default_rng(9)
    near = [(7, (np.array([1.0, 0, 0, 0]) + 0.001 * rng.normal(size=4)).astype(np.float32).tolist()) for _ in range(2500)]
    rows = [(0, [1.0, 0.0, 0.0, 0.0])] + near + [(100 + k, rng.normal(size=4).astype(np.float32).tolist()) for k in range(30)]
    found = n.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).filter("query_id = 0").orderBy("rank").collect()
    assert len({r.vec_id for r in found}) == len(found) == 5 and found[0].vec_id == 7
