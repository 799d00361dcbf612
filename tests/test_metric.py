"""The metric index held against all pairs."""

import numpy as np
import pytest

from docweir.operators import graph, metric


def frame(spark, rows, kind="long"):
    return spark.createDataFrame(rows, f"id {kind}, embedding array<float>").repartition(3)


def clustered(n, centres, size=16, seed=1, spread=0.05):
    dice = np.random.default_rng(seed)
    heart = dice.normal(size=(centres, size))
    return [(i, (heart[i % centres] + spread * dice.normal(size=size)).astype(np.float32).tolist()) for i in range(n)]


def all_pairs(rows, asked, k, exclude_self=False):
    out = []
    x = metric.units(np.array([v for _, v in rows], np.float64))
    for q, v in asked:
        far = np.round(1 - metric.units(np.array([v], np.float64)) @ x.T, 6)[0] + 0.0
        near = sorted((d, i) for d, (i, _) in zip(far.tolist(), rows, strict=True) if not (exclude_self and i == q))
        out += [(q, i, d, n + 1) for n, (d, i) in enumerate(near[:k])]
    return sorted(out)


def found(df):
    return sorted((r.query_id, r.id, r.distance, r.rank) for r in df.collect())


def asked(spark, rows):
    kind = "string" if isinstance(rows[0][0], str) else "long"
    return spark.createDataFrame(rows, f"query_id {kind}, embedding array<float>")


def test_all_rows_ask_and_clusters_are_pruned(spark):
    rows = clustered(2400, 40)
    compared = spark.sparkContext.accumulator(0)
    got = metric.nearest(frame(spark, rows), asked(spark, rows), 5, exclude_self=True, compared=compared)
    assert found(got) == all_pairs(rows, rows, 5, True)
    assert compared.value < 0.2 * 2 * len(rows) ** 2  # the result is computed twice here: once to be collected, once written on its way


@pytest.mark.parametrize("seed", [3, 4])
def test_random_vectors_ties_zeros_and_copies(spark, seed):
    dice = np.random.default_rng(seed)
    rows = [(i, dice.integers(-1, 2, size=3).astype(np.float32).tolist()) for i in range(120)]  # few directions: many ties, some zeros
    got = metric.nearest(frame(spark, rows), asked(spark, rows[::7]), 9)
    assert found(got) == all_pairs(rows, rows[::7], 9)


def test_strings_fewer_rows_than_k_and_nothing(spark):
    rows = [(f"v{i}", [float(i + 1), 1.0]) for i in range(4)]
    got = metric.nearest(frame(spark, rows, "string"), asked(spark, rows[:2]), 10)
    assert found(got) == all_pairs(rows, rows[:2], 10)
    assert found(metric.nearest(frame(spark, [], "string"), asked(spark, rows[:2]), 3)) == []
    assert found(metric.nearest(frame(spark, [("z", [0.0, 0.0]), ("n", None)], "string"), asked(spark, rows[:1]), 3)) == [("v0", "z", 1.0, 1)]


def test_parts_and_lots(spark, monkeypatch):
    rows = clustered(300, 3, seed=9) + [(1000 + i, [1.0] * 16) for i in range(60)]
    monkeypatch.setattr(metric, "PART", 20)
    monkeypatch.setattr(metric, "VISITORS", 15)
    got = metric.nearest(frame(spark, rows), asked(spark, rows[::3]), 6, exclude_self=True)
    assert found(got) == all_pairs(rows, rows[::3], 6, True)


def classes(rows, limit):
    x = metric.units(np.array([v for _, v in rows], np.float64))
    near = (np.round(1 - x @ x.T, 6) <= limit) & x.any(axis=1)[:, None] & x.any(axis=1)
    np.fill_diagonal(near, False)
    root = list(range(len(rows)))
    ids = [i for i, _ in rows]
    changed = True
    best = list(ids)
    while changed:
        changed = False
        for a in range(len(rows)):
            low = min([best[a], *(best[b] for b in np.flatnonzero(near[a]))])
            if low != best[a]:
                best[a], changed = low, True
    return sorted((ids[a], best[a], int(near[a].sum())) for a in range(len(root)))


def test_join_within_a_distance(spark, monkeypatch):
    dice = np.random.default_rng(2)
    chain = [(500 + i, [float(np.cos(i / 5)), float(np.sin(i / 5)), 0.0, 0.0]) for i in range(12)]  # neighbours of neighbours
    rows = clustered(150, 12, 4, spread=0.15) + chain + [(700 + i, [2.0, 1.0, 0.0, 0.5]) for i in range(30)] + [(800, [0.0] * 4), (801, [0.0] * 4)]
    rows += [(900 + i, dice.normal(size=4).astype(np.float32).tolist()) for i in range(40)]
    want = classes(rows, 0.05)
    got = lambda: sorted(tuple(r) for r in metric.within(frame(spark, rows), 0.05).collect())
    assert got() == want
    monkeypatch.setattr(metric, "PART", 8)
    monkeypatch.setattr(metric, "VISITORS", 5)
    assert got() == want


def test_join_skips_what_is_far(spark):
    rows, compared = clustered(1500, 60), spark.sparkContext.accumulator(0)
    got = sorted(tuple(r) for r in metric.within(frame(spark, rows), 0.01, compared).collect())
    assert got == classes(rows, 0.01)
    assert compared.value < 0.2 * len(rows) ** 2


def test_join_of_nothing(spark):
    assert metric.within(frame(spark, []), 0.05).collect() == []
    assert [tuple(r) for r in metric.within(frame(spark, [(1, None), (2, [0.0])]), 0.05).orderBy("id").collect()] == [(1, 1, 0), (2, 2, 0)]


def test_components_and_reachable(spark):
    links = [(1, 2), (2, 3), (9, 3), (20, 21), (7, 7), (None, 4)] + [(100, 101 + k) for k in range(50)] + [(300 + k, 301 + k) for k in range(40)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(links, "a int, b int")).collect()}
    assert {got[n] for n in (1, 2, 3, 9)} == {1} and got[21] == 20 and got[150] == 100 and got[340] == 300 and 7 not in got and 4 not in got
    steps = [(f"n{k}", f"n{k + 1}") for k in range(30)] + [("n3", "n0"), ("n5", "n9"), ("x", "y"), ("n1", None)]
    out = graph.reachable(spark.createDataFrame([("n0",), ("n0",)], "url string"), spark.createDataFrame(steps, "source string, target string"), 20)
    assert {r.url: r.depth for r in out.collect()} == {f"n{k}": min(k, k - 3 if k >= 9 else k) for k in range(24)}


def test_a_vector_travels_once_to_each_block(spark):
    """Where no ring can be left out, a visitor is a row for each BLOCK rows, not for each ring, and bounds are worked out in small lots."""
    rng = np.random.default_rng(8)
    rows = [(k, v.tolist()) for k, v in enumerate(rng.normal(size=(9000, 6)))]
    index = metric.build(spark.createDataFrame(rows, "id long, embedding array<double>").repartition(1))

    def which(bounds, batch, least):
        assert least.size <= metric.ROUTED
        return metric._cells(bounds, np.ones(least.shape, bool))

    assert len(index.bounds.cell) * 9000 > 2 * metric.ROUTED
    routed = metric._routed(index, index.placed.select("id", "unit").repartition(1), ["id", "unit"], which)
    most, cells = routed.selectExpr("max(size(blocks))", "max(aggregate(blocks, 0, (n, b) -> n + size(b.cells)))").first()
    assert most <= 9000 // metric.BLOCK + 1 and cells == len(set(index.bounds.cell.tolist()))
