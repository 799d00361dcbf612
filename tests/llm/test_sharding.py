import random
import zlib

import pytest

from docweir.llm import sharding as s


@pytest.mark.parametrize("seed", range(4))
def test_line_meets_brute_force(spark, seed):
    rng = random.Random(seed)
    sizes = [rng.choice([1, 2, 3, 50]) for _ in range(rng.randrange(1, 120))]
    ends = [sum(sizes[: k + 1]) for k in range(len(sizes))]
    df = spark.createDataFrame([(e - n, e) for e, n in zip(ends, sizes, strict=True)], "start long, end long")
    for shards, points in ((3, 2), (7, 3), (24, 2048)):
        capacity, cuts = s.minimax_cuts(df, shards, points)
        assert capacity == s.brute_force(sizes, shards)
        assert cuts[-1] == ends[-1] and all(b - a <= capacity for a, b in zip([0, *cuts], cuts, strict=False))


def test_documents(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choices("abé", k=rng.randrange(60))) for _ in range(150)] + ["hot text " * 3] * 80 + [None, "", None]
    docs = spark.createDataFrame([(k * 3, t, 7) for k, t in enumerate(texts)] + [(0, texts[0], 7), (None, "n", 7)], "doc_id long, text string, shard int")
    rows = s.shard_by_bytes(docs, 6).collect()
    assert len(rows) == docs.count()
    text = dict(enumerate(texts))
    by_text, slots = {}, {}
    for r in rows:
        t = "n" if r.doc_id is None else text[r.doc_id // 3] or ""
        assert r["size"] == len(t.encode()) + 8 and r.text_crc32 == zlib.crc32(t.encode())
        by_text.setdefault(t, set()).add(r.shard)
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(len(x) == 1 for x in by_text.values())
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    sums = {}
    for r in rows:
        sums[r.shard] = sums.get(r.shard, 0) + r["size"]
    order = {}
    for k, t in [(-1, "n"), *((k, t or "") for k, t in text.items())]:
        order.setdefault(t, k)
    sizes = [sum(r["size"] for r in rows if ("n" if r.doc_id is None else text[r.doc_id // 3] or "") == t) for t, _ in sorted(order.items(), key=lambda x: x[1])]
    assert max(sums.values()) == s.brute_force(sizes, 6)
    assert s.shard_by_bytes(docs.limit(0)).count() == 0
