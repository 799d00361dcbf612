"""Substring deduplication held against a table of all windows."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st

import numpy as np

from docweir.llm import substrings


def rows(spark, data, parts=3):
    frame = spark.createDataFrame(data, "doc_id long, text string").repartition(parts)
    import hashlib

    got = [(r.doc_id, r.text, r._dw_n_words, r._dw_n_removed) for r in substrings.remove_repeats(frame).collect()]
    return sorted((i is None, i, n, m, hashlib.sha256((t or "").encode()).hexdigest()) for i, t, n, m in got)


def wanted(data):
    return sorted((i is None, i, n, m, d) for (i, _), (n, m, d) in zip(data, substrings.brute_force(data), strict=True))


def test_cover_has_every_difference():
    assert {(a - b) % substrings.PERIOD for a in substrings.COVER for b in substrings.COVER} == set(range(substrings.PERIOD))


@settings(deadline=None, max_examples=60)
@given(st.lists(st.integers(0, 3), max_size=150), st.integers(1, 60))
def test_run_hashes_tell_runs_apart(codes, size):
    lane = np.array(codes, np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    got = substrings.run_hashes(lane, size)
    runs = [tuple(codes[k : k + size]) for k in range(len(codes) - size + 1)]
    assert len(got) == len(runs)
    assert len({(r, int(g)) for r, g in zip(runs, got, strict=True)}) == len(set(runs)) == len(set(got.tolist()))


def corpus(seed, n=60):
    """Texts made of shared passages at any shift, near copies with words put in, repeated and interleaved ones."""
    dice = random.Random(seed)
    word = lambda: "".join(dice.choice("abcdeé") for _ in range(dice.randrange(1, 5)))
    passages = [[word() for _ in range(dice.choice([30, 49, 50, 51, 55, 70, 120, 400]))] for _ in range(12)]
    passages += [["x"] * 90, ["x", "y"] * 60]
    data = []
    for k in range(n):
        own = []
        for _ in range(dice.randrange(4)):
            own += [word() for _ in range(dice.randrange(40))]
            p = list(dice.choice(passages))
            if dice.random() < 0.3:
                p[dice.randrange(len(p))] = "changed"
            if dice.random() < 0.2:
                p.insert(dice.randrange(len(p)), "more")
            own += p[dice.randrange(3) :]
        data.append((k * 3 % n, dice.choice([" ", "  ", "\n", "\t "]).join(own)))
    return data


def test_random_corpora(spark):
    for seed in (1, 2):
        data = corpus(seed)
        assert rows(spark, data) == wanted(data)


def test_many_blocks(spark, monkeypatch):
    data = corpus(3)
    monkeypatch.setattr(substrings, "BLOCK_ROWS", 1)
    assert rows(spark, data, 8) == wanted(data)


def test_nulls_ties_repeats_and_odd_texts(spark):
    long = " ".join(f"w{k}" for k in range(80))
    data = [(None, long), (None, long), (5, long), (5, long), (5, "pre " + long), (7, long + " tail"), (2, None), (3, ""), (4, " \n\t "), (-1, "short"), (9, " ".join(["a"] * 51)), (10, " ".join(["a"] * 50)), (11, " ".join(["a"] * 49)), (12, "nbsp here\x1cand " + long)]
    assert rows(spark, data) == wanted(data)


def test_one_hot_passage_and_copies(spark):
    passage = " ".join(f"p{k}" for k in range(60))
    data = [(k, f"own{k} " * (k % 9) + passage + f" end{k}") for k in range(300)] + [(1000 + k, "c " * 10 + passage) for k in range(200)]
    assert rows(spark, data, 7) == wanted(data)


def test_empty_table_other_columns_and_long_text(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, block string, rows int")
    assert substrings.remove_repeats(empty).collect() == []
    text = " ".join(f"v{k % 40000}" for k in range(60000))
    frame = spark.createDataFrame([(1, text, "b", 1, None), (2, text + " z", None, 2, [1])], "doc_id int, text string, block string, rows int, spans array<int>")
    out = {r.doc_id: r for r in substrings.remove_repeats(frame).collect()}
    assert (out[1]._dw_n_removed, out[1].block, out[1].rows) == (0, "b", 1) and out[1].text == text
    assert (out[2]._dw_n_removed, out[2].text, out[2].spans, out[2]._dw_spans) == (60000, "z", [1], [(0, 60000)])


def test_no_shuffle_files_stay(spark):
    """What one step shuffles is gone before the next needs room; the session's own choice stays."""
    import time

    from docweir.llm.common import CLEANUP

    def files():
        held = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {held.apply(k).getName() for k in range(held.size()) if held.apply(k).getName().startswith("shuffle_")}

    passage = " ".join(f"w{k}" for k in range(80))
    frame = spark.createDataFrame([(k, f"a{k} {passage} b{k}") for k in range(40)], "doc_id long, text string")
    before, chosen = files(), spark.conf.get(CLEANUP, "false")
    out = substrings.remove_repeats(frame)
    until = time.time() + 5
    while files() - before and time.time() < until:
        time.sleep(0.2)
    assert not files() - before and spark.conf.get(CLEANUP) == chosen
    assert sum(r._dw_n_removed for r in out.collect()) == 39 * 80
