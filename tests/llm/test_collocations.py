"""Collocations held against counts of every phrase of every piece."""

import random

from docweir.llm import collocations


def got(spark, data, parts=3, **more):
    frame = spark.createDataFrame(data, "lang string, text string").repartition(parts)
    return sorted(tuple(r) for r in collocations.collocations(frame, **more).collect())


def corpus(seed, n=150):
    dice = random.Random(seed)
    words = ["the", "The", "of", "new", "york", "city", "hall", "é", "ÉÉ", "x\x1cy", "a\xa0b", "naïve", "co-op", "…"]
    ends = [" ", " ", " ", " ", "\t", ". ", ", ", "\n", ";", " - "]
    phrase = ["new york city", "of the", "york city hall", "the the the"]
    data = []
    for _ in range(n):
        text = "".join((dice.choice(words) if dice.random() < 0.7 else dice.choice(phrase)) + dice.choice(ends) for _ in range(dice.randrange(40)))
        data.append((dice.choice(["en", "en", "de", None, ""]), text))
    return data


def test_random_corpora(spark):
    for seed in (1, 2):
        data = corpus(seed)
        assert got(spark, data) == sorted(collocations.brute_force(data))


def test_longer_phrases_and_small_blocks(spark):
    data = corpus(3)
    for longest, least in ((2, 10), (4, 4), (5, 6)):
        assert got(spark, data, 12, longest=longest, least=least) == sorted(collocations.brute_force(data, longest, least))


def test_best_and_ties(spark):
    data = [("en", "a b. c d. e f. " * 10)] + [("de", "z y x " * 12)]
    want = sorted(collocations.brute_force(data))
    assert got(spark, data) == want and [r[2] for r in want if r[0] == "en"] == ["a b", "c d", "e f"]
    assert got(spark, data, best=2) == sorted(collocations.brute_force(data, best=2))


def test_large_counts_are_exact(spark):
    """Scores hold where the products pass 64 bits."""
    n = 4_000_000_000
    names = spark.createDataFrame([(n, [n + 7], [n + 3])], "a long, heads array<long>, tails array<long>")
    wide = "cast({} as decimal(20,0))"
    row = names.selectExpr(f"(cast(1000000 as decimal(10,0)) * {wide.format('a')} * {wide.format('a')}) div ({wide.format('heads[0]')} * {wide.format('tails[0]')}) as s").first()
    assert row.s == 1_000_000 * n * n // ((n + 7) * (n + 3))


def test_nulls_empty_tables_and_one_hot_pair(spark):
    assert got(spark, []) == []
    assert got(spark, [(None, None), ("en", ""), ("en", " \t"), (None, "...")]) == []
    data = [(None, "hot pair")] * 500 + [("en", "hot pair " * 5000), ("en", "long" * 5000 + " tail")]
    assert got(spark, data) == sorted(collocations.brute_force(data))
