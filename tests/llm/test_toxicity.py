import random

import pytest

from docweir.llm import toxicity as t

FILLER = "the quick brown fox jumps over lazy dogs while seven wizards mix potions near quiet rivers and tall green hills".split()
BAD = ["idiot", "moron", "scum"]


def corpus(n=600):
    rng = random.Random(4)
    rows = []
    for k in range(n):
        words = rng.choices(FILLER, k=40)
        toxic = k % 3 == 0
        if toxic:
            words[rng.randrange(40)] = rng.choice(BAD)
        rows.append((k, " ".join(words), int(toxic)))
    return rows


@pytest.fixture(scope="module")
def fitted(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, x, 0.5) for i, x, _ in rows] + [(9000, None, 0.5)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(0, None), (0, 1), (None, 1)], "doc_id long, toxic int")
    return docs, t.fit_toxicity(docs, labels)


def test_held_out_accuracy(spark, fitted):
    docs, model = fitted
    truth = {i: y for i, _, y in corpus()}
    held = {r.doc_id for r in docs.filter(~t.learnable()).collect()}
    rows = [r for r in t.score_toxicity(docs, model).collect() if r.doc_id in held and r.doc_id in truth]
    assert len(rows) > 100
    assert all((r._dw_score >= t.THRESHOLD) == bool(truth[r.doc_id]) for r in rows)


@pytest.mark.parametrize("written", ["1d10t", "i.d.i.o.t", "idiooooot", "m0r0n", "M-O-R-O-N", "i d i o t", "$cum", "!diot,", "i   d    i o t", "i\nd\ni\no\nt", "m\t0 \n r   0 n"])
def test_disguises(fitted, written):
    _, model = fitted
    reader = t.Reader(t.LetterModel(model.counts))
    heads = frozenset(e[:3] for e in model.evidence)
    assert model.score(reader.words(f"the quick {written} jumps", heads)) >= t.THRESHOLD
    assert model.score(reader.words("see the quick brown fox, 100% a.b.c 3.14!", heads)) < t.THRESHOLD


def brute_restore(token, model):
    """The likeliest reading, by trying all of them."""
    paths = [("^^", 0.0, "")]
    for k, sign in enumerate(token):
        again = sign * 3 in token[max(0, k - 2) : k + 3]
        after = []
        for state, score, made in paths:
            for letter, cost in t.readings(sign):
                if not letter:
                    after.append((state, score + cost, made))
                    continue
                after.append((state[1] + letter, score + cost + model.log(state + letter), made + letter))
                if again and letter == state[1]:
                    after.append((state, score + cost + t.AGAIN, made))
        paths = after or paths
    return max(s + model.log(state + "$") for state, s, _ in paths), paths


def test_viterbi_is_exact(fitted):
    model = t.LetterModel(fitted[1].counts)
    for token in ("1d10t", "w1z4rd$", "b.r0.wn", "dooogs", "h!lls", "7all"):
        best, paths = brute_restore(token, model)
        made = t.restore(token, model)
        assert any(text == made and abs(s + model.log(state + "$") - best) < 1e-9 for state, s, text in paths)


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, ""), (2, None), (3, "words " * 3000), (3, "x")], "doc_id long, text string")
    model = t.fit_toxicity(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert [r._dw_score for r in t.score_toxicity(docs, model).collect()] == pytest.approx([t.BASE] * 4)
    assert t.score_toxicity(docs.limit(0), model).count() == 0


def test_beginnings_of_one_word():
    found = [("loser$", 100, 100), ("loser", 100, 100), ("lose", 110, 100), ("lowe", 90, 90), ("lowei", 90, 90), ("loweia", 20, 20), ("loweib", 30, 30), ("the$", 900, 500)]
    assert t.weigh(found, 1000, 200).keys() == {"loser$", "loser", "lowe", "lowei", "loweia", "loweib"}
    assert t.weigh(found, 0, 0) == {}


LONG_PLAIN = "the quick brown fox jumps over lazy dogs while seven wizards mix potions near quiet rivers and tall green hills"


@pytest.mark.parametrize("word", ["1d10t", "m0r0n", "5cum"])
def test_long_runs_and_tokens(fitted, word):
    _, model = fitted
    heads = frozenset(e[:3] for e in model.evidence)
    score = lambda text: model.score(t.Reader(t.LetterModel(model.counts)).words(text, heads))
    plain = LONG_PLAIN.split()
    for sign in "-._":
        assert score(sign.join([*plain[:9], word, *plain[9:]])) >= t.THRESHOLD > score(sign.join(plain))
    spelt = "".join([*plain[:9], word, *plain[9:], *plain[:9]])
    for sign in " -.":
        assert len(sign.join(spelt)) > 200 and score(sign.join(spelt)) >= t.THRESHOLD


def test_long_runs_are_linear(fitted):
    _, model = fitted
    reader = t.Reader(t.LetterModel(model.counts))
    words = reader.words(" ".join("quietriver" * 2_000))
    assert sum(map(len, words)) < 2_000_000
    assert len(t.restore("1" * 2_000 + "6a!", model=t.LetterModel(model.counts))) > 0


def test_the_sample_is_the_same_in_every_run(spark):
    """Near copies and repeated ids give way to the same rows however the table is dealt; clashing names and repeats stay."""
    rows = corpus(300)
    rows += [(i + 5000, x + " extra", y) for i, x, y in rows[::3]] + [(i, x + " other", y) for i, x, y in rows[::10]]
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    docs = spark.createDataFrame([(i, x, "own", "h") for i, x, _ in rows] * 2, "doc_id long, text string, _dw_text string, score string")
    models = [t.fit_toxicity(docs.repartition(n, "text"), labels) for n in (1, 7)]
    assert models[0] == models[1] and models[0].evidence
    scored = t.score_toxicity(docs, models[0])
    assert scored.count() == 2 * len(rows) and scored.select("score", "_dw_text").distinct().collect() == [("h", "own")]
