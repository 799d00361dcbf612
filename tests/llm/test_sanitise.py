import math
import random
import re
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docweir.llm import sanitise as s

ALPHABET = st.sampled_from("a.@-+1 2(%_)4é9\n0")
SAMPLES = [
    "mail a.b@c.de, a@b.com@c.d, x@@y.z, @a.b, a@b", "ip 1.2.3.4.5.6.7.8 256.1.1.1 007.0.0.255 1.2.3",
    "card 4111 1111 1111 1111 and 4587121519400672 4111-1111-1111-1112", "phone +1 (255) 555-8013. +12 +1--------2", "1" * 6000, "9" * 40 + ".1.2.3",
]


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet=ALPHABET, max_size=80))
def test_patterns_as_stated(text):
    assert s.base_spans(text) == s.brute_force(text)


def test_samples():
    for text in SAMPLES:
        assert s.base_spans(text) == s.brute_force(text)
    assert s.base_spans("é a@b.co 4111 1111 1111 1111")[:2] == [(2, 8, "email"), (9, 28, "card")]
    assert s.base_spans(None) == [] == s.base_spans("")


def corpus():
    rng = random.Random(2)
    filler = [f"filler{k}" for k in range(300)]
    rows = []
    for k in range(30):
        near = "falconer" if k < 6 else rng.choice(filler)
        who = "boss@corp.example" if k < 6 else f"p{k}@corp.example"
        rows.append(f"{' '.join(rng.choices(filler, k=5))} {near} wrote {who} about {' '.join(rng.choices(filler, k=5))}")
    return rows + ["A falconer came by", "nothing here", "", None] + rows[:2]


def test_disclosing_terms(spark, monkeypatch):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(corpus())], "doc_id long, text string")
    terms = {r.term for r in s.disclosing_terms(docs, disclosure=0.7).collect()}
    assert terms == {"falconer"}  # "wrote" and "about" stand beside every address
    two = spark.createDataFrame([("falconer",), ("wrote",)], "term string")
    for held in (s.HELD_TERMS, 1):  # the second way is that for more terms than a task may hold
        monkeypatch.setattr(s, "HELD_TERMS", held)
        found = {r.doc_id: r for r in s.find_personal(docs, two).collect()}
        assert len(found) == docs.count()
        assert [x.kind for x in found[0]._dw_spans] == ["term", "term", "email"]
        assert [x.kind for x in found[30]._dw_spans] == ["term"] and found[32]._dw_spans == found[33]._dw_spans == []


def test_sanitise(spark):
    docs = spark.createDataFrame([(k, t, "x", 1) for k, t in enumerate([*corpus(), *SAMPLES])], "doc_id long, text string, kind string, n_chars long")
    out = s.sanitise(docs).collect()
    assert len(out) == docs.count()
    for r in out:
        assert s.base_spans(r.text) == [] and (r.text is None or r.n_chars == len(r.text))
    assert s.sanitise(docs.limit(0)).count() == 0
    assert s.redact("ab cd", [(0, 2, "ip"), (1, 4, "card")]) == "[IP]d"


def test_one_worker_finds_and_replaces(spark, monkeypatch):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate([*corpus(), *SAMPLES])], "doc_id long, text string")
    two = spark.createDataFrame([("falconer",), ("wrote",)], "term string")
    for held in (s.HELD_TERMS, 1):
        monkeypatch.setattr(s, "HELD_TERMS", held)
        made = s.sanitise(docs, two)
        # a task runs a worker for each of its Python functions, and they stay
        assert made._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
        got = {r.doc_id: r.text for r in made.collect()}
        assert len(got) == docs.count()
        for r in s.find_personal(docs, two).collect():
            text, spans = r.text, [(x.start, x.end, x.kind) for x in r._dw_spans]
            while text and spans:
                text = s.redact(text, spans)
                spans = s.base_spans(text)
            assert got[r.doc_id] == text
        assert "[TERM]" in got[30] and "[TERM] [EMAIL]" in got[0]


def test_disclosing_terms_among_copies(spark):
    rng = random.Random(6)
    filler = [f"filler{k}" for k in range(2000)]
    rows = []
    for k in range(200):
        near = f"nickname{k % 5}" if k < 40 else rng.choice(filler)
        who = f"boss{k % 5}@corp.example" if k < 40 else f"p{k}@corp.example"
        often = "common" if k < 40 and k % 5 == 0 else rng.choice(filler)
        rows.append(f"{' '.join(rng.choices(filler, k=12))} {near} {often} {who} wrote {' '.join(rng.choices(filler, k=12))}")
    rows += [f"{' '.join(rng.choices(filler, k=9))} common {' '.join(rng.choices(filler, k=9))}" for _ in range(20)]
    docs = spark.createDataFrame([(t,) for t in rows * 20], "text string")  # twenty of each text
    assert {r.term for r in s.disclosing_terms(docs).collect()} == {f"nickname{k}" for k in range(5)}


def brute_terms(texts, support, disclosure):
    """disclosing_terms() of a list of texts, by going over all words and mentions."""
    inside, outside = set(), defaultdict(set)
    telling = lambda words: tuple(sorted({w.lower() for w in words if len(w) > 2 and not w.isdigit()}))
    for text in filter(None, texts):
        spans = s.brute_force(text)
        words = [m for m in re.finditer(r"\w+", text) if all(m.end() <= a or m.start() >= b for a, b, _ in spans)]
        near = set()
        for span in spans:
            before = [k for k, m in enumerate(words) if m.end() <= span[0]][-8:]
            after = [k for k, m in enumerate(words) if m.start() >= span[1]][:8]
            near.update(before + after)
            inside.add((s.entity(text, span), telling(words[k][0] for k in before + after)))
        for k, m in enumerate(words):
            if k not in near:
                outside[m[0].lower()].add(telling(x[0] for x in words[max(0, k - 8) : k + 9]))
    n_e, n_et, n_t = defaultdict(int), defaultdict(int), defaultdict(int)
    for who, terms in inside:
        n_e[who] += 1
        for t in terms:
            n_et[who, t] += 1
            n_t[t] += 1
    total = len(inside)
    share = lambda e, t: 1 + math.log2(min(1, n_et[e, t] / (n_t[t] + len(outside[t])))) / -math.log2(n_e[e] / (total + 1))
    return {t for (e, t), n in n_et.items() if n >= support and n_e[e] >= support and share(e, t) >= disclosure}


@pytest.mark.parametrize("seed", [1, 2])
def test_disclosing_terms_by_brute_force(spark, seed, monkeypatch):
    """One address on a third of all pages, some with their own words, copies, mentions side by side, words across spans."""
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(60)]
    rows = []
    for k in range(240):
        who = "hot@corp.example" if k % 3 == 0 else f"p{k % 11}@corp.example"
        own = [f"own{k % 11}"] if k % 3 and k % 11 < 6 else ["Hotword"] if k % 3 == 0 and k % 2 else []
        text = [*rng.choices(words, k=rng.randrange(14)), *own, who, *([f"10.0.0.{k % 7}"] if k % 5 == 0 else []), *rng.choices(words, k=rng.randrange(14))]
        if k % 13 == 0:
            text += ["own2", *rng.choices(words, k=12)]
        rows.append((" " * (1 + 400 * (k % 17 == 0))).join(text))
    rows += [*rows[:40], "", None, "y" * 900 + " hot@corp.example near", "\u65e5\u672cp1@corp.example\u65e5\u672c"]
    docs = spark.createDataFrame([(t,) for t in rows], "text string")
    for support, disclosure in ((2, 0.6), (3, 0.8), (s.SUPPORT, s.DISCLOSURE)):
        want = brute_terms(rows, support, disclosure)
        assert {r.term for r in s.disclosing_terms(docs, support, disclosure).collect()} == want
        if disclosure < 0.7:
            assert len(want) > 3
            monkeypatch.setattr(s.BitMap, "among", lambda self, words: words)  # as if all bits were set
