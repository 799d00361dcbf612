"""Alignment held against every token compared with every other."""

import random

import pytest

pytest.importorskip("public_tokenizers")
from docweir.llm import alignment

ODD = ["", None, " ", "  ", "\n", "a", "a  b", "a \n b", "a\nb", "\na", "a\n", "a\n\nb", " a", "a ", "x▁y", "▁", " a b", "<|endoftext|> and </s> <s>", "<0x41> it's", "don't we'll\tso", "tab\tword", "\x1c\x1d a\x1cb", "ünïcödé ñandú 漢字 かな 🙂🙂‍👩", "a\x00b", "é ﻿", "12345 67 8.9,0", "a" * 3000, "ab " * 900, "\r\n line\r\nnext", "\x85x  y", "   lead", "trail   "]


def rows(spark, texts, **more):
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    out = alignment.align(frame, **more)
    names = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    return [tuple(r[n] for n in names) for r in sorted(out.collect(), key=lambda r: r.doc_id)]


def test_odd_texts(spark):
    assert rows(spark, ODD) == alignment.brute_force(ODD)


def test_random_texts_small_ranges_and_blocks(spark, monkeypatch):
    """Groups, links and counts hold when documents span many ranges and pairs many blocks; workers keep what is set before they start."""
    dice = random.Random(5)
    parts = ["the", "The", "anti", "ization", " ", " ", " ", "\n", "\t", "é", "ß", "漢", "123", "!?", "'s", "▁", " ", "qzx"]
    texts = ["".join(dice.choice(parts) for _ in range(dice.randrange(60))) for _ in range(120)] + ["same words here"] * 7
    monkeypatch.setattr(alignment, "SENT", 100)
    assert rows(spark, texts) == alignment.brute_force(texts)


def test_ranges_of_a_long_text(spark):
    text = " ".join(["alignment", "of", "tokens\n", "äöü"] * 9000)  # several ranges
    got = rows(spark, [text])[0]
    encoder = alignment.Encoder(*alignment.read_vocabularies())
    (a, b), = encoder.encode([text])
    sizes = [[len(x) for x in own] for own in (encoder.bytes_a, encoder.bytes_b)]
    ends = []
    for ids, size in zip((a, b), sizes, strict=True):
        at, own = 0, []
        for i in ids.tolist():
            at += size[i]
            own.append(at)
        ends.append(own)
    both = sorted(set(ends[0]) & set(ends[1]))
    assert len(text.encode()) > 2 * alignment.RANGE
    assert got[:4] == (len(a), len(b), len(both), len(set(ends[0]) | set(ends[1])))
    import hashlib

    groups, i, j = [], 0, 0
    for end in both:
        k, m = ends[0].index(end, i) + 1, ends[1].index(end, j) + 1
        groups.append(",".join(map(str, a[i:k])) + "|" + ",".join(map(str, b[j:m])))
        i, j = k, m
    assert got[6] == hashlib.sha256(";".join(groups).encode()).hexdigest()


def test_groups_and_links_spread(spark):
    files = alignment.read_vocabularies()
    frame = spark.createDataFrame([(1, "tokenizers align", "x")], "doc_id long, text string, n_a string")
    out = alignment.align(frame)
    row = alignment.ids_of(out, files, ["doc_id"]).first()
    assert len(row.groups) == out.first().n_groups and len(row.links) == out.first().n_links
    assert {(x.a, x.b) for x in row.links} >= {(g.a[0], g.b[0]) for g in row.groups}


def test_empty_table_and_repeated_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.align(empty).collect() == []
    assert rows(spark, ["same text"] * 3 + [None]) == alignment.brute_force(["same text"] * 3 + [None])


class Counted:
    """A tokenizer that counts the texts it is given."""

    def __init__(self, inner):
        self.inner, self.n = inner, 0

    def encode_batch_fast(self, texts, **more):
        self.n += len(texts)
        return self.inner.encode_batch_fast(texts, **more)


def test_distinct_words_are_encoded_together():
    """A block's words take few calls of A, uneven texts some more, and the ids are those of whole texts."""
    encoder = alignment.Encoder(*alignment.read_vocabularies())
    whole, encoder.a = encoder.a, Counted(encoder.a)
    dice = random.Random(2)
    texts = [" ".join(f"w{dice.randrange(10**6)}ñ" for _ in range(200)) + "\nlast" for _ in range(50)] + [None, "", "two  blanks\tand a tab", " \n"]
    found = list(encoder.encode(texts))
    assert encoder.a.n < 40
    for text, own in zip(texts, found, strict=True):
        assert own is None or own[0].tolist() == whole.encode(" " + text, add_special_tokens=False).ids
    assert all(own is not None for own in found[:50]) and found[50] is None and found[51] is None
