"""Nested metadata against a walk in Python."""

import datetime
import json

from docweir.operators import metadata

ROWS = [
    {"Title": "Über", "deep": {"list": [1, 2.5, True, None, {"Key\"q": "va\\lue\nx", "n": [[["bottom"]]]}]}},
    {}, [], "plain", 12, None, {"a": {"b": {"c": {"d": "DEEP"}}}}, {"empty": "", "zero": 0}, [["x"], "y"],
]


def walk(x, name=None):
    if isinstance(x, dict):
        if name is not None:
            yield name, None
        for k, v in x.items():
            yield from walk(v, k)
    elif isinstance(x, list):
        if name is not None:
            yield name, None
        for v in x:
            yield from walk(v)
    elif name is not None or x is not None:
        yield name, None if x is None else x if isinstance(x, str) else json.dumps(x)


def test_leaves_and_containment(spark):
    df = spark.createDataFrame([(k, json.dumps(r)) for k, r in enumerate(ROWS)] + [(90, "{bad"), (91, None)], "id int, meta string")
    held = metadata.parsed(df, "meta")
    got = {}
    for r in metadata.leaves(held, "id", "metadata").collect():
        got.setdefault(r.id, []).append((r.name, r.value))
    want = {k: found for k, r in enumerate(ROWS) if (found := list(walk(r)))}
    key = lambda x: tuple(map(str, x))
    assert {k: sorted(v, key=key) for k, v in got.items()} == {k: sorted(v, key=key) for k, v in want.items()}
    for query in ("über", "title", 'key"q', "va\\lue", "deep", "2.5", "true", "bottom", "b", "{", "nowhere"):
        want = {k for k, r in enumerate(ROWS) if any(query in (x or "").lower() for pair in walk(r) for x in pair)}
        assert {r.id for r in metadata.containing(held, "id", "metadata", query).collect()} == want
    assert [r[0] for r in held.orderBy("id").limit(1).select(metadata.at("metadata", "$.deep.list[1]", "double")).collect()] == [2.5]
    assert held.filter("id = 0").select(metadata.at("metadata", "$.Title", "int")).first()[0] is None


def test_projection(spark):
    at = datetime.datetime(2024, 5, 6, 7, 8, 9, 120000)
    row = (7, "a.pdf", "s.pdf", "d/a.pdf", 10, at, "DONE", None, "x; y", ["p"], datetime.date(2024, 1, 2), None, 5)
    df = spark.createDataFrame([row], "id long, original_filename string, stored_filename string, file_path string, file_size long, uploaded_at timestamp, status string, processed_at timestamp, keywords string, policy_areas array<string>, publication_date date, page_count int, imported_by long")
    got = metadata.projection(df).first()
    assert (got.id, got.name, got.relative_path, got.size, got.imported_by, got.page_count, got.chunk_count) == ("7", "a.pdf", "d/a.pdf", 10, "5", 0, 0)
    assert (got.uploaded_at, got.processed_at, got.publication_date) == ("2024-05-06T07:08:09.120000+00:00", None, "2024-01-02")
    assert (got.keywords, got.policy_areas, got.approved, got.access_level, got.title) == (["x", "y"], ["p"], True, "public", None)
    assert abs(got.modified_at - 1714979289.12) < 1e-6
