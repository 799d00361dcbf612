import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from docweir.llm import pieces as p

ODD = ["", " ", "\n", "  a  b ", "\t\n x▁y", "a\u0000b", "日本語 テキスト🙂", "\n\n a\n  b", "x" * 5000, "é" * 300, "123 4567", " ▁ ", "ab" * 20_000, "�", "<s></s><0x41>"]


@pytest.fixture(scope="module")
def model():
    return p.PieceModel(p.read_model())


def check(model, texts):
    ids = model.encode_batch(texts)
    plain = [t or "" for t in texts]
    assert ids == model.library.encode(plain, add_eos=True, num_threads=1)
    assert [model.decode(x) for x in ids] == model.library.decode(ids)


def test_odd_texts(model):
    check(model, [*ODD, None, *ODD])


@settings(max_examples=300, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from("the ining er\n ▁")), max_size=120))
def test_any_text(model, text):
    check(model, [text])


def test_heap_and_list_agree(model, monkeypatch):
    words = ["▁" + w for w in "international Donaudampfschiff anticonstitutionnellement aaaaaaaabbbb ééé".split()]
    short = [model.merge(w) for w in words]
    monkeypatch.setattr(p, "SHORT", 0)
    assert [model.merge(w) for w in words] == short


def test_remembering_is_bounded(monkeypatch):
    monkeypatch.setattr(p, "REMEMBERED", 3)
    model = p.PieceModel(p.read_model())
    for k in range(5):
        check(model, [f"word{k} and word{k - 1}", "and more"])
    assert len(model.known) < 20


def test_documents(spark):
    rows = [(k, t, [9]) for k, t in enumerate([*ODD, None])]
    docs = spark.createDataFrame([*rows, rows[3]], "doc_id long, text string, ids array<int>")
    model = p.PieceModel(p.read_model())
    got = p.encode_documents(docs).collect()
    assert len(got) == len(rows) + 1
    for r in got:
        assert r.ids == model.library.encode(r.text or "", add_eos=True) and r.decoded == model.library.decode(r.ids)
    assert p.encode_documents(docs.limit(0)).count() == 0
