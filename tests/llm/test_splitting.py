from hypothesis import given, settings
from hypothesis import strategies as st

from veilwright.llm import splitting as S


def check(text, limit, overlap):
    pieces = S.split(text, limit, overlap)
    assert "".join(p[5][p[3] :] for p in pieces) == text
    for i, (no, a, b, o, kind, piece) in enumerate(pieces):
        assert no == i and piece == text[a:b] and 0 < len(piece) <= limit
        assert (o == 0) == (i == 0) or overlap == 0 or o > 0
        if i:
            before = pieces[i - 1]
            assert piece[:o] == before[5][len(before[5]) - o :] and o <= 2 * overlap
        if kind == "word":
            assert text[b - 1].isspace()
        if kind == "none":
            assert not any(c.isspace() for c in text[pieces[i - 1][2] if i else 0 : b - 1])
    return pieces


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="abc .\n\f\r̈🙂ş", max_size=400), st.integers(20, 60), st.integers(0, 9))
def test_round_trip(text, limit, overlap):
    if text:
        check(text, limit, overlap)


def test_cuts_at_topic():
    one = "Kedi mama yer ve kedi uyur. " * 20
    two = "Motor yakıt yakar ve motor döner. " * 20
    pieces = check(one + two, 700, 60)
    assert any(abs(p[2] - len(one)) < 2 for p in pieces)


def test_page_is_preferred():
    text = "a b c. " * 40 + "\f" + "d e f. " * 40
    assert check(text, 400, 30)[0][4] == "page"


def test_no_break_at_all():
    assert len(check("x" * 5000, 2000, 150)) == 3


def test_table(spark):
    rows = [(1, "k", "a b. " * 100), (2, "k", "short"), (3, "k", ""), (4, "k", None), (1, "k", "a b. " * 100)]
    out = S.split_table(spark.createDataFrame(rows, "id long, piece string, text string"), ["id"], "text", 100, 10).collect()
    assert {r["id"] for r in out} == {1, 2} and max(len(r["piece"]) for r in out) <= 100
    assert S.split_table(spark.createDataFrame([], "id long, text string"), ["id"], "text").count() == 0
