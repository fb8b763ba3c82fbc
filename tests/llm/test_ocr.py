import pytest

from veilwright.llm import ocr

DOC = "file_id long, noise_kind string, pages array<struct<page_number int, text string, extract_method string, confidence double>>"
CLEAN = "Kira bedelini denetim kurulu onaylar. Ek protokolü proje ofisi inceler; iç-denetim raporu alt-yüklenici teslim eder."


@pytest.fixture(scope="module")
def repair(spark):
    noisy = [
        (1, "BAKIM RAPORU\nSayı 1616\n\nKira bede-\nlini dcnetim kurulu onaylar.\nEk proto¬\nkolü projc ofisi 2O24.\n\n1 / 2", "ocr", 80.0),
        (2, "BAK1M RAPORU   2\nSayı 1616\nRapor iç-\ndenetim teslim\neder.\n2 / 2", "ocr", None),
        (3, None, "ocr", None),
        (4, "", "ocr", -1.0),
    ]
    plain = [(1, CLEAN, "native", None)]
    rows = [(i, "x", plain) for i in range(10, 40)] + [(1, "x", noisy), (1, "x", noisy), (2, "x", None), (3, "x", [])]
    return ocr.Repair(spark.createDataFrame(rows, DOC), ratio=10)


def test_found(repair):
    got = {tuple(r) for r in repair.found().select("file_id", "page_number", "line_no", "noise_kind").collect()}
    assert got == {
        (1, 1, 1, "running_line"),
        (1, 1, 2, "running_line"),
        (1, 1, 4, "split_word"),
        (1, 1, 5, "misread"),
        (1, 1, 6, "split_word"),
        (1, 1, 7, "misread"),
        (1, 1, 9, "page_number"),
        (1, 2, 1, "running_line"),
        (1, 2, 2, "running_line"),
        (1, 2, 6, "page_number"),
    }


def test_pages(repair):
    got = {(r["file_id"], r["page_number"]): r["text"] for r in repair.pages().collect()}
    assert got == {(1, 1): "Kira bedelini denetim kurulu onaylar. Ek protokolü proje ofisi 2024.", (1, 2): "Rapor iç-denetim teslim eder.", (1, 4): ""}


def test_empty(spark):
    r = ocr.Repair(spark.createDataFrame([], DOC))
    assert r.found().count() == 0 and r.pages().count() == 0


@pytest.mark.parametrize("word,seen,n", [("denetim", "dcnetim", 1), ("olur", "0lur", 1), ("kural", "lcur·al", 2), ("evet", "evet", 0), ("evet", "hayır", None), ("modern", "moclem", None)])
def test_confusions(word, seen, n):
    assert ocr.turns_into(word, seen) == n


@pytest.mark.parametrize("word,seen,n", [("2024", "2o24", 1), ("2022", "z022", 1), ("1.500", "l.5oo", 3), ("bul", "6ul", None)])
def test_digit_confusions(word, seen, n):
    assert ocr.turns_into(word, seen) == n


@pytest.mark.parametrize("raw,want", [("(2O24).", "(2024)."), ("Z022,", "2022,"), ("202l", "2021"), ("ZOl9", "2019"), ("1.5OO,OO", "1.500,00"), ("il9ili", "il9ili"), ("12B", "12B"), ("5/b", "5/b"), ("5l", "5l"), ("Tut@nağı;", "Tutanağı;"), ("fiya†ın", "fiyatın"), ("DE$EN", "DEŞEN"), ("ar·şiv", "arşiv"), ("evet", "evet")])
def test_turned_back(raw, want):
    assert ocr._turned_back(raw) == want


def test_misread_numbers(spark):
    """By the frequent number where there is one, else character by character; a frequent word comes before both."""
    plain = [(1, "Madde 4816 gibi 2024", "native", None)]
    noisy = [(1, "Sayı 4b16, 9ibi Z024 ve 2O3l\nBu Tut@nağı 2O-\n27 eder", "ocr", 80.0)]
    r = ocr.Repair(spark.createDataFrame([*((i, "x", plain) for i in range(10, 40)), (1, "x", noisy)], DOC))
    assert r.pages().where("file_id = 1").first()["text"] == "Sayı 4816, gibi 2024 ve 2031 Bu Tutanağı 2027 eder"


@pytest.mark.parametrize("line,n", [("- 3 -", 3), ("Sayfa 2/5", 2), ("[l]", 1), ("s. 1O", 10), ("iv", 4), ("3 / 8", 3), ("Sayfa l", 1), ("p. 7", 7), ("Adet 12 koli", None), ("6.123,00", None), ("Rev 2023", None), ("", None)])
def test_page_numbers(line, n):
    got = ocr.page_number_of(line) if line else None
    assert (got[0] if got else None) == n


def vocab(spark, rows):
    return spark.createDataFrame([(k, n, w) for k, n, w in rows], "key string, n long, w double")


def test_three_confusions_are_joined(spark):
    rows = [("emekli", 500, 500.0), ("cmckl1", 1, 1.0), ("kira", 300, 300.0), ("lcrri1", 1, 1.0), ("hane", 400, 400.0), ("harı3", 1, 1.0)]
    got = {r["key"]: (r["correct"], r["confusions"]) for r in ocr.corrections(vocab(spark, rows)).collect()}
    assert got == {"cmckl1": ("emekli", 3)}


def test_confidence_lowers_the_evidence_needed(spark):
    """A form on badly read pages only is corrected although it is too frequent for good pages."""
    right = ("denetim", 60, 60.0)
    assert ocr.corrections(vocab(spark, [right, ("dcnetim", 10, 10.0)])).count() == 0
    assert ocr.corrections(vocab(spark, [right, ("dcnetim", 10, 4.0)])).count() == 1
    assert [ocr.page_weight(c) for c in (None, -1.0, 20.0, 80.0, float("nan"))] == [1.0, 1.0, 0.3, 0.8, 1.0]


def test_confusions_are_a_parameter(spark):
    rows = [("rapor", 100, 100.0), ("rapur", 1, 1.0)]
    assert ocr.corrections(vocab(spark, rows)).count() == 0
    assert ocr.corrections(vocab(spark, rows), confusions="o>u").first()["correct"] == "rapor"
