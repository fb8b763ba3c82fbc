import pytest

from veilwright.llm import lookalike as L

TEXTS = ["Ortak kapı özel copy", "Договор вступает в силу. Оплата сор", "Πρώτη νύχτα", "Sözleşme, şirket: Ümit Ökten ilk Işık"] * 5


@pytest.fixture(scope="module")
def model(spark):
    return L.learn(spark.createDataFrame([(t, 1) for t in TEXTS] + [(None, 2), ("", 3)], "text string, n int"))


@pytest.mark.parametrize(
    "a,b",
    [
        ("Sözleşme", "Ｓöｚｌｅşｍｅ"),
        ("Sözleşme", "Sözleşme"),
        ("Ortak", "Оrtаk"),
        ("Ortak", "Οrtαk"),
        ("a b", "a b"),
        ("a  b", "a \tb"),
        ("ofis", "oﬁs"),
        ("mek​tup", "mek­tup"),
        ("Оплата", "Oплaтa"),
        ("KAPI", "КАРI"),
        ("a\nb", "a\r\nb"),
        ("İlk", "İlk"),
        ("ilk", "i̇lk"),
        ("АВ-12", "ΑΒ-12"),
    ],
)
def test_same_look(model, a, b):
    assert model.canonical(a) == model.canonical(b)


@pytest.mark.parametrize("a,b", [("Işık", "Isik"), ("ılk", "ilk"), ("Ortak", "ortak"), ("a b", "a  b"), ("a b", "ab"), ("söz", "soz"), ("x²", "x2"), ("a\nb", "a b"), ("0", "O")])
def test_visible_difference(model, a, b):
    assert model.canonical(a) != model.canonical(b)


def test_script_of_result(model):
    assert model.canonical("Оrtаk copy") == "Ortak copy"
    assert model.canonical("Дoгoвop") == "Договор"
    assert model.canonical("") == "" and model.canonical("🙂 12\n") == "🙂 12\n"


def test_pairs(spark, model):
    rows = [(1, "j", "P", "Ali"), (2, "j", "P", "Аli"), (2, "j", "P", "Аli"), (3, "k", "P", "Ali"), (4, "j", "P", "Ali"), (5, "j", None, "Ali"), (6, "j", None, "A​li"), (7, "j", "P", None)]
    df = spark.createDataFrame(rows, "id long, job string, label string, text string").withColumn("canonical", L.canonical_udf(model)("text"))
    got = {tuple(r) for r in L.same_look(df, "id", ["job", "label"]).collect()}
    assert got == {(1, 2), (2, 4), (5, 6)}
    assert L.same_look(df.limit(0), "id", ["job"]).count() == 0
    assert {r["text"]: r["canonical"] for r in df.collect()}[None] is None


def test_learn_from_nothing(spark):
    assert L.learn(spark.createDataFrame([], "text string")).canonical("Аli") in ("Ali", "Аli")
