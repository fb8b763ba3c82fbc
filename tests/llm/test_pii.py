import re

import pytest

from veilwright.llm import pii


def found(text):
    return [(f.kind, text[f.start : f.end]) for f in pii.detect(text)]


@pytest.mark.parametrize(
    "text,want",
    [
        ("Yanıtı mailto:ali.x+f@acme.example adresine", [("EMAIL", "ali.x+f@acme.example")]),
        ("tolga41 [at] acme [nokta] example yazın", [("EMAIL", "tolga41 [at] acme [nokta] example")]),
        ("kaan37 @ hizmet.firma.test.", [("EMAIL", "kaan37 @ hizmet.firma.test")]),
        ("Toplu yanıt için @destek etiketi", []),
        ("Tel: +90 (574) 812-9603 (dahili 12)", [("PHONE", "+90 (574) 812-9603")]),
        ("GSM : 0566.072.65.70", [("PHONE", "0566.072.65.70")]),
        ("call +44 7700 900416 now", [("PHONE", "+44 7700 900416")]),
        ("Vergi No: 5321234567, Sipariş 05-537381", []),
        ("TC Kimlik No: 10000000146", [("ID_NUMBER", "10000000146")]),
        ("TC Kimlik No: 10000000147", []),
        ("Kargo takip no 10000000146 ile", []),
        ("IBAN TR33 0006 1005 1978 6457 8413 26 idi", []),
        ("pasaport no Z4348806, uçuş", [("ID_NUMBER", "Z4348806")]),
        ("Evi Taş Cad. 51/C, Sarıyamaç, işi ise", [("ADDRESS", "Taş Cad. 51/C, Sarıyamaç")]),
        ("Adres : TAŞ MAH. ESKİ SK. NO:51 D:26 ÇINARTEPE\n", [("ADDRESS", "TAŞ MAH. ESKİ SK. NO:51 D:26 ÇINARTEPE")]),
        ("goes to 33 Quarry Street, Brackford BX7 7QZ.", [("ADDRESS", "33 Quarry Street, Brackford BX7 7QZ")]),
        ("geht an Lindenhofweg 178, 09018 Tannau.", [("ADDRESS", "Lindenhofweg 178, 09018 Tannau")]),
        ("Söğütlü Caddesi'nde yol çalışması", []),
        ("Tanık Şule Kanamuttaş ifadesinde", [("PERSON", "Şule Kanamuttaş")]),
        ("Dr. emre sevnebaltepe raporu", [("PERSON", "emre sevnebaltepe")]),
        ("Sayın Yeldenlolı, talebiniz", [("PERSON", "Yeldenlolı")]),
        ("Mert Hanım aradı", [("PERSON", "Mert")]),
        ("Çetin Tuğyorbaltaş'ın dosyası", [("PERSON", "Çetin Tuğyorbaltaş")]),
        ("Av. Kestuğçodağ, Çağla Yanıtı bekliyor", [("PERSON", "Kestuğçodağ, Çağla")]),
        ("Saygılarımla,\nE. Gerlofisoy\n", [("PERSON", "E. Gerlofisoy")]),
        ("Deniz seviyesi, Barış Mahallesi, umut verici; Demir Yufimutkan Çelik A.Ş.", []),
        ("", []),
    ],
)
def test_detect(text, want):
    assert found(text) == want


DOC = "Kefil Emre Sevnebaltepe, Taş Cad. 9/A, Bağarası adresinde. E. Sevnebaltepe: 10000000146, 0532 123 45 67. EMRE SEVNEBALTEPE ve Ayşe Kordağ (ayse@acme.example)."


def test_placeholders_keep_everything_else():
    out = pii.placeholders(DOC)
    assert out == "Kefil [PERSON_1], [ADDRESS_1] adresinde. [PERSON_1]: [ID_NUMBER_1], [PHONE_1]. [PERSON_1] ve [PERSON_2] ([EMAIL_1])."


def test_surrogates_beyond_the_pools():
    """More lone surnames, given names and one-letter addresses than the pools hold stay different and new."""
    names = [f"Soyad{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(60)]
    mails = [f"{chr(97 + i % 26)}@{'xy'[i // 26]}.com" for i in range(40)]
    text = " ".join([*names, *mails, "kaya demir"])
    at = [(text.index(t), t) for t in [*names, *mails]]
    found = [pii.Found("EMAIL" if "@" in t else "PERSON", a, a + len(t)) for a, t in at]
    out = pii.surrogates(text, b"k", found).split()
    fresh = [pii.fold(w) for w in out[:-2]]
    assert len(set(fresh)) == 100 and not {"kaya", "demir"} & set(fresh) and out[-2:] == ["kaya", "demir"]


def test_surrogates():
    out = pii.surrogates(DOC, b"k")
    assert out == pii.surrogates(DOC, b"k") != pii.surrogates(DOC, b"other")
    old, new = pii.detect(DOC), re.split(r", ", out)
    assert new and not any(DOC[f.start : f.end] in out for f in old)
    got = found(out)
    assert [k for k, _ in got] == [k for k, _ in found(DOC)]
    number = next(v for k, v in got if k == "ID_NUMBER")
    assert pii.tc_valid(number)
    people = [v for k, v in got if k == "PERSON"]
    assert people[1].split()[-1] == people[0].split()[-1] and people[2].isupper() and people[3] != people[0]
    assert pii._GENDER[pii.fold(people[0].split()[0])] == "m" and pii._GENDER[pii.fold(people[3].split()[0])] == "f"


def test_tables(spark):
    rows = [(1, DOC, "a"), (1, DOC, "a"), (2, None, "b"), (3, "", "c"), (4, "x " * 50_000 + "Tanık Ali Kordağ", "d")]
    df = spark.createDataFrame(rows, "id long, text string, pii_type string")
    rows = pii.replace_table(df, ["id"], "text", "k")
    spans = rows.distinct()
    assert {r["placeholder"] for r in rows.where("id = 1").collect()} >= {"[PERSON_1]", "[EMAIL_1]"} and rows.where("surrogate is null").count() == 0
    assert spans.where("id = 1").count() == len(pii.detect(DOC)) and spans.where("id = 4").first()["start_pos"] == 100_006
    masked = {r["id"]: r for r in pii.mask_table(df, ["id"], "text", "k").collect()}
    assert masked[2]["masked"] is None and masked[3]["masked"] == "" and masked[4]["occurrences"] == 1
    assert pii.replace_table(df.limit(0), ["id"], "text", "k").count() == 0


def test_many_people_stay_apart_in_linear_time():
    import time

    names = [f"Ali Soyad{chr(97 + i // 676)}{chr(97 + i // 26 % 26)}{chr(97 + i % 26)}" for i in range(5000)]
    text, at, spans = ". ".join(names), 0, []
    for n in names:
        at = text.index(n, at)
        spans.append(pii.Found("PERSON", at, at + len(n)))
    began = time.time()
    made = pii.drawn(text, b"k", spans)
    assert len(set(made)) == 5000 and not set(made) & set(names) and time.time() - began < 30


def test_ambiguous_mentions_are_entities_of_their_own():
    text = "Tanık Ali Kordağ, Tanık Ayşe Kordağ, A. Kordağ, Sayın Kordağ. Tanık Can Demirsoy, C. Demirsoy, Sayın Demirsoy."
    assert pii.placeholders(text) == "Tanık [PERSON_1], Tanık [PERSON_2], [PERSON_3], Sayın [PERSON_4]. Tanık [PERSON_5], [PERSON_5], Sayın [PERSON_5]."


@pytest.mark.parametrize("text,want", [("Call (020) 7946 0958 or 020 7946 0958.", ["(020) 7946 0958", "020 7946 0958"]), ("His SSN is 123456789, passport no. 987654321.", ["123456789", "987654321"]), ("Order 123456789 shipped.", [])])
def test_numbers_in_other_forms(text, want):
    assert [t for _, t in found(text)] == want


def test_model_finds_names_outside_the_lists(spark):
    """Fitted on names of the lists in some surroundings, it finds names that no list has there and in plain sentences."""
    import random

    r = random.Random(2)
    word = lambda: "".join(r.choice("bdklmnrst") + r.choice("aeio") for _ in range(3)).capitalize()
    given = (pii.FEMALE + " " + pii.MALE).split()
    frames = ["Dün {} ofise geldi.", "The letter of {} was read.", "Toplantıyı {} yönetti.", "Beide Parteien erhalten {} heute.", "We met {} again."]
    texts = [(i, r.choice(frames).format(f"{r.choice(given)} {word()}") + " Genel Kurul toplandı. Proje Ofisi kapalı. Am Montag war Ruhe.") for i in range(400)]
    model = pii.fit_names(spark.createDataFrame(texts, "id long, text string"), "text")
    for name in ("Priya Natarajan", "Oluwaseun Adeyemi", "Zoltán Kovács", "Haluk Yıldırım", "Greta Lindqvist"):
        text = f"The letter of {name} was read. Genel Kurul toplandı."
        assert [text[f.start : f.end] for f in pii.detect(text, model)] == [name]
        assert pii.detect(text) == []
    assert pii.detect("", model) == [] and pii.fit_names(spark.createDataFrame([], "id long, text string"), "text").probabilities([]) == []
