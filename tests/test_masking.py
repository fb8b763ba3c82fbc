import re

import pytest
from pyspark.sql import functions as F

from veilwright.functions import presentation as P
from veilwright.functions import spans as S
from veilwright.functions import validators as V
from veilwright.functions.registry import PATTERNS
from veilwright.operators import detect, gazetteer, masking, ner
from veilwright.plans import text_queries


def one(spark, text, expr):
    return spark.createDataFrame([(text,)], "text string").select(expr.alias("x")).first()["x"]


CHECKSUMS = [
        ("tc_kimlik", "10000000146", True),
        ("tc_kimlik", "100 000 001-46", True),
        ("tc_kimlik", "10000000147", False),
        ("tc_kimlik", "00000000146", False),
        ("tc_kimlik", "abc", False),
        ("iban_tr", "TR330006100519786457841326", True),
        ("iban_tr", "tr33 0006 1005 1978 6457 8413 26", True),
        ("iban_tr", "TR340006100519786457841326", False),
        ("iban_tr", "DE330006100519786457841326", False),
        ("vkn", "1234567890", True),
        ("vkn", "1234567891", False),
        ("vkn", "12345", False),
        ("luhn", "4111 1111 1111 1111", True),
        ("luhn", "4111 1111 1111 1112", False),
        ("luhn", "0000", False),
        ("plate", "34 ABC 123", True),
        ("plate", "82 ABC 123", False),
]


def test_validators(spark):
    df = spark.createDataFrame(CHECKSUMS, "name string, text string, ok boolean")
    got = df.select("*", *[v("text").alias(f"is_{n}") for n, v in V.VALIDATORS.items()]).collect()
    for r in got:
        assert r[f"is_{r['name']}"] is r["ok"], r
    assert spark.createDataFrame([(None,)], "text string").select(V.iban_tr("text").alias("x")).first()["x"] is None


SURFACES = [
        ("Kimlik 10000000146 ile", [("TC_No", "10000000146")]),
        ("T.C. Kimlik No: 12345678901", [("TC_No", "12345678901")]),
        ("TR33 0006 1005 1978 6457 8413 26", [("IBAN", "TR33 0006 1005 1978 6457 8413 26")]),
        ("kart 4111 1111 1111 1111", [("Card_No", "4111 1111 1111 1111")]),
        ("Vergi No: 9876543219", [("Tax_No", "9876543219")]),
        ("a.b@c.com'a", [("Email", "a.b@c.com")]),
        ("+90 532 123 45 67", [("Phone_No", "+90 532 123 45 67")]),
        ("34 ABC 123 plakalı", [("License_Plate", "34 ABC 123")]),
        ("U12345678", [("Passport_No", "U12345678")]),
        ("1.250,50 TL ve $1,000.00", [("Money_Amount", "1.250,50 TL"), ("Money_Amount", "$1,000.00")]),
        ("15.03.2024 ve 3 Ocak 2023", [("Date", "15.03.2024"), ("Date", "3 Ocak 2023")]),
        ("Esas No: 2023/145", [("Case_No", "2023/145")]),
        ("MÜŞTERİ NO: 123456", [("Customer_No", "123456")]),
        ("Musteri Numarasi 4455667", [("Customer_No", "4455667")]),
        ("SGK Sicil No: 1234567", [("SGK_No", "1234567")]),
        ("Poliçe No: PL-2024/77", [("Policy_No", "PL-2024/77")]),
        ("Sözleşme No: 2024/000123", [("Contract_No", "2024/000123")]),
        ("Fatura No: GIB2024000000123", [("Invoice_No", "GIB2024000000123")]),
        ("Dekont No: ABC-123", [("Reference_No", "ABC-123")]),
        ("Anne Adı: Ayşe Baba Adı: Ali Can", [("Person", "Ayşe"), ("Person", "Ali Can")]),
        ("192.168.1.254 adresi", [("IP_Address", "192.168.1.254")]),
        ("https://x.example/a?b=1 bak", [("URL", "https://x.example/a?b=1")]),
        ("Gül Sokak No: 5/7, Kat: 2, Kadıköy / İstanbul", [("Address", "Gül Sokak No: 5/7, Kat: 2, Kadıköy / İstanbul")]),
        ("hiçbir şey yok", []),
        ("", []),
]


def test_patterns(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(SURFACES)], "i int, text string")
    got = {r["i"]: [(s["label"], s["text"]) for s in r["s"]] for r in df.select("i", detect.detect("text").alias("s")).collect()}
    assert [(t, got[i]) for i, (t, _) in enumerate(SURFACES)] == SURFACES


def test_offsets_equal_python(spark):
    text = "🙂 a@b.co 10.0.0.1 İstanbul 05321234567 12.01.2020 2020/12345 TR330006100519786457841326 €5 " * 3
    cols = [S.matches("text", S.java(p.regex, p.ignore_case), p.group).alias(p.id) for p in PATTERNS]
    got = spark.createDataFrame([(text,)], "text string").select(*cols).first()
    for p in PATTERNS:
        want = [m.span(p.group) for m in re.finditer(p.regex, text, re.I if p.ignore_case else 0)]
        assert [(h["start"], h["end"]) for h in got[p.id]] == want


SPANS = "start int, end int, label string, source string, confidence double, text string, canonical_id string"


def spans_of(rows):
    return [(a, b, lab, src, conf, t, None) for a, b, lab, src, conf, t in rows]


def resolved(spark, rows, fn):
    df = spark.createDataFrame([(spans_of(rows),)], f"s {S.SPANS}")
    return [(x["start"], x["end"], x["label"], x["source"]) for x in df.select(fn(F.col("s")).alias("x")).first()["x"]]


def test_overlaps(spark):
    rows = [(0, 4, "A", "regex", 0.9, "x"), (2, 9, "B", "regex", 0.5, "x"), (9, 12, "C", "regex", 0.9, "x"), (9, 12, "D", "regex", 0.9, "x"), (9, 12, "E", "regex", 0.95, "x")]
    assert resolved(spark, rows, detect.without_overlaps) == [(2, 9, "B", "regex"), (9, 12, "E", "regex")]


def test_merge_dominance(spark):
    rows = [(0, 5, "TC_No", "regex", 0.8, "x"), (0, 9, "Company", "ner", 0.99, "y"), (20, 25, "Person", "ner", 0.8, "z"), (20, 25, "Person", "gazetteer", 0.8, "z")]
    pick = lambda s: detect.merge(F.filter(s, lambda x: x["source"] == "regex"), F.filter(s, lambda x: x["source"] == "ner"), F.filter(s, lambda x: x["source"] == "gazetteer"))
    assert resolved(spark, rows, pick) == [(0, 5, "TC_No", "regex"), (20, 25, "Person", "gazetteer")]


def test_gazetteer(spark):
    text = "Ankara'da yazıldı. Mavi Ada Teknoloji A.Ş. ile Ahmet Yılmaz. İstanbul 3. Asliye Mahkemesi, Ahmet Holding."
    got = [(s["label"], s["text"]) for s in one(spark, text, gazetteer.detect("text"))]
    assert ("Company", "Mavi Ada Teknoloji A.Ş.") in got and ("Person", "Ahmet Yılmaz") in got and ("Location", "Ankara") in got
    assert ("Location", "İstanbul") not in got and ("Person", "Ahmet Holding") not in got


def test_institution(spark):
    rows = [("Ankara 5. İcra Müdürlüğü", True), ("Noterler Birliği", True), ("Yılmaz Tekstil", False), ("Bakanlığı.", False)]
    df = spark.createDataFrame(rows, "text string, ok boolean").select("ok", gazetteer.is_institution(F.col("text")).alias("x"))
    assert all(r["x"] is r["ok"] for r in df.collect())


NER = [
    ("Ahmet Yılmaz'ın evi", {"Ahmet Yılmaz'ın": "PER"}, ["Ahmet Yılmaz"]),
    ("Garanti Bankası Gizlilik Politikası", {"Garanti Bankası Gizlilik Politikası": "ORG"}, ["Garanti Bankası"]),
    ("Davranış İlkeleri belgesi", {"Davranış İlkeleri": "ORG"}, []),
    ("Şirketi ve Twitter", {"Şirketi": "ORG", "Twitter": "ORG"}, []),
    ("6698 sayılı Kişisel Verilerin Korunması Kanunu gereği", {"Kişisel Verilerin Korunması": "ORG"}, []),
    ("İş Sağlığı Yönetmeliği", {"İş Sağlığı Yönetmeliği": "ORG"}, []),
    ("Ali Kaya Kanunu bilir", {"Ali Kaya": "PER"}, ["Ali Kaya"]),
    ("12-34 ve ABC", {"12-34": "LOC", "ABC": "ORG"}, []),
    ("Yılmazlar geldi", {"Yılmaz": "PER"}, ["Yılmazlar"]),
]


def test_model_filters(spark):
    rows = [(t, [(t.index(s), t.index(s) + len(s), g, 0.95) for s, g in e.items()]) for t, e, _ in NER]
    df = spark.createDataFrame(rows, f"text string, raw {ner.RAW}")
    got = df.select("text", ner.filtered("text", F.col("raw")).alias("s")).collect()
    assert [(r["text"], [x["text"] for x in r["s"]]) for r in got] == [(t, w) for t, _, w in NER]
    low = spark.createDataFrame([("Ali Kaya, Xyzt", [(0, 8, "PER", 0.69), (10, 14, "ORG", 0.75), (0, 8, "MISC", 0.99)])], f"text string, raw {ner.RAW}")
    assert low.select(ner.filtered("text", F.col("raw")).alias("s")).first()["s"] == []


def test_windows(spark):
    text = " ".join(f"w{i}" for i in range(1000))
    got = one(spark, text, ner.token_windows("text"))
    assert got[0]["core_start"] == 0 and got[-1]["core_end"] == len(text) and all(a["core_end"] == b["core_start"] for a, b in zip(got, got[1:]))
    assert len(one(spark, "a b c", ner.token_windows("text"))) == 1 and len(one(spark, "x" * 2000, ner.char_windows("text"))) == 3
    df = spark.createDataFrame([(1, text + " Ahmet")], "id int, text string")
    out = ner.windowed(df, "id", "text", lambda t: ner.dictionary_model(t, {"w500": "PER", "Ahmet": "PER"})).first()["raw"]
    assert [(r["start"], text[r["start"] : r["end"]]) for r in out] == [(text.index("w500"), "w500"), (len(text) + 1, "")]


def run(spark, text, **kw):
    df = spark.createDataFrame([("j", text, kw.pop("wanted", None))], "job_id string, text string, wanted array<struct<text:string,label:string>>")
    return masking.mask(df, "text", masking.Settings(**kw)).first()


DOC = "Ahmet Yılmaz (TC 10000000146) Ankara'da. AHMET: a@b.co, a@b.co ve c@d.co; Ahmet Yılmaz onayladı."


def test_mask(spark):
    r = run(spark, DOC)
    assert r["masked_text"] == "{Person_1} (TC {TC_No_1}) {Location_1}'da. AHMET: {Email_1}, {Email_1} ve {Email_2}; {Person_1} onayladı."
    assert r["mapping"] == {"{Person_1}": "Ahmet Yılmaz", "{TC_No_1}": "10000000146", "{Location_1}": "Ankara", "{Email_1}": "a@b.co", "{Email_2}": "c@d.co"}


def test_policy_and_manual(spark):
    r = run(spark, DOC, disabled=["Email", "Person"], wanted=[("onayladı", "Custom"), ("  ", "Custom"), ("c@d.co", "Email")], manual="wanted")
    assert r["masked_text"].endswith("a@b.co ve {Email_1}; Ahmet Yılmaz {Custom_1}.") and len([s for s in r["spans"] if s["label"] == "Email"]) == 3
    assert run(spark, DOC, mode="regex")["masked_text"].startswith("Ahmet Yılmaz (TC {TC_No_1})")
    assert run(spark, DOC, mode="ner", entries={"Ahmet Yılmaz": "PER"})["masked_text"].count("{Person_1}") == 2
    with pytest.raises(ValueError):
        run(spark, DOC, mode="other")


def test_aliases_and_coreference(spark):
    text = 'Deniz Hava Bankası A.Ş. (bundan böyle "Banka" olarak anılacaktır) ve Kuzey Lojistik (kısaca "Kuzey Grup").'
    assert set(one(spark, text, masking.aliases("text"))) == {"BANKA", "KUZEY GRUP"}
    d = one(spark, text, masking.definers("text", gazetteer.detect("text")))
    assert [(x["alias"], x["definer"]) for x in d] == [("Banka", "Deniz Hava Bankası A.Ş.")]
    r = run(spark, "Melis Kara geldi. Sonra Melis Kara gitti.", mode="ner", entries={"Melis Kara": "PER"})
    assert len(r["spans"]) == 2


def test_fuzzy(spark):
    r = run(spark, "Ahmet Yılmaz ve Ahmet Can Yılmaz", mode="ner", entries={"Ahmet Yılmaz": "PER", "Ahmet Can Yılmaz": "PER"}, fuzzy=True)
    assert r["masked_text"] == "{Person_1} ve {Person_1}"


def test_fuzzy_chain(spark):
    """Names that overlap only with their neighbours are one entity, however long the chain and whatever the order."""
    names = [f"A{i}x A{i + 1}x" for i in range(12)]
    for order in (names, names[::-1], names[::2] + names[1::2]):
        spans = [(0, 1, "Person", "ner", 0.9, t, None) for t in [*order, "Başka Biri", "!", order[0]]] + [(0, 1, "Company", "ner", 0.9, names[0], None), (0, 1, "Person", "manual", 1.0, names[0], "m")]
        df = spark.createDataFrame([(spans,), ([],)], f"s {S.SPANS}")
        ids = [[x["canonical_id"] for x in r["g"]] for r in df.select(masking.fuzzy_groups(F.col("s")).alias("g")).collect()]
        assert ids[0] == ["Person::a11x a12x"] * 12 + ["Person::başka biri", "Person::!", "Person::a11x a12x", "Company::a0x a1x", "m"] and ids[1] == []


@pytest.mark.parametrize("masked,known,want", [("{A_1} {A_10} {B_1}", {"{A_1}": "x", "{A_10}": "y$1"}, "x y$1 {B_1}"), ("{A_1}", {}, "{A_1}"), ("", {"{A_1}": "x"}, "")])
def test_unmask(spark, masked, known, want):
    df = spark.createDataFrame([(masked, known)], "m string, k map<string,string>")
    assert df.select(masking.unmask("m", F.col("k")).alias("x")).first()["x"] == want


def test_round_trip(spark):
    texts = [DOC, "", "🙂 x@y.zz\n05321234567 " * 20, None]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    rows = masking.mask(df).select("text", "masked_text", masking.unmask("masked_text", F.col("mapping")).alias("x")).collect()
    assert [r["x"] for r in rows] == [r["text"] for r in rows] and {r["masked_text"] for r in rows if r["text"] is None} == {None}


def test_presentation(spark):
    assert [p["start"] for p in one(spark, "ab\fcd", P.paginated("text"))] == [0, 3]
    long = "\n\n".join("x" * 500 for _ in range(4))
    assert [(len(p["text"]), p["start"]) for p in one(spark, long, P.paginated("text"))] == [(1002, 0), (1002, 1004)]
    seg = one(spark, "a b@c.de f", P.segments("text", detect.detect("text")))
    assert [(s["kind"], s["text"]) for s in seg] == [("plain", "a "), ("span", "b@c.de"), ("plain", " f")]
    assert one(spark, "x" * 150 + "ABC", P.context("text", F.lit(150), F.lit(153))) == "…" + "x" * 100 + "ABC"
    assert one(spark, "{A_1} {b} {C_d_2}", P.placeholders_in("text")) == ["{A_1}", "{C_d_2}"]


def test_round_trip_query_keeps_all(spark, tmp_path):
    """Texts in which an entity has several surfaces are rows too; each mention comes back as the surface that was kept."""
    spark.createDataFrame([(1, "Yaz: a@x.com", None, None), (2, "A@x.com ve a@x.com", None, None)], "call_id long, text string, original_text string, manual_spans array<struct<text:string,label:string>>").write.parquet(f"{tmp_path}/mask_calls.parquet")
    spark.createDataFrame([("d", "düz [metin]")], "doc_id string, text string").write.parquet(f"{tmp_path}/gold_docs.parquet")
    got = {r["record_id"]: r["holds"] for r in text_queries.QUERIES["U01_round_trip"](spark, str(tmp_path)).collect()}
    assert got == {"1": True, "2": True, "d": True}
    out = masking.mask(spark.createDataFrame([("A@x.com ve a@x.com",)], "text string"), "text", masking.Settings(mode="regex"))
    assert out.select(masking.unmask("masked_text", F.col("mapping")).alias("r")).first()["r"] == "A@x.com ve A@x.com"


def greedy_brute(spans):
    """Reference: longer first, then more confident, then input order."""
    kept = []
    for i, (a, b, c) in sorted(enumerate(spans), key=lambda x: (-(x[1][1] - x[1][0]), -x[1][2], x[0])):
        if all(b <= x or y <= a for x, y, _ in kept):
            kept.append((a, b, c))
    return sorted(kept)


def test_overlaps_equal_brute_force(spark):
    import random

    from veilwright.functions import spans as S
    from veilwright.operators import detect

    r = random.Random(5)
    lists = [[(a, a + r.randint(1, 9), r.choice([0.5, 0.8])) for a in (r.randint(0, n * 4) for _ in range(n))] for n in (0, 1, 3, 40, 700)]
    rows = [(i, [(a, b, "Person", "regex", c, f"{a}-{b}", None) for a, b, c in spans]) for i, spans in enumerate(lists)] + [(9, None)]
    got = {x["i"]: x["kept"] for x in spark.createDataFrame(rows, f"i int, spans {S.SPANS}").select("i", detect.without_overlaps(F.col("spans")).alias("kept")).collect()}
    for i, spans in enumerate(lists):
        assert [(s["start"], s["end"], s["confidence"]) for s in got[i]] == greedy_brute(spans)
    assert got[9] is None


def test_many_spans_in_one_text(spark):
    """Numbering, mapping and substitution over blocks: a text with thousands of spans."""
    from veilwright.operators import masking

    text = "".join(f"a{i % 700}@x.example, 2024-02-{1 + i % 28:02d} 🙂\n" for i in range(1500))
    row = masking.mask(spark.createDataFrame([(text,)], "text string"), "text", masking.Settings(mode="regex")).first()
    number, out = {}, text
    for i in range(1500):
        number.setdefault(f"a{i % 700}@x.example", len(number) + 1)
    days = {}
    for i in range(1500):
        days.setdefault(f"2024-02-{1 + i % 28:02d}", len(days) + 1)
    want = "".join(f"{{Email_{number[f'a{i % 700}@x.example']}}}, {{Date_{days[f'2024-02-{1 + i % 28:02d}']}}} 🙂\n" for i in range(1500))
    assert row["masked_text"] == want and len(row["spans"]) == 3000 and len(row["mapping"]) == 728
    assert row["mapping"]["{Email_700}"] == "a699@x.example"


def test_alias_links_in_the_plan(spark):
    from veilwright.operators import masking

    text = 'Arven Yapı Gıda (bundan böyle "Arven" olarak anılacaktır) ve Arven Lojistik'
    df = spark.createDataFrame([(text,)], "text string")
    entries = {"Arven Yapı Gıda": "ORG", "Arven Lojistik": "ORG"}
    run = lambda **kw: masking.mask(df, "text", masking.Settings(mode="ner", entries=entries, **kw)).first()["masked_text"]
    assert run().count("{Company_1}") == 1 and run(alias_links=True).count("{Company_1}") == 2
