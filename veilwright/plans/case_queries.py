"""Queries over written cases, with the expected rows stated literally in SQL.

Each case stands behind the name of every row of ``nation``, so that offsets differ from row to row. In a case
``‹ ›`` marks what must be found; places in the text follow from the marks. No expression of an operator is repeated
in its SQL.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilwright.functions import presentation as P
from veilwright.functions import spans as S
from veilwright.functions.registry import PATTERNS
from veilwright.operators import detect, evaluate, gazetteer, masking, ner
from veilwright.runtime import table

SEP = "\n"
_MARK = re.compile("‹([^›]*)›")


def parsed(marked: str) -> tuple[str, list[tuple[int, int, str]]]:
    """Text without marks and the places that they mark."""
    out, found = "", []
    at = 0
    for m in _MARK.finditer(marked):
        out += marked[at : m.start()]
        found.append((len(out), len(out) + len(m[1]), m[1]))
        out += m[1]
        at = m.end()
    return out + marked[at:], found


def _lit(v: object) -> Column:
    if isinstance(v, list):
        return F.array(*map(_lit, v))
    if isinstance(v, dict):
        return F.struct(*[_lit(x).alias(k) for k, x in v.items()])
    return F.lit(v)


def over_nations(spark: SparkSession, sf_dir: str, rows: list[dict], cast: dict[str, str] | None = None) -> DataFrame:
    """``n_nationkey, head, case_no`` and the columns of ``rows``, every case for every nation; ``text`` comes behind ``head``."""
    cases = F.array(*[F.struct(F.lit(i).alias("case_no"), *[(_lit(v).cast(cast[k]) if cast and k in cast else _lit(v)).alias(k) for k, v in r.items()]) for i, r in enumerate(rows)])
    head = F.concat("n_name", F.lit(SEP))
    out = table(spark, sf_dir, "nation").select("n_nationkey", head.alias("head"), F.explode(cases).alias("c")).select("n_nationkey", "head", "c.*")
    return out.withColumn("text", F.concat("head", "text")) if "text" in out.columns else out


def quoted(v: object) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, (int, float)):
        return repr(v)
    parts = [f"'{p}'" for p in str(v).replace("'", "''").split("\n")]
    return " || chr(10) || ".join(parts)


def sql_rows(columns: dict[str, str], rows: list[tuple], shifted: tuple[str, ...] = (), headed: tuple[str, ...] = ()) -> str:
    """Literal rows for every nation: ``columns`` with types; ``shifted`` are places, ``headed`` texts behind the head."""

    def one(c: str, kind: str) -> str:
        if c in shifted:
            return f"CAST({c}_ + length(n_name) + {len(SEP)} AS INT) AS {c}"
        if c in headed:
            return f"n_name || chr(10) || {c}_ AS {c}"
        return f"CAST({c}_ AS {kind}) AS {c}"

    named = {c: f'"{c}"' if c in ("start", "end") else c for c in columns}
    made = ", ".join(one(c, k).replace(f" AS {c}", f" AS {named[c]}") for c, k in columns.items())
    if not rows:
        return f"SELECT n_nationkey, {made} FROM nation, (SELECT {', '.join(f'CAST(NULL AS {k}) AS {c}_' for c, k in columns.items())}) v WHERE false"
    values = ", ".join("(" + ", ".join(quoted(v) for v in r) + ")" for r in rows)
    return f"SELECT n_nationkey, {made} FROM nation, (VALUES {values}) v({', '.join(f'{c}_' for c in columns)})"


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

# -- the thirty patterns

PATTERN_CASES = {
    "R01": ["No ‹10000000146› bitti", "No 10000000147 bitti", "No 110000000146 bitti", "‹10000000146›"],
    "R02": ["TCKN: ‹12345678901› son", "T.C. Kimlik No: ‹12345678901›", "TCKN: 02345678901"],
    "R03": ["IBAN ‹TR33 0006 1005 1978 6457 8413 26› son", "‹tr330006100519786457841326›", "TR34 0006 1005 1978 6457 8413 26"],
    "R04": ["‹TR34 0006 1005 1978 6457 8413› 26", "TR34 0006 1005 1978 6457"],
    "R05": ["Kart ‹4111 1111 1111 1111› son", "‹4111-1111-1111-1111›", "Kart 4111 1111 1111 1112 son"],
    "R06": ["VKN ‹1234567890› son", "VKN 1234567891 son"],
    "R07": ["Vergi No: ‹2234567890›", "Vergi Kimlik No ‹2234567890›.", "Vergi No: 223456789"],
    "R08": ["MERSİS No: ‹0123-4567-8901-2345›", "MERSİS No: 0123-4567"],
    "R09": ["Posta ‹ali.v@ornek.example› yaz, ‹x@y.co›", "ali@ornek yok"],
    "R10": ["Tel ‹+90 532 123 45 67›, ‹05321234567›", "Tel 0632 123 45 67"],
    "R11": ["Araç ‹34 ABC 123› ve ‹06AB1234› geldi", "82 ABC 123 yok"],
    "R12": ["Pasaport ‹U12345678› var", "U123456 yok"],
    "R13": ["Bedel ‹1.500,25 TL› oldu", "Bedel ‹₺250›", "250 adet"],
    "R14": ["Price ‹$1,500.25› now", "‹300 EUR› now", "300 adet"],
    "R15": ["Gün ‹01.02.2024› ve ‹2024-02-01›", "Gün 1.2.2024"],
    "R16": ["Gün ‹5 Mart 2024› idi", "Gün 5 Mert 2024 idi"],
    "R17": ["Esas No: ‹2024/123› ve Karar No ‹2024/9›", "Esas No: 24-123"],
    "R18": ["Dosya ‹2024/12345› burada", "Dosya 2024/123 burada"],
    "R19": ["Müşteri No: ‹123456›", "Müşteri No: 123"],
    "R20": ["SGK Sicil No: ‹123456789›", "SGK No: 12345"],
    "R21": ["Poliçe No: ‹AB-12345›", "Poliçe No: AB"],
    "R22": ["Sözleşme No: ‹SZ/2024-1›", "Sözleşme No: A1"],
    "R23": ["Fatura No: ‹FTR2024001›", "Fatura No: F1"],
    "R24": ["Referans No: ‹REF-99› Dekont No ‹D1234›", "Referans No: R"],
    "R25": ["Anne Adı: ‹Fatma Şahin›; Baba Adı: ‹Kemal›.", "Dede Adı: Kemal"],
    "R26": ["‹Hesap: 1234 5678 9012›.", "Hesap: 1234."],
    "R27": ["Kod ‹TGBATRIS› ve ‹AKBKTRISXXX›", "Kod TGBADEIS"],
    "R28": ["Sunucu ‹10.0.0.1› ve ‹192.168.1.254›", "Sürüm 10.300.0.1"],
    "R29": ["Bkz ‹https://ornek.example/a?b=1› son", "Bkz ftp://ornek.example"],
    "R30": ["Adres:\n‹Lale Sokak No: 12/3 Kat: 2›\nson", "Lale Sokak 12"],
}


def _pattern_cases(spark: SparkSession, sf_dir: str, pattern) -> DataFrame:
    df = over_nations(spark, sf_dir, [{"text": parsed(t)[0]} for t in PATTERN_CASES[pattern.id]])
    return df.select("n_nationkey", "case_no", F.explode(detect.detect_one("text", pattern)).alias("s")).select("n_nationkey", "case_no", "s.start", "s.end", "s.label", "s.confidence", F.col("s.text").alias("surface"))


_FOUND = {"case_no": "INT", "start": "INT", "end": "INT", "label": "VARCHAR", "confidence": "DOUBLE", "surface": "VARCHAR"}
for _p in PATTERNS:
    _name = f"{_p.id}_{_p.label.lower()}_cases"
    QUERIES[_name] = partial(_pattern_cases, pattern=_p)
    SQL[_name] = sql_rows(_FOUND, [(i, a, b, _p.label, _p.confidence, s) for i, t in enumerate(PATTERN_CASES[_p.id]) for a, b, s in parsed(t)[1]], ("start", "end"))

# -- dictionary detectors

GAZETTEER_CASES = {
    "G01_company_cases": ("Company", 0.90, gazetteer.companies, ["bizim ‹Arven Lojistik A.Ş.› ile", "bizim ‹Doruk Holding›, öte ‹Kuzey ve Yapı Ltd. Şti.› ile", "bizim Arven Lojistik ile", "bizim Türkiye Noterler Birliği A.Ş. ile"]),
    "G02_person_cases": ("Person", 0.80, gazetteer.persons, ["dün ‹Ahmet Yılmaz› geldi", "dün ‹Zeynep Kara›, ‹Ali Koç› geldi", "dün Ahmet Holding geldi", "dün Zork Yılmaz geldi"]),
    "G03_location_cases": ("Location", 0.85, gazetteer.places, ["yeri ‹Ankara› olan", "‹Kadıköy› ve ‹Bursa› için", "yeri Ankara Belediyesi olan", "yeri Zorkent olan"]),
}


def _gazetteer_cases(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    _, _, find, cases = GAZETTEER_CASES[name]
    df = over_nations(spark, sf_dir, [{"text": parsed(t)[0]} for t in cases])
    return df.select("n_nationkey", "case_no", F.explode(find("text")).alias("s")).select("n_nationkey", "case_no", "s.start", "s.end", "s.label", "s.confidence", F.col("s.text").alias("surface"))


for _name, (_label, _conf, _, _cases) in GAZETTEER_CASES.items():
    QUERIES[_name] = partial(_gazetteer_cases, name=_name)
    SQL[_name] = sql_rows(_FOUND, [(i, a, b, _label, _conf, s) for i, t in enumerate(_cases) for a, b, s in parsed(t)[1]], ("start", "end"))

# -- filters behind a model: text, what the model says (surface, group, score), what is left (surface, label, confidence)

MODEL_CASES = {
    "N05_label_map": [("dün Ahmet Kaya ile Ankara ve Arven Yapı için xyzt", [("Ahmet Kaya", "PER", 0.95), ("Ankara", "LOC", 0.9), ("Arven Yapı", "ORG", 0.9), ("xyzt", "MISC", 0.99)], [("Ahmet Kaya", "Person", 0.95), ("Ankara", "Location", 0.9), ("Arven Yapı", "Company", 0.9)])],
    "N06_common_floor": [("dün Ahmet Kaya ile Veli Can", [("Ahmet Kaya", "PER", 0.69), ("Veli Can", "PER", 0.7)], [("Veli Can", "Person", 0.7)])],
    "N08_apostrophe": [("dün Ahmet'in evi", [("Ahmet'in", "PER", 0.9)], [("Ahmet", "Person", 0.9)]), ("dün Ankara’nın yolu", [("Ankara’nın", "LOC", 0.9)], [("Ankara", "Location", 0.9)])],
    "N09_word_snap": [("dün Ahmet geldi", [("hme", "PER", 0.9)], [("Ahmet", "Person", 0.9)]), ("ağ " + "Uzun" * 40 + " son", [("nUz", "PER", 0.9)], [("Uzun" * 40, "Person", 0.9)])],
    "N10_one_letter": [("A planı ve Ahmet", [("A", "ORG", 0.95), ("Ahmet", "PER", 0.9)], [("Ahmet", "Person", 0.9)])],
    "N11_tail_trim": [("bu Arven Sözleşmesi için", [("Arven Sözleşmesi", "ORG", 0.9)], [("Arven", "Company", 0.9)]), ("bu Arven Raporu için", [("Arven Raporu", "PER", 0.9)], [("Arven Raporu", "Person", 0.9)])],
    "N12_blocklist": [("bu SÖZLEŞME ve Bankası ile Arven", [("SÖZLEŞME", "ORG", 0.95), ("Bankası", "ORG", 0.95), ("Arven", "ORG", 0.9)], [("Arven", "Company", 0.9)])],
    "N13_citation_zones": [("5411 sayılı Bankacılık Kanunu uyarınca Arven", [("Bankacılık", "PER", 0.95), ("Arven", "ORG", 0.9)], [("Arven", "Company", 0.9)])],
    "N14_law_inside": [("bu Borçlar Kanunu ile Arven", [("Borçlar Kanunu", "PER", 0.95), ("Arven", "ORG", 0.9)], [("Arven", "Company", 0.9)])],
    "N15_law_behind": [("bu Türk Ticaret Kanunu ile", [("Türk Ticaret", "ORG", 0.95)], []), ("bu Türk Ticaret Kanunu ile", [("Türk Ticaret", "PER", 0.95)], [("Türk Ticaret", "Person", 0.95)])],
    "N16_zone_overlap": [("6098 sayılı Türk Borçlar Kanunu, Veli Can", [("Türk", "LOC", 0.95), ("Veli Can", "PER", 0.9)], [("Veli Can", "Person", 0.9)])],
    "N17_number_or_short": [("no 123-456, Ada, Van ve Ege", [("123-456", "ORG", 0.95), ("Ada", "LOC", 0.95), ("Ege", "PER", 0.95)], [("Ege", "Person", 0.95)])],
    "N18_label_floors": [("dün Arven ile Doruk ve Ankara", [("Arven", "ORG", 0.77), ("Doruk", "ORG", 0.78), ("Ankara", "LOC", 0.7)], [("Doruk", "Company", 0.78), ("Ankara", "Location", 0.7)])],
    "N19_emit": [("dün Ahmet ile", [("Ahmet", "PER", 0.912345)], [("Ahmet", "Person", 0.9123)])],
}


def _raw(text: str, said: list[tuple]) -> list[dict]:
    return [{"start": text.index(s), "end": text.index(s) + len(s), "group": g, "score": float(c)} for s, g, c in said]


def _placed(head: Column, raw: Column) -> Column:
    at = F.length(head)
    return F.transform(raw, lambda e: F.struct((e["start"] + at).alias("start"), (e["end"] + at).alias("end"), e["group"].alias("group"), e["score"].alias("score")))


def _model_cases(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = over_nations(spark, sf_dir, [{"text": t, "raw": _raw(t, said)} for t, said, _ in MODEL_CASES[name]], {"raw": ner.RAW})
    spans = ner.filtered("text", _placed(F.col("head"), F.col("raw")))
    return df.select("n_nationkey", "case_no", F.explode(spans).alias("s")).select("n_nationkey", "case_no", "s.start", "s.end", "s.label", "s.confidence", F.col("s.text").alias("surface"))


for _name, _cases in MODEL_CASES.items():
    QUERIES[f"{_name}_cases"] = partial(_model_cases, name=_name)
    SQL[f"{_name}_cases"] = sql_rows(_FOUND, [(i, t.index(s), t.index(s) + len(s), k, c, s) for i, (t, _, left) in enumerate(_cases) for s, k, c in left], ("start", "end"))


def _window_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of four tokens, two of them shared; the nation's name is the first token."""
    df = over_nations(spark, sf_dir, [{"text": "bb cc dd ee ff gg"}, {"text": "bb"}]).where(~F.col("head").contains(" "))
    return df.select("n_nationkey", "case_no", "head", F.posexplode(ner.token_windows("text", 4, 2)).alias("seq", "w")).select("n_nationkey", "case_no", "seq", *[(F.col(f"w.{c}") - F.when(F.col(f"w.{c}") > 0, F.length("head")).otherwise(0)).cast("int").alias(c) for c in ("win_start", "win_end", "core_start", "core_end")])


QUERIES["N02_window_cases"] = _window_cases
_WINDOW = {"case_no": "INT", "seq": "INT", "win_start": "INT", "win_end": "INT", "core_start": "INT", "core_end": "INT"}
SQL["N02_window_cases"] = sql_rows(_WINDOW, [(0, 0, 0, 8, 0, 6), (0, 1, 3, 14, 6, 12), (0, 2, 9, 17, 12, 17), (1, 0, 0, 2, 0, 2)]) + " WHERE NOT contains(n_name, ' ')"


def _char_window_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = over_nations(spark, sf_dir, [{"size": n} for n in (900, 901, 2000)])
    text = F.expr("repeat('x', size)")
    return df.select("n_nationkey", "case_no", F.posexplode(ner.char_windows(text, 900, 180)).alias("seq", "w")).select("n_nationkey", "case_no", "seq", *[F.col(f"w.{c}").cast("int").alias(c) for c in ("win_start", "win_end", "core_start", "core_end")])


QUERIES["N03_char_window_cases"] = _char_window_cases
SQL["N03_char_window_cases"] = sql_rows(_WINDOW, [(0, 0, 0, 900, 0, 900), (1, 0, 0, 900, 0, 810), (1, 1, 720, 901, 810, 901), (2, 0, 0, 900, 0, 810), (2, 1, 720, 1620, 810, 1530), (2, 2, 1440, 2000, 1530, 2000)])

# -- the masking plan: settings, text, raw model output, manual terms, masked text, mapping

_ALIAS = 'Arven Yapı (bundan böyle "Kiracı" olarak anılacaktır) ile Kiracı Ankara Belediyesi'
MASK_CASES: dict[str, tuple[dict, list[tuple]]] = {
    "P02_modes_regex": ({"mode": "regex"}, [("Posta ali@x.example, tel 05321234567, yine ali@x.example", [], [], "Posta {Email_1}, tel {Phone_No_1}, yine {Email_1}", [("Email_1", "ali@x.example"), ("Phone_No_1", "05321234567")])]),
    "P02_modes_ner": ({"mode": "ner"}, [("dün Ahmet Kaya ali@x.example ile", [("Ahmet Kaya", "PER", 0.9)], [], "dün {Person_1} ali@x.example ile", [("Person_1", "Ahmet Kaya")])]),
    "P02_modes_full": ({"mode": "full"}, [("dün Zeynep Kara ile Veli Can ali@x.example", [("Veli Can", "PER", 0.9)], [], "dün {Person_1} ile {Person_2} {Email_1}", [("Email_1", "ali@x.example"), ("Person_1", "Zeynep Kara"), ("Person_2", "Veli Can")])]),
    "P03_exclusion": ({"mode": "ner"}, [(_ALIAS, [("Arven Yapı", "ORG", 0.9), ("Kiracı", "PER", 0.9), ("Ankara Belediyesi", "LOC", 0.9)], [], _ALIAS.replace("Arven Yapı", "{Company_1}"), [("Company_1", "Arven Yapı")])]),
    "P04_manual_terms": ({"mode": "regex"}, [("Proje X ve Proje X, ali@x.example", [], [("Proje X", "Facility"), ("ali@x", "Person"), ("  ", "Person")], "{Facility_1} ve {Facility_1}, {Person_1}.example", [("Facility_1", "Proje X"), ("Person_1", "ali@x")])]),
    "P05_coreference": ({"mode": "ner"}, [("Ahmet Kaya geldi, Ahmet Kaya gitti. Can ve Can", [("Ahmet Kaya", "PER", 0.9), ("Can", "PER", 0.9)], [], "{Person_1} geldi, {Person_1} gitti. {Person_2} ve Can", [("Person_1", "Ahmet Kaya"), ("Person_2", "Can")])]),
    "P06_fuzzy_chain": ({"mode": "ner", "fuzzy": True}, [("Aa Bb; Bb Cc; Cc Dd; Dd Ee; Ee Ff; Ff Gg Hh; Xx Yy", [(n, "PER", 0.8) for n in ("Aa Bb", "Bb Cc", "Cc Dd", "Dd Ee", "Ee Ff", "Ff Gg Hh", "Xx Yy")], [], "{Person_1}; {Person_1}; {Person_1}; {Person_1}; {Person_1}; {Person_1}; {Person_2}", [("Person_1", "Ff Gg Hh"), ("Person_2", "Xx Yy")])]),
    "P09_policy": ({"mode": "regex", "disabled": ["Email"]}, [("ali@x.example 05321234567", [], [("ali@y.example", "Email")], "ali@x.example {Phone_No_1}", [("Phone_No_1", "05321234567")]), ("ali@y.example 05321234567", [], [("ali@y.example", "Email")], "{Email_1} {Phone_No_1}", [("Email_1", "ali@y.example"), ("Phone_No_1", "05321234567")])]),
    "P10_numbering": ({"mode": "regex"}, [("b@x.example a@x.example b@x.example 2024-02-01 c@x.example", [], [], "{Email_1} {Email_2} {Email_1} {Date_1} {Email_3}", [("Date_1", "2024-02-01"), ("Email_1", "b@x.example"), ("Email_2", "a@x.example"), ("Email_3", "c@x.example")])]),
    "P11_mapping": ({"mode": "ner"}, [("Veli Can; Veli  Can; VELİCAN", [("Veli Can", "PER", 0.8), ("Veli  Can", "PER", 0.8)], [], "{Person_1}; {Person_1}; VELİCAN", [("Person_1", "Veli  Can")])]),
    "P12_substitution": ({"mode": "regex"}, [("ali@x.example", [], [], "{Email_1}", [("Email_1", "ali@x.example")]), ("düz yazı", [], [], "düz yazı", []), ("🙂 ali@x.example 🙂", [], [], "🙂 {Email_1} 🙂", [("Email_1", "ali@x.example")])]),
}


def _mask_cases(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    settings, cases = MASK_CASES[name]
    rows = [{"text": t, "raw": _raw(t, said), "wanted": [{"text": a, "label": b} for a, b in terms]} for t, said, terms, _, _ in cases]
    df = over_nations(spark, sf_dir, rows, {"raw": ner.RAW, "wanted": "array<struct<text:string,label:string>>"})
    df = df.withColumn("raw", _placed(F.col("head"), F.col("raw")))
    out = masking.mask(df, "text", masking.Settings(manual="wanted", **settings), raw="raw")
    known = F.array_join(F.array_sort(F.transform(F.map_entries("mapping"), lambda e: F.concat(F.regexp_replace(e["key"], "[{}]", ""), F.lit("="), e["value"]))), ";")
    return out.select("n_nationkey", "case_no", "masked_text", known.alias("mapping"))


for _name, (_, _cases) in MASK_CASES.items():
    QUERIES[f"{_name}_cases"] = partial(_mask_cases, name=_name)
    SQL[f"{_name}_cases"] = sql_rows({"case_no": "INT", "masked_text": "VARCHAR", "mapping": "VARCHAR"}, [(i, m, ";".join(sorted(f"{k}={v}" for k, v in known))) for i, (_, _, _, m, known) in enumerate(_cases)], headed=("masked_text",))


def _cases(name: str, rows: list[dict], make: Callable[[DataFrame], DataFrame], columns: dict[str, str], want: list[tuple], cast: dict[str, str] | None = None, shifted: tuple[str, ...] = (), headed: tuple[str, ...] = ()) -> None:
    QUERIES[name] = lambda spark, sf_dir: make(over_nations(spark, sf_dir, rows, cast))
    SQL[name] = sql_rows(columns, want, shifted, headed)


_BOTH = ["n_nationkey", "case_no"]
_cases(
    "P01_alias_cases",
    [{"text": t} for t in ('Arven (bundan böyle "Kiracı" olarak anılacaktır)', 'kısaca "Arven Grup" denir', 'Doruk ("Satıcı") ile', "bundan böyle Alıcı olarak anılır", "bundan böyle alıcı olarak anılır")],
    lambda df: df.select(*_BOTH, F.explode(masking.aliases("text")).alias("alias")),
    {"case_no": "INT", "alias": "VARCHAR"},
    [(0, "KIRACI"), (1, "ARVEN GRUP"), (2, "SATICI"), (3, "ALICI"), (4, "ALICI")],
)
_cases(
    "P07_alias_linking_cases",
    [{"text": "Arven Yapı Gıda (bundan böyle \"Arven / Şirket\" olarak anılacaktır) ve Arven Lojistik; Doruk"}],
    lambda df: df.select(*_BOTH, F.explode(masking.alias_links("text", _named_spans(("Arven Yapı Gıda", "Arven Lojistik", "Doruk")))).alias("s")).select(*_BOTH, F.col("s.text").alias("surface"), F.col("s.canonical_id").alias("canonical_id")),
    {"case_no": "INT", "surface": "VARCHAR", "canonical_id": "VARCHAR"},
    [(0, "Arven Yapı Gıda", "Company::arven yapı gıda"), (0, "Arven Lojistik", "Company::arven yapı gıda"), (0, "Doruk", None)],
)
_cases(
    "P08_overlap_cases",
    [{"a": a, "b": b} for a, b in (("Arven Yapı", "arven yapı gıda"), ("Arven Yapı", "Doruk Yapı"), ("Arven", "Doruk"), ("...", "Arven"))],
    lambda df: df.select(*_BOTH, masking.overlap_coefficient(masking.entity_tokens(F.col("a")), masking.entity_tokens(F.col("b"))).alias("overlap")),
    {"case_no": "INT", "overlap": "DOUBLE"},
    [(0, 1.0), (1, 0.5), (2, 0.0), (3, 0.0)],
)
_cases(
    "U01_unmask_cases",
    [{"text": t, "known": [{"key": k, "value": v} for k, v in known]} for t, known in (("{Email_1}, {Email_11} ve {Person_9}", [("{Email_1}", "a@x"), ("{Email_11}", "{Email_1}")]), ("{Email_1}", []), ("{Özel_1} $1 \\", [("{Özel_1}", "x$2")]))],
    lambda df: df.select(*_BOTH, masking.unmask("text", F.map_from_entries("known")).alias("restored")),
    {"case_no": "INT", "restored": "VARCHAR"},
    [(0, "a@x, {Email_1} ve {Person_9}"), (1, "{Email_1}"), (2, "x$2 $1 \\")],
    {"known": "array<struct<key:string,value:string>>"},
    headed=("restored",),
)
_cases(
    "E01_markup_cases",
    [{"text": t} for t in ("dün [[Ahmet Kaya|Person]] ile [[a@x|Email]].", "düz [yazı] | burada", "[[x|Date]]")],
    lambda df: df.select(*_BOTH, evaluate.parse_markup("text").alias("m")).select(*_BOTH, F.col("m.text").alias("clean"), F.explode_outer("m.spans").alias("s")).select(*_BOTH, "clean", "s.start", "s.end", "s.label", F.col("s.text").alias("surface")),
    {"case_no": "INT", "clean": "VARCHAR", "start": "INT", "end": "INT", "label": "VARCHAR", "surface": "VARCHAR"},
    [(0, "dün Ahmet Kaya ile a@x.", 4, 14, "Person", "Ahmet Kaya"), (0, "dün Ahmet Kaya ile a@x.", 19, 22, "Email", "a@x"), (1, "düz [yazı] | burada", None, None, None, None), (2, "x", 0, 1, "Date", "x")],
    shifted=("start", "end"),
    headed=("clean",),
)
_cases(
    "F01_page_cases",
    [{"body": t} for t in ("bir\fiki\f", "a" * 700 + "\n\n" + "b" * 400 + "\n\n" + "c" * 200, "")],
    lambda df: df.select(*_BOTH, F.posexplode(P.paginated("body")).alias("page", "p")).select(*_BOTH, "page", "p.start", F.length("p.text").alias("chars")),
    {"case_no": "INT", "page": "INT", "start": "INT", "chars": "INT"},
    [(0, 0, 0, 3), (0, 1, 4, 3), (0, 2, 8, 0), (1, 0, 0, 1102), (1, 1, 1104, 200)],
)
_cases(
    "F02_segment_cases",
    [{"body": t} for t in ("x a@y.co z", "a@y.co", "düz")],
    lambda df: df.select(*_BOTH, F.posexplode(P.segments("body", detect.detect("body"))).alias("seq", "s")).select(*_BOTH, "seq", "s.kind", "s.text"),
    {"case_no": "INT", "seq": "INT", "kind": "VARCHAR", "text": "VARCHAR"},
    [(0, 0, "plain", "x "), (0, 1, "span", "a@y.co"), (0, 2, "plain", " z"), (1, 0, "span", "a@y.co"), (2, 0, "plain", "düz")],
)
_cases(
    "F03_context_cases",
    [{"body": t, "a": a, "b": b} for t, a, b in (("kısa yazı", 0, 4), ("x" * 150 + "HEDEF" + "y" * 150, 150, 155))],
    lambda df: df.select(*_BOTH, P.context("body", F.col("a"), F.col("b")).alias("context")),
    {"case_no": "INT", "context": "VARCHAR"},
    [(0, "kısa yazı"), (1, "…" + "x" * 100 + "HEDEF" + "y" * 100 + "…")],
)
_cases(
    "F05_placeholder_cases",
    [{"body": t} for t in ("{Email_1} ve {Person_12}", "{Email} {1_2} {}")],
    lambda df: df.select(*_BOTH, F.posexplode(P.placeholders_in("body")).alias("seq", "token")),
    {"case_no": "INT", "seq": "INT", "token": "VARCHAR"},
    [(0, 0, "{Email_1}"), (0, 1, "{Person_12}")],
)


def _named_spans(names: tuple[str, ...], label: str = "Company") -> Column:
    """Spans of an automatic detector on the first place of each name."""
    at = lambda n: F.locate(n, F.col("text")) - 1
    return F.array(*[S.span(F.struct(at(n).alias("start"), (at(n) + len(n)).alias("end"), F.lit(n).alias("text")), label, "ner", 0.9) for n in names]).cast(S.SPANS)
