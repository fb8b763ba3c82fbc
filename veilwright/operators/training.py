"""Labelled sentences for training a named-entity model: templates filled by a hash of row number and seed.

Every row is an expression of its number, so any number of rows is made in parallel and always the same. Templates
use words in capitals that are no names beside names, places and companies, so that a model learns the difference.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilwright.functions import wordlists as W

#: Slots in capitals are filled; everything else is outside.
TEMPLATES = [
    "Dün PER ile LOC arasında görüşüldü .",
    "ORG yetkilisi PER belgeyi okudu .",
    "WORD Formu PER adına açıldı .",
    "LOC Şubesi WORD talebini aldı .",
    "PER , ORG ile anlaştı .",
    "İlgili WORD ve WORD eklidir .",
    "PER LOC adresinden taşındı .",
    "ORG merkezi LOC ilindedir .",
    "Bu WORD yarın PER eline geçer .",
    "WORD tutarını ORG karşılar .",
    "PER ve PER LOC yolunda buluştu .",
    "ORG , ORG şirketini devraldı .",
    "Yeni WORD LOC için geçerlidir .",
    "Toplantıda PER WORD sundu .",
    "LOC ve LOC arası kapalıdır .",
    "WORD PER tarafından imzalandı .",
    "Her WORD ORG arşivinde durur .",
    "PER geldi .",
    "Yalnız WORD yeterlidir .",
    "ORG çalışanı PER LOC şantiyesinde .",
]
SURNAMES = "Akıncı Balcı Ceviz Dereli Ekinci Fidan Gündüz Hazar Irmak Kıvanç Limon Narin Ozan Pamuk Seren Tunç Ulus Vural Yelken Zengin".split()
FIRMS = "Ardıç Balkan Ceylan Dörtyol Efes Filiz Gökkuşağı Hisar Irmak Kardelen Lodos Meltem".split()
TRADES = "Lojistik Tekstil Enerji Yapı Gıda Makine".split()
FORMS = ["A.Ş.", "Ltd. Şti.", "Holding"]
WORDS = "Sözleşme Teminat Fatura Dekont Vekâlet Taahhüt Beyanname Şartname Protokol Rapor Bildirim Poliçe Talimat Makbuz".split()


def sentences(spark: SparkSession, n: int = 6000, seed: int = 13) -> DataFrame:
    """``row_no, tokens, tags`` of ``n`` sentences."""
    rows = spark.range(n).withColumnRenamed("id", "row_no")

    def pick(values: list[str], *what: object) -> Column:
        at = F.pmod(F.xxhash64(F.col("row_no"), F.lit(seed), *[w if isinstance(w, Column) else F.lit(w) for w in what]), F.lit(len(values)))
        return F.get(F.array(*map(F.lit, values)), at.cast("int"))

    def filled(word: Column, i: Column) -> Column:
        name = F.concat_ws(" ", pick(W.FIRST_NAMES, "first", i), pick(SURNAMES, "last", i))
        firm = F.concat_ws(" ", pick(FIRMS, "firm", i), pick(TRADES, "trade", i), pick(FORMS, "form", i))
        return F.when(word == "PER", name).when(word == "ORG", firm).when(word == "LOC", pick(W.PROVINCES, "place", i)).when(word == "WORD", pick(WORDS, "word", i)).otherwise(word)

    def parts(word: Column, i: Column) -> Column:
        tokens = F.split(filled(word, i), " ")
        entity = word.isin("PER", "ORG", "LOC")
        tag = lambda t, k: F.when(~entity, "O").when(k == 0, F.concat(F.lit("B-"), word)).otherwise(F.concat(F.lit("I-"), word))
        return F.transform(tokens, lambda t, k: F.struct(t.alias("token"), tag(t, k).alias("tag")))

    out = rows.withColumn("p", F.flatten(F.transform(F.split(pick(TEMPLATES, "template"), " "), parts)))
    return out.select("row_no", F.transform("p", lambda x: x["token"]).alias("tokens"), F.transform("p", lambda x: x["tag"]).alias("tags"))
