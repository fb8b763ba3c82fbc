"""Quality of each mode against annotated documents of our own: strict scores, leak and error listing.

The documents are written for this purpose; ``[[surface|Label]]`` marks what must be found. No fitted model is part of
the engine: the modes ``ner`` and ``full`` run with a small dictionary in its place, so their recall on names says what
the filters keep of a perfect reading of known names, not what a model would find.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilwright.operators import detect, evaluate, masking

DOCUMENTS = """
Sayın [[Zeynep Kara|Person]], [[15.03.2024|Date]] tarihli başvurunuz alınmıştır. Yanıt [[zeynep.kara@ornek.example|Email]] adresine gönderilecektir.
Kiracının T.C. Kimlik No: [[10000000146|TC_No]] olup telefonu [[0532 123 45 67|Phone_No]] olarak bildirilmiştir.
Ödeme [[TR33 0006 1005 1978 6457 8413 26|IBAN]] hesabına [[12.500,00 TL|Money_Amount]] olarak yapılacaktır.
Davacı vekili dosyayı (Esas No: [[2023/145|Case_No]]) inceledi ve [[3 Ocak 2024|Date]] günü dilekçe verdi.
Satıcı [[Arven Lojistik A.Ş.|Company]] ile alıcı arasında imzalanan sözleşme [[Bursa|Location]] ilinde düzenlenmiştir.
Araç plakası [[34 ABC 123|License_Plate]] olup bedeli [[250.000 TL|Money_Amount]] olarak kararlaştırıldı.
Yolcu pasaportu [[U12345678|Passport_No]] ile giriş yaptı; iletişim: [[+90 544 987 65 43|Phone_No]].
Kart numarası [[4111 1111 1111 1111|Card_No]] olan ödeme iade edildi.
Şirketin Vergi No: [[1234567890|Tax_No]] ve MERSİS No: [[0123-4567-8901-2345|Account_No]] kaydı vardır.
Poliçe No: [[AB-12345|Policy_No]] kapsamında hasar [[02.02.2024|Date]] günü bildirildi.
Sözleşme No: [[SZ/2024-17|Contract_No]] uyarınca Fatura No: [[FTR2024009|Invoice_No]] düzenlendi.
Sunucu [[10.20.30.40|IP_Address]] üzerinden [[https://ornek.example/giris|URL]] adresine bağlanıldı.
Toplantıya [[Ahmet Yılmaz|Person]] ve [[Elif Demir|Person]] katıldı; karar oy birliğiyle alındı.
Teslimat yeri [[Ankara|Location]] olarak seçildi, sorumlu [[Mehmet Çınar|Person]] olacaktır.
Müşteri No: [[778899|Customer_No]] için Referans No: [[REF-2024-5|Reference_No]] oluşturuldu.
SGK Sicil No: [[123456789|SGK_No]] kaydı bulunan çalışan işe başladı.
[[Doruk Holding|Company]] yönetim kurulu [[Selin Koç|Person]] başkanlığında toplandı.
Anne Adı: [[Fatma Şahin|Person]]; doğum tarihi [[01.01.1980|Date]].
5411 sayılı Bankacılık Kanunu uyarınca bilgi verilmesi zorunludur.
Ankara Büyükşehir Belediyesi Zabıta Dairesi başvuruyu reddetmiştir.
İşbu sözleşme iki nüsha olarak düzenlenmiş ve taraflarca okunarak kabul edilmiştir.
Toplantı [[İzmir|Location]] ilinde, [[Kadıköy|Location]] ilçesinden gelen [[Hasan Kurt|Person]] ile yapıldı.
Güvence bedeli [[$1,500.00|Money_Amount]] olup [[2024-05-01|Date]] tarihine kadar [[muhasebe@arven.example|Email]] adresine bildirilecektir.
[[Kuzey Yapı Ltd. Şti.|Company]] yetkilisi [[Ayşe Polat|Person]] ([[0212 555 44 33|Phone_No]]) teklifi imzaladı.
""".strip().split("\n")
#: Names that the dictionary in place of a model knows.
KNOWN = {"Zeynep Kara": "PER", "Ahmet Yılmaz": "PER", "Mehmet Çınar": "PER", "Ayşe Polat": "PER", "Arven Lojistik": "ORG", "Bursa": "LOC", "İzmir": "LOC"}


def documents(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame([(f"d{i:02d}", t) for i, t in enumerate(DOCUMENTS)], "doc_id string, marked string")
    return rows.select("doc_id", evaluate.parse_markup("marked").alias("m")).select("doc_id", "m.text", F.col("m.spans").alias("gold"))


def _scored(spark: SparkSession, mode: str) -> tuple[DataFrame, DataFrame]:
    docs = documents(spark)
    gold = detect.explode_spans(docs.drop("text"), ["doc_id"], "gold").select("doc_id", "start", "end", "label")
    out = masking.mask(docs.drop("gold"), "text", masking.Settings(mode=mode, entries=KNOWN))
    return gold, detect.explode_spans(out, ["doc_id"]).select("doc_id", "start", "end", "label")


def quality(spark: SparkSession, sf_dir: str, mode: str) -> DataFrame:
    """One row: strict micro precision, recall and F1 and the share of characters that leak."""
    gold, found = _scored(spark, mode)
    row = evaluate.history_row(evaluate.strict(gold, found), evaluate.characters(gold, found), mode, masking.ENGINE_VERSION)
    return row.select("mode", *[F.round(c, 4).alias(c) for c in ("precision", "recall", "f1", "leak")], "support")


def quality_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.errors(*_scored(spark, "full"))


QUERIES = {f"E10_quality_{m}": partial(quality, mode=m) for m in ("regex", "ner", "full")} | {"E09_quality_errors": quality_errors}
SQL: dict[str, str] = {}
