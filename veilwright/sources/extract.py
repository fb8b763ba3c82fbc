"""Files to text: dispatch on the suffix, DOCX natively, PDF and images through adapters, never an exception per file."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

PAGE = "struct<page_number:int,text:string,extract_method:string,confidence:double>"
RESULT = f"filename string, error_message string, pages array<{PAGE}>"
KINDS = {".pdf": "pdf", ".docx": "docx", ".doc": "docx", **dict.fromkeys((".png", ".jpg", ".jpeg", ".tiff", ".tif", ".bmp", ".webp"), "image")}
NATIVE_LEAST = 20
_NS = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def file_kind(filename: Column) -> Column:
    """``pdf``, ``docx``, ``image`` or null by the lower-cased suffix."""
    suffix = F.lower(F.regexp_extract(filename, r"\.[^./\\]+$", 0))
    table = F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])
    return F.try_element_at(table, suffix)


def read_files(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """``filename, content`` of every file; a path that cannot be read is a row without content, which :func:`extract` reports."""
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(path)
        return files.select(F.element_at(F.split("path", "/"), -1).alias("filename"), "content")
    except AnalysisException:
        return spark.createDataFrame([(path.rstrip("/").rsplit("/", 1)[-1], None)], "filename string, content binary")


REQUEST = "text string, language string, mode string, manual_spans array<struct<text:string,label:string>>"


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """Masking requests, one JSON object per line; without a mode it is ``full``. The language is carried, not used."""
    rows = spark.read.schema(REQUEST).json(path)
    return rows.withColumn("mode", F.coalesce("mode", F.lit("full")))


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """One document per text file: ``doc_id`` is the name without its suffix."""
    name = F.regexp_replace(F.element_at(F.split(F.input_file_name(), "/"), -1), r"\.[^.]+$", "")
    return spark.read.text(path, wholetext=True).select(name.alias("doc_id"), F.col("value").alias("text"))


def docx_text(data: bytes) -> str:
    """Non-blank paragraphs, then non-blank table cells, one per line."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_NS}body")
    line = lambda p: "".join(t.text or "" for t in p.iter(f"{_NS}t"))
    paragraphs = [line(p) for p in body.findall(f"{_NS}p")]
    cells = ["\n".join(line(p) for p in c.findall(f"{_NS}p")) for c in body.iter(f"{_NS}tc")]
    return "\n".join(x for x in paragraphs + cells if x.strip())


def ocr_confidence(words: list[float]) -> float | None:
    """Mean of the non-negative word confidences, to one decimal."""
    good = [w for w in words if w >= 0]
    return round(sum(good) / len(good), 1) if good else None


def extract(files: DataFrame, pdf_pages: Callable[[bytes], list[str]] | None = None, ocr: Callable[[bytes, int | None], tuple[str, list[float]]] | None = None) -> DataFrame:
    """``filename, error_message, pages`` of ``files(filename, content)``.

    ``pdf_pages`` gives the native text per page; a page with fewer than 20 characters, and every image, goes to
    ``ocr``, which gets the bytes and the page. A missing adapter or a failing file becomes an error message, a failing
    OCR an empty page.
    """

    def scanned(data: bytes, page: int | None) -> dict:
        try:
            text, words = ocr(data, page)
            return {"page_number": page or 1, "text": text.strip(), "extract_method": "ocr", "confidence": ocr_confidence(words)}
        except Exception:  # a page that cannot be read is an empty page
            return {"page_number": page or 1, "text": "", "extract_method": "ocr", "confidence": None}

    def pages(name: str, data: bytes | None) -> list[dict]:
        if data is None:
            raise ValueError("cannot read file")
        m = re.search(r"\.[^./\\]+$", name or "")
        kind = KINDS.get(m.group().lower() if m else "")
        if kind is None:
            raise ValueError(f"Unsupported file type: {m.group() if m else ''}")
        if kind == "docx":
            return [{"page_number": 1, "text": docx_text(data), "extract_method": "docx", "confidence": None}]
        if kind == "image":
            if ocr is None:
                raise ValueError("no OCR adapter")
            return [scanned(data, None)]
        if pdf_pages is None:
            raise ValueError("no PDF adapter")
        out = []
        for n, text in enumerate(pdf_pages(data), 1):
            native = (text or "").strip()
            out.append({"page_number": n, "text": native, "extract_method": "native", "confidence": None} if len(native) >= NATIVE_LEAST or ocr is None else scanned(data, n))
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for name, data in zip(pdf["filename"], pdf["content"]):
                try:
                    rows.append((name, None, pages(name, data)))
                except Exception as e:  # one bad file must not stop the table
                    rows.append((name, str(e) or type(e).__name__, []))
            yield pd.DataFrame(rows, columns=["filename", "error_message", "pages"])

    return files.select("filename", "content").mapInPandas(run, RESULT)


def _filled(pages: Column) -> Column:
    return F.filter(pages, lambda p: F.trim(F.regexp_replace(p["text"], r"(?U)\s", " ")) != "")


def full_text(pages: Column) -> Column:
    """Non-blank pages joined by form feeds."""
    return F.array_join(F.transform(_filled(pages), lambda p: p["text"]), "\f")


def page_breaks(pages: Column) -> Column:
    """Where each non-blank page begins in the full text."""
    sizes = F.transform(_filled(pages), lambda p: F.length(p["text"]))
    zero = F.struct(F.lit(0).alias("pos"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(sizes, zero, lambda acc, n: F.struct((acc["pos"] + n + 1).alias("pos"), F.array_append(acc["out"], acc["pos"]).alias("out")), lambda acc: acc["out"])


def methods(pages: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(pages, lambda p: p["extract_method"])))


def has_ocr(pages: Column) -> Column:
    return F.exists(pages, lambda p: p["extract_method"] == "ocr")


def ocr_mean(pages: Column) -> Column:
    """Sum of the known confidences over the number of all OCR pages, to one decimal."""
    scanned = F.filter(pages, lambda p: p["extract_method"] == "ocr")
    total = F.aggregate(scanned, F.lit(0.0), lambda acc, p: acc + F.coalesce(p["confidence"], F.lit(0.0)))
    return F.when(F.size(scanned) > 0, F.round(total / F.size(scanned), 1))


def status(content_size: Column, error: Column, text: Column) -> Column:
    """Why an upload is refused, or ``ok``."""
    return F.when(content_size == 0, "empty").when(error.isNotNull(), "failed").when(F.coalesce(F.trim(F.regexp_replace(text, r"(?U)\s", " ")), F.lit("")) == "", "blank").otherwise("ok")
