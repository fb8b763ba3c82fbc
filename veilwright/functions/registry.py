"""The pattern detector's registry as data: thirty patterns, in the order that settles ties."""

from __future__ import annotations

from typing import NamedTuple


class Pattern(NamedTuple):
    id: str
    label: str
    regex: str
    confidence: float
    ignore_case: bool = False
    validator: str | None = None
    group: int = 0
    guard: str | None = None  # cheap pattern that every text with a match has


_SEP = r"\s*:?\s*"
_NO = r"(?:No\.?|Numaras[ıiIİ])"
_OCTET = r"(?:25[0-5]|2[0-4]\d|[01]?\d\d?)"
_CAP, _SMALL = "[A-ZÇĞİÖŞÜ]", "[a-zçğışöşü]"
_NAME = f"{_CAP}{_SMALL}+"
_MONTHS = "Ocak Şubat Mart Nisan Mayıs Haziran Temmuz Ağustos Eylül Ekim Kasım Aralık"
_ROADS = r"Caddesi Cadde Cad\. Sokağı Sokak Sok\. Bulvarı Blv\. Mahallesi Mah\. Bölgesi Sitesi Apartmanı"


def _one_of(words: str) -> str:
    return "(?:" + "|".join(words.split()) + ")"


def _groups(n: int, size: int, gap: str) -> str:
    return rf"(?:{gap}?\d{{{size}}}){{{n}}}"


def _keyed(word: str, value: str, guard: bool = False) -> str:
    """A document number after its keyword; group 1 is the number."""
    return rf"{word}\s*{_NO}{_SEP}({value})" + (r"(?!\d)" if guard else "")


def _code(low: int, high: int) -> str:
    return rf"[A-Z0-9][A-Z0-9\-/]{{{low},{high}}}"


def _money(symbols: str, thousands: str, decimal: str) -> str:
    amount = rf"\d{{1,3}}(?:{thousands}\d{{3}})*(?:{decimal}\d{{1,2}})?"
    return rf"(?:{symbols})\s*{amount}|{amount}\s*(?:{symbols})"


def _address() -> str:
    letters = "A-Za-zğüşıöçĞÜŞİÖÇ"
    place = rf"[ \t]*{_CAP}[{letters}.]{{1,20}}"
    words = r"\b[\wğüşıöçĞÜŞİÖÇ]+(?:[ \t]+[\wğüşıöçĞÜŞİÖÇ\.]+){0,5}"
    unit = rf"(?:[ \t]*,?[ \t]*(?:Kat|Daire|D|Blok|Bağımsız[ \t]+Bölüm)[ \t]*[:.]?[ \t]*\d+[A-Za-zÇĞİÖŞÜ]?)*"
    return rf"{words}[ \t]+{_one_of(_ROADS)}[ \t]*No[ \t]*:[ \t]*\d+(?:[ \t]*/[ \t]*\d+[A-Za-zÇĞİÖŞÜ]?)?{unit}(?:[ \t]*,{place}(?:[ \t]*/{place})?){{0,2}}"


#: The shapes, confidences and order that results depend on.
PATTERNS = [
    Pattern("R01", "TC_No", r"(?<!\d)[1-9]\d{10}(?!\d)", 0.99, validator="tc_kimlik"),
    Pattern("R02", "TC_No", rf"(?:T\.?\s*C\.?\s*Kimlik\s*{_NO}?|TCKN){_SEP}([1-9]\d{{10}})", 0.88, True, group=1),
    Pattern("R03", "IBAN", rf"\bTR\d{{2}}{_groups(5, 4, r'[\s-]')}[\s\-]?\d{{2}}\b", 0.99, True, "iban_tr"),
    Pattern("R04", "IBAN", rf"\bTR\d{{2}}{_groups(5, 4, '[ -]')}\b", 0.82, True),
    Pattern("R05", "Card_No", rf"(?<!\d)\d{{4}}{_groups(3, 4, '[ -]')}(?!\d)", 0.97, validator="luhn"),
    Pattern("R06", "Tax_No", r"(?<!\d)\d{10}(?!\d)", 0.95, validator="vkn"),
    Pattern("R07", "Tax_No", rf"Vergi\s*(?:Kimlik\s*)?No\.?{_SEP}(\d{{10}})(?!\d)", 0.88, True, group=1),
    Pattern("R08", "Account_No", rf"MERSİS\s*No\.?{_SEP}(\d{{4}}{_groups(3, 4, r'[-\s]')})", 0.97, True, group=1),
    Pattern("R09", "Email", r"\b[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}\b", 0.99, guard="@"),
    Pattern("R10", "Phone_No", r"(?:\+90|0090|0)[ \-]?[2-5]\d{2}[ \-]?\d{3}[ \-]?\d{2}[ \-]?\d{2}", 0.95),
    Pattern("R11", "License_Plate", r"\b(?:0[1-9]|[1-7][0-9]|8[01]) ?[A-ZÇĞİÖŞÜ]{1,3} ?\d{2,4}\b", 0.95, validator="plate"),
    Pattern("R12", "Passport_No", r"\b[A-Z]{1,2}\d{7,9}\b", 0.80),
    Pattern("R13", "Money_Amount", _money("₺|TL|TRY", r"\.", ","), 0.95, True),
    Pattern("R14", "Money_Amount", _money(r"\$|€|£|USD|EUR|GBP", ",", r"\."), 0.95, True),
    Pattern("R15", "Date", r"\b(?:\d{2}[./\-]\d{2}[./\-]\d{4}|\d{4}[./\-]\d{2}[./\-]\d{2})\b", 0.90),
    Pattern("R16", "Date", rf"\b\d{{1,2}}\s+{_one_of(_MONTHS)}\s+\d{{4}}\b", 0.99, True),
    Pattern("R17", "Case_No", rf"{_one_of('Esas Karar Dava Dosya İş')}\s+No\.?:?\s*(\d{{4}}/\d+)", 0.92, True, group=1),
    Pattern("R18", "Case_No", r"\b\d{4}/\d{4,}\b", 0.85, True),
    Pattern("R19", "Customer_No", _keyed("M[üu][şs]ter[iİ]", r"\d{4,15}", True), 0.92, True, group=1),
    Pattern("R20", "SGK_No", _keyed(r"(?:SGK|SSK)\s*(?:Sicil)?", r"\d{7,13}", True), 0.92, True, group=1),
    Pattern("R21", "Policy_No", _keyed("Pol[iİ][çc]e", _code(3, 19)), 0.92, True, group=1),
    Pattern("R22", "Contract_No", _keyed("S[öo]zle[şs]me", _code(3, 24)), 0.92, True, group=1),
    Pattern("R23", "Invoice_No", _keyed("Fatura", _code(5, 19)), 0.92, True, group=1),
    Pattern("R24", "Reference_No", _keyed("(?:Referans|Dekont|[İIi][şs]lem|Tak[iİ]p)", _code(3, 24)), 0.92, True, group=1),
    Pattern("R25", "Person", rf"(?:Anne|Baba)\s*Ad[ıi]{_SEP}({_NAME}(?: (?!(?:Anne|Baba)\b){_NAME})?)", 0.90, group=1),
    Pattern("R26", "Account_No", r"(?:Hesap|IBAN|Hesap\s+No\.?):?\s*[\d\s]{10,30}", 0.88, True),
    Pattern("R27", "Account_No", r"\b[A-Z]{4}TR[A-Z0-9]{2}(?:[A-Z0-9]{3})?\b", 0.90),
    Pattern("R28", "IP_Address", rf"\b(?:{_OCTET}\.){{3}}{_OCTET}\b", 0.99),
    Pattern("R29", "URL", r"https?://[^\s<>\"{}|\\^`\[\]]+", 0.95, True, guard="://"),
    Pattern("R30", "Address", _address(), 0.82, True, guard=rf"{_one_of(_ROADS)}[ \t]*No[ \t]*:[ \t]*\d"),
]

#: Labels whose pattern matches outrank other detectors.
DOMINANT = "TC_No IBAN Tax_No Card_No Phone_No License_Plate Email Passport_No Money_Amount Account_No IP_Address URL Case_No Date Customer_No SGK_No Policy_No Contract_No Invoice_No Reference_No".split()
