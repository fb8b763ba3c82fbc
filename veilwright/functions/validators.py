"""Checksum predicates over strings. Null gives null; anything malformed is false."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilwright.functions.spans import col


def _bare(c: Column | str) -> Column:
    return F.regexp_replace(col(c), "[ \\-]", "")


def _digit(c: Column, i: int) -> Column:
    return F.substring(c, i + 1, 1).try_cast("int")


def tc_kimlik(c: Column | str) -> Column:
    """Eleven digits with two check digits."""
    x = _bare(c)
    d = [_digit(x, i) for i in range(11)]
    tenth = F.pmod(7 * (d[0] + d[2] + d[4] + d[6] + d[8]) - (d[1] + d[3] + d[5] + d[7]), F.lit(10))
    last = F.pmod(sum(d[1:10], d[0]), F.lit(10))
    return x.rlike("^[1-9][0-9]{10}$") & F.coalesce((tenth == d[9]) & (last == d[10]), F.lit(False))


def iban_tr(c: Column | str) -> Column:
    """TR and 24 digits, remainder 1 modulo 97."""
    x = F.upper(_bare(c))
    moved = F.concat(F.substring(x, 5, 22), F.lit("2927"), F.substring(x, 3, 2))
    return F.when(x.rlike("^TR[0-9]{24}$"), moved.try_cast("decimal(38,0)") % 97 == 1).otherwise(F.when(x.isNotNull(), F.lit(False)))


def vkn(c: Column | str) -> Column:
    """Ten digits of a tax number with one check digit."""
    x = _bare(c)
    total = F.lit(0)
    for i in range(9):
        t = F.pmod(_digit(x, i) + (9 - i), F.lit(10))
        r = F.pmod(t * (2 ** (9 - i)), F.lit(9))
        total = total + F.when(t == 0, 0).otherwise(F.when(r == 0, 9).otherwise(r))
    check = F.pmod(10 - F.pmod(total, F.lit(10)), F.lit(10))
    return x.rlike("^[0-9]{10}$") & F.coalesce(check == _digit(x, 9), F.lit(False))


def luhn(c: Column | str) -> Column:
    """13 to 19 digits, whatever stands between them, with a Luhn check digit."""
    x = F.regexp_replace(col(c), "[^0-9]", "")
    return F.length(x).between(13, 19) & F.call_function("luhn_check", x)


def plate(c: Column | str) -> Column:
    """A province code from 01 to 81 in front."""
    head = F.substring(F.replace(col(c), F.lit(" "), F.lit("")), 1, 2)
    return head.rlike("^[0-9]{2}$") & head.between("01", "81")


VALIDATORS = {"tc_kimlik": tc_kimlik, "iban_tr": iban_tr, "vkn": vkn, "luhn": luhn, "plate": plate}
