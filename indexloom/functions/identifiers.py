"""Identifier check digits and normalisation as column expressions; nothing leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: weights of the six leading SEDOL characters.
SEDOL_WEIGHTS = [1, 3, 1, 7, 3, 9]


def _chars(s: Column) -> Column:
    return F.filter(F.split(s, ""), lambda c: c != "")


def _value(c: Column) -> Column:
    """0..9 for digits, 10..35 for letters, 36.. for ``*@#``; null for anything else."""
    a = F.ascii(c)
    return F.when(c.rlike("^[0-9]$"), a - 48).when(c.rlike("^[A-Z]$"), a - 55).when(c == "*", 36).when(c == "@", 37).when(c == "#", 38)


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0), lambda x, y: x + y)


def _tens(n: Column) -> Column:
    """The sum of a number's two digits."""
    return F.floor(n / 10).cast("int") + n % 10


def luhn_digit(digits: Column) -> Column:
    """Check digit of a string of digits: every other digit from the right doubled."""
    d = F.transform(F.reverse(_chars(digits)), lambda c, i: F.when(i % 2 == 0, _tens(c.cast("int") * 2)).otherwise(c.cast("int")))
    return (10 - _sum(d) % 10) % 10


def isin_digit(body: Column) -> Column:
    """Check digit of the first eleven characters; letters count as two digits."""
    return luhn_digit(F.array_join(F.transform(_chars(body), lambda c: _value(c).cast("string")), ""))


def sedol_digit(body: Column) -> Column:
    w = F.array(*[F.lit(x) for x in SEDOL_WEIGHTS])
    return (10 - _sum(F.zip_with(_chars(body), w, lambda c, x: _value(c) * x)) % 10) % 10


def cusip_digit(body: Column) -> Column:
    """Check digit of the first eight characters: values of even places doubled, digits added."""
    v = F.transform(_chars(body), lambda c, i: F.when(i % 2 == 1, _value(c) * 2).otherwise(_value(c)))
    return (10 - _sum(F.transform(v, _tens)) % 10) % 10


def is_isin(value: Column) -> Column:
    ok = value.rlike("^[A-Z]{2}[A-Z0-9]{9}[0-9]$")
    return F.coalesce(ok & (isin_digit(F.substring(F.when(ok, value), 1, 11)) == F.substring(value, 12, 1).try_cast("int")), F.lit(False))


def is_sedol(value: Column) -> Column:
    """Seven characters without vowels, with a right check digit."""
    ok = value.rlike("^[B-DF-HJ-NP-TV-Z0-9]{6}[0-9]$")
    return F.coalesce(ok & (sedol_digit(F.substring(F.when(ok, value), 1, 6)) == F.substring(value, 7, 1).try_cast("int")), F.lit(False))


def is_cusip(value: Column) -> Column:
    ok = value.rlike("^[A-Z0-9*@#]{8}[0-9]$")
    return F.coalesce(ok & (cusip_digit(F.substring(F.when(ok, value), 1, 8)) == F.substring(value, 9, 1).try_cast("int")), F.lit(False))


def make_isin(country: Column, serial: Column) -> Column:
    body = F.concat(country, F.lpad(serial.cast("string"), 9, "0"))
    return F.concat(body, isin_digit(body).cast("string"))


def make_sedol(serial: Column) -> Column:
    body = F.lpad(serial.cast("string"), 6, "0")
    return F.concat(body, sedol_digit(body).cast("string"))


def make_cusip(serial: Column) -> Column:
    body = F.lpad(serial.cast("string"), 8, "0")
    return F.concat(body, cusip_digit(body).cast("string"))


def cusip_to_isin(cusip: Column, country: str = "US") -> Column:
    body = F.concat(F.lit(country), cusip)
    return F.concat(body, isin_digit(body).cast("string"))


def normal_isin(value: Column) -> Column:
    """Upper case without blanks if that is a valid ISIN, else null."""
    v = F.upper(F.regexp_replace(value, r"\s", ""))
    return F.when(is_isin(v), v)


def normal_ticker(value: Column, keep_suffix: bool = True) -> Column:
    """Upper case, trimmed; runs of separators become one dot, or the part behind them is dropped."""
    v = F.regexp_replace(F.upper(F.trim(value)), r"[.\-/_ ]+", ".")
    return v if keep_suffix else F.split(v, r"\.")[0]
