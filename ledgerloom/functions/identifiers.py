"""Spanish tax ids as Column to Column functions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Fixed values of the official check-letter rules.
CHECK_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"
CONTROL_LETTERS = "JABCDEFGHI"

#: First character, number of digits and last character of each kind.
SHAPES = {"nif": ("", 8, "A-Z"), "cif": ("ABCDEFGHJKLMNPQRSUVW", 7, "0-9A-J"), "nie": ("XYZ", 7, "A-Z")}


def _whole(kind: str) -> str:
    first, n, last = SHAPES[kind]
    return "^" + (f"[{first}]" if first else "") + rf"\d{{{n}}}[{last}]$"


def _written(kind: str) -> str:
    """The kind as people write it: a blank after the letter, after the first one or two digits, and before any character from there on; one digit may be missing."""
    first, n, last = SHAPES[kind]
    return (f"[{first}] ?" if first else "") + rf"\d{{1,2}}(?: ?\d){{{n - 2}}} ?[{last}]"


NIF, CIF, NIE = map(_whole, ("nif", "cif", "nie"))
WRITTEN = "(?:" + "|".join(map(_written, ("cif", "nif", "nie"))) + ")"


def clean(raw: Column, also: str = "") -> Column:
    """Upper case without white space, hyphens and points, and what ``also`` names."""
    return F.regexp_replace(F.upper(F.trim(raw)), rf"[\s\-\.{also}]", "")


def check_letter(number: Column) -> Column:
    """The letter of a number, modulo 23."""
    return F.substring(F.lit(CHECK_LETTERS), (number % 23 + 1).cast("int"), F.lit(1))


def control_digit(digits: Column) -> Column:
    """The control digit of seven digits: odd places doubled with digit sum, even places as they are."""
    total = F.lit(0)
    for k in range(1, 8):
        d = F.substring(digits, k, 1).try_cast("int")
        total = total + (F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2) if k % 2 else d)
    return (10 - total % 10) % 10


def kind(value: Column) -> Column:
    """nif, cif, nie or desconocido, in this order of trial."""
    v = F.upper(F.trim(value))
    return F.when(v.rlike(NIF), "nif").when(v.rlike(CIF), "cif").when(v.rlike(NIE), "nie").otherwise("desconocido")


def is_valid(value: Column) -> Column:
    """The check character agrees; false for unknown formats and null."""
    v, k = F.upper(F.trim(value)), kind(value)
    nif = check_letter(F.substring(v, 1, 8).try_cast("long")) == F.substring(v, 9, 1)
    nie = check_letter(F.concat(F.translate(F.substring(v, 1, 1), "XYZ", "012"), F.substring(v, 2, 7)).try_cast("long")) == F.substring(v, 9, 1)
    digit = control_digit(F.substring(v, 2, 7))
    cif = (F.substring(v, 9, 1) == digit.cast("string")) | (F.substring(v, 9, 1) == F.substring(F.lit(CONTROL_LETTERS), (digit + 1).cast("int"), F.lit(1)))
    return F.coalesce(F.when(k == "nif", nif).when(k == "cif", cif).when(k == "nie", nie), F.lit(False))


def export_cell(raw: Column) -> Column:
    """For a CSV cell: leading junk and spaces dropped, upper case."""
    return F.upper(F.regexp_replace(F.regexp_replace(F.trim(raw), "^[^A-Za-z0-9]+", ""), r"\s+", ""))


def file_key(raw: Column, missing: str = "SIN_CLIENTE") -> Column:
    """For a file name: letters and digits only, upper case, a fixed key if nothing is left."""
    return F.coalesce(F.nullif(F.upper(F.regexp_replace(raw, "[^A-Za-z0-9]", "")), F.lit("")), F.lit(missing))
