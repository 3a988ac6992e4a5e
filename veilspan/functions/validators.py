"""Validators of identifiers as Column expressions, and the numbers behind them.

All of them take the raw span and return a boolean, or NULL for NULL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BASE36 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"  # fixed value: order of check characters
PAN_HOLDERS = "PCHFATBLJGK"  # fixed value: legal fourth letters
_FIRST_PERMUTATION = (1, 5, 7, 6, 2, 8, 3, 0, 9, 4)  # fixed value of the Verhoeff scheme


def _dihedral(a: int, b: int) -> int:
    """Product in the symmetry group of the pentagon, elements 0-4 rotations and 5-9 reflections."""
    turn = a % 5 + (b % 5 if a < 5 else -(b % 5))
    return turn % 5 + 5 * ((a >= 5) != (b >= 5))


def _permutations() -> list[tuple[int, ...]]:
    rows = [tuple(range(10))]
    while len(rows) < 8:
        rows.append(tuple(_FIRST_PERMUTATION[x] for x in rows[-1]))
    return rows


_PRODUCTS = "".join(str(_dihedral(a, b)) for a in range(10) for b in range(10))
_PERMUTED = "".join(str(x) for row in _permutations() for x in row)
_INVERSES = "".join(str(next(b for b in range(10) if _dihedral(a, b) == 0)) for a in range(10))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def compact(value: Column) -> Column:
    return F.replace(F.upper(F.trim(value)), F.lit(" "), F.lit(""))


def _at(table: str, index: Column) -> Column:
    return F.substring(F.lit(table), index.cast("int") + 1, F.lit(1)).cast("int")


def verhoeff(number: Column) -> Column:
    """Verhoeff checksum of a digit string; 0 means valid."""
    start = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("place"))

    def step(state: Column, digit: Column) -> Column:
        moved = _at(_PERMUTED, (state["place"] % 8) * 10 + digit.cast("int"))
        return F.struct(_at(_PRODUCTS, state["sum"] * 10 + moved).alias("sum"), (state["place"] + 1).alias("place"))

    return F.aggregate(F.filter(F.split(F.reverse(number), ""), lambda d: d != ""), start, step)["sum"]


def verhoeff_digit(body: Column) -> Column:
    """The digit that, appended, makes a digit string valid."""
    return _at(_INVERSES, verhoeff(F.concat(body, F.lit("0")))).cast("string")


def is_aadhaar(value: Column) -> Column:
    number = digits(value)
    return number.rlike("^[2-9][0-9]{11}$") & (verhoeff(number) == 0)


def is_pan(value: Column) -> Column:
    return compact(value).rlike(f"^[A-Z]{{3}}[{PAN_HOLDERS}][A-Z][0-9]{{4}}[A-Z]$")


def gstin_check(body: Column) -> Column:
    """Check character for the first 14 characters of a GSTIN."""

    def step(total: Column, i: Column) -> Column:
        value = (F.instr(F.lit(BASE36), F.substring(body, i, F.lit(1))) - 1) * F.when(i % 2 == 0, 2).otherwise(1)
        return total + F.floor(value / 36).cast("int") + value % 36

    total = F.aggregate(F.sequence(F.lit(1), F.lit(14)), F.lit(0), step)
    return F.substring(F.lit(BASE36), (36 - total % 36) % 36 + 1, F.lit(1))


def is_gstin(value: Column) -> Column:
    code = compact(value)
    shaped = code.rlike("^[0-9]{2}[A-Z]{5}[0-9]{4}[A-Z][0-9A-Z]Z[0-9A-Z]$")
    state = F.when(shaped, F.substring(code, 1, 2).cast("int"))
    return shaped & F.coalesce(state.between(1, 38), F.lit(False)) & (gstin_check(code) == F.substring(code, 15, 1))


def is_card(value: Column) -> Column:
    number = digits(value)
    return F.length(number).between(13, 19) & F.coalesce(F.call_function("luhn_check", number), F.lit(False))


def is_ifsc(value: Column) -> Column:
    return compact(value).rlike("^[A-Z]{4}0[0-9A-Z]{6}$")


def is_passport(value: Column) -> Column:
    return compact(value).rlike("^[A-PR-WY][0-9]{7}$")


def is_voter_id(value: Column) -> Column:
    return compact(value).rlike("^[A-Z]{3}[0-9]{7}$")


def is_mobile(value: Column) -> Column:
    return digits(value).rlike("^(?:91|0)?[6-9][0-9]{9}$")


def is_ipv4(value: Column) -> Column:
    return value.rlike(r"^(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)$")


def is_iban(value: Column) -> Column:
    """ISO 7064 mod 97 over country, check digits and account, letters counting from 10."""
    code = compact(value)
    turned = F.concat(F.substring(code, 5, 40), F.substring(code, 1, 4))
    chars = F.filter(F.split(turned, ""), lambda c: c != "")
    remainder = F.aggregate(chars, F.lit(0), lambda r, c: (r * F.when(c.rlike("[0-9]"), 10).otherwise(100) + F.instr(F.lit(BASE36), c) - 1) % 97)
    return code.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$") & (remainder == 1)


VALIDATORS: dict[str, Callable[[Column], Column]] = {
    "IN_AADHAAR": is_aadhaar,
    "IN_PAN": is_pan,
    "IN_GSTIN": is_gstin,
    "CREDIT_CARD": is_card,
    "IN_IFSC": is_ifsc,
    "IN_PASSPORT": is_passport,
    "IN_VOTER_ID": is_voter_id,
    "IN_MOBILE": is_mobile,
    "IP_ADDRESS": is_ipv4,
    "IBAN_CODE": is_iban,
}


def is_valid(entity_type: Column, value: Column) -> Column:
    """Whether a value passes its type's validator; NULL for types that have none, as for a NULL value."""
    out = F.when(F.lit(False), F.lit(True))
    for name, check in VALIDATORS.items():
        out = out.when(entity_type == name, check(value))
    return out
