"""Identifier functions: the Verhoeff checksum and masks."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Verhoeff's permutation and the multiplication of the dihedral group of order ten.
PERMUTATION = [1, 5, 7, 6, 2, 8, 3, 0, 9, 4]


def dihedral(a: int, b: int) -> int:
    """Product in the symmetries of a pentagon: rotations 0 to 4, reflections 5 to 9."""
    turn = (a + b) % 5 if a < 5 else (a - b) % 5
    return turn if (a < 5) == (b < 5) else turn + 5


def _powers() -> list[list[int]]:
    rows = [list(range(10))]
    for _ in range(7):
        rows.append([PERMUTATION[x] for x in rows[-1]])
    return rows


PRODUCT = [dihedral(a, b) for a in range(10) for b in range(10)]
POWERS = [x for row in _powers() for x in row]


def verhoeff_remainder(digits: Column) -> Column:
    """0 for a string of digits that satisfies the checksum."""
    d, p = F.lit(PRODUCT), F.lit(POWERS)
    own = F.transform(F.split(F.reverse(digits), ""), lambda x, i: F.element_at(p, (i % 8) * 10 + x.cast("int") + 1))
    return F.aggregate(own, F.lit(0), lambda c, x: F.element_at(d, c * 10 + x + 1))


def verhoeff_valid(digits: Column) -> Column:
    return F.when(digits.rlike("^[0-9]+$"), verhoeff_remainder(digits) == 0).otherwise(False)


def check_digit(digits: Column) -> Column:
    """The digit that makes the string of digits valid when it follows."""
    return F.array_position(F.array(*(verhoeff_remainder(F.concat(digits, F.lit(str(k)))) for k in range(10))), 0).cast("int") - 1


def aadhaar_valid(digits: Column) -> Column:
    """Twelve digits, the first 2 to 9, that satisfy the checksum."""
    return digits.rlike("^[2-9][0-9]{11}$") & verhoeff_valid(digits)


def mask_last4(value: Column, mask: str = "XXXXXX") -> Column:
    return F.concat(F.lit(mask), F.right(value, F.lit(4)))


def valid_py(digits: str) -> bool:
    c = 0
    for i, x in enumerate(reversed(digits)):
        c = PRODUCT[c * 10 + POWERS[(i % 8) * 10 + int(x)]]
    return c == 0


def verhoeff_valid_np(digits: np.ndarray) -> np.ndarray:
    """Of rows of digits: which satisfy the checksum."""
    product, powers = np.array(PRODUCT), np.array(POWERS)
    c = np.zeros(len(digits), np.int64)
    for i in range(digits.shape[1]):
        c = product[c * 10 + powers[i % 8 * 10 + digits[:, -1 - i]]]
    return c == 0


# How a twelve-digit number is written; it may not be part of a longer run of digits.
_GAP = "[  -]{0,2}"
AADHAAR = rf"(?<!\d)(?<!\d[  -])(?<!\d[  -][  -])([2-9]\d{{3}}){_GAP}(\d{{4}}){_GAP}(\d{{4}})(?!{_GAP}\d)"
AADHAAR_RE = re.compile(AADHAAR, re.ASCII)


def mask_in_text(text: str | None) -> str | None:
    """Numbers that satisfy the checksum are masked but for four digits; all others stay as they are."""
    if text is None:
        return None
    return AADHAAR_RE.sub(lambda m: f"XXXX XXXX {m[3]}" if valid_py(m[1] + m[2] + m[3]) else m[0], text)


@F.pandas_udf(StringType())
def _masked(s: pd.Series) -> pd.Series:
    return s.map(mask_in_text)


def mask_aadhaar_in(text: Column) -> Column:
    """Only texts that hold such a number at all go through Python."""
    shaped = text.rlike(AADHAAR)
    return F.when(shaped, _masked(F.when(shaped, text))).otherwise(text)
