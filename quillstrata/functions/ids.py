"""Time-ordered identifiers, timestamps and selectors."""

from __future__ import annotations

import os
import time
import unicodedata
import uuid

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Digits of Crockford's base 32.
CROCKFORD = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"


def uuid7(milliseconds: int | None = None) -> str:
    """A version 7 UUID: 48 bits of Unix milliseconds, then random bits."""
    ms = int(time.time() * 1000) if milliseconds is None else milliseconds
    rand = int.from_bytes(os.urandom(10), "big")
    value = (ms << 80) | (0x7 << 76) | ((rand >> 68) << 64) | (0b10 << 62) | (rand & ((1 << 62) - 1))
    return str(uuid.UUID(int=value))


def uuid7_time(col: Column) -> Column:
    """The timestamp inside a version 7 UUID."""
    return F.timestamp_millis(F.conv(F.substring(F.replace(col, F.lit("-")), 1, 12), 16, 10).cast("long"))


def short_id(col: Column) -> Column:
    """The first 60 bits of a UUID as 12 base-32 digits; it sorts as the UUID does."""
    digits = F.conv(F.substring(F.replace(col, F.lit("-")), 1, 15), 16, 32)
    plain = "ABCDEFGHIJKLMNOPQRSTUV"
    return F.lpad(F.translate(digits, plain, CROCKFORD[10:]), 12, "0")


def short_id_of(value: uuid.UUID | str) -> str:
    """short_id() of one UUID."""
    bits = uuid.UUID(str(value)).int >> 68
    return "".join(CROCKFORD[bits >> 5 * i & 31] for i in reversed(range(12)))


def parse_time(col: Column) -> Column:
    """ISO 8601; without a zone it is UTC."""
    return F.try_to_timestamp(col)


def age_days(then: Column, now: Column) -> Column:
    """Whole days of 24 hours that have passed."""
    return F.floor((F.unix_timestamp(now) - F.unix_timestamp(then)) / 86400)


def split_selector(col: Column, separator: str) -> tuple[Column, Column]:
    """What stands before and after the first separator; the second is null without one."""
    at = F.instr(col, separator)
    return F.when(at > 0, F.substring(col, F.lit(1), at - 1)).otherwise(col), F.when(at > 0, F.substring(col, at + 1, F.length(col)))


def slug(names: Column) -> Column:
    """Letters and digits of the ASCII form, joined by hyphens (Spark has no NFKD)."""

    @F.pandas_udf("string")
    def make(s: pd.Series) -> pd.Series:
        plain = s.map(lambda x: None if x is None else unicodedata.normalize("NFKD", x).encode("ascii", "ignore").decode().lower())
        return plain.str.findall(r"[a-z0-9]+").str.join("-")

    return make(names)
