"""Small text expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def split_on(text: Column, char: str) -> Column:
    """Parts between the occurrences of a character, all empty ones kept."""
    return F.split(text, f"[{re.escape(char)}]", -1)


def to_hex(data: Column) -> Column:
    return F.lower(F.hex(data))


def from_hex(text: Column) -> Column:
    return F.unhex(text)


def one_line(text: Column) -> Column:
    """Tabs and line ends as spaces, one each."""
    return F.regexp_replace(text, "[\t\r\n]", " ")


def language_code(value: Column) -> Column:
    """Two letters of a language header such as en-US; a value of two letters or fewer as it is; null if there is no such code."""
    code = F.regexp_extract(value, r"^([a-z]{2})[,;-]", 1)
    return F.when(F.length(value) <= 2, value).when(code != "", code)
