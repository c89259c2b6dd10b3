"""Column functions and name functions shared by the operators."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"


def number(text: Column) -> Column:
    """Text as a double; null where it isn't a plain number."""
    trimmed = F.trim(text)
    return F.when(trimmed.rlike(NUMBER), trimmed.try_cast("double"))


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def known(x: Column) -> Column:
    """NaN as null: missing has one form here."""
    return F.when(~F.isnan(x), x)


def blank(text: Column) -> Column:
    t = F.lower(F.trim(text))
    return t.isNull() | t.isin("", "nan", "none", "null")


def cell(text: Column) -> Column:
    """A cell's text on one line, spaces collapsed, lower case."""
    return F.lower(F.trim(F.regexp_replace(F.translate(text, " \t\r\n", "    "), " +", " ")))


def escaped(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def shown(x: Column, digits: int = 4) -> Column:
    """A number for a report; N/A where it is missing."""
    return F.when(finite(x), F.format_number(x, digits)).otherwise(F.lit("N/A"))


def one_line(name: object) -> str:
    text = unicodedata.normalize("NFKC", "" if name is None else str(name))
    return re.sub(r"\s+", " ", text).strip()


#: Units that are written differently in the sources.
SAME_NAMES = {"pm2.5 (ugm-3)": "pm2.5 ugm-3"}


def canonical(name: object) -> str:
    """A column name as used everywhere: NFKC, one line, lower case, u for micro."""
    text = one_line(name).replace("µ", "u").replace("μ", "u").lower()
    return SAME_NAMES.get(text, text)
