"""Declared source columns and the conversion of their text to types."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from tallyframe.functions import dates

Converter = Callable[[Column, str], Column]


@dataclass(frozen=True)
class SourceColumn:
    """A column of a source: where it is and how its text becomes a value.

    Positional sources use ordinalpos, counted from posbase; fixed-width ones startpos (from posbase) and
    length; others the name in the source. missing: texts that mean no value.
    """

    name: str
    datatype: str = "str"
    label: str = ""
    ordinalpos: int | None = None
    startpos: int | None = None
    length: int | None = None
    posbase: int = 0
    source: str | None = None
    format: str = ""
    missing: tuple[str, ...] = ()

    @property
    def source_name(self) -> str:
        return self.source or self.name


def _int(c: Column, _: str) -> Column:
    """A whole number; a number with a fraction is rounded."""
    return F.coalesce(c.try_cast("bigint"), F.round(c.try_cast("double")).try_cast("bigint"))


CONVERTERS: dict[str, Converter] = {
    "str": lambda c, _: c,
    "recode": lambda c, _: c,
    "int": _int,
    "long": _int,
    "float": lambda c, _: c.try_cast("double"),
    "date": lambda c, f: dates.parse_date(c, f or "date"),
    "recodedate": lambda c, f: dates.parse_date(c, f or "recodedate"),
    "datetime": lambda c, f: dates.parse_datetime(c, f or "datetime"),
    "time": lambda c, f: dates.parse_time(c, f or "iso-time"),
    "iso-date": lambda c, _: dates.parse_date(c, "iso-date"),
    "us-date": lambda c, _: dates.parse_date(c, "us-date"),
    "iso-datetime": lambda c, _: dates.parse_datetime(c, "iso-datetime"),
    "iso-time": lambda c, _: dates.parse_time(c, "iso-time"),
}


def add_datatype(name: str, convert: Converter) -> None:
    """Register a conversion from text: a function of a Column and a format."""
    CONVERTERS[name.lower()] = convert


def converted(c: Column, column: SourceColumn, missing: tuple[str, ...] = ()) -> Column:
    """The typed value of a text column; empty text and missing tokens are null.

    Text that is no number becomes null, text that is no date raises.
    """
    try:
        convert = CONVERTERS[column.datatype.lower()]
    except KeyError:
        raise ValueError(f"unknown data type {column.datatype!r}") from None
    tokens = ["", *missing, *column.missing]
    text = F.when(~c.isin(tokens), c)
    return convert(text, column.format).alias(column.name)
