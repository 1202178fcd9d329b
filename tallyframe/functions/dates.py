"""Text to dates and times by format, and dates to text, as plain expressions.

A format holds d, m, y, H, M, S, U in runs; a run of k letters reads 1 to k digits. It is anchored at the
start of the text only. Years below 50 are in 2000-2049, those from 50 to 99 in 1950-1999.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

#: Named formats.
FORMATS = {"date": "dd/mm/yyyy", "recodedate": "dd/mm/yyyy", "iso-date": "yyyy-mm-dd", "us-date": "mm/dd/yyyy", "datetime": "dd/mm/yyyy HH:MM:SS", "iso-datetime": r"yyyy-mm-dd\s+HH:MM:SS.UU", "iso-time": "HH:MM:SS.UU"}


def _pattern(fmt: str) -> tuple[str, dict[str, int]]:
    """The regular expression of a format and the group of each letter."""
    groups: dict[str, int] = {}
    out = []
    for piece in re.split(r"(d+|m+|y+|H+|M+|S+|U+)", fmt):
        if piece and piece[0] in "dmyHMSU" and piece == piece[0] * len(piece):
            groups[piece[0]] = len(groups) + 1
            out.append(rf"([0-9]{{1,{len(piece)}}})")
        else:
            out.append(piece)
    return "^" + "".join(out), groups


def _parts(c: Column, fmt: str, needed: str, errors: str) -> tuple[Column, dict[str, Column]]:
    """A flag that the text matches, and the parts; errors: raise or null for text that does not."""
    pattern, groups = _pattern(FORMATS.get(fmt, fmt))
    if lacking := [x for x in needed if x not in groups]:
        raise ValueError(f"the format {fmt!r} lacks {', '.join(lacking)}")
    text = F.when(c != "", c)
    ok = text.rlike(pattern)
    if errors == "raise":
        ok = F.when(ok, ok).when(text.isNotNull(), F.raise_error(F.concat(F.lit(f"no date or time of format {fmt}: "), text)).cast("boolean"))
    return ok, {k: F.regexp_extract(text, pattern, g) for k, g in groups.items()}


def _year(text: Column) -> Column:
    y = text.try_cast("int")
    return F.when(y < 50, y + 2000).when(y < 100, y + 1900).otherwise(y)


def _seconds(p: dict[str, Column]) -> Column:
    if "S" not in p:
        return F.lit(0.0)
    return F.concat(p["S"], F.lit("."), p["U"] if "U" in p else F.lit("0")).try_cast("double")


def _day(p: dict[str, Column]) -> Column:
    text = F.format_string("%04d-%02d-%02d", _year(p["y"]), p["m"].try_cast("int"), p["d"].try_cast("int"))
    return text.try_cast("date")  # null for days that do not exist


def parse_date(c: Column, fmt: str = "date", errors: str = "raise") -> Column:
    """A date; null for null and empty text, and for days that do not exist."""
    ok, p = _parts(c, fmt, "dmy", errors)
    return F.when(ok, _day(p))


def parse_datetime(c: Column, fmt: str = "datetime", errors: str = "raise") -> Column:
    """A timestamp without time zone; seconds and their fraction are optional in the format."""
    ok, p = _parts(c, fmt, "dmyHM", errors)
    clock = p["H"].try_cast("int") * 3600 + p["M"].try_cast("int") * 60 + _seconds(p)
    days = F.datediff(_day(p), F.lit("1970-01-01").cast("date"))
    micros = days.cast("bigint") * 86_400_000_000 + F.round(clock * 1_000_000).cast("bigint")
    # Counted in UTC whatever the session's time zone is.
    return F.when(ok, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=(micros / 1_000_000).cast("decimal(18,6)")))


def parse_time(c: Column, fmt: str = "iso-time", errors: str = "raise") -> Column:
    """Seconds since midnight as a double, so that leap seconds have a value too."""
    ok, p = _parts(c, fmt, "HM", errors)
    return F.when(ok, p["H"].try_cast("int") * 3600 + p["M"].try_cast("int") * 60 + _seconds(p))


def ddmmyyyy(c: Column, sep: str = "/") -> Column:
    return F.coalesce(F.date_format(c, f"dd'{sep}'MM'{sep}'yyyy"), F.lit("All date/times"))


def fulldate(c: Column) -> Column:
    return F.coalesce(F.date_format(c, "EEEE, dd MMMM yyyy"), F.lit("All date/times"))


def date_ticks(low: Column, high: Column, most: int = 12) -> Column:
    """An array of at most about `most` ticks between two dates: days, weeks, months, quarters, years or decades."""
    days = F.datediff(high, low)
    ticks = None
    for span, unit, text in ((3660 * most, "year", "10 year"), (366 * most, "year", "1 year"), (92 * most, "quarter", "3 month"), (31 * most, "month", "1 month"), (7 * most, "week", "7 day"), (most, "day", "1 day")):
        seq = F.sequence(F.trunc(low, unit) if unit != "day" else low, high, F.expr(f"interval {text}"))
        ticks = seq if ticks is None else F.when(days <= span, seq).otherwise(ticks)
    return ticks


def age_group(age: Column, width: int = 5, last: int = 18) -> Column:
    """Age bands from 1, `width` years each, the last open: 1 for 0-4, 18 for 85 and over by default."""
    return F.when(age >= 0, F.least(F.floor(age / width) + 1, F.lit(last)).cast("int"))
