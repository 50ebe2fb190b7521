"""Date and time functions, in UTC."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_MICROS = {"microsecond": 1, "millisecond": 1_000, "second": 1_000_000, "minute": 60_000_000, "hour": 3_600_000_000, "day": 86_400_000_000, "week": 604_800_000_000}
_FORMATS = {"Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "j": "DDD", "y": "yy", "b": "MMM", "B": "MMMM", "a": "EEE", "A": "EEEE", "I": "hh", "p": "a", "F": "yyyy-MM-dd", "T": "HH:mm:ss"}


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def micros(x) -> Column:
    """Microseconds since 1970-01-01."""
    return F.unix_micros(_col(x).cast("timestamp_ltz"))


def modified(x, *modifiers: str) -> Column:
    """A timestamp after modifiers such as '+1 month' or '-2 day'."""
    out = _col(x).cast("timestamp_ntz")
    for m in modifiers:
        found = re.fullmatch(r"\s*([+-]?\d+)\s+(year|month|day|hour|minute|second)s?\s*", m)
        if not found:
            raise ValueError(f"unknown modifier {m!r}")
        out = F.timestamp_add(found[2].upper(), F.lit(int(found[1])), out)
    return out


def date(x, *modifiers: str) -> Column:
    return modified(x, *modifiers).cast("date")


def datetime(x, *modifiers: str) -> Column:
    """Text YYYY-MM-DD HH:MM:SS."""
    return F.date_format(modified(x, *modifiers), "yyyy-MM-dd HH:mm:ss")


def strftime(fmt: str, x, *modifiers: str) -> Column:
    """Text by % fields."""
    out, k, plain = [], 0, ""
    while k < len(fmt):
        if fmt[k] == "%" and k + 1 < len(fmt):
            k += 1
            if fmt[k] == "%":
                plain += "%"
            elif fmt[k] in _FORMATS:
                if plain:
                    out.append("'" + plain.replace("'", "''") + "'")
                    plain = ""
                out.append(_FORMATS[fmt[k]])
            else:
                raise ValueError(f"unknown field %{fmt[k]}")
        else:
            plain += fmt[k]
        k += 1
    if plain:
        out.append("'" + plain.replace("'", "''") + "'")
    return F.date_format(modified(x, *modifiers), "".join(out))


def extract(field: str, x) -> Column:
    x, f = _col(x), field.lower()
    if f == "epoch":
        return micros(x) / 1e6
    if f == "dow":
        return (F.dayofweek(x) - 1).cast("long")
    native = {"year": F.year, "month": F.month, "day": F.dayofmonth, "hour": F.hour, "minute": F.minute, "second": F.second, "doy": F.dayofyear}
    if f not in native:
        raise ValueError(f"unknown field {field!r}")
    return native[f](x).cast("long")


def date_trunc(part: str, x) -> Column:
    """Also decade, century and millennium (which start in years 1 modulo 100 and 1000)."""
    x, p = _col(x).cast("timestamp_ntz"), part.lower()
    if p in ("decade", "century", "millennium"):
        year = F.year(x)
        first = F.floor(year / 10) * 10 if p == "decade" else F.floor((year - 1) / (100 if p == "century" else 1000)) * (100 if p == "century" else 1000) + 1
        return F.make_date(first.cast("int"), F.lit(1), F.lit(1)).cast("timestamp_ntz")
    return F.date_trunc(p, x).cast("timestamp_ntz")


def date_diff(part: str, a, b) -> Column:
    """b - a: whole units, rounded down; months and years by day of the month."""
    p = part.lower()
    a, b = _col(a), _col(b)
    if p in _MICROS:
        return F.floor((micros(b) - micros(a)) / _MICROS[p]).cast("long")
    months = (F.year(b) - F.year(a)) * 12 + F.month(b) - F.month(a)
    full = F.when((months > 0) & (F.dayofmonth(b) < F.dayofmonth(a)), months - 1).when((months < 0) & (F.dayofmonth(b) > F.dayofmonth(a)), months + 1).otherwise(months)
    units = {"month": 1, "quarter": 3, "year": 12}
    if p not in units:
        raise ValueError(f"unknown part {part!r}")
    return F.call_function("div", full, F.lit(units[p])).cast("long")


def last_day(x) -> Column:
    return F.date_format(F.last_day(_col(x).cast("date")), "yyyy-MM-dd")


def next_day(x, name: str) -> Column:
    """Text of the next such weekday, strictly after."""
    return F.date_format(F.next_day(_col(x).cast("date"), name), "yyyy-MM-dd")


def make_date(year, month, day) -> Column:
    return F.date_format(F.make_date(_col(year), _col(month), _col(day)), "yyyy-MM-dd")


def to_timestamp(x) -> Column:
    """From seconds since 1970, or from text."""
    return F.timestamp_seconds(_col(x)).cast("timestamp_ntz")


def age(a, b) -> Column:
    """Text 'N days HH:MM:SS[.ffffff]' of a - b."""
    d = micros(a) - micros(b)
    days = F.floor(d / 86_400_000_000)
    rest = d - days * 86_400_000_000
    text = F.format_string("%d days %02d:%02d:%02d", days, F.floor(rest / 3_600_000_000), F.floor(rest / 60_000_000) % 60, F.floor(rest / 1_000_000) % 60)
    return F.when(rest % 1_000_000 == 0, text).otherwise(F.concat(text, F.format_string(".%06d", rest % 1_000_000)))
