"""Temporal parsing and formatting: date patterns of the profile language on Spark's formatter."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Pattern token -> (Java token, strict shape of the text).
TOKENS = {
    "yyyy": ("yyyy", r"[0-9]{4}"), "yy": ("yy", r"[0-9]{2}"),
    "MMMM": ("MMMM", r"\p{L}+"), "MMM": ("MMM", r"\p{L}+"), "MM": ("MM", r"[0-9]{2}"), "M": ("M", r"[0-9]{1,2}"),
    "dddd": ("EEEE", r"\p{L}+"), "ddd": ("EEE", r"\p{L}+"), "dd": ("dd", r"[0-9]{2}"), "d": ("d", r"[0-9]{1,2}"),
    "HH": ("HH", r"[0-9]{2}"), "H": ("H", r"[0-9]{1,2}"), "hh": ("hh", r"[0-9]{2}"), "h": ("h", r"[0-9]{1,2}"),
    "mm": ("mm", r"[0-9]{2}"), "m": ("m", r"[0-9]{1,2}"), "ss": ("ss", r"[0-9]{2}"), "s": ("s", r"[0-9]{1,2}"),
    "zzz": ("SSS", r"[0-9]{3}"), "AP": ("a", r"(AM|PM)"), "ap": ("a", r"(am|pm)"),
}
DATE_TOKENS, TIME_TOKENS = {"y", "M", "d"}, {"H", "h", "m", "s", "z", "A", "a"}
_split = re.compile(r"'(?:[^']|'')*'|" + "|".join(sorted(TOKENS, key=len, reverse=True)) + r"|[A-Za-z]+|.", re.S)


class BadPattern(ValueError):
    """A date pattern with a token that is not supported."""


def tokens(pattern: str) -> list[tuple[str, bool]]:
    """(text, is a token) parts of a pattern; quoted text is literal."""
    out = []
    for m in _split.finditer(pattern):
        part = m.group()
        if part.startswith("'") and len(part) > 1:
            out.append((part[1:-1].replace("''", "'") or "'", False))
        elif part in TOKENS:
            out.append((part, True))
        elif part.isalpha() and part.isascii():
            raise BadPattern(f"unsupported token {part} in {pattern}")
        else:
            out.append((part, False))
    return out


def translate(pattern: str) -> tuple[str, str]:
    """The Java pattern and a regular expression for the strict shape of its texts."""
    parts = tokens(pattern)
    half_day = any(t in ("AP", "ap") for t, is_token in parts if is_token)
    java, shape = "", ""
    for text, is_token in parts:
        if not is_token:
            java += "'" + text.replace("'", "''") + "'" if text.isalpha() or "'" in text else text
            shape += re.escape(text)
            continue
        word, form = TOKENS[text]
        if word[0] == "h" and not half_day:
            word = word.upper()
        java, shape = java + word, shape + form
    return java, rf"\A{shape}\z"


def has_date(pattern: str) -> bool:
    return any(is_token and t[0] in DATE_TOKENS for t, is_token in tokens(pattern))


def has_time(pattern: str) -> bool:
    return any(is_token and t[0] in TIME_TOKENS for t, is_token in tokens(pattern))


def _parse(c: Column, kind: str, pattern: str) -> Column:
    java, shape = translate(pattern)
    text, form = (F.concat(F.lit("1970-01-01 "), c), f"yyyy-MM-dd {java}") if kind == "time" else (c, java)
    value = F.when(c.rlike(shape), F.try_to_timestamp(text, F.lit(form)))
    if "yy" in [t for t, is_token in tokens(pattern) if is_token]:  # two digits mean 19xx
        value = F.when(F.year(value) >= 2000, value - F.expr("INTERVAL 100 YEARS")).otherwise(value)
    return value


def parse(c: Column, kind: str, patterns: list[str] | tuple[str, ...]) -> Column:
    """Timestamp of the first pattern that fits (times lie on 1970-01-01), else null."""
    return F.coalesce(*[_parse(c, kind, p) for p in patterns])


def render(ts: Column, pattern: str) -> Column:
    java, _ = translate(pattern)
    out = F.date_format(ts, java)
    return F.lower(out) if "ap" in [t for t, is_token in tokens(pattern) if is_token] else out


def to_epoch(ts: Column) -> Column:
    return F.unix_timestamp(ts)


def from_epoch(c: Column) -> Column:
    """Strict integer seconds to a timestamp; anything else is null."""
    return F.when(c.cast("string").rlike(r"\A[+-]?[0-9]+\z"), F.timestamp_seconds(c.try_cast("bigint")))


def blank(c: Column) -> Column:
    return c.isNull() | (F.trim(c.cast("string")) == "")


def import_value(c: Column, kind: str, excel: tuple[str, ...], db_type: str, db_format: str) -> tuple[Column, Column]:
    """(stored value, failed) of a sheet cell: blank is null, text is parsed and written in the stored form."""
    ts = parse(c, kind, excel)
    stored = to_epoch(ts).cast("string") if db_type == "epochSec" else render(ts, db_format)
    return F.when(~blank(c), stored), ~blank(c) & stored.isNull()


def export_value(c: Column, kind: str, db_type: str, db_format: str, excel_format: str) -> tuple[Column, Column]:
    """(cell text, failed) of a stored value: null stays blank, the rest is parsed by the stored form."""
    ts = from_epoch(c) if db_type == "epochSec" else parse(c.cast("string"), kind, [db_format])
    text = render(ts, excel_format)
    return F.when(~blank(c), text), ~blank(c) & text.isNull()
