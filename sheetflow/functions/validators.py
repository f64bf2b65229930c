"""Column validators: each token becomes column expressions, evaluated inside whole-stage codegen.

A token is compiled to a ``Check``: when it fails, with what code and message, and what the value is afterwards. A chain
stops at the first failure and then keeps the raw value.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .temporal import parse

NULL, TYPE, REGEX = "E_VALIDATE_NULL", "E_VALIDATE_TYPE", "E_VALIDATE_REGEX"
INTEGER = r"\A\s*[+-]?[0-9]+\s*\z"
DECIMAL = r"\A\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*\z"


class BadToken(ValueError):
    """A validator token that cannot be compiled."""


@dataclass(frozen=True)
class Check:
    fails: Callable[[Column], Column]
    code: str
    message: Callable[[Column], Column]
    #: Type of the value afterwards, or None if it stays text.
    kind: str | None = None
    convert: Callable[[Column], Column] | None = None


def as_int(c: Column) -> Column:
    return F.when(c.rlike(INTEGER), F.trim(c).try_cast("bigint"))


def as_double(c: Column) -> Column:
    return F.when(c.rlike(DECIMAL), F.trim(c).try_cast("double"))


def _number(token: str, start: str) -> int:
    try:
        return int(token[len(start) :])
    except ValueError:
        raise BadToken(f"no number in {token}") from None


#: Validators of one's own, by token.
_OWN: dict[str, Check] = {}


def register(token: str, check: Check) -> None:
    """Make ``token`` a validator for all profiles; the built-in ones cannot be replaced."""
    try:
        compile_token(token)
    except BadToken:
        _OWN[token] = check
        return
    if token not in _OWN:
        raise BadToken(f"{token} is a built-in validator")
    _OWN[token] = check


def compile_token(token: str) -> Check:
    if token in _OWN:
        return _OWN[token]
    if token == "notNull":
        return Check(lambda c: c.isNull() | (c == ""), NULL, lambda c: F.lit("a value is required"))
    if token == "int":
        return Check(lambda c: c.isNotNull() & as_int(c).isNull(), TYPE, lambda c: F.concat(F.lit("no integer: "), c), "bigint", as_int)
    if token == "decimal":
        return Check(lambda c: c.isNotNull() & as_double(c).isNull(), TYPE, lambda c: F.concat(F.lit("no decimal number: "), c), "double", as_double)
    if token.startswith("len<="):
        n = _number(token, "len<=")
        return Check(lambda c: F.coalesce(F.length(c) > n, F.lit(False)), TYPE, lambda c: F.concat(F.lit(f"longer than {n}: "), F.length(c).cast("string")))
    if token.startswith("len>="):
        n = _number(token, "len>=")
        return Check(lambda c: F.coalesce(F.length(c) < n, F.lit(False)), TYPE, lambda c: F.concat(F.lit(f"shorter than {n}: "), F.length(c).cast("string")))
    if token.startswith("int>="):
        n = _number(token, "int>=")
        return Check(lambda c: c.isNotNull() & (as_int(c).isNull() | (as_int(c) < n)), TYPE, lambda c: F.concat(F.lit(f"no integer of {n} or more: "), c), "bigint", as_int)
    if token.startswith("date:"):
        pattern = token[5:]
        day = lambda c: parse(c, "date", [pattern]).cast("date")
        return Check(lambda c: c.isNotNull() & day(c).isNull(), TYPE, lambda c: F.concat(F.lit(f"no date of form {pattern}: "), c), "date", day)
    if token.startswith("regex:"):
        pattern = rf"\A(?:{token[6:]})\z"
        return Check(lambda c: c.isNotNull() & ~c.rlike(pattern), REGEX, lambda c: F.concat(F.lit("another form is needed: "), c))
    if token.startswith("enum:"):
        allowed = [x.strip() for x in token[5:].split(",")]
        return Check(lambda c: c.isNotNull() & ~c.isin(allowed), TYPE, lambda c: F.concat(F.lit("not allowed: "), c))
    raise BadToken(f"unknown validator {token}")


@dataclass(frozen=True)
class Checked:
    code: Column
    message: Column
    value: Column
    kind: str


def chain(raw: Column, tokens: list[str] | tuple[str, ...]) -> Checked:
    """First failure of a chain and the typed value (null where a typed chain fails)."""
    checks = [compile_token(t) for t in tokens]
    typed = [c for c in checks if c.kind]
    if len(typed) > 1:
        raise BadToken(f"more than one type in {list(tokens)}")
    code, message, value, kind = F.lit(None).cast("string"), F.lit(None).cast("string"), raw, "string"
    for c in reversed(checks):
        code = F.when(c.fails(raw), c.code).otherwise(code)
        message = F.when(c.fails(raw), c.message(raw)).otherwise(message)
    if typed:
        value, kind = F.when(code.isNull(), typed[0].convert(raw)), typed[0].kind
    return Checked(code, message, value, kind)
