"""The profile language: a JSON document that declares how a sheet and tables correspond."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from ..functions import temporal

NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*\Z")
ORDER = re.compile(r"[A-Za-z_][A-Za-z0-9_]*(\.[A-Za-z_][A-Za-z0-9_]*)?\Z")
SLOT_KEYS = {"dateFormat": "date", "datetimeFormat": "datetime", "timeFormat": "time"}


class ProfileError(ValueError):
    def __init__(self, message: str, code: str = "E_PROFILE_PARSE"):
        super().__init__(f"{code}: {message}")
        self.code = code


@dataclass(frozen=True)
class Side:
    type: str = "string"
    format: str = ""
    fallback: tuple[str, ...] = ()


@dataclass(frozen=True)
class Slot:
    kind: str
    excel: Side | None = None
    db: Side | None = None


@dataclass(frozen=True)
class ColumnSpec:
    db: str
    source: str
    validators: tuple[str, ...] = ()
    slot: Slot | None = None


@dataclass(frozen=True)
class FkInject:
    parent: str
    pairs: tuple[tuple[str, str], ...]


@dataclass(frozen=True)
class Lookup:
    name: str
    table: str
    match: tuple[tuple[str, str], ...]  # (lookup column, sheet header)
    select: tuple[tuple[str, str], ...]  # (lookup column, target column)
    roundtrip: bool = True
    on_missing: str = "error"

    @property
    def identity(self) -> tuple:
        """Lookups of one identity share their reference table."""
        return self.table, tuple(g for g, _ in self.match), tuple(g for g, _ in self.select)


@dataclass(frozen=True)
class Route:
    table: str
    columns: tuple[ColumnSpec, ...]
    conflict: tuple[str, ...] = ()
    parent: str | None = None
    inject: tuple[FkInject, ...] = ()
    lookups: tuple[Lookup, ...] = ()


@dataclass(frozen=True)
class ClassSpec:
    id: str
    equals: str | None
    routes: tuple[Route, ...]


@dataclass(frozen=True)
class Profile:
    name: str
    sheet: str
    mode: str
    header_row: int = 1
    classes: tuple[ClassSpec, ...] = ()
    discriminator: str | None = None
    slots: dict = field(default_factory=dict)
    order_by: tuple[str, ...] = ()
    sql: str | None = None
    class_column: str | None = None
    column_order: tuple[str, ...] = ()

    @property
    def routes(self) -> tuple[Route, ...]:
        return tuple(r for c in self.classes for r in c.routes)


def _need(ok, message: str) -> None:
    if not ok:
        raise ProfileError(message)


def _name(text, what: str) -> str:
    _need(isinstance(text, str) and NAME.match(text), f"{what} is no identifier: {text!r}")
    return text


def _pairs(value, what: str) -> tuple[tuple[str, str], ...]:
    _need(isinstance(value, list) and value, f"{what} needs pairs")
    for p in value:
        _need(isinstance(p, list) and len(p) == 2 and all(isinstance(x, str) and x for x in p), f"{what} has a pair that is none")
    return tuple((a, b) for a, b in value)


def _side(value, kind: str, side: str) -> Side:
    _need(isinstance(value, dict), f"{side} of a {kind} slot must be an object")
    type_, form, fallback = value.get("type", "string"), value.get("format", ""), tuple(value.get("fallback", ()))
    _need(type_ in ("string", "epochSec"), f"unknown type {type_}")
    if type_ == "epochSec":
        _need(kind == "datetime" and side == "db" and not form, "epochSec goes with datetimeFormat.db and no format")
    else:
        _need(form, f"{side} of a {kind} slot needs a format")
    _need(not fallback or side == "excel", "only the sheet side has fallbacks")
    for f in (form, *fallback):
        _need(not (kind == "date" and f and temporal.has_time(f)), f"time token in date format {f}")
        _need(not (kind == "time" and f and temporal.has_date(f)), f"date token in time format {f}")
    return Side(type_, form, fallback)


def _slot(value, kind: str) -> Slot:
    _need(isinstance(value, dict), f"{kind} slot must be an object")
    flat = {"excelFormat", "dbFormat", "excelFormatFallback"} & set(value)
    _need(not (flat and {"excel", "db"} & set(value)), "a slot is either flat or two-sided")
    if flat:
        excel = {"format": value.get("excelFormat", ""), "fallback": value.get("excelFormatFallback", ())} if "excelFormat" in value else None
        db = {"format": value["dbFormat"]} if "dbFormat" in value else None
    else:
        excel, db = value.get("excel"), value.get("db")
    return Slot(kind, _side(excel, kind, "excel") if excel is not None else None, _side(db, kind, "db") if db is not None else None)


def _slots(value: dict) -> list[Slot]:
    return [_slot(value[k], kind) for k, kind in SLOT_KEYS.items() if k in value]


def _column(db: str, value: dict) -> ColumnSpec:
    _name(db, "column")
    _need(isinstance(value, dict), f"column {db} must be an object")
    own = _slots(value)
    _need(len(own) <= 1, f"column {db} has more than one temporal slot")
    return ColumnSpec(db, value.get("source", db), tuple(value.get("validators", ())), own[0] if own else None)


def _lookup(value: dict) -> Lookup:
    for key in ("name", "from"):
        _name(value.get(key), f"lookup {key}")
    missing = value.get("exportOnMissing", "error")
    _need(missing in ("error", "null", "skip"), f"unknown exportOnMissing {missing}")
    return Lookup(value["name"], value["from"], _pairs(value.get("match"), "match"), _pairs(value.get("select"), "select"), value.get("exportRoundtrip", True), missing)


def _route(value: dict) -> Route:
    table = _name(value.get("table"), "table")
    columns = value.get("columns", {})
    _need(isinstance(columns, dict), "columns must be an object")
    inject = value.get("fkInject", [])
    _need(isinstance(inject, list), "fkInject must be an array")
    return Route(
        table,
        tuple(_column(c, columns[c]) for c in sorted(columns)),
        tuple(_name(c, "conflict column") for c in value.get("conflict", {}).get("columns", ())),
        value.get("parent"),
        tuple(FkInject(_name(f.get("from"), "fkInject.from"), _pairs(f.get("pairs"), "fkInject")) for f in inject),
        tuple(_lookup(x) for x in value.get("lookups", ())),
    )


def load_profile(source: str | dict) -> Profile:
    """A profile from JSON text or its parsed form."""
    try:
        doc = json.loads(source) if isinstance(source, str) else source
    except ValueError as e:
        raise ProfileError(str(e)) from None
    _need(isinstance(doc, dict), "a profile is an object")
    mode, header = doc.get("mode"), doc.get("headerRow", 1)
    _need(doc.get("profileName"), "profileName is missing")
    _need(doc.get("sheet"), "sheet is missing")
    _need(mode in ("singleTable", "multiTable", "mixed"), f"unknown mode {mode}")
    _need(isinstance(header, int) and header >= 1, "headerRow starts at 1")
    export = doc.get("export", {})
    for key in ("reverseLookups", "exportLookups"):
        _need(key not in export, f"export.{key}: lookups are declared once, on the route")
    discriminator = None
    if mode == "mixed":
        discriminator = doc.get("discriminator", {}).get("source")
        _need(discriminator, "mixed mode needs discriminator.source")
        _need("sql" not in export, "export.sql does not go with mixed mode")
        classes = tuple(ClassSpec(c.get("id", c["match"]["equals"]), c["match"]["equals"], tuple(_route(r) for r in c["routes"])) for c in doc.get("classes", ()))
        values = [c.equals for c in classes]
        _need(len(set(values)) == len(values), "two classes match the same value")
    elif mode == "multiTable":
        classes = (ClassSpec("", None, tuple(_route(r) for r in doc.get("routes", ()))),)
    else:
        classes = (ClassSpec("", None, (_route(doc),)),)
    _need(all(c.routes for c in classes) and classes, "no routes")
    order = tuple(export.get("orderBy", ()))
    for o in order:
        _need(ORDER.match(o), f"orderBy: {o!r}")
    return Profile(
        doc["profileName"], doc["sheet"], mode, header, classes, discriminator, {s.kind: s for s in _slots(doc)}, order,
        export.get("sql"), export.get("classColumn", doc.get("classColumn")), tuple(export.get("columnOrder", ())),
    )


def effective_slot(column: ColumnSpec, profile: Profile) -> Slot | None:
    """The temporal slot of a column, with sides it does not declare taken from the profile."""
    has_date_token = any(v.startswith("date:") for v in column.validators)
    if column.slot is not None:
        base = None if has_date_token else profile.slots.get(column.slot.kind)
        excel = column.slot.excel or (base.excel if base else None)
        db = column.slot.db or (base.db if base else None)
        return Slot(column.slot.kind, excel or db, db or excel) if excel or db else None
    if column.validators:  # any validator at all keeps the profile's slots away
        return None
    for kind in ("date", "datetime", "time"):
        slot = profile.slots.get(kind)
        if slot:
            return Slot(kind, slot.excel or slot.db, slot.db or slot.excel)
    return None


def column_tokens(column: ColumnSpec, slot: Slot | None) -> tuple[str, ...]:
    """Validator tokens; a slot takes the place of date tokens."""
    return tuple(t for t in column.validators if not (slot and t.startswith("date:")))


def topological(routes: tuple[Route, ...]) -> list[Route]:
    """Parents before children, else in declaration order."""
    by = {r.table: r for r in routes}
    for r in routes:
        if r.parent is not None and r.parent not in by:
            raise ProfileError(f"{r.table} has an unknown parent {r.parent}")
    done: list[Route] = []
    left = list(routes)
    while left:
        ready = next((r for r in left if r.parent is None or by[r.parent] in done), None)
        if ready is None:
            raise ProfileError("routes form a cycle", "E_PROFILE_TOPOLOGY_CYCLE")
        done.append(ready)
        left.remove(ready)
    return done
