"""Checks of a profile against headers and tables, and profiles derived from a table."""

from __future__ import annotations

from ..functions import validators
from ..sources.registry import Catalogue, TableDef, affinity
from .profile import Profile, ProfileError, Route, column_tokens, effective_slot, topological

Issue = tuple[str, str]  # code, message


def _key_fits(table: TableDef, conflict: tuple[str, ...]) -> bool:
    keys = [set(table.primary_key)] if table.primary_key else []
    return set(conflict) in keys + [set(u) for u in table.unique]


def check_route(route: Route, siblings: dict[str, Route], catalogue: Catalogue, headers: set[str] | None) -> list[Issue]:
    table = catalogue.tables.get(route.table)
    if table is None:
        return [("E_PROFILE_TABLE_NOT_FOUND", route.table)]
    out: list[Issue] = []

    def column(t: TableDef, name: str) -> None:
        if t.column(name) is None:
            out.append(("E_PROFILE_COLUMN_NOT_FOUND", f"{t.name}.{name}"))

    def header(name: str) -> None:
        if headers is not None and name not in headers:
            out.append(("E_HEADER_NOT_FOUND", name))

    for c in route.conflict:
        column(table, c)
    if not _key_fits(table, route.conflict):
        out.append(("E_PROFILE_NO_CONFLICT_KEY", f"{route.table}: {', '.join(route.conflict) or 'none'}"))
    writers: dict[str, str] = {}

    def writes(name: str, who: str) -> None:
        column(table, name)
        if name in writers and writers[name] != who:
            out.append(("E_PROFILE_PARSE", f"{route.table}.{name} is written by {writers[name]} and {who}"))
        writers.setdefault(name, who)

    for c in route.columns:
        header(c.source)
        writes(c.db, "the sheet")
    names = [x.name for x in route.lookups]
    if len(set(names)) < len(names):
        out.append(("E_PROFILE_PARSE", f"{route.table}: two lookups of one name"))
    produced = {target for x in route.lookups for _, target in x.select}
    for x in route.lookups:
        ref = catalogue.tables.get(x.table)
        if ref is None:
            out.append(("E_PROFILE_TABLE_NOT_FOUND", x.table))
            continue
        for g, h in x.match:
            column(ref, g)
            header(h)
            if h in produced and h not in {c.source for c in route.columns}:
                out.append(("E_PROFILE_PARSE", f"lookup {x.name} reads what a lookup writes"))
        for g, target in x.select:
            column(ref, g)
            writes(target, f"lookup {x.name}")
    injected: set[str] = set()
    for f in route.inject:
        parent = siblings.get(f.parent)
        if parent is None:
            out.append(("E_PROFILE_PARSE", f"fkInject from {f.parent}, which is no route"))
            continue
        by_lookup = {t for x in parent.lookups for _, t in x.select}
        by_sheet = {c.db for c in parent.columns} | {b for g in parent.inject for _, b in g.pairs}
        sides = {p in by_lookup for p, _ in f.pairs}
        if len(sides) > 1:
            out.append(("E_PROFILE_PARSE", f"fkInject of {route.table} mixes sheet and lookup columns of {f.parent}"))
        for p, c in f.pairs:
            if p not in by_lookup | by_sheet:
                out.append(("E_PROFILE_COLUMN_NOT_FOUND", f"{f.parent}.{p}"))
            column(table, c)
            if c in injected:
                out.append(("E_PROFILE_PARSE", f"{route.table}.{c} is injected twice"))
            injected.add(c)
            writes(c, writers.get(c, "fkInject") if writers.get(c) == "the sheet" else "fkInject")
    return out


def check_profile(profile: Profile, catalogue: Catalogue, headers: set[str] | None = None) -> list[Issue]:
    """All that is wrong with a profile; headers only for imports."""
    out: list[Issue] = []
    for c in profile.classes:
        by = {r.table: r for r in c.routes}
        try:
            topological(c.routes)
        except ProfileError as e:
            out.append((e.code, str(e)))
        for r in c.routes:
            if r.parent and not r.inject:
                out.append(("E_PROFILE_PARSE", f"{r.table} has a parent but no fkInject"))
            out += check_route(r, by, catalogue, headers)
            for column in r.columns:
                try:
                    tokens = column_tokens(column, effective_slot(column, profile))
                    if sum(bool(validators.compile_token(t).kind) for t in tokens) > 1:
                        raise validators.BadToken("more than one type")
                except ValueError as e:
                    out.append(("E_PROFILE_PARSE", f"{r.table}.{column.db}: {e}"))
    if profile.mode == "mixed" and headers is not None and profile.discriminator not in headers:
        out.append(("E_HEADER_NOT_FOUND", profile.discriminator or ""))
    return out


def check_column_order(profile: Profile, headers: list[str]) -> list[Issue]:
    out: list[Issue] = []
    if profile.column_order and profile.sql:
        out.append(("E_EXPORT_ORDER_WITH_RAW_SQL", profile.name))
    seen: set[str] = set()
    for h in profile.column_order:
        if h in seen:
            out.append(("E_EXPORT_DUPLICATE_ORDER", h))
        elif h not in headers and h != profile.class_column:
            out.append(("E_EXPORT_UNKNOWN_HEADER", h))
        seen.add(h)
    return out


def order_warnings(profile: Profile) -> list[Issue]:
    """Columns of orderBy whose stored text does not sort by time."""
    out: list[Issue] = []
    columns = {c.db: c for r in profile.routes for c in r.columns}
    for o in profile.order_by:
        c = columns.get(o.rpartition(".")[2])
        slot = effective_slot(c, profile) if c else None
        if slot and slot.db.type == "string" and slot.kind != "time" and not slot.db.format.startswith("yyyy"):
            out.append(("W_TIME_ORDERBY_NONSORTABLE", o))
    return out


def auto_profile(table: TableDef, sheet: str | None = None) -> tuple[dict, bool, list[str]]:
    """(profile document, executable, issues) for a table."""
    manual = [c for c in table.columns if not c.auto_increment and not c.generated]
    auto = {c.name for c in table.columns if c.auto_increment}
    key = tuple(c for c in table.primary_key if c not in auto)
    if not key and table.unique:
        key = min(table.unique, key=lambda u: (len(u), u))
    kinds = {"bigint": ["int"], "double": ["decimal"]}
    columns = {}
    for c in manual:
        tokens = ["notNull"] if c.not_null and c.name not in key else []
        tokens += ["date:yyyy-MM-dd"] if c.type.upper() == "DATE" else kinds.get(affinity(c.type), [])
        columns[c.name] = {"source": c.name, "validators": tokens}
    doc = {"profileName": f"{table.name}_auto", "sheet": sheet or table.name, "mode": "singleTable", "table": table.name, "conflict": {"columns": list(key)}, "columns": columns}
    if key:
        doc["export"] = {"orderBy": [key[0]]}
    return doc, bool(key), [] if key else [f"{table.name} has no key that can be written"]
