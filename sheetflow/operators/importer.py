"""Sheet to tables: a profile compiled to one lazy plan for each class of rows.

All routes of a class live side by side in one DataFrame: a struct of target columns, an array of errors and
a failed flag for each route. Validation, temporal conversion and foreign key injection are column expressions;
lookups are left joins with a table aggregated by its key. Uniqueness of all routes is one aggregation by (route, key)
and one join back by row, and so is the foreign key preflight of the routes that need one: the sheet is read three times
for a class however many routes it has (nine times with such a preflight), and nothing windows over or gathers the rows
of a key.

The preflight tests keys against the parents that passed uniqueness, all routes at once. A key injected from
an ancestor needs no test: a route that did not fail has ancestors that did not fail, in the same row and so in the batch.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import temporal, validators
from ..plans.profile import ClassSpec, Lookup, Profile, Route, column_tokens, effective_slot, topological
from ..sources.registry import Catalogue, affinity

ERROR = "struct<column:string,raw:string,code:string,message:string>"
NO_ERRORS = f"cast(array() as array<{ERROR}>)"


def error(column: str, raw: Column, code, message) -> Column:
    text = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(F.lit(column).alias("column"), raw.cast("string").alias("raw"), text(code).alias("code"), text(message).alias("message")).cast(ERROR)


@dataclass
class Compiled:
    """The plan of one class."""

    spec: ClassSpec
    routes: list[Route]
    rows: DataFrame
    #: Per route table: names of its target columns.
    bound: dict[str, list[str]] = field(default_factory=dict)

    def _ok(self, route: Route) -> Column:
        return ~F.col(f"failed_{self.routes.index(route)}")

    def payload(self, table: str) -> DataFrame:
        """Rows that are written to a table: those of routes that did not fail."""
        route = next(r for r in self.routes if r.table == table)
        return self.rows.filter(self._ok(route)).select("excel_row", *[F.col(f"r_{table}.`{c}`").alias(c) for c in self.bound[table]])

    def errors(self) -> DataFrame:
        every = F.concat(*[F.col(f"errors_{k}") for k in range(len(self.routes))])
        return self.rows.select("excel_row", F.explode(every).alias("e")).select(F.col("excel_row").alias("row"), "e.*")


@dataclass
class ImportPlan:
    profile: Profile
    sheet: DataFrame
    classes: list[Compiled]
    unmatched: DataFrame | None

    def errors(self) -> DataFrame:
        """One row for each rejected cell: sheet, row, column, rawValue, code, message."""
        parts = [c.errors() for c in self.classes]
        if self.unmatched is not None:
            parts.append(self.unmatched)
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out.select(F.lit(self.profile.sheet).alias("sheet"), "row", "column", F.col("raw").alias("rawValue"), "code", "message")

    def payload(self, table: str) -> DataFrame:
        parts = [c.payload(table) for c in self.classes if table in c.bound]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p, allowMissingColumns=True)
        return out

    def tables(self) -> list[str]:
        return list(dict.fromkeys(t for c in self.classes for t in c.bound))

    def written_rows(self) -> DataFrame:
        """Sheet rows of which at least one table gets something."""
        keys = [self.payload(t).select("excel_row") for t in self.tables()]
        out = keys[0]
        for k in keys[1:]:
            out = out.union(k)
        return out.distinct()


def _blank(c: Column) -> Column:
    return c.isNull() | (F.trim(c) == "")


def key_cast(c: Column, kind: str) -> Column:
    """A sheet cell as the type that a key column compares in; null if it is no such value."""
    if kind == "bigint":
        return validators.as_int(c)
    if kind == "double":
        return validators.as_double(c)
    return c.cast(kind)


def shared_lookup(lookup: Lookup, catalogue: Catalogue) -> DataFrame:
    """The reference table by key: k0.., v0.. and the number of hits (one row for each key)."""
    table = catalogue.frame(lookup.table)
    kinds = [affinity(catalogue.tables[lookup.table].column(g).type) for g, _ in lookup.match]
    keys = [F.col(g).cast(kind).alias(f"k{i}") for i, ((g, _), kind) in enumerate(zip(lookup.match, kinds, strict=True))]
    values = [F.col(g).alias(f"v{i}") for i, (g, _) in enumerate(lookup.select)]
    named = [f"k{i}" for i in range(len(keys))]
    one = F.min(F.struct(*[f"v{i}" for i in range(len(values))])).alias("v")
    return table.select(*keys, *values).groupBy(*named).agg(F.count(F.lit(1)).alias("hits"), one)


def apply_lookup(rows: DataFrame, lookup: Lookup, ref: DataFrame, catalogue: Catalogue, tag: str) -> tuple[DataFrame, Column, dict[str, Column]]:
    """Rows with one lookup joined; its error (or null) and its output columns."""
    kinds = [affinity(catalogue.tables[lookup.table].column(g).type) for g, _ in lookup.match]
    headers = [h for _, h in lookup.match]
    keys = [key_cast(F.col(f"`{h}`"), kind) for h, kind in zip(headers, kinds, strict=True)]
    mine = ref.select(*[F.col(f"k{i}").alias(f"{tag}_k{i}") for i in range(len(keys))], F.col("hits").alias(f"{tag}_hits"), F.col("v").alias(f"{tag}_v"))
    on = keys[0] == F.col(f"{tag}_k0")
    for i, k in enumerate(keys[1:], 1):
        on = on & (k == F.col(f"{tag}_k{i}"))
    joined = rows.join(mine, on, "left").drop(*[f"{tag}_k{i}" for i in range(len(keys))])
    hits = F.col(f"{tag}_hits")
    raw = F.concat_ws(",", *[F.col(f"`{h}`") for h in headers])
    case = F.when(hits.isNull(), error(headers[0], raw, "E_LOOKUP_NOT_FOUND", f"lookup {lookup.name} has no such key"))
    case = F.when(hits > 1, error(headers[0], raw, "E_LOOKUP_AMBIGUOUS", f"lookup {lookup.name} has several such keys")).otherwise(case)
    for h, k in reversed(list(zip(headers, keys, strict=True))):
        case = F.when(k.isNull(), error(h, F.col(f"`{h}`"), "E_LOOKUP_KEY_INVALID", f"no key of lookup {lookup.name}")).otherwise(case)
    for h in reversed(headers):
        case = F.when(_blank(F.col(f"`{h}`")), error(h, F.col(f"`{h}`"), "E_LOOKUP_KEY_EMPTY", f"empty key of lookup {lookup.name}")).otherwise(case)
    hit = hits == 1
    return joined, case, {target: F.when(hit, F.col(f"{tag}_v.v{i}")) for i, (_, target) in enumerate(lookup.select)}


def map_route(route: Route, profile: Profile, headers: set[str]) -> tuple[dict[str, Column], list[Column]]:
    """Target columns of a route by column expressions, and an error (or null) for each sheet column."""
    columns: dict[str, Column] = {}
    errors: list[Column] = []
    earlier = F.lit(False)
    for c in route.columns:
        raw = F.col(f"`{c.source}`") if c.source in headers else F.lit(None).cast("string")
        slot = effective_slot(c, profile)
        checked = validators.chain(raw, column_tokens(c, slot))
        bad = checked.code.isNotNull()
        case, value = F.when(bad, error(c.source, raw, checked.code, checked.message)), checked.value
        if slot:
            patterns = (slot.excel.format, *slot.excel.fallback)
            stored, failed = temporal.import_value(raw, slot.kind, patterns, slot.db.type, slot.db.format)
            skip = earlier | bad  # after an error of the route values are checked but not converted
            case = F.when(~skip & failed, error(c.source, raw, "E_TIME_PARSE", "no time of the declared form")).otherwise(case)
            value = F.when(~skip, stored)
            bad = bad | (~skip & failed)
            if slot.db.type == "epochSec":
                value = value.cast("bigint")
        columns[c.db] = value
        errors.append(case)
        earlier = earlier | bad
    return columns, errors


def compile_class(sheet: DataFrame, profile: Profile, spec: ClassSpec, catalogue: Catalogue, refs: dict) -> Compiled:
    headers = set(sheet.columns)
    routes = topological(spec.routes)
    rows = sheet if spec.equals is None else sheet.filter(F.col(f"`{profile.discriminator}`") == spec.equals)
    bound: dict[str, list[str]] = {}
    parents = {r.parent for r in routes if r.parent}
    failed: dict[str, Column] = {}
    for k, route in enumerate(routes):
        columns, errors = map_route(route, profile, headers)
        for n, lookup in enumerate(route.lookups):
            if lookup.identity not in refs:
                refs[lookup.identity] = shared_lookup(lookup, catalogue)
            rows, case, outputs = apply_lookup(rows, lookup, refs[lookup.identity], catalogue, f"l{k}_{n}")
            errors.append(case)
            columns |= outputs
        ancestors = F.coalesce(failed.get(route.parent, F.lit(False)), F.lit(False)) if route.parent else F.lit(False)
        for f in route.inject:
            for p, c in f.pairs:
                if p not in bound[f.parent]:
                    continue
                given, own = F.col(f"r_{f.parent}.`{p}`"), columns.get(c)
                case = F.when(~ancestors & given.isNull(), error(c, F.lit(None), "E_VALIDATE_FK", f"{f.parent}.{p} is null"))
                if own is not None:
                    clash = ~ancestors & own.isNotNull() & given.isNotNull() & ~own.cast("string").eqNullSafe(given.cast("string"))
                    case = F.when(clash, error(c, own, "E_VALIDATE_FK", f"differs from {f.parent}.{p}")).otherwise(case)
                errors.append(case)
                columns[c] = F.when(~ancestors, given).otherwise(own if own is not None else F.lit(None))
        found = F.filter(F.array(*errors), lambda e: e.isNotNull()) if errors else F.expr(NO_ERRORS)
        rows = rows.withColumns({f"r_{route.table}": F.struct(*[v.alias(n) for n, v in columns.items()]), f"errors_{k}": found})
        rows = rows.withColumn(f"failed_{k}", (F.size(f"errors_{k}") > 0) | ancestors)
        failed[route.table] = F.col(f"failed_{k}")
        bound[route.table] = list(columns)
    out = Compiled(spec, routes, rows, bound)
    out.rows = inherit(out, unique(out, parents))
    out.rows = inherit(out, preflight(out, catalogue))
    return out


def inherit(c: Compiled, rows: DataFrame) -> DataFrame:
    """A route fails with its parent."""
    for k, route in enumerate(c.routes):
        if route.parent:
            at = next(i for i, r in enumerate(c.routes) if r.table == route.parent)
            rows = rows.withColumn(f"failed_{k}", F.col(f"failed_{k}") | F.col(f"failed_{at}"))
    return rows


def key_text(keys: list[Column]) -> Column:
    """One text for a key: each part behind its length, so no two keys share one."""
    parts = [k.cast("string") for k in keys]
    return F.concat(*[F.concat(F.length(x).cast("string"), F.lit(":"), x) for x in parts])


def _marked(c: Compiled, rows: DataFrame, found: DataFrame) -> DataFrame:
    """Rows with the found errors (excel_row, k, e) added to their routes; at most one row of errors for each row."""
    marks = found.groupBy(F.col("excel_row").alias("m_row")).agg(F.collect_list(F.struct("k", "e")).alias("marks"))
    rows = rows.join(marks, F.col("excel_row") == F.col("m_row"), "left")
    for k in range(len(c.routes)):
        mine = F.transform(F.filter("marks", lambda x: x["k"] == k), lambda x: x["e"])  # noqa: B023  used at once
        more = F.coalesce(mine, F.expr(NO_ERRORS))
        rows = rows.withColumns({f"errors_{k}": F.concat(f"errors_{k}", more), f"failed_{k}": F.col(f"failed_{k}") | (F.size(more) > 0)})
    return rows.drop("m_row", "marks")


def _exploded(rows: DataFrame, parts: list[Column]) -> DataFrame:
    """excel_row and the fields of each of the structs that is not null."""
    return rows.select("excel_row", F.explode(F.array(*parts)).alias("x")).filter("x is not null").select("excel_row", "x.*")


def unique(c: Compiled, parents: set[str]) -> DataFrame:
    """Of the rows with one conflict key of a route the first stays; equal repeats of a parent are no error."""
    tested = []
    for k, route in enumerate(c.routes):
        if not route.conflict or any(x not in c.bound[route.table] for x in route.conflict):
            continue
        record = f"r_{route.table}"
        keys = [F.col(f"{record}.`{x}`") for x in route.conflict]
        # binds are compared as JSON text, nulls included: structs have no null-safe order in one aggregate
        binds = F.to_json(F.col(record), {"ignoreNullFields": "false"}) if route.table in parents else F.lit(None).cast("string")
        text = key_text(keys)  # null with any part
        tested.append(F.when(~F.col(f"failed_{k}") & text.isNotNull(), F.struct(F.lit(k).alias("k"), text.alias("key"), F.concat_ws(",", *[x.cast("string") for x in keys]).alias("raw"), binds.alias("binds"))))
    if not tested:
        return c.rows
    every = _exploded(c.rows, tested)
    first = every.groupBy(F.col("k").alias("u_k"), F.col("key").alias("u_key")).agg(F.min(F.struct("excel_row", "binds")).alias("u_first"), F.count(F.lit(1)).alias("u_n")).filter("u_n > 1")
    late = every.join(first, (F.col("k") == F.col("u_k")) & (F.col("key") == F.col("u_key"))).filter("excel_row > u_first.excel_row and (binds is null or binds <> u_first.binds)")
    named = F.element_at(F.array(*[F.lit(",".join(r.conflict)) for r in c.routes]), F.col("k") + 1)
    message = F.concat(F.lit("repeats the key of row "), F.col("u_first.excel_row").cast("string"))
    what = F.struct(named.alias("column"), F.col("raw"), F.lit("E_VALIDATE_DUPLICATE").alias("code"), message.alias("message")).cast(ERROR)
    return _marked(c, c.rows, late.select("excel_row", "k", what.alias("e")))


def ancestors_of(c: Compiled, route: Route) -> set[str]:
    out: set[str] = set()
    while route.parent and route.parent not in out:
        out.add(route.parent)
        route = next(r for r in c.routes if r.table == route.parent)
    return out


def preflight(c: Compiled, catalogue: Catalogue) -> DataFrame:
    """Injected keys must exist among the batch's parents or in the parent table."""
    wanted, there, stored = [], [], None
    for k, route in enumerate(c.routes):
        for f in route.inject:
            parent = next((r for r in c.routes if r.table == f.parent), None)
            if parent is None or f.parent in ancestors_of(c, route) or any(p in {t for x in parent.lookups for _, t in x.select} for p, _ in f.pairs):
                continue
            at, n = c.routes.index(parent), len(wanted)
            child, given = [F.col(f"r_{route.table}.`{b}`") for _, b in f.pairs], [F.col(f"r_{f.parent}.`{p}`") for p, _ in f.pairs]
            column, raw = F.lit(",".join(b for _, b in f.pairs)), F.concat_ws(",", *[b.cast("string") for b in child])
            wanted.append(F.when(~F.col(f"failed_{k}") & key_text(child).isNotNull(), F.struct(F.lit(k).alias("k"), F.lit(n).alias("n"), key_text(child).alias("key"), column.alias("column"), raw.alias("raw"), F.lit(f.parent).alias("parent"))))
            there.append(F.when(~F.col(f"failed_{at}") & key_text(given).isNotNull(), F.struct(F.lit(n).alias("n"), key_text(given).alias("key"))))
            if f.parent in catalogue.read:
                kept = catalogue.frame(f.parent).select(F.lit(n).alias("n"), key_text([F.col(p) for p, _ in f.pairs]).alias("key")).filter("key is not null")
                stored = kept if stored is None else stored.unionByName(kept)
    if not wanted:
        return c.rows
    known = _exploded(c.rows, there).select("n", "key")
    known = known if stored is None else known.unionByName(stored)
    known = known.select(F.col("n").alias("p_n"), F.col("key").alias("p_key"))
    lost = _exploded(c.rows, wanted).join(known, (F.col("n") == F.col("p_n")) & (F.col("key") == F.col("p_key")), "left_anti")
    what = F.struct("column", "raw", F.lit("E_VALIDATE_FK").alias("code"), F.concat(F.lit("no such row in "), F.col("parent")).alias("message")).cast(ERROR)
    return _marked(c, c.rows, lost.select("excel_row", "k", what.alias("e")))


def plan_import(sheet: DataFrame, profile: Profile, catalogue: Catalogue) -> ImportPlan:
    """Compile the import of a sheet (string columns and ``excel_row``)."""
    refs: dict = {}
    classes = [compile_class(sheet, profile, spec, catalogue, refs) for spec in profile.classes]
    unmatched = None
    if profile.discriminator:
        d = F.col(f"`{profile.discriminator}`")
        lost = sheet.filter(d.isNull() | ~d.isin([c.equals for c in profile.classes]))
        unmatched = lost.select(F.col("excel_row").alias("row"), error(profile.discriminator, d, "E_ROUTE_UNMATCHED", "no class matches").alias("e")).select("row", "e.*")
    return ImportPlan(profile, sheet, classes, unmatched)
