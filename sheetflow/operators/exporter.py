"""Tables to sheets: automatic joins, temporal forms, reverse lookups, column order, mixed unions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import temporal
from ..plans.profile import ClassSpec, Lookup, Profile, ProfileError, Slot, effective_slot, topological
from ..sources.registry import Catalogue, affinity


@dataclass
class ExportPlan:
    rows: DataFrame
    #: row (position in the output order where it has one), column, rawValue, code, message
    errors: DataFrame | None
    headers: list[str]


def auto_join(spec: ClassSpec, catalogue: Catalogue, order_by: tuple[str, ...] = ()) -> tuple[DataFrame, list[str]]:
    """Root route left-joined with its children on all injected pairs; one column for each header."""
    routes = topological(spec.routes)
    root = routes[0]
    tag = lambda t: catalogue.frame(t).select(*[F.col(c).alias(f"{t}__{c}") for c in catalogue.frame(t).columns])
    joined = tag(root.table)
    for r in routes[1:]:
        pairs = [(f.parent, p, c) for f in r.inject for p, c in f.pairs]
        if not pairs:
            raise ProfileError(f"{r.table} cannot be joined without fkInject")
        on = None
        for parent, p, c in pairs:
            term = F.col(f"{parent}__{p}") == F.col(f"{r.table}__{c}")
            on = term if on is None else on & term
        joined = joined.join(tag(r.table), on, "left")
    owner = {}
    for r in routes:
        for c in r.columns:
            owner.setdefault(c.db, r.table)
    keys = []
    for o in order_by:
        table, _, column = o.rpartition(".")
        name = f"{table or owner.get(column, root.table)}__{column}"
        if name in joined.columns:  # a class without the column is not ordered by it
            keys.append(F.col(name).asc())
    if keys:
        joined = joined.orderBy(*keys)
    outputs: dict[str, Column] = {}
    for r in routes:
        for c in r.columns:
            outputs[c.source] = F.col(f"{r.table}__{c.db}")
    hidden: dict[str, Column] = {}
    for r in routes:
        for x in r.lookups:
            if x.roundtrip:
                for _, target in x.select:
                    hidden.setdefault(f"h__{target}", F.col(f"{r.table}__{target}"))
    return joined.select(*[v.alias(k) for k, v in outputs.items()], *[v.alias(k) for k, v in hidden.items()]), list(outputs)


def slots_by_header(profile: Profile, spec: ClassSpec) -> dict[str, Slot]:
    """First declaration of a header wins; columns with a legacy date token alone stay as they are."""
    out: dict[str, Slot] = {}
    for r in topological(spec.routes):
        for c in r.columns:
            slot = effective_slot(c, profile)
            if slot:
                out.setdefault(c.source, slot)
    return out


def convert_times(rows: DataFrame, slots: dict[str, Slot]) -> tuple[DataFrame, Column]:
    """Sheet texts of temporal columns, and an array of the errors of a row."""
    changed, errors = {}, []
    for header, slot in slots.items():
        if header not in rows.columns:
            continue
        text, failed = temporal.export_value(F.col(f"`{header}`"), slot.kind, slot.db.type, slot.db.format, slot.excel.format)
        changed[header] = text
        errors.append(F.when(failed, F.struct(F.lit(header).alias("column"), F.col(f"`{header}`").cast("string").alias("rawValue"), F.lit("E_TIME_PARSE_DB").alias("code"))))
    found = F.filter(F.array(*errors), lambda e: e.isNotNull()) if errors else F.expr("cast(array() as array<struct<column:string,rawValue:string,code:string>>)")
    with_errors = rows.withColumn("time_errors", found)
    return with_errors.withColumns(changed) if changed else with_errors, F.col("time_errors")


def reverse_lookup(rows: DataFrame, lookup: Lookup, catalogue: Catalogue, tag: str, hidden: list[str] | None = None, direct: set[str] | frozenset[str] = frozenset()) -> DataFrame:
    """Fill the lookup's match headers from its selected columns.

    Adds ``<tag>_code`` (null, not found or ambiguous) and ``<tag>_skip``. A value that the sheet has itself
    (``direct``) beats the reverse value.
    """
    hidden = hidden or [f"h__{t}" for _, t in lookup.select]
    table = catalogue.frame(lookup.table)
    definition = catalogue.tables[lookup.table]
    kinds = [affinity(definition.column(g).type) for g, _ in lookup.select]
    keys = [F.col(g).cast(kind).alias(f"{tag}_k{i}") for i, ((g, _), kind) in enumerate(zip(lookup.select, kinds, strict=True))]
    values = [F.col(g).cast("string").alias(f"v{i}") for i, (g, _) in enumerate(lookup.match)]
    ref = table.select(*keys, *values).groupBy(*[f"{tag}_k{i}" for i in range(len(keys))]).agg(
        F.count(F.lit(1)).alias(f"{tag}_hits"), F.min(F.struct(*[f"v{i}" for i in range(len(values))])).alias(f"{tag}_v")
    )
    on = None
    for i, (h, kind) in enumerate(zip(hidden, kinds, strict=True)):
        term = F.col(f"`{h}`").try_cast(kind) == F.col(f"{tag}_k{i}")
        on = term if on is None else on & term
    joined = rows.join(ref, on, "left").drop(*[f"{tag}_k{i}" for i in range(len(keys))])
    hits = F.col(f"{tag}_hits")
    missing = F.when(hits.isNull(), "E_REVERSE_LOOKUP_NOT_FOUND") if lookup.on_missing == "error" else F.lit(None).cast("string")
    joined = joined.withColumn(f"{tag}_code", F.when(hits > 1, "E_REVERSE_LOOKUP_AMBIGUOUS").otherwise(missing))
    filled = {}
    for i, (_, header) in enumerate(lookup.match):
        value = F.when(hits == 1, F.col(f"{tag}_v.v{i}"))
        filled[header] = F.coalesce(F.col(f"`{header}`").cast("string"), value) if header in direct else value
    return joined.withColumns({**filled, f"{tag}_skip": F.col(f"{tag}_code").isNotNull()}).drop(f"{tag}_hits", f"{tag}_v")


def order_columns(headers: list[str], listed: tuple[str, ...]) -> list[str]:
    """Listed headers first, the rest as they come."""
    first = [h for h in listed if h in headers]
    return first + [h for h in headers if h not in first]


def _class_rows(profile: Profile, spec: ClassSpec, catalogue: Catalogue) -> tuple[DataFrame, list[str], DataFrame | None]:
    rows, headers = auto_join(spec, catalogue, profile.order_by)
    lookups = [x for r in topological(spec.routes) for x in r.lookups if x.roundtrip]
    direct = set(headers)
    codes = []
    for k, x in enumerate(lookups):
        rows = reverse_lookup(rows, x, catalogue, f"x{k}", direct=direct)
        codes.append((k, x))
        headers += [h for _, h in x.match if h not in headers]
    rows, _ = convert_times(rows, slots_by_header(profile, spec))
    errors = rows.select(F.explode("time_errors").alias("e")).select("e.*")
    for k, x in codes:
        errors = errors.unionByName(rows.filter(f"x{k}_code is not null").select(F.lit(x.match[0][1]).alias("column"), F.concat_ws(",", *[F.col(f"`h__{t}`").cast("string") for _, t in x.select]).alias("rawValue"), F.col(f"x{k}_code").alias("code")))
        rows = rows.filter(~F.col(f"x{k}_skip"))
    return rows.select(*[F.col(f"`{h}`") for h in headers]), headers, errors


def plan_export(profile: Profile, catalogue: Catalogue, spark: SparkSession | None = None) -> ExportPlan:
    """The rows and errors of an export."""
    if profile.sql:
        for name, frame in catalogue.read.items():
            frame.createOrReplaceTempView(name)
        rows = spark.sql(profile.sql)
        headers = rows.columns
        rows, _ = convert_times(rows, {h: s for c in profile.classes for h, s in slots_by_header(profile, c).items()})
        return ExportPlan(rows.select(*headers), rows.select(F.explode("time_errors").alias("e")).select("e.*"), headers)
    parts, headers, errors = [], [], None
    for spec in profile.classes:
        rows, own, bad = _class_rows(profile, spec, catalogue)
        headers += [h for h in own if h not in headers]
        if profile.mode == "mixed":
            rows = rows.select(F.lit(spec.equals).alias(profile.class_column or "class"), *[F.col(f"`{h}`").cast("string") for h in own])
        parts.append(rows)
        errors = bad if errors is None else errors.unionByName(bad)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    if profile.mode == "mixed":
        label = profile.class_column or "class"
        headers = headers if label in profile.column_order else [label, *[h for h in headers if h != label]]
        headers = headers if label in headers else [label, *headers]
    ordered = order_columns(headers, profile.column_order)
    return ExportPlan(out.select(*[F.col(f"`{h}`") for h in ordered]), errors, ordered)
