"""The facade: imports and exports over a snapshot store, batch transfers, and a replica."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import replication
from .operators.exporter import ExportPlan, plan_export
from .operators.importer import ImportPlan, plan_import
from .operators.merge import last_by_key, upsert
from .plans.checks import check_column_order, check_profile, order_warnings
from .plans.profile import Profile, load_profile
from .sources.registry import Catalogue, TableDef
from .sources.snapshots import SnapshotStore
from .sources.xlsx import SheetError, export_xlsx, read_xlsx


@dataclass
class ImportResult:
    ok: bool
    read_rows: int = 0
    written_rows: int = 0
    #: sheet, row, column, rawValue, code, message
    errors: DataFrame | None = None
    issues: list[tuple[str, str]] = field(default_factory=list)
    #: In a dry run: the rows that would be written, by table.
    payloads: dict[str, DataFrame] = field(default_factory=dict)
    version: int | None = None


@dataclass
class ExportResult:
    ok: bool
    rows: int
    errors: DataFrame | None
    #: Columns of the order whose stored text does not sort by time.
    warnings: list[tuple[str, str]] = field(default_factory=list)


class Bridge:
    """Sheets and the tables of a store."""

    def __init__(self, spark: SparkSession, store: SnapshotStore, tables: dict[str, TableDef]):
        self.spark, self.store, self.definitions = spark, store, tables
        self.profiles: dict[str, Profile] = {}

    def catalogue(self) -> Catalogue:
        there = self.store.tables()
        return Catalogue(self.definitions, {t: self.store.read(t) for t in there})

    def load(self, document: str | dict) -> Profile:
        profile = load_profile(document)
        self.profiles[profile.name] = profile
        return profile

    def user_tables(self) -> list[str]:
        return self.catalogue().user_tables()

    def describe(self) -> DataFrame:
        return self.catalogue().describe(self.spark)

    def _empty(self, table: str) -> DataFrame:
        kinds = {"INTEGER": "bigint", "REAL": "double"}
        return self.spark.createDataFrame([], ", ".join(f"`{c.name}` {kinds.get(c.type, 'string')}" for c in self.definitions[table].columns))

    def import_sheet(self, sheet: DataFrame, name: str, abort_on_error: bool = True, dry_run: bool = False) -> ImportResult:
        """All tables or none; with ``abort_on_error`` off, failed routes and what hangs on them are left out."""
        profile, catalogue = self.profiles[name], self.catalogue()
        issues = check_profile(profile, catalogue, set(sheet.columns))
        if issues:
            return ImportResult(False, issues=issues)
        plan: ImportPlan = plan_import(sheet, profile, catalogue)
        for c in plan.classes:  # validated once for errors, tables and counts
            c.rows = c.rows.persist()
        try:
            return self._import(plan, sheet, catalogue, profile, abort_on_error, dry_run)
        finally:
            for c in plan.classes:
                c.rows.unpersist()

    def _import(self, plan: ImportPlan, sheet: DataFrame, catalogue: Catalogue, profile: Profile, abort_on_error: bool, dry_run: bool) -> ImportResult:
        # the report is kept beside the versions: it must not change with the sheet or the tables
        report = f"{self.store.root}/errors/{uuid.uuid4().hex}"
        plan.errors().write.parquet(report)
        errors = self.spark.read.parquet(report)
        result = ImportResult(True, sheet.count(), errors=errors)
        if dry_run:
            result.payloads = {t: plan.payload(t) for t in plan.tables()}
            return result
        if abort_on_error and not errors.isEmpty():
            result.ok = False
            return result
        changed = {}
        for t in plan.tables():
            keys = list(next(r.conflict for r in profile.routes if r.table == t))
            once = last_by_key(plan.payload(t), keys, "excel_row").drop("excel_row")
            changed[t] = upsert(catalogue.read.get(t, self._empty(t)), once, keys)
        result.version = self.store.commit(changed)
        result.written_rows = plan.written_rows().count()
        return result

    def import_xlsx(self, path: str, name: str, sheet: str | None = None, **options) -> ImportResult:
        profile = self.profiles[name]
        try:
            rows = read_xlsx(self.spark, path, sheet or profile.sheet, profile.header_row)
        except SheetError as e:
            return ImportResult(False, issues=[(e.code, path)])
        return self.import_sheet(rows, name, **options)

    def export(self, name: str) -> ExportPlan:
        return plan_export(self.profiles[name], self.catalogue(), self.spark)

    def export_xlsx(self, path: str, name: str, sheet: str | None = None) -> ExportResult:
        """Errors of single cells or rows do not fail an export; they are reported."""
        plan, profile = self.export(name), self.profiles[name]
        wrong = check_column_order(profile, plan.headers)
        if wrong:
            return ExportResult(False, 0, None, wrong)
        return ExportResult(True, export_xlsx(plan.rows, path, sheet or profile.sheet), plan.errors, order_warnings(profile))


class BatchTransfer:
    """One transfer at a time in the background: Idle, Running, Stopping, Completed, Stopped or Failed."""

    def __init__(self, spark: SparkSession):
        self.spark, self.state, self._lock = spark, "Idle", threading.Lock()
        self._pool, self.error = ThreadPoolExecutor(1), None

    def start(self, work: Callable[[], object], group: str = "sheetflow-transfer") -> Future:
        with self._lock:
            if self.state in ("Running", "Stopping"):
                raise RuntimeError("E_BUSY")
            self.state, self.error, self._group = "Running", None, group

        def run():
            try:
                self.spark.sparkContext.setJobGroup(group, "transfer", interruptOnCancel=True)
                out = work()
                with self._lock:
                    self.state = "Stopped" if self.state == "Stopping" else "Completed"
                return out
            except Exception as e:  # noqa: BLE001
                with self._lock:
                    self.state, self.error = ("Stopped" if self.state == "Stopping" else "Failed"), e
                return None

        return self._pool.submit(run)

    def stop(self) -> None:
        with self._lock:
            if self.state != "Running":
                return
            self.state = "Stopping"
        self.spark.sparkContext.cancelJobGroup(self._group)


class Replica:
    """A node: its rows with the precedence of their last change, applied vectors and quarantine."""

    COLUMNS = ("table_name", "pk", "origin", "seq", "rank", "op", "payload")
    CHANGE = "origin string, epoch long, seq long, rank int, table_name string, op string, pk string, payload string, schema_ver long, schema_fp string"

    def __init__(self, spark: SparkSession, store: SnapshotStore, schema_ver: int, schema_fp: str):
        self.spark, self.store, self.schema_ver, self.schema_fp = spark, store, schema_ver, schema_fp

    def _read(self, name: str, schema: str) -> DataFrame:
        return self.store.read(name) if name in self.store.tables() else self.spark.createDataFrame([], schema)

    def rows(self) -> DataFrame:
        return self._read("winners", "table_name string, pk string, origin string, seq long, rank int, op string, payload string")

    def applied(self) -> DataFrame:
        return self._read("applied", "origin string, epoch long, applied_seq long")

    def quarantined(self) -> DataFrame:
        return self._read("quarantine", self.CHANGE)

    def waiting(self) -> DataFrame:
        """Changes that fit the schema and lie behind a gap."""
        return self._read("waiting", self.CHANGE)

    def receive(self, changes: DataFrame) -> int:
        """Apply what is in sequence and fits the schema. Returns the new version.

        What fits but lies behind a gap waits; what does not fit is quarantined. Both are taken up again with each
        receipt, with their own schema marks: a replay passes the guard like any other change.
        """
        key, names = ["origin", "epoch", "seq"], self.quarantined().columns
        waiting, held = self.waiting(), self.quarantined()
        inbound = changes.select(*names).unionByName(waiting).unionByName(replication.replayable(held, self.schema_ver))
        judged = replication.guard(inbound, self.schema_ver, self.schema_fp)
        fits = judged.filter("accepted").drop("accepted").dropDuplicates(key)
        refused = judged.filter("not accepted").drop("accepted")
        kept = held.filter(F.col("schema_ver") > self.schema_ver).unionByName(refused).dropDuplicates(key)
        decided = replication.applicable(fits, self.applied())
        ready = decided.filter("decision = 'apply'").select(*names)
        folded = replication.winners(self.rows().unionByName(ready.select(*self.COLUMNS)), ["table_name", "pk"], keep_tombstones=True).select(*self.COLUMNS)
        vector = self.applied().unionByName(ready.groupBy("origin", "epoch").agg(F.max("seq").alias("applied_seq"))).groupBy("origin", "epoch").agg(F.max("applied_seq").alias("applied_seq"))
        behind = decided.filter("decision = 'gap'").select(*names)
        return self.store.commit({"winners": folded, "applied": vector, "quarantine": kept, "waiting": behind})

    def live(self) -> DataFrame:
        """Rows that are not deleted."""
        return self.rows().filter("op <> 'D'")

    def baseline(self, rows: DataFrame, vector: DataFrame, expected: dict[str, int] | None = None) -> int:
        """Take another node's rows and vector as they are; what waited is void.

        The winners are the baseline's rows with their precedence, so later changes are judged against them.
        ``expected`` are the row counts that came with it, by table; another count refuses the baseline.
        """
        if expected is not None:
            found = {r.table_name: r.n for r in rows.filter("op <> 'D'").groupBy("table_name").agg(F.count(F.lit(1)).alias("n")).collect()}
            if found != expected:
                raise ValueError(f"E_SYNC_BASELINE_FAILED: {found} rows came, {expected} were announced")
        empty = self.quarantined().limit(0)
        return self.store.commit({"winners": rows.select(*self.COLUMNS), "applied": vector, "quarantine": empty, "waiting": empty})
