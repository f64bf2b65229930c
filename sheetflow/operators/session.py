"""A comparison session: a pinned version beside another node's tables, choices that are staged, and one save.

Choices are kept as keys (and column names), never as rows. Only what the other side has can be taken over: a
deletion cannot be staged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.snapshots import SnapshotStore
from .diff import cell_diff, paired, row_diff
from .merge import upsert


class ComparisonSession:
    def __init__(self, store: SnapshotStore, remote: dict[str, DataFrame], keys: dict[str, list[str]]):
        self.store, self.remote, self.keys = store, remote, keys
        self.version = store.version()
        self._rows: dict[str, DataFrame] = {}
        self._cells: dict[str, DataFrame] = {}

    def local(self, table: str) -> DataFrame:
        return self.store.read(table, self.version)

    def rows(self, table: str) -> DataFrame:
        return row_diff(self.local(table), self.remote[table], self.keys[table])

    def cells(self, table: str) -> DataFrame:
        return cell_diff(self.local(table), self.remote[table], self.keys[table])

    def accept_rows(self, table: str, keys: DataFrame) -> None:
        """Take these rows of the other side; later choices add to earlier ones."""
        new = keys.select(*self.keys[table]).distinct()
        self._rows[table] = self._rows[table].union(new).distinct() if table in self._rows else new

    def accept_table(self, table: str) -> None:
        self.accept_rows(table, self.remote[table])

    def accept_cells(self, table: str, cells: DataFrame) -> None:
        """Take single cells (keys, column) of rows that both sides have."""
        new = cells.select(*self.keys[table], "column").distinct()
        self._cells[table] = self._cells[table].union(new).distinct() if table in self._cells else new

    def unstage(self, table: str, keys: DataFrame | None = None) -> None:
        """Forget the choices of these rows, or all of the table."""
        for staged in (self._rows, self._cells):
            if table in staged and keys is not None:
                staged[table] = staged[table].join(keys.select(*self.keys[table]).distinct(), self.keys[table], "left_anti")
            else:
                staged.pop(table, None)

    def discard(self) -> None:
        self._rows.clear()
        self._cells.clear()

    def refused(self, table: str) -> DataFrame:
        """Staged keys that the other side does not have: they would be deletions."""
        return self._rows[table].join(self.remote[table], self.keys[table], "left_anti")

    def merged(self, table: str) -> DataFrame:
        """The local table after the staged choices: whole rows, then single cells."""
        local, remote, keys = self.local(table), self.remote[table], self.keys[table]
        if table in self._cells:
            local = self._with_cells(local, remote, keys, self._cells[table])
        if table in self._rows:
            local = upsert(local, remote.join(self._rows[table], keys, "left_semi"), keys)
        return local

    @staticmethod
    def _with_cells(local: DataFrame, remote: DataFrame, keys: list[str], cells: DataFrame) -> DataFrame:
        chosen = cells.groupBy(*keys).agg(F.collect_set("column").alias("__columns"))  # no more than a row has
        both = paired(local, remote, keys).filter("l is not null").join(chosen, keys, "left")
        take = lambda c: F.col("r").isNotNull() & F.coalesce(F.array_contains("__columns", c), F.lit(False))
        cell = lambda c: F.when(take(c), F.col(f"r.`{c}`")).otherwise(F.col(f"l.`{c}`")) if c in remote.columns and c not in keys else F.col(f"l.`{c}`")
        return both.select(*[cell(c).alias(c) for c in local.columns])

    def save(self) -> int:
        """Write all staged tables as one version; refused (``E_SYNC_STAGE_STALE``) if the local tables have moved on."""
        tables = {t: self.merged(t) for t in {*self._rows, *self._cells}}
        out = self.store.commit(tables, expected=self.version)
        self.version = out
        self.discard()
        return out
