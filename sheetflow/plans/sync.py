"""Settings of a replicating node, and which tables may take part."""

from __future__ import annotations

from dataclasses import dataclass, field

from ..sources.registry import Catalogue, TableDef

MIB = 1 << 20


class ConfigError(ValueError):
    def __init__(self, message: str):
        super().__init__(f"E_SYNC_INIT: {message}")


@dataclass(frozen=True)
class SyncConfig:
    """Checked when it is made; the defaults are those of the data model."""

    node: str
    tables: tuple[str, ...]
    role: str = "edge"  # or center
    center: str = ""
    peers: tuple[str, ...] = ()
    policy: str = "SourceWins"  # TargetWins, Manual
    ranks: dict[str, int] = field(default_factory=dict)
    soft: dict[str, int] = field(default_factory=lambda: {"seq": 10_000, "bytes": 50 * MIB, "ms": 300_000})
    hard: dict[str, int] = field(default_factory=lambda: {"seq": 100_000, "bytes": 500 * MIB, "ms": 3_600_000})
    outbox_bytes: int = 1024 * MIB
    outbox_artifacts: int = 10_000
    ack_delay_ms: int = 5_000
    schema_version: int = 1
    broadcast_ms: int = 5_000
    broadcast_threshold: int = 100
    selection_cap: int = 100_000
    chunk_bytes: int = 2 * MIB
    gap_timeout_ms: int = 30_000

    def __post_init__(self):
        if not self.node:
            raise ConfigError("a node needs a name")
        if not self.tables or len(set(self.tables)) < len(self.tables):
            raise ConfigError("tables are missing or named twice")
        if self.role not in ("edge", "center") or (self.role == "edge" and not self.center):
            raise ConfigError("an edge needs its center")
        if self.node in self.peers or len(set(self.peers)) < len(self.peers):
            raise ConfigError("a peer is the node itself or named twice")
        if self.policy not in ("SourceWins", "TargetWins", "Manual"):
            raise ConfigError(f"no such policy: {self.policy}")
        if len(set(self.ranks.values())) < len(self.ranks):
            raise ConfigError("two origins have one rank")
        for k in ("seq", "bytes", "ms"):
            if not 0 < self.soft[k] <= self.hard[k]:
                raise ConfigError(f"the soft limit of {k} is above the hard one")
        if min(self.selection_cap, self.chunk_bytes, self.outbox_bytes, self.outbox_artifacts, self.broadcast_threshold, self.gap_timeout_ms) <= 0:
            raise ConfigError("limits must be positive")


def eligibility(table: TableDef | None) -> str | None:
    """Why a table cannot be replicated, or null: it needs one NOT NULL key column (an INTEGER key is never null)."""
    if table is None:
        return "no such table"
    if table.kind != "table":
        return f"a {table.kind} is no base table"
    if table.name.startswith(("sqlite_", "__sync_")):
        return "an internal table"
    if not table.primary_key:
        return "no primary key"
    if len(table.primary_key) > 1:
        return "a key of several columns"
    column = table.column(table.primary_key[0])
    if column is None or column.generated:
        return "the key cannot be written"
    if not column.not_null and column.type.upper() != "INTEGER":
        return "the key may be null"
    return None


def eligible(catalogue: Catalogue, tables: list[str]) -> list[tuple[str, str, str]]:
    """(table, code, reason) of the tables that cannot take part."""
    out = []
    for t in tables:
        reason = eligibility(catalogue.tables.get(t))
        if reason:
            code = "E_SYNC_COMPOSITE_PK_NOT_SUPPORTED" if reason == "a key of several columns" else "E_SYNC_UNSUPPORTED_SCHEMA"
            out.append((t, code, reason))
    return out
