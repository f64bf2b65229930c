"""Table definitions: columns and constraints that files alone do not tell."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class ColumnDef:
    name: str
    type: str  # INTEGER, REAL, TEXT, BLOB or another declared type
    not_null: bool = False
    default: str | None = None
    auto_increment: bool = False
    generated: bool = False


@dataclass(frozen=True)
class ForeignKey:
    columns: tuple[str, ...]
    ref_table: str
    ref_columns: tuple[str, ...]


@dataclass(frozen=True)
class TableDef:
    name: str
    columns: tuple[ColumnDef, ...]
    primary_key: tuple[str, ...] = ()
    unique: tuple[tuple[str, ...], ...] = ()
    foreign_keys: tuple[ForeignKey, ...] = ()
    kind: str = "table"  # or view, virtual

    def column(self, name: str) -> ColumnDef | None:
        return next((c for c in self.columns if c.name == name), None)


def affinity(declared: str) -> str:
    """Spark type that keys of a column are compared in; by substrings, in this order."""
    t = declared.upper()
    if "INT" in t:
        return "bigint"
    if any(x in t for x in ("REAL", "FLOA", "DOUB")):
        return "double"
    if "BLOB" in t:
        return "binary"
    return "string"


@dataclass
class Catalogue:
    """Table definitions and how to read the tables."""

    tables: dict[str, TableDef]
    read: dict[str, DataFrame] = field(default_factory=dict)

    def frame(self, name: str) -> DataFrame:
        return self.read[name]

    def page(self, name: str, offset: int, size: int) -> DataFrame:
        """A page of a table in key order (of all columns where it has no key)."""
        keys = self.tables[name].primary_key or tuple(c.name for c in self.tables[name].columns)
        return self.frame(name).orderBy(*keys).offset(offset).limit(size)

    @classmethod
    def scan(cls, frames: dict[str, DataFrame], known: dict[str, TableDef] | None = None) -> Catalogue:
        """Definitions from the schemas of tables; keys and constraints, which files do not tell, from ``known``."""
        kinds = {"tinyint": "INTEGER", "smallint": "INTEGER", "int": "INTEGER", "bigint": "INTEGER", "float": "REAL", "double": "REAL", "string": "TEXT", "binary": "BLOB", "boolean": "INTEGER"}
        tables = {}
        for name, frame in frames.items():
            given = (known or {}).get(name)
            columns = tuple(
                ColumnDef(f.name, "DATETIME" if f.dataType.simpleString().startswith(("timestamp", "date")) else kinds.get(f.dataType.simpleString(), "REAL" if f.dataType.simpleString().startswith("decimal") else "TEXT"), bool(given and f.name in given.primary_key) or not f.nullable)
                for f in frame.schema
            )
            tables[name] = TableDef(name, columns, *((given.primary_key, given.unique, given.foreign_keys, given.kind) if given else ()))
        return cls(tables, dict(frames))

    def user_tables(self) -> list[str]:
        return sorted(n for n in self.tables if not n.startswith(("sqlite_", "__sync_")))

    def describe(self, spark: SparkSession) -> DataFrame:
        """A row for each column of each user table."""
        rows = [
            (t, k, c.name, c.type, c.not_null, t_.primary_key.index(c.name) + 1 if c.name in t_.primary_key else 0)
            for t in self.user_tables() for t_ in [self.tables[t]] for k, c in enumerate(t_.columns)
        ]
        return spark.createDataFrame(rows, "table_name string, position int, column_name string, declared_type string, not_null boolean, pk_position int")


_KINDS = {"i": "INTEGER", "r": "REAL", "t": "TEXT", "d": "DATETIME"}


def _table(name: str, columns: str, pk: str = "", fks: tuple = ()) -> TableDef:
    keys = tuple(pk.split()) if pk else ()
    cols = tuple(ColumnDef(c[:-2], _KINDS[c[-1]], c[:-2] in keys) for c in columns.split())
    return TableDef(name, cols, keys, (), tuple(ForeignKey((a,), t, (b,)) for a, t, b in fks))


#: The tables of the test data, with the keys that hold in it.
TEST_TABLES = {t.name: t for t in (
    _table("region", "r_regionkey:i r_name:t", "r_regionkey"),
    _table("nation", "n_nationkey:i n_name:t n_regionkey:i", "n_nationkey", (("n_regionkey", "region", "r_regionkey"),)),
    _table("customer", "c_custkey:i c_name:t c_nationkey:i c_acctbal:r c_mktsegment:t", "c_custkey", (("c_nationkey", "nation", "n_nationkey"),)),
    _table("supplier", "s_suppkey:i s_name:t s_nationkey:i s_acctbal:r", "s_suppkey", (("s_nationkey", "nation", "n_nationkey"),)),
    _table("part", "p_partkey:i p_name:t p_brand:t p_type:t p_size:i p_retailprice:r", "p_partkey"),
    _table("orders", "o_orderkey:i o_custkey:i o_orderstatus:t o_totalprice:r o_orderdate:d o_orderpriority:t", "o_orderkey", (("o_custkey", "customer", "c_custkey"),)),
    _table("lineitem", "l_orderkey:i l_partkey:i l_suppkey:i l_linenumber:i l_quantity:r l_extendedprice:r l_discount:r l_tax:r l_returnflag:t l_linestatus:t l_shipdate:d", "", (("l_orderkey", "orders", "o_orderkey"), ("l_partkey", "part", "p_partkey"), ("l_suppkey", "supplier", "s_suppkey"))),
    _table("events", "event_id:i ts:d user_id:i event_type:t value:r props:t", "event_id"),
    _table("labels", "doc_id:i quality:i toxic:i", "doc_id"),
)}


def test_catalogue(spark: SparkSession, sf_dir: str) -> Catalogue:
    return Catalogue(dict(TEST_TABLES), {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in TEST_TABLES})
