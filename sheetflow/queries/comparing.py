"""Hashes, checksums, differences and staged merges (A3, A4, A11, H*, J16, R21, W5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import hashing
from ..operators import diff
from ..sources.registry import TEST_TABLES, Catalogue, test_catalogue
from .common import table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _encoded(name: str, skip: tuple[str, ...] = ()) -> str:
    """The row encoding of a test table in plain SQL."""
    parts = []
    for c in sorted(TEST_TABLES[name].columns, key=lambda c: c.name):
        if c.name in skip:
            continue
        head = f"{len(c.name)}|{c.name}|"
        tag = {"INTEGER": "1", "REAL": "2"}.get(c.type, "3")
        value = {"REAL": f"printf('%.6f', {c.name})", "DATETIME": f"strftime({c.name}, '%Y-%m-%d %H:%M:%S')"}.get(c.type, f"CAST({c.name} AS VARCHAR)")
        parts.append(f"CASE WHEN {c.name} IS NULL THEN '{head}0|' ELSE '{head}{tag}|' || length({value}) || '|' || {value} || '|' END")
    return " || ".join(parts)


def _sum(rows: str) -> str:
    return f"CAST(CAST(coalesce(sum(CAST(CAST('0x' || substr(sha256({rows}), 1, 16) AS UBIGINT) AS HUGEINT)), 0) % 18446744073709551616 AS HUGEINT) AS VARCHAR)"


CHECKED = ("region", "nation", "customer", "supplier", "part", "orders")


@query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS row_count, {_sum(_encoded(t))} AS content_checksum FROM {t}" for t in CHECKED))
def table_checksum(spark, sf_dir):
    parts = [hashing.table_checksum(table(spark, sf_dir, t), t) for t in CHECKED]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


MUTATED = "SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN concat(c_name, '!') ELSE c_name END AS c_name, CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE c_nationkey END AS c_nationkey, c_acctbal, c_mktsegment FROM customer WHERE c_custkey % 9 <> 0 UNION ALL SELECT c_custkey + 1000000, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer WHERE c_custkey % 11 = 0"


def _both(spark, sf_dir):
    local = table(spark, sf_dir, "customer")
    local.createOrReplaceTempView("customer")
    return local, spark.sql(MUTATED)


@query(f"WITH m AS ({MUTATED}) SELECT count(*) AS row_count, {_sum(_encoded('customer'))} AS content_checksum FROM m")
def checksum_delta(spark, sf_dir):
    """The old checksum and the changes give the new one, without the unchanged rows."""
    before, after = _both(spark, sf_dir)
    old = hashing.table_checksum(before, "customer")
    delta = diff.checksum_delta(before, after, ["c_custkey"])
    total = F.col("content_checksum").cast("decimal(38,0)") + F.col("delta").cast("decimal(38,0)")
    return old.crossJoin(F.broadcast(delta)).select((F.col("row_count") + F.col("row_delta")).alias("row_count"), hashing.modulo(total).alias("content_checksum"))


@query(f"SELECT c_custkey, substr(sha256({_encoded('customer')}), 1, 32) AS row_hash, sha1({_encoded('customer')}) AS fingerprint FROM customer".replace("sha1(", "sha1("))
def row_hashes(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", hashing.row_hash(c).alias("row_hash"), hashing.fingerprint(c).alias("fingerprint"))


def _declared(t) -> str:
    """What goes into the fingerprint of a table, line by line."""
    columns = [f"column {c.name} {c.type} pk={t.primary_key.index(c.name) + 1 if c.name in t.primary_key else 0} nn={int(c.not_null)} default=None" for c in sorted(t.columns, key=lambda c: c.name)]
    keys = [f"fk {f.columns[0]} {f.ref_table} {f.ref_columns[0]}" for f in sorted(t.foreign_keys, key=lambda f: (f.columns, f.ref_table))]
    return "".join(x + "\n" for x in [f"table {t.name}", *columns, *keys])


@query(f"SELECT sha256('{''.join(_declared(TEST_TABLES[n]) for n in sorted(TEST_TABLES))}') AS fingerprint, {len(TEST_TABLES)} AS tables")
def schema_fingerprint(spark, sf_dir):
    """One fingerprint for the declared tables; any change of a column or key changes it."""
    return spark.createDataFrame([(hashing.schema_fingerprint(list(TEST_TABLES.values())), len(TEST_TABLES))], "fingerprint string, tables int")


#: A row for each column of a table as DuckDB finds it, with the type that the catalogue gives it.
_FOUND = "(SELECT column_name, CAST(row_number() OVER () - 1 AS INTEGER) AS position, CASE column_type WHEN 'BIGINT' THEN 'INTEGER' WHEN 'INTEGER' THEN 'INTEGER' WHEN 'DOUBLE' THEN 'REAL' WHEN 'VARCHAR' THEN 'TEXT' ELSE 'DATETIME' END AS declared_type FROM (DESCRIBE SELECT * FROM {t}))"


def _key_place(t) -> str:
    return f"CAST(CASE column_name {' '.join(f"WHEN '{c}' THEN {k}" for k, c in enumerate(t.primary_key, 1))} ELSE 0 END AS INTEGER)" if t.primary_key else "0"


@query(" UNION ALL ".join(f"SELECT '{n}' AS table_name, position, column_name, declared_type, {_key_place(t)} > 0 AS not_null, {_key_place(t)} AS pk_position FROM {_FOUND.format(t=n)}" for n, t in TEST_TABLES.items()))
def describe_tables(spark, sf_dir):
    """Columns as they are found in the files, with the declared keys."""
    return Catalogue.scan({n: table(spark, sf_dir, n) for n in TEST_TABLES}, TEST_TABLES).describe(spark)


_N = "(SELECT CAST(count(*) AS VARCHAR) FROM {})"


@query(f"""SELECT 'customer' AS table_name, 'Different' AS status, {_N.format('customer')} AS local_rows, {_N.format(f'({MUTATED})')} AS remote_rows
UNION ALL SELECT 'nation', 'Identical', '25', '25' UNION ALL SELECT 'region', 'OnlyLocal', '5', NULL UNION ALL SELECT 'supplier', 'OnlyRemote', NULL, {_N.format('supplier')}""")
def table_diff(spark, sf_dir):
    local, remote = _both(spark, sf_dir)
    t = lambda n: table(spark, sf_dir, n)

    def states(tables):
        out = None
        for name, df in tables.items():
            part = hashing.table_checksum(df, name).withColumn("schema_fingerprint", F.lit(hashing.schema_fingerprint([TEST_TABLES[name]])))
            out = part if out is None else out.unionByName(part)
        return out

    found = diff.table_diff(states({"customer": local, "nation": t("nation"), "region": t("region")}), states({"customer": remote, "nation": t("nation"), "supplier": t("supplier")}))
    return found.withColumns({c: F.col(c).cast("string") for c in ("local_rows", "remote_rows")})


_PAIRED = f"""WITH r AS ({MUTATED}), j AS (SELECT coalesce(l.c_custkey, r.c_custkey) AS c_custkey, l.c_custkey AS lk, r.c_custkey AS rk, l.c_name AS ln, r.c_name AS rn, l.c_nationkey AS la, r.c_nationkey AS ra FROM customer l FULL JOIN r ON l.c_custkey = r.c_custkey),
k AS (SELECT *, CASE WHEN lk IS NULL THEN 'Added' WHEN rk IS NULL THEN 'Deleted' WHEN ln IS DISTINCT FROM rn OR la IS DISTINCT FROM ra THEN 'Modified' ELSE 'Same' END AS kind FROM j)"""


@query(_PAIRED + " SELECT c_custkey, kind FROM k")
def row_diff(spark, sf_dir):
    return diff.row_diff(*_both(spark, sf_dir), ["c_custkey"]).select("c_custkey", "kind")


@query(_PAIRED + " SELECT c_custkey, kind FROM k WHERE kind <> 'Same' ORDER BY c_custkey LIMIT 50 OFFSET 100")
def diff_page(spark, sf_dir):
    """A page of changes: limit and offset are the feature."""
    return diff.diff_page(*_both(spark, sf_dir), ["c_custkey"], 100, 50).select("c_custkey", "kind")


@query(_PAIRED + """ SELECT c_custkey, 'c_name' AS "column", ln AS local, rn AS remote FROM k WHERE kind = 'Modified' AND ln IS DISTINCT FROM rn UNION ALL SELECT c_custkey, 'c_nationkey', CAST(la AS VARCHAR), CAST(ra AS VARCHAR) FROM k WHERE kind = 'Modified' AND la IS DISTINCT FROM ra""")
def cell_diff(spark, sf_dir):
    return diff.cell_diff(*_both(spark, sf_dir), ["c_custkey"])


@query(_PAIRED + " SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 AND rk IS NOT NULL THEN rn ELSE ln END AS c_name FROM k WHERE lk IS NOT NULL OR c_custkey % 2 = 0")
def stage_merge(spark, sf_dir):
    """The remote side of even keys is accepted; rows that only the local side has stay."""
    local, remote = _both(spark, sf_dir)
    staged = local.select("c_custkey").union(remote.select("c_custkey")).filter("c_custkey % 2 = 0")
    return diff.merge_staged(local, remote, staged, ["c_custkey"]).select("c_custkey", "c_name")


@query(_PAIRED + """ SELECT c_custkey, CASE kind WHEN 'Added' THEN 'I' WHEN 'Deleted' THEN 'D' ELSE 'U' END AS op, ln AS name_before, rn AS name_after FROM k WHERE kind <> 'Same'""")
def cdc_capture(spark, sf_dir):
    """Inserts, updates and deletes between two snapshots, with both images."""
    changes = diff.capture(*_both(spark, sf_dir), ["c_custkey"])
    return changes.select("c_custkey", "op", F.get_json_object("before", "$.c_name").alias("name_before"), F.get_json_object("after", "$.c_name").alias("name_after"))
