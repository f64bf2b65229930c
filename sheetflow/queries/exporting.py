"""Exports: automatic joins, column order, reverse lookups, mixed unions, SQL pass-through (J10-J14, O*, U*, S7)."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from ..operators.exporter import plan_export, reverse_lookup
from ..plans.profile import Lookup, load_profile
from ..sources.registry import Catalogue, test_catalogue
from ..sources.xlsx import export_xlsx, read_xlsx
from .common import table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


JOINED = {
    "profileName": "joined", "sheet": "Orders", "mode": "multiTable",
    "routes": [
        {"table": "orders", "conflict": {"columns": ["o_orderkey"]}, "columns": {"o_orderkey": {"source": "OrderNo"}, "o_orderpriority": {"source": "Priority"}, "o_orderstatus": {"source": "Status"}}},
        {"table": "lineitem", "parent": "orders", "conflict": {"columns": ["l_orderkey", "l_linenumber"]}, "fkInject": [{"from": "orders", "pairs": [["o_orderkey", "l_orderkey"]]}],
         "columns": {"l_linenumber": {"source": "LineNo"}, "l_partkey": {"source": "Part"}, "l_returnflag": {"source": "Flag"}}},
    ],
    "export": {"orderBy": ["o_orderkey", "l_linenumber"]},
}


@query("SELECT o_orderkey AS OrderNo, o_orderpriority AS Priority, o_orderstatus AS Status, CAST(l_linenumber AS VARCHAR) AS LineNo, CAST(l_partkey AS VARCHAR) AS Part, l_returnflag AS Flag FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey")
def export_auto_join(spark, sf_dir):
    rows = plan_export(load_profile(JOINED), test_catalogue(spark, sf_dir)).rows
    return rows.withColumns({c: F.col(c).cast("string") for c in ("LineNo", "Part")})


@query("SELECT column_name, CAST(place AS INTEGER) AS place FROM (VALUES ('Flag', 0), ('Priority', 1), ('OrderNo', 2), ('Status', 3), ('LineNo', 4), ('Part', 5)) v(column_name, place)")
def export_column_order(spark, sf_dir):
    """Listed columns first, the others in their natural order."""
    profile = load_profile(JOINED | {"export": {"columnOrder": ["Flag", "Priority"]}})
    headers = plan_export(profile, test_catalogue(spark, sf_dir)).rows.columns
    return spark.createDataFrame(list(enumerate(headers)), "place int, column_name string")


DATED = {
    "profileName": "dated", "sheet": "Orders", "mode": "singleTable", "table": "orders", "conflict": {"columns": ["o_orderkey"]},
    "dateFormat": {"excelFormat": "d/M/yyyy", "dbFormat": "yyyy-MM-dd"},
    "columns": {"o_orderkey": {"source": "No", "validators": ["int"]}, "o_orderdate": {"source": "Day"}},
}


@query("SELECT o_orderkey AS No, strftime(o_orderdate, '%-d/%-m/%Y') AS Day FROM orders")
def export_profile_slot(spark, sf_dir):
    """A profile-level date slot on the way out; a column with validators does not inherit it."""
    cat = test_catalogue(spark, sf_dir)
    cat.read["orders"] = cat.read["orders"].withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd"))
    return plan_export(load_profile(DATED), cat).rows.select("No", "Day")


def _accounts(spark, sf_dir, on_missing: str):
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.expr("CASE WHEN c_custkey % 6 = 0 THEN 'Atlantis' WHEN c_custkey % 10 = 1 THEN NULL ELSE c_name END").alias("h__name"), "c_nationkey")
    cat = Catalogue(test_catalogue(spark, sf_dir).tables, {"customer": table(spark, sf_dir, "customer")})
    lookup = Lookup("c", "customer", (("c_custkey", "No"),), (("c_name", "name"),), True, on_missing)
    return reverse_lookup(rows, lookup, cat, "x")


@query("SELECT c_custkey, CASE WHEN c_custkey % 6 <> 0 AND c_custkey % 10 <> 1 THEN CAST(c_custkey AS VARCHAR) END AS No FROM customer")
def reverse_lookup_null(spark, sf_dir):
    """Names back to keys; what is missing stays blank."""
    return _accounts(spark, sf_dir, "null").filter("not x_skip").select("c_custkey", "No")


@query("SELECT c_custkey, CASE WHEN c_custkey % 6 = 0 OR c_custkey % 10 = 1 THEN 'E_REVERSE_LOOKUP_NOT_FOUND' END AS code, c_custkey % 6 = 0 OR c_custkey % 10 = 1 AS skipped FROM customer")
def reverse_lookup_error(spark, sf_dir):
    """With the policy ``error`` a row without its key is skipped and reported."""
    return _accounts(spark, sf_dir, "error").select("c_custkey", F.col("x_code").alias("code"), F.col("x_skip").alias("skipped"))


@query("WITH n AS (SELECT p_name, count(*) AS hits FROM part GROUP BY 1) SELECT p_partkey, CASE WHEN hits = 1 THEN CAST(p_partkey AS VARCHAR) END AS No, CASE WHEN hits > 1 THEN 'E_REVERSE_LOOKUP_AMBIGUOUS' END AS code FROM part JOIN n USING (p_name)")
def reverse_lookup_ambiguous(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    cat = Catalogue(test_catalogue(spark, sf_dir).tables, {"part": part})
    found = reverse_lookup(part.select("p_partkey", F.col("p_name").alias("h__name")), Lookup("p", "part", (("p_partkey", "No"),), (("p_name", "name"),), True, "skip"), cat, "x")
    return found.select("p_partkey", "No", F.col("x_code").alias("code"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'sheet' ELSE CAST(o_custkey AS VARCHAR) END AS Cust FROM orders")
def reverse_lookup_source_wins(spark, sf_dir):
    """A value of the table itself beats the reverse lookup."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    rows = o.join(c, o.o_custkey == c.c_custkey).select("o_orderkey", F.expr("CASE WHEN o_orderkey % 2 = 0 THEN 'sheet' END").alias("Cust"), F.col("c_name").alias("h__name"))
    cat = Catalogue(test_catalogue(spark, sf_dir).tables, {"customer": c})
    return reverse_lookup(rows, Lookup("c", "customer", (("c_custkey", "Cust"),), (("c_name", "name"),)), cat, "x", direct={"Cust"}).select("o_orderkey", "Cust")


MIXED = {
    "profileName": "mixed", "sheet": "Mixed", "mode": "mixed", "discriminator": {"source": "Type"}, "classColumn": "Type",
    "classes": [
        {"id": "N", "match": {"equals": "N"}, "routes": [{"table": "nation", "conflict": {"columns": ["n_nationkey"]}, "columns": {"n_nationkey": {"source": "Key"}, "n_name": {"source": "Name"}}}]},
        {"id": "R", "match": {"equals": "R"}, "routes": [{"table": "region", "conflict": {"columns": ["r_regionkey"]}, "columns": {"r_regionkey": {"source": "Key"}, "r_name": {"source": "Region"}}}]},
        {"id": "S", "match": {"equals": "S"}, "routes": [{"table": "supplier", "conflict": {"columns": ["s_suppkey"]}, "columns": {"s_suppkey": {"source": "Key"}, "s_name": {"source": "Name"}, "s_nationkey": {"source": "Nation"}}}]},
    ],
}


@query("""SELECT 'N' AS "Type", CAST(n_nationkey AS VARCHAR) AS "Key", n_name AS "Name", CAST(NULL AS VARCHAR) AS "Region", CAST(NULL AS VARCHAR) AS "Nation" FROM nation
UNION ALL SELECT 'R', CAST(r_regionkey AS VARCHAR), NULL, r_name, NULL FROM region UNION ALL SELECT 'S', CAST(s_suppkey AS VARCHAR), s_name, NULL, CAST(s_nationkey AS VARCHAR) FROM supplier""")
def mixed_union_export(spark, sf_dir):
    """Three classes in one sheet: headers in order of first sight, blanks where a class has none."""
    return plan_export(load_profile(MIXED), test_catalogue(spark, sf_dir)).rows.select("Type", "Key", "Name", "Region", "Nation")


def _raw(spark, sf_dir, sql: str):
    profile = load_profile({"profileName": "raw", "sheet": "S", "mode": "singleTable", "table": "orders", "columns": {"o_orderkey": {}}, "export": {"sql": sql}})
    return plan_export(profile, test_catalogue(spark, sf_dir), spark).rows


RAW = {
    "raw_sql_aggregate": "SELECT o_orderpriority, o_orderstatus, count(*) AS n, CAST(round(sum(o_totalprice), 0) AS BIGINT) AS total FROM orders GROUP BY o_orderpriority, o_orderstatus HAVING count(*) > 1",
    "raw_sql_window": "SELECT o_orderkey, CAST(rank() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS BIGINT) AS r, coalesce(lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey), -1) AS previous FROM orders",
    "raw_sql_cube": "SELECT coalesce(l_returnflag, '*') AS flag, coalesce(l_linestatus, '*') AS status, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
    "raw_sql_set_ops": "SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' EXCEPT SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'",
    "raw_sql_recursive": "WITH RECURSIVE t(n, total) AS (SELECT 1, 1 UNION ALL SELECT n + 1, total + n + 1 FROM t WHERE n < 50) SELECT n, total FROM t",
    "raw_sql_subquery": "SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')",
    "raw_sql_range_join": "SELECT a.event_id, count(*) AS n FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL '1' HOUR GROUP BY a.event_id",
    "raw_sql_frames": "SELECT event_id, CAST(sum(event_id) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS BIGINT) AS s, coalesce(first_value(event_type) OVER (PARTITION BY user_id ORDER BY event_id), '') AS f FROM events",
    "raw_sql_rollup": "SELECT coalesce(o_orderstatus, '*') AS status, coalesce(o_orderpriority, '*') AS priority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)",
    "raw_sql_grouping_sets": "SELECT coalesce(o_orderstatus, '*') AS status, coalesce(o_orderpriority, '*') AS priority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())",
    "raw_sql_ranking": "SELECT o_orderkey, CAST(ntile(4) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS BIGINT) AS quarter, CAST(dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS BIGINT) AS d FROM orders",
    "raw_sql_as_of": "SELECT event_id, coalesce(max(CASE WHEN event_type = 'purchase' THEN event_id END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS last_purchase FROM events",
    "raw_sql_theta_join": "SELECT a.n_nationkey, count(*) AS n FROM nation a JOIN nation b ON a.n_regionkey < b.n_regionkey AND a.n_name > b.n_name GROUP BY a.n_nationkey",
    "raw_sql_full_join": "SELECT coalesce(c_custkey, k) AS k, CASE WHEN c_custkey IS NULL THEN 'right' WHEN k IS NULL THEN 'left' ELSE 'both' END AS side FROM (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0) a FULL JOIN (SELECT DISTINCT o_custkey AS k FROM orders) b ON c_custkey = k",
    "raw_sql_except_all": "SELECT o_custkey FROM orders EXCEPT ALL SELECT c_custkey FROM customer",
    "raw_sql_approximate": "SELECT l_returnflag, abs(approx_count_distinct(l_partkey) - count(DISTINCT l_partkey)) <= 0.2 * count(DISTINCT l_partkey) AS close FROM lineitem GROUP BY l_returnflag",
    "raw_sql_strings": "SELECT c_custkey, upper(substr(c_name, 1, 4)) AS head, replace(c_mktsegment, 'B', 'b') AS seg, CAST(length(c_name) AS BIGINT) AS n FROM customer",
}
for _name, _sql in RAW.items():
    QUERIES[_name] = lambda spark, sf_dir, sql=_sql: _raw(spark, sf_dir, sql)
    ORACLES[_name] = _sql


@query("SELECT s_suppkey + 2 AS excel_row, CAST(s_suppkey AS VARCHAR) AS \"No\", CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE s_name || ' <&\"é' END AS \"Name\", CAST(s_nationkey AS VARCHAR) AS \"Nation\" FROM supplier".replace("s_suppkey + 2", "row_number() OVER (ORDER BY s_suppkey) + 1"))
def xlsx_roundtrip(spark, sf_dir):
    """A table to a workbook and back; null cells stay null."""
    s = table(spark, sf_dir, "supplier").orderBy("s_suppkey").select(F.col("s_suppkey").alias("No"), F.expr("CASE WHEN s_suppkey % 7 <> 0 THEN concat(s_name, ' <&\"é') END").alias("Name"), F.col("s_nationkey").alias("Nation"))
    base = spark.conf.get("spark.checkpoint.dir", None) or f"file://{tempfile.mkdtemp(prefix='sheetflow-')}"
    path = f"{base.rstrip('/')}/suppliers-{uuid.uuid4().hex}.xlsx"
    export_xlsx(s, path, "Suppliers")
    return read_xlsx(spark, path, "Suppliers").withColumn("excel_row", F.col("excel_row").cast("long"))
