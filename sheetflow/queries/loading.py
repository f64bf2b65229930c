"""Routing, lookups, foreign keys, uniqueness and writes (J*, N1, W*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.importer import plan_import
from ..operators.merge import apply_mutations, last_by_key, upsert
from ..plans.profile import load_profile
from ..sources.registry import Catalogue, ColumnDef, TableDef, test_catalogue
from .common import table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _def(name: str, columns: str, pk: str) -> TableDef:
    kinds = {"i": "INTEGER", "r": "REAL", "t": "TEXT"}
    return TableDef(name, tuple(ColumnDef(c[:-2], kinds[c[-1]]) for c in columns.split()), tuple(pk.split()))


def catalogue(spark, sf_dir) -> Catalogue:
    out = test_catalogue(spark, sf_dir)
    for t in (
        _def("sales_order", "order_no:i cust:i status:t total:r segment:t", "order_no"),
        _def("sales_line", "order_no:i line_no:i qty:i part:i", "order_no line_no"),
        _def("click", "id:i who:i", "id"), _def("purchase", "id:i amount:r", "id"), _def("viewing", "id:i what:t", "id"),
        _def("account", "acc:i name:t nation:i nation_name:t region:i", "acc"),
        _def("pick", "id:i part:t price:r brand:t", "id"),
    ):
        out.tables[t.name] = t
    return out


SALES = load_profile({
    "profileName": "sales", "sheet": "Sales", "mode": "multiTable",
    "routes": [
        {"table": "sales_order", "conflict": {"columns": ["order_no"]},
         "columns": {"order_no": {"source": "OrderNo", "validators": ["notNull", "int>=0"]}, "cust": {"source": "Cust", "validators": ["int"]},
                     "status": {"source": "Status", "validators": ["notNull", "len<=1"]}, "total": {"source": "Total", "validators": ["decimal"]}},
         "lookups": [{"name": "segment", "from": "customer", "match": [["c_custkey", "Cust"]], "select": [["c_mktsegment", "segment"]]}]},
        {"table": "sales_line", "parent": "sales_order", "conflict": {"columns": ["order_no", "line_no"]},
         "fkInject": [{"from": "sales_order", "pairs": [["order_no", "order_no"]]}],
         "columns": {"line_no": {"source": "LineNo", "validators": ["int>=1"]}, "qty": {"source": "Qty", "validators": ["int>=1"]}, "part": {"source": "Part", "validators": ["int"]}}},
    ],
})

#: The sheet: orders with their lines as text, with errors that both dialects can write.
LINES = """SELECT l_orderkey, l_linenumber, l_partkey, l_quantity,
    l_orderkey * 1000 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS excel_row FROM lineitem"""
SHEET = f"""SELECT cast(excel_row AS BIGINT) AS excel_row, cast(o_orderkey AS {{text}}) AS OrderNo,
    CASE WHEN o_orderkey % 50 = 1 THEN '' WHEN o_orderkey % 50 = 2 THEN 'c7' WHEN o_orderkey % 50 = 3 THEN '99999999' ELSE cast(o_custkey AS {{text}}) END AS Cust,
    CASE WHEN o_orderkey % 40 = 5 THEN 'PX' ELSE o_orderstatus END AS Status,
    cast(o_orderkey AS {{text}}) AS Total, cast(l_linenumber AS {{text}}) AS LineNo,
    CASE WHEN l_partkey % 29 = 0 THEN 'x' ELSE cast(cast(l_quantity AS INT) AS {{text}}) END AS Qty, cast(l_partkey AS {{text}}) AS Part
    FROM ({LINES}) l JOIN orders ON l_orderkey = o_orderkey"""


def sales_sheet(spark, sf_dir):
    for t in ("orders", "lineitem"):
        table(spark, sf_dir, t).createOrReplaceTempView(t)
    return spark.sql(SHEET.format(text="STRING"))


def sales_plan(spark, sf_dir):
    return plan_import(sales_sheet(spark, sf_dir), SALES, catalogue(spark, sf_dir))


#: What the import does to that sheet, in plain SQL.
_SALES = f"""WITH sheet AS ({SHEET.format(text='VARCHAR')}),
p AS (SELECT s.*, c_mktsegment AS segment, Cust = '' AS k_empty, Cust = 'c7' AS k_bad, Status = 'PX' AS s_bad, Cust = 'c7' AS c_bad,
    Cust NOT IN ('', 'c7') AND c_custkey IS NULL AS k_none, Qty = 'x' AS q_bad
    FROM sheet s LEFT JOIN customer ON TRY_CAST(Cust AS BIGINT) = c_custkey),
q AS (SELECT *, k_empty OR k_bad OR s_bad OR k_none AS parent_failed FROM p),
r AS (SELECT *, parent_failed OR q_bad AS line_failed FROM q),
u AS (SELECT *, NOT line_failed AND excel_row > min(CASE WHEN NOT line_failed THEN excel_row END) OVER (PARTITION BY OrderNo, LineNo) AS repeated FROM r)"""


@query(_SALES + " SELECT excel_row, CAST(OrderNo AS BIGINT) AS order_no, CAST(LineNo AS BIGINT) AS line_no, CAST(Qty AS BIGINT) AS qty, CAST(Part AS BIGINT) AS part, segment FROM u WHERE NOT line_failed AND NOT repeated")
def import_multitable_lookup(spark, sf_dir):
    """Accepted order lines with the segment that their parent looked up."""
    plan = sales_plan(spark, sf_dir)
    lines, parents = plan.payload("sales_line"), plan.payload("sales_order").select("excel_row", "segment")
    return lines.join(parents, "excel_row").select("excel_row", "order_no", "line_no", "qty", "part", "segment")


@query(_SALES + """, e AS (
    SELECT 'Cust' AS "column", 'E_LOOKUP_KEY_EMPTY' AS code FROM u WHERE k_empty UNION ALL SELECT 'Cust', 'E_VALIDATE_TYPE' FROM u WHERE c_bad OR k_empty UNION ALL SELECT 'Cust', 'E_LOOKUP_KEY_INVALID' FROM u WHERE k_bad
    UNION ALL SELECT 'Cust', 'E_LOOKUP_NOT_FOUND' FROM u WHERE k_none UNION ALL SELECT 'Status', 'E_VALIDATE_TYPE' FROM u WHERE s_bad UNION ALL SELECT 'Qty', 'E_VALIDATE_TYPE' FROM u WHERE q_bad
    UNION ALL SELECT 'order_no,line_no', 'E_VALIDATE_DUPLICATE' FROM u WHERE repeated)
SELECT "column", code, count(*) AS n FROM e GROUP BY 1, 2""")
def error_report_counts(spark, sf_dir):
    """Errors of the whole import by column and code."""
    return sales_plan(spark, sf_dir).errors().groupBy("column", "code").agg(F.count(F.lit(1)).alias("n"))


@query(_SALES + " SELECT excel_row, 'order_no,line_no' AS \"column\", OrderNo || ',' || LineNo AS raw FROM u WHERE repeated")
def batch_unique(spark, sf_dir):
    """Order lines whose key stood in an earlier row."""
    return sales_plan(spark, sf_dir).errors().filter("code = 'E_VALIDATE_DUPLICATE'").select(F.col("row").alias("excel_row"), "column", F.col("rawValue").alias("raw"))


@query(_SALES + " SELECT CAST(OrderNo AS BIGINT) AS order_no, CAST(Cust AS BIGINT) AS cust, Status AS status, CAST(Total AS DOUBLE) AS total, segment, count(*) AS rows_seen FROM u WHERE NOT parent_failed GROUP BY ALL")
def parent_dedup(spark, sf_dir):
    """Equal repeats of a parent are no error and make one order."""
    orders = sales_plan(spark, sf_dir).payload("sales_order")
    seen = orders.groupBy("order_no").agg(F.count(F.lit(1)).alias("rows_seen"))
    return last_by_key(orders, ["order_no"], "excel_row").drop("excel_row").join(seen, "order_no").select("order_no", "cust", "status", "total", "segment", "rows_seen")


@query(_SALES + " SELECT count(*) AS read_rows, count(*) FILTER (WHERE NOT parent_failed) AS parent_rows, count(*) FILTER (WHERE NOT line_failed AND NOT repeated) AS line_rows, count(*) FILTER (WHERE NOT parent_failed AND (line_failed OR repeated)) AS only_parent FROM u")
def cascade_failures(spark, sf_dir):
    """A failed parent takes its lines along; a failed line leaves its parent."""
    plan = sales_plan(spark, sf_dir)
    flags = plan.classes[0].rows.select(F.col("failed_0").alias("p"), F.col("failed_1").alias("c"))
    return flags.agg(F.count(F.lit(1)).alias("read_rows"), F.count_if(~F.col("p")).alias("parent_rows"), F.count_if(~F.col("c")).alias("line_rows"), F.count_if(~F.col("p") & F.col("c")).alias("only_parent"))


SINGLE = load_profile({
    "profileName": "customers", "sheet": "Customers", "mode": "singleTable", "table": "customer", "conflict": {"columns": ["c_custkey"]},
    "columns": {"c_custkey": {"source": "No", "validators": ["notNull", "int>=1"]}, "c_name": {"source": "Name", "validators": ["notNull", "len<=32"]},
                "c_mktsegment": {"source": "Segment", "validators": ["enum:BUILDING,MACHINERY,AUTOMOBILE"]}},
})
CUSTOMERS = "SELECT c_custkey + 1 AS excel_row, cast(c_custkey AS {text}) AS No, CASE WHEN c_custkey % 10 = 4 THEN '' ELSE c_name END AS Name, c_mktsegment AS Segment FROM customer"


def _sql(spark, sf_dir, text, *tables):
    for t in tables:
        table(spark, sf_dir, t).createOrReplaceTempView(t)
    return spark.sql(text)


@query("SELECT c_custkey + 1 AS excel_row, c_custkey, c_mktsegment, c_name FROM customer WHERE c_custkey >= 1 AND c_custkey % 10 <> 4 AND c_mktsegment IN ('BUILDING', 'MACHINERY', 'AUTOMOBILE')")
def import_single(spark, sf_dir):
    sheet = _sql(spark, sf_dir, CUSTOMERS.format(text="STRING"), "customer")
    return plan_import(sheet, SINGLE, catalogue(spark, sf_dir)).payload("customer")


EVENTS = load_profile({
    "profileName": "events", "sheet": "Events", "mode": "mixed", "discriminator": {"source": "Type"},
    "classes": [
        {"id": "click", "match": {"equals": "click"}, "routes": [{"table": "click", "conflict": {"columns": ["id"]}, "columns": {"id": {"source": "Id", "validators": ["int"]}, "who": {"source": "User", "validators": ["int"]}}}]},
        {"id": "purchase", "match": {"equals": "purchase"}, "routes": [{"table": "purchase", "conflict": {"columns": ["id"]}, "columns": {"id": {"source": "Id", "validators": ["int"]}, "amount": {"source": "Value", "validators": ["decimal"]}}}]},
        {"id": "view", "match": {"equals": "view"}, "routes": [{"table": "viewing", "conflict": {"columns": ["id"]}, "columns": {"id": {"source": "Id", "validators": ["int"]}, "what": {"source": "Type"}}}]},
    ],
})


def events_plan(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    sheet = e.select((F.col("event_id") + 2).alias("excel_row"), F.col("event_id").cast("string").alias("Id"), F.col("user_id").cast("string").alias("User"), F.col("event_type").alias("Type"), (F.col("event_id") % 1000).cast("string").alias("Value"))
    return plan_import(sheet, EVENTS, catalogue(spark, sf_dir))


@query("SELECT CASE WHEN event_type IN ('click', 'purchase', 'view') THEN event_type ELSE 'unmatched' END AS class_id, count(*) AS n FROM events GROUP BY 1")
def route_mixed_counts(spark, sf_dir):
    plan = events_plan(spark, sf_dir)
    parts = [c.rows.agg(F.lit(c.spec.id).alias("class_id"), F.count(F.lit(1)).alias("n")) for c in plan.classes]
    out = plan.errors().filter("code = 'E_ROUTE_UNMATCHED'").agg(F.lit("unmatched").alias("class_id"), F.count(F.lit(1)).alias("n"))
    for p in parts:
        out = out.union(p)
    return out


@query("""SELECT event_id + 2 AS excel_row, event_id AS id, CAST(CASE WHEN event_type = 'click' THEN user_id END AS VARCHAR) AS who, CASE WHEN event_type = 'purchase' THEN CAST(event_id % 1000 AS DOUBLE) END AS amount, CASE WHEN event_type = 'view' THEN event_type END AS what
FROM events WHERE event_type IN ('click', 'purchase', 'view')""")
def route_mixed_payload(spark, sf_dir):
    plan = events_plan(spark, sf_dir)
    out = plan.payload("click")
    for t in ("purchase", "viewing"):
        out = out.unionByName(plan.payload(t), allowMissingColumns=True)
    return out.select("excel_row", "id", F.col("who").cast("string").alias("who"), "amount", "what")


def _lookup_plan(spark, sf_dir, sheet, table_name, columns, lookups, cat=None):
    profile = load_profile({"profileName": "lookup", "sheet": "L", "mode": "singleTable", "table": table_name, "conflict": {"columns": [next(iter(columns))]}, "columns": columns, "lookups": lookups})
    return plan_import(sheet, profile, cat or catalogue(spark, sf_dir))


@query("SELECT o_orderkey AS order_no, c_mktsegment AS segment FROM orders JOIN customer ON o_custkey = c_custkey")
def lookup_one_hit(spark, sf_dir):
    sheet = table(spark, sf_dir, "orders").select((F.col("o_orderkey") + 1).alias("excel_row"), F.col("o_orderkey").cast("string").alias("No"), F.col("o_custkey").cast("string").alias("Cust"))
    plan = _lookup_plan(spark, sf_dir, sheet, "sales_order", {"order_no": {"source": "No", "validators": ["int"]}}, [{"name": "s", "from": "customer", "match": [["c_custkey", "Cust"]], "select": [["c_mktsegment", "segment"]]}])
    return plan.payload("sales_order").select("order_no", "segment")


@query("SELECT o_orderkey AS row_no, CAST(o_custkey AS VARCHAR) AS raw, 'E_LOOKUP_NOT_FOUND' AS code FROM orders WHERE o_custkey % 7 = 0")
def lookup_not_found(spark, sf_dir):
    cat = catalogue(spark, sf_dir)
    cat.read["customer"] = cat.read["customer"].filter("c_custkey % 7 <> 0")
    sheet = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("excel_row"), F.col("o_orderkey").cast("string").alias("No"), F.col("o_custkey").cast("string").alias("Cust"))
    plan = _lookup_plan(spark, sf_dir, sheet, "sales_order", {"order_no": {"source": "No", "validators": ["int"]}}, [{"name": "s", "from": "customer", "match": [["c_custkey", "Cust"]], "select": [["c_mktsegment", "segment"]]}], cat)
    return plan.errors().select(F.col("row").alias("row_no"), F.col("rawValue").alias("raw"), "code")


@query("""WITH n AS (SELECT p_name, count(*) AS hits, min(p_brand) AS brand FROM part GROUP BY 1)
SELECT p_partkey AS id, CASE WHEN hits = 1 THEN brand END AS brand, CASE WHEN hits > 1 THEN 'E_LOOKUP_AMBIGUOUS' END AS code FROM part JOIN n USING (p_name)""")
def lookup_ambiguous(spark, sf_dir):
    """A key that several reference rows have is an error, never a fan-out."""
    sheet = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("excel_row"), F.col("p_partkey").cast("string").alias("Id"), F.col("p_name").alias("Name"))
    plan = _lookup_plan(spark, sf_dir, sheet, "pick", {"id": {"source": "Id", "validators": ["int"]}}, [{"name": "b", "from": "part", "match": [["p_name", "Name"]], "select": [["p_brand", "brand"]]}])
    rows = plan.classes[0].rows
    return rows.select(F.col("excel_row").alias("id"), F.col("r_pick.brand").alias("brand"), F.try_element_at("errors_0", F.lit(1))["code"].alias("code"))


@query("SELECT c_custkey AS acc, CASE WHEN c_custkey % 6 <> 0 THEN n_name END AS nation_name, CASE WHEN c_custkey % 6 = 0 THEN 'E_LOOKUP_NOT_FOUND' END AS code FROM customer JOIN nation ON c_nationkey = n_nationkey")
def lookup_composite(spark, sf_dir):
    """A key of two columns: nation and region must fit together."""
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    region = F.when(F.col("c_custkey") % 6 == 0, F.col("n_regionkey") + 100).otherwise(F.col("n_regionkey"))
    sheet = c.join(n, c.c_nationkey == n.n_nationkey).select(F.col("c_custkey").alias("excel_row"), F.col("c_custkey").cast("string").alias("Acc"), F.col("c_nationkey").cast("string").alias("Nation"), region.cast("string").alias("Region"))
    plan = _lookup_plan(spark, sf_dir, sheet, "account", {"acc": {"source": "Acc", "validators": ["int"]}}, [{"name": "n", "from": "nation", "match": [["n_nationkey", "Nation"], ["n_regionkey", "Region"]], "select": [["n_name", "nation_name"]]}])
    return plan.classes[0].rows.select(F.col("excel_row").alias("acc"), F.col("r_account.nation_name").alias("nation_name"), F.try_element_at("errors_0", F.lit(1))["code"].alias("code"))


@query("""SELECT o_orderkey AS order_no, CASE o_orderkey % 4 WHEN 0 THEN 'E_LOOKUP_KEY_EMPTY' WHEN 1 THEN 'E_LOOKUP_KEY_INVALID' WHEN 2 THEN 'E_LOOKUP_KEY_EMPTY' END AS code, CASE WHEN o_orderkey % 4 = 3 THEN c_mktsegment END AS segment
FROM orders JOIN customer ON o_custkey = c_custkey""")
def lookup_key_invalid_empty(spark, sf_dir):
    """Blank, null and lettered keys of an integer column; a blank before a number is no other key."""
    o = table(spark, sf_dir, "orders")
    key = F.expr("CASE o_orderkey % 4 WHEN 0 THEN '  ' WHEN 1 THEN concat(o_custkey, 'a') WHEN 2 THEN NULL ELSE concat(' ', o_custkey) END")
    sheet = o.select(F.col("o_orderkey").alias("excel_row"), F.col("o_orderkey").cast("string").alias("No"), key.alias("Cust"))
    plan = _lookup_plan(spark, sf_dir, sheet, "sales_order", {"order_no": {"source": "No", "validators": ["int"]}}, [{"name": "s", "from": "customer", "match": [["c_custkey", "Cust"]], "select": [["c_mktsegment", "segment"]]}])
    return plan.classes[0].rows.select(F.col("excel_row").alias("order_no"), F.try_element_at("errors_0", F.lit(1))["code"].alias("code"), F.col("r_sales_order.segment").alias("segment"))


@query(_SALES + " SELECT OrderNo AS order_no, count(*) AS lines, CAST(sum(CAST(Qty AS BIGINT)) AS BIGINT) AS qty FROM u WHERE NOT line_failed AND NOT repeated GROUP BY 1")
def fk_inject(spark, sf_dir):
    """The parent's key in its lines."""
    lines = sales_plan(spark, sf_dir).payload("sales_line")
    return lines.groupBy(F.col("order_no").cast("string").alias("order_no")).agg(F.count(F.lit(1)).alias("lines"), F.sum("qty").alias("qty"))


@query("SELECT l_orderkey * 1000 + l_linenumber AS row_no, 'order_no' AS \"column\", 'E_VALIDATE_FK' AS code FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) WHERE l_orderkey % 8 = 0")
def fk_inject_null_parent(spark, sf_dir):
    """A parent without its key has no error of its own here, but its lines have."""
    profile = load_profile({
        "profileName": "nulls", "sheet": "N", "mode": "multiTable",
        "routes": [
            {"table": "sales_order", "conflict": {"columns": ["order_no"]}, "columns": {"order_no": {"source": "No", "validators": ["int"]}}},
            {"table": "sales_line", "parent": "sales_order", "conflict": {"columns": ["order_no", "line_no"]}, "fkInject": [{"from": "sales_order", "pairs": [["order_no", "order_no"]]}], "columns": {"line_no": {"source": "Line", "validators": ["int"]}}},
        ],
    })
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    sheet = li.select((F.col("l_orderkey") * 1000 + F.col("l_linenumber")).alias("excel_row"), F.expr("CASE WHEN l_orderkey % 8 <> 0 THEN cast(l_orderkey AS STRING) END").alias("No"), F.col("l_linenumber").cast("string").alias("Line"))
    return plan_import(sheet, profile, catalogue(spark, sf_dir)).errors().select(F.col("row").alias("row_no"), "column", "code")


@query("""SELECT l_orderkey, count(*) AS lost FROM lineitem WHERE l_orderkey % 10 = 3 AND NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus = 'F') GROUP BY 1
UNION ALL SELECT l_orderkey, count(*) FROM lineitem WHERE l_orderkey % 10 <> 3 AND NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus IN ('F', 'O')) GROUP BY 1""")
def fk_preflight(spark, sf_dir):
    """Keys must exist among the batch's parents (O, but not those of key % 10 = 3) or in the table (F).

    The line's key comes from the order of its row, which may fail while the line itself does not hang on it.
    """
    profile = load_profile({
        "profileName": "preflight", "sheet": "P", "mode": "multiTable",
        "routes": [
            {"table": "sales_order", "conflict": {"columns": ["order_no"]},
             "columns": {"order_no": {"source": "No", "validators": ["int"]}, "status": {"source": "Status", "validators": ["enum:O"]}, "segment": {"source": "Last", "validators": ["regex:[^3]"]}}},
            {"table": "sales_line", "conflict": {"columns": ["line_no"]}, "fkInject": [{"from": "sales_order", "pairs": [["order_no", "order_no"]]}],
             "columns": {"line_no": {"source": "Line", "validators": ["int"]}}},
        ],
    })
    sheet = _sql(spark, sf_dir, f"""SELECT excel_row, cast(o_orderkey AS STRING) AS No, o_orderstatus AS Status, cast(o_orderkey % 10 AS STRING) AS Last, cast(excel_row AS STRING) AS Line
        FROM ({LINES}) l JOIN orders ON l_orderkey = o_orderkey""", "lineitem", "orders")  # fmt: skip
    known = catalogue(spark, sf_dir)
    known.read["sales_order"] = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("order_no"))
    lost = plan_import(sheet, profile, known).errors().filter("code = 'E_VALIDATE_FK'")
    return lost.groupBy(F.col("rawValue").cast("long").alias("l_orderkey")).agg(F.count(F.lit(1)).alias("lost"))


UPDATES = """SELECT c_custkey + (SELECT max(c_custkey) FROM customer) * (c_custkey % 2) AS c_custkey, upper(c_name) AS c_name, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 'NEW' END AS c_mktsegment FROM customer WHERE c_custkey % 4 < 2"""


@query(f"""WITH s AS ({UPDATES}) SELECT coalesce(c.c_custkey, s.c_custkey) AS c_custkey, CASE WHEN s.c_custkey IS NOT NULL THEN s.c_name ELSE c.c_name END AS c_name, CAST(c.c_nationkey AS VARCHAR) AS c_nationkey, c.c_acctbal,
    CASE WHEN s.c_custkey IS NOT NULL THEN s.c_mktsegment ELSE c.c_mktsegment END AS c_mktsegment FROM customer c FULL JOIN s ON c.c_custkey = s.c_custkey""")
def upsert_merge(spark, sf_dir):
    """Half of the source updates, half is new; nulls overwrite, columns it lacks are kept."""
    source = _sql(spark, sf_dir, UPDATES, "customer")
    merged = upsert(table(spark, sf_dir, "customer"), source, ["c_custkey"])
    return merged.withColumn("c_nationkey", F.col("c_nationkey").cast("string"))


@query(f"""WITH s AS ({UPDATES}) SELECT c_custkey, c_name, CAST(c_nationkey AS VARCHAR) AS c_nationkey, c_acctbal, c_mktsegment FROM customer
UNION ALL SELECT c_custkey, c_name, NULL, NULL, c_mktsegment FROM s WHERE c_custkey NOT IN (SELECT c_custkey FROM customer)""")
def upsert_do_nothing(spark, sf_dir):
    merged = upsert(table(spark, sf_dir, "customer"), _sql(spark, sf_dir, UPDATES, "customer"), ["c_custkey"], "nothing")
    return merged.withColumn("c_nationkey", F.col("c_nationkey").cast("string"))


@query("""WITH m AS (SELECT l_orderkey % 500 AS c_custkey, l_partkey AS p, l_orderkey * 100000 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS ordinal FROM lineitem WHERE l_orderkey % 3 = 0),
last AS (SELECT c_custkey, max_by(p, ordinal) AS p FROM m GROUP BY 1)
SELECT coalesce(c.c_custkey, l.c_custkey) AS c_custkey, CASE WHEN l.c_custkey IS NULL THEN c_name WHEN l.p % 2 = 0 THEN 'part ' || l.p WHEN c.c_custkey IS NULL THEN 'part ' || l.p ELSE c_name END AS c_name FROM customer c FULL JOIN last l ON c.c_custkey = l.c_custkey""")
def mutation_apply(spark, sf_dir):
    """Keyed writes of both modes; the last write of a key counts."""
    m = _sql(spark, sf_dir, """SELECT l_orderkey % 500 AS c_custkey, concat('part ', l_partkey) AS c_name, CASE WHEN l_partkey % 2 = 0 THEN 'update' ELSE 'nothing' END AS mode,
        l_orderkey * 100000 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS ordinal FROM lineitem WHERE l_orderkey % 3 = 0""", "lineitem")  # fmt: skip
    return apply_mutations(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), m, ["c_custkey"])
