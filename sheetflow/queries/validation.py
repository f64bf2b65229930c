"""Validators, chains and temporal conversion (V*, T*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import temporal, validators
from ..plans.checks import auto_profile
from ..sources.registry import TEST_TABLES, Catalogue
from .common import table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _checked(df, key: str, raw: str, tokens: list[str]):
    rows = df.select(key, F.expr(raw).alias("raw"))
    c = validators.chain(F.col("raw"), tokens)
    return rows.select(key, "raw", c.value.alias("value"), c.code.alias("code"))


STATUS = "CASE WHEN o_orderkey % 13 = 0 THEN '' WHEN o_orderkey % 17 = 0 THEN NULL WHEN o_orderkey % 19 = 0 THEN ' ' ELSE o_orderstatus END"


@query(f"SELECT o_orderkey, raw, 'E_VALIDATE_NULL' AS code FROM (SELECT o_orderkey, {STATUS} AS raw FROM orders) WHERE raw IS NULL OR raw = ''")
def validate_notnull(spark, sf_dir):
    return _checked(table(spark, sf_dir, "orders"), "o_orderkey", STATUS, ["notNull"]).filter("code is not null").select("o_orderkey", "raw", "code")


@query("SELECT p_partkey, p_name AS raw, CASE WHEN length(p_name) < 11 OR length(p_name) > 14 THEN 'E_VALIDATE_TYPE' END AS code FROM part")
def validate_len(spark, sf_dir):
    return _checked(table(spark, sf_dir, "part"), "p_partkey", "p_name", ["len>=11", "len<=14"]).drop("value")


SIZE = "CASE WHEN p_partkey % 11 = 0 THEN 'x' WHEN p_partkey % 7 = 0 THEN concat(p_size, '.5') WHEN p_partkey % 5 = 0 THEN concat(' ', p_size, ' ') WHEN p_partkey % 23 = 0 THEN '99999999999999999999' ELSE cast(p_size as {text}) END"


@query(f"""WITH s AS (SELECT p_partkey, {SIZE.format(text='VARCHAR')} AS raw FROM part),
v AS (SELECT *, CASE WHEN regexp_full_match(raw, '\\s*[+-]?[0-9]+\\s*') THEN TRY_CAST(trim(raw) AS BIGINT) END AS n FROM s)
SELECT p_partkey, raw, CAST(CASE WHEN n >= 10 THEN n END AS VARCHAR) AS value, CASE WHEN n IS NULL OR n < 10 THEN 'E_VALIDATE_TYPE' END AS code FROM v""")
def validate_int(spark, sf_dir):
    return _checked(table(spark, sf_dir, "part"), "p_partkey", SIZE.format(text="STRING"), ["int>=10"]).withColumn("value", F.col("value").cast("string"))


PRICE = "CASE WHEN o_orderkey % 11 = 0 THEN '1d' WHEN o_orderkey % 7 = 0 THEN 'abc' WHEN o_orderkey % 5 = 0 THEN '.5e2' WHEN o_orderkey % 3 = 0 THEN NULL ELSE cast(o_orderkey * 0.25 as {text}) END"


@query(f"""WITH s AS (SELECT o_orderkey, {PRICE.format(text='DECIMAL(20,2)')} AS raw FROM (SELECT o_orderkey FROM orders)),
v AS (SELECT o_orderkey, CAST(raw AS VARCHAR) AS raw FROM s)
SELECT o_orderkey, raw, CASE WHEN regexp_full_match(raw, '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?') THEN TRY_CAST(raw AS DOUBLE) END AS value,
    CASE WHEN raw IS NOT NULL AND NOT regexp_full_match(raw, '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?') THEN 'E_VALIDATE_TYPE' END AS code FROM v""".replace("o_orderkey * 0.25 as DECIMAL(20,2)) END", "CAST(o_orderkey * 0.25 AS DECIMAL(20,2)) AS VARCHAR) END"))
def validate_decimal(spark, sf_dir):
    raw = PRICE.format(text="STRING").replace("o_orderkey * 0.25", "cast(o_orderkey * 0.25 as decimal(20,2))")
    return _checked(table(spark, sf_dir, "orders"), "o_orderkey", raw, ["decimal"])


NAME = "CASE WHEN c_custkey % 9 = 0 THEN concat(c_name, chr(10)) WHEN c_custkey % 8 = 0 THEN lower(c_name) WHEN c_custkey % 31 = 0 THEN NULL ELSE c_name END"


@query(f"WITH s AS (SELECT c_custkey, {NAME} AS raw FROM customer) SELECT c_custkey, CASE WHEN NOT regexp_full_match(raw, 'Customer#[0-9]{{9}}') THEN 'E_VALIDATE_REGEX' END AS code FROM s")
def validate_regex(spark, sf_dir):
    return _checked(table(spark, sf_dir, "customer"), "c_custkey", NAME, [r"regex:Customer#\d{9}"]).select("c_custkey", "code")


@query("SELECT o_orderkey, o_orderpriority AS raw, CASE WHEN o_orderpriority NOT IN ('1-URGENT', '2-HIGH') THEN 'E_VALIDATE_TYPE' END AS code FROM orders")
def validate_enum(spark, sf_dir):
    return _checked(table(spark, sf_dir, "orders"), "o_orderkey", "o_orderpriority", ["enum:1-URGENT, 2-HIGH"]).select("o_orderkey", "raw", "code")


@query("""WITH s AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN strftime(o_orderdate, '%-d/%-m/%Y') WHEN o_orderkey % 11 = 0 THEN '2024-02-30' WHEN o_orderkey % 5 = 0 THEN strftime(o_orderdate, '%Y-%-m-%d') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS raw FROM orders)
SELECT o_orderkey, raw, CASE WHEN regexp_full_match(raw, '[0-9]{4}-[0-9]{2}-[0-9]{2}') THEN CAST(TRY_CAST(raw AS DATE) AS VARCHAR) END AS value,
    CASE WHEN CASE WHEN regexp_full_match(raw, '[0-9]{4}-[0-9]{2}-[0-9]{2}') THEN TRY_CAST(raw AS DATE) END IS NULL THEN 'E_VALIDATE_TYPE' END AS code FROM s""")
def validate_date(spark, sf_dir):
    raw = "CASE WHEN o_orderkey % 7 = 0 THEN date_format(o_orderdate, 'd/M/yyyy') WHEN o_orderkey % 11 = 0 THEN '2024-02-30' WHEN o_orderkey % 5 = 0 THEN date_format(o_orderdate, 'yyyy-M-dd') ELSE date_format(o_orderdate, 'yyyy-MM-dd') END"
    return _checked(table(spark, sf_dir, "orders"), "o_orderkey", raw, ["date:yyyy-MM-dd"]).withColumn("value", F.col("value").cast("string"))


QTY = "CASE WHEN l_partkey % 13 = 0 THEN '' WHEN l_partkey % 11 = 0 THEN 'x1234567' WHEN l_partkey % 7 = 0 THEN 'abc' ELSE cast(l_partkey as {text}) END"


@query(f"""WITH s AS (SELECT {QTY.format(text='VARCHAR')} AS raw FROM lineitem),
c AS (SELECT raw, CASE WHEN raw = '' THEN 'E_VALIDATE_NULL' WHEN length(raw) > 6 THEN 'E_VALIDATE_TYPE' WHEN NOT regexp_full_match(raw, '[0-9]+') THEN 'E_VALIDATE_TYPE' WHEN CAST(raw AS BIGINT) < 100 THEN 'E_VALIDATE_TYPE' END AS code,
    CASE WHEN raw = '' THEN 'needed' WHEN length(raw) > 6 THEN 'long' WHEN NOT regexp_full_match(raw, '[0-9]+') OR CAST(raw AS BIGINT) < 100 THEN 'number' END AS why FROM s)
SELECT code, why, count(*) AS n FROM c GROUP BY 1, 2""")
def chain_first_error(spark, sf_dir):
    """The first failing token decides; the message tells which."""
    rows = table(spark, sf_dir, "lineitem").select(F.expr(QTY.format(text="STRING")).alias("raw"))
    c = validators.chain(F.col("raw"), ["notNull", "len<=6", "int>=100"])
    why = F.when(c.message.startswith("a value"), "needed").when(c.message.startswith("longer"), "long").when(c.message.startswith("no integer"), "number")
    return rows.select(c.code.alias("code"), why.alias("why")).groupBy("code", "why").agg(F.count(F.lit(1)).alias("n"))


_AUTO = " UNION ALL ".join(
    f"SELECT '{n}' AS table_name, {str(bool(t.primary_key)).lower()} AS executable, '{','.join(t.primary_key)}' AS conflict, column_name, CASE column_type WHEN 'BIGINT' THEN 'int' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'decimal' ELSE '' END AS validators FROM (DESCRIBE SELECT * FROM {n})"
    for n, t in TEST_TABLES.items()
)


@query(_AUTO)
def auto_profile_columns(spark, sf_dir):
    """Derived profiles of all tables, from their files and declared keys: a row for each column."""
    rows, found = [], Catalogue.scan({n: table(spark, sf_dir, n) for n in TEST_TABLES}, TEST_TABLES)
    for name in sorted(TEST_TABLES):
        doc, executable, _ = auto_profile(found.tables[name])
        rows += [(name, executable, ",".join(doc["conflict"]["columns"]), c, ",".join(spec["validators"])) for c, spec in doc["columns"].items()]
    return spark.createDataFrame(rows, "table_name string, executable boolean, conflict string, column_name string, validators string")


@query("SELECT o_orderkey, strftime(o_orderdate, '%-d/%-m/%Y') AS cell, CAST(NULL AS VARCHAR) AS code FROM orders WHERE o_orderkey % 9 <> 0 UNION ALL SELECT o_orderkey, NULL, CASE WHEN o_orderkey % 2 = 0 THEN 'E_TIME_PARSE_DB' END FROM orders WHERE o_orderkey % 9 = 0")
def export_temporal_date(spark, sf_dir):
    """Stored ISO dates in the sheet's form; every ninth value is null or cannot be parsed."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.expr("CASE WHEN o_orderkey % 9 <> 0 THEN date_format(o_orderdate, 'yyyy-MM-dd') WHEN o_orderkey % 2 = 0 THEN 'never' END").alias("stored"))
    text, failed = temporal.export_value(F.col("stored"), "date", "string", "yyyy-MM-dd", "d/M/yyyy")
    return rows.select("o_orderkey", text.alias("cell"), F.when(failed, "E_TIME_PARSE_DB").alias("code"))


@query("SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS stored, strftime(ts, '%Y-%m-%d %H:%M:%S') AS cell FROM events UNION ALL SELECT -event_id - 1, -event_id * 86400, strftime(TIMESTAMP '1970-01-01' - to_days(CAST(event_id AS INTEGER)), '%Y-%m-%d %H:%M:%S') FROM events WHERE event_id < 1000")
def export_epoch(spark, sf_dir):
    """Timestamps to epoch seconds and back, zero and negative ones included."""
    events = table(spark, sf_dir, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("cell"))
    before = events.filter("event_id < 1000").select((-F.col("event_id") - 1).alias("event_id"), F.date_format(F.timestamp_seconds(-F.col("event_id") * 86400), "yyyy-MM-dd HH:mm:ss").alias("cell"))
    stored, _ = temporal.import_value(F.col("cell"), "datetime", ("yyyy-MM-dd HH:mm:ss",), "epochSec", "")
    rows = events.union(before).select("event_id", stored.cast("bigint").alias("stored"))
    cell, _ = temporal.export_value(F.col("stored"), "datetime", "epochSec", "", "yyyy-MM-dd HH:mm:ss")
    return rows.select("event_id", "stored", cell.alias("cell"))


@query("""WITH s AS (SELECT o_orderkey, o_orderdate AS d, CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%-d/%-m/%Y') WHEN 2 THEN strftime(o_orderdate, '%Y.%m.%d') WHEN 3 THEN 'soon' ELSE ' ' END AS raw FROM orders)
SELECT o_orderkey, raw, CASE WHEN o_orderkey % 5 < 3 THEN strftime(d, '%Y-%m-%d') END AS stored, CASE WHEN o_orderkey % 5 = 3 THEN 'E_TIME_PARSE' END AS code FROM s""")
def temporal_fallback(spark, sf_dir):
    """Three forms of date, an unparseable text and a blank."""
    raw = "CASE o_orderkey % 5 WHEN 0 THEN date_format(o_orderdate, 'yyyy-MM-dd') WHEN 1 THEN date_format(o_orderdate, 'd/M/yyyy') WHEN 2 THEN date_format(o_orderdate, 'yyyy.MM.dd') WHEN 3 THEN 'soon' ELSE ' ' END"
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(raw).alias("raw"))
    stored, failed = temporal.import_value(F.col("raw"), "date", ("yyyy-MM-dd", "d/M/yyyy", "yyyy.MM.dd"), "string", "yyyy-MM-dd")
    return rows.select("o_orderkey", "raw", stored.alias("stored"), F.when(failed, "E_TIME_PARSE").alias("code"))


@query("SELECT event_id, strftime(ts, '%H:%M:%S') AS stored FROM events")
def temporal_time_slot(spark, sf_dir):
    """A time of day on a twelve-hour clock, stored on a day of twenty-four."""
    rows = table(spark, sf_dir, "events").select("event_id", F.date_format("ts", "h:mm:ss a").alias("raw"))
    stored, _ = temporal.import_value(F.col("raw"), "time", ("h:mm:ss AP",), "string", "HH:mm:ss")
    return rows.select("event_id", stored.alias("stored"))
