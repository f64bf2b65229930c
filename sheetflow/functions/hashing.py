"""Hashes of rows, keys, tables and schemas.

A row is encoded column by column in order of the names: name length, name, type tag, value length,
value. Tags: 0 null, 1 integer, 2 floating (six decimals), 3 text, 4 binary (hex). Lengths make two rows
of equal encoding equal rows.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MODULUS = 1 << 64


def tagged(name: str, kind: T.DataType) -> Column:
    c = F.col(name)
    if isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
        tag, value = "2", F.format_string("%.6f", c.cast("double"))
    elif isinstance(kind, T.IntegralType):
        tag, value = "1", c.cast("string")
    elif isinstance(kind, T.BinaryType):
        tag, value = "4", F.hex(c)
    elif isinstance(kind, T.TimestampType):
        tag, value = "3", F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    else:
        tag, value = "3", c.cast("string")
    head = f"{len(name)}|{name}|"
    return F.when(c.isNull(), F.lit(head + "0|")).otherwise(F.concat(F.lit(f"{head}{tag}|"), F.length(value).cast("string"), F.lit("|"), value, F.lit("|")))


def encoded(df: DataFrame, columns: list[str] | None = None) -> Column:
    kinds = {f.name: f.dataType for f in df.schema}
    return F.concat(*[tagged(c, kinds[c]) for c in sorted(columns or df.columns)])


def row_hash(df: DataFrame, columns: list[str] | None = None) -> Column:
    """First 16 bytes of SHA-256 of the encoded row, in hexadecimal."""
    return F.substring(F.sha2(encoded(df, columns), 256), 1, 32)


def fingerprint(df: DataFrame, columns: list[str] | None = None) -> Column:
    return F.sha1(encoded(df, columns))


def as_number(hash_hex: Column) -> Column:
    """First 8 bytes of a hash as a number below 2**64."""
    return F.conv(F.substring(hash_hex, 1, 16), 16, 10).cast("decimal(20,0)")


def modulo(c: Column) -> Column:
    """A decimal sum modulo 2**64, never negative, as text."""
    m = F.lit(str(MODULUS)).cast("decimal(38,0)")
    return F.pmod(c.cast("decimal(38,0)"), m).cast("decimal(20,0)").cast("string")


def table_checksum(df: DataFrame, name: str) -> DataFrame:
    """table_name, row_count and the order-independent sum of row hashes modulo 2**64 (partial sums)."""
    rows = df.select(as_number(row_hash(df)).alias("h"))
    total = F.coalesce(F.sum(F.col("h").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))
    return rows.agg(F.count(F.lit(1)).alias("row_count"), modulo(total).alias("content_checksum")).select(F.lit(name).alias("table_name"), "row_count", "content_checksum")


def schema_fingerprint(tables: list) -> str:
    """SHA-256 over sorted tables: columns, primary key, unique indexes, foreign keys."""
    h = hashlib.sha256()
    for t in sorted(tables, key=lambda t: t.name):
        h.update(f"table {t.name}\n".encode())
        for c in sorted(t.columns, key=lambda c: c.name):
            h.update(f"column {c.name} {c.type} pk={t.primary_key.index(c.name) + 1 if c.name in t.primary_key else 0} nn={int(c.not_null)} default={c.default}\n".encode())
        for u in sorted(t.unique):
            h.update(f"unique {','.join(u)}\n".encode())
        for f in sorted(t.foreign_keys, key=lambda f: (f.columns, f.ref_table)):
            h.update(f"fk {','.join(f.columns)} {f.ref_table} {','.join(f.ref_columns)}\n".encode())
    return h.hexdigest()
