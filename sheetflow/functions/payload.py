"""Payloads as typed columns: a mark, a version, a kind, a header and a body, with a checksum over all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARK, VERSIONS = "SFPL", (1, 2)
KINDS = ("changeset", "push", "baseline", "control", "ack", "baseline_ack")


def encode(kind: str, header: Column, body: Column, version: int = 2) -> Column:
    """One payload: ``mark|version|kind|length of the header|header|body|checksum``; header and body are JSON texts."""
    if kind not in KINDS or version not in VERSIONS:
        raise ValueError("no such kind or version of payload")
    head = F.concat(F.lit(f"{MARK}|{version}|{kind}|"), F.length(header).cast("string"), F.lit("|"), header, F.lit("|"), body)
    return F.concat(head, F.lit("|"), F.sha2(head, 256))


def decode(df: DataFrame, column: str) -> DataFrame:
    """Adds version, kind, header, body and code: null, or E_SYNC_PAYLOAD_CORRUPT where the payload is not whole."""
    c = F.col(column)
    parts = F.split(c, r"\|", 5)
    size, rest = F.try_element_at(parts, F.lit(4)).try_cast("int"), F.try_element_at(parts, F.lit(5))
    whole = F.substring(c, 1, F.length(c) - 65)
    good = (F.try_element_at(parts, F.lit(1)) == MARK) & F.try_element_at(parts, F.lit(2)).isin(*map(str, VERSIONS)) & F.try_element_at(parts, F.lit(3)).isin(*KINDS) & size.isNotNull()
    good = F.coalesce(good & (F.substring(c, F.length(c) - 64, F.lit(65)) == F.concat(F.lit("|"), F.sha2(whole, 256))), F.lit(False))
    value = lambda x: F.when(good, x)
    body = F.substring(rest, size + 2, F.length(rest) - size - 1 - 65)
    return df.withColumns({
        "version": value(F.try_element_at(parts, F.lit(2)).try_cast("int")), "kind": value(F.try_element_at(parts, F.lit(3))),
        "header": value(F.substring(rest, F.lit(1), size)), "body": value(body), "code": F.when(~good, "E_SYNC_PAYLOAD_CORRUPT"),
    })


def fragments(df: DataFrame, key: list[str], column: str, size: int) -> DataFrame:
    """(key, idx, total, part): a text cut into parts of ``size`` characters; an empty text is one empty part."""
    total = F.greatest(F.ceil(F.length(column) / size), F.lit(1)).cast("int")
    rows = df.select(*key, F.col(column).alias("whole_"), total.alias("total"), F.explode(F.sequence(F.lit(0), total - 1)).alias("idx"))
    return rows.select(*key, "idx", "total", F.substring("whole_", F.col("idx") * size + 1, F.lit(size)).alias("part"))


def reassembled(parts: DataFrame, key: list[str]) -> DataFrame:
    """(key, text) of the messages whose parts are all there, in any order and repeated; parts that differ fail a message.

    A message has at most 65,535 parts; more is refused.
    """
    once = parts.groupBy(*key, "idx").agg(F.min("part").alias("part"), F.max("part").alias("other"), F.min("total").alias("total"), F.max("total").alias("most"))
    every = once.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n"), F.min("total").alias("total"), F.max("most").alias("most"), F.count_if(F.col("part") != F.col("other")).alias("bad"),
        F.sort_array(F.collect_list(F.when(F.col("idx") < 65_535, F.struct("idx", "part")))).alias("xs"),
    )
    whole = every.filter("n = total and total = most and bad = 0 and total <= 65535")
    return whole.select(*key, F.array_join(F.transform("xs", lambda x: x["part"]), "").alias("text"))
