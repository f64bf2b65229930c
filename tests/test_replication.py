"""Folds, gates, snapshots, workbooks and the stream."""

import os
import random
import re
import zipfile

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sheetflow.functions import hashing
from sheetflow.operators import closure, diff
from sheetflow.operators import replication as r
from sheetflow.sources.snapshots import ChangelogStore, SnapshotStore
from sheetflow.sources.xlsx import SheetError, read_rows, read_xlsx, write_xlsx
from sheetflow.streaming import inbox

CHANGE = "origin string, epoch long, seq long, rank int, op string, pk string, payload string"


def test_gate(spark):
    rows = [("a", 1, s) for s in (1, 2, 2, 4, 5)] + [("b", 1, s) for s in (3, 4)] + [("c", 1, 0)]
    got = r.applicable(spark.createDataFrame(rows, "origin string, epoch long, seq long"), spark.createDataFrame([("b", 1, 3)], "origin string, epoch long, applied_seq long"))
    assert sorted((x.origin, x.seq, x.decision) for x in got.collect()) == [
        ("a", 1, "apply"), ("a", 2, "apply"), ("a", 2, "apply"), ("a", 4, "gap"), ("a", 5, "gap"), ("b", 3, "noop"), ("b", 4, "apply"), ("c", 0, "noop"),
    ]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("abc"), st.integers(1, 9), st.integers(0, 3), st.sampled_from("UD"), st.sampled_from("xyz")), min_size=1, max_size=30, unique_by=lambda c: c[:2]))
def test_winners_do_not_depend_on_order(spark, changes):
    rows = [(o, 1, s, k, op, pk, f"{o}{s}") for o, s, k, op, pk in changes]
    expected = {}
    for row in rows:
        key = (row[3], row[2], row[0])
        if row[5] not in expected or key > expected[row[5]][0]:
            expected[row[5]] = key, row
    random.shuffle(rows)
    got = {x.pk: x.payload for x in r.winners(spark.createDataFrame(rows, CHANGE), ["pk"]).collect()}
    assert got == {pk: row[6] for pk, (_, row) in expected.items() if row[4] != "D"}


def test_checksum_follows_changes(spark):
    a = spark.createDataFrame([(k, f"v{k}") for k in range(20)], "id int, v string")
    b = spark.createDataFrame([(k, f"v{k * 2}") for k in range(10, 30)], "id int, v string")
    old, new, d = hashing.table_checksum(a, "t").first(), hashing.table_checksum(b, "t").first(), diff.checksum_delta(a, b, ["id"]).first()
    assert (int(old.content_checksum) + int(d.delta)) % hashing.MODULUS == int(new.content_checksum) and old.row_count + d.row_delta == new.row_count


def test_pages_never_invent_changes(spark):
    a, b = spark.range(100).selectExpr("id", "id % 3 as v"), spark.range(1, 101).selectExpr("id", "id % 3 as v")
    assert [(x.id, x.kind) for x in diff.diff_page(a, b, ["id"], 0, 10).collect()] == [(0, "Deleted"), (100, "Added")]
    assert diff.stale(1, 2) == "E_SYNC_STAGE_STALE" and diff.stale(2, 2) is None


def test_chunks(spark):
    rows = spark.createDataFrame([("p", k, b) for k, b in enumerate([40, 30, 50, 90, 10, 60, 500])], "push_id string, topo_index long, bytes long")
    got = closure.chunk(rows, 100).orderBy("topo_index").collect()
    assert [x.chunk_seq for x in got] == [0, 0, 1, 2, 2, 3, 4] and [x.too_large for x in got] == [False] * 6 + [True]


def test_chunk_gate(spark):
    rows = spark.createDataFrame([("p", 0), ("p", 1), ("p", 1), ("p", 3)], "push_id string, chunk_seq long")
    assert sorted((x.chunk_seq, x.ready) for x in r.chunk_gate(rows).collect()) == [(0, True), (1, True), (3, False)]


def test_table_gate_ranges_and_caps(spark):
    p = spark.createDataFrame([(["a", "b"],), (["c"],)], "tables array<string>")
    assert r.ungated(p, ["b"]).count() == 1 and r.ungated(p, []).count() == 2
    log = spark.createDataFrame([("x", 1, 10, "t", 5), ("y", 1, 11, "__sync_a", 5), ("x", 2, 12, "t", 5)], "origin string, seq long, local_seq long, table_name string, byte_size long")
    assert [x.seq for x in r.read_range(log, "x", 1).collect()] == [2] and [x.local_seq for x in r.read_range(log, not_origin="x", after=-1).collect()] == [11]
    assert r.head(log).first().head == 12 and r.head(log.limit(0)).first().head == -1
    assert r.sync_tables(log, ["t", "__sync_a"]).count() == 2
    assert r.capped(log.withColumn("peer", F.lit("p")), 10).count() == 2
    assert r.min_acked(spark.createDataFrame([("o", 1, 5, False), ("o", 1, 3, True)], "origin string, epoch long, acked_seq long, pending_baseline boolean")).first().acked_seq == 5


def test_missing_parent_is_reported(spark):
    from sheetflow.sources.registry import Catalogue, ColumnDef, ForeignKey, TableDef

    a = TableDef("a", (ColumnDef("id", "INTEGER"),), ("id",))
    b = TableDef("b", (ColumnDef("id", "INTEGER"), ColumnDef("a_id", "INTEGER")), ("id",), (), (ForeignKey(("a_id",), "a", ("id",)),))
    cat = Catalogue({"a": a, "b": b}, {"a": spark.createDataFrame([(1,)], "id int"), "b": spark.createDataFrame([(1, 1), (2, 9), (3, None)], "id int, a_id int")})
    rows = closure.closure(cat, "b", cat.frame("b"))
    assert [(x.ref_table, x.key, x.code) for x in closure.missing_parents(cat, rows).collect()] == [("a", "9", "E_SYNC_FK_CLOSURE_MISSING")]


def test_snapshots_swap_all_tables_at_once(spark, tmp_path):
    store = SnapshotStore(spark, f"file://{tmp_path}/s")
    assert store.version() == 0 and store.tables() == []
    assert store.commit({"a": spark.range(3), "b": spark.range(2)}) == 1
    assert store.commit({"a": spark.range(5)}) == 2
    assert store.tables() == ["a", "b"] and store.read("a").count() == 5 and store.read("b").count() == 2


def test_changelog_store(spark, tmp_path):
    store = ChangelogStore(spark, f"file://{tmp_path}/log")
    store.append(spark.createDataFrame([("a", 1, "xyz")], "origin string, seq long, payload string"))
    store.append(spark.createDataFrame([("b", 1, "é")], "origin string, seq long, payload string"))
    assert sorted((x.origin, x.byte_size) for x in store.read().collect()) == [("a", 3), ("b", 2)] and store.corrupt().count() == 0


def test_workbook_round_trip(spark, tmp_path):
    path = str(tmp_path / "w.xlsx")
    assert write_xlsx([("1", None, 2.0), (None, None, None), ("<&>", "é", 1.5)], ["A", "B", "C"], path, "S") == 3
    assert [tuple(x) for x in read_xlsx(spark, path, "S").orderBy("excel_row").collect()] == [(2, "1", None, "2"), (3, None, None, None), (4, "<&>", "é", "1.5")]


def test_header_rules(spark, tmp_path):
    path = str(tmp_path / "h.xlsx")
    write_xlsx([("x", "y", "z", "lost")], ["A", "B", "A", None, "D"], path)
    assert [tuple(x) for x in read_xlsx(spark, path).collect()] == [(2, "z", "y")]  # of two equal headers the last column counts
    write_xlsx([("a", "b")], ["B", "C"], str(tmp_path / "i.xlsx"))
    assert sorted(tuple(map(str, x)) for x in read_xlsx(spark, f"file://{tmp_path}/*.xlsx").collect()) == [("2", "None", "a"), ("2", "z", "y")]
    for where, name, code in ((path, "Nowhere", "E_OPEN_XLSX"), (str(tmp_path / "none.xlsx"), None, "E_OPEN_XLSX"), (path, None, "E_HEADER_NOT_FOUND")):
        with pytest.raises(SheetError, match=code):
            read_xlsx(spark, where, name, 1 if code == "E_OPEN_XLSX" else 9)
    with pytest.raises(SheetError, match="E_OPEN_XLSX"):
        read_rows(open(path, "rb").read(), "Nowhere")
    with pytest.raises(SheetError, match="E_OPEN_XLSX"):
        read_rows(b"no workbook")


def test_date_cells(tmp_path):
    path = str(tmp_path / "d.xlsx")
    write_xlsx([(46163.0,)], ["Day"], path)
    with zipfile.ZipFile(path) as z:
        parts = {n: z.read(n).decode() for n in z.namelist()}
    parts["xl/styles.xml"] = '<styleSheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>'
    parts["xl/worksheets/sheet1.xml"] = parts["xl/worksheets/sheet1.xml"].replace('<c r="A2">', '<c r="A2" s="1">')
    with zipfile.ZipFile(path, "w") as z:
        for n, text in parts.items():
            z.writestr(n, text)
    rows, _ = read_rows(open(path, "rb").read())
    assert rows[2][1] == "2026-05-21"


def test_stream_is_exactly_once(spark, tmp_path):
    base = f"file://{tmp_path}"
    rows = lambda *seqs: spark.createDataFrame([("o", 1, s, 0, "t", "U", str(s), "p", 1, "f") for s in seqs], inbox.CHANGE).coalesce(1)
    rows(1, 4).write.mode("append").parquet(f"{base}/in")
    run = lambda: inbox.run_available(inbox.read_inbox(spark, f"{base}/in"), f"{base}/check", inbox.parquet_sink(f"{base}/out"))
    run()
    rows(2, 1, 2).write.mode("append").parquet(f"{base}/in")
    run()
    rows(3, 6).write.mode("append").parquet(f"{base}/in")
    run()
    out = spark.read.schema(inbox.RELEASED).parquet(f"{base}/out/batch=*")
    assert sorted(x.seq for x in out.collect()) == [1, 2, 3, 4] and os.path.exists(tmp_path / "check")
    assert inbox.applied_vector(out).first().applied_seq == 4


LOG = [("a", 1, 1, 10, 5), ("a", 1, 2, 11, None), ("a", 2, 1, 12, 7), ("b", 1, 1, 13, 1), ("b", None, 4, 14, 2), (None, 1, 1, 15, 3), ("c", 1, None, 16, 4), ("c", 1, -1, 17, 6), ("c", 1, 3, 18, 8)]
ACKS = [("a", "a", 1, 0), ("b", "a", 1, 1), ("b", "a", 1, 0), ("b", "c", 1, None), ("d", "a", 1, 9), ("d", "b", 1, 9), ("d", "b", None, 9), ("d", "c", 1, 3), ("d", "e", 1, 2), ("e", "c", 1, -5), (None, "a", 1, 0)]


def _sent(peers):
    """(peer, local_seq, bytes) of LOG and ACKS as the definition has them: one row for each acknowledgement met, -1 without any."""
    for origin, epoch, seq, at, size in LOG:
        for p in peers:
            if None not in (origin, seq) and p != origin:
                met = [-1 if n is None else n for q, o, e, n in ACKS if q == p and o == origin and e is not None and e == epoch] or [-1]
                yield from ((p, at, size) for n in met if seq > n)


def _log_and_acks(spark):
    return spark.createDataFrame(LOG, "origin string, epoch long, seq long, local_seq long, byte_size long"), spark.createDataFrame(ACKS, "peer string, origin string, epoch long, acked_seq long")


def _pairs_move(df):
    """Whether the plan shuffles rows that have a peer and an origin."""
    return any("peer#" in keys and "origin#" in keys for keys in re.findall(r"hashpartitioning\(([^)]*)\)", df._jdf.queryExecution().executedPlan().toString()))


def test_pairs_are_made_where_the_changes_lie(spark):
    log, acks = _log_and_acks(spark)
    peers = spark.createDataFrame([("a", 1), ("b", 2), ("d", 3), ("f", 4)], "peer string, port int")
    got = r.outgoing(log, peers, acks)
    assert got.columns == [*log.columns, "peer", "port"]
    assert sorted((x.peer, x.local_seq) for x in got.collect()) == sorted((p, at) for p, at, _ in _sent("abdf"))
    bare = r.outgoing(log, peers.select("peer"), acks)
    assert sorted((x.peer, x.local_seq) for x in bare.collect()) == sorted((p, at) for p, at, _ in _sent("abdf"))
    assert not _pairs_move(bare)


def test_lag_counts_each_origin_once(spark):
    log, acks = _log_and_acks(spark)
    expected = {}
    for p, _, size in _sent("abde"):
        n, total = expected.get(p, (0, 0))
        expected[p] = n + 1, total + (size or 0)
    got = r.lag(log, acks)
    assert {x.peer: (x.lag_seq, x.lag_bytes) for x in got.collect()} == expected
    done = spark.createDataFrame([(p, o, e, 9) for p in "ab" for o, e in (("a", 1), ("a", 2), ("b", 1), ("c", 1))], acks.schema)
    assert [(x.peer, x.lag_seq) for x in r.lag(log.filter("epoch is not null"), done).collect()] == []
    assert not _pairs_move(got)
