import pytest
from pyspark.sql import functions as F

from sheetflow.api import BatchTransfer, Bridge, Replica
from sheetflow.sources.snapshots import ChangelogStore, SnapshotStore, StaleVersion
from sheetflow.sources.xlsx import write_xlsx
from sheetflow.streaming import inbox

from .test_import_export import DEPOTS, HEAD, ROWS, TABLES


@pytest.fixture
def bridge(spark, tmp_path):
    b = Bridge(spark, SnapshotStore(spark, f"file://{tmp_path}/store"), TABLES)
    b.profiles["o"] = DEPOTS
    return b


def book(tmp_path, rows):
    path = str(tmp_path / "book.xlsx")
    write_xlsx(rows, HEAD, path, "Depots")
    return path


def test_import_is_all_or_nothing(bridge, tmp_path):
    bad = bridge.import_xlsx(book(tmp_path, [*ROWS, ("", "X", "1", "1", "S", "1")]), "o")
    assert not bad.ok and bridge.store.version() == 0
    part = bridge.import_xlsx(book(tmp_path, [*ROWS, ("", "X", "1", "1", "S", "1")]), "o", abort_on_error=False)
    assert part.ok and (part.read_rows, part.written_rows, part.version) == (5, 4, 1)
    again = bridge.import_xlsx(book(tmp_path, [("K7", None, "9", "4", "pitch", "7")]), "o")
    assert again.version == 2 and bridge.store.read("depot").count() == 3 and bridge.store.read("crate").count() == 4
    row = bridge.store.read("depot").filter("site = 'K7'").first()
    assert row.keeper is None and row.rent == 9.0
    out = bridge.export_xlsx(str(tmp_path / "out.xlsx"), "o")
    assert out.ok and out.rows == 4


def test_dry_run_and_bad_workbooks(bridge, tmp_path):
    assert bridge.import_xlsx(book(tmp_path, ROWS), "o", dry_run=True).payloads["depot"].count() == 4 and bridge.store.version() == 0
    assert bridge.import_xlsx(book(tmp_path, ROWS), "o", sheet="None").issues[0][0] == "E_OPEN_XLSX"
    assert bridge.user_tables() == sorted(TABLES) and bridge.describe().count() > 10


def test_transfer_states(spark):
    t = BatchTransfer(spark)
    assert t.start(lambda: spark.range(5).count()).result() == 5 and t.state == "Completed"
    t.start(lambda: 1 / 0).result()
    assert t.state == "Failed"


def test_replica(spark, tmp_path):
    node = Replica(spark, SnapshotStore(spark, f"file://{tmp_path}/n"), 2, "fp")
    rows = lambda *r: spark.createDataFrame([(o, 1, s, k, "t", op, pk, f"{o}{s}", v, "fp") for o, s, k, op, pk, v in r], inbox.CHANGE)
    node.receive(rows(("a", 1, 1, "U", "x", 2), ("b", 1, 2, "U", "x", 2), ("a", 3, 1, "U", "y", 2), ("c", 1, 0, "U", "z", 3)))
    assert {r.pk: r.payload for r in node.live().collect()} == {"x": "b1"} and node.quarantined().count() == 1
    node.receive(rows(("a", 2, 1, "U", "y", 2), ("a", 3, 1, "D", "y", 2), ("b", 1, 2, "U", "x", 2)))
    assert {r.pk: r.payload for r in node.live().collect()} == {"x": "b1"}
    assert {r.origin: r.applied_seq for r in node.applied().collect()} == {"a": 3, "b": 1}
    later = Replica(spark, node.store, 3, "fp")
    later.receive(rows())
    assert {r.pk for r in later.live().collect()} == {"x", "z"}
    later.baseline(later.rows().filter(F.col("pk") == "z"), later.applied())
    assert later.live().count() == 1


def changes(spark, *rows):
    """(origin, seq, fingerprint) as changes of one key each."""
    return spark.createDataFrame([(o, 1, s, 1, "t", "U", f"{o}-k{s}", f"{o}{s}", 2, fp) for o, s, fp in rows], inbox.CHANGE)


@pytest.mark.parametrize("order", [(1, 3, 2), (3, 2, 1), (2, 3, 1), (3, 1, 2)])
def test_replica_fills_gaps_in_any_order(spark, tmp_path, order):
    node = Replica(spark, SnapshotStore(spark, f"file://{tmp_path}/n"), 2, "fp")
    for s in order:
        node.receive(changes(spark, ("a", s, "fp")))
    assert {r.pk for r in node.live().collect()} == {"a-k1", "a-k2", "a-k3"} and node.waiting().count() == 0
    assert [(r.origin, r.applied_seq) for r in node.applied().collect()] == [("a", 3)]


def test_replica_refuses_another_fingerprint_again_and_again(spark, tmp_path):
    node = Replica(spark, SnapshotStore(spark, f"file://{tmp_path}/n"), 2, "fp")
    node.receive(changes(spark, ("a", 1, "other"), ("a", 2, "fp")))
    for _ in range(2):
        node.receive(changes(spark))
        assert node.live().count() == 0 and node.quarantined().count() == 1 and node.waiting().count() == 1
    node.receive(changes(spark, ("a", 1, "fp")))
    assert {r.pk for r in node.live().collect()} == {"a-k1", "a-k2"}


def test_store_keeps_untouched_tables_in_place(spark, tmp_path):
    store = SnapshotStore(spark, f"file://{tmp_path}/s")
    one = spark.range(3)
    assert store.version() == 0 and store.tables() == [] and store.commit({"a": one, "b": one}) == 1
    assert store.commit({"b": spark.range(5)}) == 2
    assert store.manifest(1)["a"] == store.manifest(2)["a"] and store.manifest(1)["b"] != store.manifest(2)["b"]
    assert (store.read("a").count(), store.read("b").count(), store.read("b", 1).count()) == (3, 5, 3)


def test_store_survives_a_crash_and_refuses_a_second_writer(spark, tmp_path, monkeypatch):
    store = SnapshotStore(spark, f"file://{tmp_path}/s")
    store.commit({"a": spark.range(3)})
    with monkeypatch.context() as m:  # the writer dies after the tables, before the manifest
        m.setattr(store, "_publish", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            store.commit({"a": spark.range(9)})
    (tmp_path / "s" / "versions" / ".half").write_text("{")  # and another in the midst of its manifest
    assert store.version() == 1 and store.read("a").count() == 3
    assert store.commit({"a": spark.range(4)}, expected=1) == 2
    with pytest.raises(StaleVersion, match="E_SYNC_STAGE_STALE"):
        store.commit({"a": spark.range(5)}, expected=1)
    assert store.read("a").count() == 4


def test_changelog_truncates_what_is_acknowledged(spark, tmp_path):
    log = ChangelogStore(spark, f"file://{tmp_path}/log")
    log.append(spark.createDataFrame([(o, 1, s, f"{o}{s}") for o in "ab" for s in range(1, 6)], "origin string, epoch long, seq long, payload string"))
    assert log.truncate({"a": 3}) == 3
    assert sorted((r.origin, r.seq) for r in log.read().collect()) == [("a", 4), ("a", 5), *[("b", s) for s in range(1, 6)]] and log.corrupt().count() == 0


def test_stop_is_not_lost(spark):
    t = BatchTransfer(spark)
    t.stop()
    assert t.state == "Idle"
