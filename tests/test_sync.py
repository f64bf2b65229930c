"""Settings, pushes, sessions and payloads on small scenarios."""

import pytest
from pyspark.sql import functions as F

from sheetflow.functions import payload
from sheetflow.operators import push
from sheetflow.operators.closure import ClosureError, chunk
from sheetflow.operators.session import ComparisonSession
from sheetflow.plans.sync import ConfigError, SyncConfig
from sheetflow.sources.registry import Catalogue, ColumnDef, ForeignKey, TableDef
from sheetflow.sources.snapshots import SnapshotStore, StaleVersion

GOOD = {"node": "n1", "tables": ("reed", "moss"), "center": "hub", "peers": ("hub", "n2"), "ranks": {"hub": 2, "n2": 1}}


@pytest.mark.parametrize("change", [
    {"node": ""}, {"tables": ()}, {"tables": ("reed", "reed")}, {"role": "leaf"}, {"center": ""}, {"peers": ("n1",)}, {"peers": ("n2", "n2")}, {"policy": "Newest"},
    {"ranks": {"a": 1, "b": 1}}, {"soft": {"seq": 9, "bytes": 9, "ms": 9}, "hard": {"seq": 9, "bytes": 8, "ms": 9}}, {"selection_cap": 0},
])
def test_settings_are_checked(change):
    assert SyncConfig(**GOOD).chunk_bytes == 2 << 20
    with pytest.raises(ConfigError, match="E_SYNC_INIT"):
        SyncConfig(**{**GOOD, **change})


def ponds(spark):
    col = lambda *names: tuple(ColumnDef(n, "INTEGER", True) for n in names)
    tables = {"pond": TableDef("pond", col("id"), ("id",)), "reed": TableDef("reed", col("id", "pond"), ("id",), (), (ForeignKey(("pond",), "pond", ("id",)),))}
    frames = {"pond": spark.createDataFrame([(k,) for k in range(4)], "id int"), "reed": spark.createDataFrame([(k, k % 4) for k in range(40)], "id int, pond int")}
    return Catalogue(tables, frames)


def test_selection_push(spark):
    cat = ponds(spark)
    some = cat.frame("reed").filter("id < 6")
    p = push.selection_push(cat, "reed", some, "p", "n1", cap=10, chunk_bytes=200)
    rows = sorted((r.topo_index, r.table_name, r.record_kind, r.chunk_seq) for r in p.rows.collect())
    assert [r[1] for r in rows] == ["pond"] * 4 + ["reed"] * 6 and [r[3] for r in rows] == sorted(r[3] for r in rows)
    m = p.manifest.collect()
    assert sum(r.rows for r in m) == 10 and {r.total_chunks for r in m} == {len(m)} and all(r.bytes <= 200 for r in m)
    assert sorted(map(tuple, push.manifest(p.rows.orderBy(F.rand(1)), "n1").collect())) == sorted(map(tuple, m))
    for selected, cap, code in ((some, 9, "TOO_LARGE"), (some.limit(0), 9, "EMPTY"), (some.withColumn("pond", F.lit(99)), 99, "CLOSURE_MISSING")):
        with pytest.raises(ClosureError, match=code):
            push.selection_push(cat, "reed", selected, "p", "n1", cap=cap)


def test_chunks_follow_the_budget(spark):
    rows = spark.createDataFrame([("p", k, b) for k, b in enumerate([5, 5, 11, 1, 9, 1, 10])] + [("q", 0, 3)], "push_id string, topo_index long, bytes long")
    got = sorted((r.push_id, r.topo_index, r.chunk_seq, r.too_large) for r in chunk(rows, 10).collect())
    assert [g[2] for g in got] == [0, 0, 1, 2, 2, 3, 4, 0] and [g[1] for g in got if g[3]] == [2]


def test_session_choices(spark, tmp_path):
    store = SnapshotStore(spark, f"file://{tmp_path}/s")
    store.commit({"t": spark.createDataFrame([(1, "a", 1), (2, "b", 2), (3, "c", 3)], "id int, name string, n int"), "u": spark.range(2)})
    remote = spark.createDataFrame([(1, "A", 10), (2, "B", 20), (9, "new", 9)], "id int, name string, n int")
    s = ComparisonSession(store, {"t": remote}, {"t": ["id"]})
    keys = lambda *k: spark.createDataFrame([(x,) for x in k], "id int")
    s.accept_rows("t", keys(1, 3, 9))
    assert [r.id for r in s.refused("t").collect()] == [3]
    s.accept_cells("t", spark.createDataFrame([(2, "n"), (3, "n")], "id int, column string"))
    s.unstage("t", keys(9))
    other = ComparisonSession(store, {"t": remote}, {"t": ["id"]})
    other.accept_table("t")
    assert s.save() == 2 and sorted(map(tuple, store.read("t").collect())) == [(1, "A", 10), (2, "b", 20), (3, "c", 3)]
    with pytest.raises(StaleVersion, match="E_SYNC_STAGE_STALE"):
        other.save()
    other.discard()
    assert other._rows == {} and store.manifest(1)["u"] == store.manifest(2)["u"]


def test_payloads_that_are_not_whole(spark):
    good = spark.range(1).select(payload.encode("push", F.lit('{"a":"|"}'), F.lit("body | with\nbars")).alias("p"))
    p = good.first().p
    rows = [p, p[:-1], p.replace("body", "bodY"), "x" + p, "", None, "SFPL|2|push|", p.replace("SFPL|2", "SFPL|7")]
    got = payload.decode(spark.createDataFrame([(r,) for r in rows], "p string"), "p").collect()
    assert (got[0].version, got[0].kind, got[0].header, got[0].body, got[0].code) == (2, "push", '{"a":"|"}', "body | with\nbars", None)
    assert all(r.code == "E_SYNC_PAYLOAD_CORRUPT" and r.body is None for r in got[1:])


def test_a_validator_of_ones_own(spark):
    from sheetflow.functions import validators as v

    v.register("even", v.Check(lambda c: F.coalesce(c.try_cast("int") % 2 != 0, F.lit(False)), "E_VALIDATE_TYPE", lambda c: F.lit("an even number is needed")))
    got = v.chain(F.col("x"), ["notNull", "even"])
    df = spark.createDataFrame([("2",), ("3",), (None,)], "x string").select(got.code.alias("code"))
    assert [r.code for r in df.collect()] == [None, "E_VALIDATE_TYPE", "E_VALIDATE_NULL"]
    with pytest.raises(v.BadToken):
        v.register("int", v.compile_token("int"))


def test_a_baseline_with_missing_rows_is_refused(spark, tmp_path):
    from sheetflow.api import Replica

    node = Replica(spark, SnapshotStore(spark, f"file://{tmp_path}/n"), 1, "fp")
    rows = spark.createDataFrame([("t", "k", "a", 1, 0, "U", "p"), ("t", "gone", "a", 2, 0, "D", "p")], "table_name string, pk string, origin string, seq long, rank int, op string, payload string")
    vector = spark.createDataFrame([("a", 1, 2)], "origin string, epoch long, applied_seq long")
    with pytest.raises(ValueError, match="E_SYNC_BASELINE_FAILED"):
        node.baseline(rows, vector, {"t": 2})
    node.baseline(rows, vector, {"t": 1})
    assert [r.pk for r in node.live().collect()] == ["k"]


def test_the_stream_gate_and_its_timeout():
    import pandas as pd

    from sheetflow.streaming import inbox

    class State:
        exists, hasTimedOut, value, wait = False, False, None, None
        get = property(lambda self: self.value)

        def update(self, v):
            self.value, self.exists, self.wait = v, True, None

        def setTimeoutDuration(self, ms):  # noqa: N802
            self.wait = ms

    state = State()
    frame = lambda *seqs: pd.DataFrame([(k, f"p{k}", "U", "x") for k in seqs], columns=inbox.FIELDS)
    step = lambda *frames: [tuple(r) for f in inbox.release(("a", 1), iter(frames), state, 500) for r in f[["origin", "seq", "op"]].itertuples(index=False)]
    assert step(frame(1, 4), frame(2, 1)) == [("a", 1, "U"), ("a", 2, "U")] and state.wait == 500
    state.hasTimedOut = True
    assert step() == [("a", 3, inbox.GAP)] and state.value[0] == 2
    state.hasTimedOut = False
    assert step(frame(3, 2)) == [("a", 3, "U"), ("a", 4, "U")] and state.value == (4, []) and state.wait is None
    assert step(frame(4)) == []
