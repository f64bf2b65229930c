"""Sheets to tables and back on small scenarios."""

import pytest
from pyspark.sql import functions as F

from sheetflow.operators.exporter import plan_export
from sheetflow.operators.importer import plan_import
from sheetflow.operators.merge import last_by_key, upsert
from sheetflow.plans.profile import load_profile
from sheetflow.sources.registry import Catalogue, ColumnDef, TableDef


def define(name, columns, pk):
    kinds = {"t": "TEXT", "i": "INTEGER", "r": "REAL"}
    return TableDef(name, tuple(ColumnDef(c[:-2], kinds[c[-1]]) for c in columns.split()), tuple(pk.split()))


TABLES = {t.name: t for t in (
    define("depot", "site:t keeper:t rent:r", "site"), define("crate", "site:t shelf:i goods:t pieces:i", "site shelf"),
    define("gauge", "probe:i taken_on:t logged:t opens:t synced:i", "probe"), define("people", "id:i name:t", "id"), define("visits", "visit:t who:t person:i", "visit"),
    define("reed", "tag:t", "tag"), define("moss", "patch:t colour:t", "patch"),
)}
DEPOTS = load_profile({
    "profileName": "d", "sheet": "Depots", "mode": "multiTable",
    "routes": [
        {"table": "depot", "conflict": {"columns": ["site"]}, "columns": {"site": {"source": "Site", "validators": ["notNull"]}, "keeper": {"source": "Keeper"}, "rent": {"source": "Rent", "validators": ["decimal"]}}},
        {"table": "crate", "parent": "depot", "conflict": {"columns": ["site", "shelf"]}, "fkInject": [{"from": "depot", "pairs": [["site", "site"]]}],
         "columns": {"shelf": {"source": "Shelf", "validators": ["int>=1"]}, "goods": {"source": "Goods", "validators": ["notNull"]}, "pieces": {"source": "Pieces", "validators": ["int>=1"]}}},
    ],
    "export": {"orderBy": ["site", "shelf"]},
})
HEAD = ["Site", "Keeper", "Rent", "Shelf", "Goods", "Pieces"]
ROWS = [("K7", "Mirel", "310.25", "4", "tar", "12"), ("K7", "Mirel", "310.25", "6", "rope", "3"), ("L2", "Oduya", "97.10", "4", "tar", "40"), ("P9", "Tamsin", "8.00", "11", "glass", "7")]


def sheet(spark, head, rows):
    return spark.createDataFrame([(k, *r) for k, r in enumerate(rows, 2)], "excel_row int, " + ", ".join(f"`{h}` string" for h in head))


def codes(plan):
    return sorted((r.row, r.code) for r in plan.errors().collect())


def test_one_row_fills_two_tables(spark):
    plan = plan_import(sheet(spark, HEAD, ROWS), DEPOTS, Catalogue(TABLES))
    assert codes(plan) == []
    assert last_by_key(plan.payload("depot"), ["site"], "excel_row").count() == 3
    assert plan.payload("crate").count() == 4 and plan.written_rows().count() == 4


@pytest.mark.parametrize(("row", "code"), [
    (("", "X", "1", "1", "S", "1"), "E_VALIDATE_NULL"), (("K7", "Else", "310.25", "9", "S", "1"), "E_VALIDATE_DUPLICATE"), (("Q1", "X", "1", "0", "S", "1"), "E_VALIDATE_TYPE"),
    (("L2", "Oduya", "97.10", "4", "S", "1"), "E_VALIDATE_DUPLICATE"),
])
def test_rejections(spark, row, code):
    assert codes(plan_import(sheet(spark, HEAD, [*ROWS, row]), DEPOTS, Catalogue(TABLES))) == [(6, code)]


def test_failed_parent_takes_children_along(spark):
    plan = plan_import(sheet(spark, HEAD, [*ROWS, ("R4", "D", "no", "1", "S", "1"), ("R5", "E", "1", "1", "", "1")]), DEPOTS, Catalogue(TABLES))
    assert codes(plan) == [(6, "E_VALIDATE_TYPE"), (7, "E_VALIDATE_NULL")]
    assert {r.site for r in plan.payload("depot").collect()} == {"K7", "L2", "P9", "R5"}
    assert {r.site for r in plan.payload("crate").collect()} == {"K7", "L2", "P9"}


def test_empty_sheet(spark):
    plan = plan_import(sheet(spark, HEAD, ROWS).limit(0), DEPOTS, Catalogue(TABLES))
    assert codes(plan) == [] and plan.payload("depot").count() == 0


def test_export_undoes_import(spark):
    plan = plan_import(sheet(spark, HEAD, ROWS), DEPOTS, Catalogue(TABLES))
    tables = {t: last_by_key(plan.payload(t), list(TABLES[t].primary_key), "excel_row").drop("excel_row") for t in ("depot", "crate")}
    out = plan_export(DEPOTS, Catalogue(TABLES, tables))
    got = out.rows.withColumn("Rent", F.format_string("%.2f", "Rent")).select(*[F.col(h).cast("string") for h in HEAD]).collect()
    assert [tuple(r) for r in got] == ROWS and out.errors.count() == 0


TIMES = load_profile({
    "profileName": "t", "sheet": "Gauges", "mode": "singleTable", "table": "gauge", "conflict": {"columns": ["probe"]}, "dateFormat": {"excelFormat": "yyyy/M/d", "dbFormat": "yyyy-MM-dd"},
    "datetimeFormat": {"excelFormat": "yyyy-MM-dd HH:mm:ss", "dbFormat": "yyyy-MM-dd HH:mm:ss"}, "timeFormat": {"excelFormat": "HH:mm", "dbFormat": "HH:mm:ss"},
    "columns": {"probe": {"source": "Probe", "validators": ["int"]}, "taken_on": {"source": "Taken"}, "logged": {"source": "Logged", "datetimeFormat": {"excel": {"format": "d/M/yyyy H:mm"}}},
                "opens": {"source": "Opens", "timeFormat": {}}, "synced": {"source": "Synced", "datetimeFormat": {"db": {"type": "epochSec"}}}},
})


def test_temporal_slots(spark):
    head = ["Probe", "Taken", "Logged", "Opens", "Synced"]
    rows = [("31", "2019/11/3", "3/11/2019 7:05", "07:05", "2011-08-30 16:20:00"), ("32", " ", None, "", "1970-01-01 00:00:00"), ("33", "soon", "9/2/2020 18:45", "18:45", None)]
    plan = plan_import(sheet(spark, head, rows), TIMES, Catalogue(TABLES))
    assert codes(plan) == [(4, "E_TIME_PARSE")]  # later columns of a failed route are not converted
    got = {r.probe: r for r in plan.payload("gauge").collect()}
    assert (got[31].taken_on, got[31].logged, got[31].opens, got[31].synced) == ("2019-11-03", "2019-11-03 07:05:00", "07:05:00", 1314721200)
    assert (got[32].taken_on, got[32].opens, got[32].synced) == (None, None, 0)
    back = plan_export(TIMES, Catalogue(TABLES, {"gauge": plan.payload("gauge").drop("excel_row")})).rows.orderBy("Probe").collect()
    assert tuple(back[0])[1:] and back[0].Taken == "2019/11/3" and back[0].Logged == "3/11/2019 7:05" and back[1].Synced == "1970-01-01 00:00:00"


def visit_profile(on_missing="error"):
    return load_profile({
        "profileName": "v", "sheet": "V", "mode": "singleTable", "table": "visits", "conflict": {"columns": ["visit"]}, "columns": {"visit": {"source": "Visit"}},
        "lookups": [{"name": "p", "from": "people", "match": [["id", "PersonId"]], "select": [["name", "who"]], "exportOnMissing": on_missing}],
    })


PEOPLE = [(0, "Zero"), (1, "One"), (2, None), (7, "Twin"), (7, "Twin2"), (8, "Same"), (9, "Same")]


def test_lookup_semantics(spark):
    people = spark.createDataFrame(PEOPLE, "id int, name string")
    rows = [("a", "0"), ("b", "1"), ("c", "2"), ("d", "7"), ("e", "5"), ("f", " "), ("g", "x"), ("h", None)]
    plan = plan_import(sheet(spark, ["Visit", "PersonId"], rows), visit_profile(), Catalogue(TABLES, {"people": people}))
    assert {r.visit: r.who for r in plan.payload("visits").collect()} == {"a": "Zero", "b": "One", "c": None}
    assert [c for _, c in codes(plan)] == ["E_LOOKUP_AMBIGUOUS", "E_LOOKUP_NOT_FOUND", "E_LOOKUP_KEY_EMPTY", "E_LOOKUP_KEY_INVALID", "E_LOOKUP_KEY_EMPTY"]


@pytest.mark.parametrize(("policy", "kept", "found"), [("error", ["a"], ["E_REVERSE_LOOKUP_AMBIGUOUS", "E_REVERSE_LOOKUP_NOT_FOUND", "E_REVERSE_LOOKUP_NOT_FOUND"]), ("null", ["a", "c", "d"], ["E_REVERSE_LOOKUP_AMBIGUOUS"])])
def test_reverse_lookup(spark, policy, kept, found):
    people = spark.createDataFrame(PEOPLE, "id int, name string")
    visits = spark.createDataFrame([("a", "One"), ("b", "Same"), ("c", "Nobody"), ("d", None)], "visit string, who string")
    out = plan_export(visit_profile(policy), Catalogue(TABLES, {"people": people, "visits": visits}))
    assert out.headers == ["Visit", "PersonId"]
    assert sorted(r.Visit for r in out.rows.collect()) == kept and sorted(r.code for r in out.errors.collect()) == found


def test_mixed_classes(spark):
    profile = load_profile({
        "profileName": "m", "sheet": "M", "mode": "mixed", "discriminator": {"source": "Type"}, "classColumn": "Type",
        "classes": [{"match": {"equals": "A"}, "routes": [{"table": "reed", "conflict": {"columns": ["tag"]}, "columns": {"tag": {"source": "Mark"}}}]},
                    {"match": {"equals": "B"}, "routes": [{"table": "moss", "conflict": {"columns": ["patch"]}, "columns": {"patch": {"source": "Mark"}, "colour": {"source": "Hue"}}}]}],
    })
    plan = plan_import(sheet(spark, ["Type", "Mark", "Hue"], [("A", "1", None), ("B", "2", "x"), ("C", "3", None), (None, "4", None)]), profile, Catalogue(TABLES))
    assert codes(plan) == [(4, "E_ROUTE_UNMATCHED"), (5, "E_ROUTE_UNMATCHED")]
    out = plan_export(profile, Catalogue(TABLES, {t: plan.payload(t).drop("excel_row") for t in ("reed", "moss")}))
    assert out.headers == ["Type", "Mark", "Hue"]
    assert sorted(map(tuple, out.rows.collect())) == [("A", "1", None), ("B", "2", "x")]


def test_upsert_overwrites_with_null_and_keeps_the_rest(spark):
    target = spark.createDataFrame([(1, "a", "keep"), (2, "b", "keep")], "id int, name string, extra string")
    source = spark.createDataFrame([(1, None), (3, "c")], "id int, name string")
    assert sorted(map(tuple, upsert(target, source, ["id"]).collect())) == [(1, None, "keep"), (2, "b", "keep"), (3, "c", None)]
    assert sorted(map(tuple, upsert(target, source, ["id"], "nothing").collect())) == [(1, "a", "keep"), (2, "b", "keep"), (3, "c", None)]


@pytest.mark.parametrize("routes", [1, 2, 3, 4, 5, 6])
def test_the_sheet_is_read_a_constant_number_of_times(spark, tmp_path, routes):
    """However long the chain of routes, the plan scans the sheet three times at most."""
    names = [f"level{k}" for k in range(routes)]
    tables = {n: define(n, "key:t note:t", "key") for n in names}
    chain = [{"table": n, "conflict": {"columns": ["key"]}, "columns": {"key": {"source": "Key"}, "note": {"source": f"Note{k}"}} if not k else {"note": {"source": f"Note{k}"}}} for k, n in enumerate(names)]
    for k in range(1, routes):
        chain[k] |= {"parent": names[k - 1], "fkInject": [{"from": names[k - 1], "pairs": [["key", "key"]]}]}
    profile = load_profile({"profileName": "c", "sheet": "C", "mode": "multiTable", "routes": chain})
    sheet(spark, ["Key", *[f"Note{k}" for k in range(routes)]], [(f"k{i // 2}", *["x"] * routes) for i in range(6)]).write.parquet(str(tmp_path / "sheet"))
    plan = plan_import(spark.read.parquet(str(tmp_path / "sheet")), profile, Catalogue(tables))
    for df in (plan.payload(names[-1]), plan.errors()):
        assert df._jdf.queryExecution().optimizedPlan().toString().count("Relation [") <= 3
    assert {r.row for r in plan.errors().collect()} == {3, 5, 7}  # equal repeats are errors of the last route alone


def test_keys_with_commas_do_not_meet(spark):
    tables = {"pair": define("pair", "a:t b:t", "a b")}
    profile = load_profile({"profileName": "p", "sheet": "P", "mode": "singleTable", "table": "pair", "conflict": {"columns": ["a", "b"]}, "columns": {"a": {"source": "A"}, "b": {"source": "B"}}})
    rows = [("x,y", "z"), ("x", "y,z"), ("x", "y,z"), (None, "z"), (None, "z")]
    assert codes(plan_import(sheet(spark, ["A", "B"], rows), profile, Catalogue(tables))) == [(4, "E_VALIDATE_DUPLICATE")]
