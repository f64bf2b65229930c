import copy

import pytest

from sheetflow.plans.checks import auto_profile, check_column_order, check_profile, order_warnings
from sheetflow.plans.profile import ProfileError, effective_slot, load_profile, topological
from sheetflow.sources.registry import Catalogue, ColumnDef, ForeignKey, TableDef, affinity


def table(name, columns, pk=(), unique=()):
    return TableDef(name, tuple(ColumnDef(c, t) for c, t in columns.items()), tuple(pk), tuple(unique))


CAT = Catalogue({
    "harbour": table("harbour", {"port": "TEXT", "pilot": "TEXT", "depth": "REAL"}, ["port"]),
    "berth": table("berth", {"port": "TEXT", "slip": "INTEGER", "moored": "TEXT", "cleats": "INTEGER"}, ["port", "slip"]),
    "ref": table("ref", {"code": "TEXT", "name": "TEXT"}, ["code"]),
})
GOOD = {
    "profileName": "p", "sheet": "S", "mode": "multiTable",
    "routes": [
        {"table": "harbour", "conflict": {"columns": ["port"]}, "columns": {"port": {"source": "Port"}, "pilot": {"source": "Pilot", "validators": ["notNull"]}}},
        {"table": "berth", "parent": "harbour", "conflict": {"columns": ["port", "slip"]}, "fkInject": [{"from": "harbour", "pairs": [["port", "port"]]}], "columns": {"slip": {"source": "Slip"}}},
    ],
}


def changed(path, value):
    doc = copy.deepcopy(GOOD)
    at = doc
    for p in path[:-1]:
        at = at[p]
    if value is None:
        del at[path[-1]]
    else:
        at[path[-1]] = value
    return doc


def test_good_profile():
    p = load_profile(GOOD)
    assert check_profile(p, CAT, {"Port", "Pilot", "Slip"}) == []
    assert [r.table for r in topological(p.routes)] == ["harbour", "berth"]


@pytest.mark.parametrize("doc", [
    changed(["profileName"], None), changed(["sheet"], None), changed(["mode"], "other"), changed(["headerRow"], 0), changed(["routes"], []),
    changed(["routes", 0, "table"], "1x"), changed(["routes", 1, "fkInject"], {"from": "harbour"}), changed(["export"], {"orderBy": ["a;b"]}), changed(["export"], {"reverseLookups": []}),
    changed(["dateFormat"], {"excel": {"format": "HH:mm"}}), changed(["timeFormat"], {"excel": {"format": "yyyy"}}), changed(["dateFormat"], {"excelFormat": "yyyy", "excel": {"format": "yyyy"}}),
    changed(["dateFormat"], {"db": {"type": "epochSec"}}), changed(["datetimeFormat"], {"db": {"format": "yyyy", "fallback": ["MM"]}}), "{", "[]",
])
def test_rejected(doc):
    with pytest.raises(ProfileError):
        load_profile(doc)


def test_mixed_rules():
    one = {"table": "harbour", "conflict": {"columns": ["port"]}, "columns": {}}
    doc = {"profileName": "m", "sheet": "S", "mode": "mixed", "discriminator": {"source": "T"}, "classes": [{"match": {"equals": "A"}, "routes": [one]}, {"match": {"equals": "A"}, "routes": [one]}]}
    with pytest.raises(ProfileError):
        load_profile(doc)
    doc["classes"].pop()
    with pytest.raises(ProfileError):
        load_profile(doc | {"export": {"sql": "SELECT 1"}})
    assert check_profile(load_profile(doc), CAT, {"X"}) == [("E_HEADER_NOT_FOUND", "T")]


@pytest.mark.parametrize(("path", "value", "code"), [
    (["routes", 0, "table"], "nothing", "E_PROFILE_TABLE_NOT_FOUND"), (["routes", 0, "conflict", "columns"], ["pilot"], "E_PROFILE_NO_CONFLICT_KEY"),
    (["routes", 0, "columns", "none"], {"source": "Port"}, "E_PROFILE_COLUMN_NOT_FOUND"), (["routes", 0, "columns", "pilot", "source"], "Who", "E_HEADER_NOT_FOUND"),
    (["routes", 0, "columns", "pilot", "validators"], ["odd"], "E_PROFILE_PARSE"), (["routes", 0, "lookups"], [{"name": "l", "from": "ref", "match": [["code", "Port"]], "select": [["name", "pilot"]]}], "E_PROFILE_PARSE"),
    (["routes", 1, "fkInject"], [{"from": "harbour", "pairs": [["depth", "port"]]}], "E_PROFILE_COLUMN_NOT_FOUND"),
])
def test_checks(path, value, code):
    issues = check_profile(load_profile(changed(path, value)), CAT, {"Port", "Pilot", "Slip"})
    assert code in [c for c, _ in issues]


def test_cycle_and_unknown_parent():
    doc = changed(["routes", 0, "parent"], "berth")
    with pytest.raises(ProfileError, match="E_PROFILE_TOPOLOGY_CYCLE"):
        topological(load_profile(doc).routes)
    with pytest.raises(ProfileError):
        topological(load_profile(changed(["routes", 0, "parent"], "nobody")).routes)


def test_slots_are_inherited_side_by_side():
    doc = {
        "profileName": "t", "sheet": "S", "mode": "singleTable", "table": "x", "dateFormat": {"excelFormat": "yyyy/M/d", "dbFormat": "yyyy-MM-dd"},
        "columns": {"a": {}, "b": {"validators": ["notNull"]}, "c": {"dateFormat": {"excel": {"format": "d/M/yyyy"}}}, "d": {"validators": ["date:yyyy"], "dateFormat": {"excelFormat": "d", "dbFormat": "d"}}},
    }
    p = load_profile(doc)
    slots = {c.db: effective_slot(c, p) for c in p.routes[0].columns}
    assert slots["a"].excel.format == "yyyy/M/d" and slots["b"] is None
    assert (slots["c"].excel.format, slots["c"].db.format) == ("d/M/yyyy", "yyyy-MM-dd")
    assert slots["d"].db.format == "d"


def test_order_checks():
    p = load_profile(GOOD | {"export": {"columnOrder": ["Port", "Port", "Else"]}})
    assert check_column_order(p, ["Port", "Slip"]) == [("E_EXPORT_DUPLICATE_ORDER", "Port"), ("E_EXPORT_UNKNOWN_HEADER", "Else")]
    doc = {"profileName": "t", "sheet": "S", "mode": "singleTable", "table": "x", "dateFormat": {"excelFormat": "d/M/yyyy", "dbFormat": "d.M.yyyy"}, "columns": {"day": {}}, "export": {"orderBy": ["day"]}}
    assert order_warnings(load_profile(doc)) == [("W_TIME_ORDERBY_NONSORTABLE", "day")]


def test_auto_profile():
    t = TableDef("t", (ColumnDef("id", "INTEGER", True, auto_increment=True), ColumnDef("code", "TEXT", True), ColumnDef("n", "POINT"), ColumnDef("made", "DATE", True)), ("id",), (("code", "n"), ("code",)))
    doc, executable, _ = auto_profile(t)
    assert executable and doc["conflict"]["columns"] == ["code"]
    assert doc["columns"] == {"code": {"source": "code", "validators": []}, "n": {"source": "n", "validators": ["int"]}, "made": {"source": "made", "validators": ["notNull", "date:yyyy-MM-dd"]}}
    assert not auto_profile(TableDef("u", (ColumnDef("a", "TEXT"),)))[1]


@pytest.mark.parametrize(("declared", "kind"), [("INTEGER", "bigint"), ("POINT", "bigint"), ("double", "double"), ("BLOB", "binary"), ("VARCHAR(3)", "string"), ("", "string")])
def test_affinity(declared, kind):
    assert affinity(declared) == kind


def test_foreign_key_cycles_are_refused():
    from sheetflow.operators.closure import ClosureError, table_depths

    a = TableDef("a", (ColumnDef("id", "INTEGER"),), ("id",), (), (ForeignKey(("id",), "b", ("id",)),))
    b = TableDef("b", (ColumnDef("id", "INTEGER"),), ("id",), (), (ForeignKey(("id",), "a", ("id",)),))
    with pytest.raises(ClosureError, match="E_SYNC_FK_CYCLE_UNSUPPORTED"):
        table_depths(Catalogue({"a": a, "b": b}), ["a"])
