"""``python -m sheetflow STORE TABLES.json PROFILE.json BOOK.xlsx [import|export]``"""

import json
import sys

from pyspark.sql import SparkSession

from .api import Bridge
from .sources.registry import ColumnDef, TableDef
from .sources.snapshots import SnapshotStore


def main(args: list[str]) -> int:
    if len(args) not in (4, 5):
        print(__doc__, file=sys.stderr)
        return 2
    store, tables, profile, book = args[:4]
    spark = SparkSession.builder.appName("sheetflow").getOrCreate()
    with open(tables) as f:
        known = {n: TableDef(n, tuple(ColumnDef(c, k) for c, k in t["columns"].items()), tuple(t.get("primaryKey", ())), tuple(map(tuple, t.get("unique", ())))) for n, t in json.load(f).items()}
    bridge = Bridge(spark, SnapshotStore(spark, store), known)
    with open(profile) as f:
        name = bridge.load(f.read()).name
    if args[4:] == ["export"]:
        result = bridge.export_xlsx(book, name)
        print(f"{result.rows} rows written to {book}")
        return 0
    result = bridge.import_xlsx(book, name)
    for code, message in result.issues:
        print(f"{code}: {message}", file=sys.stderr)
    if result.errors is not None:
        result.errors.show(50, truncate=False)
    print(f"{result.read_rows} rows read, {result.written_rows} written")
    return 0 if result.ok else 1


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
