"""Run registered queries beside their SQL: python tests/check_oracle.py [name-prefix ...]."""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import duckdb  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from tickerloom.schemas import INPUT_SCHEMAS  # noqa: E402
from tickerloom.session import local_session  # noqa: E402


def connect(folder):
    db = duckdb.connect()
    for name in INPUT_SCHEMAS:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return db


def normal(rows):
    def cell(x):
        return repr(x)

    return sorted(tuple(cell(x) for x in r) for r in rows)


KINDS = {
    "bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN",
    "date": "DATE", "timestamp_ntz": "TIMESTAMP", "float": "FLOAT", "timestamp": "TIMESTAMP",
}


def compare(spark, db, folder, name, fn, sql):
    """Empty string when Spark and SQL agree, else what differs."""
    started = time.time()
    df = fn(spark, folder)
    columns = sorted(df.columns)
    rows = [tuple(r) for r in df.select(*[f"`{c}`" for c in columns]).collect()]
    spent = time.time() - started
    if sql is None:
        return "", len(rows), spent
    shape = db.execute(f"DESCRIBE {sql}").fetchall()
    expected_kinds = {r[0]: str(r[1]) for r in shape}
    if sorted(expected_kinds) != columns:
        return f"columns {columns} vs {sorted(expected_kinds)}", len(rows), spent
    kinds = {c: KINDS.get(t, t) for c, t in df.dtypes}
    if kinds != expected_kinds:
        return f"types {[(c, kinds[c], expected_kinds[c]) for c in columns if kinds[c] != expected_kinds[c]]}", len(rows), spent
    picked = ", ".join(f'"{c}"' for c in columns)
    expected = db.execute(f"SELECT {picked} FROM ({sql}) q").fetchall()
    a, b = normal(rows), normal(expected)
    if a != b:
        extra = [x for x in a if x not in set(b)][:2]
        missing = [x for x in b if x not in set(a)][:2]
        return f"rows {len(a)} vs {len(b)}: only spark {extra} only sql {missing}", len(rows), spent
    return "", len(rows), spent


if __name__ == "__main__":
    folder = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark, db = local_session(), connect(folder)
    queries, checks = entry.queries(), entry.oracle_sql()
    wanted = sys.argv[1:]
    bad = 0
    for name, fn in queries.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        try:
            error, n, spent = compare(spark, db, folder, name, fn, checks.get(name))
        except Exception as e:  # noqa: BLE001
            error, n, spent = f"{type(e).__name__}: {str(e)[:600]}", -1, 0
        bad += bool(error)
        mark = "FAIL" if error else ("ok  " if name in checks else "rows")
        print(f"{mark} {name} rows={n} {spent:.1f}s {error}", flush=True)
    print("failures:", bad)
