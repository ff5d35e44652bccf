"""Spark-vs-DuckDB comparison used by the tests and by ``python -m tests.oracle``.

Mirrors the driver's check: same row count, same column names, compatible
types, and the same multiset of rows (columns sorted by name, doubles
rounded to 9 significant digits).
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()

SPARK_KIND = {
    "bigint": "int64", "int": "int32", "smallint": "int16", "tinyint": "int8",
    "double": "float", "float": "float", "string": "str", "boolean": "bool",
    "date": "date", "timestamp_ntz": "ts", "timestamp": "ts",
}
DUCK_KIND = {
    "BIGINT": "int64", "INTEGER": "int32", "SMALLINT": "int16", "TINYINT": "int8",
    "DOUBLE": "float", "FLOAT": "float", "VARCHAR": "str", "BOOLEAN": "bool",
    "DATE": "date", "TIMESTAMP": "ts",
}


def duck_connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return float(f"{v:.9g}")
    if isinstance(v, decimal.Decimal):
        return float(f"{float(v):.9g}")
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    return v


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda t: tuple((x is None, str(type(x)), str(x)) for x in t))


def compare(spark, con, name: str, query, sql: str, sf_dir: str) -> dict:
    df = query(spark, sf_dir)
    s_names = df.columns
    s_kinds = [SPARK_KIND.get(f.dataType.simpleString(), f.dataType.simpleString())
               for f in df.schema.fields]
    s_rows = [tuple(r) for r in df.collect()]
    rel = con.sql(sql)
    d_names = rel.columns
    d_kinds = [DUCK_KIND.get(str(t), str(t)) for t in rel.types]
    d_rows = rel.fetchall()
    problems = []
    if sorted(s_names) != sorted(d_names):
        problems.append(f"columns spark={s_names} duckdb={d_names}")
    else:
        sk = dict(zip(s_names, s_kinds))
        dk = dict(zip(d_names, d_kinds))
        bad = {c: (sk[c], dk[c]) for c in s_names if sk[c] != dk[c]}
        if bad:
            problems.append(f"types {bad}")
    if len(s_rows) != len(d_rows):
        problems.append(f"rows spark={len(s_rows)} duckdb={len(d_rows)}")
    elif not problems and _rows(s_names, s_rows) != _rows(d_names, d_rows):
        a, b = _rows(s_names, s_rows), _rows(d_names, d_rows)
        diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
        problems.append(f"values differ, e.g. {diff}")
    return {"name": name, "rows": len(s_rows), "ok": not problems, "problems": problems}


def main(argv: list[str]) -> int:
    sys.path.insert(0, ".")
    import __spark_entry__ as entry
    from loanlag.session import local_session

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    only = set(argv[1:])
    spark = local_session(8)
    con = duck_connection(sf_dir)
    sqls = entry.oracle_sql()
    failed = 0
    for name, q in entry.queries().items():
        if only and name not in only:
            continue
        t0 = time.time()
        if name not in sqls:
            print(f"{name:45s} no oracle")
            continue
        try:
            res = compare(spark, con, name, q, sqls[name], sf_dir)
        except Exception as exc:  # report and go on
            res = {"name": name, "rows": -1, "ok": False, "problems": [repr(exc)[:500]]}
        failed += not res["ok"]
        print(f"{name:45s} {'OK ' if res['ok'] else 'BAD'} rows={res['rows']:6d} "
              f"{time.time() - t0:5.1f}s {'; '.join(res['problems'])}", flush=True)
    print(f"{failed} failed")
    return 1 if failed else 0


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1:]))
