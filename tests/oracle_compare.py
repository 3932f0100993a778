"""Compare a registered Spark query with its DuckDB oracle (names, row count, values).

Values: doubles rounded to 6 places, dates/timestamps as ISO text, rows compared
as an order-insensitive multiset.  Usable from pytest and as a script:

    python tests/oracle_compare.py [sf_dir] [query ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def duckdb_conn(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        r = round(v, 6)
        return 0.0 if r == 0 else r
    if isinstance(v, decimal.Decimal):
        return _norm(float(v))
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return _norm(v.asDict())
    return v


SPARK_TO_DUCKDB = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE",
                   "float": "FLOAT", "date": "DATE", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP"}


def _types(sdf, con, sql):
    sp = {f.name: SPARK_TO_DUCKDB.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in sdf.schema.fields}
    dd = {r[0]: r[1] for r in con.execute(f"DESCRIBE {sql}").fetchall()}
    return {k: (sp.get(k), dd.get(k)) for k in set(sp) | set(dd) if sp.get(k) != dd.get(k)}


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=repr)


def compare(spark, sf_dir: str, name: str, query, sql: str, con=None) -> dict:
    con = con or duckdb_conn(sf_dir)
    t0 = time.time()
    sdf = query(spark, sf_dir)
    s_names = sdf.columns
    s_rows = [tuple(r) for r in sdf.collect()]
    t1 = time.time()
    res = con.execute(sql)
    d_names = [d[0] for d in res.description]
    d_rows = res.fetchall()
    t2 = time.time()
    out = {"query": name, "spark_rows": len(s_rows), "oracle_rows": len(d_rows),
           "spark_sec": round(t1 - t0, 2), "oracle_sec": round(t2 - t1, 2),
           "names_match": sorted(s_names) == sorted(d_names)}
    type_diff = _types(sdf, con, sql)
    out["types_match"] = not type_diff
    if type_diff:
        out["type_diff"] = type_diff
    out["values_match"] = out["names_match"] and _rows(s_names, s_rows) == _rows(d_names, d_rows)
    if not out["values_match"]:
        out["spark_names"], out["oracle_names"] = s_names, d_names
        if out["names_match"]:
            a, b = _rows(s_names, s_rows), _rows(d_names, d_rows)
            sa, sb = set(a), set(b)
            out["only_spark"] = [r for r in a if r not in sb][:3]
            out["only_oracle"] = [r for r in b if r not in sa][:3]
    return out


def main(argv):
    from corpusflow.session import build_session
    import __spark_entry__ as entry

    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    wanted = argv[2:]
    spark = build_session()
    qs, sqls = entry.queries(), entry.oracle_sql()
    con = duckdb_conn(sf_dir)
    bad = 0
    for name in (wanted or sorted(qs)):
        if name not in sqls:
            df = qs[name](spark, sf_dir)
            print({"query": name, "rows_only": df.count()})
            continue
        try:
            r = compare(spark, sf_dir, name, qs[name], sqls[name], con)
        except Exception as exc:  # report and keep going
            r = {"query": name, "error": repr(exc)[:400]}
        bad += not r.get("values_match")
        print(r, flush=True)
    print("mismatches:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
