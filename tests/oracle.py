"""Spark-versus-DuckDB comparison, the same shape as the external correctness gate.

Usage: python -m tests.oracle [name ...]   (default: every registered query)
"""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return "∅"
    if isinstance(v, float):
        if math.isnan(v):
            return "∅"
        return repr(round(v, 9))
    if hasattr(v, "item") and not isinstance(v, (list, tuple)):
        try:
            return _norm(v.item())
        except (ValueError, AttributeError):
            pass
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, int):
        return str(v)
    if hasattr(v, "tolist"):
        return repr(v.tolist())
    return repr(v)


SPARK_TYPES = {"IntegerType": "int32", "LongType": "int64", "ShortType": "int16", "ByteType": "int8",
               "DoubleType": "float64", "FloatType": "float32", "StringType": "str", "BooleanType": "bool",
               "DateType": "date", "TimestampType": "ts", "TimestampNTZType": "ts"}
DUCK_TYPES = {"INTEGER": "int32", "BIGINT": "int64", "SMALLINT": "int16", "TINYINT": "int8", "DOUBLE": "float64",
              "FLOAT": "float32", "VARCHAR": "str", "BOOLEAN": "bool", "DATE": "date", "TIMESTAMP": "ts"}


def type_diff(sdf, rel):
    st = {f.name: SPARK_TYPES.get(type(f.dataType).__name__, type(f.dataType).__name__) for f in sdf.schema.fields}
    dt = {c: DUCK_TYPES.get(str(t).split("(")[0], str(t)) for c, t in zip(rel.columns, rel.types)}
    return {c: (st.get(c), dt.get(c)) for c in set(st) | set(dt) if st.get(c) != dt.get(c)}


def rows_of(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_norm(r[i]) for i in order) for r in records)


def compare(spark, con, name, fn, sql, sf_dir):
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    s_cols = list(sdf.columns)
    s_rows = [tuple(r) for r in sdf.collect()]
    t1 = time.time()
    if sql is None:
        return dict(name=name, ok=None, rows=len(s_rows), spark_s=round(t1 - t0, 2))
    rel = con.sql(sql)
    d_cols = list(rel.columns)
    d_rows = rel.fetchall()
    t2 = time.time()
    res = dict(name=name, rows=len(s_rows), oracle_rows=len(d_rows),
               spark_s=round(t1 - t0, 2), duck_s=round(t2 - t1, 2))
    if sorted(s_cols) != sorted(d_cols):
        res.update(ok=False, why=f"columns {sorted(s_cols)} vs {sorted(d_cols)}")
        return res
    td = type_diff(sdf, rel)
    if td:
        res.update(ok=False, why=f"column types differ {td}")
        return res
    a, b = rows_of(s_cols, s_rows), rows_of(d_cols, d_rows)
    if a != b:
        diff = [x for x in a if x not in set(b)][:3]
        diff2 = [x for x in b if x not in set(a)][:3]
        res.update(ok=False, why=f"values differ; spark-only {diff} oracle-only {diff2}")
        return res
    res["ok"] = True
    return res


def main(argv):
    sys.path.insert(0, ".")
    import __spark_entry__ as E
    from seqlake.session import build_session
    import os
    sf_dir = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.01")
    if os.environ.get("ORACLE_PLAIN"):   # a bare session, as an outside caller might create it
        from pyspark.sql import SparkSession
        spark = (SparkSession.builder.master("local[*]").config("spark.ui.enabled", "false")
                 .config("spark.sql.session.timeZone", os.environ.get("ORACLE_TZ", "UTC")).getOrCreate())
    else:
        spark = build_session(cores=8)
    con = duck(sf_dir)
    qs, sqls = E.queries(), E.oracle_sql()
    names = argv or list(qs)
    bad = 0
    for n in names:
        try:
            r = compare(spark, con, n, qs[n], sqls.get(n), sf_dir)
        except Exception as e:  # noqa: BLE001 - report and continue
            r = dict(name=n, ok=False, why=f"{type(e).__name__}: {str(e)[:400]}")
        if r.get("ok") is False:
            bad += 1
        print(r, flush=True)
    print(f"FAILED {bad} of {len(names)}")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
