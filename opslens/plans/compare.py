"""Result comparison against the DuckDB oracle (tests and the local check).

Order-insensitive: both results are brought to rows of plain Python values
(columns sorted by name), doubles rounded to 9 significant digits, timestamps
without zone; the two multisets must be equal. Results here are report-sized,
so collecting them in a test is fine; library code never does this.
"""

from __future__ import annotations

import datetime as _dt
import math
from collections import Counter

import duckdb

from opslens.sources.tables import RAW_TABLES, table_path


def duckdb_connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in RAW_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{table_path(sf_dir, t)}')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return float(f"{v:.9g}")
    if isinstance(v, _dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, _dt.date):
        return v.isoformat()
    if hasattr(v, "item"):  # numpy scalar
        return _norm(v.item())
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    try:
        import decimal
        if isinstance(v, decimal.Decimal):
            return _norm(float(v))
    except Exception:  # noqa: BLE001
        pass
    return v


def spark_rows(df) -> tuple[list[str], list[tuple]]:
    cols = sorted(df.columns)
    rows = [tuple(_norm(r[c]) for c in cols) for r in df.select(*cols).collect()]
    return cols, rows


def duck_rows(con, sql: str) -> tuple[list[str], list[tuple]]:
    rel = con.sql(sql)
    names = rel.columns
    data = rel.fetchall()
    cols = sorted(names)
    idx = [names.index(c) for c in cols]
    return cols, [tuple(_norm(r[i]) for i in idx) for r in data]


def compare(df, con, sql: str) -> dict:
    sc, sr = spark_rows(df)
    dc, dr = duck_rows(con, sql)
    out = {"spark_rows": len(sr), "oracle_rows": len(dr), "columns_match": sc == dc,
           "spark_columns": sc, "oracle_columns": dc}
    out["values_match"] = out["columns_match"] and Counter(sr) == Counter(dr)
    if not out["values_match"] and out["columns_match"]:
        a, b = Counter(sr), Counter(dr)
        out["only_spark"] = list((a - b).elements())[:3]
        out["only_oracle"] = list((b - a).elements())[:3]
    return out
