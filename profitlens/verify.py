"""Result comparison used by the oracle harness and the tests (same rules as the driver's gate:
column names, row count, and the multiset of rows with columns sorted by name)."""

from __future__ import annotations

import datetime as dt
import decimal
import math

TEST_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def _norm(x):
    if x is None:
        return ("~null",)
    if isinstance(x, bool):
        return ("b", x)
    if isinstance(x, float):
        return ("nan",) if math.isnan(x) else ("f", float(f"{x:.9g}"))
    if isinstance(x, (int, decimal.Decimal)):
        return ("f", float(f"{float(x):.9g}"))
    if isinstance(x, (dt.date, dt.datetime)):
        return ("s", x.isoformat())
    if isinstance(x, (list, tuple)):
        return ("l", tuple(_norm(i) for i in x))
    return ("s", str(x))


def canonical(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(_norm(r[i]) for i in order) for r in rows)


def compare(s_cols, s_rows, o_cols, o_rows) -> str:
    """'ok' or a short description of the first difference."""
    if sorted(s_cols) != sorted(o_cols):
        return f"COLS spark={s_cols} oracle={o_cols}"
    if len(s_rows) != len(o_rows):
        return f"ROWS spark={len(s_rows)} oracle={len(o_rows)}"
    a, b = canonical(s_cols, s_rows), canonical(o_cols, o_rows)
    if a != b:
        diff = [(x, y) for x, y in zip(a, b) if x != y]
        return f"VALUES {len(diff)} rows differ, e.g. {diff[:2]}"
    return "ok"


def duckdb_with_tables(sf_dir: str):
    import os

    import duckdb

    con = duckdb.connect()
    for t in TEST_TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con
