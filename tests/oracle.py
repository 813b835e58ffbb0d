"""Holding a query's rows against its SQL in DuckDB."""

from __future__ import annotations

from pathlib import Path

import duckdb

SMALL = "/root/testdata/sf0.001"
_connections: dict[str, duckdb.DuckDBPyConnection] = {}


def connection(folder: str) -> duckdb.DuckDBPyConnection:
    if folder not in _connections:
        con = duckdb.connect()
        for path in sorted(Path(folder).glob("*.parquet")):
            source = f"{path}/*.parquet" if path.is_dir() else str(path)
            con.execute(f"create view {path.stem} as select * from read_parquet('{source}')")
        _connections[folder] = con
    return _connections[folder]


def _plain(value):
    if value is None or value != value:
        return None
    if isinstance(value, bool):
        return value
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, float):
        return float(f"{value:.9g}")
    if type(value).__name__ == "Decimal":
        return float(value)
    return int(value) if isinstance(value, int) else str(value)


def _rows(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, folder: str, query, sql: str | None) -> str:
    """An empty text if both sides give the same columns and rows, else what differs."""
    frame = query(spark, folder)
    found = _rows(frame.columns, frame.collect())
    if sql is None:
        return "" if found is not None else "no result"
    cursor = connection(folder).execute(sql)
    names = [c[0] for c in cursor.description]
    wanted = _rows(names, cursor.fetchall())
    if sorted(names) != sorted(frame.columns):
        return f"columns {sorted(frame.columns)} and {sorted(names)}"
    if len(found) != len(wanted):
        return f"{len(found)} and {len(wanted)} rows"
    odd = [(a, b) for a, b in zip(found, wanted, strict=True) if not all(x == y or isinstance(x, float | int) and isinstance(y, float | int) and abs(x - y) <= 1e-6 * max(1, abs(x)) for x, y in zip(a, b, strict=True))]
    return f"{len(odd)} of {len(found)} rows differ, first {odd[0]}" if odd else ""
