"""Compare a query with its SQL, run by DuckDB on the same tables."""

from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def sql_rows(sf_dir: str, sql: str) -> tuple[list[str], list[tuple]]:
    db = duckdb.connect()
    for name in TABLES:
        if Path(f"{sf_dir}/{name}.parquet").exists():
            db.execute(f"create view {name} as select * from read_parquet('{sf_dir}/{name}.parquet')")
    found = db.execute(sql)
    columns = [c[0] for c in found.description]
    return columns, found.fetchall()


def _sorted(columns: list[str], rows: list) -> list[tuple]:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    cell = lambda x: round(x, 6) if isinstance(x, float) else x
    return sorted((tuple(cell(r[i]) for i in order) for r in rows), key=repr)


def assert_same(frame, sf_dir: str, sql: str) -> int:
    """Assert equal rows in any order; how many there are."""
    columns, rows = sql_rows(sf_dir, sql)
    assert sorted(frame.columns) == sorted(columns)
    assert _sorted(frame.columns, frame.collect()) == _sorted(columns, rows)
    return len(rows)
