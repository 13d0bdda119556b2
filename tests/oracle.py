"""Compare a query with its SQL: columns by name, rows in any order, values exactly but for the last
digits of floating point."""

from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        if Path(f"{sf_dir}/{name}.parquet").exists():
            connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def _value(v):
    if isinstance(v, float):
        return float(f"{v:.12g}") + 0.0
    return v


def rows(columns: list[str], data) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(_value(row[i]) for i in order) for row in data]
    return sorted(plain, key=repr)


def expected(connection, sql: str) -> tuple[list[str], list[tuple]]:
    result = connection.execute(sql)
    columns = [d[0] for d in result.description]
    return sorted(columns), rows(columns, result.fetchall())


def actual(frame) -> tuple[list[str], list[tuple]]:
    return sorted(frame.columns), rows(frame.columns, frame.collect())
