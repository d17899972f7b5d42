"""Row-for-row comparison of a DataFrame with a SQL statement run by DuckDB."""

from collections import Counter
from pathlib import Path

import duckdb

# Spark type -> DuckDB type that holds the same values.
SAME_TYPE = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "boolean": "BOOLEAN",
    "string": "VARCHAR",
    "timestamp_ntz": "TIMESTAMP",
}


def duckdb_over(sf_dir):
    connection = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return connection


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(row[i] for i in order) for row in rows)


def assert_same(df, connection, sql):
    result = connection.execute(sql)
    names = [column[0] for column in result.description]
    types = {column[0]: str(column[1]) for column in result.description}
    expected = _rows(names, result.fetchall())
    actual = _rows(df.columns, [tuple(row) for row in df.collect()])
    assert sorted(df.columns) == sorted(names)
    for name, kind in df.dtypes:
        assert types[name] == SAME_TYPE[kind], (name, kind, types[name])
    assert sum(actual.values()) > 0
    missing, extra = expected - actual, actual - expected
    assert not missing and not extra, (list(missing)[:3], list(extra)[:3])
