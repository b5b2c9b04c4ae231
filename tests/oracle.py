"""Runs a query and its SQL on the same tables and compares the rows."""

import os

import duckdb


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        path = f"{sf_dir}/{f}" + ("/*.parquet" if os.path.isdir(f"{sf_dir}/{f}") else "")
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{path}'")
    return con


def rows(names: list[str], data) -> tuple[list[str], list[str]]:
    order = sorted(range(len(names)), key=lambda i: names[i])

    def cell(v):
        return repr(round(v, 6) + 0.0) if isinstance(v, float) else str(v)

    return sorted(names), sorted("\t".join(cell(r[i]) for i in order) for r in data)


def of_spark(df) -> tuple[list[str], list[str]]:
    return rows(df.columns, [tuple(r) for r in df.collect()])


def of_sql(con, sql: str) -> tuple[list[str], list[str]]:
    done = con.execute(sql)
    return rows([c[0] for c in done.description], done.fetchall())
