"""Compare a query with its SQL."""

import duckdb


def same_rows(rows, sql: str, path: str, tables: list[str]) -> None:
    con = duckdb.connect()
    for name in tables:
        con.execute(f"CREATE VIEW {name} AS FROM '{path}/{name}.parquet'")
    want = con.execute(sql)
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(rows.columns)
    got = [tuple(r) for r in rows.select(*names).collect()]
    assert sorted(got, key=repr) == sorted(want.fetchall(), key=repr)
