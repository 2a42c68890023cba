"""The registered composition under the epsilon filter."""

from __future__ import annotations

import duckdb

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"


def test_all_moves(spark):
    """The query equals its SQL, and has moves of the left side alone, of the right side alone, of both on epsilon and of both on labels."""
    c = duckdb.connect()
    c.execute(f"create view conversations as select * from '{DATA}/conversations.parquet'")
    names = ["auto_id", "sl", "sr", "se", "dl", "dr", "de", "ilabel", "olabel"]
    got = sorted(tuple(r) for r in entry.queries()["compose_epsilon"](spark, DATA).select(*names).collect())
    assert got == sorted(c.execute(f"select {', '.join(names)} from ({entry.oracle_sql()['compose_epsilon']})").fetchall())
    kinds = {(dl - sl, dr - sr, de) for _, sl, sr, _, dl, dr, de, _, _ in got}
    assert {(1, 0, 1), (0, 1, 2), (1, 1, 0), (1, 0, 0)} <= kinds
