"""Every query of the subpackage that has SQL gives the rows that DuckDB gives for it."""

import duckdb
import pytest

from railloom.llm import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_rows(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    made = registry.QUERIES[name](spark, SF)
    columns = sorted(made.columns)
    done = con.execute(registry.ORACLES[name])
    names = [d[0] for d in done.description]
    want = sorted(tuple(str(r[names.index(c)]) for c in columns) for r in done.fetchall())
    assert sorted(names) == columns and sorted(tuple(str(r[c]) for c in columns) for r in made.collect()) == want
