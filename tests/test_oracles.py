"""Every query with SQL gives the rows that DuckDB gives for it."""

import duckdb
import pytest

from railloom.plans import answers, answers_sql, registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "events orders part supplier nation region customer lineitem".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def cells(row):
    return tuple(f"{v:.9g}" if isinstance(v, float) else str(v) for v in row)


QUERIES, ORACLES = registry.QUERIES | answers.QUERIES, registry.ORACLES | answers_sql.ORACLES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, duck, name):
    made = QUERIES[name](spark, SF)
    columns = sorted(made.columns)
    got = sorted(cells(r[c] for c in columns) for r in made.collect())
    done = duck.execute(ORACLES[name])
    names = [d[0] for d in done.description]
    want = sorted(cells(r[names.index(c)] for c in columns) for r in done.fetchall())
    assert sorted(names) == columns and got == want
