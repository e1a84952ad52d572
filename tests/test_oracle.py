"""Every query that has SQL against DuckDB on the smallest tables."""

from pathlib import Path

import pytest

DIR = "/root/testdata/sf0.001"
SLOW = {"module_cycles", "symbol_cycles"}

from strandline.plans import registry  # noqa: E402


@pytest.mark.skipif(not Path(DIR).exists(), reason="no test data")
@pytest.mark.parametrize("name", sorted(set(registry.SQL) - SLOW))
def test_same_as_sql(spark, name):
    import duckdb

    from compare import rows

    df = registry.QUERIES[name](spark, DIR)
    mine = rows(df.columns, df.collect())
    con = duckdb.connect()
    for p in Path(DIR).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    cur = con.execute(registry.SQL[name])
    assert mine == rows([c[0] for c in cur.description], cur.fetchall())


def test_names_agree():
    assert set(registry.SQL) <= set(registry.QUERIES)
