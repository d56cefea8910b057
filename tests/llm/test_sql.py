import duckdb
import pytest

from voxmap.llm.registry import ORACLE, QUERIES

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = c.execute(ORACLE[name])
    cols = [d[0] for d in want.description]
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(cols)
    rows = want.fetchall()
    assert rows and sorted(map(tuple, got.select(*cols).collect())) == sorted(rows)
