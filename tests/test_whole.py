import duckdb
import pytest

from attestra import whole

SF = "/root/testdata/sf0.001"


def _rows(columns, rows):
    at = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(str([[round(x, 6) for x in r[i]] if isinstance(r[i], list) else round(r[i], 6) if isinstance(r[i], float) else r[i] for i in at]) for r in rows)


@pytest.mark.parametrize("name, table", [("lines_in_reading_order", "lineitem"), ("volume_statements", "part"), ("alcohol_statements", "lineitem"), ("registry_classes", "documents")])
def test_every_row_of_the_table(spark, name, table):
    con = duckdb.connect()
    con.sql(f"create view {table} as select * from read_parquet('{SF}/{table}.parquet')")
    got, want = whole.QUERIES[name](spark, SF), con.sql(whole.SQL[name])
    rows = got.collect()
    assert len(rows) == con.sql(f"select count(*) from {table}").fetchall()[0][0]
    assert _rows(got.columns, rows) == _rows(want.columns, want.fetchall())
