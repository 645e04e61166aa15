import duckdb
import pytest

from attestra import cases

SF = "/root/testdata/sf0.001"


def _rows(columns, rows):
    def plain(v):
        return round(v, 6) if isinstance(v, float) else int(v) if isinstance(v, int) and not isinstance(v, bool) else v

    return sorted(str([plain(r[i]) for i in sorted(range(len(columns)), key=columns.__getitem__)]) for r in rows)


@pytest.mark.parametrize("name", sorted(cases.QUERIES))
def test_every_case_gives_what_its_sql_states(spark, name):
    con = duckdb.connect()
    for t in ("part", "lineitem", "customer", "supplier"):
        con.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    got, want = cases.QUERIES[name](spark, SF), con.sql(cases.SQL[name])
    a, b = _rows(got.columns, got.collect()), _rows(want.columns, want.fetchall())
    assert sorted(got.columns) == sorted(want.columns) and len(a) == len(b)
    assert a == b
