"""Queries of records, readings and cases against their SQL, and cases that the tables do not hold."""

import duckdb
import pytest

from attestra import records
from attestra.operators import intake, reads

SF = "/root/testdata/sf0.001"


def cells(rows, columns):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(str([round(r[i], 9) if isinstance(r[i], float) else r[i] for i in order]) for r in rows)


@pytest.mark.parametrize("name", sorted(records.QUERIES))
def test_equal_their_sql(spark, name):
    got = records.QUERIES[name](spark, SF)
    con = duckdb.connect()
    for t in ("customer", "lineitem", "orders", "part", "supplier"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.sql(records.SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    rows = want.fetchall()
    assert rows and cells(got.collect(), got.columns) == cells(rows, want.columns)


def test_json_texts_of_all_kinds(spark):
    texts = [None, "", "[]", "7", '{"beverage_type": "wine", "brand_name": 5, "class_type": "x"}', '{"beverage_type": "wine", "brand_name": "é", "class_type": "x", "imported": "yes"}', '{"brand_name": "a", "class_type": "b", "beverage_type": "malt", "bottler": "' + "x" * 301 + '"}']
    got = [r["errors"] for r in intake.json_applications(spark.createDataFrame([(t,) for t in texts], "json string")).collect()]
    bad = ["not an application in JSON"]
    assert got[:4] == [bad] * 4 and got[4] in ([], bad) and got[5] == bad and got[6] == ["bottler: longer than 300"]


def test_a_turned_reading_must_beat_the_one_chosen_so_far(spark):
    rows = [("a", 0, 0.6)] + [("a", 90, 0.9)] * 2 + [("a", 270, 0.9)] * 2 + [("b", 0, 0.9)] * 3 + [("b", 90, 0.9)] * 9 + [("c", 90, 0.4), ("d", 0, 0.7), ("d", 270, 0.9)]
    got = {r["image"]: (r["chosen"], round(r["score"], 3)) for r in reads.best_read(spark.createDataFrame(rows, "image string, degrees int, confidence double")).collect()}
    assert got == {"a": (90, 1.8), "b": (0, 2.7), "c": (0, 0.0), "d": (270, 0.9)}
