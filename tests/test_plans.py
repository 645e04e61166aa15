import csv
import random

import duckdb
import pandas as pd
import pytest

from attestra import queries
from attestra.operators import batch
from attestra.operators.spans import reading_order
from attestra.plans.compare import compare
from attestra.sources import csv_intake
from attestra.sources.fixtures import applications, label_lines

SF = "/root/testdata/sf0.001"


def test_reading_order_keeps_columns(spark):
    box = lambda x, y: [(float(x), float(y)), (x + 90.0, float(y)), (x + 90.0, y + 20.0), (float(x), y + 20.0)]
    lines = [(1, 0, 0, "right top", box(300, 100)), (1, 0, 1, "left top", box(100, 102)), (1, 0, 2, "left low", box(103, 110)), (1, 0, 3, "below", box(100, 200))]
    df = spark.createDataFrame(lines, "item_id int, image_index int, line_seq int, text string, box array<struct<x:double,y:double>>")
    got = [r["text"] for r in sorted(reading_order(df).collect(), key=lambda r: r["ro_pos"])]
    assert got == ["left top", "left low", "right top", "below"]


def test_comparison_follows_planted_differences(spark):
    apps, lines = applications(spark, SF).where("item_id < 30"), label_lines(spark, SF).where("item_id < 30")
    found = {r["item_id"]: r for r in compare(apps, lines).verdicts.collect()}
    assert len(found) == 30
    assert "alcohol_content" in found[7]["issues"] and "net_contents" in found[11]["issues"] and "warning" in found[13]["issues"]
    assert found[5]["issues"] == ["country_of_origin"] and found[1]["issues"] == []


def test_an_item_without_lines_has_all_checks(spark):
    apps = applications(spark, SF).where("item_id = 3")
    got = compare(apps, label_lines(spark, SF).where("item_id = -1"))
    assert {r["check_id"]: r["status"] for r in got.checks.collect()} == {"brand_name": "not_found", "class_type": "needs_review", "alcohol_content": "needs_review", "net_contents": "needs_review", "bottler": "needs_review", "country_of_origin": "not_checked"}
    assert got.verdicts.first()["verdict"] == "issues_found"


def test_csv_files(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("Brand;Class;Type;Proof;Images;Extra\r\nÉtoile;Vodka;;80;a.png|b.png;x\r\n;;;;;\r\n;Red wine;w;;;\r\n".encode("cp1252"))
    rows, about = csv_intake.read_applications(spark, str(tmp_path))
    a, b = sorted(rows.collect(), key=lambda r: r["row_number"])
    assert (a["brand_name"], a["beverage_type"], a["alcohol_content"], a["images"], a["valid"]) == ("Étoile", "spirits", "80 proof", ["a.png", "b.png"], True)
    assert b["row_number"] == 4 and b["errors"] == ["brand_name: required"]
    told = about.first()
    assert told["delimiter"] == ";" and told["unmapped"] == ["Extra"] and told["warnings"] == ["decoded as Windows-1252"]
    assert csv_intake.template().startswith("application_id,beverage_type")


def test_csv_cells_of_any_length_and_odd_files(spark, tmp_path):
    long = "x" * 400_000
    (tmp_path / "long.csv").write_text(f"brand name,class type,beverage,brand,abv\nA,{long},wine,B,12%\n")
    (tmp_path / "none.csv").write_bytes(b"\xef\xbb\xbf")
    (tmp_path / "head.csv").write_text("Colour,Size\n")
    (tmp_path / "many.csv").write_text("brand,class,type\n" + "b,c,wine\n\n" * 7)
    rows, about = csv_intake.read_applications(spark, str(tmp_path), max_rows=4)
    by_file = {r["file"].rsplit("/", 1)[1]: r for r in about.collect()}
    assert by_file["none.csv"]["warnings"] == ["empty file"] and by_file["none.csv"]["columns"] == []
    assert by_file["head.csv"]["warnings"] == ["no brand name column"] and (by_file["head.csv"]["columns"], by_file["head.csv"]["unmapped"]) == (["net_contents"], ["Colour"])
    assert by_file["many.csv"]["warnings"] == ["only the first 4 rows were read"] and by_file["long.csv"]["warnings"] == []
    got = [r for r in rows.collect() if r["file"].endswith("long.csv")]
    assert len(got) == 1 and got[0]["brand_name"] == "A B" and got[0]["class_type"] == long and got[0]["errors"] == ["class_type: longer than 200"]
    assert [r["row_number"] for r in sorted(rows.collect(), key=lambda r: r["row_number"]) if r["file"].endswith("many.csv")] == [2, 4, 6, 8]


def test_csv_that_breaks_off_keeps_what_came_before(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(csv_intake, "MOST_CHARACTERS", 1000)
    try:
        told = pd.concat(csv_intake._records(iter([pd.DataFrame({"path": ["f"], "content": [b"brand,class\na,b\n" + b"c," + b"x" * 2000]})])))
    finally:
        csv.field_size_limit(131_072)
    assert told["number"].tolist()[:2] == [1, 2] and "field" in told["problem"].iloc[-1]


def test_pairing_takes_each_file_once(spark):
    rows = spark.createDataFrame([(2, None, ["x/back.png"]), (3, None, ["back.png"]), (4, "AB", [])], "row_number long, application_id string, images array<string>")
    files = spark.createDataFrame([("top/x/back.png",), ("top/y/back.png",), ("ab_1.png",), ("abc.png",)], "path string")
    pairs, left = batch.pair_files(rows, files)
    assert sorted((r["row_number"], r["path"]) for r in pairs.collect()) == [(2, "top/x/back.png"), (3, "top/y/back.png"), (4, "ab_1.png")]
    assert [r["path"] for r in left.collect()] == ["abc.png"]


def _rows(columns, rows):
    def plain(v):
        return round(v, 6) if isinstance(v, float) else [plain(x) for x in v] if isinstance(v, (list, tuple)) else v

    return sorted(str([plain(r[i]) for i in sorted(range(len(columns)), key=columns.__getitem__)]) for r in rows)


@pytest.mark.parametrize("name", random.Random(5).sample(sorted(set(queries.SQL) - {"compare_checks", "compare_verdicts", "what_to_look_at", "field_match_rates"}), 8))
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("part", "orders", "lineitem", "events", "documents", "pages", "nation"):
        con.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    got, want = queries.QUERIES[name](spark, SF), con.sql(queries.SQL[name])
    assert _rows(got.columns, got.collect()) == _rows(want.columns, want.fetchall())
