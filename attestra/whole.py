"""Statements, lines and classes over every row of a table, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import numbers as N
from .operators.spans import reading_order
from .queries import _t
from .sources import registry

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


_REST = "l_suppkey, l_quantity, l_partkey, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"


@query(f"""SELECT l_orderkey AS item_id, line_seq, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_suppkey % 10, l_quantity, line_seq) AS ro_pos
FROM (SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, {_REST}) AS INT) AS line_seq FROM lineitem)""")
def lines_in_reading_order(spark, sf_dir):
    # every row is a line, numbered within its order, so rows with one number stay apart; rows equal in all columns may change places
    seq = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", *_REST.split(", ")))
    rows = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity", seq.alias("line_seq"))
    point = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    x, y = F.col("l_quantity") * 1_000_000 + F.col("line_seq") * 40, (F.col("l_suppkey") % 10) * 100
    box = F.array(point(x, y), point(x + 30, y), point(x + 30, y + 20), point(x, y + 20))
    lines = rows.select(F.col("l_orderkey").alias("item_id"), F.lit(0).alias("image_index"), "line_seq", F.lit("x").alias("text"), box.alias("box"))
    return reading_order(lines).select("item_id", "line_seq", F.col("ro_pos").cast("long").alias("ro_pos"))


@query("""SELECT p_partkey, CAST(CASE p_partkey % 4 WHEN 0 THEN [p_size * 10.0] WHEN 1 THEN [round(CAST(p_size AS DOUBLE) * 29.5735295625, 2), CAST(p_size * 30 AS DOUBLE)] WHEN 3 THEN [p_size * 10.0] ELSE [] END AS DOUBLE[]) AS ml,
CASE WHEN p_partkey % 4 IN (0, 3) THEN len(list_filter([50, 100, 187, 200, 250, 331, 350, 355, 375, 475, 500], lambda s: abs(p_size * 10 - s) <= greatest(0.005 * s, 0.5))) > 0 END AS fills FROM part""")
def volume_statements(spark, sf_dir):
    size, kind = F.col("p_size"), F.col("p_partkey") % 4
    n = size.cast("string")
    # 1,010 litres is a thousand and ten of them, which no label states
    text = F.when(kind == 0, F.concat(n, F.lit("0 mL"))).when(kind == 1, F.concat(n, F.lit(" FL. OZ. ("), (size * 30).cast("string"), F.lit("ml)"))).when(kind == 3, F.concat(F.lit("NET CONT. "), n, F.lit(" cl")))
    text = text.otherwise(F.concat(F.lit("CONTENTS 1,"), F.lpad((size * 10).cast("string"), 3, "0"), F.lit(" Litre")))
    v = N.parse_volumes(text)
    return _t(spark, sf_dir, "part").select("p_partkey", F.transform(v, lambda x: x["ml"]).alias("ml"), F.when(kind.isin(0, 3), N.is_standard_fill(F.lit("spirits"), F.get(v, F.lit(0))["ml"])).alias("fills"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN NOT told THEN NULL ELSE CAST(q AS DOUBLE) END AS percent, CAST(CASE WHEN kind IN (0, 2) AND q >= 5 THEN 2 * q END AS DOUBLE) AS proof, CASE WHEN told THEN kind = 2 END AS derived
FROM (SELECT *, NOT (kind = 4 OR kind = 2 AND q < 5) AS told FROM (SELECT l_orderkey, l_linenumber, l_linenumber % 5 AS kind, CAST(l_quantity AS INT) AS q FROM lineitem))""")
def alcohol_statements(spark, sf_dir):
    # a proof of one digit is not read as one, so a low one by itself states nothing
    q, kind = F.col("l_quantity").cast("int"), F.col("l_linenumber") % 5
    n, two = q.cast("string"), (2 * q).cast("string")
    text = F.when(kind == 0, F.concat(n, F.lit("% Alc./Vol. ("), two, F.lit(" Proof)"))).when(kind == 1, F.concat(F.lit("ALC. "), n, F.lit("% BY VOL"))).when(kind == 2, F.concat(two, F.lit(" PROOF"))).when(kind == 3, F.concat(F.lit("Alcohol "), n, F.lit(",0 percent by volume"))).otherwise("AGED FOUR YEARS")
    rows = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", N.parse_alcohol(text).alias("a"))
    return rows.select("l_orderkey", "l_linenumber", "a.percent", "a.proof", "a.derived")


# words end where no letter or digit of any script follows; DuckDB's own sign for it takes the ü of "beerü" for a gap
_A, _Z = r"(?:^|[^\pL\pN_])", r"(?:$|[^\pL\pN_])"


@query(f"""SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)MALT BEVERAGE|{_A}BEER{_Z}|{_A}ALE{_Z}|{_A}STOUT{_Z}|{_A}LAGER{_Z}|{_A}PORTER{_Z}|CEREAL BEVERAGE|NEAR BEER') THEN 'malt' WHEN regexp_matches(text, '(?i)WHISK|VODKA|{_A}GIN{_Z}|{_A}RUM{_Z}|TEQUILA|MEZCAL|AGAVE|BRANDY|LIQUEUR|COCKTAIL|SPIRIT|PROOF|SPECIALT|CORDIAL|ABSINTHE|SCHNAPPS|PISCO|GRAPPA|BITTERS|AQUAVIT|SOJU|BAIJIU|CACHACA') THEN 'spirits' WHEN regexp_matches(text, '(?i){_A}WINE{_Z}|CIDER|{_A}MEAD{_Z}|SAKE|VERMOUTH|CHAMPAGNE|PERRY|SANGRIA') THEN 'wine' ELSE 'spirits' END AS kind FROM documents""")
def registry_classes(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", registry.registry_class(F.col("text")).alias("kind"))
