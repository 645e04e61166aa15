"""Queries of planted cases, so that every branch of a check and every small form has rows and SQL of its own.

Each row of a whole table takes one case by its key; the SQL states what each case must give, not how it is found.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import geometry as G
from .functions import numbers as N
from .functions import text as T
from .operators import batch as B
from .operators import evaluate as E
from .operators.warning import STATEMENT
from .plans.compare import compare
from .queries import _t
from .sources import registry

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


CASES = 27


def _of(k: Column, usual, **odd) -> Column:
    """``usual``, but for the cases named (c3=... is case 3)."""
    value = lambda v: v if isinstance(v, Column) else F.lit(v)
    out = value(usual)
    for name, v in odd.items():
        out = F.when(k == int(name[1:]), value(v)).otherwise(out)
    return out


def _labels(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Applications, lines of a front and a back image with measured strokes, and whether images can be read."""
    own = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("item_id"), (F.col("c_custkey") % CASES).alias("k"))
    k = F.col("k")
    name = F.concat(F.lit("Silver Hollow "), F.col("item_id").cast("string"))
    country = _of(k, None, c7="United States", c8="France", c9="France", c10="France", c11="France").cast("string")
    apps = own.select(
        "item_id", _of(k, "spirits", c14="wine", c19="malt").alias("beverage_type"), name.alias("brand_name"), _of(k, "Straight Bourbon Whiskey", c14="Red Table Wine", c19="Pale Ale").alias("class_type"),
        _of(k, "45% Alc./Vol. (90 Proof)", c14=None, c15="45% Alc./Vol.", c16="strong", c19="0.4% Alc./Vol.", c26=None).alias("alcohol_content"), F.lit("750 mL").alias("net_contents"),
        F.lit("Old Tom Distillery LLC, 12 Main Street, Bardstown, KY, 40004").alias("bottler"), country.alias("country_of_origin"), (country.isNotNull() | (k == 12)).alias("imported"))
    half = STATEMENT.index(" (2)")
    head, tail = STATEMENT[:half], STATEMENT[half + 1 :]
    front = [_of(k, F.upper(name), c1=F.replace(F.upper(name), F.lit("HOLLOW"), F.lit("HOLLAW")), c2="MB"), _of(k, "STRAIGHT BOURBON WHISKEY", c3="VODKA", c14="RED TABLE WINE", c19="PALE ALE"),
             _of(k, "45% ALC/VOL (90 PROOF)", c14=None, c15="45% ALC/VOL (80 PROOF)", c19="0.4% ALC/VOL", c25=None), _of(k, None, c13="40% ALC/VOL"), _of(k, "750 ML", c24="700 ML")]
    back = [_of(k, "DISTILLED BY OLD TOM DISTILLERY, LLC", c4="DISTILLED BY OLD TOM DISTILLERY, INC.", c6="DISTILLED BY JUMPY ZEBRA"), _of(k, "BARDSTOWN, KENTUCKY 40004", c5=None),
            _of(k, None, c7="PRODUCT OF GEORGIA", c8="PRODUCT OF ATLANTIS", c10="PRODUCT OF FRANCE", c11="PRODUCT OF ITALY"),
            _of(k, head, c17=head.replace("Surgeon", "Surge0n"), c18=head.replace("should not", "may"), c19=None, c21=head.replace("GOVERNMENT WARNING", "Government Warning"), c23=None), _of(k, tail, c19=None, c23=None)]
    line = lambda image, seq, text: F.struct(F.lit(image).alias("image_index"), F.lit(seq).alias("line_seq"), text.cast("string").alias("text"))
    each = own.select("item_id", "k", F.inline(F.array(*[line(0, i, t) for i, t in enumerate(front)], *[line(1, len(front) + i, t) for i, t in enumerate(back)]))).where("text is not null")
    point = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    top, right = 100 + 52 * F.col("line_seq"), 100 + F.greatest(F.lit(20), 22 * F.length("text"))
    box = F.array(point(F.lit(100), top), point(right, top), point(right, top + 40), point(F.lit(100), top + 40))
    heads = F.col("text").rlike("(?i)^government warning")
    stroke = F.when(heads, F.when(k == 20, 2.0).otherwise(2.6))
    lines = each.select("item_id", "image_index", "line_seq", "text", F.lit(0.98).alias("confidence"), box.alias("box"), stroke.alias("weight_head"), F.when(heads, 2.0).alias("weight_tail"))
    images = own.select("item_id", F.explode(F.array(k != 22, k != 22)).alias("readable"))
    return apps, lines, images


@query(f"""SELECT c_custkey AS item_id, CASE k WHEN 1 THEN 'needs_review' WHEN 2 THEN 'not_found' ELSE 'match' END AS brand, CASE k WHEN 3 THEN 'needs_review' ELSE 'match' END AS class,
CASE WHEN k = 13 THEN 'mismatch' WHEN k = 14 THEN 'info' WHEN k IN (15, 16, 25, 26) THEN 'needs_review' ELSE 'match' END AS alcohol, CASE k WHEN 24 THEN 'mismatch' ELSE 'match' END AS net, CASE WHEN k IN (4, 5, 6) THEN 'needs_review' ELSE 'match' END AS bottler,
CASE WHEN k IN (7, 8, 9, 12) THEN 'needs_review' WHEN k = 10 THEN 'match' WHEN k = 11 THEN 'mismatch' ELSE 'not_checked' END AS origin,
CASE k WHEN 17 THEN 'noise' WHEN 18 THEN 'wording' WHEN 19 THEN 'not_required' WHEN 23 THEN 'absent' ELSE 'exact' END AS assessment, CASE WHEN k IN (19, 23) THEN 'not_found' WHEN k = 21 THEN 'needs_review' ELSE 'match' END AS caps,
CASE WHEN k IN (19, 23) THEN NULL WHEN k = 20 THEN 'same' ELSE 'heavier' END AS reading,
CASE WHEN k = 22 THEN 'unreadable' WHEN k IN (2, 11, 13, 18, 23, 24) THEN 'issues_found' WHEN k IN (0, 10, 14, 19) THEN 'ready_for_approval' ELSE 'needs_review' END AS verdict
FROM (SELECT c_custkey, c_custkey % {CASES} AS k FROM customer)""")
def compare_cases(spark, sf_dir):
    apps, lines, images = _labels(spark, sf_dir)
    found = compare(apps, lines, images)
    of = lambda check: F.max(F.when(F.col("check_id") == check, F.col("status")))
    names = {"brand": "brand_name", "class": "class_type", "alcohol": "alcohol_content", "net": "net_contents", "bottler": "bottler", "origin": "country_of_origin"}
    per = found.checks.groupBy("item_id").agg(*[of(check).alias(n) for n, check in names.items()])
    out = per.join(found.warning.hint("merge"), "item_id").join(found.verdicts.select("item_id", "verdict").hint("merge"), "item_id")
    return out.select("item_id", *names, "warning.assessment", "warning.caps", F.col("warning.type_weight_reading").alias("reading"), "verdict")


_STATE = "CASE p_partkey % 4 WHEN 0 THEN 'KY' WHEN 1 THEN 'KY' WHEN 2 THEN 'NY' END"


@query(f"""SELECT p_partkey, '"' || p_name || ''' - x' AS unified, 'SOLD ' || p_size || '0 ml, NO 1' AS digits, 'Kentucky straight bourbon ' || p_name || ' 12- 34' AS joined, ['Company', 'Ltd.'] AS forms, p_partkey % 2 = 0 AS case_only, p_partkey % 2 = 0 AS deed,
{_STATE} AS state, p_partkey % 4 <> 3 AS slip, replace(p_brand, '#', '_') || '_a_b' AS safe, CASE WHEN 2 * p_size + p_partkey % 2 >= 10 THEN p_partkey % 2 = 0 END AS proof_fits, p_partkey % 4 IN (0, 2) AS required, p_partkey % 2 = 0 AS capitals, ['contains', ':', 'a', '-', '1', '%'] AS tokens FROM part""")
def text_cases(spark, sf_dir):
    k, name, brand, size = F.col("p_partkey"), F.col("p_name"), F.col("p_brand"), F.col("p_size")
    even = lambda a, b: F.when(k % 2 == 0, a).otherwise(b)
    four = lambda *v: F.get(F.array(*[x if isinstance(x, Column) else F.lit(x) for x in v]), (k % 4).cast("int"))
    swapped = F.concat(F.substring(brand, 2, 1), F.substring(brand, 1, 1), F.substring(brand, 3, 99))
    stated = F.concat(size.cast("string"), F.lit("% ALC/VOL ("), (2 * size + k % 2).cast("string"), F.lit(" PROOF)"))
    return _t(spark, sf_dir, "part").select(
        k, T.unify_punctuation(F.concat(F.lit("“"), name, F.lit("’ – x"))).alias("unified"), T.fold_digits(F.concat(F.lit("SOLD "), size.cast("string"), F.lit("O ml, NO 1"))).alias("digits"),
        T.join_hyphenated(F.array(F.lit("Kentucky straight bour-"), F.concat(F.lit("bon "), name), F.lit(" "), F.lit("12-"), F.lit("34"))).alias("joined"), T.company_forms(F.concat(brand, F.lit(" Co., Ltd. COMPANY"))).alias("forms"),
        T.case_only_difference(F.concat(F.lit(" "), name), even(F.upper(name), F.concat(F.upper(name), F.lit("X")))).alias("case_only"), T.has_responsibility_prefix(F.concat(even(F.lit("Hand-crafted & bottled by: "), F.lit("Sold by ")), brand)).alias("deed"),
        T.state_code(four("Kentucky", " ky ", "New  YORK", "Ontario")).alias("state"), T.one_slip(brand, four(F.substring(brand, 2, 99), F.concat(brand, F.lit("x")), swapped, F.concat(F.lit("xy"), F.substring(brand, 3, 99)))).alias("slip"),
        T.file_safe(F.concat(brand, F.lit(" /a: b"))).alias("safe"), N.consistent(N.parse_alcohol(stated)).alias("proof_fits"),
        N.alcohol_required(four("spirits", "wine", "wine", "malt"), four("Gin", "Light white wine", "Cabernet", "Ale")).alias("required"), T.all_capitals(F.concat(F.lit("1: "), even(F.lit("ÉTÉ"), F.lit("Été")))).alias("capitals"), T.exact_tokens(F.lit("Contains:  A-1 %")).alias("tokens"))


_X, _Y, _TURN = "CAST(l_quantity AS DOUBLE)", "CAST(l_partkey % 100 AS DOUBLE)", "l_linenumber % 4"


@query(f"""SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, CASE {_TURN} WHEN 1 THEN 2 * y WHEN 2 THEN 400 - 2 * x WHEN 3 THEN 400 - 2 * y ELSE 2 * x END AS x, CASE {_TURN} WHEN 1 THEN 300 - 2 * x WHEN 2 THEN 300 - 2 * y WHEN 3 THEN 2 * x ELSE 2 * y END AS y,
greatest(0, x - 8) AS x0, greatest(0, y - 8) AS y0, least(400.0, x + 48) AS x1, least(100.0, y + 38) AS y1, greatest(0, 40 - x) / 40 AS across, greatest(0, 40 - x) * greatest(0, 10 - y) / 400 AS shared
FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, {_X} AS x, {_Y} AS y FROM lineitem)""")
def box_cases(spark, sf_dir):
    # a point read on a turned image of half size; a box around two lines of an image and none of the other; shares of two boxes, one at the origin
    x, y, d = F.col("l_quantity").cast("double"), (F.col("l_partkey") % 100).cast("double"), F.lit
    point = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
    box = lambda a, b, w, h: F.array(point(a, b), point(a + w, b), point(a + w, b + h), point(a, b + h))
    piece = lambda image, b: F.struct(F.lit(image).alias("image_index"), b.alias("box"))
    upright = G.to_upright(x, y, F.col("l_linenumber") % 4 * 90, d(400), d(300), d(0.5))
    around = G.evidence_box(F.array(piece(1, box(x, y, 20, 10)), piece(0, box(d(0.0), d(0.0), 400, 100)), piece(1, box(x + 10, y + 20, 30, 10))), d(400), d(100))
    sides = lambda a, b, w, h: F.struct(a.alias("x0"), (a + w).alias("x1"), b.alias("y0"), (b + h).alias("y1"))
    rows = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", upright.alias("u"), around.alias("e"), sides(d(0.0), d(0.0), 40, 10).alias("a"), sides(x, y, 60, 10).alias("b"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "u.x", "u.y", "e.x0", "e.y0", "e.x1", "e.y1", G.column_overlap("a", "b").alias("across"), G.area_overlap("a", "b").alias("shared"))


@query("SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'png' WHEN 1 THEN 'jpeg' WHEN 2 THEN 'gif' WHEN 3 THEN 'webp' WHEN 4 THEN 'tiff' END AS format, CASE WHEN c_custkey % 50 > 0 THEN 1000.0 * (100 - c_custkey % 50) / (c_custkey % 50) END AS eta_ms FROM customer")
def image_cases(spark, sf_dir):
    head = F.get(F.array(*[F.unhex(F.lit(h)) for h in ("89504E470D0A1A0A00000000", "FFD8FFE000104A4649460001", "474946383961000000000000", "52494646AABBCCDD57454250", "4D4D002A0000000000000000", "3C68746D6C3E3C626F64793E")]), (F.col("c_custkey") % 6).cast("int"))
    done = F.col("c_custkey") % 50
    return _t(spark, sf_dir, "customer").select("c_custkey", registry.image_format(head).alias("format"), B.eta_ms(F.lit(1000.0), done, F.lit(100)).alias("eta_ms"))


@query("""SELECT 'Batch/' || p_partkey // 2 || '.PNG' AS path, 1 + min(p_size) AS size FROM part WHERE p_partkey % 6 < 2 GROUP BY p_partkey // 2
UNION ALL SELECT 'scans/' || p_partkey, 1 + p_size FROM part WHERE p_partkey % 6 = 2""")
def file_cases(spark, sf_dir):
    # of six parts two are one file in two cases of its path, one has a type only; a text, an empty and a huge file are left out
    k, size = F.col("p_partkey"), 1 + F.col("p_size").cast("long")
    six = lambda *v: F.get(F.array(*v), (k % 6).cast("int"))
    text, pair = k.cast("string"), F.floor(k / 2).cast("string")
    path = six(F.concat(F.lit("Batch/"), pair, F.lit(".PNG")), F.concat(F.lit("batch/"), pair, F.lit(".png")), F.concat(F.lit("scans/"), text), F.concat(F.lit("notes/"), text, F.lit(".txt")), F.concat(F.lit("empty/"), text, F.lit(".png")), F.concat(F.lit("huge/"), text, F.lit(".png")))
    part = _t(spark, sf_dir, "part")
    smaller = F.min(size).over(Window.partitionBy(F.floor(k / 2)))
    files = part.select(path.alias("path"), six(smaller, smaller, size, size, F.lit(0).cast("long"), F.lit(10 * 1024 * 1024 + 1).cast("long")).alias("size"), six(F.lit(""), F.lit(""), F.lit("image/jpeg"), F.lit("text/plain"), F.lit(""), F.lit("")).alias("type"))
    return B.accepted_files(files)


@query("SELECT s_nationkey || '.png' AS name, count(*) AS n FROM supplier GROUP BY s_nationkey HAVING count(*) > 1")
def name_cases(spark, sf_dir):
    return B.duplicate_names(_t(spark, sf_dir, "supplier").select(F.concat(F.lit("batch\\"), F.col("s_suppkey").cast("string"), F.lit("/"), F.col("s_nationkey").cast("string"), F.lit(".PNG")).alias("path")))


@query("SELECT 'labels/' || p_partkey || 'x_front.png' AS path FROM part")
def unpaired_cases(spark, sf_dir):
    k = F.col("p_partkey").cast("string")
    part = _t(spark, sf_dir, "part")
    rows = part.select("p_partkey", k.alias("application_id"), F.array().cast("array<string>").alias("images")).withColumnRenamed("p_partkey", "row_number")
    files = part.select(F.explode(F.array(F.concat(F.lit("labels/"), k, F.lit("_front.png")), F.concat(F.lit("labels/"), k, F.lit("x_front.png")))).alias("path"))
    return B.pair_files(rows, files)[1]


@query("SELECT count(*) AS checks, count(*) FILTER (p_partkey % 5 IN (1, 3)) AS alarms, CAST(count(*) FILTER (p_partkey % 5 IN (1, 3)) AS DOUBLE) / count(*) AS rate FROM part")
def false_alarms(spark, sf_dir):
    status = F.get(F.array(*[F.lit(s) for s in ("match", "needs_review", "match", "mismatch", "match")]), (F.col("p_partkey") % 5).cast("int"))
    return E.false_alarm_rate(_t(spark, sf_dir, "part").select(status.alias("status")))


def _reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.get(F.array(*[F.lit(s) for s in ("exact", "noise", "wording", "absent")]), (F.col("p_partkey") % 4).cast("int"))
    caps, weight = F.when(F.col("p_size") % 2 == 0, "match").otherwise("needs_review"), F.when(F.col("p_size") % 3 == 0, "same").otherwise("heavier")
    warning = F.struct((kind != "absent").alias("present"), (kind == "exact").alias("exact"), kind.alias("assessment"), caps.alias("caps"), weight.alias("type_weight_reading"))
    variant = F.get(F.array(*[F.lit(s) for s in ("wrong_abv", "titlecase", "allbold", "altered", "missing", "tiny")]), (F.floor(F.col("p_partkey") / 4) % 6).cast("int"))
    statuses = F.create_map(F.lit("alcohol_content"), F.when(F.col("p_size") % 2 == 0, "mismatch").otherwise("match"))
    verdict = F.when(F.col("p_size") % 2 == 0, "issues_found").otherwise("needs_review")
    return _t(spark, sf_dir, "part").select("p_partkey", variant.alias("variant"), statuses.alias("statuses"), warning.alias("warning"), verdict.alias("verdict"), F.col("p_size").cast("double").alias("ms"))


@query("SELECT count(*) AS n, count(*) FILTER (p_partkey % 4 = 0) AS exact, count(*) FILTER (p_partkey % 4 = 1) AS noise, count(*) FILTER (p_partkey % 4 IN (2, 3)) AS wording_or_absent FROM part")
def warning_splits(spark, sf_dir):
    return E.warning_split(_reports(spark, sf_dir))


_FOUND = "CASE p_partkey // 4 % 6 WHEN 0 THEN p_size % 2 = 0 WHEN 1 THEN p_size % 2 = 1 WHEN 2 THEN p_size % 3 = 0 WHEN 3 THEN p_partkey % 4 = 2 WHEN 4 THEN p_partkey % 4 = 3 ELSE false END"


@query(f"SELECT count(*) FILTER (p_partkey // 4 % 6 < 5) AS assessed, count(*) FILTER ({_FOUND}) AS found, count(*) FILTER (p_partkey // 4 % 6 = 5) AS not_assessed, CAST(count(*) FILTER ({_FOUND}) AS DOUBLE) / count(*) FILTER (p_partkey // 4 % 6 < 5) AS rate FROM part")
def detections(spark, sf_dir):
    return E.detection_rate(_reports(spark, sf_dir))


@query("""SELECT ['wrong_abv', 'titlecase', 'allbold', 'altered', 'missing', 'tiny'][1 + p_partkey // 4 % 6] AS variant, count(*) AS cases, count(*) FILTER (p_size % 2 = 0) AS issues, count(*) FILTER (p_size % 2 = 1) AS reviews, median(CAST(p_size AS DOUBLE)) AS median_ms FROM part GROUP BY ALL""")
def variant_cases(spark, sf_dir):
    of = lambda v: F.coalesce(F.try_element_at("verdicts", F.lit(v)), F.lit(0)).cast("long")
    return E.by_variant(_reports(spark, sf_dir)).select("variant", "cases", of("issues_found").alias("issues"), of("needs_review").alias("reviews"), "median_ms")
