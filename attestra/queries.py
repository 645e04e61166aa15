"""Registered queries over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .functions.countries import BY_NAME, ORDER, STATE_CODE, STATE_NAMES, country_named
from .operators import batch as B
from .operators import evaluate as E
from .operators.spans import reading_order
from .plans.compare import compare, extract
from .sources import csv_intake, export, fixtures, registry

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_FOLD = r"trim(regexp_replace(replace(lower(strip_accents(text)), 'ß', 'ss'), '[\t-\r\x1c-\x20]+', ' ', 'g'))"


@query(rf"SELECT doc_id, md5(f) AS folded, md5(trim(regexp_replace(replace(replace(f, '''', ''), '\"', ''), '[^a-z0-9]+', ' ', 'g'))) AS keyed FROM (SELECT doc_id, {_FOLD} AS f FROM documents)")
def text_forms(spark, sf_dir):
    own = _t(spark, sf_dir, "documents").select("doc_id", T.fold(F.col("text")).alias("f"))
    return own.select("doc_id", F.md5("f").alias("folded"), F.md5(T.key(F.col("f"), F.col("f"))).alias("keyed"))


@query("""SELECT n_nationkey, CASE n_nationkey % 5 WHEN 0 THEN 'Italy' WHEN 1 THEN 'United States' WHEN 2 THEN 'Papua New Guinea' WHEN 3 THEN 'United Kingdom' END AS country, CASE n_nationkey % 5 WHEN 0 THEN 'Italy' WHEN 2 THEN 'Papua New Guinea' WHEN 3 THEN 'United Kingdom' END AS strict FROM nation""")
def countries(spark, sf_dir):
    texts = F.array(*[F.lit(x) for x in ("Product of Italia", "Bottled in Napa, CA 94558", "made in PAPUA NEW GUINEA", "Scotch whisky", "Estate grown")])
    c = F.get(texts, (F.col("n_nationkey") % 5).cast("int"))
    return _t(spark, sf_dir, "nation").select("n_nationkey", country_named(c).alias("country"), country_named(c, states=False).alias("strict"))


#: Ends of texts that name two countries in words of one length, a state, and both senses of Georgia.
_ORIGINS = ["French and German oak", "Mexique, Italian style", "Dutch or Korea", "Napa, CA 94558", "Atlanta, Georgia", "Republic of Georgia", "grown in Georgia", "Guinea or Papua New Guinea", "West Virginia2", "Franceville", "no name of a country", "Côte d'Ivoire"]
_NAMES = ", ".join(f"({i}, '{n}', '{c}')" for i, (n, c) in enumerate([*((n, "United States") for n in STATE_NAMES), *((n, BY_NAME[n]) for n in ORDER)]))
_ENDS = ", ".join("'" + x.replace("'", "''") + "'" for x in _ORIGINS)
_NAMED = rf"""WITH n(i, name, country) AS (VALUES {_NAMES}), d AS (SELECT doc_id, coalesce(text, '') || '. ' || list_extract([{_ENDS}], CAST(doc_id % {len(_ORIGINS)} AS INT) + 1) AS text FROM documents),
f AS (SELECT doc_id, text, {_FOLD} AS f FROM d), k AS (SELECT *, trim(regexp_replace(replace(replace(f, '''', ''), '"', ''), '[^a-z0-9]+', ' ', 'g')) AS k FROM f),
w AS (SELECT *, ' ' || trim(regexp_replace(regexp_replace(k, '[^a-z ]+', ' # ', 'g'), ' +', ' ', 'g')) || ' ' AS w FROM k),
m AS (SELECT doc_id, min(i) AS i, min(i) FILTER (i >= {len(STATE_NAMES)}) AS j FROM w JOIN n ON contains(w, ' ' || name || ' ') GROUP BY doc_id)
SELECT w.doc_id, CASE WHEN regexp_matches(k, 'republic of georgia([^a-z]|$)') THEN 'Georgia' WHEN regexp_matches(f, ',\s*georgia([^a-z]|$)') OR regexp_matches(trim(text), '{STATE_CODE}') THEN 'United States' ELSE a.country END AS country,
CASE WHEN regexp_matches(k, 'republic of georgia([^a-z]|$)') THEN 'Georgia' ELSE b.country END AS strict FROM w LEFT JOIN m USING (doc_id) LEFT JOIN n a ON a.i = m.i LEFT JOIN n b ON b.i = m.j"""


@query(_NAMED)
def countries_in_documents(spark, sf_dir):
    text = F.concat(F.coalesce("text", F.lit("")), F.lit(". "), F.get(F.array(*map(F.lit, _ORIGINS)), (F.col("doc_id") % len(_ORIGINS)).cast("int")))
    return _t(spark, sf_dir, "documents").select("doc_id", country_named(text).alias("country"), country_named(text, states=False).alias("strict"))



_APP = f"SELECT p_partkey AS item_id, CASE p_partkey % 3 WHEN 0 THEN 'spirits' WHEN 1 THEN 'wine' ELSE 'malt' END AS beverage, p_partkey % 13 AS w, p_partkey % 5 = 0 AS imported, p_partkey % 7 = 0 AS abv, p_partkey % 11 = 0 AND p_partkey % 4 >= 0 AS vol, p_partkey FROM part"
_CHECKS = f"""app AS ({_APP}),
checks AS (SELECT item_id, beverage, unnest([{{'check_id': 'brand_name', 'status': 'match'}}, {{'check_id': 'class_type', 'status': 'match'}}, {{'check_id': 'alcohol_content', 'status': CASE WHEN abv THEN 'mismatch' ELSE 'match' END}},
  {{'check_id': 'net_contents', 'status': CASE WHEN vol THEN 'mismatch' ELSE 'match' END}}, {{'check_id': 'bottler', 'status': 'match'}},
  {{'check_id': 'country_of_origin', 'status': CASE WHEN NOT imported THEN 'not_checked' WHEN p_partkey % 2 = 0 THEN 'match' ELSE 'mismatch' END}},
  {{'check_id': CASE WHEN beverage = 'wine' AND p_partkey % 4 = 1 THEN 'standard_of_fill' END, 'status': 'needs_review'}}], recursive := true) FROM app),
c AS (SELECT * FROM checks WHERE check_id IS NOT NULL)"""


@query(f"WITH {_CHECKS} SELECT item_id, check_id, status FROM c")
def compare_checks(spark, sf_dir):
    return compare(fixtures.applications(spark, sf_dir), fixtures.label_lines(spark, sf_dir)).checks.select("item_id", "check_id", "status")


@query(f"""WITH {_CHECKS} SELECT app.item_id, CASE WHEN count_if(status = 'mismatch') > 0 OR any_value(w) = 0 THEN 'issues_found' ELSE 'needs_review' END AS verdict, count_if(status = 'mismatch') + CASE WHEN any_value(w) = 0 THEN 1 ELSE 0 END AS issues
FROM app JOIN c USING (item_id) GROUP BY app.item_id""")
def compare_verdicts(spark, sf_dir):
    # the heading's weight is not measured on these lines, so no item is ready without a person's look
    found = compare(fixtures.applications(spark, sf_dir), fixtures.label_lines(spark, sf_dir)).verdicts
    return found.select("item_id", "verdict", F.size("issues").cast("long").alias("issues"))


@query("SELECT p_partkey AS item_id, p_partkey % 13 <> 0 AS present, CASE p_partkey % 13 WHEN 0 THEN 'absent' ELSE 'exact' END AS assessment, CASE p_partkey % 13 WHEN 0 THEN 'not_found' WHEN 1 THEN 'needs_review' ELSE 'match' END AS caps FROM part")
def warning_reports(spark, sf_dir):
    from .operators.warning import warnings

    lines = reading_order(fixtures.label_lines(spark, sf_dir))
    return warnings(fixtures.applications(spark, sf_dir), lines).select("item_id", "warning.present", "warning.assessment", "warning.caps")


_ML = "CASE p_partkey % 4 WHEN 0 THEN 750.0 WHEN 1 THEN 1750.0 WHEN 2 THEN 354.88 ELSE 500.0 END"


@query(f"SELECT p_partkey AS item_id, CAST(5 + p_size + CASE WHEN p_partkey % 7 = 0 THEN 1 ELSE 0 END AS DOUBLE) AS alcohol_percent, [CAST(CASE WHEN p_partkey % 11 = 0 THEN 700.0 ELSE {_ML} END AS DOUBLE)] AS net_contents_ml, p_partkey % 13 <> 0 AS warning_present, upper(p_name) AS largest_text FROM part")
def label_extracts(spark, sf_dir):
    return extract(fixtures.label_lines(spark, sf_dir)).select("item_id", "alcohol_percent", "net_contents_ml", "warning_present", "largest_text")


@query("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'spirits' WHEN 1 THEN CASE WHEN p_partkey % 2 = 0 THEN 'wine' ELSE 'malt' END END AS beverage_type, p_partkey % 4 = 0 AS imported, len(CASE WHEN p_partkey % 2 = 0 THEN ['a', 'b'] ELSE [] END) AS images,
CASE WHEN p_partkey % 3 = 2 THEN 'beverage_type: missing or not recognized' WHEN p_partkey % 10 = 0 THEN 'brand_name: required' ELSE '' END AS errors FROM part""")
def csv_rows(spark, sf_dir):
    k = F.col("p_partkey")
    none = F.lit(None).cast("string")
    cells = _t(spark, sf_dir, "part").select(k, F.when(k % 3 == 0, " Distilled Spirits").when(k % 3 == 1, F.when(k % 2 == 0, "Table wine").otherwise("Craft LAGER")).otherwise("unknown").alias("beverage_type"), F.when(k % 10 == 0, "  ").otherwise(F.col("p_name")).alias("brand_name"), F.col("p_type").alias("class_type"), none.alias("application_id"), none.alias("alcohol_content"), none.alias("net_contents"), none.alias("bottler"), none.alias("country_of_origin"), F.when(k % 4 == 0, "Yes ").otherwise("no").alias("imported"), F.when(k % 2 == 0, "a.png; b.png|").otherwise("").alias("images"))
    out = csv_intake.validated(cells)
    return out.select("p_partkey", "beverage_type", "imported", F.size("images").cast("long").alias("images"), F.array_join("errors", ";").alias("errors"))


@query("""SELECT o_orderkey AS row_number, CASE WHEN o_custkey % 4 = 0 THEN 'row-' || o_orderkey WHEN row_number() OVER (PARTITION BY CASE WHEN o_custkey % 4 = 0 THEN NULL ELSE o_custkey END, o_custkey % 4 = 0 ORDER BY o_orderkey) > 1 THEN o_custkey || ' (row ' || o_orderkey || ')' ELSE CAST(o_custkey AS VARCHAR) END AS item_key FROM orders""")
def batch_keys(spark, sf_dir):
    rows = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row_number"), F.when(F.col("o_custkey") % 4 != 0, F.col("o_custkey").cast("string")).alias("application_id"))
    return B.item_keys(rows).select("row_number", "item_key")


@query("""SELECT p_partkey AS row_number, CAST(unnest([0, 1]) AS INT) AS position, 'batch/' || CASE WHEN p_partkey % 2 = 0 THEN 'labels' ELSE 'more' END || '/cola' || p_partkey || CASE WHEN p_partkey % 2 = 0 THEN unnest(['_front.png', '_back.png']) ELSE unnest(['-a.png', '_b.png']) END AS path FROM part""")
def batch_pairs(spark, sf_dir):
    k = F.col("p_partkey")
    name = F.concat(F.lit("cola"), k.cast("string"))
    part = _t(spark, sf_dir, "part")
    listed = F.when(k % 2 == 0, F.array(F.concat(F.lit("Labels\\"), name, F.lit("_front.PNG")), F.concat(name, F.lit("_back.png")))).otherwise(F.array().cast("array<string>"))
    rows = part.select(k.alias("row_number"), F.upper(name).alias("application_id"), listed.alias("images"))
    files = part.select(F.explode(F.when(k % 2 == 0, F.array(F.concat(F.lit("batch/labels/"), name, F.lit("_front.png")), F.concat(F.lit("batch/labels/"), name, F.lit("_back.png")))).otherwise(F.array(F.concat(F.lit("batch/more/"), name, F.lit("-a.png")), F.concat(F.lit("batch/more/"), name, F.lit("_b.png"))))).alias("path"))
    return B.pair_files(rows, files)[0]


_ITEMS = "SELECT o_orderkey AS row_number, CAST(o_orderkey AS VARCHAR) AS item_key, CASE o_orderstatus WHEN 'O' THEN 'done' WHEN 'F' THEN 'done' ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'error' ELSE 'no-images' END END AS status, CASE o_orderstatus WHEN 'O' THEN CASE WHEN o_custkey % 2 = 0 THEN 'ready_for_approval' ELSE 'needs_review' END WHEN 'F' THEN CASE WHEN o_custkey % 2 = 0 THEN 'issues_found' ELSE 'unreadable' END END AS verdict, CASE WHEN o_custkey % 3 = 0 THEN 'approve' END AS decision FROM orders"


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, k, c = F.col("o_orderstatus"), F.col("o_orderkey"), F.col("o_custkey")
    return _t(spark, sf_dir, "orders").select(k.alias("row_number"), k.cast("string").alias("item_key"), F.when(s.isin("O", "F"), "done").when(k % 2 == 0, "error").otherwise("no-images").alias("status"), F.when(s == "O", F.when(c % 2 == 0, "ready_for_approval").otherwise("needs_review")).when(s == "F", F.when(c % 2 == 0, "issues_found").otherwise("unreadable")).alias("verdict"), F.when(c % 3 == 0, "approve").alias("decision"))


_N = "count(*) FILTER (WHERE "


@query(f"""WITH i AS ({_ITEMS}) SELECT count(*) AS total, {_N}status = 'done') AS done, {_N}verdict = 'ready_for_approval') AS ready, {_N}verdict = 'needs_review') AS review, {_N}verdict = 'issues_found') AS issues, {_N}verdict = 'unreadable') AS unreadable, {_N}status = 'error') AS errors, {_N}status = 'no-images') AS no_images, {_N}decision IS NOT NULL) AS decided,
CAST(round(100.0 * {_N}status IN ('done', 'error')) / {_N}status <> 'no-images')) AS BIGINT) AS percent FROM i""")
def batch_counters(spark, sf_dir):
    return B.counters(_items(spark, sf_dir))


@query(f"WITH i AS ({_ITEMS}) SELECT row_number, verdict FROM i WHERE status IN ('error', 'no-images') OR verdict IN ('issues_found', 'needs_review', 'unreadable')")
def batch_attention(spark, sf_dir):
    return B.shown(_items(spark, sf_dir), "attention").select("row_number", "verdict")


@query(f"WITH i AS ({_ITEMS}) SELECT row_number, item_key, verdict FROM i WHERE status = 'done' AND decision IS NULL ORDER BY CASE verdict WHEN 'issues_found' THEN 0 WHEN 'unreadable' THEN 1 WHEN 'needs_review' THEN 2 WHEN 'ready_for_approval' THEN 3 ELSE 4 END, row_number, item_key LIMIT 50 OFFSET 50")
def batch_second_page(spark, sf_dir):
    return B.page(B.shown(_items(spark, sf_dir), "undecided"), 1).select("row_number", "item_key", "verdict")


@query("""SELECT event_type AS variant, count(*) AS cases, median(value) AS p50, quantile_disc(value, 0.95) AS p95, list_sort(list(value))[CAST(least(count(*), floor(0.95 * count(*)) + 1) AS INT)] AS p95_upper FROM events WHERE value IS NOT NULL GROUP BY event_type""")
def latency_percentiles(spark, sf_dir):
    return E.latency(_t(spark, sf_dir, "events").select(F.col("event_type").alias("variant"), F.col("value").alias("ms")), ["variant"])


@query(f"""WITH {_CHECKS} SELECT beverage, check_id, count(*) AS n, {_N}status = 'match') AS matched, {_N}status = 'needs_review') AS review, {_N}status IN ('mismatch', 'not_found')) AS failed, {_N}status = 'match') * 1.0 / count(*) AS match_rate FROM c WHERE status <> 'not_checked' GROUP BY GROUPING SETS ((beverage, check_id), (check_id))""")
def field_match_rates(spark, sf_dir):
    apps = fixtures.applications(spark, sf_dir)
    checks = compare(apps, fixtures.label_lines(spark, sf_dir)).checks.where("status <> 'not_checked'")
    rows = checks.join(apps.select("item_id", F.col("beverage_type").alias("beverage")).hint("merge"), "item_id").select("beverage", "check_id", "status")
    return E.field_rates(rows, "beverage")


@query("SELECT 'o_orderstatus' AS \"column\", o_orderstatus AS value, count(*) AS n FROM orders GROUP BY ALL UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY ALL")
def export_tally(spark, sf_dir):
    return E.tally(_t(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority"])


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def assessment_histogram(spark, sf_dir):
    return E.histogram(_t(spark, sf_dir, "events"), "event_type")


@query("""WITH r AS (SELECT CASE WHEN event_type = 'error' THEN 503 ELSE 200 END AS status, value AS wall_ms, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS refused, epoch_ms(ts) AS at_ms FROM events)
SELECT count(*) AS n, count(*) FILTER (WHERE status = 200) AS served, CAST(sum(refused) AS BIGINT) AS refused, (max(at_ms + coalesce(wall_ms, 0)) - min(at_ms)) / 1000 AS wall_s, count(*) FILTER (WHERE status = 200) / ((max(at_ms + coalesce(wall_ms, 0)) - min(at_ms)) / 1000) AS per_s, 2 * count(*) FILTER (WHERE status = 200) / ((max(at_ms + coalesce(wall_ms, 0)) - min(at_ms)) / 1000) AS images_per_s,
median(wall_ms) FILTER (WHERE status = 200) AS p50, quantile_disc(wall_ms, 0.95) FILTER (WHERE status = 200) AS p95 FROM r""")
def load_test_figures(spark, sf_dir):
    error = F.col("event_type") == "error"
    rows = _t(spark, sf_dir, "events").select(F.when(error, 503).otherwise(200).alias("status"), F.col("value").alias("wall_ms"), error.cast("int").alias("refused"), F.round(F.unix_micros(F.col("ts").cast("timestamp")) / 1000).cast("long").alias("at_ms"))
    return E.load_figures(rows, 2)


@query("SELECT p_partkey, p_brand FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY md5('42:' || p_partkey), p_partkey) <= 5")
def quota_sample(spark, sf_dir):
    return E.quota_sample(_t(spark, sf_dir, "part").select("p_partkey", "p_brand"), "p_brand", "p_partkey", 5)


@query("""SELECT '"' || CASE WHEN p_partkey % 3 = 0 THEN '''=' ELSE '' END || p_name || '","' || replace(p_brand, '"', '""') || '","' || p_size || '"' AS line FROM part""")
def export_lines(spark, sf_dir):
    part = _t(spark, sf_dir, "part")
    name = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("="), F.col("p_name"))).otherwise(F.col("p_name"))
    return export.csv_lines(part.select(name.alias("name"), "p_brand", "p_size"))


@query(r"""WITH t AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?s)<script.*?</script>|<style.*?</style>', '', 'g'), '<[^>]+>', chr(10), 'g') AS t FROM pages),
e AS (SELECT page_id, replace(replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', chr(160)), '&amp;', '&') AS t FROM t),
l AS (SELECT page_id, list_filter(list_transform(regexp_split_to_array(t, '\r\n|\r|\n'), lambda x: regexp_replace(x, '^[\s\x{A0}\v]+|[\s\x{A0}\v]+$', '', 'g')), lambda x: x <> '') AS l FROM e)
SELECT page_id, CAST(len(l) AS BIGINT) AS lines, md5(array_to_string(l, chr(10))) AS digest FROM l""")
def page_text_lines(spark, sf_dir):
    own = _t(spark, sf_dir, "pages").select("page_id", registry.page_lines(F.col("html")).alias("l"))
    return own.select("page_id", F.size("l").cast("long").alias("lines"), F.md5(F.array_join("l", "\n")).alias("digest"))


@query("""SELECT l_orderkey AS item_id, l_linenumber % 2 AS image_index, count(*) AS line_count, avg(CAST((CAST(l_quantity AS INT) % 8) / 8.0 AS DOUBLE)) AS mean_confidence, sum(CAST(CASE WHEN (CAST(l_quantity AS INT) % 8) / 8.0 >= 0.5 THEN (CAST(l_quantity AS INT) % 8) / 8.0 ELSE 0 END AS DOUBLE)) AS read_score, avg((CAST(l_quantity AS INT) % 8) / 8.0) >= 0.6 AS readable, avg((CAST(l_quantity AS INT) % 8) / 8.0) < 0.8 OR count(*) < 3 AS retry FROM lineitem GROUP BY ALL""")
def image_read_quality(spark, sf_dir):
    rows = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("item_id"), (F.col("l_linenumber") % 2).alias("image_index"), F.lit("x").alias("text"), ((F.col("l_quantity").cast("int") % 8) / 8.0).alias("confidence"))
    return registry.image_quality(rows)


@query("""SELECT item_key, decision, note FROM (SELECT user_id AS item_key, event_type AS decision, CAST(event_id AS VARCHAR) AS note FROM events WHERE event_id % 10 <> 0 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1)""")
def latest_decisions(spark, sf_dir):
    log = _t(spark, sf_dir, "events").select(F.col("user_id").alias("item_key"), F.col("event_type").alias("decision"), F.col("event_id").cast("string").alias("note"), F.col("event_id").alias("at"), F.when(F.col("event_id") % 10 == 0, 1).otherwise(2).alias("input_version"))
    return B.latest_decisions(log, 2)


@query(f"SELECT item_id, verdict_text AS what_to_look_at FROM (WITH {_CHECKS}, w AS (SELECT item_id, CASE WHEN w = 0 THEN ['warning: missing'] WHEN w = 1 THEN ['warning: not all capitals', 'warning: confirm bold type'] ELSE ['warning: confirm bold type'] END AS t FROM app) SELECT w.item_id, array_to_string(list_concat(coalesce((SELECT list(check_id || ': ' || replace(status, '_', ' ') ORDER BY list_position(['brand_name', 'class_type', 'alcohol_content', 'net_contents', 'bottler', 'country_of_origin', 'standard_of_fill'], check_id)) FROM c WHERE c.item_id = w.item_id AND status NOT IN ('match', 'not_checked')), []), t), '; ') AS verdict_text FROM w)")
def what_to_look_at(spark, sf_dir):
    found = compare(fixtures.applications(spark, sf_dir), fixtures.label_lines(spark, sf_dir))
    return B.look_at(found.checks, found.warning)


