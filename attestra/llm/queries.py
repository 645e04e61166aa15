"""The registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat as _chat
from . import decontaminate as _decontaminate
from . import langid as _langid
from . import license as _license
from . import lm as _lm
from . import media as _media
from . import mixing as _mixing
from . import neardup as _neardup
from . import quality as _quality
from . import resample as _resample
from . import tokenfiles as _tokenfiles
from . import tokens as _tokens
from . import whiten as _whiten
from .common import table, temporary_folder


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _decontaminate.contaminated_spans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lm.score(table(spark, sf_dir, "documents"))


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    found = _langid.identify(documents, _langid.train(documents))
    return found.select("doc_id", _langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "bits_per_byte")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixing.mix(table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tokens.context_limits(_tokens.length_histogram(table(spark, sf_dir, "documents")))


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = _chat.calls_of(table(spark, sf_dir, "conversations"))
    linked = _chat.link_tool_calls(calls, results, _chat.reply_schema(spark))
    return linked.withColumn("errors", F.array_join("errors", ";"))


def op6_chat_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    return _chat.every_row(*_chat.calls_of(conversations), _chat.rest_of(conversations))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _media.text_media(table(spark, sf_dir, "documents"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _license.scan_licenses(table(spark, sf_dir, "documents"))


def op10_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _neardup.near_duplicates(table(spark, sf_dir, "documents"), shingle=4).drop("set_digest")


def op11_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = temporary_folder(spark, "tokens")
    _tokenfiles.write_tokens(table(spark, sf_dir, "documents"), folder)
    return _tokenfiles.read_tokens(spark, folder, with_ids=False)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _whiten.whiten(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_lm_score": op2_lm_score,
    "op3_langid": op3_langid,
    "op4_mixing": op4_mixing,
    "op5_token_counts": op5_token_counts,
    "op6_chat": op6_chat,
    "op6_chat_rows": op6_chat_rows,
    "op7_quality": op7_quality,
    "op8_media": op8_media,
    "op9_licenses": op9_licenses,
    "op10_neardup": op10_neardup,
    "op11_resample": op11_resample,
    "op12_token_files": op12_token_files,
    "op13_whitening": op13_whitening,
    "pipeline": pipeline,
}

_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

SQL: dict[str, str] = {
    "op1_decontaminate": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
win AS (SELECT DISTINCT item, list_slice(w, s, s + 12) AS win
        FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS s FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT len(win) AS n FROM win),
pos AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, lens WHERE len(w) >= n),
hit AS (SELECT doc_id, p, n, item FROM pos JOIN win ON list_slice(pos.w, p, p + n - 1) = win.win),
covered AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items.items, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(d.w), false) AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op4_mixing": r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
                  CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h FROM documents),
s AS (SELECT source, sum(size) AS source_size, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM d GROUP BY source),
k AS (SELECT a.source, a.w, a.source_size,
             (SELECT sum(source_size) FROM s) - coalesce(sum(3 * b.source_size), 0) AS rest_size, (SELECT sum(w) FROM s) - coalesce(sum(b.w), 0) AS rest_w
      FROM s a LEFT JOIN s b ON (3 * b.source_size / b.w, coalesce(b.source, chr(1114109))) < (3 * a.source_size / a.w, coalesce(a.source, chr(1114109)))
      GROUP BY ALL),
lam AS (SELECT rest_size, rest_w FROM k WHERE 3.0 * source_size * rest_w >= 1.0 * rest_size * w ORDER BY 3 * source_size / w, source LIMIT 1),
t AS (SELECT source, CAST(source_size AS BIGINT) AS source_size,
             CASE WHEN 3.0 * source_size * lam.rest_w < 1.0 * lam.rest_size * w THEN CAST(3 * source_size AS DOUBLE)
                  ELSE CAST(lam.rest_size * w AS DOUBLE) / CAST(lam.rest_w AS DOUBLE) END AS target FROM s, lam),
r AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS times FROM t),
g AS (SELECT source, h, sum(size) AS s, sum(sum(size)) OVER (PARTITION BY source ORDER BY h) AS upto FROM d GROUP BY source, h),
c AS (SELECT g.source, g.h, r.source_size, r.target, r.times,
             upto <= target - times * r.source_size OR (upto - s < target - times * r.source_size AND upto - (target - times * r.source_size) < (target - times * r.source_size) - (upto - s)) AS more
      FROM g JOIN r ON g.source IS NOT DISTINCT FROM r.source)
SELECT d.doc_id, d.size, c.source_size, c.target, CAST(d.size * (c.times + CASE WHEN c.more THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN c ON d.source IS NOT DISTINCT FROM c.source AND d.h = c.h""",
    "op10_neardup": r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, s, s + 3), ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 0) + 2)) AS s FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM met JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= 80 * (x.n + y.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, min(reach.b) AS component_id, min(reach.b) = d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN reach ON reach.a = d.doc_id GROUP BY d.doc_id, n.n""",
    "op6_chat": r"""
WITH RECURSIVE c AS (SELECT conv_id, turn, min(text) AS text, count(*) AS n_calls FROM conversations WHERE role = 'user' AND conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY ALL),
r AS (SELECT conv_id, turn - 1 AS turn, min(text) AS content, count(*) AS n_results FROM conversations WHERE role = 'assistant' AND conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY ALL),
lev AS (SELECT conv_id, turn, 0 AS level FROM c WHERE (conv_id, turn - 2) NOT IN (SELECT (conv_id, turn) FROM c)
        UNION ALL SELECT c.conv_id, c.turn, lev.level + 1 FROM lev JOIN c ON c.conv_id = lev.conv_id AND c.turn = lev.turn + 2),
j AS (SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.turn, r.turn) AS key_turn, c.turn AS c_turn, c.text, c.n_calls, r.n_results, r.content, r.turn AS r_turn
      FROM c FULL JOIN r ON c.conv_id = r.conv_id AND c.turn = r.turn)
SELECT j.conv_id, 't' || CAST(key_turn AS VARCHAR) AS call_id, CAST(coalesce(c_turn, r_turn + 1) AS BIGINT) AS turn, CASE WHEN c_turn IS NOT NULL THEN 'reply' END AS name,
       CASE WHEN c_turn IS NOT NULL THEN CAST(lev.level AS BIGINT) END AS level, CAST(coalesce(n_calls, 0) AS BIGINT) AS n_calls, CAST(coalesce(n_results, 0) AS BIGINT) AS n_results,
       CAST(CASE WHEN c_turn IS NOT NULL AND lev.level = 0 THEN 1 ELSE 0 END AS BIGINT) AS n_missing,
       CASE WHEN c_turn IS NULL THEN 'orphan' WHEN n_results IS NULL THEN 'unanswered' ELSE 'linked' END AS status,
       CASE WHEN c_turn IS NOT NULL AND text IS NULL THEN 'text: missing' ELSE '' END AS errors, c_turn IS NOT NULL AND text IS NOT NULL AS valid,
       CASE WHEN c_turn IS NOT NULL THEN '{"arguments":{' || coalesce('"text":' || CAST(to_json(text) AS VARCHAR) || ',', '') || '"turn":' || CAST(c_turn AS VARCHAR) || '},"id":"t' || CAST(c_turn AS VARCHAR) || '","name":"reply"' || coalesce(',"result":' || CAST(to_json(content) AS VARCHAR), '') || '}' END AS message
FROM j LEFT JOIN lev ON lev.conv_id = j.conv_id AND lev.turn = j.c_turn""",
    "op6_chat_rows": r"""
WITH c AS (SELECT conv_id, turn, '{' || coalesce('"text":' || CAST(to_json(text) AS VARCHAR) || ',', '') || '"turn":' || CAST(turn AS VARCHAR) || '}' AS arguments FROM conversations WHERE role = 'user' AND conv_id IS NOT NULL AND turn IS NOT NULL),
r AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id, turn ORDER BY text NULLS FIRST) AS place FROM conversations WHERE role = 'assistant' AND conv_id IS NOT NULL AND turn IS NOT NULL)
SELECT conv_id, turn, 't' || CAST(turn AS VARCHAR) AS call_id, CASE row_number() OVER (PARTITION BY conv_id, turn ORDER BY arguments) WHEN 1 THEN 'call' ELSE 'further call' END AS status,
       '{"arguments":' || arguments || ',"id":"t' || CAST(turn AS VARCHAR) || '","name":"reply"}' AS message FROM c
UNION ALL
SELECT r.conv_id, r.turn, 't' || CAST(r.turn - 1 AS VARCHAR), CASE WHEN k.turn IS NULL THEN 'orphan' WHEN place = 1 THEN 'result' ELSE 'further result' END,
       '{"id":"t' || CAST(r.turn - 1 AS VARCHAR) || '"' || coalesce(',"result":' || CAST(to_json(text) AS VARCHAR), '') || '}'
FROM r LEFT JOIN (SELECT DISTINCT conv_id, turn FROM c) k ON k.conv_id = r.conv_id AND k.turn = r.turn - 1
UNION ALL
SELECT conv_id, turn, NULL, CASE WHEN conv_id IS NULL OR turn IS NULL THEN 'without key' ELSE 'other role' END, '{' || concat_ws(',', '"content":' || CAST(to_json(text) AS VARCHAR), '"role":' || CAST(to_json(role) AS VARCHAR)) || '}'
FROM conversations WHERE conv_id IS NULL OR turn IS NULL OR role IS NULL OR role NOT IN ('user', 'assistant')""",
    "op11_resample": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents), b AS (SELECT {_WORDS} AS w FROM benchmark),
tab AS (SELECT list_transform(range(256), lambda i: list_reduce([i] || [0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab),
f AS (SELECT r, unnest(w) AS w FROM d), g AS (SELECT unnest(w) AS w FROM b),
crc AS (SELECT w, xor(list_reduce([4294967295] || list_transform(range(length(hex(w)) // 2), lambda i: CAST('0x' || substr(hex(w), 2 * i + 1, 2) AS BIGINT)), lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295) % 10000 AS bucket
        FROM (SELECT w FROM f UNION SELECT w FROM g), tab),
s AS (SELECT bucket, count(*) AS s, sum(count(*)) OVER () AS all_s FROM f JOIN crc USING (w) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM g JOIN crc USING (w) GROUP BY bucket),
gains AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (all_s + 10000)::DOUBLE / ((s + 1)::DOUBLE * ((SELECT count(*) FROM g) + 10000)::DOUBLE))) AS BIGINT) AS gain FROM s LEFT JOIN t USING (bucket)),
weighed AS (SELECT r, count(*) AS n, sum(gain) AS weight FROM f JOIN crc USING (w) JOIN gains USING (bucket) GROUP BY r),
scored AS (SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
           CAST(coalesce(weight, 0) AS BIGINT) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM d LEFT JOIN weighed USING (r)),
placed AS (SELECT *, row_number() OVER (ORDER BY n_features >= 20 DESC, score DESC, doc_id NULLS LAST) AS place, count(*) FILTER (n_features >= 20) OVER () AS eligible FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= 10 * eligible // 100 THEN place END AS rank FROM placed""",
}
