"""The operators of this subpackage bound to the tables of a data folder."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import turn_repair, word_bpe
from lodestone.llm.byte_bpe import round_trip
from lodestone.llm.decontamination import contamination
from lodestone.llm.hard_negatives import hard_negatives
from lodestone.llm.license_scan import licences
from lodestone.llm.lm_scoring import lm_scores
from lodestone.llm.ngram_jaccard import near_duplicates
from lodestone.llm.quality_classifier import fit_quality, score_quality
from lodestone.llm.quality_rules import judge, ratios, trusted
from lodestone.llm.token_counts import token_counts
from lodestone.llm.toxicity import fit_toxicity, severities
from lodestone.llm.url_filters import url_verdicts


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


OP2_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, reach) AS (SELECT a, b FROM e UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.reach),
m AS (SELECT doc_id, min(reach) AS least FROM r GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(least, doc_id)) AS component_id FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
"""


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"), _remainder(7) == 2)


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as a file of the folder of its source and language. Documents whose first line
    speaks of a licence stand for the licence files of their folders."""
    docs = table(spark, sf_dir, "documents")
    name = F.when(F.substring_index("text", "\n", 1).rlike("(?i)licen[sc]e"), F.concat(F.lit("LICENSE-"), "doc_id")).otherwise(F.concat("doc_id", F.lit(".txt")))
    return licences(docs.select("doc_id", F.concat_ws("/", "source", "lang", name).alias("path"), "text"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return judge(docs, ratios(docs, trusted(docs, table(spark, sf_dir, "labels"))), columns=["doc_id"])


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumn("items_sha256", F.sha2(F.array_join("items", ","), 256)).drop("items")


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
sizes AS (SELECT DISTINCT least(len(w), 13) AS m FROM b WHERE len(w) > 0),
theirs AS (
  SELECT DISTINCT item, m, array_to_string(w[i : i + m - 1], ' ') AS g
  FROM (SELECT item, w, least(len(w), 13) AS m, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM b WHERE len(w) > 0)),
ours AS (
  SELECT doc_id, m, i, array_to_string(w[i : i + m - 1], ' ') AS g
  FROM (SELECT doc_id, w, m, unnest(range(1, CAST(len(w) - m + 2 AS BIGINT))) AS i FROM d, sizes WHERE len(w) >= m)),
met AS (SELECT doc_id, i, m, item FROM ours JOIN theirs USING (m, g)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + m)) AS p FROM met) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM met) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""


#: Host, path and verdict of the rules of the query (fixed values).
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return url_verdicts(table(spark, sf_dir, "pages").select("page_id", "url"), rules).drop("url")


OP8_SQL = r"""
WITH parsed AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
judged AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/'
  END AS rule FROM parsed)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict
FROM judged
"""

def _remainder(n: int):
    """crc32 of the id as text, modulo n."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_quality(docs, table(spark, sf_dir, "labels"), _remainder(5) != 0)
    scored = score_quality(docs, model, columns=["doc_id"])
    return scored.select("doc_id", F.coalesce(_remainder(5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"), _remainder(5) != 0)
    return severities(docs, model)


def op11_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", label.alias("label"), "embedding")
    return hard_negatives(rows, F.col("id") % 100 == 0)


OP12_SQL = """
WITH v AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor(256 * x)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.id AS anchor_id, v.id, v.label = a.label AS same, CAST(list_inner_product(a.e, v.e) AS BIGINT) AS score FROM v a, v WHERE a.id % 100 = 0 AND v.id <> a.id),
p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score
  FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS n FROM s WHERE same) WHERE n <= 5),
r AS (
  SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id) AS INT) AS rank, id AS negative_id, positive_score, score AS negative_score
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score)
SELECT * FROM r WHERE rank <= 5
"""


def op13_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_repair.repair(turn_repair.damaged(table(spark, sf_dir, "conversations")), there="there")


#: A checksum by a table of 256 remainders, the damage, and the cheapest edits turn by turn.
OP13_SQL = r"""
WITH RECURSIVE bits(n, c, k) AS (
  SELECT range, range, 0 FROM range(256) UNION ALL
  SELECT n, CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY n) AS t FROM bits WHERE k = 8),
raw AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
kinds AS (
  SELECT * EXCLUDE k, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, length(k) + 1), lambda i: CAST(ascii(substr(k, i, 1)) AS BIGINT))),
    lambda c, b: xor(t[CAST(xor(c, b) & 255 AS BIGINT) + 1], c >> 8))) % 20 AS kind FROM raw, crc),
d AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM kinds, range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS tail FROM d),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again FROM o),
f AS (
  SELECT conv_id, turn, role, text, i, left(role, 1) AS r, tail = '' AS blank, tail <> '' AND again AS twice, tail <> '' AND NOT again AND tail NOT IN ('.', '!', '?') AS cut,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM n),
w(conv_id, i, n, s, u, a) AS (
  SELECT DISTINCT conv_id, 0, {'c': 0, 'e': ''}, {'c': 1000000000, 'e': ''}, {'c': 3, 'e': 'I'}, {'c': 6, 'e': 'II'} FROM f UNION ALL
  SELECT conv_id, i, n, s, least(u, {'c': n.c + 3, 'e': n.e || 'I'}, {'c': s.c + 3, 'e': s.e || 'I'}, {'c': a.c + 3, 'e': a.e || 'I'}),
    least(a, {'c': u.c + 3, 'e': u.e || 'I'}, {'c': n.c + 6, 'e': n.e || 'II'}, {'c': s.c + 6, 'e': s.e || 'II'})
  FROM (
    SELECT w.conv_id, f.i, {'c': n.c + 4, 'e': n.e || 'D'} AS n,
      least({'c': s.c + 4, 'e': s.e || 'D'}, {'c': CASE WHEN r = 's' AND NOT (blank OR twice) THEN n.c + 3 * CAST(cut AS INT) ELSE 1000000000 END, 'e': n.e || 'K'}) AS s,
      CASE WHEN blank OR twice THEN {'c': u.c + 4, 'e': u.e || 'D'} ELSE least({'c': u.c + 4, 'e': u.e || 'D'}, {'c': n.c + 3 * CAST(cut AS INT) + 3 * CAST(r <> 'u' AS INT), 'e': n.e || CASE WHEN r = 'u' THEN 'K' ELSE 'R' END},
        {'c': s.c + 3 * CAST(cut AS INT) + 3 * CAST(r <> 'u' AS INT), 'e': s.e || CASE WHEN r = 'u' THEN 'K' ELSE 'R' END}, {'c': a.c + 3 * CAST(cut AS INT) + 3 * CAST(r <> 'u' AS INT), 'e': a.e || CASE WHEN r = 'u' THEN 'K' ELSE 'R' END}) END AS u,
      CASE WHEN blank OR twice THEN {'c': a.c + 4, 'e': a.e || 'D'} ELSE least({'c': a.c + 4, 'e': a.e || 'D'}, {'c': u.c + 3 * CAST(cut AS INT) + 3 * CAST(r <> 'a' AS INT), 'e': u.e || CASE WHEN r = 'a' THEN 'K' ELSE 'R' END}) END AS a
    FROM w JOIN f ON w.conv_id IS NOT DISTINCT FROM f.conv_id AND f.i = w.i + 1)),
best AS (SELECT conv_id, least(n, a).c AS cost, least(n, a).e AS audit FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) AS last FROM w) WHERE last = 1),
edits AS (SELECT conv_id, p, audit, substr(audit, p, 1) AS edit, length(replace(left(audit, p), 'I', '')) AS i, length(replace(left(audit, p), 'D', '')) AS place FROM (SELECT *, unnest(range(1, length(audit) + 1)) AS p FROM best)),
kept AS (SELECT e.*, f.role, f.text, max(CASE WHEN place = 1 AND edit = 'K' AND f.r = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY e.conv_id) AS ahead
  FROM edits e LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM e.conv_id AND f.i = e.i AND edit <> 'I' WHERE edit <> 'D'),
lines AS (
  SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (place - ahead) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY place) AS whole
  FROM kept GROUP BY conv_id),
sums AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, sum(CAST(blank AS BIGINT)) AS blank, sum(CAST(twice AS BIGINT)) AS duplicate, sum(CAST(cut AS BIGINT)) AS truncated,
    sum(CASE WHEN before || r NOT IN ('su', 'ua', 'au') THEN 1 ELSE 0 END) AS illegal FROM f GROUP BY conv_id),
every AS (SELECT DISTINCT conv_id FROM conversations)
SELECT e.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
  CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(cost, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM every e LEFT JOIN sums ON sums.conv_id IS NOT DISTINCT FROM e.conv_id LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM e.conv_id LEFT JOIN lines ON lines.conv_id IS NOT DISTINCT FROM e.conv_id
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_ngram_jaccard": op2_ngram_jaccard,
    "op3_lm_scoring": op3_lm_scoring,
    "op4_license_scan": op4_license_scan,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_quality_rules": op6_quality_rules,
    "op7_decontamination": op7_decontamination,
    "op8_url_filters": op8_url_filters,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_toxicity": op10_toxicity,
    "op11_word_bpe": op11_word_bpe,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_turn_repair": op13_turn_repair,
}
ORACLES: dict[str, str] = {"op2_ngram_jaccard": OP2_SQL, "op7_decontamination": OP7_SQL, "op8_url_filters": OP8_SQL, "op12_hard_negatives": OP12_SQL, "op13_turn_repair": OP13_SQL}
