"""The registered corpus queries: thin calls of the operators on whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import cut_lineage

from . import collocations, filter_audit, knn, language_id, license_scan, mixing, ngram_join, piece_codec, quality_rules, rule_ensemble, secret_scan, toxicity, url_filter
from .labelled import fold_of
from .registry import query, read

#: Rules of the URL query (host, path, verdict): fixed values.
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]

URL_SQL = """
WITH parts AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages),
rules(rule_host, rule_path, verdict) AS (VALUES
  ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
  ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
keyed AS (SELECT DISTINCT host, path FROM parts),
best AS (
  SELECT k.host, k.path, arg_max(r.rule_host || r.rule_path, length(r.rule_host || r.rule_path)) AS rule,
         arg_max(r.verdict, length(r.rule_host || r.rule_path)) AS verdict
  FROM keyed k JOIN rules r
    ON (k.host = r.rule_host OR ends_with(k.host, '.' || r.rule_host)) AND starts_with(k.path, r.rule_path)
  GROUP BY k.host, k.path)
SELECT p.page_id, p.host, p.path, b.rule, coalesce(b.verdict, 'allow') AS verdict
FROM parts p LEFT JOIN best b USING (host, path)
"""

#: Source weights of the mixing query, repeating: fixed values.
MIX_WEIGHTS = (5.0, 2.0, 1.0)


@query("op1_source_mixing")
def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words taken of every document; the word counts are stored once, texts are read once."""
    documents = read(spark, sf_dir, "documents")
    sized = cut_lineage(documents.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("text_hash")))
    mixed = mixing.mix(sized, mixing.cycled_weights(MIX_WEIGHTS), size=F.col("size"), apart=F.col("text_hash"))
    return mixed.select("doc_id", "source", *(F.col(f"{mixing.MIX}.{c}").alias(c) for c in ("size", "source_size", "target", "taken")))


@query("op2_url_filter", URL_SQL)
def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of every page URL; a URL without a rule is allowed."""
    return url_filter.judge_urls(read(spark, sf_dir, "pages"), URL_RULES)


def _held_out(folds: int, fold: int):
    return (F.coalesce(fold_of(F.col("doc_id"), folds), F.lit(-1)) == fold).alias("held_out")


@query("op3_language_id")
def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; learned from the four of five ids that are not held out."""
    documents = read(spark, sf_dir, "documents")
    model = language_id.fit_languages(documents, fold_of(F.col("key"), 5) != 0)
    return language_id.identify(documents, model).select("doc_id", _held_out(5, 0), "lang_pred", "score")


@query("op4_piece_codec")
def op4_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the SentencePiece round trip of every document."""
    return piece_codec.digests(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query("op5_license_scan")
def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and notices of every document."""
    return license_scan.scan(read(spark, sf_dir, "documents"))


@query("op6_quality_classifier")
def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document by the rule ensemble."""
    documents = read(spark, sf_dir, "documents")
    model = rule_ensemble.fit_rules(documents, read(spark, sf_dir, "labels"), "quality", fold_of(F.col("key"), 5) != 0)
    scored = rule_ensemble.score(documents, model)
    return scored.select("doc_id", _held_out(5, 0), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query("op7_quality_rules")
def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base statistics and verdict of every document; the model learns from four of five labelled ids."""
    documents = read(spark, sf_dir, "documents")
    model = quality_rules.fit_quality(documents, read(spark, sf_dir, "labels"), fold_of(F.col("key"), 5) != 0)
    return quality_rules.apply_rules(documents, model)


@query("op8_ngram_join")
def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class and number of links of every document (five words, similarity 0.8)."""
    return ngram_join.near_duplicates(read(spark, sf_dir, "documents"))


KNN_SQL = """
WITH v AS (
  SELECT vec_id, min(CAST(embedding AS DOUBLE[])) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
  GROUP BY vec_id),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.e) = len(q.e) WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM pairs QUALIFY rank <= 20
"""


@query("op9_nearest_neighbours", KNN_SQL)
def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every vector whose id is divisible by 20."""
    return knn.nearest(read(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


@query("op10_toxicity")
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document; labels are learned from three of four ids."""
    documents = read(spark, sf_dir, "documents")
    model = toxicity.fit_toxicity(documents, read(spark, sf_dir, "labels"), fold_of(F.col("key"), 4) != 2)
    scored = toxicity.score(documents, model)
    return scored.select("doc_id", _held_out(4, 2), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


COLLOCATION_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents WHERE text IS NOT NULL),
worded AS (SELECT lang, row_number() OVER () AS p, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
places AS (SELECT lang, p, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM worded),
followed AS (SELECT lang, x, lead(x) OVER (PARTITION BY p ORDER BY i) AS y, lead(x, 2) OVER (PARTITION BY p ORDER BY i) AS z FROM places),
grams AS (
  SELECT lang, 1 AS k, x AS g, count(*) AS f FROM followed GROUP BY lang, x
  UNION ALL SELECT lang, 2, x || ' ' || y, count(*) FROM followed WHERE y IS NOT NULL GROUP BY lang, x, y
  UNION ALL SELECT lang, 3, x || ' ' || y || ' ' || z, count(*) FROM followed WHERE z IS NOT NULL GROUP BY lang, x, y, z),
totals AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM grams WHERE k = 1 GROUP BY lang),
candidates AS (SELECT lang, k, g, f AS a, string_split(g, ' ') AS w FROM grams WHERE k > 1 AND f >= 10),
cuts AS (
  SELECT c.lang, c.g, c.a, c.k, j.cut, x.f AS l, y.f AS r,
         (CAST(1000000 AS HUGEINT) * c.a * c.a) // (CAST(x.f AS HUGEINT) * y.f) AS score
  FROM candidates c JOIN (SELECT unnest([1, 2]) AS cut) j ON j.cut < c.k
  JOIN grams x ON x.lang = c.lang AND x.g = array_to_string(c.w[1 : j.cut], ' ')
  JOIN grams y ON y.lang = c.lang AND y.g = array_to_string(c.w[j.cut + 1 : c.k], ' ')),
lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, cut) = 1),
longer AS (
  SELECT lang, g, max(a) AS a
  FROM (SELECT lang, array_to_string(w[1:2], ' ') AS g, a FROM candidates WHERE k = 3
        UNION ALL SELECT lang, array_to_string(w[2:3], ' ') AS g, a FROM candidates WHERE k = 3)
  GROUP BY lang, g),
kept AS (
  SELECT b.* FROM lowest b LEFT JOIN longer m ON m.lang = b.lang AND m.g = b.g
  WHERE m.a IS NULL OR 100 * m.a < 50 * b.a)
SELECT lang, CAST(row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, g) AS INTEGER) AS rank,
       g AS phrase, a, l, r, n, CAST(score AS BIGINT) AS score
FROM kept JOIN totals USING (lang) QUALIFY rank <= 2000
"""


@query("op11_collocations", COLLOCATION_SQL)
def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2,000 collocations of two and three words of every language."""
    return collocations.collocations(read(spark, sf_dir, "documents"))


@query("op12_secret_scan")
def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secret spans of every document; the field learns from windows of all documents."""
    documents = read(spark, sf_dir, "documents")
    return secret_scan.digests(documents, secret_scan.fit_secrets(documents))


AUDIT_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents),
firsts AS (SELECT text, min(doc_id) AS least_id FROM t GROUP BY text),
lab AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
  FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
marked AS (
  SELECT t.part, coalesce(l.good, 0) AS good, coalesce(l.toxic, 0) AS toxic,
         concat(CASE WHEN len(words) < 50 THEN 'A' ELSE '' END,
                CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 'B' ELSE '' END,
                CASE WHEN 100 * length(regexp_replace(t.text, '[^A-Z]', '', 'g')) > 5 * length(t.text) THEN 'C' ELSE '' END,
                CASE WHEN regexp_matches(t.text, '[#$%&*|]') THEN 'D' ELSE '' END,
                CASE WHEN t.doc_id > f.least_id THEN 'E' ELSE '' END) AS fails
  FROM t JOIN firsts f ON f.text = t.text LEFT JOIN lab l ON l.doc_id = t.doc_id),
counted AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM marked GROUP BY part, fails),
letters(f) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
orders AS (
  SELECT concat(a.f, b.f, c.f, d.f, e.f) AS filter_order
  FROM letters a JOIN letters b ON b.f <> a.f JOIN letters c ON c.f NOT IN (a.f, b.f)
  JOIN letters d ON d.f NOT IN (a.f, b.f, c.f) JOIN letters e ON e.f NOT IN (a.f, b.f, c.f, d.f)),
places AS (SELECT filter_order, CAST(s.step AS INTEGER) AS step FROM orders, (SELECT unnest(range(1, 6)) AS step) s),
judged AS (
  SELECT p.filter_order, p.step, c.part, c.n, c.good, c.toxic, c.fails,
         substr(p.filter_order, p.step, 1) AS f,
         length(translate(substr(p.filter_order, 1, p.step - 1), c.fails, '')) < p.step - 1 AS gone
  FROM places p, counted c),
summed AS (
  SELECT part, filter_order, step, f,
         sum(CASE WHEN NOT gone AND NOT contains(fails, f) THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN NOT gone AND contains(fails, f) THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN gone AND contains(fails, f) THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN fails = f THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN NOT gone AND contains(fails, f) THEN good ELSE 0 END) AS good_lost,
         sum(CASE WHEN NOT gone AND contains(fails, f) THEN toxic ELSE 0 END) AS toxic_lost
  FROM judged GROUP BY part, filter_order, step, f)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM summed
"""


@query("op13_filter_audit", AUDIT_SQL)
def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of five filters removes in every order, by source."""
    return filter_audit.audit_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
