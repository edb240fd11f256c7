"""The registered queries of this package, one ``opN_<name>`` for each operator.

Each query applies its operator to the whole intended table and derives the
contract's columns from what the operator returns.  ``SQL`` holds the DuckDB
twins of those that SQL can express.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txnwatch.session import checkpoint_dir

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@query
def op9_minhash_near_dedup(spark, sf_dir):
    """Components of documents whose three-word shingles agree to 85 %."""
    from txnwatch.llm.minhash import near_duplicates
    found = near_duplicates(table(spark, sf_dir, "documents"), shingle=3, num=85, den=100)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


@query
def op2_benchmark_decontamination(spark, sf_dir):
    """Words of documents inside any ten-word window of a benchmark item."""
    from txnwatch.llm.decontaminate import decontaminate
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), clean=False)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


@query
def op4_bpe_encoding(spark, sf_dir):
    """Token ids of whole texts and the texts that they decode to, as digests."""
    import public_tokenizers
    from txnwatch.llm.bpe import encode_decode
    found = encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), ids=False)
    return found.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def toxicity_fold(ids):
    """Whether a document is held out of the fit: crc32 of its id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(ids.cast("string")) % 4 == 2, F.lit(False))


@query
def op7_toxicity(spark, sf_dir):
    """Toxicity scores of documents, learned from the labels of three folds of four."""
    from txnwatch.llm import toxicity
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.filter(~toxicity_fold(F.col("doc_id"))))
    found = toxicity.score(docs, model)
    return found.select("doc_id", toxicity_fold(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query
def op1_line_dedup(spark, sf_dir):
    """Documents without the later occurrences of repeated three-line windows."""
    from txnwatch.llm.line_dedup import dedup_lines
    found = dedup_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), F.col("clean_text").alias("text"))


SQL["op1_line_dedup"] = r"""
WITH docs AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
grams AS (
  SELECT doc_id, i AS p, lines[i + 1] || chr(10) || lines[i + 2] || chr(10) || lines[i + 3] AS w
  FROM (SELECT doc_id, lines, unnest(range(0, len(lines) - 2)) AS i FROM docs WHERE text IS NOT NULL AND len(lines) >= 3)),
later AS (
  SELECT doc_id, p FROM (SELECT *, row_number() OVER (PARTITION BY w ORDER BY doc_id NULLS FIRST, p) AS n FROM grams WHERE regexp_matches(w, '[^\s]'))
  WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, p + k AS p FROM later, (SELECT unnest(range(0, 3)) AS k)),
kept AS (
  SELECT d.doc_id, count(g.p) AS n_removed, string_agg(CASE WHEN g.p IS NULL THEN d.l END, chr(10) ORDER BY d.p) AS text
  FROM (SELECT doc_id, unnest(lines) AS l, unnest(range(0, len(lines))) AS p FROM docs WHERE text IS NOT NULL) d
  LEFT JOIN gone g ON g.doc_id = d.doc_id AND g.p = d.p GROUP BY d.doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN 0 ELSE len(d.lines) END AS n_lines, coalesce(k.n_removed, 0) AS n_removed,
  CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text
FROM docs d LEFT JOIN kept k ON k.doc_id = d.doc_id
"""


@query
def op8_language_id(spark, sf_dir):
    """Languages of documents, learned from four folds of five."""
    from txnwatch.llm import language_id
    docs = table(spark, sf_dir, "documents")
    fold = F.crc32(F.col("doc_id").cast("string")) % 5
    profiles = language_id.fit(docs.filter(fold != 0))
    found = language_id.predict(docs, profiles)
    return found.select("doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")


@query
def op6_warc(spark, sf_dir):
    """Pages written to WARC archives in the shared folder, and what is read back."""
    from txnwatch.llm import warc
    path = f"{checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"
    warc.write_archive(warc.with_revisits(table(spark, sf_dir, "pages")), path)
    found = warc.read_archive(spark, path, payload=False, verify=True)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op10_embedding_near_dedup(spark, sf_dir):
    """Links and components of embeddings with a cosine of 0.95 or more."""
    from txnwatch.llm.embedding_dedup import near_vectors
    return near_vectors(table(spark, sf_dir, "embeddings"), threshold=0.95)


#: The contract's rules.
URL_RULES = "VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')"


@query
def op3_url_filter(spark, sf_dir):
    """Verdicts on the URLs of pages."""
    from txnwatch.llm.url_filter import judge_urls
    rules = spark.sql(f"SELECT * FROM ({URL_RULES}) AS rules(host, path, verdict)")
    return judge_urls(table(spark, sf_dir, "pages"), rules).select("page_id", "host", "path", "rule", "verdict")


SQL["op3_url_filter"] = f"WITH rules(host, path, verdict) AS ({URL_RULES})," + r"""
rest AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
parts AS (
  SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(r, length(h) + 1), '^[^?#]*', 0) AS path
  FROM (SELECT page_id, coalesce(r, '') AS r, regexp_extract(coalesce(r, ''), '^[^/?#]*', 0) AS h FROM rest))
SELECT p.page_id, p.host, p.path,
  (SELECT arg_max(r.host || r.path, length(r.host || r.path) * 1000 + length(r.host)) FROM rules r
   WHERE (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)) AS rule,
  coalesce((SELECT arg_max(r.verdict, length(r.host || r.path) * 1000 + length(r.host)) FROM rules r
   WHERE (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)), 'allow') AS verdict
FROM parts p
"""


@query
def op5_license_scan(spark, sf_dir):
    """Licence families that documents carry notices of."""
    from txnwatch.llm import licenses
    docs = table(spark, sf_dir, "documents")
    found = licenses.scan(docs, licenses.fit(docs))
    return found.select("doc_id", "n_paragraphs", F.size("notices").cast("long").alias("n_notices"), F.array_join("licenses", ",").alias("licenses"))


@query
def op11_hard_negatives(spark, sf_dir):
    """Hard negatives of every hundredth embedding, with the contract's relabelled rows."""
    from txnwatch.llm.hard_negatives import hard_negatives
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    found = hard_negatives(rows.withColumn("label", label), F.col("vec_id") % 100 == 0)
    long = lambda c: F.col(c).cast("long").alias(c)
    return found.select(long("anchor_id"), long("positive_id"), F.col("rank").cast("int").alias("rank"), long("negative_id"), "positive_score", "negative_score")


SQL["op11_hard_negatives"] = """
WITH x AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda c: floor(256 * c::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
    list_sum(list_transform(list_zip(a.v, b.v), lambda c: c[1] * c[2]))::BIGINT AS score
  FROM x a JOIN x b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT p.anchor_id, p.positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id)::INTEGER AS rank,
  s.other_id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id) <= 10
"""


def quality_fold(ids):
    """Whether a document is held out of the fit: crc32 of its id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(ids.cast("string")) % 3 == 1, F.lit(False))


@query
def op12_quality_classifier(spark, sf_dir):
    """Quality scores of documents, learned from the labels of two folds of three."""
    from txnwatch.llm import quality
    labels = table(spark, sf_dir, "labels").filter(~quality_fold(F.col("doc_id")))
    found = quality.classify(table(spark, sf_dir, "documents"), labels)
    return found.select("doc_id", quality_fold(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op13_importance_resampling(spark, sf_dir):
    """A tenth of the documents, drawn towards the word distribution of the benchmark."""
    from txnwatch.llm.importance import importance_resample
    found = importance_resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), "n_features", "weight", "score", "rank")


SQL["op13_importance_resampling"] = r"""
WITH polynomial AS (
  SELECT list(c ORDER BY i) AS steps FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda a, k: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END) AS c
    FROM (SELECT unnest(range(256)) AS i))),
words AS (
  SELECT 'd' AS side, doc_id AS id, rowid AS r, n, w FROM (
    SELECT doc_id, row_number() OVER () AS rowid, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS all_words
    FROM documents) , LATERAL (SELECT len(all_words) AS n, unnest(CASE WHEN len(all_words) = 0 THEN [NULL] ELSE all_words END) AS w)
  UNION ALL
  SELECT 'b', NULL, NULL, NULL, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'))
  FROM benchmark),
coded AS (
  SELECT w, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(strlen(w)), lambda k: ('0x' || substr(hex(encode(w)), (2 * k + 1)::INT, 2))::BIGINT)),
      lambda a, b: xor(a // 256, steps[(xor(a, b) % 256) + 1])), 4294967295) % 10000 AS bucket
  FROM (SELECT DISTINCT w FROM words WHERE w IS NOT NULL), polynomial),
counts AS (
  SELECT g.bucket, coalesce(s, 0)::DOUBLE AS s, coalesce(t, 0)::DOUBLE AS t FROM (SELECT unnest(range(10000)) AS bucket) g
  LEFT JOIN (SELECT bucket, count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 'b') AS t FROM words JOIN coded USING (w) GROUP BY bucket) c ON c.bucket = g.bucket),
gain AS (
  SELECT bucket, floor(1000 * ln((t + 1) * (sum(s) OVER () + 10000) / ((s + 1) * (sum(t) OVER () + 10000))))::BIGINT AS g FROM counts),
docs AS (
  SELECT id AS doc_id, r, any_value(n) AS n_features, CASE WHEN any_value(n) = 0 THEN 0 ELSE floor(sum(g)::DOUBLE / any_value(n)) END::BIGINT AS weight
  FROM words LEFT JOIN coded USING (w) LEFT JOIN gain USING (bucket) WHERE side = 'd' GROUP BY id, r),
scored AS (
  SELECT *, weight + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM docs),
placed AS (
  SELECT *, CASE WHEN n_features >= 20 THEN row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) END AS place,
    (10 * count(*) FILTER (n_features >= 20) OVER ()) // 100 AS drawn FROM scored)
SELECT doc_id, n_features::BIGINT AS n_features, weight, score, CASE WHEN place <= drawn THEN place END::BIGINT AS rank FROM placed
"""
