"""Registered queries of the corpus operators: thin digests of what the operators return."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxweave.llm import bpe, decontam, html, quality, secrets, simhash, tokenfile, topk, urlfilter, warc
from fluxweave.llm.common import table

QUERIES = {}
ORACLES: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pretoken_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


@query
def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every document; doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return bpe.round_trip(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken"), pretoken_pattern())


@query
def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of 3-word shingles and the components of links within 3 bits."""
    found = simhash.groups(simhash.fingerprints(table(spark, sf_dir, "documents"), 3, 64), simhash.EXACT_64)
    pairs = [F.substring(F.hex("fp"), at, 2) for at in range(15, 0, -2)]  # highest byte first
    return found.select("doc_id", F.lower(F.concat(*pairs)).alias("fingerprint"), "component_id")


@query
def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files of every document, written and read back: doc_id, start, n_tokens, ids_crc32."""
    found = tokenfile.round_trip(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))
    return found.select(F.col("id").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query
def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five highest inner products of every query vector."""
    return topk.top_k(table(spark, sf_dir, "embeddings"), 5, 50, 256.0)


ORACLES["op3_topk"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND list_count(embedding) = len(embedding)
    AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, d.vec_id, list_inner_product(q.v, d.v)::BIGINT AS score
  FROM v q JOIN v d ON q.vec_id % 50 = 0 AND q.vec_id <> d.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
"""

URL_RULES = [urlfilter.Rule("block", "net", "/"), urlfilter.Rule("allow", "example.net", "/en/"), urlfilter.Rule("block", "example.com", "/de/"), urlfilter.Rule("allow", "org", "/fr/")]


@query
def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page's URL."""
    return urlfilter.judge(table(spark, sf_dir, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def _term_sql(terms, column: str) -> str:
    tests = [f"regexp_matches({column}, '(^|[^[:alnum:]]){t}($|[^[:alnum:]])')::INT" for t in terms]
    return " + ".join(tests)


ORACLES["op8_url_filter"] = f"""
WITH p AS (
  SELECT page_id, lower(coalesce(url, '')) AS u,
    CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (
  SELECT page_id, u, lower(regexp_extract(rest, '^[^/?#]*')) AS host,
    regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM p),
r AS (
  SELECT *, CASE
    WHEN regexp_matches(host, '(^|[.])example[.]net$') AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN regexp_matches(host, '(^|[.])example[.]com$') AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN regexp_matches(host, '(^|[.])org$') AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN regexp_matches(host, '(^|[.])net$') AND starts_with(path, '/') THEN 'net/' END AS rule,
    ({_term_sql(urlfilter.STRICT, "u")} + {_term_sql(urlfilter.HOST, "host")}) AS strict,
    ({_term_sql(urlfilter.SOFT + urlfilter.HOST, "u")}) AS soft FROM h)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN strict > 0 OR soft >= 2 THEN 'block' ELSE 'allow' END AS verdict FROM r
"""


@query
def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and places of secrets in every document."""
    found = secrets.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans")


@query
def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A WARC record for every page, written and read back."""
    return warc.round_trip(table(spark, sf_dir, "pages"), 0).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLES["op5_warc"] = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
d AS (
  SELECT *, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (((('0x' || substr(h, (i // 4 * 5 + 1)::INT, 5))::BIGINT >> ((3 - i % 4) * 5)::INT) & 31) + 1)::INT, 1)), '') AS payload_digest,
    max(page_id) OVER (PARTITION BY h, payload_bytes) AS top FROM p)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
  CASE WHEN top = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN top <> page_id THEN top END AS refers_to FROM d
"""


@query
def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html.extract(table(spark, sf_dir, "pages"))


def held_out(doc_id):
    """Rows that no fitting may see."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def quality_model(spark: SparkSession, sf_dir: str) -> quality.Model:
    labels = table(spark, sf_dir, "labels")
    return quality.train(table(spark, sf_dir, "documents"), labels.where(~held_out("doc_id")))


QUALITY_LEAST = 0.7


@query
def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of every document, learnt from three quarters of the labels."""
    found = quality.score(table(spark, sf_dir, "documents"), quality_model(spark, sf_dir))
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= QUALITY_LEAST).cast("int").alias("predicted"))


@query
def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold passages of benchmark items, with scores and places."""
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
