"""The thin queries over the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, html_text, langid, licenses, packing, prefix_trie, sharding, simhash, toxicity, url_filter, vector_search, warc, whitening
from .common import crc_mod, read

URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pages row by its URL: (page_id, host, path, rule, verdict). Null URLs and those without :// have an empty
    host and path and are allowed; null pages give no links. Of equally long rules an allow wins. Repeated rows are judged
    alike and stay; URLs and pages of any length are read whole; no pages, no rows. Other columns are not read."""
    pages = read(spark, sf_dir, "pages").select("page_id", "url", "html")
    rules = spark.createDataFrame(URL_RULES, "rule_host string, rule_path string, action string")
    judged = url_filter.judge_urls(pages.select("page_id", "url"), rules, url_filter.alias_edges(pages))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every documents row: (doc_id, fingerprint, component_id). Null and empty texts have fingerprint zero and are
    linked like any other. Repeated rows stay; of a component the least doc_id that isn't null is the name. Texts of any
    length are read whole; no documents, no rows. Other columns are not read."""
    return simhash.near_duplicates(read(spark, sf_dir, "documents"), radius=4, width=4)


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every documents row: (doc_id, held_out, lang_pred, score). Null and empty texts and those without letters are
    und, score 0; a null doc_id counts as an empty text for the fold; of equally likely languages the first by name is
    taken. Repeated rows stay and are judged alike; texts are read whole; without learnable rows all are und; no
    documents, no rows. Other columns are not read."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = crc_mod("doc_id", 3) == 1
    model = langid.train(docs, ~held)
    return langid.identify(docs.select("doc_id", held.alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a piece of each documents row. Null and empty texts are one token (the end mark); a text over the
    largest length is cut into pieces. Repeated rows are packed each; of equally full bins the first opened takes a
    piece; no documents, no rows. Other columns are not read."""
    return packing.pack_documents(read(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every documents row: (doc_id, held_out, score, predicted, spans). Null and empty texts are scored as texts
    without words; of several labels of an id the largest counts; a null doc_id counts as an empty text for the fold.
    Repeated rows stay and are scored alike; texts are read whole; without labels of both classes all scores are 0; no
    documents, no rows. Other columns are not read."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    held = crc_mod("doc_id", 5) == 0
    model = toxicity.train(docs, read(spark, sf_dir, "labels"), ~held)
    return toxicity.score(docs.select("doc_id", held.alias("held_out"), "text"), model).select("doc_id", "held_out", "score", "predicted", "spans")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every documents row with its shard and slot under the law rows: counts of shards at most one apart. A null text
    has size 1 and the checksum of nothing; null ids are keys like others; repeated rows are placed each, and which of
    equal rows has which slot is open. No documents, no rows. Other columns are not read."""
    docs = read(spark, sf_dir, "documents")
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    rows = docs.select("doc_id", size.alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"))
    out = sharding.assign(rows, ["doc_id", "text_crc32"], 8)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pages row: (page_id, url, text, n_chars). Null and empty pages have an empty text; pages are read whole;
    repeated rows stay and are read alike; no pages, no rows. Other columns are not read."""
    return html_text.extract(read(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, rank, vec_id, score) for rows whose vec_id is divisible by 100, against all rows. Vectors that are
    null, empty or hold null or non-finite components, and null ids, take no part; ties go to the smaller id; repeated
    rows are candidates each, equal query rows count once; no vectors, no rows. Other columns are not read."""
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return vector_search.search(vectors, vectors.filter("vec_id % 100 = 0"), k=10, scale=1024)


def op9_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, item_id, similarity, first_word, n_words) of every documents row that holds an item. Null and empty
    texts and items hold and are nothing; of equally similar windows the first is named; repeated rows and items each
    give theirs; texts are read whole; no documents or items, no rows. Other columns are not read."""
    return decontam.find_leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every documents row with its words, base phrases, labels and score. Null and empty texts have no words, no
    labels and score 0; of overlapping detections the surer, then the longer, then the earlier is kept; repeated rows
    stay and are scanned alike; texts are read whole; no documents, no rows. Other columns are not read."""
    return licenses.scan(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of every embeddings row and component up
    to 16. Vectors that are null, empty or hold null or non-finite components take no part; repeated rows and null ids
    get their results each, repeated vectors count once in the fit; components beyond 2^61 in size are cut to that;
    vectors of each length are whitened among themselves; directions without variance are no components; no vectors, no
    rows. Other columns are not read."""
    out = whitening.whiten(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"), scale=64, most=16)
    return out.select("vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error")


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) as read back from archives of every pages row.
    Null and empty pages have an empty payload; null ids come last among equal payloads; of repeated rows of one id one
    is the response; pages are stored whole; no pages, no records. Other columns are not read."""
    pages = read(spark, sf_dir, "pages").select("page_id", "url", "html")
    archives = warc.write_archives(pages, warc.archive_folder(spark))
    return warc.read_archives(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a node of the trie of rebuilt conversations: (conv_id, depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256). Null roles and texts are empty; null turns come first, equal ones go by role
    and text; repeated rows are turns each; rows without a conversation take no part; texts are read whole; no
    conversations, no nodes. Other columns are not read."""
    return prefix_trie.build_trie(*prefix_trie.share_heads(prefix_trie.order_turns(read(spark, sf_dir, "conversations"))))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_url_filter, op2_simhash, op3_langid, op4_packing, op5_toxicity, op6_sharding, op7_html, op8_topk, op9_decontam, op10_licenses, op11_whitening, op12_warc, op13_prefix_trie)}


_HOST = r"translate(regexp_extract({0}, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PATH = r"regexp_extract({0}, '(?s)^.*?://[^/?#]*([^?#]*)', 1)"
_ATTR = r"""trim(regexp_extract(tag, '(?is)[\s"'']{0}\s*=\s*("[^"]*"|''[^'']*''|[^\s"''>]+)', 1), '"''')"""
_RULE_ROWS = ", ".join(f"('{h}', '{p}', '{a}')" for h, p, a in URL_RULES)

OP1_SQL = rf"""
WITH RECURSIVE rules(h, p, a) AS (VALUES {_RULE_ROWS}),
parsed AS (SELECT page_id, html, coalesce({_HOST.format("url")}, '') AS host, coalesce({_PATH.format("url")}, '') AS path FROM pages),
tags AS (
  SELECT host, path, unnest(regexp_extract_all(regexp_replace(html, '(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<title\b.*?</title\s*>|<textarea\b.*?</textarea\s*>', ' ', 'g'), '(?is)<((?:link|meta)\s(?:[^>"'']|"[^"]*"|''[^'']*'')*)>', 1)) AS tag
  FROM parsed WHERE host <> '' AND html IS NOT NULL),
attrs AS (
  SELECT host, path, lower(tag[1:4]) AS kind, {_ATTR.format("rel")} AS rel, {_ATTR.format("href")} AS href, {_ATTR.format("http-equiv")} AS equiv, {_ATTR.format("content")} AS content FROM tags),
links AS (
  SELECT host, path, trim(replace(href, '&amp;', '&')) AS t FROM attrs WHERE kind = 'link' AND list_contains(string_split_regex(lower(trim(rel)), '\s+'), 'canonical')
  UNION ALL SELECT host, path, regexp_extract(trim(replace(content, '&amp;', '&')), '(?is)\burl\s*=\s*["'']?\s*([^"''\s>]+)', 1) FROM attrs WHERE kind = 'meta' AND lower(trim(equiv)) = 'refresh'),
whole AS (
  SELECT host || path AS a, CASE WHEN regexp_matches(t, '^(?i:[a-z][a-z0-9+.-]*)://') THEN t WHEN regexp_matches(t, '^(?i:[a-z][a-z0-9+.-]*):') THEN NULL WHEN starts_with(t, '//') THEN 'http:' || t WHEN starts_with(t, '/') THEN 'http://' || host || t
    WHEN t[1] IN ('?', '#') THEN 'http://' || host || path || t ELSE 'http://' || host || regexp_replace(CASE WHEN path = '' THEN '/' ELSE path END, '[^/]*$', '') || t END AS u
  FROM links WHERE t <> ''),
edges AS (SELECT DISTINCT a, b FROM (SELECT a, {_HOST.format("u")} || {_PATH.format("u")} AS b FROM whole WHERE {_HOST.format("u")} <> '') WHERE a <> b),
ways AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
reach(n, m) AS (SELECT a, a FROM ways UNION SELECT r.n, e.b FROM reach r JOIN ways e ON r.m = e.a),
keys AS (SELECT host, path, host || path AS node FROM parsed UNION SELECT regexp_extract(a, '^([^/]*)', 1), substr(a, length(regexp_extract(a, '^([^/]*)', 1)) + 1), a FROM ways),
fit AS (
  SELECT k.node, r.h || r.p AS rule, r.a, row_number() OVER (PARTITION BY k.node ORDER BY length(r.h || r.p) DESC, r.a <> 'allow', r.h || r.p) AS n
  FROM (SELECT DISTINCT * FROM keys) k JOIN rules r ON (k.host = r.h OR ends_with(k.host, '.' || r.h)) AND starts_with(k.path, r.p)),
best AS (SELECT node, rule, a FROM fit WHERE n = 1),
bad AS (SELECT DISTINCT r.n FROM reach r JOIN best b ON b.node = r.m WHERE b.a = 'block')
SELECT p.page_id, p.host, p.path, b.rule, coalesce(b.a, CASE WHEN bad.n IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM parsed p LEFT JOIN best b ON b.node = p.host || p.path LEFT JOIN bad ON bad.n = p.host || p.path
"""

OP8_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.v) = len(q.v) WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10
"""


OP12_SQL = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, url, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM p),
n AS (SELECT *, row_number() OVER (PARTITION BY payload_digest ORDER BY page_id NULLS LAST, url NULLS FIRST) AS k,
  first_value(page_id) OVER (PARTITION BY payload_digest ORDER BY page_id NULLS LAST, url NULLS FIRST) AS f FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND k > 1 THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND k > 1 THEN f END AS refers_to FROM n
"""

#: Prefixes are lists of whole turns here; crc32 is computed bit by bit.
OP13_SQL = """
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  SELECT c, c - c % 100 AS lender, xor(list_reduce(list_transform(range(1, len(CAST(c AS VARCHAR)) + 1), lambda k: CAST(ord(substr(CAST(c AS VARCHAR), k, 1)) AS BIGINT)),
    lambda a, x: list_reduce(range(8), lambda r, b: xor(r >> 1, (r & 1) * 3988292384), xor(a, x)), 4294967295), 4294967295) % 6 AS h
  FROM (SELECT DISTINCT conv_id AS c FROM turns)),
parts AS (
  SELECT c, 0 AS own, i, role, text FROM convs JOIN turns ON conv_id = lender AND i <= h
  UNION ALL SELECT c, 1, i, role, text FROM convs JOIN turns ON conv_id = c AND i > h),
rebuilt AS (SELECT c, role, text, row_number() OVER (PARTITION BY c ORDER BY own, i) AS depth FROM parts),
prefixes AS (
  SELECT c, depth, length(text) AS chars, list([role, text]) OVER (PARTITION BY c ORDER BY depth) AS p FROM rebuilt
  UNION ALL SELECT c, 0, 0, [] FROM convs),
nodes AS (SELECT p, min(c) AS conv_id, any_value(depth) AS depth, count(*) AS n_convs, any_value(chars) AS chars FROM prefixes GROUP BY p),
children AS (SELECT x.conv_id, x.depth, y.conv_id AS child, y.depth AS child_depth FROM nodes y JOIN nodes x ON x.p = y.p[:-2] AND y.depth > 0),
n_children AS (SELECT conv_id, depth, count(*) AS n FROM children GROUP BY ALL),
below AS (
  SELECT x.conv_id, x.depth, count(*) FILTER (WHERE k.n IS NULL) AS n_leaves, sum((y.n_convs - 1) * y.chars) AS saved
  FROM prefixes q JOIN nodes x ON x.p = q.p JOIN prefixes r ON r.c = q.c AND r.depth >= q.depth JOIN nodes y ON y.p = r.p AND y.conv_id = r.c
  LEFT JOIN n_children k ON k.conv_id = y.conv_id AND k.depth = y.depth GROUP BY ALL),
lengths AS (SELECT c, max(depth) AS depth FROM prefixes GROUP BY c),
ends AS (SELECT p, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) AS ids FROM lengths JOIN prefixes USING (c, depth) GROUP BY p)
SELECT n.conv_id, n.depth, f.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n, 0) AS n_children, b.n_leaves, CAST(b.saved AS BIGINT) AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM nodes n JOIN below b ON b.conv_id = n.conv_id AND b.depth = n.depth LEFT JOIN n_children k ON k.conv_id = n.conv_id AND k.depth = n.depth
LEFT JOIN children f ON f.child = n.conv_id AND f.child_depth = n.depth LEFT JOIN ends e ON e.p = n.p
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_url_filter": OP1_SQL, "op8_topk": OP8_SQL, "op12_warc": OP12_SQL, "op13_prefix_trie": OP13_SQL}
