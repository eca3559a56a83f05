"""The registered queries of this subpackage and their SQL, over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import digests
from .decontaminate import contaminated
from .embedding_dedup import near_duplicate_vectors
from .exact_dedup import exact_duplicates
from .fill_in_middle import MIDDLE, PREFIX, SUFFIX, fill_in_middle, restored
from .language_id import language_id
from .line_dedup import remove_repeated_lines
from .minhash_dedup import near_duplicates
from .scratch import Scratch
from .source_divergence import source_divergences
from .token_counts import token_counts
from .token_files import read_token_files, with_starts, write_token_files
from .warc import plan_records, read_archive, write_archive
from .url_filter import NEED_SOFT, SOFT_TERMS, STRICT_TERMS, judge_urls


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a folder named by the session outlives the query and serves later ones; else the cache starts empty
    cache = spark.conf.get("spark.seqloom.tokenCache", None) or Scratch(spark, "token-counts").new("cache")
    return token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), cache)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "warc")
    path = scratch.new("archive")
    write_archive(plan_records(_table(spark, sf_dir, "pages"), scratch), path)
    return read_archive(spark, path, scratch).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP2_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS n, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first
  FROM pages)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest,
       CASE WHEN n >= 100 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND first <> page_id THEN first END AS refers_to
FROM p
"""


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), shingle_words=3, percent=85)


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "token-files")
    path = scratch.new("files")
    write_token_files(_table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    rows = read_token_files(spark, path).select(
        "doc_id", "partition", "number", "start_in_file", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32")
    )
    return with_starts(scratch.keep(rows, "documents")).select("doc_id", "start", "n_tokens", "ids_crc32")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


OP6_SQL = r"""
WITH w AS (
  SELECT 'd' AS kind, doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
  UNION ALL
  SELECT 'i', item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') FROM benchmark),
g AS (SELECT kind, id, unnest(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))) AS g FROM w WHERE len(w) >= 5),
n AS (SELECT id, count(*) AS n FROM g WHERE kind = 'i' GROUP BY id),
long_items AS (
  SELECT d.id AS doc_id, i.id AS item_id, any_value(n.n) AS n_item, count(*) AS n_common
  FROM g d JOIN g i ON d.g = i.g AND d.kind = 'd' AND i.kind = 'i' JOIN n ON n.id = i.id GROUP BY 1, 2),
short_items AS (
  SELECT d.id, i.id, 1, 1 FROM w d JOIN w i ON d.kind = 'd' AND i.kind = 'i' AND len(i.w) BETWEEN 1 AND 4
   AND contains(' ' || array_to_string(d.w, ' ') || ' ', ' ' || array_to_string(i.w, ' ') || ' '))
SELECT doc_id, item_id, CAST(n_item AS BIGINT) AS n_item, CAST(n_common AS BIGINT) AS n_common FROM long_items WHERE 100 * n_common >= 80 * n_item
UNION ALL SELECT * FROM short_items
"""


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = remove_repeated_lines(_table(spark, sf_dir, "documents"))
    size, digest = F.coalesce(F.octet_length("text"), F.lit(0)), F.sha2("text", 256)
    return cleaned.select("doc_id", "n_lines", "n_removed_lines", "n_removed_chunks", size.cast("long").alias("n_bytes_kept"), digest.alias("kept_sha256"))


OP7_SQL = """
WITH t AS (
  SELECT doc_id, text, CASE WHEN text <> '' THEN string_split(CASE WHEN suffix(text, chr(10)) THEN substr(text, 1, length(text) - 1) ELSE text END, chr(10)) ELSE [] END AS l
  FROM documents),
lines AS (SELECT doc_id, unnest(range(1, len(l) + 1)) AS i, unnest(l) AS line FROM t),
pairs AS (SELECT doc_id, i, line, lead(line) OVER (PARTITION BY doc_id ORDER BY i) AS below FROM lines),
placed AS (
  SELECT doc_id, i, first_value(doc_id) OVER w AS first_doc, first_value(i) OVER w AS first_i
  FROM pairs WHERE below IS NOT NULL WINDOW w AS (PARTITION BY line, below ORDER BY doc_id, i)),
again AS (SELECT doc_id, i FROM placed WHERE first_doc <> doc_id OR i >= first_i + 2),
gone AS (SELECT doc_id, i FROM again UNION SELECT doc_id, i + 1 FROM again),
runs AS (SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE NOT follows) AS runs FROM (
  SELECT doc_id, coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i) = i - 1, false) AS follows FROM gone) GROUP BY doc_id),
rest AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS kept FROM lines ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id),
cleaned AS (
  SELECT t.doc_id, len(l) AS n_lines, coalesce(n, 0) AS n, coalesce(runs, 0) AS runs,
         CASE WHEN n IS NULL THEN text ELSE coalesce(kept || CASE WHEN suffix(text, chr(10)) THEN chr(10) ELSE '' END, '') END AS kept
  FROM t LEFT JOIN runs USING (doc_id) LEFT JOIN rest USING (doc_id))
SELECT doc_id, CAST(n_lines AS BIGINT) AS n_lines, CAST(n AS BIGINT) AS n_removed_lines, CAST(runs AS BIGINT) AS n_removed_chunks,
       CAST(coalesce(octet_length(encode(kept)), 0) AS BIGINT) AS n_bytes_kept, sha256(kept) AS kept_sha256
FROM cleaned
"""


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(_table(spark, sf_dir, "documents"))


#: (verdict, host/path)
URL_RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(_table(spark, sf_dir, "pages"), URL_RULES)


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(_table(spark, sf_dir, "embeddings"))


OP10_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
u AS (SELECT vec_id, e, sqrt(list_inner_product(e, e)) AS norm FROM v),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_inner_product(a.e, b.e) / (a.norm * b.norm) >= 0.95),
reach(id, other) AS (
  SELECT vec_id, vec_id FROM embeddings
  UNION
  SELECT r.id, l.b FROM reach r JOIN link l ON l.a = r.other),
comp AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id),
degree AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT t.vec_id, CAST(coalesce(d.n, 0) AS BIGINT) AS n_links, c.component_id, t.vec_id = c.component_id AS kept
FROM embeddings t JOIN comp c ON c.id = t.vec_id LEFT JOIN degree d ON d.a = t.vec_id
"""


OP3_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))
                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s
  FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS n
  FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM common WHERE 100 * n >= 85 * (na + nb - n)),
both_ways AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach(id, other) AS (
  SELECT doc_id, doc_id FROM s
  UNION
  SELECT r.id, l.b FROM reach r JOIN both_ways l ON l.a = r.other),
comp AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, c.component_id, s.doc_id = c.component_id AS kept
FROM s JOIN comp c ON c.id = s.doc_id
"""


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(_table(spark, sf_dir, "documents"))
    digest = lambda c: F.sha2(c, 256)
    return made.select("doc_id", F.col("n_units").alias("n"), "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("form"), F.col("output"))).alias("restored_sha256"))


OP11_SQL = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || doc_id) AS d FROM documents),
h AS (
  SELECT doc_id, text, length(text) AS n, CAST('0x' || d[1:8] AS BIGINT) AS h1, CAST('0x' || d[9:16] AS BIGINT) AS h2,
         CAST('0x' || d[17:24] AS BIGINT) AS h3, CAST('0x' || d[25:32] AS BIGINT) AS h4
  FROM t),
c AS (
  SELECT doc_id, text, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '{PREFIX}') OR contains(text, '{SUFFIX}') OR contains(text, '{MIDDLE}') OR h3 % 100 >= 90 THEN 'plain'
              WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM h),
p AS (SELECT *, substring(text, 1, a) AS prefix, substring(text, a + 1, b - a) AS middle, substring(text, b + 1) AS suffix FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(a AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(b - a AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '{PREFIX}' || prefix || '{SUFFIX}' || suffix || '{MIDDLE}' || middle
              ELSE '{SUFFIX}' || suffix || '{PREFIX}' || prefix || '{MIDDLE}' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(_table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS text FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, sha256(text) AS text_sha256
FROM t WINDOW w AS (PARTITION BY text)
"""


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergences(_table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents),
words AS (SELECT i, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM words GROUP BY lang, term HAVING count(DISTINCT i) >= 3),
of_lang AS (SELECT lang, count(*) AS v, sum(n) AS n FROM kept GROUP BY lang),
counts AS (SELECT lang, source, term, count(*) AS n FROM words SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
groups AS (
  SELECT g.lang, g.source, coalesce(v, 0) AS v, coalesce(sum(c.n), 0) AS n
  FROM (SELECT DISTINCT lang, source FROM d) g LEFT JOIN of_lang USING (lang) LEFT JOIN counts c USING (lang, source) GROUP BY g.lang, g.source, v),
shares AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000 * CAST(coalesce(c.n, 0) + 1 AS HUGEINT)) // (g.n + g.v) AS p
  FROM groups g JOIN kept k USING (lang) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
whole AS (SELECT lang, term, 1 + (1000000000 * CAST(k.n + 1 AS HUGEINT)) // (o.n + o.v) AS q FROM kept k JOIN of_lang o USING (lang)),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce((
    SELECT sum((x.p - y.p) * (x.p - y.p) // y.p) FROM shares x JOIN shares y ON x.lang = a.lang AND y.lang = a.lang AND x.source = a.source AND y.source = b.source AND x.term = y.term), 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source),
terms AS (SELECT lang, source, term AS item, (p - q) * (p - q) // q AS value FROM shares JOIN whole USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (
  SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
  UNION ALL
  SELECT * FROM (SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM terms) WHERE rank <= 200)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked
"""


def _op9_sql() -> str:
    terms = ", ".join(f"('{t}', {w})" for w, ts in ((NEED_SOFT, STRICT_TERMS), (1, SOFT_TERMS)) for t in ts)
    rules = ", ".join(f"('{verdict}', '{h}', '/{p}', '{h}/{p}')" for verdict, (h, _, p) in ((v, r.partition("/")) for v, r in URL_RULES))
    return rf"""
WITH p AS (
  SELECT page_id, url, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) END AS rest,
         translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS u
  FROM pages),
h AS (
  SELECT page_id, url, translate(coalesce(regexp_extract(rest, '^[^/?#]*'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM p),
terms(term, weight) AS (VALUES {terms}),
weights AS (
  SELECT page_id, url, sum(weight) AS weight FROM (SELECT DISTINCT page_id, url, u FROM p) x
  JOIN terms t ON contains(u, term) AND regexp_matches(u, '(^|[^a-z0-9])' || term || '($|[^a-z0-9])') GROUP BY page_id, url),
rules(verdict, h, p, rule) AS (VALUES {rules}),
best AS (
  SELECT page_id, url, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
  FROM h JOIN rules r ON (h.host = r.h OR suffix(h.host, '.' || r.h)) AND prefix(h.path, r.p) GROUP BY page_id, url)
SELECT h.page_id, h.host, h.path, b.rule,
       coalesce(b.verdict, CASE WHEN w.weight >= {NEED_SOFT} THEN 'block' ELSE 'allow' END) AS verdict
FROM h LEFT JOIN best b ON b.page_id = h.page_id AND b.url IS NOT DISTINCT FROM h.url LEFT JOIN weights w ON w.page_id = h.page_id AND w.url IS NOT DISTINCT FROM h.url
"""


QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_warc": op2_warc,
    "op3_minhash_near_dedup": op3_minhash_near_dedup,
    "op4_token_files": op4_token_files,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_decontamination": op6_decontamination,
    "op7_line_dedup": op7_line_dedup,
    "op8_language_id": op8_language_id,
    "op9_url_filter": op9_url_filter,
    "op10_embedding_near_dedup": op10_embedding_near_dedup,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_exact_dedup": op12_exact_dedup,
    "op13_source_divergence": op13_source_divergence,
}

ORACLES = {
    "op2_warc": OP2_SQL,
    "op3_minhash_near_dedup": OP3_SQL,
    "op6_decontamination": OP6_SQL,
    "op7_line_dedup": OP7_SQL,
    "op9_url_filter": _op9_sql(),
    "op10_embedding_near_dedup": OP10_SQL,
    "op11_fill_in_middle": OP11_SQL,
    "op12_exact_dedup": OP12_SQL,
    "op13_source_divergence": OP13_SQL,
}
