"""The named queries of the text operators, and the SQL of those that SQL can express."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlight.llm import archives, decontamination, language, main_text, packing, private_data, repeats, sharding, simhash, spelling, topk, url_filter, vector_codes

URL_RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables. Python workers get this package's folder on their path."""
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    known = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in known:
        env["PYTHONPATH"] = os.pathsep.join([root, *known])
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file() -> str:
    """The vocabulary file of the packing query."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_redirect_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = repeats.remove_repeats(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.train(docs.where(~language.in_fold("doc_id")))
    return language.identify(docs, model, "text", "doc_id").select("doc_id", language.in_fold("doc_id").alias("held_out"), "lang_pred", "score")


def op4_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3).drop("given")


def op5_block_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), every=20, k=20, scale=64)


def op6_hilbert_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_file(), length=4096, end_id=2, keep_ids=False).drop("ids")


def op7_external_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    shuffled = sharding.shuffle_shards(table(spark, sf_dir, "documents"), shards=8)
    crc = F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8"))
    return shuffled.select("doc_id", "size", crc.alias("text_crc32"), F.lit(sharding.LAW).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.extract_main_text(table(spark, sf_dir, "pages"))


def op9_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = archives.archive_pages(table(spark, sf_dir, "pages"), min_bytes=0)
    return done.select(F.col("item").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_fm_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = decontamination.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return done.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.encode(F.array_join("items", ","), "UTF-8"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def op11_block_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = vector_codes.compress(table(spark, sf_dir, "embeddings"), parts=8, entries=16, rounds=6, scale=4096)
    return done.rows.select("vec_id", "code", "error", "label_error", F.lit(done.digest()).alias("codebooks_sha256"))


def op12_spelling_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spelling.word_counts(table(spark, sf_dir, "documents"), least_length=7, least_count=2, noise=31)
    return spelling.spelling_groups(words, ratio=10).select("word", "form", "root", "n", "n_near", "form_n")


def op13_bootstrapped_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = private_data.find_private_data(table(spark, sf_dir, "documents"))
    counts = [private_data.count_of(F.col("base"), k).alias(f"n_{name}") for k, name in enumerate(private_data.KINDS)]
    return done.select("doc_id", *counts, F.sha2(F.encode(private_data.joined(F.col("base")), "UTF-8"), 256).alias("base_sha256"), private_data.joined(F.col("spans")).alias("spans"))


QUERIES = {f.__name__: f for f in (
    op1_redirect_filter, op2_suffix_dedup, op3_language_id, op4_simhash_golay, op5_block_topk, op6_hilbert_packing,
    op7_external_shuffle, op8_main_text, op9_arc_to_warc, op10_fm_decontamination, op11_block_codes, op12_spelling_groups,
    op13_bootstrapped_pii,
)}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_REST = "CASE WHEN contains({0}, '://') THEN substr({0}, strpos({0}, '://') + 3) ELSE '' END"

def _code_sql(parts: int, entries: int, rounds: int) -> str:
    """Every round as tables of its own: distances to all entries, the nearest, floors of the means."""
    far = "CAST(list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - c[i]) * (x[i] - c[i]))) AS BIGINT)"
    steps = [f"""kept AS MATERIALIZED (
  SELECT *, row_number() OVER (ORDER BY vec_id NULLS LAST, v) AS r
  FROM (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)),
cut AS MATERIALIZED (SELECT r, p, v[p * (len(v) // {parts}) + 1 : (p + 1) * (len(v) // {parts})] AS x FROM kept, range({parts}) t(p)),
book0 AS MATERIALIZED (SELECT p, r - 1 AS e, x AS c FROM cut WHERE r <= {entries})"""]
    for k in range(rounds + 1):
        steps.append(f"near{k} AS MATERIALIZED (SELECT p, r, any_value(x) AS x, min({{'d': {far}, 'e': e}}) AS best FROM cut JOIN book{k} USING (p) GROUP BY p, r)")
        if k < rounds:
            steps.append(f"""means{k} AS MATERIALIZED (
  SELECT p, e, list((s - (s % n + n) % n) // n ORDER BY i) AS c
  FROM (SELECT p, e, i, CAST(sum(x[i]) AS BIGINT) AS s, count(*) AS n FROM (SELECT p, best.e AS e, x, unnest(range(1, len(x) + 1)) AS i FROM near{k}) GROUP BY p, e, i) GROUP BY p, e),
book{k + 1} AS MATERIALIZED (SELECT p, e, coalesce(means{k}.c, book{k}.c) AS c FROM book{k} LEFT JOIN means{k} USING (p, e))""")
    return f"""WITH {", ".join(steps)},
coded AS (SELECT r, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM near{rounds} GROUP BY r),
digest AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM kept JOIN coded USING (r), digest"""


ORACLES = {
    "op1_redirect_filter": rf"""
WITH RECURSIVE rules(verdict, rule, h, p) AS (
  SELECT v, r, split_part(r, '/', 1), substr(r, strpos(r, '/')) FROM (VALUES {", ".join(f"('{d}', '{r}')" for d, r in URL_RULES)}) t(v, r)),
tags AS (
  SELECT url AS src, unnest(regexp_extract_all(regexp_replace(html, '(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>', ' ', 'g'), '(?is)<(?:link|meta)\b[^>]*>')) AS tag
  FROM pages WHERE url IS NOT NULL AND regexp_matches(html, '(?i)canonical|refresh')),
links AS (
  SELECT src, CASE WHEN regexp_matches(tag, '(?is)^<link') AND regexp_matches(tag, '(?is)\srel\s*=\s*["'']?([^"''>]*\s)?canonical\b') THEN regexp_extract(tag, '(?is)\shref\s*=\s*["'']?([^"''\s>]*)', 1)
    WHEN regexp_matches(tag, '(?is)^<meta') AND regexp_matches(tag, '(?is)http-equiv\s*=\s*["'']?refresh') THEN regexp_extract(tag, '(?is)url\s*=\s*["'']?([^"''\s>]*)', 1) END AS dst FROM tags),
absolute AS (
  SELECT src, CASE WHEN contains(dst, '://') THEN dst WHEN starts_with(dst, '//') THEN 'http:' || dst
    WHEN starts_with(dst, '/') THEN regexp_extract(src, '^.*?://[^/?#]*') || dst END AS dst FROM links WHERE dst <> ''),
ends AS (
  SELECT src, dst, {_REST.format("src")} AS r, {_REST.format("dst")} AS s FROM absolute WHERE dst IS NOT NULL),
named AS (
  SELECT url, rest, {_LOWER.format("regexp_extract(rest, '^[^/?#]*')")} AS host, substr(regexp_extract(rest, '^[^#]*'), length(regexp_extract(rest, '^[^/?#]*')) + 1) AS tail
  FROM (SELECT url, {_REST.format("url")} AS rest FROM (SELECT url FROM pages WHERE url IS NOT NULL UNION SELECT src FROM ends UNION SELECT dst FROM ends))),
places AS (
  SELECT *, regexp_extract(tail, '^[^?]*') AS path, host || CASE WHEN starts_with(tail, '/') THEN '' ELSE '/' END || tail AS address FROM named),
fits AS (
  SELECT url, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
  FROM places JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY url),
edges AS (
  SELECT a.address AS u, b.address AS v FROM ends JOIN places a ON a.url = src JOIN places b ON b.url = dst),
reach(u, v) AS (
  SELECT u, u FROM (SELECT u FROM edges UNION SELECT v FROM edges) UNION
  SELECT reach.u, pairs.v FROM reach JOIN (SELECT u, v FROM edges UNION SELECT v, u FROM edges) pairs ON reach.v = pairs.u),
inherited AS (
  SELECT reach.u AS address, min(fits.verdict) AS verdict FROM reach JOIN places ON places.address = reach.v JOIN fits USING (url) GROUP BY 1)
SELECT page_id, coalesce(places.host, '') AS host, coalesce(places.path, '') AS path, fits.rule, coalesce(fits.verdict, inherited.verdict, 'allow') AS verdict
FROM pages LEFT JOIN places USING (url) LEFT JOIN fits USING (url) LEFT JOIN inherited ON inherited.address = places.address AND places.host <> ''""",
    "op2_suffix_dedup": """
WITH texts AS (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS h FROM documents),
starts AS (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 49)) AS p FROM texts WHERE length(h) >= 100),
windows AS (SELECT doc_id, p, hash(substr(h, 2 * p + 1, 100)) AS a, md5_number(substr(h, 2 * p + 1, 100)) AS b FROM starts),
earliest AS (SELECT a, b, min(doc_id) AS first FROM windows GROUP BY a, b HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT doc_id, p FROM windows JOIN earliest USING (a, b) WHERE doc_id > first),
marked AS (SELECT *, CASE WHEN p > lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 50 OR lag(p) OVER (PARTITION BY doc_id ORDER BY p) IS NULL THEN 1 ELSE 0 END AS fresh FROM gone),
islands AS (SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS island FROM marked),
spans AS (SELECT doc_id, island, min(p) AS s, max(p) + 50 AS e FROM islands GROUP BY doc_id, island),
pieces AS (SELECT doc_id, s, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS since FROM spans),
summed AS (
  SELECT doc_id, sum(e - s) AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * since + 1, 2 * (s - since)), '' ORDER BY s) AS head, max(e) AS last
  FROM pieces JOIN texts USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(head || substr(h, 2 * last + 1), h))) AS kept_sha256
FROM texts LEFT JOIN summed USING (doc_id)""",
    "op5_block_topk": """
WITH rows AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT q.vec_id AS query_id, d.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(d.v AS DOUBLE[])) AS BIGINT) AS score
  FROM rows q JOIN rows d ON q.vec_id % 20 = 0 AND q.vec_id <> d.vec_id)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM pairs
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY rank <= 20""",
    "op9_arc_to_warc": """
WITH rows AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
hashed AS (SELECT page_id, CAST(octet_length(b) AS BIGINT) AS payload_bytes, sha1(b) AS h FROM rows),
grouped AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS last FROM hashed)
SELECT page_id, payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST((CAST('0x' || substr(h, CAST(i // 4 * 5 + 1 AS BIGINT), 5) AS BIGINT) >> CAST(15 - i % 4 * 5 AS BIGINT)) & 31 AS BIGINT) + 1, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to
FROM grouped""",
    "op10_fm_decontamination": rf"""
WITH doc_words AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
item_words AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWER.format("text")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
windows AS (
  SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS phrase
  FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM item_words WHERE len(w) > 0)),
grams AS (
  SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS phrase
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc_words, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)),
found AS (SELECT doc_id, i, n, item FROM grams JOIN windows USING (n, phrase)),
hits AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS place FROM found) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc_words LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op11_block_codes": _code_sql(parts=8, entries=16, rounds=6),
    "op12_spelling_groups": rf"""
WITH RECURSIVE crc_steps AS (
  SELECT list(c ORDER BY i) AS t
  FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))),
runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, {_LOWER.format("run")} AS run, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]{{7,}}')) AS run FROM documents) GROUP BY ALL),
bytes AS (SELECT *, hex(encode(id || ':' || run)) AS x FROM runs),
hashed AS (
  SELECT run, n, xor(list_reduce(list_prepend(4294967295, list_transform(range(length(x) // 2), lambda k: CAST('0x' || substr(x, CAST(2 * k + 1 AS BIGINT), 2) AS BIGINT))),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM bytes, crc_steps),
words AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
    SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) + 2 AS BIGINT)) ELSE run END AS word, n FROM hashed)
  WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
cuts AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS d FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (
  SELECT a.word, b.word AS near, b.n AS m FROM cuts a JOIN cuts b ON a.d = b.d AND a.i = b.i AND a.word <> b.word
  UNION SELECT cuts.word, words.word, words.n FROM cuts JOIN words ON d = words.word
  UNION SELECT words.word, cuts.word, cuts.n FROM cuts JOIN words ON d = words.word),
best AS (SELECT word, count(*) AS n_near, max(m) AS m, first(near ORDER BY m DESC, near) AS near FROM near GROUP BY word),
forms AS (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 10 * n THEN near END AS form, CASE WHEN m >= 10 * n THEN m END AS form_n FROM words LEFT JOIN best USING (word)),
chain(word, leads) AS (SELECT word, word FROM forms UNION ALL SELECT chain.word, form FROM chain JOIN forms ON forms.word = chain.leads WHERE form IS NOT NULL),
roots AS (SELECT chain.word, leads AS root FROM chain JOIN forms ON forms.word = chain.leads WHERE form IS NULL)
SELECT word, form, root, n, CAST(n_near AS BIGINT) AS n_near, CAST(form_n AS BIGINT) AS form_n FROM forms JOIN roots USING (word)""",
}
