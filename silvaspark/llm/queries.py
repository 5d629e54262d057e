"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from silvaspark.llm import decontamination, filter_audit, hamming_search, jaccard_join, language_id, line_dedup, sentencepiece_fst, sharding, source_divergence, substring_dedup, toxicity, url_reputation, warc
from silvaspark.runtime import table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = language_id.held_out(F.col("doc_id"))
    model = language_id.fit(docs, "lang", "doc_id", "text", train_on=~out)
    return language_id.identify(docs, model, keep={"held_out": out})


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), size=13)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op3_hamming_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = hamming_search.sign_codes(table(spark, sf_dir, "embeddings"))
    found = hamming_search.top_k(codes, codes.where("id % 100 = 0"), k=10)
    return found.select("query_id", F.col("id").alias("vec_id"), "distance", "rank")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), n_shards=40)


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sentencepiece_fst.encode_documents(docs, ids=False).select("doc_id", "n_ids", "ids_sha256", "round_trip")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontamination.contaminate(docs, table(spark, sf_dir, "benchmark"))
    items = F.array_sort(F.array_distinct("hits.item_id"))
    return found.select("doc_id", (F.size("hits") > 0).alias("contaminated"), items.alias("item_ids"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    crf = toxicity.fit(docs, table(spark, sf_dir, "labels"), train_on=~language_id.held_out(F.col("id")))
    return toxicity.score(docs, crf, keep={"held_out": language_id.held_out(F.col("doc_id"))})


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = line_dedup.drop_repeated_lines(docs, removed="n_removed_lines")
    return kept.select("doc_id", "n_removed_lines", F.sha2("text", 256).alias("kept_sha256"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.round_trip(spark, table(spark, sf_dir, "pages"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar_classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


RULES = [
    url_reputation.Rule("allow", "com"),
    url_reputation.Rule("block", "example.com", "/en/"),
    url_reputation.Rule("allow", "www.example.com", "/en/"),
    url_reputation.Rule("block", "net", "/es/"),
    url_reputation.Rule("block", "net", "/fr/"),
]


def op11_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_reputation.judge(table(spark, sf_dir, "pages"), RULES)


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.divergences(table(spark, sf_dir, "documents"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_hamming_top_k": op3_hamming_top_k,
    "op4_sharding": op4_sharding,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_decontamination": op6_decontamination,
    "op7_toxicity": op7_toxicity,
    "op8_line_dedup": op8_line_dedup,
    "op9_warc": op9_warc,
    "op10_jaccard_join": op10_jaccard_join,
    "op11_url_reputation": op11_url_reputation,
    "op12_source_divergence": op12_source_divergence,
    "op13_filter_audit": op13_filter_audit,
}

#: SQL that DuckDB runs on the same tables.
ORACLE: dict[str, str] = {
    "op2_substring_dedup": r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), g AS (
  SELECT doc_id, i, array_to_string(w[i : i + 12], ' ') AS win
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)
), bad AS (
  SELECT doc_id, i FROM g JOIN (SELECT win, min(doc_id) AS first_id FROM g GROUP BY win) USING (win) WHERE doc_id > first_id
), gone AS (
  SELECT DISTINCT doc_id, i + k AS i FROM bad, range(0, 13) AS r(k)
), words AS (
  SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM d
), kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS t FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, (len(d.w) - coalesce(kept.n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
""",
    "op9_warc": """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h FROM pages
), d AS (
  SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha1(h) AS sha,
         (SELECT string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                   1 + (16 * (substr(b, i, 1) = '1')::INT + 8 * (substr(b, i + 1, 1) = '1')::INT + 4 * (substr(b, i + 2, 1) = '1')::INT
                        + 2 * (substr(b, i + 3, 1) = '1')::INT + (substr(b, i + 4, 1) = '1')::INT), 1), '' ORDER BY i)
          FROM (SELECT CAST(from_hex(sha1(h)) AS BIT)::VARCHAR AS b), range(1, 161, 5) AS r(i)) AS payload_digest
  FROM p
), f AS (
  SELECT sha, min(page_id) AS first_id, count(*) AS c FROM d GROUP BY sha
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN c > 1 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN c > 1 AND page_id <> first_id THEN first_id END AS refers_to
FROM d JOIN f USING (sha)
""",
    "op10_jaccard_join": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), g AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS sh
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) >= 1)
), n AS (
  SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM g a JOIN g b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY ALL
), link AS (
  SELECT x, y FROM shared JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 5 * c >= 4 * (p.n + q.n - c)
), reach AS (
  SELECT doc_id AS x, doc_id AS y FROM documents
  UNION
  SELECT reach.x, link.y FROM reach JOIN link ON link.x = reach.y
), class AS (
  SELECT x, min(y) AS class_id FROM reach GROUP BY x
), links AS (
  SELECT x, count(*) AS n_links FROM link GROUP BY x
)
SELECT class.x AS doc_id, class_id, coalesce(n_links, 0)::BIGINT AS n_links FROM class LEFT JOIN links ON links.x = class.x
""",
    "op6_decontamination": r"""
WITH dw AS (
  SELECT doc_id, unnest(list_filter(list_transform(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'),
           lambda x: lower(regexp_replace(x, '^[^\pL\pN]+|[^\pL\pN]+$', '', 'g'))), lambda x: x <> '')) AS w FROM documents
), bw AS (
  SELECT item_id, unnest(list_filter(list_transform(string_split_regex(text, '[\x20\x09-\x0D]+'),
           lambda x: lower(regexp_replace(x, '^[^\pL\pN]+|[^\pL\pN]+$', '', 'g'))), lambda x: x <> '')) AS w FROM benchmark
), dp AS (
  SELECT doc_id, w, row_number() OVER (PARTITION BY doc_id) AS p FROM dw
), bp AS (
  SELECT item_id, w, row_number() OVER (PARTITION BY item_id) AS p, count(*) OVER (PARTITION BY item_id) AS n FROM bw
), eq AS (
  SELECT doc_id, item_id, dp.p - bp.p AS diag, bp.p AS p, bp.n AS n FROM dp JOIN bp USING (w) WHERE bp.n >= 5
), run AS (
  SELECT doc_id, item_id, n, count(*) OVER (PARTITION BY doc_id, item_id, diag ORDER BY p RANGE BETWEEN CURRENT ROW AND 12 FOLLOWING) AS c FROM eq
), hit AS (
  SELECT doc_id, list_sort(list(DISTINCT item_id)) AS item_ids FROM run WHERE c >= least(n, 11 + 2 * (n < 13)::INT) GROUP BY doc_id
)
SELECT d.doc_id, hit.item_ids IS NOT NULL AS contaminated, coalesce(hit.item_ids, []::BIGINT[]) AS item_ids
FROM documents d LEFT JOIN hit USING (doc_id)
""",
    "op3_hamming_top_k": """
WITH e AS (
  SELECT vec_id, list_transform(embedding[1:64], lambda x: coalesce(x > 0, false)) AS b FROM embeddings WHERE embedding IS NOT NULL
), d AS (
  SELECT q.vec_id AS query_id, e.vec_id, list_sum(list_transform(list_zip(q.b, e.b), lambda z: (z[1] <> z[2])::INT))::INT AS distance
  FROM e q JOIN e ON q.vec_id % 100 = 0 AND e.vec_id <> q.vec_id
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id)::INT AS rank FROM d
)
SELECT query_id, vec_id, distance, rank FROM r WHERE rank <= 10
""",
    "op11_url_reputation": r"""
WITH p AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), u AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p
), r(h, p, good) AS (
  VALUES ('com', '/', 1), ('example.com', '/en/', 0), ('www.example.com', '/en/', 1), ('net', '/es/', 0), ('net', '/fr/', 0)
), f AS (
  SELECT *, (SELECT max({'n': length(h || p), 'k': length(p), 'b': 1 - good, 'name': h || p}) FROM r
             WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) AS best FROM u
), b AS (
  SELECT DISTINCT host, string_split(regexp_replace(host, ':[0-9]*$|^.*@', '', 'g'), '.') AS l FROM u
), s AS (
  SELECT host, l, array_to_string(l, '.') AS bare, CASE WHEN regexp_matches(array_to_string(l, '.'), '^[0-9.]+$|^\[') THEN array_to_string(l, '.')
    WHEN len(l) > 2 AND length(l[-1]) = 2 AND l[-2] IN ('ac', 'co', 'com', 'edu', 'gov', 'net', 'or', 'org') THEN l[-2] || '.' || l[-1] ELSE l[-1] END AS suffix FROM b
), hosts AS (
  SELECT host, suffix, CASE WHEN length(bare) <= length(suffix) + 1 THEN bare
      ELSE string_split(left(bare, length(bare) - length(suffix) - 1), '.')[-1] || '.' || suffix END AS domain,
    count(best) AS n, count(*) FILTER (best.b = 0) AS good
  FROM f JOIN s USING (host) GROUP BY ALL
), domains AS (
  SELECT suffix, domain, sum(n) AS n, sum(good) AS good FROM hosts GROUP BY ALL
), suffixes AS (
  SELECT suffix, sum(n) AS n, sum(good) AS good FROM domains GROUP BY ALL
), levels AS (
  SELECT 1 AS level, '' AS parent, good::DOUBLE AS x, n::DOUBLE AS n FROM suffixes UNION ALL
  SELECT 2, suffix, good, n FROM domains UNION ALL SELECT 3, domain, good, n FROM hosts
), groups AS (
  SELECT level, parent, count(*) AS k, sum(x) AS x, sum(n) AS n, sum(x * x / n) AS xx, sum(n * n) AS nn FROM levels WHERE n > 0 GROUP BY ALL
), moments AS (
  SELECT level, sum(xx - x * x / n - (k - 1) * (x / n) * (1 - x / n)) AS beyond, sum((x / n) * (1 - x / n) * (n - nn / n - (k - 1))) AS room FROM groups GROUP BY ALL
), strengths AS (
  SELECT v.level, round(1 / least(greatest(CASE WHEN room > 0 AND beyond > 0 THEN beyond / room ELSE 0 END, 1 / 1001.0::DOUBLE), 1 / 1.5::DOUBLE) - 1, 6) AS m
  FROM (VALUES (1), (2), (3)) AS v(level) LEFT JOIN moments USING (level)
), st AS (
  SELECT max(m) FILTER (level = 1) AS s1, max(m) FILTER (level = 2) AS s2, max(m) FILTER (level = 3) AS s3 FROM strengths
), root AS (
  SELECT (sum(good) + 1)::DOUBLE / (sum(n) + 2) AS m0 FROM suffixes
), ms AS (
  SELECT suffix, (s1 * m0 + good) / (s1 + n) AS m1 FROM suffixes, st, root
), md AS (
  SELECT suffix, domain, (s2 * m1 + good) / (s2 + n) AS m2 FROM domains JOIN ms USING (suffix), st
), post AS (
  SELECT host, s3 * m2 + good AS a, s3 * (1 - m2) + n - good AS b FROM hosts JOIN md USING (suffix, domain), st
), rep AS (
  SELECT host, a / (a + b) + 1.64::DOUBLE * sqrt(a / (a + b) * (1 - a / (a + b)) / (a + b + 1)) < 0.5 AS blocked FROM post
)
SELECT page_id, host, path, best.name AS rule, CASE WHEN coalesce(best.b = 1, blocked) THEN 'block' ELSE 'allow' END AS verdict
FROM f JOIN rep USING (host)
""",
    "op12_source_divergence": r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT r, lang, source, unnest(regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
), kept AS (
  SELECT lang, term, count(*) AS n FROM w GROUP BY ALL HAVING count(DISTINCT r) >= 3
), c AS (
  SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN kept USING (lang, term) GROUP BY ALL
), v AS (
  SELECT lang, count(*) AS v, sum(n)::BIGINT AS nl FROM kept GROUP BY ALL
), g AS (
  SELECT d.lang, d.source, coalesce(any_value(t.n), 0) AS ng FROM (SELECT DISTINCT lang, source FROM d) AS d
  LEFT JOIN (SELECT lang, source, sum(n)::BIGINT AS n FROM c GROUP BY ALL) AS t USING (lang, source) GROUP BY ALL
), p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, (1 + 1000000000 * (coalesce(c.n, 0) + 1) // (ng + v))::BIGINT AS p, (1 + 1000000000 * (k.n + 1) // (nl + v))::BIGINT AS q
  FROM g JOIN v USING (lang) JOIN kept k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), f AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p)::BIGINT AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), r AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p WHERE n > 0 AND p > q
), o AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM r
)
SELECT lang, source, part, item, value::BIGINT AS value, rank FROM o WHERE part = 'pair' OR rank <= 200
""",
    "op13_filter_audit": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws, min(doc_id) OVER (PARTITION BY t) AS first_id FROM d
), l AS (
  SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id
), m AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    [f.f FOR f IN [{'f': 'A', 'x': len(ws) < 100}, {'f': 'B', 'x': 100 * len(list_distinct(ws)) < 80 * len(ws)},
      {'f': 'C', 'x': 100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * len(t)}, {'f': 'D', 'x': regexp_matches(t, '[#$%&*|]')},
      {'f': 'E', 'x': coalesce(w.doc_id > first_id, false)}] IF f.x] AS fails
  FROM w LEFT JOIN l USING (doc_id)
), c AS (
  SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY ALL
), o AS (
  SELECT '' AS filter_order UNION ALL SELECT filter_order || f FROM o, unnest(['A', 'B', 'C', 'D', 'E']) AS u(f) WHERE NOT contains(filter_order, f)
), s AS (
  SELECT part, filter_order, step, substr(filter_order, step, 1) AS f, n, good, toxic, fails,
    list_contains(fails, substr(filter_order, step, 1)) AS hit, len(list_intersect(fails, string_split(left(filter_order, step - 1), ''))) > 0 AS gone
  FROM c, o, range(1, 6) AS r(step) WHERE len(filter_order) = 5
), g AS (
  SELECT part, filter_order, step, f,
    sum(CASE WHEN NOT hit AND NOT gone THEN n ELSE 0 END) AS kept, sum(CASE WHEN hit AND NOT gone THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN hit AND gone THEN n ELSE 0 END) AS redundant, sum(CASE WHEN hit AND len(fails) = 1 THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN hit AND NOT gone THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN hit AND NOT gone THEN toxic ELSE 0 END) AS toxic_lost
  FROM s GROUP BY ALL
)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
  good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley
FROM g
""",
}
