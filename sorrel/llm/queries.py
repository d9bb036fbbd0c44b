"""The registered queries over the corpus tables, and their SQL where DuckDB can express them."""

from __future__ import annotations

from . import bpe, collocations, decontamination, language_id, mixing, near_duplicates, quality_classifier, quality_rules, sharding, spelling, token_counts, url_filter, warc
from .common import table

QUERIES = {
    "op1_language_id": lambda spark, d: language_id.language_table(table(spark, d, "documents")),
    "op2_token_counts": lambda spark, d: token_counts.token_table(table(spark, d, "documents")),
    "op3_sharding": lambda spark, d: sharding.shard_table(table(spark, d, "documents")),
    "op4_quality_classifier": lambda spark, d: quality_classifier.score_table(table(spark, d, "documents"), table(spark, d, "labels")),
    "op5_decontamination": lambda spark, d: decontamination.contamination_table(table(spark, d, "documents"), table(spark, d, "benchmark")),
    "op6_quality_rules": lambda spark, d: quality_rules.quality_table(table(spark, d, "documents")),
    "op7_url_filter": lambda spark, d: url_filter.url_table(table(spark, d, "pages")),
    "op8_near_duplicates": lambda spark, d: near_duplicates.near_duplicate_table(table(spark, d, "documents")),
    "op9_mixing": lambda spark, d: mixing.mix_table(table(spark, d, "documents")),
    "op10_warc": lambda spark, d: warc.warc_table(table(spark, d, "pages")),
    "op11_collocations": lambda spark, d: collocations.collocation_table(table(spark, d, "documents")),
    "op12_bpe": lambda spark, d: bpe.encoded_table(table(spark, d, "documents")),
    "op13_spelling_variants": lambda spark, d: spelling.variant_table(table(spark, d, "documents")),
}

#: Windows of ten words (or the whole of a shorter item) met as joined strings; words covered by a met window are counted.
DECONTAMINATION_SQL = r"""
WITH dw AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
p AS (SELECT DISTINCT item, least(10, len(w)) AS m, array_to_string(list_slice(w, k, k + least(10, len(w)) - 1), ' ') AS g
      FROM (SELECT item, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS k FROM bw WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT m FROM p),
dg AS (SELECT r, m, k, array_to_string(list_slice(w, k, k + m - 1), ' ') AS g
       FROM (SELECT r, w, m, unnest(range(1, len(w) - m + 2)) AS k FROM dw, lengths WHERE len(w) >= m)),
met AS (SELECT dg.r, dg.k, dg.m, p.item FROM dg JOIN p ON dg.m = p.m AND dg.g = p.g),
hits AS (SELECT r, count(DISTINCT place) AS n FROM (SELECT r, unnest(range(k, k + m)) AS place FROM (SELECT DISTINCT r, k, m FROM met)) GROUP BY r),
items AS (SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT r, item FROM met) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(hits.n, 0)::BIGINT AS n_hit, coalesce(items.n, 0)::BIGINT AS n_items,
       sha256(coalesce(items.s, '')) AS items_sha256, coalesce(hits.n, 0) > 0 AS contaminated
FROM dw LEFT JOIN hits USING (r) LEFT JOIN items USING (r)
"""

URL_SQL = r"""
WITH a AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substring(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
r AS (SELECT *, CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
                     WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
                     WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
                     WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule FROM h)
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
            WHEN host <> '' AND regexp_matches(translate(host || path, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '(^|[^a-z0-9])(SPAM)($|[^a-z0-9])') THEN 'block' ELSE 'allow' END AS verdict
FROM r
""".replace("SPAM", "|".join(url_filter.spam_words()))

WARC_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS digest FROM pages),
f AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY digest) END AS first_id FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest,
       CASE WHEN first_id IS NOT NULL AND page_id IS DISTINCT FROM first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM f
"""

#: Copies sorted by virtual finish time (10 units of time to a word of weight 1), their words summed in that order and the order cut at the budget.
MIXING_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5(concat_ws(':', doc_id::VARCHAR, md5(coalesce(text, '')))) AS key, row_number() OVER () AS r
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS nth, [5, 2, 1][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3) + 1] AS weight FROM s),
l AS (
  SELECT *, (sum(source_size) OVER ()
             - coalesce(sum(3 * source_size) OVER (ORDER BY 3 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY 3 * source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w),
t AS (SELECT source, nth, source_size, weight, least(weight * max(level) OVER (), (3 * source_size)::DOUBLE) AS target FROM l),
b AS (
  SELECT d.r, d.doc_id, d.size, t.nth, t.source_size, t.weight, t.target,
         coalesce(sum(size) OVER (PARTITION BY t.nth ORDER BY key, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT r, size, nth, (k * source_size + before + size) * (10 // weight) AS finish FROM b, (VALUES (0), (1), (2)) v(k) WHERE size > 0),
q AS (SELECT r, size, sum(size) OVER (ORDER BY finish, nth ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size / 2 AS middle FROM c),
x AS (SELECT r, sum(size) AS taken FROM q WHERE middle <= (SELECT sum(size) FROM d) GROUP BY r)
SELECT doc_id, size, source_size, round(target, 6) AS target, coalesce(taken, 0)::BIGINT AS taken FROM b LEFT JOIN x USING (r)
"""

#: Phrases as joined strings: counted, cut at every place, and compared with all longer ones that hold them.
COLLOCATIONS_SQL = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
totals AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang),
g AS (SELECT lang, m, array_to_string(list_slice(ws, k, k + m - 1), ' ') AS phrase
      FROM (SELECT lang, ws, m, unnest(range(1, len(ws) - m + 2)) AS k FROM w, (VALUES (1), (2), (3), (4)) v(m) WHERE len(ws) >= m)),
f AS (SELECT lang, m, phrase, count(*)::BIGINT AS a FROM g GROUP BY lang, m, phrase HAVING count(*) >= 30),
c AS (SELECT lang, m, phrase, a, string_split(phrase, ' ') AS ws FROM f WHERE m > 1),
cuts AS (SELECT c.lang, c.m, c.phrase, c.a, x.k, h.a AS l, t.a AS r, ((2000000::HUGEINT * c.a) // (h.a + t.a))::BIGINT AS score
         FROM c JOIN (VALUES (1), (2), (3)) x(k) ON x.k < c.m
         JOIN f h ON h.lang = c.lang AND h.m = x.k AND h.phrase = array_to_string(list_slice(c.ws, 1, x.k), ' ')
         JOIN f t ON t.lang = c.lang AND t.m = c.m - x.k AND t.phrase = array_to_string(list_slice(c.ws, x.k + 1, c.m), ' ')),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, m, phrase ORDER BY score, k) = 1),
inner_phrases AS (SELECT lang, a, m, array_to_string(list_slice(ws, k, k + m - 1), ' ') AS phrase
                  FROM (SELECT c.lang, c.a, c.ws, v.m, unnest(range(1, c.m - v.m + 2)) AS k FROM c JOIN (VALUES (2), (3)) v(m) ON v.m < c.m)),
longer AS (SELECT lang, m, phrase, max(a) AS most FROM inner_phrases GROUP BY lang, m, phrase),
kept AS (SELECT b.* FROM best b LEFT JOIN longer USING (lang, m, phrase) WHERE most IS NULL OR 100 * most::HUGEINT < 80 * a::HUGEINT),
ranked AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, score FROM kept)
SELECT lang, rank::BIGINT AS rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""

ORACLE_SQL = {"op5_decontamination": DECONTAMINATION_SQL, "op7_url_filter": URL_SQL, "op9_mixing": MIXING_SQL, "op10_warc": WARC_SQL, "op11_collocations": COLLOCATIONS_SQL}
