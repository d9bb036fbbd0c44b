"""Queries of the learned analyzer: statistics of word parts, units, cut words, and what analyzers find for the Korean queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sorrel.functions import text
from sorrel.operators import lexical, morphemes, search
from sorrel.plans import search_queries as sq
from sorrel.scratch import written

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return register


def _statistics(words: str, least: int) -> str:
    """Statistics of parts in SQL, as stats; words is a query of (word, n)."""
    return f"""w AS MATERIALIZED ({words}), cut AS (SELECT word, n, unnest(range(1, least(length(word), {morphemes.LONGEST}) + 1)) AS k FROM w),
each AS (SELECT 'left' AS side, substring(word, 1, k) AS part, substring(word, k + 1, 1) AS beyond, n FROM cut
  UNION ALL SELECT 'right', substring(word, length(word) - k + 1, k), CASE WHEN k < length(word) THEN substring(word, length(word) - k, 1) ELSE '' END, n FROM cut),
b AS (SELECT side, part, beyond, sum(n) AS n FROM each GROUP BY ALL),
parts AS (SELECT side, part, sum(n) AS n, count(*) AS branches, ln(sum(n)) - sum(n * ln(n)) / sum(n) AS entropy, sum(CASE WHEN beyond = '' THEN n ELSE 0 END) AS alone FROM b GROUP BY side, part HAVING sum(n) >= {least}),
stats AS MATERIALIZED (SELECT p.*, CASE WHEN length(p.part) = 1 THEN 1.0 ELSE pow(p.n / e.n, 1 / (length(p.part) - 1)) END AS cohesion
  FROM parts p JOIN parts e ON e.side = p.side AND length(e.part) = 1 AND e.part = CASE WHEN p.side = 'left' THEN left(p.part, 1) ELSE right(p.part, 1) END)"""


_LATIN = "[A-Za-zÀ-ÿ]+"
_DOCUMENT_WORDS = f"SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(coalesce(text, ''), '{_LATIN}')) AS word FROM documents) GROUP BY word"


@query(f"WITH {_statistics(_DOCUMENT_WORDS, 5)} SELECT side, part, n::BIGINT AS n, branches::BIGINT AS branches, round(entropy, 6) + 0.0 AS entropy, round(cohesion, 6) AS cohesion, alone::BIGINT AS alone FROM stats")
def part_statistics(spark, d):
    """Beginnings and ends of all words of all documents: the analyzer's statistics hold for any script."""
    words = morphemes.word_counts(sq.load(spark, d, "documents"), F.col("text"), _LATIN)
    found = morphemes.part_statistics(words, 5)
    return found.select("side", "part", "n", "branches", (F.round("entropy", 6) + 0.0).alias("entropy"), F.round("cohesion", 6).alias("cohesion"), "alone")


_REVIEW_WORDS = "SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(b, '[가-힣]+')) AS word FROM kd) GROUP BY word"
_UNITS = f"""{sq._ENRICHED}, {_statistics(_REVIEW_WORDS, morphemes.LEAST)},
units AS MATERIALIZED (SELECT part AS unit, min(floor({morphemes.SCALE} * (ln(total) - ln(n * cohesion)) + 0.5)::BIGINT) AS cost FROM stats, (SELECT sum(n)::DOUBLE AS total FROM w)
  WHERE (alone > 0 OR (entropy >= {morphemes.BRANCHING} AND (length(part) > 1 OR side = 'right'))) AND n * {morphemes.MOST} > total GROUP BY part)"""


def review_units(spark, d) -> DataFrame:
    """The units learned from all reviews, written."""
    words = morphemes.word_counts(sq.review_sources(spark, d), F.col("content"))
    return written(morphemes.learn_units(words), "units")


@query(f"WITH {_UNITS} SELECT unit, cost FROM units")
def learned_units(spark, d):
    return review_units(spark, d)


#: All paths through the lattices of the words of reviews and queries; the cheapest, its neighbouring unknown letters joined.
_CUT = f"""{sq._AIMED}, {_UNITS}, words AS MATERIALIZED (SELECT word FROM w UNION SELECT unnest(regexp_extract_all(query, '[가-힣]+')) FROM k),
spots AS (SELECT word, unnest(range(0, length(word))) AS spot FROM words),
edges AS MATERIALIZED (SELECT word, spot, length(unit) AS len, cost FROM spots JOIN units ON substring(word, spot + 1, length(unit)) = unit
  UNION ALL SELECT word, spot, 1, (SELECT max(cost) FROM units) + {int(morphemes.UNKNOWN * morphemes.SCALE)} FROM spots),
paths AS (SELECT word, 0::BIGINT AS spot, 0::BIGINT AS cost, 0 AS steps, []::BIGINT[] AS lens FROM words
  UNION ALL SELECT p.word, p.spot + e.len, p.cost + e.cost, p.steps + 1, list_append(p.lens, e.len) FROM paths p JOIN edges e ON e.word = p.word AND e.spot = p.spot),
best AS (SELECT * FROM paths WHERE spot = length(word) QUALIFY row_number() OVER (PARTITION BY word ORDER BY cost, steps, lens DESC) = 1),
steps AS (SELECT word, nth, substring(word, 1 + list_sum(lens[1:nth])::BIGINT - lens[nth], lens[nth]) AS unit FROM (SELECT word, lens, unnest(range(1, len(lens) + 1)) AS nth FROM best)),
marked AS (SELECT word, nth, unit, unit NOT IN (SELECT unit FROM units) AS unknown FROM steps),
grouped AS (SELECT word, nth, unit, sum(CASE WHEN unknown AND coalesce(before, FALSE) THEN 0 ELSE 1 END) OVER (PARTITION BY word ORDER BY nth) AS part FROM (SELECT *, lag(unknown) OVER (PARTITION BY word ORDER BY nth) AS before FROM marked)),
joined AS MATERIALIZED (SELECT word, part, string_agg(unit, '' ORDER BY nth) AS unit FROM grouped GROUP BY word, part)"""


@query(f"WITH RECURSIVE {_CUT} SELECT word, string_agg(unit, '+' ORDER BY part) AS units FROM joined GROUP BY word")
def cut_words(spark, d):
    """Every word of the reviews and the queries, cut along its cheapest path."""
    words = morphemes.word_counts(sq.review_sources(spark, d), F.col("content")).select("word")
    asked = morphemes.word_counts(sq.korean(spark), F.col("query")).select("word")
    cut = morphemes.analyzer(review_units(spark, d))
    return words.union(asked).distinct().select("word", F.array_join(cut(F.col("word")), "+").alias("units"))


#: Tokens of reviews (doc_id, term) and queries (query_id, term) under each analyzer, in SQL.
_RUNS = "SELECT doc_id, unnest(regexp_extract_all(b, '[가-힣]+')) AS word FROM kd", "SELECT query_id, unnest(regexp_extract_all(query, '[가-힣]+')) AS word FROM k"
_PAIRS = "SELECT {0}, unnest(CASE WHEN length(word) >= 3 THEN [substring(word, k, 2) FOR k IN range(1, length(word))] ELSE [word] END) AS term FROM {1}"


def _tokens(side: str, runs: str) -> str:
    return f"SELECT 'words' AS analyzer, {side}, word AS term FROM {runs} UNION ALL SELECT 'pairs', * FROM ({_PAIRS.format(side, runs)}) UNION ALL SELECT 'units', {side}, unit FROM {runs} JOIN joined USING (word)"


_ANALYZER_SQL = f"""WITH RECURSIVE {_CUT}, dr AS ({_RUNS[0]}), qr AS ({_RUNS[1]}), dt AS ({_tokens('doc_id', 'dr')}), qt AS ({_tokens('query_id', 'qr')}),
dl AS (SELECT analyzer, doc_id, count(*) AS dl FROM dt GROUP BY ALL), st AS (SELECT analyzer, count(*) AS n, avg(dl) AS avgdl FROM dl GROUP BY analyzer),
p AS (SELECT analyzer, doc_id, term, count(*) AS tf FROM dt GROUP BY ALL), df AS (SELECT analyzer, term, count(*) AS df FROM p GROUP BY ALL), q AS (SELECT analyzer, query_id, term, count(*) AS c FROM qt GROUP BY ALL),
sc AS (SELECT analyzer, query_id, doc_id, round(sum(c * {sq._GAIN}), 9) AS score FROM p JOIN q USING (analyzer, term) JOIN df USING (analyzer, term) JOIN dl USING (analyzer, doc_id) JOIN st USING (analyzer) GROUP BY ALL),
top AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY analyzer, query_id ORDER BY score DESC, doc_id) <= 100),
rel AS (SELECT query_id, doc_id FROM a JOIN en ON len([1 FOR s IN issues IF s.c = aspect AND s.m = sentiment]) > 0 WHERE aspect <> '기타' AND sentiment IN ('positive', 'negative')),
every AS (SELECT analyzer, query_id, count(*) AS relevant FROM rel, (VALUES ('words'), ('pairs'), ('units')) v(analyzer) GROUP BY ALL)
SELECT analyzer, query_id::INT AS query_id, relevant::BIGINT AS relevant, (SELECT count(*) FROM top JOIN rel USING (query_id, doc_id) WHERE top.analyzer = every.analyzer AND top.query_id = every.query_id)::BIGINT AS hits FROM every"""


@query(_ANALYZER_SQL)
def analyzer_recall(spark, d):
    """Of the reviews whose issues are what a query asks for, how many stand among its first hundred under each analyzer of Hangul."""
    reviews, asked = sq.review_sources(spark, d), search.settled(search.expand(sq.korean(spark)))
    kept = F.col("content")
    analyzers = {"words": morphemes.hangul_words, "pairs": lambda c: text.hangul_bigrams(F.array_join(morphemes.hangul_words(c), " ")), "units": morphemes.analyzer(review_units(spark, d), others=False)}
    issues = sq.korean_reviews(spark, d).select(F.col("review_id").alias("doc_id"), "issue_sentiments")
    aimed = asked.where((F.col("target_aspect") != "기타") & F.col("target_sentiment").isin("positive", "negative")).select("query_id", "target_aspect", "target_sentiment")
    each = issues.select("doc_id", F.explode("issue_sentiments").alias("s")).select("doc_id", F.col("s.issue_category").alias("target_aspect"), F.col("s.sentiment").alias("target_sentiment")).distinct()
    relevant = written(each.join(aimed, ["target_aspect", "target_sentiment"]).select("query_id", "doc_id"), "relevant")
    found = []
    for name, tokens in analyzers.items():
        index = lexical.build_index(reviews, "review_id", {"content": tokens(kept)})
        scored = lexical.match(index, asked, tokens(F.col("query")), {"content": 1.0}).withColumn("score", F.round("score", 9))
        top = search.ranked(scored, 100).select("query_id", "doc_id", F.lit(1).alias("met"))
        counted = relevant.join(top, ["query_id", "doc_id"], "left").groupBy("query_id").agg(F.count(F.lit(1)).alias("relevant"), F.count("met").alias("hits"))
        found.append(counted.select(F.lit(name).alias("analyzer"), "query_id", "relevant", "hits"))
    return reduce(DataFrame.unionByName, found)
