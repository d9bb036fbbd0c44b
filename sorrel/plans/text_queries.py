"""Queries over documents, pages, conversations and events: cleaning, keys, building, nested and JSON data, upserts."""

from __future__ import annotations

from pyspark.sql import functions as F

from sorrel.functions import arrays, text
from sorrel.operators import documents as docs_ops
from sorrel.operators import enrich, learning, lexical
from sorrel.scratch import scratch_path, written
from sorrel.session import spread
from sorrel.sources import files
from sorrel.streaming import ingest
from sorrel.vocab import ISSUE_CATEGORIES

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def load(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def texts(spark, d):
    """documents, dealt over all cores where they are few."""
    return spread(load(spark, d, "documents"))


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


#: The cleaners in DuckDB, whose regular expressions have no back-references.
_REMOVED = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '<[^>]+>', ' ', 'g'), 'https?://\S+|www\.\S+', ' ', 'g'),
  '[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_-]+(?:\.[\p{L}\p{N}_-]+)+', ' ', 'g'), '\b(?:\d{2,3}[-.\s]?\d{3,4}[-.\s]?\d{4})\b', ' ', 'g')"""
_RUNS = r"regexp_replace(regexp_replace(regexp_replace({}, '!{{3,}}', '!!!', 'g'), '\?{{3,}}', '???', 'g'), '\.{{3,}}', '...', 'g')"
_CLEAN = rf"trim(regexp_replace({_RUNS.format(_REMOVED)}, '\s+', ' ', 'g'))"
_CONTROLS = r"regexp_replace({}, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', ' ', 'g')".format(_REMOVED)
_CLEAN_SENTIMENT = rf"trim(regexp_replace({_RUNS.format(_CONTROLS)}, '\s+', ' ', 'g'))"
_PRINT = "regexp_replace(lower(text), '[^0-9a-z가-힣]', '', 'g')"
_SIGNAL = "length(c) >= 10 AND length(regexp_replace(c, '[^0-9A-Za-z가-힣]', '', 'g')) >= 10"


@query(f"SELECT doc_id, md5({_CLEAN}) AS cleaned, length({_CLEAN})::BIGINT AS n FROM documents")
def clean_text_doc(spark, d):
    c = text.clean_document(F.col("text"))
    return texts(spark, d).select("doc_id", c.alias("c")).select("doc_id", F.md5(F.col("c").cast("binary")).alias("cleaned"), F.length("c").cast("long").alias("n"))


@query(f"SELECT doc_id, md5({_CLEAN_SENTIMENT}) AS cleaned FROM documents")
def clean_text_sentiment(spark, d):
    return texts(spark, d).select("doc_id", F.md5(text.clean_sentiment(F.col("text")).cast("binary")).alias("cleaned"))


#: What is hung on every document, and what by hand each cleaner must make of it: entities, wide letters, a zero-width character,
#: a tag, an address, a URL, a number, control characters, and runs of letters and marks. NFKC turns a lone ㅋ or ㅎ into another character.
HUNG = " &lt;b&gt;굿&lt;/b&gt; ＡＢ１ ze\u200bro ㅋㅋㅋㅋㅋㅋㅋ ㅎㅎㅎㅎㅎ ㅠㅠㅠㅠㅠㅠ 좋아아아아아 !!!!! ???? wow..... a.b@c.co http://x.y/z?q 010-1234-5678 &amp; end"
HUNG_DOCUMENT = " 굿 AB1 zero " + "\u110f" * 7 + " " + "\u1112" * 5 + " " + "\u1172" * 6 + " 좋아아아아아 !!! ??? wow... & end"
HUNG_SENTIMENT = " 굿 ＡＢ１ zero ㅋㅋㅋㅋ ㅎㅎㅎㅎ ㅠㅠㅠㅠ 좋아아 !!! ??? wow... & end"


@query(f"SELECT doc_id, md5(trim({_CLEAN} || '{HUNG_DOCUMENT}')) AS document, md5(trim({_CLEAN_SENTIMENT} || '{HUNG_SENTIMENT}')) AS sentiment FROM documents")
def clean_hung(spark, d):
    """Both cleaners on texts that hold something for every step."""
    hung = texts(spark, d).select("doc_id", F.concat("text", F.lit(HUNG)).alias("t"))
    cleaned = hung.select("doc_id", text.clean_document(F.col("t")).alias("a"), text.clean_sentiment(F.col("t")).alias("b"))
    return cleaned.select("doc_id", F.md5(F.col("a").cast("binary")).alias("document"), F.md5(F.col("b").cast("binary")).alias("sentiment"))


@query(r"SELECT page_id, md5(trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))) AS stripped FROM pages")
def html_strip(spark, d):
    return load(spark, d, "pages").select("page_id", F.md5(text.run_steps(F.col("html"), (text.blanked(text.TAGS), text.squeeze)).cast("binary")).alias("stripped"))


@query(f"SELECT doc_id FROM (SELECT doc_id, text AS c FROM documents) WHERE {_SIGNAL}")
def signal_filter(spark, d):
    return load(spark, d, "documents").where(text.has_signal(F.col("text"))).select("doc_id")


@query(rf"SELECT doc_id, md5({_PRINT}) AS a, md5(regexp_replace(lower(text), '[^\p{{L}}\p{{N}}]', '', 'g')) AS b, substring({_PRINT}, 1, 200) AS c FROM documents")
def fingerprints(spark, d):
    t = F.col("text")
    return load(spark, d, "documents").select("doc_id", F.md5(text.fingerprint(t).cast("binary")).alias("a"), F.md5(text.fingerprint_any(t).cast("binary")).alias("b"), text.fingerprint_prefix(t).alias("c"))


@query("""SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY regexp_replace(lower(text), '[^0-9a-z가-힣]', '', 'g') ORDER BY doc_id) AS nth FROM documents) WHERE nth = 1""")
def dedupe_first(spark, d):
    rows = load(spark, d, "documents").select("doc_id", text.fingerprint(F.col("text")).alias("print"))
    return docs_ops.dedupe_first(rows, "print", ["doc_id"]).select("doc_id")


def review_rows(spark, d):
    """documents in the shape of raw reviews, every field filled; three in a row share an id."""
    i = F.col("doc_id")
    answer = lambda q, t: F.struct(F.lit(q).alias("question"), t.alias("answer"))
    return texts(spark, d).select(
        (i - i % 3).cast("string").alias("reviewId"), F.lit(None).cast("string").alias("review_id"), F.when(i % 2 == 0, F.lit("2024-01-02T03:04:05")).otherwise(F.concat((i * 1000).cast("string"))).alias("reviewAt"),
        F.col("source").alias("product_name"), F.lit("").alias("itemName"), F.col("lang").alias("item_name"), F.concat(F.lit("&lt;i&gt;T&lt;/i&gt; "), F.col("lang")).alias("title"), F.col("text").alias("content"),
        F.when(i % 4 == 0, F.lit("nan")).otherwise(F.col("source")).alias("summary"), F.lit(None).cast("string").alias("short_summary"), F.lit(None).cast("string").alias("aspect"), F.array("lang", "source").alias("aspect_keywords"),
        F.when(i % 5 == 0, F.lit("NaN")).otherwise((i % 5).cast("string")).alias("rating"), F.array(answer("ok?", F.col("source")), answer("", F.lit("x")), answer("why", F.concat(F.lit("&amp; "), F.col("lang")))).alias("reviewSurveyAnswers"),
        F.lit("3").alias("helpfulCount"), F.lit("2").alias("helpfulTrueCount"), F.lit("1").alias("helpfulFalseCount"), F.when(i % 2 == 0, F.array(F.lit("a"))).alias("attachments"), F.array().cast("array<string>").alias("videoAttachments"), "doc_id",
    )


def _greedy(rows: str) -> str:
    """The rows that a pass in order keeps, by recursion: rows is a table of (k, id, print), numbered from 1."""
    known = "list_contains(ids, r.id) OR list_contains(prints, r.print)"
    step = lambda a, b: f"CASE WHEN {known} THEN {a} ELSE list_append({a}, r.{b}) END"
    return f"""walked AS (SELECT 0::BIGINT AS k, []::VARCHAR[] AS ids, []::VARCHAR[] AS prints, []::BIGINT[] AS kept
  UNION ALL SELECT r.k, {step('ids', 'id')}, {step('prints', 'print')}, {step('kept', 'k')} FROM walked JOIN {rows} r ON r.k = walked.k + 1),
stays AS (SELECT unnest(kept) AS k FROM (SELECT kept FROM walked ORDER BY k DESC LIMIT 1))"""


@query(f"""WITH RECURSIVE c AS (SELECT doc_id, (doc_id - doc_id % 3)::VARCHAR AS id, source, lang, {_CLEAN} AS c FROM documents),
u AS (SELECT *, md5({_PRINT.replace('text', 'c')}) AS print, row_number() OVER (ORDER BY doc_id) AS k FROM c WHERE {_SIGNAL} AND coalesce(source, '') <> ''), {_greedy('u')}
SELECT id AS review_id, (CASE WHEN doc_id % 2 = 0 THEN 1704164645 ELSE doc_id END)::BIGINT AS review_at, source AS product_name, lang AS item_name, 'T ' || lang AS title, md5(c) AS content, (doc_id % 5)::INT AS rating, 3 AS helpful_count, 2 AS helpful_true_count,
       1 AS helpful_false_count, doc_id % 2 = 0 AS has_image, false AS has_video, CASE WHEN doc_id % 4 > 0 THEN source END AS short_summary, lang || ' ' || source AS aspect, 'ok?=' || source || ';why=& ' || lang AS answers,
       md5('상품명: ' || source || chr(10) || '옵션명: ' || lang || chr(10) || '제목: T ' || lang || chr(10) || '본문: ' || c || chr(10) || CASE WHEN doc_id % 4 > 0 THEN '요약: ' || source || chr(10) ELSE '' END || '관점 키워드: ' || lang || ' ' || source || chr(10) || '설문 응답: ok?: ' || source || ' / why: & ' || lang) AS dense
FROM u JOIN stays USING (k)""")
def build_documents(spark, d):
    """Reviews in order of doc_id, of which those that share an id or a content with one kept before are dropped."""
    built = docs_ops.build_documents(review_rows(spark, d), "doc_id")
    told = F.array_join(F.transform("review_survey_answers", lambda s: F.concat(s["question"], F.lit("="), s["answer"])), ";")
    return built.select(
        "review_id", F.unix_timestamp("review_at").alias("review_at"), "product_name", "item_name", "title", F.md5(F.col("content").cast("binary")).alias("content"), "rating", "helpful_count", "helpful_true_count", "helpful_false_count",
        "has_image", "has_video", "short_summary", F.array_join("aspect_keywords", "|").alias("aspect"), told.alias("answers"), F.md5(F.col("dense_text").cast("binary")).alias("dense"),
    )


@query(f"""WITH RECURSIVE u AS (SELECT row_number() OVER (ORDER BY doc_id) AS k, doc_id, (doc_id // 2)::VARCHAR AS id, md5({_PRINT}) AS print FROM documents), {_greedy('u')} SELECT doc_id FROM u JOIN stays USING (k)""")
def dedupe_greedy(spark, d):
    """The rows that a pass in order of doc_id keeps, where two in a row share an id."""
    rows = texts(spark, d).select("doc_id", F.floor(F.col("doc_id") / 2).alias("id"), text.fingerprint(F.col("text")).alias("print"))
    return docs_ops.dedupe_greedy(rows, "id", "print", "doc_id").select("doc_id")


@query("""SELECT conv_id, count(*)::BIGINT AS answers, md5(string_agg(role || ': ' || trim(text), ' / ' ORDER BY turn, text, role)) AS survey FROM conversations WHERE coalesce(role, '') <> '' AND coalesce(text, '') <> '' GROUP BY conv_id""")
def survey_nested_whole(spark, d):
    """Whole answers, as a digest of the joined text."""
    rows = load(spark, d, "conversations").where((F.coalesce("role", F.lit("")) != "") & (F.coalesce("text", F.lit("")) != ""))
    nested = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text", "role"))).alias("turns"))
    lines = F.transform("turns", lambda s: F.concat(s["role"], F.lit(": "), F.trim(s["text"])))
    return nested.select("conv_id", F.size("turns").cast("long").alias("answers"), F.md5(F.array_join(lines, " / ").cast("binary")).alias("survey"))


@query("SELECT doc_id, coalesce(nullif(lang, ''), nullif(source, ''), '') AS name FROM documents")
def alias_coalesce(spark, d):
    return load(spark, d, "documents").select("doc_id", F.coalesce(arrays.first_filled(F.col("lang"), F.col("source")), F.lit("")).alias("name"))


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN lang || '+' || source WHEN 1 THEN source WHEN 2 THEN '' ELSE lang END AS items, (CASE doc_id % 4 WHEN 0 THEN 2 WHEN 2 THEN 0 ELSE 1 END)::BIGINT AS n FROM documents")
def scalar_or_list(spark, d):
    """Values that are a JSON list, a text, nothing, or a list with a null."""
    i = F.col("doc_id")
    value = F.when(i % 4 == 0, F.to_json(F.array("lang", "source"))).when(i % 4 == 1, F.col("source")).when(i % 4 == 2, F.when(i % 8 == 2, F.lit(" "))).otherwise(F.concat(F.lit('["'), "lang", F.lit('", null]')))
    rows = load(spark, d, "documents").select("doc_id", arrays.listed(value).alias("v"))
    return rows.select("doc_id", F.array_join("v", "+").alias("items"), F.size("v").cast("long").alias("n"))


@query(r"SELECT doc_id, len(t)::BIGINT AS n, len(list_distinct(t))::BIGINT AS n_distinct FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS t FROM documents)")
def tokenize_standard(spark, d):
    rows = texts(spark, d).select("doc_id", text.tokens(F.col("text")).alias("t"))
    return rows.select("doc_id", F.size("t").cast("long").alias("n"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"))


_GRAMS = r"""w AS (SELECT item_id, ' ' || w || ' ' AS w FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '\S+')) AS w FROM benchmark)),
g AS (SELECT item_id, substring(w, k, n) AS term FROM (SELECT item_id, w, n, unnest(range(1, length(w) - n + 2)) AS k FROM w, (VALUES (2), (3), (4), (5)) v(n) WHERE length(w) > n)
      UNION ALL SELECT item_id, w FROM w WHERE length(w) <= 5)"""


@query(f"WITH {_GRAMS} SELECT item_id, term, count(*)::BIGINT AS n FROM g GROUP BY item_id, term")
def char_wb_ngrams(spark, d):
    grams = load(spark, d, "benchmark").select("item_id", F.explode(text.char_wb_ngrams(F.col("text"))).alias("term"))
    return grams.groupBy("item_id", "term").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_GRAMS}, tf AS (SELECT item_id, term, count(*) AS tf FROM g GROUP BY item_id, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term HAVING count(*) >= 2),
r AS (SELECT item_id, term, (1 + ln(tf)) * (ln((1.0 + (SELECT count(*) FROM benchmark)) / (1 + df)) + 1) AS raw FROM tf JOIN df USING (term))
SELECT item_id, term, round(raw / sqrt(sum(raw * raw) OVER (PARTITION BY item_id)), 6) AS weight FROM r""")
def tfidf_weights(spark, d):
    weighed = learning.tfidf(load(spark, d, "benchmark"), "item_id", text.char_wb_ngrams(F.col("text")))
    return weighed.select("item_id", "term", F.round("weight", 6).alias("weight"))


def document_grams(spark, d):
    """(doc_id, term, n) of all documents."""
    counted = texts(spark, d).select("doc_id", text.char_wb_counts(F.col("text")).alias("g")).select("doc_id", F.explode(F.arrays_zip("g.terms", "g.tfs")).alias("g"))
    return counted.select("doc_id", F.col("g.terms").alias("term"), F.col("g.tfs").cast("long").alias("n"))


@query()
def char_wb_ngrams_documents(spark, d):
    """char_wb_ngrams over documents. Tests hold it against brute force; there is no SQL."""
    return document_grams(spark, d)


@query()
def tfidf_weights_documents(spark, d):
    """tfidf_weights over documents. Tests hold it against brute force; there is no SQL."""
    weighed = learning.weights_of_texts(texts(spark, d), "doc_id", "text")
    return weighed.select("doc_id", "term", F.round("weight", 6).alias("weight"))


@query(r"SELECT term, count(*)::BIGINT AS df, sum(tf)::BIGINT AS cf FROM (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM documents) GROUP BY doc_id, term) GROUP BY term")
def postings(spark, d):
    index = lexical.build_index(texts(spark, d), "doc_id", {"text": text.tokens(F.col("text"))})
    return index.postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


_CATEGORY = "[" + ", ".join(f"'{c}'" for c in ISSUE_CATEGORIES) + "]"


@query(f"""WITH e AS (SELECT event_id, (props->>'k')::BIGINT AS k, event_type FROM events)
SELECT event_id, {_CATEGORY}[(k % 10) + 1] AS first, CASE WHEN k % 10 = 9 THEN '기타' ELSE '기타' END AS last,
       CASE WHEN lower(trim(event_type)) IN ('positive', 'negative', 'mixed', 'neutral') THEN event_type ELSE 'neutral' END AS sentiment, 5::BIGINT AS n_keywords, event_type AS summary FROM e""")
def json_metadata_normalize(spark, d):
    """Events as a model's answers: one known category, one unknown, a sentiment that no enumeration has."""
    events = load(spark, d, "events").withColumn("k", F.from_json("props", "k long")["k"])
    named = F.element_at(F.array(*[F.lit(c) for c in ISSUE_CATEGORIES]), (F.col("k") % 10 + 1).cast("int"))
    answer = F.to_json(F.struct(F.array(named, F.lit("x"), named).alias("issue_category"), F.array("event_type", F.lit(" ")).alias("aspect_keywords"),
                                F.array(F.struct(F.lit("?").alias("issue_category"), F.col("event_type").alias("sentiment"), F.lit("e").alias("evidence"))).alias("issue_sentiments"), F.col("event_type").alias("short_summary")))
    meta = events.select("event_id", arrays.parsed_metadata(answer).alias("m"))
    return meta.select("event_id", F.element_at("m.issue_category", 1).alias("first"), F.element_at("m.issue_category", -1).alias("last"), F.element_at("m.issue_sentiments", 1)["sentiment"].alias("sentiment"),
                       F.size("m.aspect_keywords").cast("long").alias("n_keywords"), F.col("m.short_summary").alias("summary"))


@query("SELECT event_id, (props->>'k')::BIGINT AS k FROM events WHERE json_valid(props)")
def json_tolerant_scan(spark, d):
    parsed = load(spark, d, "events").withColumn("p", F.from_json("props", "k long, _bad string", {"columnNameOfCorruptRecord": "_bad"}))
    return parsed.where(F.col("p").isNotNull() & F.col("p._bad").isNull()).select("event_id", F.col("p.k").alias("k"))


@query("SELECT doc_id, '기타' AS category, 0::BIGINT AS n_keywords, '' AS summary FROM documents")
def llm_metadata_defaults(spark, d):
    meta = load(spark, d, "documents").select("doc_id", arrays.parsed_metadata(F.lit(None).cast("string")).alias("m"))
    return meta.select("doc_id", F.array_join("m.issue_category", ",").alias("category"), F.size("m.aspect_keywords").cast("long").alias("n_keywords"), F.col("m.short_summary").alias("summary"))


@query("SELECT doc_id FROM documents WHERE doc_id % 3 <> 0 AND regexp_replace(lower(text), '[^\\p{L}\\p{N}]', '', 'g') NOT IN (SELECT regexp_replace(lower(text), '[^\\p{L}\\p{N}]', '', 'g') FROM documents WHERE doc_id % 3 = 0 AND text IS NOT NULL)")
def checkpoint_antijoin(spark, d):
    """A third of the documents as what a checkpoint holds; all others are new unless their content is known."""
    docs = load(spark, d, "documents")
    return docs_ops.without_known(docs, docs.where("doc_id % 3 = 0"), "doc_id", "text").select("doc_id")


@query("SELECT user_id, max_by(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY user_id")
def upsert_last_wins(spark, d):
    """Events written to a table keyed by user in two steps; of each key the last row stands."""
    rows = load(spark, d, "events").select("user_id", "event_type", "event_id")
    early = files.last_of_each(rows.where("event_id % 2 = 0"), "user_id", "event_id")
    late = rows.where("event_id % 2 = 1").join(early.select("user_id", F.col("event_id").alias("seen")), "user_id", "left").where("seen IS NULL OR event_id > seen").drop("seen")
    return files.upsert(early, late, "user_id", "event_id").select("user_id", "event_type", "event_id")


def _stream_input(docs, keep):
    """documents as reviews in a stream; every fourth shares the id of the one before it."""
    i = F.col("doc_id")
    named = docs.select((i - (i % 4 == 1).cast("int")).cast("string").alias("review_id"), F.col("source").alias("product_name"), text.clean_document(F.col("text")).alias("content"), i.alias("kept_column"))
    return named.withColumn("error", F.when(F.col("content").isNull() | ~text.has_signal(F.col("content")), "too little signal"))


STEPS = ingest.Steps(
    prepare=_stream_input,
    enrich=lambda docs: docs.withColumn("error", F.when(F.length("content") % 50 == 7, "no answer")),
    index=lambda docs, batch: docs.where(F.length("content") % 50 == 8).select("review_id", F.lit("refused").alias("error")),
)

_PRINT_ANY = r"regexp_replace(lower(c), '[^\p{L}\p{N}]', '', 'g')"
_STREAM = f"""WITH RECURSIVE c AS (SELECT doc_id, (doc_id - (doc_id % 4 = 1)::INT)::VARCHAR AS review_id, {_CLEAN} AS c FROM documents),
u AS (SELECT *, review_id AS id, md5({_PRINT_ANY}) AS print, row_number() OVER (ORDER BY doc_id) AS k FROM c WHERE {_SIGNAL}), {_greedy('u')}, fresh AS (SELECT * FROM u JOIN stays USING (k)), kept AS (SELECT * FROM fresh WHERE length(c) % 50 <> 7)"""


def ingested(spark, d):
    """(table, failures, counts) of all documents, ingested as one batch."""
    folder = scratch_path(spark, "ingest")
    counts = ingest.ingest_batch(load(spark, d, "documents"), 0, f"{folder}/docs", f"{folder}/failures", STEPS)
    return ingest.stored(spark, f"{folder}/docs"), ingest.dead_letters(spark, f"{folder}/failures"), counts


@query(f"{_STREAM} SELECT review_id, md5(c) AS content FROM kept")
def ingest_stream(spark, d):
    """documents as a stream into the document table: of an id or a content the first stands, without those whose enrichment fails."""
    folder = scratch_path(spark, "ingest")
    source = spark.readStream.schema(load(spark, d, "documents").schema).option("pathGlobFilter", "*.parquet").parquet(_stream_folder(spark, d))
    ingest.ingest_stream(source, f"{folder}/docs", f"{folder}/failures", f"{folder}/state", STEPS).awaitTermination()
    return ingest.stored(spark, f"{folder}/docs").select("review_id", F.md5(F.col("content").cast("binary")).alias("content"))


@query(f"{_STREAM} SELECT 'preprocess' AS stage, review_id, 'too little signal' AS error FROM c WHERE c IS NULL OR NOT ({_SIGNAL}) UNION ALL SELECT 'llm_enrich', review_id, 'no answer' FROM fresh WHERE length(c) % 50 = 7 UNION ALL SELECT 'index', review_id, 'refused' FROM kept WHERE length(c) % 50 = 8")
def dead_letters(spark, d):
    """What the ingestion logged, by stage."""
    return ingested(spark, d)[1].select("stage", "review_id", "error")


@query(f"{_STREAM} SELECT (SELECT count(*) FROM c)::BIGINT AS processed, 0::BIGINT AS resumed, ((SELECT count(*) FROM c WHERE c IS NULL OR NOT ({_SIGNAL})) + (SELECT count(*) FROM fresh WHERE length(c) % 50 = 7))::BIGINT AS failed, (SELECT count(*) FROM kept)::BIGINT AS kept, (SELECT count(*) FROM kept WHERE length(c) % 50 <> 8)::BIGINT AS indexed")
def ingest_counts(spark, d):
    counts = ingested(spark, d)[2]
    return spark.createDataFrame([tuple(counts.values())], ", ".join(f"{n} long" for n in counts))


PLAIN_STEPS = ingest.Steps(prepare=lambda docs, keep: docs.select(F.col("doc_id").cast("string").alias("review_id"), text.clean_document(F.col("text")).alias("content"), keep.alias("kept_column")).withColumn("error", F.when(~text.has_signal(F.col("content")), "too little signal")))

_BATCHES = f"""WITH c AS (SELECT doc_id, doc_id % 3 AS batch, {_CLEAN} AS c FROM documents), u AS (SELECT *, row_number() OVER (PARTITION BY md5({_PRINT_ANY}) ORDER BY batch, doc_id) AS nth FROM c WHERE {_SIGNAL}),
n AS (SELECT batch, count(*) AS processed, count(*) FILTER (NOT coalesce({_SIGNAL}, FALSE)) AS failed FROM c GROUP BY batch), kept AS (SELECT batch, count(*) AS kept FROM u WHERE nth = 1 GROUP BY batch),
b AS (SELECT batch, processed, failed, coalesce(kept, 0) AS kept FROM n LEFT JOIN kept USING (batch)), z AS (SELECT * FROM b WHERE batch = 0)"""


@query(f"{_BATCHES} SELECT b.batch::INT AS batch, (b.processed + CASE WHEN b.batch = 2 THEN z.processed ELSE 0 END)::BIGINT AS processed, (CASE WHEN b.batch = 2 THEN z.kept ELSE 0 END)::BIGINT AS resumed, (b.failed + CASE WHEN b.batch = 2 THEN z.failed ELSE 0 END)::BIGINT AS failed, b.kept::BIGINT AS kept FROM b, z")
def ingest_resumed(spark, d):
    """All documents in three batches, with a restart that runs the second again; the third brings the first's rows once more, which are skipped by their ids or contents."""
    folder, docs = scratch_path(spark, "resumed"), load(spark, d, "documents").withColumn("review_id", F.col("doc_id").cast("string"))
    counts = []
    for number, remainders in ((0, (0,)), (1, (1,)), (1, (1,)), (2, (0, 2))):
        found = ingest.ingest_batch(docs.where((F.col("doc_id") % 3).isin(*remainders)), number, f"{folder}/docs", f"{folder}/failures", PLAIN_STEPS)
        counts.append((number, *[found[c] for c in ("processed", "resumed", "failed", "kept")]))
    return spark.createDataFrame([counts[0], *counts[2:]], "batch int, processed long, resumed long, failed long, kept long")


def _stream_folder(spark, d) -> str:
    """A stream reads a folder: the table itself where it is one, else the single file by a glob of its folder."""
    return f"{d}/documents.parquet*" if not d.endswith("/") else f"{d}documents.parquet*"


@query("SELECT doc_id, lang, source, n_chars, md5(text) AS digest FROM documents")
def json_lines(spark, d):
    """documents appended to JSON lines in two steps and read back strictly."""
    folder = scratch_path(spark, "lines")
    rows = load(spark, d, "documents")
    files.append_lines(rows.where("doc_id % 2 = 0"), folder)
    files.append_lines(rows.where("doc_id % 2 = 1"), folder)
    back = files.read_lines_strict(spark, folder, "doc_id long, lang string, source string, n_chars long, text string")
    return back.select("doc_id", "lang", "source", "n_chars", F.md5(F.col("text").cast("binary")).alias("digest"))


@query("SELECT doc_id, lang FROM documents WHERE doc_id % 3 = 0")
def json_lines_tolerant(spark, d):
    """JSON lines of which every third is blank and every third cut short: the others are read."""
    folder = scratch_path(spark, "damaged")
    whole = F.to_json(F.struct("doc_id", "lang"))
    line = F.when(F.col("doc_id") % 3 == 1, F.lit("")).when(F.col("doc_id") % 3 == 2, F.substring(whole, 1, 9)).otherwise(whole)
    load(spark, d, "documents").select(line.alias("value")).write.text(folder)
    return files.read_lines(spark, folder, "doc_id long, lang string").select("doc_id", "lang")


@query("SELECT n_nationkey, n_name, '한글' AS letters FROM nation")
def json_document(spark, d):
    """A table as a JSON array under a name with its time, each task's part in a file, and read back."""
    rows = load(spark, d, "nation").select("n_nationkey", "n_name", F.lit("한글").alias("letters"))
    path = files.timestamped(scratch_path(spark, "document"), "nations")
    files.write_array(rows, path)
    kind = load(spark, d, "nation").schema["n_nationkey"].dataType.simpleString()
    return files.read_json(spark, path, f"n_nationkey {kind}, n_name string, letters string")


@query("SELECT conv_id, turn, role, md5(text) AS digest FROM conversations")
def csv_sink(spark, d):
    """conversations as CSV with a header, and back: columns by their order, quotes and line ends kept."""
    folder = scratch_path(spark, "csv")
    files.write_csv(load(spark, d, "conversations"), folder)
    back = files.read_csv(spark, folder, "conv_id long, turn long, role string, text string")
    return back.select("conv_id", "turn", "role", F.md5(F.col("text").cast("binary")).alias("digest"))


@query("SELECT doc_id::VARCHAR AS review_id, quality::INT AS label FROM labels")
def labelled_reviews(spark, d):
    """labels as labelled reviews in JSON, read with the demand that each has its id."""
    folder = scratch_path(spark, "labelled")
    load(spark, d, "labels").select(F.col("doc_id").cast("string").alias("review_id"), F.col("quality").cast("int").alias("label")).write.json(folder)
    return files.required(files.read_lines_strict(spark, folder, "review_id string, label int"), "review_id", "label")


@query("SELECT item_id::VARCHAR AS query_id, md5(text) AS query, 'c' || (item_id % 3) AS category, item_id || ',' || (item_id + 1) AS gold FROM benchmark")
def evaluation_set(spark, d):
    """benchmark as an evaluation set: JSON objects by query, as files of tasks, with ids under both names and a blank one."""
    i = F.col("item_id").cast("string")
    gold = F.array(F.struct(i.alias("reviewId"), F.lit(None).cast("string").alias("review_id")), F.struct(F.lit(None).cast("string").alias("reviewId"), (F.col("item_id") + 1).cast("string").alias("review_id")), F.struct(F.lit("").alias("reviewId"), F.lit("").alias("review_id")))
    entry = F.struct(F.col("text").alias("query"), F.concat(F.lit("c"), (F.col("item_id") % 3).cast("string")).alias("category"), gold.alias("reviews_to_evaluate"))
    path = f"{scratch_path(spark, 'evaluation')}/sets"
    files.write_object(load(spark, d, "benchmark").select(i.alias("query_id"), entry.alias("entry")), "query_id", "entry", path)
    read = files.load_evaluation(spark, path)
    return read.select("query_id", F.md5(F.col("query").cast("binary")).alias("query"), "category", F.array_join("gold", ",").alias("gold"))


@query("SELECT row_number() OVER (ORDER BY doc_id) AS ordinal, doc_id FROM documents")
def record_ordinals(spark, d):
    """Numbers of rows in order: sorted in ranges, written and numbered by their parts."""
    docs = load(spark, d, "documents").select("doc_id")
    return files.numbered(docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id")).select("ordinal", "doc_id")


@query("SELECT doc_id, CASE WHEN length(text) > 80 THEN regexp_replace(left(text, 80), '\\s+$', '') ELSE text END AS short, CASE WHEN length(text) > 120 THEN md5(regexp_replace(left(text, 120), '\\s+$', '')) ELSE md5(text) END AS evidence FROM documents")
def truncated_texts(spark, d):
    t = F.col("text")
    return load(spark, d, "documents").select("doc_id", text.truncated(t, 80).alias("short"), F.md5(text.truncated(t, 120).cast("binary")).alias("evidence"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 2 THEN NULL ELSE epoch(date_trunc('second', ts))::BIGINT END AS seconds FROM events")
def review_times(spark, d):
    """Times as ISO text, as epoch milliseconds, and as something else."""
    whole = F.date_trunc("second", "ts")
    written_as = F.when(F.col("event_id") % 3 == 0, F.date_format(whole, "yyyy-MM-dd'T'HH:mm:ss")).when(F.col("event_id") % 3 == 1, F.unix_millis(whole.cast("timestamp")).cast("string")).otherwise("soon")
    return load(spark, d, "events").select("event_id", F.unix_timestamp(arrays.review_time(written_as)).alias("seconds"))


@query("SELECT vec_id, round(exp(v[1]) / s, 6) AS first, (list_position(v, list_max(v)) - 1)::INT AS best, len([x FOR x IN v IF x = list_max(v)])::BIGINT AS ties FROM (SELECT vec_id, [round(x, 1) FOR x IN embedding[1:4]::DOUBLE[]] AS v, list_sum([exp(round(x, 1)) FOR x IN embedding[1:4]::DOUBLE[]]) AS s FROM embeddings)")
def softmax_argmax(spark, d):
    """Softmax and first argmax of four rounded numbers, which often tie."""
    v = F.transform(F.slice("embedding", 1, 4), lambda x: F.round(x.cast("double"), 1))
    rows = load(spark, d, "embeddings").select("vec_id", v.alias("v"))
    ties = F.size(F.filter("v", lambda x: x == F.array_max("v"))).cast("long")
    return rows.select("vec_id", F.round(F.element_at(arrays.softmax(F.col("v")), 1), 6).alias("first"), arrays.first_argmax(F.col("v")).alias("best"), ties.alias("ties"))


@query("SELECT conv_id, bool_or(role = 'user' AND turn = 1) AS asked, bool_or(role = 'user') AND bool_or(turn = 1) AS apart FROM conversations GROUP BY conv_id")
def nested_conjunction(spark, d):
    """Whether one element has both values, and whether the list has each."""
    item = F.struct(F.col("role").alias("issue_category"), F.col("turn").cast("string").alias("sentiment"))
    nested = load(spark, d, "conversations").groupBy("conv_id").agg(F.collect_list(item).alias("items"))
    apart = F.exists("items", lambda s: s["issue_category"] == "user") & F.exists("items", lambda s: s["sentiment"] == "1")
    return nested.select("conv_id", arrays.has_issue(F.col("items"), "user", "1").alias("asked"), apart.alias("apart"))


@query(f"SELECT doc_id, md5('product_name: ' || source || chr(10) || 'rating: 5' || chr(10) || 'title: ' || chr(10) || 'content: ' || text) AS fields, {len(ISSUE_CATEGORIES)}::BIGINT AS named FROM documents")
def prompts(spark, d):
    """What a model is asked: the rules, which name every category, and then the fields."""
    asked = load(spark, d, "documents").select("doc_id", enrich.prompt({"product_name": F.col("source"), "rating": F.lit(5), "title": F.lit(None), "content": F.col("text")}).alias("p"))
    after = F.expr("substring(p, locate('product_name: ', p))")
    named = sum((F.contains("p", F.lit(c)).cast("long") for c in ISSUE_CATEGORIES), F.lit(0).cast("long"))
    return asked.select("doc_id", F.md5(after.cast("binary")).alias("fields"), named.alias("named"))


@query("SELECT review_id, error, answer FROM (SELECT doc_id::VARCHAR AS review_id, NULL::VARCHAR AS error, length(text)::VARCHAR AS answer FROM documents)")
def model_answers(spark, d):
    """The slot for a language model, filled with one that tells a text's length."""
    docs = load(spark, d, "documents").select(F.col("doc_id").cast("string").alias("review_id"), F.col("text").alias("content"))
    return enrich.model_answers(docs, lambda batch: [str(len(t)) for t in batch["content"]]).select("review_id", "error", "answer")
