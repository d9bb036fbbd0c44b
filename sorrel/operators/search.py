"""Query expansion, the lexical and dense legs, fusion, reranking, post-filter and output."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sorrel import vocab
from sorrel.functions import arrays, terms, text
from sorrel.operators import review_index, vector_graph
from sorrel.operators.review_index import ranked
from sorrel.scratch import ship, written

OUTPUT = "struct<query:string,results:array<struct<review_id:string,score:double,product_name:string,content:string>>>"


LISTS = {"aspect_terms": vocab.ASPECT_TERMS, "positive_terms": vocab.POSITIVE_TERMS, "negative_terms": vocab.NEGATIVE_TERMS, "positive_phrases": vocab.POSITIVE_PHRASES, "negative_phrases": vocab.NEGATIVE_PHRASES}
EXPANDED = ("bm25_terms", "dense_queries", "must_include", "should_include", "should_exclude", *LISTS)


def told_expansion(query: str | None, found: set[str]) -> dict:
    """The expansion of a query that holds the found terms, by rule.

    Its aspect is the first, in the vocabulary's order, of which it holds a term; its sentiment is positive or negative if
    only such terms are there. Terms that hold others (as one for "not recommended") make it unknown.
    """
    aspect = next((a for a, ts in vocab.QUERY_ASPECTS.items() if any(t in found for t in ts)), vocab.OTHER)
    good, bad = (any(t in found for t in ts) for ts in (vocab.QUERY_POSITIVE, vocab.QUERY_NEGATIVE))
    mood = "positive" if good and not bad else "negative" if bad and not good else "unknown"
    lists = {name: table.get(aspect, []) for name, table in LISTS.items()}
    variants = [v for t, vs in vocab.EXPANSIONS.items() if t in found for v in vs if v not in found]
    own = lists.get(f"{mood}_terms", [])
    against = {"positive": "negative", "negative": "positive"}.get(mood)
    terms_ = list(dict.fromkeys([*variants, *lists["aspect_terms"], *own]))
    return {"target_aspect": aspect, "target_sentiment": mood, **lists, "bm25_terms": terms_, "should_include": terms_, "dense_queries": [query], "must_include": lists["aspect_terms"],
            "should_exclude": [*lists[f"{against}_terms"], *lists[f"{against}_phrases"]] if against else []}


def expansion(query: Column) -> Column:
    """told_expansion() of a column, as one struct: all vocabularies are looked for in one pass over the query."""
    vocabulary = [*vocab.QUERY_POSITIVE, *vocab.QUERY_NEGATIVE, *[t for ts in vocab.QUERY_ASPECTS.values() for t in ts], *vocab.EXPANSIONS, *[v for vs in vocab.EXPANSIONS.values() for v in vs]]
    kind = ", ".join(["target_aspect string", "target_sentiment string", *[f"{n} array<string>" for n in EXPANDED]])
    return terms.by_terms(vocabulary, told_expansion, kind)(query)


def query_aspect(query: Column) -> Column:
    return expansion(query)["target_aspect"]


def query_sentiment(query: Column) -> Column:
    return expansion(query)["target_sentiment"]


def expand(queries: DataFrame) -> DataFrame:
    """queries (query_id, query) with the expansion's columns, by rule."""
    told = queries.withColumn("_told", expansion(F.col("query")))
    return told.select(*queries.columns, "_told.*")


def settled(expanded: DataFrame) -> DataFrame:
    """The expansions as a written table, so that plans that use them many times stay small, for any number of queries."""
    return written(expanded, "expansions")


def overlay_model(expanded: DataFrame, answer: Column) -> DataFrame:
    """A model's expansion over the rules' one: only keys that its answer has; an answer that can't be parsed changes nothing."""
    schema = "rewritten_query string, bm25_terms array<string>, dense_query string, must_include array<string>, should_include array<string>, should_exclude array<string>, target_sentiment string, target_aspect string"
    got = expanded.withColumn("_m", F.from_json(answer, schema))
    filled = lambda c: F.filter(F.transform(c, text.strip), lambda t: t != "")
    for name in ("bm25_terms", "must_include", "should_include", "should_exclude"):
        got = got.withColumn(name, F.coalesce(filled(F.col(f"_m.{name}")), F.col(name)))
    for name in ("target_sentiment", "target_aspect"):
        got = got.withColumn(name, F.coalesce(F.col(f"_m.{name}"), F.col(name)))
    rewritten = arrays.first_filled(F.col("_m.dense_query"), F.col("_m.rewritten_query"))
    return got.withColumn("dense_queries", F.array_distinct(F.array_compact(F.array(F.col("query"), rewritten)))).drop("_m")


Tokens = Callable[[Column], Column]


def lexical_leg(documents: DataFrame, expanded: DataFrame, tokens: Tokens = text.tokens_cased, top: int = vocab.LEXICAL_TOP, index: review_index.ReviewIndex | None = None) -> DataFrame:
    """(query_id, doc_id, score, rank): the full clause list over enriched documents, without those that the filter excludes. See review_index.best()."""
    return review_index.best(index or review_index.build(documents, tokens, expanded=expanded), expanded, tokens, top).ranked


def issue_filter(candidates: DataFrame) -> DataFrame:
    """Without candidates that lack an issue sentiment of the query's aspect and sentiment, where it has both."""
    wanted = (F.col("target_aspect") != vocab.OTHER) & F.col("target_sentiment").isin("positive", "negative")
    there = F.coalesce(F.exists("issue_sentiments", lambda s: (s["issue_category"] == F.col("target_aspect")) & (s["sentiment"] == F.col("target_sentiment"))), F.lit(False))
    return candidates.where(~wanted | there)


def nearest(vectors: DataFrame, queries: DataFrame, top: int, group: str | None = None, block: int | None = None, mask: str | None = None) -> DataFrame:
    """(query_id, doc_id, cosine): the top vectors of each query, exactly; 0 for a zero vector.

    vectors: doc_id, vector; queries: query_id, vector; with group, only vectors with the query's value in that column count;
    with mask, only vectors that share a bit of that column with the query, or all where the query's mask is 0.
    Queries are a stated set: they are taken in blocks of bounded size, each broadcast as one matrix of unit vectors, and
    every task multiplies its vectors by it and keeps its own top, so that tasks x queries x top rows are merged. Cosines are
    rounded to 8 digits; ties go to the lower document.
    """
    extra = [c for c in (group, mask) if c]
    asked = queries.select("query_id", "vector", *extra).orderBy("query_id")
    asked = written(asked, "query-vectors")
    found = None
    for part in query_blocks(asked, block or vocab.QUERY_BLOCK):
        if not (rows := part.collect()):
            continue
        each = _nearest_block(vectors, asked, rows, top, group, mask)
        found = each if found is None else found.unionByName(each)
    if found is None:
        return vectors.join(asked.select("query_id"), F.lit(False)).select("query_id", "doc_id", F.lit(0.0).alias("cosine"))
    # A query with several vectors takes a document's best.
    return found.groupBy("query_id", "doc_id").agg(F.max("cosine").alias("cosine"))


def query_blocks(asked: DataFrame, most: int) -> Iterator[DataFrame]:
    """The query rows in blocks of about most rows."""
    blocks = -(-asked.count() // most)
    for k in range(blocks):
        yield asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == k)


def _nearest_block(vectors: DataFrame, asked: DataFrame, rows: list, top: int, group: str | None, mask: str | None) -> DataFrame:
    unit = lambda m: m / np.where((size := np.linalg.norm(m, axis=1, keepdims=True)) == 0, 1, size)
    matrix = unit(np.array([r["vector"] for r in rows], np.float64).reshape(len(rows), -1))
    shared = vectors.sparkSession.sparkContext.broadcast((matrix, [r[group] for r in rows] if group else None, np.array([r[mask] for r in rows], np.int64) if mask else None))
    kept = vectors.select("doc_id", "vector", *[c for c in (group, mask) if c])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix, groups, masks = shared.value
        groups = None if groups is None else np.array(groups)
        best_score = [np.zeros(0)] * len(matrix)
        best_doc = [np.zeros(0, object)] * len(matrix)
        for batch in batches:
            if not batch.num_rows:
                continue
            docs = np.array(batch.column("doc_id").to_pylist(), object)
            mine = unit(np.array(batch.column("vector").to_pylist(), np.float64).reshape(len(docs), -1))
            scores = (matrix @ mine.T).round(8)
            fits = None if groups is None else groups[:, None] == np.array(batch.column(group).to_pylist())[None, :]
            if masks is not None:
                let = (masks[:, None] == 0) | ((masks[:, None] & batch.column(mask).to_numpy(zero_copy_only=False)[None, :]) != 0)
                fits = let if fits is None else fits & let
            for q in range(len(matrix)):
                use = slice(None) if fits is None else np.flatnonzero(fits[q])
                value, doc = np.concatenate([best_score[q], scores[q][use]]), np.concatenate([best_doc[q], docs[use]])
                if len(value) > top:
                    edge = np.partition(value, len(value) - top)[len(value) - top]
                    sure = np.flatnonzero(value > edge)
                    tied = sorted(np.flatnonzero(value == edge), key=lambda k: doc[k])[: top - len(sure)]
                    cut = np.concatenate([sure, np.array(tied, np.int64)])
                    value, doc = value[cut], doc[cut]
                best_score[q], best_doc[q] = value, doc
        for q in range(len(matrix)):
            n = len(best_doc[q])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, q), pa.int32()), pa.array(list(best_doc[q]), kind), pa.array(best_score[q], pa.float64())], ["nth", "doc_id", "cosine"])

    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

    kind = to_arrow_type(vectors.schema["doc_id"].dataType)
    schema = StructType([StructField("nth", IntegerType()), StructField("doc_id", vectors.schema["doc_id"].dataType), StructField("cosine", DoubleType())])
    names = vectors.sparkSession.createDataFrame([(k, r["query_id"]) for k, r in enumerate(rows)], StructType([StructField("nth", IntegerType()), StructField("query_id", asked.schema["query_id"].dataType)]))
    return kept.mapInArrow(run, schema).join(F.broadcast(names), "nth").select("query_id", "doc_id", "cosine")


def dense_leg(vectors: DataFrame, queries: DataFrame, top: int = vocab.DENSE_TOP, group: str | None = None) -> DataFrame:
    """Exact nearest vectors: vectors (doc_id, vector), queries (query_id, vector); score (1 + cosine) / 2. A mask column in both filters. See nearest()."""
    found = nearest(vectors, queries, top, group, mask=_mask_column(vectors, queries))
    return ranked(found.select("query_id", "doc_id", F.round((1 + F.col("cosine")) / 2, 9).alias("score")), top)


def dense_scan(vectors: DataFrame, queries: DataFrame, top: int = vocab.DENSE_TOP) -> DataFrame:
    """What stands in where nearest-vector search fails: an exact scan, with score cosine + 1."""
    found = nearest(vectors, queries, top, mask=_mask_column(vectors, queries))
    return ranked(found.select("query_id", "doc_id", F.round(F.col("cosine") + 1, 9).alias("score")), top)


def _mask_column(vectors: DataFrame, queries: DataFrame) -> str | None:
    return "mask" if "mask" in vectors.columns and "mask" in queries.columns else None


def dense_leg_or_scan(vectors: DataFrame, queries: DataFrame, top: int = vocab.DENSE_TOP, leg: Callable[[DataFrame, DataFrame, int], DataFrame] = dense_leg) -> DataFrame:
    """leg's rows, written; where it raises, the exact scan's."""
    try:
        return written(leg(vectors, queries, top), "dense-leg")
    except Exception:  # noqa: BLE001  any failure of the leg is what the scan is for
        return dense_scan(vectors, queries, top)


def normalized_hits(hits: DataFrame, source: str) -> DataFrame:
    """(query_id, doc_id, score, rank, source) of a leg's raw hits (query_id, place, id, review_id, score): the review's id or else the hit's, 0 for no score, ranks in order of place. Hits without an id are left out."""
    named = hits.withColumn("doc_id", arrays.first_filled(F.col("review_id"), F.col("id"))).where(F.col("doc_id").isNotNull())
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("place"))
    return named.select("query_id", "doc_id", F.coalesce("score", F.lit(0.0)).alias("score"), rank.alias("rank"), F.lit(source).alias("source"))


def fuse(first: DataFrame, second: DataFrame, k: int = vocab.FUSION_K, top: int = vocab.FUSION_TOP) -> DataFrame:
    """Reciprocal rank fusion of two ranked lists; ties by the lists' scores, then ranks, then document."""
    sides = first.withColumn("side", F.lit("bm25")).unionByName(second.withColumn("side", F.lit("dense")))
    on = lambda side, c: F.max(F.when(F.col("side") == side, F.col(c)))
    fused = sides.groupBy("query_id", "doc_id").agg(
        F.sum(1 / (k + F.col("rank"))).alias("rrf_score"), on("bm25", "rank").alias("bm25_rank"), on("dense", "rank").alias("dense_rank"), on("bm25", "score").alias("bm25_score"), on("dense", "score").alias("dense_score"))
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("rrf_score", 12)), F.desc(F.coalesce("bm25_score", F.lit(0.0))), F.desc(F.coalesce("dense_score", F.lit(0.0))), F.asc_nulls_last("bm25_rank"), "dense_rank", "doc_id")
    return fused.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def rerank(candidates: DataFrame, score_pairs: Callable[[pd.Series, pd.Series], pd.Series] | None = None) -> DataFrame:
    """candidates (with query and dense_text) and final_score: from a cross-encoder slot, or the fusion score without one.

    A missing dense_text is built anew from the candidate's fields. Where the slot fails on any batch of a query's
    candidates, all of that query's candidates keep the fusion order; rerank_error tells why.
    """
    if score_pairs is None:
        return candidates.withColumns({"rerank_score": F.col("rrf_score"), "final_score": F.col("rrf_score")})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            try:
                yield batch.assign(rerank_score=pd.Series(score_pairs(batch["query"], batch["dense_text"]), index=batch.index).astype(float), rerank_error=None)
            except Exception as e:  # noqa: BLE001  reported in the rows
                yield batch.assign(rerank_score=0.0, rerank_error=repr(e))

    pairs = candidates.select("query_id", "doc_id", "query", rerank_text(candidates).alias("dense_text"))
    scored = pairs.mapInPandas(run, _with_scores(pairs)).select("query_id", "doc_id", "rerank_score", "rerank_error")
    failed = F.max("rerank_error").over(Window.partitionBy("query_id"))
    both = candidates.join(scored.withColumn("rerank_error", failed), ["query_id", "doc_id"])
    score = F.when(F.col("rerank_error").isNull(), F.col("rerank_score")).otherwise(F.col("rrf_score"))
    return both.withColumn("rerank_score", score).withColumn("final_score", F.col("rerank_score"))


def rerank_text(candidates: DataFrame) -> Column:
    """dense_text, or where it is empty the text that documents with these fields would have."""
    issues = "array<struct<issue_category:string,sentiment:string,evidence:string>>"
    answers = "array<struct<question:string,answer:string>>"
    kinds = {"product_name": "string", "item_name": "string", "title": "string", "content": "string", "short_summary": "string", "issue_category": "array<string>", "aspect_keywords": "array<string>", "issue_sentiments": issues, "review_survey_answers": answers}
    fields = {n: F.col(n) if n in candidates.columns else F.lit(None).cast(k) for n, k in kinds.items()}
    rebuilt = text.dense_text(fields)
    return F.coalesce(F.nullif(F.col("dense_text"), F.lit("")), rebuilt) if "dense_text" in candidates.columns else rebuilt


def _with_scores(pairs: DataFrame):
    from pyspark.sql.types import DoubleType, StringType, StructField, StructType

    return StructType([*pairs.schema.fields, StructField("rerank_score", DoubleType()), StructField("rerank_error", StringType())])


def post_filter(candidates: DataFrame, size: int = vocab.FINAL_TOP, expanded: DataFrame | None = None) -> DataFrame:
    """The best size candidates of each query with enough signal, without repeated ids or content prefixes.

    candidates: query_id, doc_id, content, final_score, rank. Ids are unique in a fused list, so the first row of each
    content prefix is what a pass through the list would keep. With the queries' expansions, candidates must also have an
    issue sentiment of the query's aspect and sentiment, where it has both.
    """
    usable = candidates.where((F.coalesce(F.col("doc_id").cast("string"), F.lit("")) != "") & (text.strip(F.coalesce("content", F.lit(""))) != "") & (text.meaningful_chars(F.col("content")) >= vocab.LEAST_MEANINGFUL))
    if expanded is not None:
        aimed = usable.join(expanded.select("query_id", "target_aspect", "target_sentiment"), "query_id")
        usable = issue_filter(aimed).select(*candidates.columns)
    prefix = text.fingerprint_prefix(F.col("content"), vocab.DEDUPE_PREFIX)
    in_order = [F.desc(F.round("final_score", 12)), F.col("rank")]
    first = usable.withColumn("_nth", F.row_number().over(Window.partitionBy("query_id", prefix).orderBy(*in_order))).where("_nth = 1")
    return first.withColumn("final_rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*in_order))).where(F.col("final_rank") <= size).drop("_nth")


def search_output(results: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, output): one SearchOutput struct for each query, empty where nothing was found."""
    score = F.coalesce("final_score", F.lit(0.0)).cast("double")
    item = F.struct("final_rank", F.struct(F.col("doc_id").cast("string").alias("review_id"), score.alias("score"), "product_name", F.coalesce("content", F.lit("")).alias("content")).alias("item"))
    lists = results.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["item"]).alias("results"))
    empty = F.from_json(F.lit("[]"), "array<struct<review_id:string,score:double,product_name:string,content:string>>")
    return queries.join(lists, "query_id", "left").select("query_id", F.struct("query", F.coalesce("results", empty).alias("results")).alias("output"))


def valid_output(output: Column) -> Column:
    """True if a SearchOutput has its query, results, ids and contents."""
    return output["query"].isNotNull() & output["results"].isNotNull() & F.forall(output["results"], lambda r: r["review_id"].isNotNull() & r["score"].isNotNull() & r["content"].isNotNull())


def embed(c: Column, size: int = vocab.VECTOR_SIZE) -> Column:
    """The default embedding slot: signed hashed character n-grams of 2 to 4, unit length; a zero vector for empty text.

    A gram's hash is made by array arithmetic over the text's code points.
    """

    def grams(value: str) -> np.ndarray:
        points = np.frombuffer(f" {value.lower().strip()} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        hashed = []
        for n in (2, 3, 4):
            h = np.full(max(len(points) - n + 1, 0), n, np.uint64)
            for k in range(n):
                h = (h ^ points[k : k + len(h)]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
            hashed.append(h)
        return np.concatenate(hashed)

    def run(values: pd.Series) -> pd.Series:
        def one(value: str | None) -> list[float]:
            if not value:
                return [0.0] * size
            h = grams(value)
            out = np.bincount((h % np.uint64(size)).astype(np.int64), np.where(h >> np.uint64(63), 1.0, -1.0), size)
            length = np.linalg.norm(out)
            return (out / length if length else out).tolist()

        return pd.Series([one(v) for v in values], dtype=object)

    return F.pandas_udf(run, "array<float>")(c)


@dataclass(frozen=True)
class Legs:
    """The ranked lists of a batch of queries: lexical, dense, fused and final."""

    lexical: DataFrame
    dense: DataFrame
    fused: DataFrame
    final: DataFrame


def search_batch(documents: DataFrame, expanded: DataFrame, index: review_index.ReviewIndex | None = None, score_pairs=None, size: int = vocab.FINAL_TOP, tokens: Tokens = text.tokens_cased, dense: Callable = dense_leg, embedder: Callable[[Column], Column] = embed, graph: vector_graph.VectorGraph | None = None) -> Legs:
    """All stages of hybrid search for expanded queries over enriched documents with a vector; each stage is written once.

    The dense leg sees only documents that the query's aspect and sentiment allow, by the same masks as the lexical one.
    With a stored graph of the vectors it walks that; without one it scores all vectors (see stores_graph).
    """
    if graph is not None:
        dense = lambda _, asked, top: vector_graph.graph_leg(graph, asked, top)
    lex = lexical_leg(documents, expanded, tokens, index=index)
    vectors = masked_vectors(documents)
    variants = review_index.query_mask(expanded).select("query_id", "mask", F.explode("dense_queries").alias("q")).select("query_id", "mask", embedder(F.col("q")).alias("vector"))
    near = dense_leg_or_scan(vectors, variants, vocab.DENSE_TOP, dense)
    fused = written(fuse(lex, near), "fused")
    columns = [c for c in ("product_name", "content", "dense_text", "issue_sentiments") if c in documents.columns]
    fetched = fused.join(documents.select(F.col("review_id").alias("doc_id"), *columns), "doc_id").join(expanded.select("query_id", "query"), "query_id")
    candidates = written(fetched, "candidates")  # or the filter on contents would run over all documents before the join
    final = written(post_filter(rerank(candidates, score_pairs), size, expanded), "final")
    return Legs(lex, near, fused, final)


def masked_vectors(documents: DataFrame) -> DataFrame:
    """(doc_id, vector, mask) of enriched documents."""
    return documents.select(F.col("review_id").alias("doc_id"), "vector", review_index.mask_of(F.col("issue_sentiments")).alias("mask"))


def vector_graph_of(documents: DataFrame, folder: str | None = None) -> vector_graph.VectorGraph:
    """The graph of enriched documents' vectors, stored in folder."""
    return vector_graph.build(masked_vectors(documents), folder)


def stores_graph(documents: DataFrame, least: int = vector_graph.GRAPH_FROM) -> bool:
    """Whether documents are so many that a graph of their vectors pays."""
    return documents.count() >= least


def search(spark: SparkSession, documents: DataFrame, query: str, size: int = vocab.FINAL_TOP, score_pairs=None, index: review_index.ReviewIndex | None = None) -> DataFrame:
    """One query over a stored table of enriched documents with dense vectors (columns of operators.documents, and vector): its SearchOutput."""
    expanded = settled(expand(spark.createDataFrame([(0, query)], "query_id int, query string")))
    return search_output(search_batch(documents, expanded, index, score_pairs, size).final, expanded.select("query_id", "query"))


def dense_leg_approximate(vectors: DataFrame, queries: DataFrame, top: int = vocab.DENSE_TOP, tables: int = 16, bits: int | None = None, seed: int = 42) -> DataFrame:
    """Nearest vectors by random-hyperplane hashing with multi-probe: scores only vectors that share a bucket of some table with a query.

    A vector is filed once in each table, under bits signs of random projections (by default so many that a bucket holds
    about 32 vectors). A query looks into its own bucket and those that differ in up to two of its signs; candidates are scored exactly. Queries that find fewer than
    top candidates are searched exactly. Vectors move only as far as the join on (table, bucket) takes them; the queries'
    probes, the small side, carry the query's vector.
    """
    from itertools import combinations

    bits = bits or min(max(vectors.count().bit_length() - 5, 4), 24)
    flips = [0, *[1 << i for i in range(bits)], *[(1 << i) | (1 << j) for i, j in combinations(range(bits), 2)]]
    size = len(vectors.select("vector").first()["vector"]) if vectors.take(1) else 1
    planes = np.random.default_rng(seed).standard_normal((size, tables * bits))

    def run(values: pd.Series) -> pd.Series:
        m = np.array(values.tolist(), np.float64).reshape(len(values), -1)
        signs = (m @ planes > 0).reshape(len(m), tables, bits)
        return pd.Series((signs * (1 << np.arange(bits))).sum(axis=2).astype(np.int32).tolist(), dtype=object)

    buckets = F.pandas_udf(run, "array<int>")
    filed = vectors.select("doc_id", "vector", F.posexplode(buckets(F.col("vector"))).alias("table", "bucket"))
    probe = F.explode(F.array(*[F.lit(f) for f in flips])).alias("flip")
    looked = queries.select("query_id", F.col("vector").alias("query_vector"), F.posexplode(buckets(F.col("vector"))).alias("table", "own")).select("query_id", "query_vector", "table", "own", probe)
    looked = looked.select("query_id", "query_vector", "table", F.expr("own ^ flip").alias("bucket"))
    met = filed.join(looked, ["table", "bucket"]).select("query_id", "doc_id", ((1 + arrays.cosine(F.col("vector"), F.col("query_vector"))) / 2).alias("score"))
    scored = written(met.groupBy("query_id", "doc_id").agg(F.max("score").alias("score")), "near-candidates")
    enough = scored.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= top).select("query_id")
    short = written(queries.join(enough, "query_id", "left_anti"), "short-queries")
    few = ranked(scored.join(enough, "query_id", "left_semi"), top)
    return few.unionByName(dense_leg(vectors, short.select("query_id", "vector"), top)) if short.take(1) else few


ship(__name__)
