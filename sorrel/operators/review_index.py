"""The stored index of enriched reviews, and its search: all clauses in one join, best first by blocks.

Reviews are ordered by the length of their content, and about RANGE neighbours make a range. A block holds the postings of one
(field, term) in one range, with their scores (impacts), and states the greatest of them, how many there are, and the union
of their filter masks. So blocks of a range bound the score that a query can reach there: ranges with the greatest bounds are
scored first, and then only ranges whose bound reaches the score of the last result so far. Answers and issues are elements
of a review that are scored by themselves; their elements are in the same blocks. A review's filter mask has a bit for each
pair of issue category and sentiment, so a filter is applied to blocks and postings before anything is scored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from sorrel import vocab
from sorrel.functions import text
from sorrel.operators import lexical
from sorrel.scratch import forget, scratch_path, ship, written

Tokens = Callable[[Column], Column]
#: Reviews of a range, and ranges of a query that are scored first.
RANGE, FIRST_RANGES = 64, 32
#: The parts of a full query, the fields of its elements, and where keywords are filed.
CLAUSES = ("query", "answers", "expanded", "aspect", "sentiment", "category", "issue", "phrase")
ANSWER, EVIDENCE, CATEGORY, ISSUE = "answer", "evidence", "issue_category", "issue"
TABLES = ("blocks", "terms", "fields", "places")


@dataclass(frozen=True)
class ReviewIndex:
    """blocks (field, term, range, most, n, mask, postings), terms (field, term, df), fields (field, n, avgdl), places (field, term, doc_id, places, dl, range, mask) of the fields that phrases are looked up in."""

    blocks: DataFrame
    terms: DataFrame
    fields: DataFrame
    places: DataFrame


def pair_bit(category: Column, sentiment: Column) -> Column:
    """The mask with the bit of a category and a sentiment; 0 for unknown ones. The vocabularies are closed: 40 pairs."""
    bits = {f"{c}|{s}": 1 << (len(vocab.SENTIMENTS) * i + j) for i, c in enumerate(vocab.ISSUE_CATEGORIES) for j, s in enumerate(vocab.SENTIMENTS)}
    table = F.create_map(*[F.lit(x) for pair in bits.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.concat_ws("|", category, sentiment)), F.lit(0)).cast("long")


def mask_of(issues: Column) -> Column:
    """The union of an array of issue sentiments' bits."""
    return F.aggregate(F.coalesce(issues, F.array()), F.lit(0).cast("long"), lambda a, s: a.bitwiseOR(pair_bit(s["issue_category"], s["sentiment"])))


def query_mask(expanded: DataFrame) -> DataFrame:
    """expanded with mask: what the query's filter asks for, 0 without a filter."""
    wanted = (F.col("target_aspect") != vocab.OTHER) & F.col("target_sentiment").isin("positive", "negative")
    return expanded.withColumn("mask", F.when(wanted, pair_bit(F.col("target_aspect"), F.col("target_sentiment"))).otherwise(F.lit(0).cast("long")))


def lets_through(asked: Column, there: Column) -> Column:
    return (asked == 0) | (asked.bitwiseAND(there) != 0)


def lengths(documents: DataFrame) -> DataFrame:
    """(size, n, ahead): how many reviews have a content of each length, and how many a shorter one. A row for each different length: as few as the root of twice the characters."""
    sized = documents.groupBy(_size().alias("size")).agg(F.count(F.lit(1)).alias("n"))
    ahead = F.sum("n").over(Window.orderBy("size").rowsBetween(Window.unboundedPreceding, -1))
    return written(sized.select("size", "n", F.coalesce(ahead, F.lit(0)).alias("ahead")), "lengths")


def _size() -> Column:
    return F.coalesce(F.length("content"), F.lit(0))


def in_ranges(documents: DataFrame, told: DataFrame) -> DataFrame:
    """documents with range: in order of their content's length, about RANGE to a range. Those of one length stand by a hash of their id, so neither sorting nor a join of reviews is needed. told: lengths()."""
    sizes = F.broadcast(told.select(F.col("size").alias("_size"), F.col("n").alias("_n"), F.col("ahead").alias("_ahead")))
    spot = F.col("_ahead") + F.pmod(F.xxhash64("doc_id"), F.col("_n"))
    return documents.withColumn("_size", _size()).join(sizes, "_size").withColumn("range", F.floor(spot / RANGE).cast("long")).drop("_size", "_n", "_ahead")


def invert(flat: DataFrame, words: list[str] | None = None) -> DataFrame:
    """(doc_id, range, mask, field, element, dl, term, tf, places) of (doc_id, range, mask, field, element, tokens): each element's tokens are counted in its task, or with words only those among them. places is null but for the fields of phrases.

    Rows without a term tell, for a field and some elements, in tf how many of them have tokens, and in dl how many these have.
    """
    head = ["doc_id", "range", "mask", "field", "element"]
    schema = T.StructType([*[flat.schema[c] for c in head], T.StructField("dl", T.LongType()), T.StructField("term", T.StringType()), T.StructField("tf", T.LongType()), T.StructField("places", T.ArrayType(T.IntegerType()))])
    phrases, names = list(vocab.PHRASE_FIELDS), schema.names
    shared = None if words is None else flat.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = None if shared is None else pa.array(shared.value, pa.string())
        for whole in batches:
            for low in range(0, whole.num_rows, 512):
                batch = whole.slice(low, 512)
                lists, heads = batch.column("tokens"), batch.select(head)
                sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                values = lists.flatten()
                if asked is None:
                    coded = values.dictionary_encode()
                    code, known = coded.indices, coded.dictionary
                else:
                    code, known = pc.index_in(values, value_set=asked), asked
                code = pc.fill_null(code, -1).to_numpy(zero_copy_only=False).astype(np.int64)
                hit = np.flatnonzero(code >= 0)
                row, begin = np.repeat(np.arange(len(sizes)), sizes), np.repeat(np.cumsum(sizes) - sizes, sizes)
                key, place = row[hit] * max(len(known), 1) + code[hit], hit - begin[hit]
                order = np.argsort(key, kind="stable")
                key, place = key[order], place[order]
                first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))[: len(key)])
                tf = np.diff(np.append(first, len(key)))
                owner, term = np.divmod(key[first], max(len(known), 1))
                told = pc.is_in(batch.column("field"), value_set=pa.array(phrases)).to_numpy(zero_copy_only=False)[owner]
                ends = pa.array(np.concatenate(([0], np.cumsum(np.where(told, tf, 0)))), pa.int32())
                spots = pa.ListArray.from_arrays(ends, pa.array(place[np.repeat(told, tf)], pa.int32()), mask=pa.array(~told))
                yield pa.RecordBatch.from_arrays([*heads.take(pa.array(owner)).columns, pa.array(sizes[owner]), known.take(pa.array(term)), pa.array(tf, pa.int64()), spots], names)
                fields = np.array(batch.column("field").to_pylist(), object)
                each = [np.flatnonzero(fields == f) for f in sorted(set(fields))]
                sums = [pa.array([int(f(sizes[at])) for at in each], pa.int64()) for f in (np.sum, np.count_nonzero)]
                nothing = [pa.nulls(len(each), k) for k in (pa.string(), pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays([*heads.take(pa.array([at[0] for at in each], pa.int64())).columns, sums[0], nothing[0], sums[1], nothing[1]], names)

    return flat.mapInArrow(run, schema)


def build(documents: DataFrame, tokens: Tokens = text.tokens_cased, folder: str | None = None, expanded: DataFrame | None = None) -> ReviewIndex:
    """The index of enriched reviews, stored in folder (scratch without one).

    With expanded, a stated set of queries, it holds all reviews' postings of the terms that these look up and no others: what
    a search for them needs that makes its index anew. Lengths and numbers of texts are those of all tokens in either case.

    Blocks are dealt by field, term and range, so a frequent term has many files, and each file is in their order. No file's
    size is fixed: partitions are as large as adaptive execution makes them.
    """
    spark = documents.sparkSession
    folder = folder or scratch_path(spark, "review-index")
    blank = lambda c: F.coalesce(c, F.lit(""))
    part = lambda field, element, value: F.struct(F.lit(field).alias("field"), element.cast("int").alias("element"), value.alias("text"))
    joined = lambda n: F.array_join(F.coalesce(F.col(n), F.array()), " ")
    plain = [part(n, F.lit(-1), joined(n) if n == "aspect_keywords" else blank(F.col(n))) for n in vocab.SEARCH_FIELDS]
    answers = F.transform(F.coalesce("review_survey_answers", F.array()), lambda a, i: part(ANSWER, i, blank(a["answer"])))
    evidence = F.transform(F.coalesce("issue_sentiments", F.array()), lambda s, i: part(EVIDENCE, i, blank(s["evidence"])))
    told, words = lengths(documents), None if expanded is None else looked_up(expanded, tokens)
    placed = in_ranges(documents.withColumnRenamed("review_id", "doc_id"), told).withColumn("mask", mask_of(F.col("issue_sentiments")))
    parts = placed.select("doc_id", "range", "mask", F.explode(F.concat(F.array(*plain), answers, evidence)).alias("p"))
    flat = parts.select("doc_id", "range", "mask", "p.field", "p.element", tokens(F.col("p.text")).alias("tokens"))
    inverted = written(invert(flat, words), "inverted")
    sums = inverted.where(F.col("term").isNull() & (F.col("tf") > 0)).groupBy("field").agg(F.sum("tf").alias("n"), F.sum("dl").alias("dl"))
    sums.select("field", "n", (F.col("dl") / F.col("n")).alias("avgdl")).coalesce(1).write.mode("overwrite").parquet(f"{folder}/fields")
    counted = inverted.where(F.col("term").isNotNull())
    counted.groupBy("field", "term").agg(F.count(F.lit(1)).alias("df")).sortWithinPartitions("field", "term").write.mode("overwrite").parquet(f"{folder}/terms")
    fields, terms = (spark.read.parquet(f"{folder}/{name}") for name in ("fields", "terms"))
    known = counted.join(terms, ["field", "term"]).join(F.broadcast(fields), "field")  # a row for each field
    impact = lexical.bm25(F.col("n"), F.col("df"), F.col("tf"), F.col("dl"), F.col("avgdl"))
    keywords = keyword_impacts(placed)
    if words is not None:
        keywords = keywords.join(F.broadcast(spark.createDataFrame([(w,) for w in words], "term string")), "term", "left_semi")
    impacts = known.select("field", "term", "range", "doc_id", "element", impact.alias("impact"), "mask").unionByName(keywords)
    posting = F.struct("doc_id", "element", "impact", "mask")
    blocks = impacts.groupBy("field", "term", "range").agg(F.max("impact").alias("most"), F.count(F.lit(1)).alias("n"), F.bit_or("mask").alias("mask"), F.collect_list(posting).alias("postings"))
    places = counted.where(F.col("places").isNotNull()).select("field", "term", "doc_id", "places", "dl", "range", "mask")
    for name, rows, order in (("blocks", blocks, ("field", "term", "range")), ("places", places, ("field", "term", "doc_id"))):
        rows.sortWithinPartitions(*order).write.mode("overwrite").option("compression", "zstd").parquet(f"{folder}/{name}")
    forget(inverted, told)
    return load(spark, folder)


def load(spark: SparkSession, folder: str) -> ReviewIndex:
    return ReviewIndex(*[spark.read.parquet(f"{folder}/{name}") for name in TABLES])


def keyword_impacts(placed: DataFrame) -> DataFrame:
    """Categories of reviews, scored by idf, and issues of reviews: under their category, and under category and sentiment."""
    total = lambda rows: F.broadcast(rows.agg(F.count(F.lit(1)).alias("n")))  # noqa: E731  one row
    weigh = lambda rows, c, n: rows.groupBy(c).agg(F.count(F.lit(1)).alias("df")).join(n).select(c, lexical.idf(F.col("n"), F.col("df")).alias(f"idf_{c}"))
    categories = placed.select("doc_id", "range", "mask", F.explode(F.array_distinct(F.coalesce("issue_category", F.array()))).alias("term"))
    found = categories.join(weigh(categories, "term", total(placed.where(F.size("issue_category") > 0))), "term")
    by_category = found.select(F.lit(CATEGORY).alias("field"), "term", "range", "doc_id", F.lit(-1).alias("element"), F.col("idf_term").alias("impact"), "mask")
    issues = placed.select("doc_id", "range", "mask", F.posexplode("issue_sentiments").alias("element", "s")).select("doc_id", "range", "mask", "element", "s.issue_category", "s.sentiment")
    weighed = issues.join(weigh(issues, "issue_category", total(issues)), "issue_category").join(weigh(issues, "sentiment", total(issues)), "sentiment")
    alone = F.struct(F.col("issue_category").alias("term"), (3.0 * F.col("idf_issue_category")).alias("impact"))
    both = F.struct(F.concat_ws("|", "issue_category", "sentiment").alias("term"), (3.0 * F.col("idf_issue_category") + 3.0 * F.col("idf_sentiment")).alias("impact"))
    by_issue = weighed.select("range", "doc_id", "element", "mask", F.explode(F.array(alone, both)).alias("k"))
    return by_category.unionByName(by_issue.select(F.lit(ISSUE).alias("field"), "k.term", "range", "doc_id", F.col("element").cast("int").alias("element"), "k.impact", "mask"))


def mood_terms() -> Column:
    """The target aspect's terms of the target sentiment; the negative ones unless it is positive."""
    return F.when(F.col("target_sentiment") == "positive", F.col("positive_terms")).otherwise(F.col("negative_terms"))


def asked_terms(expanded: DataFrame, tokens: Tokens = text.tokens_cased) -> DataFrame:
    """(query_id, clause, field, term, weight, asked): all that the clauses look up but phrases, with the query's mask. A token that repeats weighs more."""
    masked = query_mask(expanded).withColumnRenamed("mask", "asked")
    told = F.col("target_aspect") != vocab.OTHER
    of = lambda c: tokens(F.array_join(c, " "))
    none = F.array().cast("array<string>")
    mooded = F.col("target_sentiment").isin("positive", "negative")
    issue = F.when(mooded, F.concat_ws("|", "target_aspect", "target_sentiment")).otherwise(F.col("target_aspect"))
    once = lambda c: F.when(told, F.array(c)).otherwise(none)
    parts = [
        ("query", vocab.SEARCH_FIELDS, 3.0, tokens(F.col("query"))),
        ("answers", {ANSWER: 1.0}, 0.6, tokens(F.col("query"))),
        ("expanded", vocab.SEARCH_FIELDS, 1.2, of(F.col("bm25_terms"))),
        ("aspect", vocab.ASPECT_FIELDS, 1.6, of(F.col("aspect_terms"))),
        ("sentiment", vocab.SENTIMENT_FIELDS, 0.8, F.when(told, of(mood_terms())).otherwise(none)),
        ("category", {CATEGORY: 1.0}, 2.2, once(F.col("target_aspect"))),
        ("must", {ISSUE: 1.0}, 1.0, once(issue)),
        ("evidence", {EVIDENCE: 1.5}, 2.2, F.when(told, of(F.col("aspect_terms"))).otherwise(none)),
        ("evidence", {EVIDENCE: 1.0}, 1.6, F.when(told, of(mood_terms())).otherwise(none)),
    ]
    looked = [F.struct(F.lit(clause).alias("clause"), words.alias("terms"), F.array(*[F.struct(F.lit(f).alias("field"), F.lit(float(w * boost)).alias("weight")) for f, w in fields.items()]).alias("fields")) for clause, fields, boost, words in parts]
    each = masked.select("query_id", "asked", F.explode(F.array(*looked)).alias("c")).select("query_id", "asked", "c.clause", "c.fields", F.explode("c.terms").alias("term"))
    flat = each.select("query_id", "asked", "clause", "term", F.explode("fields").alias("f")).select("query_id", "asked", "clause", "term", "f.*")
    return flat.groupBy("query_id", "asked", "clause", "field", "term").agg(F.sum("weight").alias("weight"))


def asked_phrases(expanded: DataFrame) -> DataFrame:
    """(query_id, phrase): the phrases of each query's aspect and sentiment; query_id is a struct of the query and the phrase's number."""
    mood = F.col("target_sentiment")
    phrases = F.when(mood == "positive", F.col("positive_phrases")).when(mood == "negative", F.col("negative_phrases")).otherwise(F.array().cast("array<string>"))
    return expanded.select("query_id", F.posexplode(phrases).alias("nth", "phrase")).select(F.struct("query_id", "nth").alias("query_id"), "phrase")


def looked_up(expanded: DataFrame, tokens: Tokens = text.tokens_cased) -> list[str]:
    """All terms that a search for the queries looks up, words of phrases too."""
    spoken = asked_phrases(expanded).select(F.explode(tokens(F.col("phrase"))).alias("term"))
    found = asked_terms(expanded, tokens).select("term").union(spoken).where(F.col("term").isNotNull()).distinct()
    return sorted(r["term"] for r in found.collect())


def phrase_scores(index: ReviewIndex, expanded: DataFrame, tokens: Tokens = text.tokens_cased) -> DataFrame:
    """(query_id, doc_id, range, mask, score): the phrases of the query's aspect and sentiment, summed."""
    each = asked_phrases(expanded)
    words = each.select(F.explode(tokens(F.col("phrase"))).alias("term")).distinct()
    rows = index.places.join(words, "term", "left_semi")
    places = rows.select("field", "term", "doc_id", F.explode("places").alias("place"), "dl")
    found = lexical.phrase(lexical.Index(rows, index.fields, index.terms, places), each, tokens(F.col("phrase")), vocab.PHRASE_FIELDS, 2.4)
    summed = found.groupBy(F.col("query_id.query_id").alias("query_id"), "doc_id").agg(F.sum("score").alias("score"))
    return summed.join(rows.select("doc_id", "range", "mask").distinct(), "doc_id")


def totals(rows: DataFrame, key: str, elements: bool = True) -> DataFrame:
    """(query_id, key, score) of (query_id, key, element, clause, field, gain): the bool of all clauses.

    The original query counts with its best field, answers and issues with their best element, an issue only where its
    keyword matches; all else is summed. With greatest gains of ranges in place of reviews' gains (elements False) the
    result is no less than that of any review of the range.
    """
    clause, gain = F.col("clause"), F.col("gain")
    best = {f"best_{k}": F.sum(F.when((clause == "query") & (F.col("field") == f), gain)) for k, f in enumerate(vocab.SEARCH_FIELDS)}
    summed = {"rest": F.sum(F.when(~clause.isin("query", "answers", "must", "evidence"), gain))} | {c: F.sum(F.when(clause == c, gain)) for c in ("answers", "must", "evidence")}
    parts = rows.groupBy("query_id", key, *(["element"] if elements else [])).agg(*[c.alias(n) for n, c in (best | summed).items()])
    issue = F.col("must") + F.coalesce("evidence", F.lit(0.0))
    if elements:
        parts = parts.groupBy("query_id", key).agg(*[F.max(n).alias(n) for n in [*best, "rest"]], F.max("answers").alias("answers"), F.max(issue).alias("issue"))
    else:
        parts = parts.withColumn("issue", issue)
    greatest = F.greatest(*[F.col(n) for n in best])
    # Where no clause but evidence matched, nothing did.
    matched = F.coalesce(greatest, F.col("rest"), F.col("answers"), F.col("issue")).isNotNull()
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return parts.where(matched).select("query_id", key, (zero(greatest) + zero(F.col("rest")) + zero(F.col("answers")) + zero(F.col("issue"))).alias("score"))


def met_blocks(index: ReviewIndex, asked: DataFrame) -> DataFrame:
    """The blocks' bounds that asked terms meet and that the query's filter lets through: one join for all clauses, without the postings."""
    heads = index.blocks.select("field", "term", "range", "most", "n", "mask")
    return heads.join(asked, ["field", "term"]).where(lets_through(F.col("asked"), F.col("mask"))).drop("mask")


def posting_gains(index: ReviewIndex, met: DataFrame) -> DataFrame:
    """(query_id, range, doc_id, element, clause, field, gain) of the postings of met blocks that the filter lets through."""
    bodies = index.blocks.select("field", "term", "range", "postings")
    rows = bodies.join(met.select("query_id", "clause", "field", "term", "range", "weight", "asked"), ["field", "term", "range"])
    flat = rows.select("query_id", "range", "clause", "field", "weight", "asked", F.inline("postings"))
    return flat.where(lets_through(F.col("asked"), F.col("mask"))).select("query_id", "range", "doc_id", "element", "clause", "field", (F.col("weight") * F.col("impact")).alias("gain"))


def _phrase_rows(phrases: DataFrame, key: str) -> DataFrame:
    return phrases.select("query_id", key, F.lit(-1).alias("element"), F.lit("phrase").alias("clause"), F.lit("phrase").alias("field"), F.col("score").alias("gain"))


def clauses(index: ReviewIndex, expanded: DataFrame, tokens: Tokens = text.tokens_cased) -> dict[str, DataFrame]:
    """The should clauses of the full query by name, each as (query_id, doc_id, score), without the filter; all read the stored index."""
    asked = asked_terms(expanded, tokens).withColumn("asked", F.lit(0).cast("long"))

    def rows(*names: str) -> DataFrame:
        return posting_gains(index, met_blocks(index, asked.where(F.col("clause").isin(*names))))

    def whole(*names: str) -> DataFrame:
        return totals(rows(*names).select("query_id", "doc_id", "element", "clause", "field", "gain"), "doc_id")

    found = {name: whole(name) for name in ("query", "answers", "expanded", "aspect", "sentiment", "category")}
    return found | {"issue": whole("must", "evidence"), "phrase": phrase_scores(index, expanded, tokens).select("query_id", "doc_id", "score")}


@dataclass(frozen=True)
class Found:
    """The ranked reviews (query_id, doc_id, score, rank), written, and what it took by query (query_id, postings, scored, ranges, ranges_scored)."""

    ranked: DataFrame
    work: DataFrame


def ranked(scored: DataFrame, top: int) -> DataFrame:
    """(query_id, doc_id, score, rank): the best of each query, ties by document."""
    order = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
    return scored.select("query_id", "doc_id", "score", order.alias("rank")).where(F.col("rank") <= top)


def best(index: ReviewIndex, expanded: DataFrame, tokens: Tokens = text.tokens_cased, top: int = vocab.LEXICAL_TOP, first: int = FIRST_RANGES) -> Found:
    """The first top reviews of each query under all clauses and the filter: the same as scoring every match gives.

    Bounds of ranges come from one join of all clauses' terms with the blocks' heads. The first ranges by bound are scored;
    the score of the last of the top so far is what the bound of every further range must reach. Scores are rounded to 9 digits.
    """
    met = written(met_blocks(index, asked_terms(expanded, tokens)), "met-blocks")
    masks = query_mask(expanded).select("query_id", F.col("mask").alias("asked"))
    said = phrase_scores(index, expanded, tokens).join(masks, "query_id").where(lets_through(F.col("asked"), F.col("mask")))
    phrases = written(said.select("query_id", "doc_id", "range", "score"), "phrase-scores")
    heads = met.select("query_id", "range", "clause", "field", (F.col("weight") * F.col("most")).alias("gain"))
    spoken = _phrase_rows(phrases.groupBy("query_id", "range").agg(F.max("score").alias("score")), "range").drop("element")
    bounds = written(totals(heads.unionByName(spoken), "range", elements=False).withColumnRenamed("score", "bound"), "bounds")
    order = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("bound"), "range"))
    seeds = bounds.withColumn("nth", order).where(F.col("nth") <= first).select("query_id", "range")

    def score(chosen: DataFrame) -> DataFrame:
        rows = posting_gains(index, met.join(chosen, ["query_id", "range"], "left_semi")).drop("range")
        more = _phrase_rows(phrases.join(chosen, ["query_id", "range"], "left_semi"), "doc_id")
        return totals(rows.unionByName(more), "doc_id").withColumn("score", F.round("score", 9))

    ahead = written(ranked(score(seeds), top), "first-ranges")
    edge = ahead.where(F.col("rank") == top).select("query_id", F.col("score").alias("edge"))
    open_ = bounds.join(edge, "query_id", "left").where(F.col("edge").isNull() | (F.col("bound") + 1e-8 >= F.col("edge"))).select("query_id", "range")
    rest = written(open_.join(seeds, ["query_id", "range"], "left_anti"), "open-ranges")
    whole = written(ranked(ahead.drop("rank").unionByName(score(rest)), top), "lexical-leg")
    taken = seeds.unionByName(rest)
    scored = met.join(taken.withColumn("taken", F.lit(True)), ["query_id", "range"], "left")
    work = scored.groupBy("query_id").agg(F.sum("n").alias("postings"), F.sum(F.when(F.col("taken"), F.col("n")).otherwise(0)).alias("scored"), F.countDistinct("range").alias("ranges"), F.countDistinct(F.when(F.col("taken"), F.col("range"))).alias("ranges_scored"))
    return Found(whole, work)


def exhaustive(index: ReviewIndex, expanded: DataFrame, tokens: Tokens = text.tokens_cased, top: int = vocab.LEXICAL_TOP) -> DataFrame:
    """What best() gives, by scoring every match."""
    found = clauses(index, expanded, tokens)
    allowed = index.blocks.select(F.inline("postings")).select("doc_id", "mask").distinct()
    scored = lexical.any_of(list(found.values())).join(allowed, "doc_id").join(query_mask(expanded).select("query_id", F.col("mask").alias("asked")), "query_id")
    return ranked(scored.where(lets_through(F.col("asked"), F.col("mask"))).withColumn("score", F.round("score", 9)), top)


ship(__name__)
