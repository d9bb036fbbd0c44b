"""The stored review index, the graph of vectors and the learned analyzer against plain versions."""

import random
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from sorrel import vocab
from sorrel.functions import text
from sorrel.operators import enrich, lexical, morphemes, review_index, search, substring, vector_graph

QUERIES = ["배터리 오래 가는 만족 리뷰", "포장 꼼꼼 만족", "발열 심 불편", "카메라", "the word", "없음", "배터리 빨리 닳아서 불만"]
LINES = ["배터리 오래 가서 만족", "포장 꼼꼼 안전하게 도착 만족", "발열 심 너무 뜨겁 불편", "카메라 별로", "the word the", "그냥", "배터리 빨리 닳 방전 불만", ""]


@pytest.fixture(scope="module")
def documents(spark):
    draw = random.Random(4)
    rows = []
    for k in range(230):
        body = " ".join([draw.choice(LINES), *draw.choices(["word", "the", "other", "긴", "말"], k=draw.randrange(0, 30)), draw.choice(LINES)])
        rows.append((f"r{k:03}", draw.choice(["phone", "word", None]), draw.choice([None, "배터리"]), draw.choice(LINES), None if k == 7 else body, [(q, draw.choice(LINES)) for q in "ab"[: draw.randrange(0, 3)]] or None))
    schema = "review_id string, product_name string, item_name string, title string, content string, review_survey_answers array<struct<question:string,answer:string>>"
    return enrich.enrich(spark.createDataFrame(rows, schema)).cache()


@pytest.fixture(scope="module")
def expanded(spark):
    return search.expand(spark.createDataFrame(list(enumerate(QUERIES)), "query_id int, query string")).cache()


def rows_of(df):
    return sorted((r.query_id, r.doc_id, round(r.score, 7)) for r in df.collect())


@pytest.mark.parametrize(("size", "first", "top"), [(4, 8, 5), (16, 2, 20), (64, 8, 100)])
def test_best_by_blocks_equals_scoring_every_match(spark, documents, expanded, monkeypatch, size, first, top):
    monkeypatch.setattr(review_index, "RANGE", size)
    index = review_index.build(documents)
    found = review_index.best(index, expanded, top=top, first=first)
    assert rows_of(found.ranked) == rows_of(review_index.exhaustive(index, expanded, top=top)) != []
    work = found.work.collect()
    assert all(r.scored <= r.postings and r.ranges_scored <= r.ranges for r in work)
    if size == 4:
        assert sum(r.scored for r in work) < 0.7 * sum(r.postings for r in work)


def test_bounds_are_never_below_scores(spark, documents, expanded):
    index = review_index.build(documents)
    asked = review_index.asked_terms(expanded)
    met = review_index.met_blocks(index, asked)
    heads = met.select("query_id", "range", "clause", "field", (F.col("weight") * F.col("most")).alias("gain"))
    bounds = {(r.query_id, r.range): r.score for r in review_index.totals(heads, "range", elements=False).collect()}
    gains = review_index.posting_gains(index, met)
    places = {r.doc_id: r.range for r in gains.select("doc_id", "range").distinct().collect()}
    scores = review_index.totals(gains.drop("range"), "doc_id").collect()
    assert scores and all(r.score <= bounds[r.query_id, places[r.doc_id]] + 1e-9 for r in scores)


def test_a_search_reads_heads_first_and_tokenizes_no_review(spark, documents, expanded, tmp_path):
    index = review_index.build(documents, folder=str(tmp_path / "index"))
    asked = search.settled(review_index.asked_terms(expanded))
    plan = review_index.met_blocks(index, asked)._jdf.queryExecution().executedPlan().toString()
    assert "regexp_extract_all" not in plan and "postings" not in plan
    plan = review_index.posting_gains(index, review_index.met_blocks(index, asked))._jdf.queryExecution().executedPlan().toString()
    assert "regexp_extract_all" not in plan and "postings" in plan
    again = review_index.load(spark, str(tmp_path / "index"))
    assert rows_of(review_index.best(again, expanded).ranked) == rows_of(review_index.best(index, expanded).ranked)


def test_a_search_that_makes_its_index_stores_what_its_queries_look_up(spark, documents, expanded, monkeypatch):
    built, build = [], review_index.build
    monkeypatch.setattr(review_index, "build", lambda *a, **k: built.append(build(*a, **k)) or built[-1])
    found = search.lexical_leg(documents, expanded, top=20)
    whole = build(documents)
    assert rows_of(found) == rows_of(review_index.exhaustive(whole, expanded, top=20)) != []
    words = {w for r in expanded.select(*[F.col(c) for c in ("bm25_terms", "aspect_terms", "positive_terms", "negative_terms", "positive_phrases", "negative_phrases")], F.array("query").alias("q")).collect() for ts in r for t in ts for w in t.split()}
    terms = {(r.field, r.term): r.df for r in built[0].terms.collect()}
    assert terms == {(r.field, r.term): r.df for r in whole.terms.collect() if r.term in {t for _, t in terms}} and {t for _, t in terms} <= words
    # Lengths and numbers of texts are those of all tokens.
    of_all = documents.select(text.tokens_cased(F.coalesce("content", F.lit(""))).alias("t")).where(F.size("t") > 0).agg(F.count("t").alias("n"), F.avg(F.size("t")).alias("avgdl")).first()
    fields = [{r.field: (r.n, r.avgdl) for r in index.fields.collect()} for index in (built[0], whole)]
    assert fields[0] == fields[1] and fields[0]["content"] == (of_all.n, of_all.avgdl)


def test_filter_masks(spark):
    issues = "array<struct<issue_category:string,sentiment:string,evidence:string>>"
    df = spark.createDataFrame([(0, []), (1, [("카메라", "negative", "x"), ("기타", "neutral", "")]), (2, None), (3, [("카메라", "nonsense", "")])], f"i int, s {issues}")
    masks = {r.i: r.m for r in df.select("i", review_index.mask_of(F.col("s")).alias("m")).collect()}
    assert masks[0] == masks[2] == masks[3] == 0 and bin(masks[1]).count("1") == 2
    every = [(c, s) for c in vocab.ISSUE_CATEGORIES for s in vocab.SENTIMENTS]
    bits = spark.createDataFrame(every, "c string, s string").select(review_index.pair_bit(F.col("c"), F.col("s")).alias("m")).collect()
    assert len({r.m for r in bits}) == len(every) and all(0 < r.m < 1 << 40 for r in bits)


def test_an_empty_table_has_an_index(spark, documents, expanded):
    index = review_index.build(documents.limit(0))
    assert review_index.best(index, expanded).ranked.collect() == []


# --- graph of vectors


def vector_table(spark, n=600, size=12, seed=2):
    draw = np.random.default_rng(seed)
    centres = draw.standard_normal((8, size))
    rows = [(k, (centres[k % 8] + 0.6 * draw.standard_normal(size)).tolist(), 1 << (k % 5)) for k in range(n)] + [(n, [0.0] * size, 1), (n + 1, [1.0] * size, 16), (n + 2, [1.0] * size, 16)]
    return spark.createDataFrame(rows, "doc_id long, vector array<double>, mask long").repartition(3)


def pairs(df):
    return {(r.query_id, r.doc_id) for r in df.collect()}


def test_graph_finds_nearest_vectors(spark, monkeypatch):
    monkeypatch.setattr(vector_graph, "SEGMENT", 250)
    table = vector_table(spark)
    graph = vector_graph.build(table)
    assert graph.segments.count() == 3
    queries = table.where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), "vector")
    walked = vector_graph.walk(graph, queries, 10, 12, block=7)
    met, wanted = pairs(vector_graph.graph_leg(graph, queries, 10, 40)), pairs(search.dense_leg(table.drop("mask"), queries, 10))
    assert len(met & wanted) >= 0.95 * len(wanted) and len(met) == len(wanted)
    scored = [r.scored for r in vector_graph.work(walked).collect()]
    assert len(scored) == queries.count() and np.mean(scored) < 0.8 * table.count()


def test_graph_with_the_exact_check_misses_nothing(spark):
    """Vectors at random and many copies of one, through which a short walk doesn't get."""
    draw = np.random.default_rng(5)
    rows = [(k, draw.standard_normal(48).tolist(), 1 << (k % 3)) for k in range(1500)] + [(k, [1.0] * 48, 1 << (k % 3)) for k in range(2000, 2300)]
    table = spark.createDataFrame(rows, "doc_id long, vector array<double>, mask long").repartition(3)
    graph, queries = vector_graph.build(table), table.where("doc_id % 60 = 0").select(F.col("doc_id").alias("query_id"), "vector", "mask")
    for asked, vectors in ((queries.drop("mask"), table.drop("mask")), (queries, table)):
        wanted = rows_of(search.dense_leg(vectors, asked, 10))
        assert rows_of(vector_graph.graph_leg(graph, asked, 10, 10)) != wanted
        assert rows_of(vector_graph.graph_leg(graph, asked, 10, 10, exact=True)) == wanted


def test_graph_filters_while_walking(spark, monkeypatch):
    monkeypatch.setattr(vector_graph, "SEGMENT", 700)
    table = vector_table(spark)
    graph = vector_graph.build(table)
    queries = table.where("doc_id % 30 = 0").select(F.col("doc_id").alias("query_id"), "vector", F.col("mask"))
    for candidates in (12, 100):
        met, wanted = pairs(vector_graph.graph_leg(graph, queries, 10, candidates)), pairs(search.dense_leg(table, queries, 10))
        assert len(met & wanted) >= 0.9 * len(wanted)
    masks = {r.doc_id: r.mask for r in table.collect()}
    assert all(masks[q] & masks[d] for q, d in met)


def test_graph_of_few_vectors(spark):
    table = spark.createDataFrame([("a", [1.0, 0.0])], "doc_id string, vector array<float>")
    queries = spark.createDataFrame([(1, [2.0, 0.0]), (2, [0.0, 0.0])], "query_id int, vector array<double>")
    assert sorted((r.query_id, r.doc_id, r.score) for r in vector_graph.graph_leg(vector_graph.build(table), queries, 5).collect()) == [(1, "a", 1.0), (2, "a", 0.5)]
    assert vector_graph.graph_leg(vector_graph.build(table.limit(0)), queries, 5).collect() == []
    assert vector_graph.graph_leg(vector_graph.build(table), queries.limit(0), 5).collect() == []


def test_hybrid_search_by_graph(spark, documents, expanded):
    docs = documents.withColumn("vector", search.embed(F.coalesce("content", F.lit("")), 64)).cache()
    index, graph = review_index.build(docs), search.vector_graph_of(docs)
    embedder = lambda c: search.embed(c, 64)
    exact, near = (search.search_batch(docs, expanded, index, embedder=embedder, graph=g) for g in (None, graph))
    assert rows_of(exact.lexical) == rows_of(near.lexical)
    a, b = pairs(exact.dense), pairs(near.dense)
    assert len(a & b) >= 0.9 * len(a)
    assert search.stores_graph(docs, least=100) and not search.stores_graph(docs, least=1000)


# --- analyzer


def test_paths_are_cheapest():
    costs = {"가": 5, "나": 7, "가나": 9, "나다": 9, "다": 4, "가나다": 16, "라": 1}
    lattice = morphemes.Lattice(costs)

    def plain(word):
        best = None
        for cuts in product([0, 1], repeat=len(word) - 1):
            edges = [0, *[k + 1 for k, c in enumerate(cuts) if c], len(word)]
            parts = [word[a:b] for a, b in zip(edges, edges[1:], strict=False)]
            if any(p not in costs and len(p) > 1 for p in parts):
                continue
            found = (sum(costs.get(p, lattice.unknown) for p in parts), len(parts), [-len(p) for p in parts])
            best = found if best is None else min(best, found)
        return best

    for n in range(1, 7):
        for letters in product("가나다라마", repeat=n):
            word = "".join(letters)
            cost, lengths = lattice.path(word)
            assert (cost, len(lengths), [-x for x in lengths]) == plain(word)
    assert lattice.cut("가나마바라") == ["가나", "마바", "라"] and lattice.cut("마바") == ["마바"] and morphemes.Lattice({}).cut("가나") == ["가나"]
    long = "가나다마" * 20_000
    assert "".join(lattice.cut(long)) == long and long not in lattice.memo


def test_units_are_learned_from_counts(spark):
    stems, endings = ["배터리", "카메라", "화면"], ["가", "는", "를", "에서"]
    texts = [(f"{s}{e} {s}",) for s in stems for e in endings for _ in range(5)] + [(None,), ("abc 123",), ("하나뿐인말",)]
    words = morphemes.word_counts(spark.createDataFrame(texts, "t string"), F.col("t"))
    units = {r.unit: r.cost for r in morphemes.learn_units(words).collect()}
    assert {*stems, *endings} <= set(units) and not {"배터", "카메", "하나뿐인말"} & set(units)
    learned = morphemes.learn_units(words)
    both = spark.createDataFrame([(1, "배터리에서 카메라를, USB케이블 화면는3"), (2, None), (3, "")], "i int, t string")
    cut = {r.i: r.t for r in both.select("i", morphemes.analyzer(learned)(F.col("t")).alias("t")).collect()}
    assert cut == {1: ["배터리", "에서", "카메라", "를", "USB", "케이블", "화면", "는", "3"], 2: [], 3: []}
    only = both.select(morphemes.analyzer(learned, others=False)(F.col("t")).alias("t")).collect()
    assert only[0].t == ["배터리", "에서", "카메라", "를", "케이블", "화면", "는"]
    assert {r.unit: r.cost for r in morphemes.learn_units(words.repartition(7)).collect()} == units
    empty = morphemes.learn_units(words.limit(0))
    assert empty.collect() == [] and both.select(morphemes.analyzer(empty)(F.col("t")).alias("t")).first().t[0] == "배터리에서"


def test_search_with_the_learned_analyzer(spark, documents, expanded):
    words = morphemes.word_counts(documents, F.col("content"))
    tokens = morphemes.analyzer(morphemes.learn_units(words))
    index = review_index.build(documents, tokens)
    found = review_index.best(index, expanded, tokens)
    assert rows_of(found.ranked) == rows_of(review_index.exhaustive(index, expanded, tokens)) != []
    plain = review_index.best(review_index.build(documents), expanded, text.tokens_cased).ranked
    asked = QUERIES.index("배터리 빨리 닳아서 불만")
    assert found.ranked.where(F.col("query_id") == asked).count() >= plain.where(F.col("query_id") == asked).count() > 0


# --- wildcards


@pytest.mark.parametrize("pattern", ["*the*ing*", "src1*", "ab", "*", "a?c*", "?bc", "", "*배터리*만족", "a.c*", "abc", "*\\n*", "the*"])
def test_wildcards_by_trigrams_equal_the_scan(spark, substrings, pattern):
    docs, index = substrings
    for field in ("content", "name"):
        got = sorted((r.doc_id, r.score) for r in substring.wildcard(index, field, pattern, 2.0).collect())
        assert got == sorted((r.doc_id, r.score) for r in lexical.wildcard(docs, "i", F.col(field), pattern, 2.0).collect())


@pytest.fixture(scope="module")
def substrings(spark):
    values = [None, "", "ab", "abc", "a.c", "axc the singing", "the end", "src1", "src12 the ing", "aaaaaa", "배터리 오래 만족", "x\nthe\ning", "abcabc"]
    docs = spark.createDataFrame([(k, v, values[-k]) for k, v in enumerate(values)], "i long, content string, name string").repartition(2)
    return docs, substring.build(docs, "i", {"content": F.col("content"), "name": F.col("name")})


def test_only_candidates_are_examined(spark, substrings):
    _, index = substrings
    assert substring.required("*the*ing*") == ["ing", "the"] and substring.required("a?b*cd") == [] and substring.required("abcd?") == ["abc", "bcd"]
    assert {r.doc_id for r in substring.candidates(index, "content", "*the*ing*").collect()} == {5, 8, 11}
    assert substring.candidates(index, "content", "a*").count() == 12
