import pytest
from pyspark.sql import functions as F

from sorrel.functions import text


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t")).alias("r")).first()["r"]


@pytest.mark.parametrize(
    ("given", "wanted"),
    [
        (None, ""), ("NaN", ""), ("&lt;b&gt;good&lt;/b&gt;", "good"), ("see https://a.b/c now", "see now"), ("mail é.a@b.com ok", "mail ok"), ("call 010-1234-5678 now", "call now"),
        ("전화010-1234-5678", "전화010-1234-5678"), ("a" + chr(0x200B) + "b", "ab"), ("ㅋㅋㅋㅋㅋㅋ", "ᄏ" * 6), ("wow!!!!!", "wow!!!"), ("hm......", "hm..."), (" a \t b ", "a b"), ("！", "!"),
    ],
)
def test_document_cleaner(spark, given, wanted):
    assert one(spark, given, text.clean_document) == wanted


@pytest.mark.parametrize(("given", "wanted"), [("좋아아아아아!!!!! ㅋㅋㅋㅋㅋㅋ", "좋아아!!! ㅋㅋㅋㅋ"), ("ㅠㅠㅠㅠㅠㅠ", "ㅠㅠㅠㅠ"), ("a\x01b", "a b"), (None, "None"), ("하하하하하", "하하")])
def test_sentiment_cleaner(spark, given, wanted):
    assert one(spark, given, text.clean_sentiment) == wanted


def test_fingerprints_and_signal(spark):
    assert one(spark, "Ab c-1 가é", text.fingerprint) == "abc1가"
    assert one(spark, "Ab c-1 가é", text.fingerprint_any) == "abc1가é"
    assert one(spark, "!!!!!!!!!!!! ok", text.has_signal) is False
    assert one(spark, "0123456789", text.has_signal) is True


def test_char_grams(spark):
    assert sorted(one(spark, "ab", text.char_wb_ngrams)) == sorted([" a", "ab", "b ", " ab", "ab ", " ab "])
    assert sorted(one(spark, "a", text.char_wb_ngrams)) == sorted([" a", "a ", " a "])


def test_bigrams_match_under_particles(spark):
    assert one(spark, "배터리도 AB", text.hangul_bigrams) == ["배터", "터리", "리도", "ab"]


def test_dense_text(spark):
    answers = "array(named_struct('question', '', 'answer', 'a'), named_struct('question', 'q', 'answer', 'b'))"
    none = {"issue_category": "cast(null as array<string>)", "aspect_keywords": "array('k1', 'k2')", "issue_sentiments": "array(named_struct('issue_category', 'c', 'sentiment', 'positive', 'evidence', ''))", "review_survey_answers": answers}
    columns = {n: F.lit(v) for n, v in {"product_name": "p", "item_name": None, "title": " ", "content": "body", "short_summary": None}.items()} | {n: F.expr(e) for n, e in none.items()}
    got = spark.range(1).select(text.dense_text({k: v.cast("string") if k in ("item_name", "short_summary") else v for k, v in columns.items()})).first()[0]
    assert got == "상품명: p\n본문: body\n관점 키워드: k1, k2\n이슈별 감성: c | positive\n설문 응답: a / q: b"


def test_float_tag():
    assert text.float_tag(-0.25) == "m0p25"


def test_labelled_lines_strip_values_of_any_edge(spark):
    values = [None, "", " 　", "a", "a b", "　a b", "a b\u0085", "\n a  \r\n", " 가 나 ", "😀 x 😀"]
    rows = spark.createDataFrame(list(enumerate(values)), "i int, v string")
    lines = text.labelled_lines([("L", F.col("v"))])
    got = {r.i: r.line for r in rows.select("i", lines.alias("line")).collect()}
    assert got == {i: f"L: {v.strip()}" if v and v.strip() else "" for i, v in enumerate(values)}
