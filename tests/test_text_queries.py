import hashlib

from sorrel.plans import registry


def test_survey_holds_whole_answers(spark, tmp_path):
    long = "an answer that goes on well beyond forty characters, then "
    turns = [(1, 1, "user", long + "one"), (1, 2, "bot", " " + long + "two "), (2, 1, "user", long + "other"), (2, 2, "bot", long + "two"), (2, 3, "bot", ""), (3, 1, "", "x")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.conv_id: (r.answers, r.survey) for r in registry.QUERIES["survey_nested_whole"](spark, str(tmp_path)).collect()}
    digest = lambda first: hashlib.md5(f"user: {long}{first} / bot: {long}two".encode()).hexdigest()
    assert got == {1: (2, digest("one")), 2: (2, digest("other"))}
