"""The command line from files to files."""

import json

from pyspark.sql import functions as F

from sorrel import cli
from sorrel.sources import files

LINES = [("배터리", "배터리가 오래가서 정말 만족합니다"), ("포장", "포장이 파손되어 왔고 정말 실망했습니다"), ("화면", "화면이 선명하고 부드러워서 아주 좋아요"), ("발열", "발열이 심해서 손에 들고 있기 힘들어요")]


def reviews(folder, n=24):
    rows = [{"reviewId": str(i), "review_id": str(i), "product_name": "폰", "content": f"{LINES[i % 4][1]} {i}번째 후기", "rating": 1 + i % 5, "label": i % 4} for i in range(n)]
    (folder / "reviews.json").write_text(json.dumps(rows, ensure_ascii=False))
    return str(folder / "reviews.json")


def test_ingest_evaluate_and_preview(spark, tmp_path):
    path, table, bad, index = reviews(tmp_path), str(tmp_path / "docs"), str(tmp_path / "bad"), str(tmp_path / "index")
    base = ["ingest", "--input", path, "--checkpoint", table, "--failed-log", bad, "--index-name", index, "--llm"]
    first = cli.run(spark, [*base, "--limit", "10", "--batch-size", "4"])
    assert first["processed"] == first["kept"] == first["indexed"] == 10
    again = cli.run(spark, [*base, "--resume", "--no-index"])
    assert (again["processed"], again["resumed"], again["kept"]) == (24, 10, 14)
    assert cli.run(spark, ["ingest", "--checkpoint", table, "--failed-log", bad, "--index-name", index, "--index-from-checkpoint", "--recreate"])["indexed"] == 24
    cases = {f"q{k}": {"query": f"{word} 리뷰", "category": "a" if k < 2 else "b", "reviews_to_evaluate": [{"reviewId": str(i)} for i in range(24) if i % 4 == k] + [{"reviewId": ""}]} for k, (word, _) in enumerate(LINES)}
    (tmp_path / "eval.json").write_text(json.dumps(cases | {"none": {"query": "x y z", "category": "b", "reviews_to_evaluate": []}}, ensure_ascii=False))
    out = str(tmp_path / "out")
    summary = cli.run(spark, ["evaluate", "--documents", table, "--eval-path", str(tmp_path / "eval.json"), "--output-dir", out, "--k", "5"])
    assert summary["query_count"] == 5 and set(summary["by_category"]) == {"a", "b"} and summary["by_category"]["b"]["query_count"] == 3
    assert json.loads((tmp_path / "out" / "retrieval_eval_summary.json").read_text()) == summary
    rows = files.read_csv(spark, f"{out}/retrieval_eval", "query_id string, category string, query string, gold_count int, bm25 double, dense double, rrf double, hits int, recall double, ap double, final_ids string, missing string").collect()
    told = {r.query_id: r for r in rows}
    assert told["none"].gold_count == 0 and told["none"].recall == 0.0 and told["q0"].gold_count == 6
    assert all(len((told[f"q{k}"].final_ids or "").split()) <= 5 for k in range(4)) and summary["map_at_k"] > 0.3
    assert len(cli.run(spark, ["preview", "--input", path, "--limit", "2", "--llm"])) == 2


def test_classify_compares_folds(spark, tmp_path):
    path, out = reviews(tmp_path, 40), str(tmp_path / "out")
    base = ["classify", "--data-path", path, "--output-dir", out, "--cv-folds", "2"]
    split = cli.run(spark, [*base, "--prepare-only", "--save-preprocessed"])["folds"]
    assert [f["n_validation"] for f in split] == [20, 20] and split[0]["train_label_0"] == 5
    members = spark.read.json(f"{out}/split_seed42_k2_ids")
    assert members.groupBy("fold", "part").count().where("count <> 20").count() == 0
    told = cli.run(spark, [*base, "--models", "tfidf_logreg", "random", "--max-iter", "20"])
    assert told["leaderboard"][0]["model"] == "tfidf_logreg" and told["leaderboard"][0]["macro_f1_mean"] > 0.9
    random = told["models"]["random"]["folds"]
    assert random[0]["macro_f1"] != random[1]["macro_f1"] and told["leaderboard"][1]["macro_f1_std"] > 0
    both = cli.run(spark, ["classify", "--output-dir", out, "--cv-folds", "2", "--ensemble-only", "--ensemble-models", "tfidf_logreg", "random", "--ensemble-weights", "2", "1"])
    assert both["accuracy"] > 0.9
    assert cli.run(spark, [*base, "--validation-size", "0.25", "--max-iter", "20"])["accuracy"] > 0.9


def test_samples(spark, tmp_path):
    assert cli.run(spark, ["sample", "index", "--index-name", str(tmp_path / "i")]) == 3
    assert {r.id for r in cli.run(spark, ["sample", "search", "--query", "포장"])} == {"demo-3"}
    assert -1 <= cli.run(spark, ["sample", "sentiment"]) <= 1
    assert files.dummy_reviews(spark).where(F.length("content") < 10).count() == 0
