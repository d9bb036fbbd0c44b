"""Command line: ingest reviews, evaluate retrieval, compare classifiers, look at samples.

    python -m sorrel.cli ingest --input reviews.json --checkpoint table --failed-log failures [--resume] [--llm] [--no-index | --index-from-checkpoint]
    python -m sorrel.cli evaluate --documents table --eval-path eval.json --output-dir out [--skip-rerank]
    python -m sorrel.cli classify --data-path labelled.json --output-dir out [--prepare-only | --ensemble-only ...]
    python -m sorrel.cli sample {sentiment,index,search} --query TEXT
    python -m sorrel.cli preview --input reviews.json --limit 3 [--llm]
"""

from __future__ import annotations

import argparse
import os

from pyspark.sql import functions as F

from sorrel import vocab
from sorrel.config import load_config, named
from sorrel.functions import text
from sorrel.operators import classify, documents, embedding, enrich, experiments, learning, lexical, ranking, review_index, search, trainer
from sorrel.scratch import remove, written
from sorrel.session import build_session
from sorrel.sources import files
from sorrel.streaming import ingest


def parser() -> argparse.ArgumentParser:
    settings = load_config()
    top = argparse.ArgumentParser(prog="sorrel", description="Review analytics on Spark")
    sub = top.add_subparsers(dest="command", required=True)

    p = sub.add_parser("ingest", help="build the document table and its index; with --resume only what is new")
    p.add_argument("--input", help="a JSON array of raw reviews")
    p.add_argument("--limit", type=int, help="only the first reviews")
    p.add_argument("--llm", action="store_true", help="enrich documents: by the rules, which stand in for a language model")
    p.add_argument("--batch-size", type=int, default=1_000_000, help="reviews in a batch")
    p.add_argument("--checkpoint", "--output", default=settings.documents, help="the document table")
    p.add_argument("--failed-log", default=settings.failures)
    p.add_argument("--resume", action="store_true", help="keep the table and skip reviews whose id or content it holds")
    p.add_argument("--no-index", action="store_true")
    p.add_argument("--index-from-checkpoint", action="store_true", help="only index the table")
    p.add_argument("--index-name", default=settings.index, help="the folder of the index")
    p.add_argument("--recreate", action="store_true", help="make the index anew where there is one")

    p = sub.add_parser("evaluate", help="recall and average precision of all search stages against gold")
    p.add_argument("--documents", default=settings.documents)
    p.add_argument("--eval-path", required=True)
    p.add_argument("--output-dir", required=True)
    p.add_argument("--index-name", help="a stored index of the enriched documents; built where none is named")
    p.add_argument("--limit", type=int, help="only the first queries")
    p.add_argument("--k", type=int, default=vocab.FINAL_TOP)
    p.add_argument("--skip-rerank", action="store_true", help="keep the fusion order; without a cross-encoder it is kept anyway")

    p = sub.add_parser("classify", help="cross-validated sentiment classification, model comparison and ensembles")
    p.add_argument("--data-path")
    p.add_argument("--output-dir", required=True)
    p.add_argument("--validation-size", type=float, help="train once and hold out this share, in place of folds")
    p.add_argument("--cv-folds", "--n-splits", type=int, default=5)
    p.add_argument("--seed", type=int, default=42)
    p.add_argument("--save-preprocessed", action="store_true")
    p.add_argument("--models", nargs="+", default=["tfidf_logreg"], choices=["tfidf_logreg", "random", "network"])
    p.add_argument("--prepare-only", action="store_true", help="only save folds and their metadata")
    p.add_argument("--max-features", type=int, default=learning.CONFIG["max_features"])
    p.add_argument("--max-iter", type=int, default=learning.CONFIG["max_iter"])
    fine = experiments.Training(model="")
    for name, kind in (("epochs", int), ("batch_size", int), ("learning_rate", float), ("max_length", int)):
        p.add_argument(f"--transformer-{name.replace('_', '-')}", type=kind, default=trainer.Network.learning_rate if name == "learning_rate" else getattr(fine, name), help="of the network that is trained")
    p.add_argument("--transformer-warmup-ratio", type=float, default=fine.warmup_share)
    p.add_argument("--transformer-weight-decay", type=float, default=fine.weight_decay)
    p.add_argument("--class-weight-mode", choices=experiments.WEIGHT_MODES, default="inverse")
    p.add_argument("--effective-number-beta", type=float, default=0.999)
    p.add_argument("--custom-class-weights", nargs=4, type=float, metavar=("W0", "W1", "W2", "W3"))
    p.add_argument("--loss", choices=["cross_entropy", "focal"], default="cross_entropy")
    p.add_argument("--focal-gamma", type=float, default=1.0)
    p.add_argument("--experiment-name")
    p.add_argument("--ensemble-only", action="store_true", help="combine saved predictions")
    p.add_argument("--ensemble-models", nargs="+", default=["tfidf_logreg"])
    p.add_argument("--ensemble-method", choices=experiments.ENSEMBLES, default="soft")
    p.add_argument("--ensemble-weights", nargs="+", type=float)

    p = sub.add_parser("sample", help="run on three made-up reviews")
    p.add_argument("what", choices=["sentiment", "index", "search"])
    p.add_argument("--query", default="배터리")
    p.add_argument("--seed", type=int, default=42)
    p.add_argument("--data-path", help="labelled reviews in place of the made-up ones")
    p.add_argument("--index-name", default=f"{settings.index}-sample")

    p = sub.add_parser("preview", help="print the first documents of an input")
    p.add_argument("--input", required=True)
    p.add_argument("--limit", type=int, default=3)
    p.add_argument("--llm", action="store_true")
    return top


def enriched(docs):
    return enrich.enrich(docs).withColumn("error", F.lit(None).cast("string"))


def ingest_command(spark, a) -> dict[str, int]:
    if a.index_from_checkpoint and a.no_index:
        raise ValueError("--index-from-checkpoint needs the index")
    total = dict.fromkeys(("processed", "resumed", "failed", "kept", "indexed"), 0)
    if not a.index_from_checkpoint:
        if not a.resume:
            remove(spark, a.checkpoint)
            remove(spark, a.failed_log)
        rows = files.first_rows(files.read_json(spark, a.input, files.REVIEW_SCHEMA), a.limit)
        known = ingest.stored(spark, a.checkpoint)
        first = 0 if known is None else known.agg(F.max("batch_id")).first()[0] + 1
        steps = ingest.Steps(enrich=enriched if a.llm else None)
        for k, batch in enumerate(ingest.in_batches(rows, a.batch_size)):
            for name, n in ingest.ingest_batch(batch, first + k, a.checkpoint, a.failed_log, steps).items():
                total[name] += n
            print(" | ".join(f"{name} {n}" for name, n in total.items()))
    if not a.no_index and ingest.stored(spark, a.checkpoint) is not None:
        if a.recreate:
            remove(spark, a.index_name)
        ingest.reindex(spark, a.checkpoint, a.index_name)
        total["indexed"] = ingest.index_count(spark, a.checkpoint)
    print(f"{ingest.index_count(spark, a.checkpoint)} documents")
    return total


def evaluate_command(spark, a) -> dict:
    docs, settings = spark.read.parquet(a.documents), load_config()
    embedder = embedding.embedder(spark, embedding.load(spark, settings.embedding)) if settings.embedding else search.embed
    score_pairs = None if a.skip_rerank else named(settings.reranker)
    if "issue_sentiments" not in docs.columns:
        docs = enrich.enrich(docs)
    if "vector" not in docs.columns:
        docs = docs.withColumn("vector", embedder(F.col("dense_text")))
    docs = written(docs, "evaluated")
    cases = written(files.first_rows(files.load_evaluation(spark, a.eval_path), a.limit), "cases")
    gold = cases.select("query_id", F.explode("gold").alias("doc_id"))
    expanded = search.settled(search.expand(cases.select("query_id", "query")))
    there = a.index_name and files.path_exists(spark, f"{a.index_name}/blocks")
    index = review_index.load(spark, a.index_name) if there else review_index.build(docs, folder=a.index_name or None, expanded=None if a.index_name else expanded)
    graph = search.vector_graph_of(docs) if search.stores_graph(docs) else None
    legs = search.search_batch(docs, expanded, index, score_pairs, a.k, embedder=embedder, graph=graph)
    final = legs.final.select("query_id", "doc_id", F.col("final_rank").alias("rank"))
    stages = {"bm25": (legs.lexical, vocab.LEXICAL_TOP), "dense": (legs.dense, vocab.DENSE_TOP), "rrf": (legs.fused, vocab.FUSION_TOP), "final": (final, a.k)}
    told = ranking.stage_summary(stages, gold, cases)
    lost = ranking.missing(final, gold, a.k).groupBy("query_id").agg(F.array_sort(F.collect_list("doc_id")).alias("missing"))
    rows = cases.select("query_id", "category", "query", F.size(F.array_distinct("gold")).alias("gold_count")).join(told, "query_id").join(lost, "query_id", "left")
    rows = written(rows.withColumn("missing", F.coalesce("missing", F.array().cast("array<string>"))), "evaluation")
    flat = rows.select(
        "query_id", "category", "query", "gold_count", F.col("bm25_recall").alias("bm25_recall_at_100"), F.col("dense_recall").alias("dense_recall_at_100"), F.col("rrf_recall").alias("rrf_recall_at_50"),
        F.col("final_hits").alias("final_hits_at_k"), F.col("final_recall").alias("final_recall_at_k"), F.col("final_ap").alias("final_ap_at_k"), F.array_join("final_ids", " ").alias("final_ids"), F.array_join("missing", " ").alias("missing_gold_ids"))
    files.write_csv(flat.orderBy("query_id"), f"{a.output_dir}/retrieval_eval")
    files.write_json(rows, f"{a.output_dir}/retrieval_eval_details")
    summary = ranking.macro_means(rows).first().asDict()
    by_category = ranking.by_category(rows.select("query_id", "category", F.col("final_ap").alias("ap"), F.col("final_recall").alias("recall"))).orderBy("category").collect()
    summary["by_category"] = {r["category"]: {"query_count": r["queries"], "map_at_k": r["map"], "mean_final_recall_at_k": r["recall"]} for r in by_category}
    files.write_document(spark, summary, f"{a.output_dir}/retrieval_eval_summary.json")
    print(summary)
    return summary


def classify_command(spark, a) -> dict:
    custom = a.class_weight_mode == "custom"
    if custom != bool(a.custom_class_weights):
        raise ValueError("--custom-class-weights and the custom mode go together")
    settings = experiments.Training("", a.transformer_epochs, a.transformer_batch_size, a.transformer_learning_rate, a.transformer_max_length, a.transformer_warmup_ratio, a.transformer_weight_decay,
                                    loss="focal" if a.loss == "focal" else "ce", gamma=a.focal_gamma, class_weights=a.class_weight_mode, beta=a.effective_number_beta)
    tag = a.experiment_name or ""
    saved = f"{a.output_dir}/predictions{f'_{tag}' if tag else ''}"
    if a.ensemble_only:
        said, told = experiments.ensemble_with_metrics(spark, saved, a.ensemble_models, a.ensemble_method, a.cv_folds, a.seed, weights=a.ensemble_weights)
        scores = told.first().asDict()
        files.write_json(said, f"{a.output_dir}/ensemble_{a.ensemble_method}_seed{a.seed}_k{a.cv_folds}")
        files.write_document(spark, {"models": a.ensemble_models, "method": a.ensemble_method, "metrics": scores}, f"{a.output_dir}/ensemble_{a.ensemble_method}_seed{a.seed}_k{a.cv_folds}.json")
        print(scores)
        return scores
    raw = files.required(files.load_labelled(spark, a.data_path, "review_id string, content string, label int, product_name string, label_string string"), "content", "label")
    rows = written(learning.prepared(raw), "prepared")
    if a.save_preprocessed:
        files.write_json(rows, f"{a.output_dir}/preprocessed")
    folded = written(classify.stratified_folds(rows, a.cv_folds, a.seed), "folded")
    files.write_json(classify.fold_members(folded), f"{a.output_dir}/split_seed{a.seed}_k{a.cv_folds}_ids")
    split = [r.asDict() for r in classify.fold_metadata(folded).orderBy("fold").collect()]
    files.write_document(spark, {"seed": a.seed, "strategy": "stratified_kfold", "n_splits": a.cv_folds, "folds": split}, f"{a.output_dir}/split_seed{a.seed}_k{a.cv_folds}.json")
    if a.prepare_only:
        return {"folds": split}
    content = rows.select("review_id", "label", F.col("clean_content").alias("content"))
    if a.validation_size is not None:
        said = written(learning.train_and_hold_out(content, a.validation_size, a.seed, a.max_features, a.max_iter), "held-out")
        scores = classify.metrics(said).first().asDict()
        files.write_json(said, f"{a.output_dir}/holdout_seed{a.seed}")
        print(scores)
        return scores
    logs = {}

    def network(rows, folds, seed):
        said, logs["network"] = trainer.cross_validate(rows, settings, folds, seed, custom=a.custom_class_weights)
        return said

    known = {"tfidf_logreg": experiments.tfidf_candidate(a.max_features, a.max_iter), "random": experiments.random_candidate(), "network": network}
    board = experiments.sweep(content, {m: known[m] for m in a.models}, saved, a.cv_folds, a.seed)
    ranked = [r.asDict() for r in board.collect()]
    details = {}
    for model in a.models:
        said = files.load_predictions(spark, saved, [model], a.seed, a.cv_folds)
        folds = [r.asDict() for r in experiments.fold_scores(said).orderBy("fold").collect()]
        details[model] = {"folds": folds, "out_of_fold": experiments.out_of_fold(said).first().asDict()}
        if model in logs:
            details[model]["losses"] = [r.asDict() for r in experiments.epoch_losses(logs[model], "fold").orderBy("fold", "epoch").collect()]
    files.write_document(spark, {"leaderboard": ranked, "models": details, "settings": settings.record(), "tfidf": learning.CONFIG}, f"{a.output_dir}/model_comparison{f'_{tag}' if tag else ''}_seed{a.seed}_k{a.cv_folds}.json")
    print(ranked)
    return {"leaderboard": ranked, "models": details}


def sample_command(spark, a):
    rows = files.dummy_reviews(spark)
    if a.what == "sentiment":
        if a.data_path:
            rows = files.load_labelled(spark, a.data_path, files.DUMMY_SCHEMA)
        aligned = classify.align(learning.random_baseline(rows, a.seed), rows.select("review_id", "label"))
        score = aligned.agg(classify.kappa().alias("qwk")).first()["qwk"]
        print(f"qwk {score}")
        return score
    if a.what == "index":
        lexical.store_index(lexical.build_index(rows, "review_id", lexical.standard_fields(["content", "product_name"])), a.index_name, 1)
        count = rows.count()
        print(f"{count} reviews indexed at {a.index_name}")
        return count
    found = sample_search(rows, spark.createDataFrame([(0, a.query)], "query_id int, query string"), a.query)
    out = files.required(found.withColumnRenamed("doc_id", "id"), "id", "score").orderBy(F.desc("score"), "id").select("id", "score", "product_name", "content")
    out.show(truncate=False)
    return out.collect()


def sample_search(rows, queries, pattern: str):
    """Reviews in which a word of the query stands or which hold it anywhere."""
    index = lexical.build_index(rows, "review_id", lexical.standard_fields(["content", "product_name"]))
    words = lexical.match(index, queries, text.tokens(F.col("query")), {"content": 2.0, "product_name": 1.0})
    wild = [lexical.wildcard(rows, "review_id", F.col(c), f"*{pattern}*").withColumn("query_id", F.lit(0)) for c in ("content", "product_name")]
    return lexical.any_of([words, *wild]).join(rows.withColumnRenamed("review_id", "doc_id"), "doc_id")


def preview_command(spark, a):
    docs = documents.to_documents(files.first_rows(files.read_json(spark, a.input, files.REVIEW_SCHEMA), a.limit))
    shown = (enrich.enrich(docs) if a.llm else docs).toJSON().collect()
    print("\n".join(shown))
    return shown


COMMANDS = {"ingest": ingest_command, "evaluate": evaluate_command, "classify": classify_command, "sample": sample_command, "preview": preview_command}


def run(spark, argv: list[str]):
    args = parser().parse_args(argv)
    return COMMANDS[args.command](spark, args)


def main(argv: list[str] | None = None) -> None:
    import sys

    run(build_session("sorrel", None if "SPARK_MASTER" in os.environ else "local[*]"), sys.argv[1:] if argv is None else argv)


if __name__ == "__main__":
    main()
