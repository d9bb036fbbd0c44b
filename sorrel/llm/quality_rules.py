"""Quality rules combined by weak supervision (native).

Each rule votes good, votes bad or abstains. Expectation-maximisation over the counts of distinct vote patterns estimates,
for good and for bad documents, how often each rule's vote is right; the posterior probability that a document is good
then decides, instead of the demand that all rules pass. There are at most 3 ** rules patterns at any size of the corpus.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import exp, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, packed, word_array, written

#: Fixed values of the base rules: least words, and most per cent of words in repeated windows; words in a window.
LEAST_WORDS, MOST_REPEATED, WINDOW = 10, 20, 5
SYMBOLS = r"[#*$%&|<>]"
GOOD, BAD, ABSTAIN = 1, 0, -1
#: A document is kept at this posterior or more.
KEEP_AT = 0.5


def repeated_words(pairs: Column) -> Column:
    """Words in windows found twice or more, from the (hash, place) pairs of all windows in order.

    In that order equal windows stand together; of those, the places in order give the words covered, each window adding
    those beyond the one before. pairs must be a column, as it is looked up for every element.
    """
    same = F.filter(
        F.transform(pairs, lambda p, k: F.when((F.get(pairs, k - 1)["g"] == p["g"]) | (F.get(pairs, k + 1)["g"] == p["g"]), p["i"])),
        lambda i: i.isNotNull(),
    )
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last"))
    covered = F.aggregate(F.array_sort(same), start, lambda s, i: F.struct((s["n"] + F.least(i - s["last"], F.lit(WINDOW))).alias("n"), i.alias("last")))
    return covered["n"]


def text_stats(rows: DataFrame) -> DataFrame:
    """rows of (quality_row, text) as (quality_row, quality_stats); a row costs time in proportion to its text, and nothing is moved.

    Null texts have no words. Windows are compared by 64-bit hashes of their words.
    """
    body = F.coalesce(F.col("text"), F.lit(""))
    # What is left without lower-case letters, digits, white space and commas is short, and all counts of characters come from it.
    marks = F.regexp_replace(body, r"[\p{Ll}\p{Lo}\p{Nd}\x20\x09-\x0D,]+", "")
    lines = F.filter(F.split(body, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    step = rows.select("quality_row", word_array(F.col("text")).alias("q_words"), lines.alias("q_lines"), marks.alias("q_marks"))
    step = step.withColumn("q_hashes", F.transform("q_words", lambda w: F.xxhash64(w)))
    # A window's hash, from those of its first two words, first four words and last word: each step pairs an array with itself moved on.
    on = lambda column, by: F.slice(column, by + 1, F.size(column))
    pair = lambda a, b: F.xxhash64(a, b)
    step = step.withColumn("q_two", F.zip_with("q_hashes", on("q_hashes", 1), pair))
    step = step.withColumn("q_four", F.zip_with("q_two", on("q_two", 2), pair))
    windows = F.zip_with("q_four", on("q_hashes", WINDOW - 1), pair)
    step = step.withColumn("q_grams", F.slice(windows, 1, F.greatest(F.size("q_words") - (WINDOW - 1), F.lit(0))))
    # A text without a repeated window, as most are, is settled by a distinct count and sorts nothing.
    repeats = F.size(F.array_distinct("q_grams")) < F.size("q_grams")
    pairs = F.array_sort(F.transform("q_grams", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    step = step.withColumn("q_pairs", F.when(repeats, pairs))
    count = lambda kind: (F.length("q_marks") - F.length(F.regexp_replace("q_marks", kind, ""))).cast("long")
    stats = F.struct(
        F.size("q_words").cast("long").alias("n_words"),
        F.length(F.array_join("q_words", "")).cast("long").alias("word_chars"),
        count(SYMBOLS + "+").alias("n_symbols"),
        F.size("q_lines").cast("long").alias("n_lines"),
        (F.size("q_lines") - F.size(F.array_distinct("q_lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("q_pairs").isNull(), F.lit(0).cast("long")).otherwise(repeated_words(F.col("q_pairs"))).alias("n_repeat_words"),
        F.size(F.array_distinct("q_hashes")).cast("long").alias("n_distinct"),
        F.length("q_marks").cast("long").alias("n_marks"),
        count(r"\p{Lu}+").alias("n_upper"),
        count("[.?]+").alias("n_stops"),
        count("!+").alias("n_shouts"),
    )
    return step.select("quality_row", stats.alias("quality_stats"))


def base_failed(s: Column) -> Column:
    return (s["n_words"] < LEAST_WORDS) | (100 * s["n_repeat_words"] > MOST_REPEATED * s["n_words"])


def votes(s: Column) -> list[Column]:
    """The rules: each good, bad or abstaining, from the statistics of a text."""
    words = F.greatest(s["n_words"], F.lit(1))
    lines = F.greatest(s["n_lines"], F.lit(1))
    chars = F.greatest(s["word_chars"], F.lit(1))

    def rule(bad: Column, good: Column) -> Column:
        return F.when(bad, BAD).when(good, GOOD).otherwise(ABSTAIN)

    return [
        rule(s["n_symbols"] > 0.1 * words, s["n_symbols"] < 0.02 * words),
        rule(s["n_marks"] - s["n_upper"] > 0.1 * chars, s["n_marks"] - s["n_upper"] < 0.05 * chars),
        rule(s["n_symbols"] > 0.08 * chars, s["n_symbols"] < 0.01 * chars),
        rule(s["n_repeat_words"] > 0.1 * words, s["n_repeat_words"] < 0.03 * words),
        rule(s["n_dup_lines"] > 0.3 * lines, (s["n_dup_lines"] == 0) & (lines > 1)),
        rule((chars < 2.5 * words) | (chars > 15 * words), (chars > 3 * words) & (chars < 10 * words)),
        rule(words < 20, words > 50),
        rule(s["n_upper"] > 0.4 * chars, s["n_upper"] < 0.15 * chars),
        rule(s["n_shouts"] > 0.2 * words, s["n_shouts"] < 0.05 * words),
        rule((s["n_stops"] == 0) & (words > 50), (s["n_stops"] > 0.02 * words) & (s["n_stops"] < 0.4 * words)),
        rule((s["n_distinct"] < 0.1 * words) & (words > 50), s["n_distinct"] > 0.3 * words),
    ]


@dataclass(frozen=True)
class LabelModel:
    """Log odds of a good document, and for each rule those that a good and a bad vote add."""

    prior: float
    good: tuple[float, ...]
    bad: tuple[float, ...]

    def posterior(self, ballot: Column) -> Column:
        odds = F.lit(self.prior)
        for k, (g, b) in enumerate(zip(self.good, self.bad, strict=True)):
            vote = ballot[k]
            odds = odds + F.when(vote == GOOD, g).when(vote == BAD, b).otherwise(0.0)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-odds))


def fit_label_model(patterns: list[tuple[tuple[int, ...], int]], rules: int, rounds: int = 50) -> LabelModel:
    """Expectation-maximisation over (votes, count) patterns, started from the share of good votes.

    right[y][k] is how often rule k, if it votes on a document of class y, votes y. Each is smoothed by four made-up votes
    and kept over one half on the sum of both classes, so that a good vote never counts against a document.
    """
    prior, right = 0.5, [[0.8] * rules, [0.8] * rules]
    belief = [(sum(v == GOOD for v in p) + 1) / (sum(v != ABSTAIN for v in p) + 2) for p, _ in patterns]
    total = sum(n for _, n in patterns)
    for _ in range(rounds if total else 0):
        prior = min(max(sum(b * n for b, (_, n) in zip(belief, patterns, strict=True)) / total, 0.02), 0.98)
        for k in range(rules):
            hits, cast = [3.2, 3.2], [4.0, 4.0]
            for b, (p, n) in zip(belief, patterns, strict=True):
                for y, weight in ((BAD, (1 - b) * n), (GOOD, b * n)):
                    if p[k] != ABSTAIN:
                        cast[y] += weight
                        hits[y] += weight * (p[k] == y)
            right[BAD][k], right[GOOD][k] = (min(max(h / c, 0.02), 0.98) for h, c in zip(hits, cast, strict=True))
            if right[BAD][k] + right[GOOD][k] < 1:
                right[BAD][k] = 1 - right[GOOD][k]
        belief = []
        for p, _ in patterns:
            odds = log(prior / (1 - prior))
            for k, v in enumerate(p):
                if v == GOOD:
                    odds += log(right[GOOD][k] / (1 - right[BAD][k]))
                elif v == BAD:
                    odds += log((1 - right[GOOD][k]) / right[BAD][k])
            belief.append(1 / (1 + exp(-odds)))
    good = tuple(log(g / (1 - b)) for b, g in zip(*right, strict=True))
    bad = tuple(log((1 - g) / b) for b, g in zip(*right, strict=True))
    return LabelModel(log(prior / (1 - prior)), good, bad)


def with_votes(docs: DataFrame, keep: Column) -> DataFrame:
    """quality_row (a struct of what to keep of docs), quality_stats and quality_votes (one small integer for each rule)."""
    voted = text_stats(docs.select(keep.alias("quality_row"), F.col("text").alias("text")))
    return voted.withColumn("quality_votes", F.array(*votes(F.col("quality_stats"))).cast("array<tinyint>"))


def fit(voted: DataFrame) -> LabelModel:
    """Learn the label model from all rows; the driver gets one row for each pattern."""
    rules = len(votes(F.col("quality_stats")))
    counted = voted.groupBy("quality_votes").count().collect()
    return fit_label_model(sorted((tuple(r[0]), r[1]) for r in counted), rules)


def judge(voted: DataFrame, model: LabelModel) -> DataFrame:
    """voted with quality_posterior and quality_kept."""
    posterior = model.posterior(F.col("quality_votes"))
    kept = ~base_failed(F.col("quality_stats")) & (F.col("quality_posterior") >= KEEP_AT)
    return voted.withColumn("quality_posterior", posterior).withColumn("quality_kept", kept)


def quality_table(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, posterior.

    Null and blank texts have no words and fail the base rules; very long texts are counted whole. Ids may be null or
    repeated: each row is judged alone, so equal texts get equal verdicts, and a posterior of just KEEP_AT keeps. An empty
    table gives no rows. Only doc_id and text are read, so other columns can't clash.
    """
    voted = written(with_votes(docs, F.struct("doc_id")), "quality-votes")
    judged = judge(voted, fit(voted))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return judged.select(
        "quality_row.doc_id", *[F.col("quality_stats")[n].alias(n) for n in names], base_failed(F.col("quality_stats")).alias("base_failed"), F.col("quality_kept").alias("kept"), F.col("quality_posterior").alias("posterior")
    )


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs that are kept, with docs' columns as they are, whatever their names; see quality_table for odd rows."""
    voted = written(with_votes(docs, packed(docs, "quality_row")), "quality-docs")
    return judge(voted, fit(voted)).where("quality_kept").select("quality_row.*")
