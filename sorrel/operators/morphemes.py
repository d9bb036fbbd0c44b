"""A morphological analyzer for Hangul whose dictionary is learned from texts.

No dictionary of a language is given. Words (runs of Hangul) are counted; every beginning and every end of a word is a part.
A part holds together if its letters rarely stand apart (cohesion: how probable the part is after its outermost letter, by
letter), and it ends where many different letters may follow (branching entropy; a word's edge counts as a letter). Parts
that stand alone, or that branch, are units, and a unit's cost is minus the logarithm of its share of all words.

A word is cut along the cheapest path through the lattice of its units; letters that no unit covers form unknown units at a
cost above that of any unit. Learning is a matter of counts and joins; cutting goes over Arrow batches with the dictionary
broadcast, whose size is bounded by the share that a unit must have.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sorrel.scratch import ship

HANGUL = "[가-힣]+"
#: Occurrences of a unit, its most letters, and the share of all words that it must exceed: 1 in MOST, so there are fewer than 2 x LONGEST x MOST units.
LEAST, LONGEST, MOST = 2, 8, 100_000
#: Branching entropy from which a part is a unit, costs of an unknown letter beyond that of the rarest unit, and the scale of costs.
BRANCHING, UNKNOWN, SCALE = 0.5, 2.0, 1000
#: Words whose paths a worker remembers, and their most letters.
MEMO, MEMO_LETTERS = 200_000, 32


def word_counts(texts: DataFrame, column: Column, pattern: str = HANGUL) -> DataFrame:
    """(word, n) of the words of a text column."""
    words = texts.select(F.explode(F.regexp_extract_all(F.coalesce(column, F.lit("")), F.lit(pattern), F.lit(0))).alias("word"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def part_statistics(words: DataFrame, least: int = LEAST, longest: int = LONGEST) -> DataFrame:
    """(side, part, n, branches, entropy, cohesion, alone) of every beginning (left) and end (right) of words, up to longest letters.

    branches counts the different letters beyond the part, a word's edge among them; alone counts the words that are the part.
    A single letter has cohesion 1.
    """
    word, k, size = F.col("word"), F.col("k"), F.length("word")
    cut = words.select("word", "n", F.explode(F.sequence(F.lit(1), F.least(size, F.lit(longest)))).alias("k"))
    left = F.struct(F.lit("left").alias("side"), F.substring(word, F.lit(1), k).alias("part"), F.substring(word, k + 1, F.lit(1)).alias("beyond"))
    right = F.struct(F.lit("right").alias("side"), F.substring(word, size - k + 1, k).alias("part"), F.when(k < size, F.substring(word, size - k, F.lit(1))).otherwise("").alias("beyond"))
    each = cut.select("n", F.explode(F.array(left, right)).alias("p")).select("p.*", "n")
    beyond = each.groupBy("side", "part", "beyond").agg(F.sum("n").alias("n"))
    n = F.col("n")
    parts = beyond.groupBy("side", "part").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("branches"), F.sum(n * F.log(n.cast("double"))).alias("inner"), F.sum(F.when(F.col("beyond") == "", n).otherwise(0)).alias("alone"))
    parts = parts.where(n >= least).withColumn("entropy", F.log(n.cast("double")) - F.col("inner") / n).drop("inner")
    outer = F.when(F.col("side") == "left", F.substring("part", 1, 1)).otherwise(F.substring("part", -1, 1))
    edges = parts.where(F.length("part") == 1).select("side", F.col("part").alias("outer"), F.col("n").alias("n_outer"))
    known = parts.withColumn("outer", outer).join(edges, ["side", "outer"])
    held = F.when(F.length("part") == 1, F.lit(1.0)).otherwise(F.pow(n / F.col("n_outer"), 1 / (F.length("part") - 1)))
    return known.select("side", "part", "n", "branches", "entropy", held.alias("cohesion"), "alone")


def learn_units(words: DataFrame, least: int = LEAST, longest: int = LONGEST, most: int = MOST, branching: float = BRANCHING) -> DataFrame:
    """(unit, cost): parts that stand alone or branch, with SCALE times minus the logarithm of their share, weighed by cohesion; the cheaper side counts.

    A single letter is a unit only where it stands alone or, as an ending, branches.
    """
    total = words.agg(F.sum("n").alias("total"))
    parts = part_statistics(words, least, longest).join(F.broadcast(total))  # one row
    branches = (F.col("entropy") >= branching) & ((F.length("part") > 1) | (F.col("side") == "right"))
    units = parts.where(((F.col("alone") > 0) | branches) & (F.col("n") * most > F.col("total")))
    cost = F.floor(SCALE * (F.log(F.col("total").cast("double")) - F.log(F.col("n") * F.col("cohesion"))) + 0.5).cast("long")
    return units.groupBy(F.col("part").alias("unit")).agg(F.min(cost).alias("cost"))


class Lattice:
    """Cuts words along cheapest paths: the fewest units of equals, then the longest first unit."""

    def __init__(self, costs: dict[str, int]):
        self.costs = costs
        self.longest = max(map(len, costs), default=0)
        self.unknown = max(costs.values(), default=0) + int(UNKNOWN * SCALE)
        self.memo: dict[str, list[str]] = {}

    def path(self, word: str) -> tuple[int, list[int]]:
        """The cost of the cheapest path and the lengths of its steps, unknown letters one by one."""
        n, costs = len(word), self.costs
        best: list[tuple[int, int, int]] = [(0, 0, 0)] * (n + 1)
        for i in range(n - 1, -1, -1):
            cost, steps, _ = best[i + 1]
            found = (self.unknown + cost, steps + 1, -1)
            for length in range(1, min(self.longest, n - i) + 1):
                if (own := costs.get(word[i : i + length])) is not None:
                    cost, steps, _ = best[i + length]
                    found = min(found, (own + cost, steps + 1, -length))
            best[i] = found
        lengths, at = [], 0
        while at < n:
            lengths.append(-best[at][2])
            at += lengths[-1]
        return best[0][0], lengths

    def cut(self, word: str) -> list[str]:
        """The word's units; neighbouring letters that aren't units are one."""
        if (known := self.memo.get(word)) is not None:
            return known
        units, at, open_ = [], 0, False
        for length in self.path(word)[1]:
            unit = word[at : at + length]
            unknown = unit not in self.costs
            if unknown and open_:
                units[-1] += unit
            else:
                units.append(unit)
            open_, at = unknown, at + length
        if len(word) <= MEMO_LETTERS:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            self.memo[word] = units
        return units


def dictionary(units: DataFrame) -> dict[str, int]:
    """The learned units on the driver, for broadcast: learn_units() bounds how many there are."""
    found = units.select("unit", "cost").toArrow()
    return dict(zip(found.column("unit").to_pylist(), found.column("cost").to_pylist(), strict=True))


def analyzer(units: DataFrame, pattern: str = HANGUL, others: bool = True) -> Callable[[Column], Column]:
    """A tokenizer: the units of every word that fits the pattern and, with others, the other runs of letters and digits as they are."""
    shared = units.sparkSession.sparkContext.broadcast(dictionary(units))
    whole = rf"{pattern}|(?:(?!{pattern.rstrip('+')})[^\W_])+" if others else pattern

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        lattice, runs, is_word = Lattice(shared.value), re.compile(whole).findall, re.compile(pattern).match
        for texts in batches:
            out = []
            for value in texts:
                tokens: list[str] = []
                for token in runs(value.as_py() or ""):
                    if is_word(token):
                        tokens.extend(lattice.cut(token))
                    else:
                        tokens.append(token)
                out.append(tokens)
            yield pa.array(out, pa.list_(pa.string()))

    return F.arrow_udf(run, "array<string>")


def hangul_words(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(HANGUL), F.lit(0))


ship(__name__)
