"""Spelling variant grouping by a symmetric-delete join.

Every word emits itself and its distinct single deletions as keys. Words that share a key are joined, and a pair is near if
one word is the key (the other has one code point more), or if both lost a code point at the same place: deletions of a run
of equal code points are one key with the run's bounds, and two words differ by one replacement exactly where their runs
overlap. Every near pair shares just one such key. Near words are aggregated into each word's form, and forms are followed to
their roots by joins that double their reach each round.

Keys longer than LONG code points are named by two fingerprints, taken from sums over the word's beginning and end, so that
a word of any length has keys as long as itself in all; pairs that meet in such a key are compared in full.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import forget, ship, written

#: Code points of a word, its occurrences, times that a form is more frequent, and the divisor of hashes that damage a run.
SHORTEST, LEAST, TIMES, DAMAGED = 7, 2, 10, 31
#: Different words that a task counts before it passes them on; code points of keys that stand for themselves.
MEMO, LONG = 500_000, 48
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Fixed pattern: letters A to Z of both cases and U+00C0 to U+00FF; shorter runs can't become words.
_RUNS = re.compile(f"[A-Za-zÀ-ÿ]{{{SHORTEST},}}").findall
_PRIMES, _BASES = ((1 << 61) - 1, (1 << 89) - 1), (0x1B873593A5C3F1, 0x2545F4914F6CDD1D)


def words_of(doc_id: str, raw: bytes, damage: int = DAMAGED) -> Iterator[tuple[str, int]]:
    """(word, times) of a text in UTF-8: its long runs, lower-cased in A-Z, of which those with a hash that damage divides lose a code point."""
    ahead = crc32(f"{doc_id}:".encode("utf-8", "surrogatepass"))
    for run, times in Counter(_RUNS(raw.translate(_LOWER).decode("utf-8", "replace"))).items():
        h = crc32(run.encode(), ahead)
        if h % damage == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
            if len(run) < SHORTEST:
                continue
        yield run, times


def word_table(docs: DataFrame, least: int = LEAST, damage: int = DAMAGED) -> DataFrame:
    """(id, word, n), written: the words of docs' texts with their occurrences. Ids follow the words' order by code points."""

    def batch_of(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "times"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()), strict=True):
                if raw := text.as_py():
                    for word, times in words_of(doc_id, raw, damage):
                        counts[word] += times
                    if len(counts) >= MEMO:
                        yield batch_of(counts)
                        counts = Counter()
        yield batch_of(counts)

    texts = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), "text")
    counted = texts.mapInArrow(count, "word string, times long").groupBy("word").agg(F.sum("times").alias("n")).where(F.col("n") >= least)
    counted = written(counted, "counted-words")
    ordered = written(counted.repartitionByRange("word").sortWithinPartitions("word").withColumn("id", F.monotonically_increasing_id()), "words")
    forget(counted)
    return ordered


def fingerprints(word: str, starts: list[int]) -> list[str]:
    """The key of the word without the code point at each of starts, or of the word itself for -1, from running sums.

    A word's sum is that of its code points, each times a power of the base by its place from the end; a deletion's follows
    from the sums of what stands before and behind it.
    """
    parts = []
    for prime, base in zip(_PRIMES, _BASES, strict=True):
        ahead, behind, power = [0], [0], [1]
        for c in word:
            ahead.append((ahead[-1] * base + ord(c)) % prime)
            power.append(power[-1] * base % prime)
        for k, c in enumerate(reversed(word)):
            behind.append((behind[-1] + ord(c) * power[k]) % prime)
        n = len(word)
        parts.append([ahead[n] if i < 0 else (ahead[i] * power[n - 1 - i] + behind[n - 1 - i]) % prime for i in starts])
    return [f"#{len(word) - (i >= 0)}:{a:x}:{b:x}" for i, a, b in zip(starts, *parts, strict=True)]


def keys_of(word: str, long: int = LONG) -> Iterator[tuple[str, int, int]]:
    """(key, low, high): the word itself with low -1, and a row for each run of equal code points with the run's bounds."""
    n, runs, low = len(word), [], 0
    for k in range(1, n + 1):
        if k == n or word[k] != word[low]:
            runs.append((low, k - 1))
            low = k
    if n > long:
        starts = [-1, *[a for a, _ in runs if n - 1 > long]]
        prints = fingerprints(word, starts)
        yield prints[0], -1, -1
        deleted = prints[1:]
    else:
        yield word, -1, -1
        deleted = []
    for j, (a, b) in enumerate(runs):
        yield deleted[j] if deleted else word[:a] + word[a + 1 :], a, b


def deletion_keys(words: DataFrame, long: int = LONG) -> DataFrame:
    """(key, low, high, id, n) for every key of every word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for i, word, n in zip(*[batch.column(c).to_pylist() for c in ("id", "word", "n")], strict=True):
                for key, low, high in keys_of(word, long):
                    out.append((key, low, high, i, n))
                    if len(out) >= 1 << 16:
                        yield rows(out)
                        out = []
            if out:
                yield rows(out)

    def rows(out: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["key", "low", "high", "id", "n"])

    return words.select("id", "word", "n").mapInArrow(run, "key string, low int, high int, id long, n long")


def near_pairs(words: DataFrame, long: int = LONG) -> DataFrame:
    """(id, near_id, near_n): both directions of every pair of words that differ by one inserted, deleted or replaced code point."""
    keyed = written(deletion_keys(words, long), "deletion-keys")
    other = keyed.select("key", F.col("low").alias("near_low"), F.col("high").alias("near_high"), F.col("id").alias("near_id"), F.col("n").alias("near_n"))
    either = (F.col("low") < 0) | (F.col("near_low") < 0)
    same_place = (F.col("low") <= F.col("near_high")) & (F.col("near_low") <= F.col("high"))
    met = keyed.join(other, "key").where((F.col("id") != F.col("near_id")) & (either | same_place))
    hashed = F.startswith(F.col("key"), F.lit("#"))
    sure = met.where(~hashed).select("id", "near_id", "near_n")
    spelled = lambda name, i: words.select(F.col("id").alias(i), F.col("word").alias(name))
    both = met.where(hashed).join(spelled("a", "id"), "id").join(spelled("b", "near_id"), "near_id")
    cut = lambda w, low: F.when(F.col(low) < 0, F.col(w)).otherwise(F.concat(F.substring(w, F.lit(1), F.col(low)), F.substring(w, F.col(low) + 2, F.length(w))))
    compared = both.where(cut("a", "low") == cut("b", "near_low")).select("id", "near_id", "near_n")
    return sure.unionByName(compared)


def roots(forms: DataFrame) -> DataFrame:
    """(id, root) of (id, form_id): where the chain of forms ends. Forms grow more frequent by a factor, so chains are short; each round, written, doubles their reach."""
    state = written(forms.select("id", F.col("form_id").alias("root")), "roots")
    while True:
        ahead = state.select(F.col("id").alias("root"), F.col("root").alias("next"))
        moved, before = written(state.join(ahead, "root", "left").select("id", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots"), state
        forget(before)
        state = moved.select("id", "root")
        state.scratch_folder = moved.scratch_folder
        if not moved.where("moved").take(1):
            return state


def variants(docs: DataFrame, least: int = LEAST, times: int = TIMES, damage: int = DAMAGED, long: int = LONG) -> DataFrame:
    """(word, n, form, form_n, root, n_near) of every word of docs' texts.

    times: a word's form is its most frequent near word (the first by code points of equals), if that is so many times as frequent.
    """
    words = word_table(docs, least, damage)
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near_id").alias("id")))
    near = written(near_pairs(words, long).groupBy("id").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best")), "near-words")
    known = words.join(near, "id", "left").withColumn("best_n", -F.col("best.less").cast("decimal(20,0)"))
    is_form = F.col("best_n") >= F.lit(times) * F.col("n").cast("decimal(20,0)")
    rows = known.select("id", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("best.id")).alias("form_id"), F.when(is_form, F.col("best_n").cast("long")).alias("form_n"))
    rows = written(rows, "word-forms")
    forget(near)
    ends = roots(rows.where("form_id IS NOT NULL"))
    spelled = lambda i, name: words.select(F.col("id").alias(i), F.col("word").alias(name))
    whole = rows.join(ends.withColumnRenamed("root", "root_id"), "id", "left").join(spelled("form_id", "form"), "form_id", "left").join(spelled("root_id", "root"), "root_id", "left")
    return whole.select("word", "n", "form", "form_n", F.coalesce("root", "word").alias("root"), "n_near")


def variant_table(docs: DataFrame) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n.

    Null and empty texts have no words; very long texts and runs count whole; a null id counts as the empty one; rows that
    repeat count each. Words without a near word have n_near 0, no form and themselves as root. An empty table gives no
    rows. Only doc_id and text are read, so other columns can't clash.
    """
    return variants(docs).select("word", "form", "root", "n", "n_near", "form_n")


ship(__name__)
