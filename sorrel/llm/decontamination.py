"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are windows of WINDOW consecutive words of a benchmark item (an item of fewer words is one shorter pattern). For
patterns of one length m, a table by block of BLOCK words gives how far the search may jump; where that is 0, a bucket by
the block that ends the window holds the patterns to compare word by word. Each length is searched by itself, so a short
item doesn't shorten the jumps of the others. A benchmark is searched in blocks of bounded size, one after another: only one
is with the driver and the workers at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, packed, ship, written

WINDOW, BLOCK = 10, 3
#: Most bytes of benchmark text to broadcast at once.
BENCHMARK_BYTES = 16 << 20
#: Rows of a batch that are searched at a time.
SLICE = 256

#: Fixed rule: A-Z become a-z; digits, letters and all bytes beyond ASCII are word characters; the rest becomes a blank.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Maximal runs of word characters after lower-casing A-Z, in UTF-8; none for null."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


class WuManber:
    """Occurrences of word patterns, all of length m, in lists of words."""

    def __init__(self, patterns: dict[tuple[bytes, ...], list[str]], m: int):
        self.m, self.block = m, min(BLOCK, m)
        self.furthest = m - self.block + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.buckets: dict[tuple[bytes, ...], dict[tuple[bytes, ...], list[str]]] = {}
        for pattern, items in patterns.items():
            for end in range(self.block, m + 1):
                key = pattern[end - self.block : end]
                self.shift[key] = min(self.shift.get(key, self.furthest), m - end)
            self.buckets.setdefault(pattern[m - self.block :], {})[pattern] = items

    def search(self, words: list[bytes], hit: np.ndarray, items: set[str]) -> None:
        """Mark the words of every occurrence in hit and add the patterns' items to items."""
        m, block, furthest = self.m, self.block, self.furthest
        shift, buckets = self.shift.get, self.buckets
        end, last = m, len(words)
        while end <= last:
            key = tuple(words[end - block : end])
            by = shift(key, furthest)
            if by:
                end += by
                continue
            window = tuple(words[end - m : end])
            found = buckets[key].get(window)
            if found is not None:
                hit[end - m : end] = True
                items.update(found)
            end += 1


def searchers(rows: list[tuple[str, str | None]]) -> list[WuManber]:
    """One searcher for each pattern length among the (item id, text) rows. Items without a word have no pattern."""
    by_length: dict[int, dict[tuple[bytes, ...], list[str]]] = {}
    for item, text in rows:
        words = words_of(text)
        m = min(WINDOW, len(words))
        for k in range(len(words) - m + 1 if m else 0):
            by_length.setdefault(m, {}).setdefault(tuple(words[k : k + m]), []).append(item)
    return [WuManber(p, m) for m, p in sorted(by_length.items())]


def benchmark_blocks(benchmark: DataFrame, most_bytes: int = BENCHMARK_BYTES) -> list[DataFrame]:
    """Tables of (item, text) that make up the benchmark, of about most_bytes of text each. Equal rows count once; an item without an id counts under the empty id.

    A block holds an item whole, so its bound is most_bytes or the longest item, whichever is more.
    """
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // most_bytes))
    return [rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k) for k in range(blocks)]


def find_contamination(docs: DataFrame, benchmark: DataFrame, keep: list[Column], most_bytes: int = BENCHMARK_BYTES) -> DataFrame:
    """keep's columns and n_words, n_hit, n_items, items_sha256, contaminated for each row of docs.

    Each block of the benchmark is a step over the documents that adds to the marked words (as bits) and the found items.
    What a step but the last returns is written, so that a plan never holds two blocks; no row is shuffled.
    """
    kept = docs.select(F.struct(*keep).alias("bench_keep"), F.col("text").alias("bench_text"), F.lit(None).cast("binary").alias("bench_hit"), F.lit(None).cast("array<string>").alias("bench_items"))
    context = docs.sparkSession.sparkContext
    marked_schema = kept.schema
    told_schema = kept.select("bench_keep").schema
    for name, kind in (("n_words", "long"), ("n_hit", "long"), ("n_items", "long"), ("items_sha256", "string"), ("contaminated", "boolean")):
        told_schema = told_schema.add(name, kind)

    def step(shared, last: bool):
        def search(machines: list[WuManber], text: str | None, hit: bytes | None, items: list[str] | None) -> tuple[np.ndarray, list[str]]:
            words, found = words_of(text), set(items or ())
            marks = np.zeros(len(words), bool) if hit is None else np.unpackbits(np.frombuffer(hit, np.uint8), count=len(words)).astype(bool)
            for machine in machines:
                machine.search(words, marks, found)
            return marks, sorted(found)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            machines = searchers(shared.value)
            for whole in batches:
                for low in range(0, whole.num_rows, SLICE):
                    batch = whole.slice(low, SLICE)
                    done = [search(machines, *(v.as_py() for v in row)) for row in zip(*(batch.column(c) for c in ("bench_text", "bench_hit", "bench_items")), strict=True)]
                    found = [f for _, f in done]
                    if not last:
                        hits = pa.array([np.packbits(m).tobytes() for m, _ in done], pa.binary())
                        yield pa.RecordBatch.from_arrays([batch.column("bench_keep"), batch.column("bench_text"), hits, pa.array(found, pa.list_(pa.string()))], marked_schema.names)
                        continue
                    n_hit = [int(m.sum()) for m, _ in done]
                    sums = [hashlib.sha256(",".join(f).encode()).hexdigest() for f in found]
                    out = [pa.array([len(m) for m, _ in done], pa.int64()), pa.array(n_hit, pa.int64()), pa.array([len(f) for f in found], pa.int64()), pa.array(sums, pa.string()), pa.array([n > 0 for n in n_hit], pa.bool_())]
                    yield pa.RecordBatch.from_arrays([batch.column("bench_keep"), *out], told_schema.names)

        return run

    *others, final = benchmark_blocks(benchmark, most_bytes)
    for block in others:
        shared = context.broadcast([tuple(r) for r in block.collect()])
        before, kept = kept, written(kept.mapInArrow(step(shared, False), marked_schema), "bench-step")
        forget(before)
        shared.destroy()
    told = kept.mapInArrow(step(context.broadcast([tuple(r) for r in final.collect()]), True), told_schema)
    return told.select("bench_keep.*", *told_schema.names[1:])


def contamination_table(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    Null and wordless texts have no words and no hits; items_sha256 is then that of the empty string. Items that repeat
    an id count once; a document row that repeats is judged again; of windows that overlap, a word counts once. Very long
    texts are searched whole, in slices of SLICE rows of a batch. An empty benchmark finds nothing, an empty table gives no
    rows. Only doc_id, item_id and text are read, so other columns can't clash.
    """
    return find_contamination(docs, benchmark, [F.col("doc_id")])


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that hold no window of the benchmark, with docs' columns as they are, whatever their names.

    Null and wordless texts stay; see contamination_table for other odd rows.
    """
    return find_contamination(docs, benchmark, [packed(docs, "bench_row")]).where(~F.col("contaminated")).select("bench_row.*")


ship(__name__)
