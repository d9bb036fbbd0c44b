"""Minimax contiguous partition of a corpus into shards of near-equal bytes (native).

Documents with equal texts form one atomic group. Groups are ordered by a hash of the text, and the smallest feasible
shard capacity is found by binary search with a greedy check over that order. No list of groups is ever gathered: the
driver holds sums over hash prefixes (a few thousand), and only those prefixes in which a cut may fall are looked at more
finely, until a packing of whole prefixes reaches the bound that even divisible prefixes could not beat.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import packed, written

ROW_OVERHEAD = 8
#: Hex digits of the text hash in the first summary and in each finer one; a group is known by KEY_DIGITS of them. Two texts
#: of one hash (at 10^10 different texts some forty pairs) count as one group, which keeps equal texts together all the same.
FIRST_DIGITS, MORE_DIGITS, KEY_DIGITS = 3, 2, 15
#: Parts of a shard that are numbered in parallel.
SLOT_PARTS = 2048


def document_size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_OVERHEAD).cast("long")


def group_key(text: Column) -> Column:
    """60 bits of the text's hash as a whole number. Null counts as the empty text."""
    return F.shiftrightunsigned(F.xxhash64(F.coalesce(text, F.lit(""))), 4)


def key_digits(gkey: Column, digits: int) -> Column:
    """The first hex digits of a group's key, as a whole number."""
    return F.shiftright(gkey, 4 * (KEY_DIGITS - digits))


@dataclass(frozen=True)
class Span:
    """All groups whose keys start with prefix: their bytes, first and last key."""

    prefix: str
    total: int
    first: str
    last: str

    @property
    def atomic(self) -> bool:
        return self.first == self.last


class Packing:
    """Greedy packing of ordered spans, either as whole spans (cut) or with non-atomic spans divisible (bound)."""

    def __init__(self, spans: list[Span], shards: int):
        self.spans, self.shards, self.ends = spans, shards, [0]
        for s in spans:
            self.ends.append(self.ends[-1] + s.total)
        self.all = self.ends[-1]

    def cuts(self, capacity: int) -> list[int] | None:
        """Index of the first span of each shard after the first, if whole spans fit."""
        found, at = [], 0
        for _ in range(self.shards):
            to = bisect_right(self.ends, self.ends[at] + capacity) - 1
            if to == len(self.spans):
                return found
            if to == at:
                return None
            found.append(to)
            at = to
        return None

    def fluid(self, capacity: int) -> list[int] | None:
        """Where cuts would fall, in bytes, if non-atomic spans could be cut anywhere; None if even that doesn't fit."""
        found, at = [], 0
        for _ in range(self.shards):
            to = at + capacity
            if to >= self.all:
                return found
            k = bisect_right(self.ends, to) - 1
            if self.spans[k].atomic:
                to = self.ends[k]
            if to <= at:
                return None
            found.append(to)
            at = to
        return None

    def least(self, fits) -> int:
        low, high = -(-self.all // self.shards), self.all
        while low < high:
            mid = (low + high) // 2
            low, high = (low, mid) if fits(mid) is not None else (mid + 1, high)
        return low

    def unsure(self, low: int, high: int) -> set[str]:
        """Prefixes in which a cut may fall for a capacity from low to high."""
        a, b = self.fluid(low) or [], self.fluid(high) or []
        found = set()
        for i, x in enumerate(a):
            y = b[i] if i < len(b) else self.all
            for k in range(bisect_right(self.ends, min(x, y)) - 1, min(bisect_left(self.ends, max(x, y)) + 1, len(self.spans))):
                if not self.spans[k].atomic:
                    found.add(self.spans[k].prefix)
        return found


def minimax(spans: list[Span], shards: int, finer) -> tuple[list[str], list[str], int]:
    """(keys of groups that fill a shard alone, first key of each later shard of the rest, capacity of the rest).

    A group larger than an even share of what is left gets a shard of its own, largest first; else it would set a capacity
    at which the greedy check fills a few shards and leaves others empty. finer(prefixes) returns the finer spans of them.
    """

    def look_closer(prefixes: set[str]) -> None:
        nonlocal spans
        spans = sorted([s for s in spans if s.prefix not in prefixes] + finer(prefixes), key=lambda s: s.prefix)

    alone: list[str] = []
    while spans:
        left = sum(s.total for s in spans)
        parts = shards - len(alone)
        big = max(spans, key=lambda s: (s.total, s.prefix))
        if parts > 1 and big.total * parts > left and (len(spans) > 1 or not big.atomic):
            if big.atomic:
                alone.append(big.first)
                spans = [s for s in spans if s is not big]
            else:
                look_closer({s.prefix for s in spans if not s.atomic and s.total * parts > left})
            continue
        packing = Packing(spans, parts)
        low, high = packing.least(packing.fluid), packing.least(packing.cuts)
        if low == high or not (unsure := packing.unsure(low, high)):
            return alone, [spans[k].first for k in packing.cuts(high)], high
        look_closer(unsure)
    return alone, [], 0


def spans_of(groups: DataFrame, digits: int) -> list[Span]:
    summed = groups.groupBy(key_digits(F.col("gkey"), digits).alias("prefix")).agg(F.sum("size").alias("total"), F.min("gkey").alias("first"), F.max("gkey").alias("last"))
    hex_of = lambda value, length: f"{value:0{length}x}"
    return sorted((Span(hex_of(p, digits), total, hex_of(a, KEY_DIGITS), hex_of(b, KEY_DIGITS)) for p, total, a, b in summed.collect()), key=lambda s: s.prefix)


def plan_shards(groups: DataFrame, shards: int) -> tuple[list[str], list[str], int]:
    """minimax() over a table of (gkey, size) rows."""

    def finer(prefixes: set[str]) -> list[Span]:
        found: list[Span] = []
        for length in sorted({len(p) for p in prefixes}):
            some = sorted(p for p in prefixes if len(p) == length)
            found += spans_of(groups.where(key_digits(F.col("gkey"), length).isin([int(p, 16) for p in some])), min(length + MORE_DIGITS, KEY_DIGITS))
        return found

    return minimax(spans_of(groups, FIRST_DIGITS), shards, finer)


def shard_of(gkey: Column, alone: list[str], firsts: list[str]) -> Column:
    """The shard of a group, by comparison with at most as many literals as there are shards."""
    shard = F.lit(len(alone))
    for first in firsts:
        shard = shard + (gkey >= int(first, 16)).cast("int")
    for k, key in reversed(list(enumerate(alone))):
        shard = F.when(gkey == int(key, 16), k).otherwise(shard)
    return shard.cast("int")


def add_slots(rows: DataFrame, parts: int = SLOT_PARTS) -> DataFrame:
    """Number the rows of each shard from 0 without gaps.

    A shard is numbered in parts (by a hash of the row), each in its own window; an offset for each part comes from the
    parts' counts. There are at most shards x parts counts, so they can be broadcast at any size of the corpus.
    """
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("doc_id", "gkey"), F.lit(parts)).cast("int"))
    counts = dealt.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    number = F.row_number().over(Window.partitionBy("shard", "part").orderBy("gkey", "doc_id"))
    numbered = dealt.withColumn("slot", number.cast("long") - 1)
    return numbered.join(F.broadcast(offsets), ["shard", "part"]).withColumn("slot", F.col("slot") + F.col("offset")).drop("part", "offset")


def assign_shards(docs: DataFrame, shards: int = 24) -> DataFrame:
    """docs with two more columns: size (UTF-8 bytes plus 8) and shard, from 0 to shards - 1. Reads docs twice, moves none.

    Equal texts share a shard; null counts as the empty text. Fewer groups than shards leave shards empty; an empty table
    gives no rows. Repeated rows each count, and a very long text is one group. docs' columns pass through unchanged;
    where one is named size or shard, the new column is called shard_size or shard_number.
    """
    groups = written(docs.select(document_size(F.col("text")).alias("size"), group_key(F.col("text")).alias("gkey")), "shard-groups")
    alone, firsts, _ = plan_shards(groups, shards)
    size, shard = (other if name in {c.lower() for c in docs.columns} else name for name, other in (("size", "shard_size"), ("shard", "shard_number")))
    placed = docs.select(packed(docs, "shard_row"), document_size(F.col("text")).alias("size"), group_key(F.col("text")).alias("gkey"))
    return placed.select("shard_row.*", F.col("size").alias(size), shard_of(F.col("gkey"), alone, firsts).alias(shard))


def shard_table(docs: DataFrame, shards: int = 24) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard, under the law of near-equal bytes.

    Null texts count as empty; null ids are kept. Rows of equal id and text are numbered in any order, as they can't be
    told apart. grown_shard is null: under this law a further shard moves rows between all shards. An empty table gives no
    rows. Only doc_id and text are read, so other columns can't clash.
    """
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = written(docs.select("doc_id", document_size(F.col("text")).alias("size"), F.crc32(text).alias("text_crc32"), group_key(F.col("text")).alias("gkey")), "shard-rows")
    alone, firsts, _ = plan_shards(rows, shards)
    placed = add_slots(rows.withColumn("shard", shard_of(F.col("gkey"), alone, firsts)))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
