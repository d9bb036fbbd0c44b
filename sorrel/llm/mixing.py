"""Mixing sources to target weights by weighted fair queueing (native).

Each source's documents are shuffled by a hash and may be taken up to three times. A copy's virtual finish time is the
number of its source's words up to and including it, divided by the source's weight. All copies are range-sorted by that
time, their words are summed in that order, and the order is cut where the total budget is used up: each source then has
words in proportion to its weight, and a source that has no copies left passes its share on to the others, by weight.

Finish times are kept as whole numbers (words times the least common multiple of the weights, over the weight), so sorting
them is exact.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import lcm

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, packed, word_count, written

#: Weights of the sources in code-point order, repeating; how often a source may be used up.
WEIGHTS = (5, 2, 1)
MOST_PASSES = 3
#: Hex digits of the shuffle key that part a source, so that no task numbers a whole source.
PART_DIGITS = 3


def shuffle_key(doc_id: Column, text: Column) -> Column:
    return F.md5(F.concat_ws(":", doc_id.cast("string"), F.md5(F.coalesce(text, F.lit("")).cast("binary"))).cast("binary"))


def source_key(source: Column) -> Column:
    """A key for every source: named ones in code-point order, null after them."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(">"))


def numbered_sources(sizes: DataFrame) -> DataFrame:
    """sizes (known, source_size) with rank, from 0 in order of known: numbered in ranges, whose counts give the offsets."""
    ranged = written(sizes.repartitionByRange("known").withColumn("range", F.spark_partition_id()), "mix-sources")
    counts = ranged.groupBy("range").agg(F.count(F.lit(1)).alias("n"), F.min("known").alias("first"))
    ahead = Window.orderBy("first").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range, not each source
    offsets = counts.select("range", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("offset"))
    nth = F.row_number().over(Window.partitionBy("range").orderBy("known")) - 1
    return ranged.withColumn("nth", nth).join(F.broadcast(offsets), "range").select("known", "source_size", (F.col("nth") + F.col("offset")).alias("rank"))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, passes: int = MOST_PASSES) -> DataFrame:
    """sizes (known, source_size) with weight and target.

    The budget is shared by weight; sources whose share is above passes times their size get that much, and the rest is
    shared anew among the others, until none is above. A round is one sum over the sources; the driver gets two numbers.
    """
    cycle = F.array(*[F.lit(w) for w in weights])
    limit = (F.lit(passes) * F.col("source_size")).cast("double")
    weight = F.element_at(cycle, (F.col("rank") % len(weights) + 1).cast("int")).cast("long")
    weighed = written(numbered_sources(sizes).select("known", "source_size", weight.alias("weight"), limit.alias("limit")), "mix-weights")
    budget = weighed.agg(F.sum("source_size")).first()[0] or 0
    level, dry = 0.0, -1
    while True:
        over = F.col("limit") < F.col("weight") * F.lit(level)
        used, open_weight, n = weighed.agg(F.sum(F.when(over, F.col("limit"))), F.sum(F.when(~over, F.col("weight"))), F.sum(over.cast("long"))).first()
        if n == dry or not open_weight:
            break
        dry, level = n, (budget - (used or 0.0)) / open_weight
    return weighed.select("known", "source_size", "weight", F.least(F.col("weight") * F.lit(level), F.col("limit")).alias("target"))


def sized(docs: DataFrame, *keep: Column) -> DataFrame:
    """keep's columns and known, size, key, tie for each row of docs. Reads doc_id, source, text; tie tells rows of one key apart."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in ("text", "source")]
    tie = F.xxhash64(F.to_json(F.struct(*rest))) if keep and rest else F.lit(0).cast("long")
    own = [source_key(F.col("source")).alias("known"), word_count(F.col("text")).alias("size"), shuffle_key(F.col("doc_id"), F.col("text")).alias("key"), tie.alias("tie")]
    return docs.select(*keep, *own).withColumn("part", F.substring("key", 1, PART_DIGITS))


@dataclass(frozen=True)
class Schedule:
    """parts: (known, part, offset, source_size, weight, target); unit: whole finish times by word and unit of weight; the
    last copy sent is the one at (time, known) = (stop, last)."""

    parts: DataFrame
    unit: int
    stop: int
    last: str


def queued(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """sized() rows with source_size, weight, target and before: words of the source ahead of the row in a pass.

    Running sums are taken in parts of a source and offset by sums of whole parts, so a source with a third of all rows
    is spread over 16 ** PART_DIGITS tasks.
    """
    within = Window.partitionBy("known", "part").orderBy("key", "tie", "size").rowsBetween(Window.unboundedPreceding, -1)
    summed = rows.withColumn("within", F.coalesce(F.sum("size").over(within), F.lit(0)))
    return summed.join(parts, ["known", "part"]).withColumn("before", F.col("offset") + F.col("within")).drop("within", "offset", "part", "key", "tie")


def finish(k: Column, unit: int) -> Column:
    """The virtual finish time of a queued() row's copy in pass k, in whole units."""
    return ((k * F.col("source_size") + F.col("before") + F.col("size")) * (F.lit(unit) / F.col("weight")).cast("long")).cast("long")


def cut(queue: DataFrame, unit: int, passes: int, budget: int) -> tuple[int, str]:
    """(time, known) of the last copy sent: copies in order of finish time, until the budget is used up.

    Copies are range-sorted and written as ranges. Sums of whole ranges tell in which one the budget ends, and only that
    one is summed row by row. The copy on which it ends is sent if half of it or more fits.
    """
    copies = queue.where("size > 0").select("known", "size", "source_size", "weight", "before", F.explode(F.sequence(F.lit(0), F.lit(passes - 1))).alias("k"))
    timed = copies.select(finish(F.col("k"), unit).alias("time"), "known", "size").repartitionByRange("time", "known")
    sorted_copies = written(timed.sortWithinPartitions("time", "known").withColumn("range", F.spark_partition_id()), "mix-order")
    sums = sorted_copies.groupBy("range").agg(F.sum("size").alias("words"), F.min(F.struct("time", "known")).alias("first"))
    ahead = Window.orderBy("first").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range, not each copy
    offsets = sums.select("range", F.coalesce(F.sum("words").over(ahead), F.lit(0)).alias("ahead"))
    at = offsets.where(F.col("ahead") < budget).orderBy(F.desc("ahead")).first()
    if at is None:
        return -1, ""
    running = F.sum("size").over(Window.orderBy("time", "known").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    told = sorted_copies.where(F.col("range") == at["range"]).withColumn("middle", F.lit(at["ahead"]) + running - F.col("size") / 2)
    last = told.where(F.col("middle") <= budget).agg(F.max(F.struct("time", "known")).alias("last")).first()["last"]
    if last is None:  # the budget ends on the first copy of the range: all before it are sent
        first = told.select(F.min(F.struct("time", "known")).alias("first")).first()["first"]
        before = (F.col("time") < first["time"]) | ((F.col("time") == first["time"]) & (F.col("known") < first["known"]))
        last = sorted_copies.where(before).agg(F.max(F.struct("time", "known")).alias("last")).first()["last"]
    forget(sorted_copies)
    return (-1, "") if last is None else (last["time"], last["known"])


def schedule(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, passes: int = MOST_PASSES) -> Schedule:
    """The schedule of written sized() rows: parts' offsets, sources' targets and where the sorted copies are cut."""
    parts = rows.groupBy("known", "part").agg(F.sum("size").alias("part_size"))
    ahead = Window.partitionBy("known").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("known", "part", "part_size", F.coalesce(F.sum("part_size").over(ahead), F.lit(0)).alias("offset"))
    targets = source_targets(parts.groupBy("known").agg(F.sum("part_size").cast("long").alias("source_size")), weights, passes)
    looked_up = written(offsets.join(targets, "known"), "mix-parts")
    budget = looked_up.agg(F.sum("part_size")).first()[0] or 0
    unit = lcm(*weights)
    looked_up = looked_up.drop("part_size")
    stop, last = cut(queued(rows, looked_up), unit, passes, budget)
    return Schedule(looked_up, unit, stop, last)


def sent(k: Column, plan: Schedule) -> Column:
    """Whether a queued() row's copy in pass k comes no later than the last copy sent; one without words goes once only."""
    time = finish(k, plan.unit)
    in_time = (time < plan.stop) | ((time == plan.stop) & (F.col("known") <= plan.last))
    return in_time & ((F.col("size") > 0) | (k == 0))


def mix_table(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken (words, repeats counted).

    Null and blank texts have no words and take none; null sources come last as one source; repeated rows each count;
    equal finish times go by source, and within a source only rows of equal id and text, so of equal size, can tie. A very
    long text is one copy like any other: a source misses its target by less than its next copy. An empty table gives no
    rows, one without words targets of 0. Only doc_id, source and text are read, so other columns can't clash.
    """
    rows = written(sized(docs.select("doc_id", "source", "text"), F.col("doc_id")), "mix-sizes")
    plan = schedule(rows)
    copies = F.lit(0)
    for k in range(MOST_PASSES):
        copies = copies + sent(F.lit(k), plan).cast("int")
    return queued(rows, plan.parts).select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), (F.col("size") * copies).cast("long").alias("taken"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, passes: int = MOST_PASSES) -> DataFrame:
    """The mix itself: docs' columns, a row for each copy sent, range-sorted by virtual finish time.

    Nulls, blank and very long texts, repeated rows, ties and empty tables are treated as in mix_table; a text without
    words goes once if its place in the first pass comes before the cut. Columns of any name pass through unchanged.
    """
    rows = written(sized(docs), "mix-sizes")
    plan = schedule(rows, weights, passes)
    forget(rows)
    timed = queued(sized(docs, packed(docs, "mix_row")), plan.parts)
    copies = timed.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(passes - 1)))).where(sent(F.col("k"), plan))
    return copies.select("mix_row", finish(F.col("k"), plan.unit).alias("time"), "known").orderBy("time", "known").select("mix_row.*")
