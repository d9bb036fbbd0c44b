"""Phrase collocation mining by hierarchical pair naming.

Words that occur often enough get ids. A frequent phrase of k words is a pair of adjacent frequent phrases of k - 1 words, so
its name is the id that the pair of their ids gets in a table of all frequent pairs. Texts become sequences of ids, and each
level replaces a sequence by the names of its adjacent pairs; what isn't frequent breaks the sequence, as the end of a piece
does. The two ids of a pair are the phrase's parents: the counts of its first and last words for every cut come down from
them, and a phrase passes its own count up to its parents, which tells whether it subsumes them.

Sequences are kept in chunks of whole texts, packed, as a task's batches of plain numbers would take several times their size
in an executor's memory. The names that take more than a COMMON-th of a level's occurrences, fewer than
COMMON by definition, are broadcast; a chunk asks for each of the others once, by a shuffled join on the pair. A filter of
bounded size, with a few bits for each of the other names, keeps chunks from asking for most of what has no name; the more
names there are, the more questions it lets through.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import forget, ship, written

#: Occurrences of a candidate, words of the longest, per cent of a phrase's count that subsumes it, rows of a language.
LEAST, LONGEST, SUBSUMED, TOP = 30, 4, 80, 2000
SCALE = 2_000_000
#: Names that are broadcast at most: words take some 35 bytes each in a worker, pairs 32; positions of a chunk (a longer text makes a longer chunk); different words and positions that a task holds at a time.
COMMON, CHUNK, MEMO, COUNTED = 8_000_000, 1 << 18, 500_000, 1 << 19
#: Rows of counts that a worker sends at a time.
SENT = 1 << 16
#: 64-bit words of the filter at most, and names to a word up to then.
FILTER_WORDS, NAMES_A_WORD = 1 << 22, 2
#: Parts of a language that are ranked by themselves before the language is.
SALTS = 64

#: Fixed rule: A-Z become a-z; .,;:!? and U+000A to U+000D end a piece, tabs become blanks.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else 10 if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b for b in range(256))


def pieces(raw: bytes) -> Iterator[list[bytes]]:
    """The words of each piece of a text in UTF-8."""
    for piece in raw.translate(_TABLE).split(b"\n"):
        if words := piece.split():
            yield words


def texts_of(batch: pa.RecordBatch) -> Iterator[tuple[str, bytes]]:
    for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary()), strict=True):
        yield lang, text.as_py()


def plain(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))


def packed(ids: np.ndarray) -> bytes:
    """A chunk as it is stored: its length and its compressed ids."""
    return len(ids).to_bytes(8, "little") + pa.compress(np.ascontiguousarray(ids, np.int64).tobytes(), codec="zstd", asbytes=True)


def unpacked(chunk: bytes) -> np.ndarray:
    return np.frombuffer(pa.decompress(chunk[8:], 8 * int.from_bytes(chunk[:8], "little"), codec="zstd", asbytes=True), np.int64)


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, f) of every word, and one row of each language with a null word and the count of all its words."""

    def batch_of(lang: str, counts: Counter) -> pa.RecordBatch:
        words = pa.array(counts, pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(counts), pa.string()), words, pa.array(list(counts.values()), pa.int64())], ["lang", "word", "times"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted: dict[str, Counter] = {}
        total: Counter = Counter()
        for batch in batches:
            for lang, raw in texts_of(batch):
                tally = counted.setdefault(lang, Counter())
                for words in pieces(raw):
                    tally.update(words)
                    total[lang] += len(words)
                if len(tally) >= MEMO:
                    yield batch_of(lang, tally)
                    tally.clear()
        for lang, tally in counted.items():
            yield batch_of(lang, tally)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.nulls(len(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["lang", "word", "times"])

    return plain(docs).mapInArrow(count, "lang string, word string, times long").groupBy("lang", "word").agg(F.sum("times").alias("f"))


def word_hash(lang: str, word: bytes) -> int:
    """64 bits of a word and its language."""
    ahead = crc32(lang.encode() + b"\0")
    return crc32(word, ahead) | crc32(word[::-1], ahead) << 32


def filter_bits(hashes: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each 64-bit hash the place of its word in a filter of so many words (a power of two), and its four bits there."""
    h = hashes.astype(np.uint64)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(29)
    bits = np.zeros(len(h), np.uint64)
    for k in range(4):
        bits |= np.uint64(1) << ((h >> np.uint64(6 * k)) & np.uint64(63))
    return ((h >> np.uint64(40)) & np.uint64(words - 1)).astype(np.int64), bits


def may_hold(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """False only for hashes that no name of the filter has."""
    place, bits = filter_bits(hashes, len(table))
    return (table[place] & bits) == bits


def word_may_be_there(table: np.ndarray, h: int) -> bool:
    """may_hold() of one hash, in whole numbers."""
    h = (h ^ (h >> 33)) * 0xFF51AFD7ED558CCD & 0xFFFFFFFFFFFFFFFF
    h ^= h >> 29
    bits = 1 << (h & 63) | 1 << (h >> 6 & 63) | 1 << (h >> 12 & 63) | 1 << (h >> 18 & 63)
    return int(table[h >> 40 & len(table) - 1]) & bits == bits


def name_filter(names: DataFrame, columns: list[str], hashed) -> np.ndarray:
    """The filter of names' keys. hashed turns a batch of the columns into 64-bit hashes. At most FILTER_WORDS words come to the driver."""
    count = names.count()
    words = 1 << min(max(-(-count // NAMES_A_WORD) - 1, 63).bit_length(), FILTER_WORDS.bit_length() - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place, bits = filter_bits(hashed(batch), words)
            yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(bits.view(np.int64))], ["place", "bits"])

    merged = names.select(*columns).mapInArrow(run, "place long, bits long").groupBy("place").agg(F.bit_or("bits").alias("bits")).toArrow()
    table = np.zeros(words, np.uint64)
    table[merged.column("place").to_numpy()] = merged.column("bits").to_numpy().view(np.uint64)
    return table


class Words:
    """Ids of common words, in arrays: sorted hashes, ids, and the words (with their languages) in one buffer."""

    def __init__(self, rows: pa.Table):
        """rows: id, lang, word (bytes), read in batches, so that the driver holds little besides the arrays."""
        hashes, sizes, parts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], []
        for batch in rows.to_batches(max_chunksize=1 << 16):
            pairs = list(zip(batch.column("lang").to_pylist(), batch.column("word").to_pylist(), strict=True))
            keys = [lang.encode() + b"\0" + word for lang, word in pairs]
            hashes.append(np.array([word_hash(lang, word) for lang, word in pairs], np.uint64))
            sizes.append(np.array([len(k) for k in keys], np.int64))
            parts.append(b"".join(keys))
        order = np.argsort(whole := np.concatenate(hashes), kind="stable")
        ends = np.cumsum(lengths := np.concatenate(sizes))
        self.hashes, self.ids, self.buffer = whole[order], rows.column("id").to_numpy()[order], b"".join(parts)
        self.starts, self.ends = (ends - lengths)[order], ends[order]

    def parts(self) -> tuple:
        """Its plain arrays: an object of this class could only be read where the package is."""
        return self.hashes, self.ids, self.buffer, self.starts, self.ends

    @classmethod
    def of(cls, parts: tuple) -> Words:
        made = cls.__new__(cls)
        made.hashes, made.ids, made.buffer, made.starts, made.ends = parts
        return made

    def find(self, h: int, key: bytes) -> int:
        """The id of the word with this hash and key; 0 if it isn't there."""
        k = int(np.searchsorted(self.hashes, np.uint64(h)))
        while k < len(self.hashes) and self.hashes[k] == h:
            if self.buffer[self.starts[k] : self.ends[k]] == key:
                return int(self.ids[k])
            k += 1
        return 0


class Names(dict):
    """Ids of a language's words as a task meets them, up to MEMO at a time. A word that isn't common gets 0, or a place among those that the chunk asks for if the filter (None where all names are common) lets it through."""

    def __init__(self, known: Words, lang: str, table: np.ndarray | None):
        super().__init__()
        self.known, self.lang, self.prefix, self.table, self.asked = known, lang, lang.encode() + b"\0", table, None

    def __missing__(self, word: bytes) -> int:
        h = word_hash(self.lang, word)
        found = self.known.find(h, self.prefix + word)
        if not found and self.table is not None and word_may_be_there(self.table, h):
            return -self.asked.setdefault((self.lang, word), len(self.asked) + 1)
        if len(self) >= MEMO // 2:
            self.clear()
        self[word] = found
        return found


def word_sequences(docs: DataFrame, words: DataFrame, common: int) -> DataFrame:
    """The level of single words: (ids), packed chunks of word ids with 0 between pieces. words: (id, lang, phrase, f).

    Before it is settled, an id of -k stands for the k-th of asked, the words that may be frequent but aren't common.
    """
    context = docs.sparkSession.sparkContext
    chosen, complete = common_rows(words, common, "id", "lang", F.col("phrase").cast("binary").alias("word"))
    known = Words(chosen).parts()
    hashed = lambda b: np.array([word_hash(lang, w.as_py()) for lang, w in zip(b.column("lang").to_pylist(), b.column("phrase").cast(pa.binary()), strict=True)], np.uint64)
    shared = context.broadcast((known, None if complete else name_filter(words, ["lang", "phrase"], hashed)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, table = shared.value
        known = Words.of(parts)
        names: dict[str, Names] = {}
        ids: list[int] = []
        asked: dict = {}

        def chunk() -> pa.RecordBatch:
            rows = [{"lang": lang, "word": word.decode()} for lang, word in asked]
            return pa.RecordBatch.from_arrays([pa.array([packed(np.array(ids, np.int64))], pa.binary()), pa.array([rows], ASKED_WORDS)], ["ids", "asked"])

        for batch in batches:
            for lang, raw in texts_of(batch):
                if lang not in names:
                    names[lang] = Names(known, lang, table)
                of = names[lang]
                of.asked = asked
                for words in pieces(raw):
                    ids.extend(map(of.__getitem__, words))
                    ids.append(0)
                if len(ids) >= CHUNK:
                    yield chunk()
                    ids, asked = [], {}
        if ids:
            yield chunk()

    asked_type = T.ArrayType(T.StructType([T.StructField("lang", T.StringType()), T.StructField("word", T.StringType())]))
    chunks = plain(docs).mapInArrow(run, T.StructType([T.StructField("ids", T.BinaryType()), T.StructField("asked", asked_type)]))
    return settled(chunks, words.withColumnRenamed("phrase", "word"), ["lang", "word"], complete, 1)


ASKED_WORDS = pa.list_(pa.struct([("lang", pa.string()), ("word", pa.string())]))
ASKED_PAIRS = pa.list_(pa.struct([("left", pa.int64()), ("right", pa.int64())]))


def common_rows(names: DataFrame, common: int, *columns: str | Column) -> tuple[pa.Table, bool]:
    """Columns of the names with more than a common-th of all occurrences (f), and whether those are all there are."""
    rows, total = names.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("f").cast("decimal(38,0)")), F.lit(0))).first()
    chosen = names.where(F.col("f").cast("decimal(38,0)") * F.lit(common) > F.lit(total).cast("decimal(38,0)")).select(*columns).toArrow()
    return chosen, chosen.num_rows == rows


def settled(chunks: DataFrame, names: DataFrame, key: list[str], complete: bool, level: int) -> DataFrame:
    """(ids): the chunks, written, with what they asked for filled in from names (id and key): 0 where that has no name."""
    if complete:
        return written(chunks.select("ids"), f"level-{level}")
    chunks = written(chunks.withColumn("chunk", F.monotonically_increasing_id()), f"asking-{level}")
    wanted = chunks.select("chunk", F.posexplode("asked").alias("nth", "a")).select("chunk", "nth", "a.*")
    found = wanted.join(names.select("id", *key), key).groupBy("chunk").agg(F.collect_list(F.struct("nth", "id")).alias("found"))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, count, found in zip(batch.column("ids"), batch.column("n_asked").to_pylist(), batch.column("found").to_pylist(), strict=True):
                lookup = np.zeros(count + 1, np.int64)
                for x in found or ():
                    lookup[x["nth"] + 1] = x["id"]
                own = unpacked(ids.as_py())
                yield pa.RecordBatch.from_arrays([pa.array([packed(np.where(own < 0, lookup[np.where(own < 0, -own, 0)], own))], pa.binary())], ["ids"])

    joined = chunks.select("chunk", "ids", F.size("asked").alias("n_asked")).join(found, "chunk", "left")
    filled = written(joined.select("ids", "n_asked", "found").mapInArrow(fill, "ids binary"), f"level-{level}")
    forget(chunks)
    return filled


def adjacent(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of each chunk the ids of all places but the last, and of their right neighbours."""
    for ids in batch.column("ids"):
        own = unpacked(ids.as_py())
        yield own[:-1], own[1:]


def pair_counts(sequences: DataFrame) -> DataFrame:
    """(left, right, f): the adjacent pairs of named places, counted within tasks in blocks before they are summed."""

    def batches_of(lefts: list[np.ndarray], rights: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        left, right = np.concatenate(lefts), np.concatenate(rights)
        ids, code = np.unique(np.concatenate((left, right)), return_inverse=True)
        pair, times = np.unique(code[: len(left)] * len(ids) + code[len(left) :], return_counts=True)
        for low in range(0, len(pair), SENT):
            p = pair[low : low + SENT]
            yield pa.RecordBatch.from_arrays([pa.array(ids[p // len(ids)]), pa.array(ids[p % len(ids)]), pa.array(times[low : low + SENT].astype(np.int64))], ["left", "right", "times"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lefts, rights, held = [], [], 0
        for batch in batches:
            for left, right in adjacent(batch):
                named = (left > 0) & (right > 0)
                lefts.append(left[named])
                rights.append(right[named])
                held += len(lefts[-1])
                if held >= COUNTED:
                    yield from batches_of(lefts, rights)
                    lefts, rights, held = [], [], 0
        if held:
            yield from batches_of(lefts, rights)

    return sequences.mapInArrow(count, "left long, right long, times long").groupBy("left", "right").agg(F.sum("times").alias("f"))


def pair_hash(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    x = left.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) + right.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def pair_sequences(sequences: DataFrame, names: DataFrame, common: int, level: int) -> DataFrame:
    """(ids): the next level of the sequences, by the names (id, left, right, f) of adjacent pairs."""
    chosen, complete = common_rows(names, common, "id", "left", "right")
    ids, left, right = (chosen.column(c).to_numpy() for c in ("id", "left", "right"))
    order = np.argsort(pair_hash(left, right), kind="stable")
    hashed = lambda b: pair_hash(b.column("left").to_numpy(), b.column("right").to_numpy())
    table = None if complete else name_filter(names, ["left", "right"], hashed)
    shared = sequences.sparkSession.sparkContext.broadcast((pair_hash(left, right)[order], ids[order], left[order], right[order], table))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, known, lefts, rights, table = shared.value
        for batch in batches:
            for left, right in adjacent(batch):
                out = np.zeros(len(left), np.int64)
                at = np.flatnonzero((left > 0) & (right > 0))
                a, b = left[at], right[at]
                h = pair_hash(a, b)
                met = np.zeros(len(at), bool)
                if len(hashes) and len(at):
                    near = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
                    met = (lefts[near] == a) & (rights[near] == b)
                    out[at[met]] = known[near[met]]
                rows: list[dict] = []
                if table is None:
                    out[at[~met]] = _among_equals(hashes, known, lefts, rights, a[~met], b[~met])
                else:
                    # What isn't met here is asked for, also where another pair has its hash: the join compares the ids.
                    open_ = np.flatnonzero(~met)
                    open_ = open_[may_hold(table, h[open_])]
                    both, code = np.unique(np.stack((a[open_], b[open_])), axis=1, return_inverse=True)
                    out[at[open_]] = -1 - code.ravel()
                    rows = [{"left": x, "right": y} for x, y in both.T.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array([packed(squeezed(out))], pa.binary()), pa.array([rows], ASKED_PAIRS)], ["ids", "asked"])

    asked_type = T.ArrayType(T.StructType([T.StructField("left", T.LongType()), T.StructField("right", T.LongType())]))
    chunks = sequences.mapInArrow(run, T.StructType([T.StructField("ids", T.BinaryType()), T.StructField("asked", asked_type)]))
    return settled(chunks, names, ["left", "right"], complete, level)


def _among_equals(hashes: np.ndarray, known: np.ndarray, lefts: np.ndarray, rights: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The ids of pairs that aren't the first of their hash; 0 for pairs without a name."""
    out, h = np.zeros(len(a), np.int64), pair_hash(a, b)
    low, high = np.searchsorted(hashes, h), np.searchsorted(hashes, h, side="right")
    for k in np.flatnonzero(high - low > 1):
        for j in range(low[k], high[k]):
            if lefts[j] == a[k] and rights[j] == b[k]:
                out[k] = known[j]
    return out


def squeezed(ids: np.ndarray) -> np.ndarray:
    """ids with one 0 for each run of them."""
    return ids[(ids != 0) | np.concatenate(([True], ids[:-1] != 0))]


def named_pairs(counts: DataFrame, below: DataFrame, least: int, level: int) -> DataFrame:
    """The table of a level's phrases, written: (id, left, right, lang, phrase, last, f, heads, tails).

    below: the table of the level below, whose rows are the parents. heads and tails hold the counts of a phrase's first and
    last 1, 2, ... words, itself last: the left parent's heads and the right parent's tails, and its own count.
    """
    left = below.select(F.col("id").alias("left"), "lang", "phrase", "heads")
    right = below.select(F.col("id").alias("right"), "last", "tails")
    both = counts.where(F.col("f") >= least).join(left, "left").join(right, "right")
    rows = both.select("left", "right", "lang", F.concat_ws(" ", "phrase", "last").alias("phrase"), "last", "f", F.concat("heads", F.array("f")).alias("heads"), F.concat("tails", F.array("f")).alias("tails"))
    return written(rows.withColumn("id", F.monotonically_increasing_id() + 1), f"phrases-{level}")


def scored(phrases: DataFrame, words: int) -> DataFrame:
    """(lang, phrase, a, l, r, score) of phrases of so many words: the cut with the lowest score, the first of equals. Products are decimals."""
    count = lambda c: c.cast("decimal(20,0)")
    cuts = []
    for k in range(1, words):
        first, rest = F.element_at("heads", k), F.element_at("tails", words - k)
        score = F.call_function("div", F.lit(SCALE).cast("decimal(7,0)") * count(F.col("f")), count(first) + count(rest))
        cuts.append(F.struct(score.cast("long").alias("score"), F.lit(k).alias("k"), first.alias("l"), rest.alias("r")))
    best = F.array_min(F.array(*cuts))
    return phrases.select("lang", "phrase", F.col("f").alias("a"), best.alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")


def not_subsumed(phrases: DataFrame, longer: DataFrame | None, share: int) -> DataFrame:
    """phrases without those that stand in a longer one with share per cent of their count or more.

    Only the next level is asked: a phrase in a still longer one stands in one of that's parents, which is as frequent.
    """
    if longer is None:
        return phrases
    up = longer.select(F.explode(F.array("left", "right")).alias("id"), "f").groupBy("id").agg(F.max("f").alias("most"))
    exact = lambda c: F.col(c).cast("decimal(20,0)")
    kept = phrases.join(up, "id", "left").where(F.col("most").isNull() | (F.lit(100) * exact("most") < F.lit(share) * exact("f")))
    return kept.drop("most")


def mine(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, share: int = SUBSUMED, common: int = COMMON) -> tuple[DataFrame, DataFrame]:
    """(phrases, totals): (lang, phrase, a, l, r, score) of every candidate that isn't subsumed, and (lang, n).

    common: names with more than a common-th of a level's occurrences are broadcast; the result is the same for any number.
    """
    counted = written(word_counts(docs).where(F.col("word").isNull() | (F.col("f") >= least)).withColumn("id", F.monotonically_increasing_id() + 1), "words")
    totals = counted.where("word IS NULL").select("lang", F.col("f").alias("n"))
    level = counted.where("word IS NOT NULL").select("id", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), "f", F.array("f").alias("heads"), F.array("f").alias("tails"))
    sequences, levels = word_sequences(docs, level, common), []
    for k in range(2, longest + 1):
        level = named_pairs(pair_counts(sequences), level, least, k)
        levels.append(level)
        before, sequences = sequences, pair_sequences(sequences, level, common, k) if k < longest else None
        forget(before)
    above = [*levels[1:], None]
    found = [scored(not_subsumed(p, up, share), k) for k, (p, up) in enumerate(zip(levels, above, strict=True), 2)]
    whole = found[0]
    for more in found[1:]:
        whole = whole.unionByName(more)
    return whole, totals


def best_of_each(phrases: DataFrame, top: int) -> DataFrame:
    """phrases with rank, from 1 within their language, up to top: parts of a language first, then the rows that their parts' tops leave."""
    order = [F.desc("score"), F.desc("a"), "phrase"]
    part = Window.partitionBy("lang", "part").orderBy(*order)
    ahead = phrases.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).withColumn("nth", F.row_number().over(part)).where(F.col("nth") <= top)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")
    return ahead.withColumn("rank", rank).where(F.col("rank") <= top).drop("part", "nth")


def collocation_table(docs: DataFrame) -> DataFrame:
    """The first TOP phrases of each language: lang, rank, phrase, a, l, r, n, score.

    Null languages are und; null and empty texts have no words; ids aren't read, so rows that repeat count each. Very long
    texts and words count whole. Ties go to the phrase that is first in byte order. Languages without a candidate, and an
    empty table, give no rows. Only lang and text are read, so other columns can't clash.
    """
    phrases, totals = mine(docs)
    return best_of_each(phrases, TOP).join(F.broadcast(totals), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ship(__name__)
