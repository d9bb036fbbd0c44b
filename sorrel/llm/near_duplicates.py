"""N-gram Jaccard join by MinHash banding, with near-duplicate classes.

Every text is a set of hashed WORDS-word shingles. Bands and rows of the MinHash signature are chosen for a target recall
at the threshold. Texts that share a band become candidates: each is tied to the least text of the band (a star, never all
pairs), and stars are merged into candidate components. Pairs are verified on full shingle sets, in blocks of texts of a
bounded number and size, so that no task holds a component and none emits its pairs: a task returns counts of links and a
spanning forest. A link is a pair that shares a band and reaches the threshold, in components of any size. A component's
blocks are compared with one another, or, where it is a chain of texts that share few bands, the texts of each band, a pair
in the first band that it shares; whichever sends fewer texts. Verified links make the classes.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import forget, free_names, ship, written

WORDS, THRESHOLD, RECALL, MOST_HASHES = 5, 0.8, 0.9999, 448
#: Texts in a block of a component and bytes of their text, on average; columns of a block's shingle matrix at a time; texts that a task remembers; rows and links that are read at a time.
BLOCK, BLOCK_BYTES, COLUMNS, SEEN, SLICE, LINKS = 256, 4 << 20, 4096, 1_000_000, 64, 1 << 16
#: A key is heavy if it has more than a HEAVY-th of all rows (and more than LEAST_HEAVY); its rows are dealt over SALTS tasks.
HEAVY, LEAST_HEAVY, SALTS = 1000, 64, 64

#: Fixed rule: A-Z become a-z; digits, letters and all bytes beyond ASCII are word characters; the rest becomes a blank.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_POWERS = np.array([pow(0x9E3779B97F4A7C15 | 1, k, 1 << 64) for k in range(1, 257)], np.uint64)


def choose_bands(threshold: float = THRESHOLD, recall: float = RECALL, most_hashes: int = MOST_HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows a band, and so the fewest false candidates, that reach the recall at the threshold within most_hashes."""
    best = None
    for rows in range(1, most_hashes + 1):
        missed = 1 - threshold**rows
        bands = 1 if missed <= 1 - recall else ceil(log(1 - recall) / log1p(-(threshold**rows)))
        if bands * rows > most_hashes:
            break
        best = (bands, rows)
    if best is None:
        raise ValueError("no banding reaches this recall within so many hashes")
    return best


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the text's shingles. A text of fewer words has one, of all it has; of none, none."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass").translate(_TABLE), np.uint8)
    inside = raw != 32
    if not inside.any():
        return np.zeros(0, np.uint64)
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).astype(np.int8)))
    lengths = edge[1::2] - edge[::2]
    chars = raw[inside].astype(np.uint64)
    first = np.cumsum(lengths) - lengths
    place = np.arange(len(chars)) - np.repeat(first, lengths)
    if place[-1] > 255 or (lengths > 256).any():
        chars += (place >> 8).astype(np.uint64) << np.uint64(8)
    word = mixed(np.add.reduceat(chars * _POWERS[place & 255], first) + lengths.astype(np.uint64))
    k = min(words, len(word))
    gram = np.zeros(len(word) - k + 1, np.uint64)
    for j in range(k):
        gram = gram * np.uint64(0xD6E8FEB86659FD93) + word[j : len(word) - k + 1 + j]
    return np.unique(mixed(gram + np.uint64(k)))


def band_hashes(grams: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A signed 64-bit hash for each band of the set's MinHash signature; none for an empty set."""
    if not len(grams):
        return np.zeros(0, np.int64)
    draw = np.random.default_rng(20_240_229)
    n = bands * rows
    flips, factors = draw.integers(0, 1 << 32, n, np.uint32), draw.integers(0, 1 << 31, n, np.uint32) * np.uint32(2) + np.uint32(1)
    low = (grams >> np.uint64(32)).astype(np.uint32)
    least = np.full(n, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(low), 256):
        step = low[k : k + 256, None] ^ flips
        step *= factors
        np.minimum(least, step.min(axis=0), out=least)
    weights = mixed(np.arange(1, rows + 1, dtype=np.uint64)) | np.uint64(1)
    summed = (least.reshape(bands, rows).astype(np.uint64) * weights).sum(axis=1, dtype=np.uint64)
    return mixed(summed + mixed(np.arange(bands, dtype=np.uint64) + np.uint64(1))).view(np.int64)


def text_node(text: Column) -> Column:
    """Equal texts are one node of the link graph; null counts as the empty text."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def id_key(doc_id: Column) -> Column:
    """A key that null ids have too; no id's text equals it."""
    return F.coalesce(F.concat(F.lit("="), doc_id.cast("string")), F.lit(""))


def heavy_from(rows: int) -> int:
    """More rows of a key than this make it heavy; there are fewer than HEAVY such keys at any size."""
    return max(rows // HEAVY, LEAST_HEAVY)


def skew_join(left: DataFrame, right: DataFrame, key: str, spread: str, most: int) -> DataFrame:
    """left joined with right (one row a key, near_n: how many rows of left have it), with left's rows of heavy keys dealt over SALTS tasks by spread.

    Only the heavy keys, fewer than HEAVY by their definition, are broadcast.
    """
    heavy = right.where(F.col("near_n") > most).select(key, F.lit(True).alias("near_hot"))
    salt = F.when(F.col("near_hot"), F.pmod(F.xxhash64(spread), F.lit(SALTS))).otherwise(0).cast("int")
    dealt = left.join(F.broadcast(heavy), key, "left").withColumn("near_salt", salt).drop("near_hot")
    every = F.when(F.col("near_n") > most, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return dealt.join(right.withColumn("near_salt", F.explode(every)).drop("near_n"), [key, "near_salt"]).drop("near_salt")


def signatures(docs: DataFrame, bands: int, rows: int, words: int) -> DataFrame:
    """(doc_id, node, bytes, bands) for each row of docs; bands is null where this task has given that node's bands before."""
    kept = docs.select("doc_id", text_node(F.col("text")).alias("node"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes"), F.col("text").alias("body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            out = []
            for node, body in zip(batch.column("node").to_pylist(), batch.column("body"), strict=True):
                if node in seen:
                    out.append(None)
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(node)
                out.append(band_hashes(shingles(body.as_py(), words), bands, rows))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("doc_id", "node", "bytes")], pa.array(out, pa.list_(pa.int64()))], ["doc_id", "node", "bytes", "bands"])

    return kept.mapInArrow(run, kept.drop("body").schema.add("bands", T.ArrayType(T.LongType())))


def components(edges: DataFrame, name: str) -> DataFrame:
    """(node, root) of every node of the (a, b) edges: root is the least node that it is connected with.

    Rounds of two steps: every node ties its larger neighbours to its least one, then itself and its smaller ones. Each
    round is written to the shared folder. Ends when a round changes nothing: all nodes are then tied to their root.
    """

    def tied(both: DataFrame, most: int) -> DataFrame:
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("near_n")).select("a", F.least("a", "m").alias("m"), "near_n")
        return skew_join(both, least, "a", "b", most)

    state, edges = None, written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}-edges")
    size = edges.count()
    while True:
        most, before = heavy_from(size), edges
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = tied(both, most).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        small = tied(large, most)
        edges = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(small.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        edges = written(edges, f"{name}-round")
        forget(before)
        found = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(found) == state or not found[0]:
            break
        state, size = tuple(found), found[0]
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)


def candidate_edges(signed: DataFrame, rows: int) -> DataFrame:
    """(a, b): each text of a band with two or more texts, tied to the band's least. signed has so many rows."""
    banded = signed.where(F.col("bands").isNotNull()).select("node", F.explode("bands").alias("band"))
    least = banded.groupBy("band").agg(F.min("node").alias("least"), F.max("node").alias("most"), F.count(F.lit(1)).alias("near_n"))
    shared = least.where("least < most").select("band", "least", "near_n")
    return skew_join(banded, shared, "band", "node", heavy_from(rows)).where("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b"))


def linked(sets: list[np.ndarray], side: np.ndarray, threshold: float) -> np.ndarray:
    """The matrix of links: pairs of different sides (or all pairs, if there is one side only) at the threshold or more."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(n), sizes)
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    new = np.cumsum(times > 1) - 1
    shared = times[column] > 1
    owner, column = owner[shared], new[column[shared]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    common = np.zeros((n, n), np.float32)
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, [low, low + COLUMNS])
        part = np.zeros((n, min(COLUMNS, int(column[-1]) + 1 - low)), np.float32)
        part[owner[a:b], column[a:b] - low] = 1
        common += part @ part.T
    union = sizes[:, None] + sizes[None, :] - common
    links = common >= threshold * union - 1e-6
    np.fill_diagonal(links, False)
    if side.min() != side.max():
        links &= side[:, None] != side[None, :]
    return links


def forest(links: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """For each text the least node that its links lead to."""
    peer = nodes.copy()
    for _ in range(len(nodes)):
        near = np.where(links, peer[None, :], np.iinfo(np.int64).max).min(axis=1)
        best = np.minimum(peer, near)
        if (best == peer).all():
            break
        peer = best
    return peer


def block_of(blocks: Column) -> Column:
    return F.pmod(F.xxhash64("node", F.lit(7)), blocks).cast("int")


def blocks_for(texts: Column, size: Column) -> Column:
    """How many blocks so many texts of so many bytes make."""
    return F.greatest(F.ceil(texts / BLOCK), F.ceil(size / BLOCK_BYTES), F.lit(1)).cast("int")


def place(band: Column, key: Column, blocks: Column) -> Column:
    """Where a text is compared: in its block of the component or band bucket of this key. band is -1 for components."""
    return F.struct(band.alias("band"), key.alias("key"), blocks.alias("blocks"), block_of(blocks).alias("block"))


def placements(signed: DataFrame, members: DataFrame) -> DataFrame:
    """(node, copies, low, places) of (node, root, copies, low, bytes): a text's component, or each band it shares there.

    A text goes to as many groups as a place has blocks, so a component of n texts costs n times its blocks, and its bands the
    sum over shared bands. Components of one block stay whole; of larger ones the cheaper way is taken. Both find the same links.
    """
    most = heavy_from(members.count())
    sizes = members.groupBy("root").agg(F.count(F.lit(1)).alias("near_n"), F.sum("bytes").alias("total")).withColumn("size", F.col("near_n"))
    sized = skew_join(members, sizes.withColumn("blocks", blocks_for(F.col("size"), F.col("total"))).drop("total"), "root", "node", most)
    whole = F.array(place(F.lit(-1), F.col("root"), F.col("blocks")))
    wide = written(sized.where(F.col("blocks") > 1).select("node", "root", "size", "bytes", F.col("blocks").alias("of")), "wide")
    if wide.isEmpty():
        forget(wide)
        return sized.select("node", "copies", "low", whole.alias("places"))
    banded = signed.where(F.col("bands").isNotNull()).select("node", "bands").join(wide, "node").dropDuplicates(["node"])
    each = written(banded.select("node", "root", "size", "of", "bytes", F.posexplode("bands").alias("band", "key")), "wide-bands")
    mates = each.groupBy("key").agg(F.count(F.lit(1)).alias("near_n"), F.sum("bytes").alias("total")).where("near_n > 1")
    shared = written(skew_join(each, mates.withColumn("blocks", blocks_for(F.col("near_n"), F.col("total"))).drop("total"), "key", "node", most), "wide-shared")
    cheaper = shared.groupBy("root", "size", "of").agg(F.sum("blocks").alias("sent")).where(F.col("sent") < F.col("size") * F.col("of"))
    split = skew_join(shared, cheaper.select("root", F.col("size").alias("near_n")), "root", "node", most)
    by_band = split.groupBy("node").agg(F.collect_list(place(F.col("band"), F.col("key"), F.col("blocks"))).alias("places"))
    placed = sized.withColumn("whole", whole).join(by_band, "node", "left")
    placed = written(placed.select("node", "copies", "low", F.coalesce("places", "whole").alias("places")), "places")
    forget(wide, each, shared)
    return placed


def agree_before(bands: np.ndarray, band: int) -> np.ndarray:
    """The matrix of pairs that share one of the first bands, so many."""
    same = np.zeros((len(bands), len(bands)), bool)
    for column in bands.T[:band]:
        same |= column[:, None] == column[None, :]
    return same


def sharing(links: np.ndarray, bands: np.ndarray) -> np.ndarray:
    """The links of pairs that share a band."""
    out = np.zeros_like(links)
    a, b = np.nonzero(np.triu(links))
    for k in range(0, len(a), LINKS):
        i, j = a[k : k + LINKS], b[k : k + LINKS]
        out[i, j] = out[j, i] = (bands[i] == bands[j]).any(axis=1)
    return out


def verify(docs: DataFrame, placed: DataFrame, threshold: float, words: int, bands: int, rows: int) -> DataFrame:
    """(node, texts, docs, peer) for groups of candidates: how many other texts, and rows of docs with them, link to node.

    placed: see placements(). Each pair of blocks of a place is a group. A pair that shares a band is counted once: in its
    component, or in the first band that it shares. Of equal texts the row with the least id is fetched, so that copies of one text spread over
    tasks; the join is by merging at any size.
    """
    placed = placed.withColumn("near_id", id_key(F.col("low"))).hint("merge")
    bodies = docs.select(id_key(F.col("doc_id")).alias("near_id"), text_node(F.col("text")).alias("node"), F.col("text").alias("body"))
    texts = bodies.join(placed, ["near_id", "node"]).dropDuplicates(["near_id", "node"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, SLICE):
                batch = whole.slice(low, SLICE)
                sets = [shingles(b.as_py(), words) for b in batch.column("body")]
                hashes = pa.array([band_hashes(s, bands, rows).tobytes() for s in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("node", "copies", "places")], hashes, pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "copies", "places", "bands", "grams"])

    texts = texts.select("node", "copies", "places", "body")
    encoded = texts.mapInArrow(encode, texts.drop("body").schema.add("bands", "binary").add("grams", "binary"))
    sent = encoded.select("node", "copies", "bands", "grams", F.inline("places")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = sent.select("band", "key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "node", "copies", "block", "bands", "grams")

    def compare(group: pa.Table) -> pa.Table:
        band = group.column("band")[0].as_py()
        hashes = np.frombuffer(b"".join(group.column("bands").to_pylist()), np.int64).reshape(group.num_rows, -1)
        owned = None
        if band >= 0:
            owned = ~agree_before(hashes, band)
            np.fill_diagonal(owned, False)
            kept = owned.any(axis=1)
            group, owned = group.filter(pa.array(kept)), owned[np.ix_(kept, kept)]
            if not group.num_rows:
                return pa.table({n: pa.array([], pa.int64()) for n in ("node", "texts", "docs", "peer")})
        sets = [np.frombuffer(g, np.uint64) for g in group.column("grams").to_pylist()]
        nodes, copies, block = (group.column(c).to_numpy() for c in ("node", "copies", "block"))
        mixed_blocks = group.column("i")[0].as_py() != group.column("j")[0].as_py()
        if mixed_blocks and block.min() == block.max():
            links = np.zeros((len(nodes), len(nodes)), bool)
        else:
            links = linked(sets, block, threshold)
        links = sharing(links, hashes) if owned is None else links & owned
        some = links.any(axis=1)
        columns = (nodes[some], links.sum(axis=1)[some], (links @ copies)[some], forest(links, nodes)[some])
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("node", "texts", "docs", "peer"), columns, strict=True)})

    return dealt.groupBy("band", "key", "i", "j").applyInArrow(compare, "node long, texts long, docs long, peer long")


def join_near(docs: DataFrame, threshold: float = THRESHOLD, words: int = WORDS, recall: float = RECALL) -> tuple[DataFrame, DataFrame]:
    """(rows, nodes): rows of (doc_id, node), one for each of docs; nodes, written, of (node, root, copies, low, texts, docs)."""
    bands, per_band = choose_bands(threshold, recall)
    signed = written(signatures(docs, bands, per_band, words), "signatures")
    counted = signed.groupBy("node").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("low"), F.max("bytes").alias("bytes"))
    tied = written(components(candidate_edges(signed, signed.count()), "candidates"), "candidate-roots")
    members = written(tied.join(counted, "node"), "candidates")
    placed = placements(signed, members)
    links = written(verify(docs, placed, threshold, words, bands, per_band), "links")
    forget(tied, members, placed)
    sums = links.groupBy("node").agg(F.sum("texts").alias("texts"), F.sum("docs").alias("docs"))
    roots = components(links.select(F.col("node").alias("a"), F.col("peer").alias("b")), "classes")
    nodes = counted.join(sums, "node", "left").join(roots, "node", "left")
    nodes = nodes.select("node", F.coalesce("root", "node").alias("root"), "copies", "low", F.coalesce("texts", F.lit(0)).alias("texts"), F.coalesce("docs", F.lit(0)).alias("docs"))
    return signed.select("doc_id", "node"), written(nodes, "nodes")


def near_duplicate_table(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, class_id, n_links, n_copies, n_text_links.

    class_id is the least doc_id of the documents that links connect. n_links counts the other documents at the threshold
    or more, equal texts among them; n_copies the rows with an equal text, itself included; n_text_links the different
    texts linked. Texts without a word (null too) link with equal ones only; texts of fewer than WORDS words are one
    shingle; very long texts are shingled whole. Repeated rows each count. A class of null ids has a null class_id. An
    empty table gives no rows. Only doc_id and text are read, so other columns can't clash.
    """
    rows, nodes = join_near(docs)
    alone = nodes.where("texts = 0").withColumn("class_id", F.col("low"))
    linked_nodes = nodes.where("texts > 0")
    classes = linked_nodes.groupBy("root").agg(F.min("low").alias("class_id"), F.count(F.lit(1)).alias("near_n"))
    most = heavy_from(rows.count())
    named = alone.unionByName(skew_join(linked_nodes, classes, "root", "node", most))
    per_node = named.select("node", "class_id", (F.col("docs") + F.col("copies") - 1).alias("n_links"), F.col("copies").alias("n_copies"), F.col("texts").alias("n_text_links"), F.col("copies").alias("near_n"))
    return skew_join(rows, per_node, "node", "doc_id", most).select("doc_id", "class_id", "n_links", "n_copies", "n_text_links")


def keep_one(docs: DataFrame) -> DataFrame:
    """Of each class of near-duplicates the row with the least doc_id (null ids last); of rows with equal id and text one stays.

    docs' columns pass through unchanged, whatever their names; see near_duplicate_table for odd rows.
    """
    _, nodes = join_near(docs)
    first = F.min(F.struct(F.col("low").isNull().alias("none"), F.col("low"), F.col("node")))
    own = free_names(docs, "near_id", "near_node")
    kept = nodes.groupBy("root").agg(first.alias("first")).select(id_key(F.col("first.low")).alias(own[0]), F.col("first.node").alias(own[1]))
    keyed = docs.withColumns(dict(zip(own, (id_key(F.col("doc_id")), text_node(F.col("text"))), strict=True)))
    return keyed.join(written(kept, "kept").hint("merge"), own, "left_semi").dropDuplicates(own).select(*docs.columns)


ship(__name__)
