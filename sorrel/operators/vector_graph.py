"""A graph index for nearest vectors: a navigable small-world graph for each segment of the vectors.

Vectors are dealt into segments of bounded size by hash, and a task builds a segment's graph: every vector is linked with near
vectors in different directions, with those that chose it, and with a few by chance. A segment is one row of the stored table,
so a search moves nothing: each task walks the segments that it reads, for a broadcast block of queries, and passes on its
best; these are merged. A walk may miss some of the nearest; an exact check can follow, which only needs to pass on what is
no farther than the last of those found. A walk keeps a list of num_candidates results and ends when no open vector is nearer than the last of
them. Filters are masks: the walk goes through all vectors, but only those that share a bit with the query become results;
where a filter leaves few of a segment, these are scored directly.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from sorrel import vocab
from sorrel.operators.review_index import ranked
from sorrel.scratch import scratch_path, ship, written

#: Bytes of a segment's vectors (of 8-byte numbers) and its most vectors; links that a vector chooses, that it has at most, and those by chance.
SEGMENT_BYTES, SEGMENT, CHOSEN, MOST_LINKS, CHANCE = 16 << 20, 8192, 16, 32, 2
#: Near vectors among which links are chosen; results that a walk keeps; open vectors that it follows at a time.
CONSIDERED, NUM_CANDIDATES, STEP = 48, 100, 4
#: From so many vectors on, hybrid search uses a graph; below, scoring all vectors is as fast.
GRAPH_FROM = 1_000_000


@dataclass(frozen=True)
class VectorGraph:
    """segments: (segment, doc_ids, masks, size, vectors, links, entries), a row for each."""

    segments: DataFrame


def unit(m: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(length == 0, 1, length)


def choose_links(near: np.ndarray, scores: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Of near (nearest first) those that are nearer to the vector than to any chosen before; then the nearest of the rest, up to CHOSEN."""
    between = vectors[near] @ vectors[near].T
    chosen: list[int] = []
    for k in range(len(near)):
        if len(chosen) == CHOSEN:
            break
        if not chosen or scores[k] > between[k, chosen].max():
            chosen.append(k)
    rest = [k for k in range(len(near)) if k not in set(chosen)]
    return near[chosen + rest[: CHOSEN - len(chosen)]]


def link(vectors: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(links, entries) of unit vectors: a row of MOST_LINKS places for each, -1 where there are fewer, and the places where walks begin."""
    n = len(vectors)
    draw = np.random.default_rng(seed)
    own: list[set[int]] = [set() for _ in range(n)]
    for low in range(0, n, 512):
        scores = vectors[low : low + 512] @ vectors.T
        scores[np.arange(len(scores)), np.arange(low, low + len(scores))] = -2
        width = min(CONSIDERED, n - 1)
        for k, row in enumerate(scores):
            if width:
                near = np.argpartition(-row, width - 1)[:width]
                near = near[np.lexsort((near, -row[near]))]
                own[low + k].update(choose_links(near, row[near], vectors).tolist())
    for k, others in enumerate([list(o) for o in own]):
        for other in others:
            if len(own[other]) < MOST_LINKS - CHANCE:
                own[other].add(k)
    links = np.full((n, MOST_LINKS), -1, np.int32)
    for k, others in enumerate(own):
        others |= {int(x) for x in draw.integers(0, n, CHANCE) if x != k}
        links[k, : min(len(others), MOST_LINKS)] = sorted(others)[:MOST_LINKS]
    entries = np.sort(draw.choice(n, min(n, int(np.ceil(np.sqrt(n)))), replace=False)).astype(np.int32)
    return links, entries


def build(vectors: DataFrame, folder: str | None = None) -> VectorGraph:
    """The graph of vectors (doc_id, vector and, for filters, mask), stored in folder (scratch without one)."""
    spark = vectors.sparkSession
    folder = folder or scratch_path(spark, "vector-graph")
    rows = vectors.select("doc_id", F.col("vector").cast("array<double>").alias("vector"), F.col("mask").cast("long").alias("mask") if "mask" in vectors.columns else F.lit(0).cast("long").alias("mask"))
    told = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("size")).first()
    most = max(min(SEGMENT, SEGMENT_BYTES // (8 * max(told["size"] or 1, 1))), 1)
    parts = -(-told["n"] // most) or 1
    kind = to_arrow_type(rows.schema["doc_id"].dataType)

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("doc_id")
        matrix = np.array(group.column("vector").to_pylist(), np.float64).reshape(group.num_rows, -1)
        segment = group.column("segment")[0].as_py()
        links, entries = link(unit(matrix), segment)
        one = lambda values, t: pa.array([values], t)
        return pa.table({
            "segment": one(segment, pa.int64()), "doc_ids": one(group.column("doc_id").to_pylist(), pa.list_(kind)), "masks": one(group.column("mask").to_pylist(), pa.list_(pa.int64())),
            "size": one(matrix.shape[1], pa.int32()), "vectors": one(matrix.tobytes(), pa.binary()), "links": one(links.tobytes(), pa.binary()), "entries": one(entries.tolist(), pa.list_(pa.int32())),
        })

    schema = T.StructType([
        T.StructField("segment", T.LongType()), T.StructField("doc_ids", T.ArrayType(rows.schema["doc_id"].dataType)), T.StructField("masks", T.ArrayType(T.LongType())), T.StructField("size", T.IntegerType()),
        T.StructField("vectors", T.BinaryType()), T.StructField("links", T.BinaryType()), T.StructField("entries", T.ArrayType(T.IntegerType())),
    ])
    dealt = rows.withColumn("segment", F.pmod(F.xxhash64("doc_id"), F.lit(parts)))
    dealt.groupBy("segment").applyInArrow(run, schema).write.mode("overwrite").parquet(folder)
    return load(spark, folder)


def load(spark: SparkSession, folder: str) -> VectorGraph:
    return VectorGraph(spark.read.parquet(folder))


class Segment:
    """A segment's graph within a task."""

    def __init__(self, row: dict):
        self.doc_ids = row["doc_ids"]
        self.masks = np.array(row["masks"], np.int64)
        self.vectors = unit(np.frombuffer(row["vectors"], np.float64).reshape(len(self.doc_ids), row["size"]))
        self.links = np.frombuffer(row["links"], np.int32).reshape(len(self.doc_ids), MOST_LINKS)
        self.entries = np.array(row["entries"], np.int32)

    def search(self, query: np.ndarray, mask: int, top: int, candidates: int) -> tuple[list[tuple[float, int]], int]:
        """(results, scored): the best (score, place) that the mask lets through, and how many vectors were scored."""
        allowed = None if mask == 0 else (self.masks & mask) != 0
        if allowed is not None and (few := np.flatnonzero(allowed)).size <= 4 * candidates:
            scores = self.vectors[few] @ query
            return self.first(zip(scores.tolist(), few.tolist(), strict=True), top), len(few)
        seen = np.zeros(len(self.vectors), bool)
        open_: list[tuple[float, int]] = []
        kept: list[tuple[float, int]] = []

        def take(places: np.ndarray) -> int:
            seen[places] = True
            for score, place in zip((self.vectors[places] @ query).tolist(), places.tolist(), strict=True):
                if len(kept) == candidates and score <= kept[0][0]:
                    continue
                heapq.heappush(open_, (-score, place))
                if allowed is None or allowed[place]:
                    (heapq.heappush if len(kept) < candidates else heapq.heappushpop)(kept, (score, place))
            return len(places)

        scored = take(self.entries)
        while open_:
            follow = []
            while open_ and len(follow) < STEP:
                score, place = heapq.heappop(open_)
                if len(kept) == candidates and -score < kept[0][0]:
                    open_.clear()
                    break
                follow.append(place)
            near = np.unique(self.links[follow]) if follow else np.zeros(0, np.int32)
            near = near[near >= 0]
            near = near[~seen[near]]
            if len(near):
                scored += take(near)
        return self.first(kept, top), scored

    def no_farther(self, query: np.ndarray, mask: int, top: int, least: float | None) -> tuple[list[tuple[float, int]], int]:
        """As search(), of all vectors: the best whose rounded score is least or more, ties by document; least is None where fewer than top are known."""
        scores = self.vectors @ query
        near = np.ones(len(scores), bool) if mask == 0 else (self.masks & mask) != 0
        # Rounding moves a score by half a unit of the eighth digit at most.
        bound = -2.0 if least is None else least - 1e-8
        if (near & (scores >= bound)).sum() > top:
            bound = max(bound, np.partition(scores[near], -top)[-top] - 1e-8)
        places = np.flatnonzero(near & (scores >= bound))
        return self.first(zip(scores[places].tolist(), places.tolist(), strict=True), top), len(scores)

    def first(self, found, top: int) -> list[tuple[float, int]]:
        """The best by rounded score, ties by document."""
        return sorted(((round(s, 8) + 0.0, p) for s, p in found), key=lambda x: (-x[0], self.doc_ids[x[1]]))[:top]


def walk(graph: VectorGraph, queries: DataFrame, top: int, candidates: int = NUM_CANDIDATES, block: int | None = None) -> DataFrame:
    """(query_id, doc_id, cosine, segment, scored), written: what each segment gives for each query (query_id, vector and, for a filter, mask), and how many vectors it scored for it.

    Queries are a stated set and are taken in blocks of bounded size, as the exact leg takes them.
    """
    return _each_segment(graph, queries, block, "graph-walks", lambda segment, query, mask, _: segment.search(query, mask, top, max(candidates, top)))


def check(graph: VectorGraph, queries: DataFrame, walked: DataFrame, top: int, block: int | None = None) -> DataFrame:
    """As walk(): of each segment the best vectors that are no farther from a query than the last of the first top documents that walk() found for it, so that these and the walk's are sure to hold the nearest."""
    best = walked.groupBy("query_id", "doc_id").agg(F.max("cosine").alias("cosine"))
    last = ranked(best.withColumnRenamed("cosine", "score"), top).where(F.col("rank") == top).select("query_id", F.col("score").alias("least"))
    return _each_segment(graph, queries.join(last, "query_id", "left"), block, "graph-check", lambda segment, query, mask, least: segment.no_farther(query, mask, top, least))


def _each_segment(graph: VectorGraph, queries: DataFrame, block: int | None, name: str, look: Callable) -> DataFrame:
    """(query_id, doc_id, cosine, segment, scored), written: what look(segment, vector, mask, least) tells of every segment and query."""
    spark = queries.sparkSession
    given = lambda c, kind, default: F.col(c).cast(kind) if c in queries.columns else F.lit(default).cast(kind)
    asked = queries.select("query_id", F.col("vector").cast("array<double>").alias("vector"), given("mask", "long", 0).alias("mask"), given("least", "double", None).alias("least"))
    asked = written(asked, "graph-queries")
    kind, id_type = graph.segments.schema["doc_ids"].dataType.elementType, asked.schema["query_id"].dataType
    schema = T.StructType([T.StructField("query_id", id_type), T.StructField("doc_id", kind), T.StructField("cosine", T.DoubleType()), T.StructField("segment", T.LongType()), T.StructField("scored", T.LongType())])
    arrow = [to_arrow_type(f.dataType) for f in schema]
    blocks = max(-(-asked.count() // (block or vocab.QUERY_BLOCK)), 1)
    found = None
    for b in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).collect()
        matrix = unit(np.array([r["vector"] for r in rows], np.float64).reshape(len(rows), -1)) if rows else np.zeros((0, 1))
        shared = spark.sparkContext.broadcast((matrix, [(r["query_id"], r["mask"], r["least"]) for r in rows]))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            matrix, told = shared.value
            for batch in batches:
                for k in range(batch.num_rows):
                    row = batch.slice(k, 1).to_pylist()[0]
                    segment, out = Segment(row), []
                    for query, (name, mask, least) in zip(matrix, told, strict=True):
                        results, scored = look(segment, query, mask, least)
                        out.extend((name, segment.doc_ids[p], s, row["segment"], scored) for s, p in results)
                    columns = list(zip(*out, strict=True)) or [()] * len(arrow)
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, arrow, strict=True)], schema.names)

        each = graph.segments.mapInArrow(run, schema)
        found = each if found is None else found.unionByName(each)
    return written(found, name)


def graph_leg(graph: VectorGraph, queries: DataFrame, top: int = vocab.DENSE_TOP, candidates: int = NUM_CANDIDATES, exact: bool = False) -> DataFrame:
    """(query_id, doc_id, score, rank) as search.dense_leg() gives it, by the graph. A query with several vectors takes a document's best. exact: what the walk misses is added by check()."""
    met = walk(graph, queries, top, candidates)
    if exact:
        met = met.unionByName(check(graph, queries, met, top))
    best = met.groupBy("query_id", "doc_id").agg(F.max("cosine").alias("cosine"))
    return ranked(best.select("query_id", "doc_id", F.round((1 + F.col("cosine")) / 2, 9).alias("score")), top)


def work(walked: DataFrame) -> DataFrame:
    """(query_id, scored): vectors that walk() scored for each query with results."""
    return walked.groupBy("query_id", "segment").agg(F.max("scored").alias("scored")).groupBy("query_id").agg(F.sum("scored").alias("scored"))


ship(__name__)
