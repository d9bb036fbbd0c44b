"""A learned embedding: the leading right singular vectors of a tf-idf matrix, by randomized subspace iteration.

A text is a sparse row over hashed character grams, weighed by tf-idf. Grams are hashed once, slices of texts at a time, and
the rows' counts are written. The matrix is never gathered: in every iteration each task multiplies its rows by the present
basis and the result by its rows again, tasks' sums are added by blocks of places, and the driver only makes the summed product (places x dimensions numbers, whatever the corpus) orthonormal. A text's vector
is its row times the basis, at unit length; a text without a gram has a zero vector.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sorrel.functions import text
from sorrel.scratch import forget, ship, written

#: Places of hashed grams, their sizes, dimensions of a vector, further ones that only the iteration has, iterations, rows multiplied at a time.
PLACES, LOW, HIGH, DIMENSIONS, SPARE, ITERATIONS, SLICE, BLOCK = 4096, 2, 4, 64, 16, 4, 256, 512
#: Characters of different words that are hashed at a time.
CHARACTERS = 1 << 17
#: The CRC-32 of every byte, for steps over arrays.
CRC = np.array([crc32(bytes([k])) for k in range(256)], np.uint32) ^ np.uint32(crc32(b"\0"))


@dataclass(frozen=True)
class Embedding:
    """idf by place; basis (places x dimensions); singular values, largest first."""

    idf: np.ndarray
    basis: np.ndarray
    values: np.ndarray


def grams(value: str | None, places: int) -> dict[int, int]:
    """Counts of a text's hashed grams."""
    counts: dict[int, int] = {}
    for gram, times in text._count_grams(value, LOW, HIGH).items():
        at = crc32(gram.encode("utf-8", "surrogatepass")) % places
        counts[at] = counts.get(at, 0) + times
    return counts


def _places_of_words(words: list[str], places: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashed places of words' grams, word by word, and how many each word has. A gram's hash goes on from that of its first characters."""
    whole = "".join(f" {w} " for w in words)
    points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
    octets = np.frombuffer(whole.encode("utf-8", "surrogatepass"), np.uint8)
    sizes = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
    begins = np.cumsum(sizes) - sizes
    lengths = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    ends, owner = np.repeat(np.cumsum(lengths), lengths), np.repeat(np.arange(len(words)), lengths)
    starts, hashes = np.arange(len(points)), np.full(len(points), 0xFFFFFFFF, np.uint32)
    of, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for n in range(1, HIGH + 1):
        fits = starts + n <= ends[starts]
        starts, hashes = starts[fits], hashes[fits]
        last = starts + n - 1
        for k in range(int(sizes[last].max(initial=0))):
            more = np.flatnonzero(sizes[last] > k)
            hashes[more] = CRC[(hashes[more] ^ octets[begins[last[more]] + k]) & 0xFF] ^ (hashes[more] >> np.uint32(8))
        if n >= LOW:
            of.append(owner[starts])
            found.append((hashes ^ np.uint32(0xFFFFFFFF)).astype(np.int64) % places)
    word = np.concatenate(of)
    return np.concatenate(found)[np.argsort(word, kind="stable")], np.bincount(word, minlength=len(words))


def counted(values: list[str | None], places: int) -> np.ndarray:
    """grams() of texts as rows of counts: each different word of them is hashed once."""
    known: dict[str, int] = {}
    words, times, sizes = [], [], []
    for value in values:
        found = Counter((value or "").lower().split())
        words.extend(known.setdefault(w, len(known)) for w in found)
        times.extend(found.values())
        sizes.append(len(found))
    rows, words, times = np.repeat(np.arange(len(values)), sizes), np.array(words, np.int64), np.array(times, np.int64)
    out, spelled = np.zeros(len(values) * places), list(known)
    reached = np.cumsum([0, *map(len, spelled)])
    low = 0
    while low < len(spelled):
        high = max(int(np.searchsorted(reached, reached[low] + CHARACTERS, side="right")) - 1, low + 1)
        found, size = _places_of_words(spelled[low:high], places)
        own = np.flatnonzero((words >= low) & (words < high))
        word = words[own] - low
        each = size[word]
        at = np.arange(each.sum()) + np.repeat((np.cumsum(size) - size)[word] - (np.cumsum(each) - each), each)
        out += np.bincount(np.repeat(rows[own] * places, each) + found[at], np.repeat(times[own], each), len(out))
        low = high
    return out.reshape(len(values), places)


def _weighed(at: np.ndarray, counts: np.ndarray, rows: int, idf: np.ndarray) -> np.ndarray:
    """Rows of (1 + ln tf) x idf at unit length, of counts at row x places + place."""
    out = np.zeros(rows * len(idf))
    out[at] = (1 + np.log(counts)) * idf[at % len(idf)]
    out = out.reshape(rows, len(idf))
    lengths = np.sqrt(np.einsum("ij,ij->i", out, out))[:, None]
    out /= np.where(lengths == 0, 1, lengths)
    return out


def matrix(values: list[str | None], idf: np.ndarray) -> np.ndarray:
    """Rows of the tf-idf matrix: (1 + ln tf) x idf, at unit length. Dense, for SLICE rows at a time."""
    counts = counted(values, len(idf)).ravel()
    at = np.flatnonzero(counts)
    return _weighed(at, counts[at], len(values), idf)


def _kinds(places: int) -> tuple[type, type]:
    """How hashed() packs steps from place to place, and counts."""
    return np.uint16 if places <= 1 << 16 else np.uint32, np.uint32


def hashed(places: int = PLACES) -> Callable[[Column], Column]:
    """A text column's grams, as struct (places, counts) of packed whole numbers, each place by its distance from the one before: what learn_hashed() learns from and embedder_of_hashed() gives vectors to."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for values in batches:
            packed: tuple[list[bytes], list[bytes]] = ([], [])
            for low in range(0, len(values), SLICE):
                for row in counted(values.slice(low, SLICE).to_pylist(), places):
                    at = np.flatnonzero(row)
                    for out, numbers, kind in zip(packed, (np.diff(at, prepend=0), row[at]), _kinds(places), strict=True):
                        out.append(numbers.astype(kind).tobytes())
            yield pa.StructArray.from_arrays([pa.array(x, pa.binary()) for x in packed], ["places", "counts"])

    return F.arrow_udf(run, "places binary, counts binary")


def _slices(tables: Iterator[pa.RecordBatch | pa.StructArray], places: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Of packed places and counts, SLICE rows at a time: row x places + place, counts, and how many rows."""
    kind, kind_of_counts = _kinds(places)
    for table in tables:
        for low in range(0, table.num_rows if isinstance(table, pa.RecordBatch) else len(table), SLICE):
            packed, counts = (c.slice(low, SLICE).to_pylist() for c in (table.columns if isinstance(table, pa.RecordBatch) else table.flatten()))
            sizes = np.array([len(p) // kind().itemsize for p in packed])
            reached = np.concatenate(([0], np.cumsum(np.frombuffer(b"".join(packed), kind), dtype=np.int64)))
            starts = np.arange(len(packed)) * places - reached[np.cumsum(sizes) - sizes]
            yield reached[1:] + np.repeat(starts, sizes), np.frombuffer(b"".join(counts), kind_of_counts), len(packed)


def learn_idf(rows: DataFrame, places: int) -> np.ndarray:
    """Smoothed idf by place, of packed rows: each task passes on its counts by place, which are summed."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(places, np.int64), 0
        for at, _, size in _slices(batches, places):
            n += size
            df += np.bincount(at % places, minlength=places)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, places)), pa.array(np.concatenate(([n], df)))], ["place", "df"])

    found = rows.mapInArrow(count, "place long, df long").groupBy("place").agg(F.sum("df").alias("df")).toArrow()
    df = np.zeros(places + 1)
    df[found.column("place").to_numpy() + 1] = found.column("df").to_numpy()
    return np.log((1 + df[0]) / (1 + df[1:])) + 1


def product(rows: DataFrame, idf: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """The matrix' transpose times the matrix times basis, of packed rows, summed over tasks by blocks of places."""
    width = basis.shape[1]
    shared = rows.sparkSession.sparkContext.broadcast((idf, basis))

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, basis = shared.value
        out = np.zeros((len(idf), width))
        for at, counts, size in _slices(batches, len(idf)):
            part = _weighed(at, counts, size, idf)
            out += part.T @ (part @ basis)
        starts = range(0, len(out), BLOCK)
        yield pa.RecordBatch.from_arrays([pa.array(list(starts), pa.int64()), pa.array([out[k : k + BLOCK].tobytes() for k in starts], pa.binary())], ["start", "sums"])

    def add(group: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(s, np.float64) for s in sorted(group.column("sums").to_pylist()))
        return pa.table({"start": group.column("start").slice(0, 1), "sums": pa.array([total.tobytes()], pa.binary())})

    blocks = rows.mapInArrow(multiply, "start long, sums binary").groupBy("start").applyInArrow(add, "start long, sums binary").collect()
    out = np.zeros((len(idf), width))
    for r in blocks:
        part = np.frombuffer(r["sums"], np.float64).reshape(-1, width)
        out[r["start"] : r["start"] + len(part)] = part
    return out


def learn(texts: DataFrame, column: str, dimensions: int = DIMENSIONS, places: int = PLACES, spare: int = SPARE, iterations: int = ITERATIONS, seed: int = 42) -> Embedding:
    """The embedding of a text column, whose grams are hashed once."""
    kept = written(texts.select(hashed(places)(F.col(column)).alias("grams")), "embedding-rows")
    model = learn_hashed(kept, "grams", dimensions, places, spare, iterations, seed)
    forget(kept)
    return model


def learn_hashed(rows: DataFrame, column: str, dimensions: int = DIMENSIONS, places: int = PLACES, spare: int = SPARE, iterations: int = ITERATIONS, seed: int = 42) -> Embedding:
    """learn() of a stored column that hashed() with as many places made. Every iteration is one pass over it; signs are set so that the largest entry of a vector is positive."""
    packed = rows.select(f"{column}.places", f"{column}.counts")
    idf = learn_idf(packed, places)
    basis, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((places, min(dimensions + spare, places))))
    for _ in range(iterations):
        basis, _ = np.linalg.qr(product(packed, idf, basis))
    inner = basis.T @ product(packed, idf, basis)
    squares, turn = np.linalg.eigh((inner + inner.T) / 2)
    first = np.argsort(-squares, kind="stable")[:dimensions]
    vectors = basis @ turn[:, first]
    vectors *= np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])] < 0, -1, 1)
    return Embedding(idf, vectors, np.sqrt(np.maximum(squares[first], 0)))


def _unit(vectors: np.ndarray) -> pa.Array:
    lengths = np.linalg.norm(vectors, axis=1, keepdims=True)
    flat = vectors / np.where(lengths == 0, 1, lengths)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1) * flat.shape[1], pa.int32()), pa.array(flat.ravel()))


def _joined(parts: list[pa.Array]) -> pa.Array:
    return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.float64()))


def embedder(spark: SparkSession, model: Embedding) -> Callable[[Column], Column]:
    """The slot of search: a text column's vectors (array of double) under the model, which is broadcast once."""
    shared = spark.sparkContext.broadcast((model.idf, model.basis))

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        idf, basis = shared.value
        for values in batches:
            yield _joined([_unit(matrix(values.slice(low, SLICE).to_pylist(), idf) @ basis) for low in range(0, len(values), SLICE)])

    return F.arrow_udf(run, "array<double>")


def embedder_of_hashed(spark: SparkSession, model: Embedding) -> Callable[[Column], Column]:
    """embedder() of the texts whose hashed() column it gets."""
    shared = spark.sparkContext.broadcast((model.idf, model.basis))

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        idf, basis = shared.value
        for values in batches:
            yield _joined([_unit(_weighed(at, counts, size, idf) @ basis) for at, counts, size in _slices([values], len(idf))])

    return F.arrow_udf(run, "array<double>")


def save(spark: SparkSession, model: Embedding, folder: str) -> None:
    row = (model.idf.tobytes(), model.basis.tobytes(), model.values.tobytes())
    spark.createDataFrame([row], "idf binary, basis binary, singular binary").write.mode("overwrite").parquet(folder)


def load(spark: SparkSession, folder: str) -> Embedding:
    r = spark.read.parquet(folder).first()
    idf, values = np.frombuffer(r["idf"]), np.frombuffer(r["singular"])
    return Embedding(idf, np.frombuffer(r["basis"]).reshape(len(idf), -1), values)


ship(__name__)
