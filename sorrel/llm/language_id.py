"""Language identification by compression.

A text is encoded with each language's raw-content zstandard dictionary; the language that makes it smallest wins, and a
narrow margin is rejected. Encoding is by pieces of PIECE characters of the whole text, so that the dictionary matters
all the way through a long text and not only at its start.

A dictionary is learned from a bounded sample: SAMPLE_ROWS different texts of its language, each whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import exp

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import fold_held_out, ship

#: The sample that dictionaries are made of: different texts of each language.
SAMPLE_ROWS = 32
#: Rows of a batch that are read at a time; parts of a language that are ranked by themselves.
SLICE, PARTS = 256, 64
PIECE, LEVEL = 1500, 12
#: A decision is rejected if the second language needs less than this share more bytes; bytes per unit of log odds.
NARROW, SCALE = 0.005, 4.0
UNKNOWN = "und"


def letters(text: str | None) -> str:
    """Lower-case letters, with one blank for whatever stands between them; blank if there is no letter."""
    return regex.sub(r"[^\p{L}]+", " ", text or "").strip().lower()


def train_dictionaries(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS) -> dict[str, bytes]:
    """A dictionary for each language, from up to sample_rows different texts of (text, lang), those of the least hashes.

    Rows without text or language are left out, copies of a text count once. Hashes are made distinct and ranked without
    the texts, of which only the chosen ones are then read; the driver gets their letters. What it holds grows with the number
    of languages, of which every worker must hold a dictionary anyway.
    """
    labelled = labelled.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("lang", F.xxhash64("text").alias("place"), "text")
    least = lambda rows, *by: rows.withColumn("nth", F.row_number().over(Window.partitionBy(*by).orderBy("place"))).where(F.col("nth") <= sample_rows)
    places = labelled.select("lang", "place").distinct().withColumn("part", F.pmod("place", F.lit(PARTS)))
    chosen = least(least(places, "lang", "part").select("lang", "place"), "lang")  # first in parts, as a language may have most rows
    texts = labelled.join(F.broadcast(chosen), ["lang", "place"]).groupBy("lang", "nth").agg(F.min("text").alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("nth"), pa.array([letters(t.as_py()) for t in batch.column("text")], pa.string())], ["lang", "nth", "body"])

    bodies: dict[str, list[str]] = {}
    for r in sorted(texts.mapInArrow(cut, "lang string, nth int, body string").collect()):
        bodies.setdefault(r["lang"], []).append(r["body"])
    joined = {lang: " ".join(b for b in parts if b) for lang, parts in bodies.items()}
    return {lang: body.encode() for lang, body in joined.items() if body}


class Compressors:
    def __init__(self, dictionaries: dict[str, bytes]):
        self.names = sorted(dictionaries)
        self.encoders = []
        for name in self.names:
            raw = zstandard.ZstdCompressionDict(dictionaries[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            raw.precompute_compress(level=LEVEL)
            self.encoders.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=raw, write_checksum=False, write_content_size=False, write_dict_id=False))

    def sizes(self, body: str) -> list[int]:
        pieces = [body[k : k + PIECE].encode() for k in range(0, len(body), PIECE)]
        return [sum(len(e.compress(p)) for p in pieces) for e in self.encoders]

    def classify(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score, rejected). Without a letter, or without any language, it is und with score 0."""
        body = letters(text)
        if not body or not self.names:
            return UNKNOWN, 0.0, True
        sizes = self.sizes(body)
        best = min(sizes)
        score = 1 / sum(exp((best - s) / SCALE) for s in sizes)
        rest = sorted(sizes)[1:]
        return self.names[sizes.index(best)], score, bool(rest) and rest[0] - best < NARROW * best


def classify_languages(docs: DataFrame, dictionaries: dict[str, bytes], keep: list[Column]) -> DataFrame:
    """keep's columns and lang_pred, score, rejected for each row of docs; reads only text. No row moves."""
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)
    kept = docs.select(*keep, F.col("text").alias("lang_text"))
    names = [f.name for f in kept.schema.fields[:-1]]
    schema = kept.drop("lang_text").schema.add("lang_pred", "string").add("score", "double").add("rejected", "boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Compressors(shared.value)
        for whole in batches:
            for low in range(0, whole.num_rows, SLICE):
                batch = whole.slice(low, SLICE)
                found = [model.classify(t.as_py()) for t in batch.column("lang_text")]
                added = [pa.array([f[k] for f in found], kind) for k, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]
                yield pa.RecordBatch.from_arrays([batch.column(n) for n in names] + added, [*names, "lang_pred", "score", "rejected"])

    return kept.mapInArrow(run, schema)


def language_table(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, rejected.

    Learns from the folds that are not held out. lang_pred is the smallest language even where the margin is narrow
    (rejected tells), and und only for texts without a letter, null ones among them, or where nothing could be learned.
    Equal sizes: first by name. Very long texts are encoded whole; repeated rows are predicted each and learned once. An
    empty table gives no rows. Only doc_id, text and, to learn, lang are read, so other columns can't clash.
    """
    held = fold_held_out(F.col("doc_id"))
    dictionaries = train_dictionaries(docs.where(~held).select("text", "lang"))
    return classify_languages(docs, dictionaries, [F.col("doc_id"), held.alias("held_out")])


ship(__name__)
