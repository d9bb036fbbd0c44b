"""Token counts of a byte-level BPE vocabulary, without materialising ids.

The pre-tokens of all texts are counted into a table of distinct ones, and the pieces of each are counted once. That table
is joined to the pre-token frequencies of every document, and the products are summed. The common pre-tokens of the table,
those with more than a COMMON-th of all occurrences, are broadcast and joined within the tasks that read the texts: there
are fewer than COMMON of them at any size. What a document has besides is joined by a shuffle on the pre-token, which
without the common ones has no heavy keys.
"""

from __future__ import annotations

import json
import unicodedata
from collections import Counter
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ship, written

#: Fixed value: the published pattern that byte-level BPE splits texts by.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LIMIT = 512
#: Different pre-tokens that a task counts before it passes them on; the bound of those that are broadcast, and their most characters.
MEMO, COMMON, COMMON_CHARS = 500_000, 1_000_000, 64
REST_TYPE = T.ArrayType(T.StructType([T.StructField("token", T.StringType()), T.StructField("times", T.LongType())]))
REST = pa.list_(pa.struct([("token", pa.string()), ("times", pa.int64())]))
#: Rows of a batch that are read at a time.
SLICE = 256


class PieceCounter:
    """Pre-tokens of texts and pieces of pre-tokens, as the tokenizers library gives them."""

    def __init__(self, definition: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the executor's cores are taken by other tasks
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        added = [t["content"] for t in json.loads(definition)["added_tokens"]]
        self.special = regex.compile("|".join(regex.escape(t) for t in sorted(added, key=len, reverse=True))) if added else None
        self.split = regex.compile(PATTERN).findall
        self.assigned: dict[str, bool] = {}

    def pre_tokens(self, text: str) -> list[str]:
        """The library's own pre-tokens. Its tables and regex's differ on characters that Unicode assigned of late; texts that hold such go through the library itself."""
        if not text.isascii():
            known = self.assigned
            for c in set(text):
                if c not in known:
                    known[c] = unicodedata.category(c) != "Cn"
                if not known[c]:
                    return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]
        return self.split(text)

    def add(self, text: str, counts: Counter) -> int:
        """Add a text's pre-tokens to counts; returns how many special strings stand in it: by default each is one token."""
        if self.special is None or not (found := len(self.special.findall(text))):
            counts.update(self.pre_tokens(text))
            return 0
        for part in self.special.split(text):
            counts.update(self.pre_tokens(part))
        return found

    def frequencies(self, text: str) -> tuple[Counter, int]:
        counts: Counter = Counter()
        return counts, self.add(text, counts)

    def pieces(self, tokens: list[str]) -> list[int]:
        return [len(e) for k in range(0, len(tokens), 20_000) for e in self.tokenizer.encode_batch_fast(tokens[k : k + 20_000], add_special_tokens=False)]


def check_definition(definition: str) -> None:
    """Only byte-level BPE by the published pattern is split right by PATTERN; anything else is refused."""
    parts = json.loads(definition)
    split = parts["pre_tokenizer"] or {}
    plain = all(not t["lstrip"] and not t["rstrip"] and not t["single_word"] for t in parts["added_tokens"])
    if split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True) or parts["normalizer"] or not plain:
        raise ValueError("token counts need a byte-level BPE vocabulary without a normalizer or prefix space")


def pre_token_table(docs: DataFrame, definition: str) -> DataFrame:
    """(token, times, pieces), written: every distinct pre-token of docs' texts, how often it stands, and its pieces, counted once."""
    shared = docs.sparkSession.sparkContext.broadcast(definition)

    def batch_of(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["token", "times"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, counts = PieceCounter(shared.value), Counter()
        for batch in batches:
            for text in batch.column("text"):
                if body := text.as_py():
                    counter.add(body, counts)
                    if len(counts) >= MEMO:
                        yield batch_of(counts)
                        counts = Counter()
        yield batch_of(counts)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PieceCounter(shared.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("token"), batch.column("times"), pa.array(counter.pieces(batch.column("token").to_pylist()), pa.int32())], ["token", "times", "pieces"])

    distinct = docs.select("text").mapInArrow(count, "token string, times long").groupBy("token").agg(F.sum("times").alias("times"))
    return written(distinct.mapInArrow(encode, "token string, times long, pieces int"), "pre-tokens")


def count_tokens(docs: DataFrame, vocabulary: str, keep: list[Column], limit: int = LIMIT, common: int = COMMON) -> DataFrame:
    """keep's columns and n_bytes, n_tokens, over_limit for each row of docs. vocabulary: the path of a .json file on the driver.

    common: pre-tokens with more than a common-th of all occurrences are broadcast; the result is the same for any number.
    """
    definition = Path(vocabulary).read_text()
    check_definition(definition)
    context = docs.sparkSession.sparkContext
    pieces = pre_token_table(docs, definition)
    distinct, total = pieces.agg(F.count(F.lit(1)), F.coalesce(F.sum("times"), F.lit(0))).first()
    short = pieces.where((F.col("times") * common > total) & (F.length("token") <= COMMON_CHARS))
    chosen = {r["token"]: r["pieces"] for r in short.select("token", "pieces").collect()}
    whole = distinct == len(chosen)
    shared, known = context.broadcast(definition), context.broadcast(chosen)
    sizes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    kept = docs.select(F.struct(*keep).alias("token_row"), sizes.alias("n_bytes"), F.col("text").alias("token_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, lookup = PieceCounter(shared.value), known.value.get
        for whole_batch in batches:
            for low in range(0, whole_batch.num_rows, SLICE):
                batch, sums, rests = whole_batch.slice(low, SLICE), [], []
                for text in batch.column("token_text"):
                    tally, total = counter.frequencies(text.as_py() or "")
                    rest = []
                    for token, times in tally.items():
                        n = lookup(token)
                        if n is None:
                            rest.append({"token": token, "times": times})
                        else:
                            total += n * times
                    sums.append(total)
                    rests.append(rest)
                yield pa.RecordBatch.from_arrays([batch.column("token_row"), batch.column("n_bytes"), pa.array(sums, pa.int64()), pa.array(rests, REST)], ["token_row", "n_bytes", "n_known", "rest"])

    schema = kept.drop("token_text").schema.add("n_known", "long").add("rest", REST_TYPE)
    counted = kept.mapInArrow(run, schema)
    n_tokens = F.col("n_known")
    if not whole:
        counted = written(counted.withColumn("token_doc", F.monotonically_increasing_id()), "token-documents")
        rare = counted.select("token_doc", F.explode("rest").alias("r")).select("token_doc", "r.token", "r.times")
        sums = rare.join(pieces.select("token", "pieces"), "token").groupBy("token_doc").agg(F.sum(F.col("times") * F.col("pieces")).alias("n_rare"))
        counted = counted.drop("rest").join(sums, "token_doc", "left")
        n_tokens = n_tokens + F.coalesce("n_rare", F.lit(0))
    return counted.withColumn("n_tokens", n_tokens).select("token_row.*", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def token_table(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit.

    Null and empty texts have 0 bytes and tokens; very long texts and pre-tokens are counted whole; ids may be null or
    repeat, each row is counted. An empty table gives no rows. Only doc_id and text are read, so other columns can't clash.
    """
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    return count_tokens(docs, vocabulary, [F.col("doc_id")])


ship(__name__)
