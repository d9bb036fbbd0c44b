"""BPE encoding by forced boundaries, and decoding.

Two neighbouring bytes that no vocabulary token holds side by side can't be merged across, whatever stands around them: there
the text is cut for certain. A pre-token is cut at all such places, its fragments are encoded independently, each different
fragment once, and their ids are concatenated. So the work is that of short fragments, however long a pre-token is, and what
a worker remembers is bounded.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_names, ship

#: Pre-tokens and fragments that a worker remembers, the most characters of such, and rows of a batch that are worked on at a time.
MEMO, MEMO_CHARS, SLICE = 400_000, 64, 128
#: Symbols of a fragment from which merges are drawn from a heap; a number beyond all ids; what stands for no merge.
HEAP_FROM, WIDE, NONE = 24, 1 << 20, 1 << 60


def byte_letters() -> list[str]:
    """The published rule of byte-level vocabularies: printable Latin-1 bytes are their own letters, the others follow from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in plain]
    return [chr(b) if b in plain else chr(256 + others.index(b)) for b in range(256)]


class Encoder:
    """Ids of texts, as the tokenizers library gives them without special tokens around a text."""

    def __init__(self, definition: str):
        from tokenizers import Tokenizer

        parts = json.loads(definition)
        model = parts["model"]
        self.library = Tokenizer.from_str(definition)
        self.suffix, vocabulary = model["end_of_word_suffix"], model["vocab"]
        self.special = {t["content"]: t["id"] for t in parts["added_tokens"]}
        self.split_special = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")").split if self.special else None
        self.words = regex.compile(parts["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]).findall
        letters = byte_letters()
        self.letters, self.bytes_of = dict(enumerate(letters)), {c: b for b, c in enumerate(letters)}
        self.starts, self.ends = [vocabulary[c] for c in letters], [vocabulary[c + self.suffix] for c in letters]
        #: What a pair of ids (the left one times WIDE, plus the right one) becomes: its rank times WIDE, plus the new id.
        self.merges: dict[int, int] = {}
        for rank, merge in enumerate(model["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            self.merges[vocabulary[left] * WIDE + vocabulary[right]] = rank * WIDE + vocabulary[left + right]
        self.inside, self.ending = self.pairs(vocabulary)
        self.agreed: dict[str, bool] = {}
        self.memo: dict[str, tuple[int, ...]] = {}
        self.fragments_seen: dict[tuple[bytes, bool], tuple[int, ...]] = {}

    def pairs(self, vocabulary: dict[str, int]) -> tuple[bytearray, bytearray]:
        """By pair of bytes, whether some token holds it inside, and whether some token that ends a word ends with it."""
        inside, ending = bytearray(1 << 16), bytearray(1 << 16)
        for token in vocabulary:
            if token in self.special:
                continue
            ends = token.endswith(self.suffix) and len(token) > len(self.suffix)
            raw = [self.bytes_of[c] for c in (token[: -len(self.suffix)] if ends else token)]
            found = [a << 8 | b for a, b in zip(raw, raw[1:], strict=False)]
            if ends and found:
                ending[found.pop()] = 1
            for pair in found:
                inside[pair] = 1
        return inside, ending

    def fragments(self, raw: bytes) -> list[bytes]:
        """A pre-token's bytes, cut wherever no token spans; the last fragment is the one that ends the word."""
        inside, last = self.inside, len(raw) - 1
        cuts = [k for k in range(1, last) if not inside[raw[k - 1] << 8 | raw[k]]]
        if last > 0 and not self.ending[raw[last - 1] << 8 | raw[last]]:
            cuts.append(last)
        return [raw[a:b] for a, b in zip([0, *cuts], [*cuts, len(raw)], strict=True)] if cuts else [raw]

    def merged(self, fragment: bytes, ends: bool) -> tuple[int, ...]:
        """The ids of a fragment: the pair of the best rank, leftmost of equals, is merged until none is left."""
        starts = self.starts
        ids = [starts[b] for b in fragment]
        if ends:
            ids[-1] = self.ends[fragment[-1]]
        if len(ids) >= HEAP_FROM:
            return tuple(self.merged_by_heap(ids))
        get = self.merges.get
        found = [get(a * WIDE + b, NONE) for a, b in zip(ids, ids[1:], strict=False)]
        while found and (best := min(found)) < NONE:
            k = found.index(best)
            ids[k] = best % WIDE
            del ids[k + 1], found[k]
            if k:
                found[k - 1] = get(ids[k - 1] * WIDE + ids[k], NONE)
            if k < len(found):
                found[k] = get(ids[k] * WIDE + ids[k + 1], NONE)
        return tuple(ids)

    def merged_by_heap(self, ids: list[int]) -> list[int]:
        get, n = self.merges.get, len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        waiting = [(best // WIDE, k, best) for k, (a, b) in enumerate(zip(ids, ids[1:], strict=False)) if (best := get(a * WIDE + b)) is not None]
        heapq.heapify(waiting)
        while waiting:
            _, k, best = heapq.heappop(waiting)
            right = after[k]
            if ids[k] < 0 or right >= n or get(ids[k] * WIDE + ids[right]) != best:
                continue
            ids[k], ids[right], after[k] = best % WIDE, -1, after[right]
            if after[k] < n:
                before[after[k]] = k
            for left in (before[k], k):
                if left >= 0 and after[left] < n and (more := get(ids[left] * WIDE + ids[after[left]])) is not None:
                    heapq.heappush(waiting, (more // WIDE, left, more))
        return [i for i in ids if i >= 0]

    def fragment_ids(self, fragment: bytes, ends: bool) -> tuple[int, ...]:
        key = (fragment, ends)
        if (known := self.fragments_seen.get(key)) is None:
            known = self.merged(fragment, ends)
            if len(fragment) <= MEMO_CHARS:
                if len(self.fragments_seen) >= MEMO:
                    self.fragments_seen.clear()
                self.fragments_seen[key] = known
        return known

    def raw_ids(self, raw: bytes) -> tuple[int, ...]:
        """The ids of a pre-token's bytes, as they stand in the normalised text."""
        *starts, last = self.fragments(raw)
        if not starts:
            return self.merged(last, True)
        return (*[i for fragment in starts for i in self.fragment_ids(fragment, False)], *self.fragment_ids(last, True))

    def word_ids(self, word: str) -> tuple[int, ...]:
        found = self.raw_ids(word.encode("utf-8", "surrogatepass"))
        if len(word) <= MEMO_CHARS:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            self.memo[word] = found
        return found

    def agrees(self, c: str) -> bool:
        """Whether this process' character tables treat c as the library's do: its class, its small letter, how it composes and orders."""
        if unicodedata.category(c) == "Cn":
            return False
        lib = self.library
        for probe in (c, "́" + c, c + "̧", "a" + c + c + "1"):
            own = small(probe)
            theirs = lib.normalizer.normalize_str(probe)
            if regex.sub(r"\s+", " ", own) != theirs or [w.encode() for w in self.words(own)] != self.library_words(theirs):
                return False
        return True

    def library_words(self, normal: str) -> list[bytes]:
        return [bytes(map(self.bytes_of.__getitem__, w)) for w, _ in self.library.pre_tokenizer.pre_tokenize_str(normal)]

    def pre_tokens(self, text: str) -> list[str] | None:
        """The pre-tokens of a text without special strings; None if it holds a character on which tables differ."""
        if text.isascii():
            return self.words(text.lower())
        agreed = self.agreed
        for c in set(text):
            if c not in agreed:
                agreed[c] = c.isascii() or self.agrees(c)
            if not agreed[c]:
                return None
        return self.words(small(text))

    def ids(self, text: str) -> list[int]:
        out: list[int] = []
        known, add = self.memo.get, out.extend
        for part in self.split_special(text) if self.split_special else [text]:
            if part in self.special:
                out.append(self.special[part])
                continue
            if (words := self.pre_tokens(part)) is None:
                for raw in self.library_words(self.library.normalizer.normalize_str(part)):
                    add(self.raw_ids(raw))
                continue
            for word in words:
                add(known(word) or self.word_ids(word))
        return out


def small(text: str) -> str:
    """Composed, in small letters, character by character: a sigma at a word's end is like any other."""
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


def check_definition(definition: str) -> None:
    """Only byte-level BPE with word ends over composed small letters is encoded right here; anything else is refused."""
    parts = json.loads(definition)
    model, splits = parts["model"], (parts["pre_tokenizer"] or {}).get("pretokenizers") or [{}, {}]
    steps = [s["type"] for s in (parts["normalizer"] or {}).get("normalizers", [])]
    fits = (
        model["type"] == "BPE" and model.get("end_of_word_suffix") and not model.get("dropout") and not model.get("ignore_merges") and not model.get("continuing_subword_prefix")
        and steps == ["NFC", "Replace", "Lowercase"] and [s.get("type") for s in splits] == ["Split", "ByteLevel"] and splits[0]["behavior"] == "Removed" and splits[0]["invert"]
        and not splits[1]["add_prefix_space"] and not splits[1]["use_regex"] and parts["decoder"] is None
        and all(not t["lstrip"] and not t["rstrip"] and not t["single_word"] and not t["normalized"] for t in parts["added_tokens"])
        and all(c + end in model["vocab"] for c in byte_letters() for end in ("", model["end_of_word_suffix"]))
    )
    if not fits:
        raise ValueError("this encoder needs a byte-level BPE vocabulary with word ends, small letters and no decoder")


def encode(docs: DataFrame, vocabulary: str, name: str = "ids") -> DataFrame:
    """docs without text and with an array of token ids. vocabulary: the path of a .json file on the driver. Null texts have no ids."""
    definition = Path(vocabulary).read_text()
    check_definition(definition)
    shared = docs.sparkSession.sparkContext.broadcast(definition)
    own, text = free_names(docs, "bpe_row", "bpe_text")
    rest = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    rows = docs.select(F.struct(*rest).alias(own), F.col("text").alias(text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for whole in batches:
            for low in range(0, whole.num_rows, SLICE):
                batch = whole.slice(low, SLICE)
                flat, ends = [], [0]
                for value in batch.column(1):
                    flat.extend(encoder.ids(value.as_py() or ""))
                    ends.append(len(flat))
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.array(flat, np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0), ids], [own, "ids"])

    schema = T.StructType([rows.schema[own], T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return rows.mapInArrow(run, schema).select(f"{own}.*", F.col("ids").alias(name))


def decode(ids: Column, vocabulary: str) -> Column:
    """The texts of arrays of ids: tokens as the vocabulary spells them with a blank between, special ones too; unknown ids have none."""
    definition = Path(vocabulary).read_text()
    check_definition(definition)
    parts = json.loads(definition)
    spelled = parts["model"]["vocab"] | {t["content"]: t["id"] for t in parts["added_tokens"]}
    tokens: list[str | None] = [None] * (max(spelled.values()) + 2)
    for token, i in spelled.items():
        tokens[i] = token

    def run(lists: pa.Array) -> pa.Array:
        known, last, joined = pa.array(tokens, pa.string()), len(tokens) - 1, [pa.array([], pa.string())]
        for low in range(0, len(lists), SLICE):
            part = lists.slice(low, SLICE)
            ids = part.flatten()
            inside = pc.and_(pc.greater_equal(ids, 0), pc.less(ids, last))
            spelled = pc.take(known, pc.if_else(inside, ids, last))
            ends = np.concatenate(([0], np.cumsum(pc.fill_null(pc.list_value_length(part), 0).to_numpy(zero_copy_only=False))))
            there = np.concatenate(([0], np.cumsum(pc.is_valid(spelled).to_numpy(zero_copy_only=False))))
            joined.append(pc.binary_join(pa.ListArray.from_arrays(pa.array(there[ends], pa.int32()), spelled.drop_null()), " "))
        return pa.concat_arrays(joined)

    return F.arrow_udf(run, "string")(ids)


def encoded_table(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256.

    Null and empty texts have no ids and decode to the empty text; very long texts and words are encoded whole; special
    strings inside texts are their tokens; ids may be null or repeat, each row is encoded. An empty table gives no rows. Only
    doc_id and text are read, so other columns can't clash.
    """
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("word_bpe_49k.json")
    encoded = encode(docs.select("doc_id", "text"), vocabulary)
    spelled = F.array_join(F.col("ids").cast("array<string>"), " ")
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(spelled, 256).alias("ids_sha256"), F.sha2(decode(F.col("ids"), vocabulary), 256).alias("decoded_sha256"))


ship(__name__)
