"""Text cleaning and keys as column expressions.

The cleaners need HTML unescaping and NFKC, which Spark lacks, so their texts go to Python anyway: all steps run there, in
one Arrow pass, and a step's regular expression only runs on texts that hold what it looks for.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sorrel.scratch import ship

#: What the cleaners remove or shorten.
TAGS, URLS = r"<[^>]+>", r"https?://\S+|www\.\S+"
EMAILS = r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+"
PHONES = r"\b(?:\d{2,3}[-.\s]?\d{3,4}[-.\s]?\d{4})\b"
ZERO_WIDTH = "".join(map(chr, (0x200B, 0x200C, 0x200D, 0xFEFF)))
CONTROLS = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"

Rule = tuple[re.Pattern, str, Callable[[str], bool]]


def holds(*marks: str) -> Callable[[str], bool]:
    return lambda value: any(m in value for m in marks)


def beyond_ascii(value: str) -> bool:
    return not value.isascii()


def may_hold_digits(value: str) -> bool:
    return not value.isascii() or any(d in value for d in "0123456789")


def blank(pattern: str, where: Callable[[str], bool]) -> Rule:
    return re.compile(pattern), " ", where


def shorten(group: str, least: int, to: int, where: Callable[[str], bool] = beyond_ascii) -> Rule:
    """Runs of least or more of one character of the group become to of it."""
    return re.compile(rf"({group})\1{{{least - 1},}}"), r"\1" * to, where


REMOVALS = (
    blank(TAGS, holds("<")), blank(URLS, holds("http", "www.")), blank(EMAILS, holds("@")), blank(PHONES, may_hold_digits),
    (re.compile(f"[{ZERO_WIDTH}]"), "", beyond_ascii),
)
LAUGHS = (shorten("ㅋ", 5, 4), shorten("ㅎ", 5, 4))
MARKS = (shorten("[!?]", 3, 3, holds("!!!", "???")), shorten(r"\.", 3, 3, holds("...")))

#: The cleaners' steps between unescaping and the squeezing of white space, in order.
DOCUMENT_RULES = (*REMOVALS, *LAUGHS, *MARKS)
SENTIMENT_RULES = (*REMOVALS, blank(CONTROLS, lambda value: True), *MARKS, *LAUGHS, shorten("[ㅠㅜ]", 5, 4), shorten("[가-힣]", 4, 2))


def apply_rules(value: str, rules: tuple[Rule, ...]) -> str:
    for pattern, to, where in rules:
        if where(value):
            value = pattern.sub(to, value)
    return " ".join(value.split())


def document_text(value: str | None) -> str:
    """The document cleaner: null and "nan" are empty; entities are resolved before tags are looked for."""
    if value is None or value.lower() == "nan":
        return ""
    value = html.unescape(value)
    return apply_rules(value if value.isascii() else unicodedata.normalize("NFKC", value), DOCUMENT_RULES)


def sentiment_text(value: str | None) -> str:
    """The classifier's cleaner; it also shortens runs of Hangul syllables. Null counts as the text None."""
    return apply_rules(html.unescape("None" if value is None else value).strip(), SENTIMENT_RULES)


def clean_columns(rows: DataFrame, names: tuple[str, ...], lists: tuple[str, ...] = (), clean: Callable[[str | None], str] = document_text) -> DataFrame:
    """rows with the named text columns, and the texts of the named array columns, cleaned: all in one Arrow pass over the rows.

    What follows sees plain columns, so no cleaning is done twice, however often a cleaned column is used.
    """
    columns = rows.columns

    def one(name: str, column: pa.Array) -> pa.Array:
        if name in names:
            return pa.array([clean(v.as_py()) for v in column], pa.string())
        if name in lists:
            return pa.array([None if v is None else [clean(x) for x in v] for v in column.to_pylist()], pa.list_(pa.string()))
        return column

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, 256):
                batch = whole.slice(low, 256)
                yield pa.RecordBatch.from_arrays([one(c, batch.column(k)) for k, c in enumerate(columns)], columns)

    return rows.mapInArrow(run, rows.schema)


def _mapped(clean: Callable[[str | None], str]) -> Callable[[pd.Series], pd.Series]:
    def run(values: pd.Series) -> pd.Series:
        return pd.Series([clean(v) for v in values], dtype=object)

    return run


def clean_document(c: Column) -> Column:
    return F.pandas_udf(_mapped(document_text), "string")(c)


def clean_sentiment(c: Column) -> Column:
    return F.pandas_udf(_mapped(sentiment_text), "string")(c)


def strip(c: Column) -> Column:
    """Without Unicode white space at either end; trim() only takes blanks."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def squeeze(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def blanked(pattern: str):
    return lambda c: F.regexp_replace(c, pattern, " ")


def run_steps(c: Column, steps) -> Column:
    return reduce(lambda value, step: step(value), steps, c)


def fingerprint(c: Column) -> Column:
    """Lower-case ASCII letters, digits and Hangul syllables of a text."""
    return F.regexp_replace(F.lower(c), "[^0-9a-z가-힣]", "")


def fingerprint_any(c: Column) -> Column:
    """Lower-case letters and numbers of any script."""
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", "")


def fingerprint_prefix(c: Column, length: int = 200) -> Column:
    return F.substring(fingerprint(c), 1, length)


def meaningful_chars(c: Column) -> Column:
    return F.length(F.regexp_replace(c, "[^0-9A-Za-z가-힣]", ""))


def has_signal(c: Column, length: int = 10, meaningful: int = 10) -> Column:
    return (F.length(c) >= length) & (meaningful_chars(c) >= meaningful)


def tokens(c: Column) -> Column:
    """Words of letters and numbers in lower case: the standard analyzer."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def tokens_cased(c: Column) -> Column:
    """Words without lower-casing: the slot of a morphological analyzer that has no filters."""
    return F.regexp_extract_all(c, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def hangul_bigrams(c: Column) -> Column:
    """Words, with runs of Hangul as overlapping pairs, so that a stem matches under any particle."""
    words = F.regexp_extract_all(F.lower(c), F.lit(r"[가-힣]+|[\p{L}\p{N}&&[^가-힣]]+"), F.lit(0))
    pairs = F.transform(words, lambda w: F.when(w.rlike("^[가-힣]{3,}$"), F.transform(F.sequence(F.lit(1), F.length(w) - 1), lambda k: w.substr(k, F.lit(2)))).otherwise(F.array(w)))
    return F.flatten(pairs)


def char_wb_ngrams(c: Column, low: int = 2, high: int = 5) -> Column:
    """Character n-grams within words padded by a blank on each side. A word shorter than n gives itself once, padded."""
    words = F.filter(F.split(F.regexp_replace(F.lower(c), r"(?U)\s+", " "), " "), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit(" "), w, F.lit(" ")))
    grams = lambda w, n: F.when(F.length(w) > n, F.transform(F.sequence(F.lit(1), F.length(w) - n + 1), lambda k: w.substr(k, F.lit(n))))
    sizes = F.sequence(F.lit(low), F.lit(high))
    longer = F.transform(padded, lambda w: F.flatten(F.filter(F.transform(sizes, lambda n: grams(w, n)), lambda g: g.isNotNull())))
    whole = F.transform(padded, lambda w: F.when(F.length(w) <= high, F.array(w)).otherwise(F.array().cast("array<string>")))
    return F.concat(F.flatten(longer), F.flatten(whole))


def _count_grams(value: str | None, low: int, high: int) -> Counter:
    counts: Counter = Counter()
    for word, times in Counter((value or "").lower().split()).items():
        word = f" {word} "
        for n in range(low, min(high, len(word) - 1) + 1):
            for k in range(len(word) - n + 1):
                counts[word[k : k + n]] += times
        if len(word) <= high:
            counts[word] += times
    return counts


def char_wb_counts(c: Column, low: int = 2, high: int = 5) -> Column:
    """(terms, tfs): the different grams of char_wb_ngrams and how often each occurs, counted in Arrow batches."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for values in batches:
            for start in range(0, len(values), 64):  # a whole batch of counts would fill the worker's memory
                counted = [_count_grams(v, low, high) for v in values.iloc[start : start + 64]]
                yield pd.DataFrame({"terms": [list(x) for x in counted], "tfs": [list(x.values()) for x in counted]})

    return F.pandas_udf(run, "terms array<string>, tfs array<int>")(c)


def contains_any(c: Column, terms: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(c, F.lit(t)) for t in terms], F.lit(False))


def truncated(c: Column, length: int) -> Column:
    return F.when(F.length(c) > length, F.regexp_replace(F.substring(c, 1, length), r"(?U)\s+$", "")).otherwise(c)


def labelled_lines(pairs: list[tuple[str, Column]]) -> Column:
    """label: value lines, in order, without those whose value is null or blank."""
    edges = lambda v: F.concat(F.substring(v, 1, 1), F.substring(v, -1, 1))
    bare = lambda v: F.when(edges(v).rlike(r"(?U)\s"), strip(v)).otherwise(v)  # noqa: E731  most values need no pass over the whole text
    lines = [F.when(v.rlike(r"(?U)\S"), F.concat(F.lit(f"{label}: "), bare(v))) for label, v in pairs]
    return F.concat_ws("\n", *lines)


def joined(items: Column, separator: str) -> Column:
    return F.array_join(F.filter(items, lambda x: x.isNotNull() & (x != "")), separator)


def dense_text(d: dict[str, Column]) -> Column:
    """The one labelled text that stands for a document in dense retrieval. d maps field names to columns.

    The labels are fixed values, in the order in which lines stand.
    """
    sentiments = F.transform(d["issue_sentiments"], lambda s: joined(F.array(strip(s["issue_category"]), strip(s["sentiment"]), strip(s["evidence"])), " | "))
    blank = lambda v: F.coalesce(v, F.lit(""))
    asked = F.filter(d["review_survey_answers"], lambda s: (blank(s["question"]) != "") | (blank(s["answer"]) != ""))
    answers = F.transform(asked, lambda s: F.btrim(F.concat(blank(s["question"]), F.lit(": "), blank(s["answer"])), F.lit(": ")))
    return labelled_lines([
        ("상품명", d["product_name"]), ("옵션명", d["item_name"]), ("제목", d["title"]), ("본문", d["content"]), ("요약", d["short_summary"]),
        ("이슈 카테고리", joined(d["issue_category"], ", ")), ("관점 키워드", joined(d["aspect_keywords"], ", ")),
        ("이슈별 감성", F.array_join(sentiments, " / ")), ("설문 응답", F.array_join(answers, " / ")),
    ])


def float_tag(value: float) -> str:
    """A number in a file name: shortest form, m for minus, p for the point."""
    return f"{value:g}".translate(str.maketrans("-.", "mp"))


ship(__name__)
