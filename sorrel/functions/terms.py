"""Which of many terms a text holds, in one pass over the text, whatever the size of the vocabulary."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from sorrel.scratch import ship


class Finder:
    """The terms of a vocabulary that stand anywhere in a text, parts of words and overlapping ones too: an Aho-Corasick automaton, or a search for each term where that library isn't there."""

    def __init__(self, terms: Iterable[str]):
        self.terms = sorted(set(terms) - {""})
        try:
            import ahocorasick
        except ImportError:
            self.machine = None
            return
        self.machine = ahocorasick.Automaton()
        for term in self.terms:
            self.machine.add_word(term, term)
        if self.terms:
            self.machine.make_automaton()

    def found(self, value: str | None) -> set[str]:
        if not value or not self.terms:
            return set()
        if self.machine is None:
            return {t for t in self.terms if t in value}
        return {term for _, term in self.machine.iter(value)}


def by_terms(terms: Iterable[str], tell: Callable[[str | None, set[str]], dict | list | str | None], kind: str) -> Callable[[Column], Column]:
    """A function of a text column: tell(text, the terms that it holds) for each row, as the named Spark type. One plan node for any vocabulary."""
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    vocabulary, arrow = sorted(set(terms)), to_arrow_type(_parse_datatype_string(kind))

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        finder = Finder(vocabulary)
        for values in batches:
            yield pa.array([tell(v, finder.found(v)) for v in values.to_pylist()], arrow)

    return F.arrow_udf(run, kind)


ship(__name__)
