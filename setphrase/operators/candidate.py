"""Candidate phrases and their matches as values, beside the columns that ``formulas`` makes of them."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Row, SparkSession

from setphrase.functions.tokens import VAR


@dataclass(frozen=True)
class CandidatePhrase:
    """Words of a phrase; an open slot is ``<VAR>``. Its length is its number of words."""

    words: tuple[str, ...]

    @classmethod
    def of(cls, phrase: str | Iterable[object]) -> CandidatePhrase:
        """From a string (split at blanks) or a sequence of strings, tokens (with an attribute or field ``n``) and None, which is a slot."""
        if isinstance(phrase, str):
            return cls(tuple(phrase.split(" ")))
        return cls(tuple(VAR if w is None else _label(w) for w in phrase))

    @property
    def text(self) -> str:
        return " ".join(self.words)

    @property
    def slots(self) -> tuple[int, ...]:
        return tuple(i for i, w in enumerate(self.words) if w == VAR)

    def __len__(self) -> int:
        return len(self.words)

    def __str__(self) -> str:
        return self.text


def _label(word: object) -> str:
    if isinstance(word, str):
        return word
    label = word["n"] if isinstance(word, (dict, Row)) else getattr(word, "n", None)
    if not isinstance(label, str):
        raise TypeError(f"not a word: {word!r}")
    return label


@dataclass(frozen=True)
class CandidateMatch:
    """Where a candidate stands in a document; its length is that of the phrase as text."""

    candidate: CandidatePhrase
    doc_id: object = None
    word_start: int | None = None
    char_start: int | None = None
    variable_match: Sequence[str] = field(default=())

    @property
    def word_end(self) -> int | None:
        return None if self.word_start is None else self.word_start + len(self.candidate)

    @property
    def char_end(self) -> int | None:
        return None if self.char_start is None else self.char_start + len(self.candidate.text)

    @property
    def variable_terms(self) -> list[str]:
        """The document's words at the open slots."""
        return [self.variable_match[i] for i in self.candidate.slots] if self.variable_match else []

    def __len__(self) -> int:
        return len(self.candidate.text)


def frame(spark: SparkSession, candidates: Iterable[CandidatePhrase]) -> DataFrame:
    """(phrase) of candidates, as ``formulas`` takes them."""
    return spark.createDataFrame([(c.text,) for c in candidates], "phrase string")


def of_row(match: Row) -> CandidateMatch:
    """A collected row of ``formulas`` as a value."""
    return CandidateMatch(CandidatePhrase(tuple(match["terms"])), match["doc_id"], match["word_start"], match["char_start"] if "char_start" in match else None, tuple(match["variable_match"]))
