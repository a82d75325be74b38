"""The facade: parameters and the DataFrames that they define, all lazy."""

from __future__ import annotations

from functools import cached_property

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from setphrase.functions.lineage import cut, sized
from setphrase.operators import blocks, cooc, formulas, vocab


class PhraseSearch:
    """Formulaic phrases of a corpus (doc_id, tokens).

    ``persist`` keeps the vocabulary, counts it, and pairs and selected tokens are then found by
    ``blocks`` of documents, unless it has more than blocks.MOST_TERMS terms. Else, and without
    ``persist``, tokens are rows.
    """

    def __init__(self, docs: DataFrame, min_term_freq: int = 1, skip_size: int = 4, min_cooc_freq: int | None = None, min_neighbour_cooc: int | None = None, enforce_max_term_frac: float | None = None, persist: bool = True):
        if not isinstance(docs, DataFrame):
            raise TypeError("docs must be a DataFrame of (doc_id, tokens)")
        self.docs, self.min_term_freq, self.skip_size = docs, min_term_freq, skip_size
        self.min_cooc_freq, self.min_neighbour_cooc, self.max_frac, self.persist = min_cooc_freq, min_neighbour_cooc, enforce_max_term_frac, persist
        self._known_strong: dict[int, DataFrame] = {}

    def _kept(self, df: DataFrame) -> DataFrame:
        return df.persist(StorageLevel.MEMORY_AND_DISK) if self.persist else df

    @cached_property
    def tok(self) -> DataFrame:
        return vocab.positions(self.docs)

    @cached_property
    def vocab(self) -> DataFrame:
        whole = self.docs.schema["doc_id"].dataType.typeName() in ("long", "integer", "short", "byte")
        return self._kept(vocab.vocabulary_of(self.docs) if whole else vocab.vocabulary(self.tok))

    @cached_property
    def min_freq_vocab(self) -> DataFrame:
        found = vocab.selected_vocabulary(self.vocab, min_term_freq=self.min_term_freq)
        return sized(found) if self.persist else found

    @property
    def coll_size(self) -> DataFrame:
        return vocab.collection_size(self.min_freq_vocab)

    @cached_property
    def _terms(self):
        """The terms to be sent along, or None."""
        if not self.persist or self.min_freq_vocab.count() > blocks.MOST_TERMS:
            return None
        return self.docs.sparkSession.sparkContext.broadcast(blocks.Terms(self.min_freq_vocab))

    @cached_property
    def _parts(self) -> int:
        return blocks.parts_of(self.min_freq_vocab, self.skip_size + 1)

    @cached_property
    def _blocks(self) -> DataFrame:
        return cut(blocks.lists(self.docs, self._terms, self.skip_size + 1, self._parts, formulas.CONTEXT))

    @cached_property
    def cooc(self) -> DataFrame:
        return self.cooc_with_ids.select("t1", "t2", "freq")

    @cached_property
    def cooc_with_ids(self) -> DataFrame:
        """(t1, t2, id1, id2, freq)."""
        if self._terms is None:
            found = self._kept(cooc.cooccurrences(self.tok, self.skip_size, self.min_freq_vocab))
            return cooc.as_ids(found, self.min_freq_vocab, keep_terms=True)
        return blocks.cooccurrences(blocks.lists(self.docs, self._terms, self.skip_size + 1, self._parts), self._terms, self._parts)

    def _strong(self, least: int) -> DataFrame:
        if least not in self._known_strong:
            self._known_strong[least] = cut(blocks.frequent(self._blocks, self._parts, least))
        return self._known_strong[least]

    def sequences(self, min_cooc_freq: int | None = None, min_neighbour_cooc: int | None = None, max_docs: int | None = None) -> DataFrame:
        """(doc_id, tokens, sel, chars): ``selected`` with a row for each document that has tokens."""
        m, k = self._thresholds(min_cooc_freq, min_neighbour_cooc)
        found = blocks.selected(self._blocks, self._strong(m), self._terms, self._parts, m, k, formulas.CONTEXT, self.docs.schema["doc_id"].dataType.simpleString())
        if max_docs is not None:
            found = found.join(self.docs.select("doc_id").orderBy("doc_id").limit(max_docs), "doc_id", "left_semi")
        return found

    def _thresholds(self, min_cooc_freq: int | None, min_neighbour_cooc: int | None) -> tuple[int, int]:
        m = self.min_cooc_freq if min_cooc_freq is None else min_cooc_freq
        if m is None:
            raise ValueError("give min_cooc_freq here or to the constructor")
        k = self.min_neighbour_cooc if min_neighbour_cooc is None else min_neighbour_cooc
        return m, 1 if k is None else k

    def selected(self, min_cooc_freq: int | None = None, min_neighbour_cooc: int | None = None, max_docs: int | None = None) -> DataFrame:
        m, k = self._thresholds(min_cooc_freq, min_neighbour_cooc)
        if self._terms is not None:
            found = self.sequences(m, k, max_docs)
            return found.select("doc_id", F.posexplode(F.arrays_zip("tokens", "sel")).alias("pos", "t")).select("doc_id", "pos", F.col("t.tokens").alias("term"), F.col("t.sel").alias("sel"))
        tok = self.tok
        if max_docs is not None:
            tok = tok.join(self.docs.select("doc_id").orderBy("doc_id").limit(max_docs), "doc_id", "left_semi")
        strong = self.cooc.where(F.col("freq") >= m)
        return formulas.selected(tok, self.min_freq_vocab, sized(strong) if self.persist else strong, m, k)

    def extract_phrases(self, phrase_type: str = "sub_phrases", min_cooc_freq: int | None = None, min_neighbour_cooc: int = 1, max_docs: int | None = None, **options) -> DataFrame:
        """Matches of "sub_phrases", "long_phrases" or "candidate_phrases"."""
        kinds = {"sub_phrases": formulas.sub_phrases, "long_phrases": formulas.long_phrases, "candidate_phrases": formulas.candidate_phrases}
        if phrase_type not in kinds:
            raise ValueError(f"phrase_type must be one of {sorted(kinds)}")
        chosen = self.selected if self._terms is None else self.sequences
        found = kinds[phrase_type](chosen(min_cooc_freq, min_neighbour_cooc, max_docs), **options)
        return self._rare_enough(found) if self.max_frac is not None else found

    def _rare_enough(self, matches: DataFrame) -> DataFrame:
        """Drop phrases all of whose terms are more frequent than the given fraction of the collection."""
        total = self.coll_size.first()["coll_size"]
        common = self.vocab.where(F.col("tf") >= self.max_frac * total).select("term")
        keyed = matches.withColumn("_k", F.monotonically_increasing_id())
        rare = keyed.select("_k", F.explode("terms").alias("term")).where("term <> '<VAR>'").join(common, "term", "left_anti").select("_k").distinct()
        return keyed.join(rare, "_k", "left_semi").drop("_k")

    def index_candidate_docs(self, candidates: DataFrame, phrase_type: str = "sub_phrases", **options) -> DataFrame:
        return formulas.candidate_index(self.extract_phrases(phrase_type, **options), candidates)

    def extract_candidate_variables(self, phrase_type: str, candidates: DataFrame, **options) -> DataFrame:
        return formulas.candidate_variables(self.extract_phrases(phrase_type, **options), candidates)
