"""Label patterns in documents, and phrases as orderings of a set of terms."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from setphrase.functions import tokens as T
from setphrase.operators import blocks

#: Tokens whose windows a task compares together.
WINDOW_TOKENS = 500_000


@dataclass(frozen=True)
class Pattern:
    """A sequence of one label or more, hashable, with ``in`` and ``len``."""

    labels: tuple[str, ...]

    def __init__(self, labels: Iterable[str]):
        object.__setattr__(self, "labels", tuple(labels))
        if not self.labels:
            raise ValueError("a pattern has at least one label")

    @property
    def start(self) -> str:
        return self.labels[0]

    @property
    def end(self) -> str:
        return self.labels[-1]

    @property
    def length(self) -> int:
        return len(self.labels)

    def __len__(self) -> int:
        return len(self.labels)

    def __contains__(self, label: object) -> bool:
        return label in self.labels

    def __iter__(self):
        return iter(self.labels)


class PatternIndex:
    """A set of patterns, with those that start or end with a label, to be looked up in documents (doc_id, tokens)."""

    def __init__(self, patterns: Pattern | Iterable[Pattern] = ()):
        self.patterns: set[Pattern] = set()
        self.add([patterns] if isinstance(patterns, Pattern) else patterns)

    def add(self, patterns: Iterable[Pattern]) -> None:
        self.patterns.update(p if isinstance(p, Pattern) else Pattern(p) for p in patterns)

    def __len__(self) -> int:
        return len(self.patterns)

    def __contains__(self, pattern: object) -> bool:
        return pattern in self.patterns

    def starting_with(self, label: str) -> set[Pattern]:
        return {p for p in self.patterns if p.start == label}

    def ending_with(self, label: str) -> set[Pattern]:
        return {p for p in self.patterns if p.end == label}

    def find(self, docs: DataFrame) -> DataFrame:
        """find_all for the patterns of this index."""
        return find_all(docs, docs.sparkSession.createDataFrame([(list(p),) for p in self.patterns], "labels array<string>"))


def find(docs: DataFrame, pattern: Iterable[str]) -> DataFrame:
    """(doc_id, start): all occurrences in (doc_id, tokens)."""
    return docs.select("doc_id", F.explode(T.positions_of("tokens", list(pattern))).alias("start"))


def contains(docs: DataFrame, pattern: Iterable[str]) -> DataFrame:
    """(doc_id, found)."""
    return docs.select("doc_id", (F.size(T.positions_of("tokens", list(pattern))) > 0).alias("found"))


def find_all(docs: DataFrame, patterns: DataFrame) -> DataFrame:
    """(doc_id, start, pattern): occurrences of patterns (labels array), looked up by their first label.

    Each token carries as many tokens as the longest pattern has, never its whole document.
    """
    index = patterns.where(F.size("labels") > 0).select(F.col("labels")[0].alias("term"), F.col("labels").alias("pattern")).distinct()
    longest = index.agg(F.coalesce(F.max(F.size("pattern")), F.lit(1)).alias("n")).first()["n"]
    window = F.transform("tokens", lambda term, i: F.struct(i.alias("start"), term.alias("term"), F.slice("tokens", i + 1, longest).alias("ahead")))
    at = docs.select("doc_id", F.inline(window))
    return at.join(index, "term").where(F.slice("ahead", F.lit(1), F.size("pattern")) == F.col("pattern")).select("doc_id", "start", "pattern")


def phrase_ids(phrases: DataFrame, vocab: DataFrame) -> DataFrame:
    """(phrase, ids): unknown terms get the id of <VAR> if there is one, else -1."""
    var = vocab.where(F.col("term") == T.VAR).agg(F.coalesce(F.max("term_id"), F.lit(-1)).alias("var_id"))
    terms = phrases.select("phrase", F.posexplode(F.split("phrase", " ", -1)).alias("p", "term")).join(vocab.select("term", "term_id"), "term", "left").join(F.broadcast(var))  # one row
    made = terms.groupBy("phrase").agg(F.array_sort(F.collect_list(F.struct("p", F.coalesce("term_id", "var_id").alias("i")))).alias("r"))
    return made.select("phrase", F.transform("r", lambda x: x["i"]).alias("ids"))


def orderings(ids: DataFrame, col: str = "ids") -> DataFrame:
    """(key, ids, freq): how often each ordering of a set of terms occurs."""
    return ids.groupBy(T.set_key(col).alias("key"), F.col(col).alias("ids")).agg(F.count("*").alias("freq"))


def of_set(counted: DataFrame, ids: Sequence[int]) -> DataFrame:
    """The orderings of one set; ids may repeat and come in any order."""
    return counted.where(F.col("key") == F.array(*[F.lit(i) for i in sorted(set(ids))]))


def multiset_overlaps(rows: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """(key, overlap): the elements of array a in order, each as often as array b holds it at most; for arrays of any length.

    Elements are numbered among their equals and joined to b's counts, so the work grows with the
    arrays' lengths and not with their square. A key names one row.
    """
    both = rows.select(F.col(key).alias("key"), F.col(a).alias("a"), F.col(b).alias("b"))
    order = Window.partitionBy("key", "x").orderBy("i")
    mine = both.select("key", F.posexplode("a").alias("i", "x")).withColumn("k", F.row_number().over(order))
    theirs = both.select("key", F.explode("b").alias("x")).groupBy("key", "x").agg(F.count("*").alias("n"))
    kept = mine.join(theirs, ["key", "x"]).where("k <= n").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("r"))
    none = F.array().cast(both.schema["a"].dataType)
    return both.select("key").join(kept, "key", "left").select(F.col("key").alias(key), F.coalesce(F.transform("r", lambda e: e["x"]), none).alias("overlap"))


def known(counted: DataFrame, ids: DataFrame, exact: bool = True) -> DataFrame:
    """The rows of ids (ids) whose ordering, or only whose set, has been counted."""
    keyed = ids.withColumn("key", T.set_key("ids"))
    return keyed.join(counted, ["key", "ids"] if exact else ["key"], "left_semi").select("ids")


def window_overlaps(docs: DataFrame, size: int = 6, step: int = 3, min_overlap: int = 3) -> DataFrame:
    """(doc_id, start, overlap): T.partial_overlap of each window of (doc_id, tokens) and the one ``step`` tokens on; tokens hold no blanks and aren't empty.

    Words are compared as numbers; texts are made only of what is returned, and of windows whose inner words would let one hold the other.
    """
    if step < 1 or size < 1:
        raise ValueError("size and step must be at least 1")
    most = WINDOW_TOKENS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in blocks.pieces(batches, most):
            flat, row, starts = blocks.laid_flat(table)
            word = flat.dictionary_encode().indices.to_numpy(zero_copy_only=False)
            pos = np.arange(len(row)) - starts[:-1][row]
            i = np.nonzero(pos % step == 0)[0]
            rest = starts[1:][row[i]] - i
            second = np.clip(rest - step, 0, size)
            # a window that ends its document holds the next one
            at, n = i + step, np.where(rest <= size, second, -1)
            same = lambda k, a, b, long: np.logical_and.reduce([word[a + x] == word[b + x] for x in range(long)]) if long > 0 else np.ones(len(k), bool)
            for length in np.unique(second[rest > size]).tolist():
                k = np.nonzero((rest > size) & (second == length))[0]
                inner = np.logical_or.reduce([same(k, i[k] + o + 1, i[k] + step + 1, length - 2) for o in range(size - length + 1)])
                for x in k[inner].tolist():
                    first, other = (" ".join(flat.slice(a, m).to_pylist()) for a, m in ((i[x], size), (i[x] + step, length)))
                    if first in other:
                        at[x], n[x] = i[x], size
                    elif other in first:
                        n[x] = length
                for m in range(length, min_overlap - 1, -1):
                    k = k[n[k] < 0]
                    for a, b in ((i[k] + size - m, i[k] + step), (i[k] + step + length - m, i[k])):
                        hit = same(k, a, b, m) & (n[k] < 0)
                        at[k[hit]], n[k[hit]] = a[hit], m
            ends = np.concatenate([[0], np.cumsum(np.maximum(n, 0))])
            places = np.repeat(at - ends[:-1], np.maximum(n, 0)) + np.arange(ends[-1])
            texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), flat.take(pa.array(places))), " ")
            yield from pa.table({"doc_id": table.column(0).take(pa.array(row[i])), "start": pa.array(pos[i].astype(np.int32)), "overlap": pc.if_else(pa.array(n >= 0), texts, pa.scalar(None, pa.string()))}).to_batches()

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "tokens").where(F.size("tokens") > 0).mapInArrow(run, f"doc_id {id_type}, start int, overlap string")
