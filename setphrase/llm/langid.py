"""Language ID (8) by string kernels.

The blended-spectrum presence kernel of two texts counts the n-grams (n = 1..3) of letters that
both hold, over the root of the numbers each holds. Landmarks are a bounded sample of labelled
texts (Nyström); one-versus-rest kernel ridge regression is fitted in their space. As a kernel
value is linear in a text's presence vector, landmarks, whitening and regression fold into one
matrix, and a batch of texts is scored by one sparse-by-dense product.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from setphrase.llm.common import cut, whole_texts

CELLS = 1 << 16
SPECTRUM = 3
SAMPLE_PER_LANGUAGE = 800
LANDMARKS = 384
RIDGE = 1e-2
CHARS_AT_ONCE = 1_000_000
_fold: list[np.ndarray] = []


def _folding() -> np.ndarray:
    """Code point -> lower-cased letter, or 0 for what is no letter."""
    if not _fold:
        table = np.zeros(0x110000, np.uint32)
        for c in range(0x110000):
            ch = chr(c)
            if ch.isalpha():
                low = ch.lower()
                table[c] = ord(low) if len(low) == 1 else c
        _fold.append(table)
    return _fold[0]


def grams(text: str | None, present: np.ndarray | None = None) -> np.ndarray:
    """Cells of the n-grams of a whole text, each once and ascending; empty if it has no letter.

    A run of anything but letters is one blank, and the text starts and ends with one.
    """
    table = np.zeros(CELLS, bool) if present is None else present
    tail, any_ = np.zeros(1, np.uint32), False
    text = text or ""
    for at in range(0, len(text), CHARS_AT_ONCE):
        codes = _folding()[np.frombuffer(text[at : at + CHARS_AT_ONCE].encode("utf-32-le", "surrogatepass"), np.uint32)]
        if at + CHARS_AT_ONCE >= len(text):
            codes = np.append(codes, np.uint32(0))
        codes = np.concatenate([tail, codes])
        codes = codes[np.r_[True, (codes[1:] != 0) | (codes[:-1] != 0)]]
        any_ |= bool((codes != 0).any())
        h = np.zeros(len(codes), np.uint32)
        for n in range(1, SPECTRUM + 1):
            h = (h[: len(codes) - n + 1] if n > 1 else h) * np.uint32(0x01000193) + (codes[n - 1 :] + np.uint32(1)) * np.uint32(0x9E3779B1)
            if not len(h):
                break
            table[((h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B) + np.uint32(n)) >> np.uint32(16)] = True
        tail = codes[-(SPECTRUM - 1) :]
    if not any_:
        table[:] = False
        return np.zeros(0, np.int64)
    cells = np.flatnonzero(table)
    table[:] = False
    return cells


class KernelClassifier:
    """languages, and the matrix (CELLS x languages) into which landmarks and regression fold."""

    def __init__(self, languages: list[str], matrix: np.ndarray):
        self.languages, self.matrix = languages, matrix.astype(np.float32)

    @classmethod
    def fit(cls, cells: list[np.ndarray], labels: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE, seed: int = 42) -> KernelClassifier:
        languages = sorted(set(labels))
        if not cells:
            return cls([], np.zeros((CELLS, 0)))
        if len(languages) == 1:
            return cls(languages, np.ones((CELLS, 1)))
        y = np.where(np.array(labels)[:, None] == np.array(languages), 1.0, -1.0)
        chosen: list[int] = []
        rng, label = np.random.default_rng(seed), np.array(labels)
        for language in languages:
            own = np.flatnonzero(label == language)
            chosen += rng.permutation(own)[: -(-landmarks // len(languages))].tolist()
        # landmarks as columns: presence over the root of how many n-grams a landmark holds; only n-grams that one holds have a row
        held = np.unique(np.concatenate([cells[i] for i in chosen]))
        marks = np.zeros((len(held) + 1, len(chosen)), np.float32)
        row = np.full(CELLS, len(held))
        row[held] = np.arange(len(held))
        for k, i in enumerate(chosen):
            marks[row[cells[i]], k] = 1 / np.sqrt(len(cells[i]))
        kernel = np.vstack([marks[row[c]].sum(0) / np.sqrt(len(c)) for c in cells]).astype(np.float64)
        values, vectors = np.linalg.eigh(kernel[chosen])
        ok = values > 1e-8 * values.max()
        white = vectors[:, ok] / np.sqrt(values[ok])
        phi = np.hstack([kernel @ white, np.ones((len(cells), 1))])
        # languages count alike, however many texts each has
        weight = np.sqrt(len(labels) / len(languages) / np.array([(label == x).sum() for x in label]))[:, None]
        a = (phi * weight).T @ (phi * weight) + ridge * len(cells) / 100 * np.eye(phi.shape[1])
        coef = np.linalg.solve(a, (phi * weight).T @ (y * weight))
        folded = np.zeros((CELLS, len(languages)))
        folded[held] = marks[:-1] @ (white @ coef[:-1])
        model = cls(languages, folded)
        model.bias = coef[-1].astype(np.float32)
        return model

    bias: np.ndarray | float = 0.0

    def scores(self, cells: list[np.ndarray]) -> np.ndarray:
        """(texts x languages) decision values by one batched product; a text without n-grams gets the bias."""
        sizes = np.array([len(c) for c in cells])
        out = np.zeros((len(cells), len(self.languages)), np.float32)
        some = np.flatnonzero(sizes)
        if len(some) and len(self.languages):
            rows = self.matrix[np.concatenate([cells[i] for i in some])]
            starts = np.r_[0, np.cumsum(sizes[some])[:-1]]
            out[some] = np.add.reduceat(rows, starts, axis=0) / np.sqrt(sizes[some])[:, None]
        return out + self.bias

    def predict(self, cells: list[np.ndarray]) -> tuple[list[str], np.ndarray]:
        """(languages, scores from 0 to 1); "und" with score 0 for texts without n-grams and before any training."""
        if not self.languages:
            return ["und"] * len(cells), np.zeros(len(cells))
        e = np.exp(4 * (s := self.scores(cells).astype(np.float64)) - 4 * s.max(1, keepdims=True))
        best, share = s.argmax(1), (e / e.sum(1, keepdims=True)).max(1)
        some = np.array([len(c) > 0 for c in cells], bool)
        return [self.languages[b] if ok else "und" for b, ok in zip(best, some)], np.where(some, share, 0.0)


def train(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = SAMPLE_PER_LANGUAGE) -> KernelClassifier:
    """Fit on about ``per_language`` texts of each language, among rows where ``learn`` holds and the language is not null.

    The sample takes the rows whose hashed id falls below a rate that the language's count
    sets, so it needs no sort. All languages are learned, however many. Only the texts' n-gram cells (at most CELLS each) are collected.
    """
    rows = docs.where(learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    counts = cut(rows.groupBy("lang").agg(F.count("*").alias("n")))
    # a row for each language, of each of which the model itself holds CELLS floats
    rated = rows.join(F.broadcast(counts), "lang")
    drawn = rated.where(F.pmod(F.xxhash64("id", F.lit(8)), F.lit(1_000_000)) < F.lit(per_language * 1_000_000.0) / F.col("n")).select("id", "text", "lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(CELLS, bool)
        for batch in batches:
            cells = [grams(t.as_py(), table) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([c.astype("<u2").tobytes() for c in cells], pa.binary())], ["id", "lang", "cells"])

    sample = whole_texts(drawn).mapInArrow(run, "id long, lang string, cells binary").toPandas()
    sample = sample[sample["cells"].map(len) > 0].sort_values(["id", "lang"])
    return KernelClassifier.fit([np.frombuffer(c, "<u2").astype(np.int64) for c in sample["cells"]], sample["lang"].tolist())


def identify(docs: DataFrame, model: KernelClassifier, id_col: str = "doc_id", text_col: str = "text", pred_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """docs with the columns ``pred_col`` and ``score_col`` behind all its own; columns of docs with these names are replaced.

    ``und`` (score 0) if the text is null or has no letter, or if nothing was learned.
    """
    bound = docs.sparkSession.sparkContext.broadcast(model)  # CELLS x languages floats
    names = [c for c in docs.columns if c.lower() not in (pred_col.lower(), score_col.lower())]
    kept = docs.select(*[F.col(f"`{c}`") for c in names])
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, model_ = np.zeros(CELLS, bool), bound.value
        for batch in batches:
            for first in range(0, len(batch), 256):
                part = batch.slice(first, 256)
                langs, scores = model_.predict([grams(t.as_py(), table) for t in part.column(at)])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*part.schema.names, pred_col, score_col])

    schema = StructType([*kept.schema.fields]).add(pred_col, "string").add(score_col, "double")
    return whole_texts(kept).mapInArrow(run, schema)
