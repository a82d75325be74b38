"""Toxicity (5): class-conditional Kneser-Ney models.

Each class (toxic, ordinary) has an interpolated Kneser-Ney model of words. It backs off from the
word to its first five and then its first four letters, and at last to the counts that both
classes share. A word's count is the number of texts that hold it (a text that repeats a word is
one context of it), a beginning's count is the sum over its words. Counts grow with the input and
no unit is hashed or folded.

At a level with counts c_y(u) of a unit u in class y, N_y their sum and N the sum of both:

* shared rate       s(u)   = min over y of (c_y(u) + 1) / N_y, the rate that both classes reach;
* shared backoff    P(u)   = (s(u) + SHARE x (c_tox(u) + c_ord(u) + 1) / N) / Z, which sums to 1;
* discount          D_y(u) = DISCOUNT + LIFT x e + z x sqrt(e) with e = N_y x s(u), so only what a
  class says more often than both do, beyond chance, is its own;
* class model       P_y(u) = max(c_y(u) - D_y(u), 0) / N_y + G_y x P(u) x P_y(parent) / P(parent).

G_y is the mass that discounting left to the shared counts. Unknown and evenly used words have the
parent's ratio, which is 1 at the root. The difference of a text's two log-likelihoods is
normalised by the text's length and by its root, and once more over different words only, so that
neither a long text nor one repeated word decides; logistic regression puts the three on a scale from
0 to 1. Its weights, and z, are chosen on a bounded sample of the labelled texts, each scored with
its own counts left out.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from math import exp, fsum, log, prod, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from setphrase.llm.common import crc32_of_id, cut, sieve, sifted, whole_texts

STEMS = (4, 5)  # letters of the units below the word, the shortest first
LEVELS = len(STEMS) + 1
DISCOUNT = 0.75
SHARE = 0.1
LIFT = 2.0
STRICTNESS = (3.0, 4.0, 6.0)  # values of z to choose from
FEATURES = 3
CALIBRATION_ROWS = 6_000
UNITS_SENT = 500_000
WORD = re.compile(r"[^\W\d_]+")
CACHED = 250_000


def words(text: str) -> Counter[str]:
    """The words of a text, lower-cased, with how often each occurs."""
    return Counter(WORD.findall(text.lower()))


def units(word: str) -> tuple[str, ...]:
    """A word's units from the shortest beginning to the word itself."""
    return (*(word[:n] for n in STEMS), word)


def own_mass(counts: tuple[float, float], totals: tuple[float, float], z: float) -> tuple[float, float, float]:
    """(own counts of toxic, of ordinary after discounting, shared backoff before Z) of a unit with these counts."""
    rate = min((c + 1) / n for c, n in zip(counts, totals))
    own = []
    for c, n in zip(counts, totals):
        e = n * rate
        own.append(max(c - DISCOUNT - LIFT * e - z * sqrt(e), 0.0))
    return own[0], own[1], rate + SHARE * (counts[0] + counts[1] + 1) / (totals[0] + totals[1])


class ToxicityModel:
    """known[level] maps units that some class holds as its own to their two counts; totals[level] are sums over all units."""

    def __init__(self, known: list[dict[str, tuple[int, int]]], totals: list[tuple[float, float]], kept: dict[float, list[tuple[float, float, float]]], z: float = STRICTNESS[0]):
        # kept[z][level]: the share of each class's mass that discounting leaves to the shared counts, and Z
        self.known, self.totals, self.kept, self.z = known, totals, kept, z
        self.weights = np.append(np.zeros(FEATURES), -2.0)
        self._excess: dict[str, float] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_excess": {}}

    def word(self, word: str, z: float, without: tuple[int, list[Counter]] | None = None) -> float:
        """log P_toxic(word) - log P_ordinary(word); ``without``: less what a text of that class holds, by level and unit."""
        toxic = ordinary = 1.0  # P_y / P
        for level, (known, totals, kept, unit) in enumerate(zip(self.known, self.totals, self.kept[z], units(word))):
            toxic, ordinary = toxic * kept[0], ordinary * kept[1]
            counts = known.get(unit)
            if counts is not None:
                if without is not None:
                    y, held = without
                    counts = (counts[0] - y * held[level][unit], counts[1] - (1 - y) * held[level][unit])
                a, b, shared = own_mass(counts, totals, z)
                toxic += a / totals[0] / (shared / kept[2])
                ordinary += b / totals[1] / (shared / kept[2])
        return log(toxic / ordinary)

    def unknown(self, z: float) -> float:
        """The ratio of a word that no class holds as its own."""
        return log(prod(k[0] for k in self.kept[z]) / prod(k[1] for k in self.kept[z]))

    def ratios(self, text: str) -> list[float]:
        """normalised ratios of a text's words."""
        found, known, base = words(text), self._excess, self.unknown(self.z)
        if len(known) > CACHED:
            known.clear()
        for word in [w for w in found if w not in known]:
            known[word] = self.word(word, self.z) - base
        return normalised([(known[w], n) for w, n in found.items()], base)

    def left_out(self, text: str, toxic: bool, z: float) -> list[float]:
        """ratios, had this text of that class not been counted."""
        found, base = words(text), self.unknown(z)
        held = [Counter(w[:n] for w in found) for n in (*STEMS, None)]
        return normalised([(self.word(w, z, (int(toxic), held)) - base, n) for w, n in found.items()], base)

    def score(self, text: str) -> float:
        return scaled(self.weights, self.ratios(text))

    def calibrate(self, ratios: np.ndarray, toxic: np.ndarray) -> float:
        """Logistic regression on the ratios, by Newton's method with a little shrinkage; returns the mean loss."""
        if not len(toxic):
            return 0.0
        scale = np.append(np.where(ratios.std(0) > 0, ratios.std(0), 1.0), 1.0)
        x = np.column_stack([ratios, np.ones(len(ratios))]) / scale
        share = (toxic.sum() + 0.5) / (len(toxic) + 1)
        w, shrink = np.append(np.zeros(FEATURES), np.log(share / (1 - share))), np.append(np.full(FEATURES, 0.1), 0.0)
        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            h = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(shrink + 1e-6)
            step = np.linalg.solve(h, x.T @ (p - toxic) + shrink * w)
            w -= step * min(1.0, 2 / max(1e-9, np.abs(step).max()))
            if np.abs(step).max() < 1e-6:
                break
        self.weights = w / scale
        p = np.clip(1 / (1 + np.exp(-np.clip(x @ w, -30, 30))), 1e-9, 1 - 1e-9)
        return float(-(toxic * np.log(p) + (1 - toxic) * np.log(1 - p)).mean())


def normalised(words_: list[tuple[float, int]], base: float) -> list[float]:
    """Of words' ratios above ``base`` and how often each occurs: the sum of ratios over the text's length, over its root,
    and what different words have above base over the root of their number. A text without words has base, 0, 0."""
    total, size = fsum(x * n for x, n in words_), sum(n for _, n in words_)
    if not size:
        return [base, 0.0, 0.0]
    return [base + total / size, base * sqrt(size) + total / sqrt(size), fsum(x for x, _ in words_) / sqrt(len(words_))]


def scaled(weights: np.ndarray, ratios: list[float]) -> float:
    x = fsum(w * r for w, r in zip(weights.tolist(), [*ratios, 1.0]))
    return 1 / (1 + exp(-min(30.0, max(-30.0, x))))


def _own(c: Column, other: Column, n: float, m: float, z: float) -> Column:
    """own_mass of one class as a column."""
    e = F.lit(float(n)) * F.least((c + 1) / F.lit(float(n)), (other + 1) / F.lit(float(m)))
    return F.greatest(c - F.lit(DISCOUNT) - F.lit(LIFT) * e - F.lit(z) * F.sqrt(e), F.lit(0.0))


def _shared(a: Column, b: Column, n: float, m: float) -> Column:
    return F.least((a + 1) / F.lit(float(n)), (b + 1) / F.lit(float(m))) + SHARE * (a + b + 1) / F.lit(float(n + m))


def count_words(texts: DataFrame) -> DataFrame:
    """Rows (word, toxic, ordinary): how many texts (text, y) of each class hold a word. Combined before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: tuple[Counter, Counter] = (Counter(), Counter())

        def out() -> pa.RecordBatch:
            both = list(counts[0].keys() | counts[1].keys())
            columns = [pa.array(both, pa.string()), *[pa.array([counts[y][w] for w in both], pa.int64()) for y in (1, 0)]]
            counts[0].clear(), counts[1].clear()
            return pa.RecordBatch.from_arrays(columns, ["word", "toxic", "ordinary"])

        for batch in batches:
            for text, y in zip(batch.column(0), batch.column(1).to_pylist()):
                counts[y].update(words(text.as_py()).keys())
                if len(counts[0]) + len(counts[1]) > 200_000:
                    yield out()
        yield out()

    found = whole_texts(texts.select("text", "y")).mapInArrow(run, "word string, toxic long, ordinary long")
    return found.groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))


def count_units(counted: DataFrame) -> DataFrame:
    """Rows (level, unit, toxic, ordinary) of words and their beginnings."""
    made = counted.select(F.lit(LEVELS - 1).alias("level"), F.col("word").alias("unit"), "toxic", "ordinary")
    for level, n in enumerate(STEMS):
        begun = counted.groupBy(F.substring("word", 1, n).alias("unit")).agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))
        made = made.unionByName(begun.select(F.lit(level).alias("level"), "unit", "toxic", "ordinary"))
    return made


def fitted(counts: DataFrame) -> tuple[DataFrame, list[tuple[float, float]], dict[float, list[tuple[float, float, float]]]]:
    """(units that some class holds as its own at some strictness, totals, kept) of count_units.

    A unit also stays if it would be some class's own with one count less of either class.
    """
    sums = {r["level"]: (float(r["a"]), float(r["b"])) for r in counts.groupBy("level").agg(F.sum("toxic").alias("a"), F.sum("ordinary").alias("b")).collect()}
    totals = [tuple(max(1.0, x) for x in sums.get(level, (0.0, 0.0))) for level in range(LEVELS)]
    a, b = F.col("toxic").cast("double"), F.col("ordinary").cast("double")
    both, kept = [], {z: [] for z in STRICTNESS}
    for level, (n, m) in enumerate(totals):
        at = counts.where(F.col("level") == level)
        least = min(STRICTNESS)
        fewer = ((a, b), (F.greatest(a - 1, F.lit(0.0)), b), (a, F.greatest(b - 1, F.lit(0.0))))
        both.append(at.where(F.greatest(*[x for p, q in fewer for x in (_own(p, q, n, m, least), _own(q, p, m, n, least))]) > 0))
        sums_ = [_shared(a, b, n, m), *[x for z in STRICTNESS for x in (_own(a, b, n, m, z), _own(b, a, m, n, z))]]
        norm, *row = at.agg(*[F.coalesce(F.sum(x), F.lit(0.0)) for x in sums_]).first()
        for k, z in enumerate(STRICTNESS):
            kept[z].append((1 - row[2 * k] / n, 1 - row[2 * k + 1] / m, norm or 1.0))
    known = both[0]
    for part in both[1:]:
        known = known.unionByName(part)
    return known, totals, kept


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = 3, held_out: int = 1, sample: int = CALIBRATION_ROWS, units_sent: int = UNITS_SENT) -> ToxicityModel | TableModel:
    """Count all labelled texts but those of fold ``held_out``, which is never read; calibrate on about ``sample`` of them.

    Labels that are null, or whose id is, teach nothing; an id with several labels is toxic if
    one of them is. Texts without labels aren't shuffled (a sieve of labelled ids). Units that
    tell the classes apart are counted; up to ``units_sent`` travel with the tasks, more stay a
    table that texts are joined to, with the same scores.
    """
    fold = F.pmod(crc32_of_id(id_col), F.lit(folds))
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & (fold != held_out))
    known = cut(known.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max((F.col(label_col) > 0).cast("int")).alias("y")))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    texts = sifted(texts, "id", cut(sieve(known, "id"))).where("_hit").join(known.hint("merge"), "id").select("id", "text", "y")

    table, totals, kept = fitted(count_units(cut(count_words(texts))))
    table = cut(table)
    rate = sample / max(1, known.count())
    drawn = cut(texts.where(F.pmod(F.xxhash64("id", F.lit(5)), F.lit(1_000_000)) < rate * 1_000_000))
    few = table.count() <= units_sent
    if few:
        model = ToxicityModel(_collected(table), totals, kept)
    else:  # the sample's own units are enough to calibrate by
        named = drawn.select(F.explode(_words("text")).alias("w")).select("w.word").distinct()
        near = [named.select(F.lit(level).alias("level"), (F.substring("word", 1, n) if n else F.col("word")).alias("unit")).distinct() for level, n in enumerate((*STEMS, 0))]
        wanted = near[0].unionByName(near[1]).unionByName(near[2])
        model = ToxicityModel(_collected(table.join(wanted, ["level", "unit"], "left_semi")), totals, kept)
    bound = docs.sparkSession.sparkContext.broadcast(model)

    def ratios(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, y in zip(batch.column(0), batch.column(1).to_pylist()):
                rows.append([x for z in STRICTNESS for x in bound.value.left_out(text.as_py(), y > 0, z)])
            values = np.array(rows, np.float64).reshape(-1, FEATURES * len(STRICTNESS))
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.FixedSizeListArray.from_arrays(pa.array(values.ravel()), values.shape[1]).cast(pa.list_(pa.float64()))], ["y", "r"])

    seen: pd.DataFrame = drawn.select("text", "y").mapInArrow(ratios, "y int, r array<double>").toPandas()
    seen = seen.iloc[sorted(range(len(seen)), key=lambda i: (seen["y"].iloc[i], tuple(seen["r"].iloc[i])))]  # sums don't depend on the order of tasks
    toxic = (seen["y"].to_numpy() > 0).astype(float)
    values = np.array(seen["r"].tolist(), np.float64).reshape(len(seen), len(STRICTNESS), FEATURES)
    losses = []
    for k, z in enumerate(STRICTNESS if len(seen) else ()):
        losses.append((model.calibrate(values[:, k], toxic), z, model.weights))
    if losses:
        _, model.z, model.weights = min(losses, key=lambda x: x[:2])
    return model if few else TableModel(table, model)


def _collected(table: DataFrame) -> list[dict[str, tuple[int, int]]]:
    known: list[dict[str, tuple[int, int]]] = [{} for _ in range(LEVELS)]
    rows = table.toPandas()
    for level, unit, toxic, ordinary in zip(rows["level"], rows["unit"], rows["toxic"], rows["ordinary"]):
        known[level][unit] = (int(toxic), int(ordinary))
    return known


@F.pandas_udf(ArrayType(StructType().add("word", "string").add("n", "long")))
def _words(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: [{"word": w, "n": n} for w, n in sorted(words(t or "").items())])


class TableModel:
    """A model whose units are too many to send: words of texts are joined to them."""

    def __init__(self, table: DataFrame, model: ToxicityModel):
        self.table, self.model = table, model

    def score(self, docs: DataFrame) -> DataFrame:
        """Rows (id, score) of rows (id, text)."""
        m, spark = self.model, docs.sparkSession
        rows = cut(docs.select(F.monotonically_increasing_id().alias("row"), "id", _words("text").alias("words")))
        spread = rows.select("row", F.inline("words"))
        # each different word is looked up once; only words that some class knows come back
        ratio = spread.select("word").distinct().select("word", *[(F.substring("word", 1, n) if n else F.col("word")).alias(f"u{level}") for level, n in enumerate((*STEMS, 0))])
        toxic = ordinary = F.lit(1.0)
        for level, ((n, o), (g, h, norm)) in enumerate(zip(m.totals, m.kept[m.z])):
            part = self.table.where(F.col("level") == level).select(F.col("unit").alias(f"u{level}"), F.col("toxic").cast("double").alias(f"a{level}"), F.col("ordinary").cast("double").alias(f"b{level}"))
            ratio = ratio.join(part, f"u{level}", "left")
            a, b = F.col(f"a{level}"), F.col(f"b{level}")
            shared = _shared(a, b, n, o) / norm
            toxic = toxic * g + F.coalesce(_own(a, b, n, o, m.z) / n / shared, F.lit(0.0))
            ordinary = ordinary * h + F.coalesce(_own(b, a, o, n, m.z) / o / shared, F.lit(0.0))
        base = m.unknown(m.z)
        own = F.coalesce(*[F.col(f"a{level}") for level in range(LEVELS)]).isNotNull()
        ratio = cut(ratio.where(own).select("word", (F.log(toxic / ordinary) - base).alias("r")))
        sums = spread.join(ratio, "word").groupBy("row").agg(F.sum(F.col("r") * F.col("n")).alias("total"), F.sum("r").alias("different"))
        total, different = F.coalesce("total", F.lit(0.0)), F.coalesce("different", F.lit(0.0))
        size = F.aggregate("words", F.lit(0).cast("long"), lambda acc, w: acc + w["n"])
        root = lambda c: F.sqrt(F.greatest(c, F.lit(1)).cast("double"))
        weights = m.weights.tolist()
        x = weights[0] * (base + total / F.greatest(size, F.lit(1))) + weights[1] * (base * F.sqrt(size.cast("double")) + total / root(size)) + weights[2] * different / root(F.size("words")) + weights[3]
        return rows.join(sums, "row", "left").select("id", (1 / (1 + F.exp(-F.least(F.greatest(x, F.lit(-30.0)), F.lit(30.0))))).alias("score"))


def score(docs: DataFrame, model: ToxicityModel | TableModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """Rows (id, score, predicted) for every row of docs; whole texts, null counts as empty; other columns are ignored."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    if isinstance(model, TableModel):
        out = model.score(rows)
    else:
        bound = docs.sparkSession.sparkContext.broadcast(model)  # at most UNITS_SENT units, counted by train

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                scores = np.array([bound.value.score(t.as_py()) for t in batch.column(1)], np.float64)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], ["id", "score"])

        out = whole_texts(rows).mapInArrow(run, "id long, score double")
    return out.select(F.col("id").alias(id_col), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
