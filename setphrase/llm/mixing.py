"""Mixing sources to target weights (10) by iterative proportional fitting.

Token sums per (source, language, topic) cell are raked until their marginals meet the target
shares; a cell's factor is the product of its marginals' adjustments. Documents are sampled
with a probability proportional to their cell's factor, by a hash of their id, so the sample
is the same at every run and in every partitioning.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from setphrase.llm.common import cut

DIMS = ("source", "lang", "topic")
ROUNDS = 25
CELLS_ON_DRIVER = 200_000
UNKNOWN = "\x00null"


def n_tokens(text: str) -> Column:
    """Words between white space; 0 for null."""
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def topic(text: str) -> Column:
    """The form of a text, for documents that carry no topic of their own: none (no letter), symbols (fewer than
    three letters to a character that is neither letter nor white space), else short, medium or long
    prose (below 1,000, below 10,000 characters, longer)."""
    t = F.coalesce(F.col(text), F.lit(""))
    other = F.length(F.regexp_replace(t, r"[\p{L}\x20\x09-\x0D]+", ""))
    letters = F.length(F.regexp_replace(t, r"[^\p{L}]+", ""))
    size = F.length(t)
    return F.when(letters == 0, "none").when(letters < 3 * other, "symbols").when(size < 1_000, "short").when(size < 10_000, "medium").otherwise("long")


def tempered(shares: Mapping[str, float], exponent: float) -> dict[str, float]:
    """Shares raised to an exponent and made to sum to 1: below 1 it favours the small."""
    raised = {k: v**exponent for k, v in shares.items() if v > 0}
    total = sum(raised.values())
    return {k: v / total for k, v in raised.items()}


def rake(cells: np.ndarray, codes: np.ndarray, targets: Sequence[np.ndarray], rounds: int = ROUNDS) -> np.ndarray:
    """Factors of the cells after so many rounds of fitting each marginal in turn.

    cells: token sums; codes: (dims, cells) value of each dimension; targets: wanted share of
    each value. A value without tokens is passed over.
    """
    weight = cells.astype(np.float64)
    total = weight.sum()
    for _ in range(rounds):
        for code, target in zip(codes, targets):
            now = np.bincount(code, weight, len(target))
            weight = weight * np.divide(target * total, now, out=np.zeros(len(target)), where=now > 0)[code]
    return np.divide(weight, cells, out=np.zeros(len(cells)), where=cells > 0)


def _rake_frames(cells: DataFrame, dims: Sequence[str], targets: Mapping[str, DataFrame], rounds: int) -> DataFrame:
    """The same as rake for more cells than the driver should hold, as joins and sums."""
    total = cells.agg(F.sum("tokens").cast("double").alias("t")).first()["t"] or 0.0
    now = cells.withColumn("w", F.col("tokens").cast("double"))
    for _ in range(rounds):
        for dim in dims:
            marginal = now.groupBy(dim).agg(F.sum("w").alias("m"))
            step = cut(marginal.join(targets[dim], dim, "left").select(dim, F.when(F.col("m") > 0, F.coalesce("share", F.lit(0.0)) * total / F.col("m")).otherwise(0.0).alias("f")))
            now = now.join(step, dim).withColumn("w", F.col("w") * F.col("f")).drop("f")
        now = cut(now)
    return now.select(*dims, "tokens", F.when(F.col("tokens") > 0, F.col("w") / F.col("tokens")).otherwise(0.0).alias("factor"))


def mixed(
    docs: DataFrame,
    targets: Mapping[str, Mapping[str, float]] | None = None,
    exponent: float = 0.9,
    rounds: int = ROUNDS,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    lang_col: str = "lang",
    cells_on_driver: int = CELLS_ON_DRIVER,
    row_col: str | None = None,
    topic_col: str | None = None,
) -> DataFrame:
    """Rows (id, source, lang, topic, tokens, weight, probability, draw, sampled) for every row of docs.

    ``topic_col`` names a column of topics (null is a topic of its own); without one, a text's form is its topic.
    ``targets`` gives shares of tokens for values of source, lang or topic; a dimension that it
    leaves out gets its own shares raised to ``exponent``; values that it doesn't name get none.
    ``weight`` is the calibrated factor of the cell: sums of weight x tokens meet the targets.
    ``probability`` is the weight over the largest weight of any cell, so no document is wanted
    more than once. A null source or language is a value of its own. Documents without tokens
    have nothing to weigh: they are sampled with probability 1. Rows that repeat an id are drawn
    alike; a row with a null id is drawn by its text. ``row_col`` adds the whole row as a struct. Up to ``cells_on_driver`` cells are fitted on the driver (their number is counted
    first); more are fitted by joins and sums, with the same result.
    """
    named = docs.select(
        F.col(id_col).cast("long").alias("id"),
        F.coalesce(F.col(source_col), F.lit(UNKNOWN)).alias("source"),
        F.coalesce(F.col(lang_col), F.lit(UNKNOWN)).alias("lang"),
        (F.coalesce(F.col(topic_col), F.lit(UNKNOWN)) if topic_col else topic(text_col)).alias("topic"),
        n_tokens(text_col).alias("tokens"),
        F.coalesce(F.col(id_col).cast("long").cast("string"), F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))).alias("drawn_by"),
        *([F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(row_col)] if row_col else []),
    )
    spark = docs.sparkSession
    cells = named.groupBy(*DIMS).agg(F.sum("tokens").alias("tokens"))
    cells = cut(cells.where("tokens > 0"))
    n = cells.count()
    if n <= cells_on_driver:
        rows = cells.orderBy(*DIMS).collect()
        sums, codes, wanted = np.array([r["tokens"] for r in rows], np.float64), [], []
        for dim in DIMS:
            values = sorted({r[dim] for r in rows})
            at = {v: i for i, v in enumerate(values)}
            code = np.array([at[r[dim]] for r in rows], np.int64)
            own = np.bincount(code, sums, len(values)) / max(1.0, sums.sum()) if rows else np.zeros(0)
            share = (targets or {}).get(dim) or tempered(dict(zip(values, own)), exponent)
            codes.append(code), wanted.append(np.array([share.get(v, 0.0) for v in values]))
        factor = rake(sums, np.array(codes), wanted, rounds) if rows else sums
        schema = "source string, lang string, topic string, factor double, top double"
        top = float(factor.max()) if len(factor) else 1.0
        factors = spark.createDataFrame([(*(r[d] for d in DIMS), float(f), top) for r, f in zip(rows, factor)], schema)
    else:
        shares = {}
        for dim in DIMS:
            given = (targets or {}).get(dim)
            if given:
                shares[dim] = spark.createDataFrame(list(given.items()), f"{dim} string, share double")
            else:
                own = cells.groupBy(dim).agg(F.pow(F.sum("tokens").cast("double"), F.lit(exponent)).alias("s"))
                scale = own.agg(F.sum("s").alias("a")).first()["a"]
                shares[dim] = cut(own.select(dim, (F.col("s") / scale).alias("share")))
        fitted = cut(_rake_frames(cells, DIMS, shares, rounds))
        top = fitted.agg(F.max("factor").alias("m")).first()["m"]
        factors = fitted.select(*DIMS, "factor", F.lit(top).alias("top"))
    # the cells' number was counted above: few are sent out, more are joined by a shuffle
    found = named.join(F.broadcast(factors) if n <= cells_on_driver else factors, list(DIMS), "left")
    weight = F.when(F.col("tokens") > 0, F.col("factor")).otherwise(F.lit(1.0))
    probability = F.when(F.col("tokens") > 0, F.col("factor") / F.col("top")).otherwise(F.lit(1.0))
    draw = F.conv(F.substring(F.md5(F.concat(F.lit("mix:"), F.col("drawn_by")).cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))
    null = lambda c: F.when(F.col(c) != UNKNOWN, F.col(c)).alias(c)
    out = found.select("id", null("source"), null("lang"), null("topic"), "tokens", weight.alias("weight"), probability.alias("probability"), draw.alias("draw"), *([row_col] if row_col else []))
    return out.withColumn("sampled", F.col("draw") < F.col("probability")).withColumnRenamed("id", id_col)


def sample(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The sampled rows of docs, with all their columns."""
    return mixed(docs, id_col=id_col, row_col="_row", **options).where("sampled").select(*[F.col("_row").getField(c).alias(c) for c in docs.columns])
