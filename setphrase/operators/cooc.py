"""Ordered skip-bigram co-occurrence."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from setphrase.functions import tokens as T
from setphrase.operators import blocks


def masked(tok: DataFrame, vocab: DataFrame | None) -> DataFrame:
    """(doc_id, pos, term, st): st is null for terms outside the vocabulary, which keep their position."""
    if vocab is None:
        return tok.withColumn("st", F.col("term"))
    return tok.join(vocab.select("term", F.col("term").alias("st")), "term", "left").select("doc_id", "pos", "term", "st")


def pairs(tok: DataFrame, reach: int, col: str = "st") -> DataFrame:
    """(doc_id, pos, t1, d, t2) for non-null terms d = 1..reach positions apart; one sort by document, no self-join."""
    order = Window.partitionBy("doc_id").orderBy("pos")
    ahead = tok.select("doc_id", "pos", F.col(col).alias("t1"), *[F.lead(col, d).over(order).alias(f"_{d}") for d in range(1, reach + 1)]).where("t1 is not null")
    others = F.array(*[F.struct(F.lit(d).alias("d"), F.col(f"_{d}").alias("t2")) for d in range(1, reach + 1)])
    return ahead.select("doc_id", "pos", "t1", F.inline(others)).where("t2 is not null")


def pairs_within(docs: DataFrame, reach: int) -> DataFrame:
    """(t1, t2) for terms up to ``reach`` positions apart in (doc_id, tokens); nothing is shuffled."""
    ahead = [F.slice("tokens", d + 1, F.greatest(F.size("tokens") - d, F.lit(0))).alias(f"_{d}") for d in range(1, reach + 1)]
    rows = docs.where(F.size("tokens") > 1).select(F.inline(F.arrays_zip(F.col("tokens").alias("t1"), *ahead))).where("t1 is not null")
    return rows.select("t1", F.explode(F.array(*[f"_{d}" for d in range(1, reach + 1)])).alias("t2")).where("t2 is not null")


def cooccurrences(tok: DataFrame, skip_size: int = 0, vocab: DataFrame | None = None) -> DataFrame:
    """(t1, t2, freq): ordered pairs with up to skip_size tokens between them; tok has a row for each token, or without vocab for each document (doc_id, tokens)."""
    if vocab is None and "tokens" in tok.columns:
        return pairs_within(tok, skip_size + 1).groupBy("t1", "t2").agg(F.count("*").alias("freq"))
    return pairs(masked(tok, vocab), skip_size + 1).groupBy("t1", "t2").agg(F.count("*").alias("freq"))


def gram_counts(docs: DataFrame, n: int, max_skips: int = 0, least: int = 1) -> DataFrame:
    """(terms, freq): n-grams of (doc_id, tokens) with up to max_skips gaps that occur at least so often."""
    by_blocks = blocks.grams(docs, T.skip_offsets(n, max_skips), least)
    if by_blocks is not None:
        return by_blocks
    made = T.skip_ngrams("tokens", n, max_skips) if max_skips else T.ngrams("tokens", n)
    rows = docs.select(F.explode(made).alias("g")).select(F.col("g.terms" if max_skips else "g").alias("terms"))
    return rows.groupBy("terms").agg(F.count("*").alias("freq")).where(F.col("freq") >= least)


def of_term(cooc: DataFrame, term: str) -> DataFrame:
    return cooc.where((F.col("t1") == term) | (F.col("t2") == term))


def as_ids(cooc: DataFrame, vocab: DataFrame, keep_terms: bool = False) -> DataFrame:
    """(id1, id2, freq), or with the terms (t1, t2, id1, id2, freq)."""
    ids = vocab.select("term", "term_id")
    named = cooc.join(ids.toDF("t1", "id1"), "t1").join(ids.toDF("t2", "id2"), "t2")
    return named.select(*(["t1", "t2"] if keep_terms else []), "id1", "id2", "freq")


def as_terms(cooc: DataFrame, vocab: DataFrame) -> DataFrame:
    """(t1, t2, freq) of (id1, id2, freq)."""
    ids = vocab.select("term", "term_id")
    return cooc.join(ids.toDF("t1", "id1"), "id1").join(ids.toDF("t2", "id2"), "id2").select("t1", "t2", "freq")
