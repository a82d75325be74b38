"""Keyness: tokens that are more frequent in one corpus than in another."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def weighted_tokens(phrases: DataFrame, phrase_col: str = "context") -> DataFrame:
    """(token, freq) of phrases weighted by their frequency."""
    return phrases.select(F.explode(F.split(phrase_col, " ", -1)).alias("token"), "freq").groupBy("token").agg(F.sum("freq").alias("freq"))


def key_tokens(own: DataFrame, reference: DataFrame, min_llr: float = 10.83, min_diff: float = 100.0, min_freq: int = 0) -> DataFrame:
    """(token, llr, perc_diff) of (token, freq) tables: over-used tokens with log-likelihood and percentage difference at the thresholds.

    A token that the reference lacks has its share there taken as 1e-18.
    """
    n1, n2 = own.agg(F.sum("freq").alias("n1")), reference.agg(F.sum("freq").alias("n2"))
    both = own.where(F.col("freq") >= min_freq).select("token", F.col("freq").alias("a")).join(reference.select("token", F.col("freq").alias("b")), "token", "left").join(F.broadcast(n1)).join(F.broadcast(n2))  # one row each
    a, b = F.col("a").cast("double"), F.coalesce(F.col("b"), F.lit(0)).cast("double")
    total = F.col("n1") + F.col("n2")
    part = lambda o, n: F.when(o > 0, o * F.log(o / (n * (a + b) / total))).otherwise(0.0)
    llr = 2 * (part(a, F.col("n1")) + part(b, F.col("n2")))
    ref = F.when(b > 0, b / F.col("n2")).otherwise(F.lit(1e-18))
    found = both.select("token", llr.alias("llr"), (100 * (a / F.col("n1") - ref) / ref).alias("perc_diff"), (a / F.col("n1") > b / F.col("n2")).alias("more"))
    return found.where(F.col("more") & (F.col("llr") >= min_llr) & (F.col("perc_diff") >= min_diff)).drop("more")
