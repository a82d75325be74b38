"""Structured Streaming beside the batch operators: running counts, and selection against frozen statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from setphrase.functions import tokens as T


def running_term_frequencies(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(term, tf) over a stream of texts; write it in update or complete mode."""
    return docs.select(F.explode(T.words(text_col)).alias("term")).groupBy("term").agg(F.count("*").alias("tf"))


def windowed_term_frequencies(docs: DataFrame, time_col: str, window: str = "1 hour", late: str = "10 minutes", text_col: str = "text") -> DataFrame:
    """(start, term, tf) by event time; state older than the watermark is dropped."""
    words = docs.withWatermark(time_col, late).select(time_col, F.explode(T.words(text_col)).alias("term"))
    return words.groupBy(F.window(time_col, window).alias("w"), "term").agg(F.count("*").alias("tf")).select(F.col("w.start").alias("start"), "term", "tf")


def known_phrases(docs: DataFrame, phrases: DataFrame, n: int, text_col: str = "text") -> DataFrame:
    """Occurrences (doc_id, phrase) of a frozen table of n-word phrases in a stream: a stateless stream-static join."""
    grams = docs.select("doc_id", F.explode(T.ngrams(T.words(text_col), n)).alias("g"))
    return grams.select("doc_id", F.array_join("g", " ").alias("phrase")).join(phrases.select("phrase"), "phrase", "left_semi").select("doc_id", "phrase")
