"""Vocabulary and term frequencies over (doc_id, pos, term)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

from setphrase.functions.tokens import words
from setphrase.operators import blocks

BLOCK = 1 << 16


def checked(docs: DataFrame, tokens_col: str = "tokens") -> DataFrame:
    """docs, if it has a column of token arrays (or of structs with an array ``words``), as ``tokens``; else a TypeError or KeyError.

    Tokens are strings, or structs whose field ``n`` is the string. Rows with a null token end the query.
    """
    if tokens_col not in docs.columns:
        raise KeyError(f"no column {tokens_col}")
    kind = docs.schema[tokens_col].dataType
    at = F.col(f"`{tokens_col}`")
    if isinstance(kind, StructType):
        if "words" not in kind.names:
            raise KeyError(f"{tokens_col} needs a field words, an array of strings")
        kind, at = kind["words"].dataType, at["words"]
    if isinstance(kind, ArrayType) and isinstance(kind.elementType, StructType) and "n" in kind.elementType.names:
        kind, at = ArrayType(kind.elementType["n"].dataType), F.transform(at, lambda t: t["n"])
    if not isinstance(kind, ArrayType) or not isinstance(kind.elementType, StringType):
        raise TypeError(f"{tokens_col} must be an array of strings or a struct with one in words, not {kind.simpleString()}")
    sound = F.when(F.exists(at, lambda t: t.isNull()), F.raise_error(F.lit("a token is null"))).otherwise(at)
    return docs.withColumn("tokens", sound)


def tokenised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer=words) -> DataFrame:
    """(doc_id, tokens): the canonical input."""
    return docs.select(F.col(id_col).alias("doc_id"), tokenizer(text_col).alias("tokens"))


def positions(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, term) of (doc_id, tokens)."""
    return docs.select("doc_id", F.posexplode("tokens").alias("pos", "term"))


def term_frequencies(tok: DataFrame) -> DataFrame:
    return tok.groupBy("term").agg(F.count("*").alias("tf"))


def vocabulary(tok: DataFrame) -> DataFrame:
    """(term, term_id, tf): ids in order of first appearance by (doc_id, pos).

    A global rank in two steps: sums over blocks of document ids, and ranks within a block, so
    that no task sorts all terms.
    """
    return _ranked(tok.groupBy("term").agg(F.min(F.struct("doc_id", "pos")).alias("f"), F.count("*").alias("tf")))


def vocabulary_of(docs: DataFrame) -> DataFrame:
    """``vocabulary`` of (doc_id, tokens), ids of whole numbers: terms are counted by blocks of documents, so that no token becomes a row."""
    return _ranked(blocks.first_seen(docs).groupBy("term").agg(F.min("f").alias("f"), F.sum("n").alias("tf")))


def _ranked(first: DataFrame) -> DataFrame:
    first = first.withColumn("b", F.floor(F.col("f.doc_id") / BLOCK))
    sizes = first.groupBy("b").agg(F.count("*").alias("n"))
    base = sizes.select("b", (F.sum("n").over(Window.orderBy("b")) - F.col("n")).alias("base"))
    inner = F.row_number().over(Window.partitionBy("b").orderBy("f")) - 1
    return first.withColumn("r", inner).join(base, "b").select("term", (F.col("base") + F.col("r")).alias("term_id"), "tf")


def extended_vocabulary(vocab: DataFrame, tok: DataFrame) -> DataFrame:
    """A vocabulary (term, term_id, tf) with another corpus added: known terms keep their ids, new ones follow in order of first appearance; frequencies add up.

    tok has a row for each token, or for each document (doc_id, tokens). To reset one, make a ``vocabulary`` anew.
    """
    more = vocabulary_of(tok) if "tokens" in tok.columns else vocabulary(tok)
    known = vocab.select("term", "term_id", "tf")
    new = more.join(known.select("term"), "term", "left_anti")
    first = known.agg(F.coalesce(F.max("term_id") + 1, F.lit(0)).alias("first"))
    # ids of new terms are those of a ranking of their own: ranks among blocks of ids, then within one
    blocks = new.withColumn("b", F.floor(F.col("term_id") / BLOCK))
    base = blocks.groupBy("b").agg(F.count("*").alias("n")).select("b", (F.sum("n").over(Window.orderBy("b")) - F.col("n")).alias("base"))
    inner = F.row_number().over(Window.partitionBy("b").orderBy("term_id")) - 1
    numbered = blocks.withColumn("r", inner).join(base, "b").join(F.broadcast(first))  # one row
    added = more.select("term", F.col("tf").alias("more"))
    grown = known.join(added, "term", "left").select("term", "term_id", (F.col("tf") + F.coalesce("more", F.lit(0))).alias("tf"))
    return grown.unionByName(numbered.select("term", (F.col("first") + F.col("base") + F.col("r")).alias("term_id"), "tf"))


def selected_vocabulary(vocab: DataFrame, terms: list[str] | None = None, ids: list[int] | None = None, min_term_freq: int | None = None) -> DataFrame:
    """A part of a vocabulary with its ids: terms win over the frequency threshold, which wins over ids."""
    if terms is not None:
        return vocab.where(F.col("term").isin(list(terms)))
    if min_term_freq is not None:
        if not isinstance(min_term_freq, int) or isinstance(min_term_freq, bool):
            raise TypeError("min_term_freq must be an integer")
        return vocab.where(F.col("tf") >= min_term_freq)
    if ids is not None:
        return vocab.where(F.col("term_id").isin(list(ids)))
    raise ValueError("give terms, ids or min_term_freq")


def with_ids(df: DataFrame, vocab: DataFrame, term_col: str = "term") -> DataFrame:
    """df with term_id; null where the vocabulary lacks the term."""
    return df.join(vocab.select(F.col("term").alias(term_col), "term_id"), term_col, "left")


def with_terms(df: DataFrame, vocab: DataFrame, id_col: str = "term_id") -> DataFrame:
    return df.join(vocab.select(F.col("term_id").alias(id_col), "term"), id_col, "left")


def collection_size(vocab: DataFrame) -> DataFrame:
    return vocab.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("coll_size"))


def frequency_of(vocab: DataFrame, term: str | Column) -> DataFrame:
    """One row with a term's frequency, 0 if it is unknown."""
    return vocab.where(F.col("term") == term).agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("tf"))


def top(df: DataFrame, k: int, by: str, *ties: str) -> DataFrame:
    """The k rows with the largest value, ties in ascending order of the others."""
    return df.orderBy(F.desc(by), *ties).limit(k)
