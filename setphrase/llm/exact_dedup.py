"""Exact dedup (2): group by a 128-bit content hash, keep the smallest id, compare bytes inside groups.

Only hashes are shuffled for texts that occur once. The texts of groups with more than one
member are shuffled once per map task (the aggregate combines copies before the exchange, so
a text that a third of all rows hold costs one row a task), and the aggregate's own key
comparison is the byte comparison.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from setphrase.llm.common import WHITE, cut, sieve, sifted, spread_join, without


def normalised(text: str | Column) -> Column:
    """The text (null: empty) with each run of ASCII white space replaced by one space."""
    text = F.col(text) if isinstance(text, str) else text
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, " ")


def exact_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    hash_128: Callable[[Column], Column] = lambda t: F.unhex(F.md5(t)),
    sieve_bits: int = 24,
) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    A null text counts as empty; empty texts are equal to one another. A null id sorts
    before every other id. Rows that repeat an id and a text are members of one group and
    are all marked as the row that stays. Any other column is ignored.

    ``sieve_bits`` bounds what is broadcast: a bitmap of 2**sieve_bits bits, of which the
    hashes of repeated texts set one each. A text is shuffled only if its bit is set; a text
    that shares the bit by chance is compared too, which costs time and changes nothing.
    ``hash_128`` may be weak: texts that share it but differ in a byte are told apart by
    their bytes and joined back by SHA-256.
    """
    text = normalised(text_col)
    rows = docs.select(F.col(id_col).alias("id"), text.alias("t"))
    sha = lambda t: F.unhex(F.sha2(t, 256))
    hashed = cut(rows.select("id", hash_128(F.col("t").cast("binary")).alias("h"), sha("t").alias("sha")))

    repeated = hashed.groupBy("h").agg(F.count("*").alias("n")).where("n > 1")
    seen = sifted(rows.select("id", "t", hash_128(F.col("t").cast("binary")).alias("h")), "h", sieve(repeated, "h", sieve_bits), sieve_bits).where("_hit")
    # struct keeps a null id smallest: min() alone would skip it
    groups = seen.groupBy("h", "t").agg(F.min(F.struct(F.col("id").isNotNull().alias("o"), F.col("id").alias("id"))).alias("k"), F.count("*").alias("n"))
    groups = groups.select("h", sha("t").alias("sha"), F.col("k.id").alias("keep"), "n", F.lit(True).alias("found"))
    found = F.coalesce("found", F.lit(False))
    keep = F.when(found, F.col("keep")).otherwise(F.col("id"))
    return spread_join(hashed, cut(groups), ["h", "sha"], "n", "left").select(
        F.col("id").alias(id_col),
        keep.alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        keep.eqNullSafe(F.col("id")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns; rows that repeat an id and a text all stay."""
    gone = exact_duplicates(docs, id_col, text_col).where("not kept").select(id_col, "text_sha256")
    return without(docs, gone, lambda c: c(id_col), lambda c: F.sha2(normalised(c(text_col)), 256))
