"""Contexts of phrases: counts before and after, words, dominant terms, roll-ups.

ctx is a table (direction, phrase, context, freq) with direction "pre" or "post".
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from setphrase.functions import tokens as T
from setphrase.functions.lineage import sized

MOST_SOUGHT = 1_000
EMPTY = "direction string, phrase string, context string, freq long"


def main_phrases(phrases: DataFrame) -> DataFrame:
    """(phrase, main) from (main, variants array, ord): a main phrase maps to itself, a variant to its first main."""
    own = phrases.select(F.col("main").alias("phrase"), "main", F.lit(0).alias("k"), "ord")
    other = phrases.select(F.explode("variants").alias("phrase"), "main", F.lit(1).alias("k"), "ord")
    return own.unionByName(other).groupBy("phrase").agg(F.min_by("main", F.struct("k", "ord", "main")).alias("main"))


def occurrences(docs: DataFrame, phrases: DataFrame, context_size: int = 5) -> DataFrame:
    """(doc_id, phrase, pre, post): every occurrence (overlapping ones too) of phrases (phrase, main) in (doc_id, tokens).

    Up to MOST_SOUGHT phrases are sought within each row, so that only hits become rows and
    nothing is shuffled. More are joined with all n-grams of the lengths that they have.
    """
    named = phrases.where("phrase is not null").select("phrase", "main", F.size(F.split("phrase", " ", -1)).alias("n"))
    few = [r["phrase"] for r in named.select("phrase").distinct().limit(MOST_SOUGHT + 1).collect()]
    sought = few if len(few) <= MOST_SOUGHT else None
    lengths = sorted({len(p.split(" ")) for p in few} if sought is not None else {r["n"] for r in named.select("n").distinct().collect()})
    found = None
    for n in lengths:
        text = lambda i, n=n: F.array_join(F.slice("tokens", i + 1, n), " ")
        starts = F.when(F.size("tokens") >= n, F.sequence(F.lit(0), F.size("tokens") - n)).otherwise(F.array().cast("array<int>"))
        if sought is not None:
            own = [p for p in sought if len(p.split(" ")) == n]
            first = sorted({p.split(" ")[0] for p in own})
            starts = F.filter(starts, lambda i: F.get("tokens", i).isin(first) & text(i).isin(own))

        def window(i):
            pre = F.slice("tokens", F.greatest(i - context_size, F.lit(0)) + 1, F.least(i, F.lit(context_size)))
            return F.struct(text(i).alias("phrase"), pre.alias("pre"), F.slice("tokens", i + n + 1, context_size).alias("post"))

        keyed = docs.select("doc_id", F.inline(F.transform(starts, window)))
        wanted = named.where(F.col("n") == n).drop("n")
        hit = keyed.join(F.broadcast(wanted) if sought is not None else sized(wanted), "phrase").select("doc_id", F.col("main").alias("phrase"), "pre", "post")
        found = hit if found is None else found.unionByName(hit)
    return found if found is not None else docs.sparkSession.createDataFrame([], "doc_id long, phrase string, pre array<string>, post array<string>")


def phrase_counts(occ: DataFrame) -> DataFrame:
    return occ.groupBy("phrase").agg(F.count("*").alias("freq"))


def context_counts(occ: DataFrame, *more: str) -> DataFrame:
    """ctx of occurrences; empty contexts aren't counted. ``more`` names further columns to count by, such as a period."""
    sides = F.array(*[F.struct(F.lit(d).alias("direction"), F.col(d).alias("c")) for d in ("pre", "post")])
    rows = occ.select("phrase", *more, F.inline(sides)).where(F.size("c") > 0)
    return rows.groupBy(*more, "direction", "phrase", F.array_join("c", " ").alias("context")).agg(F.count("*").alias("freq"))


def empty(spark) -> DataFrame:
    return spark.createDataFrame([], EMPTY)


def context_words(ctx: DataFrame) -> DataFrame:
    """(direction, word, freq): words of contexts weighted by frequency."""
    words = ctx.select("direction", F.explode(F.split("context", " ", -1)).alias("word"), "freq")
    return words.groupBy("direction", "word").agg(F.sum("freq").alias("freq"))


def dominant_terms(freq: DataFrame, variant_of: DataFrame, min_frac: float = 0.1) -> DataFrame:
    """(word, freq) with variants (variant, preferred) folded in, if it is at least such a fraction of all."""
    named = freq.join(variant_of.withColumnRenamed("variant", "word"), "word", "left").groupBy(F.coalesce("preferred", "word").alias("word")).agg(F.sum("freq").alias("freq"))
    total = named.agg(F.sum("freq").alias("total"))
    return named.join(F.broadcast(total)).where(F.col("freq") / F.col("total") >= min_frac).select("word", "freq")  # one row


def dominant_phrases(phrase: str, terms: DataFrame, col: str = "word") -> DataFrame:
    """(word, phrase): the slots of a phrase filled by each dominant term."""
    return terms.select(col, T.filled(F.lit(phrase), F.col(col)).alias("phrase"))


def merged_phrases(ctx: DataFrame) -> DataFrame:
    """(direction, context, freq) over all phrases."""
    return ctx.groupBy("direction", "context").agg(F.sum("freq").alias("freq"))


def merged_periods(ctx: DataFrame, periods: list, period_col: str = "period") -> DataFrame:
    """ctx over the given periods."""
    return ctx.where(F.col(period_col).isin(list(periods))).groupBy("direction", "phrase", "context").agg(F.sum("freq").alias("freq"))


def sub_contexts(ctx: DataFrame) -> DataFrame:
    """(direction, sub_phrase, freq): all beginnings of post contexts and all ends of pre contexts that occur more than once."""
    w = F.split("context", " ", -1)
    ends = F.transform(F.sequence(F.lit(1), F.size(w)), lambda n: F.array_join(F.when(F.col("direction") == "post", F.slice(w, F.lit(1), n)).otherwise(F.slice(w, F.size(w) - n + 1, n)), " "))
    return ctx.where("freq > 1").select("direction", F.explode(ends).alias("sub_phrase"), "freq").groupBy("direction", "sub_phrase").agg(F.sum("freq").alias("freq"))


def selected_words(ctx: DataFrame, variant_of: DataFrame | None = None, min_word_prob: float = 0.1) -> DataFrame:
    """(direction, word): words that at least such a share of a direction's contexts hold, variants folded in."""
    total = ctx.groupBy("direction").agg(F.sum("freq").alias("total"))
    words = normalised_words(ctx, variant_of).select("direction", F.explode(F.array_distinct("words")).alias("word"), "freq")
    return words.groupBy("direction", "word").agg(F.sum("freq").alias("f")).join(total, "direction").where(F.col("f") / F.col("total") >= min_word_prob).select("direction", "word")


def normalised_words(ctx: DataFrame, variant_of: DataFrame | None = None) -> DataFrame:
    """ctx with ``words``: the context's words, each variant as its preferred form."""
    split = ctx.withColumn("words", F.filter(F.split(F.trim("context"), r"\s+"), lambda w: w != ""))
    if variant_of is None:
        return split
    at = split.select("direction", "phrase", "context", "freq", F.posexplode("words").alias("p", "variant")).join(variant_of, "variant", "left")
    back = at.groupBy("direction", "phrase", "context", "freq").agg(F.array_sort(F.collect_list(F.struct("p", F.coalesce("preferred", "variant").alias("w")))).alias("r"))
    return back.select("direction", "phrase", "context", "freq", F.transform("r", lambda x: x["w"]).alias("words"))


class PhraseContext:
    """Contexts of phrases (main, variants, ord) in sentences (doc_id, tokens), and what follows from them."""

    def __init__(self, phrases: DataFrame, sentences: DataFrame, variant_of: DataFrame | None = None, context_size: int = 5):
        self.phrases, self.variant_of = main_phrases(phrases), variant_of
        self.occurrences = occurrences(sentences, self.phrases, context_size)

    def count_phrase_contexts(self) -> DataFrame:
        return context_counts(self.occurrences)

    def transitions(self, phrase: str | None = None, **options) -> DataFrame:
        from setphrase.operators import transitions

        ctx = self.count_phrase_contexts()
        return transitions.probabilities(ctx.where(F.col("phrase") == phrase) if phrase else ctx, variant_of=self.variant_of, **options)


def period_totals(occ: DataFrame, period_col: str) -> DataFrame:
    """(period, phrase, freq, share of the period)."""
    counts = occ.groupBy(period_col, "phrase").agg(F.count("*").alias("freq"))
    return counts.withColumn("share", F.col("freq") / F.sum("freq").over(Window.partitionBy(period_col)))
