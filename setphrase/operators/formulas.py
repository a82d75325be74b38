"""Selecting tokens by their neighbourhood and cutting documents into phrases with open slots."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from setphrase.functions import tokens as T
from setphrase.functions.lineage import cut, sized
from setphrase.operators.cooc import pairs

CONTEXT = 4


def selected(tok: DataFrame, vocab: DataFrame, cooc: DataFrame, min_cooc_freq: int, min_neighbour_cooc: int = 1, window: int = CONTEXT) -> DataFrame:
    """(doc_id, pos, term, sel): sel is the term if it occurs at least min_cooc_freq times and at least
    min_neighbour_cooc positions within the window hold a term that co-occurs with it as often; else null.

    Every pair of neighbours is formed once and credits both its positions. Tokens are looked up
    in the vocabulary once for both uses.
    """
    known = tok.join(vocab.select("term", F.col("term").alias("st"), "tf"), "term", "left")
    held = known.select("doc_id", "pos", "term", F.when(F.col("tf") >= min_cooc_freq, F.col("st")).alias("st"))
    near = pairs(known.select("doc_id", "pos", "st"), window)
    strong = near.join(cooc.where(F.col("freq") >= min_cooc_freq).select("t1", "t2"), ["t1", "t2"], "left_semi")
    credit = strong.select("doc_id", F.explode(F.array("pos", F.col("pos") + F.col("d"))).alias("pos"))
    enough = credit.groupBy("doc_id", "pos").agg(F.count("*").alias("n")).where(F.col("n") >= min_neighbour_cooc)
    if min_neighbour_cooc <= 0:
        return held.select("doc_id", "pos", "term", F.col("st").alias("sel"))
    found = held.join(enough, ["doc_id", "pos"], "left")
    return found.select("doc_id", "pos", "term", F.when(F.col("n").isNotNull(), F.col("st")).alias("sel"))


def sequences(sel: DataFrame) -> DataFrame:
    """(doc_id, tokens, sel) as arrays; open positions are null."""
    rows = F.array_sort(F.collect_list(F.struct("pos", "term", "sel")))
    made = sel.groupBy("doc_id").agg(rows.alias("r"))
    return made.select("doc_id", F.transform("r", lambda x: x["term"]).alias("tokens"), F.transform("r", lambda x: x["sel"]).alias("sel"))


def _islands(sel: DataFrame) -> DataFrame:
    """Runs without slots: a run's key is the number of nulls before it."""
    island = F.sum(F.col("sel").isNull().cast("int")).over(Window.partitionBy("doc_id").orderBy("pos"))
    runs = sel.withColumn("g", island).where("sel is not null").groupBy("doc_id", "g").agg(F.array_sort(F.collect_list(F.struct("pos", "sel"))).alias("r"))
    terms = F.transform("r", lambda x: x["sel"])
    return runs.select("doc_id", F.col("r")[0]["pos"].alias("start"), terms.alias("terms"), terms.alias("span"))


def runs(sel: DataFrame, max_variables: int = 0) -> DataFrame:
    """(doc_id, start, terms, span), and char_start if sel has chars: greedy runs that open at a selected token and close at null number max_variables + 1.

    Nulls in terms are slots, span holds the document's own tokens. With slots allowed, a fold
    over each document keeps only the runs' bounds.
    """
    if max_variables == 0:
        return _islands(sel) if "tokens" not in sel.columns else _parts_of_rows(sel, _island_bounds())
    docs = sel if "tokens" in sel.columns else sequences(sel)
    bounds = "struct<s:int,e:int>"
    empty = F.struct(F.array().cast(f"array<{bounds}>").alias("done"), F.lit(-1).alias("open"), F.lit(0).alias("nulls"), F.lit(0).alias("i"))

    def step(acc, x):
        shut = x.isNull() & (acc["open"] >= 0) & (acc["nulls"] >= max_variables)
        done = F.when(shut, F.concat(acc["done"], F.array(F.struct(acc["open"].alias("s"), acc["i"].alias("e"))))).otherwise(acc["done"])
        open_ = F.when(shut, F.lit(-1)).when((acc["open"] < 0) & x.isNotNull(), acc["i"]).otherwise(acc["open"])
        nulls = F.when(shut, F.lit(0)).when((acc["open"] >= 0) & x.isNull(), acc["nulls"] + 1).otherwise(acc["nulls"])
        return F.struct(done.alias("done"), open_.alias("open"), nulls.alias("nulls"), (acc["i"] + 1).alias("i"))

    last = lambda acc: F.when(acc["open"] >= 0, F.concat(acc["done"], F.array(F.struct(acc["open"].alias("s"), acc["i"].alias("e"))))).otherwise(acc["done"])
    return _parts_of_rows(docs, F.aggregate("sel", empty, step, last))


def _island_bounds():
    """array<struct<s, e>>: runs of selected tokens in the array sel; e is behind the last."""
    at = F.sequence(F.lit(0), F.greatest(F.size("sel") - 1, F.lit(0)))
    edge = lambda step: F.filter(at, lambda i: F.get("sel", i).isNotNull() & F.get("sel", i + step).isNull())
    return F.arrays_zip(edge(-1).alias("s"), F.transform(edge(1), lambda i: i + 1).alias("e"))


def _parts_of_rows(docs: DataFrame, bounds) -> DataFrame:
    part = lambda c, b: F.slice(c, b["s"] + 1, b["e"] - b["s"])
    made = lambda b: F.struct(b["s"].alias("start"), part("sel", b).alias("terms"), part("tokens", b).alias("span"), *([F.get("chars", b["s"]).alias("char_start")] if "chars" in docs.columns else []))
    return docs.select("doc_id", F.inline(F.transform(bounds, made)))


def long_phrases(sel: DataFrame, min_phrase_length: int = 3, max_variables: int = 0) -> DataFrame:
    """Whole runs with at least so many selected tokens, as matches; with char_start and char_end if sel has chars."""
    found = runs(sel, max_variables).where(F.size(F.filter("terms", lambda t: t.isNotNull())) >= min_phrase_length)
    return _matches(found, F.col("start"), F.col("terms"), F.col("span"))


def sub_phrases(sel: DataFrame, min_phrase_length: int = 3, max_phrase_length: int = 5, max_variables: int = 0, max_skips: int = 0) -> DataFrame:
    """n-grams (n = max_phrase_length, with up to max_skips tokens left out) of runs that are longer than
    min_phrase_length (slots count), as matches."""
    held = runs(sel, max_variables).where(F.size("terms") > min_phrase_length)
    grams = held.select("doc_id", "start", "span", F.explode(T.skip_ngrams("terms", max_phrase_length, max_skips)).alias("g"))
    span = F.slice("span", F.col("g.start") + 1, max_phrase_length)
    return _matches(grams, F.col("start") + F.col("g.start"), F.col("g.terms"), span)


def candidate_phrases(sel: DataFrame, min_length: int = 3, max_length: int = 5) -> DataFrame:
    """Windows of max_length from every selected token, unless at least min_length of it are slots."""
    if "tokens" in sel.columns:
        at = F.when(F.size("sel") >= max_length, F.sequence(F.lit(0), F.size("sel") - max_length)).otherwise(F.array().cast("array<int>"))
        window = lambda c, i: F.slice(c, i + 1, max_length)
        fits = F.filter(at, lambda i: F.get("sel", i).isNotNull() & (F.size(F.filter(window("sel", i), lambda t: t.isNull())) < min_length))
        rows = sel.select("doc_id", F.inline(F.transform(fits, lambda i: F.struct(i.alias("start"), window("sel", i).alias("terms"), window("tokens", i).alias("span")))))
        return _matches(rows, F.col("start"), F.col("terms"), F.col("span"))
    order = Window.partitionBy("doc_id").orderBy("pos")
    ahead = [F.lead("sel", k).over(order).alias(f"_{k}") for k in range(1, max_length)]
    words = [F.lead("term", k).over(order).alias(f"w{k}") for k in range(1, max_length)]
    rows = sel.select("doc_id", "pos", "sel", "term", *ahead, *words, F.lead("pos", max_length - 1).over(order).alias("last"))
    rows = rows.where("sel is not null and last is not null")
    rows = rows.withColumn("terms", F.array("sel", *[f"_{k}" for k in range(1, max_length)])).withColumn("span", F.array("term", *[f"w{k}" for k in range(1, max_length)]))
    return _matches(rows.where(F.size(F.filter("terms", lambda t: t.isNull())) < min_length), F.col("pos"), F.col("terms"), F.col("span"))


def _matches(df: DataFrame, start, terms, span) -> DataFrame:
    """(doc_id, phrase, terms, word_start, word_end, variable_match, variable_terms)."""
    at = ["char_start"] if "char_start" in df.columns else []
    rows = df.select("doc_id", start.cast("int").alias("word_start"), terms.alias("_t"), span.alias("variable_match"), *at)
    found = rows.select(
        "doc_id",
        T.rendered("_t").alias("phrase"),
        F.transform("_t", lambda t: F.coalesce(t, F.lit(T.VAR))).alias("terms"),
        "word_start",
        (F.col("word_start") + F.size("_t")).alias("word_end"),
        "variable_match",
        T.variable_terms("_t", "variable_match").alias("variable_terms"),
        *at,
    )
    return found.withColumn("char_end", F.col("char_start") + F.length("phrase")) if at else found


def char_starts(tok: DataFrame) -> DataFrame:
    """(doc_id, pos, char_start): where each token begins in its document's tokens joined by blanks."""
    before = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return tok.select("doc_id", "pos", F.coalesce(F.sum(F.length("term") + 1).over(before), F.lit(0)).alias("char_start"))


def with_chars(matches: DataFrame, tok: DataFrame) -> DataFrame:
    """matches with char_start and char_end in the document's tokens joined by blanks; a slot counts as it is written in the phrase."""
    if "char_start" in matches.columns:
        return matches
    at = char_starts(tok).withColumnRenamed("pos", "word_start")
    return matches.join(at, ["doc_id", "word_start"]).withColumn("char_end", F.col("char_start") + F.length("phrase"))


def phrase_frequencies(matches: DataFrame) -> DataFrame:
    return matches.groupBy("phrase").agg(F.count("*").alias("freq"))


def candidate_index(matches: DataFrame, candidates: DataFrame) -> DataFrame:
    """(phrase, doc_id, freq): where the given candidates occur, an entry for each document."""
    return matches.join(sized(cut(candidates.select("phrase").distinct())), "phrase", "left_semi").groupBy("phrase", "doc_id").agg(F.count("*").alias("freq"))


def candidate_variables(matches: DataFrame, candidates: DataFrame) -> DataFrame:
    """(doc_id, phrase, word_start, surface): the document's words at each match of the candidates."""
    found = matches.join(sized(cut(candidates.select("phrase").distinct())), "phrase", "left_semi")
    return found.select("doc_id", "phrase", "word_start", F.array_join("variable_match", " ").alias("surface"))
