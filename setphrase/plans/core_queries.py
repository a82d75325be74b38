"""Queries from tokens to phrases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from setphrase.functions import tokens as T
from setphrase.operators import cooc, formulas, vocab
from setphrase.operators.search import PhraseSearch
from setphrase.plans import phrases_sql as S
from setphrase.plans.registry import query, read


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocab.tokenised(read(spark, sf_dir, "documents").where("text is not null"))


def search(spark: SparkSession, sf_dir: str, tf: int = S.TF, min_cooc: int = S.COOC) -> PhraseSearch:
    return PhraseSearch(corpus(spark, sf_dir), tf, S.SKIP, min_cooc)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frequencies of three-word formulas."""
    found = search(spark, sf_dir, 5, 5).extract_phrases("sub_phrases", min_phrase_length=2, max_phrase_length=3)
    return formulas.phrase_frequencies(found)


@query(f"with {S.DOCS} select doc_id, array_to_string(w, ' ') as tokens from docs")
def tokenize_docs(spark, sf_dir):
    return corpus(spark, sf_dir).select("doc_id", F.array_join("tokens", " ").alias("tokens"))


@query(f"with {S.DOCS} select doc_id, len(w)::bigint as n_tokens from docs")
def doc_lengths(spark, sf_dir):
    return corpus(spark, sf_dir).select("doc_id", F.size("tokens").cast("long").alias("n_tokens"))


@query(r"select doc_id, len(string_split(text, ' '))::bigint as n_tokens, len(list_filter(string_split(text, ' '), lambda x: x = ''))::bigint as n_empty from documents where text is not null")
def whitespace_tokens(spark, sf_dir):
    made = read(spark, sf_dir, "documents").where("text is not null").select("doc_id", T.blanks("text").alias("w"))
    return made.select("doc_id", F.size("w").cast("long").alias("n_tokens"), F.size(F.filter("w", lambda x: x == "")).cast("long").alias("n_empty"))


@query(f"with {S.VOCAB} select term, tf from tf")
def term_freq(spark, sf_dir):
    return vocab.term_frequencies(vocab.positions(corpus(spark, sf_dir)))


@query(f"with {S.TOK}, f as (select term, min(struct_pack(d := doc_id, p := pos)) as f, count(*) as tf from tok group by term) select term, row_number() over (order by f.d, f.p) - 1 as term_id, tf from f")
def vocab_ids(spark, sf_dir):
    return vocab.vocabulary_of(corpus(spark, sf_dir))


@query(f"with {S.VOCAB}, f as (select term, min(struct_pack(d := doc_id, p := pos)) as f from tok group by term), v as (select term, row_number() over (order by f.d, f.p) - 1 as term_id from f) select term, term_id, tf from minv join v using (term)")
def min_freq_vocab(spark, sf_dir):
    return search(spark, sf_dir).min_freq_vocab


@query(f"with {S.VOCAB} select sum(tf)::bigint as coll_size from minv")
def coll_size(spark, sf_dir):
    return search(spark, sf_dir).coll_size


@query(f"with {S.VOCAB} select term, tf from tf order by tf desc, term limit 50")
def top_terms(spark, sf_dir):
    return vocab.top(vocab.term_frequencies(vocab.positions(corpus(spark, sf_dir))), 50, "tf", "term")


@query(f"with {S.VOCAB} select coalesce(max(tf) filter (term = 'the'), 0) as tf from tf")
def term_lookup(spark, sf_dir):
    return vocab.frequency_of(vocab.term_frequencies(vocab.positions(corpus(spark, sf_dir))), "the")


def _ngram_sql(n: int) -> str:
    leads = " || ' ' || ".join(["term"] + [f"lead(term, {k}) over o" for k in range(1, n)])
    return f"with {S.TOK}, g as (select {leads} as ngram from tok window o as (partition by doc_id order by pos)) select ngram, count(*) as freq from g where ngram is not null group by ngram"


def _ngram_counts(spark, sf_dir, n):
    return cooc.gram_counts(corpus(spark, sf_dir), n).select(F.array_join("terms", " ").alias("ngram"), "freq")


@query(_ngram_sql(2))
def ngrams_2(spark, sf_dir):
    return _ngram_counts(spark, sf_dir, 2)


@query(_ngram_sql(3))
def ngrams_3(spark, sf_dir):
    return _ngram_counts(spark, sf_dir, 3)


_SKIPS = ", ".join(f"term || ' ' || lead(term, {a}) over o || ' ' || lead(term, {b}) over o" for _, a, b in T.skip_offsets(3, 1))


@query(f"with {S.TOK}, g as (select unnest([{_SKIPS}]) as ngram from tok window o as (partition by doc_id order by pos)) select ngram, count(*) as freq from g where ngram is not null group by 1")
def skip_ngrams_3_1(spark, sf_dir):
    return cooc.gram_counts(corpus(spark, sf_dir), 3, 1).select(F.array_join("terms", " ").alias("ngram"), "freq")


@query(f"with {S.TOK} select a.term as t1, b.term as t2, count(*) as freq from tok a join tok b on a.doc_id = b.doc_id and b.pos = a.pos + 1 group by 1, 2")
def skip_cooc_0(spark, sf_dir):
    return cooc.cooccurrences(corpus(spark, sf_dir), 0)


@query(f"with {S.PAIRS} select t1, t2, freq from cooc")
def skip_cooc_4(spark, sf_dir):
    return search(spark, sf_dir).cooc


@query(f"with {S.PAIRS} select t1, t2, freq from cooc where t1 = 'the' or t2 = 'the'")
def cooc_of_term(spark, sf_dir):
    return cooc.of_term(search(spark, sf_dir).cooc, "the")


@query(f"with {S.PAIRS} select t1, t2, freq from cooc order by freq desc, t1, t2 limit 100")
def top_cooc(spark, sf_dir):
    return vocab.top(search(spark, sf_dir).cooc, 100, "freq", "t1", "t2")


@query(f"with {S.PAIRS}, f as (select term, min(struct_pack(d := doc_id, p := pos)) as f from tok group by term), v as (select term, row_number() over (order by f.d, f.p) - 1 as i from f) select a.i as id1, b.i as id2, freq from cooc join v a on a.term = t1 join v b on b.term = t2")
def cooc_ids(spark, sf_dir):
    return search(spark, sf_dir).cooc_with_ids.select("id1", "id2", "freq")


@query(f"with {S.chosen()} select doc_id, pos, sel from sel where sel is not null")
def selected_tokens(spark, sf_dir):
    return search(spark, sf_dir).selected().where("sel is not null").select("doc_id", "pos", "sel")


@query(f"with {S.chosen(2)} select doc_id, pos, sel from sel where sel is not null")
def selected_neigh2(spark, sf_dir):
    return search(spark, sf_dir).selected(min_neighbour_cooc=2).where("sel is not null").select("doc_id", "pos", "sel")


@query(f"with {S.ISLANDS} select doc_id, start::int as word_start, array_to_string(terms, ' ') as phrase from runs where len(terms) >= 3")
def long_phrases_k0(spark, sf_dir):
    return search(spark, sf_dir).extract_phrases("long_phrases", min_phrase_length=3).select("doc_id", "word_start", "phrase")


_GRAMS = "g as (select doc_id, start, terms, unnest(range(1, len(terms) - 1)) as i from runs where len(terms) > 2)"


@query(f"with {S.ISLANDS}, {_GRAMS} select doc_id, (start + i - 1)::int as word_start, array_to_string(terms[i:i + 2], ' ') as phrase from g")
def sub_phrases_k0(spark, sf_dir):
    return search(spark, sf_dir).extract_phrases("sub_phrases", min_phrase_length=2, max_phrase_length=3).select("doc_id", "word_start", "phrase")


@query(f"with {S.ISLANDS}, {_GRAMS} select array_to_string(terms[i:i + 2], ' ') as phrase, count(*) as freq from g group by 1")
def sub_phrase_freq(spark, sf_dir):
    return formulas.phrase_frequencies(search(spark, sf_dir).extract_phrases("sub_phrases", min_phrase_length=2, max_phrase_length=3))


@query(f"with {S.ISLANDS}, {_GRAMS} select array_to_string(terms[i:i + 2], ' ') as phrase, count(*) as freq from g group by 1 order by freq desc, phrase limit 100")
def top_formulas(spark, sf_dir):
    return vocab.top(sub_phrase_freq(spark, sf_dir), 100, "freq", "phrase")


@query(S.greedy(2, "select doc_id, start as word_start, phrase from runs where kept >= 3"))
def long_phrases_k2(spark, sf_dir):
    return search(spark, sf_dir).extract_phrases("long_phrases", min_phrase_length=3, max_variables=2).select("doc_id", "word_start", "phrase")


@query(S.greedy(2, "select doc_id, (start + i - 1)::int as word_start, array_to_string(terms[i:i + 4], ' ') as phrase from (select *, unnest(range(1, len(terms) - 3)) as i from runs where len(terms) > 3)"))
def sub_phrases_k2(spark, sf_dir):
    return search(spark, sf_dir).extract_phrases("sub_phrases", max_phrase_length=5, max_variables=2).select("doc_id", "word_start", "phrase")


@query(S.greedy(1, "select doc_id, start as word_start, phrase, variables from runs where kept >= 3"))
def variable_terms(spark, sf_dir):
    found = search(spark, sf_dir).extract_phrases("long_phrases", min_phrase_length=3, max_variables=1)
    return found.select("doc_id", "word_start", "phrase", F.array_join("variable_terms", " ").alias("variables"))


_WINDOW = """win as (select doc_id, pos, list(sel) over o as terms, count(sel) over o as kept, count(*) over o as n, sel from sel window o as (partition by doc_id order by pos rows between current row and 4 following))"""


@query(f"with {S.chosen()}, {_WINDOW} select doc_id, pos as word_start, array_to_string([coalesce(t, '<VAR>') for t in terms], ' ') as phrase from win where sel is not null and n = 5 and 5 - kept < 3")
def window_5_candidates(spark, sf_dir):
    return search(spark, sf_dir).extract_phrases("candidate_phrases", min_length=3, max_length=5).select("doc_id", "word_start", "phrase")


_TOP20 = f"with {S.ISLANDS}, {_GRAMS}, p as materialized (select doc_id, (start + i - 1)::int as word_start, array_to_string(terms[i:i + 2], ' ') as phrase from g), best as (select phrase from p group by 1 order by count(*) desc, phrase limit 20)"


@query(f"{_TOP20} select phrase, doc_id, count(*) as freq from p where phrase in (select phrase from best) group by 1, 2")
def candidate_doc_index(spark, sf_dir):
    s, options = search(spark, sf_dir), {"min_phrase_length": 2, "max_phrase_length": 3}
    best = vocab.top(formulas.phrase_frequencies(s.extract_phrases("sub_phrases", **options)), 20, "freq", "phrase")
    return s.index_candidate_docs(best, **options)


@query(f"{_TOP20} select doc_id, phrase, word_start, phrase as surface from p where phrase in (select phrase from best)")
def candidate_variables(spark, sf_dir):
    s, options = search(spark, sf_dir), {"min_phrase_length": 2, "max_phrase_length": 3}
    best = vocab.top(formulas.phrase_frequencies(s.extract_phrases("sub_phrases", **options)), 20, "freq", "phrase")
    return s.extract_candidate_variables("sub_phrases", best, **options)


@query(f"""with {S.TOK}, own as (select tok.*, lang = 'en' as own from tok join documents using (doc_id)), f as (select term, min(struct_pack(d := doc_id, p := pos)) filter (own) as f1, min(struct_pack(d := doc_id, p := pos)) filter (not own) as f2, count(*) as tf from own group by term)
select term, row_number() over (order by f1 is null, coalesce(f1, f2).d, coalesce(f1, f2).p) - 1 as term_id, tf from f""")
def extended_vocab(spark, sf_dir):
    """The vocabulary of the English documents, and then of the others."""
    docs = read(spark, sf_dir, "documents").where("text is not null")
    tok = lambda part: vocab.tokenised(docs.where(part))
    return vocab.extended_vocabulary(vocab.vocabulary_of(tok("lang = 'en'")), tok("lang <> 'en'"))


_CHARS = f"{S.ISLANDS}, ch as (select doc_id, pos, coalesce(sum(length(term) + 1) over (partition by doc_id order by pos rows between unbounded preceding and 1 preceding), 0)::bigint as c from tok)"


@query(f"with {_CHARS} select r.doc_id, array_to_string(terms, ' ') as phrase, start as word_start, c as char_start, c + length(array_to_string(terms, ' ')) as char_end from runs r join ch on ch.doc_id = r.doc_id and ch.pos = r.start where len(terms) >= 3")
def phrase_chars(spark, sf_dir):
    s = search(spark, sf_dir)
    return formulas.with_chars(s.extract_phrases("long_phrases"), s.tok).select("doc_id", "phrase", "word_start", "char_start", "char_end")
