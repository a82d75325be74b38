"""Queries over contexts, transitions, collocations, keyness and patterns."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from setphrase.functions import tokens as T
from setphrase.operators import colloc, context, cooc, keyness, patterns, transitions, vocab
from setphrase.plans import phrases_sql as S
from setphrase.plans.core_queries import corpus
from setphrase.plans.registry import query, read

PHRASES = [("of the", ["in the"], 0), ("and the", [], 1), ("that the", ["with the"], 2)]
_PAIRS = ", ".join(f"('{p}', '{m}')" for m, vs, _ in PHRASES for p in (m, *vs))
OCC = f"""{S.DOCS}, ph(phrase, main) as (values {_PAIRS}), spots as (select doc_id, w, unnest(range(1, len(w))) as i from docs where len(w) > 1),
occ as materialized (select doc_id, main as phrase, w[greatest(i - 5, 1):i - 1] as pre, w[i + 2:i + 6] as post from spots join ph on w[i] || ' ' || w[i + 1] = ph.phrase)"""
CTX = f"""{OCC}, ctx as materialized (select direction, phrase, context, count(*) as freq from (select 'pre' as direction, phrase, array_to_string(pre, ' ') as context from occ where len(pre) > 0
  union all select 'post', phrase, array_to_string(post, ' ') from occ where len(post) > 0) group by all)"""


def occurrences(spark, sf_dir):
    phrases = spark.createDataFrame(PHRASES, "main string, variants array<string>, ord int")
    return context.occurrences(corpus(spark, sf_dir), context.main_phrases(phrases))


def contexts(spark, sf_dir):
    return context.context_counts(occurrences(spark, sf_dir))


@query(f"with {OCC} select phrase, count(*) as freq from occ group by phrase")
def phrase_counts(spark, sf_dir):
    return context.phrase_counts(occurrences(spark, sf_dir))


@query(f"with {CTX} select * from ctx")
def phrase_context_counts(spark, sf_dir):
    return contexts(spark, sf_dir)


@query(f"with {CTX} select direction, word, sum(freq)::bigint as freq from (select direction, unnest(string_split(context, ' ')) as word, freq from ctx) group by all")
def context_word_freq(spark, sf_dir):
    return context.context_words(contexts(spark, sf_dir))


_VARIANTS = [("a", "the"), ("and", "or")]
_VALUES = ", ".join(f"('{a}', '{b}')" for a, b in _VARIANTS)
_DOM = f"{CTX}, v(variant, preferred) as (values {_VALUES}), cw as (select unnest(string_split(context, ' ')) as word, freq from ctx), f as (select coalesce(preferred, word) as word, sum(freq)::bigint as freq from cw left join v on v.variant = cw.word group by 1)"


def _dominant(spark, sf_dir):
    words = context.context_words(contexts(spark, sf_dir)).groupBy("word").agg(F.sum("freq").alias("freq"))
    return context.dominant_terms(words, spark.createDataFrame(_VARIANTS, "variant string, preferred string"), 0.02)


@query(f"with {_DOM} select word, freq from f where freq / (select sum(freq) from f) >= 0.02")
def dominant_terms(spark, sf_dir):
    return _dominant(spark, sf_dir)


@query(f"with {_DOM} select word, replace('<VAR> of the', '<VAR>', word) as phrase from f where freq / (select sum(freq) from f) >= 0.02")
def dominant_phrases(spark, sf_dir):
    return context.dominant_phrases("<VAR> of the", _dominant(spark, sf_dir))


@query(f"with {CTX} select direction, context, sum(freq)::bigint as freq from ctx group by all")
def merged_contexts(spark, sf_dir):
    return context.merged_phrases(contexts(spark, sf_dir))


@query(f"""with {CTX}, p as (select direction, freq, string_split(context, ' ') as c from ctx where freq > 1), e as (select direction, freq, c, unnest(range(1, len(c) + 1)) as n from p)
select direction, array_to_string(case when direction = 'post' then c[1:n] else c[len(c) - n + 1:len(c)] end, ' ') as sub_phrase, sum(freq)::bigint as freq from e group by all""")
def prefix_suffix_freq(spark, sf_dir):
    return context.sub_contexts(contexts(spark, sf_dir))


@query(f"""with {OCC}, o as (select occ.*, source from occ join documents using (doc_id) where source in ('src0', 'src1', 'src2'))
select direction, phrase, context, count(*) as freq from (select 'pre' as direction, phrase, array_to_string(pre, ' ') as context from o where len(pre) > 0 union all select 'post', phrase, array_to_string(post, ' ') from o where len(post) > 0) group by all""")
def period_rollup(spark, sf_dir):
    source = read(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("period"))
    ctx = context.context_counts(occurrences(spark, sf_dir).join(source, "doc_id"), "period")
    return context.merged_periods(ctx, ["src0", "src1", "src2"])


# words that at least so many contexts hold; the rest become numbered slots
_PROB = 0.05
SEL = f"""{CTX}, split as materialized (select *, list_filter(string_split(context, ' '), lambda x: x <> '') as words from ctx), tot as (select direction, sum(freq) as total from ctx group by 1),
cwf as (select direction, word, sum(freq) as f from (select direction, freq, unnest(list_distinct(words)) as word from split) group by 1, 2),
keep as materialized (select direction, list(word) as ws from cwf join tot using (direction) where f / total >= {_PROB} group by 1)"""
PATHS = f"""{SEL}, turned as (select s.direction, freq, coalesce(ws, []) as ws, case when s.direction = 'pre' then list_reverse(words) else words end as r from split s left join keep using (direction)),
paths as materialized (select direction, freq, list_prepend('<PHRASE>', [case when list_contains(ws, x) then x else '<VAR-' || (i - 1) || '>' end for x, i in r]) as path from turned)"""
STEPS = f"{PATHS}, st as (select direction, freq, path, unnest(range(1, len(path))) as i from paths where len(path) > 1)"
MARKOV = f"{STEPS}, edges as materialized (select direction, [path[i]] as src, [path[i + 1]] as dst, sum(freq)::bigint as freq from st group by all), probs as materialized (select *, freq / sum(freq) over (partition by direction, src) as prob from edges)"
TRIE = f"{STEPS}, edges as materialized (select direction, path[1:i] as src, path[1:i + 1] as dst, sum(freq)::bigint as freq from st group by all), probs as materialized (select *, freq / sum(freq) over (partition by direction, src) as prob from edges)"
_SHOW = "direction, array_to_string(src, ' ') as src, array_to_string(dst, ' ') as dst, freq"


def _shown(edges):
    made = edges.select("direction", F.array_join("src", " ").alias("src"), F.array_join("dst", " ").alias("dst"), "freq", *(["prob"] if "prob" in edges.columns else []))
    return made.withColumn("prob", F.round("prob", 6)) if "prob" in made.columns else made


@query(f"with {SEL} select direction, unnest(ws) as word from keep")
def selected_context_words(spark, sf_dir):
    return context.selected_words(contexts(spark, sf_dir), None, _PROB)


@query(f"with {MARKOV} select {_SHOW} from edges")
def transition_freq_markov(spark, sf_dir):
    return _shown(transitions.counts(contexts(spark, sf_dir), False, _PROB))


@query(f"with {TRIE} select {_SHOW} from edges")
def transition_freq_trie(spark, sf_dir):
    return _shown(transitions.counts(contexts(spark, sf_dir), True, _PROB))


@query(f"with {STEPS}, ok as (select * from st where not exists (select 1 from (select unnest(path[2:i + 1]) as x) where x like '<VAR%')) select direction, array_to_string(path[1:i], ' ') as src, array_to_string(path[1:i + 1], ' ') as dst, sum(freq)::bigint as freq from ok group by all")
def transition_freq_no_var(spark, sf_dir):
    return _shown(transitions.counts(contexts(spark, sf_dir), True, _PROB, exclude_var=True))


@query(f"with {TRIE} select {_SHOW}, round(prob, 6) as prob from probs")
def transition_probs(spark, sf_dir):
    return _shown(transitions.shares(transitions.counts(contexts(spark, sf_dir), True, _PROB)))


@query(f"""with {TRIE}, pre as (select direction, dst as node, unnest(range(2, len(dst) + 1)) as n from probs), weak as (select distinct pre.direction, node from pre join probs p on p.direction = pre.direction and p.dst = node[1:n] where p.prob < 0.02)
select {_SHOW}, round(prob, 6) as prob from probs where not exists (select 1 from weak where weak.direction = probs.direction and weak.node = probs.dst)""")
def pruned_trie(spark, sf_dir):
    return _shown(transitions.probabilities(contexts(spark, sf_dir), 0.02, _PROB, tree=True))


_REACH = f"with recursive {MARKOV}, kept as materialized (select * from probs where prob >= 0.05), reach as (select distinct direction, ['<PHRASE>'] as node from kept union select k.direction, k.dst from reach r join kept k on k.direction = r.direction and k.src = r.node)"


@query(f"{_REACH} select direction, node[1] as node from reach")
def reachable_nodes(spark, sf_dir):
    edges = transitions.pruned_words(transitions.shares(transitions.counts(contexts(spark, sf_dir), False, _PROB)), 0.05)
    return transitions.reachable(edges).select("direction", F.col("node")[0].alias("node"))


@query(f"{_REACH} select {_SHOW}, round(prob, 6) as prob from kept k where exists (select 1 from reach r where r.direction = k.direction and r.node = k.src)")
def pruned_markov(spark, sf_dir):
    return _shown(transitions.probabilities(contexts(spark, sf_dir), 0.05, _PROB, tree=False))


@query(f"""with recursive {MARKOV}, step as materialized (select direction, src[1] as a, dst[1] as b, prob from probs where dst[1] not like '%<VAR-%' and src[1] <> dst[1]),
x as (select distinct direction, ['<PHRASE>'] as path, 1.0::double as p from probs union all select x.direction, list_append(path, b), p * prob from x join step s on s.direction = x.direction and s.a = path[len(path)]
  where p * prob >= 0.02 and len(list_filter(list_append(path, b), lambda w: w = b)) <= 2),
par as (select direction, path[1:len(path) - 1] as path, max((p >= 0.9)::int) as m from x where len(path) > 1 group by all)
select x.direction, array_to_string(x.path, ' ') as path, round(p, 6) as prob, case when p >= 0.9 then 'main' else 'split' end as kind from x left join par on par.direction = x.direction and par.path = x.path where m is null or (p >= 0.9 and m = 0)""")
def phrase_extensions(spark, sf_dir):
    edges = transitions.shares(transitions.counts(contexts(spark, sf_dir), False, _PROB))
    found = transitions.extensions(edges, min_split_prob=0.02)
    return found.select("direction", F.array_join("path", " ").alias("path"), F.round("prob", 6).alias("prob"), "kind")


@query()
def extended_phrases(spark, sf_dir):
    return transitions.extend_phrase("of the", contexts(spark, sf_dir), None, 0.02, _PROB)


@query(f"""{_REACH}, named as (select replace(replace(src[1], '<PHRASE>', 'of the'), '"', chr(39)) as a, replace(replace(dst[1], '<PHRASE>', 'of the'), '"', chr(39)) as b, prob
  from kept k where direction = 'post' and exists (select 1 from reach r where r.direction = k.direction and r.node = k.src)), lines as (select '  "' || a || '" -> "' || b || '" [label="' || printf('%.2f', prob) || '"];' as line from named)
select (row_number() over (order by line))::int as line_no, line from lines union all select 0, 'digraph {{' union all select 1073741824, '}}'""")
def transition_dot(spark, sf_dir):
    return transitions.dot(transitions.probabilities(contexts(spark, sf_dir), 0.05, _PROB, tree=False), "of the", "post")


BIG = f"""{S.TOK}, two as (select a.term as w1, unnest([lead(term, 1) over o, lead(term, 2) over o]) as w2 from tok a window o as (partition by doc_id order by pos)),
bi as materialized (select w1, w2, count(*) as n_ii from two where w2 is not null group by 1, 2),
m as materialized (select w1, w2, n_ii, (sum(n_ii) over (partition by w1))::bigint as n_ix, (sum(n_ii) over (partition by w2))::bigint as n_xi, (sum(n_ii) over ())::bigint as n_xx from bi)"""
_T = "1e-20"
_LLR = "2 * (" + " + ".join(f"({o}) * ln(({o}) / ({r}::double * ({c}) / n_xx + {_T}) + {_T})" for o, r, c in (("n_ii", "(n_ix)", "n_xi"), ("(n_ix - n_ii)", "(n_ix)", "n_xx - n_xi"), ("(n_xi - n_ii)", "(n_xx - n_ix)", "n_xi"), ("(n_xx - n_ix - n_xi + n_ii)", "(n_xx - n_ix)", "n_xx - n_xi"))) + ")"


def _bigrams(spark, sf_dir):
    return colloc.bigram_counts(corpus(spark, sf_dir))


@query(f"with {BIG} select * from m")
def bigram_marginals(spark, sf_dir):
    return _bigrams(spark, sf_dir)


@query(f"with {BIG} select w1, w2, round({_LLR}, 3) as score from m where n_ii >= 5")
def bigram_llr(spark, sf_dir):
    return colloc.scored(_bigrams(spark, sf_dir)).where("n_ii >= 5").select("w1", "w2", F.round("score", 3).alias("score"))


@query(f"with {BIG} select w1, w2, round(log2(n_ii::double / n_xx) - log2(n_ix::double * n_xi), 5) as score from m where n_ii >= 5")
def bigram_pmi(spark, sf_dir):
    return colloc.scored(_bigrams(spark, sf_dir), colloc.pmi()).where("n_ii >= 5").select("w1", "w2", F.round("score", 5).alias("score"))


@query(f"with {BIG}, s as (select w1, w2, round({_LLR}, 3) as score from m) select * from s order by score desc, w1, w2 limit 100")
def nbest_bigrams(spark, sf_dir):
    return colloc.nbest(colloc.scored(_bigrams(spark, sf_dir)).select("w1", "w2", F.round("score", 3).alias("score")), 100)


@query(f"with {BIG}, s as (select w1, w2, round({_LLR}, 3) as score from m) select * from s where score > 50")
def above_score(spark, sf_dir):
    return colloc.above(colloc.scored(_bigrams(spark, sf_dir)).select("w1", "w2", F.round("score", 3).alias("score")), 50.0)


@query(f"""with recursive {BIG}, s as (select w1, w2, round({_LLR}, 3) as score from m), best as (select * from s order by score desc, w1, w2 limit 100),
r as materialized (select *, row_number() over (order by score desc, w1, w2) as k from best where length(w1) + length(w2) >= 9),
g as (select 0::bigint as k, []::varchar[] as used, false as taken union all
  select g.k + 1, case when list_contains(used, w1) or list_contains(used, w2) then used else list_concat(used, [w1, w2]) end, not (list_contains(used, w1) or list_contains(used, w2)) from g join r on r.k = g.k + 1)
select w1, w2, score from g join r using (k) where taken""")
def non_overlapping_bigrams(spark, sf_dir):
    return colloc.non_overlapping(nbest_bigrams(spark, sf_dir))


_MERGES = [colloc.VariantPairs([(("of", "the"), ("of", "the")), (("in", "the"), ("of", "the"))]), colloc.VariantPairs([(("of__the", "and"), ("of__the", "and"))])]


@query()
def merged_tokens(spark, sf_dir):
    return colloc.merged_units(corpus(spark, sf_dir), _MERGES, with_indexes=False).select("doc_id", F.array_join("units", " ").alias("units"))


@query()
def merged_bigrams(spark, sf_dir):
    return colloc.merged_bigram_counts(corpus(spark, sf_dir), _MERGES)


@query(f"""with {S.TOK}, l as (select tok.term as token, lang = 'en' as own from tok join documents using (doc_id)), a as (select token, count(*) as a from l where own group by 1), b as (select token, count(*) as b from l where not own group by 1),
t as (select token, a::double as a, coalesce(b, 0)::double as b, (select sum(a) from a)::double as n1, (select sum(b) from b)::double as n2 from a left join b using (token)),
k as (select token, 2 * (a * ln(a / (n1 * (a + b) / (n1 + n2))) + case when b > 0 then b * ln(b / (n2 * (a + b) / (n1 + n2))) else 0 end) as llr, case when b > 0 then b / n2 else 1e-18 end as r, a / n1 as s, b / n2 as rb from t)
select token, round(llr, 3) as llr, b_0 as absent from (select *, rb = 0 as b_0 from k) where s > rb and llr >= 10.83 and 100 * (s - r) / r >= 100""")
def key_tokens(spark, sf_dir):
    tok = vocab.positions(corpus(spark, sf_dir)).join(read(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    count = lambda df: df.groupBy(F.col("term").alias("token")).agg(F.count("*").alias("freq"))
    found = keyness.key_tokens(count(tok.where("lang = 'en'")), count(tok.where("lang <> 'en'")))
    return found.select("token", F.round("llr", 3).alias("llr"), (F.col("perc_diff") > 1e12).alias("absent"))


_KEYS = ["the", "and", "of"]


@query(f"""with {CTX}, k as (select direction, context, string_split(context, ' ') as c from ctx), p as (select *, list_filter([list_position(c, x) for x in {_KEYS}], lambda i: i > 0) as h from k)
select direction, context, case when len(h) = 0 then null when direction = 'post' then array_to_string(c[1:list_max(h)], ' ') else array_to_string(c[list_min(h):len(c)], ' ') end as trimmed from p group by all""")
def key_phrase_trim(spark, sf_dir):
    ctx = context.merged_phrases(contexts(spark, sf_dir))
    return ctx.select("direction", "context", F.when(F.col("direction") == "post", T.key_phrase("context", _KEYS, "post")).otherwise(T.key_phrase("context", _KEYS, "pre")).alias("trimmed"))


_RUNS = " ".join(f"when least(len(x), len(y)) >= {n} and x[len(x) - {n - 1}:len(x)] = y[1:{n}] then array_to_string(y[1:{n}], ' ') when least(len(x), len(y)) >= {n} and y[len(y) - {n - 1}:len(y)] = x[1:{n}] then array_to_string(x[1:{n}], ' ')" for n in (6, 5, 4, 3))


@query(f"""with {S.DOCS}, i as (select doc_id, w, unnest(range(1, len(w) + 1, 3))::int as i from docs), p as (select doc_id, i - 1 as start, w[i:i + 5] as x, w[i + 3:i + 8] as y from i),
s as (select *, array_to_string(x, ' ') as a, array_to_string(y, ' ') as b from p)
select doc_id, start, case when contains(b, a) then a when contains(a, b) then b {_RUNS} end as overlap from s""")
def partial_overlap(spark, sf_dir):
    """Of all pairs of six-word windows three words apart."""
    return patterns.window_overlaps(corpus(spark, sf_dir), 6, 3)


@query(f"with {S.TOK}, l as (select doc_id, pos, term, lead(term) over (partition by doc_id order by pos) as after from tok) select doc_id, pos as start from l where term = 'of' and after = 'the'")
def pattern_positions(spark, sf_dir):
    return patterns.find(corpus(spark, sf_dir), ["of", "the"])


@query(f"with {S.DOCS} select doc_id, contains(' ' || array_to_string(w, ' ') || ' ', ' of the ') as found from docs")
def pattern_in_doc(spark, sf_dir):
    return patterns.contains(corpus(spark, sf_dir), ["of", "the"])


@query(f"with {S.TOK}, p(labels) as (values (['of', 'the']), (['and', 'of', 'the']), (['the'])), l as (select doc_id, pos, array[term, lead(term) over o, lead(term, 2) over o] as t from tok window o as (partition by doc_id order by pos)) select doc_id, pos as start, array_to_string(labels, ' ') as pattern from l join p on t[1:len(labels)] = labels")
def pattern_index(spark, sf_dir):
    wanted = spark.createDataFrame([(["of", "the"],), (["and", "of", "the"],), (["the"],)], "labels array<string>")
    return patterns.find_all(corpus(spark, sf_dir), wanted).select("doc_id", "start", F.array_join("pattern", " ").alias("pattern"))


@query(f"with {S.TOK}, g as (select [term, lead(term) over o, lead(term, 2) over o] as t from tok window o as (partition by doc_id order by pos)) select array_to_string(list_sort(list_distinct(t)), ' ') as key, array_to_string(t, ' ') as ids, count(*) as freq from g where t[3] is not null group by all having count(*) > 1")
def phrase_pattern_groups(spark, sf_dir):
    counted = cooc.gram_counts(corpus(spark, sf_dir), 3, least=2)
    return counted.select(F.array_join(T.set_key("terms"), " ").alias("key"), F.array_join("terms", " ").alias("ids"), "freq")


HALVES = f"{S.DOCS}, s as (select doc_id, w[1:len(w) // 2] as a, w[len(w) // 2 + 1:len(w)] as b from docs)"


def _halves(spark, sf_dir):
    docs = corpus(spark, sf_dir).withColumn("half", F.floor(F.size("tokens") / 2).cast("int"))
    return docs.select("doc_id", F.slice("tokens", F.lit(1), F.col("half")).alias("a"), F.slice("tokens", F.col("half") + 1, F.size("tokens") - F.col("half")).alias("b"))


@query(f"""with {HALVES}, x as (select doc_id, unnest(a) as x, generate_subscripts(a, 1) as i from s), k as (select *, row_number() over (partition by doc_id, x order by i) as k from x),
y as (select doc_id, x, count(*) as n from (select doc_id, unnest(b) as x from s) group by 1, 2), o as (select doc_id, string_agg(x, ' ' order by i) as overlap from k join y using (doc_id, x) where k <= n group by 1)
select doc_id, coalesce(overlap, '') as overlap from s left join o using (doc_id)""")
def multiset_overlap(spark, sf_dir):
    """Of the two halves of each text."""
    found = patterns.multiset_overlaps(_halves(spark, sf_dir), "doc_id", "a", "b")
    return found.select("doc_id", F.array_join("overlap", " ").alias("overlap"))


@query(f"with {HALVES} select doc_id, coalesce(array_to_string(list_sort(list_intersect(list_distinct(a), list_distinct(b))), ' '), '') as shared, list_has_all(a, b) as contained, list_sort(list_distinct(a)) = list_sort(list_distinct(b)) as equal from s")
def set_overlap(spark, sf_dir):
    """Shared terms of the two halves of each text, and whether the first holds all of the second, or both the same."""
    return _halves(spark, sf_dir).select("doc_id", F.array_join(T.set_overlap("a", "b"), " ").alias("shared"), T.set_contains("a", "b").alias("contained"), T.set_equal("a", "b").alias("equal"))


_LOOKED_UP = ["of the", "the of", "of an unheardofterm", "in the of the"]
_IDS = f"{S.TOK}, f as (select term, min(struct_pack(d := doc_id, p := pos)) as f from tok group by term), v as (select term, row_number() over (order by f.d, f.p) - 1 as term_id from f)"


def _looked_up(spark, sf_dir):
    phrases = spark.createDataFrame([(p,) for p in _LOOKED_UP], "phrase string")
    return patterns.phrase_ids(phrases, vocab.vocabulary_of(corpus(spark, sf_dir)))


@query(f"""with {_IDS}, p as (select unnest({_LOOKED_UP}) as phrase), w as (select phrase, unnest(string_split(phrase, ' ')) as term, generate_subscripts(string_split(phrase, ' '), 1) as i from p)
select phrase, string_agg(coalesce(term_id, -1)::varchar, ' ' order by i) as ids from w left join v using (term) group by 1""")
def phrase_term_ids(spark, sf_dir):
    return _looked_up(spark, sf_dir).select("phrase", F.array_join(F.transform("ids", lambda i: i.cast("string")), " ").alias("ids"))


@query(f"""with {_IDS}, t as (select doc_id, pos, term_id, lead(term_id) over (partition by doc_id order by pos) as b from tok join v using (term)), c as (select distinct least(term_id, b) as x, greatest(term_id, b) as y from t where b is not null),
p as (select unnest({_LOOKED_UP}) as phrase), w as (select phrase, list(coalesce(term_id, -1) order by i) as ids from (select phrase, unnest(string_split(phrase, ' ')) as term, generate_subscripts(string_split(phrase, ' '), 1) as i from p) left join v using (term) group by 1)
select array_to_string(ids, ' ') as ids from w where exists (select 1 from c where list_sort(list_distinct(ids)) = case when x = y then [x] else [x, y] end)""")
def known_phrase_sets(spark, sf_dir):
    """Which of some phrases have the terms of a bigram of the corpus, in whatever order."""
    docs = corpus(spark, sf_dir)
    tok = vocab.with_ids(vocab.positions(docs), vocab.vocabulary_of(docs))
    pairs = tok.select("doc_id", "pos", "term_id", F.lead("term_id").over(Window.partitionBy("doc_id").orderBy("pos")).alias("b")).where("b is not null")
    counted = patterns.orderings(pairs.select(F.array("term_id", "b").alias("ids")))
    found = patterns.known(counted, _looked_up(spark, sf_dir).select(F.col("ids").cast("array<bigint>").alias("ids")), exact=False)
    return found.select(F.array_join(F.transform("ids", lambda i: i.cast("string")), " ").alias("ids"))
