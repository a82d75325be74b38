"""Queries over spelling variants, normalisation and paragraph sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from setphrase.functions import dutch, edits
from setphrase.functions.lineage import cut
from setphrase.operators import blocks, colloc, context, variants, vocab
from setphrase.plans import phrases_sql as S
from setphrase.plans.context_queries import BIG, CTX, contexts
from setphrase.plans.core_queries import corpus, search
from setphrase.plans.registry import query, read
from setphrase.sources import text as sources


def _frequent(spark, sf_dir):
    return search(spark, sf_dir).min_freq_vocab.where("length(term) >= 4")


_GRAMS = ", ".join(f"case when i + {d} <= length(t) then t[i] || t[i + {d}] end" for d in (1, 2, 3))
SIMILAR = f"""{S.VOCAB}, q as materialized (select term as t from minv where length(term) >= 4), l as (select t, unnest(range(1, length(t))) as i from q), gs as (select t, unnest([{_GRAMS}]) as g from l),
c as (select t, g, count(*)::double as n from gs where g is not null group by 1, 2), v as materialized (select t, g, n / sqrt(sum(n * n) over (partition by t)) as w from c),
sim as materialized (select a.t as a, b.t as b, sum(a.w * b.w) as cosine from v a join v b using (g) where a.t < b.t group by 1, 2)"""


@query(f"with {SIMILAR} select a, b, round(cosine, 6) as cosine from sim where cosine >= 0.8 - 1e-12")
def similar_terms(spark, sf_dir):
    return variants.similar_terms(_frequent(spark, sf_dir), "term", 0.8).withColumn("cosine", F.round("cosine", 6))


BOTH = f"{SIMILAR}, near as materialized (select a as term, b as near, round(cosine, 6) as cosine from sim where cosine >= 0.7 - 1e-12 union all select b, a, round(cosine, 6) from sim where cosine >= 0.7 - 1e-12)"


@query(f"with {BOTH} select term, near, cosine from near qualify row_number() over (partition by term order by cosine desc, near) <= 5")
def ranked_similar_terms(spark, sf_dir):
    return _ranked(spark, sf_dir, 5)


def _ranked(spark, sf_dir, top):
    half = cut(variants.similar_terms(_frequent(spark, sf_dir), "term", 0.7).withColumn("cosine", F.round("cosine", 6)))
    return variants.ranked(half, top)


def _bytes(word: str) -> str:
    """A lower-case word with a byte for each letter: the SQL engine's edit distance is one of bytes."""
    return f"translate({word}, 'àáâäçèéêëìíîïñòóôöùúûüß', 'ABCDEFGHIJKLMNOPQRSTUVW')"


_NEAR = f"""{BOTH}, nw as materialized (select term as word, near from (select *, row_number() over (partition by term order by cosine desc, near) as r from near where length(term) >= 4)
where r <= case when length(term) <= 6 then 100 else 1000 end and abs(length(term) - length(near)) <= 2 and levenshtein({_bytes('term')}, {_bytes('near')}) <= 3)"""


def _near_words(spark, sf_dir):
    """Letters stand in for word vectors."""
    return colloc.variant_words(_ranked(spark, sf_dir, 1000).withColumnRenamed("term", "word"))


@query(f"with {_NEAR} select * from nw")
def variant_words(spark, sf_dir):
    return _near_words(spark, sf_dir)


_SELECTED = f"{BIG.removeprefix(S.TOK + ', ')}, sel as materialized (select w1, w2 from m where length(w1) >= 4 and length(w2) >= 4 order by n_ii desc, w1, w2 limit 300)"


@query(f"""with {_NEAR}, {_SELECTED}, own as (select distinct w as word, w as near from (select unnest([w1, w2]) as w from sel)), n as materialized (select * from nw union select * from own),
j as (select sel.w1 as p1, sel.w2 as p2, a.near as w1, b.near as w2 from sel join n a on a.word = sel.w1 join n b on b.word = sel.w2), k as (select j.* from j join m using (w1, w2) where levenshtein({_bytes("w1 || ' ' || w2")}, {_bytes("p1 || ' ' || p2")}) <= 4)
select w1, w2, min(struct_pack(a := p1, b := p2)).a as p1, min(struct_pack(a := p1, b := p2)).b as p2 from k group by 1, 2""")
def bigram_variants(spark, sf_dir):
    counts = cut(colloc.bigram_counts(corpus(spark, sf_dir)))
    selected = counts.where("length(w1) >= 4 and length(w2) >= 4").orderBy(F.desc("n_ii"), "w1", "w2").limit(300)
    return colloc.bigram_variants(selected, counts, _near_words(spark, sf_dir))


@query()
def variant_similarity(spark, sf_dir):
    pairs = variants.similar_terms(_frequent(spark, sf_dir), "term", 0.7)
    return pairs.select("a", "b", F.round(edits.variant_similarity("a", "b"), 6).alias("similarity"))


@query()
def edit_classes(spark, sf_dir):
    pairs = variants.similar_terms(_frequent(spark, sf_dir), "term", 0.7)
    return pairs.select("a", "b", edits.edit_classes("a", "b").alias("classes"), edits.diff_code("a", "b").alias("code"))


_RATIO = "1 - levenshtein(r1, r2) / greatest(length(r1), length(r2), 1)"


@query(f"""with {CTX}, m as (select context as p, sum(freq) as freq from ctx group by 1), w as (select p, freq, string_split(p, ' ') as t from m), l as (select p, freq, t, unnest(range(1, len(t))) as i from w where len(t) > 1),
g as (select p, freq, i, t[i] as x, t[i + 1] as y, t[i] || ' ' || t[i + 1] as s from l), o as (select s, min((-freq, p, i)) as f, max((-freq, p, i)) as u from g group by 1),
h as materialized (select distinct p, x, y, g.s, f, u, substr(p, 1, strpos(p, g.s) - 1) as head, substr(p, strpos(p, g.s) + length(g.s)) as tail from g join o on o.s = g.s),
k as materialized (select *, case when ends_with(head, ' ') and starts_with(tail, ' ') then head || substr(tail, 2) else replace(p, s, '') end as r from h),
j as (select a.s as swap1, b.s as swap2, a.r as r1, b.r as r2, b.p as p2 from k a join k b on a.x = b.y and a.y = b.x and a.s <> b.s and a.u > b.f where abs(length(a.r) - length(b.r)) <= 4 and not contains(b.p, a.s))
select swap1, swap2, count(*) as freq from j where {_RATIO} >= 0.7 group by 1, 2""")
def word_swaps(spark, sf_dir):
    return variants.word_swaps(contexts(spark, sf_dir))


def _sub_phrases(spark, sf_dir):
    merged = context.merged_phrases(contexts(spark, sf_dir))
    return context.sub_contexts(merged).select("sub_phrase", "freq"), variants.word_swaps(merged)


@query()
def aligned_chunks(spark, sf_dir):
    return variants.aligned_tokens(*_sub_phrases(spark, sf_dir))


@query()
def preferred_variants(spark, sf_dir):
    forms = variants.preferred_forms(variants.aligned_tokens(*_sub_phrases(spark, sf_dir)))
    return spark.createDataFrame(list(forms.items()), "variant string, preferred string")


@query()
def rewritten_contexts(spark, sf_dir):
    return variants.rewritten_contexts(contexts(spark, sf_dir))


@query()
def context_word_variants(spark, sf_dir):
    tf = vocab.term_frequencies(vocab.positions(corpus(spark, sf_dir)))
    found = variants.context_word_variants(contexts(spark, sf_dir), term_freq=tf)
    return spark.createDataFrame(list(found.items()), "variant string, preferred string")


def _respelled(step: str, before: str, group: str) -> str:
    """A table (term, w): w of the table before, with the rules of a letter group as a case expression; for words in small letters."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    marks = {"#": r"\x02", "[|]": r"\x03"}

    def ends(left: str) -> str:
        for mark, code in marks.items():
            left = left.replace(mark, code)
        return quoted(f"(?:{left})$")

    fits = lambda left, right: " and ".join([f"regexp_matches(l, {ends(left)})"] * bool(left) + [f"regexp_matches(p[i + 1], {quoted(f'^(?:{right})')})"] * bool(right)) or "true"
    cases = " ".join(f"when {fits(left, right)} then {quoted(out)}" for left, right, out in dutch.RULES[group])
    own = {w: w for w in [*dutch.KEPT.get(group, ()), *dutch.KEPT_IN_ANY_CASE.get(group, ())]} | dutch.OWN.get(group, {})
    own |= {w: w.replace("gh", "ch") for w in dutch.CH_FOR_GH} if group == "gh" else {}
    fixed = "".join(f"when w = {quoted(old)} then {quoted(new)} " for old, new in sorted(own.items()))
    return f"""{step}_p as (select term, w, string_split(w, '{group}') as p from {before}), {step}_i as (select term, p, unnest(range(1, len(p))) as i from {step}_p where len(p) > 1),
{step}_o as (select term, string_agg(case {cases} end || p[i + 1], '' order by i) as o from (select *, case when i = 1 then chr(2) else chr(3) end || p[i] as l from {step}_i) group by term),
{step} as materialized (select term, case {fixed}when o is null then w else p[1] || o end as w from {step}_p left join {step}_o using (term))"""


_GROUPS = ("ck", "ae", "gh", "uy", "ey", "y")
_SPELLED = ", ".join(_respelled(f"s{k + 1}", f"s{k}", group) for k, group in enumerate(_GROUPS))


@query(f"""with {S.VOCAB}, s0 as (select term, term as w from tf), {_SPELLED}
select term, case when w in ('wordt', 'vindt') then w when w = 'duisent' then 'duizend' when regexp_matches(w, '(dt|heit|lant)$') then regexp_replace(w, 'd?t$', 'd') else w end as normal from s{len(_GROUPS)}""")
def normalise_dutch(spark, sf_dir):
    return dutch.normalised(vocab.term_frequencies(vocab.positions(corpus(spark, sf_dir))))


_TABLE = ", ".join(f"('{old}', '{new}')" for old, new in dutch.NGRAMS_NL)
# every hit of an n-gram is either replaced or not, from the last to the first
_REWRITES = f"""with recursive {S.VOCAB}, ng(o, n) as (values {_TABLE}), l as (select term, unnest(range(0, length(term) - 1)) as i from minv where length(term) > 1),
hit as materialized (select term, i, o, n, row_number() over (partition by term order by i desc, o desc, n desc) as k, count(*) over (partition by term) as many from l join ng on substr(term, i + 1, 2) = o
  where o[1] <> o[2] or length(regexp_extract(substr(term, 1, i), '(' || o[1] || '*)$', 1)) % 2 = 0),
r as (select term, 0::bigint as k, term as spelling, 0 as used from hit where k = 1 union all
  select r.term, r.k + 1, case when take then substr(spelling, 1, i) || n || substr(spelling, i + 3) else spelling end, used + take::int from r join hit on hit.term = r.term and hit.k = r.k + 1 cross join (values (true), (false)) as c(take)),
made as materialized (select r.term, spelling from r join hit on hit.term = r.term and hit.k = r.k where r.k = many and used > 0)"""


@query(f"{_REWRITES} select * from made")
def ngram_rewrites(spark, sf_dir):
    return dutch.rewrites(blocks.term_counts(corpus(spark, sf_dir)).where(F.col("tf") >= S.TF))


@query(f"{_REWRITES} select made.term, arg_min(spelling, (-tf, spelling)) as best from made join tf on tf.term = made.spelling group by made.term")
def preferred_spellings(spark, sf_dir):
    counted = cut(blocks.term_counts(corpus(spark, sf_dir)))
    return dutch.most_frequent(dutch.rewrites(counted.where(F.col("tf") >= S.TF)), counted, "term")


@query(f"with {S.VOCAB} select term, strip_accents(term) as ascii from tf")
def unicode_ascii(spark, sf_dir):
    return dutch.ascii_words(vocab.term_frequencies(vocab.positions(corpus(spark, sf_dir))))


@query("""with l as (select doc_id as file, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as line_no from documents where text is not null),
k as (select *, coalesce(sum((line = '')::int) over (partition by file order by line_no rows between unbounded preceding and 1 preceding), 0)::bigint as para_no from l)
select file, para_no, coalesce(trim(string_agg(line, ' ' order by line_no) filter (line <> ''), ' '), '') as text from k group by 1, 2""")
def paragraphs_from_lines(spark, sf_dir):
    lines = read(spark, sf_dir, "documents").where("text is not null").select(F.col("doc_id").alias("file"), F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    return sources.paragraphs(lines)


@query(f"with {S.DOCS} select doc_id, '<START> ' || array_to_string(w, ' ') || case when len(w) > 0 then ' ' else '' end || '<END>' as words from docs")
def dict_sentence_boundaries(spark, sf_dir):
    return corpus(spark, sf_dir).select("doc_id", F.array_join(sources.bounded_words(F.col("tokens"), ""), " ").alias("words"))


@query(r"""select conv_id, string_agg(text, chr(10) order by turn, text) as text from conversations where text is not null group by 1""")
def merged_paragraphs(spark, sf_dir):
    turns = read(spark, sf_dir, "conversations").where("text is not null").select("conv_id", F.col("turn").alias("ord"), "text", F.array("text").alias("tokens"))
    return sources.merged_paragraphs(turns, "conv_id").select("conv_id", "text")
