"""Facts of single functions on small inputs."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from setphrase.functions import dutch, edits
from setphrase.functions import tokens as T
from setphrase.operators import colloc, variants
from setphrase.operators.search import PhraseSearch
from setphrase.sources import text as sources

BORING = "this is a bit of a repetitive a sentence with a bit of a repetitive message"


@pytest.fixture(scope="module")
def boring(spark):
    return spark.createDataFrame([(1, BORING.split(" "))], "doc_id long, tokens array<string>")


def test_boring_sentence(boring):
    s = PhraseSearch(boring, min_term_freq=2, min_cooc_freq=2)
    assert {r["term"]: r["tf"] for r in s.min_freq_vocab.collect()} == {"a": 5, "bit": 2, "of": 2, "repetitive": 2}
    cooc = {(r["t1"], r["t2"]): r["freq"] for r in s.cooc.collect()}
    assert len(cooc) == 11 and sum(cooc.values()) == 31 and cooc["a", "a"] == 6 and cooc["a", "repetitive"] == 4
    phrases = lambda k: {(r["phrase"], r["word_start"]) for r in s.extract_phrases("long_phrases", max_variables=k).collect()}
    assert phrases(0) == {("a bit of a repetitive a", 2), ("a bit of a repetitive", 10)}
    assert phrases(1) == {("a bit of a repetitive a <VAR>", 2), ("a bit of a repetitive <VAR>", 10)}
    assert phrases(2) == {("a bit of a repetitive a <VAR> <VAR> a bit of a repetitive", 2)}
    with pytest.raises(ValueError):
        s.extract_phrases("other")
    with pytest.raises(TypeError):
        PhraseSearch(["no frame"])


def test_skip_ngrams(spark):
    row = spark.range(1).select(F.transform(T.skip_ngrams(F.split(F.lit("a b c d"), " "), 3, 1), lambda g: F.array_join(g["terms"], "")).alias("g")).first()
    assert row["g"] == ["abc", "abd", "acd", "bcd"]
    with pytest.raises(ValueError):
        T.skip_offsets(1, 0)


def test_edit_scripts_are_shortest_and_lead_there():
    rng = random.Random(1)
    for _ in range(400):
        a, b = ("".join(rng.choice("abk c") for _ in range(rng.randrange(9))) for _ in "ab")
        script, out, i = edits.edit_script(a, b), "", 0
        for op, s, d in script:
            out += a[i:s] + ("" if op == "delete" else b[d])
            i = s + (op != "insert")
        assert out + a[i:] == b
        assert "".join(p.source for p in edits.pieces(a, b)) == a and "".join(p.dest for p in edits.pieces(a, b)) == b
    assert len(edits.edit_script("kitten", "sitting")) == 3


def test_variant_edits():
    assert edits.similarity("jaar", "jar") == 1 and edits.similarity("zon", "son") == 1 and edits.similarity("Huis", "huis") == 1
    assert edits.similarity("kat", "kast") < 1 and edits.similarity("", "") == 1 and edits.similarity("", "a") == 0
    assert edits.code("macht", "magt") == ("ch", "g") and edits.is_swap("macht", "magt")
    assert [c[:2] for c in edits.align("de heer van", "de heere van") if c[2] == "replaced"] == [("heer", "heere")]


def test_preferred_forms_are_a_star():
    forms = variants.PreferredForms({"heer": 9, "heere": 3, "here": 2})
    for a, b in (("heere", "here"), ("heer", "heere"), ("here", "heer")):
        forms.learn(a, b)
    assert set(forms.of.values()).isdisjoint(forms.of)
    assert variants.rewritten("de h.r komt", {"h.r": r"heer\1"}) == r"de heer\1 komt" and variants.rewritten("hir", {"h.r": "x"}) == "hir"
    assert variants.is_variant("de zon", "de son", {}, {}) and not variants.is_variant("de zon", "zon", {}, {})


def test_word_swaps(spark):
    rows = [("heer en meester van alles", 5), ("meester heer en van alles", 1), ("en heer meester van alles", 3)]
    found = variants.word_swaps(spark.createDataFrame(rows, "context string, freq long")).collect()
    assert ("en heer", "heer en", 2) in {tuple(r) for r in found}


def test_merging():
    tokens = "is goedgevonden en verstaan mits desen".split()
    units = colloc.merge(tokens, [colloc.VariantPairs([(("goedgevonden", "verstaan"), ("goedgevonden", "verstaan"))])])
    assert units == [(0,), (1, 3), (2,), (4,), (5,)] and colloc.rendered_unit(tokens, units[1]) == "goedgevonden____verstaan"
    assert len(colloc.VariantPairs([(("a", "b"), ("c", "d"))])) == 2
    with pytest.raises(TypeError):
        colloc.VariantPairs([("ab", ("c", "d"))])


def test_spelling():
    assert [dutch.normalise(w) for w in ("Uytrecht", "heerlyckheit", "", "MAENDT")] == ["Utrecht", dutch.normalise("heerlyckheit"), "", dutch.normalise("maendt").upper()]
    assert dutch.to_ascii("café") == "cafe" and "vader" in dutch.ngram_spellings("uader", [("ua", "va")])


def test_readers(spark, tmp_path):
    path = tmp_path / "x.tsv"
    path.write_text("id\ttext\n1\tOne two.\n2\tbad\trow\n3\tThree\n")
    rows = sources.delimited(spark, str(path), skip_invalid_lines=True).collect()
    assert [(r["id"], r["text"], r["line_no"]) for r in rows] == [("1", "One two.", 2), ("3", "Three", 4)]
    with pytest.raises(Exception, match="columns"):
        sources.delimited(spark, str(path)).collect()
    path.write_text("a\n\n\nb\nc\n")
    paras = sources.paragraphs(sources.text_lines(spark, str(path))).orderBy("para_no").collect()
    assert [r["text"] for r in paras] == ["a", "", "b c"]
    path.write_text("r1\tp1\tDe Heer, komt\nbad\nr1\tp2\t1\tte Huis\n")
    rows = sources.resolutions(spark, str(path), ignorecase=True, include_boundaries=True).collect()
    assert [r["words"] for r in rows] == [["<START>", "de", "heer", "komt", "<END>"], ["<START>", "te", "huis", "<END>"]]


def test_merged_bigrams_of_all_documents(spark):
    docs = spark.createDataFrame([(k, ["a", "b"]) for k in (1, 2, 3)], "doc_id long, tokens array<string>")
    counts = lambda df: [r["n_ii"] for r in df.collect() if (r["w1"], r["w2"]) == ("a", "b")]
    found = colloc.merged_bigram_counts(docs, [])
    assert "Limit" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert counts(found) == [3] and counts(colloc.merged_bigram_counts(docs, [], most_texts=2)) == [2]


def test_occurrences_become_rows_only_where_a_phrase_stands(spark, monkeypatch):
    from setphrase.operators import context

    docs = spark.createDataFrame([(1, "a b c a b d a".split() * 20), (2, ["b"]), (3, [])], "doc_id long, tokens array<string>")
    phrases = spark.createDataFrame([("a b", "a b"), ("c", "a b"), ("b c a", "x")], "phrase string, main string")
    found = context.occurrences(docs, phrases)
    assert "Exchange hashpartitioning" not in found._jdf.queryExecution().executedPlan().toString()
    rows = sorted(map(str, found.collect()))
    assert len(rows) == 40 + 20 + 20
    monkeypatch.setattr(context, "MOST_SOUGHT", 0)
    assert sorted(map(str, context.occurrences(docs, phrases).collect())) == rows


@pytest.mark.parametrize("skip, neighbours", [(0, 1), (4, 2), (2, 0)])
def test_blocks_of_documents_give_what_rows_of_tokens_give(spark, monkeypatch, skip, neighbours):
    from setphrase.operators import blocks, vocab

    rng = random.Random(skip)
    rows = [(i, [rng.choice("abcdefgh") + rng.choice("éx") * rng.randrange(2) for _ in range(rng.choice([0, 1, 2, 9, 60]))]) for i in range(40)]
    docs = spark.createDataFrame([*rows, (-3, None)], "doc_id long, tokens array<string>")
    monkeypatch.setattr(blocks, "BLOCK_TOKENS", 50)
    monkeypatch.setattr(blocks, "PART_PAIRS", 300)
    own, other = (PhraseSearch(docs, 12, skip, 6, neighbours, persist=p) for p in (True, False))
    assert own._parts > 1
    got = lambda df: sorted(map(str, df.collect()))
    assert got(own.cooc_with_ids) == got(other.cooc_with_ids)
    assert got(own.selected()) == got(other.selected()) and any(r["sel"] for r in own.selected().collect())
    for kind, options in (("long_phrases", {"min_phrase_length": 1}), ("long_phrases", {"max_variables": 2}), ("sub_phrases", {"min_phrase_length": 2, "max_phrase_length": 3}), ("candidate_phrases", {"max_length": 4})):
        a, b = (s.extract_phrases(kind, min_neighbour_cooc=neighbours, **options) for s in (own, other))
        assert got(a.select(b.columns)) == got(b)
    assert got(vocab.vocabulary_of(docs)) == got(vocab.vocabulary(vocab.positions(docs)))


def test_no_token_is_shuffled_as_a_row(spark, boring):
    found = PhraseSearch(boring, 2, 4, 2).extract_phrases("long_phrases", max_variables=1)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "posexplode" not in plan and "Window" not in plan


def test_bigrams_of_documents_are_those_of_their_tokens(spark, monkeypatch):
    from setphrase.operators import blocks, vocab

    docs = spark.createDataFrame([(1, "a b a b c".split()), (2, ["a"]), (3, []), (4, None), (5, ["a", "b"])], "doc_id long, tokens array<string>")
    got = lambda df: sorted(map(tuple, df.collect()))
    want, found = got(colloc.bigram_counts(vocab.positions(docs))), colloc.bigram_counts(docs)
    assert got(found) == want and want and colloc.bigram_counts(docs.limit(0)).count() == 0
    assert "Window" not in found._jdf.queryExecution().toString()
    monkeypatch.setattr(blocks, "MOST_TERMS", 0)
    assert got(colloc.bigram_counts(docs)) == want


def test_merged_bigrams_are_handed_on_counted(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "in the of the and x of the and".split() * 50), (2, None)], "doc_id long, tokens array<string>").coalesce(1)
    sets = [colloc.VariantPairs([(("in", "the"), ("of", "the"))])]
    found = colloc.merged_bigram_counts(docs, sets)
    units = colloc.merge(docs.first()["tokens"], sets)
    names = [colloc.rendered_unit(docs.first()["tokens"], u) for u in units]
    want = {}
    for i, j in colloc.unit_pairs(units):
        want[names[i], names[j]] = want.get((names[i], names[j]), 0) + 1
    assert {(r["w1"], r["w2"]): r["n_ii"] for r in found.collect()} == want
    monkeypatch.setattr(colloc, "with_marginals", lambda df: df)
    plan = colloc.merged_bigram_counts(docs, sets)._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "sum(n#" in plan


def test_likeness_by_blocks_is_that_of_joined_grams(spark, monkeypatch):
    from setphrase.operators import likeness

    rng = random.Random(9)
    words = ["".join(rng.choice("abcé😀") for _ in range(rng.choice([1, 2, 5, 9]))) for _ in range(150)] + ["", "aaaaaaaa", "a b a b", None]
    df = spark.createDataFrame([(w,) for w in words], "t string")
    monkeypatch.setattr(likeness, "ROWS", 16)
    monkeypatch.setattr(likeness, "COLUMNS", 40)
    found = variants.similar_terms(df, "t", 0.7)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    got = lambda x: {(r["a"], r["b"]): round(r["cosine"], 9) for r in x.collect()}
    own = got(found)
    monkeypatch.setattr(likeness, "MOST_TERMS", 0)
    assert own == got(variants.similar_terms(df, "t", 0.7)) and len(own) > 20
    assert variants.similar_terms(df.limit(0), "t", 0.7).count() == 0


def test_extended_vocabulary_of_documents_makes_no_rows_of_tokens(spark):
    from setphrase.operators import vocab

    docs = spark.createDataFrame([(1, "b a b".split()), (2, "c a".split()), (70_000, "d b".split())], "doc_id long, tokens array<string>")
    first = vocab.vocabulary_of(docs.where("doc_id = 1"))
    grown = vocab.extended_vocabulary(first, docs.where("doc_id > 1"))
    assert "explode" not in grown._jdf.queryExecution().toString()
    assert sorted(map(tuple, grown.collect())) == [("a", 1, 2), ("b", 0, 3), ("c", 2, 1), ("d", 3, 1)]


def test_word_swaps_are_those_of_all_pairs(spark, monkeypatch):
    from setphrase.operators import swaps

    rng = random.Random(3)
    rows = {" ".join(rng.choice(["a", "of", "the", "dé", "thee", ",", "😀"]) for _ in range(rng.choice([2, 3, 5, 5]))): rng.randrange(1, 4) for _ in range(260)}
    df = spark.createDataFrame(list(rows.items()), "context string, freq long")

    def distance(x, y):
        last = list(range(len(y) + 1))
        for i, a in enumerate(x, 1):
            now = [i]
            for j, b in enumerate(y, 1):
                now.append(min(last[j] + 1, now[-1] + 1, last[j - 1] + (a != b)))
            last = now
        return last[-1]

    where, held = {}, set()
    for p, f in rows.items():
        w = p.split(" ")
        for i, g in enumerate(zip(w, w[1:])):
            if "," not in g:
                where.setdefault(" ".join(g), []).append((-f, p, i))
                held.add((p, " ".join(g)))
    want = {}
    for p1, s1 in held:
        for p2, s2 in held:
            if s1 == s2 or sorted(s1.split()) != sorted(s2.split()) or s1 in p2 or max(where[s1]) <= min(where[s2]):
                continue
            r1, r2 = swaps.rest_of(p1, s1), swaps.rest_of(p2, s2)
            longest = max(len(r1), len(r2))
            if abs(len(r1) - len(r2)) <= 4 and (longest == 0 or 1 - distance(r1, r2) / longest >= 0.7):
                want[s1, s2] = want.get((s1, s2), 0) + 1
    for most in (8_000, 7):  # all in one bin; sets of words with more rows dealt into chunks
        monkeypatch.setattr(swaps, "BIN_ROWS", most)
        monkeypatch.setattr(swaps, "MOST_PAIRS_AT_ONCE", 20)
        assert {(r["swap1"], r["swap2"]): r["freq"] for r in variants.word_swaps(df).collect()} == want and len(want) > 10


@pytest.mark.parametrize("n, skips, least", [(2, 0, 1), (3, 0, 2), (3, 1, 1), (4, 2, 1)])
def test_grams_of_blocks_are_those_of_rows(spark, monkeypatch, n, skips, least):
    from setphrase.operators import blocks, cooc

    rng = random.Random(n)
    rows = [(i, [rng.choice("abcdefgh") + rng.choice("éx") * rng.randrange(2) for _ in range(rng.choice([0, 1, 2, 3, 60]))]) for i in range(30)]
    docs = spark.createDataFrame([*rows, (-3, None)], "doc_id long, tokens array<string>")
    monkeypatch.setattr(blocks, "BLOCK_TOKENS", 50)
    monkeypatch.setattr(blocks, "PART_PAIRS", 300)
    found = cooc.gram_counts(docs, n, skips, least)
    assert "Generate" not in found._jdf.queryExecution().toString()
    got = lambda df: sorted(map(str, df.collect()))
    own = got(found)
    assert cooc.gram_counts(docs.limit(0), n, skips, least).count() == 0
    # numbers of n-grams beyond 64 bits
    real = blocks.Terms.__init__
    monkeypatch.setattr(blocks.Terms, "__init__", lambda made, v: (real(made, v), setattr(made, "base", 3_000_000 if n == 3 else made.base))[0])
    assert own == got(cooc.gram_counts(docs, n, skips, least))
    monkeypatch.setattr(blocks, "MOST_TERMS", 0)
    assert own == got(cooc.gram_counts(docs, n, skips, least)) and own


def test_merging_by_blocks_is_that_of_single_documents(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(i, [rng.choice(["of", "the", "and", "in", "x"]) for _ in range(rng.choice([0, 1, 3, 12, 80]))]) for i in range(40)]
    sets = [colloc.VariantPairs([(("of", "the"), ("of", "the")), (("in", "the"), ("of", "the")), (("the", "of"), ("of", "the"))]), colloc.VariantPairs([(("of__the", "and"), ("of__the", "and")), (("in____the", "of__the"), ("x", "x"))])]
    monkeypatch.setattr(colloc, "MERGED_TOKENS", 30)
    # no unit is named and no pair is looked at one by one
    docs = spark.createDataFrame(rows, "doc_id long, tokens array<string>").coalesce(2)
    found = {r["doc_id"]: (r["units"], [tuple(u) for u in r["indexes"]]) for r in colloc.merged_units(docs, sets).collect()}
    want = {i: (u := colloc.merge(t, sets), [colloc.rendered_unit(t, x) for x in u])[::-1] for i, t in rows}
    assert found == {i: (names, units) for i, (names, units) in want.items()} and any(len(u) > 2 for _, us in want.values() for u in us)
    assert "MapInPandas" not in colloc.merged_units(docs, sets, with_indexes=False)._jdf.queryExecution().toString()


@pytest.mark.parametrize("size, step", [(6, 3), (4, 1), (2, 5)])
def test_window_overlaps_are_those_of_texts(spark, monkeypatch, size, step):
    from setphrase.operators import patterns

    rng = random.Random(size)
    rows = [(i, [rng.choice(["a", "ba", "ab", "c"][: rng.randrange(1, 5)]) for _ in range(rng.choice([0, 1, 2, 5, 8, 40]))]) for i in range(60)]
    docs = spark.createDataFrame([*rows, (-1, None)], "doc_id long, tokens array<string>")
    monkeypatch.setattr(patterns, "WINDOW_TOKENS", 100)
    found = patterns.window_overlaps(docs, size, step)
    assert "transform" not in found._jdf.queryExecution().toString()
    pairs = [(i, k, " ".join(t[k : k + size]), " ".join(t[k + step : k + step + size])) for i, t in rows for k in range(0, len(t), step)]
    want = spark.createDataFrame(pairs, "doc_id long, start int, a string, b string").select("doc_id", "start", T.partial_overlap("a", "b").alias("overlap"))
    got = lambda df: sorted(map(str, df.collect()))
    assert got(found) == got(want) and pairs


def test_rewritten_words_need_no_ids(spark):
    from setphrase.operators import blocks

    docs = spark.createDataFrame([(1, ["stoffe", "uader", "dorp"] * 3), (2, ["uader"]), (3, None)], "doc_id long, tokens array<string>")
    counted = blocks.term_counts(docs)
    assert {r["term"]: r["tf"] for r in counted.collect()} == {"stoffe": 3, "uader": 4, "dorp": 3}
    found = dutch.rewrites(counted.where("tf > 2"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, found.collect())) == [("stoffe", "stofe"), ("uader", "vader")]
    # words without a hit are left before anything is shuffled
    assert plan.index("Aggregate") < plan.index("RLIKE")
