"""What SQL doesn't express, against brute force on small inputs."""

from __future__ import annotations

import random
from collections import Counter
from itertools import combinations, product

import pytest
from pyspark.sql import functions as F

from setphrase.functions import dutch, edits
from setphrase.functions import tokens as T
from setphrase.operators import colloc, context, formulas, patterns, transitions, variants, vocab
from setphrase.plans import catalogue
from setphrase.streaming import terms


def test_non_overlapping_is_the_greedy_choice(spark, data):
    best = catalogue.queries()["nbest_bigrams"](spark, str(data)).collect()
    used, want = set(), set()
    for r in sorted(best, key=lambda r: (-r["score"], r["w1"], r["w2"])):
        if len(r["w1"]) + len(r["w2"]) >= 9 and not {r["w1"], r["w2"]} & used:
            used |= {r["w1"], r["w2"]}
            want.add((r["w1"], r["w2"]))
    found = catalogue.queries()["non_overlapping_bigrams"](spark, str(data)).collect()
    assert {(r["w1"], r["w2"]) for r in found} == want and len(found) == len(want)


def test_merging_and_its_counts_against_brute_force(spark):
    rng = random.Random(4)
    wanted = {("a", "b"), ("c", "d"), ("a", "d"), ("b", "b")}
    docs = [(i, [rng.choice("abcdef") for _ in range(rng.randrange(1, 25))]) for i in range(60)]
    units, pairs = {}, Counter()
    for i, tokens in docs:
        gone, joined = set(), {}
        for a in range(len(tokens) - 1, -1, -1):
            for b in (a + 2, a + 1):
                if b < len(tokens) and (tokens[a], tokens[b]) in wanted and not {a, b} & (gone | joined.keys()):
                    joined[a] = b
                    gone.add(b)
        made = [(k, joined.get(k, k)) for k in range(len(tokens)) if k not in gone]
        units[i] = [tokens[a] + ("" if a == b else "__" * (b - a) + tokens[b]) for a, b in made]
        for x in range(len(made)):
            ends = 0
            for y in range(x + 1, len(made)):
                ends += made[y][1] > made[x][1]
                if ends >= 3 or made[y][0] >= made[x][1] + 3:
                    break
                pairs[units[i][x], units[i][y]] += 1
    frame = spark.createDataFrame(docs, "doc_id long, tokens array<string>")
    sets = [colloc.VariantPairs([(p, p) for p in wanted])]
    assert {r["doc_id"]: r["units"] for r in colloc.merged_units(frame, sets).collect()} == units
    counted = colloc.merged_bigram_counts(frame, sets).collect()
    assert {(r["w1"], r["w2"]): r["n_ii"] for r in counted} == pairs
    left, right = Counter(), Counter()
    for (a, b), n in pairs.items():
        left[a] += n
        right[b] += n
    assert all((r["n_ix"], r["n_xi"], r["n_xx"]) == (left[r["w1"]], right[r["w2"]], pairs.total()) for r in counted)


# by hand from the rules
SPELLINGS = {
    "heerlyckheit": "heerlijkheid",
    "ghelyck": "gelijk",
    "jaer": "jaar",
    "maght": "macht",
    "eylant": "eiland",
    "huys": "huis",
    "duisent": "duizend",
    "wordt": "wordt",
    "backen": "bakken",
    "boeck": "boek",
    "July": "Juli",
    "Bayreuth": "Bayreuth",
    "lunae": "lunae",
    "prael": "praal",
    "praesent": "present",
    "vught": "vught",
    "Sigh": "Sich",
    "overigheit": "overigheid",
    "vaghe": "vage",
    "uyr": "uur",
    "HUYS": "HUIS",
    "tyt": "tijt",
    "slecht": "slecht",
    "voughden": "vougden",
    "yder": "ijder",
    "": "",
}


def test_dutch_spelling(spark):
    assert {w: dutch.normalise(w) for w in SPELLINGS} == SPELLINGS
    frame = spark.createDataFrame([(w,) for w in SPELLINGS] + [("huys",), (None,)], "term string")
    assert {r["term"]: r["normal"] for r in dutch.normalised(frame).collect()} == SPELLINGS | {None: None}


def test_ngram_spellings_and_the_most_frequent(spark):
    words = ["uader", "ouer", "cxff", "uaua", "none", "uouo"]
    want = {}
    for w in words:
        hits = [(i, old, new) for old, new in dutch.NGRAMS_NL for i in range(len(w)) if w.startswith(old, i)]
        free = [c for n in range(1, len(hits) + 1) for c in combinations(hits, n) if all(a[0] + len(a[1]) <= b[0] or b[0] + len(b[1]) <= a[0] for a, b in combinations(c, 2))]
        want[w] = set()
        for choice in free:
            new = w
            for i, old, to in sorted(choice, reverse=True):
                new = new[:i] + to + new[i + len(old) :]
            want[w].add(new)
    made = dutch.rewrites(spark.createDataFrame([(w,) for w in words], "term string")).collect()
    found = {w: {r["spelling"] for r in made if r["term"] == w} for w in words}
    assert found == want
    tf = spark.createDataFrame([("vader", 5), ("uvader", 9), ("over", 2), ("uava", 2), ("vaua", 2)], "term string, tf long")
    candidates = spark.createDataFrame([(w, s) for w, all_ in want.items() for s in all_], "term string, spelling string")
    assert {r["term"]: r["best"] for r in dutch.most_frequent(candidates, tf, "term").collect()} == {"uader": "vader", "ouer": "over", "uaua": "uava"}


def test_edit_scripts_have_the_edit_distance_and_classes():
    rng = random.Random(6)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, c in enumerate(a, 1):
            old, row = row, [i]
            for j, d in enumerate(b, 1):
                row.append(min(old[j - 1] + (c != d), old[j] + 1, row[-1] + 1))
        return row[-1]

    for _ in range(300):
        a, b = ("".join(rng.choice("abkce ") for _ in range(rng.randrange(8))) for _ in "ab")
        assert len(edits.edit_script(a, b)) == len(edits.variant_edits(a, b)) == distance(a, b)
    assert edits.variant_edits("jaar", "jar") == [True] and edits.variant_edits("kat", "kast") == [False]
    assert edits.variant_edits("zaak", "zaek") == [True] and edits.variant_edits("boek", "boeck") == [True]
    script = edits.edit_script("heer, van", "heer van")
    assert [edits.is_dropped("heer, van", "heer van", e, edits.is_punct) for e in script] == [True]
    assert [edits.is_added("heer van", "heer, van", e, edits.is_punct) for e in edits.edit_script("heer van", "heer, van")] == [True]
    assert [edits.is_added("van de", "van  de", e, str.isspace) for e in edits.edit_script("van de", "van  de")] == [True]
    assert not edits.is_dropped("ab", "b", ("delete", 0, 0), str.isspace)


def test_rewriting_is_one_variant_after_the_other():
    rng = random.Random(8)
    phrase = lambda n: " ".join("".join(rng.choice("ab.") for _ in range(rng.randrange(1, 4))) for _ in range(n))
    for _ in range(60):
        rules = {phrase(rng.randrange(1, 3)): phrase(rng.randrange(1, 3)) for _ in range(40)} | {".": "a", " ": "b"}
        fast, swaps = variants.Rewriting(rules), [(phrase(2), phrase(2)) for _ in range(40)]
        undo = variants.Unswapping(swaps)
        for _ in range(20):
            x, y = phrase(rng.randrange(1, 7)), phrase(rng.randrange(1, 7))
            assert fast(x) == variants.rewritten(x, rules)
            want = y
            for a, b in swaps:
                if a in x and b in want:
                    want = want.replace(b, a)
            assert undo(x, y) == want


def test_distractors():
    known, others = {"heere": "heer"}, {"man": "heer"}
    same = "de groote heer van het landt"
    assert variants.is_variant(same, "de groote heere van het landt", known, {})
    assert not variants.is_variant(same, "de groote hoer van het landt", {}, {"hoer": "heer"})
    assert not variants.is_variant(same, "de groote hoer van het landt", {}, others)
    assert variants.is_variant(same, "de groote hoer van het landt", {"hoer": "heer"}, {"hoer": "heer"})


def test_patterns(spark):
    p = patterns.Pattern(["is", "a", "repetition"])
    assert len(p) == p.length == 3 and "a" in p and "b" not in p and (p.start, p.end) == ("is", "repetition") and p == patterns.Pattern(("is", "a", "repetition"))
    with pytest.raises(ValueError):
        patterns.Pattern([])
    index = patterns.PatternIndex(p)
    index.add([patterns.Pattern(["is", "a", "doc"]), patterns.Pattern(["repetition"])])
    assert len(index) == 3 and p in index and {q.end for q in index.starting_with("is")} == {"repetition", "doc"} and index.ending_with("doc")
    rng = random.Random(3)
    docs = [(1, "There is a repetition is a repetition".split()), (2, []), *[(i, [rng.choice(["is", "a", "repetition", "doc"]) for _ in range(30)]) for i in range(3, 9)]]
    frame = spark.createDataFrame(docs, "doc_id long, tokens array<string>")
    want = {(i, k, q.labels) for i, t in docs for q in index.patterns for k in range(len(t)) if tuple(t[k : k + len(q)]) == q.labels}
    found = [(r["doc_id"], r["start"], tuple(r["pattern"])) for r in index.find(frame).collect()]
    assert set(found) == want and len(found) == len(want)
    assert {(i, k) for i, k, q in want if q == p.labels} == {tuple(r) for r in patterns.find(frame, p).collect()}
    assert sum(r["found"] for r in patterns.contains(frame, p).collect()) == len({i for i, _, q in want if q == p.labels})
    # as many copies of the array as tokens would be quadratic
    assert "posexplode" not in patterns.find_all(frame, spark.createDataFrame([(["is"],)], "labels array<string>"))._jdf.queryExecution().optimizedPlan().toString()


def test_set_algebra(spark):
    rng = random.Random(5)
    rows = [(i, [rng.choice("abcd") for _ in range(rng.randrange(6))], [rng.choice("abcd") for _ in range(rng.randrange(6))]) for i in range(80)]
    frame = spark.createDataFrame(rows, "k long, a array<string>, b array<string>")
    found = frame.select("k", T.set_overlap("a", "b").alias("o"), T.set_contains("a", "b").alias("c"), T.set_equal("a", "b").alias("e"), T.multiset_overlap("a", "b").alias("m"))
    many = {r["k"]: r["overlap"] for r in patterns.multiset_overlaps(frame, "k", "a", "b").collect()}
    for r, (_, a, b) in zip(found.orderBy("k").collect(), rows):
        left, want = Counter(b), []
        for x in a:
            if left[x]:
                left[x] -= 1
                want.append(x)
        assert (r["o"], r["c"], r["e"], r["m"]) == (sorted({*a} & {*b}), {*a} >= {*b}, {*a} == {*b}, want) and many[r["k"]] == want


def test_sentences_are_checked(spark):
    frame = lambda kind, v: spark.createDataFrame([(1, v)], f"doc_id long, tokens {kind}")
    assert vocab.checked(frame("array<string>", ["this", "is"])).first()["tokens"] == ["this", "is"]
    assert vocab.checked(frame("struct<words:array<string>>", (["a"],))).first()["tokens"] == ["a"]
    assert vocab.checked(frame("array<struct<t:string,n:string>>", [("This", "this"), ("is", "is")])).first()["tokens"] == ["this", "is"]
    for kind, value, error in (("string", "this is", TypeError), ("struct<text:string>", ("a",), KeyError), ("array<int>", [1], TypeError)):
        with pytest.raises(error):
            vocab.checked(frame(kind, value))
    with pytest.raises(KeyError):
        vocab.checked(spark.range(1))
    with pytest.raises(Exception, match="token is null"):
        vocab.checked(frame("array<string>", ["a", None])).collect()


def test_vocabulary_grows_and_keeps_its_ids(spark):
    tok = lambda rows: vocab.positions(spark.createDataFrame(rows, "doc_id long, tokens array<string>"))
    first = vocab.vocabulary(tok([(1, ["b", "a", "b"]), (9, ["c"])]))
    grown = {r["term"]: (r["term_id"], r["tf"]) for r in vocab.extended_vocabulary(first, tok([(1, ["x", "a"]), (200_000, ["y", "x", "b"])])).collect()}
    assert grown == {"b": (0, 3), "a": (1, 2), "c": (2, 1), "x": (3, 2), "y": (4, 1)}
    assert vocab.extended_vocabulary(first.limit(0), tok([(1, ["q"])])).collect() == [("q", 0, 1)]


def test_matches_have_their_characters(spark):
    docs = spark.createDataFrame([(1, "a bit of a bit of it".split())], "doc_id long, tokens array<string>")
    sel = vocab.positions(docs).withColumn("sel", F.when(F.col("term") != "it", F.col("term")))
    found = formulas.with_chars(formulas.sub_phrases(sel, 3, 3), vocab.positions(docs)).collect()
    text = "a bit of a bit of it"
    assert len(found) == 4 and all(text[r["char_start"] : r["char_end"]] == r["phrase"] for r in found)


def chain(spark, words, probs):
    path = ["<PHRASE>", *words]
    return spark.createDataFrame([("post", [a], [b], 10, p) for a, b, p in zip(path, words, probs)], "direction string, src array<string>, dst array<string>, freq long, prob double")


def test_reach_and_extensions_have_no_end_of_their_own(spark):
    words = [f"w{i}" for i in range(17)]
    edges = chain(spark, words, [1.0] * 17)
    assert {r["node"][0] for r in transitions.reachable(edges).collect()} == {"<PHRASE>", *words}
    assert {r["node"][0] for r in transitions.reachable(edges, depth=3).collect()} == {"<PHRASE>", "w0", "w1", "w2"}
    assert [r["path"] for r in transitions.extensions(edges).collect()] == [["<PHRASE>", *words]]
    weak = transitions.extensions(chain(spark, words[:4], [1.0, 0.5, 0.5, 0.1]), 0.2).collect()
    assert sorted((len(r["path"]), r["kind"]) for r in weak) == [(2, "main"), (4, "split")]


def test_extended_phrases_and_dot(spark):
    ctx = spark.createDataFrame([("post", "of the", "king of spain", 9), ("post", "of the", "king of france", 1), ("pre", "of the", "in name", 10)], "direction string, phrase string, context string, freq long")
    found = {(r["kind"], r["phrase"]) for r in transitions.extend_phrase("of the", ctx, None, 0.05, 0.05).collect()}
    # what is less likely than 0.1 isn't split off
    assert ("main", "in name of the king of spain") in found
    edges = transitions.probabilities(ctx, 0.05, 0.05, tree=False).collect()
    text = "\n".join(r["line"] for r in transitions.dot(transitions.probabilities(ctx, 0.05, 0.05, tree=False), "of the", "post").orderBy("line_no").collect())
    assert text.startswith("digraph {") and text.endswith("}")
    for e in edges:
        if e["direction"] == "post":
            name = lambda w: "of the" if w == "<PHRASE>" else w
            assert f'"{name(e["src"][0])}" -> "{name(e["dst"][0])}" [label="{e["prob"]:.2f}"];' in text


def test_term_counts_of_a_stream(spark, tmp_path):
    for i, text in enumerate(["a b a", "b c"]):
        spark.createDataFrame([(text,)], "text string").coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema("text string").parquet(f"{tmp_path}/in/*")
    query = terms.running_term_frequencies(stream).writeStream.format("memory").queryName("stream_terms").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert {(r["term"], r["tf"]) for r in spark.table("stream_terms").collect()} == {("a", 2), ("b", 2), ("c", 1)}


def test_context_variants_and_alignment(spark):
    counted = spark.createDataFrame([("post", "heeren staten", 40), ("post", "heeren staeten", 3), ("post", "iets anders", 9)], "direction string, context string, freq long")
    ctx = counted.withColumn("phrase", F.lit("de"))
    assert variants.context_word_variants(ctx) == {"staeten": "staten"}
    chunks = {(r["source"], r["dest"], r["freq"]) for r in variants.aligned_tokens(context.sub_contexts(ctx).select("sub_phrase", "freq")).collect()}
    assert ("staten", "staeten", 40) in chunks
    forms = variants.preferred_forms(variants.aligned_tokens(context.sub_contexts(ctx).select("sub_phrase", "freq")))
    assert forms == {"staeten": "staten"}
    rows = {(r["context"], r["freq"]) for r in variants.rewritten_contexts(ctx).collect()}
    assert rows == {("heeren staten", 43), ("iets anders", 9)}


def test_skip_grams_are_all_choices(spark):
    tokens = list("abcde")
    want = [tokens[i] + tokens[i + a] + tokens[i + b] for i, (a, b) in product(range(5), [(1, 2), (1, 3), (2, 3)]) if i + b < 5]
    row = spark.range(1).select(F.transform(T.skip_ngrams(F.array(*map(F.lit, tokens)), 3, 1), lambda g: F.array_join(g["terms"], "")).alias("g")).first()
    assert row["g"] == want


def test_doc_reader_and_charters(spark, tmp_path):
    import zipfile

    from setphrase.sources import text as sources

    path = tmp_path / "x.tsv"
    path.write_text("id\ttext\tyear\n1\tDe Heer, komt (nu) .\t1705\n2\t\t1706\n")
    rows = sources.doc_reader(spark, str(path), "id", "text", ignorecase=True, include_boundaries=True, remove_punctuation=True).orderBy("doc_id").collect()
    assert [(r["doc_id"], r["tokens"], r["metadata"]) for r in rows] == [("1", ["<START>", "de", "heer", "komt", "nu", "<END>"], {"year": "1705"}), ("2", ["<START>", "<END>"], {"year": "1706"})]
    assert sources.doc_reader(spark, str(path), "id", "text").orderBy("doc_id").first()["tokens"] == ["De", "Heer,", "komt", "(nu)", "."]
    with zipfile.ZipFile(tmp_path / "c.zip", "w") as z:
        z.writestr("a.xml", "<c><transcriptie>&lt;p&gt;Wij {sic} maken&lt;/p&gt;&lt;p&gt;cont&lt;/p&gt;</transcriptie></c>")
        z.writestr("b.xml", "<c><transcriptie>broken")
        z.writestr("c.xml", "<c><other/></c>")
    rows = sources.charters(spark, str(tmp_path / "c.zip")).orderBy("para_id").collect()
    assert [(r["para_id"], r["text"], r["words"]) for r in rows] == [("a.xml-1", "Wij  maken", ["Wij", "maken"]), ("a.xml-2", "cont", ["cont"]), ("b.xml-1", "", []), ("c.xml-1", "", [])]


def test_fixed_lists_and_lookups(spark):
    sentences = vocab.positions(spark.createDataFrame([(1, "a b a".split())], "doc_id long, tokens array<string>"))
    assert [(r["term"], r["tf"]) for r in vocab.top(vocab.term_frequencies(sentences), 1, "tf", "term").collect()] == [("a", 2)]
    phrases = spark.createDataFrame([("a b",), ("b zz",)], "phrase string")
    known = spark.createDataFrame([("a", 0), ("b", 1)], "term string, term_id long")
    with_var = known.unionByName(spark.createDataFrame([("<VAR>", 7)], "term string, term_id long"))
    assert {r["phrase"]: r["ids"] for r in patterns.phrase_ids(phrases, known).collect()} == {"a b": [0, 1], "b zz": [1, -1]}
    assert {r["phrase"]: r["ids"] for r in patterns.phrase_ids(phrases, with_var).collect()} == {"a b": [0, 1], "b zz": [1, 7]}
    counted = patterns.orderings(spark.createDataFrame([([1, 2],), ([2, 1],), ([1, 2, 1],)], "ids array<int>"))
    assert counted.count() == 3 and patterns.of_set(counted, [2, 1, 2]).count() == 3
    asked = spark.createDataFrame([([2, 2, 1],), ([2, 1],), ([3],)], "ids array<int>")
    assert sorted(r["ids"] for r in patterns.known(counted, asked).collect()) == [[2, 1]]
    assert sorted(r["ids"] for r in patterns.known(counted, asked, exact=False).collect()) == [[2, 1], [2, 2, 1]]


def test_word_swaps_against_brute_force(spark):
    rng = random.Random(12)
    phrases = {" ".join(rng.choices(["aa", "bb", "cc", "ddd"], k=rng.randrange(3, 6))): rng.randrange(1, 50) for _ in range(70)}
    ranked = sorted(phrases, key=lambda p: (-phrases[p], p))
    spots = [(p, i, tuple(p.split(" ")[i : i + 2])) for p in ranked for i in range(len(p.split(" ")) - 1)]
    first, last = {}, {}
    for at, (_, _, g) in enumerate(spots):
        first.setdefault(g, at)
        last[g] = at

    def rest(p, g):
        s = " ".join(g)
        head, _, tail = p.partition(s)
        return head + tail[1:] if head.endswith(" ") and tail.startswith(" ") else p.replace(s, "")

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, c in enumerate(a, 1):
            old, row = row, [i]
            for j, d in enumerate(b, 1):
                row.append(min(old[j - 1] + (c != d), old[j] + 1, row[-1] + 1))
        return row[-1]

    want = Counter()
    held = sorted({(p, g) for p, _, g in spots})
    for p, g in held:
        for q, h in held:
            if g != h and sorted(g) == sorted(h) and last[g] > first[h] and " ".join(g) not in q:
                x, y = rest(p, g), rest(q, h)
                longest = max(len(x), len(y))
                if abs(len(x) - len(y)) <= 4 and (not longest or 1 - distance(x, y) / longest >= 0.7):
                    want[" ".join(g), " ".join(h)] += 1
    frame = spark.createDataFrame(list(phrases.items()), "context string, freq long")
    assert {(r["swap1"], r["swap2"]): r["freq"] for r in variants.word_swaps(frame).collect()} == want and want


def test_candidates_as_values(spark):
    from setphrase.operators import candidate

    text = "that's just like, uh, your opinion, man."
    made = candidate.CandidatePhrase.of(text)
    assert made.text == text and made == candidate.CandidatePhrase.of(text.split(" ")) == candidate.CandidatePhrase.of([{"t": w, "n": w} for w in text.split(" ")]) and len(made) == 7
    slot = candidate.CandidatePhrase.of(["a", None, "of"])
    assert str(slot) == "a <VAR> of" and slot.slots == (1,)
    with pytest.raises(TypeError):
        candidate.CandidatePhrase.of(["a", 3])
    match = candidate.CandidateMatch(slot, 5, 2, 10, ["a", "bit", "of"])
    assert (match.word_end, match.char_end, match.variable_terms, len(match)) == (5, 20, ["bit"], 10)
    docs = spark.createDataFrame([(1, "a bit of a lot of it".split())], "doc_id long, tokens array<string>")
    sel = vocab.positions(docs).withColumn("sel", F.when(F.col("term").isin("a", "of"), F.col("term")))
    found = formulas.with_chars(formulas.sub_phrases(sel, 2, 3, max_variables=9), vocab.positions(docs))
    hits = found.join(candidate.frame(spark, [slot]), "phrase", "left_semi").orderBy("word_start").collect()
    assert [(candidate.of_row(r).variable_terms, r["char_start"]) for r in hits] == [(["bit"], 0), (["lot"], 9)]
