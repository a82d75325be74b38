"""The operators against brute force, round trips and held-out labels, and on awkward rows."""

from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from setphrase.llm import embed_dedup, exact_dedup, html_main, langid, mixing, packing, queries, simhash, tokens, toxicity, url_rules, wavelet
from setphrase.llm.common import connected_components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
AWKWARD = [(1, None, "en", "a", 0), (2, "", None, "a", 0), (3, "same text here", "en", None, 1), (4, "same \t text here", "en", "b", 1), (4, "same text here", "en", "b", 1), (None, "no id at all", "de", "b", 1), (5, "x" * 30_000 + " " + "long words " * 9_000, "en", "c", 1), (6, "12 .. !!", "en", "c", 1), (7, "  \n ", "es", "c", 1)]


def docs_frame(spark, rows):
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def awkward(spark):
    # clashing names beside the known columns
    names = "id t h fp word length _w _b _bits _hit _key0 _gone0 _c0 score lang_pred _row row key node n_links topic tokens weight".split()
    return docs_frame(spark, AWKWARD).selectExpr("*", *[f"{i} as {c}" for i, c in enumerate(names)])


@pytest.fixture(scope="module")
def texts(spark, data):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{data}/documents.parquet").collect()}


def components(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_connected_components(spark):
    rng = random.Random(3)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(0, i) for i in range(300, 340)]
    found = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = components(340, links)
    assert found == {i: want[i] for i in {x for a, b in links if a != b for x in (a, b)}}


def test_embeddings_against_brute_force(spark, data):
    df = spark.read.parquet(f"{data}/embeddings.parquet")
    bad = [(-1, None), (-2, []), (-3, [0.0] * 4), (-4, [1.0, float("nan")]), (-5, [None, 1.0])]
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    rng = np.random.default_rng(1)
    base = np.array([v for _, v in rows[:60]])
    rows += [(10_000 + i, [float(x) for x in base[i % 60] + rng.normal(0, 0.12 * np.abs(base).mean(), base.shape[1])]) for i in range(600)]
    rows += [(20_000 + i, rows[0][1]) for i in range(5)]
    made = embed_dedup.near_vectors(spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>")).collect()
    ids, x = [i for i, _ in rows], np.array([v for _, v in rows], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    link = np.argwhere(np.triu(x @ x.T >= 0.9, 1))
    count = Counter(i for pair in link for i in pair)
    order = sorted(range(len(ids)), key=ids.__getitem__)
    rank = {i: k for k, i in enumerate(order)}
    roots = components(len(ids), [(rank[a], rank[b]) for a, b in link])
    found = {r["vec_id"]: r for r in made}
    assert len(made) == len(rows) + len(bad)
    want = {ids[i]: count[i] for i in range(len(ids))}
    assert all(found[i]["n_links"] <= n for i, n in want.items())
    assert sum(found[i]["n_links"] for i in want) >= 0.9 * sum(want.values())
    same = sum(found[ids[i]]["component_id"] == ids[order[roots[rank[i]]]] for i in range(len(ids)))
    assert same >= 0.98 * len(ids)
    assert all(found[i]["n_links"] == 0 and found[i]["component_id"] == i for i, _ in bad)


def test_vectors_that_share_an_id_keep_their_own_links(spark):
    rows = [(1, [1.0, 0.0, 0.0]), (1, [0.0, 1.0, 0.0]), (2, [0.99, 0.1, 0.0]), (None, [0.0, 1.0, 0.001]), (None, [0.0, 0.0, 5.0]), (3, [0.0, 0.0, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "0 as key", "1 as row", "2 as n_links", "3 as v", "4 as ok")
    found = sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in embed_dedup.near_vectors(frame).collect()), key=str)
    assert found == sorted([(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (None, 1, 1, False), (None, 0, None, True), (3, 0, 3, True)], key=str)
    lonely = [r for r in embed_dedup.near_vectors(spark.createDataFrame(rows[:3], "vec_id long, embedding array<float>")).collect()]
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in lonely) == [(1, 0, 1), (1, 1, 1), (2, 1, 1)]
    assert embed_dedup.near_vectors(frame.limit(0)).count() == 0


def test_exact_dedup_with_colliding_hashes(spark):
    rows = [(i, f"text {i % 3}", "en", "a", 0) for i in range(30)]
    found = exact_dedup.exact_duplicates(docs_frame(spark, rows), hash_128=lambda t: F.unhex(F.lit("00"))).collect()
    assert {(r["doc_id"], r["keep_id"], r["group_size"]) for r in found} == {(i, i % 3, 10) for i in range(30)}


def test_simhash_against_brute_force(spark, texts):
    some = dict(sorted(texts.items())[:150])
    rng = random.Random(5)
    for i, (k, t) in enumerate(list(some.items())[:60]):
        words = t.split(" ")
        words[rng.randrange(len(words))] = "changed"
        some[100_000 + i] = " ".join(words)
    rows = [(k, t, "en", "a", 0) for k, t in some.items()]
    ids = sorted(some)
    prints = [simhash.fingerprint(some[i]) for i in ids]
    links = [(a, b) for a in range(len(ids)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 3]
    roots = components(len(ids), links)
    found = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.simhash_groups(docs_frame(spark, rows)).collect()}
    assert found == {i: (f"{p:016x}", ids[roots[k]]) for k, (i, p) in enumerate(zip(ids, prints))}


def test_fingerprint_by_definition():
    import xxhash

    text = "One two\tthree FOUR five"
    w = ["one", "two", "three", "four", "five"]
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(3)]
    assert simhash.fingerprint(text) == sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) > 1.5)
    assert simhash.fingerprint(None) == simhash.fingerprint(" \n") == 0


def test_near_duplicates_keep_the_first(spark):
    words = [f"w{i}" for i in range(200)]
    rows = [(1, " ".join(words), "en", "a", 0), (2, " ".join([*words[:100], "x", *words[101:]]), "en", "a", 0), (3, " ".join(reversed(words)), "en", "a", 0)]
    assert {r["doc_id"] for r in simhash.drop_near_duplicates(docs_frame(spark, rows)).collect()} == {1, 3}


@pytest.fixture(scope="module")
def library():
    """The tokenizer as its file gives it."""
    import public_tokenizers
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return lambda text: made.encode(text, add_special_tokens=False).ids


def test_tokens_equal_the_library(texts, library):
    enc = tokens.encoder()
    rng = random.Random(1)
    odd = ["", "Don't STOP! <|endoftext|> — 3.14", "hello <|endoftext|> world", "<|startoftext|><|STARTOFTEXT|>A<|endoftext", "<|end<|endoftext|>oftext|>", "ÀÉßÿ café über²", "İstanbul ﬁ"] + ["".join(rng.choice("aB'3 .,-éÀß×\t\nxyz<>|/") for _ in range(50)) for _ in range(200)]
    every = odd + list(texts.values())[:100]
    assert [np.frombuffer(x, "<u2").tolist() for x in enc.ids(every)] == [library(t) for t in every]
    assert library("hello <|endoftext|> world")[1] == 49407


def test_wavelet_matrix_answers_like_a_list():
    rng = np.random.default_rng(2)
    for size, top in ((0, 1), (1, 1), (700, 1), (3000, 5), (5000, 40_000), (150_000, 900)):
        ids = rng.integers(0, top, size).astype("<u2")
        m = wavelet.WaveletMatrix(wavelet.build(ids, np.array([1], np.int64), np.array([size], np.int64)))
        assert len(m._open) <= m.planes  # nothing but the planes' last blocks has been unpacked
        assert m.decode().tolist() == ids.tolist()
        for i in rng.integers(0, max(1, size), 20) if size else ():
            token = int(ids[i])
            assert m.access(int(i)) == token
            at = np.flatnonzero(ids == token)
            assert m.count(token) == len(at) and m.count(token, int(i)) == int((at < i).sum())
            k = int(rng.integers(0, len(at)))
            assert m.select(token, k) == at[k] and m.select(token, len(at)) == -1
        assert m.count(65535) == 0


def test_shards_round_trip(spark, data, texts, library):
    start, want = 0, {}
    for k in sorted(texts):
        ids = np.array([*library(texts[k]), 1], "<u4")
        want[k] = (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    found = queries.op3_wavelet_shards(spark, str(data)).collect()
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in found} == want


def check_packing(rows, size=2048):
    at = {}
    for r in rows:
        at.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in at.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= size
    return len(at)


def test_packing_is_whole_and_tight(spark, data, texts, library):
    rows = queries.op4_best_fit_packing(spark, str(data)).collect()
    want = set()
    for k, t in texts.items():
        ids = np.array([*library(t), 0], "<u4")
        want |= {(k, p, a, len(ids[a : a + 2048]), zlib.crc32(ids[a : a + 2048].tobytes())) for p, a in enumerate(range(0, len(ids), 2048))}
    assert {(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows} == want
    lower = -(-sum(r["length"] for r in rows) // 2048)
    assert check_packing(rows) <= lower * 1.01 + 2


@pytest.mark.parametrize("kind", ["hot", "halves", "skewed", "few"])
def test_packing_places_pieces_by_configurations(kind, monkeypatch):
    """Nearly all pieces by rounded configurations, close to the dual bound, also where best-fit has an easy time."""
    rng = np.random.default_rng(7)
    lengths = {"hot": [700] * 5000 + rng.integers(1, 2049, 5000).tolist(), "halves": rng.integers(1024, 2048, 3000).tolist(), "skewed": np.clip(rng.lognormal(5.8, 1.1, 20_000).astype(int), 1, 2048).tolist(), "few": rng.integers(1, 2049, 150).tolist()}[kind]
    histogram, rest = dict(Counter(lengths)), []
    plain = packing.best_fit
    monkeypatch.setattr(packing, "best_fit", lambda h, size: rest.append(dict(h)) or plain(h, size))
    made = packing.solve(histogram, 2048)
    placed = Counter()
    for pattern, n in made:
        assert sum(x * k for x, k in pattern) <= 2048
        for x, k in pattern:
            placed[x] += n * k
    assert placed == histogram
    assert sum(sum(h.values()) for h in rest) <= 0.05 * len(lengths)
    _, bound = packing.start_prices(np.array(list(histogram)), np.array(list(histogram.values())), 2048)
    assert sum(n for _, n in made) <= min(1.005 * bound + 3, 1.005 * sum(n for _, n in plain(histogram, 2048)) + 2)


def test_packing_in_small_buckets(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = packing.pack(docs, bucket_rows=3).collect()
    assert check_packing(rows) == check_packing(packing.pack(docs).collect()) and len({(r["doc_id"], r["piece"]) for r in rows}) == len(rows)


def test_language_on_held_out_documents(spark, data):
    found = queries.op8_language_id(spark, str(data).replace("sf0.001", "sf0.01"))
    docs = spark.read.parquet(str(data).replace("sf0.001", "sf0.01") + "/documents.parquet").select("doc_id", "lang")
    held = found.where("held_out and lang_pred <> 'und'").join(docs, "doc_id").where("lang is not null")
    assert held.where(F.col("lang") == F.col("lang_pred")).count() >= 0.95 * held.count()


def test_language_edges(spark, awkward):
    model = langid.train(awkward, F.lit(True))
    found = [(r["doc_id"], r["lang_pred"], r["score"]) for r in langid.identify(awkward, model).collect()]
    assert {i for i, lang, _ in found if lang == "und"} == {1, 2, 6, 7}
    assert all(0 <= s <= 1 for _, _, s in found) and len(found) == len(AWKWARD)


def test_toxicity_on_held_out_documents(spark, data):
    folder = str(data).replace("sf0.001", "sf0.1")
    found = queries.op5_toxicity(spark, folder).where("held_out").join(spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "toxic"), "doc_id").where("toxic is not null").collect()
    hit = sum(r["predicted"] and r["toxic"] for r in found)
    print(f"{hit} of {sum(r['toxic'] for r in found)} toxic rows, {sum(r['predicted'] for r in found)} predicted")
    assert hit >= 0.8 * sum(r["toxic"] for r in found)
    assert hit >= 0.9 * sum(r["predicted"] for r in found)


def test_toxicity_against_brute_force(spark):
    """Both forms of the model against sums over dictionaries, and rows of the held-out fold, which must teach nothing."""
    from math import exp, log, sqrt

    rng = random.Random(2)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8))) for _ in range(300)]
    rows, labels = [], []
    for i in range(400):
        toxic = i % 5 == 0
        words = rng.choices(vocabulary, k=rng.randrange(3, 40)) + (rng.sample(["awfulest", "awful", "baddie", "badd"], 2) if toxic else [])
        rows.append((i, " ".join(words), "en", "a", 0))
        labels.append((i, int(toxic)))
    docs, known = docs_frame(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(docs, known)
    flipped = spark.createDataFrame([(i, 1 - y if zlib.crc32(str(i).encode()) % 3 == 1 else y) for i, y in labels], "doc_id long, toxic int")
    assert toxicity.train(docs, flipped).weights.tolist() == model.weights.tolist()
    counts = [Counter() for _ in range(6)]
    for (_, text, *_), (i, y) in zip(rows, labels):
        if zlib.crc32(str(i).encode()) % 3 != 1:
            for level, n in enumerate((4, 5, 99)):
                counts[2 * level + 1 - y].update(w[:n] for w in set(text.split()))
    totals = [sum(c.values()) for c in counts]

    def own(level, u, z):
        c, n = counts[2 * level : 2 * level + 2], totals[2 * level : 2 * level + 2]
        s = min((c[k][u] + 1) / n[k] for k in (0, 1))
        return [max(c[k][u] - 0.75 - 2 * n[k] * s - z * sqrt(n[k] * s), 0) / n[k] for k in (0, 1)], s + 0.1 * (c[0][u] + c[1][u] + 1) / sum(n)

    def ratio(word):
        p = [1.0, 1.0]
        for level, n in enumerate((4, 5, 99)):
            every = [own(level, u, model.z) for u in {*counts[2 * level], *counts[2 * level + 1]}]
            left = [1 - sum(o[k] for o, _ in every) for k in (0, 1)]
            mine, shared = own(level, word[:n], model.z)
            p = [left[k] * p[k] + mine[k] * sum(s for _, s in every) / shared for k in (0, 1)]
        return log(p[0] / p[1])

    new = ["awfully bad awful awful", "", None, "abc badd unheard abc", rows[0][1]]
    frame = docs_frame(spark, [(i, t, "en", "a", 0) for i, t in enumerate(new)]).selectExpr("*", "1 as words", "2 as row", "3 as id", "4 as score")
    want = []
    for text in new:
        words, base = (text or "").split(), ratio("unheard")
        mean = sum(map(ratio, words)) / len(words) if words else base
        above = sum(ratio(w) - base for w in set(words)) / sqrt(max(1, len(set(words))))
        x = model.weights @ np.array([mean, mean * sqrt(len(words)), above, 1.0])
        want.append(1 / (1 + exp(-max(-30, min(30, x)))))
    table = toxicity.train(docs, known, units_sent=0)
    assert isinstance(table, toxicity.TableModel)
    for m in (model, table):
        found = {r["doc_id"]: r["score"] for r in toxicity.score(frame, m).collect()}
        assert [round(found[i], 9) for i in range(len(new))] == [round(x, 9) for x in want]
    assert want[0] > 0.5 > want[1]


def test_url_rules_and_index_agree():
    rng = random.Random(4)
    rules = [*queries.HOST_RULES, *url_rules.DEFAULT_PATTERNS]
    index = url_rules.RuleIndex(rules, {})
    urls = [None, "", "no scheme", "http://EXAMPLE.com/en/7x?q", "http://a.example.net/de/8#f", "https://x.org", "http://com/en/"] + ["http://" + "".join(rng.choice(["a", "example", ".", "com", "net", "/", "en", "de", "7", "8", "casino", "-", "online", "?"]) for _ in range(9)) for _ in range(3000)]
    for url in urls:
        host, path = url_rules.parts(url)
        fits = [r for r in queries.HOST_RULES if r.fits(host, path)]
        best = max(fits, key=lambda r: len(r.name), default=None)
        import re

        pattern = any(re.search(p.pattern, host + path.lower()) for p in url_rules.DEFAULT_PATTERNS)
        assert index.judge(url) == (host, path, best and best.name, best.verdict if best else "block" if pattern else "allow")


def test_url_rules_are_those_of_the_contract():
    contract = "block com/en/, allow example.com/en/7, allow net/de/, block example.net/de/8, block org/es/"
    assert [f"{r.verdict} {r.name}" for r in queries.HOST_RULES] == contract.split(", ")
    index = url_rules.RuleIndex([*queries.HOST_RULES, *url_rules.DEFAULT_PATTERNS], {})
    judged = {u: index.judge(u)[2:] for u in ("https://a.net/de/1", "https://casino-bonus.net/de/1", "https://example.net/de/8", "https://example.com/en/71", "https://x.com/en/7")}
    assert list(judged.values()) == [("net/de/", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("example.com/en/7", "allow"), ("com/en/", "block")]


def test_main_text():
    page = "<html><head><title>T</title><style>p{}</style></head><body><nav><a>Home</a></nav><div class='ads'>Buy</div><article><h1>Head &amp; tail</h1><p>First  para, with words.<p>Second <b>bold</b> para.</article><div id=comments><p>Nice!</p></div><footer>c</footer><script>x<y</script></body></html>"
    assert html_main.main_text(page) == "Head & tail First para, with words. Second bold para."
    assert html_main.main_text(None) == html_main.main_text("") == html_main.main_text("<nav>x</nav>") == ""


def test_main_text_takes_names_and_forms_as_evidence():
    m, body = html_main.main_text, "Many long words, and more of them. " * 40
    assert m("<form><article><h1>T</h1><p>One two, three.</p></article></form><p>x</p>") == "T One two, three. x"
    assert m("<div><p title=don't>Para one, with words.</p><p>Two, more.</p></div>") == "Para one, with words. Two, more."
    assert m("<div><div class='side-by-side'><p>Para one, with words.</p></div><p>Two, more.</p></div>") == "Para one, with words. Two, more."
    assert m(f"<div class='banner top'>Sale, now.</div><form id=aspnet><div><h1>Head</h1><p>{body}</p></div></form><div class='cookie-notice'>We use, cookies.</div>") == f"Head {body.strip()}"
    assert m("<article class=post><h1>A</h1><p>Text, one.</p><div class=comments><article class=comment><p>Nice, one.</p></article></div></article>") == "A Text, one."
    assert m("<article class=comment><p>Nice, one.</p></article><article><p>The article, itself.</p></article>") == "The article, itself."
    assert m("<article><p>1 &lt; 2 &amp;amp; &#x41;&nbsp;b, <script>if (a<b) {</script>c<!-- <p> --> d.<p a=\"<b>\" b='>'>e, f.</article>") == "1 < 2 &amp; A b, c d. e, f."
    assert m("a < b, and <c>d</c> <") == "a < b, and d <"


HOSTILE = {"tags": "<a " * 350_000, "quotes": '<a b="x' * 140_000, "deep": "<div>" * 200_000 + "text, here", "texts": "<div>x, " * 120_000, "ends": "<b><div>" * 80_000 + "</b>" * 80_000, "unknown": "<div>" * 100_000 + "</x>" * 100_000, "comments": "<!--" * 250_000, "signs": "<" * 1_000_000, "paragraphs": "<p>x" * 250_000, "equals": "<a " + "= " * 500_000}


@pytest.mark.parametrize("kind", HOSTILE)
def test_main_text_of_hostile_pages(kind):
    import time

    began = time.perf_counter()
    html_main.main_text(HOSTILE[kind])
    assert time.perf_counter() - began < 6  # a second or less on an idle machine; minutes if it were quadratic


def test_mixing_meets_its_marginals():
    rng = np.random.default_rng(0)
    codes = np.array([np.repeat(range(3), 4), np.tile(range(4), 3)])
    cells = rng.uniform(1, 100, 12)
    targets = [np.array([0.2, 0.3, 0.5]), np.array([0.1, 0.2, 0.3, 0.4])]
    made = mixing.rake(cells, codes, targets, 200) * cells
    for code, target in zip(codes, targets):
        assert np.allclose(np.bincount(code, made) / made.sum(), target, atol=1e-6)


def test_mixing_on_driver_and_by_joins(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = lambda n: {(r["doc_id"], round(r["weight"], 6), r["sampled"]) for r in mixing.mixed(docs, rounds=3, cells_on_driver=n).collect()}
    assert rows(200_000) == rows(0)


def _shards(d):
    from setphrase.llm.common import shared_folder

    path = shared_folder(d.sparkSession, "shards")
    wavelet.write_shards(d, path)
    return wavelet.read_shards(d.sparkSession, path)


OPERATORS = {
    "exact_dedup": lambda d: exact_dedup.exact_duplicates(d),
    "simhash": lambda d: simhash.simhash_groups(d),
    "packing": lambda d: packing.pack(d).select("doc_id", "piece").where("piece = 0"),
    "mixing": lambda d: mixing.mixed(d),
    "html": lambda d: html_main.extract(d.withColumnRenamed("doc_id", "page_id").withColumnRenamed("source", "url").withColumnRenamed("text", "html")),
    "url": lambda d: url_rules.judge_urls(d.withColumnRenamed("doc_id", "page_id").withColumnRenamed("text", "url"), queries.HOST_RULES),
    "language": lambda d: langid.identify(d, langid.train(d, F.lit(True))),
    "embeddings": lambda d: embed_dedup.near_vectors(d.withColumnsRenamed({"doc_id": "vec_id"}).withColumn("embedding", F.expr("array(n_chars, 1.0D, vec_id)"))),
    "shards": lambda d: _shards(d),
    "toxicity": lambda d: toxicity.score(d, toxicity.train(d, d.selectExpr("doc_id", "cast(doc_id % 2 as int) as toxic"))),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_awkward_rows(spark, awkward, name):
    assert OPERATORS[name](awkward).count() == len(AWKWARD)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, awkward, name):
    assert OPERATORS[name](awkward.limit(0)).count() == 0


def test_values_of_awkward_rows(spark, awkward, library):
    """Nulls, empty and long texts, ties and repeated rows have the results that the docstrings give them."""
    text = {i: t or "" for i, t, *_ in AWKWARD if i != 4}
    exact = Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_duplicates(awkward).collect())
    assert exact == Counter({(1, 1, 2, True): 1, (2, 1, 2, False): 1, (3, 3, 3, True): 1, (4, 3, 3, False): 2, (None, None, 1, True): 1, (5, 5, 1, True): 1, (6, 6, 1, True): 1, (7, 7, 1, True): 1})
    groups = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.simhash_groups(awkward).collect()}
    assert all(groups[i][0] == f"{simhash.fingerprint(t):016x}" for i, t in text.items())
    assert groups[1] == groups[2] == groups[7] == ("0" * 16, 1) and groups[4][1] == 3 and groups[None][1] is None
    want = {i: (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for i, t in text.items() for ids in [[*library(t), 1]]}
    shards = {r["doc"]: (r["n"], r["crc"]) for r in _shards(awkward).collect()}
    assert all(shards[i] == x for i, x in want.items()) and shards[1] == (1, zlib.crc32(np.array([1], "<u4").tobytes()))
    packed = packing.pack(awkward).collect()
    assert sum(r["length"] for r in packed if r["doc_id"] == 5) == want[5][0] and max(r["length"] for r in packed) <= 2048 < want[5][0]
    mixed = {r["doc_id"]: (r["tokens"], r["topic"], r["sampled"]) for r in mixing.mixed(awkward).collect()}
    assert mixed[1] == mixed[2] == mixed[7] == (0, "none", True) and mixed[5][:2] == (18_001, "long") and mixed[6][:2] == (3, "none")
    scores = {r["doc_id"]: r["score"] for r in OPERATORS["toxicity"](awkward).collect()}
    assert scores[1] == scores[2] == scores[7] and scores[3] == scores[4] and all(0 <= s <= 1 for s in scores.values())
    hosts = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in OPERATORS["url"](awkward).collect()}
    assert set(hosts.values()) == {("", "", None, "allow")}
    pages = {r["page_id"]: (r["text"], r["n_chars"]) for r in OPERATORS["html"](awkward).collect()}
    long = " ".join(text[5].split())
    assert pages[1] == pages[2] == pages[7] == ("", 0) and pages[5] == (long, len(long)) and pages[4] == ("same text here", 14)


def test_awkward_shards(spark, awkward, tmp_path):
    for df, n in ((awkward, len(AWKWARD)), (awkward.limit(0), 0)):
        wavelet.write_shards(df, f"{tmp_path}/{n}")
        rows = wavelet.read_shards(spark, f"{tmp_path}/{n}").collect()
        assert len(rows) == n
        rows = sorted(rows, key=lambda r: r["start"])
        assert [r["start"] for r in rows] == np.cumsum([0, *(r["n"] for r in rows)])[:-1].tolist()


def test_duplicates_of_awkward_rows(spark, awkward):
    kept = exact_dedup.drop_exact_duplicates(awkward)
    assert kept.columns == awkward.columns
    assert sorted(r["doc_id"] or 0 for r in kept.select("doc_id").collect()) == [0, 1, 3, 5, 6, 7]


def brute_force_pipeline(docs, tokens_of):
    """Pieces (doc_id, piece, start, length, crc) of the documents that all stages keep, by dictionaries and all pairs."""
    import hashlib
    import re

    docs = {i: t for i, t in docs.items() if t and any(c.isalpha() for c in t[0])}
    first = {}
    for i in sorted(docs):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", docs[i][0]), i)
    docs = {i: docs[i] for i in first.values()}
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", t.translate({c: c + 32 for c in range(65, 91)})) for i, (t, *_) in docs.items()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, w in words.items()}
    ids = sorted(docs)
    links = [(a, b) for a in range(len(ids)) for b in range(a) if len(sets[ids[a]] & sets[ids[b]]) >= 0.8 * len(sets[ids[a]] | sets[ids[b]])]
    docs = {i: docs[i] for i, root in zip(ids, components(len(ids), links)) if ids[root] == i}

    def form(t):
        letters = sum(c.isalpha() for c in t)
        other = sum(not c.isalpha() and c not in " \t\n\v\f\r" for c in t)
        return "none" if not letters else "symbols" if letters < 3 * other else "short" if len(t) < 1000 else "medium" if len(t) < 10_000 else "long"

    cell = {i: (source, lang, form(t)) for i, (t, lang, source) in docs.items()}
    sums = Counter()
    for i in docs:
        sums[cell[i]] += len(words[i])
    total, weight = sum(sums.values()), {c: float(n) for c, n in sums.items()}
    targets = []
    for d in range(3):
        own = Counter()
        for c, n in sums.items():
            own[c[d]] += n / total
        scale = sum(x**0.9 for x in own.values())
        targets.append({v: x**0.9 / scale * total for v, x in own.items()})
    for _ in range(mixing.ROUNDS):
        for d in range(3):
            now = Counter()
            for c, w in weight.items():
                now[c[d]] += w
            weight = {c: w * targets[d][c[d]] / now[c[d]] for c, w in weight.items()}
    factor = {c: w / sums[c] for c, w in weight.items()}
    drawn = lambda i: int(hashlib.md5(f"mix:{i}".encode()).hexdigest()[:13], 16) / 2**52
    docs = {i: t for i, t in docs.items() if drawn(i) < factor[cell[i]] / max(factor.values())}
    made = set()
    for i, (t, *_) in docs.items():
        every = np.array([*tokens_of(t), 0], "<u4")
        made |= {(i, p, a, len(every[a : a + 2048]), zlib.crc32(every[a : a + 2048].tobytes())) for p, a in enumerate(range(0, len(every), 2048))}
    return made


def test_pipeline_against_brute_force(spark, data, library):
    import corpus_pipeline

    docs = {r["doc_id"]: (r["text"], r["lang"], r["source"]) for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    rows = corpus_pipeline.run(spark, str(data)).collect()
    want = brute_force_pipeline(docs, library)
    assert {(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows} == want and len(rows) == len(want)
    assert len({r["doc_id"] for r in rows}) >= 50
    check_packing(rows)


@pytest.mark.parametrize("stage", ["language_id", "exact_dedup", "simhash_near_dedup", "source_mixing"])
def test_stages_on_awkward_rows(spark, awkward, stage):
    """Whole rows stay, of all columns; the long text, which nothing resembles, is among them."""
    import corpus_pipeline

    run = dict(corpus_pipeline.STAGES)[stage]
    kept = run(spark, awkward, "")
    assert kept.columns == awkward.columns and run(spark, awkward.limit(0), "").count() == 0
    rows, given = [tuple(r) for r in kept.collect()], Counter(tuple(r) for r in awkward.collect())
    assert not Counter(rows) - given
    ids = Counter(r[0] for r in rows)
    want = {"language_id": {3: 1, 4: 2, None: 1, 5: 1}, "exact_dedup": {1: 1, 3: 1, None: 1, 5: 1, 6: 1, 7: 1}, "simhash_near_dedup": {1: 1, 3: 1, None: 1, 5: 1, 6: 1}}
    assert stage not in want or ids == want[stage]
    assert run(spark, awkward.unionByName(awkward), "").count() >= len(rows)


def test_last_stage_on_awkward_rows(spark, awkward):
    import corpus_pipeline

    rows = corpus_pipeline.pack(spark, awkward, "").collect()
    assert Counter(r["doc_id"] for r in rows if r["piece"] == 0) == Counter(r[0] for r in AWKWARD)
    check_packing(rows)


@pytest.mark.parametrize("sizes", [[16] * 4, [22, 21, 21], [32, 32], [13, 13, 13, 13, 12], [8] * 8])
@pytest.mark.parametrize("block", [2048, 7])
def test_near_links_by_any_partitions(spark, sizes, block, monkeypatch):
    rng = random.Random(9)
    tau = max(3, len(sizes) - 1)
    prints = {rng.getrandbits(64) for _ in range(150)}
    for p in list(prints)[:100]:
        for _ in range(2):
            prints.add(p ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(1, tau + 3))))
    prints = sorted(prints)
    links = [(a, b) for a in range(len(prints)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= tau]
    monkeypatch.setattr(simhash, "BLOCK", block)
    rows = [(p - (1 << 64) if p >> 63 else p, i) for i, p in enumerate(prints)]
    made = simhash.near_links(spark.createDataFrame(rows, "fp long, rep long"), tau, sizes).collect()
    assert components(len(prints), [(r["a"], r["b"]) for r in made]) == components(len(prints), links)
    assert simhash.widths(100_000, 3) == [16] * 4 and simhash.widths(10**8, 3) == [22, 21, 21] and simhash.widths(10**10, 3) == [32, 32]


def near_rows(spark, texts):
    return docs_frame(spark, [(k, t, "en", "a", 0) for k, t in texts])


def test_near_links_are_checked_before_a_forest(spark, monkeypatch):
    """Chains and a smallest id that is near by its fingerprint only: B and C are copies all the same."""
    words = [f"w{i}" for i in range(300)]
    edit = lambda w, at, by: [*w[:at], *by, *w[at + len(by) :]]
    b = edit(words, 20, [f"b{i}" for i in range(28)])
    c = edit(b, 290, ["c"])
    d = edit(c, 200, [f"d{i}" for i in range(28)])
    monkeypatch.setattr(simhash, "near_links", lambda nodes, tau: spark.createDataFrame([(2, 1), (3, 1), (4, 1)], "a long, b long"))
    rows = [(1, " ".join(edit(words, 60, [f"a{i}" for i in range(40)]))), (2, " ".join(b)), (3, " ".join(c)), (4, " ".join(d))]
    sets = [set(simhash.shingle_hashes(t.encode(), 5).__next__().tolist()) for _, t in rows]
    near = [(i + 1, j + 1) for j in range(4) for i in range(j) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    assert near == [(2, 3), (3, 4)] or near == [(2, 3), (2, 4), (3, 4)]
    for members in (512, 1):
        monkeypatch.setattr(simhash, "MEMBERS", members)
        assert {r["doc_id"] for r in simhash.drop_near_duplicates(near_rows(spark, rows)).collect()} == {1, 2}


def test_near_duplicates_recall_from_0_8(spark):
    """Scattered one-word edits and truncated texts, held to the shingle sets themselves."""
    rng = random.Random(11)
    rows, near = [], 0
    for i in range(400):
        words = [f"w{rng.randrange(100_000)}" for _ in range(rng.randrange(80, 300))]
        want, n = rng.uniform(0.8, 0.9), len(words)
        if i % 2:
            other = words[: max(5, round(want * (n - 4)) + 5)]
        else:
            other = list(words)
            for at in rng.sample(range(n), max(1, round((1 - want) / (1 + want) * n / 5))):
                other[at] = f"x{i}"
        x, y = (set(zip(*(w[k:] for k in range(5)))) for w in (words, other))
        if len(x & y) >= 0.8 * len(x | y):
            near += 1
            rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
    kept = {r["doc_id"] for r in simhash.drop_near_duplicates(near_rows(spark, rows)).select("doc_id").collect()}
    found = sum(k not in kept for k, _ in rows if k % 2)
    print(f"recall {found} of {near}")
    assert near >= 250 and all(k in kept for k, _ in rows if k % 2 == 0)
    assert found >= 0.98 * near


def test_near_duplicates_of_one_fingerprint(spark):
    """Texts that repeat one shingle have its hash as fingerprint, whatever else they say."""
    junk = "buy now cheap " * 120
    texts = [junk + " ".join(f"{k}{i}" for i in range(60)) for k in "abc"]
    assert len({simhash.fingerprint(t) for t in texts}) == 1
    texts.append(texts[1].replace("b30", "x"))
    assert {r["doc_id"] for r in simhash.drop_near_duplicates(near_rows(spark, list(enumerate(texts)))).collect()} == {0, 1, 2}


def test_rows_with_null_or_repeated_ids_are_decided_one_by_one(spark):
    words = [f"w{i}" for i in range(200)]
    first, copy, other, third = " ".join(words), " ".join([*words[:199], "x"]), "another text " * 3 + "altogether", "a third text"
    pairs = lambda df: {(r["doc_id"], r["text"]) for r in df.collect()}
    near = near_rows(spark, [(1, first), (None, copy), (None, other), (7, copy + " y"), (7, third)])
    assert pairs(simhash.drop_near_duplicates(near)) == {(1, first), (None, other), (7, third)}
    exact = near_rows(spark, [(1, first), (7, first), (7, third)])
    assert pairs(exact_dedup.drop_exact_duplicates(exact)) == {(1, first), (7, third)}
    nameless = [(None, f"text number {i} of many") for i in range(200)] + [(1, "long " * 3000)]
    mixed = mixing.sample(near_rows(spark, nameless), targets={"topic": {"short": 0.02, "long": 0.98}})
    assert 0 < sum(i is None for i, _ in pairs(mixed)) < 200


@pytest.mark.parametrize("long", ["<div class=body>{}</div>", "<section>{}</section>", "<blockquote>{}</blockquote>", "<ul><li>{}</ul>", "<table><tr><td>{}</table>", "<pre>{}</pre>"])
@pytest.mark.parametrize("around", ["article", "main", "div"])
def test_main_text_beside_one_long_container(long, around):
    body = "Many long words, and more of them. " * 60
    page = f"<html><body><nav><a>Home</a></nav><div><a>One link</a> <a>two</a></div><{around}><h1>Head</h1><p>Lead.</p>{long.format(body)}<p>End.</p></{around}><footer>c</footer></body></html>"
    assert html_main.main_text(page) == f"Head Lead. {body.strip()} End."
